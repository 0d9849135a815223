import random
import re
from collections import Counter

from cases import EDGES
from textlake.llm import licences
from textlake.llm.licence_texts import PHRASES, TEMPLATES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_places(text):
    """Brute force: (start, phrase) wherever a phrase's words stand."""
    words = plain_words(text)
    return sorted((i, p) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def plain_chains(words, template, shortest=licences.SHORTEST, gap=licences.GAP):
    """Brute force: the best chain's coverage. Pieces are all runs that neither end can be made longer at the right."""
    pieces = []
    for i in range(len(words)):
        longest = max((n for n in range(len(words) - i + 1) if any(words[i : i + n] == template[x : x + n] for x in range(len(template) - n + 1))), default=0)
        if longest >= shortest and not (i and any(words[i - 1 : i + longest] == template[x : x + longest + 1] for x in range(len(template) - longest))):
            pieces += [(i, i + longest, x) for x in range(len(template) - longest + 1) if words[i : i + longest] == template[x : x + longest]]
    best = {}
    for a, b, x in sorted(pieces):
        best[a, b, x] = max([b - a, *(v + b - a - max(0, d - a, y + d - c - x) for (c, d, y), v in best.items() if c < a and y < x <= y + d - c + gap and a <= d + gap)])
    return max(best.values(), default=0)


def changed(rnd, text):
    words = text.split()
    for _ in range(rnd.randint(0, 4)):
        k = rnd.randrange(len(words))
        words[k : k + rnd.choice((0, 1, 1, 2))] = rnd.choice(([], ["foo"], ["the"], words[: rnd.randint(0, 9)]))
    return " ".join(words)


def texts(rnd, n):
    out = []
    for _ in range(n):
        parts = [rnd.choice(("In other words.", "MIT License", "the APACHE, license!", "general\npublic-license", "mitlicense mit  license é", "General Public Licensé", changed(rnd, rnd.choice(TEMPLATES)[1]))) for _ in range(rnd.randint(0, 4))]
        out.append(rnd.choice((" ", ". ", "\n")).join(parts))
    return out


def test_places_by_brute_force():
    rnd, known = random.Random(5), licences.Templates(PHRASES, TEMPLATES)
    for t in [*texts(rnd, 400), *(t or "" for _, t in EDGES)]:
        n, found, spans, score = known.scan(t.encode())
        assert n == len(plain_words(t))
        assert sorted((a, known.phrases[p]) for a, p in found) == plain_places(t), t
        assert all(0 <= a < b <= n for a, b, *_ in spans) and 0 <= score <= 1
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_coverage_by_brute_force():
    rnd = random.Random(6)
    for _ in range(40):
        label, template = rnd.choice([t for t in TEMPLATES if len(t[1]) < 700])
        text = "before " + changed(rnd, template) + " behind " + changed(rnd, template)
        known = licences.Templates({}, [(label, template)])
        want = plain_chains(plain_words(text), plain_words(template)) / len(plain_words(template))
        _, _, spans, score = known.scan(text.encode())
        assert score == want, text
        assert any(s[4] == want for s in spans) == (want >= licences.COVER)


def test_templates_are_found_whole_and_with_other_holders():
    known = licences.Templates(PHRASES, TEMPLATES)
    for label, text in TEMPLATES:
        words = plain_words(text)
        spans = known.scan(("Copyright A. N. Other. " + text + " And so on.").encode())[2]
        assert [(s[2], s[3], s[4]) for s in spans] == [(label, len(words), 1.0)]
    holder = next(t for label, t in TEMPLATES if label == "bsd").replace("COPYRIGHT HOLDERS AND", "REGENTS OF THE COLLEGE AND")
    assert [s[2] for s in known.scan(holder.encode())[2]] == ["bsd"]
    assert known.scan(b"the software is what it is, and may be used by anyone who has a copy of it")[2:] == ([], 0.0)


def test_blocks_do_not_cut_words(monkeypatch):
    monkeypatch.setattr(licences, "BLOCK", 3)
    assert list(licences.words_of("The Cat, sat—on  a2 É".encode())) == [w.encode() for w in plain_words("The Cat, sat—on  a2 É")]


def test_scan_and_digest(docs, spark):
    rows = [*EDGES, (50, "x MIT License, Apache License; mit license"), (51, TEMPLATES[0][1]), (52, "word " * 300_000 + "mit license")]
    out = licences.licence_digest(licences.scan_licences(docs(*rows)))
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    got = out.collect()
    want = []
    for i, t in rows:
        at = plain_places(t)
        want.append((i, len(plain_words(t)), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({PHRASES[p] for _, p in at}))))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[51].labels == "mit" and by_id[51].base_labels == "" and by_id[50].labels == "apache,mit" and by_id[52].last_word == 300_000
    assert licences.scan_licences(docs()).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(x'ff206d6974206c6963656e7365' as string) as text, 2 as n_words, 3 as spans")
    assert licences.licence_digest(licences.scan_licences(broken)).first().n_base == 1

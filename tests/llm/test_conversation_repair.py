import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from textlake.llm import conversation_repair, queries

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
        out += [row] * {0: 0, 3: 2}.get(way, 1)
    return out


def plain_repair(rows):
    """Brute force on a conversation's rows (turn, role, text): the least (cost, audit) from each place to the end, as a whole string."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, put_in):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, rest):
            if rest:
                options.append((cost + rest[0], letter + rest[1], (line, *rest[2]) if line is not None else rest[2]))

        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in steps and put_in < 3:
                add(3, "I", f"{name}:", best(i, steps[state, c], put_in + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(4, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if (state, role[:1]) in steps:
                    add(more, "K", f"{role}:{text}", best(i + 1, steps[state, role[:1]], 0))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in steps:
                        add(3 + more, "R", f"{name}:{text}", best(i + 1, steps[state, c], 0))
        return min(options) if options else None

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
    }


def plain(rows):
    by = defaultdict(list, {r[0]: [] for r in rows})
    for conv, *row in plain_damage(rows):
        by[conv].append(tuple(row))
    return {conv: plain_repair(by[conv]) for conv in by}


def invented(rnd, n, longest=12):
    rows = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rnd.randint(1, longest)):
            role = rnd.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "ünknown", "s"))
            text = rnd.choice((None, "", " \n", "Yes.", "Yes.", "no", "What? ", "Well\t", "ok!\x0b", "a\x1c", "…", "long " * 30 + rnd.choice("ab.")))
            rows.append((conv, rnd.choice((turn, turn, turn, None, turn + 3, -turn)), role, text))
            rows += [rows[-1]] * rnd.choice((0, 0, 0, 0, 1, 3))
            turn += rnd.choice((0, 1, 1, 1, 2))
    rnd.shuffle(rows)
    return rows


def repaired(spark, rows, partitions=5, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, block int").repartition(partitions)
    out = conversation_repair.repair(df, **options).collect()
    found = {r.conv_id: r.asDict() for r in out}
    assert len(found) == len(out)
    for r in found.values():
        del r["conv_id"]
    return found


@pytest.mark.parametrize("block_rows", [conversation_repair.BLOCK_ROWS, 3])
def test_repair_by_brute_force(spark, block_rows):
    """Also with conversations that are cut into many blocks, over borders of tasks."""
    rows = invented(random.Random(block_rows), 120)
    found, want = repaired(spark, rows, block_rows=block_rows), plain(rows)
    for conv in want:
        assert found[conv] == want[conv], (conv, [r for r in rows if r[0] == conv])
    assert found.keys() == want.keys()


def test_one_conversation_over_many_blocks_and_tasks(spark):
    rnd = random.Random(9)
    rows = [(7, k, rnd.choice(("user", "assistant", "user", "assistant", "system")), rnd.choice((f"t{k}.", f"t{k}", "same.", ""))) for k in range(600)] + [(7, 3, "user", "copy.")] * 50 + [(8, 1, "user", "a.")]
    assert repaired(spark, rows, block_rows=16) == plain(rows)


def test_codes_over_blocks_are_those_of_the_whole():
    rnd = random.Random(4)
    for _ in range(300):
        codes = bytes(rnd.choice((0, 1, 2, 3, 5, 6, 8, 9, 10, 11, 21)) for _ in range(rnd.randint(1, 14)))
        cut = sorted(rnd.sample(range(1, len(codes)), min(len(codes) - 1, rnd.randint(0, 4))))
        blocks = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)])]
        cost, (whole,), _ = conversation_repair.repair_codes([codes])
        cost_of_blocks, parts, _ = conversation_repair.repair_codes(blocks)
        assert (cost, whole) == (cost_of_blocks, "".join(parts))


def test_nothing_left_and_empty_tables(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = repaired(spark, [(dropped, 0, "user", "a")])
    assert found == {dropped: {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(none).count() == 0


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_conversations(spark, sf).collect()}
    assert found == plain(rows)

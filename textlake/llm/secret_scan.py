"""Secret scans with multipart credential linking.

Base kinds are found by pattern in the whole text. On top of them, parts of credentials are gathered: access
identifiers, secrets and endpoints. Each part has a scope, its span widened by `reach` characters to both sides; parts
whose scopes overlap, which may be up to twice `reach` apart, are joined (an interval join: both lists sorted by start,
one sweep). Weak candidates, that is long
mixed tokens and named identifiers that mean nothing alone, are reported only when a complementary part is in scope:

* `weak`: a token of 20 characters or more with upper case, lower case and digits, next to an identifier or endpoint;
  one within a URL needs another identifier or endpoint, or that the URL is reported as an endpoint;
* `identifier`: a named account, user or client id, next to a secret of any kind;
* `endpoint`: a URL, next to a secret of any kind.

Weak tokens that overlap a base span are part of it and not reported again. Spans count code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; an empty table gives an empty result; texts of any length
are scanned whole; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import documents, text_or_empty, text_slices
from textlake.session import ship_package, short_batches

# The base kinds, in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "weak", "identifier", "endpoint")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NAME = re.compile(r"[A-Za-z0-9_-]+=(?!=|$)")
NAMED = re.compile(r"""\b(?:user(?:name)?|login|account(?:_id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
NAMES = ("user", "login", "account", "clientid", "client_id", "accesskey", "access_key")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+")

Span = tuple[int, int, int]  # start, index of kind, end


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def in_scope(spans: list[Span], others: list[Span], reach: int) -> list[Span]:
    """The spans that have one of the others, not itself, within reach; both are sorted by start.

    Interval join: another span is in scope if it starts before the scope's end and ends behind its start. The running
    maximum of ends, over the others in order of start, tells the latter with one search. Callers whose two scopes are
    both widened pass the sum of the two widths.
    """
    starts, ends, furthest = [o[0] for o in others], [], 0
    for o in others:
        furthest = max(furthest, o[2])
        ends.append(furthest)
    out = []
    for s in spans:
        lo, hi = bisect_right(ends, s[0] - reach), bisect_left(starts, s[2] + reach)
        if hi - lo > 1 or (hi - lo == 1 and others[lo] != s):
            out.append(s)
    return out


def url_tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of token characters within a URL: of its authority, and of all behind it; names of query values do not count."""
    at = text.index("://", start, end) + 3
    behind = next((i for i in range(at, end) if text[i] in "/?#"), end)
    for a, b in ((at, behind), (behind + 1, end)):
        for m in RUN.finditer(text, a, b):
            name = NAME.match(text, m.start(), m.end())
            first = name.end() if name and text[m.start() - 1] in "?&;#" else m.start()
            if m.end() - first >= 20:
                yield first, m.end()


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """What linking adds to the base spans."""
    low = text.lower()
    named = [(m.start(), 4, m.end()) for m in NAMED.finditer(text)] if any(n in low for n in NAMES) else []
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    identifiers = sorted([*named, *(s for s in base if s[1] == 1)])
    if not identifiers and not ends:
        return []
    starts, reached = [s[0] for s in base], list(accumulate((s[2] for s in base), max))

    def free(a: int, b: int) -> bool:
        """Whether no base span that begins before b ends behind a."""
        i = bisect_left(starts, b)
        return not i or reached[i - 1] <= a

    def mixed(t: str) -> bool:
        return any(c.isdigit() for c in t) and any(c.isupper() for c in t) and any(c.islower() for c in t)

    weak = [(m.start(), 3, m.end()) for m in WEAK.finditer(text) if mixed(m[0]) and free(m.start(), m.end())]
    weak = [w for w in weak if not any(e[0] <= w[0] < e[2] for e in ends[max(0, bisect_left(ends, w) - 1) : bisect_left(ends, w)])]
    wide = 2 * reach  # both scopes
    weak = in_scope(weak, sorted([*identifiers, *ends]), wide)
    access = [s for s in base if s[1] == 1]
    # Tokens within a URL: that URL alone is no complement.
    inner = {e: [(x, 3, y) for x, y in url_tokens(text, e[0], e[2]) if mixed(text[x:y]) and free(x, y)] for e in ends}
    for k, e in enumerate(ends):
        by_name = set(in_scope(inner[e], identifiers, wide)) if inner[e] else ()
        for w in inner[e]:
            if w in by_name or (k and ends[k - 1][2] > w[0] - wide) or (k + 1 < len(ends) and ends[k + 1][0] < w[2] + wide):
                weak.append(w)
    while True:
        secrets = sorted([*(s for s in base if s[1] != 1), *weak])
        linked = in_scope(ends, sorted([*secrets, *access]), wide)
        known = set(weak)
        new = [w for e in linked for w in inner[e] if w not in known]
        if not new:
            return [*weak, *in_scope(named, secrets, wide), *linked]
        weak += new


def scan(text: str, reach: int = 200) -> list[Span]:
    """All spans by start, then kind."""
    base = base_spans(text)
    return sorted([*base, *linked_spans(text, base, reach)])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(df: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, for every row."""
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(parts):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t, reach)] for t in texts]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(spans, _ARROW)], names=["doc_id", "spans"])

    return documents(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans' list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text: str, reach: int = 200, mark: str = "[REDACTED]") -> str:
    """The text with every secret replaced; endpoints stay, but for secrets within them. Overlapping spans are replaced as one."""
    out, at = [], 0
    for a, kind, b in scan(text, reach):
        if kind == 5:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact_secrets(df: DataFrame, reach: int = 200, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets taken out of the text; null texts stay null."""
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)
    names, at = df.columns, df.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(parts, text_col):
            columns = [*part.columns]
            columns[at] = pa.array([None if t is None else redact(t, reach) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text_or_empty(text_col))).mapInArrow(run, df.schema)

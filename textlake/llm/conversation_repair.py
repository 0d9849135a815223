"""Conversation structure repair by the tight arcs of a bidirectional shortest-path search.

Rows of a conversation become codes, one byte each: the role's initial (s, u, a or another) and the row's fault. The repaired
roles must read (s?(ua)+)?, an automaton of four states; edits are arcs of a graph of (rows done, state): Keep 0, Rerole 3,
Delete 4, Insert 3, and 3 more for a truncated row that is not deleted. The least costs from the front and from the back tell
the arcs that lie on a cheapest path: those with front + weight + back equal to the least cost. From the front a set of
nodes moves on over the tight arcs of the least letter that leaves it, until all rows are done; so no list of alternatives
is ever kept.

Rows are dealt by ranges of conversation and turn and sorted, so a conversation of any length is split over tasks; a task
repairs the conversations that lie wholly within it at once. What is cut by a border of tasks, or longer than a block, goes on
as blocks of `block_rows` rows: the codes of all blocks of a conversation, a byte a row, meet in one task, which keeps costs at
the borders of blocks only and gives every block its letters; blocks are then rewritten where they are, and the
digest of the repaired text, which SHA-256 allows in no other way, is taken over the blocks as a stream.

Copies of a row (same turn, role and text) are counted before anything is sorted, and the first turn of a role and text in a
conversation is an aggregate; both are combined map-side, whatever a conversation repeats. All counts but the cost follow from
codes and turns, and are summed up over the blocks.

Order: by turn (null first), role, the text's first 64 characters, and its digest. Texts are told apart by their MD5 digests. Defined cases: a null role or text counts as one space, a null conv_id is a conversation of its own, and both
have the space in place of the number in the key of the damage; a role may be any string, and one that begins with none
of s, u, a cannot be kept; a conversation without rows has zeros, an empty audit and the digest of the empty string; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.session import materialise, ship_package

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of the edits, and of a truncated row that stays.
COST, TRUNCATED = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}, 3
#: States: nothing yet, after s, after u, after a. STEPS has the state that an initial leads to.
STATES, ENDS = range(4), (0, 3)
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ROLE = {2: "user", 3: "assistant"}
INSERTS = tuple((s, t, COST[INSERT]) for (c, s), t in sorted(STEPS.items()) if c != "s")
#: A row's code: the index of its initial here, plus 4 if it must go, 8 if it is truncated, and 16 if it is blank.
INITIALS = "sua"
MUST_GO, CUT, BLANK = 4, 8, 16
#: Initials that may follow one another.
LEGAL = frozenset((INITIALS.index(x), INITIALS.index(y)) for x, y in ("su", "ua", "au"))
FAR = 1 << 60
BLOCK_ROWS, BLOCK_BYTES = 65_536, 4 << 20


@lru_cache(maxsize=None)
def arcs(code: int) -> tuple[tuple[int, int, str, int], ...]:
    """The arcs over a row: (state before, state behind, letter, weight)."""
    out = [(s, s, DELETE, COST[DELETE]) for s in STATES]
    if not code & MUST_GO:
        extra, own = TRUNCATED if code & CUT else 0, code & 3
        for (c, s), t in STEPS.items():
            if own < 3 and c == INITIALS[own]:
                out.append((s, t, KEEP, COST[KEEP] + extra))
            if c != "s":
                out.append((s, t, REROLE, COST[REROLE] + extra))
    return tuple(out)


def with_inserts(front: list[int]) -> list[int]:
    """Least costs with rows put in; two rounds suffice, as a third row put in would only lead back."""
    for _ in range(2):
        for s, t, w in INSERTS:
            front[t] = min(front[t], front[s] + w)
    return front


def before_inserts(back: list[int]) -> list[int]:
    """The same from the back."""
    for _ in range(2):
        for s, t, w in INSERTS:
            back[s] = min(back[s], back[t] + w)
    return back


def over(front: list[int], codes: bytes) -> list[int]:
    """Least costs from the front behind the rows of codes."""
    for code in codes:
        new = [FAR] * 4
        for s, t, _, w in arcs(code):
            if front[s] + w < new[t]:
                new[t] = front[s] + w
        front = with_inserts(new)
    return front


def back_over(back: list[int], codes: bytes) -> list[int]:
    """Least costs from the back before the rows of codes."""
    for code in reversed(codes):
        new = [FAR] * 4
        for s, t, _, w in arcs(code):
            if back[t] + w < new[s]:
                new[s] = back[t] + w
        back = before_inserts(new)
    return back


def start_costs() -> list[int]:
    return with_inserts([0, FAR, FAR, FAR])


def end_costs() -> list[int]:
    return before_inserts([0 if s in ENDS else FAR for s in STATES])


def letters(codes: bytes, front: list[int], back: list[int], nodes: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The least string of tight arcs over a block, and the set of states behind it. front: costs before the block, back:
    costs behind it, nodes: the states reached before it. last: whether rows may be put in behind the block too; else
    they are put in before the next."""
    fronts, backs = [front], [back]
    for code in codes:
        fronts.append(over(fronts[-1], bytes((code,))))
    for code in reversed(codes):
        backs.append(back_over(backs[-1], bytes((code,))))
    backs.reverse()
    total = min(f + b for f, b in zip(fronts[0], backs[0]))
    out, i, n = [], 0, len(codes)
    while True:
        f, b = fronts[i], backs[i]
        found: dict[str, set[tuple[int, int]]] = {}
        if i < n or last:
            for s, t, w in INSERTS:
                if s in nodes and f[s] + w + b[t] == total:
                    found.setdefault(INSERT, set()).add((i, t))
        if i < n:
            for s, t, letter, w in arcs(codes[i]):
                if s in nodes and f[s] + w + backs[i + 1][t] == total:
                    found.setdefault(letter, set()).add((i + 1, t))
        if not found:
            return "".join(out), nodes
        letter = min(found)
        out.append(letter)
        i, nodes = max(k for k, _ in found[letter]), frozenset(t for _, t in found[letter])


def repair_codes(blocks: list[bytes]) -> tuple[int, list[str], list[int]]:
    """The least cost, and for each block of a conversation its letters and the state before it."""
    back = end_costs()
    backs = [back]
    for codes in reversed(blocks):
        back = back_over(back, codes)
        backs.append(back)
    backs.reverse()
    front, nodes, found, states = start_costs(), frozenset((0,)), [], []
    cost = min(f + b for f, b in zip(front, backs[0]))
    for k, codes in enumerate(blocks):
        states.append(min(nodes))
        text, nodes = letters(codes, front, backs[k + 1], nodes, k == len(blocks) - 1)
        found.append(text)
        front = over(front, codes)
    return cost, found, states


def rewrite(text: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines that the letters make of the rows (role, text), from a state on."""
    for letter in text:
        if letter == INSERT:
            state = STEPS["a", 2] if state == 2 else STEPS["u", state]
            yield f"{ROLE[state]}:"
            continue
        role, said = next(rows)
        if letter == DELETE:
            continue
        if letter == KEEP:
            state = STEPS[role[0], state]
        else:
            state = STEPS["a", 2] if state == 2 else STEPS["u", state]
            role = ROLE[state]
        yield f"{role}:{said}"


# ---- damage and faults, as expressions -------------------------------------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of what is left of the rows, by the checksum of conversation and turn."""
    number = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    way = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(way == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(way == 1, F.lit("")).when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return rows.where("copies > 0")


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies), each once with all its copies, in ORDER, plus code, the first copy's."""
    rows = rows.withColumn("head", F.left("text", F.lit(64))).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    once = rows.groupBy(*ORDER).agg(F.min("text").alias("text"), F.sum("copies").alias("copies"))
    same, at = ["conv_id", "role", "digest"], lambda t: F.struct(t.isNotNull().alias("known"), t.alias("turn"))
    # Only what occurs in several turns can have an earlier one.
    first = rows.groupBy(*same).agg(F.min(at(F.col("turn"))).alias("first"), F.max(at(F.col("turn"))).alias("last")).where("first < last")
    found = once.join(first, [once[c].eqNullSafe(first[c]) for c in same], "left")
    again = F.coalesce(at(once["turn"]) > F.col("first"), F.lit(False))
    said = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", "")
    fault = F.when(said == "", MUST_GO + BLANK).when(again, MUST_GO).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.left(once["role"], F.lit(1))
    own = F.coalesce(*[F.when(initial == c, k) for k, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    return found.select(*[once[c] for c in (*ORDER, "text", "copies")], (own + fault).cast("int").alias("code"))


# ---- counts that blocks of a conversation can be asked for one by one ------------------------------------------------------


class Counts:
    """What is counted along a conversation, row by row or block by block."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.turn = self.own = None

    def codes(self, codes: bytes) -> None:
        if not codes:
            return
        self.blank += sum(map(codes.count, range(BLANK, 2 * BLANK)))
        self.duplicate += sum(map(codes.count, range(MUST_GO, CUT)))
        self.truncated += sum(map(codes.count, range(CUT, CUT + MUST_GO)))
        own = [self.own, *(c & 3 for c in codes)]
        self.illegal += sum(pair not in LEGAL for pair in zip(own, own[1:]) if pair[0] is not None)
        self.own = own[-1]

    def span(self, first: int | None, last: int | None, turns: int) -> None:
        """Turns in ascending order: the first, the last, how many there are (none is null)."""
        if turns:
            self.turns += turns - (first == self.turn)
            self.first = first if self.first is None else self.first
            self.turn = last

    def as_row(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


# ---- repair ----------------------------------------------------------------------------------------------------------------

ORDER = ["conv_id", "turn", "role", "head", "digest"]
PLACE = ["conv_id", "part", "block"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLACE = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64())]
_COUNTS = [(c, pa.int64()) for c in COUNTS]
_BLOCK = pa.schema([*_PLACE, ("whole", pa.bool_()), ("codes", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64()), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
_LETTERS = pa.schema([*_PLACE, ("letters", pa.string()), ("state", pa.int32()), *_COUNTS])
_RESULT = pa.schema([("conv_id", pa.int64()), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL.get(f.type, 'array<struct<role: string, text: string>>')}" for f in schema)


def batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BLOCK_BYTES bytes of text at most; fields that a row lacks are null."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += 100 + sum(len(r["text"]) for r in x.get("rows") or ()) + sum(len(x.get(c) or "") for c in ("codes", "audit", "letters"))
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def rows_of(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of record batches, a few at a time as Python values."""
    for batch in parts:
        for k in range(0, batch.num_rows, 1_000):
            yield from zip(*[batch[c].slice(k, 1_000).to_pylist() for c in names])


class Block:
    """Rows of a conversation as they come, until there are enough for a block."""

    def __init__(self, conv_id: int | None, part: int, number: int):
        """number: of its first block among all of the task."""
        self.conv_id, self.part, self.number, self.whole = conv_id, part, number, True
        self.empty()

    def empty(self) -> None:
        self.codes, self.rows, self.size = bytearray(), [], 0
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, code: int, role: str, text: str, copies: int, most: int) -> Iterator[dict]:
        """Take in a row's copies; gives the blocks that are full before all are taken in."""
        while copies:
            if len(self.codes) >= most or self.size >= BLOCK_BYTES:
                yield self.cut()
            now = min(copies, most - len(self.codes))
            self.codes += bytes((code,)) * now
            self.rows += [(role, "" if code & MUST_GO else text)] * now
            self.size += 0 if code & MUST_GO else now * len(text)
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            copies -= now

    def place(self) -> dict:
        return {"conv_id": self.conv_id, "part": self.part, "block": self.number}

    def finished(self) -> dict:
        """The whole conversation, repaired."""
        codes, counts, sha = bytes(self.codes), Counts(), hashlib.sha256()
        cost, (text,), _ = repair_codes([codes])
        counts.codes(codes)
        counts.span(self.first, self.last, self.turns)
        for k, line in enumerate(rewrite(text, 0, iter(self.rows))):
            sha.update((b"\n" if k else b"") + line.encode())
        return self.place() | counts.as_row() | {"whole": True, "audit": text, "cost": cost, "repaired_sha256": sha.hexdigest()}

    def cut(self) -> dict:
        """What there is so far as a block; the next begins behind it."""
        rows = [{"role": r, "text": t} for r, t in self.rows]
        out = self.place() | {"whole": False, "codes": bytes(self.codes), "rows": rows, "first": self.first, "last": self.last, "turns": self.turns}
        self.number += 1
        self.whole = False
        self.empty()
        return out


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired conversations, where one lies wholly within a task and a block, and blocks of the others."""
    ship_package(rows.sparkSession)
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    dealt = dealt.select("conv_id", "turn", "role", "text", "copies", "code", F.spark_partition_id().alias("part"))

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, whole, number = None, False, 0
        for conv, turn, role, text, copies, code, part in rows_of(parts, "conv_id", "turn", "role", "text", "copies", "code", "part"):
            if now is None or conv != now.conv_id:
                if now is not None:
                    # The first conversation of a task may have begun in the one before it.
                    yield now.finished() if whole and now.whole else now.cut()
                    whole, number = True, now.number
                now = Block(conv, part, number)
            yield from now.add(turn, code, role, text, 1, block_rows)
            # Copies of a blank row are blank, of any other duplicates.
            yield from now.add(turn, code if code & BLANK else code & 3 | MUST_GO, role, "", copies - 1, block_rows)
        if now is not None:
            yield now.cut()

    return dealt.mapInArrow(lambda parts: batches(made(parts), _BLOCK), ddl(_BLOCK))


def block_letters(blocks: DataFrame) -> DataFrame:
    """Of the conversations that are not whole: each block's place, letters and the state before it; the counts stand at
    the first block. A task holds a byte for each row of a conversation."""

    def solved(held: list[tuple]) -> Iterator[dict]:
        cost, found, states = repair_codes([x[3] for x in held])
        counts = Counts()
        for *_, codes, first, last, turns in held:
            counts.codes(codes)
            counts.span(first, last, turns)
        for k, x in enumerate(held):
            yield dict(zip(PLACE, x)) | {"letters": found[k], "state": states[k]} | (counts.as_row() | {"cost": cost} if not k else {})

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        for x in rows_of(parts, *PLACE, "codes", "first", "last", "turns"):
            if held and x[0] != held[0][0]:
                yield from solved(held)
                held = []
            held.append(x)
        if held:
            yield from solved(held)

    dealt = blocks.select(*PLACE, "codes", "first", "last", "turns").repartition("conv_id").sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(lambda parts: batches(made(parts), _LETTERS), ddl(_LETTERS))


def joined_blocks(blocks: DataFrame, solved: DataFrame) -> DataFrame:
    """A row for each conversation that is not whole."""

    def rewritten(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = []
            for rows, letters_, state in rows_of(iter((batch,)), "rows", "letters", "state"):
                lines = list(rewrite(letters_, state, ((r["role"], r["text"]) for r in rows)))
                texts.append("\n".join(lines) if lines else None)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in kept], names=kept)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, sha = None, None
        for conv, text, letters_, *counts in rows_of(parts, "conv_id", "text", "letters", *COUNTS):
            if now is None or conv != now["conv_id"]:
                if now:
                    yield now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()}
                now, sha, empty = {"conv_id": conv, "audit": []} | dict(zip(COUNTS, counts)), hashlib.sha256(), True
            now["audit"].append(letters_)
            if text is not None:
                sha.update((b"" if empty else b"\n") + text.encode())
                empty = False
        if now:
            yield now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()}

    kept = [*PLACE, "text", "letters", *COUNTS]
    both = blocks.select(*PLACE, "rows").join(solved.drop("conv_id"), ["part", "block"]).select(*PLACE, "rows", "letters", "state", *COUNTS)
    types = {"text": "string", "letters": "string", "part": "int"}
    texts = both.mapInArrow(rewritten, ", ".join(f"{c} {types.get(c, 'long')}" for c in kept))
    return texts.repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(lambda parts: batches(hashed(parts), _RESULT), ddl(_RESULT))


def repair(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of df, whose
    rows (conv_id, turn, role, text) are damaged first."""
    blocks = materialise(blocks_of(marked(damaged(df)), block_rows), "repair-blocks")
    cut = blocks.where("not whole")
    solved = materialise(block_letters(cut), "repair-letters")
    found = blocks.where("whole").select(*_RESULT.names).unionByName(joined_blocks(cut, solved))
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(found[c], F.lit(0).cast("long")).alias(c) for c in COUNTS]
    none = hashlib.sha256().hexdigest()
    return every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").select(every["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))

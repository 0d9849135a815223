"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its shingles of five words (lower case, white space aside); lines with fewer words have none and are
left alone. A line is removed if an earlier line, by (doc_id, line number), has a Jaccard similarity of 0.8 or more, be
that line itself removed or not. So the result does not depend on any order of work.

1. Equal word sequences are one class, whose first line stands for it; later members are removed.
2. A line of n tokens has at least a = ceil(0.8 n) of them in common with a match, and a match has at least a tokens. So
   whatever the order of tokens, both lines of a match share `l` tokens among the first n - a + l of each, where l is that
   of the shorter line. By the order of hashes this is a cheap screen: only lines that share as many tokens there as the
   shortest possible match promises (l grows with n) can have a match. In a usual corpus few are left.
3. Rarity: among the lines left, the frequency of every token is counted exactly. A token of one line only is the rarest
   and cannot be shared, so a line with fewer than a shared tokens has no match; the others order theirs from rare to
   common, ties by hash.
4. Prefix filter: of the first n - a + 1 tokens in this order those that are shared are posted, with size and place. A
   posting is paired with the earliest line of its token first; only lines for which no such pair holds go on to be
   paired with the others. Length filter: 0.8 n <= m <= n / 0.8. Positional filter: what can still be shared behind the
   places of the common token must suffice.
5. Pairs are verified on the whole token sets.

Very frequent tokens never meet in one task: the most frequent ones of a bounded sample of lines are counted map-side and
told by a list that goes with the tasks; the sample decides only by which way a token goes, not what comes out. Tokens are 64-bit hashes of
the shingles; classes are keyed by two 64-bit hashes. Intermediate tables are deleted as soon as they have been used.

Defined cases: a null text has no lines; blank and short lines always stay; a null doc_id sorts first; lines and texts of
any length are handled whole, in time in proportion; rows that repeat an id are ordered by a hash of their text, and rows
that repeat both are one document that loses the same lines in all of them; an empty table gives an empty result; extra
columns pass through, whatever their names; a column that is named lines_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import text_or_empty
from textlake.session import discard, materialise

WORDS = 5
SIMILARITY = 0.8
#: Share of a line's tokens by which the screen looks beyond the shortest prefix.
SCREEN = 0.06
#: Line numbers by document are sent to all tasks up to so many lines; beyond, they are joined by exchange.
BROADCAST_ROWS = 1_000_000
#: The sample of lines in which frequent tokens are looked for, how often they must occur there, and how many there are at most.
SAMPLE_LINES, FREQUENT, MOST_FREQUENT = 20_000, 10, 4_000
SPACE = "[\\x09\\x0B\\x0C\\x0D\\x20]+"


def clean_lines(text: Column) -> Column:
    """The text in lower case, with one space between the words of a line and one at most around them.

    Most texts are so already; that is found by plain searches, each a pass over the text, so that the pattern runs only over
    the others. The space around a line is left to hashed(), as it takes no search there.
    """
    odd = F.contains(text, F.lit("  "))
    for part in ("\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(text, F.lit(part))
    return F.when(odd, F.regexp_replace(F.lower(text), SPACE, " ")).otherwise(F.lower(text))


def row_hash(text_col: str) -> Column:
    """What tells rows with the same id apart."""
    return F.xxhash64(text_or_empty(text_col))


def bound(col: Column, f) -> Column:
    """f(col) with col computed once, however often f refers to it."""
    return F.element_at(F.transform(F.array(col), f), 1)


def hashed(line: Column, words: int) -> Column:
    """struct<k1, k2, h> of a line as clean_lines() leaves it: two hashes of all of it, and the 64-bit hashes of its shingles in their order.

    Used within the loop over a text's lines, so that rows carry hashes and no words.
    """

    def shingles(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))

    def of(norm: Column, w: Column) -> Column:
        h = F.slice(bound(F.transform(w, lambda x: F.xxhash64(x)), shingles), F.lit(1), F.size(w) - (words - 1))
        return F.when(F.size(w) >= words, F.struct(F.xxhash64(norm).alias("k1"), F.xxhash64(F.lit(1), norm).alias("k2"), h.alias("h")))

    return bound(F.trim(line), lambda norm: bound(F.split(norm, " "), lambda w: of(norm, w)))


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, row (a hash of the text), line_no (from 0), k1, k2, tokens of every line with enough words."""
    pieces = F.transform(F.split(clean_lines(text_or_empty(text_col)), "\n", -1), lambda line: hashed(line, words))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), F.posexplode(pieces).alias("line_no", "x"))
    return rows.where("x is not null").select("doc_id", "row", "line_no", "x.k1", "x.k2", token_set(F.col("x.h")).alias("tokens"))


def token_set(h: Column) -> Column:
    """Distinct hashes in ascending order."""
    return F.sort_array(F.array_distinct(h))


def least_common(n: Column, similarity: float) -> Column:
    """How many of its n tokens a line has in common with any match, at least."""
    return F.ceil(F.lit(similarity) * n - 1e-9).cast("int")


def frequent_tokens(rows: DataFrame, n_lines: int, array: str) -> list[int]:
    """At most MOST_FREQUENT tokens: those of many lines in a sample of about SAMPLE_LINES lines. rows: k1, array."""
    sampled = rows.where(F.pmod("k1", F.lit(max(1, n_lines // SAMPLE_LINES))) == 0)
    counts = sampled.select(F.explode(array).alias("token")).groupBy("token").count().where(F.col("count") >= FREQUENT)
    return [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()]


def among(found: list[int]) -> Column:
    """Whether token is one of a bounded list."""
    return F.expr(f"token IN ({', '.join(map(str, found))})") if found else F.lit(False)


def shared(rows: DataFrame, frequent: list[int], owner: str) -> DataFrame:
    """rows (token, owner) whose token has another owner too, with lines, by which tokens go from rare to common: how many
    rows the token has, for frequent tokens in powers of two.

    Frequent tokens are summed up where they are; what comes back is a list as short as theirs. The others are dealt by
    token once; both the count and the join read that one exchange.
    """
    total = lambda df: df.groupBy("token").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"), F.count("*").alias("lines")).where("lo <> hi").select("token", "lines")
    # Without the test for nulls, which a later join adds to one of the two, they would not be one exchange.
    few = rows.where(~among(frequent) & F.col(owner).isNotNull()).repartition("token")
    out = few.join(total(few).hint("shuffle_hash"), "token")
    powers: dict[int, list[int]] = {}
    for r in total(rows.where(among(frequent))).collect() if frequent else ():
        powers.setdefault(1 << r["lines"].bit_length(), []).append(r["token"])
    if not powers:
        return out
    lines = F.coalesce(*[F.when(among(found), F.lit(n).cast("long")) for n, found in sorted(powers.items())])
    return out.unionByName(rows.where(among(frequent)).withColumn("lines", lines).where("lines is not null"))


def by_document(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """From doc_id, row, ... per line to a row per document with the list of the values."""
    return lines.groupBy("doc_id", "row").agg(F.collect_set(value).alias(name))


def with_lists(df: DataFrame, lists: DataFrame, n_lines: int, id_col: str, text_col: str, how: str) -> DataFrame:
    """df joined with lists of lines by document; sent to all tasks if they are few enough, else by exchange."""
    same = df[id_col].cast("long").eqNullSafe(lists["doc_id"]) & (F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == lists["row"])
    return df.join(F.broadcast(lists) if n_lines <= BROADCAST_ROWS else lists, same, how)


def token_sets(df: DataFrame, firsts: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id (a number), k1, k2, at, n, tokens of the lines firsts (k1, k2, at) names; only these are shingled again."""
    listed = materialise(by_document(firsts.select("k1", "k2", "at.*"), F.col("line_no"), "picks"), "line-picks")
    n_lines = listed.agg(F.sum(F.size("picks"))).first()[0] or 0
    plain = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_lists(plain, listed, n_lines, "doc_id", "text", "inner")
    pick = lambda ls: F.transform("picks", lambda i: F.struct(i.alias("line_no"), bound(clean_lines(F.get(ls, i)), lambda line: hashed(line, words)).alias("x")))
    rows = found.select(listed["doc_id"], listed["row"], F.explode(bound(F.split(plain["text"].cast("string"), "\n", -1), pick)).alias("p"))
    rows = rows.select("p.x.k1", "p.x.k2", F.struct("doc_id", "row", "p.line_no").alias("at"), token_set(F.col("p.x.h")).alias("tokens")).withColumn("n", F.size("tokens"))
    sets = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "line-sets", hashes=True)
    if sets.groupBy("k1", "k2").count().where("count > 1").limit(1).count():  # rows that repeat id and text
        once = materialise(sets.dropDuplicates(["k1", "k2"]), "line-sets", hashes=True)
        discard(sets)
        sets = once
    discard(listed)
    return sets


def postings(sets: DataFrame, t: float) -> DataFrame:
    """token, id, at, n, place: what of the rarity-ordered prefixes other lines have too."""
    n_lines = sets.count()
    frequent = frequent_tokens(sets, n_lines, "tokens")
    rows = sets.select("id", F.explode("tokens").alias("token"))
    common = shared(rows, frequent, "id").join(sets.select("id", "n").hint("shuffle_hash"), "id")
    order = Window.partitionBy("id").orderBy("lines", "token")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = common.select("id", "n", "token", F.row_number().over(order).alias("i"), F.count("*").over(whole).cast("int").alias("common"))
    need, single = least_common(F.col("n"), t), F.col("n") - F.col("common")
    place = single + F.col("i") - 1
    posted = ranked.where((F.col("common") >= need) & (place <= F.col("n") - need)).select("token", "id", "n", place.alias("place"))
    return materialise(posted.join(sets.select("id", "at"), "id").select("token", "id", "at", "n", "place"), "line-postings", hashes=True)


def later_matches(sets: DataFrame, posted: DataFrame, t: float) -> DataFrame:
    """id of every line that has an earlier match."""
    a, b = posted.alias("a"), posted.alias("b")

    def fits() -> Column:
        """Length and positional filters on a pair of postings of one token; a is earlier."""
        na, nb = F.col("a.n"), F.col("b.n")
        most = F.least(na - F.col("a.place"), nb - F.col("b.place"))
        near = (F.least(na, nb) >= F.lit(t) * F.greatest(na, nb) - 1e-9) & (most >= F.lit(t / (1 + t)) * (na + nb) - 1e-9)
        return (F.col("a.token") == F.col("b.token")) & (F.col("a.at") < F.col("b.at")) & near

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
        side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"))
        common = F.size(F.array_intersect("ta", "tb"))
        ok = common >= F.lit(t) * (F.size("ta") + F.size("tb") - common) - 1e-9
        return pairs.join(side("a"), "a").join(side("b"), "b").where(ok).select(F.col("b").alias("id")).distinct()

    # First against the earliest line of each token: one pair per posting.
    lead = posted.groupBy("token").agg(F.min(F.struct("at", "id", "n", "place")).alias("x")).select("token", "x.*").alias("a")
    led = materialise(verified(lead.join(b, fits())), "line-matches")
    # Then, for what is left, against every earlier line that shares a token.
    left = posted.join(led, "id", "left_anti").alias("b")
    out = materialise(led.union(verified(a.join(left, fits()))), "line-matches")
    discard(led)
    return out


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row and lines, the numbers of the lines that have an earlier match, of every document with any."""
    t = similarity
    n = F.size("tokens")
    beyond = lambda size: (F.lit(1) + F.floor(F.lit(SCREEN) * size)).cast("int")
    lines = lines_of(df, id_col, text_col, words)
    lines = lines.select("doc_id", "row", "line_no", "k1", "k2", beyond(least_common(n, t)).alias("need"), F.slice("tokens", F.lit(1), F.least(n, n - least_common(n, t) + beyond(n))).alias("prefix"))
    keyed = materialise(lines, "line-keys", hashes=True)

    # The screen, by the order of hashes.
    frequent = frequent_tokens(keyed, keyed.count(), "prefix")
    hits = shared(keyed.select("k1", F.explode("prefix").alias("token")), frequent, "k1").groupBy("k1").agg(F.count("*").alias("hits"))
    hits = materialise(hits, "line-hits")

    at = F.struct("doc_id", "row", "line_no")
    firsts = keyed.join(hits, "k1").where("hits >= need").groupBy("k1", "k2").agg(F.min(at).alias("at"))
    sets = token_sets(df, firsts, words, id_col, text_col)
    posted = postings(sets, t)
    near = later_matches(sets, posted, t)

    # Of a class, all members but the first go, and the first too if the class has an earlier match.
    found = near.join(sets.select("id", "k1", "k2"), "id").select("k1", "k2", F.lit(True).alias("near"))
    classes = keyed.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("copies"))
    # Written, so that Spark can split the copies of a hot line, which meet one row, over tasks.
    gone = materialise(classes.join(found, ["k1", "k2"], "left").where("copies > 1 or near"), "line-gone")
    lost = keyed.select("doc_id", "row", "line_no", "k1", "k2").join(gone, ["k1", "k2"]).where(F.coalesce("near", F.lit(False)) | (at > F.col("at")))
    out = materialise(by_document(lost, F.col("line_no"), "lines"), "lines-removed")
    for table in (keyed, hits, sets, posted, near, gone):
        discard(table)
    return out


def drop_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the removed lines taken out of the text, plus lines_removed; documents without any pass unchanged."""
    n_lines = removed.agg(F.sum(F.size("lines"))).first()[0] or 0
    joined = with_lists(df, removed, n_lines, id_col, text_col, "left")
    old, gone = df[text_col], removed["lines"]

    def kept(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")

    text = F.when(gone.isNull(), old).otherwise(bound(F.split(old, "\n", -1), kept))
    columns = [text.alias(c) if c == text_col else df[c] for c in df.columns if c != "lines_removed"]
    return joined.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("lines_removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """df without later copies and near copies of lines, plus lines_removed."""
    return drop_lines(df, removed_lines(df, id_col, text_col, words, similarity), id_col, text_col)

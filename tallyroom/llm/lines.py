"""Fuzzy line deduplication by MinHash.

A line is compared by its shingles: runs of ``SHINGLE`` characters after lower-casing and folding white space, a
shorter line being one shingle. Exact copies are one line from the start, so a line shorter than a shingle is like no
other. Shingles are taken from the line's UTF-32 form and known by 64-bit hashes; two shingles of a compared pair share
a hash with a chance of some n * n / 2^65.

For the bands shingles are rows, so hashing them is compiled. The hash space is cut into ``LEAVES`` even leaves; a leaf's MinHash is the hash
nearest to its start by exclusive or, thus the least in the leaf or, if that is empty, in the nearest one. Band k is made of the MinHashes of ``BAND``
neighbouring leaves, so it agrees with about the third power of the similarity, and a pair of similarity 0.8 shares one in more than
99 of 100 cases (measured in the tests). Of a long line only the hashes are aggregated that lie so low in their leaf that some ``NEAR`` are expected in each;
where many leaves then have none, as the line repeats itself, all are.

Lines that share a band are candidates, verified by the exact Jaccard similarity of all shingles. Pairs whose bitmaps rule
them out are left out before that: a bit is the parity of the shingles that fall on it, so two bitmaps differ in no more bits than the lines
in shingles. In two rounds each line is compared with one line of its band and length class only, and found components are joined.
Pairs that are still in different components are compared directly in bands of ``FEW`` lines or less. In larger ones lines are matched through
their rarest shingles: at 0.8 two lines must share one of the first ``n - ceil(0.8 n) + 1`` in any common order, so
rare ones first loses no pair. First each line is compared with one line of each of its
rarest shingles and components are joined again; then all pairs that are still in different ones are verified. A pair whose lines also
have the same rare shingle just before the shared one is made there.
One line of each component stays: its first by document and place.

All of it is DataFrame expressions, joins and groupings; there is no Python on the executors.

Blank lines stay as they are. Rows that share doc_id, place and text are one row of the result with their number as ``copies``, of
which one stays where the line is kept. Of rows that share doc_id and place only the smaller name comes first. Rows
without an id come last. A null or empty text has no lines that count; further columns are left out.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written
from tallyroom.llm.components import components

SHINGLE, LIKE = 10, 0.8
BANDS, BAND, LEAVES, NEAR = 10, 3, 32, 4
ROUNDS = 2
#: Numbers of 32 bits in a leaf; so many are enough to tell a line's hashes apart.
LEAF = 2**32 // LEAVES
#: Lines of a band that are compared pair by pair, by their bitmaps.
FEW = 128
#: Words of 64 bits in a line's bitmap.
WORDS = 16
#: Lines of one class differ in their shingles by a quarter at most.
CLASS = 1.25


def folded(text: Column) -> Column:
    """The text with its lines lower-cased, white space within them as single spaces and none at their ends."""
    low = F.lower(text)
    other = F.greatest(*[F.contains(low, F.lit(c)) for c in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r")])  # than single spaces within lines
    single = F.regexp_replace(F.regexp_replace(low, "[ \\t\\x0B\\f\\r]+", " "), " ?\n ?", "\n")
    return F.trim(F.when(other, single).otherwise(low))


def hashes(text: Column) -> Column:
    """Hashes of a text's shingles, repeats included. The bytes are bound by the outer lambda, so each shingle is cut from them in place."""
    cut = lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.shiftright(F.length(b), 2) - SHINGLE)),
        lambda i: F.xxhash64(F.substr(b, i * 4 + 1, F.lit(4 * SHINGLE))))
    return F.transform(F.array(F.encode(text, "UTF-32")), cut)[0]


def shingles(text: Column) -> Column:
    return F.array_distinct(hashes(text))


def _minhashes(lines: DataFrame, near: float) -> DataFrame:
    """``line, n`` with the number of its shingles, repeats included, and ``m0``, ``m1``, …: the MinHashes of its bands' leaves.
    Besides the first, only hashes count of which ``near`` are expected in each leaf."""
    size = F.char_length("text")
    low = F.least(F.lit(1.0), F.lit(float(LEAVES * near)) / F.col("n")) * F.lit(float(LEAF))
    whole = lines.where(size >= SHINGLE).select("line", (size - (SHINGLE - 1)).alias("n"), F.encode("text", "UTF-32").alias("b"))
    # For an inner explode Spark would filter by the array's size below, and make it twice.
    each = whole.select("line", "n", "b", low.alias("low"), F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    h = F.shiftright(F.xxhash64(F.substr("b", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))), 32).cast("int")
    each = each.select("line", "n", "low", "i", h.alias("h")).where((F.col("h").bitwiseAND(LEAF - 1) < F.col("low")) | (F.col("i") == 0))
    # Leaves by their start with its first bit turned, so that the least signed number is the nearest.
    starts = [LEAF * (k * LEAVES // BANDS + j) - 2**31 for k in range(BANDS) for j in range(BAND)]
    return each.groupBy("line", "n").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(start))).alias(f"m{k}") for k, start in enumerate(starts)])


def bands(lines: DataFrame) -> DataFrame:
    """``band, line, n``: keys of the bands of each line and the number of its shingles, repeats included. ``lines``: line, text."""
    found = written(_minhashes(lines, NEAR), "minhashes")
    # Lines that repeat themselves have fewer distinct hashes than expected: all of theirs count.
    empty = sum((F.when(F.col(f"m{k}") >= LEAF - 2**31, 1).otherwise(0) for k in range(1, BANDS * BAND)), F.when(F.col("m0") >= LEAF - 2**31, 1).otherwise(0))
    sparse = (F.col("n") > LEAVES * NEAR) & (empty > BANDS * BAND // 10)
    again = lines.join(written(found.where(sparse).select("line"), "sparse"), "line", "left_semi")
    found = found.where(~sparse).unionAll(written(_minhashes(again, math.inf), "minhashes"))
    keys = [F.xxhash64(F.lit(k), *[f"m{k * BAND + j}" for j in range(BAND)]) for k in range(BANDS)]
    return found.select("line", "n", F.explode(F.array(*keys)).alias("band")).select("band", "line", "n")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose shingles have a Jaccard similarity of LIKE or more."""
    text = lines.select("line", "text")
    both = (pairs.join(text.select(F.col("line").alias("a"), F.col("text").alias("x")), "a")
            .join(text.select(F.col("line").alias("b"), F.col("text").alias("y")), "b"))
    sets = both.select("a", "b", shingles(F.col("x")).alias("s"), shingles(F.col("y")).alias("t"))
    shared = sets.select("a", "b", (F.size("s") + F.size("t")).alias("sizes"), F.size(F.array_intersect("s", "t")).alias("shared"))
    return shared.where(F.col("shared") >= LIKE * (F.col("sizes") - F.col("shared"))).select("a", "b")


def bitmaps(each: DataFrame, *by: str) -> DataFrame:
    """The keys with ``w0``, ``w1``, …: the bitmap of a line's shingles. ``each``: a row for each ``token``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(63).cast("int"))
    cut = each.select(*by, F.shiftright("token", 6).bitwiseAND(WORDS - 1).cast("int").alias("word"), bit.alias("bit"))
    none = F.lit(0).cast("long")
    return cut.groupBy(*by).agg(*[F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(none)), none).alias(f"w{k}") for k in range(WORDS)])


def maps(lines: DataFrame) -> DataFrame:
    """``line, n`` and the line's bitmap, with the number of its distinct shingles. ``lines``: line, text."""
    sets = lines.select("line", shingles(F.col("text")).alias("s"))
    return bitmaps(sets.select("line", F.size("s").alias("n"), F.explode_outer("s").alias("token")), "line", "n")


def _fits(words: list[str]) -> Column:
    """Whether numbers of shingles, ``n`` and ``m``, and bitmaps do not rule out that two lines are alike."""
    fits = F.least("n", "m") >= LIKE * F.greatest("n", "m")
    if words:  # lines that are alike differ in (1 - LIKE) / (1 + LIKE) of their shingles at most
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"other_{words[0]}"))))
        fits = fits & ((1 + LIKE) * bits <= (1 - LIKE) * (F.col("n") + F.col("m")) + 1e-6)
    return fits


def _possible(pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that ``_fits`` leaves."""
    words = [f"w{k}" for k in range(WORDS)]
    other = mapped.select(F.col("line").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"other_{c}") for c in words])
    return pairs.join(mapped.withColumnRenamed("line", "a"), "a").join(other, "b").where(_fits(words)).select("a", "b")


def _paired(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``line, b`` of ``rows`` and ``others`` with one key and different roots that ``_fits`` leaves, by bitmaps where rows have them.
    ``key, line, n, root`` on both sides."""
    words, before = [c for c in rows.columns if c in {f"w{k}" for k in range(WORDS)}], [c for c in rows.columns if c == "before"]
    other = others.select(key, F.col("line").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), *[F.col(c).alias(f"other_{c}") for c in words + before])
    return rows.join(other, key).where((F.col("root") != F.col("other")) & _fits(words))


def _meetings(rows: DataFrame, key: str) -> DataFrame:
    """Pairs ``a, b`` of rows as ``_paired`` makes them, each at the first of the keys that follow each other in both lines."""
    again = F.col("before") == F.col("other_before") if "before" in rows.columns else F.lit(False)
    return _paired(rows, rows, key).where((F.col("line") < F.col("b")) & ~F.coalesce(again, F.lit(False))).select(
        F.col("line").alias("a"), "b")


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    return _meetings(rows, key).distinct()


def _centered(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each row and the one of its token that comes first by a hash."""
    least = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("line").alias("h"), "line")).alias("c"))
    center = rows.join(least.select("token", F.col("c.line").alias("line")), ["token", "line"])
    return _paired(rows.drop("before"), center, "token").select(F.least("line", "b").alias("a"), F.greatest("line", "b").alias("b")).distinct()


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key has several roots, with the number of its rows."""
    spread = rows.groupBy(key).agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
    return rows.join(spread.where("least <> most").select(key, "size"), key)


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the ``root`` of their line by the links."""
    roots = components(links).select(F.col("node").alias("line"), F.col("root").alias("found"))
    return rows.join(roots, "line", "left").withColumn("root", F.coalesce("found", "line")).drop("found")


def rarest(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``token, before, line, n, root`` and the line's bitmap: the rarest shingles of each line by which it must meet any line like it, each with
    the one before it. ``rows``: line, root."""
    sets = lines.join(rows, "line").select("line", "root", shingles(F.col("text")).alias("s"))
    each = sets.select("line", F.size("s").alias("n"), "root", F.explode_outer("s").alias("token"))
    each = written(each, "tokens")
    often = each.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    # A line's shingles that no other line has come first in the order and take their places.
    listed = each.join(often, "token").groupBy("line", "n", "root").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("l"))
    places = F.col("n") - F.ceil(LIKE * F.col("n")).cast("int") + 1 - (F.col("n") - F.size("l"))
    met = listed.select("line", "n", "root", F.slice("l", F.lit(1), F.greatest(F.lit(0), places))["token"].alias("t"))
    met = met.select("line", "n", "root", "t", F.posexplode("t").alias("p", "token")).select(
        "line", "n", "root", "token", F.when(F.col("p") > 0, F.get("t", F.col("p") - 1)).alias("before"))
    return met.join(bitmaps(each, "line"), "line").select("token", "before", "line", "n", "root", *[f"w{k}" for k in range(WORDS)])


def like_lines(lines: DataFrame) -> DataFrame:
    """``line, root`` for lines that are like another. ``lines``: distinct ``text`` with its id ``line``."""
    found = bands(lines)
    shared = found.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    kind = F.floor(F.log("n") / F.log(F.lit(CLASS)) + F.lit(1e-9)).cast("int").alias("kind")
    found = written(found.join(shared, "band").select("band", "line", "n", kind), "bands")
    lines = written(lines.select("line", "text").join(found.select("line").distinct(), "line", "left_semi"), "candidates")
    mapped = written(maps(lines), "maps")
    links, rows = None, found.withColumn("root", F.col("line"))
    for turn in range(ROUNDS):
        center = rows.groupBy("band", "kind").agg(
            F.min(F.struct(F.xxhash64("line", F.lit(turn)).alias("h"), "line", "root")).alias("c"), F.count("*").alias("c_rows")).where("c_rows > 1")
        pairs = rows.join(center, ["band", "kind"]).where(F.col("root") != F.col("c.root")).select(
            F.least("line", "c.line").alias("a"), F.greatest("line", "c.line").alias("b")).distinct()
        new = written(verified(written(_possible(pairs, mapped), "pairs"), lines), "links")
        links = new if links is None else links.unionAll(new)
        rows = written(_open(_rooted(found, links), "band"), "open")
    few = _pairs(rows.where(F.col("size") <= FEW).select("band", "line", "root").join(mapped, "line"), "band")
    crowd = rows.where(F.col("size") > FEW).select("line", "root").distinct()
    tokens = written(rarest(crowd, lines), "rarest")
    near = written(few.unionAll(_centered(_open(tokens, "token").drop("size"))).distinct(), "pairs")
    links = links.unionAll(written(verified(near, lines), "links"))
    tokens = _open(_rooted(tokens, links), "token").drop("size")
    last = written(_pairs(tokens, "token").join(near, ["a", "b"], "left_anti"), "pairs")
    roots = components(links.unionAll(written(verified(last, lines), "links")))
    return roots.select(F.col("node").alias("line"), "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """A row for each line that counts: doc_id, place, copies, name (its folded text's MD5), root (of the lines it is like), kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(text).alias("folded"))
    each = whole.select("doc_id", F.posexplode_outer(F.split("folded", "\n")).alias("place", "text"))
    # Document and place as one number, which hash aggregation can hold; no id is the last.
    at = (F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(2**63))) * F.lit(Decimal(2**31)) + F.col("place")).cast("decimal(38,0)")
    each = each.where("text <> ''").select("doc_id", "place", at.alias("at"), "text")
    lines = written(each.groupBy("text").agg(F.min("at").alias("first")).select(
        F.monotonically_increasing_id().alias("line"), F.unhex(F.md5("text")).alias("name"), "text", "first"), "lines")
    roots = written(like_lines(lines), "roots")
    named = lines.select("line", "name", "first").join(roots, "line", "left").select("name", "first", F.coalesce("root", "line").alias("root"))
    firsts = named.groupBy("root").agg(F.min(F.struct("first", "name")).alias("best"))
    kept = named.join(firsts, "root").select("name", "root", "best")
    places = each.groupBy("doc_id", "place", "at", F.unhex(F.md5("text")).alias("name")).agg(F.count("*").alias("copies"))
    return places.join(kept, "name").select(
        "doc_id", "place", "copies", "name", "root",
        ((F.col("at") == F.col("best.first")) & (F.col("name") == F.col("best.name"))).alias("kept"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document id: its lines, how many stay, and a checksum of the places and texts that stay; zeros without lines."""
    docs = documents(spark, sf_dir)
    counted = deduplicated(docs).select("doc_id", "copies", F.col("kept").cast("long").alias("one"), F.when(
        F.col("kept"), F.xxhash64("place", "name")).alias("digest"), F.when(F.col("kept"), F.col("place") + 1).alias("at"))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("int"))
    return counted.unionAll(bare).groupBy("doc_id").agg(
        F.sum("copies").alias("n_lines"), F.sum("one").alias("n_kept"), F.coalesce(F.sum("at"), F.lit(0)).cast("long").alias("kept_places"),
        F.coalesce(F.bit_xor("digest"), F.lit(0)).cast("long").alias("kept_digest"))


QUERIES = {"op6_fuzzy_line_dedup": op6_fuzzy_line_dedup}
ORACLES: dict[str, str] = {}

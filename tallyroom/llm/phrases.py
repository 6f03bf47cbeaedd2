"""Phrase collocations by marginalising the longest windows.

Every word opens one window: itself and up to three words that follow in its piece, padded at the piece's end. Only these
longest windows are counted. Each occurrence of a shorter phrase is the beginning of exactly one of them, so
``ROLLUP (lang, w1, w2, w3, w4)`` sums the counts of all shorter phrases, of the words and of the whole language.

**Counting at scale.** Most windows occur once, and shuffling four words for each word of the text would cost many times the
input. Each task therefore counts its windows as integers, some ``CHUNK`` at a time, and sends one row for each first
word in a chunk, with all its windows as one string. Rows meet by first word, and for frequent words by one of ``SALTS`` salts
too, which the second word decides, so a word that opens a third of all windows is spread and yet all windows of a pair of
words are in one place, sorted to one another. Which words are frequent is read off the beginning of at most ``LOOK`` texts
before the job starts; that decides where rows go, never what is counted. There the counts of the pair, of the triple and of the window are complete; a window that is
rarer than ``LEAST`` gives up its last word, a triple its third and a pair its second, since no candidate can come of
them. What is left is a small part of the windows, and sums of beginnings do not change by it, so the rollup sees exact
counts of all that matters. A first word whose windows take more than ``HELD`` bytes in one place passes on as it is,
which the rollup counts alike.

Candidates are phrases of two to ``WORDS`` words that occur ``LEAST`` times. A candidate's score is its count against
those of its two parts, at its worst cut; it is dropped if a longer candidate holds it and is at least ``SHARE`` percent as
frequent. Products are decimals of 38 digits.

Defined results: a null text has no words and a null language is ``und``. Equal rows count as often as they occur. Words may
hold any character but blanks, tabs and separators. Very long texts are read in segments of ``SEGMENT`` bytes, so a
text costs memory by the segment; a language without candidates has no rows. Further columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import LOWER, UPPER, documents, written

WORDS, LEAST, SCALE, SHARE, TOP = 4, 30, 2_000_000, 80, 2000
CHUNK, SEGMENT, HELD = 1_000_000, 1_000_000, 32_000_000
SALTS, LOOK, LOOK_CHARS, OFTEN = 16, 500, 4000, 0.002
#: A separator is a token of its own, and ends a piece; separators are no part of words.
_TOKEN = re.compile(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+")
_BLANK = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_SEPARATORS = [bytes([c]) for c in b".,;:!?\x0a\x0b\x0c\x0d"]
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_COLUMNS = [f"w{k + 1}" for k in range(WORDS)]


class _Ids(dict):
    """Numbers for the words of one language; 0 is what ends a piece."""

    def __init__(self, words: list[bytes], langs: list[bytes], lang: bytes):
        super().__init__((s, 0) for s in _SEPARATORS)
        self.words, self.langs, self.lang = words, langs, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return k


class _Chunk:
    """Windows of a task, until there are ``CHUNK`` of them."""

    def __init__(self, hot: frozenset[bytes] = frozenset()) -> None:
        self.hot = hot
        self.words, self.langs, self.ids = [b""], [b""], {}
        self.windows, self.n = [], 0

    def add(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                cut = _BLANK.search(text, at + SEGMENT)
                end = cut.start() if cut else end
            if lang not in self.ids:
                self.ids[lang] = _Ids(self.words, self.langs, lang)
            ids = self.ids[lang]
            own = list(map(ids.__getitem__, _TOKEN.findall(text, at, end)))
            ahead = [ids[m.group()] for m in islice(_TOKEN.finditer(text, end), WORDS - 1)]
            lead = np.array(own + ahead + [0] * (WORDS - 1 - len(ahead)), np.int32)
            # Lead columns: the words that follow, none after the end of the piece.
            columns = [lead[: len(own)]]
            for k in range(1, WORDS):
                columns.append(np.where(columns[-1] == 0, 0, lead[k : len(own) + k]))
            window = np.stack(columns)
            self.windows.append(window[:, window[0] != 0])
            self.n += self.windows[-1].shape[1]
            at = end
            if self.n >= CHUNK or len(self.words) >= 1 << 20:
                yield from self.counted()

    def counted(self) -> Iterator[pa.RecordBatch]:
        """``word, salt, n, rest``: for each first word (with its language) and salt the number of windows and the windows: lines of a
        second word, the pair's count and, after commas, third and fourth words, with a count if above one. Separators are no part of words.
        """
        if not self.n:
            return
        w = np.concatenate(self.windows, axis=1).astype(np.int64)
        self.windows = []
        hot = np.array([x in self.hot for x in self.words])
        salts = np.array([zlib.crc32(x) % SALTS for x in self.words]) if hot.any() else np.zeros(len(hot), np.int64)
        # Words take 20 bits and salts 16.
        group = w[0] << 16 | np.where(hot[w[0]], salts[w[1]], 0)
        pair, end = group << 20 | w[1], w[2] << 20 | w[3]
        order = np.lexsort((end, pair))
        group, pair, end = group[order], pair[order], end[order]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh = new.copy()
        fresh[1:] |= end[1:] != end[:-1]
        at, starts = np.flatnonzero(fresh), np.flatnonzero(new)
        n, n2 = np.diff(at, append=len(pair)), np.diff(starts, append=len(pair))
        words = pa.array(self.words, pa.binary())
        low = (1 << 20) - 1
        take = lambda k: words.take(pa.array(k))
        text = lambda k: pc.cast(pc.cast(pa.array(k), pa.string()), pa.binary())
        join = lambda by, *x: pc.binary_join_element_wise(*x, pa.scalar(by, pa.binary()))
        lists = lambda starts, x, by: pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int64()), x), pa.scalar(by, pa.binary()))
        entry = join(b" ", take(end[at] >> 20), take(end[at] & low))
        entry = pc.if_else(pa.array(n > 1), join(b" ", entry, text(n)), entry)
        line = join(b",", join(b" ", take(pair[starts] & low), text(n2)), lists(np.searchsorted(at, starts), entry, b","))
        group = group[starts]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rest, total = lists(heads, line, b"\n"), pa.array(np.add.reduceat(n2, heads), pa.int64())
        first, salt = group[heads] >> 16, pa.array(group[heads] & 65535, pa.int32())
        word = join(b"\t", take(first), pa.array(self.langs, pa.binary()).take(pa.array(first)))
        self.__init__(self.hot)
        for k in range(0, len(word), 50_000):
            yield pa.RecordBatch.from_arrays([x[k : k + 50_000] for x in (word, salt, total, rest)], ["word", "salt", "n", "rest"])


def _counted(batches: Iterator[pa.RecordBatch], hot: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    chunk = _Chunk(hot)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            yield from chunk.add(lang.as_py(), text.as_py().translate(_FOLD))
    yield from chunk.counted()


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``word, w2, w3, w4, n`` from rows of ``counted`` that are sorted by word and salt."""
    out: list[tuple] = []

    def whole(word: bytes, rows: list[tuple[int, bytes]]) -> None:
        """All windows of a word and salt: rare last words are given up."""
        rare, pairs = 0, {}
        if sum(n for n, _ in rows) < least:
            out.append((word, b"", b"", b"", sum(n for n, _ in rows)))
            return
        for _, rest in rows:
            for line in rest.split(b"\n"):
                head, _, tail = line.partition(b",")
                w2, _, n = head.partition(b" ")
                if (x := pairs.get(w2)) is None:
                    pairs[w2] = [int(n), [tail]]
                else:
                    x[0] += int(n)
                    x[1].append(tail)
        for w2, (n, tails) in pairs.items():
            if n < least or not w2:
                rare += n
                continue
            f4, f3, left = Counter(), Counter(), Counter()
            for tail in tails:
                for w3, w4, c in _entries(tail):
                    f4[w3, w4] += c
            for (w3, _), c in f4.items():
                f3[w3] += c
            for (w3, w4), c in f4.items():
                left[(w3, w4 if c >= least else b"") if f3[w3] >= least else (b"", b"")] += c
            out.extend((word, w2, *x, c) for x, c in left.items())
        if rare:
            out.append((word, b"", b"", b"", rare))

    def as_they_are(word: bytes, rows: list[tuple[int, bytes]]) -> None:
        for _, rest in rows:
            for line in rest.split(b"\n"):
                head, _, tail = line.partition(b",")
                out.extend((word, head.partition(b" ")[0], *x) for x in _entries(tail))

    def ready(most: int) -> Iterator[pa.RecordBatch]:
        if len(out) > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.binary()] * WORDS + [pa.int64()])], ["word", "w2", "w3", "w4", "n"])
            out.clear()

    key, rows, held, finish = None, [], 0, whole
    for batch in batches:
        for word, salt, n, rest in zip(*(batch.column(c).to_pylist() for c in ("word", "salt", "n", "rest"))):
            if (word, salt) != key:
                if rows:
                    finish(key[0], rows)
                key, rows, held, finish = (word, salt), [], 0, whole
                yield from ready(20_000)
            rows.append((n, rest))
            held += len(rest)
            if held > HELD:
                finish = as_they_are  # for what is held and for the rest of this word and salt
                finish(word, rows)
                rows, held = [], 0
                yield from ready(0)
    if rows:
        finish(key[0], rows)
    yield from ready(0)


def _entries(tail: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    for e in tail.split(b","):
        w3, w4, *n = e.split(b" ")
        yield w3, w4, int(n[0]) if n else 1


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def windows(docs: DataFrame, least: int) -> DataFrame:
    """``lang, w1 .. w4, n``: the longest windows, without last words that no candidate can have."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    some = Counter(w for r in texts.select(F.substring(F.col("text").cast("string"), 1, LOOK_CHARS).alias("t")).limit(LOOK).collect()
                   for w in _TOKEN.findall(r["t"].encode().translate(_FOLD)))
    much = OFTEN * some.total()
    hot = frozenset(w for w, n in some.items() if n > much and w not in _SEPARATORS)
    sent = texts.mapInArrow(lambda batches: _counted(batches, hot), "word binary, salt int, n long, rest binary")
    near = sent.repartition("word", "salt").sortWithinPartitions("word", "salt")
    cut = near.mapInArrow(lambda batches: _merged(batches, least), "word binary, w2 binary, w3 binary, w4 binary, n long")
    cut = cut.groupBy("word", "w2", "w3", "w4").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))
    w1, lang = F.substring_index("word", "\t", 1), F.expr("substring(word, instr(word, '\t') + 1)")
    return cut.select(lang.alias("lang"), w1.alias("w1"), *[F.col(c).cast("string").alias(c) for c in ("w2", "w3", "w4")], "n")


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, w1 .. w4, k, f``: all phrases of k words with ``least`` occurrences, and with k = 0 all words of a language."""
    kept = windows(docs, least)
    rolled = kept.rollup("lang", *_COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # The grouping id has a one for each column that is summed over; a window that is padded is no phrase of that length.
    k = F.lit(WORDS) - F.length(F.regexp_replace(F.bin("g"), "0", ""))
    last = F.coalesce(*[F.when(F.col("k") == i + 1, F.col(c)) for i, c in enumerate(_COLUMNS)], F.lit("-"))
    return rolled.withColumn("k", k.cast("int")).where((F.col("k") >= 0) & (last != "") & ((F.col("k") == 0) | (F.col("f") >= least))).select(
        "lang", *[F.when(F.col("k") > i, F.col(c)).otherwise("").alias(c) for i, c in enumerate(_COLUMNS)], "k", "f")


def phrase(*words: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(w, F.lit("")) for w in words])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, scale: int = SCALE) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = written(frequent(docs, least), "phrases")
    words = [F.col(c) for c in _COLUMNS]
    known = found.where("k > 0").select("lang", "k", phrase(*words).alias("phrase"), "f")
    each = found.where("k > 1").select("lang", "k", F.col("f").alias("a"), phrase(*words).alias("phrase"), F.filter(F.array(*words), lambda w: w != "").alias("words"))
    slices = lambda i, size: F.array_join(F.slice("words", i, size), " ")
    cuts = each.select("lang", "k", "a", "phrase", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "a", "phrase", "cut", slices(F.lit(1), F.col("cut")).alias("left"), slices(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    parts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({scale} as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: slices(i, size))))).alias("phrase")
    held = each.where("k > 2").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * share)
    left = scored.join(held, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "worst.*")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)  # each task keeps its own first rows only
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}


def _oracle() -> str:
    """The same in DuckDB, with an n-gram list for each length."""
    grams = " union all ".join(
        f"select lang, {k} as k, array_to_string(w[i:i + {k - 1}], ' ') as phrase from (select lang, w, unnest(range(1, len(w) - {k} + 2)) as i from pieces where len(w) >= {k})"
        for k in range(1, WORDS + 1))
    return f"""
with cut as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
pieces as materialized (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from cut),
f as materialized (select lang, k, phrase, count(*) as f from ({grams}) group by all),
keyed as materialized (select lang || chr(9) || phrase as key, f from f where f >= {LEAST}),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as materialized (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1 and f >= {LEAST}),
cuts as (
  select c.lang, c.phrase, a, cut, l.f as l, r.f as r, (({SCALE}::hugeint * a) // (l.f + r.f))::bigint as score
  from (select *, lang || chr(9) || array_to_string(w[:cut], ' ') as p, lang || chr(9) || array_to_string(w[cut + 1:], ' ') as q
    from (select *, unnest(range(1, k)) as cut from c)) c
  join keyed l on l.key = p join keyed r on r.key = q),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (
  select lang, inside as phrase, max(a) as longer from (
    select lang, a, k, s, array_to_string(w[i:i + s - 1], ' ') as inside
    from (select *, unnest(range(1, k - s + 2)) as i from (select *, unnest(range(2, k)) as s from c where k > 2))) group by all),
stay as (select worst.* from worst left join held using (lang, phrase) where longer is null or 100::hugeint * longer < {SHARE}::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from stay join n using (lang)
qualify rank <= {TOP}"""


ORACLES = {"op13_phrase_collocations": _oracle()}

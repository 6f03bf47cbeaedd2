"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Words and word beginnings that mark toxic documents are learned from the labelled training rows: those in
at least ``LEAST`` toxic documents and ``TIMES`` as often in toxic ones as in others, relative to how many
there are of each, at most ``ENTRIES`` of either, the strongest first. A document is then described by the
density and number of such words, how often one stands near a second-person word, and by
rates of capitals, exclamation and question marks, other marks and obfuscated words. Trees learn from at most
``SAMPLE`` labelled ids, taken by a hash; isotonic regression on training rows that the trees did not see turns
their scores into probabilities.

Rows whose CRC-32 of the id has remainder 2 by 4 are held out: nothing is learned from them. Null and empty
texts have all rates 0 and are scored like others. Labels that are null count for nothing, equal labels
of one id count once, and of rows that share an id the least text is learned from. With one class
only, or none, every score is the share of toxic training rows, 0 if there are none.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import UPPER, documents, written

LEAST, TIMES, ENTRIES, STEM, SAMPLE = 4, 8.0, 400, 4, 20_000
CUTOFF = 0.3
NEAR = 3
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta",
                 "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
FEATURES = ["lexicon", "stems", "n_lexicon", "n_stems", "near_you", "capitals", "exclamations", "questions", "marks", "obfuscated"]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}@$*]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    return _part(doc_id) == 2


def _part(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    """Marked words and beginnings, from ``text, toxic``; at most ENTRIES of each reach the driver."""
    total = F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))
    toxic, other = train.agg(*total).first()
    rows = train.select("toxic", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("w"))

    def strongest(entries: Column) -> list[str]:
        n = rows.select("toxic", F.explode(entries).alias("w")).groupBy("w").agg(
            F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("o"))
        ratio = (F.col("t") / max(toxic, 1)) / ((F.col("o") + 0.5) / max(other, 1))
        found = n.where(F.col("t") >= LEAST).withColumn("ratio", ratio).where(F.col("ratio") >= TIMES)
        return [r["w"] for r in found.orderBy((F.log("ratio") * F.col("t")).desc(), "w").limit(ENTRIES).collect()]

    stems = F.array_distinct(F.transform(F.filter("w", lambda w: F.char_length(w) > STEM), lambda w: F.substring(w, 1, STEM)))
    return strongest(F.col("w")), strongest(stems)


def features(docs: DataFrame, words: list[str], stems: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and FEATURES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def kind(w: Column) -> Column:
        """One letter for each word: L in the lexicon, S by its beginning, Y second person, else a full stop."""
        return (F.when(w.isin(words or [""]), "L").when((F.char_length(w) > STEM) & F.substring(w, 1, STEM).isin(stems or [""]), "S")
                .when(w.isin(list(SECOND_PERSON)), "Y").otherwise("."))

    rows = docs.select(*keep, text.alias("_t"), F.array_join(F.transform(tokens(text), kind), "").alias("_k"))
    n, chars = F.greatest(F.char_length("_k"), F.lit(1)), F.greatest(F.char_length("_t"), F.lit(1))
    without = {x: F.char_length("_k") - F.char_length(F.replace("_k", F.lit(x), F.lit(""))) for x in "LS"}

    def rate(characters: str) -> Column:
        return (F.char_length("_t") - F.char_length(F.translate("_t", characters, ""))) / chars

    near = F.regexp_count("_k", F.lit(f"[LS][.LS]{{0,{NEAR - 1}}}Y|Y[.Y]{{0,{NEAR - 1}}}[LS]"))
    values = [without["L"] / n, (without["L"] + without["S"]) / n, without["L"], without["S"], near / n, rate(UPPER), rate("!"), rate("?"),
              rate("#*$%&|<>@"), F.regexp_count("_t", F.lit("\\p{L}[@$*0-9]+\\p{L}")) / n]
    return rows.select(*keep, *[v.cast("double").alias(f) for v, f in zip(values, FEATURES)])


def chosen(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of training labels, at most SAMPLE: the leading parts of their hashes that fit."""
    keys = written(labels.where("toxic is not null and doc_id is not null").where(_part(F.col("doc_id")) != 2).select("doc_id", "toxic").distinct(), "labels")
    parts = max(1, -(-64 * keys.count() // SAMPLE))
    marked = keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "toxic"), F.lit(parts)))
    sizes = {r["part"]: r["count"] for r in marked.where("part < 64").groupBy("part").count().collect()}
    last, rows = 0, 0
    while last < min(parts, 64) and rows + sizes.get(last, 0) <= SAMPLE:
        rows, last = rows + sizes.get(last, 0), last + 1
    return marked.where(F.col("part") < last).select("doc_id", "toxic")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    wanted = F.broadcast(chosen(labels)).withColumnRenamed("doc_id", "_id")  # at most SAMPLE rows of numbers
    train = docs.join(wanted, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(train.select("doc_id", "text", "toxic", _part(F.col("doc_id")).alias("part")), "sample")
    words, stems = lexicon(sample)
    table = written(features(sample, words, stems, ["toxic", "part"]), "features")
    counts = {(r["toxic"], r["part"] == 3): r["count"] for r in table.groupBy("toxic", F.col("part")).count().collect()} if words or stems else {}
    fit_on = {t for (t, calibrates) in counts if not calibrates}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    every = features(docs, words, stems, ["doc_id"])
    if fit_on >= {0, 1}:
        data = assembler.transform(table.withColumn("label", F.col("toxic").cast("double")))
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=1).fit(data.where("part <> 3"))
        raw = vector_to_array("probability")[1].alias("raw")
        held = trees.transform(data.where("part = 3")).select(raw, "label")
        seen = {t for (t, calibrates) in counts if calibrates}
        score = F.col("raw")
        out = trees.transform(assembler.transform(every)).select("doc_id", raw)
        if seen:
            curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
            # Steps of the curve tie; a thousandth of the trees' own score orders inside them.
            out, score = curve.transform(out), 0.999 * F.col("score") + 0.001 * F.col("raw")
    else:
        share = table.agg(F.avg("toxic")).first()[0] or 0.0
        out, score = every.select("doc_id"), F.lit(float(share))
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_boosted_toxicity": op10_boosted_toxicity}
ORACLES: dict[str, str] = {}

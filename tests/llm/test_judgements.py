import math
import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import catalog, quality, quotes, toxicity

D = "/root/testdata/sf0.001"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(make, odd_rows, none, spark):
    rng = random.Random(3)
    rows = odd_rows + [(500 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n#|x|\n#|x|", "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (77777, 0), (2, None)], "doc_id bigint, quality int")
    got = quality.judged(make(rows), labels)
    want = Counter((i, *counted(t)) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got.select("doc_id", *quality.MEASURED).collect()) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.judged(none, labels).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_foreign_columns_pass_through_with_their_values(spark):
    """Names that the operator uses itself, and one with a dot."""
    names = ["n_capitals", "a.b", "_text", "_lines", "_passes", "kept", "n_words", "_stratum", "_row", "_id", "base_failed", "quality", "stratum"]
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "en", *range(700, 700 + len(names))), (2, "short", None, *range(len(names)))],
                                 "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    kept = quality.survivors(docs, labels)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, text, "en", *range(700, 700 + len(names)))]
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert got[1].n_words == 40 and got[1].kept and got[2].base_failed and got[1]["a.b"] == 701


def test_binomial_tail(spark):
    cases = [(0, 100), (3, 1000), (40, 10_000), (9, 20), (0, 1), (700, 90_000)]
    rows = spark.createDataFrame(cases, "k bigint, n bigint").withColumn("p", quality.tail(F.col("k"), F.col("n"), 0.01)).collect()
    for r in rows:
        term = lambda j: math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99))  # noqa: E731, B023
        want = 1.0 if r.k > r.n * 0.01 else sum(map(term, range(r.k + 1)))
        assert abs(r.p - want) < 1e-9 + 1e-6 * want


def test_thresholds_are_certified_by_stratum(spark):
    rng = random.Random(0)
    rows = []
    for stratum, n in (("big", 6000), ("small", 60)):
        for k in range(n):
            bad = k % 5 == 0
            rows.append((stratum, 0 if bad else 1, rng.uniform(0.4, 2) if bad else rng.uniform(0, 0.06), 0.0, 0.0, 0.0, 5.0))
    schema = "stratum string, quality int, symbols double, dup_lines double, repeats double, capitals double, long_words double"
    got = [tuple(r) for r in quality.thresholds(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("big", "symbols", 0.3)]  # too few labels certify nothing in the small stratum


def test_quotes(spark):
    rows = [(1, 0, "user", "Shall we meet on Monday?\n\nBring the red folder, please."), (1, 1, "assistant", "On Tue, A wrote:\n> Bring the  red\n> folder, please.\nI will."),
            (1, 2, "user", "> > Bring the red folder, please.\n> I will.\nThanks"), (1, 3, "assistant", "> nobody said this\nWhat?"),
            (1, 5, "user", "> shall we MEET on monday?\nYes"), (2, 0, "user", "> Thanks\nhm"), (None, 1, "user", "> Thanks"), (1, None, "user", None), (1, 3, "assistant", "again")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("thread", F.lit("x")).withColumn("hash", F.lit(1))
    got = Counter((r.conv_id, r.turn, r.reply_to, r.thread, r.depth, r.n_quoted > 0, r.said) for r in quotes.linked(table).collect())
    assert got == Counter([
        (1, 0, None, 0, 0, False, rows[0][3]), (1, 1, 0, 0, 1, True, "I will."), (1, 2, 1, 0, 2, True, "Thanks"), (1, 3, 2, 0, 3, False, "What?"),
        (1, 3, 2, 0, 3, False, "again"), (1, 5, 0, 0, 1, True, "Yes"), (2, 0, None, 0, 0, False, "hm"), (None, 1, None, 1, 0, False, ""), (1, None, None, None, 0, False, "")])
    assert quotes.linked(table.where("conv_id = 9")).count() == 0


def test_toxicity(spark, make, none):
    rng = random.Random(6)
    plain, rude = [f"word{k}" for k in range(300)], [f"rudely{k}" for k in range(12)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=60) + (rng.choices(rude, k=3) + ["you"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id bigint, toxic int")
    rows += [(2000, None, None, None), (None, "", "en", "s")]
    got = toxicity.scored(make(rows), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) > 0
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 2000)
    assert toxicity.scored(none, labels).count() == 0
    assert {r.score for r in toxicity.scored(make(rows[:5]), labels.where("doc_id = 1")).collect()} == {0.0}


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages"):
        db.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, D)
    found = db.execute(catalog.ORACLES[name])
    at = [c[0] for c in found.description]
    assert Counter(tuple(r) for r in df.select(*at).collect()) == Counter(found.fetchall())


def test_pipeline_stages(spark, stored, odd_rows, none, tmp_path):
    folder = tmp_path / "in"
    stored.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(8, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs, seen = spark.read.parquet(str(folder / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == stored.columns
        seen.append(docs.collect())
    passed = {i for i, t, *_ in odd_rows if (m := counted(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r.doc_id for r in seen[0]} == passed
    assert Counter(r.text for r in seen[1]) == Counter({r.text for r in seen[0]})  # no two are equal but for case here
    assert {8, 9} <= {r.doc_id for r in seen[1]} and {8, 9} & {r.doc_id for r in seen[2]} == {8}  # white space only differs
    assert {r.doc_id for r in seen[3]} <= {r.doc_id for r in seen[2]}
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(folder)).count() == 0


def test_stages_do_not_make_row_ids_anew_when_they_are_read(spark, stored, tmp_path):
    """Ids of a second read name other rows where files are cut otherwise, so ids are written once and joined."""
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.mix):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        df = stage(spark, stored, "")
        assert "monotonically_increasing_id" not in df._jdf.queryExecution().toString()
        many = sorted(map(str, df.collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many more tasks when the result is read
        try:
            assert sorted(map(str, df.collect())) == many
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

"""Quality rules with risk-controlled thresholds.

Fixed rules reject a text with too few words or too many repeated windows. Each further rule compares
a measure with a cutoff, and labelled documents decide the cutoff: for every stratum, rule and
candidate cutoff the holdout's good documents that would be rejected are counted, and a cutoff is
valid if the exact binomial bound says that a false rejection rate of ``RISK`` or more would hardly show so few:
P(at most k of n rejected | rate RISK) <= ALPHA / tests. Tests are counted over all strata, rules and cutoffs
(Bonferroni), and the rules of a stratum share ``RISK`` equally, so with confidence 1 - ALPHA no
stratum loses more than ``RISK`` of its good documents to these rules. Of the valid cutoffs the one of least
cost is taken, bad documents kept against good ones lost; where none is valid the rule does not reject.

Candidates are fixed, so they do not depend on the labels. All counting is done over all labelled
documents; a stratum is a language.

A null text has no words and fails the fixed rules. Null languages form a stratum. Labels without
a document, or with a null quality, count for nothing; of repeated labels of a document each counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import UPPER, documents, packed, unpacked, words, written

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
RISK, ALPHA = 0.02, 0.05
#: Measures of which a high value speaks against a text.
CUTOFFS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0), "dup_lines": (0.01, 0.02, 0.05, 0.1), "repeats": (0.1, 0.15, 0.2, 0.25),
    "capitals": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5), "long_words": (8.0, 10.0, 12.0, 15.0, 20.0),
}
#: A good document lost costs as much as so many bad ones kept.
FALSE_COST = 50
#: What a result shows; n_capitals is for a rule only.
MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a name that is taken is replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    names = [c for c in docs.columns if c not in (*MEASURED, "n_capitals")]
    rows = docs.select(*[f"`{c}`" for c in names], words(F.col("text").cast("string")).alias("_words"), lines.alias("_lines"), text.alias("_text"))
    n = F.size("_words")
    # A window by the hash of its words; 64 bits tell the windows of one text apart.
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    rows = rows.select(
        *[f"`{c}`" for c in names], n.cast("long").alias("n_words"), F.char_length(F.translate("_text", " \t\n\v\f\r", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.octet_length("_text") - F.octet_length(F.translate("_text", UPPER, ""))).cast("long").alias("n_capitals"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    # Most texts repeat no window, which a distinct count tells; only the others are sorted.
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    marked = F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*[c for c in rows.columns if c != "_windows"], marked.alias("_marked"))
    return rows.select(*[c for c in rows.columns if c != "_marked"], F.coalesce(_covered(F.col("_marked")), F.lit(0)).cast("long").alias("n_repeat_words"))


def _covered(marked: Column) -> Column:
    """Words in windows that occur twice or more, from the sorted (hash, place) of all windows."""
    n = F.size(marked)
    pairs = F.zip_with(F.slice(marked, 1, n - 1), F.slice(marked, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    # Each repeated window adds the words up to the next one, eight at most.
    return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct(
        (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum"), i.alias("last")))["sum"]


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / n,
        "repeats": F.col("n_repeat_words") / n, "long_words": F.col("word_chars") / n,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial, by its largest term in logarithms and the ratios of the ones below."""
    log_top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0),
        lambda s, i: s + F.log((n - i) / (i + 1.0))) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    ratios = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (i * (1 - rate) / ((n - i + 1) * rate))).alias("term"),
                              (s["sum"] + s["term"] * (i * (1 - rate) / ((n - i + 1) * rate))).alias("sum")))["sum"]
    # Above the mean the terms below grow; nothing is certified there.
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(log_top) * ratios)


def thresholds(holdout: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """``stratum, rule, cutoff``: reject what lies above. ``holdout``: stratum, quality, and a column for each rule."""
    pairs = [(r, c) for r, cuts in CUTOFFS.items() for c in cuts]
    above = [F.count(F.when((F.col("quality") == q) & (F.col(r) > c), 1)).alias(f"{kind}{i}")
             for i, (r, c) in enumerate(pairs) for q, kind in ((1, "k"), (0, "b"))]
    counts = holdout.groupBy("stratum").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("n"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"), *above)
    tested = counts.select("stratum", "n", "bad", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b")) for i, (r, c) in enumerate(pairs)]))
        .alias("t")).select("stratum", "n", "bad", "t.*")
    tests = tested.withColumn("tests", F.count("*").over(Window.partitionBy()))  # a few dozen rows for each stratum
    valid = tests.where(tail(F.col("k"), F.col("n"), risk / len(CUTOFFS)) <= alpha / F.col("tests"))
    cost = (F.col("bad") - F.col("b")) / F.greatest("bad", F.lit(1)) + FALSE_COST * F.col("k") / F.col("n")
    return valid.where("b > 0").groupBy("stratum", "rule").agg(F.min(F.struct(cost.alias("cost"), (-F.col("cutoff")).alias("minus"))).alias("best")).select(
        "stratum", "rule", (-F.col("best.minus")).alias("cutoff"))


def _verdicts(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``_row`` (the given columns of ``docs`` as c0, c1 ...), MEASURED, base_failed and kept.

    Texts are measured once: the measures are written, thresholds and verdicts read them.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("_stratum")
    found = written(measured(docs.select(packed(columns), F.col("doc_id").alias("_id"), lang, "text")).drop("text"), "measures")
    x = measures()
    marks = labels.select(F.col("doc_id").alias("_id"), "quality")
    known = found.select("_id", F.col("_stratum").alias("stratum"), *[x[r].alias(r) for r in CUTOFFS]).join(marks, "_id")
    cuts = thresholds(known.where("quality is not null"))
    wide = cuts.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))  # a row for each language
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in CUTOFFS])
    rejected = reduce(lambda a, b: a | b, [F.coalesce(x[r] > F.col(f"_cut_{r}"), F.lit(False)) for r in CUTOFFS])
    joined = found.join(wide, "_stratum", "left").withColumn("base_failed", base_failed())
    return joined.select("_row", *MEASURED, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all), MEASURED, base_failed and kept; of these names a column that is taken gives way."""
    columns = docs.columns if columns is None else columns
    new = (*MEASURED, "base_failed", "kept")
    return _verdicts(docs, labels, columns).select(*unpacked(columns, [c for c in columns if c not in new]), *new)


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns as they are, whatever their names."""
    return _verdicts(docs, labels, docs.columns).where("kept").select(*unpacked(docs.columns))


def op9_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(documents(spark, sf_dir), labels, ["doc_id"]).select("doc_id", *MEASURED, "base_failed", "kept")


QUERIES = {"op9_risk_controlled_quality": op9_risk_controlled_quality}


def _oracle() -> str:
    """The same in DuckDB, with windows compared as words and the binomial by log-gamma."""
    pairs = [(r, c) for r, cuts in CUTOFFS.items() for c in cuts]
    tested = " union all ".join(
        f"select stratum, '{r}' as rule, {c} as cutoff, count(*) filter (quality = 1) as n, count(*) filter (quality = 0) as bad, "
        f"count(*) filter (quality = 1 and {r} > {c}) as k, count(*) filter (quality = 0 and {r} > {c}) as b from known group by stratum" for r, c in pairs)
    rate = RISK / len(CUTOFFS)
    rejects = " or ".join(f"coalesce({r} > (select cutoff from chosen c where c.stratum = m.stratum and c.rule = '{r}'), false)" for r in CUTOFFS)
    return f"""
with d as (
  select doc_id, coalesce(lang, '?') as stratum, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as l from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW})),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (
  select doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by doc_id),
b as (
  select d.doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_capitals,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from d left join cov using (doc_id)),
m as (
  select *, n_symbols / greatest(n_words, 1) as symbols, n_dup_lines / greatest(n_words, 1) as dup_lines,
    n_repeat_words / greatest(n_words, 1) as repeats, word_chars / greatest(n_words, 1) as long_words,
    n_capitals / greatest(word_chars, 1) as capitals,
    n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from b),
known as (select m.*, quality from m join labels using (doc_id) where quality is not null),
tested as ({tested}),
valid as (
  select * from (select *, count(*) over () as tests from tested) q
  where b > 0 and k <= n * {rate} and (
    select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate})))
    from (select unnest(range(0, k + 1)) as j)) <= {ALPHA} / tests),
chosen as (
  select stratum, rule, cutoff from (
    select *, row_number() over (partition by stratum, rule order by (bad - b) / greatest(bad, 1) + {FALSE_COST} * k / n, cutoff desc) as place from valid)
  where place = 1)
select doc_id, {', '.join(MEASURED)}, base_failed, not base_failed and not ({rejects}) as kept from m"""


ORACLES = {"op9_risk_controlled_quality": _oracle()}

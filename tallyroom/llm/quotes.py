"""Quotation linking: conversations in reply order without quotes.

A line's level is the number of ``>`` it begins with. Consecutive lines of one level above 0 are a quoted
passage. Passages, paragraphs and lines are hashed after lower-casing and folding white
space, both as quoted and as a message's own words (level 0), and a quoted unit is joined to the first message
of its conversation that has the unit as its own; whole passages count before paragraphs, those before lines.
A message answers the source of its quoted passage of the lowest level, of several the latest. One that
quotes nothing known answers the turn before it, if there is one, else it begins a thread. Threads and
depths are found by letting every message's pointer skip to its target's target.

Sorted by ``conv_id, thread, turn`` the rows are conversations in which each reply follows what it answers. ``said``
is the text without quoted lines and the lines that announce them ("... wrote:").

A null text is empty. A message without conversation or turn begins a thread of its own and is never linked;
rows that share both are one message to others, and each keeps its own row. A quote never links to its own or a later turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import written

_MARK = "^(?:[ \\t]*>)+[ ]?"
_ANNOUNCES = "(?i)\\b(wrote|schrieb|a écrit|escribió)\\s*:\\s*$"


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with row, lines (array of level and text) and said."""
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: F.struct(
        F.regexp_count(F.regexp_extract(x, _MARK, 0), F.lit(">")).alias("level"), F.regexp_replace(x, _MARK, "").alias("body")))
    rows = messages.withColumn("_lines", lines)
    after = F.concat(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))))
    own = F.filter(F.zip_with("_lines", after, lambda x, y: F.when((x["level"] == 0) & ~((y["level"] > 0) & x["body"].rlike(_ANNOUNCES)), x["body"])), lambda x: x.isNotNull())
    return rows.withColumn("_said", F.trim(F.array_join(own, "\n")))


def units(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, size, hash of every passage, paragraph and line; size 3 for a passage, 2 a paragraph, 1 a line."""
    # Runs of one level, as text: a line feed joins lines of a run, a form feed stands between runs.
    runs = F.aggregate("_lines", F.struct(F.lit("").alias("text"), F.lit(-1).alias("level")), lambda s, x: F.struct(
        F.concat(s["text"], F.when(s["level"] == -1, "").when(s["level"] == x["level"], "\n").otherwise("\f"),
                 F.when(s["level"] == x["level"], "").otherwise(F.concat(x["level"].cast("string"), F.lit("\v"))),
                 F.translate(x["body"], "\f\v", "  ")).alias("text"), x["level"].alias("level")))["text"]
    passages = rows.select("conv_id", "turn", F.explode(F.split(runs, "\f")).alias("p")).select(
        "conv_id", "turn", F.split("p", "\u000b")[0].cast("int").alias("level"), F.split("p", "\u000b")[1].alias("body"))
    paragraphs = F.transform(F.split("body", "\n[ \\t]*\n"), lambda x: F.struct(F.lit(2).alias("size"), folded(x).alias("text")))
    lines = F.transform(F.split("body", "\n"), lambda x: F.struct(F.lit(1).alias("size"), folded(x).alias("text")))
    every = F.concat(F.array(F.struct(F.lit(3).alias("size"), folded(F.col("body")).alias("text"))), paragraphs, lines)
    return passages.select("conv_id", "turn", "level", F.explode(every).alias("u")).where("u.text <> ''").select(
        "conv_id", "turn", "level", "u.size", F.xxhash64("u.text").alias("hash")).where("conv_id is not null and turn is not null")


def linked(messages: DataFrame) -> DataFrame:
    """``messages`` with reply_to, thread, depth, n_quoted (linked quoted units) and said."""
    rows = parsed(messages)
    found = written(units(rows), "units")
    own = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = found.where("level > 0").groupBy("conv_id", "hash", "turn").agg(F.min(F.struct("level", -F.col("size"))).alias("rank"), F.count("*").alias("n"))
    links = quoted.join(own, ["conv_id", "hash"]).where("source < turn").groupBy("conv_id", "turn").agg(
        F.min(F.struct("rank", (-F.col("source")).alias("minus"))).alias("best"), F.sum("n").alias("n_quoted")).select(
        "conv_id", "turn", (-F.col("best.minus")).alias("reply_to"), "n_quoted")
    nodes = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    parents = nodes.join(links, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("reply_to", "before").alias("reply_to"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"))
    tree = written(parents.select("*", F.coalesce("reply_to", "turn").alias("thread"), F.col("reply_to").isNotNull().cast("long").alias("depth"),
                                  F.col("reply_to").isNull().alias("done")), "tree")
    done, open_ = tree.where("done"), tree.where("not done")
    while not open_.isEmpty():  # the pointers' reach doubles each time; a message whose target is settled is settled
        far = done.unionAll(open_).select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"), F.col("done").alias("reached"))
        new = written(open_.join(far, ["conv_id", "thread"]).select(
            "conv_id", "turn", "reply_to", "n_quoted", F.col("next").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("reached").alias("done")), "tree")
        done, open_ = done.unionAll(new.where("done")), new.where("not done")
    tree = done
    names = [c for c in messages.columns if c not in ("reply_to", "thread", "depth", "n_quoted", "said")]
    placed = rows.alias("m").join(tree.alias("t"), (F.col("m.conv_id") == F.col("t.conv_id")) & (F.col("m.turn") == F.col("t.turn")), "left")
    return placed.select(*[F.col(f"m.`{c}`") for c in names], "t.reply_to", F.coalesce("t.thread", "m.turn").alias("thread"),
                         F.coalesce("t.depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("t.n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.col("m._said").alias("said"))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "n_quoted", "said")


QUERIES = {"op1_quotation_linking": op1_quotation_linking}
#: The given conversations quote nothing, and a quote mark fails the twin; tests hold quotes against brute force.
ORACLES = {"op1_quotation_linking": """
with recursive m as (select conv_id, turn, role, trim(coalesce(text, ''), ' ') as said from conversations where not regexp_matches(coalesce(text, ''), '(^|\\n)[ \\t]*>')),
n as (select distinct conv_id, turn from m where conv_id is not null and turn is not null),
p as (select n.conv_id, n.turn, b.turn as reply_to from n left join n b on n.conv_id = b.conv_id and n.turn = b.turn + 1),
t as (
  select conv_id, turn, reply_to, turn as thread, 0::bigint as depth from p where reply_to is null
  union all
  select p.conv_id, p.turn, p.reply_to, t.thread, t.depth + 1 from p join t on p.conv_id = t.conv_id and p.reply_to = t.turn)
select m.conv_id, m.turn, role, reply_to, coalesce(thread, m.turn) as thread, coalesce(depth, 0) as depth, 0::bigint as n_quoted, said
from m left join t on m.conv_id = t.conv_id and m.turn = t.turn"""}

"""A Merkle manifest of a dataset, and a recursive query that climbs it.

Every row is a leaf: the SHA-256 of its fields. The leaves of a language, ascending by id, form a tree: every two
neighbours become one node until one node, the language's subroot, is left; the subroots, ordered by language,
form a tree in the same way up to the root. A node without a neighbour is hashed alone.

**Building.** Leaves are placed by a range shuffle and counts per task, so no task ranks a whole language. A round
gathers ``2 ** STRIDE`` neighbours at a time, folds them to their common node, and stores for each of them a row that
links it to that node and holds the siblings on the way. A round leaves one row in 256, so a tree takes a few
rounds however large it is. Trees of all languages are built together, then the tree of their subroots.

**Climbing.** A recursive common table expression starts at the leaves, joins each with its node's row, folds
the hash over that row's siblings and appends them to the proof, and goes on from the parent until no row links further.
A stored row spans eight levels rather than one, because each step of the recursion shuffles every leaf with its proof so
far; the siblings and their order are those of single levels. Upper nodes have very many leaves below them, so
their rows are stored once for each of up to ``SALTS`` salts and a leaf joins that of its own salt.

Defined results: a null field counts as ``-`` and an empty text as ``0:``. Rows that share an id are leaves of their own,
ordered by their hash; rows without an id come first. An empty table has no root and no rows. Further columns are
not read, whatever their names. Nodes are kept as 32 bytes and written out as hexadecimal text where they are hashed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written

STRIDE, SALTS = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots; the trees of languages are numbered from 0.
TOP = -1
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """``leaves``: doc_id, tree, place, salt, leaf, changed, path. ``nodes``: a row for each link. ``subroots``: tree, lang, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None


def digest(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("binary"), 256))


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of a row: each field as its UTF-8 byte count, a colon and its value, or ``-``."""
    text = [c.cast("string") for c in fields.values()]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def placed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within the key, and ``total``, by a range shuffle and counts per task.

    The key columns must not be null.
    """
    spread = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    table = written(spread.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    runs = table.groupBy(*key, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each key and task
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    joined = table.withColumn("_part", part).join(runs, [*key, "_part"])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "total")


def _round(rows: DataFrame) -> DataFrame:
    """A group of neighbours in each row: tree, total, left (nodes of the tree above), up, top and its members.

    ``rows``: tree, total (leaves), n (nodes of this round), place, hash, rest. A member is place, hash, rest and path:
    the sibling on each level, null where there is none.
    """
    groups = rows.groupBy("tree", "total", "n", F.shiftright("place", STRIDE).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("place", "hash", "rest"))).alias("m"))
    # Levels to one node, as far as this round goes: the binary digits of n - 1.
    groups = groups.withColumn("h", F.expr(f"if(n > 1, least({STRIDE}, length(bin(n - 1))), 0)")).withColumn("l0", F.expr("transform(m, x -> x.hash)"))
    for j in range(STRIDE):
        groups = groups.withColumn(f"l{j + 1}", F.expr(
            f"if({j} < h, transform(sequence(0, (size(l{j}) - 1) div 2), i -> unhex(sha2(cast(concat(lower(hex(l{j}[2 * i])), "
            f"coalesce(lower(hex(get(l{j}, 2 * i + 1))), '')) as binary), 256))), l{j})"))
    levels = F.array(*[F.col(f"l{j}") for j in range(STRIDE)]).alias("levels")
    groups = groups.select("tree", "total", "n", "up", "h", "m", levels, F.col(f"l{STRIDE}")[0].alias("top"))
    return groups.select("tree", "total", F.shiftright(F.col("n") + 2**STRIDE - 1, STRIDE).alias("left"), "up", "top", F.expr("""
        transform(m, (x, k) -> named_struct('place', x.place, 'hash', x.hash, 'rest', x.rest, 'path',
          if(h > 0, transform(sequence(0, h - 1), j -> get(levels[j], shiftright(k, j) ^ 1)), cast(array() as array<binary>))))""").alias("members"))


def _climbed(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of the trees of ``rows`` (tree, total, place, hash, rest), and the top of each: tree, total, round, hash."""
    rounds, tops = [], None
    rows = rows.withColumn("n", F.col("total"))
    while True:
        done = written(_round(rows), "round")
        rounds.append(done)
        ended = done.where("left = 1").select("tree", "total", F.lit(len(rounds)).alias("round"), F.col("top").alias("hash"))
        tops = ended if tops is None else tops.unionAll(ended)
        above = done.where("left > 1")
        if above.limit(1).count() == 0:
            return rounds, tops
        rows = above.select("tree", "total", F.col("left").alias("n"), F.col("up").alias("place"), F.col("top").alias("hash"), F.lit(None).cast("int").alias("rest"))


def _links(done: DataFrame, number: int) -> DataFrame:
    """The rows of a round's members: tree, total, round, place, path and the parent's tree, round and place."""
    each = done.select("tree", "total", "up", F.explode("members").alias("x"))
    return each.select("tree", "total", F.lit(number).alias("round"), "x.place", "x.path",
                       F.col("tree").alias("up_tree"), F.lit(number + 1).alias("up_round"), F.col("up").alias("up_place"))


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs``: doc_id, source, lang, n_chars, text.

    ``changed`` is an n_chars to check instead of the stored one, null to leave a row alone; the tree is
    built from what is stored. Missing columns count as null.
    """
    spark = docs.sparkSession
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])
    fields = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), leaf(fields | {"n_chars": changed}))
    # Null before all others, in the order of bytes.
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    hashed = rows.select(group.alias("group"), "doc_id", leaf(fields).alias("hash"), other.alias("changed"))
    found = written(placed(written(hashed, "leaves"), ["group"], ["doc_id", "hash"]), "placed")
    trees = written(placed(found.where("place = 0").select("group", F.col("total").alias("size")), [], ["group"]), "trees").select(
        "group", F.col("place").cast("int").alias("tree"), F.col("total").alias("n_trees"))
    start = found.join(trees, "group").select("tree", "total", "place", "hash", F.struct("doc_id", "changed").alias("rest"))
    rounds, tops = _climbed(start)
    tops = written(tops, "subroots")
    n_trees = trees.count()
    crown = tops.select(F.lit(TOP).alias("tree"), F.lit(n_trees).cast("long").alias("total"), F.col("tree").cast("long").alias("place"), "hash",
                        F.struct(F.col("tree").alias("from"), "round", F.col("total").alias("below")).alias("rest"))
    upper, roots = _climbed(crown)
    base = upper[0].select(F.explode("members").alias("x"), "up").select(
        F.col("x.rest.from").alias("tree"), F.col("x.rest.below").alias("total"), F.col("x.rest.round").alias("round"), F.lit(0).cast("long").alias("place"), "x.path",
        F.lit(TOP).alias("up_tree"), F.lit(1).alias("up_round"), F.col("up").alias("up_place"), F.col("x.place").alias("bits"))
    linked = base
    for number, done in [*enumerate(rounds[1:], 1), *enumerate(upper[1:], 1)]:
        linked = linked.unionByName(_links(done, number).withColumn("bits", F.col("place")))
    # A leaf's salt is its group's number, so the first links of a language have one salt and later ones many.
    many = F.expr(f"if(tree = {TOP}, {SALTS}, cast(least({SALTS}, (total + {2**STRIDE - 1}) div {2**STRIDE}) as int))")
    salts = F.expr(f"if(tree <> {TOP} and round = 1 and up_tree <> {TOP}, array(cast(place & {SALTS - 1} as int)), sequence(0, _salts - 1))")
    nodes = linked.withColumn("_salts", many).select("tree", "round", "place", "path", "bits", "up_tree", "up_round", "up_place", F.explode(salts).alias("salt"))
    leaves = rounds[0].select("tree", F.explode("members").alias("x")).select(
        "tree", "x.place", "x.rest.doc_id", F.col("x.hash").alias("leaf"), "x.rest.changed", "x.path")
    lang = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1))
    subroots = tops.select("tree", F.col("hash").alias("subroot")).join(trees.select("tree", lang.alias("lang")), "tree")
    root = roots.first()  # one row
    return Manifest(leaves, written(nodes, "nodes"), subroots, bytes(root["hash"]) if root else None)


def _fold(start: str, path: str, place: str) -> str:
    """SQL for the hash at the end of a path; a one in the binary place says that the sibling stands on the left."""
    return f"""aggregate(transform({path}, (s, j) -> named_struct('s', lower(hex(s)), 'j', j)), {start}, (a, x) -> unhex(sha2(cast(
      if(x.s is null, lower(hex(a)), if(shiftright({place}, x.j) & 1 = 1, concat(x.s, lower(hex(a))), concat(lower(hex(a)), x.s))) as binary), 256)))"""


def _siblings(path: str) -> str:
    return f"aggregate({path}, cast('' as binary), (a, s) -> concat(a, coalesce(s, cast('' as binary))))"


def climb(manifest: Manifest) -> DataFrame:
    """``doc_id, tree, leaf, proof, folded`` at the root: the siblings on the way, and the hash of the changed or stored leaf folded over them."""
    spark = manifest.leaves.sparkSession
    view = {n: f"{n}_{uuid.uuid4().hex}" for n in ("leaves", "nodes")}
    manifest.leaves.createOrReplaceTempView(view["leaves"])
    manifest.nodes.createOrReplaceTempView(view["nodes"])
    limit = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # every leaf is a row of each step
    try:
        found = spark.sql(f"""
          with recursive climb(doc_id, leaf, lang_tree, salt, tree, round, place, folded, proof) as (
            select doc_id, leaf, tree, cast(shiftright(place, {STRIDE}) & {SALTS - 1} as int), tree, 1, shiftright(place, {STRIDE}),
              {_fold("coalesce(changed, leaf)", "path", "place")}, {_siblings("path")}
            from {view["leaves"]}
            union all
            select c.doc_id, c.leaf, c.lang_tree, c.salt, n.up_tree, n.up_round, n.up_place,
              {_fold("c.folded", "n.path", "n.bits")}, concat(c.proof, {_siblings("n.path")})
            from climb c join {view["nodes"]} n on n.tree = c.tree and n.round = c.round and n.place = c.place and n.salt = c.salt)
          select c.doc_id, c.lang_tree as tree, c.leaf, c.proof, c.folded from climb c
          where c.tree = {TOP} and c.round = (select coalesce(max(up_round), 0) from {view["nodes"]} where up_tree = {TOP})""")
        return written(found, "climb")
    finally:
        spark.conf.set(_ROW_LIMIT, limit)
        for name in view.values():
            spark.catalog.dropTempView(name)


def verified(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    manifest = build(docs, changed)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    climbed = climb(manifest).join(manifest.subroots.select("tree", "subroot"), "tree")
    return climbed.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded").alias("folded_root"),
        (text("folded") == root).alias("verified"))


def tampered() -> Column:
    """One more character where 7 divides the CRC of the id."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(documents(spark, sf_dir), tampered())


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}


def _oracle() -> str:
    """The same in DuckDB, level by level and with a bitwise CRC."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    whole = " || ".join(map(field, FIELDS))
    other = " || ".join(field("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    above = "sha256(string_agg(h, '' order by i))"
    return f"""
with recursive
crc(v, k, c) as (
  select range::bigint, 0, range::bigint from range(256)
  union all select v, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
crcs as (select list(c order by v) as t from crc where k = 8),
d as (
  select doc_id, lang, sha256({whole}) as leaf, sha256({other}) as other, doc_id::varchar as s,
    dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n
  from documents),
e as (
  select d.*, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(substr(s, k, 1))::bigint for k in range(1, length(s) + 1)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 as hit from d, crcs),
low(tree, lvl, i, n, h) as (
  select tree, 0, i, n, leaf from e
  union all select tree, lvl + 1, i // 2, (n + 1) // 2, {above} from low where n > 1 group by tree, lvl, i // 2, n),
sub as (select tree, h as subroot from low where n = 1),
high(lvl, i, n, h) as (
  select 0, tree, (select count(*) from sub), subroot from sub
  union all select lvl + 1, i // 2, (n + 1) // 2, {above} from high where n > 1 group by lvl, i // 2, n),
store as (select tree, lvl, i, n, h from low union all select -1, lvl, i, n, h from high),
climb(doc_id, leaf, tree, lang_tree, lvl, i, n, folded, proof) as (
  select doc_id, leaf, tree, tree, 0, i, n, case when hit then other else leaf end, '' from e
  union all
  select c.doc_id, c.leaf, case when c.n = 1 then -1 else c.tree end, c.lang_tree, case when c.n = 1 then 0 else c.lvl + 1 end,
    case when c.n = 1 then c.tree else c.i // 2 end, case when c.n = 1 then (select count(*) from sub) else (c.n + 1) // 2 end,
    case when c.n = 1 then c.folded when c.i % 2 = 1 then sha256(s.h || c.folded) else sha256(c.folded || coalesce(s.h, '')) end,
    case when c.n = 1 then c.proof else c.proof || coalesce(s.h, '') end
  from climb c left join store s on s.tree = c.tree and s.lvl = c.lvl and s.i = xor(c.i, 1) where c.n > 1 or c.tree >= 0)
select doc_id, leaf, subroot, (select h from high where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = (select h from high where n = 1) as verified
from climb join sub on sub.tree = lang_tree where climb.tree = -1 and climb.n = 1"""


ORACLES = {"op11_merkle_manifest": _oracle()}

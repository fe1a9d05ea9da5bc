"""Merkle manifest of a dataset, and proofs folded by a recursive query.

Each row is a leaf. The leaves of a group (a language) ascend by id; runs of
``FANOUT`` nodes become a node until one is left, the group's root. The roots of the
groups, in order, are the leaves of one more tree, whose root is the dataset's.

The built levels are stored as rows that name their parent: ``(tree, level, no)``, the digests of
its children in order (``kids``, 32 bytes each), and the parent with the place among
its children. A recursive query starts at every leaf with the digest that is to be
proved and ascends: at each parent it appends a row with the other children to
the proof and folds the digest with them, up to the root.

Scale. Leaves get their place in the group from one range partitioning and a
count per (partition, group); no window runs over rows. A level is an
eighth of the one below. All leaves of a dataset meet at the same root,
so upper nodes would be hot keys of the climb: leaves climb in chunks of
``8 ** CHUNK_LEVELS`` neighbours, and a node above that level is stored once for each chunk
below it. So a key of the climb has that many leaves at most,
and the copies are one row per chunk and level. Each step shuffles the digest
only; the siblings it appends meet once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import discard, saved
from landloom.llm.turn_repair import CRC

FANOUT = 8
CHUNK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over the groups' roots.
TOP = -1
DIGEST = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    said = []
    for field in fields:
        value = field.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


def digest_of(children: Column) -> Column:
    """Digest (bytes) of a node whose children's digests, end to end, are ``children`` (bytes)."""
    return F.unhex(F.sha2(F.lower(F.hex(children)), 256))


def joined_digests(parts: Column) -> Column:
    """An array of digests (bytes) end to end."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` (saved) with ``no``: the place from 0 in its ``group``, by ``order``.

    Rows are range-partitioned and sorted; a row's place is its place in the
    partition plus the rows of its group in the partitions before.
    """
    first = F.col(group).asc_nulls_first()
    dealt = rows.repartitionByRange(first, *order).sortWithinPartitions(first, *order)
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = dealt.join(counts, dealt[group].eqNullSafe(counts["_g"]) & (part == counts["_part"]))
    out = saved(met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("no")), "numbered")
    discard(dealt)
    return out


def levels_of(leaves: DataFrame) -> list[DataFrame]:
    """Levels above ``tree, last, no, digest`` rows: ``tree, last, level, no, kids, digest``, each a saved table.

    ``last`` is the number of the tree's last node at that level. A tree ends at the
    level where it has one node; a tree of one leaf has none above it.
    """
    levels, below = [], leaves
    while below.agg(F.max("last")).first()[0]:
        level = len(levels) + 1
        kids = F.transform(F.array_sort(F.collect_list(F.struct("no", "digest"))), lambda k: k["digest"])
        up = [F.shiftright(c, 3).alias(f"up_{c}") for c in ("last", "no")]
        # The only node of its tree has no run to join.
        runs = below.where("last > 0").groupBy("tree", *up).agg(joined_digests(kids).alias("kids"))
        runs = runs.select("tree", F.col("up_last").alias("last"), F.lit(level).alias("level"), F.col("up_no").alias("no"), "kids", digest_of(F.col("kids")).alias("digest"))
        below = saved(runs, "level")
        levels.append(below)
    return levels


CLIMB = """
WITH RECURSIVE climb (row_id, lang_no, chunk, step, folded, beside, tree, level, no, slot) AS (
  SELECT row_id, lang_no, chunk, 0, start, X'', up_tree, up_level, up_no, slot FROM {leaves}
  UNION ALL
  SELECT c.row_id, c.lang_no, c.chunk, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(n.kids, 1, c.slot * 32), c.folded, substring(n.kids, c.slot * 32 + 33)))), 256)),
         concat(substring(n.kids, 1, c.slot * 32), substring(n.kids, c.slot * 32 + 33)),
         n.up_tree, n.up_level, n.up_no, n.slot
  FROM climb c JOIN {nodes} n
    ON c.lang_no = n.lang_no AND c.chunk = n.chunk AND c.tree = n.tree AND c.level = n.level AND c.no = n.no
)
SELECT row_id, lang_no, chunk, step, folded, beside FROM climb
"""


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``row_id, folded_root, proof_sha256`` per leaf, by the recursive query (saved).

    Each step of the recursion folds the digest and appends a row with the
    siblings it met; a leaf's rows in order are its proof. The rows of a chunk
    stay together, so equal siblings of neighbours compress. The recursion yields
    a row per leaf and level, so Spark's default limit of recursive rows is
    lifted while it runs; the depth ends at the root.
    """
    spark, limit = leaves.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rows = spark.sql(CLIMB, leaves=leaves, nodes=nodes).repartition("lang_no", "chunk")
        beside = F.transform(F.array_sort(F.collect_list(F.struct("step", "beside"))), lambda s: F.hex(s["beside"]))
        ends = rows.groupBy("lang_no", "chunk", "row_id").agg(F.max_by("folded", "step").alias("folded"), beside.alias("beside"))
        proof = F.sha2(F.lower(F.array_join("beside", "")), 256)
        return saved(ends.select("row_id", F.lower(F.hex("folded")).alias("folded_root"), proof.alias("proof_sha256")), "climbed")
    finally:
        spark.conf.set(limit, before)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    text_col: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per input row.

    ``tampered`` says which rows are folded with their text's ``A-Z``
    lower-cased (default: those where 3 divides the CRC-32 of the decimal id); such a row fails
    to verify exactly if that changes its text. Leaves with one id (repeated rows, null ids, which come
    first) are in order of their digests. A null group is a group of its own, the first one. Null fields are part of
    the digest, null texts stay as they are; very long texts are hashed where they
    stand; an empty table gives no row; other columns, whatever their names, take no part.
    """
    ident = F.col(id_col).cast("long")
    if tampered is None:
        tampered = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    plain = leaf_digest([F.col(f) for f in fields])
    changed = leaf_digest([lowered if f == text_col else F.col(f) for f in fields])
    start = F.when(tampered & F.col(text_col).rlike("[A-Z]"), F.unhex(changed))
    rows = docs.select(ident.alias("doc_id"), F.col(group_col).cast("string").alias("lang"), F.unhex(plain).alias("digest"), start.alias("start"))
    leaves = numbered(rows, "lang", F.col("doc_id").asc_nulls_first(), F.col("digest"))

    # Groups, in order (one row each), and the tree over their roots.
    langs = leaves.groupBy("lang").agg(F.max("no").alias("most"))
    langs = numbered(langs.withColumn("all", F.lit(0)), "all", F.col("lang").asc_nulls_first()).withColumnRenamed("no", "lang_no")
    named = F.col("lang").eqNullSafe(F.col("_lang"))
    named_trees = langs.select(F.col("lang").alias("_lang"), F.col("lang_no").alias("tree"), F.col("most").alias("last"))
    trees = leaves.join(named_trees, named).select("tree", "last", "no", "digest")
    levels = levels_of(trees)
    heights = langs.select(F.col("lang_no").alias("tree"), "most")
    tops = trees.where("last = 0").select("tree", F.lit(0).alias("height"), F.col("digest").alias("subroot"))
    for own in levels:
        tops = tops.unionByName(own.where("last = 0").select("tree", F.col("level").alias("height"), F.col("digest").alias("subroot")))
    tops = saved(tops, "tops")
    last_lang = F.lit(tops.count() - 1).cast("long")
    upper = levels_of(tops.select(F.lit(TOP).cast("long").alias("tree"), last_lang.alias("last"), F.col("tree").alias("no"), F.col("subroot").alias("digest")))

    # Every node with its parent. A group's root hangs in the upper tree; the last root hangs nowhere.
    single = not upper
    place = lambda c: (F.col(c) % FANOUT).cast("int")
    over = lambda c: F.shiftright(c, 3)
    at_top = F.lit(None).cast("long") if single else F.lit(TOP).cast("long")
    ends = F.col("level") == F.col("height")
    up_tree = F.when(ends, at_top).otherwise(F.col("tree"))
    up_level = F.when(ends, F.lit(None if single else 1).cast("int")).otherwise(F.col("level") + 1)
    up_no = F.when(ends, F.lit(None).cast("long") if single else over("tree")).otherwise(over("no"))
    slot = F.when(ends, F.lit(None).cast("int") if single else place("tree")).otherwise(place("no"))
    linked = {"up_tree": up_tree, "up_level": up_level, "up_no": up_no, "slot": slot}

    wide = FANOUT**CHUNK_LEVELS
    chunk_of = lambda level, no: F.floor(no * F.pow(F.lit(float(FANOUT)), level) / wide).cast("long")
    inner = None
    for own in levels:
        inner = own if inner is None else inner.unionByName(own)
    columns = ["lang_no", "chunk", "tree", "level", "no", "kids", *linked]
    nodes = None
    last_chunk = F.floor(F.col("most") / wide).cast("long")
    if inner is not None:
        placed = inner.join(tops.join(heights, "tree").select("tree", "height", "most"), "tree").withColumns(linked)
        # Chunks of leaves below a node: one up to CHUNK_LEVELS, more above.
        end = F.least(last_chunk, chunk_of(F.col("level"), F.col("no") + 1) - 1)
        begin = chunk_of(F.col("level"), F.col("no"))
        nodes = placed.withColumn("chunk", F.explode(F.sequence(begin, F.greatest(begin, end)))).withColumn("lang_no", F.col("tree")).select(*columns)
    if upper:
        roof = None
        for own in upper:
            roof = own if roof is None else roof.unionByName(own)
        height = len(upper)
        above = roof.select(
            F.col("level"),
            F.col("no"),
            "kids",
            F.when(F.col("level") < height, F.col("tree")).alias("up_tree"),
            F.when(F.col("level") < height, F.col("level") + 1).alias("up_level"),
            F.when(F.col("level") < height, over("no")).alias("up_no"),
            F.when(F.col("level") < height, place("no")).alias("slot"),
        )
        steps = langs.select("lang_no", last_chunk.alias("_last"), F.explode(F.sequence(F.lit(1), F.lit(height))).alias("level"))
        steps = steps.withColumn("no", F.expr("shiftright(lang_no, 3 * level)"))
        met = steps.join(above, ["level", "no"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
        met = met.withColumn("tree", F.lit(TOP).cast("long")).select(*columns)
        nodes = met if nodes is None else nodes.unionByName(met)

    base = leaves.withColumn("row_id", F.monotonically_increasing_id())
    base = base.join(tops.join(langs, tops["tree"] == langs["lang_no"]).select(F.col("lang").alias("_lang"), "tree", "height", "subroot"), named)
    base = base.withColumn("level", F.lit(0)).withColumns(linked)
    base = base.select(
        "row_id", "doc_id", F.col("tree").alias("lang_no"), F.floor(F.col("no") / wide).cast("long").alias("chunk"),
        "digest", F.coalesce("start", "digest").alias("start"), "subroot", *linked,
    )
    base = saved(base, "leaves")
    if nodes is None:
        nodes = base.select("lang_no", "chunk", F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_no").alias("no"), F.col("digest").alias("kids"), *linked).where("false")
    nodes = saved(nodes, "nodes")
    proofs = climbed(base.select("row_id", "lang_no", "chunk", "start", *linked), nodes)
    root = (upper[-1].select("digest") if upper else tops.select(F.col("subroot").alias("digest"))).first()
    said = F.lit(None).cast("string") if root is None else F.lit(bytes(root["digest"]).hex())
    out = base.select("row_id", "doc_id", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), said.alias("root"))
    out = out.join(proofs, "row_id").withColumn("verified", F.col("folded_root") == F.col("root"))
    discard(leaves, tops, nodes, *levels, *upper)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER () AS uid, {_sql_leaf("text")} AS leaf,
         {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
         {CRC.format(key="CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang COLLATE C NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves
), inner_ AS (
  SELECT tree, 0 AS level, no, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, no // 8, sha256(string_agg(h, '' ORDER BY no)), any_value((n + 7) // 8) FROM inner_ WHERE n > 1 GROUP BY tree, level, no // 8
), tops AS (SELECT *, count(*) OVER () AS wide FROM inner_ WHERE n = 1),
outer_ AS (
  SELECT -1 AS tree, 0 AS level, tree AS no, h, wide AS n FROM tops
  UNION ALL
  SELECT tree, level + 1, no // 8, sha256(string_agg(h, '' ORDER BY no)), any_value((n + 7) // 8) FROM outer_ WHERE n > 1 GROUP BY tree, level, no // 8
), nodes AS (
  -- A node with what it is part of: its key, the key of its run, its place there.
  SELECT tree || ':' || level || ':' || no AS key, CASE WHEN n > 1 THEN tree || ':' || (level + 1) || ':' || (no // 8) END AS run, no % 8 AS slot, h FROM (SELECT * FROM inner_ WHERE n > 1 UNION ALL SELECT * FROM outer_)
  UNION ALL SELECT i.tree || ':' || i.level || ':' || i.no, o.run, o.slot, i.h FROM inner_ i JOIN
    (SELECT no AS t, CASE WHEN n > 1 THEN '-1:1:' || (no // 8) END AS run, no % 8 AS slot FROM outer_ WHERE level = 0) o ON i.tree = o.t WHERE i.n = 1
), runs AS (SELECT run, list(h ORDER BY slot) AS hs FROM (SELECT DISTINCT * FROM nodes WHERE run IS NOT NULL AND NOT (key LIKE '-1:0:%')) GROUP BY run),
climb AS (
  SELECT uid, tree || ':0:' || no AS key, CASE WHEN hit THEN low ELSE leaf END AS h, '' AS proof, 0 AS steps FROM placed
  UNION ALL
  SELECT uid, n.run, sha256(array_to_string(hs[1:slot], '') || c.h || array_to_string(hs[slot + 2:], '')),
         proof || array_to_string(hs[1:slot], '') || array_to_string(hs[slot + 2:], ''), steps + 1
  FROM climb c JOIN nodes n ON c.key = n.key JOIN runs r ON n.run = r.run
), ended AS (SELECT uid, arg_max(h, steps) AS folded, arg_max(proof, steps) AS proof FROM climb GROUP BY uid),
top AS (SELECT h AS root FROM outer_ WHERE n = 1)
SELECT doc_id, leaf, tops.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN tops ON placed.tree = tops.tree JOIN ended USING (uid), top
"""

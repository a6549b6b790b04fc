"""Merkle manifest of a table: leaf, proof and root of every row, by nested-struct rollup.

Leaves are ranked within their group; the digits of the rank (base ``FAN``) are columns. Within a
block of FAN ** DIGITS ranks they are grouped away one after the other, lowest first: each grouping
turns up to FAN structs into one that holds their hash and themselves as ``kids``. A block is one
row then, a nest of bounded size; its hash is a leaf of the next tier, whose blocks are nests
again, until each group is one node. The groups' nodes are a last tree. On the way down a
transform over the nest gives every leaf of it the steps to the block's hash, an explode puts them
into rows, and the steps above come from the parent's row: one row for one block, found by
grouping both under the block's number. There is no join, and no group holds more than two rows
or FAN of them.

A step is (l, r): the digests left and right of a node in its run. The last run of a level may be
shorter, even one node; its step then has no digest at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria.llm.common import materialize, table

FAN, DIGITS = 2, 8
_STEPS = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: list[str], h: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``, nulls first) and ``size`` within ``group``.

    Rows are dealt into ranges of the order, so a group of any size is many tasks; rows equal in
    everything are told apart by their position in the input. Ranks are a row's number in its range
    plus the rows of the group in the ranges before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in (group, *order, h, "__at")]
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(n, *sort)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    all_of = Window.partitionBy(group)
    before = F.sum("__n").over(all_of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(all_of).alias("size"))
    within = Window.partitionBy(group, "__part").orderBy(*sort)
    numbered = dealt.withColumn("__row", F.row_number().over(within))
    on = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    rank = (F.col("__before") + F.col("__row") - 1).alias("rank")
    return numbered.join(counts, on).select(*rows.columns, rank, F.col("size").cast("long"))


def _nested(nodes: DataFrame, keep: list[str], fan: int, digits: int) -> DataFrame:
    """(grp, block, size, node) from (grp, rank, size, h, keep...): the nest of each block."""
    digit = [F.pmod(F.floor(F.col("rank") / fan**k), F.lit(fan)).cast("int").alias(f"d{k}") for k in range(digits)]
    block = F.floor(F.col("rank") / fan**digits).cast("long")
    leaf = F.struct("h", *keep).alias("node")
    rows = nodes.select("grp", block.alias("block"), "size", *digit, leaf).repartition("grp", "block")
    for k in range(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), F.col("node").alias("node"))), lambda a, b: a["d"] - b["d"])
        rows = rows.groupBy("grp", "block", "size", *[f"d{j}" for j in range(k + 1, digits)]).agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
        # a group of up to fan ** k rows is one node already, which goes up as it is
        joined = F.when(F.col("size") > fan**k, digest(F.array_join(F.transform("kids", lambda x: x["h"]), ""))).otherwise(F.col("kids")[0]["h"])
        rows = rows.withColumn("node", F.struct(joined.alias("h"), F.col("kids"))).drop("kids")
    return rows


def _leaves(node: Column, level: int, fan: int, size: Column, above: Column) -> Column:
    """The leaves under ``node`` with the steps from each to the top of the nest and on ``above``."""
    if level == 0:
        return F.array(F.struct(node.alias("leaf"), above.alias("steps")))
    kids = node["kids"]
    hashes = F.transform(kids, lambda x: x["h"])

    def one(kid: Column, i: Column) -> Column:
        left = F.array_join(F.slice(hashes, F.lit(1), i), "")
        right = F.array_join(F.slice(hashes, i + 2, F.lit(fan)), "")
        step = F.array(F.struct(left.alias("l"), right.alias("r")))
        step = F.when(size > fan ** (level - 1), step).otherwise(F.expr(f"cast(array() as {_STEPS})"))
        return _leaves(kid, level - 1, fan, size, F.concat(step, above))

    return F.flatten(F.transform(kids, one))


def tree(nodes: DataFrame, keep: list[str], fan: int = FAN, digits: int = DIGITS) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Merkle trees of the groups of ``nodes`` (grp, rank, size, h, keep...).

    Returns (grp, top), one row per group, and the tiers, lowest first, for :func:`proofs`: the nests
    (grp, block, size, node) and the digits grouped away in them. No tier takes more digits than
    the largest group's ranks have.
    """
    nodes, tiers = materialize(nodes, "leaves"), []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        used = next((k for k in range(1, digits) if fan**k >= largest), digits)
        nest = materialize(_nested(nodes, keep, fan, used), "tier")
        tiers.append((nest, used))
        nodes, keep = nest.select("grp", F.col("block").alias("rank"), F.ceil(F.col("size") / fan**used).cast("long").alias("size"), F.col("node.h").alias("h")), []
        if largest <= fan**used:
            return nodes.select("grp", F.col("h").alias("top")), tiers
        largest = -(-largest // fan**used)


def proofs(tiers: list[tuple[DataFrame, int]], above: DataFrame, fan: int = FAN) -> DataFrame:
    """(grp, leaf, steps, more) of every leaf of the lowest tier; ``above`` (grp, steps, more) has the steps
    that follow each group's top."""
    parents, none = above.select("grp", F.lit(0).cast("long").alias("block"), "steps", "more"), F.lit(None)
    for tier, digits in reversed(tiers):
        up = parents.select("grp", "block", none.cast("long").alias("size"), none.cast(tier.schema["node"].dataType).alias("node"), "steps", "more")
        own = tier.select("grp", "block", "size", "node", none.cast(_STEPS).alias("steps"), none.cast(above.schema["more"].dataType).alias("more"))
        both = own.unionByName(up).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "steps", "more")])
        leaves = _leaves(F.col("node"), digits, fan, F.col("size"), F.col("steps"))
        rows = both.select("grp", "block", "more", F.posexplode(leaves).alias("at", "x"))
        parents = rows.select("grp", (F.col("block") * fan**digits + F.col("at")).alias("block"), "x.steps", "more", "x.leaf")
    return parents.select("grp", "leaf", "steps", "more")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def proof_digest(steps: Column) -> Column:
    """One hash of all digests of the steps, in order."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """One row per row of ``docs``: order column, group, leaf, steps, subroot, root, and
    ``checked``, the leaf of the row as it would be with the values of ``tampered``.

    A leaf is the hash of ``fields``. Leaves of a group ascend by ``order`` (nulls first; rows
    with the same value by their leaf, equal rows in any order, which changes no hash). Groups ascend by
    UTF-8 bytes, null first. Nulls are values of their own in any field. Columns that are not in
    ``fields``, ``group`` or ``order`` are not read. An empty table gives an empty manifest.
    """
    values = {c: F.col(c) for c in fields}
    plain = digest(*[field(v) for v in values.values()])
    changed = digest(*[field(v) for v in (values | (tampered or {})).values()]) if tampered else plain
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("key"), plain.alias("h"), changed.alias("checked"))
    tops, tiers = tree(ranked(rows, "grp", ["key"], "h"), ["key", "checked"], fan, digits)
    # the groups' tops are the leaves of one more tree
    upper = tops.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("top").alias("h"))
    root, upper_tiers = tree(ranked(upper, "grp", ["name"], "h"), ["name"], fan, digits)
    whole = root.select("grp", F.expr(f"cast(array() as {_STEPS})").alias("steps"), F.col("top").alias("more"))
    of_group = proofs(upper_tiers, whole, fan)
    more = F.struct(F.col("leaf.h").alias("subroot"), F.col("more").alias("root")).alias("more")
    found = proofs(tiers, of_group.select(F.col("leaf.name").alias("grp"), "steps", more), fan)
    return found.select(F.col("leaf.key").alias(order), F.col("grp").alias(group), F.col("leaf.h").alias("leaf"), "steps", "more.subroot", "more.root", "leaf.checked")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"n_chars": n_chars})
    back = folded(F.col("checked"), F.col("steps"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal number, bit by bit: 0xEDB88320 is the reversed polynomial.
_CRC = """list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS checked
  FROM documents),
levels AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM levels WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY lvl, pos // 2, n),
walk AS (
  SELECT doc_id, lang, leaf, checked, 0 AS lvl, pos, n, '' AS seen, checked AS h FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.checked, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.seen || coalesce(s.h, ''),
         sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END)
  FROM walk w LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1),
at_top AS (SELECT w.doc_id, w.leaf, w.seen, w.h, t.subroot, t.pos, t.n FROM walk w JOIN tops t ON w.lang IS NOT DISTINCT FROM t.lang WHERE w.n = 1),
climb AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, pos, n, seen, h FROM at_top
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.seen || coalesce(s.h, ''),
         sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END)
  FROM climb w LEFT JOIN upper s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1)
SELECT c.doc_id, c.leaf, c.subroot, r.h AS root, sha256(c.seen) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM climb c, (SELECT h FROM upper WHERE n = 1) r WHERE c.n = 1
"""

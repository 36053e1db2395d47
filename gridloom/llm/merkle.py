"""Merkle manifest of a dataset: a leaf hash a row, a tree for each language, one root over the languages' roots, and
for each row the proof that leads from its leaf to that root.

A leaf is the hash of a row's fields; two consecutive nodes (at the end of a run one) become their parent, level by level.
A node is kept in the row of its first leaf. So at level l the sibling of a node stands 2^l rows before or after it: a lead and a
lag column with that fixed offset, masked by the slot (left or right) and the run length, supply the siblings, and rows of
first children hash the parents. A running window, which takes the last node at or before a row, hands each leaf its ancestors' siblings.

A language's leaves are not one window: leaves are numbered by ranges (counts of ranges give the offsets) and dealt into
aligned blocks of 2^BITS consecutive ones. All levels of a block are windows over one sort, without another shuffle; the
blocks' nodes are the leaves of the next tier, a 2^BITS-th of the rows, which works alike, until every language has one node.
The languages' roots, in order, go the same way. The tiers' siblings are joined back by block: a language may be as
large as it likes, as each block is a key of its own.

Texts are read once, for the leaf; afterwards a row is its id, its language and one or two hashes. The driver sees
the number of rows and the largest number of leaves of a language.

Defined results: a null field counts as ``-`` in its leaf; a null language is a language of its own, first in order; leaves with
equal or null ids (these first) follow one another by their hash, so that equal rows get the places of their group in any order;
a lone leaf is its language's root, a lone language's root the root; the proof of a row without any sibling is the hash of no
text; an empty table gives an empty result. Other columns are carried along by ``manifest``; those named like its own (``subroot``,
``root``, ``path``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BITS = 10  # levels that a block holds
ROWS = 200_000  # of a range, sorted by a task
FEW = 50_000  # ranges and groups, some dozen bytes each, that are broadcast
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def group_key(name: Column) -> Column:
    """A text for each value and for null, in the same order, null first: joins and windows need no null-safe keys."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df (__g, others) with __pos, a row's place in its group from 0, and __n, the group's rows. Ranges are by group, order and, for
    rows that agree in all that, an arbitrary number, so that no range grows with equal rows. df should be written already."""
    parts = -(-df.count() // ROWS) or 1
    keys = ["__g", *order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = cut(tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__tie"))
    part = F.shiftright("__at", 33)  # the rest counts a partition's rows
    counts = ranged.groupBy("__g", part.alias("__part")).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    upto = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    known = cut(counts.withColumn("__before", F.sum("__rows").over(upto) - F.col("__rows")).withColumn("__n", F.sum("__rows").over(Window.partitionBy("__g"))).drop("__rows"))
    known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
    return ranged.withColumn("__part", part).join(known, ["__g", "__part"]).withColumn("__pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__before", "__first")


def climb(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """nodes (__g, __pos, __n, __h, others) with __block, __up: the hash of the node ``bits`` levels higher (or of the group's
    root, if that is lower) on the row of its first leaf, and __sibs: for each level with more than one node the sibling of the
    row's node, as its side (L, R) and its hash, or an empty text where a run has but one node."""
    block = "OVER (PARTITION BY __g, __block ORDER BY __pos"
    own = [f"`{c}`" for c in nodes.columns]
    out, found = nodes.selectExpr(*own, f"shiftright(__pos, {bits}) AS __block", "__h AS __h0"), []
    for level in range(bits):
        h, step = f"__h{level}", 1 << level
        node, first, pair = f"__pos % {step} = 0 AND __n > {step}", f"__pos % {2 * step} = 0", f"__pos + {step} < __n"
        sibling = f"CASE WHEN {node} AND {first} AND {pair} THEN concat('R', __next) WHEN {node} AND {first} THEN '' WHEN {node} THEN concat('L', __last) END AS __s{level}"
        parent = f"CASE WHEN {node} AND {first} AND {pair} THEN sha2(concat({h}, __next), 256) WHEN {node} AND {first} THEN sha2({h}, 256) WHEN {first} THEN {h} END AS __h{level + 1}"
        near = out.selectExpr("*", f"lead({h}, {step}) {block}) AS __next", f"lag({h}, {step}) {block}) AS __last")
        out = near.selectExpr(*own, "__block", *found, sibling, parent)
        found.append(f"__s{level}")
    running = ", ".join(f"last({s}, true) {block} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for s in found)
    return out.selectExpr(*own, "__block", f"__h{bits} AS __up", f"array_compact(array({running})) AS __sibs")


def _ascend(nodes: DataFrame, largest: int, bits: int) -> tuple[list[DataFrame], list[int]]:
    """The tiers, from nodes on to the last one with one node a group (__g, __pos, __n, __h), and the levels of each but that."""
    tiers, levels = [nodes], []
    while largest > 1:
        levels.append(min(bits, (largest - 1).bit_length()))
        up = climb(tiers[-1].select("__g", "__pos", "__n", "__h"), levels[-1]).filter(F.pmod("__pos", F.lit(1 << levels[-1])) == 0)
        remain = F.shiftright(F.col("__n") + ((1 << levels[-1]) - 1), levels[-1])
        tiers.append(cut(up.select("__g", F.col("__block").alias("__pos"), remain.alias("__n"), F.col("__up").alias("__h"))))
        largest = -(-largest >> levels[-1])
    return tiers, levels


def _descend(tiers: list[DataFrame], levels: list[int], known: DataFrame) -> DataFrame:
    """The first tier's rows with __path, from them up to known's (__g, __path, others), and known's other columns."""
    known = known.withColumn("__block", F.lit(0).cast("long"))
    if len(tiers) == 1:
        return tiers[0].join(known.drop("__block"), "__g")
    for nodes, bits in reversed(list(zip(tiers, levels))):
        higher = known.withColumnRenamed("__path", "__higher")
        lower = climb(nodes, bits).drop("__up").join(higher, ["__g", "__block"]).withColumn("__path", F.concat("__sibs", "__higher")).drop("__sibs", "__higher", "__block")
        known = lower.withColumnRenamed("__pos", "__block").drop("__n", "__h")
    return lower


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", bits: int = BITS) -> DataFrame:
    """rows (group, order, leaf, others) with subroot, root and path: the siblings from leaf to root, each with its side (L, R)
    before it, or empty where a node is alone in its run. Leaves of a group ascend by order, then by their hash."""
    rows = rows.drop(*(c for c in ("subroot", "root", "path") if c not in (group, leaf, *order)))
    leaves = cut(rows.withColumn("__g", group_key(F.col(group))).withColumn("__h", F.col(leaf)))
    placed = cut(numbered(leaves, [*order, leaf]))
    tiers, levels = _ascend(placed, placed.agg(F.max("__n")).first()[0] or 0, bits)
    tops = tiers[-1].select("__g", F.col("__h").alias("__subroot"))
    # the groups' roots are one more group
    listed = cut(tops.select(F.lit("").alias("__g"), F.col("__g").alias("__name"), F.col("__subroot").alias("__h")))
    ordered = cut(numbered(listed, ["__name"]))
    above, steps = _ascend(ordered, ordered.count(), bits)
    root = above[-1].select("__g", F.col("__h").alias("__root"), F.array().cast("array<string>").alias("__path"))
    outer = _descend(above, steps, root).select(F.col("__name").alias("__g"), "__path", F.col("__h").alias("__subroot"), "__root")
    inner = _descend(tiers, levels, cut(outer))
    return inner.select(*rows.columns, F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.col("__path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def step(h, s):
        side, other = F.substring(s, 1, 1), F.substring(s, 2, 64)
        return F.when(side == "L", digest(other, h)).when(side == "R", digest(h, other)).otherwise(digest(h))

    return F.aggregate(path, leaf, step)


def proof(path: Column) -> Column:
    """The hash of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    damaged = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    plain = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", leaf_of(plain).alias("leaf"), F.when(damaged, leaf_of(changed)).alias("tampered"))
    made = manifest(rows, "lang", ["doc_id"]).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || {value} END"


def _tree_sql(name: str, leaves: str) -> str:
    """A recursive CTE of all nodes (g, l, k, n, h) above leaves (g, k, n, h)."""
    return f"""{name} AS (SELECT g, 0 AS l, k, n, h FROM {leaves} UNION ALL
  SELECT g, l + 1, k // 2, (n + 1) // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY k) AS nxt FROM {name}) WHERE n > 1 AND k % 2 = 0)"""


_CRC = """xor(list_reduce([4294967295] || list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
ORACLE = f"""WITH RECURSIVE crcs AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({' || '.join(map(_field_sql, FIELDS))}) AS leaf, sha256({' || '.join(_field_sql('n_chars + 1' if c == 'n_chars' else c) for c in FIELDS)}) AS other FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM hashed),
leaves AS (SELECT g, k, n, leaf AS h FROM placed),
{_tree_sql('tree', 'leaves')},
subroots AS (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n, h FROM tree WHERE n = 1),
{_tree_sql('upper', 'subroots')},
nodes AS MATERIALIZED (SELECT 0 AS tier, g, l, k, n, h FROM tree UNION ALL SELECT 1, '', l, k, n, h FROM upper),
root AS (SELECT h AS root FROM upper WHERE n = 1),
steps AS (
  SELECT p.r, 0 AS tier, p.g, 0 AS l, p.k, p.n FROM placed p UNION ALL
  SELECT r, CASE WHEN s.n > 1 THEN s.tier ELSE 1 END, CASE WHEN s.n > 1 THEN s.g ELSE '' END, CASE WHEN s.n > 1 THEN s.l + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN s.k // 2 ELSE t.k END, CASE WHEN s.n > 1 THEN (s.n + 1) // 2 ELSE t.n END
  FROM steps s LEFT JOIN subroots t ON s.tier = 0 AND t.name = s.g WHERE s.n > 1 OR s.tier = 0),
siblings AS (
  SELECT s.r, row_number() OVER (PARTITION BY s.r ORDER BY s.tier, s.l) AS i, s.k, coalesce(o.h, '') AS h FROM steps s
  LEFT JOIN nodes o ON o.tier = s.tier AND o.g = s.g AND o.l = s.l AND o.k = xor(s.k, 1) WHERE s.n > 1),
folds AS (
  SELECT r, 0 AS i, CASE WHEN {_CRC} % 7 = 0 THEN other ELSE leaf END AS h FROM placed, crcs UNION ALL
  SELECT f.r, f.i + 1, sha256(CASE WHEN s.k % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM folds f JOIN siblings s ON s.r = f.r AND s.i = f.i + 1),
ends AS (SELECT r, arg_max(h, i) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, string_agg(h, '' ORDER BY i) AS p FROM siblings GROUP BY r)
SELECT p.doc_id, p.leaf, t.h AS subroot, root, sha256(coalesce(q.p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN ends e USING (r) JOIN subroots t ON t.name = p.g CROSS JOIN root LEFT JOIN proofs q USING (r)"""

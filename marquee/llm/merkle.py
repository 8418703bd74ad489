"""Merkle manifest of a table: leaf digests, one tree a language, one tree
over the languages' roots, and a proof for every row.

Trees grow by sibling-shift self-joins.  A level holds its nodes under
(grp, idx); it is joined with itself on the computed index of the sibling,
``idx XOR 1``, and the rows in slot zero of their pair (even ``idx``) emit
the parent.  Proofs come down the same way: a node's proof is its sibling
followed by the proof of its parent, ``idx >> 1``.  Texts are read once, for
the leaves, and never shuffled; every level is a written table, so a lost
executor never leads back below it, and no row, group or level passes
through the driver or one task.

Results for odd input: a null column is hashed as ``-``; rows with a null
doc_id come first in their language, rows with equal doc_id follow each other
by digest, so repeated rows are repeated leaves; an empty or very long text
is hashed whole; an empty table has no rows and no root; other columns of the
input, whatever their names, are neither read nor hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.keys import surrogate_key
from marquee.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ONE_TASK_NODES = 4096            # levels of at most so many nodes are joined in one task


def digest(*fields: str | Column) -> Column:
    """SHA-256 of the fields, each written as its UTF-8 length, a colon and
    its value, or ``-`` if null; lower-case hex."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def _parent(h: Column, sibling: Column) -> Column:
    return F.unhex(F.sha2(F.concat(_hex(h), F.coalesce(_hex(sibling), F.lit(""))), 256))


def _with_sibling(nodes: DataFrame, at_most: int) -> DataFrame:
    """Nodes (grp, idx, n, h) with the sibling's digest, null for the last
    node of an odd level."""
    if at_most <= ONE_TASK_NODES:
        nodes = nodes.coalesce(1)
    other = nodes.select(F.col("grp").alias("_grp"), F.expr("idx ^ 1").alias("_idx"), F.col("h").alias("sib"))
    return nodes.join(other, (nodes["grp"] == other["_grp"]) & (nodes["idx"] == other["_idx"]), "left").drop("_grp", "_idx")


def _grow(leaves: DataFrame, most: int, rows: int, groups: int, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """All levels of the trees over ``leaves`` (grp, idx, n, h), and the
    roots (grp, h).  A level has the nodes of the trees that have more than
    one there, with their siblings; ``most`` is the largest number of leaves
    of a tree."""
    levels, roots, nodes = [], [leaves.where("n = 1").select("grp", "h")], leaves
    for height in range((most - 1).bit_length() if most else 0):
        at_most = (rows >> height) + groups
        level = materialize(_with_sibling(nodes.where("n > 1"), at_most), f"merkle-{name}-{height}")
        levels.append(level)
        nodes = level.where("idx % 2 = 0").select("grp", F.expr("idx div 2").alias("idx"), F.expr("(n + 1) div 2").alias("n"), _parent(F.col("h"), F.col("sib")).alias("h"))
        roots.append(nodes.where("n = 1").select("grp", "h"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, out


def _step() -> Column:
    """One step of a proof: empty for a node without sibling, else the side
    of the sibling (1 right, 2 left) and its digest."""
    side = F.when(F.expr("idx % 2 = 0"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("02")))
    return F.when(F.col("sib").isNull(), F.unhex(F.lit(""))).otherwise(F.concat(side, F.col("sib")))


def _descend(levels: list[DataFrame], tops: DataFrame, rows: int, groups: int, name: str) -> DataFrame:
    """Proofs (grp, idx, path) of the leaves, given those of the roots
    (grp, height, path)."""
    def roots(height: int) -> DataFrame:
        return tops.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("idx"), "path")

    above = roots(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        if (rows >> height) + groups <= ONE_TASK_NODES:
            level, above = level.coalesce(1), above.coalesce(1)
        up = above.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
        here = level.join(up, (level["grp"] == up["_grp"]) & (F.expr("idx div 2") == up["_idx"]))
        above = here.select("grp", "idx", F.concat(F.array(_step()), F.col("_path")).alias("path")).unionByName(roots(height))
        if height:
            above = materialize(above, f"merkle-{name}-path-{height}")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """Hex digest of the root that a leaf's hex digest and a proof give."""
    def up(node, step):
        sibling = _hex(F.substring(step, 2, 32))
        return F.sha2(F.when(F.length(step) == 0, node).when(F.hex(F.substring(step, 1, 1)) == "01", F.concat(node, sibling)).otherwise(F.concat(sibling, node)), 256)
    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """SHA-256 of the hex digests of a proof's siblings, from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda step: _hex(F.substring(step, 2, 32))), ""), 256)


@dataclass
class Manifest:
    """``leaves`` (doc_id, lang, leaf, further digests, grp, idx, n),
    ``levels`` of the languages' trees, ``top`` levels of the tree over their
    roots, ``subroots`` (grp, lang, height, h), ``root`` (h) of at most one
    row, and the numbers of leaves and languages."""
    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: DataFrame
    rows: int
    groups: int


def build(docs: DataFrame, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text).
    ``also`` names further hex digests to be taken of every row in the same
    scan."""
    also = also or {}
    rows = docs.select(F.col("doc_id"), F.col("lang"), F.unhex(digest(*FIELDS)).alias("leaf"), *[F.unhex(c).alias(k) for k, c in also.items()])
    ranked = surrogate_key(rows, ["lang", "doc_id", "leaf"], "rank", dtype="long")
    langs = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    langs = materialize(surrogate_key(langs, "lang", "grp", dtype="long").withColumn("grp", F.col("grp") - 1), "merkle-langs")
    total, groups, most = langs.agg(F.sum("n"), F.count(F.lit(1)), F.max("n")).first()
    total, most = total or 0, most or 0
    ids = langs.select("grp", "first", "n", F.col("lang").alias("_lang"))
    leaves = ranked.join(ids, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("idx", F.col("rank") - F.col("first")).drop("_lang", "rank", "first")
    levels, roots = _grow(leaves.select("grp", "idx", "n", F.col("leaf").alias("h")), most, total, groups, "leaf")
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    subroots = materialize(roots.join(langs.select("grp", "lang", height.alias("height")), "grp"), "merkle-subroots")
    top, root = _grow(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(groups).cast("long").alias("n"), "h"), groups, groups, 1, "top")
    return Manifest(leaves, levels, top, subroots, root.select("h"), total, groups)


def proofs(m: Manifest) -> DataFrame:
    """Every row with its proof: (doc_id, lang, leaf and further digests as
    hex, subroot, root, path); ``path`` has the steps from leaf to root."""
    start = m.root.select(F.lit(0).cast("long").alias("grp"), F.lit(len(m.top)).alias("height"), F.array().cast("array<binary>").alias("path"))
    across = _descend(m.top, start, m.groups, 1, "top").select(F.col("idx").alias("grp"), "path")
    tops = materialize(m.subroots.join(across, "grp").crossJoin(F.broadcast(m.root.select(F.col("h").alias("root")))), "merkle-tops")
    paths = _descend(m.levels, tops.select("grp", "height", "path"), m.rows, m.groups, "leaf")
    digests = [c for c in m.leaves.columns if c not in ("doc_id", "lang", "grp", "idx", "n")]
    up = paths.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), "path")
    ends = tops.select(F.col("grp").alias("_top"), _hex(F.col("h")).alias("subroot"), _hex(F.col("root")).alias("root"))
    placed = m.leaves.join(up, (F.col("grp") == F.col("_grp")) & (F.col("idx") == F.col("_idx"))).join(ends, F.col("grp") == F.col("_top"))
    return placed.select("doc_id", "lang", *[_hex(F.col(c)).alias(c) for c in digests], "subroot", "root", "path")


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """Every row with its proof, and the root that the proof gives for the
    ``tampered`` digest of the row: (doc_id, lang, leaf, tampered, subroot,
    root, path, folded_root, verified)."""
    found = proofs(build(docs, {"tampered": tampered}))
    found = found.withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

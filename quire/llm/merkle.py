"""Merkle manifest of a table: one tree a group, one over the groups' roots, and a version
of it for every changed row.

Every row becomes a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8
length, ``:`` and the value. Within a tree leaves stand in order; while several nodes
remain, every two neighbours become the SHA-256 of their digests as hex text (a last one
alone becomes that of its own). The roots of the trees, in order of their names (null first),
are the leaves of the upper tree.

Trees are built in aligned blocks of 4,096 nodes, one small group each, whatever the size
of a tree: the tops of the blocks are the nodes of the next level, which is cut in blocks
again. A block is a persistent tree: a changed leaf makes a new version by copying
its ancestors; all other nodes are shared. A version goes on above its block along the
same nodes' path: its task has the siblings up to the root, one row a block, and copies one
ancestor a level, so versions never meet in one place.

Leaves are numbered without a window over a whole tree: rows are cut into sampled ranges of
(tree, order), numbered inside them, and the ranges' counts are added.

Defined cases: null fields, trees and order keys are values of their own, null first; rows of
the same tree and order key stand by their leaf, equal rows in the order in which they are read (their
digests are equal, so the roots do not depend on it); an empty table gives no rows; long
texts are hashed where they are read and never moved. Only the columns in ``keep`` are passed on;
one that is named like an output column is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.arrow_ops import col
from quire.operators.ordered import RANGE, cut
from quire.session import written

#: levels of a block; a block has 2^HEIGHT nodes at most
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT = ("position", "leaf", "subroot", "root", "proof", "version_root")
_STEPS = "steps array<struct<left:binary,right:binary>>"


def digest(*parts: bytes) -> bytes:
    """The parent of these digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def height(nodes: int) -> int:
    """Levels from so many nodes to one."""
    return max(nodes - 1, 0).bit_length()


class PersistentTree:
    """Nodes that are never changed: a digest and up to two children. ``root`` is the first
    version; ``with_leaf`` makes another one."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.digests, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(*row[i : i + 2]) for i in range(0, len(row), 2)]
        (self.root,) = row

    def _node(self, left: int, right: int = -1) -> int:
        kids = [self.digests[left]] if right < 0 else [self.digests[left], self.digests[right]]
        self.digests.append(digest(*kids))
        self.left.append(left)
        self.right.append(right)
        return len(self.digests) - 1

    def _way(self, root: int, place: int) -> list[tuple[int, bool]]:
        """From the root down: each ancestor, and whether the way goes right."""
        out = []
        for level in range(self.levels - 1, -1, -1):
            goes_right = bool(place >> level & 1)
            out.append((root, goes_right))
            root = self.right[root] if goes_right else self.left[root]
        return out

    def with_leaf(self, root: int, place: int, leaf: bytes) -> int:
        """The root of a version of ``root`` with another leaf; only ancestors are copied."""
        way = self._way(root, place)
        self.digests.append(leaf)
        self.left.append(-1)
        self.right.append(-1)
        node = len(self.digests) - 1
        for above, goes_right in reversed(way):
            node = self._node(self.left[above], node) if goes_right else self._node(node, self.right[above])
        return node

    def steps(self, root: int, place: int) -> list[tuple[bytes | None, bytes | None]]:
        """The siblings to the left and right of each node on the way, from the leaf up."""
        out = []
        for above, goes_right in reversed(self._way(root, place)):
            other = self.left[above] if goes_right else self.right[above]
            sibling = self.digests[other] if other >= 0 else None
            out.append((sibling, None) if goes_right else (None, sibling))
        return out


def climb(node: bytes, steps: Sequence[tuple[bytes | None, bytes | None]]) -> bytes:
    """The root that a node leads to beside these siblings."""
    for left, right in steps:
        node = digest(*(p for p in (left, node, right) if p is not None))
    return node


def leaf(df: DataFrame, fields: Sequence[str] = FIELDS, changed: Mapping[str, Column] | None = None) -> Column:
    """The digest of a row (binary), with other values for the fields in ``changed``."""
    def part(name: str) -> Column:
        text = (changed or {}).get(name, col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(f) for f in fields)).cast("binary"), 256))


def number(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with ``_idx``, their number in their ``_tree`` from 0, and ``_m``, the number of
    rows of the tree, as a written table, and the largest ``_m``. ``order`` must be total."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = cut(df, keys, ["_tree"])
    totals = rows.groupBy("_tree", RANGE).agg(F.count(F.lit(1)).alias("_own"))
    # one row for each tree and range
    ranges = Window.partitionBy("_tree")
    before = ranges.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select(
        "_tree", RANGE, F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(ranges).alias("_m"))
    within = F.row_number().over(Window.partitionBy("_tree", RANGE).orderBy(*keys))
    numbered = rows.join(places, ["_tree", RANGE]).withColumn("_idx", F.col("_before") + within - 1).drop("_before", RANGE)
    numbered = written(numbered, "merkle-numbered")
    return numbered, numbered.agg(F.max("_m")).first()[0] or 0


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("_block", F.shiftright("_idx", HEIGHT))


def tops(nodes: DataFrame) -> DataFrame:
    """The nodes HEIGHT levels above ``nodes`` (_tree, _idx, _m, node)."""
    target = to_arrow_schema(T.StructType.fromDDL("_tree string, _idx long, _m long, node binary"))

    def make(block: pa.Table) -> pa.Table:
        block = block.sort_by("_idx")
        m = block["_m"][0].as_py()
        tree = PersistentTree(block["node"].to_pylist(), min(HEIGHT, height(m)))
        made = [[block["_tree"][0].as_py()], [block["_block"][0].as_py()], [-(-m >> HEIGHT)], [tree.digests[tree.root]]]
        return pa.table([pa.array(v, f.type) for v, f in zip(made, target, strict=True)], schema=target)

    return _blocks(nodes).groupBy("_tree", "_block").applyInArrow(make, "_tree string, _idx long, _m long, node binary")


def paths(nodes: DataFrame, most: int) -> DataFrame:
    """Of each node (_tree, _idx, _m, node): the siblings from it up to the root of its tree,
    and that root. ``most`` is the largest _m. ``nodes`` is a written table."""
    target = to_arrow_schema(T.StructType.fromDDL(f"_tree string, _idx long, _block long, {_STEPS}, root binary"))

    def make(block: pa.Table) -> pa.Table:
        block = block.sort_by("_idx")
        tree = PersistentTree(block["node"].to_pylist(), min(HEIGHT, height(block["_m"][0].as_py())))
        n = block.num_rows
        steps = [[{"left": a, "right": b} for a, b in tree.steps(tree.root, i)] for i in range(n)]
        made = [block["_tree"].to_pylist(), block["_idx"].to_pylist(), block["_block"].to_pylist(), steps, [tree.digests[tree.root]] * n]
        return pa.table([pa.array(v, f.type) for v, f in zip(made, target, strict=True)], schema=target)

    own = _blocks(nodes).groupBy("_tree", "_block").applyInArrow(make, f"_tree string, _idx long, _block long, {_STEPS}, root binary")
    if most <= 1 << HEIGHT:
        return own.drop("_block")
    above = paths(written(tops(nodes), "merkle-tops"), -(-most >> HEIGHT))
    above = above.select("_tree", F.col("_idx").alias("_block"), F.col("steps").alias("_more"), F.col("root").alias("_top"))
    joined = own.join(above, ["_tree", "_block"])
    return joined.select("_tree", "_idx", F.concat("steps", "_more").alias("steps"), F.col("_top").alias("root"))


def manifest(
    df: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id", changed: Column | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep`` of each row with position (in its tree), leaf, subroot, root,
    proof (sibling digests from the leaf to the root, left to right) and version_root: the
    root of the version in which this row alone has the leaf ``changed`` (binary; null: as
    it is). Digests are lowercase hex."""
    kept = [c for c in keep if c.lower() not in OUT]
    names = {c: f"_kept_{i}" for i, c in enumerate(kept)}
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), col(tree).cast("string")), F.lit("-")).alias("_tree"), col(order).alias("_order"),
        leaf(df, fields).alias("node"), F.monotonically_increasing_id().alias("_at"),
        (F.lit(None).cast("binary") if changed is None else changed).alias("_changed"), *(col(c).alias(n) for c, n in names.items()),
    )
    leaves, most = number(rows, ["_order", "node", "_at"])
    upper = written(tops(leaves.select("_tree", "_idx", "_m", "node")), "merkle-tops")
    below = written(paths(upper, -(-most >> HEIGHT)), "merkle-paths")
    roots = below.groupBy("_tree").agg(F.first("root").alias("node")).select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "node")
    roots, trees = number(roots, ["_name"])
    last = paths(roots.drop("_name"), trees).join(roots.select("_idx", "_name"), "_idx")
    last = last.select(F.col("_name").alias("_tree"), F.col("steps").alias("_more"), F.col("root").alias("_root"))
    # one row for each block
    ways = below.join(last, "_tree").select(
        "_tree", F.col("_idx").alias("_block"), F.concat("steps", "_more").alias("steps"), F.col("root").alias("_subroot"), "_root")

    results = "position long, leaf string, subroot string, root string, proof array<string>, version_root string"
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for c, n in names.items()] + T.StructType.fromDDL(results).fields)
    target = to_arrow_schema(schema)

    def prove(block: pa.Table, way: pa.Table) -> pa.Table:
        block = block.sort_by("_idx")
        nodes = block["node"].to_pylist()
        own = PersistentTree(nodes, min(HEIGHT, height(block["_m"][0].as_py())))
        upper = [(s["left"], s["right"]) for s in way["steps"][0].as_py()]
        first = own.root
        proof, versions = [], []
        for i, new in enumerate(block["_changed"].to_pylist()):
            steps = own.steps(first, i)
            proof.append([s.hex() for pair in (*steps, *upper) for s in pair if s is not None])
            top = climb(nodes[i], steps) if new is None else own.digests[own.with_leaf(first, i, new)]
            versions.append(climb(top, upper).hex())
        n = len(nodes)
        subroot, root = (way[c][0].as_py().hex() for c in ("_subroot", "_root"))
        made = [block["_idx"], [x.hex() for x in nodes], [subroot] * n, [root] * n, proof, versions]
        columns = [block[c] for c in names.values()] + [v if isinstance(v, pa.ChunkedArray) else pa.array(v) for v in made]
        return pa.table([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    grouped = _blocks(leaves).groupBy("_tree", "_block")
    proved = grouped.cogroup(ways.groupBy("_tree", "_block")).applyInArrow(prove, schema)
    return proved.withColumnsRenamed({n: c for c, n in names.items()})

"""A Merkle manifest of a table, and versions of it by path copying.

The rows of a group, in key order, are the leaves of a binary tree; the roots of all groups, in
group order, are the leaves of one more tree. Trees are built in aligned blocks: a block of 2^HEIGHT
neighbouring nodes is one task's work and yields one node of the tier above, so a tier is 2^HEIGHT
times smaller than the one below, and no task ever holds a whole group.

Versions are persistent: a changed leaf copies its ancestors and nothing else, first inside its
block, then, by the path that the block got from the tiers above, up to the root. All other nodes
of a version are those of the manifest. Versions do not depend on each other; each one starts from
the manifest, in the task of its block, so any number of them is spread like the leaves.

Positions come from a range partitioning by group and key that is written before it is counted;
rows that are equal in both are dealt out too, so neither a large group nor a repeated key is one
task's work.

Edge cases: a null group comes first, a null key first in its group; rows with equal keys lie in
the order of their digests, and equal rows have a leaf each; a group of one row is its own root;
a row without a changed digest is folded from its own leaf; an empty table has no root and no
rows. Only the wanted columns are read, so further columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: A block has 2^HEIGHT nodes at most.
HEIGHT = 12
#: A step up: the sibling's digest, and on which side it lies: -1 left, 1 right, 0 no sibling.
_STEP = pa.struct([("digest", pa.string()), ("side", pa.int32())])
_STEPS = "array<struct<digest: string, side: int>>"
_COPY = pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])
_COPIES = "array<struct<level: int, index: bigint, digest: string>>"


def digest_of(fields: Sequence[str | Column]) -> Column:
    """The digest of a row: its fields as ``-`` if null, else their byte count, ``:`` and value."""

    def part(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def joined(digests: Sequence[str]) -> str:
    """The node above the given ones."""
    return sha256("".join(digests).encode()).hexdigest()


class Block:
    """The tree over neighbouring nodes: up to one node, or up to ``height`` levels."""

    def __init__(self, nodes: list[str], height: int | None):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([joined(below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str | None, int]]:
        """The steps from a node to the top."""
        steps = []
        for nodes in self.levels[:-1]:
            other = at ^ 1
            steps.append((nodes[other], 1 if other > at else -1) if other < len(nodes) else (None, 0))
            at >>= 1
        return steps


def climb(digest: str, steps: Sequence[tuple[str | None, int]]) -> list[str]:
    """The copied nodes of a version: the digest after each step."""
    copies = []
    for other, side in steps:
        digest = joined([digest] if not side else [other, digest] if side < 0 else [digest, other])
        copies.append(digest)
    return copies


@dataclass
class Manifest:
    """``leaves``: tree, position, key, leaf, changed; ``blocks``: the path of every block of leaves
    (tree, block, height, inner steps to the group's root, outer steps from there, subroot)."""

    leaves: DataFrame
    blocks: DataFrame
    root: str | None
    height: int


def _positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its row number from 0 inside each tree, by ``order``; not yet written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *(F.col(c).asc_nulls_first() for c in order), "_tie"]
    dealt = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    dealt = stored(dealt, name)
    runs = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    position = F.col("_at") - F.col("_from") + F.col("_before")
    return (
        dealt.join(stored(runs.drop("_n"), f"{name}-runs"), ["tree", "_part"])
        .withColumn("position", position.cast("bigint"))
        .drop("_part", "_at", "_from", "_before")
    )


def _units(df: DataFrame, rows: int, height: int) -> DataFrame:
    """``df`` with the block of each node, and the unit of work its block belongs to.

    There are about as many units as full blocks, so that many small trees share a task call.
    """
    units = max(1, -(-rows >> height))
    block = F.shiftright("position", height)
    unit = F.pmod(F.xxhash64("tree", block), F.lit(units)).cast("int")
    return df.withColumn("block", block).withColumn("unit", unit)


def _blocks(table: pa.Table) -> Iterator[tuple[str, int, pa.Table]]:
    """The blocks of a unit: tree, number, nodes by position."""
    table = table.sort_by([("tree", "ascending"), ("position", "ascending")])
    trees, numbers = table["tree"].to_pylist(), table["block"].to_pylist()
    start = 0
    for end in range(1, len(trees) + 1):
        if end == len(trees) or (trees[end], numbers[end]) != (trees[start], numbers[start]):
            yield trees[start], numbers[start], table.slice(start, end - start)
            start = end


def _tops(nodes: DataFrame, rows: int, height: int) -> DataFrame:
    """The nodes above: one per block (tree, position, size of the tree, digest)."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for tree, number, block in _blocks(table):
            size = block["size"][0].as_py()
            built = Block(block["digest"].to_pylist(), height if size > 1 << height else None)
            found.append((tree, number, -(-size >> height), built.top))
        names = ["tree", "position", "size", "digest"]
        return pa.table(dict(zip(names, map(list, zip(*found)))))

    schema = "tree string, position bigint, size bigint, digest string"
    dealt = _units(nodes.select("tree", "position", "size", "digest"), rows, height)
    return dealt.groupBy("unit").applyInArrow(run, schema)


def _paths(nodes: DataFrame, above: DataFrame, rows: int, height: int) -> DataFrame:
    """The steps of every node to the root of its tree, from those of the blocks above."""

    def run(table: pa.Table, blocks: pa.Table) -> pa.Table:
        upper = {(b["tree"], b["block"]): b["steps"] for b in blocks.to_pylist()}
        out = {"tree": [], "position": [], "steps": []}
        for tree, number, block in _blocks(table):
            size = block["size"][0].as_py()
            built = Block(block["digest"].to_pylist(), height if size > 1 << height else None)
            rest = [(s["digest"], s["side"]) for s in upper.get((tree, number)) or []]
            for i, position in enumerate(block["position"].to_pylist()):
                out["tree"].append(tree)
                out["position"].append(position)
                steps = [*built.path(i), *rest]
                out["steps"].append([{"digest": d, "side": s} for d, s in steps])
        fields = [("tree", pa.string()), ("position", pa.int64()), ("steps", pa.list_(_STEP))]
        return pa.table(out, pa.schema(fields))

    dealt = _units(nodes.select("tree", "position", "size", "digest"), rows, height)
    units = max(1, -(-rows >> height))
    blocks = above.select(
        "tree",
        F.col("position").alias("block"),
        "steps",
        F.pmod(F.xxhash64("tree", "position"), F.lit(units)).cast("int").alias("unit"),
    )
    return (
        dealt.groupBy("unit")
        .cogroup(blocks.groupBy("unit"))
        .applyInArrow(run, f"tree string, position bigint, steps {_STEPS}")
    )


def _forest(nodes: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Tiers over (tree, position, size, digest): the root of each tree (tree, digest), and the
    steps of every node of ``nodes`` to it (tree, position, steps)."""
    tiers = [nodes]
    counts = []
    while True:
        rows, largest = tiers[-1].agg(F.count("*"), F.max("size")).first()
        counts.append(rows)
        if (largest or 0) <= 1:
            break
        tiers.append(stored(_tops(tiers[-1], rows, height), f"{name}-tier"))
    roots = tiers[-1].select("tree", "digest")
    none = F.array().cast(_STEPS)
    paths = tiers[-1].select("tree", "position", none.alias("steps"))
    for tier, rows in zip(tiers[-2::-1], counts[-2::-1]):
        paths = stored(_paths(tier, paths, rows, height), f"{name}-paths")
    return roots, paths


def build(df: DataFrame, key: str, group: str, leaf: str, changed: str, height: int = HEIGHT) -> Manifest:
    """The manifest of rows with a digest ``leaf``, and ``changed``: the digest of a version's leaf."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = df.select(
        tree.alias("tree"), F.col(key).alias("key"), F.col(leaf).alias("leaf"),
        F.col(changed).alias("changed"),
    )
    leaves = _positions(rows, ["key", "leaf", "changed"], "merkle-rows")
    leaves = stored(leaves, "merkle-leaves")
    sizes = stored(leaves.groupBy("tree").agg((F.max("position") + 1).alias("size")), "merkle-sizes")
    total = leaves.count()
    # The first tier is built over the leaves themselves; the tiers above have their own table.
    nodes = leaves.join(sizes, "tree").select(
        "tree", "position", "size", F.col("leaf").alias("digest")
    )
    tops = stored(_tops(nodes, total, height), "merkle-blocks")
    roots, inner = _forest(tops, height, "merkle-group")
    # The tree over the groups: one tree whose leaves are the groups' roots.
    top = roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = stored(_positions(top, ["group"], "merkle-groups"), "merkle-subroots")
    groups = top.count()
    whole, outer = _forest(top.withColumn("size", F.lit(groups).cast("bigint")), height, "merkle-top")
    outer = top.join(outer, ["tree", "position"]).select(
        F.col("group").alias("tree"), F.col("steps").alias("outer"), F.col("digest").alias("subroot")
    )
    blocks = (
        inner.join(sizes, "tree")
        .join(outer, "tree")
        .select("tree", F.col("position").alias("block"), "size", F.col("steps").alias("inner"),
                "outer", "subroot")
    )
    found = whole.first()
    return Manifest(leaves, stored(blocks, "merkle-paths"), found and found.digest, height)


def versions(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof and its version.

    Columns: tree, position, key, leaf, subroot, ``proof`` (steps from the leaf to the root) and
    ``copies``: the version's own nodes by level and index, the changed leaf first and its root
    last. Levels go on counting above a group's root, where indices are those of the groups' tree.
    """
    height = manifest.height

    def run(table: pa.Table, blocks: pa.Table) -> pa.Table:
        upper = {(b["tree"], b["block"]): b for b in blocks.to_pylist()}
        proofs, copies, subroots, parts = [], [], [], []
        for tree, number, block in _blocks(table):
            above = upper[tree, number]
            built = Block(block["leaf"].to_pylist(), height if above["size"] > 1 << height else None)
            rest = [(s["digest"], s["side"]) for s in above["inner"] + above["outer"]]
            inner = len(above["inner"])
            # Where the path enters the groups' tree: the index that its sides spell.
            place = sum((s["side"] < 0) << i for i, s in enumerate(above["outer"]))
            changed = block["changed"].to_pylist()
            for i, position in enumerate(block["position"].to_pylist()):
                steps = [*built.path(i), *rest]
                first = changed[i] or built.levels[0][i]
                nodes = [first, *climb(first, steps)]
                own = len(steps) - len(rest) + inner
                proofs.append([{"digest": d, "side": s} for d, s in steps])
                copies.append([
                    {"level": n, "index": position >> n if n <= own else place >> (n - own), "digest": d}
                    for n, d in enumerate(nodes)
                ])
            subroots += [above["subroot"]] * len(changed)
            parts.append(block.select(["tree", "position", "key", "leaf"]))
        out = pa.concat_tables(parts)
        out = out.append_column("subroot", pa.array(subroots, pa.string()))
        out = out.append_column("proof", pa.array(proofs, pa.list_(_STEP)))
        return out.append_column("copies", pa.array(copies, pa.list_(_COPY)))

    leaves = manifest.leaves
    rows = leaves.count()
    units = max(1, -(-rows >> height))
    dealt = _units(leaves, rows, height)
    blocks = manifest.blocks.withColumn(
        "unit", F.pmod(F.xxhash64("tree", "block"), F.lit(units)).cast("int")
    )
    key = leaves.schema["key"].dataType.simpleString()
    schema = (
        f"tree string, position bigint, key {key}, leaf string, subroot string, "
        f"proof {_STEPS}, copies {_COPIES}"
    )
    return dealt.groupBy("unit").cogroup(blocks.groupBy("unit")).applyInArrow(run, schema)

"""Merkle manifest of a table: a hash tree per group, one above the groups, and a proof for every row.

Leaves of a group are cut into aligned blocks. A block keeps each level of its part of the tree as one string of hex
digests: fixed-width substrings of a level are hashed to the next, and the digest that flanks a node in its level is its
sibling. Block roots are the leaves of the next round, until every group has one block; the subroots of all groups go
through the same rounds. A block is a row of fixed size, so that neither a group nor the table meets in one task.

Null cells count as ``-``. Rows with equal order stand by their digests; repeated rows are leaves of their own. An empty
table has no rows, hence no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import stored, without
from tablewarden.llm.ranks import ranked, same

#: Levels of a block; it has 2 ** LEVELS leaves.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Hex digits of a digest.
WIDTH = 64


def digest(*parts: Column) -> Column:
    """SHA-256 of the strings, one after the other, in lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def cell(value: Column) -> Column:
    """A cell as leaves hold it: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf(cells: list[Column]) -> Column:
    return digest(*[cell(c) for c in cells])


def _parents(level: Column) -> Column:
    """The level above: every two digests become one, a last single one is hashed alone."""
    runs = F.ceil(F.length(level) / (2 * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substr(level, i * (2 * WIDTH) + 1, F.lit(2 * WIDTH)), 256)), "")


def _levels(height: Column, nodes: Column) -> Column:
    """All levels of a block as an array of strings, from its leaves to its root."""
    steps = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), height)
    return F.aggregate(steps, F.array(F.array_join(nodes, "")), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _steps(levels: Column, height: Column, place: Column) -> Column:
    """The sibling segments from a leaf to the block's root: ``L`` or ``R`` and the digest, or ``N`` where a node is alone."""

    def one(h: Column) -> Column:
        node = F.call_function("shiftright", place, h)
        sibling = F.substr(F.element_at(levels, h + 1), node.bitwiseXOR(F.lit(1)) * WIDTH + 1, F.lit(WIDTH))
        return F.when(sibling == "", "N").otherwise(F.concat(F.when(node % 2 == 1, "L").otherwise("R"), sibling))

    return F.transform(F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), height), one)


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """``(g, b, n, height, leaves, levels)`` from ``nodes (g, r, n, node, *extra)``: place r of n in group g."""
    inside = F.sort_array(F.collect_list(F.struct("r", "node", *extra)))
    out = nodes.groupBy("g", F.floor(F.col("r") / BLOCK).alias("b")).agg(F.max("n").alias("n"), inside.alias("leaves"))
    # Halvings until one node is left; a block among others goes through all its levels.
    alone = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    out = out.withColumn("height", F.when(F.col("n") <= BLOCK, alone).otherwise(LEVELS))
    return out.withColumn("levels", _levels(F.col("height"), F.col("leaves.node")))


def climb(nodes: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """For ``nodes (g, r, n, node, *extra)``: ``(g, node, *extra, path)`` with each node's path to the root of its group, and ``(g, top)``."""
    blocks = stored(_blocks(nodes, extra))
    tops = blocks.select("g", "b", "n", F.element_at("levels", -1).alias("node"))
    largest = blocks.agg(F.max("n")).head()[0] or 0
    if largest <= BLOCK:
        whole = blocks.withColumn("above", F.array().cast("array<string>"))
        tops = tops.select("g", F.col("node").alias("top"))
    else:
        upper, tops = climb(tops.select("g", F.col("b").alias("r"), F.ceil(F.col("n") / BLOCK).alias("n"), "node", "b"), ["b"])
        whole = blocks.alias("x").join(upper.select("g", "b", F.col("path").alias("above")).alias("y"), same(["g", "b"], "x", "y")).select("x.*", "y.above")

    def known(x: Column) -> Column:
        place = (x["r"] - F.col("b") * BLOCK).cast("int")
        path = F.concat(_steps(F.col("levels"), F.col("height"), place), F.col("above"))
        return F.struct(x["node"].alias("node"), *[x[e].alias(e) for e in extra], path.alias("path"))

    return whole.select("g", F.inline(F.transform("leaves", known))), tops


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` and its path give."""

    def up(done: Column, step: Column) -> Column:
        side, sibling = F.substring(step, 1, 1), F.substr(step, F.lit(2), F.lit(WIDTH))
        return F.when(side == "L", digest(sibling, done)).when(side == "R", digest(done, sibling)).otherwise(F.sha2(done, 256))

    return F.aggregate(path, node, up)


def siblings(path: Column) -> Column:
    """The siblings of a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2), F.lit(WIDTH))), "")


def manifest(rows: DataFrame, cells: list[str], group: str, order: str, keep: dict[str, Column]) -> DataFrame:
    """``(*keep, leaf, subroot, root, path)`` of every row: its digest over ``cells``, the roots and its path of siblings.

    ``keep`` names columns that are computed from a row and carried along; texts are not.
    """
    leaves = rows.select(
        F.col(f"`{group}`").alias("g"),
        F.col(f"`{order}`").alias("_order"),
        leaf([F.col(f"`{c}`") for c in cells]).alias("node"),
        *[c.alias(f"_{n}") for n, c in keep.items()],
    )
    extra = [f"_{n}" for n in keep]
    placed = ranked(leaves, ["g"], ["_order", "node"]).withColumnsRenamed({"rank": "r", "group_rows": "n"})
    found, subroots = climb(placed.select("g", "r", "n", "node", *extra), extra)
    over = ranked(subroots.select(F.lit(0).alias("all"), "g", F.col("top").alias("node")), ["all"], ["g"])
    above, root = climb(over.select(F.col("all").alias("g"), F.col("rank").alias("r"), F.col("group_rows").alias("n"), "node", F.col("g").alias("group")), ["group"])
    roots = above.join(root.withColumnRenamed("top", "root"), "g").select(F.col("group").alias("g"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    out = found.alias("x").join(roots.alias("y"), same(["g"], "x", "y"))
    return out.select(*[F.col(f"x._{n}").alias(n) for n in keep], F.col("x.node").alias("leaf"), "y.subroot", "y.root", F.concat("x.path", "y.above").alias("path"))


def audit(rows: DataFrame, found: Column, cells: list[str], group: str, order: str) -> DataFrame:
    """A manifest and its check: ``found`` is the digest of the row as it is met later (null: as it was).

    Returns ``order``, ``leaf``, ``subroot``, ``root``, ``path``, ``folded_root`` (from the row as found and the siblings
    of the manifest) and ``verified``.
    """
    out = manifest(without(rows, "leaf", "subroot", "root", "path"), cells, group, order, {order: F.col(f"`{order}`"), "found": found})
    out = out.withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("path"))).drop("found")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

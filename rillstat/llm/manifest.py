"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

Rows are put in order by a range partitioning and numbered. A tree is climbed in tiers: a tier
takes blocks of neighbouring nodes, each block in one task, and goes up several levels there.
On each level conditional aggregates over a parent's children spread them into ``fanout`` slot
columns. All columns together make the parent's digest; all but the own one are a node's
siblings. The tops of the blocks are the nodes of the next tier, so the rows of a hot group are
spread over as many tasks as it has blocks, and a tier has a ``BLOCK``-th of the rows of the one below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.sinks.tables import stored

#: Nodes of a block at most, unless ``fanout`` itself is larger.
BLOCK = 256


def spelled(*values: Column) -> Column:
    """Values one after the other, each with its UTF-8 length and a colon before it; ``-`` for null."""
    texts = [value.cast("string") for value in values]
    return F.concat(*(
        F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)) for text in texts
    ))


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs), 256)


def folded(leaf: Column, path: str | Column) -> Column:
    """The root that a leaf leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, at: digest(at["before"], node, at["after"]))


def siblings(path: str | Column) -> Column:
    """The digests of all siblings of a path, from the leaf up and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), "")


def _numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``_pos``, their place from 0 among their ``_group`` by ``order``, and ``_n``, the group's size; the greatest size.

    No group is sorted in one task: ranges are numbered inside, and the counts of the ranges before are added.
    """
    keys = ["_group", *order]
    # Numbers are written with the rows, as the ranges may differ from one run of the plan to the next.
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("_group", "_range").agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    runs = stored(runs.withColumn("_n", F.sum("_rows").over(Window.partitionBy("_group"))).drop("_rows"), "runs")
    placed = placed.join(runs, ["_group", "_range"]).withColumn("_pos", F.col("_at") - F.col("_start") + F.col("_before"))
    return placed.drop("_at", "_range", "_start", "_before"), runs.agg(F.max("_n")).first()[0] or 0


def _levels(fanout: int, most: int) -> int:
    """Levels of a tier: as many as a block has room for and a tree of ``most`` nodes needs, one at least."""
    levels = 1
    while fanout**levels < most and fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _tier(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with ``_block``, the path inside their block in ``_path`` and the block's top in ``_node``."""
    # One exchange for all levels: the windows below are finer than this partitioning.
    rows = nodes.withColumn("_block", F.expr(f"_pos div {fanout ** levels}")).repartition("_group", "_block")
    for level in range(levels):
        width = fanout**level
        slot = F.expr(f"(_pos div {width}) % {fanout}")
        children = Window.partitionBy("_group", "_block", F.expr(f"_pos div {width * fanout}"))
        names = [f"_slot{s}" for s in range(fanout)]
        rows = rows.withColumns({name: F.max(F.when(slot == s, F.col("_node"))).over(children) for s, name in enumerate(names)})
        before = F.concat_ws("", *(F.when(slot > s, F.col(name)) for s, name in enumerate(names)))
        after = F.concat_ws("", *(F.when(slot < s, F.col(name)) for s, name in enumerate(names)))
        # A tree ends on the level that has one node left.
        open_ = F.col("_n") > width
        rows = rows.withColumns({
            f"_at{level}": F.when(open_, F.struct(before.alias("before"), after.alias("after"))),
            "_node": F.when(open_, F.sha2(F.concat_ws("", *names), 256)).otherwise(F.col("_node")),
        }).drop(*names)
    steps = [f"_at{level}" for level in range(levels)]
    return rows.withColumn("_path", F.filter(F.array(*steps), lambda at: at.isNotNull())).drop(*steps)


def _climbed(nodes: DataFrame, most: int, fanout: int, crown: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``nodes`` with ``_path, _subroot, _root`` up to the group's top, and through the tree that ``crown`` makes over the tops.

    ``most`` is the size of the largest group.
    """
    levels = _levels(fanout, most)
    span = fanout**levels
    tier = stored(_tier(nodes, fanout, levels), "tier")
    if most <= span:
        if crown is None:
            return tier.withColumn("_root", F.col("_node")).drop("_node", "_block")
        above = crown(tier.filter("_pos = 0").select("_group", "_node"))
        # A group has at most one block here.
        on = ["_group"]
    else:
        tops = tier.filter(f"_pos % {span} = 0")
        tops = tops.select("_group", F.col("_block").alias("_pos"), F.expr(f"(_n + {span - 1}) div {span}").alias("_n"), "_node")
        above = _climbed(tops, -(-most // span), fanout, crown).withColumnRenamed("_pos", "_block")
        on = ["_group", "_block"]
    above = above.select(*on, F.col("_path").alias("_beyond"), *(["_subroot"] if crown else []), "_root")
    return tier.join(above, on).withColumn("_path", F.concat("_path", "_beyond")).drop("_beyond", "_node", "_block")


def _over_groups(fanout: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over the groups' tops, in the order of the groups."""

    def crown(tops: DataFrame) -> DataFrame:
        rows = tops.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_node")
        made = _climbed(*_numbered(rows.withColumn("_subroot", F.col("_node")), ["_name"]), fanout, None)
        return made.select(F.col("_name").alias("_group"), "_path", "_subroot", "_root")

    return crown


def manifest(rows: DataFrame, leaf: Column, group: str, order: Sequence[str], keep: dict[str, Column], fanout: int = 2) -> DataFrame:
    """``keep``'s columns with ``leaf, subroot, root, path``, one row for each of ``rows``.

    ``leaf`` is a row's digest. The leaves of a ``group`` stand in the order of ``order`` and then of the digests. While a
    group has several nodes, every ``fanout`` consecutive ones become the digest of their digests, the last ones also if
    they are fewer, even one. ``subroot`` is what remains, the leaf itself of a group of one row. The subroots, ordered
    by group (null first, by UTF-8 bytes), make ``root`` likewise. ``path`` has for each level the siblings
    ``before`` and ``after`` as texts, empty where there are none: see :func:`folded` and :func:`siblings`.

    A null group is a group of its own, apart from the empty one. Null order keys come first. Repeated rows are
    leaves of their own, each with its own path. Names of the columns of ``rows`` do not matter. An empty table has no rows here.
    """
    names = [f"_key{i}" for i in range(len(order))]
    own = {f"_own{i}": column for i, column in enumerate(keep.values())}
    slim = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"),
        *(F.col(name).alias(key) for name, key in zip(order, names, strict=True)),
        leaf.alias("_leaf"),
        *(column.alias(name) for name, column in own.items()),
    )
    # Stored, as the ranges are found by a pass of their own; the row number only lets equal rows be parted.
    slim = stored(slim.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    nodes, most = _numbered(slim, [*names, "_leaf", "_row"])
    made = _climbed(nodes.drop("_row", *names).withColumn("_node", F.col("_leaf")), most, fanout, _over_groups(fanout))
    return made.select(
        *(F.col(own_name).alias(name) for own_name, name in zip(own, keep, strict=True)),
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.col("_path").alias("path"),
    )

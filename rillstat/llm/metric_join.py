"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, windows, recursion.

Jaccard distance is a metric, and two documents link if it is at most ``e``. Most documents are at distance 1 from
nearly all others, where no pivot tells them apart, so the space is thinned out first:

1. *Outlying documents.* Of a linked pair's shingles in the order of their hashes, the first
   ``n - ceil(t * n) + c`` of each hold at least c common ones, t being the similarity. A document with fewer
   shingles there that any other one has links with nothing. Only this part of the sets is shuffled for all documents.
2. *First regions.* The others' shingles are counted in full and each set is ordered from rare to frequent. A linked pair's first
   common shingle comes before too little of either set is left. A region holds the documents that
   share a shingle so placed, and has one pivot, the least by hash. Distances to the pivot are exact; those within
   ``e`` are linked. Regions of one component are done: no pair in them can change anything.
3. *Recursion.* A region that holds several components and is too large for a task gets more pivots. A document belongs to the
   Voronoi region of its nearest pivot and, by the triangle inequality, a linked one can be in the region of pivot p only if it is
   at most ``2 * e`` farther from p than from its own; inside that window it is replicated. Each smaller region is joined the
   same way.
4. *Centres.* Where pivots do not divide (all distances alike), the most central pivot is taken off instead: as the symmetric
   difference of two sets is that of their differences from any third set, a member is its difference from the centre from there
   on, one row each, a fraction of its set if the region is dense. Of a region whose differences are still too many for a task,
   members leave whose differences have too little in common with those of all other components together, which is exact.
5. A region small enough is joined in one task by counting common shingles, or common differences, of documents of different
   components. Only what is too large after step 4 goes on as pairs of blocks, whose rows grow with the square of its size.

A pivot has been compared with all of its region and leaves it. No region, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.llm.batches import map_slices
from rillstat.llm.graphs import components
from rillstat.llm.hashing import mixed, shingles, word_hashes
from rillstat.operators.ranking import ranked
from rillstat.sinks.tables import stored

#: A region of at most so many documents with so many shingles together is joined in one task.
REGION_ROWS, REGION_SHINGLES = 512, 1 << 20

#: The same for the differences of a region's documents from its centre; ``REGION_SHINGLES`` bounds their number.
CENTRE_ROWS = 1 << 13

#: Pivots that divide a larger region.
PIVOTS = 8

#: Regions that pivots leave with more copies of their documents than this go on as differences from a centre.
COPIES = 2.0

#: Up to so many classes of texts, 16 bytes each, their numbers are sent to all tasks instead of moving the texts to them.
SENT = 1 << 20

_SPARE = 10


def _nodes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's shingle set; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(values ^ np.uint64(0xD1B54A32D192ED03)), offsets[:-1][full]))
    return out


def _digests(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingles(*word_hashes(batch.column(1)), size)
        arrays = [batch.column(0), pa.array(np.diff(offsets)), pa.array(_nodes(values, offsets).view(np.int64)), batch.column(2)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "node", "print"])

    return work


def _least_common(n, numerator: int, denominator: int):
    """The least number of common shingles of a set of ``n`` and any linked one."""
    return -(-n * numerator // denominator)


def _beginnings(size: int, numerator: int, denominator: int):
    """The first shingles of each set by hash, with the set's node."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingles(*word_hashes(batch.column(0)), size)
        n = np.diff(offsets)
        common = _least_common(n, numerator, denominator)
        take = n - common + np.minimum(common, np.maximum(1, n // _SPARE))
        rows = np.repeat(np.arange(len(n)), take)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take) + offsets[:-1][rows]
        nodes = _nodes(values, offsets)[rows]
        return pa.RecordBatch.from_arrays([pa.array(values[place].view(np.int64)), pa.array(nodes.view(np.int64))], names=["shingle", "node"])

    return work


def _near_others(source: DataFrame, classes: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The classes that have enough shingles in common with others to be linked."""
    first = map_slices(source.select("text"), _beginnings(size, numerator, denominator), "shingle BIGINT, node BIGINT", ["text"])
    alone = first.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    own = alone.filter("node = last").groupBy("node").agg(F.count("*").alias("own"))
    sized = classes.withColumn("common", F.expr(f"(n * {numerator} + {denominator - 1}) div {denominator}"))
    take = F.expr(f"n - common + least(common, greatest(1, n div {_SPARE}))")
    # A partner may be as small as the common part, and its own beginning is shorter then.
    need = F.expr(f"greatest(1, common div {_SPARE})")
    return sized.join(own, "node", "left").filter(take - F.coalesce("own", F.lit(0)) >= need).select("node", "n", "print")


def _sets(source: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """``node, n, s``: the full sets of the classes ``near``, 8 bytes a shingle."""
    prints = near.select("print")
    few = near.count() <= SENT
    texts = source.withColumn("print", F.xxhash64("text")).join(F.broadcast(prints) if few else prints, "print", "left_semi")
    texts = texts.dropDuplicates(["print"]).select("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingles(*word_hashes(batch.column(0)), size)
        sets = pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(_nodes(values, offsets).view(np.int64)), pa.array(np.diff(offsets)), sets], names=["node", "n", "s"]
        )

    return stored(map_slices(texts, work, "node BIGINT, n BIGINT, s BINARY", ["text"]), "sets")


def _tokens(sets: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                n = some.column("n").to_numpy()
                values = np.frombuffer(b"".join(some.column("s").to_pylist()), dtype=np.int64)
                arrays = [pa.array(np.repeat(some.column("node").to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(values)]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "shingle"])

    return sets.mapInArrow(work, "node BIGINT, n BIGINT, shingle BIGINT")


def _first_regions(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``region, node, n, left, pivot``: documents that share a shingle early in the order from rare to frequent.

    ``left`` is the number of a set's shingles from there on.
    """
    total = numerator + denominator
    tokens = _tokens(sets)
    known = tokens.groupBy("shingle").agg(F.count("*").alias("df"), F.min("n").alias("least")).filter("df > 1")
    shared = tokens.join(known, "shingle")
    own = Window.partitionBy("node")
    left = F.count("*").over(own) - F.row_number().over(own.orderBy("df", "shingle")) + 1
    partner = F.greatest("least", F.ceil(F.col("n") * numerator / denominator))
    early = shared.withColumn("left", left).filter(total * F.col("left") >= numerator * (F.col("n") + partner))
    early = stored(early.select(F.col("shingle").alias("region"), "node", "n", "left"), "early")
    pivots = early.groupBy("region").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    return stored(early.join(pivots.drop("last"), "region"), "regions")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, n_a, n_b``: exact sizes of the pairs' intersections."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b").select("a", "b", "s_a", "s_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                sizes[:, i] = np.isin(a, b, assume_unique=True, kind="sort").sum(), len(a), len(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sizes)], names=["a", "b", "common", "n_a", "n_b"])

    return both.mapInArrow(work, "a BIGINT, b BIGINT, common BIGINT, n_a BIGINT, n_b BIGINT")


class _Components:
    """Which component each document that has a link is in; others are alone."""

    def __init__(self, found: DataFrame):
        self.of = found

    def on(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.of, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def joined(self, links: DataFrame) -> _Components:
        """With more links ``a, b``."""
        a = self.on(links.select(F.col("a").alias("node"), "b")).select(F.col("b").alias("node"), F.col("comp").alias("a"), F.col("node").alias("from"))
        ends = stored(self.on(a).select("a", F.col("comp").alias("b"), "from", F.col("node").alias("to")), "links")
        steps = components(ends.filter("a <> b"))
        later = steps.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        old = self.of.join(later, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"))
        return _Components(stored(old.union(steps.join(old, "node", "left_anti")), "components"))


def _unsettled(regions: DataFrame, comps: _Components) -> DataFrame:
    """``region, node, n, comp`` of the regions with several components; regions of equal members once."""
    rows = comps.on(regions)
    seen = rows.groupBy("region").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"),
        F.bit_xor(F.xxhash64("node")).alias("members"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("also"),
    ).filter("low < high")
    once = seen.groupBy("rows", "members", "also").agg(F.min("region").alias("region")).select("region")
    return rows.join(once, "region").select("region", "node", "n", "comp")


def _links(sized: DataFrame, numerator: int, denominator: int) -> DataFrame:
    return sized.filter(F.col("common") * denominator >= numerator * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _divided(regions: DataFrame, sizes: DataFrame, sets: DataFrame, comps: _Components, level: int, numerator: int, denominator: int):
    """The smaller regions of regions too large for a task, those that do not divide with a centre each, and the components
    with the links of their pivots."""
    order = [F.xxhash64("node", F.lit(level)), F.col("node")]
    pivots = ranked(regions, ["region"], order, PIVOTS).select("region", F.col("node").alias("pivot"))
    rest = regions.join(pivots.withColumnRenamed("pivot", "node"), ["region", "node"], "left_anti")
    near = stored(rest.select("region", "node", "n").join(pivots, "region"), "to-pivots")
    between = pivots.join(pivots.withColumnRenamed("pivot", "b"), "region").filter("pivot < b").select(F.col("pivot").alias("a"), "b")
    pairs = near.select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(between).distinct()
    sized = stored(_common(pairs, sets), "sized")
    distance = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    known = sized.select(F.col("a").alias("pivot"), F.col("b").alias("node"), distance.alias("distance"))
    placed = near.join(known, ["pivot", "node"])
    # Doubles err by far less than the slack, which only makes the window a little wider.
    window = 2 * (1 - numerator / denominator) + 1e-9
    home = F.min("distance").over(Window.partitionBy("region", "node"))
    inside = placed.withColumn("home", home).filter(F.col("distance") <= F.col("home") + window)
    voronoi = stored(inside.select("region", "pivot", "node", "n"), "voronoi")
    parts = voronoi.groupBy("region", "pivot").agg(F.count("*").alias("part")).groupBy("region")
    parts = parts.agg(F.sum("part").alias("copies"), F.max("part").alias("most"))
    apart = parts.join(sizes, "region").filter((F.col("copies") <= COPIES * F.col("rows")) & (F.col("most") <= 0.8 * F.col("rows")))
    apart = stored(apart.select("region"), "apart")
    smaller = voronoi.join(apart, "region", "left_semi").select(F.xxhash64("region", "pivot").alias("region"), "node", "n")
    total = placed.groupBy("region", "pivot").agg(F.sum("distance").alias("total"))
    centres = total.groupBy("region").agg(F.min(F.struct("total", "pivot")).alias("best")).select("region", F.col("best.pivot").alias("centre"))
    whole = rest.select("region", "node", "n").join(apart, "region", "left_anti").join(centres, "region")
    return smaller, stored(whole, "whole"), comps.joined(_links(sized, numerator, denominator))


def _differences(whole: DataFrame, sets: DataFrame, comps: _Components) -> DataFrame:
    """``region, node, n, comp, x``: the symmetric difference of each unsettled set from its region's centre."""
    centres = whole.select("region", "centre").distinct()
    centres = centres.join(sets.select(F.col("node").alias("centre"), F.col("s").alias("c")), "centre").select("region", "c")
    rows = stored(_unsettled(whole.select("region", "node", "n"), comps), "unsettled")
    rows = rows.join(sets.select("node", "s"), "node").join(centres, "region").select("region", "node", "n", "comp", "s", "c")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (4, 5))
                apart.append(np.setxor1d(a, b, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(apart, pa.binary())], names=["region", "node", "n", "comp", "x"])

    return stored(rows.mapInArrow(work, "region BIGINT, node BIGINT, n BIGINT, comp BIGINT, x BINARY"), "differences")


def _sizes(rows: DataFrame) -> DataFrame:
    """``region, rows, shingles, fits``: the sizes of regions of differences, and whether a task joins them."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.expr("length(x) div 8")).alias("shingles"))
    return sizes.withColumn("fits", F.expr(f"rows <= 2 OR rows <= {CENTRE_ROWS} AND shingles <= {REGION_SHINGLES}"))


def _linkable(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The rows of regions of differences that may link with another component.

    Sets link if ``2 * total * common >= weight + weight``, ``common`` being the number of common differences. Those of a row
    with all other components together, and the least weight among these, bound that.
    """
    total = numerator + denominator
    rows = rows.withColumn("weight", F.expr(f"{total} * (length(x) div 8) - {denominator - numerator} * n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                x = some.column("x").to_pylist()
                own = some.select(["region", "node", "comp"]).take(pa.array(np.repeat(np.arange(len(x)), [len(v) // 8 for v in x])))
                values = np.frombuffer(b"".join(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(values)], names=["region", "node", "comp", "shingle"])

    tokens = rows.select("region", "node", "comp", "x").mapInArrow(work, "region BIGINT, node BIGINT, comp BIGINT, shingle BIGINT")
    several = tokens.groupBy("region", "shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    shared = tokens.join(several, ["region", "shingle"]).groupBy("region", "node").agg(F.count("*").alias("shared"))
    light = rows.groupBy("region", "comp").agg(F.min("weight").alias("least"))
    first = light.groupBy("region").agg(F.min(F.struct("least", "comp")).alias("first"))
    second = light.join(first, "region").filter("comp <> first.comp").groupBy("region").agg(F.min("least").alias("second"))
    bounded = rows.join(shared, ["region", "node"], "left").join(first, "region").join(second, "region")
    partner = F.when(F.col("comp") == F.col("first.comp"), F.col("second")).otherwise(F.col("first.least"))
    able = bounded.filter(2 * total * F.coalesce("shared", F.lit(0)) >= F.col("weight") + partner)
    return stored(able.select("region", "node", "n", "comp", "x"), "linkable")


def _by_task(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``region, node, n, comp, x`` of regions of differences that a task can join."""
    sizes = stored(_sizes(rows), "sizes")
    ready = rows.join(sizes.filter("fits").select("region"), "region", "left_semi")
    over = sizes.filter("NOT fits").select("region")
    if over.isEmpty():
        return ready
    able = _linkable(rows.join(over, "region", "left_semi"), numerator, denominator)
    blocks = F.greatest(F.ceil(F.col("rows") * 3 / CENTRE_ROWS), F.ceil(F.col("shingles") * 3 / REGION_SHINGLES))
    able = able.join(_sizes(able).withColumn("blocks", F.when(F.col("fits"), F.lit(1)).otherwise(blocks)), "region")
    able = able.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = able.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    region = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    return ready.union(paired.select(region.alias("region"), "node", "n", "comp", "x"))


def _joined_in_task(numerator: int, denominator: int):
    """A spanning forest of the links between components inside one region; ``x`` holds sets or differences from one set."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["x"]]
        n, held = rows["n"].to_numpy(), np.array([len(x) for x in sets])
        ends = np.cumsum(held)
        owner = np.repeat(np.arange(len(sets)), held)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
        comp = rows["comp"].to_numpy().copy()
        main = pd.Series(comp).mode().iloc[0]
        pairs = []
        for i in np.flatnonzero(comp != main).tolist():
            own = token[ends[i] - held[i]:ends[i]]
            counts = starts[own + 1] - starts[own]
            at = np.arange(counts.sum()) + np.repeat(starts[own] - np.cumsum(counts) + counts, counts)
            common = np.bincount(holders[at], minlength=len(sets))
            near = (numerator + denominator) * (held + held[i] - 2 * common) <= (denominator - numerator) * (n + n[i])
            for j in np.flatnonzero(near & (comp != comp[i])).tolist():
                if comp[i] != comp[j]:
                    pairs.append((i, j))
                    comp[comp == comp[i]] = comp[j]
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": [node[i] for i, _ in pairs], "b": [node[j] for _, j in pairs]}, dtype="int64")

    return work


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100
) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of characters other than blank and 0x09 to 0x0D, A-Z in lower case. A row's set holds its distinct
    shingles of ``size`` words; with fewer words the whole sequence is the only one. Documents link if
    ``denominator * common >= numerator * union``; ``component_id`` is the least id reachable by links, the own one included.
    Rows of equal sets are one point of the space. Shingles and sets are told apart by 64-bit hashes.

    A null or empty text, or one of blanks, has no shingles and links with nothing: its component is its own id. Rows with one
    id and different texts are one document with all the links of its texts. A row without an id belongs to the
    component of the documents that it is linked with; without any its component is null. Other columns are
    ignored. An empty table has an empty result.
    """
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    slim = source.withColumn("print", F.xxhash64("text"))
    slim = stored(map_slices(slim, _digests(size), "id BIGINT, n BIGINT, node BIGINT, print BIGINT", ["text"]), "digests")
    classes = slim.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("print").alias("print"))
    near = stored(_near_others(source, classes, size, numerator, denominator), "near")
    sets = _sets(source, near, size)
    first = _first_regions(sets, numerator, denominator)

    members = first.filter("node <> pivot")
    facing = first.filter("node = pivot").select("region", F.col("n").alias("n_pivot"), F.col("left").alias("left_pivot"))
    total = numerator + denominator
    # Beyond this a linked pair shares an earlier shingle, and meets in that one's region.
    possible = total * F.least("left", "left_pivot") >= numerator * (F.col("n") + F.col("n_pivot"))
    pairs = members.join(facing, "region").filter(possible).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(stored(_common(pairs, sets), "sized"), numerator, denominator).union(_same_id(slim))
    comps = _Components(components(links))

    regions, level, ready = members.select("region", "node", "n"), 0, []
    whole = []  # regions that pivots do not divide
    while True:
        level += 1
        open_ = stored(_unsettled(regions, comps), "unsettled")
        sizes = open_.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        large = stored(sizes.filter((F.col("rows") > REGION_ROWS) | (F.col("shingles") > REGION_SHINGLES) & (F.col("rows") > 2)), "large")
        ready.append(open_.join(large.select("region"), "region", "left_anti"))
        if large.isEmpty():
            break
        wide = open_.join(large.select("region"), "region", "left_semi")
        regions, undivided, comps = _divided(wide, large, sets, comps, level, numerator, denominator)
        whole.append(undivided)
    small = reduce(DataFrame.union, (some.select("region", "node", "n") for some in ready))
    small = stored(_unsettled(small, comps), "small")
    small = small.join(sets.select("node", F.col("s").alias("x")), "node").select("region", "node", "n", "comp", "x")
    if whole:
        differences = _differences(reduce(DataFrame.union, whole), sets, comps)
        small = small.union(_by_task(differences, numerator, denominator))
    # Regions have a bounded number of documents, and so has the group that a task gets at a time.
    found = small.groupBy("region").applyInPandas(_joined_in_task(numerator, denominator), "a BIGINT, b BIGINT")
    comps = comps.joined(stored(found, "found"))

    rows = comps.on(slim.filter("n > 0"))
    least = stored(rows.groupBy("comp").agg(F.min("id").alias("component")), "least")
    rows = rows.join(least, "comp").select("id", "n", "component")
    empty = slim.filter("n = 0").join(_first_component(slim, comps, least), "id", "left")
    empty = empty.select("id", "n", F.coalesce("component", "id").alias("component"))
    return rows.union(empty).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _same_id(slim: DataFrame) -> DataFrame:
    """``a, b``: the sets of an id that has unlike ones; of most tables none."""
    owned = slim.filter("n > 0 AND id IS NOT NULL")
    several = owned.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("id", "a")
    return owned.join(several, "id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _first_component(slim: DataFrame, comps: _Components, least: DataFrame) -> DataFrame:
    """``id, component`` of ids that have an empty text and another one."""
    both = slim.filter("n = 0 AND id IS NOT NULL").select("id").distinct()
    owned = slim.filter("n > 0").join(both, "id").select("id", "node").distinct()
    return comps.on(owned).join(least, "comp").groupBy("id").agg(F.min("component").alias("component"))

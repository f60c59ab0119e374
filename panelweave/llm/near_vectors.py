"""Near-duplicate vectors by p-stable hashing of normalised vectors, with exact cosines.

A hash is floor((a . u + b) / width) for a direction a of normal numbers, an offset b and the unit vector u. Some of
them together name a bucket of a table, and there are several tables. How many follows from the number of vectors:
as many hashes as keep unrelated vectors of a bucket to a fixed expectation, as many tables as find a pair at the
threshold with the wanted probability.

Equal vectors are one node. Groups of near copies of any size would fill buckets with pairs, so nodes of crowded
buckets are first gathered in cells: nodes within half the threshold's angle of a common centre, all of which link by
the triangle inequality. From then on a cell is one unit. Of two units that share a bucket the angle between their
centres and their radii mostly say that all or none of their members link; only for the rest members are compared.
Links within and between cells are counted, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.components import connected_components
from panelweave.llm.tables import attach_spread, drop_staged, stage

SEED = 12
#: Width of a hash, in distances of unit vectors at the threshold.
WIDTHS = 6.0
#: Expected number of orthogonal vectors that a vector meets in a bucket.
STRANGERS = 0.05
#: Probability that a pair with a cosine at the threshold shares a bucket; nearer pairs are surer.
WANTED = 0.99
#: Nodes from which a bucket is crowded, nodes that one task compares for cells, and the least nodes of a cell.
CROWDED, CHUNK, CELL = 64, 2048, 8
#: Unit vectors and directions are whole numbers of these bits, so that products are exact in any order.
UNIT_BITS, PLANE_BITS = 20, 10
#: Angles are compared with this margin.
MARGIN = 1e-8


def same_hash(distance: float, width: float) -> float:
    """Probability that one hash of two vectors at a distance is the same (the 2-stable case)."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def table_plan(n: int, cosine: float = 0.9, wanted: float = WANTED) -> tuple[float, int, int]:
    """Width of a hash, hashes of a bucket and tables for ``n`` vectors."""
    near = sqrt(2 - 2 * cosine)
    width = WIDTHS * near
    hashes = max(1, ceil(log(max(n, 1) / STRANGERS) / -log(same_hash(sqrt(2), width))))
    return width, hashes, ceil(log(1 - wanted) / log(1 - same_hash(near, width) ** hashes))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal width as matrices, scaled by powers of two so that squares stay finite."""
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(width))
        yield rows, np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def bucket_keys(nodes: DataFrame, width: float, hashes: int, tables: int) -> DataFrame:
    """(node, vec) -> (key, node), a row per table."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, x in _matrices(batch.column("vec")):
                size = x.shape[1]
                if size not in planes:
                    draw = np.random.default_rng([SEED, size])
                    lines = np.rint(draw.standard_normal((size, tables * hashes)) * 2**PLANE_BITS)
                    offsets = draw.uniform(0, width, tables * hashes)
                    odd = draw.integers(0, 1 << 62, (tables, hashes), dtype=np.int64) * 2 + 1
                    planes[size] = lines, offsets, odd, draw.integers(0, 1 << 62, tables, dtype=np.int64)
                lines, offsets, odd, salt = planes[size]
                for at in range(0, len(rows), 128):
                    unit = np.rint(_units(x[at : at + 128]) * 2**UNIT_BITS)
                    step = np.floor((unit @ lines / 2.0 ** (UNIT_BITS + PLANE_BITS) + offsets) / width).astype(np.int64)
                    key = (step.reshape(len(unit), tables, hashes) * odd).sum(2) + salt
                    key = (key ^ (key >> 29)) * np.int64(-4658895280553007687)
                    yield pa.record_batch([pa.array(key.reshape(-1)), pa.array(np.repeat(node[rows[at : at + 128]], tables))], names=["key", "node"])

    return nodes.select("node", "vec").mapInArrow(keys, "key long, node long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those with a neighbour of the same key; one row is held back between batches."""
    held, before = None, False

    def out(rows: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        like = key[1:] == key[:-1]
        keep = np.append(False, like) | np.append(like, False)
        keep[0] |= before
        yield out(rows.slice(0, len(key) - 1), keep[:-1])
        held, before = rows.slice(len(key) - 1), bool(keep[-1])
    if held is not None and before:
        yield held


def shared_buckets(nodes: DataFrame, cosine: float) -> DataFrame:
    """(key, node) of the buckets with more than one node, written."""
    keys = bucket_keys(nodes, *table_plan(nodes.count(), cosine))
    return stage(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long"), "buckets")


def find_cells(nodes: DataFrame, buckets: DataFrame, cosine: float) -> DataFrame:
    """(node, cell, centre, radius, weight): cells among the nodes of crowded buckets, written.

    A node takes part once, in the fullest bucket it has, so it is in one cell at most. Cells bear the number of one
    of their nodes, whose row has the centre, the largest angle to it and the number of vectors of the cell. Which
    nodes meet in a chunk decides only how many are gathered.
    """
    crowded = buckets.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= CROWDED)
    home = buckets.join(crowded, "key").groupBy("node").agg(F.max(F.struct("size", "key")).alias("home"))
    home = home.select("node", F.col("home.key").alias("key"), F.pmod(F.xxhash64("node"), F.ceil(F.col("home.size") / CHUNK)).cast("int").alias("chunk"))
    half = cos(acos(cosine) / 2 - MARGIN)

    def gather(rows: pa.Table) -> pa.Table:
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        found: dict[str, list] = {"node": [], "cell": [], "centre": [], "radius": [], "weight": []}
        for own, x in _matrices(rows.column("vec").combine_chunks()):
            unit = _units(x)
            alike = unit @ unit.T >= cosine
            degree = alike.sum(1)
            open_ = np.ones(len(own), bool)
            for first in np.argsort(-degree, kind="stable"):
                if not open_[first] or degree[first] < CELL:
                    continue
                centre = unit[open_ & alike[first]].mean(0)
                length = np.sqrt((centre * centre).sum())
                if not length:
                    continue
                centre = centre / length
                near = unit @ centre
                inside = np.flatnonzero(open_ & (near >= half))
                if len(inside) < CELL:
                    continue
                open_[inside] = False
                members = node[own[inside]]
                head = int(members.min())
                for m in members.tolist():
                    found["node"].append(m)
                    found["cell"].append(head)
                    found["centre"].append(centre.tolist() if m == head else None)
                    found["radius"].append(acos(min(1.0, float(near[inside].min()))) + MARGIN if m == head else None)
                    found["weight"].append(int(copies[own[inside]].sum()) if m == head else None)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(found.items(), kinds)})

    kind = "node long, cell long, centre array<double>, radius double, weight long"
    crowd = home.join(nodes.select("node", "vec", "copies"), "node")
    return stage(crowd.groupBy("key", "chunk").applyInArrow(gather, kind), "cells")


def _compared(pairs: DataFrame, cosine: float) -> DataFrame:
    """(a, b, a_vec, b_vec, a_radius, b_radius) -> (a, b, links): whether all members link, none, or null for some.

    Two single vectors have no radius, and their cosine decides.
    """
    full = acos(cosine)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pc.equal(pc.list_value_length(batch.column("a_vec")), pc.list_value_length(batch.column("b_vec")))
            batch = batch.filter(same)
            for rows, x in _matrices(batch.column("a_vec")):
                part = batch.take(pa.array(rows))
                y = next(_matrices(part.column("b_vec")))[1]
                near = np.clip(_cosines(x, y), -1, 1)
                radius = part.column("a_radius").to_numpy(zero_copy_only=False) + part.column("b_radius").to_numpy(zero_copy_only=False)
                angle = np.arccos(near)
                every, none = angle + radius <= full - MARGIN, angle - radius > full + MARGIN
                single = radius == 0
                every, none = np.where(single, near >= cosine, every), np.where(single, near < cosine, none)
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(every, mask=~(every | none))], names=["a", "b", "links"])

    return pairs.select("a", "b", "a_vec", "b_vec", "a_radius", "b_radius").mapInArrow(compare, "a long, b long, links boolean")


def _sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with vectors and radii of (unit, vec, radius) tables for either side."""
    left = left.select(F.col("unit").alias("a"), F.col("vec").alias("a_vec"), F.col("radius").alias("a_radius"))
    right = right.select(F.col("unit").alias("b"), F.col("vec").alias("b_vec"), F.col("radius").alias("b_radius"))
    return pairs.join(left, "a").join(right, "b")


def link_near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Two vectors link where their cosine, in double precision, is at least ``cosine``; each pair at the threshold is
    found with a chance of 0.99, nearer ones with more, and no pair below it is linked. ``n_links`` counts the other
    rows linked directly, equal vectors and repeated rows included, ``component_id`` is the smallest vec_id reachable,
    ``kept`` whether that is the row's own. Vectors that are null, empty or zero, hold a null or a component that is
    not finite, or have no vec_id link with nothing: no links, and a component of their own id (null and not kept
    without one). Vectors of different numbers of components do not link. Equal vectors are told by 64-bit hashes. An
    empty table gives no rows; other columns are not read.
    """
    field = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = field if field in ("float", "double") else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.transform("vec", lambda x: x + F.lit(0).cast(kind))).alias("vec")).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stage(nodes, "nodes")
    buckets = shared_buckets(nodes, cosine)
    cells = find_cells(nodes, buckets, cosine)

    place = cells.select("node", "cell")
    unit = F.coalesce("cell", "node")
    entries = stage(buckets.join(place, "node", "left").select("key", unit.alias("unit")).distinct(), "entries")
    drop_staged(buckets)
    met = entries.select("key", F.col("unit").alias("a")).join(entries.select("key", F.col("unit").alias("b")), "key").where("a < b")
    pairs = met.select("a", "b").distinct()

    single = nodes.join(place, "node", "left_anti")
    heads = cells.where("node = cell")
    units = single.select(F.col("node").alias("unit"), "vec", F.lit(0.0).alias("radius"), F.col("copies").alias("weight"))
    centred = heads.select(F.col("cell").alias("unit"), F.col("centre").cast(f"array<{kind}>").alias("vec"), "radius", "weight")
    # A centre rounded to floats is not quite the one that the radius was measured from.
    centred = centred.withColumn("radius", F.col("radius") + F.lit(1e-6 if kind == "float" else 0.0))
    units = units.unionByName(centred)
    told = stage(_compared(_sides(pairs, units, units), cosine), "told")
    drop_staged(entries)

    # Where only some members may link, those of the one are held against the centre of the other, then member by member.
    members = cells.select("node", F.col("cell").alias("unit")).unionByName(single.select("node", F.col("node").alias("unit")))
    doubt = told.where("links IS NULL")
    b_cell = doubt.join(heads.select(F.col("cell").alias("b")), "b", "left_semi")
    a_cell = doubt.join(heads.select(F.col("cell").alias("b")), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"))
    turned = b_cell.select("a", "b").unionByName(a_cell)
    singles = nodes.select(F.col("node").alias("unit"), "vec", F.lit(0.0).alias("radius"))
    each = turned.join(members.withColumnRenamed("unit", "a"), "a").select(F.col("node").alias("a"), "b")
    some = stage(_compared(_sides(each, singles, centred), cosine), "some")
    last = some.where("links IS NULL").join(members.withColumnRenamed("unit", "b"), "b").select("a", F.col("node").alias("b"))
    exact = stage(_compared(_sides(last, singles, singles), cosine).where("links"), "exact")

    whole = told.where("links").select("a", "b")
    partly = some.where("links").select("a", "b")
    weights = units.select("unit", "weight")
    copies = nodes.select("node", "copies")

    def added(pairs: DataFrame, to: str, other: str, table: DataFrame, name: str) -> DataFrame:
        sized = table.toDF(other, "more")
        return pairs.join(sized, other).select(F.col(to).alias(name), "more")

    unit_more = added(whole, "a", "b", weights, "unit").unionByName(added(whole, "b", "a", weights, "unit")).unionByName(added(partly, "b", "a", copies, "unit"))
    node_more = added(partly, "a", "b", weights, "node").unionByName(added(exact, "a", "b", copies, "node")).unionByName(added(exact, "b", "a", copies, "node"))
    unit_sums = unit_more.groupBy("unit").agg(F.sum("more").alias("unit_more"))
    node_sums = node_more.groupBy("node").agg(F.sum("more").alias("node_more"))

    links = whole.unionByName(partly).unionByName(exact.select("a", "b")).unionByName(cells.where("node <> cell").select(F.col("node").alias("a"), F.col("cell").alias("b")))
    joined = connected_components(links)
    named = nodes.select("node", "copies", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    named = attach_spread(named, stage(smallest, "smallest"), "component")

    cell_sums = heads.select(F.col("cell").alias("unit"), "weight").join(unit_sums, "unit", "left")
    own = cell_sums.select("unit", (F.col("weight") + F.coalesce("unit_more", F.lit(0))).alias("linked"))
    in_cells = place.withColumnRenamed("cell", "unit").join(own, "unit").select("node", "linked")
    counted = named.join(in_cells, "node", "left").join(unit_sums.withColumnRenamed("unit", "node"), "node", "left").join(node_sums, "node", "left")
    linked = F.coalesce(F.col("linked"), F.col("copies") + F.coalesce("unit_more", F.lit(0))) + F.coalesce("node_more", F.lit(0)) - 1
    result = stage(counted.select("node", linked.alias("n_links"), "component_id", F.col("copies").alias("rows")), "result")
    out = attach_spread(rows.select("vec_id", "node"), result, "node")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

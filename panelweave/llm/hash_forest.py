"""Approximate nearest neighbours by a forest of hash prefix trees.

Each tree gives every vector a string of 64 sign bits of random projections and keeps the strings as sorted
arrays, cut at trie nodes into blocks. A query goes down each tree to the strings with the longest prefix in
common with its own, whatever that length is, which gives first neighbours. Then it goes up in all trees at
once, to the level where a neighbour as near as the last of these would share a prefix in some tree with
the wanted probability, and looks at everything below. Vectors for the largest inner product get one
more coordinate that makes their lengths equal, queries a zero there, so that angles order as products do.

Near strings lie in the same few blocks, so rows of one prefix, however many, are dealt over blocks and
queries over groups; equal vectors are one entry with the smallest of its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.tables import stage

TREES, BITS, SEED = 20, 64, 7
#: Levels of the tries that the driver holds: TREES * 2**TRIE counts, whatever the number of vectors.
TRIE = 12
BLOCK_ROWS, GROUP_QUERIES = 4096, 4096
#: Pairs multiplied at once.
PAIRS = 1 << 15
#: Strings that a query looks at in each tree and direction on its way down.
REACH = 32
WANTED = 0.9


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = TREES, wanted: float = WANTED) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the ``k`` largest inner products found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; all other rows are candidates, equal vectors included.
    Ties go to the smaller vec_id. Vectors that are null, zero, hold a null or a component that is not finite, have
    no vec_id, or another number of components than most (the larger number if two are as frequent) take no part.
    Repeated rows count once. With fewer candidates than ``k`` all are returned; an empty table gives no rows.
    Scores are computed in double precision on the original components.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & sound).withColumn("vec", F.transform("vec", lambda x: x + 0.0))
    by_size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = by_size["size"] if by_size else 1
    rows = rows.where(F.size("vec") == width)
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 1.0

    order = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    kinds = first.where("place = 1").select(F.col("vec_id").alias("node"), "vec")
    nodes = stage(kinds, "nodes")
    named = F.xxhash64("vec")
    same = nodes.select("node", F.col("vec").alias("node_vec"))
    members = stage(first.join(same, named == F.xxhash64("node_vec")).where("vec = node_vec").select("node", "vec_id"), "members")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec").distinct()
    asked = stage(asked.join(same, named == F.xxhash64("node_vec")).where("vec = node_vec").select(F.col("vec_id").alias("query_id"), "node"), "asked")
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi")

    found = _search(nodes, queries, width, float(longest), k, trees, wanted)
    near = asked.join(found.withColumnRenamed("node", "of").withColumnRenamed("query", "node"), "node")
    near = near.select("query_id", F.col("of").alias("node"), "score")
    every_one = near.join(members, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _planes(width: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, trees * BITS))


def _codes(x: np.ndarray, extra: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as numbers, a row per vector and a column per tree."""
    bits = (np.column_stack([x, extra]) @ planes >= 0).reshape(len(x), trees, BITS)
    return np.packbits(bits, axis=2).view(">u8").reshape(len(x), trees).astype(np.uint64)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    differ = x ^ y
    high = (differ >> np.uint64(32)).astype(np.float64)
    low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Blocks:
    """Where the sorted arrays are cut: trie nodes with at most BLOCK_ROWS strings, or the deepest ones in parts."""

    def __init__(self, counts: np.ndarray):
        self.first, self.base, self.parts, total = [], [], [], 0
        for tree in counts:
            running = np.concatenate([[0], np.cumsum(tree)])
            cuts, open_ = [], [(0, TRIE)]
            while open_:
                at, height = open_.pop()
                if height and running[at + (1 << height)] - running[at] > BLOCK_ROWS:
                    open_ += [(at + (1 << height - 1), height - 1), (at, height - 1)]
                else:
                    cuts.append((at, -(-int(running[at + (1 << height)] - running[at]) // BLOCK_ROWS) or 1))
            cuts.sort()
            parts = np.array([n for _, n in cuts])
            self.first.append(np.array([a for a, _ in cuts]))
            self.base.append(total + np.cumsum(parts) - parts)
            self.parts.append(parts)
            total += int(parts.sum())
        self.total = total

    def of_rows(self, tree: int, code: np.ndarray, node: np.ndarray) -> np.ndarray:
        leaf = np.searchsorted(self.first[tree], (code >> np.uint64(64 - TRIE)).astype(np.int64), side="right") - 1
        return self.base[tree][leaf] + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.parts[tree][leaf]

    def of_prefix(self, tree: int, code: int, length: int) -> np.ndarray:
        """All blocks with strings that share ``length`` bits with ``code``, or with its whole trie node."""
        top = code >> 64 - TRIE
        free = max(TRIE - length, 0)
        low = top >> free << free
        a = np.searchsorted(self.first[tree], low, side="right") - 1
        b = np.searchsorted(self.first[tree], low + (1 << free) - 1, side="right") - 1
        return np.arange(self.base[tree][a], self.base[tree][b] + self.parts[tree][b])


def _search(nodes: DataFrame, queries: DataFrame, width: int, longest: float, k: int, trees: int, wanted: float) -> DataFrame:
    """(query, node, score): at least the ``k`` best other nodes found for each query node, and itself."""
    planes = _planes(width, trees)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("vec"), width)
                codes = _codes(x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0)), planes, trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), len(x))
                again = pa.array(np.repeat(np.arange(len(x)), trees))
                yield pa.record_batch([pa.array(tree), pa.array(codes.reshape(-1).view(np.int64)), part.column("node").take(again), part.column("vec").take(again)], names=["tree", "code", "node", "vec"])

    forest = nodes.mapInArrow(strings, "tree int, code long, node long, vec array<double>")
    held = forest.groupBy("tree", F.shiftrightunsigned("code", 64 - TRIE).alias("top")).count().collect()  # at most trees * 2**TRIE rows
    counts = np.zeros((trees, 1 << TRIE), np.int64)
    for tree, top, n in held:
        counts[tree, top] = n
    blocks = _Blocks(counts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, code, node = (batch.column(x).to_numpy() for x in ("tree", "code", "node"))
            block = np.zeros(len(tree), np.int64)
            for t in np.unique(tree).tolist():
                own = tree == t
                block[own] = blocks.of_rows(t, code[own].view(np.uint64), node[own])
            yield pa.record_batch([pa.array(block), *(batch.column(x) for x in ("code", "node", "vec"))], names=["block", "code", "node", "vec"])

    arrays = forest.mapInArrow(placed, "block long, code long, node long, vec array<double>")

    def asked(levels: bool):
        """Queries with their strings, once for each block that they go to: their own leaves, or all below their level."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = _matrix(part.column("vec"), width)
                    codes = _codes(x, np.zeros(len(x)), planes, trees)
                    level = part.column("level").to_numpy() if levels else np.full(len(x), BITS)
                    row, block, code = [], [], []
                    for i in range(len(x)):
                        for t in range(trees):
                            to = blocks.of_prefix(t, int(codes[i, t]), int(level[i]))
                            row += [i] * len(to)
                            block += to.tolist()
                            code += [codes[i, t]] * len(to)
                    again = pa.array(np.array(row, np.int64))
                    bound = part.column("bound") if levels else pa.array(np.full(len(x), -np.inf))
                    yield pa.record_batch(
                        [pa.array(np.array(block, np.int64)), pa.array(np.array(code, np.uint64).view(np.int64)), part.column("node").take(again), part.column("vec").take(again), pa.array(level.astype(np.int32)[row]), bound.take(again)],
                        names=["block", "q_code", "query", "q_vec", "level", "bound"],
                    )

        return rows

    schema = "block long, q_code long, query long, q_vec array<double>, level int, bound double"

    def gather(looking: DataFrame, down: bool) -> DataFrame:
        looking = stage(looking, "looking")
        asked_for = looking.groupBy("block").count().where(F.col("count") > GROUP_QUERIES)
        crowd = stage(asked_for.select("block", F.ceil(F.col("count") / GROUP_QUERIES).cast("int").alias("groups")), "crowded")
        groups = F.coalesce("groups", F.lit(1))
        left = arrays.join(crowd, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), groups - 1))).drop("groups")
        right = looking.join(crowd, "block", "left").withColumn("part", F.pmod(F.xxhash64("query"), groups).cast("int")).drop("groups")

        def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
            if not rows.num_rows or not asking.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            code = rows.column("code").to_numpy().view(np.uint64)
            order = np.argsort(code, kind="stable")
            code, node, vec = code[order], rows.column("node").to_numpy()[order], _matrix(rows.column("vec"), width)[order]
            q_code, query = asking.column("q_code").to_numpy().view(np.uint64), asking.column("query").to_numpy()
            q_vec, level, bound = _matrix(asking.column("q_vec"), width), asking.column("level").to_numpy(), asking.column("bound").to_numpy()

            def products(q: np.ndarray, at: np.ndarray) -> np.ndarray:
                """The same additions for a pair wherever it meets."""
                parts = [(q_vec[q[i : i + PAIRS]] * vec[at[i : i + PAIRS]]).sum(1) for i in range(0, len(q), PAIRS)]
                return np.concatenate(parts) if parts else np.zeros(0)

            if down:
                place = np.searchsorted(code, q_code)
                at = place[:, None] + np.arange(-REACH, REACH)
                valid = (at >= 0) & (at < len(code))
                at = np.clip(at, 0, len(code) - 1)
                depth = np.where(valid, _common(code[at], q_code[:, None]), -1)
                best = np.argsort(-depth, axis=1, kind="stable")[:, :REACH]
                q, column = np.repeat(np.arange(len(query)), best.shape[1]), best.reshape(-1)
                keep = valid[q, column]
                q, at = q[keep], at[q, column][keep]
            else:
                qs, ats = [], []
                for a in range(0, len(query), 128):
                    score = q_vec[a : a + 128] @ vec.T
                    low = q_code[a : a + 128]
                    free = np.minimum(BITS - level[a : a + 128], BITS - 1).astype(np.uint64)
                    begin = np.searchsorted(code, low >> free << free)
                    end = np.searchsorted(code, low | (np.uint64(1) << free) - np.uint64(1), side="right")
                    whole = level[a : a + 128] == 0
                    begin, end = np.where(whole, 0, begin), np.where(whole, len(code), end)
                    column = np.arange(len(code))
                    outside = (column < begin[:, None]) | (column >= end[:, None]) | (score < bound[a : a + 128, None] - 1e-9 * longest)
                    score[outside] = -np.inf
                    # All that may be as near as the last wanted one; of ties the smaller numbers stay.
                    least = np.partition(score, -k - 1, axis=1)[:, -k - 1] if len(code) > k else np.full(len(low), -np.inf)
                    q, column = np.nonzero((score >= least[:, None] - 1e-9 * longest) & (score > -np.inf))
                    exact = products(q + a, column)
                    order = np.lexsort((node[column], -exact, q))
                    q, column = q[order], column[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    qs.append(q[place <= k] + a)
                    ats.append(column[place <= k])
                q, at = np.concatenate(qs), np.concatenate(ats)
            score = products(q, at)
            return pa.table({"query": query[q], "node": node[at], "score": score})

        met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "query long, node long, score double")
        return met.groupBy("query", "node").agg(F.max("score").alias("score"))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    first = gather(queries.mapInArrow(asked(False), schema), True)
    first = stage(first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1), "first")
    # The k-th best other node, or nothing if there are not as many.
    others = first.where("query <> node").groupBy("query").agg(F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), False), k)).alias("bound"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("bound") / (length * longest**0.5)))
    share = 1 - F.acos(cosine) / np.pi
    needed = float(np.log(1 - (1 - wanted) ** (1 / trees)))
    level = F.when(F.col("bound").isNull() | (share <= 0), 0).when(share >= 1, BITS).otherwise(F.least(F.lit(BITS), F.floor(F.lit(needed) / F.log(share)))).cast("int")
    climbing = queries.join(others, queries["node"] == others["query"], "left").select("node", "vec", level.alias("level"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    more = gather(climbing.mapInArrow(asked(True), schema), False)
    both = first.select("query", "node", "score").unionByName(more).groupBy("query", "node").agg(F.max("score").alias("score"))
    return both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")

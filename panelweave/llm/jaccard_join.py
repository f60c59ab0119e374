"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one global order: rare ones first, by a table of the most repeated shingles, then by hash.
Two sets with overlap of at least T share at least m shingles among their first n - T + m ones, for any
m up to T. Each document picks its own m: where its prefix holds frequent shingles, a longer prefix that
asks for more common shingles meets fewer candidates. A pair is judged by the smaller m of the two.
The choice changes the work, never the result, since every surviving pair is verified on whole sets.

Joins that carry texts or sets are merge joins at every size, so that their cost in a small run tells that of a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.components import connected_components
from panelweave.llm.tables import attach_spread, drop_staged, packed_texts, stage, unpacked
from panelweave.llm.words import shingle_sets, slices

#: Shingles whose frequency the order knows. The table is broadcast, so its size is fixed: 16 bytes each.
FREQUENT = 100_000
#: Hashes that a task counts at once; repeats inside such a window are reported.
WINDOW = 1 << 20
LONGEST_MATCH = 6
#: Least and most bits of a set's bitmap, which otherwise has two to four for each shingle.
LEAST_BITS, MOST_BITS = 128, 1 << 16
#: Bits of the filter of documents whose texts are wanted.
FILTER_BITS = 1 << 23
#: Cost of verifying a pair, in entries of the index read.
VERIFY_COST = 32


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> one row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z). Sets with 100 * |intersection| >= percent * |union| are linked;
    component_id is the smallest doc_id reachable by links. Documents with equal sets are one node, so a
    group of copies of any size costs one row. Null and empty texts have no shingles and stand alone;
    a text of fewer than ``k`` words has one shingle; repeated rows give repeated results; a null doc_id
    never names a component unless nothing else is in it. Other columns are ignored. Sets hold 64-bit
    hashes; verification compares 48 bits of them.
    """
    nodes, named = _labelled(docs, k, percent)
    joined = attach_spread(nodes, named.select("node", "component_id", "rows"), "node")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, version) of the document that stays of each group linked as in ``similarity_components``.

    ``version`` is the text's 64-bit hash: rows with one doc_id or none and different texts are documents of their own.
    The smallest doc_id stays (one with an id rather than one without), then the smallest version. Documents without
    shingles all stay. Each pair is one row.
    """
    nodes, named = _labelled(docs, k, percent)
    joined = attach_spread(nodes, named.select("node", "component", "rows"), "node")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("first")
    kept = joined.where("n_shingles > 0").groupBy("component").agg(least).select("first.doc_id", "first.version")
    return kept.unionByName(joined.where("n_shingles = 0").select("doc_id", "version").distinct())


def _labelled(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, version, node, n_shingles), no node without shingles; each node's (node, component, component_id, rows). Written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = _prefixes(docs, k, percent)
    nodes = stage(every.select("doc_id", "version", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), "n_shingles"), "nodes")
    classes = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    postings = _repeated_postings(every)
    maps = stage(every.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")), "bitmaps")
    drop_staged(every)
    pairs = _possible(_pivot_pairs(postings, percent), maps, percent)
    sets = _sets(docs, classes, pairs, k)
    links = _verified(pairs, sets, percent)
    drop_staged(pairs)
    first = connected_components(links)
    pairs = _possible(_pairs_across(postings, first, percent), maps, percent)
    drop_staged(postings, maps)
    more = _sets(docs, classes, pairs, k, sets)
    rest = _verified(pairs, sets.unionByName(more), percent)
    drop_staged(pairs, sets, more)
    found = connected_components(links.unionByName(rest)) if not rest.isEmpty() else first
    label = (
        classes.join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .groupBy("component")
        .agg(F.min("doc_id").alias("component_id"))
    )
    named = classes.join(found, "node", "left").select("node", "rows", F.coalesce("component", "node").alias("component")).join(label, "component")
    return nodes, stage(named.select("node", "component", "component_id", "rows"), "named")


def _set_hash(hashes: np.ndarray) -> int:
    """64-bit name of a set of mixed hashes."""
    with np.errstate(over="ignore"):
        spread = hashes * np.uint64(0xD6E8FEB86659FD93)
        spread = (spread ^ (spread >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        value = spread.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(hashes) * np.uint64(0x9FB21C651E98DF25)) ^ np.uint64(len(hashes))
    return int(value.view(np.int64))


def _bitmap(hashes: np.ndarray) -> bytes:
    """Bits that an odd number of the set's shingles fall on. Halves of a bitmap, xored, are the bitmap of half the bits."""
    bits = LEAST_BITS
    while bits < min(2 * len(hashes), MOST_BITS):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the larger folded: at most the shingles that are in one of the sets only."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs whose bitmaps do not rule out that they are similar; ``pairs`` is dropped. Written.

    Sets that are similar enough differ in at most (n_a + n_b) * (100 - percent) / (100 + percent) shingles, and their
    bitmaps in no more bits. A bitmap is a small part of its set, so strangers never have their sets moved.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
            maps = zip(batch.column("map_a"), batch.column("map_b"), strict=True)
            keep = [(100 + percent) * _differing(x.as_py(), y.as_py()) <= (100 - percent) * (m + n) for (m, n), (x, y) in zip(sizes, maps, strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = maps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("map_a"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("map_b"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "n_a", "n_b", "map_a", "map_b")
    kept = stage(both.mapInArrow(compare, "a long, b long"), "possible")
    drop_staged(pairs)
    return kept


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles and their counts, over all documents, up to one miss per window of a task."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= 3
            return pa.record_batch([pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                held += sets
                size += sum(map(len, sets))
                if size >= WINDOW:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(repeats, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def _match_count(extra: np.ndarray, free: int, n: int) -> int:
    """Shared shingles to ask for: the least of index entries read plus pairs verified.

    ``extra``: how many other documents are expected behind each shingle of the longest prefix; ``free``: n - T.
    Shingles of about the same frequency mostly come from the same passage or group of copies, hence from the same documents.
    So those documents are candidates if the prefix has at least m of these shingles; strays are not.
    """
    if not extra.any():
        return 1
    best, cheapest = 1, None
    level = np.where(extra > 0, np.log2(np.maximum(extra, 1)) * 4, -1).astype(np.int64)
    for m in range(1, min(LONGEST_MATCH, n - free) + 1):
        own = extra[: free + m]
        _, first, size = np.unique(level[: free + m], return_index=True, return_counts=True)
        candidates = float(own[first][size >= m].sum())
        cost = float(own.sum()) + (free + m) + VERIFY_COST * candidates
        if cheapest is None or cost < cheapest:
            best, cheapest = m, cost
    return best


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, version, node, n_shingles, matches, prefix, bitmap): each row's set by name, its prefix and its bitmap. Written."""
    tokens, counts = _frequent(docs, k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, sizes, matches, prefixes, maps = [], [], [], [], []
                for hashes in shingle_sets(part.column("text"), k):
                    n = len(hashes)
                    sizes.append(n)
                    names.append(_set_hash(hashes))
                    maps.append(_bitmap(hashes))
                    if not n:
                        matches.append(0)
                        prefixes.append(b"")
                        continue
                    free = n + (-percent * n) // 100  # n - ceil(percent * n / 100)
                    extra = np.zeros(n, np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                        known = tokens[at] == hashes
                        extra[known] = counts[at[known]]
                    order = np.argsort(extra, kind="stable")[: free + LONGEST_MATCH]
                    m = _match_count(np.maximum(extra[order] - 1, 0), free, n)
                    matches.append(m)
                    prefixes.append(hashes[order[: free + m]].tobytes())
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("version"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(maps, pa.binary())],
                    names=["doc_id", "version", "node", "n_shingles", "matches", "prefix", "bitmap"],
                )

    schema = "doc_id long, version long, node long, n_shingles long, matches int, prefix binary, bitmap binary"
    return stage(docs.withColumn("version", F.xxhash64("text")).mapInArrow(rows, schema), "prefixes")


def _repeated_postings(every: DataFrame) -> DataFrame:
    """(token, node, n, matches, place): the prefix entries whose token stands in prefixes of different sets.

    ``place`` counts the tokens before it in the node's order. Written.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            size = np.array([len(x) for x in prefixes], np.int64)
            if not size.sum():
                continue
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            repeat = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), size))
            yield pa.record_batch(
                [pa.array(np.concatenate(prefixes)), repeat("node"), repeat("n_shingles"), repeat("matches"), pa.array(place.astype(np.int32))],
                names=["token", "node", "n", "matches", "place"],
            )

    table = every.where("n_shingles > 0").select("node", "n_shingles", "matches", "prefix").mapInArrow(entries, "token long, node long, n long, matches int, place int")
    spread = table.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y"))
    shared = stage(spread.where("x <> y").select("token"), "tokens")
    kept = stage(table.join(shared.hint("merge"), "token", "left_semi").distinct(), "postings")
    drop_staged(shared)
    return kept


def _wanted_bits(ids: DataFrame) -> np.ndarray:
    """Which hashes modulo FILTER_BITS the ids have; of fixed size, so it tells less and less of very many ids."""
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 32 AS INT)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """(node, hashes): whole sets of the nodes in ``pairs``, as 48-bit numbers, but for those in ``known``, each once. Written.

    Texts are chosen by doc_id. Most others are left out before the exchange, by a filter of fixed size. A doc_id may have
    several texts: what is not the set of a wanted node goes.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.join(known.select("node"), "node", "left_anti") if known is not None else wanted
    wanted = stage(classes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("id")), "wanted")
    ids = wanted.select("id").distinct()
    bits = _wanted_bits(ids)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            yield batch.filter(pa.array(bits[bit // 32] >> (bit % 32).astype(np.uint32) & 1 == 1)).select(["doc_id", "text"])

    hashed = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    texts = packed_texts(hashed.mapInArrow(asked, "doc_id long, text string"))
    chosen = texts.join(ids.hint("merge"), texts.doc_id.eqNullSafe(ids.id), "left_semi").select("packed")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in unpacked(batches):
            sets = shingle_sets(text, k)
            short = [x.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for x in sets]
            yield pa.record_batch([pa.array([_set_hash(x) for x in sets], pa.int64()), pa.array(short, pa.binary())], names=["node", "hashes"])

    found = chosen.mapInArrow(rows, "node long, hashes binary").join(wanted.select("node").hint("merge"), "node", "left_semi")
    sets = stage(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    drop_staged(wanted)
    return sets


def _near(percent: int) -> Column:
    """Whether a shared token counts for a pair of postings (..._a, ..._b).

    A similar pair shares at least ``least`` tokens. Before the k-th shared one stand k - 1, so it leaves least - k + 1
    tokens of each set from its place on. The first m shared tokens therefore all pass.
    """
    least = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    m = F.least("matches_a", "matches_b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (F.col("place_a") <= F.col("n_a") - least + m - 1) & (F.col("place_b") <= F.col("n_b") - least + m - 1)


def _matched(pairs: DataFrame) -> DataFrame:
    """Pairs of postings that count -> (a, b), a < b, with as many shared tokens as the smaller of their numbers of matches.

    Which side of a pair is a may differ from token to token, so sides are ordered before tokens are counted.
    """
    m = F.least("matches_a", "matches_b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.first(m).alias("m")).where("shared >= m").select("a", "b")


def _side(postings: DataFrame, name: str, *more: str) -> DataFrame:
    return postings.select("token", F.col("node").alias(name), *[F.col(x).alias(f"{x}_{name}") for x in ("n", "matches", "place", *more)])


def _pivot_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each node with one node of each of its tokens: linear in the postings, however many share a token.

    A token's pivot is the node whose prefix is shared most, in a group of near copies the least edited one. Written.
    """
    counted = stage(postings.join(postings.groupBy("node").agg(F.count("*").alias("known")), "node"), "counted")
    best = F.max(F.struct((F.col("known") * 1000 / F.col("n")).cast("int").alias("known"), "node", "n", "matches", "place")).alias("p")
    pivot = stage(counted.groupBy("token").agg(best).select("token", "p.*"), "pivots")
    drop_staged(counted)
    pairs = stage(_matched(_side(postings, "a").join(_side(pivot, "b").hint("merge"), "token").where((F.col("a") != F.col("b")) & _near(percent))), "pairs")
    drop_staged(pivot)
    return pairs


def _pairs_across(postings: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes in different components that share tokens.

    Tokens inside one component are done. Elsewhere the rows of a token's largest component meet only the other
    rows, never each other, so a large group of copies beside some strangers costs its size times their number. Written.
    """
    labelled = postings.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_tokens = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    opened = stage(labelled.join(open_tokens.hint("merge"), "token", "left_semi"), "open")
    sizes = opened.groupBy("token", "component").count()
    major = sizes.groupBy("token").agg(F.max(F.struct("count", "component"))["component"].alias("major"))
    rows = stage(opened.join(major.hint("merge"), "token").withColumn("minor", F.col("component") != F.col("major")), "open")
    drop_staged(opened)
    left = _side(rows.where("minor"), "a", "component")
    right = _side(rows, "b", "component", "minor")
    apart = (F.col("component_a") != F.col("component_b")) & (~F.col("minor_b") | (F.col("a") < F.col("b")))
    pairs = stage(_matched(left.join(right.hint("merge"), "token").where(apart & _near(percent))), "pairs")
    drop_staged(rows)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose whole sets are similar enough. Written."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(x: bytes) -> np.ndarray:
            out = np.zeros((len(x) // 6, 8), np.uint8)
            out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
            return out.reshape(-1).view(np.uint64)

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                x, y = numbers(x.as_py()), numbers(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "hashes_a", "hashes_b")
    return stage(both.mapInArrow(compare, "a long, b long").distinct(), "verified")

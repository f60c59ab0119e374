"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's length.
Sketches of two documents therefore hold the same part of what both share: intersections, unions and
containment can be estimated between texts of very unequal length, and the sketch of a merged document is
the union of the sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.tables import packed_texts, unpacked
from panelweave.llm.words import shingle_sets

#: One hash in so many is kept.
SCALE = 8
#: Rows of one ordered range of documents; the driver keeps two numbers for each range, of MOST_RANGES at most.
RANGE_ROWS, MOST_RANGES = 8192, 20_000


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The part of a sorted set of hashes below the threshold, and always its smallest."""
    return hashes[: max(int(np.searchsorted(hashes, np.uint64(2**64 // scale))), 1)]


def merged(x: np.ndarray, y: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents together."""
    return sketch(np.union1d(x, y), scale)


def containment(x: np.ndarray, y: np.ndarray, scale: int = SCALE) -> float:
    """Estimated part of the first document's shingles that the second one has."""
    return _share(x, y, scale, lambda both, a, b: both / a)


def likeness(x: np.ndarray, y: np.ndarray, scale: int = SCALE) -> float:
    """Estimated Jaccard similarity. Where no hash of one lies below the threshold, only their smallest are compared."""
    return _share(x, y, scale, lambda both, a, b: both / (a + b - both))


def _share(x: np.ndarray, y: np.ndarray, scale: int, ratio) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    limit = np.uint64(2**64 // scale)
    if x[0] >= limit or y[0] >= limit:
        return float(x[0] == y[0])
    return ratio(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def written(x: np.ndarray) -> str:
    return base64.b64encode(x.astype(">u8").tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, fingerprint, one row per row; words are lower-cased, null is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in unpacked(batches):
            marks = [written(sketch(x, scale)) for x in shingle_sets(text, k)]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(x) for x in text.to_pylist()], pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return packed_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, n_chars long, fingerprint string")


def edited_fingerprints(docs: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like it the edited and the next text are.

    The edited text has the last third of its characters replaced by as many from the head of the next document, in
    descending doc_id, null last; after the last comes the first. Rows of one doc_id follow in the order of their
    text's hash. Null and empty texts have empty fingerprints, of likeness 1 to each other and 0 to others;
    a single document follows itself. Documents are dealt into ranges of doc_id, each with the row that
    follows its last one, so no task sees the whole order.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text")
    rows = keyed.count()
    parts = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    cuts = keyed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * MOST_RANGES).alias("cuts")).first()["cuts"]
    edges = np.unique(np.array(cuts if parts > 1 and cuts else [], np.int64))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            place = np.searchsorted(edges, key, side="right")
            most = np.full(len(edges) + 1, -(2**63))
            np.maximum.at(most, place, key)
            seen = np.unique(place)
            yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(most[seen])], names=["place", "key"])

    highest = {r["place"]: r["key"] for r in keyed.select("key").mapInArrow(tops, "place int, key long").groupBy("place").agg(F.max("key").alias("key")).collect()}
    filled = sorted(highest)
    # The range below a range gives the row that follows; below the lowest comes the highest one.
    above = {highest[b]: a for a, b in zip(filled, [filled[-1], *filled[:-1]], strict=True)} if filled else {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(sorted(above), np.int64)
        to = np.array([above[x] for x in first.tolist()], np.int32)
        for batch in batches:
            key = batch.column("key").to_numpy()
            place = np.searchsorted(edges, key, side="right").astype(np.int32)
            twice = np.flatnonzero(np.isin(key, first))
            order = np.concatenate([np.arange(len(key)), twice])
            both = batch.take(pa.array(order))
            also = np.arange(len(order)) >= len(key)
            place = np.concatenate([place, to[np.searchsorted(first, key[twice])]])
            yield pa.record_batch([pa.array(place), pa.array(also), *both.columns], names=["place", "after", *both.schema.names])

    packed = packed_texts(keyed).mapInArrow(deal, "place int, after boolean, key long, doc_id long, version int, packed binary")
    dealt = packed.repartitionById(len(edges) + 1, F.col("place")).sortWithinPartitions("place", "after", F.desc("key"), "version")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one after it
        for part, text in unpacked(batches):
            places, after, ids = (part.column(x).to_pylist() for x in ("place", "after", "doc_id"))
            rows = list(zip(places, after, ids, text.to_pylist(), strict=True))
            rows = [held, *rows] if held else rows
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            held = rows[-1]
            if pairs:
                yield digest(pairs)

    def digest(pairs: list[tuple]) -> pa.RecordBatch:
        edited = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in pairs]
        plain, changed, after = ([sketch(x, scale) for x in shingle_sets(pa.array(texts, pa.string()), k)] for texts in ([a[3] for a, _ in pairs], edited, [b[3] for _, b in pairs]))
        return pa.record_batch(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([written(x) for x in plain]),
                pa.array([written(x) for x in changed]),
                pa.array([likeness(x, y, scale) for x, y in zip(plain, changed, strict=True)], pa.float64()),
                pa.array([likeness(x, y, scale) for x, y in zip(plain, after, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return dealt.select("place", "after", "doc_id", "packed").mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

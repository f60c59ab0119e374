"""Substring dedup by seed and extend: winnowed anchors find repeats, extension gives their exact bounds.

Winnowing marks the smallest of every ``span - k + 1`` consecutive k-grams, so each window of ``span`` words
belongs to exactly one anchor inside it and equal windows have equal anchors at equal places. An anchor with
the windows it owns is a run. Anchors that occur once cannot lie in a repeat. For the others:

* a run whose whole content occurs again is a repeat as it stands (copies of any number are one key);
* runs around the same anchor with different content are extended word by word to both sides by comparing
  the windows they own, one run standing for all equal ones.

Repeats of one document are then joined into maximal ones. Everything is grouped by content and nothing is
paired, so a passage that a third of all documents share costs its occurrences, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.tables import drop_staged, packed_texts, stage, unpacked
from panelweave.llm.words import Spans, Words, gram_hashes, slices


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 8) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept (the remaining words joined by one blank), one row per row.

    A word goes if a window of ``span`` consecutive words around it starts at any other place, in the same
    document or another, judged on the input. Every copy goes, the first included. Null and empty texts
    have no words; texts shorter than ``span`` words stay; overlapping repeats count as repeats; repeated rows
    are documents of their own; a null doc_id is a document like any other. Other columns are ignored.
    Words are compared by 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    repeats = _repeats(texts, span, k)
    ranges = repeats.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    ranges = ranges.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"))
    packed = packed_texts(texts)
    both = packed.join(ranges, packed.doc_id.eqNullSafe(ranges.id) & (packed.version == ranges.v), "left")
    return both.select("doc_id", "packed", "starts", "ends").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def kept_digest(docs: DataFrame, span: int, k: int = 8) -> DataFrame:
    """The digest of ``remove_repeats``: the SHA-256 of the kept words instead of the words."""
    out = remove_repeats(docs, span, k)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def _anchors(hashes: np.ndarray, doc: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: first window, number of windows, anchor's k-gram hash, document."""
    n = len(hashes) - span + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty
    grams = gram_hashes(hashes, k)
    width = span - k + 1
    least, size = np.arange(len(grams)), 1

    def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(grams[y] < grams[x], y, x)  # the left one of equals

    while size * 2 <= width:
        least = better(least[: len(least) - size], least[size:])
        size *= 2
    least = better(least[:n], least[width - size : width - size + n])
    start = np.flatnonzero(doc[:n] == doc[span - 1 :])
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(new)
    return start[at], np.diff(np.append(at, len(start))), grams[anchor[at]], doc[start[at]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _repeats(texts: DataFrame, span: int, k: int) -> DataFrame:
    """(doc_id, version, start, end): word ranges that are repeats, ends excluded."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                hashes = words.hashes()
                start, size, gram, doc = _anchors(hashes, words.doc, span, k)
                content = Spans(hashes).hashes(start, size + span - 1)
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(doc)), part.column("version").take(pa.array(doc)), _signed(gram), _signed(content), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["doc_id", "version", "gram", "content", "start", "size"],
                )

    schema = "doc_id long, version long, gram long, content long, start int, size int"
    every = stage(texts.mapInArrow(runs, schema), "runs")
    seeds = stage(every.groupBy("gram").count().where("count > 1").select("gram"), "seeds")
    seeded = stage(every.join(seeds, "gram", "left_semi"), "seeded")
    drop_staged(every, seeds)
    one = F.min(F.struct("doc_id", "version", "start", "size")).alias("one")
    kinds = stage(seeded.groupBy("gram", "content").agg(F.count("*").alias("times"), one), "kinds")
    again = stage(kinds.where("times > 1").select("gram", "content"), "again")
    whole = seeded.join(again, ["gram", "content"], "left_semi").select("doc_id", "version", "start", (F.col("start") + F.col("size") + (span - 1)).alias("end"))

    several = stage(kinds.groupBy("gram").count().where("count > 1").select("gram"), "several")
    unlike = kinds.join(several, "gram", "left_semi").select("one.*", "gram", "times")
    windows = stage(_windows(texts, unlike, span), "windows")
    common = stage(windows.groupBy("window").count().where("count > 1").select("window"), "common")
    part = windows.where("times = 1").join(common, "window", "left_semi").select("doc_id", "version", "start", (F.col("start") + span).alias("end"))
    return whole.unionByName(part)


def _windows(texts: DataFrame, runs: DataFrame, span: int) -> DataFrame:
    """(window, doc_id, version, start, times): the windows of ``runs``, named by their content."""
    of = runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "size", "gram", "times")).alias("runs"))
    of = of.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), *[F.col(f"runs.{x}").alias(x) for x in ("start", "size", "gram", "times")])
    packed = packed_texts(texts).dropDuplicates(["doc_id", "version"])
    both = packed.join(of, packed.doc_id.eqNullSafe(of.id) & (packed.version == of.v))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in unpacked(batches):
            words = Words(text)
            spans = Spans(words.hashes())
            number = pc.list_value_length(part.column("start")).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), number)
            start, size, gram, times = (part.column(x).flatten().to_numpy() for x in ("start", "size", "gram", "times"))
            size = size.astype(np.int64)
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(start.astype(np.int64), size) + within
            doc = np.repeat(doc, size)
            name = spans.hashes(at + words.first[doc], np.full(len(at), span)) ^ np.repeat(gram, size).view(np.uint64)
            yield pa.record_batch(
                [_signed(name), part.column("doc_id").take(pa.array(doc)), part.column("version").take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(np.repeat(times, size))],
                names=["window", "doc_id", "version", "start", "times"],
            )

    return both.select("doc_id", "version", "packed", "start", "size", "gram", "times").mapInArrow(extend, "window long, doc_id long, version long, start int, times long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text in unpacked(batches):
        words = Words(text)
        raw = words.raw.tobytes()
        removed, kept = [], []
        for row, (starts, ends) in enumerate(zip(part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True)):
            first, n = int(words.first[row]), int(words.count[row])
            stay = np.ones(n, bool)
            if starts:
                change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
                stay = np.cumsum(change)[:n] == 0
            at = np.flatnonzero(stay) + first
            removed.append(n - len(at))
            kept.append(b" ".join([raw[i:j] for i, j in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]))
        yield pa.record_batch(
            [part.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

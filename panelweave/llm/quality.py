"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Each feature of a text has one lookup table over quantile bins, each chosen pair of features one table
over a grid. Shallow trees on one feature (or one pair) at a time, fitted in turn to the gradient of the
logistic loss and added with a small rate, build the tables; a score is the sum of one entry per table.
The fit runs on a bounded sample of labelled rows, scoring on every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.words import Words, gram_hashes, slices

#: Labelled rows that the model is fitted on at most, the first by a hash of their doc_id.
SAMPLE = 20_000
BINS, GRID, PAIRS = 48, 16, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_HESSIAN, RIDGE = 120, 40, 0.12, 4.0, 1.0

NAMES = ["bytes", "words", "word_length", "word_spread", "upper", "digit", "stop", "mark", "other_ascii", "beyond_ascii", "line_length", "short_lines", "distinct_words", "top_word", "distinct_triples", "capitalised"]


def _byte_groups() -> np.ndarray:
    group = np.full(256, 4, np.uint8)
    group[128:] = 5
    group[65:91] = 0
    group[48:58] = 1
    group[[ord(c) for c in ".,;:?'\"-()"]] = 2
    group[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 3
    group[97:123] = group[[9, 10, 11, 12, 13, 32]] = 6
    return group


def features(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; null and empty texts have zeros."""
    words = Words(column)
    size = np.diff(words.rows)
    n, docs = words.count, len(size)
    some, total = np.maximum(size, 1), np.maximum(n, 1)
    out = np.zeros((docs, len(NAMES)))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n)

    def by_doc(value: np.ndarray, first: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        return running[first[1:]] - running[first[:-1]]

    length = (words.end - words.start).astype(np.float64)
    out[:, 2] = by_doc(length, words.first) / total
    out[:, 3] = np.sqrt(np.maximum(by_doc(length**2, words.first) / total - out[:, 2] ** 2, 0))
    group = _byte_groups()[words.raw]
    for j in range(6):
        out[:, 4 + j] = by_doc(group == j, words.rows) / some
    breaks = np.flatnonzero(words.raw == 10)
    line_doc = np.searchsorted(words.rows, breaks, side="right") - 1
    begin = np.concatenate([words.rows[:-1], breaks + 1])
    owner = np.concatenate([np.arange(docs), line_doc])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    stop = np.append(begin[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = words.rows[owner[last] + 1]
    lines = np.bincount(owner, minlength=docs)
    out[:, 10] = np.log1p(size / lines)
    out[:, 11] = np.bincount(owner, (stop - begin) < 30, minlength=docs) / lines * (size > 0)
    hashes = words.hashes()

    def distinct(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (names >> np.uint64(20)))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        of = (key[at] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(docs)
        np.maximum.at(most, of, np.diff(np.append(at, len(key))))
        return np.bincount(of, minlength=docs), most

    kinds, most = distinct(hashes, words.doc)
    out[:, 12], out[:, 13] = kinds / total, most / total
    triples = gram_hashes(hashes, 3)
    whole = words.doc[: len(triples)] == words.doc[2:] if len(triples) else np.zeros(0, bool)
    kinds, _ = distinct(triples[whole], words.doc[: len(triples)][whole])
    out[:, 14] = kinds / np.maximum(n - 2, 1)
    lead = words.raw[words.start]
    out[:, 15] = by_doc((lead >= 65) & (lead <= 90), words.first) / total
    return out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    grid_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: additions of table entries by bin."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.grid_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of the best tree of three leaves, grown leaf by leaf."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (0.0, None, None)
        for leaf in leaves:
            a, b = leaf
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_HESSIAN) | (all_h - left_h < LEAST_HESSIAN)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), leaf, a + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four quarters."""
    def parts(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        upper = c[:-1, :-1]
        return [upper, c[:-1, -1:] - upper, c[-1:, :-1] - upper, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + upper]

    gs, hs = parts(g), parts(h)
    gain = sum(x**2 / (y + RIDGE) for x, y in zip(gs, hs, strict=True)) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where(np.minimum.reduce(hs) < LEAST_HESSIAN, 0, gain)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    if gain[a, b] > 0:
        v = [_step(x[a, b], y[a, b]) for x, y in zip(gs, hs, strict=True)]
        out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return float(gain[a, b]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting. Without rows of both labels the model is a constant."""
    count, width = len(x), x.shape[1]
    rate = (y.sum() + 0.5) / (count + 1)
    base = float(np.log(rate / (1 - rate)))

    def cuts(bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if count else np.zeros(0) for j in range(width)]

    edges, grid_edges = cuts(BINS), cuts(GRID)
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(base, edges, tables, grid_edges, [], [])
    if not 0 < y.sum() < count:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    score = np.full(count, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            n = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            tables[j] += step
            score += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(grid_edges)]
    shape = [len(e) + 1 for e in grid_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    gains = [(_quarters(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(width) for j in range(i) if min(shape[i], shape[j]) > 1]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.grids = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            table += step
            score += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the third that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fits on at most ``sample`` labelled documents outside the held-out third, the first by a hash of doc_id.

    Labels other than 0 and 1, null ids and labels of documents that do not exist are ignored. However often a
    doc_id or a label is repeated, each (doc_id, quality) is one example, with the smallest features of its texts; an id
    with both labels is two. Null and empty texts have the features of a text without words. Without any example the
    model scores 0.5.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct().join(ids, "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` pairs of numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    seen = texts.mapInArrow(rows, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    got = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").toPandas()  # at most ``sample`` rows
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    return fit(x, got["quality"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, *more: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns ``more``, one row per row of ``docs``.

    Scores lie in [0, 1]; null and empty texts get the score of a text without words, repeated rows equal ones.
    A null doc_id counts as not held out. Nothing but the text enters a score.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", *more)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(part.column("text")))
                predicted = pa.array((score >= 0.5).astype(np.int32))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(score), predicted, *(part.column(x) for x in more)], names=["doc_id", "held_out", "score", "predicted", *more])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in more)
    return own.mapInArrow(rows, f"doc_id long, held_out boolean, score double, predicted int{kinds}")


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores 0.5 or more.

    Rows are judged one by one: repeated rows stay or go together, a null or empty text is judged as one without words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)

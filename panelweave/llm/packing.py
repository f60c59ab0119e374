"""Packing by minimum bin slack.

A document's tokens are cut at every ``window`` tokens from its start; what remains is shorter than a window.
Only the number of pieces of each length matters for filling windows, and that is a table of at most
``window`` rows. On it, minimum bin slack picks for each next window the longest open length and the multiset of
others that comes closest to the capacity, by subset sums over bitsets, and repeats the same pattern while
the counts last. So the plan has as many patterns as lengths, about, whatever the number of documents.
Pieces of one length are interchangeable: each takes its place in the plan by its number within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.bpe import piece_encoder
from panelweave.llm.numbering import numbered
from panelweave.llm.tables import stage
from panelweave.llm.words import slices


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity`` that holds the longest open length.

    Bit s of a state tells that the sum s can be reached with the lengths so far. A length with n pieces enters
    in doubling lots (1, 2, 4, ...); going back through the states gives how many pieces of each were used.
    Longer lengths enter first; as soon as the capacity itself is reached, the search ends.
    """
    longest = max(counts)
    lots = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), (capacity - longest) // length)
        lot = 1
        while left > 0:
            lots.append((length, min(lot, left)))
            left -= lot
            lot *= 2
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    states = [1]
    for length, lot in lots:
        if states[-1] >> room & 1:
            break
        states.append((states[-1] | states[-1] << length * lot) & mask)
    total = states[-1].bit_length() - 1
    used = {longest: 1}
    for state, (length, lot) in zip(reversed(states[:-1]), reversed(lots[: len(states) - 1]), strict=True):
        if not state >> total & 1:
            total -= length * lot
            used[length] = used.get(length, 0) + lot
    return used


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, pieces, first sequence, pieces in each sequence, first offset) for every use of a pattern."""
    counts = {length: n for length, n in counts.items() if n}
    taken = dict.fromkeys(counts, 0)
    plan, sequence = [], 0
    while counts:
        pattern = fill_window(counts, capacity)
        times = min(counts[length] // n for length, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            plan.append((length, taken[length], n * times, sequence, n, offset))
            offset += n * length
            taken[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, text) -> one row per document: doc_id, tokens, and each piece's CRC-32. Written.

    ``tokenizer``: path of a vocabulary file that every executor has. Null texts are empty: their only token is ``end_id``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                encoded = encoder.encode(part.column("text"))
                raw = encoded.ids.astype("<u4").tobytes()
                tokens, sums = [], []
                for a, b in zip(encoded.first[:-1].tolist(), encoded.first[1:].tolist(), strict=True):
                    own = raw[4 * a : 4 * b] + end
                    tokens.append(b - a + 1)
                    sums.append([zlib.crc32(own[i : i + 4 * window]) for i in range(0, len(own), 4 * window)])
                yield pa.record_batch([part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "sums"])

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, doc_tokens long, sums array<long>"), "tokens")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and ``end_id``. No sequence exceeds ``window`` tokens, and offsets in one are
    without gaps. Null and empty texts are one piece of one token; a very long text is many full pieces and at
    most one shorter; repeated rows are pieces of their own; an empty table gives no rows; other columns are ignored.
    """
    tokens = token_pieces(docs, tokenizer, window, end_id)
    pieces = tokens.select("doc_id", "doc_tokens", F.posexplode("sums").alias("n", "ids_crc32")).select(
        "doc_id",
        (F.col("n") * F.lit(window)).cast("long").alias("start"),
        F.least(F.lit(window), F.col("doc_tokens") - F.col("n") * window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    plan = packing_plan(counts, window)
    by_length: dict[int, list[np.ndarray]] = {}
    for length, *rest in plan:
        by_length.setdefault(length, []).append(rest)
    table = {length: np.array(rest, np.int64) for length, rest in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(x).to_numpy() for x in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                first, _, start, each, at = table[size][np.searchsorted(table[size][:, 0], number[own], side="right") - 1].T
                sequence[own] = start + (number[own] - first) // each
                offset[own] = at + (number[own] - first) % each * size
            yield pa.record_batch([*(batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return numbered(pieces, "length", order, "number").mapInArrow(place, schema)

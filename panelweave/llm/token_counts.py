"""Token counts of fields and sections by offset-mapped attribution.

The fields of a row are put together into one text and encoded once. Each token's bytes give the characters
it touches; tokens and sections, both in order, are joined by position. A token across a border
belongs to the section with most of its characters, of equals to the first; a token that touches no
section is separator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.bpe import piece_encoder
from panelweave.llm.words import slices


def _owners(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens [start, end): the section [low, high) with most of their characters (-1: none), and whether they lie across a border.

    Sections are in order and apart.
    """
    first = np.searchsorted(high, start, side="right")
    last = np.searchsorted(low, end, side="left") - 1
    owner = np.where(first <= last, first, -1)
    inside = (first == last) & (low[np.minimum(first, len(low) - 1)] <= start) & (end <= high[np.minimum(first, len(low) - 1)]) if len(low) else np.zeros(len(start), bool)
    for i in np.flatnonzero(first < last).tolist():
        own = np.arange(first[i], last[i] + 1)
        share = np.minimum(high[own], end[i]) - np.maximum(low[own], start[i])
        owner[i] = own[int(share.argmax())]
    return owner, (owner >= 0) & ~inside


def attribute_tokens(docs: DataFrame, tokenizer: str, fields: Sequence[str], by_line: Sequence[str] = (), separator: str = " ") -> DataFrame:
    """One row per section of each row: doc_id, field, section, start, end, n_tokens, n_across.

    ``fields`` are joined with ``separator`` between them; those in ``by_line`` have a section per line, its line feed
    included, the others one. ``start`` and ``end`` count characters of the joined text; ``n_across`` of the tokens also
    touch something else. A field named "" has the tokens of separators alone, as section 0; together the
    sections of a row have all its tokens. Null fields are empty; an empty field is one section without characters and
    tokens; repeated rows have sections of their own; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"field{i}") for i, f in enumerate(fields)])
    whole = own.select("doc_id", *own.columns[1:], F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in own.columns[1:]]).alias("text"))
    gap = len(separator)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield sections(encoder, part)

    def sections(encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        doc, field, number, low, high, base = [], [], [], [], [], 0
        columns = [part.column(f"field{i}").to_pylist() for i in range(len(fields))]
        first_char = []
        for row, values in enumerate(zip(*columns, strict=True)):
            at = base
            first_char.append(base)
            for f, value in enumerate(values):
                lines = (value or "").split("\n") if fields[f] in by_line else [value or ""]
                for n, line in enumerate(lines):
                    size = len(line) + (n < len(lines) - 1)
                    doc.append(row)
                    field.append(f)
                    number.append(n)
                    low.append(at)
                    high.append(at + size)
                    at += size
                at += gap
            base = at - gap if values else at
        low, high, doc = np.array(low, np.int64), np.array(high, np.int64), np.array(doc, np.int64)
        encoded = encoder.encode(part.column("text"))
        stop = np.cumsum(encoded.size)
        raw = b"".join(x.encode() for x in part.column("text").to_pylist())
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        start, end = char[stop - encoded.size], char[stop - 1] + 1
        filled = np.flatnonzero(high > low)
        owner, across = _owners(start, end, low[filled], high[filled])
        total = np.zeros(len(low), np.int64)
        total[filled] = np.bincount(owner[owner >= 0], minlength=len(filled))
        border = np.zeros(len(low), np.int64)
        border[filled] = np.bincount(owner[across], minlength=len(filled))
        of = np.repeat(np.arange(part.num_rows), np.diff(encoded.first))
        alone = np.bincount(of[owner < 0], minlength=part.num_rows)
        offset = np.array(first_char, np.int64)
        ids = part.column("doc_id").take(pa.array(np.concatenate([doc, np.arange(part.num_rows)])))
        zero = np.zeros(part.num_rows, np.int64)
        names = pa.array([*(fields[f] for f in field), *[""] * part.num_rows], pa.string())
        join = lambda x, y=zero: pa.array(np.concatenate([np.asarray(x, np.int64), y]))
        return pa.record_batch(
            [ids, names, join(number), join(low - offset[doc]), join(high - offset[doc]), join(total, alone), join(border)],
            names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_across"],
        )

    return whole.mapInArrow(rows, "doc_id long, field string, section long, start long, end long, n_tokens long, n_across long")

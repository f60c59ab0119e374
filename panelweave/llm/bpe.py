"""Byte-level BPE of whole Arrow text columns: pieces are cut with array operations, each distinct piece is encoded once.

The tokenizer file cuts a text into pieces (contractions, letters, digits, other marks, white space, the
first three with one leading blank) and encodes each piece by itself. Here the pieces of many texts are
cut at once from character classes, named by 64-bit hashes, and the library's model encodes those that a
worker has not met, by the merges of the file. Slices of texts with a special token in them go through the
tokenizers library whole; the tests hold both ways against each other.
"""

from __future__ import annotations

import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from panelweave.llm.words import factors, mix, text_bytes

BLANK, LETTER, DIGIT, MARK = range(4)
#: Code points with the property White_Space, and the contractions. Fixed values of the tokenizer's pattern.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Slots for pieces that a worker remembers, and tokens that it keeps for them before it starts afresh.
SLOTS = 1 << 21
REMEMBERED = 1 << 23


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], MARK) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = BLANK
    return table


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class Encoded:
    """Token ids of some texts, one after another; ``first``: where each text's start; sizes of tokens in bytes."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.ids, self.first, self.size = ids, first, size


class PieceEncoder:
    """``path``: a tokenizer file whose merges are numbered in the order in which they apply."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.classes = _classes()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = [t.encode() for t in special]
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in vocabulary.items() if token not in special}
        self.merge = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        for token in special:
            self.size[vocabulary[token]] = len(token.encode())
        self._forget()

    def _forget(self) -> None:
        self.slot = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.number = np.zeros(SLOTS, np.int32)
        self.store = [np.zeros(0, np.int32)]
        self.stored = 0

    def encode(self, column: pa.Array) -> Encoded:
        raw, rows = text_bytes(column)
        whole = raw.tobytes()
        if any(x in whole for x in self.special):
            return self._by_library([whole[i:j].decode() for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)])
        if not len(raw):
            return Encoded(np.zeros(0, np.int32), np.zeros(len(rows), np.int64), np.zeros(0, np.int64))
        lead = (raw & 0xC0) != 0x80
        byte_of = np.append(np.flatnonzero(lead), len(raw))
        chars = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        text_at = np.searchsorted(byte_of, rows)
        start = byte_of[np.flatnonzero(self._piece_starts(chars, text_at))]
        size = np.diff(np.append(start, len(raw)))
        name = self._names(raw, start, size)
        if self.stored > REMEMBERED:
            self._forget()
        slot = (name & np.uint64(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.slot[slot] != name)
        at, number = self.at[slot], self.number[slot]
        if len(new):
            fresh, where, which = np.unique(name[new], return_index=True, return_inverse=True)
            where = new[where]
            learnt = [self.merge(whole[i : i + n]) for i, n in zip(start[where].tolist(), size[where].tolist(), strict=True)]
            count = np.array([len(x) for x in learnt], np.int32)
            place = (self.stored + np.cumsum(count) - count).astype(np.int32)
            at[new], number[new] = place[which], count[which]
            mine = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
            self.slot[mine], self.at[mine], self.number[mine] = fresh, place, count
            self.store.append(np.array([t for x in learnt for t in x], np.int32))
            self.stored += int(count.sum())
        if len(self.store) > 1:
            self.store = [np.concatenate(self.store)]
        total = int(number.sum())
        begin = np.cumsum(number) - number
        ids = self.store[0][np.repeat(at - begin, number) + np.arange(total)]
        piece = np.searchsorted(start, rows)
        first = np.append(begin, total)[piece]
        return Encoded(ids, first, self.size[ids])

    def _by_library(self, texts: list[str]) -> Encoded:
        ids = [np.array(x.ids, np.int32) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        return Encoded(flat, np.cumsum([0, *map(len, ids)]), self.size[flat])

    @staticmethod
    def _names(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        within = np.arange(len(raw)) - np.repeat(start, size)
        value = (raw.astype(np.uint64) + np.uint64(1)) * factors(int(size.max()))[within]
        return mix(np.add.reduceat(value, start) + size.astype(np.uint64))

    def _piece_starts(self, chars: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Which characters begin a piece."""
        kind = self.classes[chars]
        n = len(chars)
        begins = np.zeros(n + 1, bool)
        begins[text_at] = True
        mark = begins[:-1].copy()
        mark[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(mark)
        after = np.append(run[1:], n)
        # White space before something else in the same text: its last character stands apart, and a plain
        # blank there goes with what follows.
        gap = (kind[run] == BLANK) & ~begins[after]
        last = after[gap] - 1
        mark[last] = True
        mark[last[chars[last] == 32] + 1] = False
        quote = np.flatnonzero((chars == 39) & mark)
        if len(quote):
            owner = np.searchsorted(text_at, quote, side="right")
            end = text_at[owner]
            for tail in CONTRACTIONS:
                fit = quote + len(tail) < end
                for j, letter in enumerate(tail, 1):
                    fit &= chars[np.minimum(quote + j, n - 1)] == ord(letter)
                mark[quote[fit] + 1] = False
                beyond = quote[fit] + 1 + len(tail)
                mark[beyond[beyond < n]] = True
        return mark


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process, made once and kept from task to task."""
    held = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders"))
    if not hasattr(held, "by_path"):
        held.by_path = {}
    if path not in held.by_path:
        held.by_path[path] = PieceEncoder(path)
    return held.by_path[path]

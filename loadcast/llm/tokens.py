"""Token ids of whole texts, by the tokenizers library, in Arrow batches.

Both vocabularies used here split a text into words before any merge, so a text's ids are the
ids of its chunks one after the other, whenever the text is cut at a place where every word ends.
Two kinds of places are used: before a single space between two characters that are not white
space, and between a Latin letter and ASCII punctuation. Each distinct chunk goes through the library
once and is then looked up. A text in which a space stands beside other white space, or at an end,
goes through the library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNSAFE = f"^ |[{WHITE}] | [{WHITE}]| $|\\x1f"
INNER_CUT = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"
CUT = "\x1f"
SLICE_BYTES = 8_000_000
CHUNKS_KEPT = 800_000


def load_library(path: str):
    """The tokenizers library for a vocabulary; threads of its own would only compete with the other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkTokenizer:
    """The ids of texts; ``chunks_kept`` bounds the memory of the lookup, never the result."""

    def __init__(self, path: str, chunks_kept: int = CHUNKS_KEPT) -> None:
        self.library = load_library(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([UNSAFE, *(f"(?i:{re.escape(a)})" for a in added)])
        self.chunks_kept = chunks_kept
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, name: str, first: int, values) -> None:
        old = getattr(self, name)
        if first + len(values) > len(old):
            new = np.zeros(max(first + len(values), 2 * len(old)), old.dtype)
            new[:first] = old[:first]
            setattr(self, name, new)
        getattr(self, name)[first:first + len(values)] = values

    def _learn(self, chunks: list[str]) -> None:
        first = len(self.slots)
        for begin in range(0, len(chunks), 20_000):
            some = chunks[begin:begin + 20_000]
            ids = self._library_ids(some)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._append("starts", first, self.used + np.cumsum(lengths) - lengths)
            self._append("lengths", first, lengths)
            self._append("pool", self.used, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
            self.used += int(lengths.sum())
            self.slots.update(zip(some, range(first, first + len(some))))
            first += len(some)

    def _slots_of(self, chunks: np.ndarray) -> np.ndarray:
        if len(self.slots) + len(chunks) > self.chunks_kept:
            self._forget()
        known = self.slots.get
        slots = np.fromiter((known(c, -1) for c in chunks), np.int64, len(chunks))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            slots[unknown] = len(self.slots) + np.arange(len(unknown))
            self._learn(chunks[unknown].tolist())
        return slots

    def _safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        words = pc.list_flatten(pieces).dictionary_encode()
        text_ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
        # a text's first word has no space before it
        index[np.concatenate([[0], text_ends[:-1]])] += 1
        spelled = pa.concat_arrays([pc.binary_join_element_wise("", words.dictionary, " "), words.dictionary])
        used = np.flatnonzero(np.bincount(index, minlength=2 * len(words.dictionary)))
        spelled = spelled.take(pa.array((used >> 1) + (used & 1) * len(words.dictionary)))
        cut = pc.split_pattern(pc.replace_substring_regex(spelled, INNER_CUT, "\\1" + CUT + "\\2"), CUT)
        parts = pc.list_flatten(cut).dictionary_encode()
        slots = self._slots_of(parts.dictionary.to_numpy(zero_copy_only=False))[parts.indices.to_numpy(zero_copy_only=False)]
        word_ids, word_ends = self._gather(self.pool, self.starts[slots], self.lengths[slots])
        part_ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        word_ends = np.concatenate([[0], word_ends])[part_ends]
        place = np.zeros(2 * len(words.dictionary), np.int64)
        place[used] = np.arange(len(used))
        at = place[index]
        word_starts = np.concatenate([[0], word_ends[:-1]])
        ids, ends = self._gather(word_ids, word_starts[at], (word_ends - word_starts)[at])
        return ids, np.diff(np.concatenate([[0], ends[text_ends - 1]]))

    @staticmethod
    def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of a pool one after the other, and where each ends."""
        ends = np.cumsum(lengths)
        places = np.repeat(starts - (ends - lengths), lengths)
        places += np.arange(len(places))
        return pool[places], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids and the number of ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._safe(texts)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k in np.flatnonzero(unsafe):
            ids[k] = np.asarray(self._library_ids([texts[int(k)].as_py()])[0], np.uint32)
        if not unsafe.all():
            flat, counts = self._safe(texts.filter(pa.array(~unsafe)))
            for k, part in zip(np.flatnonzero(~unsafe), np.split(flat, np.cumsum(counts)[:-1])):
                ids[k] = part
        return np.concatenate(ids), np.asarray([len(i) for i in ids], np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str, chunks_kept: int = CHUNKS_KEPT) -> ChunkTokenizer:
    """One tokenizer for each vocabulary in a Python worker."""
    return ChunkTokenizer(path, chunks_kept)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch that hold about ``limit`` bytes of text each; a row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    bounds = np.flatnonzero(np.diff(group)) + 1
    begin = 0
    for end in [*bounds.tolist(), batch.num_rows]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end

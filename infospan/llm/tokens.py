"""Token ids of whole texts by a public tokenizer file, a worker's chunks encoded once.

A text is cut into chunks whose ids don't depend on their neighbours; distinct chunks go through the
tokenizers library and are kept in a bounded table of the Python worker, and texts are put together from that table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from infospan.llm.shared import held

#: Chunks that a worker remembers before it starts afresh, chunks encoded at once, and bytes of text handled at once.
REMEMBERED = 600_000
CHUNKS_AT_ONCE = 20_000
TEXT_AT_ONCE = 2_000_000
#: Ids in a worker's table above which texts with added tokens, which are encoded whole, make it start afresh.
WHOLE_IDS = 16_000_000
#: Marks of a text's first chunk and of one that follows its neighbour without a space.
FIRST, JOINED = "\x02", "\x03"
#: A piece always ends between a letter or digit and what is neither one, nor space, nor a combining mark.
PIECE_END = r"([\pL\pN])([^\s\pL\pN\pM])"
EDGE = re.compile(r"(?<=\S)(?= )")


def public_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkedTokenizer:
    """cut: `spaces` for byte-level tokenizers, whose tokens may begin with one space; `words` for those that drop white space and case.

    Both also cut where PIECE_END matches. `spaces`: a text is cut before each space between other characters and before
    each single line end between other characters. A text with other white space beside a space is cut only where a space follows a character that
    isn't white space; such a chunk holds its whole run of white space.
    """

    def __init__(self, path: str, cut: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.end_id = Tokenizer.from_file(path), cut, end_id
        added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.added = "|".join(map(re.escape, added))
        self.mark = added[0] if added and self.tokenizer.token_to_id(added[0]) is not None else None
        self.mark_id = self.tokenizer.token_to_id(added[0]) if added else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 1
        self.pool[0] = self.end_id
        self.starts, self.sizes, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 1
        self.sizes[0] = 1  # entry 0: the end id

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """New entries with these numbers of ids; -1: not to be used by itself."""
        n, at = len(sizes), self.count
        for name in ("starts", "sizes"):
            if at + n > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * (at + n)))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        own = np.maximum(sizes, 0)
        self.starts[at : at + n], self.sizes[at : at + n] = self.used + np.cumsum(own) - own, sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += n
        return range(at, at + n)

    def _chunk(self, part: str) -> str | None:
        if part.isalnum():
            return " " + part
        if part.startswith((FIRST, JOINED)):
            chunk = core = part[1:]
            if part == FIRST:
                return ""
        elif part.startswith("\n"):
            chunk, core = part, part[1:]
        else:
            chunk, core = " " + part, part
        return None if not core or core[0].isspace() or core[-1].isspace() else chunk

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and their numbers.

        An added token splits a text before anything else does, so chunks joined by one are encoded in one call, each by itself.
        """
        if self.mark is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) == len(chunks) - 1:
                return np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found])

    def _learn(self, keys: list[str], table: dict[str, int], chunks: list[str | None]) -> None:
        some = [c for c in chunks if c is not None]
        runs = [self._ids(some[k : k + CHUNKS_AT_ONCE]) for k in range(0, len(some), CHUNKS_AT_ONCE)]  # the library's tokens take far more room than ids
        ids, found = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        sizes = np.full(len(chunks), -1)
        if len(some) < len(chunks):
            sizes[[c is not None for c in chunks]] = found
        else:
            sizes = found
        table.update(zip(keys, self._add(ids, sizes), strict=True))

    def _entries(self, parts: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [parts[k] for k in missing.tolist()]
            first = self.count
            self._learn(new, self.known, new if self.cut == "words" else [self._chunk(p) for p in new])
            at[missing] = first + np.arange(len(new))
        return at

    def _by_runs(self, text: str) -> np.ndarray:
        chunks = EDGE.split(text)
        new = list(dict.fromkeys(c for c in chunks if c not in self.runs))
        if new:
            self._learn(new, self.runs, new)
        return np.fromiter(map(self.runs.__getitem__, chunks), np.int64, len(chunks))

    def _whole(self, text: str) -> np.ndarray:
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._add(ids, np.array([len(ids)])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, the end id after each text, and the number of ids of each text. Null: empty."""
        if len(self.known) + len(self.runs) > REMEMBERED:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd, whole = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        lower = pc.ascii_lower(texts)
        if self.added:  # no chunk may be cut within an added token, nor lower-cased into one
            found = pc.match_substring_regex(lower, self.added)
            whole = found.to_numpy(zero_copy_only=False)
        if whole.any():
            none = pa.scalar("", pa.large_string())
            kept, lower = pc.if_else(found, none, texts), pc.if_else(found, none, lower)
        else:
            kept = texts
        if self.cut == "words":
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, PIECE_END, r"\1 \2"))
        else:
            odd = pc.match_substring_regex(kept, f"[{FIRST}{JOINED}]").to_numpy(zero_copy_only=False).copy()
            cut = pc.replace_substring_regex(kept, PIECE_END, rf"\1 {JOINED}\2")
            none = pa.scalar("", pa.large_string())
            marked = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), pc.replace_substring(cut, "\n", " \n"), none)
            lists = pc.split_pattern(marked, " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        entries = self._entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]  # strings at once, no scalar for each
        counts = np.diff(bounds)
        bad = np.flatnonzero(self.sizes[entries] < 0)
        if len(bad):
            odd[np.searchsorted(bounds, bad, "right") - 1] = True
        if odd.any() or whole.any():
            pieces = [self._whole(texts[i].as_py()) if whole[i] else self._by_runs(texts[i].as_py()) if odd[i] else entries[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            counts, entries = np.array([len(p) for p in pieces]), np.concatenate(pieces)
            bounds = np.concatenate(([0], np.cumsum(counts)))
        entries = np.insert(entries, bounds[1:], 0)
        bounds = bounds + np.arange(len(bounds))
        sizes = self.sizes[entries]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        kind = np.int32 if max(self.used, ends[-1]) < 1 << 31 else np.int64
        where = np.repeat((self.starts[entries] - ends[:-1]).astype(kind), sizes)
        where += np.arange(ends[-1], dtype=kind)
        ids, counts = self.pool[where], ends[bounds[1:]] - ends[bounds[:-1]]
        if whole.any() and self.used > WHOLE_IDS:
            self.clear()
        return ids, counts


def tokenizer_of(path: str, cut: str, end_id: int) -> ChunkedTokenizer:
    """The worker's own; later tasks in the same worker find its chunks."""
    return held((path, cut, end_id), lambda: ChunkedTokenizer(path, cut, end_id))


def slices(batch: pa.RecordBatch, text: int, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `at_once` bytes of text, TEXT_AT_ONCE if None; a longer text is a run of its own.

    Copies with buffers of their own: some kernels (ascii_lower) misread arrays that begin within a buffer.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (at_once or TEXT_AT_ONCE), "right")))
        yield batch.take(pa.array(np.arange(low, high)))
        low = high


def encoded(batches: Iterator[pa.RecordBatch], text: int, path: str, cut: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each run of rows with the ids of its texts and their numbers."""
    tokenizer = tokenizer_of(path, cut, end_id)
    for batch in batches:
        for rows in slices(batch, text):
            ids, counts = tokenizer.encode(rows.column(text))
            yield rows, ids, counts


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values as little-endian bytes; bounds has the first value of each run and the end."""
    data = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(data)])

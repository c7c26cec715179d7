"""Token ids in binary files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, serves all files. A file holds independent blocks of whole documents; a
block's ids go round `LANES` interleaved 64-bit states that share one stream of 32-bit words. At every
`CHECKPOINT_ROWS` rows the states and the place in the stream are kept, so a reader decodes all parts of a block side
by side, or starts at any of them. Blocks carry CRC-32 sums of their bytes and of their ids.

File: MAGIC, then blocks. Block: HEADER (sizes and sums), doc ids (int64, the smallest of them for null), ids per document (uint32),
checkpoint places (uint32), checkpoint states (uint64), words (uint32); all little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infospan.llm.shared import open_store, scratch, shuffle_partitions, written
from infospan.llm.tokens import binaries, encoded

MAGIC = b"RANSIDS1"
#: documents, ids, rows, checkpoints, words (uint32 each), CRC-32 of what follows the header, CRC-32 of the ids.
HEADER = struct.Struct("<7I")
LANES, CHECKPOINT_ROWS = 256, 128
LOW = 1 << 31
#: Ids in a block before it ends with its document, and blocks that are encoded side by side.
BLOCK_IDS, BLOCKS_AT_ONCE = 1 << 18, 8
#: Ids that are counted in one call.
COUNTED_AT_ONCE = 1 << 22
NULL_ID = -(1 << 63)


@dataclass
class Table:
    """Frequencies that sum to 2 ** bits; every id seen has at least 1."""

    bits: int
    freq: np.ndarray
    cum: np.ndarray
    slot: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int]) -> Table:
        size = max(counts, default=0) + 1
        bits = min(24, max(12, (max(1, len(counts)) - 1).bit_length() + 3))
        n = np.zeros(size, np.float64)
        n[list(counts)] = list(counts.values())
        total = 1 << bits
        freq = np.where(n > 0, np.maximum(1, np.floor(n / max(1.0, n.sum()) * (total - len(counts)))), 0).astype(np.int64)
        freq[int(freq.argmax())] += total - int(freq.sum())
        cum = np.cumsum(freq) - freq
        slot = np.repeat(np.arange(size, dtype=np.uint32), freq)
        return cls(bits, freq.astype(np.uint64), cum.astype(np.uint64), slot)

    def to_bytes(self) -> bytes:
        body = struct.pack("<2I", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        bits, size = struct.unpack_from("<2I", data)
        freq = np.frombuffer(data, "<u4", size, 8).astype(np.int64)
        return cls(bits, freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(size, dtype=np.uint32), freq))


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, checkpoint places, checkpoint states and words of each block; blocks are coded side by side."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    rows = np.array([-(-len(blocks[i]) // LANES) for i in order])
    most = int(rows[0]) if len(rows) else 0
    ids = np.full((len(order), most * LANES), int(table.freq.argmax()), np.uint32)
    for k, i in enumerate(order):
        ids[k, : len(blocks[i])] = blocks[i]
    ids = ids.reshape(len(order), most, LANES)
    state = np.full((len(order), LANES), LOW, np.uint64)
    bits, shift, half = np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32)
    words: list[list[np.ndarray]] = [[] for _ in order]
    marks: list[list[tuple[int, np.ndarray]]] = [[] for _ in order]
    put = np.zeros(len(order), np.int64)
    for row in range(most - 1, -1, -1):
        n = int(np.searchsorted(-rows, -row, "left"))  # blocks with more rows than this
        x, symbol = state[:n], ids[:n, row]
        freq = table.freq[symbol]
        full = x >= freq << shift
        for k in np.flatnonzero(full.any(axis=1)).tolist():
            words[k].append((out := x[k][full[k]]).astype(np.uint32))
            put[k] += len(out)
        x = np.where(full, x >> half, x)
        quotient = x // freq
        state[:n] = (quotient << bits) + (x - quotient * freq) + table.cum[symbol]
        if row % CHECKPOINT_ROWS == 0:
            for k in range(n):
                marks[k].append((int(put[k]), state[k].copy()))
    out: list = [None] * len(order)
    for k, i in enumerate(order):
        places = np.array([put[k] - done for done, _ in reversed(marks[k])], np.uint32)
        states = np.array([s for _, s in reversed(marks[k])], np.uint64).reshape(-1, LANES)
        stream = np.concatenate(words[k][::-1]) if words[k] else np.zeros(0, np.uint32)
        out[i] = (int(rows[k]), places, states, stream)
    return out


def decode_block(n: int, rows: int, places: np.ndarray, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The n ids of a block; all checkpointed parts go side by side."""
    if not n:
        return np.zeros(0, np.uint32)
    parts = len(places)
    out = np.zeros((parts, CHECKPOINT_ROWS, LANES), np.uint32)
    x, at = states.astype(np.uint64), places.astype(np.int64)
    bits, mask, half, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32), np.uint64(LOW)
    last = rows - (parts - 1) * CHECKPOINT_ROWS
    words = np.append(words, np.zeros(1, np.uint32)).astype(np.uint64)
    for row in range(CHECKPOINT_ROWS):
        if row == last:
            x, at = x[:-1], at[:-1]
        if not len(x):
            break
        within = x & mask
        symbol = table.slot[within]
        out[: len(x), row] = symbol
        x = table.freq[symbol] * (x >> bits) + within - table.cum[symbol]
        short = x < low
        order = np.cumsum(short, axis=1)
        word = words[np.minimum(at[:, None] + order - 1, len(words) - 1)]
        x = np.where(short, x << half | word, x)
        at = at + order[:, -1]
    return out.reshape(-1)[:n]


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, coded: tuple) -> bytes:
    rows, places, states, words = coded
    body = b"".join([doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), places.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return HEADER.pack(len(doc_ids), len(ids), rows, len(places), len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def unpack_block(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, ids per document and all ids of a block; raises ValueError if a checksum differs."""
    docs, n, rows, parts, stream, body_sum, ids_sum = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size :]
    if zlib.crc32(body) != body_sum:
        raise ValueError("a block is damaged")
    at, found = 0, []
    for kind, size in (("<i8", docs), ("<u4", docs), ("<u4", parts), ("<u8", parts * LANES), ("<u4", stream)):
        found.append(np.frombuffer(body, kind, size, at))
        at += size * np.dtype(kind).itemsize
    doc_ids, counts, places, states, words = found
    ids = decode_block(n, rows, places, states.reshape(-1, LANES), words, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("a block's ids differ from those written")
    return doc_ids, counts.astype(np.int64), ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, cut: str, id_col: str, text_col: str, wide: bool) -> DataFrame:
    """(doc_id, ids): little-endian uint16, or uint32 for vocabularies over 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, counts in encoded(batches, 1, tokenizer, cut, end_id):
            bounds = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays([rows.column(0), binaries(ids if wide else ids.astype(np.uint16), bounds).cast(pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, wide: bool) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has ids at most."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
            ids = np.frombuffer(lists.buffers()[2], kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0])
            for low in range(0, len(ids), COUNTED_AT_ONCE):
                n = np.bincount(ids[low : low + COUNTED_AT_ONCE])
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def largest_id(tokenizer: str, end_id: int) -> int:
    """The largest id that the tokenizer's file, its added tokens or the end of a text can give."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, cut: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, in ascending id order, to files in `folder`; returns the written index of blocks.

    Index: (shard, block, file, offset, size, start, n_ids): start counts the shard's ids before the block. A file is
    named by its task's attempt and the index names only files of attempts that ended well, so a lost executor leaves
    at most an unused file. Ids are cast to long, so that an id that is no number fails or, without ANSI mode, is null; null ids come first (the least
    long stands for null and can't be an id), equal ids keep any order. Null texts are the end id alone. An empty table gives an empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    wide = largest_id(tokenizer, end_id) >= 1 << 16
    tokens = written(tokenized(docs, tokenizer, end_id, cut, id_col, text_col, wide), "ids")
    table = Table.of(count_ids(tokens, wide))
    coded_table = table.to_bytes()
    kind = np.dtype("<u4" if wide else "<u2")
    _put(f"{folder}/table", coded_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, known = task.partitionId(), Table.from_bytes(coded_table)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rans"
        found: list[tuple] = []
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        store, path = open_store(name)
        offset, start = len(MAGIC), 0
        with store.open_output_stream(path) as out:
            out.write(MAGIC)

            def flush() -> None:
                nonlocal offset, start
                for (doc_ids, counts, ids), coded in zip(ready, encode_blocks([r[2] for r in ready], known), strict=True):
                    data = pack_block(doc_ids, counts, ids, coded)
                    out.write(data)
                    found.append((shard, len(found), name, offset, len(data), start, len(ids)))
                    offset, start = offset + len(data), start + len(ids)
                ready.clear()

            doc_ids, parts, held = [], [], 0

            def close() -> None:
                nonlocal held
                if doc_ids:
                    ready.append((np.array(doc_ids, np.int64), np.array([len(p) for p in parts]), np.concatenate(parts).astype(np.uint32)))
                doc_ids.clear()
                parts.clear()
                held = 0

            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    doc_ids.append(NULL_ID if key is None else key)
                    parts.append(np.frombuffer(ids.as_py(), kind))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        close()
                        if len(ready) == BLOCKS_AT_ONCE:
                            flush()
            close()
            flush()
        if not found:
            store.delete_file(path)
        names = ["shard", "block", "file", "offset", "size", "start", "n_ids"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    n = shuffle_partitions(spark)
    ordered = tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    blocks = ordered.mapInArrow(run, "shard int, block int, file string, offset long, size long, start long, n_ids long")
    return written(blocks, "rans-index")


def _put(uri: str, data: bytes) -> None:
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start counts the ids of all documents before; ids little-endian uint32.

    Raises if a checksum differs.
    """
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # a row for each file
    tasks = index.join(base, "shard").select("file", "offset", "size", (F.col("base") + F.col("start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, files = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                if table is None:
                    with store.open_input_file(path.rsplit("/", 1)[0] + "/table") as f:
                        table = Table.from_bytes(f.read())
                if path not in files:
                    for f in files.values():
                        f.close()
                    files = {path: store.open_input_file(path)}
                    if files[path].read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{path} has another format")
                doc_ids, counts, ids = unpack_block(files[path].read_at(row["size"], row["offset"]), table)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                keys = pa.array(doc_ids, mask=doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(row["start"] + bounds[:-1]), pa.array(counts), binaries(ids, bounds).cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    n = shuffle_partitions(spark)
    return tasks.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write() to a new folder in the shared one, then read()."""
    folder = scratch(docs.sparkSession, "rans")
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, **options))

"""Exact deduplication by Grace hashing.

Each task first drops the copies within what it reads: an open-addressing table of bounded size compares complete
normalised contents and keeps one representative of each. Representatives go to spill files, dealt into buckets by their digest; a bucket whose
distinct contents are over the table's budget is dealt again by further bits of the digest, until every bucket fits. Each bucket then
streams through one table, which holds each distinct content once. Contents that very many tasks have are combined over salts before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm import shared
from infospan.llm.shared import SPACE, shuffle_partitions, written

#: Content bytes that one table holds, and parts into which a bucket over that is dealt again.
TABLE_BYTES = 64_000_000
FANOUT = 16
#: Rows of one task in a row key.
ROW_BITS = 36


class ContentTable:
    """Open addressing with linear probing; equal digests are told apart by their complete contents."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """The content's entry and whether it is new."""
        h = int.from_bytes(digest[:8], "big")
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


#: Rows whose numbers a task holds before it lets go of them, however few contents they have.
ROWS_HELD = 500_000


def _better(a: tuple, b: tuple) -> bool:
    """(n_chars, id): more characters first, then the smaller id; a null id comes last."""
    return (a[0], a[1] is not None) > (b[0], b[1] is not None) or (a[0] == b[0] and a[1] is not None and b[1] is not None and a[1] < b[1])


def _partial(docs: DataFrame, id_col: str, text_col: str, kind: str, table_bytes: int) -> DataFrame:
    """A row for each document: its key, its representative's key; representatives also carry digest, content and what they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << ROW_BITS
        names = ["row", "doc_id", "rep", "digest", "content", "best_chars", "best_id", "n"]

        def flush() -> pa.RecordBatch:
            reps = [firsts[e] for e in entries]
            is_rep = [r == k for r, k in zip(reps, rows, strict=True)]
            pick = lambda values: [values[e] if own else None for e, own in zip(entries, is_rep, strict=True)]
            arrays = [
                pa.array(rows, pa.int64()), pa.array(ids, id_type), pa.array(reps, pa.int64()), pa.array([digests[e] for e in entries], pa.binary()),
                pa.array(pick(table.contents), pa.binary()), pa.array(pick([b[0] for b in best]), pa.int64()), pa.array(pick([b[1] for b in best]), id_type), pa.array(pick(counts), pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        table, rows, ids, entries, firsts, digests, best, counts = ContentTable(), [], [], [], [], [], [], []
        for batch in batches:
            id_type = batch.schema.field(0).type
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            for key, n_chars, text in zip(batch.column(0).to_pylist(), chars, texts, strict=True):
                content = (text.as_py() or b"").translate(None, SPACE)
                digest = hashlib.sha256(content).digest()
                entry, new = table.find(digest, content)
                if new:
                    firsts.append(row)
                    digests.append(digest)
                    best.append((n_chars, key))
                    counts.append(1)
                else:
                    counts[entry] += 1
                    if _better((n_chars, key), best[entry]):
                        best[entry] = (n_chars, key)
                rows.append(row)
                ids.append(key)
                entries.append(entry)
                row += 1
                if table.bytes > table_bytes or len(rows) >= ROWS_HELD:
                    yield flush()
                    table, rows, ids, entries, firsts, digests, best, counts = ContentTable(), [], [], [], [], [], [], []
        if rows:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, rep long, digest binary, content binary, best_chars long, best_id {kind}, n long")


def _bucket(bits: int, level: int) -> F.Column:
    """`bits` bits of the digest, other bytes at each level."""
    word = F.conv(F.hex(F.substring("digest", 1 + 6 * level, 6)), 16, 10).cast("long")
    return F.pmod(word, F.lit(1 << bits))


def _spill(reps: DataFrame, table_bytes: int) -> DataFrame:
    """Representatives with the `bucket` (array, a number for each level) in which they fit one table."""
    spark = reps.sparkSession
    sizes = reps.groupBy("digest").agg(F.max(F.length("content")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    wanted = max(4 * shuffle_partitions(spark), 2 * total // table_bytes)
    first = max(0, int(wanted - 1).bit_length())
    bucket, level = F.array(_bucket(first, 0)), 0
    while level < 4:
        level += 1
        over = sizes.withColumn("bucket", bucket).groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("contents")).where((F.col("bytes") > table_bytes) & (F.col("contents") > 1))
        over = written(over.select("bucket"), "spill-sizes")
        if over.isEmpty():
            break
        # Over-full buckets are dealt again; the rest of the digest's bytes serve the next level.
        again = reps.withColumn("b", bucket).join(over.withColumnRenamed("bucket", "b"), "b", "left_semi").select("digest", F.concat("b", F.array(_bucket(FANOUT.bit_length() - 1, level))).alias("deeper")).distinct()
        reps = written(reps.withColumn("b0", bucket).join(again, "digest", "left").withColumn("bucket", F.coalesce("deeper", "b0")).drop("deeper", "b0"), "spill")
        sizes = reps.groupBy("digest", "bucket").agg(F.max(F.length("content")).alias("bytes"))
        bucket = F.col("bucket")
    return reps.withColumn("bucket", bucket)


def _resolve(spilled: DataFrame, kind: str, combine: bool = False) -> DataFrame:
    """(row, keep_id, group_size, leader, best_chars, digest, content) of every representative, bucket by bucket.

    leader: the first row of the same content, which alone keeps digest and content.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, counts, rows, entries, leaders, digests = ContentTable(), [], [], [], [], [], []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("best_id").type
            columns = [batch.column(c).to_pylist() for c in ("row", "best_chars", "best_id", "n", "digest")]
            for (row, n_chars, best_id, n, digest), content in zip(zip(*columns, strict=True), batch.column("content"), strict=True):
                entry, new = table.find(digest, content.as_py())
                if new:
                    best.append((n_chars, best_id))
                    counts.append(n)
                    leaders.append(row)
                    digests.append(digest)
                else:
                    counts[entry] += n
                    if _better((n_chars, best_id), best[entry]):
                        best[entry] = (n_chars, best_id)
                rows.append(row)
                entries.append(entry)
        at = np.array(entries, np.int64)
        own = [leaders[e] == row for e, row in zip(entries, rows, strict=True)]
        once = lambda values: pa.array([values[e] if first else None for e, first in zip(entries, own, strict=True)], pa.binary())
        arrays = [pa.array(rows, pa.int64()), pa.array([best[e][1] for e in entries], id_type), pa.array(np.array(counts, np.int64)[at]), pa.array(np.array(leaders, np.int64)[at]), pa.array([best[e][0] for e in entries], pa.int64())]
        kept = [once(digests), once(table.contents)] if combine else [pa.nulls(len(rows), pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([*arrays, *kept], ["row", "keep_id", "group_size", "leader", "best_chars", "digest", "content"])

    return spilled.select("bucket", "row", "digest", "content", "best_chars", "best_id", "n").groupBy("bucket").applyInArrow(run, f"row long, keep_id {kind}, group_size long, leader long, best_chars long, digest binary, content binary")


def _combined(reps: DataFrame, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """reps with one for each content and salt where very many tasks have a digest, and (row, leader) of those that others stand for now."""
    n = shuffle_partitions(reps.sparkSession)
    counts = reps.groupBy("digest").agg(F.count("*").alias("tasks")).where(F.col("tasks") >= shared.HOT_ROWS)
    hot = written(counts.orderBy(F.desc("tasks")).limit(4 * n), "hot-contents")
    if hot.isEmpty():
        return reps, None
    hot = F.broadcast(hot)  # 4 rows a partition at most
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("tasks") / shared.HOT_ROWS) + 1)
    first = written(_resolve(reps.join(hot, "digest").withColumn("bucket", F.array(F.xxhash64("digest"), salt)), kind, combine=True), "combined")
    leaders = first.where("row = leader").select("row", "digest", "content", "best_chars", F.col("keep_id").alias("best_id"), F.col("group_size").alias("n"))
    return reps.join(hot, "digest", "left_anti").unionByName(leaders), first.select("row", "leader")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal if they agree without the characters [\\x20\\x09-\\x0D]; null counts as empty. The row with the most
    characters stays, then the one with the smallest id, null last; of rows that agree in id and are the best, all are
    kept. Texts of any length are compared whole. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = written(_partial(docs, id_col, text_col, kind, table_bytes), "partial")
    reps = table.where("content IS NOT NULL").select("row", "digest", "content", "best_chars", "best_id", "n")
    reps, stood_for = _combined(reps, kind)
    found = _resolve(_spill(reps, table_bytes), kind).select("row", "keep_id", "group_size")
    if stood_for is not None:
        others = stood_for.join(found.withColumnRenamed("row", "leader"), "leader").select("row", "keep_id", "group_size")
        found = found.join(stood_for.select("row"), "row", "left_anti").unionByName(others)
    # A representative stands for the rows of one task only, so no key of this join has more rows than a task reads.
    joined = table.select("doc_id", "digest", "rep").join(found, F.col("rep") == F.col("row"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows with one id, all."""
    kept = groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")

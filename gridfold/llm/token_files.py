"""Token-ID output: flat unsigned integer files with 64-bit document offsets, in ascending order of doc_id.

A range partition of the documents becomes a shard: ``shard-NNNNN.ids`` (unsigned 16-bit where the vocabulary allows it, else
32-bit), ``.offsets`` (unsigned 64-bit; one more than documents, from 0), ``.docs`` (64-bit document ids) and ``.named`` (a
byte each: 0 where a document has no id). Shards are
numbered in the order of their ranges, so a shard's first position in the whole is the sum of the ids of those before it:
a prefix sum over one row per shard. ``index.json`` holds the shards with their bases. Readers map the files into memory.

Null texts count as empty and have the end id alone; rows of a null doc_id come first, with 0 in .named, and are read as null. Repeated rows
are written as often as they come, equal ids in the order of their texts. Empty tables give no shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm._common import atomic_file, bounded_batches, column, map_shared, materialise, n_shuffle, open_shared, write_arrays
from gridfold.llm.tokens import encoded, encoder

END_ID = 1


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Writes the shards and their index below folder; returns the index, one entry per shard that has documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        kind = "<u2" if max(encoder(tokenizer).vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        names, named, offsets, total = [], [], [np.zeros(1, np.int64)], 0
        uri = f"{folder}/shard-{shard:05d}"
        with atomic_file(f"{uri}.ids") as f:
            for batch in batches:
                texts = column(batch, "text")
                names.append(column(batch, "doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                named.append(column(batch, "doc_id").is_valid().to_numpy(zero_copy_only=False))
                for _, ids, ends in encoded(texts, tokenizer, end_id):
                    f.write(ids.astype(kind).tobytes())
                    offsets.append(ends + total)
                    total += int(ends[-1])
        if names:
            write_arrays(uri, offsets=np.concatenate(offsets).astype("<u8"), docs=np.concatenate(names).astype("<i8"), named=np.concatenate(named).astype("u1"))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sum(map(len, names))]), pa.array([total])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = shards or n_shuffle(spark)
    written = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, docs long, ids long")
    found = materialise(written, f"{folder}/_shards").orderBy("shard").collect()  # one small row per shard
    base, index = 0, []
    width = 2 if max(encoder(tokenizer).vocab_size, end_id + 1) <= 1 << 16 else 4
    for r in found:
        index.append({"shard": r.shard, "docs": r.docs, "ids": r.ids, "base": base, "bytes_per_id": width})
        base += r.ids
    with atomic_file(f"{folder}/index.json") as f:
        f.write(json.dumps({"shards": index, "ids": base}).encode())
    return index


def read_index(folder: str) -> list[dict]:
    with open_shared(f"{folder}/index.json") as f:
        return json.loads(f.read())["shards"]


class Shard:
    """A shard's documents, by memory map."""

    def __init__(self, folder: str, shard: int, bytes_per_id: int):
        uri = f"{folder}/shard-{shard:05d}"
        self.ids = map_shared(f"{uri}.ids", f"<u{bytes_per_id}")
        self.offsets = map_shared(f"{uri}.offsets", "<u8")
        self.docs = map_shared(f"{uri}.docs", "<i8")
        self.named = map_shared(f"{uri}.named", "u1")  # 0 where a document has no doc_id

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[int(self.offsets[k]) : int(self.offsets[k + 1])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task per shard."""
    index = read_index(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(folder, r["shard"], r["bytes_per_id"])
                for lo in range(0, len(shard), 10_000):
                    hi = min(len(shard), lo + 10_000)
                    at = shard.offsets[lo : hi + 1].astype(np.int64)
                    crc = [zlib.crc32(shard[k].astype("<u4").tobytes()) for k in range(lo, hi)]
                    docs = pa.array(np.asarray(shard.docs[lo:hi]), mask=np.asarray(shard.named[lo:hi]) == 0)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)

    shards = spark.createDataFrame([(r["shard"], r["base"], r["bytes_per_id"]) for r in index], "shard long, base long, bytes_per_id int")
    return shards.repartition(max(1, len(index)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Substring dedup with a log-structured fingerprint index.

Every window of W words has an anchor: its leftmost gram of K words with the least hash. Equal windows have equal anchors at
equal places, so it is enough to index anchors, about one in (W - K + 2) / 2 words. An index row holds the anchor's
fingerprint and a digest of the block, the words of all windows that share the anchor: 128 bits together.

The index is log-structured. A run is an immutable table, bucketed and sorted by fingerprint. A new batch is combined per
(fingerprint, block), written as a run, and merge-joined with each earlier run (bucket by bucket: history is not shuffled again); when more than FANOUT runs of a level have gathered, they are compacted to one run of the next level. So a corpus grows by
batches without reading earlier texts again.

Fingerprints that meet (in history, or twice in a batch) are only candidates. They are verified on whole windows: a block
found twice repeats all its windows; where one fingerprint has several blocks, one document of each block is read again and
the 128-bit digests of its single windows are compared. Then each document loses the words of its repeated windows.

Windows are judged on the input. Null texts have no words; texts shorter than a window lose nothing. Repeated rows repeat
all their windows; rows sharing a doc_id are told apart by a row number given when they are staged. A null doc_id is kept as
null. Empty tables give no rows. Places within a slice of texts wrap after 4.2 million words (one longer text): of equal grams in
one window another may be the anchor then, its block differs from its copies' and its windows are compared singly. Hot passages: every exchange of occurrences is a count that tasks combine first, or a join
whose many rows are on the side that Spark can split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm._common import U64, Words, bounded_batches, column, gram_hashes, hash_bytes, materialise, mix, n_shuffle, shared_dir, slices

W, K = 35, 8
BATCHES, FANOUT = 3, 1
_Q = (0x9E3779B97F4A7C15 | 7, 0xC2B2AE3D27D4EB4F)
_PLACE = 22  # bits of a word's place in a slice of texts


class Blocks:
    """Word hashes of some texts, and digests of any run of words by prefix sums modulo 2^64."""

    def __init__(self, texts: pa.Array, digests: int = 1):
        words = Words(texts)
        self.counts, self.starts = words.counts, words.starts
        distinct = words.distinct()
        self.hashes = hash_bytes(distinct)[words.codes]
        self.sums, self.back = [], []
        for seed, q in enumerate(_Q[:digests]):
            powers = np.full(len(words) + 1, q, U64)
            inverse = np.full(len(words) + 1, pow(q, -1, 1 << 64), U64)
            powers[0] = inverse[0] = 1
            powers, inverse = np.cumprod(powers), np.cumprod(inverse)
            own = self.hashes if not seed else hash_bytes(distinct, seed)[words.codes]
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(mix(own) * powers[:-1])]))
            self.back.append(inverse)

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Independent 64-bit digests of the words in [start, end)."""
        length = (end - start).astype(U64)
        return tuple(mix((s[end] - s[start]) * b[start] + length).view(np.int64) for s, b in zip(self.sums, self.back, strict=True))


def anchors(blocks: Blocks, w: int = W, k: int = K):
    """Anchors of all windows: text, first window (word in its text), number of windows, fingerprint."""
    n = len(blocks.hashes)
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),)
    if n < w:
        return empty
    grams = gram_hashes(blocks.hashes, k)
    place = U64((1 << _PLACE) - 1)
    keyed = (grams & ~place) | (np.arange(len(grams), dtype=U64) & place)
    # least key of every span of w - k + 1 grams, by doubling
    span, least, done = w - k + 1, keyed, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    inside = np.maximum(blocks.counts - w + 1, 0)
    if not inside.sum():
        return empty
    text = np.repeat(np.arange(len(inside)), inside)
    first = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    windows = first + blocks.starts[text]
    chosen = least[windows]
    low = (chosen & place).astype(np.int64)
    anchor = windows + ((low - windows) & int(place))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    length = np.diff(np.concatenate([new, [len(windows)]]))
    return text[new], first[new], length, grams[anchor[new]]


def staged(docs: DataFrame, batches: int, w: int = W, k: int = K) -> DataFrame:
    """Index rows of every document: batch, row, fp, block, first, windows."""
    schema = pa.schema([("row", pa.int64()), ("fp", pa.int64()), ("block", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            rows, texts = column(batch, "row").to_numpy(zero_copy_only=False), column(batch, "text")
            for lo, hi in slices(texts, 1 << 20):
                blocks = Blocks(texts.slice(lo, hi - lo))
                text, first, length, fp = anchors(blocks, w, k)
                start = blocks.starts[text] + first
                (block,) = blocks.digests(start, start + length + w - 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[lo:hi][text]), pa.array(fp.view(np.int64)), pa.array(block), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32))], schema=schema)

    out = docs.mapInArrow(run, "row long, fp long, block long, first int, windows int")
    return out.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))


class FingerprintIndex:
    """Runs of (fp, block, n), each bucketed and sorted by fp below one folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.name = f"fp_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        sorted_ = rows.select("fp", "block", "n").repartition(self.buckets, "fp").sortWithinPartitions("fp", "block")
        sorted_.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Writes the batch's combined rows as a run; returns the fingerprints that are in earlier runs too, or more than once in this one."""
        history = self.runs()
        name = self._write(batch)
        own = self.spark.table(name)
        met = own.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp")
        for run in history:
            met = met.unionByName(own.select("fp").join(self.spark.table(run).select("fp").hint("merge"), "fp", "left_semi"))
        met = materialise(met, f"{self.folder}/met-{self.made}")
        self._keep(name, 0)
        return met

    def _keep(self, name: str, at: int) -> None:
        """Puts a run into its level; a level that is over full is compacted to one run of the next."""
        while len(self.levels) <= at:
            self.levels.append([])
        self.levels[at].append(name)
        if len(self.levels[at]) > self.fanout:
            old, self.levels[at] = self.levels[at], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._keep(self._write(merged.groupBy("fp", "block").agg(F.sum("n").alias("n"))), at + 1)
            self.drop(old)

    def drop(self, names: list[str]) -> None:
        """Forgets runs and deletes their files."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _structs(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as flat arrays by field, and where each row's part ends (one more than rows, from 0)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    fields = {f.name: pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k, f in enumerate(flat.type)}
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), fields


def _windows(rows: DataFrame, w: int) -> DataFrame:
    """Digests of single windows: rows with text and blocks (fp, block, first, windows, n); out fp, block, place, w1, w2, n."""
    schema = pa.schema([("fp", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int32())])

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            texts, (ends, own) = column(batch, "text"), _structs(column(batch, "blocks"))
            for lo, hi in slices(texts, 1 << 20):
                blocks = Blocks(texts.slice(lo, hi - lo), 2)
                part = slice(ends[lo], ends[hi])
                fp, block, n, length = (own[c][part] for c in ("fp", "block", "n", "windows"))
                start = np.repeat(blocks.starts, np.diff(ends[lo : hi + 1])) + own["first"][part]
                place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                at = np.repeat(start, length) + place
                w1, w2 = blocks.digests(at, at + w)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, length)), pa.array(np.repeat(block, length)), pa.array(place.astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(np.repeat(np.minimum(n, 2), length).astype(np.int32))], schema=schema)

    return rows.select("text", "blocks").mapInArrow(run, "fp long, block long, place int, w1 long, w2 long, n int")


def repeated_windows(index_rows: DataFrame, docs: DataFrame, folder: str, batches: int, w: int = W) -> DataFrame:
    """Runs of windows that are found elsewhere too: row, first, windows. index_rows: staged(); docs: row, text."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, f"{folder}/index", n_shuffle(spark))
    met = None
    for b in range(batches):
        found = index.add(index_rows.filter(F.col("batch") == b).groupBy("fp", "block").agg(F.count("*").alias("n")))
        met = found if met is None else met.unionByName(found)
    index.drop(index.runs())  # this call's history; a lasting index keeps its runs
    index.levels.clear()
    # verification: blocks of met fingerprints
    open_ = materialise(index_rows.join(met, "fp", "left_semi").select("row", "fp", "block", "first", "windows"), f"{folder}/candidates")
    blocks = open_.groupBy("fp", "block").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "windows")).alias("at"))
    blocks = materialise(blocks.select("fp", "block", "n", "at.row", "at.first", "at.windows"), f"{folder}/blocks")
    mixed = blocks.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest")).filter("kinds > 1 AND rarest = 1").select("fp")
    torn = blocks.join(mixed, "fp", "left_semi")
    wanted = torn.groupBy("row").agg(F.collect_list(F.struct("fp", "block", "first", "windows", "n")).alias("blocks"))
    single = materialise(_windows(docs.join(wanted, "row"), w), f"{folder}/windows")
    again = single.groupBy("w1", "w2").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest")).filter("kinds > 1 AND rarest = 1").select("w1", "w2")
    partly = single.filter("n = 1").join(again, ["w1", "w2"], "left_semi").select("fp", "block", "place")
    partly = partly.join(blocks.filter("n = 1").select("fp", "block", "row", "first"), ["fp", "block"]).select("row", (F.col("first") + F.col("place")).alias("first"), F.lit(1).alias("windows"))
    fully = open_.join(blocks.filter("n > 1").select("fp", "block"), ["fp", "block"], "left_semi").select("row", "first", "windows")
    return fully.unionByName(partly)


def substring_dedup(docs: DataFrame, *, w: int = W, k: int = K, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space). docs needs doc_id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = docs.filter("doc_id IS NULL").isEmpty() and docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    numbered = docs.withColumn("row", F.col("doc_id")) if unique else materialise(docs.withColumn("row", F.monotonically_increasing_id()), f"{folder}/numbered")
    index_rows = materialise(staged(numbered.select("row", "text"), batches, w, k), f"{folder}/staged")
    marks = repeated_windows(index_rows, numbered.select("row", "text"), folder, batches, w)
    spans = marks.groupBy("row").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            n_words, n_removed, kept = [], [], []
            ends, spans = _structs(column(batch, "spans"))
            for k, text in enumerate(column(batch, "text").to_pylist()):
                words = text.encode().split()
                first, own = spans["first"][ends[k] : ends[k + 1]], ends[k + 1] > ends[k]
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, first + spans["windows"][ends[k] : ends[k + 1]] + w - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if own else words).decode())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return numbered.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")



"""What the training-data operators share: shared storage, words, hashing, bounded Arrow slices.

Everything an executor writes goes below ``spark.checkpoint.dir`` (the folder the cluster shares), to a name that only
depends on the task's partition, and appears by an atomic rename. A task that is run again writes the same file.
"""

from __future__ import annotations

import io
import os
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridfold.operators.storage import materialise, n_shuffle, shared_dir  # noqa: F401  the operators' common tools

#: A word and the white space between words, as Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

U64 = np.uint64


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of whole texts small, where the session has not chosen less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


# --- files in the shared folder -------------------------------------------------------------------------------------


def _filesystem(uri: str):
    """A pyarrow file system and path for a URI that is not local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, else None."""
    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        return urllib.parse.unquote(parts.path)
    return None


class atomic_file:
    """A file to write in the shared folder that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.uri, self.path = uri, local_path(uri)

    def __enter__(self):
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.part"
            self.file = open(self.part, "wb")  # noqa: SIM115
        else:
            self.fs, self.to = _filesystem(self.uri)
            self.fs.create_dir(os.path.dirname(self.to), recursive=True)
            self.part = f"{self.to}.{uuid.uuid4().hex}.part"
            self.file = self.fs.open_output_stream(self.part)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if self.path is not None:
            os.remove(self.part) if kind else os.replace(self.part, self.path)
        elif kind:
            self.fs.delete_file(self.part)
        else:
            self.fs.move(self.part, self.to)


def open_shared(uri: str):
    """A readable, seekable file of the shared folder."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    fs, at = _filesystem(uri)
    return fs.open_input_file(at)


def map_shared(uri: str, dtype) -> np.ndarray:
    """A flat array file: memory-mapped where the folder is mounted, else read."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with open_shared(uri) as f:
        return np.frombuffer(f.read(), dtype)


def write_arrays(uri: str, **arrays: np.ndarray) -> None:
    """One flat file for each array, named uri.<key>."""
    for key, a in arrays.items():
        with atomic_file(f"{uri}.{key}") as f:
            buffer = io.BufferedWriter(f, 1 << 20) if isinstance(f, io.RawIOBase) else f
            buffer.write(memoryview(np.ascontiguousarray(a)).cast("B"))
            buffer.flush()


# --- words and hashes ----------------------------------------------------------------------------------------------


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about so many bytes; a longer text is a range of its own."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield lo, hi
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Words:
    """The words of some texts: codes into their distinct words, and each text's number of words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat, at = lists.flatten(), lists.offsets.to_numpy()
        at = at - at[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(full)])
        ends = before[at]
        self.counts = np.diff(ends)
        self.starts = ends[:-1]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    def distinct(self) -> np.ndarray:
        """The distinct words as bytes."""
        return self.vocabulary.cast(pa.binary()).to_numpy(zero_copy_only=False)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, in the order of the texts."""
        return hash_bytes(self.distinct(), seed)[self.codes]


def hash_bytes(values, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in values), U64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words that start at each position, as far as n follow; text ends are not minded here."""
    if len(words) < n:
        return np.empty(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        out = mix(out + words[k : k + len(out)] + U64(0x9E3779B97F4A7C15))
    return out


def inner_positions(counts: np.ndarray, n: int) -> np.ndarray:
    """Positions, in the words of texts laid end to end, at which n words of one text start."""
    starts = np.cumsum(counts) - counts
    inside = np.maximum(counts - n + 1, 0)
    total = int(inside.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(inside) - inside), inside)

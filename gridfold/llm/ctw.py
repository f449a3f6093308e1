"""LM scoring by context-tree weighting over bytes.

A byte is coded by eight binary decisions; each decision has a context tree over the DEPTH bytes before it. A node holds how
often 0 and 1 followed its context; its Krichevsky-Trofimov block probability depends on these counts alone, and so does
the weighted one: half the node's own estimate plus half the product of its children's. So the tree needs no sequential
pass: byte n-grams are counted by all tasks, and the weights are worked out bottom-up from the counts, dealt by the last two
context bytes and streamed in groups of the last three; the two upper levels are 256 contexts and the root.
A prediction mixes the estimates of all depths, each weighted by its posterior.

The end of a text is coded as one more byte (0), and the start is a context of zeros, so probabilities of texts add up to
one. N-grams of texts that are only scored are in the model too, with the counts of training texts.

Documents are read once. A task cuts its rows into chunks, each with at most about HELD distinct n-grams; it writes a chunk's
texts to the shared folder and hands on its distinct n-grams and words with their counts. Scoring goes by chunk: where the
whole model (or vocabulary) has at most MAPPED entries, which is counted first, tasks load it from its files; beyond that,
the chunks' n-grams are joined with it and go back to their chunk. So a task holds a chunk's n-grams or MAPPED entries, however
large the model is. Nothing of the corpus goes through the driver but the levels above two context bytes (65,536 nodes'
sums at most), the list of model files and totals.

Null and empty texts are an end alone. Repeated rows count each. A null doc_id counts as an empty id text in the choice of
held-out rows. An empty training set gives N = 0, V = 0 and a model of even odds; empty tables give no rows. Very long texts
are counted and scored in pieces of SLICE bytes (a word is never cut), the text itself is held whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm._common import U64, Words, atomic_file, bounded_batches, column, hash_bytes, map_shared, materialise, n_shuffle, open_shared, shared_dir, slices, write_arrays

DEPTH = 5
HELD_OUT, PARTS = 2, 7
#: Distinct n-grams of a chunk; bytes of text at a time; entries of a model that tasks load whole (12 bytes each); n-grams of a group in the tree's passes.
HELD, SLICE, MAPPED, GROUP = 1_500_000, 1 << 20, 4_000_000, 300_000
GRAM, WORD, TOKENS, ENDS = 0, 1, 2, 3
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def packed(raw: bytes, depth: int, before: bytes = b"") -> np.ndarray:
    """Each byte with the depth bytes before it as one number: the byte lowest, the one before it next; before: what precedes raw, else zeros."""
    data = np.frombuffer(bytes(8 - len(before)) + before + raw, np.uint8)
    ending = np.ndarray((len(raw),), ">u8", data, 1, (1,))  # the eight bytes that end at each place
    return ending.astype(np.int64) & ((1 << 8 * (depth + 1)) - 1)


def grams(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its context, packed, and how many each text has; lower case, ends included."""
    raws = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary()).to_pylist()
    if not raws:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # after each text its end and, before the next, a context of zeros
    keys = packed(bytes(depth + 1).join(raws) + b"\0", depth)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    starts = np.cumsum(sizes + depth)[:-1]
    keep = np.ones(len(keys), bool)
    keep[(starts[:, None] - 1 - np.arange(depth)).reshape(-1)] = False
    return keys[keep], sizes


def portions(texts: pa.Array, depth: int, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray | None, Words | None]]:
    """Row ranges with their packed bytes, how many of them each row has, and their words. A long text comes in several portions of its one row, bytes (with no words) and words (with no bytes)."""
    for lo, hi in slices(texts, most):
        part = texts.slice(lo, hi - lo)
        if hi - lo > 1 or len(part[0].as_buffer() or b"") <= most:
            yield lo, hi, *grams(part, depth), Words(part, lower=True)
            continue
        raw = pc.ascii_lower(part).cast(pa.large_binary())[0].as_py()
        for at in range(0, len(raw), most):
            piece = raw[at : at + most] + (b"\0" if at + most >= len(raw) else b"")
            keys = packed(piece, depth, raw[max(0, at - depth) : at])
            yield lo, hi, keys, np.array([len(keys)]), None
        at = 0
        while at < len(raw):
            space = _SPACE.search(raw, at + most)
            to = space.start() if space else len(raw)
            yield lo, hi, None, None, Words(pa.array([raw[at:to].decode()], pa.large_string()))
            at = to


def placed(keys: np.ndarray, depth: int) -> np.ndarray:
    """The packed bytes in the order of the tree's passes: by the last two context bytes, then the third, the others, the byte."""
    rest = (1 << 8 * (depth - 3)) - 1
    return (keys >> 8 & 0xFFFF) << 8 * (depth - 1) | (keys >> 24 & 255) << 8 * (depth - 2) | (keys >> 32 & rest) << 8 | keys & 255


def unplaced(places: np.ndarray, depth: int) -> np.ndarray:
    """The packed bytes of a place."""
    rest = (1 << 8 * (depth - 3)) - 1
    return (places >> 8 & rest) << 32 | (places >> 8 * (depth - 2) & 255) << 24 | (places >> 8 * (depth - 1) & 0xFFFF) << 8 | places & 255


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def _factorised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    codes, distinct = pd.factorize(values)
    return codes, np.asarray(distinct)


class _Sum:
    """Counts per key, added up."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def combined(self) -> int:
        """Number of distinct keys, after adding up."""
        if len(self.keys) > 1:
            k, n = _tally(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [k], [n], len(k)
        return self.held


TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


class _Chunk:
    """The file of a chunk's texts, under a number that no other attempt of a task has, and what was counted in it."""

    def __init__(self, folder: str, number: int):
        self.number, self.file = number, atomic_file(f"{folder}/texts-{number}.arrow")
        self.out = pa.ipc.new_stream(self.file.__enter__(), TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.grams, self.words, self.tokens, self.ends = _Sum(), _Sum(), 0, 0

    def close(self, failed: bool = False) -> None:
        self.out.close()
        self.file.__exit__(failed or None, None, None)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.grams.combined(), self.words.combined()
        for kind, keys, counts in ((GRAM, *map(np.concatenate, (self.grams.keys, self.grams.counts))), (WORD, *map(np.concatenate, (self.words.keys, self.words.counts))), (TOKENS, np.zeros(1, np.int64), np.array([self.tokens])), (ENDS, np.zeros(1, np.int64), np.array([self.ends]))):
            for lo in range(0, len(keys), 100_000):
                n = len(keys[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), pa.array(np.full(n, kind, np.int8)), pa.array(keys[lo : lo + n]), pa.array(counts[lo : lo + n])], names=["chunk", "kind", "key", "n"])


def counted(docs: DataFrame, folder: str, depth: int = DEPTH, held: int = HELD, most: int = SLICE) -> DataFrame:
    """Counts by chunk (chunk, kind, key, n): places of n-grams and hashes of words with how often training texts have them, tokens and ends of training texts. Writes the chunks' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunks, now = TaskContext.get().taskAttemptId() << 20, 0, None
        try:
            for batch in batches:
                texts, train = column(batch, "text"), ~column(batch, "held_out").to_numpy(zero_copy_only=False)
                done = 0
                for lo, hi, keys, sizes, words in portions(texts, depth, most):
                    if now is None:
                        now, chunks = _Chunk(folder, base + chunks), chunks + 1
                    elif lo == done and now.grams.held > held and now.grams.combined() > held:
                        now.close()
                        yield from now.rows()
                        now, chunks = _Chunk(folder, base + chunks), chunks + 1
                    own = train[lo:hi]
                    if keys is not None:
                        codes, distinct = _factorised(keys)
                        now.grams.add(placed(distinct, depth), np.bincount(codes, weights=np.repeat(own, sizes), minlength=len(distinct)).astype(np.int64))
                    if words is not None:
                        n = np.bincount(words.codes, weights=np.repeat(own, words.counts), minlength=len(words.vocabulary)).astype(np.int64)
                        now.words.add(hash_bytes(words.distinct()).view(np.int64), n)
                        now.tokens += int(words.counts[own].sum())
                    if lo == done:  # the row range's first portion
                        now.ends += int(own.sum())
                        now.out.write_batch(pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), column(batch, "held_out").slice(lo, hi - lo), pc.fill_null(texts.slice(lo, hi - lo), "")], schema=TEXTS))
                        done = hi
            if now is not None:
                last, now = now, None
                last.close()
                yield from last.rows()
        finally:
            if now is not None:
                now.close(failed=True)

    return docs.mapInArrow(run, "chunk long, kind tinyint, key long, n long")


# --- the trees' arithmetic -------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers, by Stirling's series after a shift upwards."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1.0)


def nodes_of(contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
    """Binary nodes of byte counts: context, prefix (1 to 255: the bits so far after a leading one), zeros, ones."""
    ctx, prefix, bit, n = [], [], [], []
    for k in range(8):
        ctx.append(contexts)
        prefix.append((1 << k) | (symbols >> (8 - k)))
        bit.append((symbols >> (7 - k)) & 1)
        n.append(counts)
    ctx, prefix, bit, n = (np.concatenate(x) for x in (ctx, prefix, bit, n))
    keys, inverse = np.unique(ctx << 8 | prefix, return_inverse=True)
    ones = np.bincount(inverse, weights=n * bit, minlength=len(keys))
    return keys >> 8, keys & 255, np.bincount(inverse, weights=n * (1 - bit), minlength=len(keys)), ones


def up(ctx: np.ndarray, prefix: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logw: np.ndarray, depth: int):
    """The level above: contexts without their oldest byte; counts and the children's log weighted probabilities summed."""
    keys, inverse = np.unique((ctx & ((1 << 8 * depth) - 1)) << 8 | prefix, return_inverse=True)
    total = lambda x: np.bincount(inverse, weights=x, minlength=len(keys))
    return keys >> 8, keys & 255, total(zeros), total(ones), total(logw)


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln weighted probability of nodes, and the posterior weight of a node's own estimate (1 at full depth)."""
    own = log_kt(zeros, ones)
    if children is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def predict_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Level:
    """A level's nodes, sorted by (context, prefix), with what has been mixed down to them: p(1) and the weight left for deeper levels."""

    def __init__(self, keys: np.ndarray, mixed: np.ndarray, left: np.ndarray):
        self.keys, self.mixed, self.left = keys, mixed, left

    def below(self, ctx, prefix, zeros, ones, weight, depth: int) -> Level:
        at = np.searchsorted(self.keys, (ctx & ((1 << 8 * depth) - 1)) << 8 | prefix)
        mixed = self.mixed[at] + self.left[at] * weight * predict_one(zeros, ones)
        return Level(ctx << 8 | prefix, mixed, self.left[at] * (1 - weight))


def gram_logs(level: Level, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each packed n-gram's byte after its context, by the deepest level."""
    out, ctx, symbol = np.zeros(len(keys)), keys >> 8, keys & 255
    for k in range(8):
        at = np.searchsorted(level.keys, ctx << 8 | (1 << k) | (symbol >> (8 - k)))
        p = level.mixed[at]
        out += np.log10(np.where((symbol >> (7 - k)) & 1, p, 1 - p))
    return out


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, to: int):
    """Levels depth..to of the trees of some n-grams, bottom-up: per level (ctx, prefix, zeros, ones, weight), and the sums for the level above."""
    ctx, prefix, zeros, ones = nodes_of(keys >> 8, keys & 255, counts)
    logw, weight = weigh(zeros, ones, None)
    levels = {depth: (ctx, prefix, zeros, ones, weight)}
    for d in range(depth - 1, to - 1, -1):
        ctx, prefix, zeros, ones, below = up(ctx, prefix, zeros, ones, logw, d)
        logw, weight = weigh(zeros, ones, below)
        levels[d] = (ctx, prefix, zeros, ones, weight)
    return levels, up(ctx, prefix, zeros, ones, logw, to - 1)


def top_levels(ctx, prefix, zeros, ones, below) -> dict[int, Level]:
    """Levels 1 and 0 from the sums below level 1, and what they mix: a Level for depth 1."""
    logw1, weight1 = weigh(zeros, ones, below)
    c0, p0, z0, o0, b0 = up(ctx, prefix, zeros, ones, logw1, 0)
    _, weight0 = weigh(z0, o0, b0)
    root = Level(c0 << 8 | p0, weight0 * predict_one(z0, o0), 1 - weight0)
    return root.below(ctx, prefix, zeros, ones, weight1, 0)


def groups(batches: Iterator[pa.RecordBatch], depth: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and counts of whole last-three-byte contexts, several at a time, from batches in order of places."""
    places, counts, held = [], [], 0
    for batch in batches:
        places.append(column(batch, "place").to_numpy())
        counts.append(column(batch, "n").to_numpy())
        held += len(places[-1])
        if held > most:
            p, n = np.concatenate(places), np.concatenate(counts)
            third = p >> 8 * (depth - 2)
            cut = int(np.searchsorted(third, third[-1]))
            if cut:
                yield p[:cut], n[:cut]
            places, counts, held = [p[cut:]], [n[cut:]], len(p) - cut
    if held:
        yield np.concatenate(places), np.concatenate(counts)


def build(gram_counts: DataFrame, folder: str, depth: int = DEPTH) -> DataFrame:
    """The model: part, n of its files (sorted places, log10 probabilities; folder/model-<part>) from places and counts.

    Contexts of the last two bytes are dealt to tasks, which work bottom-up for what the upper levels need and keep their
    n-grams and second level in files; a second pass over these files works top-down.
    """
    spark = gram_counts.sparkSession
    parts = n_shuffle(spark)
    dealt = gram_counts.select(F.col("key").alias("place"), "n").withColumn("pair", F.shiftright("place", 8 * (depth - 1)))
    dealt = dealt.repartition(parts, "pair").sortWithinPartitions("place").select("place", "n")
    pairs = pa.schema([("place", pa.int64()), ("n", pa.int64())])
    sums = pa.schema([("part", pa.int64()), ("ctx", pa.int64()), ("prefix", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())])

    def bottom_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().taskAttemptId()  # files of one attempt belong together
        found = []
        with atomic_file(f"{folder}/grams-{number}.arrow") as f, pa.ipc.new_stream(f, pairs, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:

            def copied() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out.write_batch(batch)
                    yield batch

            for places, counts in groups(copied(), depth):
                _, above = subtree(unplaced(places, depth), counts, depth, 3)
                found.append(above)
        if found:
            ctx, prefix, zeros, ones, below = (np.concatenate(x) for x in zip(*found, strict=True))
            ctx, prefix, zeros, ones, below = up(ctx, prefix, zeros, ones, below, 2)  # groups that share two bytes
            write_arrays(f"{folder}/second-{number}", ctx=ctx, prefix=prefix, zeros=zeros, ones=ones, below=below)
            logw, _ = weigh(zeros, ones, below)
            above = up(ctx, prefix, zeros, ones, logw, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(above[0]), number)), *map(pa.array, above)], schema=sums)

    partial = materialise(dealt.mapInArrow(bottom_up, "part long, ctx long, prefix long, zeros double, ones double, below double"), f"{folder}/level1")
    level1 = partial.groupBy("ctx", "prefix").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    level1 = level1.orderBy("ctx", "prefix").toArrow()  # 256 contexts of 255 prefixes at most
    top = top_levels(*(level1.column(c).to_numpy() for c in ("ctx", "prefix", "zeros", "ones", "below")))
    model = pa.schema([("part", pa.int64()), ("n", pa.int64())])

    def top_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in column(batch, "part").to_pylist():
                names = ("ctx", "prefix", "zeros", "ones", "below")
                ctx, prefix, zeros, ones, below = (np.asarray(map_shared(f"{folder}/second-{part}.{c}", "<i8" if k < 2 else "<f8")) for k, c in enumerate(names))
                second = top.below(ctx, prefix, zeros, ones, weigh(zeros, ones, below)[1], 1)
                total = 0
                with open_shared(f"{folder}/grams-{part}.arrow") as f, atomic_file(f"{folder}/model-{part}.keys") as keys, atomic_file(f"{folder}/model-{part}.logs") as logs:
                    for places, counts in groups(iter(pa.ipc.open_stream(f)), depth):
                        own = unplaced(places, depth)
                        levels, _ = subtree(own, counts, depth, 3)
                        level = second
                        for d in range(3, depth + 1):
                            level = level.below(*levels[d], d - 1)
                        keys.write(places.astype("<i8").tobytes())
                        logs.write(gram_logs(level, own).astype("<f4").tobytes())
                        total += len(places)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total])], schema=model)

    files = partial.select("part").distinct()
    return materialise(files.repartition(parts, "part").mapInArrow(top_down, "part long, n long"), f"{folder}/model")


def entries(files: DataFrame, folder: str) -> DataFrame:
    """The model's entries (key, value), from its files."""
    schema = pa.schema([("key", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in column(batch, "part").to_pylist():
                keys, logs = map_shared(f"{folder}/model-{part}.keys", "<i8"), map_shared(f"{folder}/model-{part}.logs", "<f4")
                for lo in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(logs[lo : lo + 100_000].astype(np.float64))], schema=schema)

    return files.mapInArrow(run, "key long, value double")


def loaded(folder: str, name: str, parts: list[int], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the files of a small model, sorted; kept for the tasks that a process runs one after another."""
    known = _LOADED.get((folder, name))
    if known is None:
        keys = [np.asarray(map_shared(f"{folder}/{name}-{p}.keys", "<i8")) for p in parts]
        values = [np.asarray(map_shared(f"{folder}/{name}-{p}.logs", kind)) for p in parts]
        k, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, values))
        order = np.argsort(k)
        for old in [x for x in _LOADED if x[0] != folder]:
            del _LOADED[old]
        known = _LOADED[folder, name] = (k[order], v[order])
    return known


_LOADED: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}


def written(words: DataFrame, folder: str) -> DataFrame:
    """Files (part, n; folder/words-<part>) of word hashes and counts."""
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            keys.append(column(batch, "key").to_numpy())
            counts.append(column(batch, "n").to_numpy())
        part, k, n = TaskContext.get().taskAttemptId(), np.concatenate(keys), np.concatenate(counts)
        write_arrays(f"{folder}/words-{part}", keys=k, logs=n)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(k)])], schema=schema)

    return materialise(words.mapInArrow(run, "part long, n long"), f"{folder}/words-files")


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    """The values of some keys in a sorted table, the default where it has none."""
    if not len(known):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], default)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])


def score(docs: DataFrame, *, depth: int = DEPTH, held: int = HELD, most: int = SLICE, mapped: int = MAPPED) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (code length, the end counted as a byte).

    docs needs doc_id and text. depth: at least 3, at most 6.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "ctw")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    rows = materialise(counted(docs, folder, depth, held, most), f"{folder}/counts")
    totals = {r.kind: r.n for r in rows.filter(F.col("kind") >= TOKENS).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    total, ends = totals.get(TOKENS, 0) + totals.get(ENDS, 0), totals.get(ENDS, 0)
    files = build(rows.filter(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")), folder, depth)
    words = rows.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0")
    words = materialise(words, f"{folder}/words")
    n_words, n_grams = words.count(), files.agg(F.sum("n")).first()[0] or 0
    distinct = n_words + (ends > 0)
    whole_grams, whole_words = n_grams <= mapped, n_words <= mapped
    gram_parts = [r.part for r in files.collect()] if whole_grams else []  # a list of files that hold MAPPED entries at most
    word_parts = [r.part for r in written(words, folder).collect()] if whole_words else []
    even, below = 8 * math.log10(0.5), math.log10(total + distinct + 1)

    def scored(chunk: int, places: np.ndarray, logs: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        with open_shared(f"{folder}/texts-{chunk}.arrow") as f:
            for batch in pa.ipc.open_stream(f):
                n = batch.num_rows
                base, own, tokens, known, size = np.full(n, math.log10(ends + 1) - below), np.zeros(n), np.ones(n, np.int64), np.full(n, int(ends > 0)), np.zeros(n, np.int64)
                for lo, hi, keys, sizes, w in portions(column(batch, "text"), depth, most):
                    if keys is not None:
                        codes, some = _factorised(keys)
                        found = looked_up(placed(some, depth), places, logs, even)[codes]
                        own[lo:hi] += np.add.reduceat(found, np.cumsum(sizes) - sizes)
                        size[lo:hi] += sizes
                    if w is not None:
                        c = looked_up(hash_bytes(w.distinct()).view(np.int64), hashes, counts, 0)
                        per = np.concatenate([[0.0], np.cumsum((np.log10(c + 1) - below)[w.codes])])
                        seen = np.concatenate([[0], np.cumsum((c > 0)[w.codes])])
                        first, last = w.starts, w.starts + w.counts
                        base[lo:hi] += per[last] - per[first]
                        known[lo:hi] += seen[last] - seen[first]
                        tokens[lo:hi] += w.counts
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(own), pa.array(size - 1), pa.array(own / -math.log10(2) / size)], schema=SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, then kind, then key; each chunk has its row of tokens last."""
        held_keys: dict[int, list] = {GRAM: [], WORD: []}
        held_values: dict[int, list] = {GRAM: [], WORD: []}
        model = loaded(folder, "model", gram_parts, "<f4") if whole_grams else None
        vocabulary = loaded(folder, "words", word_parts, "<i8") if whole_words else None

        def table(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, values = held_keys[kind], held_values[kind]
            out = (np.concatenate(keys), np.concatenate(values)) if keys else (np.empty(0, np.int64), np.empty(0))
            held_keys[kind], held_values[kind] = [], []
            return out

        for batch in batches:
            chunk, kind, key, value = (column(batch, c).to_numpy() for c in ("chunk", "kind", "key", "value"))
            at = np.flatnonzero(np.diff(chunk.astype(np.int64) * 4 + kind, prepend=-1))
            for lo, hi in zip(at, np.append(at[1:], len(chunk)), strict=True):
                if kind[lo] == TOKENS:
                    yield from scored(int(chunk[lo]), *(model or table(GRAM)), *(vocabulary or table(WORD)))
                else:
                    held_keys[kind[lo]].append(key[lo:hi].copy())
                    held_values[kind[lo]].append(value[lo:hi].copy())

    asked = rows.filter(F.col("kind") == TOKENS).select("chunk", "kind", "key", F.lit(0.0).alias("value"))
    if not whole_grams:
        asked = asked.unionByName(rows.filter(F.col("kind") == GRAM).select("chunk", "kind", "key").join(entries(files, folder), "key"))
    if not whole_words:
        asked = asked.unionByName(rows.filter(F.col("kind") == WORD).select("chunk", "kind", "key").join(words.select("key", F.col("n").cast("double").alias("value")), "key"))
    asked = asked.repartition(n_shuffle(spark), "chunk").sortWithinPartitions("chunk", "kind", "key")
    return asked.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")

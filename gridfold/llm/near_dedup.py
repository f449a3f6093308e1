"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence), as 64-bit hashes. The sketch
has T coordinates. Round i < T throws every shingle into a hashed bin with the value i plus a hash; round i >= T throws all
shingles into bin i - T; a document stops after the round in which its last bin was filled, so every coordinate is filled
and a coordinate of two documents agrees with the probability of their similarity, concentrated as for independent
coordinates. A byte of each coordinate is kept. BANDS bands of ROWS coordinates are the buckets: at a similarity of 0.85 a
pair shares no bucket with probability (1 - 0.85^10)^70 < 3e-7; at 0.5 it shares one with probability 0.07.

Nodes are distinct texts. Texts of equal sets are a class: one of them stands in the buckets, the others are verified
against it. Pairs of a bucket are not all emitted:

1. every member of a bucket is verified against one member, and found links are contracted to components;
2. in buckets whose components still differ, members of different components compare their sketches, in blocks of bounded
   size; members of a bucket's largest component meet only those outside it. Pairs whose agreement is so low that a linked
   pair would have it with probability below MISS (the sketch's concentration bound) end there. While these are many, every
   member gives only its best partner in some of the bands, and the links found are contracted again;
3. what is left is emitted once, at the first band that the pair shares, and verified on the full sets.

Of buckets with the same members only the first is looked at. So a bucket of many copies costs a comparison per member, no
bucket is cut, and only texts that are nearly similar enough but lie in different components are emitted as pairs. The
comparison of sketches is quadratic in the members of one bucket that lie in different components, outside the largest.

Null texts and texts without words have empty sets and link with nothing. Rows that share a doc_id are one document: what
any of its texts links with, it is linked with. A row without doc_id links with nothing and stays. Empty tables give no
rows. Hot buckets and classes: minima and counts are combined by the tasks before the exchange, and joins keep the many rows
on the side that Spark can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm._common import U64, Words, bounded_batches, column, gram_hashes, materialise, mix, shared_dir, slices
from gridfold.operators.components import components

SHINGLE, BANDS, ROWS = 5, 70, 10
SIMILARITY = 85
#: A bucket's number is its band in the upper bits, 56 bits of its hash below.
MOST_BANDS, BUCKET_BITS = 128, 56
#: Probability with which a linked pair's sketches may agree so little that it is not verified.
MISS = 1e-7
#: Members of a block of a bucket; sketches that are compared at a time; pairs, as a multiple of the open buckets' members, from which members first give their best partner only; rounds of that, each in one of so many bands.
BLOCK, AT_ONCE, BEST_OVER, BEST_ROUNDS, BEST_BANDS = 1024, 16_384, 8, 2, 4
#: Rows that a task should have at least, where tables are light; pairs of texts.
ROWS_PER_TASK, PAIRS_PER_TASK = 50_000, 4_000


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams = gram_hashes(hashes, n)
    out = []
    for start, count in zip(words.starts.tolist(), words.counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(grams[start : start + count - n + 1]))
        else:
            out.append(gram_hashes(hashes[start : start + count], count) if count else np.empty(0, U64))
    return out


def fast_similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t filled coordinates for every set; sets must not be empty."""
    unfilled = ~U64(0)
    sketch = np.full((len(sets), t), unfilled, U64)
    flat = sketch.reshape(-1)
    items = np.concatenate(sets) if sets else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    low = U64(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + mix(np.array([i + 1], U64)))
        bins = (h >> U64(32)) % U64(t) if i < t else np.full(len(h), i - t, U64)
        np.minimum.at(flat, owner * t + bins.astype(np.int64), (U64(i) << U64(32)) | (h & low))
        if i < 4 or i % 8 == 7 or i >= t:
            # within these rounds a filled document would only meet larger values: minima don't change
            open_ = (sketch == unfilled).any(axis=1)[owner]
            items, owner = items[open_], owner[open_]
    return sketch


def least_agreement(t: int, similarity: float, miss: float = MISS) -> int:
    """Coordinates of t that two sets of this similarity agree in at least, but for a probability of miss (Chernoff's bound)."""
    for k in range(int(similarity * t), 0, -1):
        x = k / t
        if t * (x * math.log(x / similarity) + (1 - x) * math.log((1 - x) / (1 - similarity))) > -math.log(miss):
            return k
    return 0


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the text), n_shingles, a 128-bit digest of the set (c1, c2), and the sketch's bytes; null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, texts = column(batch, "doc_id"), column(batch, "key"), column(batch, "text")
            for lo, hi in slices(texts):
                sets = shingle_sets(texts.slice(lo, hi - lo), n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                some = [sets[k] for k in full]
                low = fast_similarity_sketch(some, bands * rows).astype(np.uint8)
                sketches: list[bytes | None] = [None] * len(sets)
                digest = np.zeros((2, len(sets)), U64)
                if some:
                    items, starts = np.concatenate(some), np.cumsum(sizes[full]) - sizes[full]
                    digest[0, full] = np.add.reduceat(mix(items), starts)
                    digest[1, full] = np.add.reduceat(mix(items ^ U64(0xD6E8FEB86659FD93)), starts)
                    for k, sketch in zip(full.tolist(), low, strict=True):
                        sketches[k] = sketch.tobytes()
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(sketches, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, c1 long, c2 long, sketch binary")


def few(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The table in as many tasks as its rows need, at most as many as it has."""
    return df.coalesce(max(8, rows // per_task))


def verified(pairs: DataFrame, n_pairs: int, texts: DataFrame, similarity: int, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = column(batch, "text_a").dictionary_encode(), column(batch, "text_b").dictionary_encode()
            sets_a, sets_b = shingle_sets(a.dictionary, n), shingle_sets(b.dictionary, n)
            keep = []
            for x, y in zip(a.indices.to_pylist(), b.indices.to_pylist(), strict=True):
                x, y = sets_a[x], sets_b[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = few(few(pairs.join(side("b"), "b"), n_pairs, PAIRS_PER_TASK).join(side("a"), "a").select("a", "b", "text_a", "text_b"), n_pairs, PAIRS_PER_TASK)
    return both.mapInArrow(run, "a long, b long")


def open_buckets(labelled: DataFrame) -> DataFrame:
    """The members of buckets with several components, with the bucket's figures: n, pairs (of different components, per member), out (members outside the largest component, top)."""
    per = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    per = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max(F.struct("n", "component")).alias("top")).filter("top.n < n")
    per = per.select("bucket", "n", F.col("top.component").alias("top"), (F.col("n") - F.col("top.n")).alias("out"), ((F.col("n") * F.col("n") - F.col("squares")) / 2 / F.col("n")).alias("pairs"))
    return labelled.join(per, "bucket")


def in_blocks(members: DataFrame) -> DataFrame:
    """The members of open buckets, once for each pair of blocks (lo, hi) in which they meet others.

    A small bucket is one block. In a larger one, those outside the largest component are dealt over blocks 0 to few - 1 and
    meet all blocks; those in it are dealt over the blocks from few on and meet only the former.
    """
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    few, many = number(F.col("out")), number(F.col("n") - F.col("out"))
    dealt = F.xxhash64("node", F.lit(1))
    largest, small = F.col("component") == F.col("top"), F.col("n") <= BLOCK
    block = F.when(small, 0).when(largest, few + F.pmod(dealt, many)).otherwise(F.pmod(dealt, few)).cast("int")
    meets = F.sequence(F.lit(0), F.when(small, 1).when(largest, few).otherwise(few + many) - 1)
    met = members.withColumn("block", block).withColumn("with", F.explode(meets))
    return met.select("bucket", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "size", "component", "sketch")


def compared(members: DataFrame, sketches: DataFrame, best: bool, least: int, similarity: int, bands: int, rows: int) -> DataFrame:
    """Pairs (a, b) of members of an open bucket that lie in different components and agree in at least so many coordinates: each member's best in its block, or all, each once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole groups."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table)
                if starts[-1]:
                    yield table.slice(0, int(starts[-1]))
                    table = table.slice(int(starts[-1]))
                held, n = table.to_batches(), table.num_rows
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            block, size, of, node, bucket = (table[c].to_numpy() for c in ("block", "size", "component", "node", "bucket"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, bands * rows)
            band = bucket >> BUCKET_BITS
            starts = _starts(table)
            ends = np.append(starts[1:], table.num_rows)
            found: list[np.ndarray] = []
            for i, j in _meetings(starts, ends, block, of, size, similarity):
                same = sketch[i] == sketch[j]
                agreed = same.sum(axis=1)
                ok = np.flatnonzero(agreed >= least)
                if not best and len(ok):
                    # a pair is emitted at the first band that it shares
                    ok = ok[same[ok].reshape(len(ok), bands, rows).all(axis=2).argmax(axis=1) == band[i[ok]]]
                found.append(np.stack([i[ok], j[ok], agreed[ok]]))
            i, j, agreed = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            if best and len(i):
                at, to, by = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agreed, agreed])
                order = np.lexsort((to, -by, at))
                first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
                i, j = at[first], to[first]
            if len(i):
                a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    keys = ("bucket", "lo", "hi")
    placed = in_blocks(members.join(sketches, "node")).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "a long, b long")


def _starts(table: pa.Table) -> np.ndarray:
    """First rows of the groups of a sorted table."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("bucket", "lo", "hi"):
        v = table[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _meetings(starts: np.ndarray, ends: np.ndarray, block: np.ndarray, of: np.ndarray, size: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) to compare, some at a time: of one group, different components and sizes that allow a link, and of different blocks where a group has two."""
    two = np.maximum.reduceat(block, starts) > np.minimum.reduceat(block, starts)
    end_of, mixed = np.repeat(ends, ends - starts), np.repeat(two, ends - starts)
    after = end_of - np.arange(len(of)) - 1
    total = np.cumsum(after)
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (of[i] != of[j]) & (100 * small >= similarity * large) & (~mixed[i] | (block[i] != block[j]))
        if ok.any():
            yield i[ok], j[ok]
        lo = hi


def near_dedup(docs: DataFrame, *, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. docs needs doc_id and text.

    similarity: least 100 * |intersection| / |union| of linked documents. Below 80, choose more bands of fewer rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "near-dedup")
    if bands > MOST_BANDS:
        raise ValueError(f"at most {MOST_BANDS} bands")
    least = least_agreement(bands * rows, similarity / 100)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))
    sketches = materialise(sketched(docs, bands, rows, n), f"{folder}/sketches")
    known = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a number for each distinct text, fixed as it is written
    texts_of = known.groupBy("key", "c1", "c2", "n_shingles").agg(F.min("doc_id").alias("doc")).withColumn("node", F.monotonically_increasing_id())
    texts_of = materialise(texts_of, f"{folder}/texts-of")
    classes = texts_of.groupBy("c1", "c2", "n_shingles").agg(F.min(F.struct("doc", "node", "key")).alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes.select("c1", "c2", "n_shingles", "n", F.col("rep.doc").alias("doc_id"), "rep.node", "rep.key"), f"{folder}/classes")
    reps = known.select("doc_id", "key", "n_shingles", "sketch").join(classes.select("doc_id", "key", "node"), ["doc_id", "key"])
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(F.substring("sketch", i * rows + 1, F.lit(rows)), i), 64 - BUCKET_BITS)
    bucket = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: hashed(i).bitwiseOR(F.shiftleft(i.cast("long"), BUCKET_BITS)))
    members = reps.select("node", F.col("n_shingles").cast("int").alias("size"), F.explode(bucket).alias("bucket"))
    # counted where the members are dealt by bucket, so that they are dealt once
    shared = members.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1").drop("n")
    members = materialise(shared.dropDuplicates(["bucket", "node"]), f"{folder}/shared")
    n_members = members.count()
    # of buckets with the same members, that of the first band is enough
    alike_buckets = few(members, n_members).groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first_buckets = few(alike_buckets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), n_members)
    members = materialise(few(members.join(first_buckets, "bucket", "left_semi"), n_members), f"{folder}/members")
    n_members = members.count()
    # a row per node: what is known of a node is joined once, not once per bucket
    node_buckets = materialise(few(members, n_members).groupBy("node", "size").agg(F.collect_list("bucket").alias("buckets")), f"{folder}/node-buckets")
    centres = members.groupBy("bucket").agg(F.min("node").alias("b"))

    alike = texts_of.join(classes.filter("n > 1").select("c1", "c2", "n_shingles", F.col("node").alias("b")), ["c1", "c2", "n_shingles"]).filter("node <> b").select(F.col("node").alias("a"), "b")
    alike = few(materialise(alike, f"{folder}/alike"), n_members)
    nodes = node_buckets.select("node")
    wanted = nodes.unionByName(alike.select(F.col("a").alias("node"))).unionByName(alike.select(F.col("b").alias("node"))).distinct()
    wanted = texts_of.join(wanted, "node", "left_semi").select(F.col("doc").alias("doc_id"), "key", "node")
    texts = materialise(docs.join(wanted, ["doc_id", "key"]).select("node", "text"), f"{folder}/texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():  # rows repeated with their doc_id
        texts = materialise(texts.dropDuplicates(["node"]), f"{folder}/texts-once")
    sketched_nodes = classes.join(nodes, "node", "left_semi").select("doc_id", "key", "node")
    member_sketches = materialise(sketches.select("doc_id", "key", "sketch").join(sketched_nodes, ["doc_id", "key"]).select("node", "sketch").dropDuplicates(["node"]), f"{folder}/member-sketches")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(pairs.distinct(), f"{folder}/pairs-{name}")
        return materialise(verified(pairs, pairs.count(), texts, similarity, n), f"{folder}/links-{name}")

    stars = members.select("bucket", F.col("node").alias("a")).join(centres, "bucket").filter("a <> b").select("a", "b")
    links = check(few(stars, n_members).unionByName(alike), "star")
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not repeated.isEmpty():  # rows of one doc_id are one document
        texts_of_doc = known.join(repeated, "doc_id", "left_semi").select("doc_id", "key").join(texts_of.select("key", F.col("node").alias("a")), "key")
        least_of_doc = texts_of_doc.groupBy("doc_id").agg(F.min("a").alias("b"))
        links = links.unionByName(materialise(texts_of_doc.join(least_of_doc, "doc_id").filter("a <> b").select("a", "b").distinct(), f"{folder}/links-doc"))
    found = None
    for step in range(BEST_ROUNDS + 1):
        found = _grown(found, links, f"{folder}/components-{step}")
        labelled = node_buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")) if found is not None else node_buckets.withColumn("component", F.col("node"))
        labelled = labelled.select("node", "size", "component", F.explode("buckets").alias("bucket"))
        open_ = materialise(open_buckets(few(labelled, n_members)), f"{folder}/open-{step}")
        n_open, n_pairs = open_.agg(F.count("*"), F.sum("pairs")).first()
        links = None
        if not n_open:
            break
        whole = step == BEST_ROUNDS or n_pairs <= BEST_OVER * n_open
        of_round = open_.filter(F.shiftright("bucket", BUCKET_BITS) % BEST_BANDS == step)
        agree = lambda best: compared(of_round if best else open_, member_sketches, best, least, similarity, bands, rows)  # noqa: B023, E731
        links = check(agree(not whole), f"{step}")
        if not whole and links.isEmpty():
            links, whole = check(agree(False), f"{step}-all"), True
        if whole:
            break
    if links is not None:
        found = _grown(found, links, f"{folder}/components")
    labels = texts_of.select("key", "node", F.col("doc").alias("label"))
    if found is not None:
        of = found.join(texts_of.select("node", "doc"), "node")
        of = of.join(of.groupBy("component").agg(F.min("doc").alias("least")), "component").select("node", "least")
        labels = labels.join(of, "node", "left").withColumn("label", F.coalesce("least", "label"))
    whole = sketches.select("doc_id", "n_shingles", "key").join(labels.select("key", "label"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grown(found: DataFrame | None, links: DataFrame, folder: str) -> DataFrame | None:
    """The components of what was found and new links; None without any."""
    if links.isEmpty():
        return found
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links, folder)

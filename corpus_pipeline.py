"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next stage's docs. All stages but the last return the columns of docs.
A stage's decisions take effect: documents that it rejects are gone for the next.

Nulls, empty and long texts, ties, repeated rows and empty tables: as the operators define. The first three stages decide
on rows: where doc_id is null or repeated, rows get numbers in the order of doc_id (null last) and text, the operator sees
these instead, and a row follows its own verdict. Of rows that are alike in everything one stays in exact dedup. Columns of
docs may have any names. A mix repeats rows; packing then packs each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from gridfold.llm._common import materialise, n_shuffle, shared_dir
from gridfold.llm.queries import tokenizer_path

#: Similarity of near copies in the corpus, in hundredths; a pair at 0.80 shares no band with probability (1 - 0.8^10)^110 < 4e-6.
NEAR, NEAR_BANDS, NEAR_ROWS = 80, 110, 10


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that is different for every row and ascends with doc_id: doc_id itself, where it is a key."""
    key = _fresh(docs, "row")
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.filter("id IS NULL").isEmpty() and ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    order = (F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256))
    placed = docs.repartitionByRange(n_shuffle(spark), *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
    return materialise(placed, f"{shared_dir(spark, 'numbered')}/rows"), key


def _seen(rows: DataFrame, key: str) -> DataFrame:
    """What an operator sees of the rows, under their numbers."""
    return rows.select(F.col(key).alias("doc_id"), "text", "lang", "source")


def _kept(rows: DataFrame, key: str, verdicts: DataFrame) -> DataFrame:
    kept = verdicts.filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows, key = _numbered(spark, docs)
    return _kept(rows, key, quality_rules.quality_rules(_seen(rows, key))).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts that with the most code points stays, then that with the smallest doc_id."""
    rows, key = _numbered(spark, docs)
    return _kept(rows, key, exact_dedup.exact_dedup(_seen(rows, key))).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    rows, key = _numbered(spark, docs)
    return _kept(rows, key, near_dedup.near_dedup(_seen(rows, key), similarity=NEAR, bands=NEAR_BANDS, rows=NEAR_ROWS)).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them, in whole copies: the part of a copy counts as one from half its words on."""
    rows, key = _numbered(spark, docs)
    taken, _ = mixing.mix(_seen(rows, key), F.array("source"))
    copies, copy = _fresh(rows, "copies"), _fresh(rows, "copy")
    times = taken.filter("taken > 0").select(F.col("doc_id").alias(key), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies)).filter(F.col(copies) > 0)
    return rows.join(times, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of near-equal length: one row per piece, with its ids' checksum."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the robust estimates nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs

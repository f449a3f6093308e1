"""Exact dedup by skew-safe combining: locally, then by salted digest groups, then across salts.

Texts are equal when they are identical without white space. Every stage groups by the digest and by the whole content, so
two contents under one digest never merge. A task first combines its own rows (the partial aggregate before the exchange),
so that a group of copies sends one row per task however large it is; the salt then spreads a digest over several tasks,
and its salt winners meet last. Rows find their winner by a join on the digest, whose side of documents can be split where
a digest is hot; the other side has one row per digest.

Of equal texts the row with the most code points in its text stays, then the smallest doc_id. Null texts count as empty and
equal all texts without content. A null doc_id counts after all others. Repeated rows form groups like any copies (rows of
one doc_id are each reported). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm._common import SPACE, materialise, n_shuffle, shared_dir

SALTS = 16
#: Doc ids are 64-bit, so a rank of code points and then ids fits a decimal: points * 10^20 + (2^63 - 1 - doc_id).
_LAST = 9223372036854775807
_DECIMAL = "decimal(38,0)"


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _rank(points: Column, doc_id: Column) -> Column:
    ids = F.lit(_LAST).cast(_DECIMAL) - F.coalesce(doc_id, F.lit(_LAST)).cast(_DECIMAL)
    return (points.cast(_DECIMAL) * F.lit("100000000000000000000").cast("decimal(21,0)") + ids.cast("decimal(20,0)")).cast(_DECIMAL)


def exact_dedup(docs: DataFrame, *, salts: int = SALTS, digest=lambda c: F.sha2(c, 256)) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. docs needs doc_id and text."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "exact-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(F.col("text")).alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("points")).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    ranked = rows.select("digest", "content", salt.alias("salt"), _rank(F.col("points"), F.col("doc_id")).alias("rank"))
    salted = ranked.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("size"))
    whole = salted.repartition(n_shuffle(spark), "digest").groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))
    # a digest's contents: one, unless they collide; then the contents are kept to tell them apart
    contents = whole.groupBy("digest").agg(F.count("*").alias("contents"), F.max("rank").alias("rank"), F.max("size").alias("size"))
    groups = materialise(contents, f"{folder}/groups")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(F.col("text")).alias("content")).select("doc_id", "content", digest(F.col("content")).alias("digest"))
    plain = light.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")).join(groups.filter("contents = 1"), "digest")
    found = plain
    if not groups.filter("contents > 1").isEmpty():
        torn = groups.filter("contents > 1").select("digest")
        parts = materialise(whole.join(torn, "digest", "left_semi"), f"{folder}/torn")
        found = plain.select("doc_id", "text_sha256", "rank", "size").unionByName(light.join(parts, ["digest", "content"]).select("doc_id", F.sha2("content", 256).alias("text_sha256"), "rank", "size"))
    scale = F.lit("100000000000000000000").cast("decimal(21,0)")
    keep = (F.lit(_LAST).cast("decimal(20,0)") - (F.col("rank") % scale).cast("decimal(20,0)")).cast("long")
    return found.select("doc_id", F.when(keep != _LAST, keep).alias("keep_id"), F.col("size").alias("group_size"), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

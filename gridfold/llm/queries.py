"""The subpackage's registered queries, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import ctw, exact_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_files, warc
from gridfold.llm._common import shared_dir


def tokenizer_path() -> str:
    """The word vocabulary's file, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.classify(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    bundles = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(spark, bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write(documents(spark, sf_dir), folder, tokenizer_path())
    return token_files.read(spark, folder)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, sources = mixing.mix(documents(spark, sf_dir), F.array("source"))
    goals = spark.createDataFrame([(k, int(n), round(t, 6)) for k, (n, t) in sources.items()], "source string, source_size long, target double")
    return taken.join(F.broadcast(goals), F.col("sources")[0].eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body, length(coalesce(text, '')) AS points FROM documents),
        g AS (SELECT body, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (payload_digest)""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))) AS seeded FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3.0 * n AS cap, sum(n) OVER () AS total FROM s),
        r AS (SELECT *, cap / weight AS ratio,
                     (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM w),
        u AS (SELECT min_by(unit, ratio) FILTER (WHERE unit <= ratio) AS unit FROM r),
        t AS (SELECT r.source, n, CAST(CASE WHEN ratio < u.unit THEN cap ELSE weight * u.unit END AS DOUBLE) AS target FROM r, u),
        q AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
        o AS (SELECT d.*, n, target, quota // greatest(n, 1) AS whole, quota % greatest(n, 1) AS rest,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY seeded, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, n AS source_size, round(target, 6) AS target, CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM o""",
    "op10_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM v),
        r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
        x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
        k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END AS kept FROM d LEFT JOIN x USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
}

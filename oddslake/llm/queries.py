"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.llm import (
    exact_dedup, kneser_ney, max_sketch, mixing, ngram_join, pu_quality, quality_rules, secret_scan, sharding, stable_search, surrogates, vector_packing,
    whitening,
)
from oddslake.llm.common import documents, held_out, with_package
from oddslake.session import prepare as settings


#: Key of the registered query; a run on real data brings a secret one.
SURROGATE_KEY = b"registered query"


def prepare(spark: SparkSession) -> SparkSession:
    return with_package(settings(spark))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneser_ney.learn_and_score(documents(prepare(spark), sf_dir), ~held_out("doc_id", 7))
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(prepare(spark), sf_dir))


def op3_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.scan_secrets(documents(prepare(spark), sf_dir))
    base = F.concat("assign", "access", "hex")
    return spans.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.concat(base, "random")).alias("spans"),
    )


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace_private(documents(prepare(spark), sf_dir), SURROGATE_KEY)
    kinds = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), kinds.alias("entities"))


def op5_dot_product_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(documents(prepare(spark), sf_dir))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_size(documents(prepare(spark), sf_dir), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = pu_quality.classify(documents(spark, sf_dir), labels, ~held_out("doc_id", 4))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(prepare(spark), sf_dir))


def op9_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(documents(prepare(spark), sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(documents(prepare(spark), sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(documents(prepare(spark), sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return stable_search.nearest(vectors, F.col("vec_id") % 50 == 0)


def op13_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney, op2_patricia_owners, op3_randomness_battery, op4_surrogates, op5_dot_product_packing,
        op6_minimax_shards, op7_positive_unlabelled, op8_partition_join, op9_flow_mixing, op10_covariance_outliers,
        op11_max_sketches, op12_stable_projections, op13_bit_sliced_whitening,
    )
}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: SQL that must give the rows of a query. The others draw on hashes, models or random choices.
SQL: dict[str, str] = {
    "op2_patricia_owners": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op8_partition_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op11_max_sketches": f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s), t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN s USING (doc_id), g GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r QUALIFY rank <= 10""",
}

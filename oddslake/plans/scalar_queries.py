"""Scalar helpers over text forms derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.functions import casefold, fingerprint, instant, json_list, nfkc, number, probability, to_epoch
from oddslake.plans.registry import Query, json_text, table, text

SUFFIX = ["", "d", "e1", " ", "x", "_0", "e400"]
ZONES = ["Z", "+00:00", "-05:30", "", "+0200", " junk"]


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as landed text: plain, with type letters, exponents, blanks, underscores."""
    form = F.element_at(F.array(*[F.lit(s) for s in SUFFIX]), (F.col("event_id") % len(SUFFIX) + 1).cast("int"))
    landed = F.concat(F.when(F.col("user_id") % 2 == 0, "").otherwise("0"), (F.col("value") / 512 + 0.001).cast("string"), form)
    rows = table(spark, sf_dir, "events").select("event_id", landed.alias("t"))
    return rows.select("event_id", number(F.col("t")).alias("number"), probability(F.col("t")).alias("probability"))


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("o_orderkey") % len(ZONES) + 1).cast("int"))
    landed = F.when(F.col("o_custkey") % 10 == 0, text("o_custkey")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", landed.alias("t"))
    return rows.select("o_orderkey", to_epoch(F.col("t")).alias("epoch"), F.date_format(instant(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("event_id") % 4
    landed = F.when(form == 0, F.concat(F.lit('["a", null, '), text("user_id"), F.lit("]"))).when(form == 1, F.col("props")).when(form == 2, F.lit("invalid")).otherwise("[]")
    items = json_list(landed)
    return table(spark, sf_dir, "events").select("event_id", F.size(items).alias("items"), F.get(items, 2).alias("third"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal records written with different key order share one fingerprint."""
    k = F.get_json_object("props", "$.k")
    user = (F.col("user_id") % 3).cast("string")
    nested = lambda first: json_text(x=user, y=k) if first else json_text(y=k, x=user)
    record = F.when(F.col("event_id") % 2 == 0, json_text(a=k, b=nested(True))).otherwise(json_text(b=nested(False), a=k))
    rows = table(spark, sf_dir, "events").select(fingerprint(record).alias("f"), k.cast("int").alias("k"), (F.col("user_id") % 3).cast("int").alias("u"))
    return rows.groupBy("f").agg(F.count(F.lit(1)).alias("records"), F.min("k").alias("k"), F.max("k").alias("k_max"), F.min("u").alias("u"), F.max("u").alias("u_max")).drop("f")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents written as separate marks come back composed; case folding lower-cases."""
    mark = F.concat(F.lit("é"), F.lit(" "), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", mark.alias("t"))
    return rows.select("doc_id", F.sha2(nfkc(F.col("t")), 256).alias("composed"), (casefold(F.lit("ÉTÉ ＡＢ")) == "été ａｂ").alias("folded"))


_FORMS = "[" + ", ".join(f"'{s}'" for s in SUFFIX) + "]"
QUERIES = [
    Query(
        "numeric_text",
        numbers,
        """WITH v AS (SELECT event_id, event_id % 7 AS f, CAST(value / 512 + 0.001 AS VARCHAR) AS t, value / 512 + 0.001 AS x FROM events),
        n AS (SELECT event_id, CASE f WHEN 0 THEN x WHEN 3 THEN x WHEN 2 THEN CASE WHEN t LIKE '%e%' THEN NULL ELSE CAST(t || 'e1' AS DOUBLE) END
          WHEN 5 THEN CASE WHEN t LIKE '%e%' THEN x ELSE CAST(t || '0' AS DOUBLE) END WHEN 6 THEN CASE WHEN x = 0 THEN 0 END END AS number FROM v)
        SELECT event_id, number, CASE WHEN number BETWEEN 0 AND 1 THEN number END AS probability FROM n""",
    ),
    Query(
        "instant_text",
        instants,
        """WITH z AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS f, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders),
        e AS (SELECT *, CASE WHEN o_custkey % 10 > 0 THEN CASE f WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s + 19800 WHEN 4 THEN s - 7200 END END AS inst FROM z)
        SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey ELSE inst END AS epoch, strftime(TIMESTAMP '1970-01-01' + to_seconds(inst), '%Y-%m-%d %H:%M:%S') AS utc FROM e""",
    ),
    Query(
        "json_lists",
        lists,
        "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS items, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS third FROM events",
    ),
    Query(
        "record_fingerprints",
        fingerprints,
        "SELECT count(*) AS records, k, k AS k_max, u, u AS u_max FROM (SELECT CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, CAST(user_id % 3 AS INT) AS u FROM events) GROUP BY k, u",
    ),
    Query(
        "composed_text",
        composed,
        "SELECT doc_id, sha256(nfc_normalize('e' || chr(769) || ' ' || text)) AS composed, true AS folded FROM documents",
    ),
]

"""OpenAPI documents to a table of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.functions import computed

# The HTTP methods that count as operations.
METHODS = ["get", "post", "put", "delete", "patch"]
_DOCUMENT = """
info STRUCT<version:STRING>, servers STRING, security STRING, paths MAP<STRING,MAP<STRING,STRING>>"""
_OPERATION = """
summary STRING, operationId STRING, tags ARRAY<STRING>, security STRING, parameters ARRAY<STRING>, deprecated BOOLEAN"""


def api_operations(documents: DataFrame) -> dict[str, DataFrame]:
    """``sources`` (hash, version, servers), ``operations`` (one row each) and ``errors``."""
    parsed = computed(documents, d=F.from_json("content", _DOCUMENT))
    usable = F.col("d").isNotNull() & F.col("d.paths").isNotNull()
    good = parsed.filter(usable)
    sources = good.select(
        "api", "url", F.sha2("content", 256).alias("sha256"), F.col("d.info.version").alias("version"),
        F.col("d.servers").alias("servers"),
    )
    errors = parsed.filter(~usable).select("api", "url", F.lit("No OpenAPI paths in response").alias("error"))
    none = F.array().cast("array<string>")
    operations = (
        good.select("api", F.col("d.security").alias("__security"), F.explode("d.paths").alias("path", "item"))
        .withColumn("__shared", F.coalesce(F.from_json(F.col("item")["parameters"], "array<string>"), none))
        .select("api", "path", "__security", "__shared", F.explode("item").alias("key", "body"))
        .filter(F.lower("key").isin(*METHODS))
        .transform(lambda df: computed(df, o=F.from_json("body", _OPERATION)))
        .select(
            "api",
            F.upper("key").alias("method"),
            "path",
            F.col("o.summary").alias("summary"),
            F.col("o.operationId").alias("operation_id"),
            F.col("o.tags").alias("tags"),
            F.when(F.array_contains(F.json_object_keys("body"), "security"), F.col("o.security"))
            .otherwise(F.coalesce("__security", F.lit("[]")))
            .alias("security"),
            F.concat("__shared", F.coalesce("o.parameters", none)).alias("parameters"),
            F.coalesce("o.deprecated", F.lit(False)).alias("deprecated"),
            F.when(F.col("key") == "get", F.lit("GET extraction candidate"))
            .otherwise(F.lit("review; most are state-changing"))
            .alias("research_use"),
        )
    )
    return {"sources": sources, "operations": operations, "errors": errors}

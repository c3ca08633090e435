"""Landed response envelopes to payload rows, with a side table for responses of a wrong shape."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import computed
from oddslake.sources.endpoints import BY_TABLE, ENDPOINTS, Endpoint

CARRIED = ["run_id", "row_pos", "observed_at", "url", "params"]


_RULE = "array<struct<table:string,rows:string,id_key:string,null_is_empty:boolean>>"


def _host(endpoint: Endpoint) -> str:
    """The part of a route's pattern that all endpoints of one API share."""
    return endpoint.path.split("[^/]+", 1)[0] if not endpoint.path.startswith("/trade-api/v2") else "/trade-api/v2"


def claimed(raw: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS) -> DataFrame:
    """Successful responses with the contract that claims each, in one scan; others are left out.

    The API is told by its host first, so a response is only compared with the routes of that API. The
    query string is not part of a route, and no route matches two contracts.
    """
    route = F.regexp_replace("url", r"[?#].*$", "")
    by_host: dict[str, list[Column]] = {}
    for number, endpoint in enumerate(endpoints, 1):
        by_host.setdefault(_host(endpoint), []).append(F.when(route.rlike(endpoint.path), F.lit(number)))
    number = F.coalesce(F.lit(None).cast("int"), *[F.when(route.rlike(host), F.coalesce(*tests)) for host, tests in by_host.items()])
    rules = F.from_json(F.lit(json.dumps([{"table": e.table, "rows": e.rows, "id_key": e.id_key, "null_is_empty": e.null_is_empty} for e in endpoints])), _RULE)
    numbered = computed(raw.filter(F.col("status_code").between(200, 299)), __number=number)
    return computed(numbered.filter(F.col("__number").isNotNull()), __rule=F.element_at(rules, F.col("__number"))).drop("__number")


def _row_list(rule: Column) -> tuple[Column, Column]:
    """(array of row texts, reason it is unusable) of a response under its contract."""
    data, key = F.col("data"), rule["rows"]
    is_object, is_list = data.rlike(r"^\s*\{"), data.rlike(r"^\s*\[")
    value = F.call_function("get_json_object", data, F.concat(F.lit("$."), key))
    present = F.coalesce(F.array_contains(F.json_object_keys(data), key), F.lit(False))
    keyed = F.when(rule["null_is_empty"] & present & value.isNull(), F.array().cast("array<string>")).otherwise(F.from_json(value, "array<string>"))
    whole, root = key.isNull(), key == ""
    rows = F.when(whole, F.when(is_object, F.array(data))).when(root, F.from_json(data, "array<string>")).otherwise(keyed)
    reason = (
        F.when(whole, F.when(~F.coalesce(is_object, F.lit(False)), F.lit("expected an object")))
        .when(root, F.when(rows.isNull() | ~F.coalesce(is_list, F.lit(False)), F.lit("expected a list at the root")))
        .when(F.json_object_keys(data).isNull(), F.concat(F.lit("expected an object containing "), key))
        .when(~present, F.concat(F.lit("missing expected field "), key))
        .when(rows.isNull() | ~F.coalesce(value, F.lit("[")).startswith("["), F.concat(F.lit("field "), key, F.lit(" is not a list")))
    )
    not_records = F.exists(rows, lambda r: ~F.coalesce(r.startswith("{"), F.lit(False)))
    return rows, F.coalesce(reason, F.when(not_records, F.lit("a row is not an object")))


def explode_envelopes(raw: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): one row per record of every contract's table, with its page and place, and the unusable responses.

    Each of the two scans the log once, however many contracts there are. An unusable response yields
    no rows at all, so a changed format cannot pass as an empty or partial page.
    """
    rows, reason = _row_list(F.col("__rule"))
    shaped = computed(claimed(raw, endpoints), __rows=rows, reason=reason)
    name = F.col("__rule.table").alias("table")
    good = shaped.filter(F.col("reason").isNull()).select(*CARRIED, name, F.col("__rule.id_key").alias("__id_key"), F.posexplode("__rows").alias("item_pos", "payload"))
    identity = F.call_function("get_json_object", F.col("payload"), F.concat(F.lit("$."), F.col("__id_key")))
    bad = shaped.filter(F.col("reason").isNotNull()).select(*CARRIED, name, "reason", "data")
    return good.withColumn("id", identity).select(*CARRIED, "item_pos", "payload", "table", "id"), bad


def explode_tables(raw: DataFrame, tables: Iterable[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Payload rows of the named tables and one table of all unusable responses.

    To keep many tables, :func:`land_tables` writes them in one pass.
    """
    parts = {table: explode_envelopes(raw, BY_TABLE[table])[0] for table in tables}
    return parts, explode_envelopes(raw, [e for table in parts for e in BY_TABLE[table]])[1]


def land_tables(raw: DataFrame, path: str, endpoints: Sequence[Endpoint] = ENDPOINTS) -> DataFrame:
    """Write the rows of every contract below ``path``, a folder a table, from one scan of the log, and read them back."""
    rows, _ = explode_envelopes(raw, endpoints)
    rows.write.mode("overwrite").partitionBy("table").parquet(path)
    return raw.sparkSession.read.schema(rows.schema).parquet(path)


def request_errors(raw: DataFrame) -> DataFrame:
    """Failed requests as error rows: transport failures and non-success responses."""
    failed = F.col("error").isNotNull() | ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    message = F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    return raw.filter(failed).select(
        "run_id", F.concat_ws(" ", "method", "url").alias("operation"), message.alias("error"), "observed_at"
    )

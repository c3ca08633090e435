import json
import re

import pytest
from pyspark.sql import functions as F

from oddslake import schemas
from oddslake.functions import salted_join, fingerprint, instant, number, strict_epoch, to_epoch
from oddslake.functions.ordered import lag_ordered, row_number_ordered, running_sum
from oddslake.operators import audit
from oddslake.sources import catalog, envelopes, tables
from oddslake.sources.endpoints import BY_TABLE, ENDPOINTS

GAMMA = "https://gamma-api.example.com"
KALSHI = "https://api.example.com/trade-api/v2"


def raw(spark, *rows):
    base = {"run_id": "r", "observed_at": "2026-01-01T00:00:00Z", "method": "GET", "params": {}, "status_code": 200, "attempt": 1}
    return spark.createDataFrame([{**base, **r, "row_pos": i} for i, r in enumerate(rows)], schemas.ENVELOPE)


def test_envelopes_to_rows_and_bad_shapes(spark):
    log = raw(
        spark,
        {"url": GAMMA + "/events", "data": '[{"id":1},{"id":2}]'},
        {"url": GAMMA + "/events/keyset?limit=1", "data": '{"events":[{"id":3}],"next_cursor":"x"}'},
        {"url": GAMMA + "/events", "data": '{"error":"bad response"}'},
        {"url": GAMMA + "/events", "data": '[1]'},
        {"url": GAMMA + "/events", "data": '[{"id":9}]', "status_code": 500},
        {"url": KALSHI + "/markets/trades", "data": '{"trades":null}'},
        {"url": KALSHI + "/markets/trades", "data": '{"trades":[{"trade_id":"t"}],"cursor":""}'},
        {"url": KALSHI + "/markets/trades", "data": '{"renamed":[]}'},
        {"url": KALSHI + "/markets/trades", "data": '{"trades":{"a":1}}'},
        {"url": KALSHI + "/markets/trades", "error": "ReadTimeout", "status_code": None},
    )
    rows, bad = envelopes.explode_tables(log, ["poly_events", "kalshi_trades"])
    assert sorted(r["id"] for r in rows["poly_events"].collect()) == ["1", "2", "3"]
    assert [r["id"] for r in rows["kalshi_trades"].collect()] == ["t"]
    reasons = sorted((r["row_pos"], r["reason"]) for r in bad.collect())
    assert reasons == [
        (2, "expected a list at the root"), (3, "a row is not an object"),
        (7, "missing expected field trades"), (8, "field trades is not a list"),
    ]
    errors = sorted((r["error"]) for r in envelopes.request_errors(log).collect())
    assert errors == ["HTTP 500", "ReadTimeout"]
    assert len(ENDPOINTS) >= 80 and "kalshi_cutoff" in BY_TABLE


def test_retry_audit(spark):
    u = KALSHI + "/markets"
    log = raw(
        spark,
        {"url": u, "status_code": 429}, {"url": u, "attempt": 2},
        {"url": u + "/a", "status_code": 404}, {"url": u + "/b", "status_code": 503, "attempt": 1}, {"url": u + "/b", "status_code": 503, "attempt": 2},
        {"url": u + "/c", "status_code": None, "error": "ConnectError", "attempt": 5}, {"url": u, "params": {"b": "1", "a": "2"}},
    )
    got = {(r["url"], r["params"]): (r["attempts"], r["retryable_responses"], r["outcome"]) for r in audit.retry_audit(log).collect()}
    assert got[(u, "[]")] == (2, 1, "success")
    assert got[(u + "/a", "[]")] == (1, 0, "terminal_error")
    assert got[(u + "/b", "[]")] == (2, 2, "retries_exhausted")
    assert got[(u + "/c", "[]")] == (1, 0, "transport_failure")
    assert got[(u, '[{"key":"a","value":"2"},{"key":"b","value":"1"}]')] == (1, 0, "success")


def test_pagination_audit(spark):
    ddl = "run_id STRING, endpoint STRING, filters STRING, row_pos BIGINT, cursor STRING, next_cursor STRING, rows_json STRING"
    walks = {
        "ok": [(None, "x", '[{"id":1}]'), ("x", "", '[{"id":2}]')],
        "ends": [(None, "LTE=", "[]")],
        "empty_then_more": [(None, "x", "[]"), ("x", None, '[{"id":1}]')],
        "cursor": [(None, "x", '[{"id":1}]'), ("x", "x", '[{"id":2}]')],
        "start": [("s", "x", '[{"id":1}]'), ("x", "s", '[{"id":2}]')],
        "page": [(None, "x", '[{"a":1,"b":2}]'), ("x", "y", '[{"b":2,"a":1}]')],
        "cap": [(None, "x", '[{"id":1}]')],
    }
    rows = [("r", name, "", i, *page) for name, pages in walks.items() for i, page in enumerate(pages)]
    got = {r["endpoint"]: r["status"] for r in audit.pagination_audit(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        "ok": "complete", "ends": "complete", "empty_then_more": "complete", "cursor": "repeated_cursor",
        "start": "repeated_cursor", "page": "repeated_page", "cap": "incomplete_cursor_remains",
    }


def test_run_status_and_checks(spark):
    runs = spark.createDataFrame(
        [("a", True, False), ("b", True, False), ("c", True, True), ("d", False, False), ("e", True, False)], "run_id STRING, finished BOOLEAN, fatal BOOLEAN"
    )
    log = spark.createDataFrame([("a",), ("a",), ("b",)], "run_id STRING")
    errors = spark.createDataFrame([("b", "op")], "run_id STRING, operation STRING")
    warnings = spark.createDataFrame([("e", "w"), ("e", "w")], "run_id STRING, warning STRING")
    got = {r["run_id"]: (r["request_count"], r["warning_count"], r["status"], r["exit_code"]) for r in audit.run_status(log, errors, warnings, runs).collect()}
    assert got == {
        "a": (2, 0, "complete_within_requested_scope", 0), "b": (1, 0, "partial", 2), "c": (0, 0, "failed", 2),
        "d": (0, 0, "running", 0), "e": (0, 1, "partial", 0),
    }
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "p DOUBLE")
    rules = {"price_in_range": F.col("p").between(0, 1)}
    assert audit.check_ranges(df, rules).first()["violations"] == 1
    assert audit.violations(df, rules).first()["p"] == 1.5
    counts = {r["dataset"]: r["rows"] for r in audit.dataset_counts({"x": df, "y": df.limit(0)}).collect()}
    assert counts == {"x": 3, "y": 0}


def test_catalog(spark):
    doc = {
        "info": {"version": "2"}, "security": [{"k": []}],
        "paths": {"/a": {"parameters": [{"name": "p"}], "get": {"summary": "s", "operationId": "o", "tags": ["t"], "parameters": [{"name": "q"}]},
                         "POST": {"security": None, "deprecated": True}, "trace": {}}},
    }
    docs = spark.createDataFrame([("x", "u", json.dumps(doc)), ("y", "v", "{}"), ("z", "w", "oops")], schemas.API_DOCUMENT)
    out = catalog.api_operations(docs)
    ops = {r["method"]: r for r in out["operations"].collect()}
    assert set(ops) == {"GET", "POST"}
    assert ops["GET"]["security"] == '[{"k":[]}]' and ops["POST"]["security"] is None
    assert [json.loads(p)["name"] for p in ops["GET"]["parameters"]] == ["p", "q"]
    assert ops["GET"]["research_use"] == "GET extraction candidate" and ops["POST"]["deprecated"]
    assert out["errors"].count() == 2 and len(out["sources"].first()["sha256"]) == 64


def test_jsonl_csv_and_positions(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text('{"a":"x","n":1}\n\n{"a":"=1","n":2}\n', encoding="utf-8")
    df = tables.read_jsonl(spark, str(src), "a STRING, n INT")
    assert [(r["a"], r["row_pos"]) for r in df.collect()] == [("x", 0), ("=1", 1)]
    (tmp_path / "bad.jsonl").write_text('{"a":\n', encoding="utf-8")
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a STRING").collect()
    nested = spark.createDataFrame([("=x", "-1", -5.0, ["a"], {"k": "v"}), ("ok", None, 1.0, None, None)], "t STRING, u STRING, n DOUBLE, l ARRAY<STRING>, m MAP<STRING,STRING>")
    tables.write_csv(nested, str(tmp_path / "csv"), bom=True)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*"))
    assert "'=x,'-1,-5.0," in text and '"[""a""]"' in text and text.startswith("﻿t")
    tables.write_jsonl(nested, str(tmp_path / "json"))
    back = tables.read_jsonl(spark, str(tmp_path / "json"), nested.schema).drop("row_pos").orderBy("t").collect()
    assert back == nested.orderBy("t").collect()
    with pytest.raises(Exception, match="not a JSON number"):
        tables.write_jsonl(spark.createDataFrame([(float("nan"),)], "x DOUBLE"), str(tmp_path / "nan"))
    ranked = tables.with_row_pos(spark.range(100).repartition(5), F.desc("id")).collect()
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["row_pos"])] == list(range(99, -1, -1))
    flat = tables.preview(spark.createDataFrame([((1,),)], "a STRUCT<b:INT>"), ["a.b", "a.c", "z"])
    assert flat.first().asDict() == {"a_b": 1, "a_c": None, "z": None}
    tables.export_tables({"one": nested}, str(tmp_path / "all"))
    assert (tmp_path / "all" / "one").is_dir()
    assert json.loads(tables.json_document(nested.limit(1)).first()[0])["m"] == {"k": "v"}


def test_ingest_appends_each_file_once(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / d) for d in ("landing", "bronze", "checkpoint"))
    line = {"run_id": "r", "row_pos": 0, "url": GAMMA + "/events", "data": "[]", "status_code": 200}
    (tmp_path / "landing").mkdir()
    for i in range(2):
        (tmp_path / "landing" / f"{i}.json").write_text(json.dumps({**line, "row_pos": i}) + "\n")
        tables.ingest(spark, landing, schemas.ENVELOPE, out, ckpt).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["row_pos"] for r in rows) == [0, 1] and rows[0]["run_id"] == "r"
    tables.write_table(spark.read.parquet(out), str(tmp_path / "copy"), ["run_id"])
    assert (tmp_path / "copy" / "run_id=r").is_dir()


def test_salted_join_equals_plain_join(spark):
    many = spark.range(1000).selectExpr("cast(if(id % 3 = 0, 0, id % 50) as int) as k", "id")
    one = spark.range(0, 60, 2).selectExpr("cast(id as int) as k", "id * 10 as v")
    for how in ("inner", "left"):
        plain = {tuple(r) for r in many.join(one, ["k"], how).collect()}
        assert {tuple(r) for r in salted_join(many, one, ["k"], F.col("id"), how).collect()} == plain


def test_scalar_edges(spark):
    cases = {
        "1_000": 1000.0, " 2.5 ": 2.5, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1d": None, "0x1p3": None, "nan": None,
        "inf": None, "": None, "true": None, "1__0": None, "1e999": None, "-3": -3.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    assert {r["t"]: r["n"] for r in df.select("t", number(F.col("t")).alias("n")).collect()} == cases
    times = {
        "2026-01-01T00:00:00Z": 1767225600, "2026-01-01T05:30:00+0530": 1767225600, "20260101T000000Z": 1767225600,
        "2026-01-01 00:00+00:00": 1767225600, "2026-01-01T00:00:00.9Z": 1767225600, "2026-01-01": None, "12": 12, "bad": None,
        "2026-01-01T00:00:00": None,
    }
    df = spark.createDataFrame([(k,) for k in times], "t STRING")
    assert {r["t"]: r["n"] for r in df.select("t", to_epoch(F.col("t")).alias("n")).collect()} == times
    assert df.filter("t = 'bad'").select(instant(F.col("t"))).first()[0] is None
    with pytest.raises(Exception, match="timezone"):
        df.select(strict_epoch(F.col("t"))).collect()
    a = spark.createDataFrame([('{"b":[1,{"y":1,"x":2}],"a":null}', '{"a":null,"b":[1,{"x":2,"y":1}]}', '{"a":1}')], "p STRING, q STRING, r STRING")
    p, q, r = a.select(*[fingerprint(F.col(c)) for c in "pqr"]).first()
    assert p == q != r


def test_ordered_helpers_match_plain_windows(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k STRING, pos BIGINT, v INT")
    total = {(r["k"], r["pos"]): r["s"] for r in running_sum(df, ["k"], "pos", F.col("v"), "s", 10).collect()}
    before = {(r["k"], r["pos"]): r["p"] for r in lag_ordered(df, ["k"], "pos", "v", "p", 10).collect()}
    turn = {(r["k"], r["pos"]): r["n"] for r in row_number_ordered(df, ["k"], "pos", "n", 10).collect()}
    for key in "ab":
        last, acc = None, 0
        for n, (k, pos, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            acc += v
            assert total[(k, pos)] == acc and before[(k, pos)] == last and turn[(k, pos)] == n
            last = v


def test_every_route_belongs_to_one_contract():
    from oddslake.plans.audit_queries import SAMPLES

    claims = [[e for e in ENDPOINTS if re.search(e.path, f"https://{route}")] for route, *_ in SAMPLES]
    assert [len(c) for c in claims] == [1] * len(SAMPLES)
    assert {id(c[0]) for c in claims} == {id(e) for e in ENDPOINTS}
    assert [(c[0].table, c[0].rows, c[0].id_key) for c in claims] == [(t, None if k == "-" else "" if k == "." else k, None if i == "-" else i) for _, t, k, i in SAMPLES]


def test_all_contracts_share_one_scan_of_the_log(spark, tmp_path):
    log = [("r", i, "t", f"https://gamma-api.example.com/{p}", {}, 200, d) for i, (p, d) in enumerate([("tags", '[{"id":1},{"id":2}]'), ("tags/9", '{"id":9}'), ("tags", "{}"), ("nowhere", "[]"), ("teams", None)])]
    raw = spark.createDataFrame(log, "run_id STRING, row_pos BIGINT, observed_at STRING, url STRING, params MAP<STRING,STRING>, status_code INT, data STRING")
    raw.write.parquet(str(tmp_path / "log"))
    raw = spark.read.parquet(str(tmp_path / "log"))
    rows, bad = envelopes.explode_envelopes(raw)
    assert all(df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 for df in (rows, bad))
    assert sorted((r["table"], r["item_pos"], r["id"]) for r in rows.collect()) == [("poly_tag_detail", 0, "9"), ("poly_tags", 0, "1"), ("poly_tags", 1, "2")]
    assert sorted((r["table"], r["reason"]) for r in bad.collect()) == [("poly_tags", "expected a list at the root"), ("poly_teams", "expected a list at the root")]
    landed = envelopes.land_tables(raw, str(tmp_path / "tables"))
    assert sorted(p.name for p in (tmp_path / "tables").iterdir() if p.is_dir()) == ["table=poly_tag_detail", "table=poly_tags"] and landed.count() == 3

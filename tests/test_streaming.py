import json

import pytest
from pyspark.sql import functions as F

from oddslake import schemas
from oddslake.streaming import frames as S


T0 = "2026-01-01T00:00:00Z"


def table(spark, *rows):
    base = {"run_id": "r", "observed_at": T0, "kind": "message", "connection_id": 0}
    return spark.createDataFrame([{"row_pos": i, **base, **r} for i, r in enumerate(rows)], schemas.FRAME)


def book(kind, sid, seq):
    return json.dumps({"type": f"orderbook_{kind}", "sid": sid, "seq": seq})


def test_gap_segments_and_summary(spark):
    df = table(
        spark,
        {"kind": "connected", "data": None},
        {"data": book("snapshot", 1, 1)},
        {"data": book("delta", 1, 3)},
        {"kind": "gap", "data": None, "error": "SequenceGap"},
        {"kind": "connected", "connection_id": 1},
        {"data": book("snapshot", 1, 9), "connection_id": 1},
        {"data": book("delta", 1, "10"), "connection_id": 1},
        {"data": book("delta", 1, 10), "connection_id": 1},
        {"data": json.dumps({"type": "ticker", "sid": 1, "seq": 99}), "connection_id": 1},
    )
    parsed = S.parse_frames(df)
    (gap,) = S.sequence_gaps(S.sequenced(parsed), width=2).collect()
    assert (gap["connection_id"], gap["sid"], gap["expected_seq"], gap["got_seq"]) == (0, "1", 2, 3)
    assert [r["segment"] for r in S.segments(df, width=3).orderBy("row_pos").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    row = S.stream_summary(parsed).first()
    assert (row["messages"], row["data_messages"], row["connections"], row["gaps"]) == (6, 6, 2, 1)
    assert row["warnings"] == ["1 connection/sequence gaps; do not reconstruct across gaps"] and row["status"] == "partial"


def test_acknowledgement_lists_heartbeats_and_errors(spark):
    df = table(
        spark,
        {"data": json.dumps({"type": "subscribed", "msg": {"channel": "ticker"}})},
        {"data": "PONG"}, {"data": ""}, {"data": "hello"},
    )
    clean = S.drop_heartbeats(df)
    assert [json.loads(r["data"]).get("text") for r in clean.orderBy("row_pos").collect()] == [None, "hello"]
    row = S.stream_summary(S.parse_frames(clean)).first()
    assert (row["messages"], row["data_messages"]) == (2, 0) and row["warnings"] == [S.NO_DATA_WARNING]
    df = table(
        spark,
        {"data": json.dumps([{"event_type": "book"}, {"event_type": "other"}, 3, {"topic": "comments", "payload": {"a": 1}}])},
        {"data": json.dumps({"topic": "comments", "payload": {}})},
        {"data": json.dumps({"type": "error", "msg": "no"})},
        {"data": json.dumps({"error": None, "type": "x"})},
    )
    rows = S.parse_frames(df).orderBy("row_pos").collect()
    assert [r["data_items"] for r in rows] == [2, 0, 0, 0]
    assert [r["is_error"] for r in rows] == [False, False, True, False]
    assert S.stream_summary(S.parse_frames(df)).first()["status"] == "failed"
    assert S.data_items(df).filter("is_data").count() == 2


def land(df, path, parts):
    """Frames in files that arrive one after another, in the order of positions."""
    total = df.agg(F.max("row_pos")).first()[0] + 1
    for part in range(parts):
        inside = F.floor(F.col("row_pos") * parts / total) == part
        df.filter(inside).coalesce(1).write.mode("append").json(path)


def streamed(spark, tmp_path, **options):
    parsed = S.parse_frames(S.drop_heartbeats(S.read_frames(spark, str(tmp_path / "in"), streaming=True, max_files=1)))
    return S.run_sequence_gaps(S.sequenced(parsed), *[str(tmp_path / d) for d in ("out", "ckpt")], **options)


def plain_gaps(df):
    return sorted(tuple(r) for r in S.sequence_gaps(S.sequenced(S.parse_frames(df))).collect())


@pytest.mark.parametrize(("subscriptions", "width", "border_files"), [(3, 1_000_000, 100), (1, 4, 1)])
def test_stream_equals_batch(spark, tmp_path, subscriptions, width, border_files):
    """One hot subscription, or several, over many micro-batches with gaps inside and between them."""
    rows = []
    for pos in range(120):
        jump = pos // 37 * 5 + pos // 30
        rows.append({"data": book("delta", pos % subscriptions, pos // subscriptions + jump), "row_pos": pos, "connection_id": pos // 90})
    df = table(spark, *rows)
    land(df, str(tmp_path / "in"), 4)
    got = streamed(spark, tmp_path, width=width, max_files=border_files)
    want = plain_gaps(df)
    assert sorted(tuple(r) for r in got.collect()) == want and any(pos % 30 == 0 for *_, pos, _, _ in want)
    batches = {r["batch"] for r in spark.read.parquet(str(tmp_path / "out/borders")).select("batch").distinct().collect()}
    assert len(batches) == 4
    plan = S.sequence_gaps(S.sequenced(S.parse_frames(df)), width)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan


def test_runs_go_on_where_the_last_one_stopped(spark, tmp_path):
    first = table(spark, *[{"data": book("delta", 1, s), "row_pos": p} for p, s in enumerate([1, 2, 5])])
    land(first, str(tmp_path / "in"), 1)
    assert [r["got_seq"] for r in streamed(spark, tmp_path).collect()] == [5]
    later = table(spark, *[{"data": book("delta", 1, s), "row_pos": p} for p, s in [(3, 6), (4, 9)]], {"data": book("delta", 1, 20), "row_pos": 5})
    land(later, str(tmp_path / "in"), 3)
    assert sorted(r["got_seq"] for r in streamed(spark, tmp_path).collect()) == [5, 9, 20]
    assert sorted(r["got_seq"] for r in streamed(spark, tmp_path).collect()) == [5, 9, 20]


def test_a_border_seen_twice_counts_once(spark, tmp_path):
    """A repeated micro-batch writes its borders again under new names."""
    rows = spark.createDataFrame([("r", 0, "1", 0, 1, 4, 5, T0), ("r", 0, "1", 5, 9, 7, 11, T0)], S.BORDER.replace("at TIMESTAMP", "at STRING"))
    for n in (0, 1, 2):
        part = rows.filter(F.col("first_pos") == min(n, 1) * 5).withColumn("at", F.col("at").cast("timestamp"))
        part.write.parquet(str(tmp_path / f"out/borders/batch={n}"))
    S.border_gaps_stream(spark, str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files=1).awaitTermination(120)
    found = spark.read.schema(S.GAP).parquet(str(tmp_path / "out/between")).collect()
    assert [tuple(r) for r in found] == [("r", 0, "1", 5, 6, 9)]


def test_state_forgets_idle_subscriptions(spark, tmp_path):
    """When frames a day younger have arrived, a subscription starts afresh: its next number is no gap."""
    def arrive(pos, sid, seq, day):
        frame = {"data": book("delta", sid, seq), "row_pos": pos, "observed_at": f"2026-01-{day:02}T00:00:00Z"}
        table(spark, frame).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        return streamed(spark, tmp_path).count()

    assert arrive(0, 1, 1, 1) == 0 and arrive(1, 1, 4, 1) == 1  # remembered
    assert arrive(2, 2, 1, 9) == 1 and arrive(3, 2, 2, 9) == 1  # eight days on, the first one's timer is due
    assert arrive(4, 1, 50, 9) == 1  # no gap after it was forgotten
    assert arrive(5, 1, 70, 9) == 2  # known again


def test_streamed_summary_equals_batch(spark, tmp_path):
    rows = []
    for i in range(60):
        kind = "gap" if i % 17 == 5 else "message"
        data = None if kind == "gap" else json.dumps({"type": "error"}) if i == 33 else book("delta", 1, i)
        rows.append({"run_id": f"r{i % 3}", "kind": kind, "data": data, "connection_id": i // 25, "observed_at": f"2026-01-01T{i // 10:02}:{i % 10}0:00Z" if i % 10 < 6 else None})
    df = table(spark, *rows)
    land(df, str(tmp_path / "in"), 3)
    parsed = S.parse_frames(S.read_frames(spark, str(tmp_path / "in"), streaming=True, max_files=1))
    # Frames without an instant share one early span, so nothing may count as late here.
    S.summary_stream(parsed, str(tmp_path / "out"), str(tmp_path / "ckpt"), "1 hour", "100000 days").awaitTermination(120)
    got = sorted(tuple(r) for r in S.read_summary(spark, str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in S.stream_summary(S.parse_frames(df)).collect())
    assert got == want and {r[-1] for r in want} == {"failed", "partial"}


def test_summary_as_streaming_query(spark, tmp_path):
    rows = [{"data": book("delta", 1, i), "row_pos": i, "connection_id": i % 3} for i in range(9)]
    table(spark, *rows).repartition(3).write.json(str(tmp_path / "in"))
    parsed = S.parse_frames(S.read_frames(spark, str(tmp_path / "in"), streaming=True, max_files=1))
    query = (
        S.stream_summary(parsed).writeStream.outputMode("complete").format("memory").queryName("summary")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    row = spark.table("summary").first()
    assert (row["messages"], row["data_messages"], row["connections"], row["gaps"]) == (9, 9, 3, 0)

import pytest
from pyspark.sql import functions as F

from oddslake.operators import snapshots as S
from oddslake.plans.snapshot_queries import report
from oddslake.session import stored

T0 = "2026-09-06T12:00:00+00:00"
T1 = "2026-09-07T12:00:00+00:00"
DDL = """platform STRING, market_id STRING, event_id STRING, outcome STRING, token_id STRING, title STRING,
rules STRING, probability DOUBLE, price_source STRING, observed_at STRING, topics ARRAY<STRING>,
quality_flags ARRAY<STRING>, volume DOUBLE, volume_unit STRING, spread DOUBLE, row_pos BIGINT"""
BASE = {
    "platform": "polymarket", "market_id": "m1", "event_id": "e1", "outcome": "Yes", "token_id": "t1",
    "title": "US midterms 2026", "rules": "Same rules", "probability": 0.4, "price_source": "gamma_outcome_price",
    "observed_at": T0, "topics": ["midterms_2026"], "quality_flags": [], "volume": 5000.0,
    "volume_unit": "USD_notional", "spread": None,
}


@pytest.fixture
def table(spark):
    def build(*changes):
        rows = [{**BASE, **change, "row_pos": i} for i, change in enumerate(changes)]
        return spark.createDataFrame(rows, DDL)

    return build


def test_change_is_in_percentage_points(table):
    report = S.analyze(table({"probability": 0.46, "observed_at": T1}), table({}))
    (change,) = report["changes"].collect()
    (entry,) = report["watchlist"].collect()
    summary = report["summary"].first()
    assert change["change_pp"] == 6.0 and entry["change_pp"] == 6.0
    assert entry["reasons"] == ["price_move_requires_review", "2026_midterm_exposure"]
    assert summary["previous_earliest"] == T0 and summary["comparison_requested"]
    assert summary["new_market_count"] == 0


def test_venues_are_not_matched(table):
    report = S.analyze(table({"platform": "kalshi", "probability": 0.9, "observed_at": T1}), table({}))
    assert report["changes"].count() == 0
    assert report["new_coverage"].count() == 1 and report["disappeared_coverage"].count() == 1
    assert report["watchlist"].first()["reasons"][0] == "new_in_collected_coverage"
    assert report["summary"].first()["new_market_count"] == 1


def test_incomparable_observations_are_skipped(table):
    variations = [
        ({"observed_at": T0}, "missing_or_nonincreasing_observation_time"),
        ({"observed_at": "not a time"}, "missing_or_nonincreasing_observation_time"),
        ({"observed_at": "2026-09-07T12:00:00"}, "missing_or_nonincreasing_observation_time"),
        ({"price_source": "last_trade"}, "price_source_changed_or_missing"),
        ({"price_source": None}, "price_source_changed_or_missing"),
        ({"rules": "Changed rules"}, "contract_definition_changed"),
        ({"probability": None}, "missing_valid_price"),
        ({"probability": float("nan")}, "missing_valid_price"),
        ({"token_id": "changed"}, "contract_definition_changed"),
        ({"market_id": None}, "missing_stable_market_identity"),
    ]
    fresh = {"probability": 0.9, "observed_at": T1}
    current = table(*[{"outcome": str(i), **fresh, **v} for i, (v, _) in enumerate(variations)])
    previous = table(*[{"outcome": str(i)} for i in range(len(variations))])
    compared = S.compare(current, previous)
    got = {r["outcome"]: r["reason"] for r in S.skipped_comparisons(compared).collect()}
    assert got == {str(i): reason for i, (_, reason) in enumerate(variations)}
    assert S.changes(compared).count() == 0


def test_counts_thresholds_and_duplicates(table):
    report = S.analyze(table({}, {"outcome": "No", "token_id": "t2", "probability": 0.6}))
    summary = report["summary"].first()
    assert (summary["current_outcome_count"], summary["current_market_count"]) == (2, 1)
    assert report["topic_market_counts"].collect()[0].asDict() == {"topic": "midterms_2026", "markets": 1}
    assert not summary["comparison_requested"] and report["new_coverage"].count() == 0
    assert summary["new_market_count"] is None and report["interpretation"].count() == 6
    (entry,) = S.analyze(table({"volume": 0.0, "spread": 0.1}))["watchlist"].collect()
    assert entry["quality_flags"] == ["low_cumulative_volume", "wide_spread"]
    assert entry["volume_unit"] == "USD_notional" and entry["change_pp"] is None
    now = {"observed_at": T1, "probability": 0.7}
    report = S.analyze(table(now, now), table({}))
    assert report["changes"].count() == 0
    assert report["skipped_comparisons"].first()["reason"] == "duplicate_snapshot_identity"
    assert S.duplicate_identities(table(now, now)).first()["copies"] == 2


def test_order_last_row_wins_and_shared_table(table, tmp_path):
    current = table(
        {"market_id": "a", "probability": 0.5, "observed_at": T1, "topics": []},
        {"market_id": "b", "probability": 0.9, "observed_at": T1, "topics": []},
        {"market_id": "c", "probability": 0.41, "observed_at": T1},
        {"market_id": "d", "probability": 0.43, "observed_at": T1, "topics": ["trade_tariffs"]},
        {"market_id": "e", "probability": 0.4, "observed_at": T1, "topics": ["us_macro"]},
    )
    previous = table(*[{"market_id": m} for m in "abcde"])
    report = S.analyze(current, previous, compared_path=str(tmp_path / "compared"))
    assert [r["market_id"] for r in report["changes"].collect()] == ["b", "a", "d", "c", "e"]
    watch = report["watchlist"].collect()
    assert [r["market_id"] for r in watch] == ["c", "b", "a", "d", "e"]
    assert watch[3]["reasons"] == ["price_move_requires_review", "investment_issue_keyword_evidence"]
    assert watch[4]["reasons"] == ["target_topic_coverage"]
    copies = table({"probability": 0.1}, {"probability": 0.2}, {"probability": 0.3})
    (row,) = S.latest_snapshot(copies).collect()
    assert (row["probability"], row["copies"], row["first_pos"]) == (0.3, 3, 0)


@pytest.mark.parametrize("with_previous", [True, False])
def test_the_report_agrees_with_its_single_operators(table, tmp_path, with_previous):
    """Nulls, copies, rows without identity and one-sided rows, in one comparison and table by table."""
    def side(shift):
        odd = [{"market_id": None, "outcome": str(shift)}, {"platform": None}, {"observed_at": "never"}, {"topics": None, "market_id": "n"}]
        return [{"market_id": f"m{i % 9}", "outcome": f"o{i % 4}", "probability": (i * 7 % 11) / 11, "observed_at": T1 if shift else T0, "topics": ["us_macro"] * (i % 2)} for i in range(shift, 25 + shift)] + odd

    current, previous = table(*side(6)), table(*side(0)) if with_previous else None
    report = S.analyze(current, previous, compared_path=str(tmp_path / "both"))
    compared = S.compare(current, previous)
    nothing = S.coverage_difference(current, current)
    single = {
        "summary": S.summary(current, previous), "changes": S.changes(compared), "skipped_comparisons": S.skipped_comparisons(compared),
        "watchlist": S.watchlist(compared, comparison_requested=with_previous), "topic_market_counts": S.topic_market_counts(current),
        "new_coverage": S.coverage_difference(current, previous) if with_previous else nothing,
        "disappeared_coverage": S.coverage_difference(previous, current) if with_previous else nothing,
    }
    assert {n: [r.asDict() for r in report[n].collect()] for n in single} == {n: [r.asDict() for r in df.collect()] for n, df in single.items()}
    assert [r["caveat"] for r in report["interpretation"].orderBy("pos").collect()] == S.INTERPRETATION


def test_both_sides_read_each_snapshot_once(table, tmp_path):
    for name in ("now", "then"):
        table({}, {"market_id": name}).write.parquet(str(tmp_path / name))
    spark = table({}).sparkSession
    sides = S.both_sides(*[spark.read.parquet(str(tmp_path / n)) for n in ("now", "then")])
    assert sides._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted((r["k_market_id"], r["copies"], r["prev_copies"]) for r in sides.collect())[-2:] == [("now", 1, None), ("then", None, 1)]


def test_one_table_of_both_snapshots_gives_the_same_reports(table, spark):
    """F2 of round 4: copies, nulls, rows without identity in several parts and rows on one side only, unsorted too."""
    rows = [
        {"market_id": f"m{i % 11}", "outcome": f"o{i % 3}", "probability": (i * 7 % 13) / 13, "observed_at": T0 if i % 4 == 1 else T1, "topics": ["us_macro"] * (i % 3), "event_id": None if i % 5 == 0 else f"e{i}"}
        for i in range(60)
    ]
    odd = [{"market_id": None, "outcome": str(i % 2), "probability": i / 10, "observed_at": T1} for i in range(7)] + [{"platform": None}, {"observed_at": "never", "market_id": "n"}]
    both = table(*rows, *odd).withColumn("now", F.col("row_pos") % 4 != 1).withColumn("part", F.when(F.col("market_id").isNull(), F.col("row_pos")).otherwise(F.hash("market_id")))
    unknown = both.limit(1).withColumn("now", F.lit(None).cast("boolean")).withColumn("market_id", F.lit("left out"))
    want = S.analyze(both.filter("now"), both.filter("NOT now"))
    got = S.analyze_marked(both.unionByName(unknown), "now", "part")
    loose = S.analyze_marked(both.unionByName(unknown), "now", "part", ordered=False)
    by_text = lambda df: sorted(str(r.asDict()) for r in df.collect())
    for name, df in want.items():
        assert by_text(got[name]) == by_text(df) == by_text(loose[name]), name
        assert got[name].columns == df.columns == loose[name].columns
    for name in ("changes", "watchlist", "topic_market_counts", "new_coverage", "disappeared_coverage"):
        assert [str(r) for r in got[name].collect()] == [str(r) for r in want[name].collect()], name
    assert want["changes"].count() and want["skipped_comparisons"].count() and want["disappeared_coverage"].count()


def test_the_report_shuffles_each_row_once_and_sorts_none(spark, monkeypatch):
    """F2 of round 4: rows went through a shuffle for the join, for each side, for both sides and for each sorted report."""
    written = []
    monkeypatch.setattr(S, "stored", lambda df, path=None, tidy=False: written.append((df, tidy)) or stored(df, path, tidy))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = report(spark, "/root/testdata/sf0.001")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan(out)
        ((sides, tidy),) = written
        # Rows with and without identity are scanned apart: two shuffles each for the join, one more for the few without.
        exchanges = [line for line in plan(sides).split("\n") if "Exchange" in line]
        assert tidy and len(exchanges) == 5 and sum("k_market_id" in line for line in exchanges) == 1, exchanges
        assert "first_pos" not in sides.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_tidy_table_leaves_no_shuffle_files_and_no_setting(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "k")
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert stored(rows, str(tmp_path / "t"), tidy=True).count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before

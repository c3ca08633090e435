import json

import pytest
from pyspark.sql import functions as F

from oddslake import schemas
from oddslake.operators import collect, discover
from oddslake.operators.topics import classify
from oddslake.sources.taxonomy import Taxonomy


def events(spark, *items):
    rows = [(json.dumps(e), "2026-09-07T12:00:00+00:00", i, e.get("series_ticker")) for i, e in enumerate(items)]
    return spark.createDataFrame(rows, "event STRING, observed_at STRING, row_pos BIGINT, series_ticker STRING")


def series_table(spark, *items):
    return spark.createDataFrame([json.dumps(s) for s in items], "string").select(
        F.from_json("value", schemas.KALSHI_SERIES).alias("s")
    ).select("s.*")


def test_first_copy_of_a_market_stays_and_closed_ones_go(spark):
    def market(key, question, **more):
        return {"id": key, "question": question, "conditionId": f"0x{key}", "outcomes": ["Up", "Down"], "clobTokenIds": [f"{key}u", f"{key}d"], "active": True, **more}

    fed = {"id": "macro-1", "title": "Federal Reserve decision in March", "markets": [market("rate", "Will the Fed cut rates?"), market("old", "Will the Fed hold?", closed=True)]}
    again = {"id": "macro-2", "title": "Rates, copied", "markets": [market("rate", "Another wording"), {"question": "without any id"}]}
    plain = {"id": "fun", "title": "Board games", "markets": [market("go", "Will black win the final?")]}
    out = discover.discover(events(spark, fed, again, plain, plain), None, None)
    kept = {r["candidate_id"]: json.loads(r["event"]) for r in out["candidates"].collect()}
    assert set(kept) == {"rate", "go"} and kept["rate"] == {"id": "macro-1", "title": "Federal Reserve decision in March"}
    assert sorted(r["token_id"] for r in out["markets"].collect()) == ["rated", "rateu"]
    (coverage,) = out["coverage"].collect()
    assert (coverage["candidate_markets"], coverage["selected_outcome_rows"], coverage["unclassified_markets"]) == (2, 2, 1)
    counters = {r["counter"]: r["n"] for r in out["counters"].collect()}
    assert counters == {"polymarket_events": 3, "candidate_markets": 2, "selected_outcome_rows": 2}
    assert out["warnings"].count() == 0


SEATED = "Resolves for the party of the {} seated for the term starting 2027."


@pytest.fixture
def senate(spark):
    """Four election series and one foreign; events of which some prove their cycle by ticker and rule."""
    kinds = [
        ("UNUSED", "Governor races", 0, []), ("SEATS", "Senate Race Winner", 40, []), ("CHAMBER", "House control", 7, []),
        ("PRIMARY", "Senate primary nominee", 900, []), ("ABROAD", "Senate control", 5000, ["Foreign"]),
    ]
    series = series_table(spark, *[{"ticker": t, "title": n, "category": "Elections", "tags": g, "volume_fp": str(v)} for t, n, v, g in kinds])

    def event(ticker, series_ticker, rule, status="active"):
        return {"event_ticker": ticker, "series_ticker": series_ticker, "title": f"Who takes {ticker}?", "markets": [{"ticker": f"{ticker}-X", "title": "Party X wins", "status": status, "rules_primary": rule}]}

    proven = SEATED.format("Senator")
    landed = events(
        spark, event("SEATS-OH-26", "SEATS", proven), event("SEATS-OH-28", "SEATS", proven), event("SEATS-ME-26", "SEATS", "Resolves by count."),
        event("CHAMBER-2026", "CHAMBER", SEATED.format("House member")), event("SEATS-TX-26", "SEATS", proven, "settled"), event("ABROAD-26", "ABROAD", proven),
    )
    return series, landed


def test_series_are_ranked_and_events_prove_their_cycle(senate):
    series, landed = senate
    out = discover.discover(None, series, landed, topics=["midterms_2026"])
    assert [r["ticker"] for r in out["series_selected"].collect()] == ["CHAMBER", "SEATS", "PRIMARY", "UNUSED"]
    got = [r["market_id"] for r in out["markets"].orderBy("row_pos").collect()]
    assert got == ["CHAMBER-2026-X", "SEATS-OH-26-X"]
    shown = {json.loads(r["event"])["event_ticker"]: json.loads(r["event"]) for r in out["candidates"].collect()}
    assert set(shown) == {"CHAMBER-2026", "SEATS-OH-26", "SEATS-OH-28", "SEATS-ME-26"}
    evidence = shown["SEATS-OH-26"]["derived_election_cycle_evidence"]
    assert evidence == {"event_ticker": "SEATS-OH-26", "rule": SEATED.format("Senator"), "basis": discover.CYCLE_BASIS}
    assert shown["SEATS-OH-26"]["derived_election_cycle"] in (2026, "2026")
    for ticker in ("SEATS-OH-28", "SEATS-ME-26"):
        assert not {"derived_election_cycle", "derived_election_cycle_evidence"} & set(shown[ticker])
    counters = {r["counter"]: r["n"] for r in out["counters"].collect()}
    assert counters == {"kalshi_series_matching": 4, "kalshi_series_selected": 4, "kalshi_events": 5, "candidate_markets": 4, "selected_outcome_rows": 2}
    assert out["warnings"].count() == 0


def test_discovery_warns_of_what_it_leaves_out(senate):
    series, landed = senate
    out = discover.discover(None, series, landed, topics=["midterms_2026"], max_series=1, include_closed=True)
    assert [r["ticker"] for r in out["series_selected"].collect()] == ["CHAMBER"]
    said = sorted(r["warning"] for r in out["warnings"].collect())
    assert said == sorted([discover.SERIES_LIMITED % (1, 4), discover.ARCHIVED_LEFT_OUT])
    out = discover.discover(None, series, landed, series_tickers=["ABROAD", "ZETA", "ALPHA"], topics=["midterms_2026"])
    assert [(r["ticker"], r["priority"]) for r in out["series_selected"].collect()] == [("ABROAD", 0)]
    assert [r["warning"] for r in out["warnings"].collect()] == [discover.SERIES_ABSENT + "ALPHA, ZETA"]
    assert [r["ticker"] for r in out["series_absent"].collect()] == ["ALPHA", "ZETA"]
    with pytest.raises(ValueError, match="Unknown topics"):
        discover.discover(None, series, None, topics=["nope"])


def test_all_contracts_of_discovery_can_be_chosen(senate, spark):
    """Positions are structs; a limit above a hundred and none take the same way."""
    series, landed = senate
    rows = discover.discover(None, series, landed, topics=["midterms_2026"])["markets"]
    for limit in (None, 1, 101):
        chosen, notice = collect.select_contracts(rows, limit)
        assert chosen.count() == min(2, limit or 2)
        assert (notice.first()["warning"] is not None) == (limit == 1)


def test_official_sources_are_noted(spark):
    series = series_table(
        spark,
        {"title": "Jobs added", "ticker": "JOBS", "settlement_sources": [{"name": "A blog", "url": "https://example.org"}, {"name": "Labor statistics", "url": "http://WWW.bls.gov/x"}]},
        {"title": "Bills", "tags": ["Law"], "settlement_sources": [{"name": "Copy", "url": "https://mycongress.gov"}, {"name": "Clerk", "url": "https://a.congress.gov/b"}]},
        {"title": "Rain", "category": "Weather", "tags": []},
    )
    rows = classify(discover.series_context(series), "context").collect()
    note = discover.OFFICIAL_NOTE
    assert [r["context"] for r in rows] == [f"Jobs added JOBS  {note}Labor statistics", f"Bills   ['Law']{note}Clerk", "Rain  Weather "]
    assert "fed_monetary_policy" not in rows[0]["topics"]


def test_close_races_come_before_clear_and_unquoted_ones(spark):
    def quoted(bid, ask, **more):
        return json.dumps({"yes_bid_dollars": str(bid), "yes_ask_dollars": str(ask), **more})

    sets = [
        [quoted(0.2, 0.9)], [quoted(0.05, 0.09, volume_24h_fp="80"), quoted(0.3, 0.4, volume_24h_fp="1")], [json.dumps({"yes_bid": 44, "yes_ask": 50})],
        [quoted(0.5, 0.5, yes_ask_size_fp="0")], [quoted(0.42, 0.52, volume_24h_fp="5")],
    ]
    df = spark.createDataFrame(list(enumerate(sets)), "i INT, ms ARRAY<STRING>")
    order = [r["i"] for r in df.orderBy(discover.event_priority(F.col("ms")), "i").collect()]
    assert order == [4, 2, 1, 0, 3]
    flat = df.select("i", F.explode("ms").alias("market")).withColumns(discover.quote_columns())
    ranked = discover.event_closeness(flat, ["i"]).collect()
    assert [r["i"] for r in ranked] == order and [r["distance"] is None for r in ranked] == [False, False, False, True, True]


def test_cycle_needs_ticker_and_rule(spark):
    rule, other = SEATED.format("member of Congress"), "Resolves on the day of the vote."
    cases = [("A-26", [other, rule]), ("A-27", [rule]), ("A-2026", [other]), ("A-2026", [None]), ("B-2026", [rule]), ("26", [rule])]
    rows = [(t, [json.dumps({"rules_primary": r}) for r in rules]) for t, rules in cases]
    df = spark.createDataFrame(rows, "t STRING, ms ARRAY<STRING>")
    got = [r[0] for r in df.select(discover.cycle_evidence(F.col("t"), F.col("ms"))).collect()]
    assert [g and (g["year"], g["event_ticker"], g["rule"]) for g in got] == [(2026, "A-26", rule), None, None, None, (2026, "B-2026", rule), None]


def test_query_match_and_selection(spark):
    df = spark.createDataFrame([("The Senate race",), ("senators",), ("who and the",)], "t STRING")
    run = lambda q: [r[0] for r in df.select(discover.query_match(F.col("t"), q)).collect()]
    assert run(["Senate in US"]) == [True, False, False]
    assert run(["who will the"]) == [False, False, False]
    assert run(None) == [True, True, True]
    ok = {"acceptingOrders": True, "enableOrderBook": True, "conditionId": "c", "clobTokenIds": '["1"]'}
    ms = [
        {**ok, "outcomePrices": '["0.5","0.5"]', "volume24hr": 5}, {**ok, "outcomePrices": '["0.5","0.5"]', "volume24hr": 9},
        {**ok, "outcomePrices": '["0.01","0.99"]', "volume24hr": 90}, {**ok, "clobTokenIds": "[]"}, {**ok, "conditionId": ""}, {**ok, "acceptingOrders": False},
    ]
    table = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(ms)], "i INT, market STRING")
    chosen = discover.selectable_markets(table)
    assert sorted(r["i"] for r in chosen.collect()) == [0, 1, 2]
    assert discover.sample_market(chosen, F.col("i")).first()["i"] == 1


def outcome_rows(spark):
    ddl = "platform STRING, market_id STRING, outcome STRING, token_id STRING, condition_id STRING, event_id STRING, series_id STRING, row_pos BIGINT"
    return spark.createDataFrame(
        [
            ("polymarket", "g1", "Yes", "t1", "0xc", "7", None, 0), ("polymarket", "g1", "No", None, None, "7", None, 1),
            ("polymarket", "0xd", "Yes", "t3", None, None, None, 2), ("polymarket", "g3", "Yes", "t4", None, None, None, 3),
            ("kalshi", "K1", "Yes", None, None, None, "S", 4), ("kalshi", "K2", "Yes", None, None, None, None, 5),
        ],
        ddl,
    )


def test_contract_routing_and_interleave(spark):
    rows = outcome_rows(spark)
    chosen, notice = collect.select_contracts(rows, 3)
    assert [r["market_id"] for r in chosen.collect()] == ["g1", "K1", "0xd"]
    assert notice.first()["warning"] == "Collection limited to 3 of 5 contracts"
    out = collect.dataset_routes(rows, ["books", "trades", "history", "comments", "holders"])
    routes = {(r["market_id"], r["dataset"], r["id"]) for r in out["routes"].collect()}
    assert routes == {
        ("g1", "books", "t1"), ("g1", "history", "t1"), ("0xd", "books", "t3"), ("0xd", "history", "t3"),
        ("g3", "books", "t4"), ("g3", "history", "t4"), ("g1", "trades", "0xc"), ("g1", "holders", "0xc"),
        ("0xd", "trades", "0xd"), ("0xd", "holders", "0xd"), ("g1", "comments", "7"),
        ("K1", "books", "K1"), ("K1", "trades", "K1"), ("K1", "history", "K1"), ("K2", "books", "K2"), ("K2", "trades", "K2"),
    }
    errors = sorted((r["operation"], r["error"].split(";")[0]) for r in out["errors"].collect())
    assert errors == [
        ("kalshi:K2:candles", "Missing series_id"), ("polymarket:g1", "Missing outcome token ID"),
        ("polymarket:g3", "Missing condition_id for Data API"),
    ]
    warnings = out["warnings"].collect()
    assert len(warnings) == 2 and "comments, holders" in warnings[0]["warning"]
    with pytest.raises(ValueError, match="Unknown datasets: x"):
        collect.dataset_routes(rows, ["x"])


def test_collect_joins_each_dataset_on_its_id(spark):
    t = lambda *r: spark.createDataFrame(list(r), "id STRING, v STRING")
    out = collect.collect_datasets(
        outcome_rows(spark),
        {"polymarket": {"history": t(("t1", "h"), ("0xc", "wrong")), "trades": t(("0xc", "p"), ("t1", "wrong"))}, "kalshi": {"trades": t(("K1", "k"))}},
        max_markets=2,
    )
    got = lambda name: [(r["market_id"], r["v"]) for r in out[name].collect()]
    assert got("polymarket_history") == [("g1", "h")]
    assert got("polymarket_trades") == [("g1", "p")]
    assert got("kalshi_trades") == [("K1", "k")]


def test_taxonomy_dimensions(spark):
    dims = Taxonomy.default().dimensions(spark)
    assert dims["topic_sectors"].filter("topic = 'us_politics'").count() == 1


def test_venues_take_turns_under_any_limit(spark):
    rows = [("a" if i % 4 else "b", str(i), i * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "platform STRING, market_id STRING, first_pos BIGINT")
    queues = {v: [m for p, m, _ in rows if p == v] for v in "ba"}  # "b" holds the first row
    turns = [queues[v][i] for i in range(300) for v in "ba" if i < len(queues[v])]
    for limit in (50, 250):
        assert [r["market_id"] for r in discover.interleave(df, limit).collect()] == turns[:limit]


def test_collection_keeps_to_the_range_and_merges_the_archive(spark):
    rows = spark.createDataFrame([("kalshi", f"K{i}", "S", i) for i in range(3)], "platform STRING, market_id STRING, series_id STRING, row_pos BIGINT")
    ddl = "id STRING, ts BIGINT, trade_key STRING, row_pos BIGINT, v STRING"
    live = spark.createDataFrame([("K0", 100, "a", 1, "live"), ("K0", 99, "b", 2, "live"), ("K0", 200, "c", 3, "live"), ("K1", 150, "d", 4, "live"), ("Q", 150, "e", 5, "live")], ddl)
    archive = spark.createDataFrame([("K0", 100, "a", 1, "archive"), ("K0", 120, "f", 2, "archive"), ("K2", 300, "g", 3, "archive")], ddl)
    cutoffs = spark.createDataFrame([("kalshi", "1970-01-01T00:02:30Z")], "platform STRING, trades_created_ts STRING")

    def run(**more):
        out = collect.collect_datasets(rows, {"kalshi": {"trades": live}}, archives={"kalshi": {"trades": archive}}, cutoffs=cutoffs, **more)
        return [(r["market_id"], r["ts"], r["trade_key"], r["v"]) for r in out["kalshi_trades"].collect()]

    assert run(start=100, end=200) == [("K0", 100, "a", "archive"), ("K0", 120, "f", "archive"), ("K1", 150, "d", "live")]
    assert run(start=160, end=400) == [("K0", 200, "c", "live")]
    assert run(run_epoch=201 + 0) == [("K0", 99, "b", "live"), ("K0", 100, "a", "archive"), ("K0", 120, "f", "archive"), ("K0", 200, "c", "live"), ("K1", 150, "d", "live")]
    with pytest.raises(Exception, match="end must be after start"):
        run(start=5, end=5)


def test_candles_of_a_range_are_routed_and_in_order(spark):
    rows = spark.createDataFrame([("kalshi", "K0", None, "S", 0), ("kalshi", "K1", None, None, 1)], "platform STRING, market_id STRING, series_id STRING, series_ticker STRING, row_pos BIGINT")
    ddl = "id STRING, ts BIGINT, ticker STRING, end_period_ts BIGINT, row_pos BIGINT, v STRING"
    step = 60 * 4000
    candle = lambda t, pos, v: ("K0", t, "K0", t, pos, v)
    live = spark.createDataFrame([candle(step - 60, 1, "live"), candle(60, 0, "live")], ddl)
    archive = spark.createDataFrame([candle(120, 0, "archive"), candle(2 * step - 60, 2, "archive"), candle(5 * step, 3, "archive")], ddl)
    out = collect.collect_datasets(rows, {"kalshi": {"history": live}}, archives={"kalshi": {"history": archive}}, start=0, end=2 * step, period_minutes=1)
    got = [(r["end_period_ts"], r["tier"]) for r in out["kalshi_history"].collect()]
    assert got == [(60, "live"), (step - 60, "live"), (2 * step - 60, "archive")]
    assert [r["error"] for r in out["errors"].collect()] == [collect.NO_SERIES]

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from oddslake.operators import books, history, timewindows


def yes(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id INT, data STRING")
    return books.yes_book(df).orderBy("id").collect()


def test_yes_book(spark):
    cases = {
        "both": {"orderbook_fp": {"yes_dollars": [["0.11", "7"], ["0.125", "0.5"]], "no_dollars": [["0.75", "3"], ["0.8", "2.5"]]}},
        "one side": {"orderbook_fp": {"yes_dollars": None, "no_dollars": [["0.6", "9"]]}},
        "cents": {"orderbook": {"yes": [[12, 30], [31, 4]], "no": [[64, 8]]}},
        "dollars win": {"yes_dollars": [["0.07", "1"]], "yes": [[90, 90]]},
        "not a number": {"no_dollars": [["inf", "2"]]},
        "beyond one": {"yes_dollars": [["1.0001", "2"]]},
        "no size": {"no_dollars": [["0.33"]]},
        "empty level": {"yes_dollars": [["0.9", "0"], ["0.66", "2"]], "no_dollars": [["0.5", "6"]]},
    }
    got = dict(zip(cases, yes(spark, *[json.dumps(c) for c in cases.values()]), strict=True))
    d = Decimal
    both = got["both"]
    assert (both["best_bid"], both["best_ask"], both["midpoint"], both["spread"], both["crossed"]) == (d("0.125"), d("0.2"), d("0.1625"), d("0.075"), False)
    assert [(x["price"], x["size"]) for x in both["yes_asks"]] == [(d("0.2"), d("2.5")), (d("0.25"), d("3"))]
    assert [x["price"] for x in both["yes_bids"]] == [d("0.125"), d("0.11")]
    assert (got["one side"]["best_bid"], got["one side"]["best_ask"], got["one side"]["midpoint"]) == (None, d("0.4"), None)
    assert (got["cents"]["best_bid"], got["cents"]["best_ask"]) == (d("0.31"), d("0.36"))
    assert [x["price"] for x in got["dollars win"]["yes_bids"]] == [d("0.07")] and got["dollars win"]["yes_asks"] == []
    for name in ("not a number", "beyond one", "no size"):
        assert got[name]["book_error"] == "invalid price or quantity" and got[name]["best_ask"] is None
    assert len(got["empty level"]["yes_bids"]) == 1 and got["empty level"]["crossed"] is True
    bad = spark.createDataFrame([(json.dumps(cases["beyond one"]),)], "data STRING")
    with pytest.raises(Exception, match="invalid price or quantity"):
        books.yes_book(bad, strict=True).collect()


def test_clob_touch_and_ladder(spark):
    raw = '{"asset_id":"t","market":"0x","bids":[{"price":"0.1","size":"5"},{"price":"0.3","size":"2"}],"asks":[{"price":"0.9","size":"1"},{"price":"0.5","size":"1"}]}'
    levels = books.clob_levels(spark.createDataFrame([(raw,), ('{"asset_id":"u","bids":[]}',)], "data STRING"))
    (touch,) = books.book_touch(levels, ["token_id"]).collect()
    assert (touch["best_bid"], touch["best_ask"], touch["midpoint"]) == (Decimal("0.3"), Decimal("0.5"), Decimal("0.4"))
    prices = [str(r["price"].normalize()) for r in books.ladder(levels, ["token_id"]).collect()]
    assert prices == ["0.3", "0.1", "0.5", "0.9"]


def test_trade_merge_prefers_last_value_and_first_place(spark):
    ddl = "payload STRING, row_pos BIGINT"
    live = history.kalshi_trades(
        spark.createDataFrame(
            [('{"trade_id":"x","yes_price_dollars":"0.25"}', 0), ('{"a":1,"b":2}', 1), ('{"trade_id":"y","yes_price_dollars":"0.5","created_time":"2026-01-01T00:00:00Z"}', 2)],
            ddl,
        )
    )
    archive = history.kalshi_trades(
        spark.createDataFrame([('{"trade_id":"x","yes_price_dollars":"0.26"}', 0), ('{"b":2,"a":1}', 1)], ddl)
    )
    rows = history.merge_latest(live, archive, ["trade_key"]).orderBy("first_tier", "first_pos").collect()
    assert [(r["trade_id"], r["price"]) for r in rows] == [("x", 0.26), (None, None), ("y", 0.5)]


def test_candles_route_and_dedupe(spark):
    ddl = "ticker STRING, end_period_ts BIGINT, v STRING, row_pos BIGINT"
    live = spark.createDataFrame(
        [("A", 5, "l5", 0), ("A", 25, "l25", 1), ("B", 5, "l5", 2), ("B", 25, "l25", 3), ("A", 10, "l10", 4)], ddl
    )
    archive = spark.createDataFrame(
        [("A", 5, "a5", 0), ("A", 15, "a15", 1), ("A", 25, "a25", 2), ("B", 15, "a15", 3), ("C", 1, "a1", 4), ("A", 20, "a20", 5)],
        ddl,
    )
    archived = spark.createDataFrame([("A",), ("C",)], "ticker STRING")
    rows = history.route_candles(live, archive, archived, 0, 40, 10).collect()
    got = sorted((r["ticker"], r["v"]) for r in rows)
    # A: windows 0 and 1 hold live candles (10 lies on their border), window 2 holds 25 live.
    assert got == [("A", "l10"), ("A", "l25"), ("A", "l5"), ("B", "l25"), ("B", "l5"), ("C", "a1")]
    live2 = live.filter("v <> 'l10'")
    got = sorted((r["ticker"], r["v"]) for r in history.route_candles(live2, archive, archived, 0, 40, 10).collect())
    assert got == [("A", "a15"), ("A", "a20"), ("A", "a25"), ("A", "l5"), ("B", "l25"), ("B", "l5"), ("C", "a1")]
    dup = spark.createDataFrame([("A", 1, "p", 0), ("A", 1, "q", 1), ("A", None, "r", 2), ("A", None, "s", 3)], ddl)
    assert [r["v"] for r in history.dedupe_candles(dup).collect()] == ["q"]
    assert sorted(r["v"] for r in history.dedupe_candles(dup, keep="first").collect()) == ["p", "r", "s"]
    flat = spark.createDataFrame(
        [("A", '{"end_period_ts":50,"price":{"close":"0.42"},"volume":"7"}'), ("A", '{"end_period_ts":60,"price":{"close_dollars":"0.5"},"yes_bid":{"close_dollars":"0.4"}}')],
        "ticker STRING, payload STRING",
    )
    rows = history.candles(flat, "archive").orderBy("end_period_ts").collect()
    assert [(r["trade_close"], r["bid_close"], r["volume"]) for r in rows] == [(0.42, None, 7.0), (0.5, 0.4, None)]


def test_points_holders_details_tiers(spark):
    hist = spark.createDataFrame(
        [("t", '{"history":[{"t":10,"p":0.5},{"t":20,"p":0.6}]}', 0), ("t", '{"history":[{"t":20,"p":0.7}]}', 1)],
        "token_id STRING, payload STRING, row_pos BIGINT",
    )
    points = history.dedupe_points(history.price_points(hist)).orderBy("t").collect()
    assert [(r["t"], r["p"]) for r in points] == [(10, 0.5), (20, 0.7)]
    h = spark.createDataFrame([('{"token":"a","holders":[{"proxyWallet":"w","amount":1.5,"outcomeIndex":1}]}',)], "payload STRING")
    assert history.holders(h).first().asDict() == {"token": "a", "wallet": "w", "amount": 1.5, "outcome_index": 1}
    t = lambda *r: spark.createDataFrame(list(r), "ticker STRING, payload STRING")
    contracts = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker STRING")
    rows = history.market_details(contracts, t(("a", "1")), t(("a", "x"), ("b", "2"))).orderBy("ticker").collect()
    assert [(r["details"], r["details_tier"]) for r in rows] == [("1", "live"), ("2", "archive"), (None, None)]
    ranges = spark.createDataFrame([("kalshi", 1, 200), ("kalshi", 200, 300), ("polymarket", 1, 2)], "platform STRING, start_ts BIGINT, end_ts BIGINT")
    cut = spark.createDataFrame([("kalshi", "1970-01-01T00:01:40Z")], "platform STRING, trades_created_ts STRING")
    got = {(r["platform"], r["start_ts"]): r["tiers"] for r in history.trade_tiers(ranges, cut).collect()}
    assert got == {("kalshi", 1): "live+archive", ("kalshi", 200): "live", ("polymarket", 1): "live"}


def test_windows(spark):
    r = lambda *x: spark.createDataFrame([x], "start_ts BIGINT, end_ts BIGINT")
    pairs = lambda df: [(w["window_start"], w["window_end"]) for w in df.orderBy("window_start").collect()]
    assert pairs(timewindows.time_windows(r(1, 10), 4)) == [(1, 5), (5, 9), (9, 10)]
    with pytest.raises(Exception, match="end must be after start"):
        timewindows.time_windows(r(10, 1), 4).collect()
    with pytest.raises(ValueError):
        timewindows.time_windows(r(1, 2), 0)
    assert pairs(timewindows.candle_windows(r(0, 120), 1, bars_per_window=1)) == [(0, 59), (60, 119), (120, 120)]
    cut = timewindows.candle_windows(r(0, 1000), 1, bars_per_window=1, max_windows=2)
    assert pairs(cut) == [(0, 59), (60, 119)] and cut.first()["truncated"]
    with pytest.raises(ValueError):
        timewindows.candle_windows(r(0, 60), 5)
    b = spark.createDataFrame([(0, 86400, 100), (0, 3600, 2)], "start_ts BIGINT, end_ts BIGINT, n_tickers INT")
    assert [x["fits"] for x in timewindows.candle_budget(b, 1).orderBy("end_ts").collect()] == [True, False]


def bisect_by_hand(times, lo, hi, capacity):
    n = sum(lo <= t <= hi for t in times)
    if n < capacity or lo == hi:
        return [(lo, hi, n, n >= capacity)]
    mid = (lo + hi) // 2
    return bisect_by_hand(times, lo, mid, capacity) + bisect_by_hand(times, mid + 1, hi, capacity)


def test_first_gap_over_many_windows(spark):
    """Bitmaps of several words, a full one, markets without live candles and markets not archived."""
    live = {"full word": range(62), "two words": [*range(70), 80], "gap": [0, 1, 3], "late": [5, 64], "far": [*range(40), *range(62, 124)], "not archived": range(3)}
    df = spark.createDataFrame([(t, i) for t, places in live.items() for i in [*places, *places]], "ticker STRING, window_index BIGINT")
    archived = spark.createDataFrame([(t,) for t in [*live, "no candle", "gap"] if t != "not archived"], "ticker STRING")
    got = {r["ticker"]: r["switch_index"] for r in history._first_gap(df, archived).collect()}
    assert got == {"full word": 62, "two words": 70, "gap": 2, "late": 0, "far": 40, "no candle": 0}


@pytest.mark.parametrize("start,end,times", [
    (1, 2, [1] * 3 + [2] * 3),
    (1, 1, [1] * 9),
    (3, 40, [3, 3, 3, 9, 9, 9, 9, 9, 17, 18, 19, 20, 21, 40]),
    (5, 12, [6]),
])
def test_saturated_split_matches_bisection(spark, start, end, times):
    df = spark.createDataFrame([("m", t) for t in times], "market STRING, t BIGINT")
    rows = timewindows.split_saturated(df, ["market"], "t", start, end, 2, 2).orderBy("window_start").collect()
    got = [(r["window_start"], r["window_end"], r["n_rows"], r["over_budget"]) for r in rows]
    assert got == bisect_by_hand(times, start, end, 4)


@pytest.mark.parametrize(("span", "pages"), [(1000, 1), (77, 3)])
def test_saturated_split_of_many_keys(spark, span, pages):
    """Random times, one second with a third of all rows, crowded neighbours, rows outside the range and null times."""
    rng, rows = random.Random(span), []
    for key in ("a", "b", None):
        rows += [(key, rng.randrange(-5, span + 5)) for _ in range(60)] + [(key, 11)] * 40 + [(key, 40 + rng.randrange(3)) for _ in range(20)] + [(key, None)]
    df = spark.createDataFrame(rows, "market STRING, t BIGINT").repartition(5)
    got = timewindows.split_saturated(df.filter(F.col("market").isNotNull()), ["market"], "t", 0, span, 2, 2 * pages).collect()
    for key in ("a", "b"):
        mine = sorted((r["window_start"], r["window_end"], r["n_rows"], r["over_budget"]) for r in got if r["market"] == key)
        assert mine == bisect_by_hand([t for k, t in rows if k == key and t is not None], 0, span, (pages + 1) * 2)


def test_default_range(spark):
    ddl = "s BIGINT, e BIGINT"
    run = F.lit(10_000_000)
    pick = lambda rows: [
        tuple(r) for r in spark.createDataFrame(rows, ddl).select(*timewindows.default_range(F.col("s"), F.col("e"), run)).collect()
    ]
    week = 7 * 86400
    assert pick([(None, None), (5, 9), (None, 700_000)]) == [(10_000_000 - week, 10_000_000), (5, 9), (700_000 - week, 700_000)]
    with pytest.raises(Exception, match="end must be after start"):
        pick([(9, 9)])

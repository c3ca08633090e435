"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oddslake.plans import QUERIES  # noqa: E402
from oddslake.session import local_session  # noqa: E402

HEADLINE = [
    "snapshot_changes", "snapshot_skipped", "snapshot_watchlist", "new_coverage", "topic_market_counts", "snapshot_summary",
    "normalize_kalshi_quotes", "normalize_polymarket_outcomes", "yes_book_touch", "market_book_touch", "topic_labels",
    "topic_evidence_terms", "default_topic_labels", "trade_merge_dedupe", "price_points_dedupe", "candle_tier_routing",
    "saturated_windows", "series_rank_topk", "event_closeness", "candidates_first_wins", "venue_interleave", "dataset_routes",
    "retry_audit", "pagination_audit", "envelope_rows", "sequence_gaps", "frame_segments", "stream_summary", "csv_safe_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", int(cores) if cores.isdigit() else 8)
    known = {q.name: q for q in QUERIES}
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


main()

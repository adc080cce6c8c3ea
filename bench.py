"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each."""

import json
import os
import signal
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

HEADLINES = [
    "price_stats_grouping_sets",
    "search_page",
    "facet_counts",
    "features_union_view",
    "band_join_comparables",
    "market_then_any",
    "street_sales",
    "previous_sale",
    "group_history",
    "change_detection",
    "rolling_spend_24h",
    "asof_previous",
    "keyed_upsert",
    "containing_area",
    "nearest_line",
    "ambiguity_cutoff_match",
    "text_search_relevance",
    "content_fingerprint",
]
#: Takes far longer than all others together (README, Open); asked for by BENCH_SIGNALS=1.
SLOW = ["market_signals"]


def main() -> None:
    from plotline.plans.registry import QUERIES
    from plotline.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    took = {}

    def told() -> None:
        print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)

    def ended(*_) -> None:
        told()  # those that are done
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in HEADLINES + (SLOW if os.environ.get("BENCH_SIGNALS") == "1" else []):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    told()
    spark.stop()


if __name__ == "__main__":
    main()

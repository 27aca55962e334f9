"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Each query runs once untimed and then twice; the best
of the two counts.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINES = [
    "a01_categories", "a03_merchants", "a05_spending_by_month", "a06_duplicate_charges",
    "a07_subcategory_stats", "a12_loan_summary", "a15_live_summary", "a16_portfolio_summary",
    "a18_ledger_stats", "p02_find_transactions", "p09_loan_rows", "j02_pair_in_order",
    "j04_latest_balance", "j03_not_yet_enriched", "f06_enriched_bank", "f29_enriched_card",
    "s09_duplicate_files", "s18_upsert_enrichment", "t02_dcu_checking", "t04_boa",
    "w05_last_six_turns", "s04_text_lines",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks import load
    from pennywright.session import recommended

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = recommended(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
QUERIES = ("profile_customer_c_name", "profile_events_props", "profile_pages_url", "profile_part_p_brand", "position_stats", "tokenize_pages_url", "anomalies_orders_vs_customer", "merge_profiles", "tokens_of_documents")
SLOW = ("profile_documents_text",)  # free text: minutes of edit distances, so only with BENCH_SLOW=1


def main() -> None:
    from pyspark.sql import SparkSession

    from glyphloom.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    queries, took = catalog.queries(), {}
    for name in QUERIES + (SLOW if os.environ.get("BENCH_SLOW") else ()):
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()

"""Headline queries on one machine: prints one JSON line of seconds for each."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["sort_pos", "sort_dup_rank", "sort_key_be_signed", "argsort_take", "run_value_gather", "splitters_d3", "merge_k_way", "merge_by_parts", "verify_inversions", "multiset_check"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sortweave.plans.queries import QUERIES

    def orderby(s, d):
        return s.read.parquet(f"{d}/lineitem.parquet").orderBy("l_orderkey")

    took = {}
    for name, f in [("lineitem_orderby", orderby), *((n, QUERIES[n]) for n in HEADLINE)]:
        times = []
        for _ in range(2):
            began = time.time()
            f(spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

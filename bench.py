"""Times the queries over the reference's operators; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyframe.plans.catalogue import QUERIES

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in sorted(QUERIES):
        each = []
        for _ in range(1 + RUNS):  # the first warms up
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "fact_and_text_queries_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Seconds per headline query; one JSON line."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from cairn.jobs import queries as core

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.local.dir", f"{scratch}/local").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.checkpoint.dir", f"file://{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in core.queries().items():
        runs = []
        for _ in range(RUNS):
            began = time.time()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF)}))


if __name__ == "__main__":
    main()

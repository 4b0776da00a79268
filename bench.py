"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from glyphsift import queries

HEADLINE = ("top_network_indicators", "ext_1_byte_offsets", "ext_2_utf8_runs", "rnk_10_score", "agg_1_dedup", "agg_4_count_by_tag", "agg_6_distinct", "win_4_top_per_container", "joi_4_diff", "set_2_except_all", "fil_8_profile_security", "srt_2_top_n", "snk_6_csv")


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the text that the scoring query reads, and a first run that starts the workers
    texts = sum(spark.read.parquet(f"{data}/{t}.parquet").selectExpr(f"sum(octet_length({c})) AS n").first()["n"] for t, c in (("documents", "text"), ("pages", "url"), ("pages", "html"), ("conversations", "text"), ("events", "props")))
    queries.QUERIES["agg_6_distinct"](spark, data).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf"), "scored_mb_per_s": round(texts / 1e6 / took["rnk_10_score"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()

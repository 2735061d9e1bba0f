"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from termloom import queries as core

HEADLINE = ("term_dictionary", "field_meta", "seek_exact", "postings_delta", "block128_width", "prefix_blocks", "floor_block_lookup", "fst_int_outputs", "fst_match_key", "byte_codec_round_trip")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    all_queries, took = core.queries(), {}
    all_queries["term_dictionary"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.time()
        all_queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

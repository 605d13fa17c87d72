"""Time the headline queries and print one JSON line.

Every query is run to the end into a sink that discards its rows: once to warm up, then ``BENCH_RUNS`` times (default 2),
of which the fastest counts. Preparing a query (feeds, stored tables) is part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gramlode.plans.registry import QUERIES
from gramlode.session import build_session

HEADLINE = [
    "clean_bigrams",
    "gram_counts_per_job",
    "keyword_counts",
    "keyword_counts_large",
    "counts_wide",
    "job_semi",
    "snippet_sample",
    "surface_dict",
    "bigram_count",
    "bigram_topk",
    "synonym_candidates",
    "label_score",
    "page_json",
    "xml_framed_scan",
    "archive_keyword_counts",
    "counts_sink",
    "job_keyword_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

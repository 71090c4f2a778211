"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Each query is built and written to the noop sink, so all
its rows are worked out; a first pass over small queries warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tarnseek.plans.registered import all_queries
from tarnseek.session import build_session

HEADLINE = [
    "text_filter_sort_page",
    "tokenize_corpus",
    "text_term",
    "text_wildcard",
    "text_match_all",
    "text_match_any",
    "text_phrase",
    "postings_build",
    "term_stats",
    "text_postings_and",
    "bm25_single_term",
    "bm25_multi_term",
    "relevance_page",
    "filter_range_double",
    "filter_between_date",
    "filter_nested",
    "like_glob_string",
    "sort_multi",
    "topk",
    "page_nth",
    "page_deep",
    "page_with_total",
    "group_count_string",
    "group_count_long",
    "group_head",
    "group_members_page",
    "ingest_list",
    "ingest_bad_records",
    "lookup_fetch",
    "stream_ingest",
    "ingest_resume",
    "snapshot_page",
]
WARM_UP = ["filter_nested", "group_count_string", "sort_multi", "text_term", "ingest_typed"]


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "tarnseek-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # The test tables are files of one row group, which one task would tokenise.
            "spark.tarnseek.textSplits": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        timed(spark, sf_dir, name)
    times = {name: timed(spark, sf_dir, name) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

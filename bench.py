"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rapport.plans.catalog import QUERIES
from rapport.session import build_session

HEADLINE = [
    "relationship_status", "a1_leaderboard_window", "a2_activity_totals", "a7_person_source_stats", "a8_profile_scalars",
    "a9_top_topics", "a10_global_topics", "w1_rolling_counts", "w2_latest_emails", "w9_upcoming", "t8_activity_series",
    "j2_event_people", "u1_timeline", "r1_term_statistics", "r2_keyword_search", "r4_vector_search", "r6_fusion_rank_norm",
    "r8_evidence_answer", "a14_ranking_answers", "j8_person_in_question", "x2_resolve_senders", "x5_duplicate_people",
    "x7_merge_events", "s1_chat_text", "s11_html_documents", "k2_upsert_latest", "f16_topics_classic",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "rapport-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()      # start-up is not part of any query
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One session runs all steps in order: the graph is built once and timed by
itself, the questions' seeds are found once (untimed, after `retrieve_batch` has
timed them), and later steps read both. `u4_entity_resolution` resolves 20,000
mentions of some hundred distinct names at sf0.1.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# the questions of the batch are one per vector label
PLANS = [
    "v3_cosine_search", "g1_traversal", "g1_traversal_whole", "a1_node_counts", "a2_edge_counts", "a4_usage_counts", "j1_paper_entities",
    "f13_f14_chunks", "f7_unsectioned", "x1_search_nodes", "k4_node_merge", "k5_edge_merge", "k15_delete_cascade_nodes",
    "u5_claim_dedup", "u4_entity_resolution", "p23_without_conflicts", "a8_eval_summary", "a9_recall", "r5_recent_requests",
    "r1_stream_ingest",
]


def main() -> None:
    from citeloom.operators.retrieve import graph_context, retrieve
    from citeloom.plans import QUERIES, domain, retrieval
    from citeloom.runtime import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8, app="citeloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, step) -> object:
        start = time.perf_counter()
        result = step()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        return result

    corpus = timed("graph_build", lambda: domain.corpus(spark, SF_DIR))
    asked = retrieval.questions(spark, SF_DIR)

    def answer_batch():
        found = retrieve(corpus, asked, row_limit=retrieval.ROWS, max_nodes=retrieval.NODES)
        found.ranked.write.format("noop").mode("overwrite").save()
        return found

    found = timed("retrieve_batch", answer_batch)
    timed("context_batch", lambda: graph_context(corpus, asked, found))
    retrieval.found(spark, SF_DIR)
    for name in PLANS:
        timed(name, lambda: QUERIES[name](spark, SF_DIR))
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

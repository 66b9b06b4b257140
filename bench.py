"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from namewright.plans.queries import queries
from namewright.plans.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["norm_core_b", "blocking_keys", "candidate_counts", "token_overlap", "link_exact_core", "link_full", "link_with_overrides", "dupes_normalized", "clean_variants", "vec_topk", "finalize", "eval_pairs"]


def main() -> None:
    spark = local_session(CPUS, int(CPUS) * 2, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = queries(), {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}), flush=True)


if __name__ == "__main__":
    main()

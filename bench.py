"""Time the headline queries once each, after one warm-up scan, and print one JSON line."""
import json
import os
import time

from codestrata.catalog import registry
from codestrata.session import local_session

HEADLINE = ["g1_neighbors", "g4_module_rollup", "g6_file_relationships", "g7_impact", "d1_file_changes", "d3_relationship_delta", "s5_file_profile",
            "c3_chunk_reconstruction", "r5_vector_topk", "r6_lexical_topk", "t1_quota_admission", "x4_import_resolve_python"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    known, times = registry.collect(), {}
    for name in HEADLINE:
        if name not in known:
            continue
        started = time.perf_counter()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints a JSON line with all figures so far after each query, so a run that is stopped still leaves its last line; the last one holds
all. A query that takes more than $BENCH_QUERY_LIMIT seconds is cancelled: it has null, counts as that limit in the total, and the run fails at its end; after
$BENCH_LIMIT seconds no further one is begun.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

from strandloom.plans import catalog
from strandloom.session import local_session

HEADLINE = [
    "reads_scan", "revcomp", "quality_trim", "kmer_spectrum", "kmer_counts", "next_base_table", "unique_kmer_filter", "contrast",
    "overlaps", "contained_reads", "irreducible_edges", "edge_dedupe", "amend_edges", "weak_edges", "read_distance", "sw_align", "coverage",
    "insert_stats", "reciprocal_best", "scaftigs", "sam_identity", "seq_rank", "contrast_exact", "bubble_complex", "unitigs", "correct_reads",
]


def timed(spark, name: str, sf_dir: str, limit: float) -> float | None:
    """Seconds of one run, or None where it was cancelled or failed."""
    cancelled = threading.Event()

    def cancel() -> None:
        while not cancelled.wait(2):  # a query may begin another job after the one that is cancelled
            spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(limit, cancel)
    timer.start()
    began = time.perf_counter()
    try:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began
    except Exception as error:  # noqa: BLE001
        print(f"{name}: {str(error)[:300]}", file=sys.stderr, flush=True)
        return None
    finally:
        timer.cancel()
        cancelled.set()


def main() -> None:
    sf_dir, repeats = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_REPEATS", "1"))
    cores, limit, total = os.environ.get("BENCH_CPUS", "8"), float(os.environ.get("BENCH_QUERY_LIMIT", "150")), float(os.environ.get("BENCH_LIMIT", "1400"))
    spark = local_session("bench", cores=cores, partitions=int(cores) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float | None] = {}
    began = time.perf_counter()
    for name in HEADLINE:
        if time.perf_counter() - began > total:
            break
        taken = [timed(spark, name, sf_dir, limit) for _ in range(repeats)]
        seconds[name] = None if None in taken else round(statistics.median(taken), 3)
        done = round(sum(limit if s is None else s for s in seconds.values()), 3)
        print(json.dumps({"metric": "total_seconds", "value": done, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cores, "of": len(HEADLINE)}), flush=True)
    spark.stop()
    if failed := [name for name, s in seconds.items() if s is None]:
        sys.exit(f"cancelled or failed: {', '.join(failed)}")


if __name__ == "__main__":
    main()

"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no collect to the
driver).  One untimed warm-up pass (JVM, file listing, codegen caches), then
the best of ``BENCH_REPEAT`` timed passes per query.  Without names on the
command line the three hunts are also timed as stored jobs (date range, de-dup,
findings, IOC roll-up, events written).  Prints one JSON line.
"""

from __future__ import annotations

import gc
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracehound.operators import hunts  # noqa: E402
from tracehound.plans import catalog, jobs  # noqa: E402
from tracehound.session import checkpoint_dir, get_session  # noqa: E402
from tracehound.sources import fixtures as fx  # noqa: E402

HEADLINE = ["c2_beaconing", "dns_tunneling", "lateral_movement"]


def run_once(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def time_jobs(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of each headline hunt as a whole stored run."""
    params = {"c2_beaconing": fx.C2_PARAMS, "lateral_movement": fx.LATERAL_PARAMS}
    out = {}
    for i, name in enumerate(HEADLINE):
        results = f"{checkpoint_dir(spark).rstrip('/')}/bench-{os.getpid()}-{i}"
        logs = fx.load(spark, sf_dir, hunts.get(name).source)
        t0 = time.perf_counter()
        jobs.run_hunt_job(spark, name, logs, results_dir=results, execution_id=i, start_date="2024-01-01", end_date="2024-12-31",
                          params=params.get(name))
        out[name] = round(time.perf_counter() - t0, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or list(catalog.REGISTRY)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="tracehound-bench")
    for n in names:                                   # warm-up
        run_once(catalog.REGISTRY[n](spark, sf_dir))
    gc.collect()                                      # start the timed pass with clean heaps
    spark.sparkContext._jvm.System.gc()
    times = {}
    for n in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run_once(catalog.REGISTRY[n](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "hunts_seconds": {n: times[n] for n in HEADLINE if n in times},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }
    if not sys.argv[1:]:
        out["jobs_seconds"] = time_jobs(spark, sf_dir)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

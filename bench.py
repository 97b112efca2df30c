"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 4)
BENCH_RUNS    rounds over all queries, median reported (default 3, after one warm-up query)
BENCH_SECONDS a further round begins only if it would end within so many seconds (default 900)
BENCH_ALL     1 = every registered query, one run each
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import time

HEADLINE = [
    "prj_2_canonicalize_pay", "flt_1_public_feed", "wn_1_best_row", "wn_7_top_k", "jn_6_latest_before", "ag_14_empirical_percentile",
    "bi_1_fct_jobs", "bi_2_skill_demand", "bi_3_salary_benchmarks", "bi_5_sector_benchmarks", "bi_6_hiring_difficulty", "bi_7_company_scorecard",
    "bi_9_ghost_index", "bi_10_honesty_score", "bi_14_radar_snapshot", "bi_24_skill_index", "bi_27_company_roles", "lc_2_expire_states", "lc_8_stream_event_counts",
    "txt_2_extract_salary", "txt_8_skills_sectioned", "txt_9_tag_skills", "txt_18_find_boilerplate", "dup_3_near_dup_clusters", "dup_4_connected_components",
    "mat_1_knn", "mat_3_match_jobs", "mat_4_skill_gaps", "mat_7_market_skill_stats", "mat_8_weighted_job_matches", "snk_1_upsert",
]


def main() -> None:
    from postlens.catalog import QUERIES
    from postlens.session import build_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "4"))
    everything = os.environ.get("BENCH_ALL") == "1"
    runs = 1 if everything else int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = list(QUERIES) if everything else HEADLINE
    once("bi_3_salary_benchmarks")
    taken: dict[str, list[float]] = {}
    failed: dict[str, str] = {}

    def report() -> bool:
        """Prints the line; a total only if every query has a time and none failed in any round."""
        times = {name: round(statistics.median(seconds), 3) for name, seconds in taken.items() if seconds}
        missing = [name for name in names if name not in times]
        whole = not missing and not failed
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3) if whole else None, "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")),
                          "rounds": min((len(taken.get(name, [])) for name in names), default=0), "rounds_wanted": runs, "missing": missing, "failed": failed}), flush=True)
        return whole

    def stopped(*_) -> None:
        os._exit(0 if report() else 1)

    signal.signal(signal.SIGTERM, stopped)  # whoever stops it still gets the rounds so far
    began, limit = time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "900"))
    for done in range(runs):
        if done and (time.perf_counter() - began) * (done + 1) / done > limit:
            break
        for name in names:
            try:
                seconds = once(name)
                taken.setdefault(name, []).append(seconds)
            except Exception as exc:  # keep the other timings
                failed[name] = f"{type(exc).__name__}: {str(exc)[:120]}"
                print(f"{name}: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr)
            if everything:
                print(f"{name} {taken.get(name)}", file=sys.stderr, flush=True)
    sys.exit(0 if report() else 1)


if __name__ == "__main__":
    main()

"""Time the headline queries on one warm session and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "scan_articles", "scoped_issue_metrics", "latest_placement_asof", "illegal_transitions", "agenda_rank", "receipt_disjunctive_join",
    "merge_articles_discovery", "pair_confusion", "partition_reconcile", "title_tokens", "body_tokens", "segment_sentences", "morph_summary",
    "extract_page_body", "frame_items", "axis_patterns", "evidence_answer", "candidate_pairs", "complete_link_clusters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE

    from pressgrain.plans import QUERIES
    from pressgrain.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.log.level": "ERROR"})

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def median_of(name: str, runs: int = 3, long: float = 8.0) -> float:
        """Median of three runs; of a query that takes long, the first one."""
        times = [run(name)]
        while len(times) < runs and times[0] < long:
            times.append(run(name))
        return statistics.median(times)

    # start the JVM's code paths and the Python workers before anything is timed
    for name in ("scan_articles", "title_tokens"):
        run(name)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in only:
        try:
            times[name] = round(median_of(name), 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as e:  # noqa: BLE001 - one broken query must not hide the times of the others
            failed[name] = str(e)[:300]
            print(f"{name} failed: {failed[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")} | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks import load
from logvane.session import build_session
from logvane.sources import derived

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# parsing, state, models, history and streams; the first of each group warms up what follows
HEADLINE = (
    "parse_dispatch_permissive",
    "parse_auth",
    "win_request_rate",
    "win_unique_endpoints",
    "win_unique_ips",
    "feat_entropy",
    "feat_vector",
    "geo_distance",
    "retrain_job",
    "score_pipeline",
    "iforest_fit_score",
    "importance_scaled",
    "roc_auc",
    "pr_auc",
    "stats_grouping_sets",
    "timeseries_week",
    "latency_quantiles",
    "related_logs",
    "similar_anomalies",
    "user_baseline",
    "alert_cooldown_5m",
    "alert_hourly_cap",
    "incident_sessions",
    "stream_tumbling",
    "stream_exact_features",
)


def main() -> None:
    from checks.registry import QUERIES

    load()
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    lines = derived.lines(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "scored_lines_per_sec": round(lines / seconds["score_pipeline"], 1),
                "training_sec": seconds["retrain_job"],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

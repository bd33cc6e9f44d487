"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from riskframe.catalog import load
from riskframe.session import get_session

HEADLINE = (
    "flagship",
    "pit_history_card",
    "pit_history_email",
    "pit_history_device",
    "pit_history_hot_keys",
    "pit_history_unlabelled",
    "rate_by_hour",
    "rate_by_device",
    "top_card_entities",
    "identity_left_join",
    "join_audit_fanout",
    "key_audit",
    "column_profile_approx",
    "outlier_profile",
    "correlation_matrix",
    "split_summary",
    "train_lookup_features",
    "model_ready",
    "undersample",
    "average_precision",
    "threshold_table",
    "isotonic_calibration",
    "risk_bands",
    "upsert_scored",
    "review_worklist",
    "batch_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = load()[0]
    spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

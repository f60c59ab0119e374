"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans.catalog import all_entries, backtest  # noqa: E402
from panelweave.plans.flagship import flagship  # noqa: E402
from panelweave.session import build_session  # noqa: E402

HEADLINE = [
    "uni_3_interval_join",
    "bor_3_summary",
    "dq_7_warnings",
    "fac_24_library",
    "fac_27_redundant_pairs",
    "sig_2_composite",
    "sig_7_neutral_liquid",
    "sig_9_as_of_weights",
    "var_full_grid",
    "val_4_5_checks",
    "var_5_bootstrap",
    "cmp_2_rank_all",
    "fam_3_family_verdict",
    "txt_2_factor_tags",
    "evt_9_ledger_errors",
    "chn_1_verify_chains",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "panelweave-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    flagship(spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up, not timed
    seconds: dict[str, float] = {}

    def measure(name: str, build) -> None:
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)

    measure("flagship", lambda: flagship(spark, folder))
    # var_full_grid computes the whole research run here; val_4_5_checks and var_5_bootstrap read its tables.
    for key in HEADLINE:
        measure(key, lambda k=key: entries[k][0](spark, folder))
    backtest._RUNS.clear()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()

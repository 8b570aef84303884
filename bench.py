"""Times the headline queries end to end and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_bars", "qc_structural", "returns_roc", "bollinger", "ema_macd", "obv_z",
    "technical_panel", "market_regime", "sector_loo", "future_vol", "relative_labels",
    "rank_tercile", "asof_pe", "scaler_params", "yearly_ic", "auc_ap_brier", "turnover_cost",
    "list_companies", "live_overlay", "feature_panel",
    "ridge_eval", "logit_eval", "walk_forward",
]


def main():
    from barloom.plans.catalog import all_queries
    from barloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, cpus)
    queries, seconds = all_queries(), {}
    queries["list_companies"](spark, sf).count()  # JVM and parquet readers warm
    for n in names:
        t = time.time()
        queries[n](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

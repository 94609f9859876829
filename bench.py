"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "agg_1_rank_ic", "agg_6_ic_summary", "agg_3_top_spread", "win_4_quantile_bucket", "rol_3_volatility", "rol_7_beta", "lbl_1_triple_barrier", "lbl_8_composite",
    "jn_7_as_of", "jn_15_model_pairs", "wf_1_expanding_folds", "wf_3_leakage", "st_6_block_bootstrap", "st_8_newey_west", "pf_1_topk_book", "dq_7_hash_chain", "ml_3_walk_forward",
    "ml_3_expanding_43", "ml_3_boosted_ranker", "st_16_leave_one_key",
]


def permutations(spark: SparkSession, d: str):
    """200 seeds of within-date permutation of the label, and the spread of the top decile under each."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessera.operators.resample import permuted_spread
    from tessera.plans.panels import supplier_month

    panel = supplier_month(spark, d).where("y is not null").select("date", "key", "x2", "y")
    # The score's top share is the same under every seed: it is marked once and goes along.
    w = Window.partitionBy("date")
    k = F.greatest(F.lit(1), F.bround(0.1 * F.count("*").over(w)))
    marked = panel.select("date", "key", "y", (F.row_number().over(w.orderBy(F.desc("x2"), "key")) <= k).alias("top"))
    return permuted_spread(marked, "y", "top", 200).groupBy("seed").agg(F.avg("spread").alias("spread"))


def main() -> None:
    from tessera.plans import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.master": f"local[{cpus}]", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": place, "spark.sql.warehouse.dir": f"{place}/warehouse", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda f: f(spark, d).write.format("noop").mode("overwrite").save()
    run(QUERIES["agg_1_rank_ic"])
    times = {}
    for name, f in {**{n: QUERIES[n] for n in HEADLINE}, "permutation_200_seeds": permutations}.items():
        began = time.time()
        run(f)
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()

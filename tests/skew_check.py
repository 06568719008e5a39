"""Skew evidence (not a pytest module): run per-user operators on generated
tables where one customer holds a third of all orders and report, per
shuffle stage, the largest number of records a single task read.

    python tests/skew_check.py [n_orders]
"""

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import queries  # noqa: E402
from tests.test_random_fixture import generate  # noqa: E402

QUERIES = [
    "first_orders", "order_sequence", "churn_vs_revenue", "customer_mix_order_grain_all", "segment_split",
    "orders_in_next_90d",
]
CONTRAST = "naive_lead_over_raw_orders"


def main() -> None:
    n_orders = int(sys.argv[1]) if len(sys.argv) > 1 else 300000
    work = tempfile.mkdtemp(prefix="skew-", dir=os.environ.get("SKEW_DIR", "/tmp"))
    data, ev = os.path.join(work, "data"), os.path.join(work, "events")
    os.makedirs(data)
    os.makedirs(ev)
    generate(data, seed=1, n_orders=n_orders, n_cust=20000)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
        .config("spark.eventLog.dir", ev)
        # Coalescing would merge small partitions into one task and hide the
        # distribution; measure the raw hash partitions instead.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    items = spark.read.parquet(f"{data}/lineitem.parquet").count()
    for name in QUERIES:
        spark.sparkContext.setJobGroup(name, name)
        queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    # Contrast: a plain per-user window over raw orders (what the rollups avoid).
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from basketlens.operators.facts import completed_items, completed_orders
    from basketlens.params import fixture_params
    from basketlens.sources.fixture import fixture_tables

    spark.sparkContext.setJobGroup(CONTRAST, CONTRAST)
    o = completed_orders(completed_items(fixture_tables(spark, data), fixture_params()))
    w = Window.partitionBy("user_id").orderBy("order_ts", "order_id")
    o.withColumn("next_ts", F.lead("order_ts").over(w)).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_job, worst, total = {}, defaultdict(int), defaultdict(int)
    files = [f for f in glob.glob(f"{ev}/**", recursive=True) if os.path.isfile(f)]
    for line in (ln for f in files for ln in open(f)):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e["Stage IDs"]:
                stage_job[sid] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            key = (stage_job.get(e["Stage ID"]), e["Stage ID"])
            worst[key] = max(worst[key], read)
            total[key] += read
    print(f"line items: {items}; one customer holds ~1/3 of all orders; 8 shuffle partitions")
    print("per query, over shuffle stages reading >= 1% of the line-item count:")
    print("the largest share of a stage's records read by one task (balanced ~ 1/8 = 12.5%)")
    for name in QUERIES + [CONTRAST]:
        shares = [
            (worst[k] / total[k], total[k]) for k in total if k[0] == name and total[k] >= 0.01 * items
        ]
        top = max(shares, default=(0.0, 0))
        print(f"{name:32s} stages={len(shares):2d}  worst task share={top[0]:6.1%}  (stage reads {top[1]} records)")


if __name__ == "__main__":
    main()

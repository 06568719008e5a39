"""Run a metric from the command line.

    python -m basketlens list
    python -m basketlens run segment_split --data /path/to/parquet --layout shop
    python -m basketlens run dashboard_payload --data /root/testdata/sf0.01 --layout fixture --out /tmp/payload.json

`--layout shop` reads order_items/events/users.parquet with the default
parameters; `--layout fixture` reads the driver tables with fixture
parameters. Results are shown (`--show N` rows) or written as Parquet
(`--out`; for `dashboard_payload` one JSON file, or a script that assigns it if its name ends
in .js).
"""

from __future__ import annotations

import argparse
import sys

from basketlens.catalog import METRICS
from basketlens.params import default_params, fixture_params
from basketlens.session import local_session
from basketlens.sources.export import write_document
from basketlens.sources.fixture import fixture_tables
from basketlens.sources.tables import shop_tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="basketlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list metric names")
    run = sub.add_parser("run", help="run one metric")
    run.add_argument("metric", choices=sorted(METRICS))
    run.add_argument("--data", required=True, help="folder with the input Parquet files")
    run.add_argument("--layout", choices=["shop", "fixture"], default="shop")
    run.add_argument("--out", help="write the result here instead of showing it")
    run.add_argument("--show", type=int, default=50)
    run.add_argument("--master", default="local[*]")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(sorted(METRICS)))
        return 0

    spark = local_session(cpus=args.master.removeprefix("local[").removesuffix("]"))
    if args.layout == "shop":
        tables, params = shop_tables(spark, args.data), default_params()
    else:
        tables, params = fixture_tables(spark, args.data), fixture_params()
    df = METRICS[args.metric](tables, params)
    if args.out:
        if args.metric == "dashboard_payload":
            write_document(df, args.out, "DASHBOARD_DATA" if args.out.endswith(".js") else None)
        else:
            df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

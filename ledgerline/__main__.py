"""Command line: ingest the CSV tables, then run jobs and write each result as a Parquet table.

    python -m ledgerline ingest <csv_dir> <table_dir> [--buckets N] [--orders-by-month]
    python -m ledgerline run <table_dir> <out_dir> [job ...] [--delivered STATUS] [--bucket-prefix P]
    python -m ledgerline jobs

``run`` without job names runs every job. Each result lands in ``<out_dir>/<job>``; nothing is
collected to the driver except the small per-job status lines printed at the end.
"""

from __future__ import annotations

import argparse
import sys
import time

from ledgerline.plans.registry import MODEL_JOBS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline")
    sub = parser.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest", help="CSV files -> typed Parquet tables")
    ing.add_argument("csv_dir")
    ing.add_argument("table_dir")
    ing.add_argument("--buckets", type=int, default=None)
    ing.add_argument("--orders-by-month", action="store_true")
    ing.add_argument("--bucket-prefix", default="sales_")
    ing.add_argument("--infer", action="store_true", help="type undeclared columns too")
    ing.add_argument("--rejects", default=None, help="folder for rows with unreadable values")
    run = sub.add_parser("run", help="run jobs over ingested tables, write results")
    run.add_argument("table_dir")
    run.add_argument("out_dir")
    run.add_argument("jobs", nargs="*")
    run.add_argument("--delivered", default="delivered")
    run.add_argument("--bucket-prefix", default=None)
    sub.add_parser("jobs", help="list job names")
    args = parser.parse_args(argv)

    if args.cmd == "jobs":
        print("\n".join(MODEL_JOBS))
        return 0

    from pyspark import cloudpickle

    import ledgerline
    from ledgerline.session import build_session, clear_scratch
    cloudpickle.register_pickle_by_value(ledgerline)  # executors need no copy of the package
    spark = build_session()
    try:
        return run_command(spark, args)
    finally:
        clear_scratch(spark)


def run_command(spark, args) -> int:
    from ledgerline.sources.csv_ingest import ingest_tables, load_model
    if args.cmd == "ingest":
        audit = ingest_tables(spark, args.csv_dir, args.table_dir, buckets=args.buckets,
                              orders_by_month=args.orders_by_month,
                              table_prefix=args.bucket_prefix, infer=args.infer, rejects=args.rejects)
        for row in audit.collect():  # one row per column
            print(f"{row.tbl:24s} {row.col:32s} {row.rows:>12,} rows {row.nulls:>12,} nulls  {row.total or ''}")
        return 0

    model = load_model(spark, args.table_dir, delivered=args.delivered,
                       table_prefix=args.bucket_prefix)
    names = args.jobs or [n for n in MODEL_JOBS if n != "ingest_tables"]
    unknown = [n for n in names if n not in MODEL_JOBS]
    if unknown:
        print(f"unknown jobs: {unknown}", file=sys.stderr)
        return 2
    failed = 0
    for name in names:
        t0 = time.perf_counter()
        try:
            MODEL_JOBS[name](model).write.mode("overwrite").parquet(f"{args.out_dir.rstrip('/')}/{name}")
            print(f"ok   {name:28s} {time.perf_counter() - t0:7.2f}s")
        except Exception as exc:  # report and continue with the remaining jobs
            failed += 1
            print(f"FAIL {name:28s} {type(exc).__name__}: {str(exc)[:200]}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: the load run and the report run.

    python -m staylens load   --raw RAW.csv --out TABLES_DIR [--keying last_wins|exact]
    python -m staylens report --tables TABLES_DIR --out REPORTS_DIR [--group-by COL]

`load` cleans the raw file and writes raw/ (as read), dedup/, dated/ (formatted),
clean/, patients/, admissions/, billing/, the quarantined rows and
cleaning_report/ as Parquet. `report`
joins the tables into the encounter view, writes it once, writes every
report table under REPORTS_DIR and prints the KPI and forecast cards
(one row each).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from staylens.plans.cleaning import cleaning_report, cleaning_stages
from staylens.plans.dashboard import build_reports
from staylens.plans.encounters import encounter_view
from staylens.plans.normalise import Tables, normalise
from staylens.session import get_session
from staylens.sources.files import malformed_lines, read_raw_csv, read_table, write_table


def _load(args) -> None:
    spark = get_session(args.master)
    # the parsed file is written once; profiles, dedup and report scan it
    raw = read_table(spark, write_table(read_raw_csv(spark, args.raw, multi_line=args.multi_line, on_malformed=args.on_malformed),
                                        os.path.join(args.out, "raw")))
    # the deduplicated, formatted rows are written once; the outlier
    # statistics and filter scan them instead of re-running the dedup
    groups = [args.outlier_group_by] if args.outlier_group_by else []
    stages = cleaning_stages(raw, threshold=args.threshold, group_cols=groups,
                             stage=lambda name, df: read_table(spark, write_table(df, os.path.join(args.out, name))))
    counts = {}

    def written(name, df):
        # row count taken while the table is written (no second pass)
        obs = Observation(name)
        path = write_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), os.path.join(args.out, name))
        counts[name] = obs.get["rows"]
        return read_table(spark, path)

    clean = written("clean", stages.clean)
    write_table(cleaning_report(stages, threshold=args.threshold, group_cols=groups),
                os.path.join(args.out, "cleaning_report"))
    tables = normalise(clean, args.keying, stage=written)
    for name, bad in tables.quarantine.items():
        written(f"quarantine_{name}", bad)
    if args.on_malformed == "quarantine":
        written("quarantine_lines", malformed_lines(spark, args.raw, args.multi_line))
    for name, n in counts.items():
        print(f"{name}: {n} rows")
    print(f"tables written to {args.out}")


def _report(args) -> None:
    spark = get_session(args.master)
    tables = Tables(*(read_table(spark, os.path.join(args.tables, n)) for n in ("patients", "admissions", "billing")))
    view = read_table(spark, write_table(encounter_view(tables), os.path.join(args.out, "encounters")))
    groups = [args.group_by] if args.group_by else []
    reports = build_reports(view, group_cols=groups)
    for name, df in reports.items():
        write_table(df, os.path.join(args.out, name))
    read_table(spark, os.path.join(args.out, "kpi_cards")).show(truncate=False)
    read_table(spark, os.path.join(args.out, "forecast_summary")).show(truncate=False)


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="staylens")
    parser.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    sub = parser.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="clean a raw file and write the tables")
    load.add_argument("--raw", required=True)
    load.add_argument("--out", required=True)
    load.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    load.add_argument("--on-malformed", choices=("fail", "quarantine"), default="fail", help="lines with more fields than the header")
    load.add_argument("--keying", choices=("last_wins", "exact"), default="last_wins")
    load.add_argument("--threshold", type=float, default=3.0)
    load.add_argument("--outlier-group-by", default=None, help="z-scores per group of this raw column")
    load.set_defaults(run=_load)
    rep = sub.add_parser("report", help="compute the reports from written tables")
    rep.add_argument("--tables", required=True)
    rep.add_argument("--out", required=True)
    rep.add_argument("--group-by", default=None)
    rep.set_defaults(run=_report)
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()

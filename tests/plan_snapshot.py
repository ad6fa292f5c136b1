"""Write PLANS.md: the physical plans of the main steps, as at scale.

    python tests/plan_snapshot.py [sf_dir]

Automatic broadcast is switched off (every table counts as large), so the
plans show the strategies Spark picks when nothing fits in memory; only the
explicitly bounded broadcast remains.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEEP = re.compile(r"(Exchange|Join|Aggregate|Scan|Window|Union|Subquery|TakeOrdered|Generate|Expand|Filter|Sort\b)")


def outline(df) -> str:
    tree = df._jdf.queryExecution().executedPlan().treeString()
    lines = []
    for line in tree.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: [^,]*,", "", line)
            lines.append(line[:170])
    return "\n".join(lines)


def main(argv):
    from staylens import registry
    from staylens.plans.cleaning import cleaning_stages
    from staylens.plans.encounters import encounter_view
    from staylens.plans.normalise import normalise
    from staylens.session import get_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    raw = registry._raw(spark, sf)
    clean = registry._clean(spark, sf)
    lazy = normalise(clean)
    tables = registry._tables(spark, sf)
    view = registry._view(spark, sf)
    sections = [
        ("Cleaning chain (dedup, title case, dates, z-score filter), fully lazy: the statistics "
         "subquery repeats the dedup", cleaning_stages(raw).clean),
        ("Clean table from the written deduplicated rows (what the registered queries use)",
         registry._stages(spark, sf).clean),
        ("Admissions keyed to the last patient of their name", lazy.admissions),
        ("Bills keyed to the last admission of their date (bounded broadcast)", lazy.billing),
        ("Encounter view from the written tables", encounter_view(tables)),
        ("Report: mean stay and distinct patients by condition", registry.QUERIES["stay_by_condition"](spark, sf)),
        ("Report: top 10 doctors", registry.QUERIES["top_doctors"](spark, sf)),
        ("Monthly series, fit and forecast", registry.QUERIES["forecast"](spark, sf)),
        ("Duplicate rows (semi join, no window)", registry.QUERIES["duplicate_rows"](spark, sf)),
    ]
    del view
    out = ["# Physical plans at scale", "",
           "Generated by `python tests/plan_snapshot.py` with automatic broadcast off",
           "(`spark.sql.autoBroadcastJoinThreshold=-1`), i.e. as if every table were",
           "large. Only operators, exchanges, joins and scans are kept; expression ids are removed.", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", outline(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main(sys.argv)

"""Raw table -> every report, as lazy DataFrames.

`build_reports` is the whole dashboard: KPI cards, four group reports and
the forecast. For a production run, `materialise` the encounter view once
(written to the shared checkpoint folder) and point every report at it, so
the cleaning and the joins run once instead of once per report.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from staylens.operators import reports, timeseries
from staylens.plans.cleaning import clean_encounters, cleaning_stages
from staylens.plans.encounters import encounter_view
from staylens.plans.normalise import normalise
from staylens.schemas import FORECAST_HORIZON, TOP_DOCTORS
from staylens.session import cut_lineage


def encounters_from_raw(raw: DataFrame, keying: str = "last_wins", stage=None, **clean_options) -> DataFrame:
    """Clean, normalise and join: the view every report reads.

    `stage` (e.g. `plans.stages.stage_to(folder)`) writes the deduplicated
    rows and each table as they are built, so the dedup runs once and every
    table is computed once; without it the whole chain is one lazy plan.
    """
    if stage is None:
        return encounter_view(normalise(clean_encounters(raw, **clean_options), keying))
    clean = stage("clean", cleaning_stages(raw, stage=stage, **clean_options).clean)
    return encounter_view(normalise(clean, keying, stage=stage))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: the view is computed once and survives executor loss."""
    return cut_lineage(df)


def build_reports(view: DataFrame, group_cols: Iterable[str] = (), top_k: int = TOP_DOCTORS,
                  horizon: int = FORECAST_HORIZON, labels: bool = True) -> dict[str, DataFrame]:
    groups = list(group_cols)
    history = timeseries.monthly_counts(view, group_cols=groups)
    fit = timeseries.linear_fit(history, group_cols=groups)
    fc = timeseries.forecast(fit, groups, horizon)
    return {
        "kpi_cards": reports.kpis(view, labels=labels),
        "cost_by_gender": reports.cost_by_group(view, "gender", labels=labels),
        "stay_by_condition": reports.stay_by_group(view, "medical_condition", labels=labels),
        "top_doctors": reports.top_groups(view, "doctor", k=top_k),
        "admission_type_pct": reports.crosstab_pct(view),
        "monthly_patients": history,
        "monthly_fit": fit,
        "forecast": fc,
        "forecast_summary": timeseries.forecast_summary(fit, groups, horizon, labels=labels),
        "forecast_series": timeseries.forecast_series(history, fc, groups),
    }

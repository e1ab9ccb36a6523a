"""Ratio features of a sprint row.

Every builder maps a dict of input Columns to a dict of feature Columns, so the
same definition serves a table (``add_features``) and a what-if variant whose
inputs are expressions. All features of a table land in one projection.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from worklens.functions import clip, ratio, zero_to
from worklens.operators.prep import col_or_zero

# fixed value: nominal sprint length in days
SPRINT_DAYS = 10.0

INPUTS = {
    "planned": "Planned_Story_Points_Sprint",
    "completed": "Completed_Story_Points",
    "pct": "Percent_Done",
    "days": "Days_Remaining_Sprint",
    "velocity": "Historical_Velocity",
    "blocked": "Blocked_Stories",
    "scope": "Scope_Change",
    "workload": "Current_Workload_Percent",
    "consec": "Consecutive_Overloads",
}


def inputs_of(df: DataFrame) -> dict[str, Column]:
    return {short: col_or_zero(df, name).cast("double") for short, name in INPUTS.items()}


def core_features(x: Mapping[str, Column], sprint_days: float = SPRINT_DAYS) -> dict[str, Column]:
    """Guarded form: a non-positive denominator yields the neutral value."""
    gap = x["planned"] - x["completed"]
    reach = x["velocity"] * x["days"] / F.lit(sprint_days)
    return {
        "Velocity_Efficiency": ratio(x["velocity"], x["planned"], 1.0),
        "Completion_Gap": gap,
        "Blocker_Severity": x["blocked"] * ratio(F.lit(1.0), x["days"], 1.0),
        "Scope_Pressure": ratio(x["scope"], x["planned"], 0.0),
        "Sprint_Momentum": ratio(x["completed"], x["velocity"], 0.0),
        "Recovery_Index": F.when((gap > 0.0) & (x["days"] > 0.0), reach / gap).otherwise(F.lit(1.0)),
        "Workload_Stress": x["workload"] / 100.0 * x["consec"],
    }


def clipped_features(x: Mapping[str, Column], sprint_days: float = SPRINT_DAYS) -> dict[str, Column]:
    """Clipped form: zero denominators are replaced, ratios limited to a range."""
    gap = x["planned"] - x["completed"]
    planned, velocity = zero_to(x["planned"], 1.0), zero_to(x["velocity"], 1.0)
    reach = x["velocity"] * x["days"] / F.lit(sprint_days)
    return {
        "Velocity_Efficiency": clip(x["velocity"] / planned, 0.0, 3.0),
        "Completion_Gap": gap,
        "Blocker_Severity": x["blocked"] * (F.lit(1.0) / F.abs(zero_to(x["days"], 1.0))),
        "Scope_Pressure": clip(x["scope"] / planned, -1.0, 2.0),
        "Sprint_Momentum": clip(x["completed"] / velocity, 0.0, 2.0),
        "Recovery_Index": clip(reach / zero_to(gap, 0.001), 0.0, 5.0),
        "Workload_Stress": x["workload"] / 100.0 * x["consec"],
    }


def novel_features(x: Mapping[str, Column], scope_pressure: Column,
                   sprint_days: float = SPRINT_DAYS) -> dict[str, Column]:
    gap = x["planned"] - x["completed"]
    elapsed = clip(F.lit(sprint_days) - x["days"], 1.0, 10.0)
    return {
        "Days_Per_Remaining_SP": clip(x["days"] / zero_to(gap, 0.001), -2.0, 10.0),
        "Overcommitment_Ratio": clip(x["planned"] / zero_to(x["velocity"], 1.0), 0.0, 3.0),
        "Blocker_Scope_Risk": x["blocked"] * (F.lit(1.0) + clip(scope_pressure, 0.0, 2.0)),
        "Burn_Rate": clip(x["completed"] / elapsed, 0.0, 20.0),
        "Can_Finish_Score": clip(x["velocity"] / F.lit(sprint_days) * x["days"] - gap, -50.0, 50.0),
    }


def feature_exprs(x: Mapping[str, Column], mode: str = "core", novel: bool = False,
                  sprint_days: float = SPRINT_DAYS) -> dict[str, Column]:
    build = {"core": core_features, "clipped": clipped_features}[mode]
    out = build(x, sprint_days)
    if novel:
        out |= novel_features(x, out["Scope_Pressure"], sprint_days)
    return out


def engineer_features(df: DataFrame, mode: str = "core", novel: bool = False,
                      sprint_days: float = SPRINT_DAYS) -> DataFrame:
    """``df`` plus the seven (or twelve) feature columns, in one projection."""
    return df.withColumns(feature_exprs(inputs_of(df), mode, novel, sprint_days))


def estimation_error(df: DataFrame) -> Column:
    est, actual = F.col("Original_Estimate_Hours"), F.col("Resolution_Time_Hours")
    return clip((actual - est) / zero_to(est, 1.0) * 100.0, -100.0, 300.0)


def days_to_recover(df: DataFrame, sprint_days: float = SPRINT_DAYS) -> DataFrame:
    """Days needed to burn the remaining points, as is and with blockers removed."""
    x = inputs_of(df)
    remaining = F.greatest(F.lit(0.0), x["planned"] - x["completed"])
    rate = F.when(x["days"] > 0.0, x["velocity"] / F.lit(sprint_days)).otherwise(F.lit(1.0))
    needed = ratio(remaining, rate, 999.0)
    overrun = F.greatest(F.lit(0.0), needed - x["days"])
    freed = F.greatest(F.lit(0.5), x["velocity"] - x["blocked"] * 2.0) / F.lit(sprint_days)
    needed_freed = remaining / freed
    overrun_freed = F.greatest(F.lit(0.0), needed_freed - x["days"])
    return df.select(
        "row_id",
        remaining.alias("remaining_sp"),
        ratio(remaining * 100.0, x["planned"], 0.0).alias("remaining_pct"),
        needed.alias("days_needed"),
        overrun.alias("overrun"),
        needed_freed.alias("days_if_unblocked"),
        overrun_freed.alias("overrun_if_unblocked"),
        (overrun_freed - overrun).alias("overrun_change"),
    )

"""Grouped and global roll-ups: each is one aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.functions import (
    band_heat_risk, band_heat_score, band_person, clip, percent_text, ratio, round_half_up,
)
from worklens.operators.features import estimation_error
from worklens.operators.ordering import exact_quantiles
from worklens.operators.prep import group_key


def share(hit: Column) -> Column:
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def _mean(df: DataFrame, name: str) -> Column:
    return F.avg(F.col(name).cast("double")) if name in df.columns else F.max(F.lit(0.0))


def _risk_means(df: DataFrame) -> dict[str, Column]:
    failed = share(F.col("Success_Label") == 0) if "Success_Label" in df.columns else F.max(F.lit(0.0))
    return {
        "sprint_risk": failed,
        "overload": _mean(df, "Expected_Overload"),
        "burnout": _mean(df, "Risk_Flag"),
        "workload": _mean(df, "Current_Workload_Percent"),
        "consec": _mean(df, "Consecutive_Overloads"),
    }


def _total(of: Column) -> Column:
    return F.sum(F.when(of, 1).otherwise(0)).cast("bigint")


def kpi_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        _total(F.col("Success_Label") == 0).alias("sprints_at_risk"),
        F.sum("Risk_Flag").cast("bigint").alias("burnout_flags"),
    ).withColumn("features", F.lit(len(df.columns)))


def kpi_rates(df: DataFrame) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("records"),
        _total(F.col("Success_Label") == 1).alias("done"),
        _total(F.col("Success_Label") == 0).alias("at_risk"),
        F.sum("Risk_Flag").cast("bigint").alias("burnout"),
        _total(F.col("Expected_Overload") == 1).alias("overload"),
    )
    pct = lambda c: ratio(F.col(c) * 100.0, F.col("records"), 0.0)
    return counted.withColumns({f"{c}_pct": pct(c) for c in ("done", "at_risk", "burnout", "overload")})


def assignee_risk(df: DataFrame, by: str | None = None, variant: str = "capped") -> DataFrame:
    """Risk shares, score and status per person.

    ``capped``: light workloads add points, heavy ones cost at most 15.
    ``floored``: light workloads add nothing and heavy ones are not limited.
    """
    by = by or group_key(df)
    strain = (F.col("workload") - 100.0) / 2.0
    penalty = {"capped": F.least(strain, F.lit(15.0)), "floored": F.greatest(strain, F.lit(0.0))}[variant]
    score = clip(F.lit(100.0) - F.col("sprint_risk") * 35.0 - F.col("overload") * 30.0
                 - F.col("burnout") * 20.0 - penalty, 0.0, 100.0)
    return (df.groupBy(by)
            .agg(F.count(F.lit(1)).alias("records"), *[e.alias(n) for n, e in _risk_means(df).items()])
            .withColumn("score", score).withColumn("status", band_person(F.col("score"))))


def export_assignees(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or group_key(df)
    return assignee_risk(df, by).select(
        F.col(by).alias("Assignee"),
        round_half_up(F.col("score"), 1).alias("Health_Score"),
        percent_text(F.col("sprint_risk")).alias("Sprint_Risk"),
        percent_text(F.col("overload")).alias("Overload"),
        percent_text(F.col("burnout")).alias("Burnout_Flag"),
        percent_text(F.col("workload") / 100.0).alias("Avg_Workload"),
        round_half_up(F.col("consec"), 1).alias("Avg_Consec_Overloads"),
        F.col("status").alias("Status"),
    )


def health_heatmap(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or group_key(df)
    m = _risk_means(df)
    pct = df.groupBy(by).agg((m["sprint_risk"] * 100.0).alias("sr"), (m["overload"] * 100.0).alias("ol"),
                             (m["burnout"] * 100.0).alias("br"), m["workload"].alias("wl"))
    score = clip(F.lit(100.0) - F.col("sr") * 0.35 - F.col("ol") * 0.30 - F.col("br") * 0.20
                 - F.greatest(F.lit(0.0), (F.col("wl") - 100.0) / 2.0), 0.0, 100.0)
    named = {"sprint_risk_pct": F.col("sr"), "overload_pct": F.col("ol"), "burnout_pct": F.col("br"),
             "avg_workload": F.col("wl"), "health_score": score}
    return pct.select(by, *[round_half_up(e, 1).alias(n) for n, e in named.items()])


def heatmap_bands(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or group_key(df)
    risky = ("sprint_risk_pct", "overload_pct", "burnout_pct", "avg_workload")
    return health_heatmap(df, by).select(
        by, *[band_heat_risk(F.col(c)).alias(f"{c}_band") for c in risky],
        band_heat_score(F.col("health_score")).alias("health_score_band"))


def sprint_trend(df: DataFrame) -> DataFrame:
    """Per sprint; the blocked average is left out when its column is absent."""
    m = _risk_means(df)
    measures = {"sprint_risk_pct": round_half_up(m["sprint_risk"] * 100.0, 1),
                "avg_workload": round_half_up(m["workload"], 1)}
    if "Blocked_Stories" in df.columns:
        measures["avg_blocked"] = round_half_up(F.avg("Blocked_Stories"), 2)
    measures["burnout_pct"] = round_half_up(m["burnout"] * 100.0, 1)
    return df.groupBy("Sprint_Number").agg(*[e.alias(n) for n, e in measures.items()]).orderBy("Sprint_Number")


def observed(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """The values of a column that is to become columns; raises above ``limit`` of them."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    return sorted(values)


def workload_pivot(df: DataFrame, people: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """Mean workload, one row per sprint and one column per person, of the list or else of those in the table."""
    by = by or group_key(df)
    people = observed(df, by) if people is None else people
    wide = (df.groupBy("Sprint_Number").pivot(by, list(people))
            .agg(F.avg("Current_Workload_Percent")))
    return wide.select("Sprint_Number", *[round_half_up(F.col(p), 1).alias(p) for p in people])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), column)


def mean_by(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return (df.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias(alias))
            .orderBy(F.desc(alias), key))


def rate_by(df: DataFrame, key: str, hit: Column, alias: str) -> DataFrame:
    return df.groupBy(key).agg((share(hit) * 100.0).alias(alias)).orderBy(key)


def estimation_error_rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", "Issue_Type", "Original_Estimate_Hours", "Resolution_Time_Hours",
                     estimation_error(df).alias("estimation_error_pct"))


def estimation_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("Original_Estimate_Hours").alias("avg_estimate"),
        F.avg("Resolution_Time_Hours").alias("avg_actual"),
        F.avg(estimation_error(df)).alias("avg_error_pct"),
    ).withColumn("budget", F.when(F.col("avg_error_pct") > 0.0, "over budget").otherwise("under budget"))


def error_histogram(df: DataFrame) -> DataFrame:
    return (df.groupBy(round_half_up(estimation_error(df), 6).alias("estimation_error_pct"))
            .agg(F.count(F.lit(1)).alias("records")).orderBy("estimation_error_pct"))


def cycle_time(df: DataFrame, by: str = "Priority") -> DataFrame:
    """Mean resolution hours, or the days-remaining proxy when hours are absent."""
    if "Resolution_Time_Hours" in df.columns and by in df.columns:
        return mean_by(df, by, "Resolution_Time_Hours", "avg_resolution_hours")
    return mean_by(df, group_key(df), "Days_Remaining_Sprint", "avg_days_remaining")


def assignee_stats(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or group_key(df)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"),
        round_half_up(F.avg("Current_Workload_Percent"), 2).alias("avg_workload"),
        round_half_up(F.avg("Consecutive_Overloads"), 2).alias("avg_consec_overloads"),
        F.sum("Risk_Flag").cast("bigint").alias("burnout_count"),
        round_half_up(F.avg("Success_Label"), 2).alias("success_rate"),
    )


def sprint_stats(df: DataFrame, n: int = 20) -> DataFrame:
    return df.groupBy("Sprint_Number").agg(
        round_half_up(F.avg("Success_Label"), 3).alias("success_rate"),
        round_half_up(F.avg("Current_Workload_Percent"), 3).alias("avg_workload"),
        round_half_up(F.avg("Blocked_Stories"), 3).alias("avg_blocked"),
        F.count(F.lit(1)).alias("records"),
    ).orderBy("Sprint_Number").limit(n)


def feature_means(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature, from a single aggregation unpivoted afterwards."""
    means = df.agg(*[F.avg(f).alias(f) for f in features])
    return means.unpivot([], list(features), "feature", "mean")


#: What a resource vector is made of: each feature and the column it comes from.
VECTOR_SOURCES = {"workload": "Current_Workload_Percent", "burnout": "Risk_Flag", "sprint_risk": "Success_Label", "consec": "Consecutive_Overloads"}


def can_cluster(df: DataFrame) -> bool:
    """Whether the table has two of the four features at least; with fewer there is nothing to cluster by."""
    return len(set(VECTOR_SOURCES.values()) & set(df.columns)) >= 2


def resource_vectors(df: DataFrame, by: str) -> DataFrame:
    """Means per resource; a feature the table lacks is 0. A table with fewer than two of them gives no vectors."""
    m = _risk_means(df)
    if not can_cluster(df):
        df = df.where(F.lit(False))
    return df.groupBy(by).agg(m["workload"].alias("workload"), m["burnout"].alias("burnout"),
                              m["sprint_risk"].alias("sprint_risk"), m["consec"].alias("consec"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def label_variety(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Classes per label, of any type; a fit needs more than one."""
    agg = df.agg(*[F.count_distinct(c).cast("int").alias(c) for c in labels])
    return (agg.unpivot([], list(labels), "label", "classes")
            .withColumn("can_fit", F.col("classes") > 1))


def recent_slope(df: DataFrame, value: Column, n: int = 5) -> DataFrame:
    """(last - first) / (count - 1) over the last ``n`` sprint means: one row."""
    means = df.groupBy("Sprint_Number").agg(F.avg(value).alias("m"))
    recent = means.orderBy(F.desc("Sprint_Number")).limit(n)
    return recent.agg(
        F.count(F.lit(1)).cast("int").alias("sprints"),
        ((F.max_by("m", "Sprint_Number") - F.min_by("m", "Sprint_Number"))
         / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("slope"))


def cycle_time_matrix(df: DataFrame, keys: Sequence[str] = ("Issue_Type", "Priority", "Assignee")) -> DataFrame:
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"),
                                  F.avg("Resolution_Time_Hours").alias("avg_hours"))
    spread = exact_quantiles(df, keys, "Resolution_Time_Hours", {"p50_hours": 0.5, "p90_hours": 0.9})
    return means.join(spread, list(keys))


def bug_density(df: DataFrame, keys: Sequence[str] = ("Sprint_Number", "Assignee")) -> DataFrame:
    return df.groupBy(*keys).agg(
        _total(F.col("Issue_Type") == "Bug").alias("bugs"),
        F.sum("Story_Points_Issue").cast("bigint").alias("story_points"),
    ).withColumn("bugs_per_point", ratio(F.col("bugs") * 1.0, F.col("story_points"), 0.0))


def velocity_forecast(df: DataFrame) -> DataFrame:
    """Least-squares line of completed points per sprint, next sprint with a 95 % interval."""
    per_sprint = (df.groupBy(F.col("Sprint_Number").cast("double").alias("x"))
                  .agg(F.sum("Completed_Story_Points").alias("y")))
    fit = per_sprint.agg(
        F.count(F.lit(1)).cast("int").alias("sprints"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("x_mean"), F.max("x").alias("x_max"),
        F.avg("y").alias("avg_velocity"),
        F.max_by("x", "y").cast("int").alias("peak_sprint"), F.max("y").alias("peak_velocity"),
        F.min_by("x", "y").cast("int").alias("low_sprint"), F.min("y").alias("low_velocity"))
    n, nxt = F.col("sprints"), F.col("x_max") + 1.0
    residual = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    error = F.sqrt(residual / (n - 2) * (F.lit(1.0) + F.lit(1.0) / n
                                         + (nxt - F.col("x_mean")) * (nxt - F.col("x_mean")) / F.col("sxx")))
    point = F.col("intercept") + F.col("slope") * nxt
    return fit.select(
        "sprints", "slope", "intercept", "avg_velocity", "peak_sprint", "peak_velocity",
        "low_sprint", "low_velocity", nxt.cast("int").alias("next_sprint"), point.alias("next_velocity"),
        (point - error * 1.96).alias("next_low"), (point + error * 1.96).alias("next_high"))


def estimation_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("Issue_Type").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("Original_Estimate_Hours").alias("avg_estimate"),
        F.avg("Resolution_Time_Hours").alias("avg_actual"))


def commitment_reliability(df: DataFrame) -> DataFrame:
    return df.groupBy("Sprint_Number").agg(
        F.sum("Planned_Story_Points_Sprint").alias("planned"),
        F.sum("Completed_Story_Points").alias("completed"),
        F.sum("Scope_Change").alias("scope_change"),
    ).withColumns({
        "reliability_pct": ratio(F.col("completed") * 100.0, F.col("planned"), 0.0),
        "scope_creep_pct": ratio(F.col("scope_change") * 100.0, F.col("planned"), 0.0),
    }).orderBy("Sprint_Number")


def points_by_assignee(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or group_key(df)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("records"),
                              F.sum("Story_Points_Issue").cast("bigint").alias("story_points"))


def priority_breakdown(df: DataFrame) -> DataFrame:
    """Counts and share per priority; the window runs over the few grouped rows."""
    counted = df.groupBy("Priority").agg(F.count(F.lit(1)).alias("records"))
    return counted.withColumn("share_pct", F.col("records") * 100.0 / F.sum("records").over(Window.partitionBy()))


def score_histogram(df: DataFrame, p: str, bins: int = 20) -> DataFrame:
    """Equal bins on [0, 1], the last one closed; empty bins are present with 0."""
    slot = F.least(F.floor(F.col(p) * float(bins)), F.lit(bins - 1)).cast("int")
    counted = df.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    return binned(counted, bins)


def binned(counted: DataFrame, bins: int) -> DataFrame:
    """Every bin with its start and its records; empty bins are present with 0."""
    every = counted.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.col("bin") / float(bins)).alias("bin_start"), F.coalesce("records", F.lit(0)).alias("records"))

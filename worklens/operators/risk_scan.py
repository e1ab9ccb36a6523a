"""Rule-based risk scan: findings, decision chain, health score, actions and report.

One aggregation per scan, whatever the grouping; every product after it is a
row-wise expression on the aggregated row, so nothing is grouped twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from worklens.functions import band_health, clip, fixed_text, percent_text, ratio

# fixed values: severities in display order, icons, thresholds and wording
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2, "success": 3}
ICON_CRITICAL, ICON_WARNING, ICON_SUCCESS = "\U0001F534", "\U0001F7E1", "✅"
SPRINT, WORKLOAD, BURNOUT = "Sprint Completion", "Workload Projection", "Burnout Risk"
LIMITS = {SPRINT: (0.15, 0.5), WORKLOAD: (0.2, 0.45), BURNOUT: (0.25, 0.5)}
ACTIONS = {
    SPRINT: "Consider reducing scope or unblocking stories immediately.",
    WORKLOAD: "Redistribute story points from overloaded to available team members.",
    BURNOUT: "Schedule 1:1s, reduce high-priority task load, or grant recovery sprint.",
}
ALL_WELL = {
    SPRINT: ("All sprints on track", "No spillover risk detected."),
    WORKLOAD: ("Workloads within capacity", "No overload signals found."),
    BURNOUT: ("No burnout risk detected", "Team load looks sustainable."),
}
# (label, detail, status)
CHAIN_TEXT = {
    "linked_sprint": ("Linked: Sprint risk ← Overload detected",
                      "Sprint may be at risk because team members are overloaded. Reallocation needed.", "alert"),
    "rebalance": ("Recommend: Rebalance workload",
                  "Move story points from overloaded members to those under capacity before sprint closes.", "action"),
    "sprint_only": ("Sprint risk detected — checking workload",
                    "Workload looks OK. Risk may stem from blocked stories or scope change.", "alert"),
    "unblock": ("Recommend: Unblock stories & freeze scope",
                "No reallocation needed. Focus on removing blockers and preventing scope creep.", "action"),
    "linked_burnout": ("Linked: Burnout risk ← Persistent overloads",
                       "Burnout signal correlates with overloaded workload across multiple sprints.", "alert"),
    "recovery": ("Recommend: Recovery sprint or capacity reduction",
                 "Reduce assigned story points by 20–30% for flagged members next sprint.", "action"),
    "all_clear": ("All clear — no chained risks",
                  "No cross-objective dependencies triggered. Project health looks good.", "done"),
}
P1, P2, P3 = "\U0001F534 P1 — Immediate", "\U0001F7E1 P2 — This Sprint", "\U0001F4A1 P3 — Next Sprint"
STEP_ICON = {"done": "✅", "alert": "⚠️", "action": "\U0001F4A1"}
CLOSING = ("*Report auto-generated by the Agentic AI layer. ", " rows × 5 objectives scanned.*")
STATUS_ICON = {"Healthy": "\U0001F7E2", "Needs Attention": "\U0001F7E1", "At Risk": "\U0001F534"}


@dataclass(frozen=True)
class Signals:
    """Where the scan takes its flags and probabilities from."""

    sprint_fails: Column
    sprint_p: Column
    overloaded: Column
    overload_p: Column
    burnout: Column


def label_signals() -> Signals:
    ok, over, flag = F.col("Success_Label"), F.col("Expected_Overload"), F.col("Risk_Flag")
    return Signals(ok == 0, ok.cast("double"), over == 1, over.cast("double"), flag == 1)


def prediction_signals(sprint: tuple[str, str], workload: tuple[str, str], burnout: str) -> Signals:
    """Signals from scored columns: (prediction, probability) names and a prediction name."""
    return Signals(F.col(sprint[0]) == 0, F.col(sprint[1]), F.col(workload[0]) == 1,
                   F.col(workload[1]), F.col(burnout) == 1)


def _mean_where(hit: Column, value: Column) -> Column:
    return F.coalesce(F.avg(F.when(hit, value)), F.lit(0.0))


def _finding(severity: Column, icon: Column, objective: str, title: Column, detail: Column, action: Column,
             seq: Column) -> Column:
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[severity], F.lit(9))
    return F.struct(rank.alias("rank"), seq.alias("seq"), severity.alias("severity"),
                    F.lit(objective).alias("objective"), icon.alias("icon"), title.alias("title"),
                    detail.alias("detail"), action.alias("action"))


def scan(df: DataFrame, group_cols: Sequence[str] = (), signals: Signals | None = None) -> DataFrame:
    """One row per group: ``records``, ``findings`` (sorted), ``chain``, ``health``."""
    s = signals or label_signals()

    def col(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(0.0)

    total = lambda hit: F.sum(F.when(hit, 1).otherwise(0)).cast("bigint")
    stats = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("records"),
        total(s.sprint_fails).alias("n_sprint"), total(s.overloaded).alias("n_over"),
        total(s.burnout).alias("n_burn"),
        _mean_where(s.sprint_fails, s.sprint_p).alias("m_p"),
        _mean_where(s.sprint_fails, col("Blocked_Stories")).alias("m_blocked"),
        _mean_where(s.sprint_fails, col("Days_Remaining_Sprint")).alias("m_days"),
        _mean_where(s.overloaded, s.overload_p).alias("m_op"),
        _mean_where(s.overloaded, col("Current_Workload_Percent")).alias("m_wl"),
        _mean_where(s.burnout, col("Consecutive_Overloads")).alias("m_consec"))

    n = F.col("records")
    text = lambda c: F.col(c).cast("string")
    wording = {
        SPRINT: ("n_sprint",
                 F.concat(text("n_sprint"), F.lit(" of "), text("records"), F.lit(" sprints ("),
                          percent_text(ratio(F.col("n_sprint") * 1.0, n, 0.0)), F.lit(") at risk of spillover")),
                 F.concat(F.lit("Avg completion probability: "), percent_text(F.col("m_p")),
                          F.lit(" | Avg blocked stories: "), fixed_text(F.col("m_blocked"), 1),
                          F.lit(" | Avg days remaining: "), fixed_text(F.col("m_days"), 1))),
        WORKLOAD: ("n_over",
                   F.concat(text("n_over"), F.lit(" resource(s) projected to be overloaded")),
                   F.concat(F.lit("Average overload probability: "), percent_text(F.col("m_op")),
                            F.lit(" | Avg current workload: "), percent_text(F.col("m_wl") / 100.0))),
        BURNOUT: ("n_burn",
                  F.concat(text("n_burn"), F.lit(" team member(s) flagged for burnout risk")),
                  F.concat(F.lit("Avg consecutive overloads: "), fixed_text(F.col("m_consec"), 1),
                           F.lit(" sprints"))),
    }
    findings, raised = [], {}
    for seq, (objective, (count, title, detail)) in enumerate(wording.items(), start=1):
        warn, critical = LIMITS[objective]
        hit = F.col(count) * 1.0 / n
        is_warn = (n > 0) & (hit > warn)
        raised[objective] = is_warn
        severity = F.when((n > 0) & (hit > critical), "critical").when(is_warn, "warning").otherwise("success")
        icon = (F.when(severity == "critical", ICON_CRITICAL).when(severity == "warning", ICON_WARNING)
                .otherwise(ICON_SUCCESS))
        well_title, well_detail = ALL_WELL[objective]
        findings.append(_finding(
            severity, icon, objective, F.when(is_warn, title).otherwise(well_title),
            F.when(is_warn, detail).otherwise(well_detail),
            F.when(is_warn, ACTIONS[objective]).otherwise(""),
            F.when(is_warn, seq).otherwise(seq + len(wording))))

    def step(name: str, when: Column) -> Column:
        label, detail, status = CHAIN_TEXT[name]
        return F.when(when, F.struct(F.lit(label).alias("label"), F.lit(detail).alias("detail"),
                                     F.lit(status).alias("status")))

    sprint, over, burn = raised[SPRINT], raised[WORKLOAD], raised[BURNOUT]
    opening = F.struct(F.lit("Scan Objectives").alias("label"),
                       F.concat(F.lit("Scanned "), text("records"), F.lit(" records across 5 objectives.")).alias("detail"),
                       F.lit("done").alias("status"))
    chain = F.filter(F.array(
        opening,
        step("linked_sprint", sprint & over), step("rebalance", sprint & over),
        step("sprint_only", sprint & ~over), step("unblock", sprint & ~over),
        step("linked_burnout", burn & over), step("recovery", burn & over),
        step("all_clear", ~sprint & ~over & ~burn)), lambda s: s.isNotNull())

    out = stats.select(*group_cols, "records", F.array_sort(F.array(*findings)).alias("findings"),
                       chain.alias("chain"))
    count_of = lambda sev: F.size(F.filter("findings", lambda f: f["severity"] == sev))
    out = out.withColumns({"criticals": count_of("critical"), "warnings": count_of("warning"),
                           "healthy": count_of("success")})
    return out.withColumn("health", clip(
        F.lit(100) - F.col("criticals") * 25 - F.col("warnings") * 10, F.lit(0), F.lit(100)).cast("int"))


def agent_scan(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    rows = scanned.select(*group_cols, F.posexplode("findings").alias("pos", "f"))
    return rows.select(*group_cols, (F.col("pos") + 1).alias("seq"), *[
        F.col(f"f.{c}").alias(c) for c in ("severity", "objective", "icon", "title", "detail", "action")])


def decision_chain(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    rows = scanned.select(*group_cols, F.posexplode("chain").alias("pos", "s"))
    return rows.select(*group_cols, (F.col("pos") + 1).alias("step"),
                       *[F.col(f"s.{c}").alias(c) for c in ("label", "detail", "status")])


def health_score(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return scanned.select(*group_cols, "criticals", "warnings", "health",
                          band_health(F.col("health")).alias("band"))


def action_table(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Actions of findings by severity, then those of the chain."""
    def row(priority, objective, issue, action):
        return F.struct(priority.alias("Priority"), objective.alias("Objective"),
                        issue.alias("Issue"), action.alias("Action"))

    from_findings = F.transform(
        F.filter("findings", lambda f: f["action"] != ""),
        lambda f: row(F.when(f["severity"] == "critical", P1).otherwise(P2), f["objective"], f["title"], f["action"]))
    from_chain = F.transform(
        F.filter("chain", lambda s: s["status"] == "action"),
        lambda s: row(F.lit(P3), F.lit("Cross-Objective"), s["label"], s["detail"]))
    rows = scanned.select(*group_cols, F.posexplode(F.concat(from_findings, from_chain)).alias("pos", "a"))
    return rows.select(*group_cols, (F.col("pos") + 1).alias("seq"), "a.*")


def export_health(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return agent_scan(scanned, group_cols).select(
        *group_cols, F.col("objective").alias("Objective"), F.upper("severity").alias("Severity"),
        F.col("title").alias("Finding"), F.col("action").alias("Action"))


def export_actions(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return action_table(scanned, group_cols).drop("seq")


def report_markdown(scanned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The written report, one text per group."""
    band = band_health(F.col("health"))
    icon = F.create_map(*[F.lit(x) for kv in STATUS_ICON.items() for x in kv])[band]
    step_icon = F.create_map(*[F.lit(x) for kv in STEP_ICON.items() for x in kv])
    text = lambda c: F.col(c).cast("string")
    bullet = lambda f: F.concat(F.lit("- **"), f["icon"], F.lit(" ["), f["objective"], F.lit("]** "), f["title"])
    open_items = F.transform(
        F.filter("findings", lambda f: f["severity"] != "success"),
        lambda f: F.concat(bullet(f), F.lit(": "), f["detail"], F.lit("\n  → *"), f["action"], F.lit("*")))
    good_items = F.transform(F.filter("findings", lambda f: f["severity"] == "success"), bullet)
    steps = F.transform("chain", lambda s, i: F.concat(
        F.lit("**Step "), (i + 1).cast("string"), F.lit("** "), step_icon[s["status"]], F.lit(" "),
        s["label"], F.lit("\n"), s["detail"]))
    lines = F.concat(
        F.array(
            F.lit("## Project Health Report"),
            F.concat(F.lit("**Overall Status:** "), icon, F.lit(" "), band, F.lit(" — Health Score: "),
                     text("health"), F.lit("/100")),
            F.concat(F.lit("**Dataset:** "), text("records"), F.lit(" records analyzed across 5 AI objectives.")),
            F.lit("### Summary"),
            F.concat(text("criticals"), F.lit(" critical issue(s) and "), text("warnings"),
                     F.lit(" warning(s). "), text("healthy"), F.lit(" objective(s) returned healthy signals.")),
            F.lit("### Findings")),
        open_items, F.array(F.lit("### Healthy Signals")), good_items,
        F.array(F.lit("### Chained Recommendations")), steps,
        F.array(F.lit("---"), F.concat(F.lit(CLOSING[0]), text("records"), F.lit(CLOSING[1]))))
    return scanned.select(*group_cols, F.concat_ws("\n", lines).alias("report"))

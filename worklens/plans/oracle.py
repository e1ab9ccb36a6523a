"""DuckDB texts equivalent to the registered queries.

Written from the definitions, not from the DataFrame code. Doubles are rounded
by floor to six decimals, the form both engines evaluate alike.
"""

from __future__ import annotations

import math

from worklens import columns as C
from worklens.functions import noise as N
from worklens.operators import risk_scan as S
from worklens.operators import whatif as W
from worklens.sources.work_items import WORK_ITEMS_SQL

_KIND = {"string": "s", "double": "d", "int": "i", "bigint": "l"}
_TYPES = {n: _KIND[t.simpleString()] for n, t in C.WORK_ITEM_FIELDS}


def r(expr: str, digits: int = 6) -> str:
    return f"floor(({expr})*1e{digits}+0.5e0)/1e{digits}"


def _fill(name: str) -> str:
    zero = {"s": "'0'", "d": "0e0", "i": "0", "l": "0"}[_TYPES[name]]
    return f"coalesce({name}, {zero})"


def _label(name: str) -> str:
    hit = f"{_fill(name)} = 'Yes'" if _TYPES[name] == "s" else f"{_fill(name)} > {C.LABEL_THRESHOLDS[name]}e0"
    return f"case when {hit} then 1 else 0 end"


PREPARED = "select " + ", ".join(
    f"{_label(n) if n in C.LABEL_THRESHOLDS else _fill(n)} as {n}" for n in _TYPES) + " from work_items"
CTES = f"with work_items as ({WORK_ITEMS_SQL}), p as ({PREPARED})"


def on(select: str, *ctes: str) -> str:
    return CTES + "".join(f", {c}" for c in ctes) + " " + select


def _shown(names, keep=()) -> str:
    return ", ".join([*keep, *[f"{r(n) if _TYPES.get(n) == 'd' else n} as {n}" for n in names]])


def clip(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


PL, CO, DA, VE = ("Planned_Story_Points_Sprint", "Completed_Story_Points",
                  "Days_Remaining_Sprint", "Historical_Velocity")
BL, SC, WL, CN = "Blocked_Stories", "Scope_Change", "Current_Workload_Percent", "Consecutive_Overloads"
GAP = f"({PL} - {CO})"


def core_features(x: dict[str, str]) -> dict[str, str]:
    pl, co, da, ve, bl, sc, wl, cn = (x[k] for k in ("pl", "co", "da", "ve", "bl", "sc", "wl", "cn"))
    return {
        "Velocity_Efficiency": f"case when {pl} > 0 then {ve} / {pl} else 1e0 end",
        "Completion_Gap": f"({pl} - {co})",
        "Blocker_Severity": f"{bl} * case when {da} > 0 then 1e0 / {da} else 1e0 end",
        "Scope_Pressure": f"case when {pl} > 0 then {sc} / {pl} else 0e0 end",
        "Sprint_Momentum": f"case when {ve} > 0 then {co} / {ve} else 0e0 end",
        "Recovery_Index": f"case when {pl} - {co} > 0 and {da} > 0 then ({ve} * {da} / 1e1) / ({pl} - {co}) else 1e0 end",
        "Workload_Stress": f"{wl} / 1e2 * {cn}",
    }


TABLE = {"pl": PL, "co": CO, "da": DA, "ve": VE, "bl": BL, "sc": SC, "wl": WL, "cn": CN}
CORE = core_features(TABLE)


def nz(x: str, value: str) -> str:
    return f"case when {x} = 0 then {value} else {x} end"


CLIPPED = {
    "Velocity_Efficiency": clip(f"{VE} / ({nz(PL, '1e0')})", "0e0", "3e0"),
    "Completion_Gap": GAP,
    "Blocker_Severity": f"{BL} * (1e0 / abs({nz(DA, '1e0')}))",
    "Scope_Pressure": clip(f"{SC} / ({nz(PL, '1e0')})", "-1e0", "2e0"),
    "Sprint_Momentum": clip(f"{CO} / ({nz(VE, '1e0')})", "0e0", "2e0"),
    "Recovery_Index": clip(f"({VE} * {DA} / 1e1) / ({nz(GAP, '0.001e0')})", "0e0", "5e0"),
    "Workload_Stress": f"{WL} / 1e2 * {CN}",
}


def novel(scope_pressure: str) -> dict[str, str]:
    return {
        "Days_Per_Remaining_SP": clip(f"{DA} / ({nz(GAP, '0.001e0')})", "-2e0", "1e1"),
        "Overcommitment_Ratio": clip(f"{PL} / ({nz(VE, '1e0')})", "0e0", "3e0"),
        "Blocker_Scope_Risk": f"{BL} * (1e0 + {clip(scope_pressure, '0e0', '2e0')})",
        "Burn_Rate": clip(f"{CO} / {clip(f'1e1 - {DA}', '1e0', '1e1')}", "0e0", "2e1"),
        "Can_Finish_Score": clip(f"{VE} / 1e1 * {DA} - {GAP}", "-5e1", "5e1"),
    }


ERROR = clip(f"(Resolution_Time_Hours - Original_Estimate_Hours) / ({nz('Original_Estimate_Hours', '1e0')}) * 1e2",
             "-1e2", "3e2")
FAIL = "avg(case when Success_Label = 0 then 1e0 else 0e0 end)"
MEANS = (f"count(*) as records, {FAIL} as sprint_risk, avg(cast(Expected_Overload as double)) as overload, "
         "avg(cast(Risk_Flag as double)) as burnout, avg(Current_Workload_Percent) as workload, "
         "avg(cast(Consecutive_Overloads as double)) as consec")
CAPPED = clip("1e2 - sprint_risk * 35e0 - overload * 3e1 - burnout * 2e1 - least((workload - 1e2) / 2e0, 15e0)",
              "0e0", "1e2")
FLOORED = clip("1e2 - sprint_risk * 35e0 - overload * 3e1 - burnout * 2e1 - greatest((workload - 1e2) / 2e0, 0e0)",
               "0e0", "1e2")
STATUS = "case when score >= 60 then 'OK' when score >= 40 then 'Watch' else 'At Risk' end"


def person(key: str, score: str) -> str:
    return on(f"select {key}, records, " + ", ".join(
        f"{r(c)} as {c}" for c in ("sprint_risk", "overload", "burnout", "workload", "consec", "score"))
        + f", {STATUS} as status from b", f"a as (select {key}, {MEANS} from p group by {key})",
        f"b as (select *, {score} as score from a)")


def pct(expr: str) -> str:
    return f"cast(cast(floor(({expr})*1e2+0.5e0) as int) as varchar) || '%'"


def fixed1(expr: str) -> str:
    return f"printf('%.1f', {r(expr, 1)})"


HEAT = (f"heat as (select Assignee, {r('sr', 1)} as sprint_risk_pct, {r('ol', 1)} as overload_pct, "
        f"{r('br', 1)} as burnout_pct, {r('wl', 1)} as avg_workload, "
        + r(clip("1e2 - sr * 0.35e0 - ol * 0.3e0 - br * 0.2e0 - greatest(0e0, (wl - 1e2) / 2e0)", "0e0", "1e2"), 1)
        + f" as health_score from (select Assignee, {FAIL} * 1e2 as sr, avg(cast(Expected_Overload as double)) * 1e2 as ol, "
        "avg(cast(Risk_Flag as double)) * 1e2 as br, avg(Current_Workload_Percent) as wl from p group by Assignee))")


def heat_band(c: str) -> str:
    return f"case when {c} > 60 then 'red' when {c} > 30 then 'yellow' else 'green' end as {c}_band"


def recover() -> str:
    rem = f"greatest(0e0, {GAP})"
    rate = f"(case when {DA} > 0 then {VE} / 1e1 else 1e0 end)"
    inner = (f"select row_id, {rem} as remaining_sp, case when {PL} > 0 then {rem} * 1e2 / {PL} else 0e0 end as remaining_pct, "
             f"case when {rate} > 0 then {rem} / {rate} else 999e0 end as days_needed, "
             f"{rem} / (greatest(0.5e0, {VE} - {BL} * 2e0) / 1e1) as days_if_unblocked, {DA} as days from p")
    over = "greatest(0e0, days_needed - days)"
    over2 = "greatest(0e0, days_if_unblocked - days)"
    return on(f"select row_id, {r('remaining_sp')} as remaining_sp, {r('remaining_pct')} as remaining_pct, "
              f"{r('days_needed')} as days_needed, {r(over)} as overrun, {r('days_if_unblocked')} as days_if_unblocked, "
              f"{r(over2)} as overrun_if_unblocked, {r(over2 + ' - ' + over)} as overrun_change from q",
              f"q as ({inner})")


def profile() -> str:
    shown = {"s": "StringType", "d": "DoubleType", "i": "IntegerType", "l": "IntegerType"}
    return f"with work_items as ({WORK_ITEMS_SQL}) " + " union all ".join(
        f"select '{n}' as column_name, '{shown[k]}' as spark_type, count(*) - count({n}) as nulls, "
        f"count(distinct {n}) as distinct_values from work_items" for n, k in _TYPES.items())


def describe() -> str:
    cols = [n for n, k in _TYPES.items() if k != "s" or n in C.LABEL_THRESHOLDS][:8]
    one = lambda n: (
        f"select '{n}' as column_name, count({n}) as records, {r(f'avg(cast({n} as double))', 2)} as mean, "
        f"{r(f'stddev_samp(cast({n} as double))', 2)} as std, {r(f'min(cast({n} as double))', 2)} as min, "
        + ", ".join(f"{r(f'quantile_cont(cast({n} as double), 0.{q})', 2)} as q{q}" for q in (25, 50, 75))
        + f", {r(f'max(cast({n} as double))', 2)} as max from p")
    return on(" union all ".join(one(n) for n in cols))


# -- risk scan ---------------------------------------------------------------

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_ctes(keys: tuple[str, ...], source: str = "p", fails: str = "Success_Label = 0",
              p_ok: str = "Success_Label", over: str = "Expected_Overload = 1", p_over: str = "Expected_Overload",
              burn: str = "Risk_Flag = 1") -> list[str]:
    k = "".join(f"{c}, " for c in keys)
    group = f" group by {', '.join(keys)}" if keys else ""
    mean = lambda hit, v: f"coalesce(avg(case when {hit} then cast({v} as double) end), 0e0)"
    count = lambda hit: f"count(case when {hit} then 1 end)"
    stats = (f"st as (select {k}count(*) as n, {count(fails)} as n1, {count(over)} as n2, {count(burn)} as n3, "
             f"{mean(fails, p_ok)} as m_p, {mean(fails, BL)} as m_bl, {mean(fails, DA)} as m_da, "
             f"{mean(over, p_over)} as m_op, {mean(over, WL)} as m_wl, {mean(burn, CN)} as m_cn from {source}{group})")
    level = "case when cast({c} as double) / n > {hi}e0 then 'critical' when cast({c} as double) / n > {lo}e0 then 'warning' else 'success' end"
    levels = "lv as (select *, " + ", ".join(
        level.format(c=f"n{i}", lo=S.LIMITS[o][0], hi=S.LIMITS[o][1]) + f" as s{i}"
        for i, o in enumerate((S.SPRINT, S.WORKLOAD, S.BURNOUT), 1)) + " from st)"
    titles = {
        S.SPRINT: f"n1 || ' of ' || n || ' sprints (' || {pct('cast(n1 as double) / n')} || ') at risk of spillover'",
        S.WORKLOAD: "n2 || ' resource(s) projected to be overloaded'",
        S.BURNOUT: "n3 || ' team member(s) flagged for burnout risk'"}
    details = {
        S.SPRINT: f"'Avg completion probability: ' || {pct('m_p')} || ' | Avg blocked stories: ' || {fixed1('m_bl')} "
                  f"|| ' | Avg days remaining: ' || {fixed1('m_da')}",
        S.WORKLOAD: f"'Average overload probability: ' || {pct('m_op')} || ' | Avg current workload: ' || {pct('m_wl / 1e2')}",
        S.BURNOUT: f"'Avg consecutive overloads: ' || {fixed1('m_cn')} || ' sprints'"}
    parts = []
    for i, o in enumerate((S.SPRINT, S.WORKLOAD, S.BURNOUT), 1):
        well_t, well_d = S.ALL_WELL[o]
        parts.append(
            f"select {k}n, case s{i} when 'critical' then 0 when 'warning' then 1 else 3 end as rk, "
            f"case when s{i} = 'success' then {i + 3} else {i} end as ord, s{i} as severity, {_q(o)} as objective, "
            f"case s{i} when 'critical' then {_q(S.ICON_CRITICAL)} when 'warning' then {_q(S.ICON_WARNING)} "
            f"else {_q(S.ICON_SUCCESS)} end as icon, "
            f"case when s{i} = 'success' then {_q(well_t)} else {titles[o]} end as title, "
            f"case when s{i} = 'success' then {_q(well_d)} else {details[o]} end as detail, "
            f"case when s{i} = 'success' then '' else {_q(S.ACTIONS[o])} end as action from lv")
    part_by = f"partition by {', '.join(keys)} " if keys else ""
    findings = (f"fi as (select {k}cast(row_number() over ({part_by}order by rk, ord) as int) as seq, severity, objective, "
                f"icon, title, detail, action from ({' union all '.join(parts)}))")
    spr, ovl, brn = ("s1 <> 'success'", "s2 <> 'success'", "s3 <> 'success'")
    when = {"linked_sprint": f"{spr} and {ovl}", "rebalance": f"{spr} and {ovl}",
            "sprint_only": f"{spr} and not ({ovl})", "unblock": f"{spr} and not ({ovl})",
            "linked_burnout": f"{brn} and {ovl}", "recovery": f"{brn} and {ovl}",
            "all_clear": f"not ({spr}) and not ({ovl}) and not ({brn})"}
    steps = [f"select {k}0 as ord, 'Scan Objectives' as label, 'Scanned ' || n || ' records across 5 objectives.' as detail, "
             "'done' as status from lv"]
    steps += [f"select {k}{i}, {_q(S.CHAIN_TEXT[name][0])}, {_q(S.CHAIN_TEXT[name][1])}, {_q(S.CHAIN_TEXT[name][2])} "
              f"from lv where {cond}" for i, (name, cond) in enumerate(when.items(), 1)]
    chain = (f"ch as (select {k}cast(row_number() over ({part_by}order by ord) as int) as step, label, detail, status "
             f"from ({' union all '.join(steps)}))")
    sev = lambda v: f"cast(({' + '.join(f'case when s{i} = {_q(v)} then 1 else 0 end' for i in (1, 2, 3))}) as int)"
    health = (f"he as (select *, cast({clip('100 - criticals * 25 - warnings * 10', '0', '100')} as int) as health from "
              f"(select {k}n, {sev('critical')} as criticals, {sev('warning')} as warnings, {sev('success')} as healthy from lv))")
    return [stats, levels, findings, chain, health]


BAND = "case when health >= 75 then 'Healthy' when health >= 50 then 'Needs Attention' else 'At Risk' end"


def actions(keys: tuple[str, ...]) -> str:
    k = "".join(f"{c}, " for c in keys)
    part_by = f"partition by {', '.join(keys)} " if keys else ""
    return on(
        f"select {k}cast(row_number() over ({part_by}order by src, ord) as int) as seq, Priority, Objective, Issue, Action from ("
        f"select {k}0 as src, seq as ord, case when severity = 'critical' then {_q(S.P1)} else {_q(S.P2)} end as Priority, "
        f"objective as Objective, title as Issue, action as Action from fi where action <> '' union all "
        f"select {k}1, step, {_q(S.P3)}, 'Cross-Objective', label, detail from ch where status = 'action')",
        *scan_ctes(keys))


def report(keys: tuple[str, ...], ctes: list[str] | None = None) -> str:
    k = "".join(f"{c}, " for c in keys)
    part_by = "group by " + ", ".join(keys) if keys else ""
    icon = f"case {BAND} " + " ".join(f"when {_q(b)} then {_q(i)}" for b, i in S.STATUS_ICON.items()) + " end"
    step_icon = "case status " + " ".join(f"when {_q(b)} then {_q(i)}" for b, i in S.STEP_ICON.items()) + " end"
    head = (f"'## Project Health Report' || chr(10) || '**Overall Status:** ' || {icon} || ' ' || {BAND} || "
            "' — Health Score: ' || health || '/100' || chr(10) || '**Dataset:** ' || n || "
            "' records analyzed across 5 AI objectives.' || chr(10) || '### Summary' || chr(10) || criticals || "
            "' critical issue(s) and ' || warnings || ' warning(s). ' || healthy || "
            "' objective(s) returned healthy signals.' || chr(10) || '### Findings'")
    bullet = "'- **' || icon || ' [' || objective || ']** ' || title"
    rows = " union all ".join([
        f"select {k}0 as sec, 0 as ord, {head} as line from he",
        f"select {k}1, seq, {bullet} || ': ' || detail || chr(10) || '  → *' || action || '*' from fi where severity <> 'success'",
        f"select {k}2, 0, '### Healthy Signals' from he",
        f"select {k}3, seq, {bullet} from fi where severity = 'success'",
        f"select {k}4, 0, '### Chained Recommendations' from he",
        f"select {k}5, step, '**Step ' || step || '** ' || {step_icon} || ' ' || label || chr(10) || detail from ch",
        f"select {k}6, 0, '---' || chr(10) || '*Report auto-generated by the Agentic AI layer. ' || n || ' rows × 5 objectives scanned.*' from he"])
    return on(f"select {k}string_agg(line, chr(10) order by sec, ord) as report from ({rows}) {part_by}", *(ctes or scan_ctes(keys)))


def flat_sql() -> dict[str, str]:
    raw = f"with work_items as ({WORK_ITEMS_SQL}) "
    whole = raw + f"select {_shown(_TYPES)} from work_items"
    feats = lambda exprs: on("select row_id, " + ", ".join(f"{r(e)} as {n}" for n, e in exprs.items()) + " from p")
    res, spr = ("Resource_ID",), ("Sprint_Number",)
    ki = "count(*) as records, count(case when Success_Label = 0 then 1 end) as {a}, cast(sum(Risk_Flag) as bigint) as {b}"
    rate = lambda c: r(f"case when records > 0 then {c} * 1e2 / records else 0e0 end") + f" as {c}_pct"
    fit = ("select count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, "
           "regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, avg(x) as mx, max(x) + 1 as nx, avg(y) as my, "
           "arg_max(x, y) as px, max(y) as py, arg_min(x, y) as lx, min(y) as ly from v")
    err = "1.96e0 * sqrt(greatest(syy - b * sxy, 0e0) / (n - 2) * (1e0 + 1e0 / n + (nx - mx) * (nx - mx) / sxx))"
    return {
        "work_items": whole, "scan_csv": whole, "sink_roundtrip": whole,
        "preview_head": on(f"select {', '.join(f'{r(n)} as {n}' if k == 'd' and n not in C.LABEL_THRESHOLDS else n for n, k in _TYPES.items())} from p order by row_id limit 5"),
        "fill_missing": raw + "select " + ", ".join(
            f"{r(_fill(n)) if k == 'd' else _fill(n)} as {n}" for n, k in _TYPES.items()) + " from work_items",
        "binarize_labels": on("select row_id, " + ", ".join(C.LABEL_THRESHOLDS) + " from p"),
        "align_features": on(f"select row_id, {r(VE)} as {VE}, {r(BL)} as {BL}, 0e0 as Team_Size, {r(SC)} as {SC} from p"),
        "features_core": feats(CORE), "features_clipped": feats(CLIPPED),
        "features_novel": feats(novel(CLIPPED["Scope_Pressure"])),
        "estimation_error_rows": on(
            f"select row_id, Issue_Type, {_shown(['Original_Estimate_Hours', 'Resolution_Time_Hours'])}, "
            f"{r(ERROR)} as estimation_error_pct from p"),
        "confidence_band": on(
            f"select row_id, pred, {r('p')} as p, case when pred = 1 and p > 0.75e0 or pred = 0 and p < 0.25e0 then 'High' "
            "when pred = 1 and p > 0.6e0 or pred = 0 and p < 0.4e0 then 'Medium' else 'Low' end as confidence from "
            "(select row_id, Percent_Done / 1e2 as p, case when Percent_Done / 1e2 > 0.5e0 then 1 else 0 end as pred from p)"),
        "days_to_recover": recover(),
        "kpi_summary": on(f"select {ki.format(a='sprints_at_risk', b='burnout_flags')}, {len(_TYPES)} as features from p"),
        "kpi_rates": on("select *, " + ", ".join(rate(c) for c in ("done", "at_risk", "burnout", "overload")) + " from k",
                        f"k as (select {ki.format(a='at_risk', b='burnout')}, count(case when Success_Label = 1 then 1 end) as done, "
                        "count(case when Expected_Overload = 1 then 1 end) as overload from p)"),
        "assignee_risk": person("Assignee", CAPPED),
        "assignee_risk_floored": person("Assignee", FLOORED),
        "resource_risk": person("Resource_ID", CAPPED),
        "export_assignees": on(
            f"select Assignee, {r('score', 1)} as Health_Score, {pct('sprint_risk')} as Sprint_Risk, {pct('overload')} as Overload, "
            f"{pct('burnout')} as Burnout_Flag, {pct('workload / 1e2')} as Avg_Workload, {r('consec', 1)} as Avg_Consec_Overloads, "
            f"{STATUS} as Status from (select *, {CAPPED} as score from (select Assignee, {MEANS} from p group by Assignee))"),
        "health_heatmap": on("select * from heat", HEAT),
        "heatmap_bands": on(
            "select Assignee, " + ", ".join(heat_band(c) for c in ("sprint_risk_pct", "overload_pct", "burnout_pct", "avg_workload"))
            + ", case when health_score >= 60 then 'green' when health_score >= 40 then 'yellow' else 'red' end as health_score_band from heat", HEAT),
        "sprint_trend": on(
            f"select Sprint_Number, {r(FAIL + ' * 1e2', 1)} as sprint_risk_pct, {r(f'avg({WL})', 1)} as avg_workload, "
            f"{r(f'avg({BL})', 2)} as avg_blocked, {r('avg(cast(Risk_Flag as double)) * 1e2', 1)} as burnout_pct from p group by Sprint_Number"),
        "workload_pivot": on("select Sprint_Number, " + ", ".join(
            r(f"avg(case when Assignee = '{a}' then {WL} end)", 1) + f" as {a}" for a in C.ASSIGNEES) + " from p group by Sprint_Number"),
        "issue_type_counts": on("select Issue_Type, count(*) as records from p group by Issue_Type"),
        "workload_by_assignee": on(f"select Assignee, {r(f'avg({WL})')} as avg_workload from p group by Assignee"),
        "risk_by_sprint": on(f"select Sprint_Number, {r(FAIL + ' * 1e2')} as risk_pct from p group by Sprint_Number"),
        "burnout_by_sprint": on(f"select Sprint_Number, {r('avg(cast(Risk_Flag as double)) * 1e2')} as burnout_pct from p group by Sprint_Number"),
        "estimation_summary": on(
            f"select {r('e')} as avg_estimate, {r('a')} as avg_actual, {r('x')} as avg_error_pct, "
            "case when x > 0 then 'over budget' else 'under budget' end as budget from "
            f"(select avg(Original_Estimate_Hours) as e, avg(Resolution_Time_Hours) as a, avg({ERROR}) as x from p)"),
        "estimation_histogram": on(f"select {r('e')} as estimation_error_pct, records from (select {r(ERROR)} as e, count(*) as records from p group by 1)"),
        "cycle_time_by_priority": on(f"select Priority, {r('avg(Resolution_Time_Hours)')} as avg_resolution_hours from p group by Priority"),
        "cycle_time_proxy": on(f"select Assignee, {r(f'avg({DA})')} as avg_days_remaining from p group by Assignee"),
        "assignee_stats": on(
            f"select Assignee, count(*) as records, {r(f'avg({WL})', 2)} as avg_workload, {r(f'avg(cast({CN} as double))', 2)} as avg_consec_overloads, "
            f"cast(sum(Risk_Flag) as bigint) as burnout_count, {r('avg(cast(Success_Label as double))', 2)} as success_rate from p group by Assignee"),
        "sprint_stats": on(
            f"select Sprint_Number, {r('avg(cast(Success_Label as double))', 3)} as success_rate, {r(f'avg({WL})', 3)} as avg_workload, "
            f"{r(f'avg({BL})', 3)} as avg_blocked, count(*) as records from p group by Sprint_Number order by Sprint_Number limit 20"),
        "profile_columns": profile(),
        "describe_numeric": describe(),
        "feature_means": on(" union all ".join(
            f"select '{n}' as feature, {r(f'avg({e})')} as mean from p"
            for n, e in (CORE | novel("(" + CORE["Scope_Pressure"] + ")")).items())),
        "resource_vectors": on(f"select Resource_ID, " + ", ".join(f"{r(c)} as {c}" for c in ("workload", "burnout", "sprint_risk", "consec"))
                               + f" from (select Resource_ID, {MEANS} from p group by Resource_ID)"),
        "distinct_assignees": on("select distinct Assignee from p"),
        "label_variety": on(" union all ".join(
            f"select '{c}' as label, cast(count(distinct {c}) as int) as classes, count(distinct {c}) > 1 as can_fit from p" for c in C.LABEL_THRESHOLDS)),
        "score_histogram": on(
            "select cast(b as int) as bin, " + r("b / 2e1") + " as bin_start, coalesce(records, 0) as records from range(20) g(b) left join "
            "(select least(cast(floor(Percent_Done / 1e2 * 2e1) as int), 19) as s, count(*) as records from p group by 1) on s = b"),
        "recent_slope": on(
            f"select cast(count(*) as int) as sprints, {r('(arg_max(m, Sprint_Number) - arg_min(m, Sprint_Number)) / greatest(count(*) - 1, 1)')} as slope from "
            "(select Sprint_Number, avg(Percent_Done / 1e2) as m from p group by Sprint_Number order by Sprint_Number desc limit 5)"),
        "cycle_time_matrix": on(
            f"select Issue_Type, Priority, Assignee, count(*) as records, {r('avg(Resolution_Time_Hours)')} as avg_hours, "
            f"{r('quantile_cont(Resolution_Time_Hours, 0.5)')} as p50_hours, {r('quantile_cont(Resolution_Time_Hours, 0.9)')} as p90_hours "
            "from p group by Issue_Type, Priority, Assignee"),
        "bug_density": on(
            f"select *, {r('case when story_points > 0 then bugs * 1e0 / story_points else 0e0 end')} as bugs_per_point from "
            "(select Sprint_Number, Assignee, count(case when Issue_Type = 'Bug' then 1 end) as bugs, cast(sum(Story_Points_Issue) as bigint) as story_points "
            "from p group by Sprint_Number, Assignee)"),
        "velocity_forecast": on(
            f"select cast(n as int) as sprints, {r('b')} as slope, {r('a')} as intercept, {r('my')} as avg_velocity, cast(px as int) as peak_sprint, "
            f"{r('py')} as peak_velocity, cast(lx as int) as low_sprint, {r('ly')} as low_velocity, cast(nx as int) as next_sprint, "
            f"{r('a + b * nx')} as next_velocity, {r('a + b * nx - ' + err)} as next_low, {r('a + b * nx + ' + err)} as next_high from f",
            f"v as (select cast(Sprint_Number as double) as x, sum({CO}) as y from p group by 1)", f"f as ({fit})"),
        "estimation_by_type": on(f"select Issue_Type, count(*) as records, {r('avg(Original_Estimate_Hours)')} as avg_estimate, {r('avg(Resolution_Time_Hours)')} as avg_actual from p group by Issue_Type"),
        "commitment_reliability": on(
            f"select Sprint_Number, {r('planned')} as planned, {r('completed')} as completed, {r('scope_change')} as scope_change, "
            f"{r('case when planned > 0 then completed * 1e2 / planned else 0e0 end')} as reliability_pct, "
            f"{r('case when planned > 0 then scope_change * 1e2 / planned else 0e0 end')} as scope_creep_pct from "
            f"(select Sprint_Number, sum({PL}) as planned, sum({CO}) as completed, sum({SC}) as scope_change from p group by Sprint_Number)"),
        "points_by_assignee": on("select Assignee, count(*) as records, cast(sum(Story_Points_Issue) as bigint) as story_points from p group by Assignee"),
        "priority_breakdown": on(f"select Priority, records, {r('records * 1e2 / sum(records) over ()')} as share_pct from (select Priority, count(*) as records from p group by Priority)"),
        "agent_scan": on("select * from fi", *scan_ctes(())),
        "agent_scan_by_sprint": on("select * from fi", *scan_ctes(spr)),
        "agent_scan_by_resource": on("select * from fi", *scan_ctes(res)),
        "decision_chain": on("select * from ch", *scan_ctes(())),
        "decision_chain_by_resource": on("select * from ch", *scan_ctes(res)),
        "health_score": on(f"select criticals, warnings, health, {BAND} as band from he", *scan_ctes(())),
        "health_score_by_resource": on(f"select Resource_ID, criticals, warnings, health, {BAND} as band from he", *scan_ctes(res)),
        "action_table": actions(()), "action_table_by_resource": actions(res),
        "export_actions": "select Priority, Objective, Issue, Action from (" + actions(()) + ")",
        "export_health": on("select objective as Objective, upper(severity) as Severity, title as Finding, action as Action from fi", *scan_ctes(())),
        "report_markdown": report(()), "report_markdown_by_sprint": report(spr),
    }


# -- what-if -----------------------------------------------------------------

_BASE = {PL: "pl", CO: "co", "Percent_Done": "pc", DA: "da", VE: "ve", BL: "bl", SC: "sc"}
SHORT = (f"s as (select row_id, Sprint_Number, {PL} as pl, {CO} as co, Percent_Done as pc, {DA} as da, {VE} as ve, "
         f"{BL} as bl, {SC} as sc, {WL} as wl, {CN} as cn from p)")


def score(**change: str) -> str:
    x = {k: k for k in ("pl", "co", "pc", "da", "ve", "bl", "sc", "wl", "cn")} | change
    feats = core_features(x)
    z = f"{W.RULE_INTERCEPT}e0" + "".join(
        f" + {w}e0 * ({x[_BASE[n]] if n in _BASE else feats[n]})" for n, w in W.RULE_COEFFICIENTS.items())
    return f"(1e0 / (1e0 + exp(-({z}))))"


def simulated(n: int, seed: int = 42) -> list[str]:
    """Noisy inputs per (row, draw), mixed step by step in CTEs, then scored."""
    h0 = ", ".join(f"((row_id % {N.PRIME}) * {N.ROW_STEP} + i * {N.DRAW_STEP} + {d * N.DIM_STEP + seed}) % {N.PRIME} as h{d}"
                   for d in range(8))
    ctes = [SHORT, f"m0 as (select s.*, {h0} from s, (select unnest(range(1, {n + 1})) as i))"]
    base = "row_id, pl, co, pc, da, ve, bl, sc, wl, cn"
    for step, (shift, mult) in enumerate(zip(N.SHIFTS, N.MIX), 1):
        ctes.append(f"m{step} as (select {base}, " + ", ".join(
            f"(xor(h{d}, h{d} >> {shift}) * {mult}) % {N.PRIME} as h{d}" for d in range(8)) + f" from m{step - 1})")
    u = lambda d: f"((cast(h{d} as double) + 1e0) / {N.PRIME + 1}e0)"
    zs = []
    for pair in range(4):
        radius = f"sqrt(-2e0 * ln({u(2 * pair)}))"
        angle = f"{2.0 * math.pi!r}e0 * {u(2 * pair + 1)}"
        zs += [f"{radius} * cos({angle})", f"{radius} * sin({angle})"]
    ctes.append(f"zz as (select {base}, " + ", ".join(f"{e} as z{j}" for j, e in enumerate(zs[:7])) + " from m3)")
    ctes.append(
        "nn as (select row_id, pl + z0 * (pl * 0.05e0) as pl, co + z1 * (co * 0.05e0 + 0.5e0) as co, "
        f"{clip('pc + z2 * 3e0', '0e0', '1e2')} as pc, da + z3 * 0.5e0 as da, ve + z4 * (ve * 0.05e0) as ve, "
        "greatest(0e0, bl + z5 * 0.3e0) as bl, sc + z6 as sc, wl, cn from zz)")
    ctes.append(f"sim as (select row_id, {score()} as p from nn)")
    return ctes


def monte_carlo(n: int) -> str:
    q = lambda v: f"quantile_cont(p, {v})"
    return on(
        f"select row_id, {r(f'count(case when p >= 0.5e0 then 1 end) / {n}e0')} as success_rate, "
        + ", ".join(f"{r(q(v / 100))} as p{v}" for v in (5, 25, 50, 75, 95))
        + f", {r(q(0.95) + ' - ' + q(0.05))} as uncertainty from sim group by row_id", *simulated(n))


def monte_carlo_histogram(n: int) -> str:
    return on("select cast(b as int) as bin, " + r("b / 2e1") + " as bin_start, coalesce(records, 0) as records from range(20) g(b) "
              "left join (select least(cast(floor(p * 2e1) as int), 19) as k, count(*) as records from sim group by 1) on k = b",
              *simulated(n))


def optimal_path() -> str:
    planned = "greatest(co + 1e0, pl - n)"
    tries = " union all ".join([
        f"select row_id, 1 as kind, 'unblock stories' as action, cast(n as double) as cost, {score(bl='greatest(0e0, bl - n)')} as p "
        "from (select *, unnest(range(1, cast(floor(bl) as bigint) + 2)) as n from lo)",
        f"select row_id, 2, 'descope sprint', cast(n as double), {score(pl=planned, pc=f'least(1e2, co / {planned} * 1e2)')} "
        "from (select *, unnest(range(1, cast(floor(pl - co) as bigint) + 1, 2)) as n from lo)",
        f"select row_id, 3, 'extend sprint', cast(n as double), {score(da='(da + n)')} from (select *, unnest(range(1, 11)) as n from lo)",
        f"select row_id, 4, 'freeze scope', sc, {score(sc='0e0')} from lo where sc > 0"])
    return on(
        f"select row_id, {r('now_p')} as current_p, coalesce(choice, 1) as choice, "
        "coalesce(action, case when now_p >= 0.8e0 then 'none needed' else 'combine actions' end) as action, "
        f"{r('cost')} as cost, {r('p')} as new_p, {r('p - now_p')} as gain from sc0 left join "
        "(select row_id as rid, cast(row_number() over (partition by row_id order by cost, kind) as int) as choice, action, cost, p "
        "from hits) on rid = row_id",
        SHORT, f"sc0 as (select *, {score()} as now_p from s)", "lo as (select * from sc0 where now_p < 0.8e0)",
        f"hits as (select * from (select *, row_number() over (partition by row_id, kind order by cost) as o from ({tries}) where p >= 0.8e0) where o = 1)")


def trajectory() -> str:
    done = "least(pl, co + ve * 0.8e0)"
    pct_ = f"case when pl > 0 then least(1e2, {done} / pl * 1e2) else pc end"
    steps = " union all ".join(
        f"select row_id, now_p, {i} as step, least(1e1, bl + {0.3 * i!r}e0) as b, sc + {0.5 * i!r}e0 as c, "
        + clip(score(co=done, pc=pct_, bl=f"least(1e1, bl + {0.3 * i!r}e0)", sc=f"(sc + {0.5 * i!r}e0)") + f" + slope * {i}", "0.05e0", "0.98e0")
        + " as p from sc0, sl" for i in (1, 2, 3))
    return on(
        f"select row_id, step, {r('now_p')} as current_p, {r('b')} as projected_blocked, {r('c')} as projected_scope, {r('p')} as p, "
        "case when p >= 0.5e0 then 'on track' else 'at risk' end as outlook, "
        "case when max(case when step = 3 then p end) over (partition by row_id) >= now_p then 'improving' else 'declining' end as overall from t",
        SHORT, f"sc0 as (select *, {score()} as now_p from s)",
        "sl as (select (arg_max(m, k) - arg_min(m, k)) / greatest(count(*) - 1, 1) as slope from "
        "(select Sprint_Number as k, avg(now_p) as m from sc0 group by 1 order by 1 desc limit 5))",
        f"t as ({steps})")


def risk_factors() -> str:
    parts = " union all ".join(
        f"select row_id, {_q(n.replace('_', ' '))} as feature, {i} as i, {n} * {W.RULE_COEFFICIENTS[n]}e0 as impact from p"
        for i, n in enumerate(C.BASE_SPRINT))
    return on(f"select row_id, cast(row_number() over (partition by row_id order by impact, i) as int) as position, feature, {r('impact')} as impact, "
              "case when impact > 0 then 'Helping' else 'Hurting' end as direction, "
              f"{r('least(abs(impact) / (max(abs(impact)) over (partition by row_id) + 1e-9) * 1e2, 1e2)')} as bar_pct from rf", f"rf as ({parts})")


# -- encoders, metrics, neighbours ---------------------------------------------

def zscores(cols, keep: str, source: str, fit: str) -> list[str]:
    stats = "zst as (select " + ", ".join(
        f"avg({c}) as m{j}, case when stddev_pop({c}) = 0 then 1e0 else stddev_pop({c}) end as s{j}" for j, c in enumerate(cols)) + f" from {fit})"
    rows = lambda name, src: f"{name} as (select {keep}, " + ", ".join(
        f"({c} - m{j}) / s{j} as f{j}" for j, c in enumerate(cols)) + f" from {src}, zst)"
    return [stats, rows("z", source), rows("zf", fit)]


def nearest(width: int, k: int, tag: str, where: str) -> str:
    d2 = " + ".join(f"(a.f{j} - b.f{j}) * (a.f{j} - b.f{j})" for j in range(width))
    return (f"nb as (select query_id, unnest(l) as e from (select a.row_id as query_id, "
            f"min({{'d': floor(sqrt({d2}) * 1e6 + 0.5e0), 'n': b.row_id, 'tag': b.{tag}}}, {k}) as l "
            f"from z a, zf b where {where} group by a.row_id))")


def similar() -> list[str]:
    return [*zscores(C.BASE_SPRINT, "row_id, Success_Label", "p", "p"), nearest(7, 5, "Success_Label", "a.row_id <> b.row_id")]


CODED = ("enc as (select *, (select count(*) from (select distinct Summary as v from p) where v < p.Summary) as Summary_enc, "
         "(select count(*) from (select distinct Labels as v from p) where v < p.Labels) as Labels_enc from p)")
PART = "('0x' || substr(md5(cast(row_id as varchar)), 1, 8))::bigint % 5"


def classify_parts() -> tuple[list[str], str]:
    picked = (
        "select query_id, tag as predicted from (select query_id, tag, row_number() over (partition by query_id "
        "order by floor(w * 1e6 + 0.5e0) desc, tag) as o from votes) where o = 1")
    return [
        CODED, f"tr as (select * from enc where {PART} <> 0)", f"te as (select * from enc where {PART} = 0)",
        *zscores(C.ALLOC, "row_id, Assignee_Resource", "te", "tr"), nearest(4, 5, "Assignee_Resource", "true"),
        "nz as (select query_id, e.d / 1e6 as d, e.tag as tag, min(e.d) over (partition by query_id) as d0 from nb)",
        "votes as (select query_id, tag, sum(case when d0 = 0 then 1e0 else 1e0 / d end) as w from nz where d0 > 0 or d = 0 group by query_id, tag)"], picked


def classify() -> str:
    ctes, picked = classify_parts()
    return on(picked, *ctes)


RULE = ("rp as (select Success_Label as y, case when Percent_Done / 1e2 > 0.5e0 then 1 else 0 end as pred, Percent_Done / 1e2 as p from p)")


def isotonic_rule() -> str:
    """The largest over starts of the least mean over ends, then lines between the knots."""
    value = ("case when lo.k is null then hi.v when hi.k is null or hi.k = lo.k then lo.v "
             "else lo.v + (hi.v - lo.v) * (te.p - lo.k) / (hi.k - lo.k) end")
    return on(
        f"select row_id, y, {r('te.p')} as p, {r(value)} as calibrated from te asof left join knots lo on te.p >= lo.k asof left join knots hi on te.p <= hi.k",
        f"rows_ as (select row_id, Success_Label as y, Percent_Done / 1e2 as p, {PART} = 0 as held from p)", "te as (select * from rows_ where held)",
        "pool as (select p, row_number() over (order by p) as i, sum(sum(y)) over (order by p) as cs, sum(count(*)) over (order by p) as cw, sum(y) as s, count(*) as w "
        "from rows_ where not held group by p)",
        "least_ as (select a.i as a, b.i as i, b.p as k, min(cast(b.cs - a.cs + a.s as double) / cast(b.cw - a.cw + a.w as double)) over (partition by a.i order by b.i desc) as m "
        "from pool a join pool b on a.i <= b.i)",
        "knots as (select k, max(m) as v from least_ group by k)")


def report_rows() -> str:
    f1 = "case when precision + recall > 0 then precision * recall * 2e0 / (precision + recall) else 0e0 end"
    per = ("select c as label, count(case when y = c then 1 end) as support, "
           "coalesce(count(case when y = c and pred = c then 1 end) * 1e0 / nullif(count(case when pred = c then 1 end), 0), 0e0) as precision, "
           "coalesce(count(case when y = c and pred = c then 1 end) * 1e0 / nullif(count(case when y = c then 1 end), 0), 0e0) as recall "
           "from rp, (select unnest([0, 1]) as c) group by c")
    avg_row = lambda name, f: (f"select '{name} avg', {r(f('precision'))}, {r(f('recall'))}, {r(f('f1'))}, cast(sum(support) as bigint), '' from pc")
    acc = "(select avg(case when y = pred then 1e0 else 0e0 end) from rp)"
    return on(
        f"select cast(label as varchar) as label, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, support, '' as note from pc union all "
        f"select 'accuracy', null, null, {r(acc)}, (select count(*) from rp), case when {acc} < 0.6e0 then 'low signal' else '' end union all "
        + avg_row("macro", lambda c: f"avg({c})") + " union all " + avg_row("weighted", lambda c: f"sum({c} * support) / sum(support)"),
        RULE, f"pc as (select *, {f1} as f1 from ({per}))")


def wide_sql(draws: int = 1000) -> dict[str, str]:
    onehot = [(c, v) for c, vs in (("Issue_Type", C.ISSUE_TYPES), ("Priority", C.PRIORITIES)) for v in sorted(vs)]
    scored = (f"ps as (select *, {score()} as prob from (select *, {PL} as pl, {CO} as co, Percent_Done as pc, {DA} as da, {VE} as ve, "
              f"{BL} as bl, {SC} as sc, {WL} as wl, {CN} as cn from p))")
    est, act = "Original_Estimate_Hours", "Resolution_Time_Hours"
    return {
        "label_encode": on("select row_id, cast(Summary_enc as int) as Summary_enc, cast(Labels_enc as int) as Labels_enc from enc", CODED),
        "standardize": on("select row_id, " + ", ".join(f"{r(f'f{j}')} as {c}" for j, c in enumerate(C.BASE_SPRINT)) + " from z",
                          *zscores(C.BASE_SPRINT, "row_id", "p", "p")),
        "one_hot": on("select row_id, " + ", ".join(f"case when {c} = {_q(v)} then 1e0 else 0e0 end as \"{c}_{v}\"" for c, v in onehot) + " from p"),
        "split_80_20": on(f"select row_id, case when {PART} = 0 then 'test' else 'train' end as part from p"),
        "stratified_folds": on("select row_id, Success_Label, cast((row_number() over (partition by Success_Label order by "
                               "md5(cast(row_id as varchar)), row_id) - 1) % 5 as int) as fold from p"),
        "stratified_split": on("select row_id, Success_Label, case when (row_number() over (partition by Success_Label order by "
                               "md5(cast(row_id as varchar)), row_id) - 1) % 5 = 0 then 'test' else 'train' end as part from p"),
        "class_weights": on(f"select Success_Label, records, {r('sum(records) over () * 1e0 / (count(*) over () * records)')} as weight "
                            "from (select Success_Label, count(*) as records from p group by 1)"),
        "classification_report": report_rows(),
        "roc_auc": on(
            f"select {r('sum(case when y = 1 then below + ties / 2e0 end) / (count(case when y = 1 then 1 end) * cast(count(case when y = 0 then 1 end) as double))')} as auc from "
            "(select y, sum(1 - y) over (order by p range between unbounded preceding and current row) - sum(1 - y) over (partition by p) as below, "
            "sum(1 - y) over (partition by p) as ties from rp)", RULE),
        "isotonic_rule": isotonic_rule(),
        "isolation_samples": on("select cast(tree as int) as tree, row_id from (select tree, row_id, row_number() over (partition by tree "
                                "order by md5('42/' || tree || '/' || row_id), row_id) as place from p, range(100) t(tree)) where place <= 256"),
        "brier_score": on(f"select {r('avg((p - y) * (p - y))')} as brier from rp", RULE),
        "regression_metrics": on(
            f"select {r('1e0 - mse / spread')} as r2, {r('mse')} as mse, {r('sqrt(mse)')} as rmse, {r('mae')} as mae from "
            f"(select avg(({act} - {est}) * ({act} - {est})) as mse, avg(abs({act} - {est})) as mae, var_pop({act}) as spread from p)"),
        "agent_scan_scored": on("select * from fi", scored, *scan_ctes(
            ("Sprint_Number",), "ps", "not prob >= 0.5e0", "prob", f"least({WL} / 220e0, 1e0) >= 0.5e0", f"least({WL} / 220e0, 1e0)", f"{CN} >= 2")),
        "monte_carlo": monte_carlo(draws), "monte_carlo_histogram": monte_carlo_histogram(draws),
        "optimal_path": optimal_path(), "trajectory": trajectory(), "risk_factors": risk_factors(),
        "knn_similar": on(
            f"select query_id, cast(row_number() over (partition by query_id order by e.d, e.n) as int) as position, e.n as neighbor_id, "
            f"{r('e.d / 1e6')} as distance, {r('1e0 / (1e0 + e.d / 1e6)')} as similarity, "
            "case when e.tag = 1 then 'Success' else 'Spilled' end as outcome from nb", *similar()),
        "knn_verdict": on(
            "select query_id, cast(sum(e.tag) as int) as succeeded, cast(count(*) as int) as compared, "
            "case when sum(e.tag) >= 3 then 'supports' else 'contradicts' end as verdict from nb group by query_id", *similar()),
        "knn_classify": classify(),
    }


def gaussian_nb() -> str:
    """Closed form: class means, population variances (plus 1e-9 of the largest overall variance) and priors."""
    w = range(len(C.WORKLOAD))
    stats = ("gs as (select label, count(*) as n, " + ", ".join(f"avg(f{j}) as m{j}, var_pop(f{j}) as v{j}" for j in w)
             + " from zf group by label)")
    eps = "ge as (select 1e-9 * greatest(" + ", ".join(f"var_pop(f{j})" for j in w) + ") as eps, count(*) as total from zf)"
    lik = " + ".join(f"-0.5e0 * (ln({2.0 * math.pi!r}e0 * (v{j} + eps)) + (f{j} - m{j}) * (f{j} - m{j}) / (v{j} + eps))" for j in w)
    ll = f"gl as (select row_id, z.label as y, gs.label as c, ln(n * 1e0 / total) + {lik} as ll from z, gs, ge)"
    return on(
        f"select row_id, y, cast(case when l1 > l0 then 1 else 0 end as int) as pred, {r('1e0 / (1e0 + exp(l0 - l1))')} as p from "
        "(select row_id, any_value(y) as y, max(case when c = 0 then ll end) as l0, max(case when c = 1 then ll end) as l1 from gl group by row_id)",
        f"lw as (select *, Expected_Overload as label from p)",
        f"tr as (select * from lw where {PART} <> 0)", f"te as (select * from lw where {PART} = 0)",
        *zscores(C.WORKLOAD, "row_id, label", "te", "tr"), stats, eps, ll)


def bayes_ctes(tag: str, cols: tuple[str, ...], label: str) -> list[str]:
    """``b_<tag>`` (row_id, pred, prob): what a model fitted on the training part says of every row."""
    w = range(len(cols))
    pick = ", ".join(f"cast({c} as double) as x{j}" for j, c in enumerate(cols))
    scale = ", ".join(f"avg(x{j}) as m{j}, case when stddev_pop(x{j}) = 0 then 1e0 else stddev_pop(x{j}) end as s{j}" for j in w)
    zs = ", ".join(f"(x{j} - m{j}) / s{j} as f{j}" for j in w)
    lik = " + ".join(f"-0.5e0 * (ln({2.0 * math.pi!r}e0 * (v{j} + eps)) + (f{j} - m{j}) * (f{j} - m{j}) / (v{j} + eps))" for j in w)
    return [
        f"x_{tag} as (select row_id, {label} as label, {PART} <> 0 as fits, {pick} from p)",
        f"z_{tag} as (select row_id, label, fits, {zs} from x_{tag}, (select {scale} from x_{tag} where fits))",
        f"c_{tag} as (select label, count(*) as n, " + ", ".join(f"avg(f{j}) as m{j}, var_pop(f{j}) as v{j}" for j in w) + f" from z_{tag} where fits group by label)",
        f"e_{tag} as (select 1e-9 * greatest(" + ", ".join(f"var_pop(f{j})" for j in w) + f") as eps, count(*) as total from z_{tag} where fits)",
        f"l_{tag} as (select row_id, c_{tag}.label as c, ln(n * 1e0 / total) + {lik} as ll from z_{tag}, c_{tag}, e_{tag})",
        f"b_{tag} as (select row_id, case when l1 > l0 then 1 else 0 end as pred, case when l0 - l1 > 7e2 then 0e0 else 1e0 / (1e0 + exp(l0 - l1)) end as prob from "
        f"(select row_id, max(case when c = 0 then ll end) as l0, max(case when c = 1 then ll end) as l1 from l_{tag} group by row_id))"]


FLAGS = [(f"{c}_{v}", f"case when {c} = {_q(v)} then 1e0 else 0e0 end") for c, vs in (("Issue_Type", C.ISSUE_TYPES), ("Priority", C.PRIORITIES)) for v in sorted(vs)]


def least_squares(alpha: float, drop_first: bool) -> list[str]:
    """``ls`` (row_id, y, predicted) of the held-out rows: normal equations on scaled features, solved by elimination."""
    first = {f"{c}_{sorted(vs)[0]}" for c, vs in (("Issue_Type", C.ISSUE_TYPES), ("Priority", C.PRIORITIES))}
    exprs = [e for name, e in FLAGS if not (drop_first and name in first)] + [f"cast({c} as double)" for c in C.TTR_NUMERIC]
    w = range(len(exprs))
    pick = ", ".join(f"{e} as x{j}" for j, e in enumerate(exprs))
    scale = ", ".join(f"avg(x{j}) as m{j}, stddev_pop(x{j}) as s{j}" for j in w)
    ctes = [f"lx as (select row_id, Resolution_Time_Hours as y, {PART} <> 0 as fits, {pick} from p)",
            f"lz as (select row_id, y, fits, my, {', '.join(f'(x{j} - m{j}) / s{j} as z{j}' for j in w)} from lx, (select avg(y) as my, {scale} from lx where fits))"]
    cells = [f"sum(z{i} * z{j}){f' + {alpha!r}e0' if i == j else ''} as a{i}_{j}" for i in w for j in w]
    ctes.append(f"g0 as (select {', '.join(cells)}, {', '.join(f'sum(z{i} * (y - my)) as b{i}' for i in w)} from lz where fits)")
    for k in list(w)[:-1]:
        rows = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} as a{i}_{j}" if i > k else f"a{i}_{j}" for i in w for j in w if j >= i or i > k]
        sides = [f"b{i} - a{i}_{k} * b{k} / a{k}_{k} as b{i}" if i > k else f"b{i}" for i in w]
        ctes.append(f"g{k + 1} as (select {', '.join([*rows, *sides])} from g{k})")
    last, before = len(exprs) - 1, f"g{len(exprs) - 1}"
    for i in reversed(w):
        rest = "".join(f" - a{i}_{j} * w{j}" for j in range(i + 1, last + 1))
        ctes.append(f"v{i} as (select *, (b{i}{rest}) / a{i}_{i} as w{i} from {before})")
        before = f"v{i}"
    fit = " + ".join(f"w{j} * z{j}" for j in w)
    ctes.append(f"ls as (select row_id, y, greatest(my + {fit}, 0e0) as predicted from lz, {before} where not fits)")
    return ctes


def objectives_closed() -> str:
    """Held-out metrics of three naive Bayes models, ridge regression and five neighbours."""
    parts = {"sprint": (C.BASE_SPRINT, "Success_Label"), "workload": (C.WORKLOAD, "Expected_Overload"), "burnout": (C.BURNOUT, "Risk_Flag")}
    bayes = [cte for t, (cols, label) in parts.items() for cte in bayes_ctes(t, cols, label)]
    rows = [f"select '{t}' as objective, 'Naive Bayes' as algorithm, count(*) as held_out, {r('avg(case when label = pred then 1e0 else 0e0 end)')} as accuracy, "
            f"cast(null as double) as r2, cast(null as double) as mse from b_{t} join x_{t} using (row_id) where not fits" for t in parts]
    rows.append(f"select 'ttr', 'Ridge Regression', count(*), null, {r('1e0 - avg((y - predicted) * (y - predicted)) / var_pop(y)')}, {r('avg((y - predicted) * (y - predicted))')} from ls")
    near, picked = classify_parts()
    rows.append(f"select 'alloc', 'KNN', count(*), {r('avg(case when Assignee_Resource = predicted then 1e0 else 0e0 end)')}, null, null from ({picked}) join p on row_id = query_id")
    return on(" union all ".join(rows), *bayes, *least_squares(1.0, False), *near)


def scanned_by_models() -> list[str]:
    parts = {"sprint": (C.BASE_SPRINT, "Success_Label"), "workload": (C.WORKLOAD, "Expected_Overload"), "burnout": (C.BURNOUT, "Risk_Flag")}
    added = ", ".join(f"b_{t}.pred as pred_{t}, b_{t}.prob as p_{t}" for t in parts)
    joined = " ".join(f"join b_{t} on b_{t}.row_id = p.row_id" for t in parts)
    return [*[cte for t, (cols, label) in parts.items() for cte in bayes_ctes(t, cols, label)],
            f"pf as (select p.*, {added} from p {joined})",
            *scan_ctes((), "pf", "pred_sprint = 0", "p_sprint", "pred_workload = 1", "p_workload", "pred_burnout = 1")]


def silhouette_of_bands() -> str:
    """All pairs of rows and clusters, from the definition of mean squared distances."""
    names = ("workload", "burnout", "sprint_risk", "consec")
    stats = ", ".join(f"avg({c}) as m{j}, case when stddev_pop({c}) = 0 then 1e0 else stddev_pop({c}) end as s{j}" for j, c in enumerate(names))
    d2 = " + ".join(f"(a.z{j} - b.z{j}) * (a.z{j} - b.z{j})" for j in range(4))
    return on(
        f"select {r('avg(case when n = 1 or far is null then 0e0 else coalesce((far - own) / nullif(greatest(own, far), 0), 0e0) end)')} as silhouette from "
        "(select id, max(case when same then others end) + 1 as n, max(case when same then total / nullif(others, 0) end) as own, "
        "min(case when not same then total / others end) as far from per group by id)",
        "rv as (select Resource_ID as id, avg(Current_Workload_Percent) as workload, avg(cast(Risk_Flag as double)) as burnout, "
        "avg(case when Success_Label = 0 then 1e0 else 0e0 end) as sprint_risk, avg(cast(Consecutive_Overloads as double)) as consec from p group by Resource_ID)",
        "rz as (select id, case when workload > 1e2 then 2 when workload > 8e1 then 1 else 0 end as band, "
        + ", ".join(f"({c} - m{j}) / s{j} as z{j}" for j, c in enumerate(names)) + f" from rv, (select {stats} from rv))",
        f"per as (select a.id, a.band = b.band as same, b.band, count(case when a.id <> b.id then 1 end) as others, sum({d2}) as total "
        "from rz a, rz b group by a.id, a.band, b.band)")


def fitted_sql() -> dict[str, str]:
    scanned = scanned_by_models()
    return {
        "fit_gnb": gaussian_nb(),
        "silhouette_of_bands": silhouette_of_bands(),
        "fit_ols": on(f"select row_id, {r('y')} as y, {r('predicted')} as predicted from ls", *least_squares(0.0, True)),
        "fit_ridge": on(f"select row_id, {r('y')} as y, {r('predicted')} as predicted from ls", *least_squares(1.0, False)),
        "train_objectives_closed": objectives_closed(),
        "agent_scan_fitted": on("select * from fi", *scanned),
        "decision_chain_fitted": on("select * from ch", *scanned),
        "health_score_fitted": on(f"select criticals, warnings, health, {BAND} as band from he", *scanned),
        "report_fitted": report((), scanned),
    }


def oracle_sql() -> dict[str, str]:
    return flat_sql() | wide_sql() | fitted_sql()

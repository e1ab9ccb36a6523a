"""The ``work_items`` table derived from ``orders`` and ``lineitem``.

``WORK_ITEMS_SQL`` is the definition (one text, valid in Spark and DuckDB; the
oracle uses it). ``work_items`` builds the same rows for Spark with one window
instead of three, and splits customers that hold too many rows for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WORK_ITEMS_SQL = """
with li as (
  select l_orderkey,
         sum(l_quantity) as planned,
         sum(case when l_linestatus = 'F' then l_quantity else 0e0 end) as completed,
         cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) as blocked,
         cast(sum(case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then -1 else 0 end) as double) as scope_chg,
         cast(count(*) as int) as n_lines
  from lineitem group by l_orderkey),
b as (
  select o_orderkey, o_custkey, o_orderdate, o_orderpriority,
         planned, completed, blocked, scope_chg, n_lines,
         cast(13 - (day(o_orderdate) - 1) % 14 as double) as days_rem,
         cast(60 + (cast(floor(o_totalprice) as bigint) % 101) as double) as wl
  from orders left join li on o_orderkey = l_orderkey),
w as (
  select b.*,
         coalesce(avg(coalesce(planned, 0e0)) over (partition by o_custkey order by o_orderdate, o_orderkey
                  rows between 3 preceding and 1 preceding), 0e0) as velocity,
         sum(case when wl > 110 then 0 else 1 end) over (partition by o_custkey order by o_orderdate, o_orderkey
                  rows between unbounded preceding and current row) as island
  from b),
v as (
  select w.*,
         row_number() over (partition by o_custkey, island order by o_orderdate, o_orderkey) as rn,
         min(case when wl > 110 then 1 else 0 end) over (partition by o_custkey, island) as all_over
  from w),
x as (
  select v.*,
         cast(case when wl > 110 then least(rn - (case when all_over = 1 then 0 else 1 end), 4) else 0 end as int) as consec,
         case o_custkey % 8 when 0 then 'Alice' when 1 then 'Bob' when 2 then 'Carol' when 3 then 'David'
              when 4 then 'Eve' when 5 then 'Frank' when 6 then 'Grace' else 'Henry' end as who,
         coalesce(planned, 0e0) % 40 as est,
         case coalesce(n_lines, 0) % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 5 else 8 end as sp,
         case (o_orderkey * 7 + o_custkey) % 5 when 0 then 'Fix login bug' when 1 then 'Add search'
              when 2 then 'Refactor API' when 3 then 'Update DB' else 'Deploy CI' end as summ
  from v)
select
  o_orderkey as row_id,
  concat('SP', cast(o_orderkey as varchar(20))) as Sprint_ID,
  cast((year(o_orderdate) - 1995) * 3 + floor((month(o_orderdate) - 1) / 4e0) + 1 as int) as Sprint_Number,
  planned as Planned_Story_Points_Sprint,
  completed as Completed_Story_Points,
  case when planned > 0 then completed / planned * 100 end as Percent_Done,
  days_rem as Days_Remaining_Sprint,
  velocity as Historical_Velocity,
  blocked as Blocked_Stories,
  scope_chg as Scope_Change,
  case when planned > 0 and completed * 100 > planned * 60 and blocked < 3 and days_rem > 1 then 'Yes' else 'No' end as Success_Label,
  who as Assignee,
  planned * 0.8e0 as Planned_Story_Points_Resource,
  planned * (0.7e0 + cast(o_custkey % 7 as double) / 1e1) as Current_Assigned_SP,
  velocity * 0.9e0 as Historical_Avg_SP,
  days_rem as Remaining_Days_Resource,
  cast(o_orderkey % 5 as double) as High_Priority_Tasks_Resource,
  wl as Current_Workload_Percent,
  (wl - 60) / 100e0 as Expected_Overload,
  concat('ISS', cast(o_orderkey as varchar(20))) as Issue_ID,
  case when (o_orderkey * 3 + o_custkey) % 10 < 3 then 'Bug' when (o_orderkey * 3 + o_custkey) % 10 < 6 then 'Story'
       when (o_orderkey * 3 + o_custkey) % 10 < 8 then 'Task' when (o_orderkey * 3 + o_custkey) % 10 < 9 then 'Epic'
       else 'Sub-task' end as Issue_Type,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'High' when o_orderpriority = '3-MEDIUM' then 'Medium' else 'Low' end as Priority,
  est as Original_Estimate_Hours,
  cast(sp as int) as Story_Points_Issue,
  est * (0.5e0 + cast(o_custkey % 14 as double) / 1e1) as Resolution_Time_Hours,
  planned as Total_SP_This_Sprint,
  velocity * 0.85e0 as Historical_Avg_SP_Burnout,
  cast((o_orderkey + o_custkey) % 5 as double) as High_Priority_Tasks_Burnout,
  consec as Consecutive_Overloads,
  case when consec >= 2 or wl > 130 then 1e0 else 0e0 end as Risk_Flag,
  summ as Summary,
  case (o_orderkey + o_custkey * 3) % 5 when 0 then 'feature' when 1 then 'bug' when 2 then 'tech-debt'
       when 3 then 'regression' else 'hotfix' end as Labels,
  est as Original_Estimate_Resource,
  cast(sp as int) as Story_Points_Resource,
  who as Assignee_Resource,
  o_custkey as Resource_ID
from x
"""

# A customer with more rows than this is processed day by day.
HOT_ROWS = 1_000_000
LOOKBACK = 3

def _hot_customers(orders: DataFrame, hot_rows: int) -> DataFrame | None:
    hot = (orders.groupBy("o_custkey").count().where(F.col("count") > hot_rows)
           .select("o_custkey", F.lit(True).alias("is_hot")))
    return None if hot.isEmpty() else hot


def with_history(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds ``prev``: the (planned, over) pairs of the up to three preceding rows.

    ``df`` is ordered per ``o_custkey`` by (``o_orderdate``, ``o_orderkey``).
    Normally one window per customer. For hot customers the window runs per
    customer and day, and the last three rows of every earlier day are carried
    in through a second window over at most three rows per day.
    """
    pair = F.struct(F.col("planned0").alias("planned"), F.col("over").alias("over"))
    order = ["o_orderdate", "o_orderkey"]
    if hot is None:
        w = Window.partitionBy("o_custkey").orderBy(*order)
        prev = F.array(*[F.lag(pair, k).over(w) for k in range(1, LOOKBACK + 1)])
        return df.withColumn("prev", prev)

    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    seg = (df.join(hot, "o_custkey", "left")
           .withColumn("seg", F.when(F.col("is_hot"), day).otherwise(F.lit(0))))
    w = Window.partitionBy("o_custkey", "seg").orderBy(*order)
    back = Window.partitionBy("o_custkey", "seg").orderBy(*[F.desc(c) for c in order])
    ranked = seg.withColumns(
        {f"lag{k}": F.lag(pair, k).over(w) for k in range(1, LOOKBACK + 1)}
        | {"rn": F.row_number().over(w)})
    tails = (seg.where("is_hot").withColumn("rn_back", F.row_number().over(back))
             .where(F.col("rn_back") <= LOOKBACK))
    across = Window.partitionBy("o_custkey").orderBy(*order)
    first = Window.partitionBy("o_custkey", "seg").orderBy(*order)
    carry = (tails.select("o_custkey", "seg", *order,
                          *[F.lag(pair, k).over(across).alias(f"carry{k}") for k in range(1, LOOKBACK + 1)])
             .withColumn("pos", F.row_number().over(first)).where("pos = 1")
             .select("o_custkey", "seg", *[f"carry{k}" for k in range(1, LOOKBACK + 1)]))
    carried = F.array(*[F.col(f"carry{k}") for k in range(1, LOOKBACK + 1)])
    prev = F.array(*[
        F.when(F.col("rn") > k, F.col(f"lag{k}"))
        .otherwise(F.get(carried, F.lit(k) - F.col("rn")))
        for k in range(1, LOOKBACK + 1)])
    return (ranked.join(carry, ["o_custkey", "seg"], "left")
            .withColumn("prev", prev).select(*df.columns, "prev"))


def work_items(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    lines = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(*map(F.expr, (
            "sum(l_quantity) as planned",
            "sum(case when l_linestatus = 'F' then l_quantity else 0e0 end) as completed",
            "cast(sum(if(l_returnflag = 'R', 1, 0)) as double) as blocked",
            "cast(sum(case l_returnflag when 'A' then 1 when 'N' then -1 else 0 end) as double) as scope_chg",
            "cast(count(*) as int) as n_lines",
        ))))
    joined = (
        orders.join(lines, "o_orderkey", "left")
        .selectExpr("*", "cast(60 + floor(o_totalprice) % 101 as double) as wl", "coalesce(planned, 0e0) as planned0")
        .selectExpr("*", "cast(wl > 110 as int) as over"))
    seen = with_history(joined, _hot_customers(orders, hot_rows))
    return seen.selectExpr(
        "*",
        "coalesce(try_divide(coalesce(prev[0].planned, 0e0) + coalesce(prev[1].planned, 0e0) + coalesce(prev[2].planned, 0e0),"
        " size(filter(prev, p -> p is not null))), 0e0) as velocity",
        "cast(over * (1 + coalesce(prev[0].over, 0) * (1 + coalesce(prev[1].over, 0) * (1 + coalesce(prev[2].over, 0))))"
        " as int) as consec",
        "cast(13 - (day(o_orderdate) - 1) % 14 as double) as days_rem",
        "planned0 % 40 as est",
        "cast(array(1, 2, 3, 5, 8)[coalesce(n_lines, 0) % 5] as int) as sp",
        "array('Alice', 'Bob', 'Carol', 'David', 'Eve', 'Frank', 'Grace', 'Henry')[o_custkey % 8] as who",
    ).selectExpr(
        "o_orderkey as row_id",
        "concat('SP', o_orderkey) as Sprint_ID",
        "cast((year(o_orderdate) - 1995) * 3 + floor((month(o_orderdate) - 1) / 4e0) + 1 as int) as Sprint_Number",
        "planned as Planned_Story_Points_Sprint",
        "completed as Completed_Story_Points",
        "case when planned > 0 then completed / planned * 100 end as Percent_Done",
        "days_rem as Days_Remaining_Sprint",
        "velocity as Historical_Velocity",
        "blocked as Blocked_Stories",
        "scope_chg as Scope_Change",
        "if(planned > 0 and completed * 100 > planned * 60 and blocked < 3 and days_rem > 1, 'Yes', 'No') as Success_Label",
        "who as Assignee",
        "planned * 0.8e0 as Planned_Story_Points_Resource",
        "planned * (0.7e0 + cast(o_custkey % 7 as double) / 1e1) as Current_Assigned_SP",
        "velocity * 0.9e0 as Historical_Avg_SP",
        "days_rem as Remaining_Days_Resource",
        "cast(o_orderkey % 5 as double) as High_Priority_Tasks_Resource",
        "wl as Current_Workload_Percent",
        "(wl - 60) / 1e2 as Expected_Overload",
        "concat('ISS', o_orderkey) as Issue_ID",
        "array('Bug', 'Bug', 'Bug', 'Story', 'Story', 'Story', 'Task', 'Task', 'Epic', 'Sub-task')"
        "[(o_orderkey * 3 + o_custkey) % 10] as Issue_Type",
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'High' when o_orderpriority = '3-MEDIUM' then 'Medium'"
        " else 'Low' end as Priority",
        "est as Original_Estimate_Hours",
        "sp as Story_Points_Issue",
        "est * (0.5e0 + cast(o_custkey % 14 as double) / 1e1) as Resolution_Time_Hours",
        "planned as Total_SP_This_Sprint",
        "velocity * 0.85e0 as Historical_Avg_SP_Burnout",
        "cast((o_orderkey + o_custkey) % 5 as double) as High_Priority_Tasks_Burnout",
        "consec as Consecutive_Overloads",
        "if(consec >= 2 or wl > 130, 1e0, 0e0) as Risk_Flag",
        "array('Fix login bug', 'Add search', 'Refactor API', 'Update DB', 'Deploy CI')[(o_orderkey * 7 + o_custkey) % 5] as Summary",
        "array('feature', 'bug', 'tech-debt', 'regression', 'hotfix')[(o_orderkey + o_custkey * 3) % 5] as Labels",
        "est as Original_Estimate_Resource",
        "sp as Story_Points_Resource",
        "who as Assignee_Resource",
        "o_custkey as Resource_ID",
    )

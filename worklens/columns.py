"""Column roles of the wide work-item table.

The order inside each tuple is part of the contract: model coefficients and
importances are reported in this order.
"""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()

# fixed values: the wide schema of a work-item file
WORK_ITEM_FIELDS = (
    ("row_id", _L),
    ("Sprint_ID", _S),
    ("Sprint_Number", _I),
    ("Planned_Story_Points_Sprint", _D),
    ("Completed_Story_Points", _D),
    ("Percent_Done", _D),
    ("Days_Remaining_Sprint", _D),
    ("Historical_Velocity", _D),
    ("Blocked_Stories", _D),
    ("Scope_Change", _D),
    ("Success_Label", _S),
    ("Assignee", _S),
    ("Planned_Story_Points_Resource", _D),
    ("Current_Assigned_SP", _D),
    ("Historical_Avg_SP", _D),
    ("Remaining_Days_Resource", _D),
    ("High_Priority_Tasks_Resource", _D),
    ("Current_Workload_Percent", _D),
    ("Expected_Overload", _D),
    ("Issue_ID", _S),
    ("Issue_Type", _S),
    ("Priority", _S),
    ("Original_Estimate_Hours", _D),
    ("Story_Points_Issue", _I),
    ("Resolution_Time_Hours", _D),
    ("Total_SP_This_Sprint", _D),
    ("Historical_Avg_SP_Burnout", _D),
    ("High_Priority_Tasks_Burnout", _D),
    ("Consecutive_Overloads", _I),
    ("Risk_Flag", _D),
    ("Summary", _S),
    ("Labels", _S),
    ("Original_Estimate_Resource", _D),
    ("Story_Points_Resource", _I),
    ("Assignee_Resource", _S),
    ("Resource_ID", _L),
)
WORK_ITEM_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in WORK_ITEM_FIELDS])

BASE_SPRINT = (
    "Planned_Story_Points_Sprint", "Completed_Story_Points", "Percent_Done",
    "Days_Remaining_Sprint", "Historical_Velocity", "Blocked_Stories", "Scope_Change",
)
WORKLOAD = (
    "Planned_Story_Points_Resource", "Current_Assigned_SP", "Historical_Avg_SP",
    "Remaining_Days_Resource", "High_Priority_Tasks_Resource", "Current_Workload_Percent",
)
TTR_NUMERIC = ("Original_Estimate_Hours", "Story_Points_Issue")
BURNOUT = (
    "Total_SP_This_Sprint", "Historical_Avg_SP_Burnout",
    "High_Priority_Tasks_Burnout", "Consecutive_Overloads",
)
ALLOC = ("Summary_enc", "Labels_enc", "Original_Estimate_Resource", "Story_Points_Resource")
ENGINEERED = (
    "Velocity_Efficiency", "Completion_Gap", "Blocker_Severity", "Scope_Pressure",
    "Sprint_Momentum", "Recovery_Index", "Workload_Stress",
)
NOVEL = (
    "Days_Per_Remaining_SP", "Overcommitment_Ratio", "Blocker_Scope_Risk",
    "Burn_Rate", "Can_Finish_Score",
)
ANOMALY = (
    "Current_Workload_Percent", "Blocked_Stories", "Consecutive_Overloads",
    "Completion_Gap", "Blocker_Severity", "Workload_Stress",
)

# fixed values: categories and binarisation thresholds
ISSUE_TYPES = ("Bug", "Epic", "Story", "Sub-task", "Task")
PRIORITIES = ("High", "Low", "Medium")
ASSIGNEES = ("Alice", "Bob", "Carol", "David", "Eve", "Frank", "Grace", "Henry")
LABEL_THRESHOLDS = {"Success_Label": 0.5, "Expected_Overload": 0.5, "Risk_Flag": 0.3}

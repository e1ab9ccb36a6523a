"""The registered queries: each reads the tables under ``sf_dir`` whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens import columns as C
from worklens import storage
from worklens.functions import settle
from worklens.operators import (
    encode, ensembles, features, isotonic, metrics, models, neighbors, objectives, prep, profile, risk_scan, rollups, unsupervised, whatif,
)
from worklens.sources import scan_csv, scan_parquet, work_items, write_csv, write_parquet

Query = Callable[[SparkSession, str], DataFrame]


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(work_items(spark, sf_dir))


def _on_prepared(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: settle(op(prepared(spark, sf_dir)))


def _on_staged(cols: Sequence[str], op: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read their input more than once: the needed columns are
    written to the shared folder first, instead of deriving the table per pass."""
    return lambda spark, sf_dir: settle(op(storage.stage(prepared(spark, sf_dir).select(*dict.fromkeys(cols)))))


def _on_raw(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: settle(op(work_items(spark, sf_dir)))


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_dir(spark)}/worklens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _csv_roundtrip(df: DataFrame) -> DataFrame:
    path = _fresh_path(df.sparkSession, "csv")
    write_csv(df, path)
    return scan_csv(df.sparkSession, path, C.WORK_ITEM_SCHEMA)


def _parquet_roundtrip(df: DataFrame) -> DataFrame:
    path = _fresh_path(df.sparkSession, "parquet")
    write_parquet(df, path)
    return scan_parquet(df.sparkSession, path)


def _features(mode: str) -> Query:
    def op(df: DataFrame) -> DataFrame:
        return features.engineer_features(df, mode).select("row_id", *C.ENGINEERED)
    return _on_prepared(op)


def _novel(df: DataFrame) -> DataFrame:
    return features.engineer_features(df, "clipped", novel=True).select("row_id", *C.NOVEL)


def _feature_means(df: DataFrame) -> DataFrame:
    return rollups.feature_means(features.engineer_features(df, "core", novel=True), C.ENGINEERED + C.NOVEL)


def _align(df: DataFrame) -> DataFrame:
    wanted = ("Historical_Velocity", "Blocked_Stories", "Team_Size", "Scope_Change")
    return prep.align(df, wanted)


# the columns the numeric description covers: the first eight that are numeric once prepared
NUMERIC = [n for n, t in C.WORK_ITEM_FIELDS if n in C.LABEL_THRESHOLDS or t.typeName() != "string"][:8]
ALLOCATION = ("row_id", "Summary", "Labels", "Original_Estimate_Resource", "Story_Points_Resource", "Assignee_Resource")
SPRINT_INPUTS = ("row_id", "Sprint_Number", *features.INPUTS.values())
LOOKUP = ("row_id", "Success_Label", *C.BASE_SPRINT)
BY_SPRINT, BY_RESOURCE = ("Sprint_Number",), ("Resource_ID",)
DURATION_INPUTS = ("row_id", "Resolution_Time_Hours", *C.TTR_NUMERIC, "Issue_Type", "Priority", *features.INPUTS.values())
SCAN_INPUTS = ("row_id", *C.LABEL_THRESHOLDS, *C.BASE_SPRINT, *C.WORKLOAD, *C.BURNOUT)


OBJECTIVE_INPUTS = (*SCAN_INPUTS, *DURATION_INPUTS, *ALLOCATION)


def _scanned(product, group_cols=()) -> Query:
    return _on_prepared(lambda df: product(risk_scan.scan(df, group_cols), group_cols))


def _flat_queries() -> dict[str, Query]:
    failed = lambda: F.col("Success_Label") == 0
    burned = lambda: F.col("Risk_Flag") == 1
    return {
        "work_items": _on_raw(lambda df: df),
        "scan_csv": _on_raw(_csv_roundtrip),
        "sink_roundtrip": _on_raw(_parquet_roundtrip),
        "preview_head": _on_prepared(prep.preview),
        "fill_missing": _on_raw(prep.fill_missing),
        "binarize_labels": _on_raw(lambda df: prep.binarize_labels(df).select("row_id", *C.LABEL_THRESHOLDS)),
        "align_features": _on_prepared(_align),
        "features_core": _features("core"),
        "features_clipped": _features("clipped"),
        "features_novel": _on_prepared(_novel),
        "estimation_error_rows": _on_prepared(rollups.estimation_error_rows),
        "confidence_band": _on_prepared(lambda df: prep.confidence_rows(prep.rule_prediction(df))),
        "days_to_recover": _on_prepared(features.days_to_recover),
        "kpi_summary": _on_prepared(rollups.kpi_summary),
        "kpi_rates": _on_prepared(rollups.kpi_rates),
        "assignee_risk": _on_prepared(rollups.assignee_risk),
        "assignee_risk_floored": _on_prepared(lambda df: rollups.assignee_risk(df, variant="floored")),
        "resource_risk": _on_prepared(lambda df: rollups.assignee_risk(df, by="Resource_ID")),
        "export_assignees": _on_prepared(rollups.export_assignees),
        "health_heatmap": _on_prepared(rollups.health_heatmap),
        "heatmap_bands": _on_prepared(rollups.heatmap_bands),
        "sprint_trend": _on_prepared(rollups.sprint_trend),
        "workload_pivot": _on_prepared(lambda df: rollups.workload_pivot(df)),
        "issue_type_counts": _on_prepared(lambda df: rollups.value_counts(df, "Issue_Type")),
        "workload_by_assignee": _on_prepared(
            lambda df: rollups.mean_by(df, "Assignee", "Current_Workload_Percent", "avg_workload")),
        "risk_by_sprint": _on_prepared(lambda df: rollups.rate_by(df, "Sprint_Number", failed(), "risk_pct")),
        "burnout_by_sprint": _on_prepared(lambda df: rollups.rate_by(df, "Sprint_Number", burned(), "burnout_pct")),
        "estimation_summary": _on_prepared(rollups.estimation_summary),
        "estimation_histogram": _on_prepared(rollups.error_histogram),
        "cycle_time_by_priority": _on_prepared(rollups.cycle_time),
        "cycle_time_proxy": _on_prepared(lambda df: rollups.cycle_time(df.drop("Resolution_Time_Hours"))),
        "assignee_stats": _on_prepared(rollups.assignee_stats),
        "sprint_stats": _on_prepared(rollups.sprint_stats),
        "profile_columns": _on_raw(profile.profile_columns),
        "describe_numeric": _on_staged(NUMERIC, profile.describe_numeric),
        "feature_means": _on_prepared(_feature_means),
        "resource_vectors": _on_prepared(lambda df: rollups.resource_vectors(df, "Resource_ID")),
        "distinct_assignees": _on_prepared(lambda df: rollups.distinct_values(df, "Assignee")),
        "label_variety": _on_prepared(lambda df: rollups.label_variety(df, list(C.LABEL_THRESHOLDS))),
        "score_histogram": _on_prepared(lambda df: rollups.score_histogram(prep.rule_prediction(df), "p")),
        "recent_slope": _on_prepared(lambda df: rollups.recent_slope(df, F.col("Percent_Done") / 100.0)),
        "cycle_time_matrix": _on_staged(("Issue_Type", "Priority", "Assignee", "Resolution_Time_Hours"),
                                        rollups.cycle_time_matrix),
        "bug_density": _on_prepared(rollups.bug_density),
        "velocity_forecast": _on_prepared(rollups.velocity_forecast),
        "estimation_by_type": _on_prepared(rollups.estimation_by_type),
        "commitment_reliability": _on_prepared(rollups.commitment_reliability),
        "points_by_assignee": _on_prepared(rollups.points_by_assignee),
        "priority_breakdown": _on_prepared(rollups.priority_breakdown),
        "agent_scan": _scanned(risk_scan.agent_scan),
        "agent_scan_by_sprint": _scanned(risk_scan.agent_scan, BY_SPRINT),
        "agent_scan_by_resource": _scanned(risk_scan.agent_scan, BY_RESOURCE),
        "decision_chain": _scanned(risk_scan.decision_chain),
        "decision_chain_by_resource": _scanned(risk_scan.decision_chain, BY_RESOURCE),
        "health_score": _scanned(risk_scan.health_score),
        "health_score_by_resource": _scanned(risk_scan.health_score, BY_RESOURCE),
        "action_table": _scanned(risk_scan.action_table),
        "action_table_by_resource": _scanned(risk_scan.action_table, BY_RESOURCE),
        "export_health": _scanned(risk_scan.export_health),
        "export_actions": _scanned(risk_scan.export_actions),
        "report_markdown": _scanned(risk_scan.report_markdown),
        "report_markdown_by_sprint": _scanned(risk_scan.report_markdown, BY_SPRINT),
    }


# Draws per row in the registered simulation.
DRAWS = 1000


def _allocation_rows(df: DataFrame) -> DataFrame:
    return encode.label_encode(df, {"Summary": "Summary_enc", "Labels": "Labels_enc"})


def _one_hot(df: DataFrame) -> DataFrame:
    flags = encode.one_hot(encode.levels_of(df, ["Issue_Type", "Priority"]))
    return df.select("row_id", *[e.alias(n) for n, e in flags.items()])


def _regression(df: DataFrame) -> DataFrame:
    return metrics.regression_metrics(df, "Resolution_Time_Hours", "Original_Estimate_Hours")


def _scored_scan(df: DataFrame) -> DataFrame:
    scored = whatif.scored(df, whatif.rule_score()).withColumns({
        "pred_success": (F.col("p") >= 0.5).cast("int"),
        "p_over": F.least(F.col("Current_Workload_Percent") / 220.0, F.lit(1.0)),
    }).withColumns({"pred_over": (F.col("p_over") >= 0.5).cast("int"),
                    "pred_burn": (F.col("Consecutive_Overloads") >= 2).cast("int")})
    signals = risk_scan.prediction_signals(("pred_success", "p"), ("pred_over", "p_over"), "pred_burn")
    return risk_scan.agent_scan(risk_scan.scan(scored, BY_SPRINT, signals), BY_SPRINT)


def similar_items(df: DataFrame) -> DataFrame:
    """The five most similar other items of every item."""
    z = encode.standardize(df, C.BASE_SPRINT, keep=("row_id", "Success_Label"))
    return neighbors.knn_join(z, z, C.BASE_SPRINT, 5, payload="Success_Label", exclude_self=True)


def _knn_classify(df: DataFrame) -> DataFrame:
    rows = _allocation_rows(df)
    train, test = encode.split_80_20(rows)
    keep = ("row_id", "Assignee_Resource")
    matches = neighbors.knn_join(
        encode.standardize(test, C.ALLOC, keep, fit_on=train), encode.standardize(train, C.ALLOC, keep),
        C.ALLOC, 5, payload="Assignee_Resource")
    return neighbors.knn_vote(matches)


def _isotonic_rule(df: DataFrame) -> DataFrame:
    """The share done as a probability, calibrated on the training rows: (row_id, y, p, calibrated) of the held-out rows."""
    train, test = (prep.rule_prediction(part).withColumn("model", F.lit(0)) for part in encode.split_80_20(df))
    maps = isotonic.fit(train.withColumn("x", F.col("p")))
    return isotonic.predict(maps, test, "p", "calibrated").select("row_id", "y", "p", "calibrated")


def _wide_queries() -> dict[str, Query]:
    rule = whatif.rule_score()
    on = _on_prepared
    report = lambda df: metrics.classification_report(prep.rule_prediction(df))
    return {
        "label_encode": _on_staged(("row_id", "Summary", "Labels"), lambda df: _allocation_rows(df).select("row_id", "Summary_enc", "Labels_enc")),
        "standardize": _on_staged(("row_id", *C.BASE_SPRINT), lambda df: encode.standardize(df, C.BASE_SPRINT)),
        "one_hot": _on_staged(("row_id", "Issue_Type", "Priority"), _one_hot),
        "split_80_20": on(encode.split_rows),
        "stratified_folds": on(lambda df: encode.stratified_folds(df.select("row_id", "Success_Label"), "Success_Label")),
        "stratified_split": on(lambda df: encode.stratified_rows(df, "Success_Label")),
        "class_weights": on(lambda df: encode.class_weights(df, "Success_Label")),
        "classification_report": on(report),
        "roc_auc": on(lambda df: metrics.roc_auc(prep.rule_prediction(df))),
        "brier_score": on(lambda df: metrics.brier_score(prep.rule_prediction(df))),
        "regression_metrics": on(_regression),
        "isotonic_rule": _on_staged(("row_id", "Percent_Done", "Success_Label"), _isotonic_rule),
        "agent_scan_scored": on(_scored_scan),
        "monte_carlo": on(lambda df: whatif.monte_carlo(df, rule, DRAWS)),
        "monte_carlo_histogram": on(lambda df: whatif.monte_carlo_histogram(df, rule, DRAWS)),
        "optimal_path": on(lambda df: whatif.optimal_path(df, rule)),
        "trajectory": _on_staged(SPRINT_INPUTS, lambda df: whatif.trajectory(df, rule)),
        "risk_factors": on(lambda df: whatif.risk_factors(df, whatif.RULE_COEFFICIENTS)),
        "knn_similar": _on_staged(LOOKUP, lambda df: neighbors.knn_similar(similar_items(df))),
        "knn_verdict": _on_staged(LOOKUP, lambda df: neighbors.knn_verdict(similar_items(df))),
        "knn_classify": _on_staged(ALLOCATION, _knn_classify),
    }


# Settings of the registered fits.
ROUNDS, TREES, BOOSTS, FOLDS = 80, 60, 60, 5
CALIBRATED_ROUNDS, BURNOUT_ROUNDS = 200, 60


def _split(df: DataFrame, objective: str, **options) -> models.Split:
    return models.prepare_split(df, models.OBJECTIVES[objective], **options)


def _classifier(objective: str, make: Callable[[models.Split], object], **options) -> Query:
    def op(df: DataFrame) -> DataFrame:
        s = _split(df, objective, **options)
        return models.classify(make(s).fit(s.train), s.test)
    return _on_prepared(op)


def _regressor(make: Callable[[models.Split], object], **options) -> Query:
    def op(df: DataFrame) -> DataFrame:
        s = _split(df, "ttr", **options)
        return models.regress(make(s).fit(s.train), s.test)
    return _on_staged(DURATION_INPUTS, op)


def _members(n: int) -> dict[str, object]:
    return ensembles.default_members(n, TREES, ROUNDS, BOOSTS)


def _allocation(make: Callable[[models.Split], object]) -> Query:
    """A fit of many classes: (row_id, y, predicted) of the held-out rows, by name."""
    def op(df: DataFrame) -> DataFrame:
        s = _split(df, "alloc")
        names = F.array(*[F.lit(a) for a in s.classes])
        return make(s).fit(s.train).transform(s.test).select(
            "row_id", names[F.col("label").cast("int")].alias("y"), names[F.col("prediction").cast("int")].alias("predicted"))
    return _on_staged(ALLOCATION, op)


def _burnout_vote(df: DataFrame) -> DataFrame:
    """Boosted trees and a balanced forest on burnout, by the mean of their probabilities."""
    s = _split(df, "burnout", extra=C.ENGINEERED[:4], balanced=True)
    members = {"Gradient Boosting": models.gbt(BURNOUT_ROUNDS), "Random Forest": models.forest(TREES, weighted=True)}
    return ensembles.vote_soft(ensembles.fit_members(members, s.train), s.test)


def _regressors(df: DataFrame) -> DataFrame:
    return objectives.compare_regressors(_split(df, "ttr", extra=C.ENGINEERED, drop_first=True), BURNOUT_ROUNDS)


def _vote(df: DataFrame) -> tuple[DataFrame, list[str]]:
    s = _split(df, "sprint", extra=C.ENGINEERED, balanced=True)
    members = _members(s.n_train)
    return ensembles.vote_soft(ensembles.fit_members(members, s.train), s.test), list(members)


def _comparison(df: DataFrame) -> DataFrame:
    voted, names = _vote(df)
    return ensembles.model_comparison(voted, names)


def _stacking(df: DataFrame) -> DataFrame:
    s = _split(df, "sprint", extra=C.ENGINEERED, balanced=True)
    return ensembles.stacking(_members(s.n_train), s.train, s.test, FOLDS)


def _scorecard(df: DataFrame) -> DataFrame:
    s = _split(df, "sprint", extra=C.ENGINEERED, balanced=True)
    members = _members(s.n_train)
    return ensembles.cv_scorecard(ensembles.out_of_fold(members, s.train, FOLDS), list(members))


def _calibrated(df: DataFrame) -> DataFrame:
    s = _split(df, "sprint", extra=C.ENGINEERED[:6] + C.NOVEL, stratified=True)
    return ensembles.calibrated_gbt(s.train, s.test, FOLDS, CALIBRATED_ROUNDS)


def _baseline_delta(df: DataFrame) -> DataFrame:
    base = _split(df, "sprint", balanced=True, stratified=True)
    baseline = models.classify(models.softmax(weighted=True).fit(base.train), base.test)
    rich = _split(df, "sprint", extra=C.ENGINEERED[:6] + C.NOVEL, stratified=True)
    enriched = models.classify(models.gbt(ROUNDS).fit(rich.train), rich.test)
    return ensembles.baseline_delta(baseline, enriched)


def _importance(df: DataFrame) -> DataFrame:
    s = _split(df, "sprint", extra=C.ENGINEERED)
    return models.feature_importance(models.gbt(ROUNDS).fit(s.train), df.sparkSession, s.names)


def _scenarios(df: DataFrame) -> DataFrame:
    makers = {
        "sprint": (True, lambda n, rows: models.tree(6)),
        "workload": (False, lambda n, rows: models.gaussian_nb()),
        "ttr": (False, lambda n, rows: models.ridge(n, models.label_deviation(rows))),
        "burnout": (True, lambda n, rows: models.tree(5)),
    }
    fitted = {name: models.fit_pipeline(df, models.OBJECTIVES[name], make, balanced)[0]
              for name, (balanced, make) in makers.items()}
    return models.score_scenarios(df, fitted, objectives.suggest_assignee(df, df))


def _scanned_by_models(df: DataFrame) -> DataFrame:
    """The scan of what Gaussian naive Bayes models of three objectives predict for every row."""
    fitted = {name: models.fit_pipeline(df, models.OBJECTIVES[name], lambda n, rows: models.gaussian_nb())[0]
              for name in ("sprint", "workload", "burnout")}
    signals = risk_scan.prediction_signals(("pred_sprint", "p_sprint"), ("pred_workload", "p_workload"), "pred_burnout")
    return risk_scan.scan(models.with_predictions(df, fitted), (), signals)


def _with_models(product: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_staged(SCAN_INPUTS, lambda df: product(_scanned_by_models(df)))


def _anomalies(df: DataFrame) -> DataFrame:
    return unsupervised.anomaly_flags(features.engineer_features(df), C.ANOMALY)


def _clusters(df: DataFrame) -> DataFrame:
    return unsupervised.cluster_resources(rollups.resource_vectors(df, "Resource_ID"), "Resource_ID")


def _band_silhouette(df: DataFrame) -> DataFrame:
    """How far the workload bands of resources part them, as a silhouette of their standardised vectors."""
    vectors = storage.stage(rollups.resource_vectors(df, "Resource_ID"))
    band = F.when(F.col("workload") > 100.0, 2).when(F.col("workload") > 80.0, 1).otherwise(0).alias("band")
    z = encode.standardize(vectors, unsupervised.VECTOR, keep=("Resource_ID", band))
    return unsupervised.silhouette(storage.stage(z), unsupervised.VECTOR, "band")


FITTED = (*C.BASE_SPRINT, *C.ENGINEERED, *C.NOVEL)


def _fitted_score(df: DataFrame) -> whatif.ModelScore:
    """A balanced logistic model on base, engineered and novel features."""
    pipeline, _, _ = models.fit_pipeline(df, models.OBJECTIVES["sprint"], lambda n, rows: models.logistic(n, weighted=True),
                                         balanced=True, extra=C.ENGINEERED + C.NOVEL)
    return whatif.ModelScore(pipeline, FITTED)


def _with_fitted(op: Callable[[DataFrame, whatif.ModelScore], DataFrame]) -> Query:
    return _on_staged((*SPRINT_INPUTS, "Success_Label"), lambda df: op(df, _fitted_score(df)))


def _with_inputs(op: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_staged((*SPRINT_INPUTS, "Success_Label"), op)


def _model_queries() -> dict[str, Query]:
    on = _on_prepared
    return {
        "fit_logistic": _classifier("workload", lambda s: models.softmax(weighted=True), balanced=True),
        "fit_tree": _classifier("sprint", lambda s: models.tree(6), balanced=True),
        "fit_forest": _classifier("burnout", lambda s: models.forest(TREES, weighted=True), balanced=True,
                                  extra=C.ENGINEERED[:4]),
        "fit_gbt": _classifier("sprint", lambda s: models.gbt(ROUNDS), extra=C.ENGINEERED),
        "fit_gbt_reg": _regressor(lambda s: models.gbt_regressor(ROUNDS), extra=C.ENGINEERED),
        "fit_gnb": _classifier("workload", lambda s: models.gaussian_nb()),
        "fit_ols": _regressor(lambda s: models.ols(), drop_first=True),
        "fit_ridge": _regressor(lambda s: models.ridge(s.n_train, models.label_deviation(s.train))),
        "fit_adaboost": _allocation(lambda s: ensembles.AdaBoost(BOOSTS, classes=len(s.classes))),
        "fit_multinomial": _allocation(lambda s: models.softmax(len(s.classes))),
        "fit_forest_alloc": _allocation(lambda s: models.forest(100)),
        "vote_burnout": _on_staged((*SCAN_INPUTS, *features.INPUTS.values()), _burnout_vote),
        "compare_regressors": _on_staged(DURATION_INPUTS, _regressors),
        "train_objectives": _on_staged(OBJECTIVE_INPUTS, objectives.train_objectives),
        "train_objectives_closed": _on_staged(OBJECTIVE_INPUTS, lambda df: objectives.train_objectives(df, objectives.CLOSED)),
        "vote_soft": on(lambda df: _vote(df)[0]),
        "model_comparison": on(_comparison),
        "stacking": _with_inputs(_stacking),
        "cv_scorecard": _with_inputs(_scorecard),
        "calibrated_gbt": _with_inputs(_calibrated),
        "baseline_delta": _with_inputs(_baseline_delta),
        "feature_importance": on(_importance),
        "score_scenarios": _on_staged(OBJECTIVE_INPUTS, _scenarios),
        "agent_scan_fitted": _with_models(risk_scan.agent_scan),
        "decision_chain_fitted": _with_models(risk_scan.decision_chain),
        "health_score_fitted": _with_models(risk_scan.health_score),
        "report_fitted": _with_models(risk_scan.report_markdown),
        "monte_carlo_fitted": _with_fitted(lambda df, score: whatif.monte_carlo(df, score, DRAWS)),
        "optimal_path_fitted": _with_fitted(whatif.optimal_path),
        "trajectory_fitted": _with_fitted(whatif.trajectory),
        "cluster_resources": on(_clusters),
        "silhouette_of_bands": on(_band_silhouette),
        "anomaly_flags": on(_anomalies),
        "isolation_samples": _on_staged(("row_id",), lambda df: unsupervised.tree_samples(df).select("tree", "row_id")),
        "anomaly_topk": on(lambda df: unsupervised.anomaly_topk(_anomalies(df))),
    }


def queries() -> dict[str, Query]:
    return _flat_queries() | _wide_queries() | _model_queries()

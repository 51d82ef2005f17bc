"""Compare diagnosed findings with expected ones, run by run and as a suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.runtimes import canonical_runtime, is_supported
from jobscope.session import literal_rows
from jobscope.vocab import (
    EXPECTED_FINDINGS,
    OUTCOMES,
    SCORE_LANES,
    SCORE_RUNTIMES,
    SUITE_OUTCOMES,
)

UNKNOWN = "UNKNOWN"


def expected_catalog(spark: SparkSession) -> DataFrame:
    """The built-in expectations, one row per scenario."""
    ddl = (
        "scenario string, expected_outcome string, expected_root_cause_category string, "
        "acceptable_related_categories array<string>, recommendation_type string, "
        "pr_ready boolean"
    )
    rows = [
        (name, outcome, category, None if related is None else list(related), kind, ready)
        for name, outcome, category, related, kind, ready, *_ in EXPECTED_FINDINGS
    ]
    return literal_rows(spark, rows, ddl)


def acceptable(expected: Column, related: Column) -> Column:
    """The expected category and its related ones."""
    return F.array_union(F.array(expected), F.coalesce(related, F.array().cast("array<string>")))


def any_ready(recommendations: Column) -> Column:
    return F.exists(recommendations, lambda r: F.coalesce(r["pr_ready"], F.lit(False)))


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def _quoted_list(items: Column) -> Column:
    shown = F.transform(items, lambda i: F.coalesce(_quoted(i), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def _title(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))


def _check(pos: int, name, passed: Column, expected: Column, actual: Column, message: Column):
    return F.struct(
        F.lit(pos).alias("pos"),
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        passed.alias("passed"),
        expected.alias("expected"),
        actual.alias("actual"),
        F.when(passed, "").otherwise(message).alias("message"),
    )


def _expectations(expected: DataFrame) -> DataFrame:
    """One row per scenario, with whatever depends on the expectation alone worked out."""
    want, related = F.col("expected_root_cause_category"), F.col("acceptable_related_categories")
    names = F.sort_array(F.array_distinct(related))
    alternatives = F.when(
        F.size(names) > 0, F.concat(F.lit(" (or "), _quoted_list(names), F.lit(")"))
    ).otherwise("")
    return expected.select(
        F.coalesce("scenario", F.lit("unknown")).alias("scenario"),
        "expected_root_cause_category",
        acceptable(want, related).alias("acceptable"),
        F.concat(F.lit("Expected "), _quoted(want), alternatives).alias("wanted_text"),
        "recommendation_type",
        "pr_ready",
    )


def _verdicts() -> dict[str, Column]:
    """The three answers, each of which is shown, judged and explained below."""
    want, got = F.col("expected_root_cause_category"), F.col("actual_category")
    return {
        "category_ok": F.when(want.isNull(), got == UNKNOWN).otherwise(
            F.array_contains("acceptable", got)
        ),
        "type_ok": F.exists(
            "recommendations",
            lambda r: F.coalesce(r["type"] == F.col("recommendation_type"), F.lit(False)),
        ),
        "got_ready": any_ready(F.col("recommendations")),
    }


def _category_check() -> Column:
    want, got = F.col("expected_root_cause_category"), F.col("actual_category")
    silent = F.concat(
        F.lit("Expected no root cause (UNKNOWN) but the diagnosis returned "), _quoted(got)
    )
    wrong = F.concat(F.col("wanted_text"), F.lit(", got "), _quoted(got))
    return _check(
        1,
        F.when(want.isNull(), "no_false_positive").otherwise("root_cause_category"),
        F.col("category_ok"),
        F.coalesce(want, F.lit(UNKNOWN)),
        got,
        F.when(want.isNull(), silent).otherwise(wrong),
    )


def _type_check() -> Column:
    want = F.col("recommendation_type")
    message = F.concat(
        F.lit("Expected recommendation type "), _quoted(want), F.lit(", got "), F.col("got_types")
    )
    check = _check(
        2, "recommendation_type", F.col("type_ok"), want, F.col("got_types"), message
    )
    return F.when(want.isNotNull(), check)


def _ready_check() -> Column:
    want, got = F.col("pr_ready"), F.col("got_ready")
    message = F.concat(F.lit("Expected pr_ready="), _title(want), F.lit(", got "), _title(got))
    check = _check(3, "pr_ready", got == want, want.cast("string"), got.cast("string"), message)
    # False is an expectation like any other; only NULL means "not checked".
    return F.when(want.isNotNull(), check)


def evaluate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per run (and per expectation without a run) with its array of checks.

    ``ran`` tells the two apart: what nobody ran can neither pass nor fail.

    ``expected`` holds one row per scenario.  The runs are inner-joined to it, which lets
    Spark broadcast the catalogue when it is small and split a hot scenario when it is not;
    scenarios nobody ran are added from the distinct scenario names.
    """
    wanted = _expectations(expected)
    runs = actual.select(
        "scenario",
        "run_id",
        F.coalesce("investigation_id", F.lit("")).alias("investigation_id"),
        F.coalesce("root_cause.category", F.lit(UNKNOWN)).alias("actual_category"),
        "root_cause",
        F.coalesce(
            F.filter("recommendations", lambda r: r.isNotNull()), F.expr("array()")
        ).alias("recommendations"),
        F.lit(True).alias("ran"),
    )
    types = dict((f.name, f.dataType) for f in runs.schema)
    not_run = wanted.join(runs.select("scenario").distinct(), "scenario", "left_anti").select(
        "*",
        F.lit(None).cast(types["run_id"]).alias("run_id"),
        F.lit("").alias("investigation_id"),
        F.lit(UNKNOWN).alias("actual_category"),
        F.lit(None).cast(types["root_cause"]).alias("root_cause"),
        F.expr("array()").cast(types["recommendations"]).alias("recommendations"),
        F.lit(False).alias("ran"),
    )
    judged = (
        runs.join(wanted, "scenario")
        .unionByName(not_run)
        .withColumns(_verdicts())
        .withColumn(
            "got_types",
            F.when(
                F.col("recommendation_type").isNotNull(),
                _quoted_list(F.transform("recommendations", lambda r: r["type"])),
            ),
        )
    )
    checks = F.array_compact(F.array(_category_check(), _type_check(), _ready_check()))
    return judged.withColumn("checks", checks).drop(
        "acceptable", "wanted_text", "category_ok", "type_ok", "got_ready", "got_types"
    )


def unexpected_runs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Runs of scenarios that have no expectation; ``evaluate`` cannot judge these."""
    return actual.join(expected.select("scenario").distinct(), "scenario", "left_anti")


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per (run, check)."""
    # Every run has a check; the outer form keeps Spark from testing that on each row.
    return evaluate(expected, actual).select(
        "scenario", "run_id", "investigation_id", F.inline_outer("checks")
    )


def summarise(evaluated: DataFrame) -> DataFrame:
    """Outcome and one-line summary per run; an expectation without a run is skipped.

    The checks sit in the row, so nothing moves.
    """
    failed = F.filter("checks", lambda c: ~c["passed"])
    total = F.size("checks").cast("string")
    return evaluated.withColumn(
        "outcome",
        F.when(~F.col("ran"), "skip")
        .when(F.forall("checks", lambda c: c["passed"]), "pass")
        .otherwise("fail"),
    ).withColumn(
        "summary",
        F.when(
            F.col("outcome") == "pass",
            F.concat(F.lit("PASS: all "), total, F.lit(" check(s) passed")),
        )
        .when(F.col("outcome") == "skip", "SKIP: not run")
        .otherwise(
            F.concat(
                F.lit("FAIL: "),
                F.size(failed).cast("string"),
                F.lit(" of "),
                total,
                F.lit(" check(s) failed: "),
                F.array_join(F.transform(failed, lambda c: c["name"]), ", "),
            )
        ),
    )


def suite_summary(results: DataFrame) -> DataFrame:
    """Runs per outcome and scenario, with the outcome's total and the suite's exit code.

    An outcome nothing has gets one row with a NULL scenario and 0 runs.  Runs are counted where
    they are read; names stay in rows of their own, however many scenarios there are.  Only a
    failure sets ``overall``.
    """
    per_scenario = results.groupBy("outcome", "scenario").agg(F.count(F.lit(1)).alias("run_count"))
    totals = per_scenario.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("run_count"))), F.lit(0)).alias(o)
            for o in SUITE_OUTCOMES
        ]
    )
    by_outcome = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(o).alias("outcome"),
                        F.col(o).alias("outcome_runs"),
                        F.when(F.col("fail") > 0, 1).otherwise(0).alias("overall"),
                    )
                    for o in SUITE_OUTCOMES
                ]
            )
        )
    )  # three rows
    empty = by_outcome.where("outcome_runs = 0").select(
        "outcome", F.lit(None).cast("string").alias("scenario"), F.lit(0).cast("bigint").alias("run_count")
    )
    return per_scenario.unionByName(empty).join(F.broadcast(by_outcome), "outcome")


def confusion(evaluated: DataFrame) -> DataFrame:
    """Runs per (expected, actual) category; a missing expectation counts as UNKNOWN."""
    want = F.coalesce("expected_root_cause_category", F.lit(UNKNOWN))
    return evaluated.groupBy(want.alias("expected"), F.col("actual_category").alias("actual")).agg(
        F.count(F.lit(1)).alias("run_count")
    )


def confusion_matrix(evaluated: DataFrame, categories: list[str]) -> DataFrame:
    """``confusion`` with one column per category."""
    return (
        confusion(evaluated)
        .groupBy("expected")
        .pivot("actual", categories)
        .agg(F.sum("run_count"))
        .fillna(0)
    )


def scorecard(scores: DataFrame) -> DataFrame:
    """Mean score per criterion with one column per (lane, runtime)."""
    cells = [
        F.avg(
            F.when((F.col("lane") == lane) & (F.col("runtime") == runtime), F.col("score"))
        ).alias(f"{lane}_{runtime}")
        for runtime in SCORE_RUNTIMES
        for lane in SCORE_LANES
    ]
    return scores.groupBy("criterion").agg(*cells)


def lint_catalog(expected: DataFrame, configs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per scenario of either table, with the names of the rules it breaks."""
    known = jobs.select("job").distinct().withColumn("job_known", F.lit(True))
    wanted = expected.select(
        "scenario",
        "expected_outcome",
        F.col("expected_root_cause_category").alias("category"),
        F.coalesce(F.size("expected_evidence"), F.lit(0)).alias("n_evidence"),
        F.coalesce(F.size("expected_recommendations"), F.lit(0)).alias("n_recommendations"),
        F.lit(True).alias("has_finding"),
    )
    configured = (
        configs.select(
            "scenario", "job", F.col("expected_root_cause_category").alias("config_category")
        )
        .join(known, "job", "left")
        .withColumn("has_config", F.lit(True))
    )
    faulty = F.col("has_finding") & (F.col("scenario") != "happy_path")
    config_agrees = F.coalesce("config_category", F.lit(UNKNOWN)) == F.coalesce(
        "category", F.lit(UNKNOWN)
    )
    rules = {
        "no_finding": F.col("has_finding").isNull(),
        "no_category": faulty & F.col("category").isNull(),
        "category_on_happy_path": F.col("has_finding")
        & (F.col("scenario") == "happy_path")
        & F.col("category").isNotNull(),
        "bad_outcome": F.col("has_finding")
        & ~F.coalesce(F.col("expected_outcome").isin(*OUTCOMES), F.lit(False)),
        "few_evidence": F.col("has_finding") & (F.col("n_evidence") < 2),
        "no_recommendation": faulty & (F.col("n_recommendations") < 1),
        "category_mismatch": F.col("has_finding") & F.col("has_config") & ~config_agrees,
        "unknown_job": F.col("has_config") & F.col("job_known").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return wanted.join(configured, "scenario", "full").select(
        "scenario", broken.alias("violations")
    )


def unsupported(runs: DataFrame) -> DataFrame:
    """Runs whose (runtime, scenario) pair is not offered, with the reason."""
    runtime = canonical_runtime(F.col("runtime"))
    scenarios = is_supported(runtime, F.col("scenario"))
    return runs.where(~F.coalesce(scenarios, F.lit(False))).withColumn(
        "reason",
        F.when(scenarios.isNull(), "unknown runtime").otherwise("scenario not offered"),
    )


def report_rows(summarised: DataFrame, validated_at: Column) -> DataFrame:
    """The columns of a validation report."""
    return summarised.select(
        "scenario",
        "run_id",
        "investigation_id",
        "outcome",
        "summary",
        validated_at.alias("validation_timestamp"),
        F.transform("checks", lambda c: c.dropFields("pos")).alias("checks"),
        "root_cause",
        "recommendations",
    )

"""Run records: context, diagnosis requests, latest runs and terminal states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.runtimes import canonical_runtime, is_terminal, known_signals, run_state
from jobscope.functions.text import first_present, present
from jobscope.functions.times import default_start, iso_utc, normalise_time
from jobscope.vocab import RUN_WAIT_SECONDS, SIGNAL_FIELDS, TERMINAL_STATES


def with_run_state(runs: DataFrame) -> DataFrame:
    """``job_state`` from the runtime's raw state."""
    runtime = canonical_runtime(F.col("runtime"))
    return runs.withColumn("job_state", run_state(runtime, F.col("raw_state"), F.col("job_state")))


def resolve_window(runs: DataFrame, as_of: Column) -> DataFrame:
    """``time_window`` from the live times, else the context's window, else the last 30 minutes.

    Which live times count depends on the runtime: EKS has no start time of its own, and only
    serverless falls back to its last update for the end.
    """
    runtime = canonical_runtime(F.col("runtime"))
    started = F.when(runtime != "emr_eks", normalise_time(F.col("started_at")))
    updated = F.when(runtime == "emr_serverless", normalise_time(F.col("updated_at")))
    start = F.coalesce(
        started,
        normalise_time(F.col("created_at")),
        present(F.col("time_window.start")),
        iso_utc(default_start(as_of)),
    )
    end = F.coalesce(
        normalise_time(F.col("ended_at")),
        updated,
        present(F.col("time_window.end")),
        iso_utc(as_of),
    )
    return runs.withColumn("time_window", F.struct(start.alias("start"), end.alias("end")))


def build_context(runs: DataFrame, as_of: Column) -> DataFrame:
    """Run records with state, window and defaults filled in."""
    resolved = resolve_window(with_run_state(runs), as_of)
    return (
        resolved.withColumn("runtime", canonical_runtime(F.col("runtime")))
        .withColumn("scenario", F.coalesce("scenario", F.lit("happy_path")))
        .withColumn("expected_outcome", F.coalesce("expected_outcome", F.lit("success")))
        .withColumn("deploy_mode", first_present(F.col("deploy_mode"), F.lit("unknown")))
    )


def build_request(context: DataFrame, account_id: str) -> DataFrame:
    """A diagnosis request per run: ids by runtime, empty ones left out as NULL."""
    runtime = canonical_runtime(F.col("runtime"))
    on_ec2, serverless, on_eks = (
        runtime == r for r in ("emr_ec2", "emr_serverless", "emr_eks")
    )
    typed = serverless | on_eks
    target = F.struct(
        F.when(serverless, present(F.col("serverless_application_id"))).alias(
            "serverless_application_id"
        ),
        F.when(on_eks, present(F.col("virtual_cluster_id"))).alias("virtual_cluster_id"),
        present(F.col("job_run_id")).alias("job_run_id"),
        F.when(serverless, present(F.col("attempt").cast("string")).cast("int")).alias("attempt"),
        F.when(on_eks, present(F.col("eks_cluster_name"))).alias("eks_cluster_name"),
        F.when(on_eks, present(F.col("namespace"))).alias("namespace"),
    )
    request = {
        "account_id": F.lit(account_id),
        "application_id": F.when(~typed, present(F.col("application_id"))),
        "cluster_id": F.when(~typed, F.coalesce("cluster_id", F.lit(""))),
        "deploy_mode": F.when(~typed, F.coalesce("deploy_mode", F.lit("unknown"))),
        "diagnostic_signals": known_signals(F.col("diagnostic_signals")),
        "job_state": F.coalesce("job_state", F.lit("unknown")),
        "region": F.coalesce("region", F.lit("")),
        "runtime": F.when(typed, runtime),
        "step_id": F.when(~typed, present(F.col("step_id"))),
        "target": F.when(typed, target),
        "time_window": F.col("time_window"),
    }
    return context.select(
        "run_id", F.struct(*[request[k].alias(k) for k in sorted(request)]).alias("request")
    )


def sorted_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON text with keys in order; NULL fields are left out."""
    return F.to_json(F.struct(*[df[c] for c in sorted(columns)]))


def signal_rows(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, field, value) for every accepted signal of a run."""
    return runs.select(key, F.explode(known_signals(F.col("diagnostic_signals")))).toDF(
        key, "field", "value"
    )


def accepted_signals(rows: DataFrame) -> DataFrame:
    """The accepted rows of a signal table that is already in long form."""
    return rows.where(F.col("field").isin(*SIGNAL_FIELDS))


def _text_rank(text: Column, start: Column) -> Column:
    """The fifteen bytes from ``start`` on as one number that sorts like them."""

    def number(at: Column, width: int) -> Column:
        part = F.substr(text.cast("binary"), at.cast("int"), F.lit(width))
        return F.conv(F.rpad(F.hex(part), 2 * width, "0"), 16, 10).cast("decimal(20,0)")

    shift = F.lit(str(2**64)).cast("decimal(20,0)")
    return (number(start, 7).cast("decimal(17,0)") * shift + number(start + 7, 8)).cast("decimal(38,0)")


def latest_run(runs: DataFrame, exported: Column | None = None) -> DataFrame:
    """The newest record per scenario by run id, exported copies left out.

    Ids that start with the scenario's name are told apart by what follows it.  The largest
    beginning per scenario is a number, so Spark finds it with a hash aggregate where the runs
    are read; only the records that share it are ranked by their whole id.
    """
    originals = runs if exported is None else runs.where(~exported)
    scenario, run_id = F.col("scenario"), F.col("run_id").cast("string")
    prefixed = F.coalesce(F.startswith(run_id, scenario), F.lit(False))
    start = F.when(prefixed, F.octet_length(scenario) + 1).otherwise(1)
    rank = F.coalesce(_text_rank(run_id, start), F.lit(-1).cast("decimal(38,0)"))
    marked = originals.withColumns({"_prefixed": prefixed, "_rank": rank})
    top = marked.groupBy(F.col("scenario").alias("_scenario"), F.col("_prefixed").alias("_kind")).agg(
        F.max("_rank").alias("_top")
    )
    same = (
        scenario.eqNullSafe(F.col("_scenario"))
        & (F.col("_prefixed") == F.col("_kind"))
        & (F.col("_rank") == F.col("_top"))
    )
    newest = Window.partitionBy("scenario").orderBy(F.desc_nulls_last("run_id"))
    candidates = marked.join(top, same, "left_semi").withColumn("_place", F.row_number().over(newest))
    return candidates.where("_place = 1").select("scenario", *[c for c in runs.columns if c != "scenario"])


def terminal_firsts(at: Column) -> list[Column]:
    """The earliest ``at`` of each terminal state, one aggregate per state.

    These minima have a fixed width, so Spark hash-aggregates them; the minimum of a (time,
    state) pair would sort the whole history first.
    """
    terminal = is_terminal(canonical_runtime(F.col("runtime")), F.col("state"))
    return [
        F.min(F.when(terminal & (F.col("state") == s), at)).alias(s) for s in _terminal_names()
    ]


def earliest_terminal() -> Column:
    """The earliest of ``terminal_firsts`` as ``struct(at, state)``."""
    pairs = [
        F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("at"), F.lit(s).alias("state")))
        for s in _terminal_names()
    ]
    return F.array_min(F.array_compact(F.array(*pairs)))


def _terminal_names() -> list[str]:
    return sorted({s for states in TERMINAL_STATES.values() for s in states})


def terminal_state(history: DataFrame, timeout_s: int = RUN_WAIT_SECONDS) -> DataFrame:
    """First terminal state per run before its deadline, else TIMEOUT.

    A run without submission time has no deadline: whatever state it ends in is in time, and
    until then it is UNKNOWN.
    """
    firsts = history.groupBy("run_id").agg(
        F.min("submitted_at").alias("submitted_at"), *terminal_firsts(F.col("ts"))
    )
    wait = F.make_dt_interval(secs=F.lit(timeout_s).cast("decimal(18,6)"))
    in_time = F.col("first").isNotNull() & F.coalesce(F.col("first.at") < F.col("deadline"), F.lit(True))
    return firsts.select(
        "run_id",
        "submitted_at",
        (F.col("submitted_at") + wait).alias("deadline"),
        earliest_terminal().alias("first"),
    ).select(
        "run_id",
        "submitted_at",
        "deadline",
        F.when(in_time, F.col("first.at")).alias("finished_at"),
        F.when(in_time, F.col("first.state"))
        .when(F.col("deadline").isNull(), "UNKNOWN")
        .otherwise("TIMEOUT")
        .alias("final_state"),
    )

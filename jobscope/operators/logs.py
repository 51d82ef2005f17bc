"""Log lines and log listings: failure signals, application ids, log readiness."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.functions.runtimes import canonical_runtime
from jobscope.functions.text import (
    application_id,
    application_log_prefix,
    job_log_prefix,
    listing_file,
    normalise_uri,
    present,
    starts_with_any,
    step_log_prefix,
)
from jobscope.vocab import (
    APPLICATION_LOG_NAMES,
    LOG_FILE_ORDER,
    SERVERLESS_LOG_NAMES,
    SIGNAL_RULES,
    STEP_LOG_NAMES,
)


def _alternation(phrases: Sequence[str]) -> str:
    """One pattern for all phrases, with shared beginnings written once; longer phrases first."""
    branches: dict[str, list[str]] = {}
    for p in phrases:
        branches.setdefault(p[:1], []).append(p[1:])
    ends = "" in branches
    parts = []
    for first, tails in branches.items():
        if first:
            literal = re.sub(r"(\W)", r"\\\1", first)
            parts.append(literal + (_alternation(tails) if tails != [""] else ""))
    if not parts:
        return ""
    return parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)}){'?' if ends else ''}"


def found_rules(line: Column, rules: Sequence[tuple[str, str]] = SIGNAL_RULES) -> Column:
    """The (category, phrase) rules whose phrase a line holds, whatever its case.

    One pattern is tried at every place of the lowered line and names the longest phrase that
    begins there; a phrase inside another one, or at its beginning, follows from that one.
    """
    low = {p: p.lower() for _, p in rules}
    phrases = sorted(set(low.values()))
    held = {
        q: [F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase")) for c, p in rules if low[p] in q]
        for q in phrases
    }
    by_phrase = F.create_map(*[x for q, inside in held.items() for x in (F.lit(q), F.array(*inside))])
    # a place can begin a phrase only with one of these; the look-ahead keeps overlapping finds
    firsts = "".join(re.sub(r"(\W)", r"\\\1", c) for c in sorted({q[0] for q in phrases}))
    pattern = f"(?=[{firsts}])(?=({_alternation(phrases)}))"
    finds = F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(finds, lambda q: by_phrase[q])))


def scan_signals(
    lines: DataFrame, rules: Sequence[tuple[str, str]] = SIGNAL_RULES, text: str = "line"
) -> DataFrame:
    """Lines that hold a known phrase, whatever its case, one row per phrase found.

    The rules are one compiled pattern, so lines are neither joined nor shuffled, and a line is
    lowered and read once.  Empty phrases are refused: every line would hold them.
    """
    if not all(p for _, p in rules):
        raise ValueError("a phrase may not be empty")
    return lines.select("*", F.inline(found_rules(F.col(text), rules)))


def file_rank(file_name: Column) -> Column:
    """Position in the order log files are searched in; NULL for other files."""
    rank = F.array_position(F.array(*[F.lit(n) for n in LOG_FILE_ORDER]), file_name)
    return F.nullif(rank, F.lit(0))


def _line_place(lines: DataFrame) -> Column:
    """``line_no`` as one number in the same order."""
    if not isinstance(lines.schema["line_no"].dataType, StructType):
        return F.col("line_no").cast("decimal(38,0)")
    shift = F.lit(str(2**63)).cast("decimal(19,0)")
    split = F.col("line_no.split_start").cast("decimal(19,0)") * shift
    return (split + F.col("line_no.row_in_split")).cast("decimal(38,0)")


def application_ids(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run the first application id: by file order, then file path, then line order.

    The first line of each file is a minimum of numbers, found by a hash aggregate where the
    lines are read; only files are ranked, and only their first lines looked up again.
    """
    path = "file_path" if "file_path" in lines.columns else "file_name"
    found = lines.select(
        F.col(key),
        F.col(path).alias("_path"),
        file_rank(F.col("file_name")).alias("_rank"),
        _line_place(lines).alias("_line"),
        application_id(F.col("line")).alias("application_id"),
    ).where("application_id IS NOT NULL AND _rank IS NOT NULL")
    files = found.groupBy(F.col(key).alias("_key"), F.col("_path").alias("_file"), "_rank").agg(
        F.min("_line").alias("_first")
    )
    order = Window.partitionBy("_key").orderBy("_rank", "_file")
    first = files.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    same = (
        F.col(key).eqNullSafe(F.col("_key"))
        & (F.col("_path") == F.col("_file"))
        & (F.col("_line") == F.col("_first"))
    )
    return found.join(first.select("_key", "_file", "_first"), same, "left_semi").select(
        key, "application_id"
    )


def log_entries(listing: DataFrame, streams: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Listed files and log streams by place, with what kind of log each of them is.

    Columns named in ``also`` are kept; both sides have them.
    """
    prefix = F.regexp_extract("stream", "^(.*applications/[^/]+/jobs/[^/]+)", 1)
    nowhere = F.lit("")  # never NULL: Spark would test a nullable join key on every entry
    entries = listing.select(
        F.coalesce(normalise_uri(F.col("prefix")), nowhere).alias("place"),
        listing_file(F.col("line")).alias("file"),
        F.lit(False).alias("is_stream"),
        *also,
    ).unionByName(
        streams.select(
            F.coalesce(stream_place(F.col("log_group"), prefix), nowhere).alias("place"),
            F.lit(None).cast("string").alias("file"),
            F.lit(True).alias("is_stream"),
            *also,
        )
    )
    return entries.select(
        "place",
        starts_with_any(F.col("file"), STEP_LOG_NAMES).alias("is_step"),
        starts_with_any(F.col("file"), APPLICATION_LOG_NAMES).alias("is_application"),
        starts_with_any(F.col("file"), SERVERLESS_LOG_NAMES).alias("is_job"),
        "is_stream",
        *also,
    )


def place_flags(listing: DataFrame, streams: DataFrame) -> DataFrame:
    """Per place, which kinds of log are there: one row per listed prefix or job stream prefix."""
    return log_entries(listing, streams).groupBy("place").agg(
        F.bool_or("is_step").alias("has_step"),
        F.bool_or("is_application").alias("has_application"),
        F.bool_or("is_job").alias("has_job"),
        F.bool_or("is_stream").alias("has_stream"),
    )


def stream_place(group: Column, prefix: Column) -> Column:
    return F.concat(group, F.lit("|"), prefix)


def _is_running() -> Column:
    return F.coalesce(F.col("expected_outcome") == "running", F.lit(False))


def _given(*names: str) -> Column:
    every = F.lit(True)
    for name in names:
        every = every & present(F.col(name)).isNotNull()
    return every


def _check_kind() -> Column:
    """Which check a run gets: ec2, serverless or, as NULL, none."""
    runtime = canonical_runtime(F.col("runtime"))
    ec2 = (runtime == "emr_ec2") & _given("cluster_id", "step_id", "region", "log_uri")
    serverless = (runtime == "emr_serverless") & _given(
        "serverless_application_id", "job_run_id", "region"
    )
    return F.when(_is_running(), None).when(ec2, "ec2").when(serverless, "serverless")


def with_places(runs: DataFrame) -> DataFrame:
    """Runs with ``_check`` and the two places a checked run's logs may be in.

    ``_main`` is where its own log lies (step log or job log), ``_other`` where else it may or must
    be (application log or log stream).
    """
    ec2, serverless = F.col("_check") == "ec2", F.col("_check") == "serverless"
    step = step_log_prefix(F.col("log_uri"), F.col("cluster_id"), F.col("step_id"))
    app = application_log_prefix(F.col("log_uri"), F.col("cluster_id"), F.col("application_id"))
    job = job_log_prefix(
        F.col("log_uri"), F.col("serverless_application_id"), F.col("job_run_id")
    )
    stream = F.concat_ws(
        "/",
        F.trim(F.col("cloudwatch_log_stream_prefix"), F.lit("/")),
        F.lit("applications"),
        F.col("serverless_application_id"),
        F.lit("jobs"),
        F.col("job_run_id"),
    )
    # A run without a place meets nothing, and such runs don't all meet in one task.
    nowhere = F.concat(F.lit("\0"), F.xxhash64("run_id").cast("string"))
    main = F.when(ec2, step).when(serverless & _given("log_uri"), job)
    other = F.when(ec2 & _given("application_id"), app).when(
        serverless & _given("cloudwatch_log_group", "cloudwatch_log_stream_prefix"),
        stream_place(F.col("cloudwatch_log_group"), stream),
    )
    checked = runs.withColumn("_check", _check_kind())
    return checked.withColumns(
        {"_main": F.coalesce(main, nowhere), "_other": F.coalesce(other, nowhere)}
    )


def log_readiness(runs: DataFrame, listing: DataFrame, streams: DataFrame) -> DataFrame:
    """``logs``: not_checked, ready or waiting for every run.

    Listings and streams are the big inputs; both are reduced to one row per place in a single
    pass before anything is joined, so a run with millions of listed files costs no more than
    any other.  Runs are read once, and each looks at its two places.
    """
    flags = place_flags(listing, streams)
    # Paths are long texts built from short columns, so file sizes say little about the size of
    # these sides: the first join is never a broadcast.  Spark plans the second.
    mine = flags.select(F.col("place").alias("_main"), "has_step", "has_job").hint("merge")
    elsewhere = flags.select(F.col("place").alias("_other"), "has_application", "has_stream")
    met = with_places(runs).join(mine, "_main", "left").join(elsewhere, "_other", "left")

    return met.select(*[F.col(c) for c in runs.columns], readiness().alias("logs"))


def needs_application() -> Column:
    """Whether a run is ready only with its application log."""
    needs = (F.col("deploy_mode") == "cluster") & (F.col("expected_outcome") == "failed")
    return F.coalesce(needs, F.lit(False))


def readiness(needs: Column | None = None) -> Column:
    """not_checked, ready or waiting, from the check and what was found."""

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    on_ec2 = yes("has_step") & (~(needs_application() if needs is None else needs) | yes("has_application"))
    ready = F.when(F.col("_check") == "ec2", on_ec2).otherwise(yes("has_job") | yes("has_stream"))
    return F.when(F.col("_check").isNull(), "not_checked").when(ready, "ready").otherwise("waiting")


def runs_without_logs(runs: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Runs nothing was logged for."""
    return runs.join(lines.select(key).distinct(), key, "left_anti")

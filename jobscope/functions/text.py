"""Text rules for locations, log listings, labels and job names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.vocab import APPLICATION_ID_PATTERN, CLIENT_MODE_SCENARIOS


def normalise_uri(uri: Column) -> Column:
    """``s3n://`` and ``s3a://`` become ``s3://``; anything else stays."""
    legacy = F.startswith(uri, F.lit("s3n://")) | F.startswith(uri, F.lit("s3a://"))
    return F.when(legacy, F.concat(F.lit("s3://"), F.substr(uri, F.lit(7)))).otherwise(uri)


def application_id(line: Column) -> Column:
    """First application id in a line, NULL when there is none."""
    found = F.regexp_extract(line, APPLICATION_ID_PATTERN, 0)
    return F.nullif(found, F.lit(""))


def listing_file(line: Column) -> Column:
    """File name of a listing line: last word, then last path segment; NULL for blank lines."""
    spaced = F.rtrim(F.translate(line, "\t\n\r\f\v", "     "))
    word = F.substring_index(spaced, " ", -1)
    return F.nullif(F.substring_index(word, "/", -1), F.lit(""))


def starts_with_any(file: Column, names: Sequence[str]) -> Column:
    """Whether a file name starts with one of ``names``; no name does not."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.startswith(file, F.lit(name))
    return F.coalesce(hit, F.lit(False))


def names_log_file(line: Column, names: Sequence[str]) -> Column:
    """Whether a listing line names a file that starts with one of ``names``."""
    return starts_with_any(listing_file(line), names)


def join_path(root: Column, *parts: Column | str) -> Column:
    """Parts below a root without its trailing slashes, ending in one slash."""
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.concat_ws("/", F.rtrim(root, F.lit("/")), *pieces), F.lit("/"))


def step_log_prefix(log_uri: Column, cluster: Column, step: Column) -> Column:
    return join_path(normalise_uri(log_uri), cluster, "steps", step)


def application_log_prefix(log_uri: Column, cluster: Column, app: Column) -> Column:
    return join_path(normalise_uri(log_uri), cluster, "containers", app)


def job_log_prefix(log_uri: Column, app: Column, run: Column) -> Column:
    return join_path(normalise_uri(log_uri), "applications", app, "jobs", run)


def present(col: Column) -> Column:
    """The text, or NULL when it is empty: both count as missing."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def missing_names(**cols: Column) -> Column:
    """Names of the columns that are NULL or empty, in the order given."""
    return F.array_compact(
        F.array(*[F.when(present(c).isNull(), F.lit(n)) for n, c in cols.items()])
    )


def excerpt(query: Column, n_chars: int) -> Column:
    return F.left(query, F.lit(n_chars))


def deploy_mode(explicit: Column, scenario: Column) -> Column:
    """Explicit mode, else the scenario's default."""
    default = F.when(scenario.isin(*CLIENT_MODE_SCENARIOS), "client").otherwise("cluster")
    return F.coalesce(present(explicit), default)


def valid_deploy_mode(mode: Column) -> Column:
    return mode.isin("client", "cluster")


def has_object_key(uri: Column) -> Column:
    """An ``s3://`` location with a key below its bucket."""
    return uri.rlike("^s3://[^/]*/.+")


def safe_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_-]+\z")


def job_name(scenario: Column, run_id: Column, prefix: str) -> Column:
    """Dashed job name with the scenario cut to 28 and the run id to 18 characters."""
    dashed = F.left(F.replace(scenario, F.lit("_"), F.lit("-")), F.lit(28))
    return F.concat_ws("-", F.lit(prefix), dashed, F.left(run_id, F.lit(18)))


def window_label(start: Column, end: Column) -> Column:
    return F.concat_ws(
        " to ",
        F.coalesce(present(start), F.lit("(unknown start)")),
        F.coalesce(present(end), F.lit("(unknown end)")),
    )


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and an id with leading zeros; wider ids keep all their digits."""
    digits = number.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    )

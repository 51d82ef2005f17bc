"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Settings every job of this library relies on.  All can be changed at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "jobscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Event times are UTC throughout; sessions built elsewhere may say otherwise."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


# Scratch folders by their parent; a context may set a parent of its own.
_LOCAL: dict[str, str] = {}
_ROOTS: dict[str, str] = {}
_SPACE: ContextVar[str | None] = ContextVar("scratch_space", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a single-machine session may fall
    back to a temporary folder, because there the driver's disk is also the executors' disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="jobscope-")
        atexit.register(delete_folder, spark, _LOCAL[application])
    return _LOCAL[application]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; nothing happens when the session is gone."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses.

    It lies in the caller's ``scratch_space`` if there is one, else in a folder of this process
    that is deleted when the process ends: results may be read from it until then.
    """
    root = _SPACE.get()
    if root is None:
        shared = shared_folder(spark)
        if shared not in _ROOTS:
            _ROOTS[shared] = f"{shared}/scratch-{uuid.uuid4().hex}"
            atexit.register(delete_folder, spark, _ROOTS[shared])
        root = _ROOTS[shared]
    return f"{root}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """A folder for all scratch of the calls inside; it is deleted on leaving.

    A result that reads from scratch has to be used up before.
    """
    path = f"{shared_folder(spark)}/space-{uuid.uuid4().hex}"
    token = _SPACE.set(path)
    try:
        yield path
    finally:
        _SPACE.reset(token)
        delete_folder(spark, path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small fixed table.

    It goes through Arrow because Spark then knows its size and broadcasts it in joins; a table
    made from Python tuples counts as unboundedly large.
    """
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)

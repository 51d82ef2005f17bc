"""Query-plan documents as rows, with the nodes worth a look."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LARGE_ROWS = 100_000

_NODE_DDL = (
    "plan_no bigint, node_no bigint, depth bigint, node_type string, relation string, "
    "plan_rows bigint, max_child_rows bigint, problem string"
)
_PIECE = 10_000  # nodes per output batch


def _rows_of(node: dict) -> tuple[int | None, bool]:
    """The planned rows of a node, and whether they are missing or a number."""
    value = node.get("Plan Rows")
    if value is None:
        return None, True
    if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 2**63:
        return int(value), True
    return None, False


def _text_of(node: dict, field: str) -> tuple[str | None, bool]:
    value = node.get(field)
    return (value, True) if value is None or isinstance(value, str) else (None, False)


def _nodes(plan_no: int, root: dict) -> Iterator[tuple]:
    """Nodes of one plan in reading order; a field of the wrong type is NULL and named as a problem."""
    todo, node_no = [(root, 0)], 0
    while todo:
        node, depth = todo.pop()
        below = node.get("Plans")
        children = [c for c in below if isinstance(c, dict)] if isinstance(below, list) else []
        sizes = [n for n, _ in map(_rows_of, children) if n is not None]
        kind, kind_fits = _text_of(node, "Node Type")
        relation, relation_fits = _text_of(node, "Relation Name")
        size, size_fits = _rows_of(node)
        problems = [
            name
            for name, fits in (
                ("Node Type is not text", kind_fits),
                ("Relation Name is not text", relation_fits),
                ("Plan Rows is not a number", size_fits),
                ("Plans holds something else", below is None or below == children),
            )
            if not fits
        ]
        yield (plan_no, node_no, depth, kind, relation, size, max(sizes, default=None), "; ".join(problems) or None)
        node_no += 1
        todo.extend((c, depth + 1) for c in reversed(children))


def _plans(document: str | None) -> Iterator[tuple]:
    """Nodes of every plan of a document; one row with a reason for what is not a plan."""

    def reason(text: str, plan_no: int | None = None) -> tuple:
        return (plan_no, None, None, None, None, None, None, text)

    if document is None:
        yield reason("no document")
        return
    try:
        parsed = json.loads(document)
    except ValueError:
        yield reason("not JSON")
        return
    except RecursionError:
        yield reason("nested too deep")
        return
    if not isinstance(parsed, list):
        parsed = [parsed]
    if not parsed:
        yield reason("no plan")
    for plan_no, wrapped in enumerate(parsed):
        root = wrapped.get("Plan") if isinstance(wrapped, dict) else None
        if isinstance(root, dict):
            yield from _nodes(plan_no, root)
        else:
            yield reason("no plan", plan_no)


def plan_nodes(plans: DataFrame, key: str = "plan_id", document: str = "document") -> DataFrame:
    """One row per plan node, whatever the depth of the tree, for every plan of a document.

    A document that is no plan, or an element of a list that is none, gives one row with a reason
    in ``problem``.  A tree of unknown depth has no fixed-size expression, so each document is
    walked in an Arrow batch where it is read; nothing is shuffled, and the nodes leave in pieces.
    """
    schema = StructType.fromDDL(f"{key} {plans.schema[key].dataType.simpleString()}, {_NODE_DDL}")
    arrow = to_arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for plan, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for node in _plans(text.as_py()):
                    rows.append((plan, *node))
                    if len(rows) == _PIECE:
                        yield packed(rows)
                        rows = []
            yield packed(rows)

    return plans.select(key, document).mapInArrow(walk, schema)


def flag_nodes(nodes: DataFrame, large_rows: int = LARGE_ROWS) -> DataFrame:
    """Sequential scans of large relations and nested loops over large inputs."""

    def large(col):
        return F.coalesce(F.col(col) >= large_rows, F.lit(False))

    return nodes.withColumns(
        {
            "large_seq_scan": F.coalesce(F.col("node_type") == "Seq Scan", F.lit(False))
            & large("plan_rows"),
            "large_nested_loop": F.coalesce(F.col("node_type") == "Nested Loop", F.lit(False))
            & large("max_child_rows"),
        }
    )

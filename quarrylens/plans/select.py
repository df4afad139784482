"""Read-only selections over the logical views with a reproducible order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quarrylens.sources.snapshots import INPUT_ORDER, NEEDS_NO_ANALYSIS, VIEWS

_MOST = 2**31 - 1


@dataclass
class Selection:
    """A result: the lazy frame, and how the plan reads."""

    frame: DataFrame
    matched: DataFrame
    plan: str
    columns: list[str] = field(default_factory=list)


_QUOTED = r"'(?:[^']|'')*'"
_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _check_types(filtered: DataFrame) -> None:
    """A condition compares text with text and integers with integers. Spark would make others fit: in the analysed
    condition, whatever form it was given in, any change of type but among integers is such a case."""
    todo = [filtered._jdf.queryExecution().analyzed().condition()]
    while todo:
        e = todo.pop()
        kids = [e.children().apply(i) for i in range(e.children().size())]
        if e.getClass().getSimpleName() == "Cast" and not {e.dataType().simpleString(), kids[0].dataType().simpleString()} <= _INTEGERS:
            raise ValueError(f"type mismatch: {kids[0].sql()} as {e.dataType().simpleString()}")
        todo += kids


def select(source: DataFrame, view: str, columns: list[str] | None = None, where: Column | str | None = None, order: list[tuple[str, bool]] | None = None, limit: int | None = None, status: str = "complete", has_references: bool = True) -> Selection:
    """Filter, stable sort, limit, project. ``order``: (field, descending); ties keep the view's input order, whose
    columns end every sort, so the answer does not depend on partitions. ``where`` is a Column or a SQL condition.

    Unknown views and fields, a negative limit, and views that the snapshot has not been analysed for are errors
    before anything runs; an empty source gives an empty result with its columns.
    """
    if view not in VIEWS:
        raise ValueError(f"unknown table: {view}")
    names = VIEWS[view].names
    columns = list(names) if columns is None else columns
    for name in [*columns, *[f for f, _ in order or []]]:
        if name not in names:
            raise ValueError(f"unknown field: {name}")
    if limit is not None and limit < 0:
        raise ValueError("limit must be non-negative")
    if view == "references" and not has_references:
        raise ValueError("reference index unavailable")
    if view not in NEEDS_NO_ANALYSIS and status == "not_requested":
        raise ValueError("table requires an analysed snapshot")
    out, steps = source, [f"Scan({view})"]
    if isinstance(where, str):
        bare = re.sub(_QUOTED, "", where)
        if re.search(r"\bselect\b", bare, re.I):
            raise ValueError("subqueries are not supported")
        if fraction := re.search(r"(?<!\w)(?:\d+\.\d*|\.\d+)", bare):  # analysis may have rounded it
            raise ValueError(f"type mismatch: {fraction[0]} is no integer")
    if where is not None:
        try:
            out = out.where(where)
        except AnalysisException as error:
            raise ValueError(f"the condition does not fit {view}: {error.getCondition()}") from error
        _check_types(out)
        steps.append("Filter")
    matched = out
    ties = INPUT_ORDER[view]
    if order or (limit is not None and limit <= _MOST):
        keys = [F.desc(f) if down else F.asc(f) for f, down in order or []]
        ties = [(t.lstrip("-"), t.startswith("-")) for t in ties]
        out = out.orderBy(*keys, *[F.desc(t) if down else F.asc(t) for t, down in ties if t in source.columns and t not in {f for f, _ in order or []}])
        if order:
            steps.append("StableSort(" + ", ".join(f"{f} {'DESC' if down else 'ASC'}" for f, down in order) + ")")
    if limit is not None:
        steps.append(f"Limit({limit})")
        if limit <= _MOST:
            out = out.limit(limit)
    steps.append(f"Project({', '.join(columns)})")
    return Selection(out.select(*columns), matched, " -> ".join(steps), columns)

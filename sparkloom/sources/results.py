"""Results as JSON and as a text table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame) -> str:
    """``{"columns": [...], "rows": [{...}]}`` of a result that fits the driver."""
    return json.dumps({"columns": df.columns, "rows": [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]] if df.columns else []}, ensure_ascii=False)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, written by all executors."""
    df.write.json(path)


def to_table(df: DataFrame) -> str:
    """A header and rows with ``|`` between columns: floats with four decimals, strings in quotes."""
    lines = [" | ".join(df.columns)]
    lines.append("-" * len(lines[0]))
    lines += [" | ".join(_cell(row[c]) for c in df.columns) for row in df.toLocalIterator()]
    return "\n".join(lines)


def _cell(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x:.4f}"
    if isinstance(x, str):
        return f'"{x}"'
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return "[" + ", ".join(map(_cell, x)) + "]"
    return json.dumps(x.asDict(recursive=True), default=str) if hasattr(x, "asDict") else str(x)

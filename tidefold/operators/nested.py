"""Nested documents of any shape to rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def leaves(value, path: str = "", separator: str = ".") -> Iterator[tuple[str, str]]:
    """Paths and texts of all values that aren't maps; nulls are left out, lists are texts of their own."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}{separator}{k}" if path else str(k), separator)
    elif value is not None:
        yield path, value if isinstance(value, str) else json.dumps(value)


def flatten_json(df: DataFrame, key: str, body: str, separator: str = ".") -> DataFrame:
    """PRJ4: a row (key, path, value) for each value of each JSON document, however deep: keys joined by the separator.

    What isn't JSON, or no map, has no rows. The shape is read from each document, so it is one Arrow map over rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[body]):
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    continue
                if isinstance(value, dict):
                    rows += [(k, p, v) for p, v in leaves(value, "", separator)]
            yield pd.DataFrame(rows, columns=[key, "path", "value"], dtype=object)

    return df.select(key, body).mapInPandas(run, f"`{key}` {kind}, path string, value string")

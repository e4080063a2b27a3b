"""Result and configuration files, JSON or YAML, one by one or a folder of them over all tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import open_input


class _Unique(yaml.SafeLoader):
    """YAML's plain values; a key that comes twice is an error."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len(keys) != len(set(map(repr, keys))):
            raise ValueError(f"a key comes twice, line {node.start_mark.line + 1}")
        return super().construct_mapping(node, deep)


def parse_yaml(text: str):
    """The value of a YAML document: maps, lists and plain values. What isn't YAML, and a key that comes twice, raises ValueError."""
    try:
        return yaml.load(text, _Unique)  # a safe loader: it makes plain values only
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def dump_yaml(value) -> str:
    """The text that `parse_yaml` reads back."""
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def read_settings(path: str, default=None):
    """SRC23: a small JSON or YAML file by its name, or the default where it is missing."""
    try:
        with open_input(path) as f:
            text = f.read().decode("utf-8-sig")
    except FileNotFoundError:
        return default
    return _parsed(path, text)


def _parsed(path: str, text: str):
    return json.loads(text) if path.endswith(".json") else parse_yaml(text)


def keep_known(given: dict, known: dict) -> dict:
    """SF31: a configuration without the keys, at any depth, that `known` (the defaults) doesn't have."""
    return {k: keep_known(v, known[k]) if isinstance(v, dict) and isinstance(known[k], dict) else v for k, v in given.items() if k in known}


def leaves(value, path: tuple = ()) -> Iterator[tuple[str, str]]:
    """The values of nested maps with their paths, as JSON; an empty map is a value."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, (*path, str(k)))
    else:
        yield ".".join(path), json.dumps(value, separators=(",", ":"))


def scan_settings(spark: SparkSession, folder: str, known: dict | None = None) -> DataFrame:
    """SRC23, SF31: a row for each value of each JSON or YAML file of a folder: (name, path, value as JSON).

    Each task reads and parses its own files. With `known` only the keys that it has are kept; a file that can't be read as
    what its name says has one row with a null path and value; a file that isn't a map has its one value under an empty path.
    """
    texts = spark.read.option("pathGlobFilter", "*.{json,yaml,yml}").text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, text in zip(pdf["name"], pdf["value"]):
                try:
                    value = _parsed(name, text.removeprefix("\ufeff"))
                    kept = keep_known(value, known) if known is not None and isinstance(value, dict) else value
                    rows += [(name, path, v) for path, v in leaves(kept)]
                except ValueError:
                    rows.append((name, None, None))
            yield pd.DataFrame(rows, columns=["name", "path", "value"], dtype=object)

    return texts.mapInPandas(run, "name string, path string, value string")

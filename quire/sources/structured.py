"""JSON, YAML and TOML values as paths and texts."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of fields that hold text, and limits.
TEXT_FIELDS = frozenset("title name subject description content body text message payload data properties metadata value result summary label comment note info spec status kind type key id url path author email address version tag category caption heading abstract readme changelog license".split())

FIELD = "array<struct<path: string, value: string, is_text: boolean>>"


def walk(value, prefix: str = "") -> Iterator[tuple[str, str, bool]]:
    """(path, text, whether a text field) of each scalar: object fields by dots, array
    items by [i], at the top by item_i; nulls and blank strings go."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{prefix}[{i}]" if prefix else f"item_{i}")
    elif isinstance(value, str):
        if value.strip():
            yield prefix, value, prefix.rpartition(".")[2].partition("[")[0].lower() in TEXT_FIELDS
    elif value is not None:
        yield prefix, json.dumps(value, default=str), False


def flat_yaml(text: str) -> dict:
    """The plain subset of YAML that needs no library: nested maps by indent, lists
    of scalars by dashes or brackets, quoted and bare scalars."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    holder: list[tuple[dict, str]] = []

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
            return s[1:-1]
        if s in ("", "~", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        try:
            return int(s)
        except ValueError:
            try:
                return float(s)
            except ValueError:
                return s

    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith(("#", "---", "...")):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while len(stack) > 1 and indent <= stack[-1][0] and not (body.startswith("- ") and isinstance(stack[-1][1], list) and indent == stack[-1][0]):
            stack.pop()
        if body.startswith("- "):
            if not isinstance(stack[-1][1], list):
                owner, name = holder[-1]
                owner[name] = []
                stack.append((indent, owner[name]))
            stack[-1][1].append(scalar(body[2:]))
        elif ":" in body:
            name, _, rest = body.partition(":")
            target = stack[-1][1]
            if not isinstance(target, dict):
                continue
            target[name.strip()] = scalar(rest)
            holder.append((target, name.strip()))
            if not rest.strip():
                target[name.strip()] = {}
                stack.append((indent, target[name.strip()]))
    return root


def parsed(text: str | None, kind: str) -> list[dict] | None:
    """Flattened fields, or None for what doesn't parse."""
    if text is None:
        return None
    try:
        value = {"json": json.loads, "toml": tomllib.loads, "yaml": flat_yaml}[kind](text)
    except (ValueError, RecursionError):
        return None
    return [dict(zip(("path", "value", "is_text"), x, strict=True)) for x in walk(value)]


def flattened(text: Column, kind: str = "json") -> Column:
    """array<struct<path, value, is_text>>. A path walk of any depth is beyond
    built-in functions, so this is a vectorised UDF."""

    @F.pandas_udf(FIELD)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parsed(t, kind))

    return run(text)


def flatten(rows: DataFrame, key: str, column: str, kind: str = "json") -> DataFrame:
    return rows.select(key, F.explode(flattened(F.col(column), kind)).alias("f")).select(key, "f.*")


def schema_text(column: Column) -> Column:
    """The schema of a JSON text, as Spark writes it."""
    return F.schema_of_variant(F.try_parse_json(column))

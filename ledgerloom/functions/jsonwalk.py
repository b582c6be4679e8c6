"""Walks over JSON texts, Arrow-batched: every node with its key, path and type."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nodes(v, path: tuple = ()):
    """(path, key, value) of every node under ``v``; a path is a tuple, so keys may hold any character."""
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        at = (*path, k)
        yield at, k if isinstance(v, dict) else None, x
        yield from nodes(x, at)


def parsed(text):
    try:
        return json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.StructType([T.StructField("longest_string", T.LongType()), T.StructField("longest_list", T.LongType()), T.StructField("longest_inner_list", T.LongType())]))
def json_sizes(s: pd.Series) -> pd.DataFrame:
    """Bytes of the longest string value, members of the longest list and of the longest list inside a list; null: unreadable."""

    def of(text):
        v = parsed(text)
        if v is None:
            return None, None, None
        strings, lists, inner = [0], [0], [0]
        for path, _, x in nodes(v):
            if isinstance(x, str):
                strings.append(len(x.encode("utf-8", "surrogatepass")))
            elif isinstance(x, list):
                lists.append(len(x))
                if any(isinstance(p, int) for p in path):
                    inner.append(len(x))
        return max(strings), max(lists), max(inner)

    return pd.DataFrame([of(x) for x in s], columns=["longest_string", "longest_list", "longest_inner_list"], dtype="Int64")


def key_count(keys: set[str]):
    """UDF: how many object keys anywhere in a JSON text are one of ``keys`` exactly; null where it can't be read."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        def of(text):
            v = parsed(text)
            return None if v is None else sum(k in keys for _, k, _ in nodes(v))

        return pd.Series([of(x) for x in s], dtype="Int64")

    return count

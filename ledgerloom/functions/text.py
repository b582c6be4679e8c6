"""Text functions that Spark lacks, Arrow-batched."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """Comparison form: NFKC, then case folding."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def _walk(v, depth, stats, paths, path):
    stats[0] += 1
    stats[1] = max(stats[1], depth)
    items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, x in items:
        at = f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else str(k)
        if isinstance(v, dict):
            paths.append(at)
        _walk(x, depth + 1, stats, paths, at)


def _tree(text):
    try:
        v = json.loads(text)
        stats, paths = [0, 0], []
        _walk(v, 1, stats, paths, "")
        return stats, paths
    except (ValueError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.StructType([T.StructField("nodes", T.IntegerType()), T.StructField("depth", T.IntegerType())]))
def json_tree_stats(s: pd.Series) -> pd.DataFrame:
    """Nodes and depth of a JSON text; null where it can't be read."""
    rows = [_tree(x) for x in s]
    return pd.DataFrame({"nodes": pd.array([r and r[0][0] for r in rows], "Int32"), "depth": pd.array([r and r[0][1] for r in rows], "Int32")})


def forbidden_key_paths(keys: set[str]):
    """UDF: dotted paths (with [i]) of keys in ``keys``, whatever their case, anywhere in a JSON text."""
    low = {k.lower() for k in keys}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paths(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [p for p in (_tree(x) or ((), ()))[1] if p.rpartition(".")[2].lower() in low])

    return paths


def contract_key_paths(words: set[str]):
    """UDF: paths of keys that equal or hold one of ``words`` once NFKC-folded, with '-' as '_'."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paths(s: pd.Series) -> pd.Series:
        form = lambda k: unicodedata.normalize("NFKC", k).casefold().replace("-", "_")
        return s.map(lambda x: [p for p in (_tree(x) or ((), ()))[1] if any(w in form(p.rpartition(".")[2]) for w in words)])

    return paths


def _scalars(v, inside: bool, tokens: set[str], out: list[str]) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            _scalars(x, inside or any(t in k.lower() for t in tokens), tokens, out)
    elif isinstance(v, list):
        for x in v:
            _scalars(x, inside, tokens, out)
    elif inside and isinstance(v, str):
        out.append(v)


def protected_scalars(tokens: set[str]):
    """UDF: distinct, sorted string values under keys that hold a token; none where the JSON can't be read."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def values(s: pd.Series) -> pd.Series:
        def of(text):
            out: list[str] = []
            try:
                _scalars(json.loads(text), False, tokens, out)
            except (ValueError, TypeError, RecursionError):
                pass
            return sorted(set(out))

        return pd.Series([of(x) for x in s], dtype=object)

    return values


def fitting_length(limit: int):
    """UDF: greatest number of leading characters whose JSON string takes at most ``limit`` bytes (monotone search)."""

    @F.pandas_udf(T.IntegerType())
    def fit(s: pd.Series) -> pd.Series:
        def of(text):
            if text is None:
                return None
            a, b = 0, len(text)
            while a < b:
                m = (a + b + 1) // 2
                a, b = (m, b) if len(json.dumps(text[:m], ensure_ascii=False).encode("utf-8", "surrogatepass")) <= limit else (a, m - 1)
            return a

        return pd.Series([of(x) for x in s], dtype="Int32")

    return fit

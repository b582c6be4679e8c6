"""Column-level data quality: exact base aggregates, malformed values, and changes between loads.

Changes are found by a classifier two-sample test: logistic regression, trained by distributed gradient passes,
tells each load from the one before; cross-fitted discrimination with columns left out and columns alone says
which columns changed. What it points at is confirmed by exact shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.session import Scratch

#: One-hot levels per column and hash; two hashes, so that values which fall together once seldom do twice.
LEVELS, HASHES = 32, 2
STEPS, BINS = 6, 512
#: What points at a column. A value whose share moves by ``least`` gives an AUC of at least 0.5 + least / 2 to a
#: column alone, however large the loads; SLACK is for six steps of training and for binned scores. The cross-fitted AUC
#: may lie below that by chance: by CHANCE standard errors. A column that the others can't stand in for loses
#: LEAST_LOSS of AUC when it is left out, where its cross-fitted AUC alone says nothing.
SLACK, CHANCE, LEAST_LOSS = 0.015, 3.0, 0.05


def unpivot(df: DataFrame, id_col: str, load_col: str, columns: list[str]) -> DataFrame:
    """(row_id, load_id, column_name, value) with values as text; nulls stay."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return df.select(F.col(id_col).alias("row_id"), F.col(load_col).alias("load_id"), pairs).select("row_id", "load_id", "x.*")


def malformed(value: Column, form: tuple[str, str]) -> Column:
    """A non-null value that isn't of its form; the form is (prefix put before the value, pattern of the whole)."""
    prefix, rx = form
    return value.isNotNull() & ~F.concat(F.lit(prefix), value).rlike(rf"\A(?:{rx})\z")


def base_profile(df: DataFrame, table: str, columns: list[str], forms: dict[str, tuple[str, str]], id_col: str, load_col: str, as_text: bool = False) -> DataFrame:
    """Per column: rows, nulls, null rate, distinct non-null values, least and greatest value as text, malformed values.

    Least and greatest are by the order of numbers and times for such columns, of the text for others or all (``as_text``).
    Exact. Values are counted once each with map-side combining, so a frequent value is no hot task. An empty
    table gives no rows.
    """
    cells = unpivot(df, id_col, load_col, columns)
    by_value = cells.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    bad = F.lit(False)
    for c, form in forms.items():
        bad = bad | ((F.col("column_name") == c) & malformed(F.col("value"), form))
    out = by_value.groupBy(F.lit(table).alias("table_name"), "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_malformed"),
    )
    out = out.withColumn("null_rate", F.round(F.col("n_null") / F.col("n_rows"), 6))
    ordered = [] if as_text else [c for c in columns if isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not ordered:
        return out
    ends = df.select(F.array(*(F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")) for c in ordered)).alias("x")).select(F.inline("x"))
    pick = lambda own, text: F.when(F.col("column_name").isin(ordered), F.col(own)).otherwise(F.col(text)).alias(text)
    picked = {"least": pick("low", "least"), "greatest": pick("high", "greatest")}
    return out.join(ends, "column_name", "left").select(*(picked.get(c, F.col(c)) for c in out.columns))


def load_profile(df: DataFrame, table: str, columns: list[str], load_col: str) -> DataFrame:
    """Per load and column: rows, null rate, distinct non-null values, share of the most frequent value (null included).

    Rows of no load form a load of their own (null). Exact, with values counted once each as in ``base_profile``.
    """
    by_value = unpivot(df, load_col, load_col, columns).groupBy("load_id", "column_name", "value").agg(F.count("*").alias("n"))
    g = by_value.groupBy(F.lit(table).alias("table_name"), "column_name", "load_id")
    out = g.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("n_distinct"), F.max("n").alias("most"))
    share = lambda c: F.round(F.col(c) / F.col("n_rows"), 6)
    return out.select("table_name", "column_name", "load_id", "n_rows", share("nulls").alias("null_rate"), "n_distinct", share("most").alias("top_share"))


def _tokens(columns: list[str], width: int) -> Column:
    """One-hot positions of a row: HASHES per column; columns beyond this table's own are -1."""
    out = []
    for i in range(width):
        for h in range(HASHES):
            at = (i * HASHES + h) * LEVELS
            value = F.xxhash64(F.lit(h), F.coalesce(F.col(columns[i]).cast("string"), F.lit("\0"))) if i < len(columns) else None
            out.append((F.lit(at) + F.pmod(value, F.lit(LEVELS))).cast("int") if value is not None else F.lit(-1))
    return F.array(*out)


def compressed(df: DataFrame, table: int, columns: list[str], width: int, id_col: str, load_col: str, order: DataFrame) -> DataFrame:
    """Counts of (table, rank of load, fold, tokens): the training rows, each distinct one once with its weight."""
    rows = df.select(F.lit(table).alias("tab"), F.col(load_col).alias("load"), F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int").alias("fold"), _tokens(columns, width).alias("tokens"))
    return _ranked(rows, order)


def compressed_alone(df: DataFrame, first: int, columns: list[str], id_col: str, load_col: str, order: DataFrame) -> DataFrame:
    """As ``compressed``, with each column as a table of its own, numbered from ``first``: one pass, and at most LEVELS ** HASHES rows a column, load and fold."""
    cells = F.explode(F.array(*(F.struct(F.lit(first + i).alias("tab"), _tokens([c], 1).alias("tokens")) for i, c in enumerate(columns)))).alias("x")
    rows = df.select(F.col(load_col).alias("load"), F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int").alias("fold"), cells).select("load", "fold", "x.*")
    return _ranked(rows, order)


def _ranked(rows: DataFrame, order: DataFrame) -> DataFrame:
    counts = rows.groupBy("tab", "load", "fold", "tokens").agg(F.count("*").alias("n")).join(order, "load")
    loads = counts.select("load", "seq").distinct().withColumn("rank", F.row_number().over(Window.orderBy("seq", "load")))  # loads, not rows
    return counts.join(loads.select("load", "rank"), "load").select("tab", "load", "rank", "fold", "tokens", "n")


def _models(tabs: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """(table, columns used): all, all but one, one alone."""
    out = []
    for tab, c in tabs.items():
        sets = {tuple(range(c))} | {tuple(x for x in range(c) if x != i) for i in range(c)} | {(i,) for i in range(c)}
        out += [(tab, s) for s in sorted(sets) if s]
    return out


def _pass(rows: DataFrame, models, weights: dict, sizes: dict, what: str) -> pd.DataFrame:
    """One distributed pass: gradients and curvatures on the model's fold, or score histograms on the other fold.

    Columns alone also have a model of both folds (fold 2), scored on what it was trained on.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for part in it:
            for (tab, rank, fold), g in part.groupby(["tab", "rank", "fold"]):
                tokens, n = np.stack(g["tokens"].to_numpy()), g["n"].to_numpy(float)
                for at, label in ((rank, 1.0), (rank + 1, 0.0)):
                    if (tab, at) not in sizes or (tab, at - 1) not in sizes:
                        continue
                    mass = n / sizes[(tab, rank)]
                    for m, (mt, cols) in enumerate(models):
                        if mt != tab:
                            continue
                        x = tokens[:, [c * HASHES + h for c in cols for h in range(HASHES)]]
                        for use in (fold if what == "train" else 1 - fold, *([2] if len(cols) == 1 else [])):
                            w = weights.get((m, at, use))
                            z = w[-1] + w[x].sum(axis=1) if w is not None else np.zeros(len(x))
                            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                            if what == "train":
                                d = tokens.shape[1] * LEVELS + 1
                                a = acc.setdefault((m, at, use), np.zeros((2, d)))
                                for j, v in enumerate(((p - label) * mass, p * (1 - p) * mass)):
                                    a[j, :-1] += np.bincount(x.ravel(), np.repeat(v, x.shape[1]), d - 1)
                                    a[j, -1] += v.sum()
                            else:
                                a = acc.setdefault((m, at, use), np.zeros((2, BINS)))
                                a[int(label)] += np.bincount(np.minimum((p * BINS).astype(int), BINS - 1), mass, BINS)
        rows = [(*k, i, float(v[0, i]), float(v[1, i])) for k, v in acc.items() for i in np.flatnonzero(v.any(axis=0))]
        yield pd.DataFrame(rows, columns=["m", "at", "fold", "i", "a", "b"]).astype({"m": "int32", "at": "int32", "fold": "int32", "i": "int32", "a": float, "b": float})

    parts = rows.mapInPandas(run, "m int, at int, fold int, i int, a double, b double")
    return parts.groupBy("m", "at", "fold", "i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # models times features


def load_changes(rows: DataFrame, tabs: dict[int, int], least: float = 0.2) -> pd.DataFrame:
    """(tab, rank, column, auc_alone, auc_own, auc_loss, pointed): for each load and column, how well the column tells
    the load from the one before: cross-fitted, on the rows trained on, and what the others lose without it.

    A column is pointed at when neither AUC rules out a share that moved by ``least``, at every size of loads.
    """
    sizes = {(r.tab, r["rank"]): float(r.n) for r in rows.groupBy("tab", "rank").agg(F.sum("n").alias("n")).collect()}  # loads
    models, weights = _models(tabs), {}
    dim = max(tabs.values(), default=0) * HASHES * LEVELS + 1
    for _ in range(STEPS):
        for (m, at, fold), g in _pass(rows, models, weights, sizes, "train").groupby(["m", "at", "fold"]):
            w = weights.setdefault((m, at, fold), np.zeros(dim))
            step = g["a"].to_numpy() / (g["b"].to_numpy() + 1e-4)
            w[g["i"].to_numpy()] -= np.clip(step, -4, 4) / (len(models[m][1]) * HASHES + 1)
    auc = {}
    scores = _pass(rows, models, weights, sizes, "score")
    for (m, at, own), g in scores.groupby(["m", "at", scores["fold"] == 2]):
        neg, pos = np.zeros(BINS), np.zeros(BINS)
        np.add.at(neg, g["i"].to_numpy(), g["a"].to_numpy())
        np.add.at(pos, g["i"].to_numpy(), g["b"].to_numpy())
        if neg.sum() and pos.sum():
            auc[(m, at, own)] = float((pos * (np.cumsum(neg) - neg / 2)).sum() / (neg.sum() * pos.sum()))
    index, out, moved = {m: i for i, m in enumerate(models)}, [], 0.5 + least / 2 - SLACK
    for (tab, at), n in sizes.items():
        if (tab, at - 1) not in sizes:
            continue
        c, before = tabs[tab], sizes[(tab, at - 1)]
        error = np.sqrt((n + before + 1) / (12 * n * before))
        full = auc.get((index[(tab, tuple(range(c)))], at, False), 1.0)
        for i in range(c):
            alone, own = (auc.get((index[(tab, (i,))], at, x), 1.0) for x in (False, True))
            rest = auc.get((index[(tab, tuple(x for x in range(c) if x != i))], at, False), 0.5) if c > 1 else 0.5
            out.append((tab, at, i, alone, own, full - rest, own >= moved and (alone >= moved - CHANCE * error or full - rest >= LEAST_LOSS)))
    return pd.DataFrame(out, columns=["tab", "rank", "column", "auc_alone", "auc_own", "auc_loss", "pointed"])


def exact_shifts(df: DataFrame, load_col: str, columns: list[str], suspects: list[tuple[str, str, str]], least: float = 0.2) -> DataFrame:
    """(column_name, load_id) of the suspected (column, load, load before) where a value's share moved by more than ``least``."""
    spark = df.sparkSession
    sus = spark.createDataFrame(suspects, "column_name string, load_id string, before string")
    cells = unpivot(df, load_col, load_col, columns).groupBy("column_name", "load_id", "value").agg(F.count("*").alias("n"))
    sizes = df.groupBy(F.col(load_col).alias("load_id")).agg(F.count("*").alias("rows"))
    cells = cells.join(sizes, "load_id").select("column_name", "load_id", "value", (F.col("n") / F.col("rows")).alias("share"))
    new = sus.join(cells, ["column_name", "load_id"]).select("column_name", "load_id", "value", "share")
    old = sus.join(cells.withColumnRenamed("load_id", "before"), ["column_name", "before"]).select("column_name", "load_id", "value", -F.col("share"))
    moved = new.union(old).groupBy("column_name", "load_id", "value").agg(F.sum("share").alias("by"))
    return moved.filter(F.abs("by") > least + 1e-12).select("column_name", "load_id").distinct()


def quality_issues(tables: dict[str, tuple[DataFrame, str, str, dict[str, tuple[str, str]]]], loads: DataFrame, load_key="load_id", seq_key="load_seq") -> DataFrame:
    """(table_name, column_name, issue, load_id, row_id): malformed values and shifts between loads.

    ``tables``: name -> (rows, id column, load column, form of each column). Rows of no known load have no place
    in the order of loads and take part in 'pattern' only. Ties of ``seq_key`` are ordered by load. Empty tables
    give no issues; one load has nothing before it.
    """
    spark = loads.sparkSession
    order = loads.select(F.col(load_key).alias("load"), F.col(seq_key).alias("seq")).groupBy("load").agg(F.min("seq").alias("seq"))
    width, names = max(len(t[3]) for t in tables.values()), list(tables)
    parts = [compressed(df, i, list(forms), width, id_col, load_col, order) for i, (df, id_col, load_col, forms) in enumerate(tables.values())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = Scratch(spark, "profile").save(rows, "rows")
    changed = load_changes(rows, {i: len(tables[n][3]) for i, n in enumerate(names)})
    load_of = {(r.tab, r["rank"]): r.load for r in rows.select("tab", "rank", "load").distinct().collect()}  # loads
    out = None
    for i, (name, (df, id_col, load_col, forms)) in enumerate(tables.items()):
        cols, bad = list(forms), F.lit(False)
        for c, form in forms.items():
            bad = bad | ((F.col("column_name") == c) & malformed(F.col("value"), form))
        found = unpivot(df, id_col, load_col, cols).filter(bad).select(F.lit(name).alias("table_name"), "column_name", F.lit("pattern").alias("issue"), "load_id", F.col("row_id").cast("bigint").alias("row_id"))
        sus = [(cols[int(r.column)], load_of[(i, r["rank"])], load_of[(i, r["rank"] - 1)]) for _, r in changed[(changed["tab"] == i) & changed["pointed"]].iterrows()]
        if sus:
            moved = exact_shifts(df, load_col, cols, sus)
            found = found.union(moved.select(F.lit(name), "column_name", F.lit("shift"), "load_id", F.lit(0).cast("bigint")))
        out = found if out is None else out.union(found)
    return out


def column_changes(tables: dict[str, tuple[DataFrame, str, str, list[str]]], loads: DataFrame, load_key="load_id", seq_key="load_seq", least: float = 0.2) -> DataFrame:
    """(table_name, column_name, load_id): each column and load where a value's share, null included, moved by more than ``least``.

    ``tables``: name -> (rows, id column, load column, columns). Each column is told from the load before alone,
    which is where a moved share shows. Hashed values may hide each other's moves there, so columns in which a
    cell holds more than ``least`` of either load are looked at too: no moved share is missed. The load column
    tells nothing but the load and goes to the exact shares only. Otherwise as ``quality_issues``.
    """
    spark = loads.sparkSession
    order = loads.select(F.col(load_key).alias("load"), F.col(seq_key).alias("seq")).groupBy("load").agg(F.min("seq").alias("seq"))
    parts, owner = [], []
    for name, (df, id_col, load_col, columns) in tables.items():
        told = [c for c in columns if c != load_col]
        if told:
            parts.append(compressed_alone(df, len(owner), told, id_col, load_col, order))
            owner += [(name, c) for c in told]
    empty = spark.createDataFrame([], "table_name string, column_name string, load_id string")
    if not parts:
        return empty
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = Scratch(spark, "changes").save(rows.repartition("tab").sortWithinPartitions("tab", "rank", "fold"), "rows")
    changed = load_changes(rows, dict.fromkeys(range(len(owner)), 1), least)
    load_of = {(r.tab, r["rank"]): r.load for r in rows.select("tab", "rank", "load").distinct().collect()}  # loads times columns
    sizes, cells = rows.groupBy("tab", "rank").agg(F.sum("n").alias("rows")), rows.groupBy("tab", "rank", "tokens").agg(F.sum("n").alias("n"))
    heavy = {(r.tab, r["rank"]) for r in cells.join(sizes, ["tab", "rank"]).filter(F.col("n") > least * F.col("rows")).select("tab", "rank").distinct().collect()}
    pointed = {(int(r.tab), int(r["rank"])) for _, r in changed[changed["pointed"]].iterrows()}
    pairs = {k for k in pointed | heavy | {(t, at + 1) for t, at in heavy} if k in load_of and (k[0], k[1] - 1) in load_of}
    out = empty
    for name, (df, _, load_col, columns) in tables.items():
        sus = {(owner[t][1], load_of[(t, at)], load_of[(t, at - 1)]) for t, at in pairs if owner[t][0] == name}
        if load_col in columns:
            sus |= {(load_col, l, load_of[(t, at - 1)]) for (t, at), l in load_of.items() if owner[t][0] == name and (t, at - 1) in load_of}
        if sus:
            moved = exact_shifts(df, load_col, sorted({c for c, _, _ in sus}), sorted(sus), least)
            out = out.union(moved.select(F.lit(name), "column_name", "load_id"))
    return out

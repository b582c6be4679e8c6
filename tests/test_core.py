import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import patches, predicates, text
from ledgerloom.operators import drift, leakage, orphans, profile, reconcile, sequence
from ledgerloom.sources import files

T = lambda day, h=0: datetime(2026, 1, day, h)
REFS, PARENTS = "ref_id bigint, ref_column string, key string, at timestamp", "ref_column string, key string, begins timestamp, ends timestamp"


def found(spark, refs, parents):
    out = orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return sorted((r.ref_id, r.ref_column, r.reason) for r in out.collect())


def test_orphans(spark):
    parents = [("p", "a", T(5), T(10)), ("p", "a", T(12), None), ("p", "b", T(5), None), ("p", "b", T(5), None), ("p", "gone", T(8), T(6)), ("p", "nobegin", None, None), (None, None, None, None), ("c", "a", T(1), None)]
    refs = [(1, "p", "a", T(4)), (2, "p", "a", T(5)), (3, "p", "a", T(10)), (4, "p", "a", T(12)), (5, "p", "zz", T(5)), (6, "p", None, T(5)), (7, "p", "b", None), (8, "p", "gone", T(9)), (9, "p", "nobegin", T(9)), (10, "c", "a", T(2)), (11, "c", "b", T(9)), (5, "p", "zz", T(5)), (12, "p", "x" * 5000, T(5)), (13, "p", "é", T(5))]
    assert found(spark, refs, parents) == [(1, "p", "late"), (3, "p", "deleted"), (5, "p", "missing"), (5, "p", "missing"), (7, "p", "late"), (8, "p", "deleted"), (9, "p", "late"), (11, "c", "missing"), (12, "p", "missing"), (13, "p", "missing")]


def test_orphans_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "p", "a", T(1))], []) == [(1, "p", "missing")]
    assert found(spark, [], [("p", "a", T(1), None)]) == []


def test_orphans_long_keys_differ_in_the_last_byte(spark):
    for n in (63, 64, 65):
        for column in ("local_catalog_key", "a_column_with_a_very_long_name_" * 3):
            assert found(spark, [(1, column, "k" * (n - 1) + "a", T(9)), (2, column, "k" * (n - 1) + "b", T(9))], [(column, "k" * (n - 1) + "a", T(1), None)]) == [(2, column, "missing")]


def test_orphans_keys_with_zero_bytes(spark):
    assert found(spark, [(1, "p", "a\0", T(9)), (2, "p", "a", T(9))], [("p", "a", T(1), None)]) == [(1, "p", "missing")]


def test_orphans_hot_key_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PER_CHUNK", 50)
    monkeypatch.setattr(orphans, "PER_RANGE", 20)
    parents = [("p", f"k{i:03}", T(2), None) for i in range(100)]
    refs = [(i, "p", "k050", T(1 if i % 3 == 0 else 3)) for i in range(400)] + [(1000 + i, "p", f"k{i:03}", T(3)) for i in range(120)]
    got = found(spark, refs, parents)
    monkeypatch.setattr(orphans, "CASES", 2)  # more ranges than CASE expressions should search
    assert found(spark, refs, parents) == got
    assert got == sorted([(i, "p", "late") for i in range(0, 400, 3)] + [(1100 + i, "p", "missing") for i in range(20)])


LOADS = [(f"L{i}", i) for i in range(1, 4)]


def issues(spark, rows, forms, columns="id bigint, load string, v string, value string, row_id string"):
    df = spark.createDataFrame(rows, columns)
    loads = spark.createDataFrame(LOADS, "load_id string, load_seq int")
    return {tuple(r) for r in profile.quality_issues({"t": (df, "id", "load", forms)}, loads).collect()}


def test_quality_issues(spark):
    rows = [(i, "L1", "yes" if i % 2 else "no", None, None) for i in range(200)]
    rows += [(200 + i, "L2", "yes", None, None) for i in range(200)]
    rows += [(400 + i, "L3", "yes" if i else "YES", None, "x") for i in range(200)]
    rows += [(900, None, "maybe", None, None), (901, "L9", "", None, None)]
    got = issues(spark, rows, {"v": ("", "yes|no")})
    assert got == {("t", "v", "pattern", "L3", 400), ("t", "v", "pattern", None, 900), ("t", "v", "pattern", "L9", 901), ("t", "v", "shift", "L2", 0)}


def test_quality_null_share_and_gap(spark):
    rows = [(i, "L1", "yes", None, None) for i in range(100)] + [(100 + i, "L3", None if i < 30 else "yes", None, None) for i in range(100)]
    assert issues(spark, rows, {"v": ("", "yes|no")}) == {("t", "v", "shift", "L3", 0)}


def test_quality_empty_and_tiny(spark):
    assert issues(spark, [], {"v": ("", "yes|no")}) == set()
    assert issues(spark, [(1, "L1", "yes", None, None), (2, "L2", "no", None, None)], {"v": ("", "yes|no")}) == {("t", "v", "shift", "L2", 0)}


def test_few_columns_are_pointed_at_in_small_loads(spark):
    """400 rows a load: the test points at the moved columns and at few others; at 50 rows too."""
    import random

    r, columns = random.Random(3), ["a", "b", "c", "d"]
    for rows in (400, 50):
        loads, df = [(f"L{i:02}", i) for i in range(12)], []
        for i in range(12):
            for j in range(rows):
                shifted = r.random() < (0.55 if i % 4 == 2 else 0.05)
                df.append((i * rows + j, f"L{i:02}", "x" if shifted else r.choice("pqrst"), r.choice(["yes", "no"]), f"v{r.randrange(9)}", None if r.random() < 0.3 else "only"))
        df = spark.createDataFrame(df, "id bigint, load string, a string, b string, c string, d string")
        order = spark.createDataFrame(loads, "load string, seq int")
        got = profile.load_changes(profile.compressed(df, 0, columns, 4, "id", "load", order), {0: 4})
        moved = {(i, 0) for i in (3, 4, 7, 8, 11, 12)}  # ranks count from 1: a load and the one after it
        assert {(x["rank"], x["column"]) for _, x in got[got["pointed"]].iterrows()} >= moved
        assert got["pointed"].mean() < (0.5 if rows == 400 else 0.7)


def test_column_changes_of_all_columns(spark):
    loads = spark.createDataFrame([("l1", 1), ("l2", 2), ("l3", 3)], "load_id string, load_seq int")
    # two values that the classifier can't tell apart: both hashes are the same
    same = spark.range(20000).select(F.col("id").cast("string").alias("v")).groupBy(profile._tokens(["v"], 1)).agg(F.collect_list("v").alias("v")).filter(F.size("v") > 1).head()["v"]
    l = F.concat(F.lit("l"), (F.col("id") % 3 + 1).cast("string"))
    df = spark.range(60000).select("id", l.alias("load_id"), F.when((l != "l2") | (F.col("id") % 10 < 3), "x").alias("gaps"), F.when(l == "l3", same[0]).otherwise(same[1]).alias("alike"), (F.col("id") % 7).alias("still"), F.timestamp_seconds("id").alias("at"))
    changes = lambda d: sorted(tuple(r) for r in profile.column_changes({"t": (d, "id", "load_id", d.columns)}, loads).collect())
    assert changes(df) == [("t", "alike", "l3"), ("t", "gaps", "l2"), ("t", "gaps", "l3"), ("t", "load_id", "l2"), ("t", "load_id", "l3")]
    assert changes(df.filter("load_id != 'l2'")) == [("t", "alike", "l3"), ("t", "load_id", "l3")] and changes(df.limit(0)) == []


def test_changes_query_is_registered():
    import __spark_entry__ as e

    assert {"p2_found", "p2_profile", "p2_changes"} <= set(e.queries())


def test_base_profile(spark):
    df = spark.createDataFrame([(1, "L1", "a"), (2, "L1", "a"), (3, "L1", None), (4, "L1", "B")], "id bigint, load string, v string")
    r = profile.base_profile(df, "t", ["v"], {"v": ("", "[a-z]")}, "id", "load").collect()
    assert [(x.n_rows, x.n_null, x.n_distinct, x.least, x.greatest, x.n_malformed, x.null_rate) for x in r] == [(4, 1, 2, "B", "a", 1, 0.25)]


def test_base_profile_ranges_by_type(spark):
    df = spark.createDataFrame([(i, "L1", float(-i) if i % 2 else None, str(i), T(1, 5), None) for i in (9, 10, 100, 101)], "id bigint, load string, x double, s string, at timestamp, none int")
    got = lambda d, **k: {r.column_name: (r.least, r.greatest) for r in profile.base_profile(d, "t", ["id", "x", "s", "at", "none"], {}, "id", "load", **k).collect()}
    assert got(df) == {"id": ("9", "101"), "x": ("-101.0", "-9.0"), "s": ("10", "9"), "at": ("2026-01-01 05:00:00",) * 2, "none": (None, None)}
    assert got(df, as_text=True)["id"] == ("10", "9") and got(df.limit(0)) == {}


def changes(spark, *files_):
    rows = [("s", f"f{i:02}", json.dumps(b) if isinstance(b, dict) else b) for i, bodies in enumerate(files_) for b in bodies]
    df = spark.createDataFrame(rows, "stream string, file_name string, body string")
    return sorted(tuple(r)[1:] for r in drift.schema_changes(df).collect())


def test_drift(spark):
    a = [{"id": f"ab{i}c-{i:04}", "n": i * 37, "o": {"x": 1, "y": "t"}, "l": [{"kind": "one"}, {"kind": "two"}]} for i in range(40)]
    renamed = [{"the_id": x["id"], "n": x["n"], "o": x["o"], "l": x["l"]} for x in a]
    moved = [{"the_id": x["the_id"], "o": {**x["o"], "n": x["n"]}, "l": x["l"]} for x in renamed]
    retyped = [{**x, "o": "gone flat", "l": [{"kind": 3}]} for x in moved]
    assert changes(spark, a, renamed) == [("f01", "renamed", "id", "the_id")]
    assert changes(spark, renamed, moved) == [("f01", "renamed", "n", "o.n")]
    assert changes(spark, moved, retyped) == [("f01", "retyped", "l[].kind", ""), ("f01", "retyped", "o", "")]
    assert changes(spark, a, [{k: v for k, v in x.items() if k != "o"} for x in a]) == [("f01", "removed", "o", "")]
    assert changes(spark, [{"a": 1}], [{"a": 1, "b": None}]) == [("f01", "added", "b", "")]
    assert changes(spark, [{"a": True}] * 9, [{"b": "text of another kind"}] * 9) == [("f01", "added", "b", ""), ("f01", "removed", "a", "")]


def test_drift_of_dotted_keys(spark):
    assert changes(spark, [{"a.b": 1}], [{"a": {"b": 1}}]) == [("f01", "added", "a", ""), ("f01", "removed", "`a.b`", "")]
    assert changes(spark, [{"x[]": 1, "y": "k"}], [{"x[]": 1, "y": "k", "z.": None}]) == [("f01", "added", "`z.`", "")]
    got = unified(spark, [{"a.b": 1, "a": {"b": "in"}}], [{"a.b": 2, "a": {"b": "in"}, "a_b": True}])
    assert sorted(map(str, got[1].asDict().values())) == sorted(["100", "f1", "0", "2", "in", "true"])


def test_subtrees_are_moved_and_matched(spark):
    box = lambda i: {"width": i, "colour": f"c-{i}", "sides": [{"kind": "flat"}]}
    old = [{"in": {"box": box(i), "n": i}, "out": {"m": 1}} for i in range(20)]
    new = [{"in": {"n": i}, "out": {"m": 1, "box": box(i)}} for i in range(20)]
    assert changes(spark, old, new) == [("f01", "renamed", "in.box", "out.box")]
    # a renamed object keeps its children: one edit, not one a field; what is new in it isn't told
    renamed = [{"in": {"crate": {**box(i), "depth": 1}, "n": i}, "out": {"m": 1}} for i in range(20)]
    assert changes(spark, old, renamed) == [("f01", "renamed", "in.box", "in.crate")]


def test_edit_distance_is_least():
    """Against all ways to match children under matched parents, on small trees."""
    import itertools
    import random

    r = random.Random(3)

    def tree(depth=0):
        return {k: tree(depth + 1) if depth < 2 and r.random() < 0.4 else None for k in r.sample("abcd", r.randrange(1, 4))}

    def sketches(t, at="", out=None):
        out = {} if out is None else out
        for k, v in t.items():
            s = out[f"{at}{drift.SEP}{k}" if at else k] = drift._Sketch()
            s.types = {"object": 1} if v is not None else {"string": 1}
            s.kinds = {} if v is not None else {"kind" + k: 1}
            if v is not None:
                sketches(v, f"{at}{drift.SEP}{k}" if at else k, out)
        return out

    size = lambda t: 0 if t is None else sum(1 + size(v) for v in t.values())

    def least(e, p, q, s, t):
        """Fields of one name are one field; the others are matched in every possible way."""
        ps, qs = list(s or {}), list(t or {})
        child = lambda at, k: f"{at}{drift.SEP}{k}" if at else k
        total, best = 0.0, None
        for k in set(ps) & set(qs):
            total += e._node(child(p, k), child(q, k)) + least(e, child(p, k), child(q, k), s[k], t[k])
        ps, qs = [k for k in ps if k not in qs], [k for k in qs if k not in ps]
        for n in range(min(len(ps), len(qs)) + 1):
            for some in itertools.combinations(ps, n):
                for other in itertools.permutations(qs, n):
                    costs = [e._node(child(p, x), child(q, y)) for x, y in zip(some, other)]
                    if None in costs:
                        continue
                    c = sum(costs) + sum(least(e, child(p, x), child(q, y), s[x], t[y]) for x, y in zip(some, other))
                    c += sum(1 + size(s[x]) for x in ps if x not in some) + sum(1 + size(t[y]) for y in qs if y not in other)
                    best = c if best is None else min(best, c)
        return total + best

    for _ in range(60):
        a, b = tree(), tree()
        e = drift._Edit(sketches(a), sketches(b))
        assert abs(e.script()[0] - least(e, "", "", a, b)) < 1e-9


def test_typed_columns_and_rejects(spark):
    rows = [(1, "s", "f0", 1, '{"n": 1, "x": 1.5, "b": true, "t": 7}'), (2, "s", "f1", 1, '{"n": 2, "x": 2, "b": false, "t": "seven"}'), (3, "s", "f1", 2, "{cut"), (4, "s", "f1", 3, "[1]"), (5, "s", "f1", 4, None)]
    df = spark.createDataFrame(rows, "raw_id bigint, stream string, file_name string, line_no bigint, body string")
    out = drift.unified_table(df, "s", typed=True)
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["x"] == "double" and dict(out.dtypes)["b"] == "boolean" and dict(out.dtypes)["t"] == "string"
    assert sorted((r.n, r.x, r.b, r.t) for r in out.collect()) == [(1, 1.5, True, "7"), (2, 2.0, False, "seven")]
    assert sorted((r.raw_id, r.reason) for r in drift.rejected_lines(df).collect()) == [(3, "unreadable"), (4, "no object"), (5, "null")]


def test_drift_dirty(spark):
    assert changes(spark) == []
    assert changes(spark, [{"a": 1}, '{"a": 1, "b"', None, "7", "[1]", ""], ['{"a" : 2}', '{"a": NaN}']) == []
    assert changes(spark, [{"a": None}], [{"a": 1}], [{"a": "x"}]) == [("f02", "retyped", "a", "")]
    assert changes(spark, [{"a": 1}], ["{cut"], [{"b": 1}]) == []
    deep = "[" * 100_000
    assert changes(spark, [{"a": "x" * 200_000}, deep], [{"a": "y"}]) == []


def test_unified_table(spark):
    rows = [(i, "s", f"f{f}", i, json.dumps(b)) for f, bodies in enumerate([[{"id": f"a-{i}", "n": i} for i in range(30)], [{"key": f"a-{i}", "n": str(i)} for i in range(30)]]) for i, b in enumerate(bodies, 30 * f)]
    out = drift.unified_table(spark.createDataFrame(rows, "raw_id bigint, stream string, file_name string, line_no bigint, body string"), "s").orderBy("raw_id").collect()
    assert len(out) == 60 and {r.key for r in out} == {f"a-{i}" for i in range(30)} and [r.n for r in out[:3]] == ["0", "1", "2"]


def unified(spark, *files):
    rows = [(100 * f + i, "s", f"f{f}", i, json.dumps(b)) for f, bodies in enumerate(files) for i, b in enumerate(bodies)]
    return drift.unified_table(spark.createDataFrame(rows, "raw_id bigint, stream string, file_name string, line_no bigint, body string"), "s").orderBy("raw_id").collect()


def test_unified_table_scalar_and_object(spark):
    text, obj = [{"h": "{no object"}, {"h": "b"}], [{"h": {"x": "c", "y": 1}}, {"h": {"x": "d"}}]
    out = unified(spark, text, obj)
    assert [(r.h, r.h__x, r.h__y) for r in out] == [("{no object", None, None), ("b", None, None), (None, "c", "1"), (None, "d", None)]
    assert [json.loads(r.h) if r.h[0] == "{" and r.h[1] != "n" else r.h for r in unified(spark, obj, text)] == [obj[0]["h"], obj[1]["h"], "{no object", "b"]
    assert [(r.h, r.h__x) for r in unified(spark, [{"h": [1, 2]}], obj)] == [("[1,2]", None), (None, "c"), (None, "d")]
    # an object before and after, with another field before; a field renamed while it was text; nulls between
    assert [(r.h, r.h__x, r.h__z) for r in unified(spark, [{"h": {"x": "a", "z": "q"}}], text, obj)] == [(None, "a", "q"), ("{no object", None, None), ("b", None, None), (None, "c", None), (None, "d", None)]
    assert [(r.h, r.h__x) for r in unified(spark, [{"g": "two words"}], [{"h": "two words"}], obj)] == [("two words", None)] * 2 + [(None, "c"), (None, "d")]
    assert [(r.h, r.h__x) for r in unified(spark, text, [{"h": None}], obj)] == [("{no object", None), ("b", None), (None, None), (None, "c"), (None, "d")]
    # both in one file
    assert [(r.h, r.h__x) for r in unified(spark, [{"h": "a"}, *obj])] == [("a", None), (None, "c"), (None, "d")]
    # renamed together with its object: kept, in a column of its own
    kept = unified(spark, [{"one_info": {"label": "two words", "n": 1, "m": 2, "q": 3}}], [{"one_data": {"title": "two words", "n": 1, "m": 2, "q": 3}}])
    assert [(r.one_info__label, r.one_data__title, r.one_data__n) for r in kept] == [("two words", None, "1"), (None, "two words", "1")]
    assert [r.h for r in unified(spark, [{"h": "a"}, *obj], [{"k": 1}])] == ["a", '{"x":"c","y":1}', '{"x":"d"}', None]


def test_assignment_is_least():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(30):
        c = r.integers(0, 20, (4, 6)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
        assert sum(c[i, j] for i, j in drift._assign(c)) == best


def test_head_tail(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), (None,), ("",)], "t string")
    cut = lambda n: [r[0] for r in df.select(predicates.head_tail(F.col("t"), n, "..")).collect()]
    assert cut(7) == ["abc..ij", "abc", None, ""] and cut(1) == [".", ".", None, ""] and cut(0) == ["", "", None, ""] and cut(3) == ["a..", "abc", None, ""]


def test_reconcile(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert sorted(tuple(r) for r in reconcile.inventory_delta(a, b, "k", "v").collect()) == [(1, "deleted"), (2, "modified"), (4, "created")]
    assert sorted((r.k, r.origin) for r in reconcile.precedence_union(a, b, "k").collect()) == [(1, "base"), (2, "base"), (3, "base"), (4, "increment")]
    assert tuple(reconcile.set_comparison(a, b, "k").head()) == (1, 1, 2)


def test_sequences(spark):
    df = spark.createDataFrame([("u", 1, 3), ("u", 2, 5), ("u", 3, 4), ("u", 4, 1), ("v", 1, None)], "u string, o bigint, s bigint")
    assert sorted((r.u, r.o) for r in sequence.greedy_pack(df, ["u"], "o", "s", 9).collect()) == [("u", 1), ("u", 2), ("u", 4), ("v", 1)]
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, "stop"), ("a", 3, "x"), ("b", 1, "x"), ("c", 1, "x"), ("c", 2, "x"), ("c", 3, "stop")], "u string, o bigint, t string")
    got = {r.u: (r.reads, r.outcome) for r in sequence.budgeted_replay(e, ["u"], "o", F.col("t") == "stop", 2).collect()}
    assert got == {"a": (2, "finish"), "b": (1, "insufficient_material"), "c": (2, "budget_exhausted")}
    i = spark.createDataFrame([("k", 0, 5, 1), ("k", 5, 6, 2), ("k", 8, 9, 3), ("k", 1, 2, 4)], "k string, s bigint, e bigint, t bigint")
    assert sorted(tuple(r) for r in sequence.merged_intervals(i, ["k"], "s", "e", "t").collect()) == [("k", 0, 6, 3), ("k", 8, 9, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße Ｘ", '{"A":[{"b":1}]}'), (None, None), ("", "{cut")], "t string, j string")
    out = df.select(text.nfkc_casefold("t").alias("t"), text.json_tree_stats("j").alias("s"), text.forbidden_key_paths({"B"})("j").alias("p")).collect()
    assert out[0].t == "strasse x" and tuple(out[0].s) == (4, 4) and out[0].p == ["A[0].b"]
    assert out[1].t is None and out[2].s.nodes is None and out[2].p == []


PATCH = 'diff --git a/x.c b/y.c\nrename from x.c\nrename to y.c\n--- a/x.c\n+++ b/y.c\n@@ -1,2 +1,3 @@ f\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-q\n+r\ndiff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n--- "a/\\303\\251.txt"\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n'


def test_patches():
    h = patches.hunks(PATCH)
    assert [(x[0], x[1], x[2], x[3], x[4], x[9], x[10], x[11]) for x in h] == [(1, "x.c", "y.c", False, 1, 2, 1, True), (1, "x.c", "y.c", False, 2, 1, 1, True), (2, None, None, True, None, 0, 0, True), (3, "é.txt", None, False, 1, 0, 1, True)]
    assert patches.hunks(None) == [] and patches.hunks("no diff\n+x") == []


def test_patch_paths():
    good = {("a/x.py", "a/"): "x.py", ("rename", ""): "rename", ("a/x.py", ""): "a/x.py", ('"b/\\303\\251\\t.txt"', "b/"): None, ('"b/\\303\\251.txt"', "b/"): "é.txt", ("/dev/null", "a/"): None, ("a/x.c\t2026-01-01", "a/"): "x.c", ('"a/q\\"q"', "a/"): 'q"q'}
    for (text, prefix), want in good.items():
        if (text, prefix) == ('"b/\\303\\251\\t.txt"', "b/"):
            with pytest.raises(patches.BadPath):
                patches.path_of(text, prefix)
        else:
            assert patches.path_of(text, prefix) == want
    for bad in ("a/../../etc/passwd", "/etc/passwd", '"a/x\\q"', '"a/x', '"a/\\377"', "a/", "a//b", "a/./b", '"a/x\\ry"', "a/c:d"):
        with pytest.raises(patches.BadPath):
            patches.path_of(bad, "a/")


def test_patch_files():
    moved = "diff --git a/a/x.py b/y.py\nsimilarity index 90%\nrename from a/x.py\nrename to y.py\ndiff --git a/c b/d\ncopy from c\ncopy to d\n"
    assert [(x[0], x[1], x[2], x[4]) for x in patches.hunks(moved)] == [(1, "a/x.py", "y.py", None), (2, "c", "d", None)]
    short = "--- a/x\n+++ b/x\n@@ -1,3 +1,2 @@\n a\n-b\n"
    assert [(x[11], x[12]) for x in patches.hunks(short)] == [(False, True)]
    unsafe = "--- a/../x\n+++ b/x\n@@ -1,0 +1 @@\n+a\n"
    assert [(x[1], x[2], x[6], x[11], x[12]) for x in patches.hunks(unsafe)] == [(None, "x", 0, True, False)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"1","n":1}\n\n{"k":"2","n":2}\n')
    assert files.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "k string, n int", "k").count() == 2
    (tmp_path / "b.jsonl").write_text('{"k":"1","n":1}\n{"k":"1","n":2}\n')
    with pytest.raises(ValueError):
        files.strict_jsonl(spark, str(tmp_path / "b.jsonl"), "k string, n int", "k")
    (tmp_path / "c.jsonl").write_text('{"k":"1","k":"2"}\n')
    with pytest.raises(Exception):
        files.strict_jsonl(spark, str(tmp_path / "c.jsonl"), "k string").collect()
    (tmp_path / "ids.txt").write_text("# list\nb-1 # two\n\na-2\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt"), r"\w-\d").orderBy("position").collect()] == ["b-1", "a-2"]
    (tmp_path / "t.csv").write_text("a,b\n1,yes\n")
    assert files.checked_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], True, {"b": ["yes"]}).count() == 1
    with pytest.raises(ValueError):
        files.checked_csv(spark, str(tmp_path / "t.csv"), ["a", "c"])
    df = spark.createDataFrame([(1, None, "x"), (2, {"a": 1}, None)], "i int, m map<string,int>, s string").drop("m")
    assert files.write_verified(df, str(tmp_path / "out"), "parquet").count() == 2
    assert files.write_verified(df, str(tmp_path / "outj"), "json").count() == 2
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "e1.body").write_bytes(b"hello")
    (tmp_path / "ev" / "e2.body").write_bytes(b"\xff")
    import hashlib

    rec = spark.createDataFrame([("e1", "sha256:" + hashlib.sha256(b"hello").hexdigest()), ("e2", "sha256:" + hashlib.sha256(b"\xff").hexdigest()), ("e3", "x")], "evidence_id string, content_sha256 string")
    got = {r.evidence_id: (r.state, r.text) for r in files.verified_evidence(spark, rec, str(tmp_path / "ev")).collect()}
    assert got == {"e1": ("ok", "hello"), "e2": ("not_text", None), "e3": ("missing", None)}
    assert files.file_inventory(spark, str(tmp_path / "ev")).count() == 2


def test_streaming(spark, tmp_path):
    from ledgerloom.streaming import replay

    rows = [(1, T(1, 1), 7, "view"), (2, T(1, 2), 7, "error"), (3, T(1, 3), 8, "view"), (4, T(1, 4), 8, "view"), (5, T(1, 5), 9, "view")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("r", replay.budgeted_replay_stream(stream, 2), "append"), ("w", replay.windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r) for r in spark.table("r").collect()) == [(7, 2, "finish"), (8, 2, "budget_exhausted")]
    assert spark.table("w").agg(F.sum("n")).head()[0] == 5


def test_entry_without_llm(tmp_path):
    """A copy without the subpackage gives the core's queries; a missing library isn't taken for a missing subpackage."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    shutil.copytree(home / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert {'coverage_status', 'p2_found', 'p5_found', 'p6_found'} <= set(q) and not {'p1_found', 'p9_found'} & set(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    if (home / "ledgerloom" / "llm").exists():
        broken = "import sys; sys.modules['ledgerloom.session'] = None\ntry:\n    import __spark_entry__\nexcept ImportError:\n    print('told')"
        assert "told" in subprocess.run([sys.executable, "-c", broken], cwd=home, capture_output=True, text=True).stdout


def test_streaming_state_ends(spark, tmp_path):
    from ledgerloom.streaming import replay

    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string"
    batches = [[(1, T(1, 1), 7, "view"), (2, T(1, 1), 8, "error")], [(3, T(2, 1), 9, "view")], [(4, T(3, 1), 9, "view")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.budgeted_replay_stream(stream, 3, idle_minutes=30).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    assert sorted(tuple(r) for r in spark.table("ended").collect())[:2] == [(7, 1, "insufficient_material"), (8, 1, "finish")]
    assert progress["stateOperators"][0]["numRowsTotal"] <= 1


def test_more_text_functions(spark):
    df = spark.createDataFrame([('{"Guard-Location":{"x":["a",{"y":"b"}]},"z":"c"}', 'ab"é' * 50), ("{cut", None), (None, "")], "j string, t string")
    out = df.select(text.contract_key_paths({"guard_l"})("j").alias("k"), text.protected_scalars({"guard"})("j").alias("s"), text.fitting_length(40)("t").alias("n")).collect()
    assert out[0].k == ["Guard-Location"] and out[0].s == ["a", "b"] and out[1].k == [] and out[2].s == []
    fits = lambda n: len(json.dumps(('ab"é' * 50)[:n], ensure_ascii=False).encode()) <= 40
    assert fits(out[0].n) and not fits(out[0].n + 1) and out[1].n is None and out[2].n == 0


def test_file_tools(spark, tmp_path):
    for name in ("a/x.json", "b/y.json"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(name)
    inv = files.file_inventory(spark, str(tmp_path))
    assert sorted(r.part for r in files.grammar_scan(inv, r"/([ab])/\w\.json$", ["part"]).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        files.grammar_scan(inv, r"/(a)/\w\.json$", ["part"]).collect()
    first = files.tree_digest(inv).head()[0]
    (tmp_path / "b/y.json").write_text("changed")
    assert files.tree_digest(files.file_inventory(spark, str(tmp_path))).head()[0] != first
    req, res = spark.createDataFrame([("h1",), ("h2",)], "commitment string"), spark.createDataFrame([("h1", "r")], "commitment string, response string")
    assert sorted((r.commitment, r.response, r.cached) for r in files.reused_responses(req, res).collect()) == [("h1", "r", True), ("h2", None, False)]
    assert files.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |"


def test_built_chain(spark):
    import hashlib

    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "u string, o int, c string")
    h = hashlib.sha256((hashlib.sha256(b"|a").hexdigest() + "|b").encode()).hexdigest()
    assert tuple(sequence.built_chain(df, ["u"], "o", F.col("c")).head()) == ("u", 2, h)


def test_positions_are_windows(spark):
    import random

    r = random.Random(1)
    df = spark.createDataFrame([(r.choice(["a", "a", "a", "b", None]), i * 3, r.choice(["x", "y", None])) for i in range(500)], "u string, o bigint, v string")
    w = Window.partitionBy("u").orderBy("o")
    want = df.select("o", (F.row_number().over(w) - 1).alias("p"), F.lag("v").over(w).alias("l"), F.lead("v").over(w).alias("n"))
    got = sequence.positioned(df, ["u"], "o", previous={"l": F.col("v")}, following={"n": F.col("v")}, span=40)
    assert sorted(map(tuple, want.collect()), key=str) == sorted(((x.o, x.position, x.l, x.n) for x in got.collect()), key=str)


def test_intervals_across_buckets(spark):
    import random

    r = random.Random(2)
    rows = [(r.choice("ab"), s := r.randrange(3000), s + r.choice([1, 3, 200]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint, t bigint")
    got = lambda span: sorted(map(tuple, sequence.merged_intervals(df, ["k"], "s", "e", "t", span).collect()))
    assert got(7) == got(500) == got(10**9) and sum(x[3] for x in got(7)) == 400


def test_leakage_revisions(spark, tmp_path):
    import hashlib

    from ledgerloom.plans import reference

    a, b, c, e = (hashlib.sha1(x.encode()).hexdigest() for x in "abce")
    spark.createDataFrame([(f"git:{a.upper()}", f"'{b}'"), ("unknown", None)], "buggy_revision string, fixed_revision string").write.parquet(str(tmp_path / "r01_candidates.parquet"))
    spark.createDataFrame([((f"https://h.example/o/n/commit/{c}", f"commit \u200b{e}"),)], "repository struct<vulnerable_commit string, fixed_commit string>").write.parquet(str(tmp_path / "case_catalog.parquet"))
    texts = [(1, f"see {a[:8]}."), (2, f"at {b} and {b[:12]}"), (3, f"URL/{c[:9].upper()}"), (4, f"v1-3-g{e[:10]}"), (5, a[:7]), (6, a[:8] + ("1" if a[8] != "1" else "2") * 4), (7, None), (8, "unknown")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, reference.leakage_revisions(spark, str(tmp_path)).collect())) == [(1, sha(a)), (2, sha(b)), (3, sha(c)), (4, sha(e))]


def test_contained_values_is_brute_force(spark):
    import random

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcä ") for _ in range(n))
    values = [word(r.choice([3, 8, 9, 20])) for _ in range(60)] + ["https://one.example/x", "https://one.example/y", None, "", "  ", "ＷＩＤＥ ｖａｌｕｅ"]
    texts = [(i, word(40) + (r.choice(values) or "") + word(30)) for i in range(80)] + [(100, None), (101, ""), (102, values[0]), (103, "see HTTPS://ONE.EXAMPLE/X now"), (104, "a wide VALUE here"), (105, "x" * 100_000 + "https://one.example/y")]
    allowed = [values[1], values[2], "other"]
    import unicodedata

    form = lambda x: unicodedata.normalize("NFKC", x or "").casefold().strip()
    secrets = {form(v) for v in values} - {form(a) for a in allowed} - {""}
    want = {(i, v) for i, t in texts if form(t) not in {form(a) for a in allowed} for v in secrets if (v in form(t) if len(v.encode()) >= 8 else v == form(t))}
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = leakage.contained_values(df(texts, "id bigint, text string"), df([(v,) for v in values], "value string"), df([(a,) for a in allowed], "value string")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} == want and len(want) > 10
    assert leakage.contained_values(df([], "id bigint, text string"), df([], "value string"), df([], "value string")).isEmpty()


def test_contained_values_sends_the_driver_a_filter(spark, tmp_path, monkeypatch):
    """What the driver gets and what is kept on disk follow the number of values, not of their windows; ids may repeat or be null."""
    import random

    r = random.Random(6)
    n = 60_000
    values = [(f"{r.getrandbits(160):040x}",) for _ in range(n)]
    texts = [(1, f"a {values[0][0]} b"), (1, f"{values[0][0]}"), (None, f"c {values[1][0]}"), (2, f"{values[2][0][1:]} {values[3][0][:-1]}")]
    frame, sent = type(spark.range(1)), []
    for name, size in (("collect", lambda rows: sum(len(x) for row in rows for x in row if isinstance(x, bytes))), ("toPandas", lambda table: table.memory_usage(index=False).sum())):
        whole = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, whole=whole, size=size: (out := whole(self), sent.append(int(size(out))))[0])
    monkeypatch.setattr("ledgerloom.session.shared_dir", lambda spark: f"file://{tmp_path}")
    got = leakage.contained_values(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(values, "value string"), spark.createDataFrame([], "value string"))
    held = sorted(map(tuple, got.collect()), key=str)
    assert sum(sent) < 5 * n
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 200 * n
    assert held == [(1, values[0][0]), (None, values[1][0])]


def test_contained_values_with_common_windows(spark, monkeypatch):
    """Values that differ in their last bytes or not at all but for their length; slices of a filter; a text of several chunks."""
    monkeypatch.setattr(leakage, "KEYS", 16)
    monkeypatch.setattr(leakage, "SLICE", 4)
    path = "https://one.example/" + "/".join("abcdefghij" * 3)
    values = [f"{path}/{i}" for i in range(200)] + [path[:k] for k in range(20, len(path))] + ["x" * k for k in range(8, 60)] + ["ü" * 9, "needle over an edge"]
    long = "".join(chr(97 + i * i % 23) for i in range(leakage.CHUNK))
    texts = [(1, f"see {path}/17 and {'x' * 30}."), (2, long[:-9] + "needle over an edge" + long), (3, "Ü" * 10), (4, path[:-1]), (5, "https://one.example"), (6, path + "/19")]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = leakage.contained_values(df(texts, "id bigint, text string"), df([(v,) for v in values], "value string"), df([(path + "/19",)], "value string")).collect()
    want = {(i, v) for i, t in texts[:-1] for v in values if v in t.casefold() and v != path + "/19"}
    assert sorted(map(tuple, got)) == sorted(want) and {i for i, _ in want} == {1, 2, 3, 4}


def test_quantiles_are_exact(spark):
    import random

    import numpy as np

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), float(r.randrange(1000)) if r.random() < 0.9 else None) for _ in range(500)] + [("none", None), ("one", 7.0)]
    n = F.col("n")
    got = {x.g: (x.mid, x.p95) for x in sequence.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"mid": (n + 1) / 2, "p95": (n - 1) * F.lit(0.95) + 1}, span=37).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], (np.median(v), np.quantile(v, 0.95)))
    assert "none" not in got


def test_strict_lines_name_the_place(spark, tmp_path):
    good = '{"k":"1","n":1}\n'
    for bad in ('{"k":"1","n":"x"}', '{"k":"1","n":1,"z":2}', '{"k":"1"', '{"k":"1","k":"2","n":1}', "[1]", '{"k":"1","n":NaN}'):
        (tmp_path / "x.jsonl").write_text(good + "\n" + bad + "\n" + good)
        with pytest.raises(ValueError, match="x.jsonl:3"):
            files.strict_jsonl(spark, str(tmp_path / "x.jsonl"), "k string, n int")
    (tmp_path / "x.jsonl").write_text(good + '{"k":null,"n":2}\n')
    assert files.strict_jsonl(spark, str(tmp_path / "x.jsonl"), "k string, n int").count() == 2


def test_replay_of_evidence(spark):
    """Supported, then countered; no material; the budget taking a decision back; an undecided finish."""
    rows = [("s", 1, "sup"), ("s", 2, "fin"), ("c", 1, "sup"), ("c", 2, "cnt"), ("c", 3, "fin"), ("i", 1, "sup"), *(("b", k, "sup") for k in range(1, 6)), ("u", 1, "fin")]
    k = F.col("k")
    update = sequence.evidence_update(support=F.when(k == "sup", 1), counter=F.when(k == "cnt", 1), status=F.when(k == "sup", "supported"), revision=F.when(k == "cnt", "refuted"), terminal=F.when(k == "fin", "FINISH"))
    got = {x.c: (x.reads, x.status, x.terminal, x.reason) for x in sequence.evidence_replay(spark.createDataFrame(rows, "c string, o int, k string"), ["c"], "o", update, 4).collect()}
    assert got == {"s": (2, "supported", "FINISH", None), "c": (3, "refuted", "FINISH", None), "i": (1, "unresolved", "UNRESOLVED", "insufficient_material"), "b": (4, "unresolved", "UNRESOLVED", "budget_exhausted"), "u": (1, "unresolved", "UNRESOLVED", "insufficient_material")}

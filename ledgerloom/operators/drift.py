"""Schemas that drift between files of JSON lines.

Each file's schema is a tree of fields with types and content sketches. Consecutive trees of a stream are
compared by tree edit distance (add, remove, rename, move, retype); the scripts of least cost compile into
projections that read every file into one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import Scratch, ship

BINS = 64
#: Between the keys of a path, and after an array. Control characters, so that keys may hold dots and brackets.
SEP, EACH = "\x1f", "\x1e"
#: The kinds of string content, tried in this order.
KINDS = {
    "blank": r"\s*",
    "digest": r"(?:sha\d+:)?[0-9a-f]{12,}",
    "time": r"\d{4}-\d\d-\d\d(?:[T ][\d:.]+(?:Z|[+-]\d\d:?\d\d)?)?",
    "number": r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?",
    "flag": r"(?i:true|false|yes|no)",
    "url": r"[a-z+]+://\S+",
    "file": r"(?:[^\s/]+/)+[^\s/]+\.\w+",
    "path": r"(?:[^\s/]+/)+[^\s/]+",
    "code": r"(?=\S*\d)[\w:]+(?:[-.][\w:]+)*",
    "lower": r"[a-z]+",
    "upper": r"[A-Z]+(?:_[A-Z]+)*",
    "snake": r"[a-z]+(?:[_-][a-z]+)+",
    "camel": r"[A-Za-z]+",
    "text": r"(?s:.*\s.*)",
    "other": r"(?s:.*)",
}
_KIND = re.compile("|".join(f"(?P<{k}>(?:{v})\\Z)" for k, v in KINDS.items()))
_NAMES = list(KINDS)


class _Sketch:
    """Of one field in one file: values by type, by kind of content and by hash bin. Fixed size; covers all values."""

    __slots__ = ("types", "kinds", "bins", "inner")

    def __init__(self):
        self.types, self.kinds, self.bins, self.inner = {}, {}, {}, 0


def _key(k: str) -> str:
    return k.replace(SEP, "\ufffd").replace(EACH, "\ufffd") if SEP in k or EACH in k else k


def shown(path: str) -> str:
    """Path as reports write it: dotted, with ``[]`` after an array; keys with dots, brackets or backticks are quoted."""
    key = lambda k: "`" + k.replace("`", "``") + "`" if re.search(r"[.\[\]`]", k) or not k else k
    parts = [(k.rstrip(EACH), len(k) - len(k.rstrip(EACH))) for k in path.split(SEP)]
    return ".".join(key(k) + "[]" * n for k, n in parts) if path else ""


def json_path(path: str) -> str:
    """Path for Spark's JSON functions."""
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path.split(SEP))


def _note(fields: dict, path: str, v, memo: dict) -> None:
    s = fields.get(path)
    if s is None:
        s = fields[path] = _Sketch()
    if v is None:
        s.types["null"] = s.types.get("null", 0) + 1
        return
    t = type(v)
    name = "string" if t is str else "boolean" if t is bool else "number" if t in (int, float) else "array" if t is list else "object"
    s.types[name] = s.types.get(name, 0) + 1
    if t is dict:
        for k, x in v.items():
            _note(fields, f"{path}{SEP}{_key(k)}", x, memo)
        return
    if t is list:
        at = path + EACH
        for x in v:
            if type(x) is dict:
                s.inner += 1
                for k, y in x.items():
                    _note(fields, f"{at}{SEP}{_key(k)}", y, memo)
            elif x is not None:
                kind, b = _content(x, memo)
                s.kinds[kind] = s.kinds.get(kind, 0) + 1
        return
    kind, b = _content(v, memo)
    s.kinds[kind] = s.kinds.get(kind, 0) + 1
    s.bins[b] = s.bins.get(b, 0) + 1


def _content(v, memo: dict) -> tuple[str, int]:
    key = (v.__class__, v) if v.__class__ is not list else None
    hit = memo.get(key) if key else None
    if hit is None:
        if isinstance(v, str):
            kind = _KIND.match(v).lastgroup
            if kind == "text":
                kind += str(min(9, len(v).bit_length()))
        elif isinstance(v, bool):
            kind = "bool"
        elif isinstance(v, (int, float)):
            size = abs(v)
            kind = ("i" if size != size or size == float("inf") or v == int(v) else "f") + (str(int(np.log10(size + 1))) if size == size and size != float("inf") else "?")
        else:
            kind = "nested"
        hit = kind, crc32(str(v).encode("utf-8", "surrogatepass")) % BINS
        if key:
            if len(memo) > 200_000:
                memo.clear()
            memo[key] = hit
    return hit


def _sketches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files: dict = {}
    memo: dict = {}
    for part in it:
        for stream, file, body in zip(part["stream"], part["file_name"], part["body"]):
            try:
                v = json.loads(body)
            except (ValueError, TypeError, RecursionError):
                continue  # cut off: not readable
            if type(v) is dict:
                fields = files.setdefault((stream, file), {})
                fields.setdefault("", _Sketch()).types["object"] = 1
                for k, x in v.items():
                    _note(fields, _key(k), x, memo)
    out = [(s, f, p, json.dumps([x.types, x.kinds, x.bins, x.inner])) for (s, f), fields in files.items() for p, x in fields.items()]
    if out:
        yield pd.DataFrame(out, columns=["stream", "file_name", "path", "sketch"])


def field_sketches(lines: DataFrame) -> DataFrame:
    """(stream, file_name, path, sketch): partial sketches by partition, to be added up."""
    ship(lines.sparkSession)
    return lines.select("stream", "file_name", "body").mapInPandas(_sketches, "stream string, file_name string, path string, sketch string")


def file_fields(lines: DataFrame) -> DataFrame:
    """(stream, file_name, field_path, types): each field of each file, with the types of its values joined by ``;`` (null has none)."""
    types = F.map_keys(F.from_json(F.get_json_object("sketch", "$[0]"), "map<string,bigint>"))
    path = F.replace(F.replace("path", F.lit(EACH), F.lit("[]")), F.lit(SEP), F.lit(".")).alias("field_path")
    out = field_sketches(lines).filter("path <> ''").groupBy("stream", "file_name", path).agg(F.array_distinct(F.flatten(F.collect_set(types))).alias("t"))
    return out.select("stream", "file_name", "field_path", F.array_join(F.array_sort(F.array_remove("t", "null")), ";").alias("types"))


# ---- comparing two schemas


def _tree(rows: pd.DataFrame) -> dict[str, _Sketch]:
    fields: dict[str, _Sketch] = {}
    for path, text in zip(rows["path"], rows["sketch"]):
        s, (types, kinds, bins, inner) = fields.setdefault(path, _Sketch()), json.loads(text)
        for mine, more in ((s.types, types), (s.kinds, kinds), (s.bins, bins)):
            for k, n in more.items():
                mine[k] = mine.get(k, 0) + n
        s.inner += inner
    return fields


def _type(s: _Sketch) -> str | None:
    """Most frequent type; null has none."""
    return max((n, t) for t, n in s.types.items() if t != "null")[1] if set(s.types) - {"null"} else None


def _parent(path: str) -> str:
    return path.rpartition(SEP)[0]


def _holds_fields(fields: dict, parent: str) -> bool:
    """The parent is an object (or array of objects) in this file, so that what lies under it can be told."""
    while parent:
        s = fields.get(parent.rstrip(EACH))
        if s is None or (not s.inner if parent.endswith(EACH) else _type(s) != "object"):
            return False
        parent = _parent(parent.rstrip(EACH))
    return True


def _overlap(a: dict, b: dict) -> float:
    na, nb = sum(a.values()), sum(b.values())
    return sum(min(a[k] / na, b[k] / nb) for k in a.keys() & b.keys()) if na and nb else float(na == nb)


def _few(s: _Sketch) -> bool:
    """The field takes few values: they fill few bins, each many times."""
    n = sum(s.bins.values())
    return len(s.bins) <= min(BINS * 3 // 8, n / 2)


def _words(path: str) -> set[str]:
    return set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z\d])([A-Z])", r"\1_\2", path.rpartition(SEP)[2]).lower()))


def _rename_cost(a: dict, p: str, b: dict, q: str) -> float | None:
    """Cost of turning field p of ``a`` into q of ``b``, below that of removing and adding (2); None: not one field."""
    x, y = a[p], b[q]
    t = _type(x)
    if t is None or t != _type(y):
        return None
    names = _words(p), _words(q)
    alike = len(names[0] & names[1]) / max(1, min(map(len, names)))
    if t == "object" or (t == "array" and (x.inner or y.inner)):
        under = [{f[len(r):].lstrip(EACH) for f in fields if f.startswith((r + SEP, r + EACH + SEP))} for fields, r in ((a, p), (b, q))]
        same = len(under[0] & under[1]) / max(1, len(under[0] | under[1]))
    elif t == "array" and not (x.kinds and y.kinds):
        same = alike
    else:
        same = _overlap(x.kinds, y.kinds)
        if t == "boolean":
            same = max(alike, _overlap(x.bins, y.bins))
        elif t != "array" and (_few(x) or _few(y)):
            same = min(same, _overlap(x.bins, y.bins))
    if same < 0.5:
        return None
    return 1.5 - 0.6 * same - 0.4 * alike + (0.2 if _parent(p) != _parent(q) else 0)


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns (shortest augmenting paths); rows <= columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        dist, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = ~used
            free[0] = False
            reduced = np.r_[np.inf, cost[match[j0] - 1] - u[match[j0]] - v[1:]]
            closer = free & (reduced < dist)
            dist[closer], way[closer] = reduced[closer], j0
            j1 = int(np.argmin(np.where(free, dist, np.inf)))
            delta = dist[j1]
            u[match[used]] += delta
            v[used] -= delta
            dist[free] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


class _Edit:
    """Tree edit distance of two schemas: unordered trees, children matched under matched parents.

    A node costs 1 to remove or add, so a subtree costs its size; a retype costs 1, a rename less than removing and
    adding, by how alike name and content are. The children of two matched nodes are assigned at least total cost,
    each pair at the distance of its subtrees. A move takes a whole subtree from one parent to another.
    """

    RETYPE, MOVE = 1.0, 0.2

    def __init__(self, a: dict[str, _Sketch], b: dict[str, _Sketch]):
        self.a, self.b = a, b
        self.under = [self._children(t) for t in (a, b)]
        self.sizes: dict[tuple[int, str], float] = {}
        self.known: dict[tuple[str, str], tuple[float, list[tuple[str | None, str | None]]] | None] = {}

    @staticmethod
    def _children(fields: dict[str, _Sketch]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for p in sorted(fields):
            if p:
                out.setdefault(_parent(p).rstrip(EACH), []).append(p)
        return out

    def size(self, side: int, p: str) -> float:
        key = (side, p)
        if key not in self.sizes:
            self.sizes[key] = 1.0 + sum(self.size(side, c) for c in self.under[side].get(p, []))
        return self.sizes[key]

    def _node(self, p: str, q: str) -> float | None:
        """Cost of turning node p into q without their children; None: they can't be one field."""
        if p.rpartition(SEP)[2] == q.rpartition(SEP)[2]:
            t, u = _type(self.a[p]), _type(self.b[q])
            return self.RETYPE if t and u and t != u else 0.0
        return _rename_cost(self.a, p, self.b, q)

    def distance(self, p: str, q: str) -> float | None:
        found = self._match(p, q)
        return None if found is None else found[0]

    def _match(self, p: str, q: str) -> tuple[float, list[tuple[str | None, str | None]]] | None:
        """(distance of the subtrees, pairs of their children; None on a side: removed or added)."""
        key = (p, q)
        if key not in self.known:
            node = self._node(p, q) if p else 0.0
            if node is None:
                self.known[key] = None
            else:
                cost, pairs = self._assigned(self.under[0].get(p, []), self.under[1].get(q, []))
                self.known[key] = (node + cost, pairs)
        return self.known[key]

    def _assigned(self, ps: list[str], qs: list[str], move: float = 0.0) -> tuple[float, list[tuple[str | None, str | None]]]:
        """Least-cost pairs of subtrees. Fields of one name under one parent are one field unless that costs more than both."""
        n, m = len(ps), len(qs)
        if not n or not m:
            return sum(self.size(0, p) for p in ps) + sum(self.size(1, q) for q in qs), [(p, None) for p in ps] + [(None, q) for q in qs]
        never = 1e6
        cost = np.full((n, m + n), never)  # the added cost of not adding q is taken off, so that rows alone are assigned
        for i, p in enumerate(ps):
            cost[i, m + i] = self.size(0, p)
            for j, q in enumerate(qs):
                same = not move and p.rpartition(SEP)[2] == q.rpartition(SEP)[2]
                d = self.distance(p, q)
                if d is not None and (same or d + move < self.size(0, p) + self.size(1, q)):
                    cost[i, j] = (-1e3 if same else d + move) - self.size(1, q)
        pairs = [(ps[i], qs[j]) for i, j in _assign(cost) if j < m and cost[i, j] < never / 2]
        gone, come = [p for p in ps if p not in {x for x, _ in pairs}], [q for q in qs if q not in {x for _, x in pairs}]
        total = sum(self.distance(p, q) + move for p, q in pairs) + sum(self.size(0, p) for p in gone) + sum(self.size(1, q) for q in come)
        return total, pairs + [(p, None) for p in gone] + [(None, q) for q in come]

    def script(self) -> tuple[float, list[tuple[str, str, str]]]:
        """(distance, edits): retypes, renames, moves, removals and additions from the roots downwards."""
        out, gone, come, todo = [], [], [], [("", "")]
        while todo:
            p, q = todo.pop()
            for x, y in self._match(p, q)[1]:
                if x is None or y is None:
                    (gone if y is None else come).append(y if x is None else x)
                    continue
                changed = _type(self.a[x]) and _type(self.b[y]) and _type(self.a[x]) != _type(self.b[y])
                if x.rpartition(SEP)[2] != y.rpartition(SEP)[2]:
                    out.append(("renamed", x, y))
                elif changed:
                    out.append(("retyped", x, ""))
                if not changed:
                    todo.append((x, y))
        moved = [(x, y) for x, y in self._assigned(sorted(gone), sorted(come), self.MOVE)[1] if x is not None and y is not None]
        out += [("moved", x, y) for x, y in moved]
        out += [("removed", x, "") for x in gone if x not in {x for x, _ in moved}]
        out += [("added", y, "") for y in come if y not in {y for _, y in moved}]
        return self._match("", "")[0], sorted(out)


def edit_script(a: dict[str, _Sketch], b: dict[str, _Sketch]) -> list[tuple[str, str, str]]:
    """(change_kind, field_path, new_path) that turn schema ``a`` into ``b`` at least cost, as they are reported.

    Only fields whose parents are objects in both schemas, under names that both have, are told: when an object comes,
    goes, changes type or is renamed, what lies under it isn't. A move is a rename to another parent.
    """
    seen = lambda p: _holds_fields(a, _parent(p)) and _holds_fields(b, _parent(p))
    script = _Edit(a, b).script()[1]
    out = []
    for kind, p, q in script:
        if kind in ("renamed", "moved"):
            if seen(p) and seen(q):
                out.append(("renamed", p, q))
        elif seen(p):
            out.append((kind, p, q))
    return sorted(out)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    at = rows["at"].iloc[0]
    new, old = rows[rows["rank"] == at], rows[rows["rank"] == at - 1]
    script = edit_script(_tree(old), _tree(new)) if len(new) and len(old) else []
    stream, file = (new["stream"].iloc[0], new["file_name"].iloc[0]) if len(new) else (None, None)
    return pd.DataFrame([(stream, file, *x) for x in script], columns=["stream", "file_name", "change_kind", "field_path", "new_path"])


def _compare_shown(rows: pd.DataFrame) -> pd.DataFrame:
    out = _compare(rows)
    return out.assign(field_path=out["field_path"].map(shown), new_path=out["new_path"].map(shown))


def schema_changes(lines: DataFrame, sketches: DataFrame | None = None, compare=_compare_shown) -> DataFrame:
    """(stream, file_name, change_kind, field_path, new_path) between each file and the one before it in its stream.

    ``lines`` has (stream, file_name, body). Unreadable lines and lines that are no object say nothing; a file
    without readable lines still counts as a file, with no field, and gives no changes against its neighbours.
    Null bodies are unreadable; repeated lines change nothing. No files: no changes.
    """
    files = lines.filter("file_name IS NOT NULL").select("stream", "file_name").distinct()
    files = files.withColumn("rank", F.row_number().over(Window.partitionBy("stream").orderBy("file_name")))
    rows = (field_sketches(lines) if sketches is None else sketches).join(files, ["stream", "file_name"])
    rows = rows.withColumn("at", F.explode(F.array("rank", F.col("rank") + 1)))  # as the later and as the earlier file
    return rows.groupBy("stream", "at").applyInPandas(compare, "stream string, file_name string, change_kind string, field_path string, new_path string")


# ---- projections


def field_history(changes: list[tuple[str, str, str, str]], files: list[str], last: dict[str, str], held: list[set[str]]) -> dict[str, list[tuple[int, int, str, bool]]]:
    """For each field of the last schema and each that ended or became an object: (first file, last file, path then, objects too).

    ``held`` has the fields of each file that have values other than objects. One that no column reads there, as it
    is an object later, gets a column for these values; what its objects hold in other files has columns of its own.
    """
    spans: dict[str, list[tuple[int, int, str, bool]]] = {p: [] for p in last}
    until, bare = {p: (p, len(files) - 1) for p in last}, set()

    def close(path: str, first: int) -> str:
        final, end = until.pop(path)
        spans[final].append((first, end, path, final not in bare))
        return final

    def begin(path: str, end: int) -> str:
        final = path if path not in spans else f"{path}@{files[end]}"
        spans[final], until[path] = [], (final, end)
        return final

    def read(path: str) -> bool:
        above = path
        while above := _parent(above):
            if above in until and until[above][0] not in bare:
                return True
        return path in until

    for i in range(len(files) - 1, -1, -1):
        for p in sorted(held[i]):
            if not read(p):
                bare.add(begin(p, i))
        for _, kind, path, new in [c for c in changes if i and c[0] == files[i]]:
            if kind == "renamed":
                for p in [p for p in until if p == new or p.startswith((new + SEP, new + EACH))]:
                    final = close(p, i)
                    until[path + p[len(new):]] = (final, i - 1)
            elif kind == "added" and path in until:
                close(path, i)
            elif kind == "removed" and path not in until:
                begin(path, i - 1)
    for p in list(until):
        close(p, 0)
    return spans


def _texts(lines: DataFrame, paths: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``lines`` with the text at each path in a column of its own (by name). Each object is parsed once for all its fields."""
    parents: dict[str, set[str]] = {}
    for p in paths:
        while p:
            above, _, key = p.rpartition(SEP)
            parents.setdefault(above, set()).add(key)
            p = above
    names = {"": "body"}
    for above in sorted(parents, key=lambda p: (p.count(SEP) + bool(p), p)):
        keys = sorted(parents[above])
        own = [f"_t{len(names) + i}" for i in range(len(keys))]
        lines = lines.select("*", F.json_tuple(names[above], *keys).alias(*own))
        names |= {f"{above}{SEP}{k}" if above else k: c for k, c in zip(keys, own)}
    return lines, names


def projection(texts: dict[str, str], body: Column, file_name: Column, spans: list[tuple[int, int, str, bool]], files: list[str]) -> Column:
    """The field's text in each file, read from where it stood then; arrays and objects as JSON."""
    out = F.lit(None).cast("string")
    for first, end, path, objects in spans:
        value = F.col(texts[path])
        if not objects:
            value = F.when(~F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), json_path(path), "variant")).startswith("OBJECT"), value)
        out = F.when(file_name.between(files[first], files[end]), value).otherwise(out)
    return out


_READABLE = r"^\s*\{"


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(stream, raw_id, file_name, line_no, reason) of the lines that no table holds: 'null', 'unreadable' or 'no object'."""
    reason = F.when(F.col("body").isNull(), "null").when(F.try_parse_json("body").isNull(), "unreadable").when(~F.col("body").rlike(_READABLE), "no object")
    return lines.select("stream", "raw_id", "file_name", "line_no", reason.alias("reason")).filter("reason IS NOT NULL")


def _typed(text: Column, types: set[str], whole: bool) -> Column:
    """The text in the one type that all files gave it; text where they differ."""
    if types == {"boolean"}:
        return text.cast("boolean")
    if types == {"number"}:
        return text.try_cast("bigint" if whole else "double")
    return text


def unified_table(lines: DataFrame, stream: str, typed: bool = False) -> DataFrame:
    """One row per readable line of the stream, one column per field outside arrays of objects.

    Columns are named by the field's last path (dots as ``__``); a field that was renamed or moved is one
    column, one that ended keeps its column. A field that becomes an object keeps a column for the values before;
    the object's fields have their own. Values are as written; null where the file has no such field. With ``typed``,
    fields that are numbers or booleans in all files are BIGINT, DOUBLE or BOOLEAN, and a field whose type changes is
    reconciled to text. Lines that can't be read are told by ``rejected_lines``.
    """
    lines = lines.filter((F.col("stream") == stream) & F.col("file_name").isNotNull())
    sketches = Scratch(lines.sparkSession, "drift").save(field_sketches(lines), "sketches")
    changes = [tuple(r)[1:] for r in schema_changes(lines, sketches, _compare).collect()]  # schemas, not records
    files = [r[0] for r in lines.select("file_name").distinct().orderBy("file_name").collect()]
    trees: dict[str, dict[str, _Sketch]] = {f: {} for f in files}
    for f, g in sketches.select("file_name", "path", "sketch").toPandas().groupby("file_name"):  # schemas, not records
        trees[f] = _tree(g)
    fields = trees[files[-1]] if files else {}
    leaf = {p: _type(s) for p, s in fields.items() if p and EACH not in p and _type(s) != "object"}
    held = [{p for p, s in trees[f].items() if p and EACH not in p and set(s.types) - {"null", "object"}} for f in files]
    spans = {p: s for p, s in field_history([c for c in changes if EACH not in c[2]], files, leaf, held).items() if s}
    readable = F.try_parse_json("body").isNotNull() & F.col("body").rlike(_READABLE)
    rows, texts = _texts(lines.filter(readable).select("raw_id", "file_name", "line_no", "body"), {x[2] for s in spans.values() for x in s})
    cols, taken = [], set()
    for p, s in sorted(spans.items()):
        c = projection(texts, F.col("body"), F.col("file_name"), s, files)
        if typed:
            seen = [trees[files[i]][path] for first, end, path, _ in s for i in range(first, end + 1) if path in trees[files[i]]]
            c = _typed(c, {t for x in seen for t in x.types if t != "null"}, all(k[0] == "i" for x in seen for k in x.kinds))
        name = re.sub(r"\W+", "__", shown(p).replace("`", ""))
        while name in taken:  # two keys that differ only in signs
            name += "_"
        taken.add(name)
        cols.append(c.alias(name))
    return rows.select("raw_id", "file_name", "line_no", *cols)

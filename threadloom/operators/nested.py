"""Deeply nested semi-structured records as related flat tables (problem 6).

Columnar shredding: every value of a record belongs to a leaf path (keys, and
``[]`` for the elements of an array) and is written to that path's column with
a repetition level (at which array it starts a new element) and a definition
level (how much of the path is there). The record's table of each repeated
ancestor is then rebuilt from the level sequences of a column below it: a
repetition level gives the index of every enclosing array, a definition level
tells elements, nulls and empty arrays apart, so rows carry their own position,
their parent element and their record.

A path may hold values of several kinds (a string here, an object there): each
kind has its own step in the path and so its own column, and no type is lost.

Definition levels count one for "present and not null", one for "is an array"
and one for "has an element": at the level of "has an element" an entry is a
null element, above it a value, below it there is no element.

Edge cases: text that is not JSON gives no rows; a JSON string that holds JSON
is opened once; null elements count in positions and give no row; the newest
row of a key counts, ties in time by the larger text; a null time is oldest;
null keys group like values; duplicate keys in an object keep the last; numbers
beyond double are kept as text; an empty table gives empty tables; other
columns are ignored; nesting deeper than ``MAX_DEPTH`` is not JSON here.
"""

from __future__ import annotations

import json
import math
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: guard against texts made to exhaust a worker; the steps of a path of this depth take about 100 MB
MAX_DEPTH = 5_000
KEY, ITEM = 0, 1


def open_json(text: str | None):
    """(value, ok): the parsed text; a string that holds JSON is opened once."""
    if not text:
        return None, False
    try:
        v = json.loads(text, parse_constant=_constant)
        if isinstance(v, str):
            try:
                inner = json.loads(v, parse_constant=_constant)
            except (ValueError, RecursionError):
                return v, True
            return inner, True
        return v, True
    except (ValueError, RecursionError):
        return None, False


def _constant(name: str):
    return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}[name]


class Node:
    """A step of the path tree of one record: what was seen below it."""

    __slots__ = ("keys", "items", "leaf", "list_seen", "object_seen")

    def __init__(self):
        self.keys: dict[str, Node] = {}
        self.items: Node | None = None
        self.leaf = self.list_seen = self.object_seen = False

    def learn(self, v, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise RecursionError
        if isinstance(v, dict):
            self.object_seen = True
            for k, x in v.items():
                self.keys.setdefault(k, Node()).learn(x, depth + 1)
        elif isinstance(v, list):
            self.list_seen = True
            if self.items is None:
                self.items = Node()
            for x in v:
                self.items.learn(x, depth + 1)
        elif v is not None:
            self.leaf = True


class Column:
    """One leaf path: its steps and the sequence of (repetition, definition, value)."""

    __slots__ = ("steps", "reps", "defs", "values")

    def __init__(self, steps: tuple):
        self.steps = steps
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.values: list = []

    def add(self, r: int, d: int, v=None) -> None:
        self.reps.append(r)
        self.defs.append(d)
        self.values.append(v)


def shred(value) -> list[Column]:
    """The columns of one record."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * MAX_DEPTH))  # Python frames; they take no C stack
    root = Node()
    root.learn(value)
    columns: dict[tuple, Column] = {}

    def column(steps: tuple) -> Column:
        c = columns.get(steps)
        if c is None:
            c = columns[steps] = Column(steps)
        return c

    def missing(node: Node, steps: tuple, r: int, d: int) -> None:
        """Nothing below this point: one entry in every column below."""
        bare = True
        if node.leaf:
            column(steps + (("=",),)).add(r, d)
            bare = False
        for k, n in node.keys.items():
            missing(n, steps + ((KEY, k),), r, d)
            bare = False
        if node.list_seen:
            missing(node.items, steps + ((ITEM,),), r, d)
            bare = False
        if bare:
            column(steps + (("0",),)).add(r, d)

    def write(v, node: Node, steps: tuple, r: int, d: int, reps: int) -> None:
        if v is None:
            return missing(node, steps, r, d)
        d += 1
        bare = True
        if node.leaf:
            bare = False
            if isinstance(v, (dict, list)):
                column(steps + (("=",),)).add(r, d)
            else:
                column(steps + (("=",),)).add(r, d + 1, v)
        for k, n in node.keys.items():
            bare = False
            if isinstance(v, dict) and k in v:
                write(v[k], n, steps + ((KEY, k),), r, d, reps)
            else:
                missing(n, steps + ((KEY, k),), r, d)
        if node.list_seen:
            bare = False
            below = steps + ((ITEM,),)
            if isinstance(v, list):
                if not v:
                    missing(node.items, below, r, d + 1)
                for i, x in enumerate(v):
                    write(x, node.items, below, r if i == 0 else reps + 1, d + 2, reps + 1)
            else:
                missing(node.items, below, r, d)
        if bare:
            column(steps + (("0",),)).add(r, d)

    write(value, root, (), 0, 0, 0)
    return list(columns.values())


def _arrays(steps: tuple) -> list[tuple[int, int]]:
    """(steps up to the element, definition level at which there is an element) of each array on a path."""
    out, present = [], 1
    for i, s in enumerate(steps):
        if s[0] == ITEM:
            out.append((i + 1, present + 2))
            present += 3
        elif s[0] == KEY:
            present += 1
    return out


def _name(steps: tuple, at: list[int] | None = None) -> str:
    """A path as text: keys joined by ".", positions (or nothing) in brackets."""
    out, n = [], 0
    for s in steps:
        if s[0] == ITEM:
            out.append("[]" if at is None else f"[{at[n]}]")
            n += 1
        elif s[0] == KEY:
            out.append(("." if out else "") + s[1])
    return "".join(out)


def elements(columns: list[Column]) -> dict[str, list[tuple[str, str, int]]]:
    """Per repeated ancestor: (node path, parent node path, position) of its non-null elements.

    One column below the ancestor is enough: its levels hold the whole structure.
    """
    chosen: dict[tuple, tuple[Column, int, int]] = {}
    for c in columns:
        for n, (upto, have) in enumerate(_arrays(c.steps), 1):
            k = c.steps[:upto]
            if k not in chosen or len(c.steps) < len(chosen[k][0].steps):
                chosen[k] = c, n, have
    out: dict[str, list] = {}
    for steps, (c, n, have) in chosen.items():
        rows = []
        at = [0] * n
        above = max((i for i, s in enumerate(steps[:-1], 1) if s[0] == ITEM), default=0)
        for r, d in zip(c.reps, c.defs):
            if r > n:
                continue  # a deeper array goes on inside this element
            if r:
                at[r - 1] += 1
                for i in range(r, n):
                    at[i] = 0
            if d > have:
                rows.append((_name(steps, at), _name(steps[:above], at), at[-1]))
        out[_name(steps)] = rows
    return out


def fields(columns: list[Column]) -> dict[tuple[str, str], dict[str, str]]:
    """Per (table path, node path): the scalar fields of the element, as JSON texts by key path."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for c in columns:
        if c.steps[-1] != ("=",):
            continue
        arrays = _arrays(c.steps)
        n = len(arrays)
        steps = c.steps[: arrays[-1][0]] if n else ()
        rest = c.steps[len(steps) : -1]
        name, table = _name(rest) or "value", _name(steps)
        full = 1 + sum(3 if s[0] == ITEM else 1 for s in c.steps[:-1]) + 1
        at = [0] * n
        for r, d, v in zip(c.reps, c.defs, c.values):
            if r:
                at[r - 1] += 1
                for i in range(r, n):
                    at[i] = 0
            if d == full:
                out.setdefault((table, _name(steps, at)), {})[name] = json.dumps(v, ensure_ascii=False)
    return out


def restore(columns: list[Column]) -> list:
    """All (path, value) leaves of the record again, in order: for tests of the round trip."""
    out = []
    for c in columns:
        arrays = _arrays(c.steps)
        full = 1 + sum(3 if s[0] == ITEM else 1 for s in c.steps[:-1]) + 1
        at = [0] * len(arrays)
        for r, d, v in zip(c.reps, c.defs, c.values):
            if r:
                at[r - 1] += 1
                for i in range(r, len(at)):
                    at[i] = 0
            if c.steps[-1] == ("=",) and d == full:
                out.append((_name(c.steps[:-1], at), v))
    return sorted(out, key=lambda x: x[0])


# ---- Spark -----------------------------------------------------------------

FIELDS = ("groq_output_json", "cognitive_map_json")


def newest_payloads(payloads: DataFrame) -> DataFrame:
    """(source_node_id, batch_id, field_name, text): both JSON texts of the newest row of each key."""
    at = F.coalesce(F.col("updated_at").cast("timestamp").cast("double"), F.lit(-1e18))
    order = F.struct(at, *(F.coalesce(c, F.lit("")) for c in FIELDS))
    new = payloads.groupBy("source_node_id", "batch_id").agg(F.max_by(F.struct(*FIELDS), order).alias("p"))
    both = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(f"p.{c}").alias("text")) for c in FIELDS))
    return new.select("source_node_id", "batch_id", F.explode(both).alias("x")).select("source_node_id", "batch_id", "x.field_name", "x.text").where("text is not null")


def _shredded(text):
    v, ok = open_json(text)
    if not ok or not isinstance(v, (dict, list)):
        return None
    try:
        return shred(v)
    except RecursionError:
        return None


def _paths(batches):
    for b in batches:
        take, paths = [], []
        for i, text in enumerate(b.column(3).to_pylist()):
            cols = _shredded(text)
            if cols is None:
                continue
            # a key that holds "." or brackets can spell another path: a path comes once
            own = dict.fromkeys(r[0] for rows in elements(cols).values() for r in rows)
            paths.extend(own)
            take.extend([i] * len(own))
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(take, pa.int64())) for k in range(3)), pa.array(paths, pa.string())], names=["source_node_id", "batch_id", "field_name", "node_path"])


def element_paths(payloads: DataFrame) -> DataFrame:
    """(source_node_id, batch_id, field_name, node_path) of each non-null array element."""
    return newest_payloads(payloads).mapInArrow(_paths, "source_node_id string, batch_id string, field_name string, node_path string")


_TABLES = "source_node_id string, batch_id string, field_name string, table_path string, node_path string, parent_path string, position int, fields map<string,string>"


def _tables(batches):
    for b in batches:
        take, rows = [], []
        for i, text in enumerate(b.column(3).to_pylist()):
            cols = _shredded(text)
            if cols is None:
                continue
            f = fields(cols)
            rows.append(("", "", None, 0, f.get(("", ""), {})))
            take.append(i)
            for table, es in elements(cols).items():
                for path, parent, pos in es:
                    rows.append((table, path, parent, pos, f.get((table, path), {})))
                    take.append(i)
        t = list(zip(*rows)) if rows else [[]] * 5
        idx = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(k).take(idx) for k in range(3)), pa.array(t[0], pa.string()), pa.array(t[1], pa.string()), pa.array(t[2], pa.string()), pa.array(t[3], pa.int32()), pa.array([list(x.items()) for x in t[4]], pa.map_(pa.string(), pa.string()))],
            names=["source_node_id", "batch_id", "field_name", "table_path", "node_path", "parent_path", "position", "fields"],
        )


def flat_rows(payloads: DataFrame) -> DataFrame:
    """Rows of all flat tables: table_path names the table ("" is the record's own).

    parent_path is the node_path of the row one level up in the same record and field.
    """
    return newest_payloads(payloads).mapInArrow(_tables, _TABLES)


def flat_table(payloads: DataFrame, table_path: str, columns: list[str], field_name: str = "cognitive_map_json") -> DataFrame:
    """One level as a table: links to record and parent, position and the named scalar fields (as text)."""
    t = flat_rows(payloads).where((F.col("field_name") == field_name) & (F.col("table_path") == table_path))
    text = lambda c: F.when(F.element_at("fields", c).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.element_at("fields", c), F.lit("}")), "v string")["v"]).otherwise(F.element_at("fields", c))
    return t.select("source_node_id", "batch_id", "node_path", "parent_path", "position", *(F.when(F.map_contains_key("fields", c), text(c)).alias(c) for c in columns))

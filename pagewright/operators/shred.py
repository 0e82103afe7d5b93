"""Nested records turned into flat tables that are linked to one another.

Every record is shredded into columns: each leaf path is a sequence of values with a
repetition level (at which repeated ancestor the value repeats; 0 begins a record) and a
definition level (how many names of the path are there). All records have the columns of one
schema, which a first pass learns; a column that a record lacks has null entries. Leaf
paths with the same nearest repeated ancestor, their owner, repeat alike, so a row of the shredded table
holds an owner's columns of one record, and their repetition levels once.

Tables are reconstructed per owner from the level sequences alone: instances are numbered by
counting the entries that begin one, a child finds its parent by the parent's number, and
an instance's place is the number of entries since its parent began.

A field named in `repeated` that holds an object is taken as an array of one. Names are
compared without case and separators (blockType, BlockType and block_type are one). A repeated field
within itself (children of children) shares the columns of its owner; its paths are written name^2, name^3 and so on.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.tables import once

SHREDDED = (
    "rec_id long, owner string, owner_rep int, owner_depth int, parent string, rep array<int>, def array<int>, n array<int>, "
    "parent_n array<int>, top_n array<int>, place array<int>, columns map<string, struct<def: array<int>, value: array<string>>>"
)
#: Paths a schema may have; more mean that names of fields hold data, which should be turned into values first.
MAX_PATHS = 100_000
_DROP = re.compile(r"[\W_]+")
_NTH = re.compile(r"(.*?)(?:\^(\d+))?")


@lru_cache(maxsize=100_000)
def plain_name(name: str) -> str:
    return _DROP.sub("", name).lower()


@dataclass
class Shape:
    """What a field looks like in any record: its fields, whether it repeats, holds plain values, or holds itself."""

    fields: dict[str, Shape] = field(default_factory=dict)
    repeats: bool = False
    scalar: bool = False
    recursive: bool = False

    def rows(self, path: str = "") -> Iterator[tuple[str, bool, bool, bool]]:
        todo = [(path, self)]
        while todo:
            p, s = todo.pop()
            yield p, s.repeats, s.scalar, s.recursive
            todo += [(f"{p}.{k}" if p else k, x) for k, x in s.fields.items()]

    def pruned(self, leaves: frozenset[str] | None, owners: frozenset[str] | None, inner: str = "") -> Shape:
        """Only the columns wanted: leaves, by their path below their owner, of owners, by their last name, and what holds them."""
        out = Shape({}, self.repeats, self.scalar and (leaves is None or (inner or "value") in leaves), self.recursive)
        for k, s in self.fields.items():
            below = s.pruned(leaves, owners, "" if s.repeats else f"{inner}.{k}" if inner else k)
            if below.fields or (owners is None or k in owners if s.repeats else below.scalar):
                out.fields[k] = below
        return out

    @staticmethod
    def of_rows(rows: Iterable[tuple[str, bool, bool, bool]]) -> Shape:
        root = Shape()
        for path, repeats, scalar, recursive in sorted(rows):
            s = root
            for k in path.split(".") if path else ():
                s = s.fields.setdefault(k, Shape())
            s.repeats, s.scalar, s.recursive = s.repeats or repeats, s.scalar or scalar, s.recursive or recursive
        return root


def _slow_loads(text: str):
    """json.loads in Python alone, whose depth only memory bounds."""
    d = json.JSONDecoder()
    d.parse_object, d.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
    d.scan_once = json.scanner.py_make_scanner(d)
    return d.decode(text)


def _parse(payload: str | None):
    """The record, or None if it is no complete JSON; a record inside a string is taken out of it."""
    while isinstance(payload, str):
        if not payload.strip():
            return None
        try:
            payload = json.loads(payload)
        except RecursionError:
            try:
                payload = _slow_loads(payload)
            except ValueError:
                return None
        except ValueError:
            return None
    return payload


def _unwrapped(x, root: str) -> list[dict]:
    """The objects that have the root field, looked for inside wrappers and lists."""
    found, todo = [], [x]
    while todo:
        y = todo.pop()
        if isinstance(y, list):
            todo += reversed(y)
        elif isinstance(y, dict):
            if any(plain_name(k) == root for k in y):
                found.append(y)
            else:
                todo += [v for v in reversed(y.values()) if isinstance(v, (dict, list))]
    return found


def _learn(x, shape: Shape, repeated: frozenset[str], name: str = "") -> None:
    if isinstance(x, dict):
        for raw, v in x.items():
            k = plain_name(raw)
            if k == name and shape.repeats:
                shape.recursive, s = True, shape
            else:
                s = shape.fields.setdefault(k, Shape())
            if isinstance(v, list):
                s.repeats = True
                for y in v:
                    _learn(y, s, repeated, k)
            else:
                if k in repeated:
                    s.repeats = True
                _learn(v, s, repeated, k)
    elif x is not None and not isinstance(x, list):
        shape.scalar = True


class _Group:
    """An owner's columns of one record."""

    __slots__ = ("below", "depth", "dfn", "leaves", "outer", "owner_rep", "path", "rep")

    def __init__(self, path: str, owner_rep: int, depth: int, outer: _Group | None) -> None:
        self.path, self.owner_rep, self.depth, self.outer = path, owner_rep, depth, outer
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.leaves: dict[str, tuple[list[int], list]] = {}
        self.below: dict[tuple[str, str, bool], _Group] = {}


def _text(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, (dict, list)):
        return None
    return ("false", "true")[x] if isinstance(x, bool) else str(x)


class _Columns:
    def __init__(self) -> None:
        self.groups: dict[str, _Group] = {}

    def under(self, g: _Group, inner: str, name: str, again: bool) -> _Group:
        """The group of a repeated field below g; again: the field is g's own name."""
        found = g.below.get((inner, name, again))
        if found is None:
            if again:
                base, nth = _NTH.fullmatch(g.path).groups()
                path, names = f"{base}^{int(nth or 1) + 1}", 1
            else:
                path, names = ".".join(x for x in (g.path, inner, name) if x), inner.count(".") + 2 if inner else 1
            found = g.below[inner, name, again] = self.groups[path] = _Group(path, g.owner_rep + 1, g.depth + names, g)
        return found

    def put(self, g: _Group, leaf: str, depth: int, value) -> None:
        col = g.leaves.get(leaf)
        if col is None:
            col = g.leaves[leaf] = ([], [])
        col[0].append(depth)
        col[1].append(value)

    def absent(self, shape: Shape, g: _Group, inner: str, name: str, rep: int, depth: int, again: bool = False) -> None:
        """An entry in every column below a field that isn't there; of a field within itself, in the field's alone."""
        if shape.repeats:
            g = self.under(g, inner, name, again)
            g.rep.append(rep)
            g.dfn.append(depth)
            inner = ""
        else:
            inner = f"{inner}.{name}" if inner else name
        if shape.scalar:
            self.put(g, inner or "value", depth, None)
        for k, s in shape.fields.items():
            if not again or not s.repeats:
                self.absent(s, g, inner, k, rep, depth)
        if shape.recursive and not again:
            self.absent(shape, g, inner, name, rep, depth, True)

    def fill(self, x, shape: Shape, g: _Group, inner: str, name: str, rep: int, depth: int) -> None:
        """Entries of a value that is there; inner: its path below its owner's group."""
        if shape.scalar:
            self.put(g, inner or "value", depth, _text(x))
        have = {plain_name(k): v for k, v in x.items()} if isinstance(x, dict) else {}
        for k, s in shape.fields.items():
            v = have.get(k)
            if s.repeats:
                self.items(v, s, g, inner, k, rep, depth, False)
            elif v is None:
                self.absent(s, g, inner, k, rep, depth)
            else:
                self.fill(v, s, g, f"{inner}.{k}" if inner else k, k, rep, depth + 1)
        if shape.recursive:
            self.items(have.get(name), shape, g, "", name, rep, depth, True)

    def items(self, v, s: Shape, g: _Group, inner: str, name: str, rep: int, depth: int, again: bool) -> None:
        mine = self.under(g, inner, name, again)
        values = v if isinstance(v, list) else [] if v is None else [v]
        if not values:
            self.absent(s, g, inner, name, rep, depth, again)
        for i, y in enumerate(values):
            r = rep if i == 0 else mine.owner_rep
            if y is None:
                self.absent(s, g, inner, name, r, depth, again)
            else:
                mine.rep.append(r)
                mine.dfn.append(mine.depth)
                self.fill(y, s, mine, "", name, r, mine.depth)


def learned(payloads: Iterable[str | None], root: str, repeated: frozenset[str]) -> Shape:
    shape = Shape()
    for p in payloads:
        for x in _unwrapped(_parse(p), root):
            _learn(x, shape, repeated)
    return shape


def columns_of(payload: str | None, root: str, shape: Shape) -> list[_Group]:
    """One record's columns, by owner; none if the payload is no complete record."""
    cols = _Columns()
    for x in _unwrapped(_parse(payload), root):
        top = cols.groups.setdefault("", _Group("", 0, 0, None))
        top.rep.append(0)
        top.dfn.append(0)
        cols.fill(x, shape, top, "", "", 0, 0)
    return list(cols.groups.values())


def instances(rep: np.ndarray, dfn: np.ndarray, sizes: np.ndarray, owner_rep: np.ndarray, depth: np.ndarray, parent_rep: np.ndarray, parent_depth: np.ndarray) -> dict[str, np.ndarray]:
    """From the levels of columns laid end to end (one of each per column: size, levels of owner and parent; a parent level
    below 0 stands for no parent): n, the number of each entry's instance of the owner; parent_n, that of the owner's parent;
    top_n, that of the outermost ancestor; place, the 0-based place of the instance in its array."""
    ends = np.cumsum(sizes)
    start = np.repeat(ends - sizes, sizes)
    each = lambda x: np.repeat(x, sizes)
    owner_rep, depth, parent_rep, parent_depth = map(each, (owner_rep, depth, parent_rep, parent_depth))

    def counted(flag: np.ndarray) -> np.ndarray:
        c = np.cumsum(flag)
        return c - (c[start] - flag[start])

    entry = rep <= owner_rep
    begins = np.where(parent_rep > 0, (rep <= parent_rep) & (dfn >= parent_depth), np.arange(len(rep)) == start)
    entries = np.cumsum(entry)
    place = entries - np.maximum.accumulate(np.where(begins, entries, 0)) if len(rep) else entries
    n = {"n": counted(entry & (dfn >= depth)), "parent_n": np.where(parent_rep < 0, 0, counted(begins)), "top_n": counted((rep <= 1) & (dfn >= 1)), "place": place}
    return {k: v.astype(np.int32) for k, v in n.items()}


def _batch(records: list[tuple[int, list[_Group]]]) -> pa.RecordBatch:
    groups = [(rec, g) for rec, gs in records for g in gs]
    gs = [g for _, g in groups]
    ints = lambda xs: np.fromiter(xs, np.int32)
    sizes = ints(len(g.rep) for g in gs)
    rep, dfn = ints(x for g in gs for x in g.rep), ints(x for g in gs for x in g.dfn)
    owner_rep, depth = ints(g.owner_rep for g in gs), ints(g.depth for g in gs)
    outer = [g.outer for g in gs]
    found = instances(rep, dfn, sizes, owner_rep, depth, ints(-1 if o is None else o.owner_rep for o in outer), ints(-1 if o is None else o.depth for o in outer))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    at = {id(g): i for i, g in enumerate(gs)}
    for i, g in enumerate(gs):
        if "^" in g.path:  # below a field within itself, outermost ancestors without any have no entry: the parent knows its own
            mine = slice(offsets[i], offsets[i + 1])
            up = slice(offsets[at[id(g.outer)]], offsets[at[id(g.outer)] + 1])
            tops = np.append(found["top_n"][up][dfn[up] >= g.outer.depth], 0)
            found["top_n"][mine] = tops[found["parent_n"][mine] - 1]
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
    leaves = [(k, col) for g in gs for k, col in g.leaves.items()]
    ends = np.concatenate([[0], np.cumsum(ints(len(c[0]) for _, c in leaves))]).astype(np.int32)
    cols = pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(ends, pa.array(ints(d for _, c in leaves for d in c[0]))), pa.ListArray.from_arrays(ends, pa.array([v for _, c in leaves for v in c[1]], pa.string()))], ["def", "value"]
    )
    per = np.concatenate([[0], np.cumsum(ints(len(g.leaves) for g in gs))]).astype(np.int32)
    columns = pa.MapArray.from_arrays(per, pa.array([k for k, _ in leaves], pa.string()), cols)
    parent = pa.array([None if o is None else o.path for o in outer], pa.string())
    arrays = [pa.array([rec for rec, _ in groups], pa.int64()), pa.array([g.path for g in gs], pa.string()), pa.array(owner_rep), pa.array(depth), parent, listed(rep), listed(dfn)]
    arrays += [listed(found[k]) for k in ("n", "parent_n", "top_n", "place")] + [columns]
    return pa.RecordBatch.from_arrays(arrays, ["rec_id", "owner", "owner_rep", "owner_depth", "parent", "rep", "def", "n", "parent_n", "top_n", "place", "columns"])


def _deep() -> None:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))  # calls between Python functions take memory, no stack


def schema_of(records: DataFrame, root: str, repeated: Iterable[str]) -> Shape:
    """The shape of all records. A task sends each path it meets once; the paths, not the records, are gathered, and
    more than MAX_PATHS of them are an error."""
    names, base = frozenset(map(plain_name, repeated)), plain_name(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        shape = Shape()
        for b in batches:
            for p in b.column(0).to_pylist():
                for x in _unwrapped(_parse(p), base):
                    _learn(x, shape, names)
        rows = list(shape.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.bool_()) for i in (1, 2, 3)]], ["path", "repeats", "scalar", "recursive"])

    paths = records.where("payload is not null").select("payload").mapInArrow(run, "path string, repeats boolean, scalar boolean, recursive boolean")
    got = paths.distinct().limit(8 * MAX_PATHS + 1).collect()
    if len({r.path for r in got}) > MAX_PATHS:
        raise ValueError(f"the records have more than {MAX_PATHS} paths")
    return Shape.of_rows(tuple(r) for r in got)


def shred(records: DataFrame, root: str, repeated: Iterable[str], leaves: Iterable[str] | None = None, owners: Iterable[str] | None = None, shape: Shape | None = None) -> DataFrame:
    """rec_id, payload -> a row for each record and owner (see SHREDDED); owner '' is the record itself.

    root: the field by which the record is known inside wrappers; leaves: only these columns of each owner;
    owners: only those with these last names, and their ancestors; shape: the schema, if it is known. Records that are null, empty or cut off have no rows, however
    deep they nest the others have all; a rec_id that is repeated is one record; further columns are ignored."""
    base = plain_name(root)
    shape = schema_of(records, root, repeated) if shape is None else shape
    plan = list(shape.pruned(None if leaves is None else frozenset(leaves), None if owners is None else frozenset(owners)).rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        schema = Shape.of_rows(plan)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [(rec, columns_of(p, base, schema)) for rec, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield _batch(got)

    one = once(records.where("payload is not null and rec_id is not null").select("rec_id", "payload"), "rec_id")
    return one.mapInArrow(run, SHREDDED)


def last_name() -> Column:
    return F.regexp_extract("owner", r"([^.^]*)(\^\d+)?$", 1)


def there(values: Column | None = None) -> Column:
    """Of a row of the shredded table, the values (an array beside the levels) of the instances that are there; the
    instance with number n is its n-th."""
    z = F.arrays_zip(F.col("def").alias("d"), (F.col("n") if values is None else values).alias("v"))
    return F.transform(F.filter(z, lambda x: x["d"] >= F.col("owner_depth")), lambda x: x["v"])


def column(leaf: str) -> Column:
    """A leaf's values of a row; all null where the schema has no such column."""
    return F.coalesce(F.col("columns")[leaf]["value"], F.array_repeat(F.lit(None).cast("string"), F.size("n")))


def flat_table(shredded: DataFrame, last_names: Iterable[str], fields: dict[str, str]) -> DataFrame:
    """One table for every owner whose last name is given: rec_id, path, n, parent_path, parent_n, top_n, place and a
    column for each of `fields` (leaf -> column name)."""
    z = F.arrays_zip("n", "parent_n", "top_n", "place", "def", *[column(k).alias(v) for k, v in fields.items()])
    mine = shredded.where(last_name().isin(*last_names)).select("rec_id", F.col("owner").alias("path"), "owner_depth", F.col("parent").alias("parent_path"), F.inline(z))
    mine = mine.where(F.col("def") >= F.col("owner_depth"))
    return mine.select("rec_id", "path", "n", "parent_path", "parent_n", "top_n", "place", *fields.values())


def every_table(shredded: DataFrame) -> DataFrame:
    """A row for each instance of every owner, the record itself (path '') included: rec_id, path, n, parent_path,
    parent_n, place and fields, a map of all its leaves, null where a value isn't there."""
    values = F.transform(F.sequence(F.lit(0), F.size("n") - 1), lambda i: F.transform_values("columns", lambda k, c: c["value"][i]))
    z = F.arrays_zip("n", "parent_n", "place", "def", values.alias("fields"))
    rows = shredded.where(F.size("n") > 0).select("rec_id", F.col("owner").alias("path"), "owner_depth", F.col("parent").alias("parent_path"), F.inline(z))
    return rows.where(F.col("def") >= F.col("owner_depth")).select("rec_id", "path", "n", "parent_path", "parent_n", "place", "fields")

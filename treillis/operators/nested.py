"""Problem 7: deeply nested semi-structured records as related flat tables.

A merged schema is inferred from the shapes at every path of all records: an array anywhere makes the path
an array, else an object makes it an object. Records are brought to that schema (a lone object becomes an
array of one, a text in place of an array or object the JSON it holds), read by it inside the JVM, and
every array level is exploded into a child table with the key of its record, the place of its parent
and its own place.

Defined cases: a byte order mark before a record is ignored; a line that isn't complete JSON or has no
object with the identifying field has no children; null entries are counted in the places and give no row;
an object of more than WIDE names is a text;
a text that isn't JSON in place of an array or object counts as missing; repeated names in an object: the last counts;
columns other than those named are not read.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treillis.session import bound_arrow_batches

#: Most paths a merged schema may have, and most names an object may have over all records: an object with more is keyed
#: by data, not by fields, and stays one value, as the JSON text of it.
MOST_PATHS, WIDE = 10_000, 1_000


def _parsed(text: str):
    """What a text holds as JSON if that is an array or object, else None."""
    text = text.lstrip("﻿ \t\r\n")
    if text[:1] not in ("{", "["):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def locate(text: str | None, field: str) -> dict | None:
    """The object that holds the field, at whatever depth; the outermost and first if several do."""
    level = [_parsed(text)] if text is not None else []
    while level:
        below = []
        for node in level:
            if isinstance(node, str):
                node = _parsed(node)
            if isinstance(node, dict):
                if field in node:
                    return node
                below.extend(node.values())
            elif isinstance(node, list):
                below.extend(node)
        level = below
    return None


def _shape(value) -> str:
    if isinstance(value, str):
        held = _parsed(value)
        return "text" if held is None else f"held {_shape(held)}"
    return {bool: "boolean", int: "bigint", float: "double", list: "array", dict: "object", type(None): "null"}[type(value)]


def _shapes(value, path: str, out: dict[str, set[str]], names: dict[str, set[str]]) -> None:
    """Adds the shapes at each path to ``out`` and the names of each object to ``names``; of a wide object its shape only."""
    shape = _shape(value)
    out.setdefault(path, set()).add(shape)
    if shape.startswith("held "):
        value = _parsed(value)
    if isinstance(value, dict):
        mine = names.setdefault(path, set())
        if len(mine) <= WIDE:
            mine.update(value)
        if len(mine) <= WIDE:
            for k, v in value.items():
                _shapes(v, f"{path}\x1f{k}", out, names)
    elif isinstance(value, list):
        for v in value:
            _shapes(v, path + "\x1f", out, names)


def _narrowed(shapes: dict[str, set[str]]) -> dict[str, set[str]]:
    """The shapes without what lies below wide objects, which become texts."""
    names: dict[str, set[str]] = {}
    for path in shapes:
        up, _, name = path.rpartition("\x1f")
        if name and path:
            names.setdefault(up, set()).add(name)
    wide = {p for p, n in names.items() if len(n) > WIDE} | {p for p, s in shapes.items() if "wide" in s}
    under = lambda p: any(p[:k] in wide for k in range(len(p)) if p[k] == "\x1f")
    return {p: ({"text"} if p in wide else s) for p, s in shapes.items() if not under(p)}


def infer(lines: DataFrame, column: str, field: str) -> dict[str, set[str]]:
    """The shapes at each path of the located records, over all of them; few rows whatever their number."""
    bound_arrow_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[str]] = {}
        names: dict[str, set[str]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                record = locate(text, field)
                if record is not None:
                    _shapes(record, "", seen, names)
            for path in [p for p, n in names.items() if len(n) > WIDE]:
                seen[path].add("wide")
                for p in [p for p in seen if p.startswith(path + "\x1f")]:
                    del seen[p]
        rows = [(p, s) for p, shapes in seen.items() for s in shapes]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["chemin", "forme"])

    rows = lines.select(column).mapInArrow(run, "chemin string, forme string").distinct().limit(8 * MOST_PATHS + 1).collect()
    if len(rows) > 8 * MOST_PATHS:
        raise ValueError("the records have too many paths for one schema")
    shapes: dict[str, set[str]] = {}
    for path, shape in rows:
        shapes.setdefault(path, set()).add(shape)
    return _narrowed(shapes)


def merged_schema(shapes: dict[str, set[str]], path: str = "") -> T.DataType:
    """The type at a path: array before object before scalar, scalars widened."""
    here = {s.removeprefix("held ") for s in shapes.get(path, ())} - {"null"}
    if "array" in here:
        inner = dict(shapes)
        if "object" in here:  # lone objects have their fields one level higher
            for p, s in shapes.items():
                if p.startswith(path + "\x1f") and p[len(path) + 1 :] and not p.startswith(path + "\x1f\x1f"):
                    moved = f"{path}\x1f{p[len(path):]}"
                    inner[moved] = inner.get(moved, set()) | s
            inner[path + "\x1f"] = inner.get(path + "\x1f", set()) | {"object"}
        return T.ArrayType(merged_schema(inner, path + "\x1f"))
    if "object" in here:
        names = sorted({p[len(path) + 1 :].split("\x1f", 1)[0] for p in shapes if p.startswith(path + "\x1f")} - {""})
        return T.StructType([T.StructField(n, merged_schema(shapes, f"{path}\x1f{n}")) for n in names])
    if here == {"boolean"}:
        return T.BooleanType()
    if here and here <= {"bigint"}:
        return T.LongType()
    if here and here <= {"bigint", "double"}:
        return T.DoubleType()
    return T.StringType()


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """Two schemas as one: fields of both, the first's type where scalars differ."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        more = {f.name: f for f in b.fields}
        own = [T.StructField(f.name, merge_types(f.dataType, more[f.name].dataType) if f.name in more else f.dataType) for f in a.fields]
        return T.StructType(own + [f for f in b.fields if f.name not in a.names])
    if isinstance(a, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType if isinstance(b, T.ArrayType) else b))
    return a


def conform(value, kind: T.DataType):
    """A value brought to a type of the merged schema."""
    if isinstance(kind, (T.ArrayType, T.StructType)) and isinstance(value, str):
        value = _parsed(value)
    if isinstance(kind, T.ArrayType):
        if isinstance(value, dict):
            value = [value]
        return [conform(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StructType):
        return {f.name: conform(value[f.name], f.dataType) for f in kind.fields if f.name in value} if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf") else None


def read_records(lines: DataFrame, key: str, column: str, field: str, schema: T.StructType) -> DataFrame:
    """``key`` and the fields of the schema for every line that holds a record."""
    bound_arrow_batches(lines.sparkSession)
    kind = lines.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [locate(t, field) for t in batch.column(1).to_pylist()]
            text = [None if r is None else json.dumps(conform(r, schema), ensure_ascii=False) for r in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[key, "_json"]).filter(pa.array([t is not None for t in text], pa.bool_()))

    read = lines.select(key, column).mapInArrow(run, f"`{key}` {kind}, _json string").select(key, F.from_json("_json", schema).alias("_r"))
    # A record whose own field has the name of the key keeps it under another one.
    return read.select(key, *[F.col(f"_r.`{n}`").alias(n if n != key else f"_{n}") for n in schema.names])


def child_arrays(schema: T.StructType, keys: tuple[str, ...]) -> list[tuple[str, Column]]:
    """Path and column of every array of a record, through structs."""
    out: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, column: Column) -> None:
        if isinstance(kind, T.ArrayType):
            out.append((path, column))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", column.getField(f.name))

    for f in schema.fields:
        if f.name not in keys:
            walk(f.dataType, f.name, F.col(f"`{f.name}`"))
    return out


def flatten(records: DataFrame, key: str) -> dict[str, DataFrame]:
    """The record table (path '') and a table for each array, at every level.

    A child has ``key``, ``rang`` (its place), the fields of its entry, and, below another child, ``parent``
    (the places on the way down)."""
    flat: list[Column] = []

    def scalars(kind: T.DataType, name: str, column: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                scalars(f.dataType, f"{name}_{f.name}" if name else f.name, column.getField(f.name) if name else F.col(f"`{f.name}`"))
        elif not isinstance(kind, T.ArrayType):
            flat.append(column.alias(name))

    scalars(records.schema, "", F.lit(None))
    tables = {"": records.select(*flat)}

    def below(frame: DataFrame, path: str, column: Column, kind: T.ArrayType) -> None:
        entry = frame.select(key, "_p", F.posexplode(column).alias("rang", "_e")).filter("_e is not null")
        here: list[Column] = []
        inner: list[tuple[str, Column, T.ArrayType]] = []

        def fields(k: T.DataType, name: str, c: Column) -> None:
            if isinstance(k, T.StructType):
                for f in k.fields:
                    fields(f.dataType, f"{name}_{f.name}" if name else f.name, c.getField(f.name))
            elif isinstance(k, T.ArrayType):
                inner.append((f"{path}.{name}" if name else f"{path}[]", c, k))
            else:
                here.append(c.alias(name or "valeur"))

        fields(kind.elementType, "", F.col("_e"))
        tables[path] = entry.select(key, F.col("_p").alias("parent"), "rang", *here)
        for p, c, k in inner:
            below(entry.withColumn("_p", F.concat("_p", F.array("rang"))), p, c, k)

    for path, column in child_arrays(records.schema, (key,)):
        kind = records.select(column.alias("x")).schema["x"].dataType
        below(records.withColumn("_p", F.array().cast("array<int>")), path, column, kind)
    return tables


def child_places(records: DataFrame, key: str) -> DataFrame:
    """``key``, ``tableau`` (path), ``parent`` (the places on the way down) and ``rang`` of each child of every level, in one pass.

    The arrays are those of the merged schema, walked as flatten() does; these are the keys of its child tables."""
    place = "struct<tableau:string, parent:array<int>, rang:int>"

    def below(path: str, column: Column, kind: T.ArrayType, parent: Column) -> list[Column]:
        own = F.transform(column, lambda e, i: F.when(e.isNotNull(), F.struct(F.lit(path).alias("tableau"), parent.alias("parent"), i.alias("rang"))))
        out = [F.coalesce(own.cast(f"array<{place}>"), F.array().cast(f"array<{place}>"))]

        def fields(k: T.DataType, name: str, of) -> None:
            if isinstance(k, T.StructType):
                for f in k.fields:
                    fields(f.dataType, f"{name}.{f.name}", lambda e, of=of, f=f: of(e).getField(f.name))
            elif isinstance(k, T.ArrayType):
                inner = F.transform(column, lambda e, i: F.concat(*below(f"{path}{name or '[]'}", of(e), k, F.concat(parent, F.array(i)))))
                out.append(F.coalesce(F.flatten(inner), F.array().cast(f"array<{place}>")))

        fields(kind.elementType, "", lambda e: e)
        return out

    every: list[Column] = []
    for path, column in child_arrays(records.schema, (key,)):
        every += below(path, column, records.select(column.alias("x")).schema["x"].dataType, F.array().cast("array<int>"))
    if not every:
        return records.select(key, F.lit("").alias("tableau"), F.array().cast("array<int>").alias("parent"), F.lit(0).alias("rang")).limit(0)
    return records.select(key, F.explode(F.concat(*every)).alias("x")).filter("x is not null").select(key, "x.tableau", "x.parent", "x.rang")


#: The arrays of a collected record.
RECORD_ARRAYS = ["H", "TRT", "SST", "raffinements", "diagnostic_singulier.H"]


def collected(loaded: DataFrame, lines: DataFrame, key: str = "enr_id", column: str = "brut", field: str = "terme") -> tuple[DataFrame, DataFrame]:
    """Loaded records, and those of raw lines under the merged schema of both."""
    own = T.StructType([f for f in loaded.schema.fields if f.name not in (key, "recu_ts")])
    inferred = merged_schema(infer(lines, column, field))
    schema = merge_types(own, inferred if isinstance(inferred, T.StructType) else T.StructType([]))
    return loaded.drop("recu_ts"), read_records(lines, key, column, field, schema)


def all_children(loaded: DataFrame, lines: DataFrame) -> DataFrame:
    """The children of loaded and raw records that stand in the arrays of a collected record."""
    places = [child_places(r, "enr_id").filter(F.col("tableau").isin(RECORD_ARRAYS)) for r in collected(loaded, lines)]
    return reduce(DataFrame.union, places).select("enr_id", "tableau", "rang")


def all_tables(loaded: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of loaded and raw records together."""
    first, second = (flatten(r, "enr_id") for r in collected(loaded, lines))
    tables = {}
    for path in dict.fromkeys([*first, *second]):
        both = [t[path] for t in (first, second) if path in t]
        tables[path] = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), both)
    return tables

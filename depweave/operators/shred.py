"""Nested JSON bodies into flat tables that keep parent-child links.

Adjacency-table shredding. ``shred`` stores every value of a body as a row
(node, parent, label, ordinal, kind, scalar), whatever its field: nothing is
chosen before the table is written. ``entities`` joins the object nodes with
their scalar children, which are pivoted into columns; ``link`` walks from child
to parent by joins on (record, node). ``rebuild`` puts a document together again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import materialize

ADJACENCY = "node int, parent int, label string, ordinal int, kind string, scalar string"
KINDS = ("object", "array", "string", "number", "boolean", "null", "lone")
_OBJECT, _ARRAY, _STRING, _NUMBER, _BOOLEAN, _NULL, _LONE = range(len(KINDS))


def find_list(doc: object, label: str, lone: Sequence[str]) -> tuple[object, object]:
    """(owner, entries) of the ``label`` list: the document itself, a field of it, or a field of an enveloping object.

    Envelopes are searched breadth first and only through objects, so lists
    of other things are never entered. A document that is itself one entry
    (it has a field of ``lone``) is a list of one without an owner.
    """
    if isinstance(doc, list):
        return None, doc
    level = [doc]
    while level:
        for x in level:
            if isinstance(x, dict) and label in x:
                return x, x[label]
        level = [v for x in level if isinstance(x, dict) for v in x.values() if isinstance(v, dict)]
    if isinstance(doc, dict) and any(c in doc for c in lone):
        return None, doc
    return None, None


class Rows:
    """Columns of adjacency rows as they are collected; ``kind`` holds indices into ``KINDS``."""

    def __init__(self) -> None:
        self.node: list[int] = []
        self.parent: list[int] = []
        self.label: list[str] = []
        self.ordinal: list[int | None] = []
        self.kind: list[int] = []
        self.scalar: list[str | None] = []

    def __len__(self) -> int:
        return len(self.node)

    def tuples(self) -> Iterator[tuple]:
        return zip(self.node, self.parent, self.label, self.ordinal, [KINDS[k] for k in self.kind], self.scalar)


def _told(v: object) -> tuple[int, str | None]:
    """Kind and text of a value that is no object and no list."""
    if v is True:
        return _BOOLEAN, "true"
    if v is False:
        return _BOOLEAN, "false"
    if v is None:
        return _NULL, "null"
    return (_STRING, v) if type(v) is str else (_NUMBER, str(v) if type(v) is int else json.dumps(v))


def adjacency(doc: object, label: str, lone: Sequence[str], out: Rows | None = None) -> Rows:
    """Rows (node, parent, label, ordinal, kind, scalar) of one decoded document, one for every value in it, added to ``out``.

    ``kind`` is object, array, string, number, boolean or null; ``scalar`` is
    the text of the last four. Entries of a list are children of the object
    whose field it is, with their place as ordinal; a value that is no entry has
    none. A list has a row of its own only if it is empty, lies in another list,
    or is the document. The object that owns the ``label`` list is node 0; a
    document that is the list, or one entry of it, has entries of that label
    under a node 0 of kind array, or lone. The root's parent is -1.
    """
    out = Rows() if out is None else out
    nodes, put_parent, put_label, put_ordinal, put_kind, put_scalar = out.node, out.parent.append, out.label.append, out.ordinal.append, out.kind.append, out.scalar.append
    base = len(nodes)
    owner, entries = find_list(doc, label, lone)
    owner_at = -1

    def row(parent: int, name: str, ordinal: int | None, kind: int, scalar: str | None) -> None:
        put_parent(parent)
        put_label(name)
        put_ordinal(ordinal)
        put_kind(kind)
        put_scalar(scalar)

    stack: list[tuple[object, int, str, int | None]] = []
    count = 0
    if owner is None and entries is not None:
        whole = isinstance(doc, list)
        row(-1, "", None, _ARRAY if whole else _LONE, None)
        owner_at, count = 0, 1
        stack = [(v, 0, label, i) for i, v in (enumerate(doc) if whole else [(None, doc)])]
        stack.reverse()
    else:
        stack.append((doc, -1, "", None))
    # a row's node is its place among the document's rows, the owner's apart
    while stack:
        value, parent, name, ordinal = stack.pop()
        kind = type(value)
        if kind is dict:
            if value is owner:
                owner_at, node = count, 0
            else:
                node = count + 1
            row(parent, name, ordinal, _OBJECT, None)
            fields = value.items()
        elif kind is list:
            node = count + 1
            row(parent, name, ordinal, _ARRAY, None)
            fields = [("", value)] if value else ()
        else:
            row(parent, name, ordinal, *_told(value))
            fields = ()
        count += 1
        for k, v in fields:
            t = type(v)
            if t is dict:
                stack.append((v, node, k, None))
            elif t is list:
                if not v:
                    row(node, k, None, _ARRAY, None)
                    count += 1
                for i, x in enumerate(v):
                    if type(x) is str:
                        row(node, k, i, _STRING, x)
                        count += 1
                    else:
                        stack.append((x, node, k, i))
            else:
                put_parent(node)
                put_label(k)
                put_ordinal(None)
                if t is str:
                    put_kind(_STRING)
                    put_scalar(v)
                else:
                    what, text = _told(v)
                    put_kind(what)
                    put_scalar(text)
                count += 1
    nodes.extend(range(1, count + 1))
    if owner_at >= 0:
        nodes[base + owner_at] = 0
    return out


def rebuild(rows: Iterable[Sequence]) -> object:
    """The document whose adjacency rows (in any order) these are; fields come in the order of their nodes."""
    below: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r[0], -1 if r[3] is None else r[3])):
        below.setdefault(r[1], []).append(r)

    def value(r: Sequence) -> object:
        node, kind, scalar = r[0], r[4], r[5]
        own = below.get(node, ())
        if kind == "string":
            return scalar
        if kind in ("number", "boolean", "null"):
            return json.loads(scalar)
        if kind == "lone":
            return value(own[0])
        if kind == "array":
            return [value(c) for c in sorted(own, key=lambda c: c[3])]
        out: dict = {}
        lists: dict[str, list] = {}
        for c in own:
            if c[3] is None:
                out[c[2]] = value(c)
            else:
                lists.setdefault(c[2], []).append(c)
        return out | {k: [value(c) for c in sorted(v, key=lambda c: c[3])] for k, v in lists.items()}

    return value(below[-1][0])


def decode(body: str | None) -> object:
    """The document, or None for a null, empty or unreadable body (RFC 8259; a byte order mark is passed over)."""
    if not body:
        return None
    try:
        return json.loads(body[1:] if body[0] == "\ufeff" else body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def _no_constant(x: str) -> None:
    raise ValueError(x)


#: Where the graph documents keep their modules, and what tells a module that is the whole document.
MODULES = ("modules", ("source", "dependencies"))


def shred(df: DataFrame, record: str, body: str, label: str = MODULES[0], lone: Sequence[str] = MODULES[1], rows_per_batch: int = 200_000) -> DataFrame:
    """(record, node, parent, label, ordinal, kind, scalar) of every value of every readable body, see ``adjacency``.

    Null, empty and unreadable bodies give nothing (documents nested deeper
    than Python's JSON decoder follows count as unreadable). Strings that hold
    a lone surrogate get U+FFFD in its place. Of a field named twice in one
    object the last holds.
    """
    kind = df.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            rows, at = Rows(), []
            for k in range(batch.num_rows):
                doc = decode(bodies[k].as_py())
                if doc is None:
                    continue
                adjacency(doc, label, lone, rows)
                at += [k] * (len(rows) - len(at))
                if len(rows) >= rows_per_batch:
                    yield _batch(ids, at, rows)
                    rows, at = Rows(), []
            if len(rows):
                yield _batch(ids, at, rows)

    return df.select(F.col(record).alias("record"), F.col(body).alias("body")).mapInArrow(run, f"record {kind}, {ADJACENCY}")


def _batch(ids: pa.Array, at: list[int], rows: Rows) -> pa.RecordBatch:
    i32 = pa.int32()
    kinds = pa.DictionaryArray.from_arrays(pa.array(rows.kind, pa.int8()), pa.array(KINDS)).cast(pa.string())
    cols = [ids.take(pa.array(at, i32)), pa.array(rows.node, i32), pa.array(rows.parent, i32), _text(rows.label), pa.array(rows.ordinal, i32), kinds, _text(rows.scalar)]
    return pa.RecordBatch.from_arrays(cols, names=["record", "node", "parent", "label", "ordinal", "kind", "scalar"])


def _entries(value: object) -> Iterable[tuple[int, object]]:
    """Entries of a list with their places; a lone entry in its place."""
    return () if value is None else enumerate(value) if isinstance(value, list) else ((0, value),)


def _text_of(entry: object, field: str) -> str | None:
    v = entry.get(field) if isinstance(entry, dict) else entry
    return v if isinstance(v, str) else None


def edge_rows(doc: object) -> Iterator[tuple[str | None, int, str | None, str | None]]:
    """(source, ord, resolved, module) of one decoded document's dependencies; absent fields are None."""
    for _, m in _entries(find_list(doc, *MODULES)[1]):
        if isinstance(m, dict):
            for i, x in _entries(m.get("dependencies")):
                if isinstance(x, (dict, str)):
                    yield _text_of(m, "source"), i, _text_of(x, "resolved"), _text_of(x, "module") if isinstance(x, dict) else None


def document_edges(df: DataFrame, body: str, rows_per_batch: int = 200_000) -> DataFrame:
    """(source, ord, resolved, module) of every readable body, whatever its envelope.

    Bodies are read as by ``shred``: lists of one may be written as their
    entry and entries as their name, null entries keep their place but give no
    row, unreadable bodies give nothing. A body's rows are put together where
    it is decoded, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for b in batch.column(0):
                doc = decode(b.as_py())
                if doc is None:
                    continue
                for row in edge_rows(doc):
                    rows.append(row)
                    if len(rows) >= rows_per_batch:
                        yield _edge_batch(rows)
                        rows = []
            if rows:
                yield _edge_batch(rows)

    return df.select(F.col(body).alias("body")).mapInArrow(run, "source string, ord bigint, resolved string, module string")


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    source, at, resolved, module = zip(*rows)
    return pa.RecordBatch.from_arrays([_text(source), pa.array(at, pa.int64()), _text(resolved), _text(module)], names=["source", "ord", "resolved", "module"])


def _text(values: Sequence[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([s and s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for s in values], pa.string())


def entities(nodes: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """Entries of the lists ``labels`` with the scalar field that names them: (record, node, parent, label, ordinal, ``name``).

    ``nodes`` is an adjacency table partitioned by ``part``, see ``stored``. An
    entry that is a string is its own name; other scalars and lists are no
    entries; a naming field that is no string counts as absent. A lone entry
    has the ordinal 0.
    """
    own = F.when(F.col("kind") == "string", F.col("scalar")).alias("own_")
    objects = nodes.where(F.col("part").isin(list(labels)) & F.col("kind").isin("object", "string")).select("record", "node", "parent", "label", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), own)
    leaves = nodes.where((F.col("part") == name) & (F.col("kind") == "string") & F.col("ordinal").isNull()).select("record", F.col("parent").alias("node"), "label", "scalar")
    wide = leaves.groupBy("record", "node").pivot("label", [name]).agg(F.first("scalar"))
    return objects.join(wide, ["record", "node"], "left").select("record", "node", "parent", "label", "ordinal", F.coalesce("own_", name).alias(name))


def stored(df: DataFrame, record: str, body: str, labels: Sequence[str]) -> DataFrame:
    """The adjacency table of all values, written once; ``part`` parts its files by ``labels``, so a reader of some opens no others."""
    part = F.when(F.col("label").isin(list(labels)), F.col("label")).otherwise("")
    return materialize(shred(df, record, body).withColumn("part", part), "adjacency", by="part")


def link(child: DataFrame, parent: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """The child table with columns ``keep`` of each row's parent, named with ``prefix``."""
    up = parent.select("record", F.col("node").alias("parent"), *[F.col(c).alias(prefix + c) for c in keep])
    return child.join(up, ["record", "parent"])


@dataclass
class GraphTables:
    """Flat tables of the graph documents; each row has its own and its ancestors' ordinals."""

    modules: DataFrame
    dependencies: DataFrame
    items: DataFrame

    @property
    def rules(self) -> DataFrame:
        return self.items.where("label = 'rules'")

    @property
    def cycles(self) -> DataFrame:
        return self.items.where("label = 'cycle'")

    def named(self) -> DataFrame:
        """One row per named entry: (record, kind, module_ord, dep_ord, item_ord, name)."""
        none = F.lit(-1)
        kind = F.when(F.col("label") == "rules", "rule").otherwise("cycle")
        out = self.modules.select("record", F.lit("module").alias("kind"), F.col("ordinal").alias("module_ord"), none.alias("dep_ord"), none.alias("item_ord"), F.col("source").alias("name"))
        out = out.unionByName(self.dependencies.select("record", F.lit("dependency").alias("kind"), "module_ord", F.col("ordinal").alias("dep_ord"), none.alias("item_ord"), F.col("resolved").alias("name")))
        out = out.unionByName(self.items.select("record", kind.alias("kind"), "module_ord", "dep_ord", F.col("ordinal").alias("item_ord"), "name"))
        return out.where("name is not null and name != ''")


def graph_tables(df: DataFrame, record: str, body: str) -> GraphTables:
    """Shred graph documents into module, dependency, rule and cycle tables.

    An entry that is no object and no string gives no row but keeps its
    place; an empty name counts as none. Entries without a name stay in the
    tables (their children need them) with a null name.
    """
    nodes = stored(df, record, body, ("modules", "source", "dependencies", "resolved", "rules", "cycle", "name"))
    # node 0 owns the list of modules: lists of that name elsewhere are other things
    modules = entities(nodes, ["modules"], "source").where("parent = 0")
    deps = link(entities(nodes, ["dependencies"], "resolved"), modules, "module_", ["ordinal", "source"]).withColumnRenamed("module_ordinal", "module_ord")
    items = link(entities(nodes, ["rules", "cycle"], "name"), deps, "dep_", ["ordinal", "module_ord", "resolved"]).withColumnRenamed("dep_ordinal", "dep_ord").withColumnRenamed("dep_module_ord", "module_ord")
    return GraphTables(modules, deps, items)

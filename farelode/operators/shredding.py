"""Deeply nested, loosely typed JSON records as related flat tables, by shared inlining.

Three steps:

1. ``schema_graph``: every document is walked once and yields the edges of its schema graph - parent element, child
   element, and how the child occurs there (repeated in a list, nested in itself). The edges are folded per batch and
   then by a distributed aggregation, so what reaches the driver is one row per distinct edge.
2. ``inline_plan``: elements that are repeated, that are shared (have several parents) or that take part in a cycle
   become tables of their own. All other descendants are inlined into the nearest such ancestor. An object whose members
   are named by data (ids, dates) would make an element of every id: ``document_plan`` finds such maps by the number of
   their members and walks again with all members of a map as one repeated element, ``<map>.entries``.
3. ``shred``: every document is walked again and yields the rows of these tables. A row has its table, the key of its
   document, its own key and its parent's key, its ordinal in its list and its inlined values. Keys are paths of
   ordinals (the hash of the path where it is long), so a foreign key needs no join and a repeated task gives the same
   keys.

All walks are iterative, also the reading of text that is too deep for the standard parser: no depth loses a document.
``rejected_documents`` lists those that are no JSON records at all.

Element names are compared without case and separators (``penaltyTiers`` = ``penalty_tiers`` = ``Penalty-Tiers``).
Text that encodes an object or a list counts as what it encodes, at any depth. Text that starts like an object or a list
but is not valid JSON (NaN and Infinity are not) is no element.

Reading JSON of unknown shape needs an imperative walk; it runs in Arrow batches (``mapInPandas``) without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelode.tables import durable

ROOT = "document"
ITEM = "item"  # the elements of a list that stands directly in a list, or of a document that is a list
EDGE_SCHEMA = "parent string, child string, repeated boolean, recursive boolean, documents bigint"
ROW_SCHEMA = "doc_key bigint, table_name string, row_key string, parent_table string, parent_key string, ordinal int, numbers map<string,int>, path string, fields map<string,string>, is_empty boolean"
MAP_MEMBERS = 1_000  # an element with more members of nested or repeated values is a map, and their names are data
LONG_KEY = 200  # characters of a path from which on its hash stands for it
_WORD = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def element_name(name: str) -> str:
    """The spelling of an element name that all its variants share: lower case words joined by one underscore."""
    return "_".join(_WORD.findall(_HUMP.sub("_", name))).lower() or "_"


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"null|true|false|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


def _member(text: str, at: int) -> tuple[str, int]:
    """The name of an object's member and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError("a member has no name")
    name, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("a member has no value")
    return name, _SPACE.match(text, at + 1).end()


def _loads_deep(text: str) -> object:
    """JSON of any depth, with an own stack."""
    boxes: list[dict | list] = []
    names: list[str | None] = []
    at = _SPACE.match(text, 0).end()
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                boxes.append(box)
                name, at = _member(text, at) if c == "{" else (None, at)
                names.append(name)
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _PLAIN.match(text, at)
            if m is None:
                raise ValueError("no value")
            value, at = json.loads(m[0]), m.end()
        while True:  # the value is complete, and with it perhaps what it stands in
            at = _SPACE.match(text, at).end()
            if not boxes:
                if at != len(text):
                    raise ValueError("text behind the value")
                return value
            box, c = boxes[-1], text[at : at + 1]
            if isinstance(box, dict):
                box[names[-1]] = value
            else:
                box.append(value)
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(box, dict):
                    names[-1], at = _member(text, at)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not closed")
            value, at = boxes.pop(), at + 1
            names.pop()


def _loads(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _loads_deep(text)


def _dumps(value: object) -> str:
    """A value as JSON text, of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x.text)
        elif isinstance(x, (dict, list)):
            inner: list[object] = [_Raw("[" if isinstance(x, list) else "{")]
            for i, y in enumerate(x):
                inner.append(_Raw(", " * (i > 0) + (f"{json.dumps(y, ensure_ascii=False)}: " if isinstance(x, dict) else "")))
                inner.append(x[y] if isinstance(x, dict) else y)
            todo += [*inner, _Raw("]" if isinstance(x, list) else "}")][::-1]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


@dataclass(frozen=True)
class _Raw:
    text: str


def decode(value: object) -> object:
    """A value with text that encodes an object or list (also an encoded text of one) replaced by what it encodes.

    Broken text of that kind gives None.
    """
    while isinstance(value, str):
        bare = value.strip().lstrip("﻿")
        if bare[:1] not in ("{", "["):
            if len(bare) < 2 or bare[0] != '"' or bare[-1] != '"' or bare[1:2] not in ("{", "[", "\\"):
                return value
        try:
            value = _loads(bare)
        except ValueError:
            return None if bare[:1] in ("{", "[") else value
    return value


def parse(text: str | None) -> object:
    """A whole document; None where it is null, blank or not valid JSON. A text inside is decoded again."""
    if not isinstance(text, str):
        return None
    try:
        return decode(_loads(text.strip().lstrip("﻿")))
    except ValueError:
        return None


def is_blank(value: object, known: dict[int, tuple[object, bool]] | None = None) -> bool:
    """Null, white space, or a list or object with only such values.

    ``known`` keeps what was found out about the lists and objects of one document, so that each is looked through once.
    """
    if value is None or isinstance(value, str) and not value.strip():
        return True
    if not isinstance(value, (dict, list)):
        return False
    known = {} if known is None else known
    told = known.get(id(value))
    if told is not None:
        return told[1]
    path = [(value, iter(value.values() if isinstance(value, dict) else value))]
    while path:
        box, rest = path[-1]
        for x in rest:
            if x is None or isinstance(x, str) and not x.strip():
                continue
            if isinstance(x, (dict, list)):
                told = known.get(id(x))
                if told is None:
                    path.append((x, iter(x.values() if isinstance(x, dict) else x)))
                    break
                if told[1]:
                    continue
            for b, _ in path:
                known[id(b)] = (b, False)  # the object is kept, so that its id stays its own
            return False
        else:
            known[id(box)] = (box, True)
            path.pop()
    return True


@dataclass
class InlinePlan:
    """tables: elements that have a table of their own, by the graph or as ``requested`` where no document repeats them.
    recursive: those of them that lie on a cycle. maps: elements whose members are named by data."""

    tables: frozenset[str]
    recursive: frozenset[str] = field(default_factory=frozenset)
    requested: frozenset[str] = field(default_factory=frozenset)
    maps: frozenset[str] = field(default_factory=frozenset)

    def describe(self) -> list[tuple[str, bool]]:
        return sorted((t, t in self.recursive) for t in self.tables)


def entries_of(element: str) -> str:
    """The element that all members of a map are."""
    return f"{element}.entries"


def _edges(value: object, parent: str, above: tuple[str, ...], names: dict[str, str], maps: frozenset[str], out: dict[tuple[str, str], list[bool]]) -> None:
    """Iterative walk, so that deep nesting can't exhaust the stack."""
    todo = [(value, parent, above)]
    while todo:
        value, parent, above = todo.pop()
        if isinstance(value, list):  # a list of lists repeats its parent's element
            for x in value:
                if isinstance(x := decode(x), (dict, list)):
                    todo.append((x, parent, above))
            continue
        if not isinstance(value, dict):
            continue
        entry = entries_of(parent) if parent in maps else None
        for key, child in value.items():
            name = entry or names.get(key) or names.setdefault(key, element_name(key))
            child = decode(child)
            flags = out.setdefault((parent, name), [False, False])
            if entry or isinstance(child, list):
                flags[0] = True
            if isinstance(child, (dict, list)):
                if name in above:
                    flags[1] = True
                todo.append((child, name, (*above, name) if name not in above else above))


def schema_graph(documents: DataFrame, column: str, maps: frozenset[str] = frozenset()) -> DataFrame:
    """The distinct edges of the schema graph: ``parent, child, repeated, recursive, documents``. The members of ``maps`` are
    one element each.

    Null, blank and invalid documents have no edges; an empty table gives an empty graph.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, str] = {}
        for batch in batches:
            seen: dict[tuple[str, str], list] = {}
            for text in batch["_text"]:
                own: dict[tuple[str, str], list[bool]] = {}
                _edges(parse(text), ROOT, (), names, maps, own)
                for edge, (repeated, recursive) in own.items():
                    s = seen.setdefault(edge, [False, False, 0])
                    s[0] |= repeated
                    s[1] |= recursive
                    s[2] += 1
            if len(names) > 100_000:  # free-form keys
                names.clear()
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["parent", "child", "repeated", "recursive", "documents"])

    return (
        documents.select(F.col(column).cast("string").alias("_text"))
        .mapInPandas(walk, EDGE_SCHEMA)
        .groupBy("parent", "child")
        .agg(F.bool_or("repeated").alias("repeated"), F.bool_or("recursive").alias("recursive"), F.sum("documents").alias("documents"))
    )


def structural_edges(edges: DataFrame) -> DataFrame:
    """The edges that a plan depends on: to elements that are repeated, nested in themselves or have children of their own.

    Plain values, of which free-form keys can make very many, stay where they are. ``edges`` is read twice, so it should be
    a written table.
    """
    inner = edges.select(F.col("parent").alias("_inner")).distinct()
    return edges.join(inner, F.col("child") == F.col("_inner"), "left").withColumn("nested", F.col("_inner").isNotNull()).where("repeated OR recursive OR nested").drop("_inner")


def inline_plan(edges: Iterable, always: Iterable[str] = (), never: Iterable[str] = ()) -> InlinePlan:
    """Tables for repeated, shared and recursive elements; ``always`` and ``never`` override the graph.

    Shared means an element with own children under more than one parent: elements that are plain values everywhere
    are columns wherever they stand.
    """
    edges = list(edges)
    # an element has children if it is a parent here, or if its edge says so
    inner = {e["parent"] for e in edges} | {e["child"] for e in edges if "nested" in e and e["nested"]}
    edges = [(e["parent"], e["child"], e["repeated"], e["recursive"]) for e in edges]
    parents: dict[str, set[str]] = {}
    for parent, child, *_ in edges:
        parents.setdefault(child, set()).add(parent)
    # an element lies on a cycle if it can be reached from itself
    children: dict[str, set[str]] = {}
    for parent, child, *_ in edges:
        if child in inner:
            children.setdefault(parent, set()).add(child)

    def reaches_itself(start: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for x in children.get(todo.pop(), ()):
                if x == start:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return False

    cyclic = {x for x in inner if reaches_itself(x)} | {child for _, child, _, recursive in edges if recursive}
    repeated = {child for _, child, many, _ in edges if many}
    shared = {child for child, above in parents.items() if child in inner and len(above) > 1}
    told = (repeated | shared | cyclic) - set(never) - {ROOT}
    tables = (told | set(always)) - set(never) - {ROOT}
    return InlinePlan(frozenset(tables), frozenset(cyclic & tables), frozenset(tables - told))


def document_plan(documents: DataFrame, column: str, always: Iterable[str] = (), never: Iterable[str] = (), map_members: int = MAP_MEMBERS) -> tuple[InlinePlan, DataFrame]:
    """(plan, edges) of the documents, with maps told.

    An element with more than ``map_members`` members that are nested or repeated is a map. Each round walks the documents
    with the maps known so far; rounds end when none is left, after one where there are no maps. The driver gets the
    structural edges of the last round, at most ``map_members`` for each element, and in each round the 1,000 elements with
    the most members beyond that number; further ones come in the next round.
    """
    maps: frozenset[str] = frozenset()
    while True:
        edges = durable(schema_graph(documents, column, maps))
        structural = structural_edges(edges)
        large = structural.groupBy("parent").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > map_members)
        found = {r["parent"] for r in large.orderBy(F.desc("members"), "parent").limit(1_000).collect()}
        if not found:
            break
        maps |= found
    plan = inline_plan(structural.collect(), always, never)
    plan.maps = maps
    return plan, edges


def _text(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else _dumps(value)


def _key(path: str) -> str:
    """A row's key: its path, or where that is long its hash, so that keys of deep rows stay short."""
    return path if len(path) <= LONG_KEY else "#" + hashlib.md5(path.encode(errors="surrogatepass")).hexdigest()


def shred_document(key: int, document: object, plan: InlinePlan, names: dict[str, str], keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """The rows of one document in document order, parents before their children; ``keep``: of these tables only.

    No row for a document that is no object or list. ``numbers`` has, for the row and each of its ancestors, the running
    number of that row among the document's rows of its table. A map's entry has its name as the value ``_key``.
    """
    if not isinstance(document, (dict, list)):
        return
    running: dict[str, int] = {}
    known: dict[int, tuple[object, bool]] = {}
    # (value, table, element, entry's name, own key, parent table, parent key, ordinal, numbers of the ancestors, path)
    todo: list[tuple] = [(document, ROOT, ROOT, None, "", None, None, 0, {}, ROOT)]
    while todo:
        value, own, element, entry_name, row_key, parent, parent_key, ordinal, above, path = todo.pop()
        number = running.get(own, 0)
        running[own] = number + 1
        numbers = above if own == ROOT else {**above, own: number}
        columns: dict[str, str | None] = {} if entry_name is None else {"_key": entry_name}
        counts: dict[str, int] = {}
        below: list[tuple] = []
        if isinstance(value, dict):
            inner = [(iter(value.items()), "", element, path)]  # singleton descendants are walked where they stand
            while inner:
                members, prefix, at_element, at = inner[-1]
                entry = entries_of(at_element) if at_element in plan.maps else None
                for raw, child in members:
                    name = entry or names.get(raw) or names.setdefault(raw, element_name(raw))
                    child = decode(child)
                    if entry or name in plan.tables:
                        items = child if isinstance(child, list) else [] if child is None and not entry else [child]
                        first = counts.get(name, 0)
                        below += [(decode(x), name, name, raw if entry else None, _key(f"{row_key}/{name}.{i}"), own, row_key, i, numbers, _key(f"{at}.{name}")) for i, x in enumerate(items, first)]
                        counts[name] = first + len(items)
                    elif isinstance(child, dict):
                        inner.append((iter(child.items()), f"{prefix}{name}.", name, f"{at}.{name}"))
                        break
                    else:
                        columns[prefix + name] = _text(child)
                else:
                    inner.pop()
        elif isinstance(value, list):  # a list of lists, or a document that is a list
            below = [(decode(x), ITEM, element, None, _key(f"{row_key}/{ITEM}.{i}"), own, row_key, i, numbers, _key(f"{path}.{ITEM}")) for i, x in enumerate(value)]
        else:
            columns["value"] = _text(value)
        if keep is None or own in keep:
            yield key, own, row_key, parent, parent_key, ordinal, numbers, path, columns, is_blank(value, known)
        todo += reversed(below)


def shred(documents: DataFrame, key: str, column: str, plan: InlinePlan, tables: Iterable[str] | None = None) -> DataFrame:
    """All rows of all tables of ``plan``, as ``ROW_SCHEMA``; ``tables`` keeps only some tables' rows.

    ``row_key`` and ``parent_key`` are unique in a document, so (``doc_key``, ``parent_table``, ``parent_key``) is the
    foreign key. ``is_empty`` marks rows without any non-blank value. Null, blank and invalid documents have no rows;
    repeated documents have their rows repeated; other columns of the input are not read.
    """
    keep = frozenset(tables) if tables is not None else None
    columns = re.findall(r"(\w+) (?:\w+<\S+>|\w+)(?:, |$)", ROW_SCHEMA)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, str] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_key, text in zip(batch["_key"].tolist(), batch["_text"].tolist()):
                for row in shred_document(doc_key, parse(text), plan, names, keep):
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if len(names) > 100_000:
                names.clear()
            yield pd.DataFrame(rows, columns=columns)

    source = documents.select(F.col(key).cast("bigint").alias("_key"), F.col(column).cast("string").alias("_text"))
    return source.mapInPandas(walk, ROW_SCHEMA)


REJECTED_SCHEMA = "doc_key bigint, reason string"


def rejected_documents(documents: DataFrame, key: str, column: str) -> DataFrame:
    """The documents that give no rows although they are not blank: ``doc_key``, ``reason``: ``not_json`` (also text that
    encodes broken JSON) or ``no_record`` (a value that is neither an object nor a list). Null and blank ones are no documents.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_key, text in zip(batch["_key"].tolist(), batch["_text"].tolist()):
                if isinstance(text, str) and text.strip().lstrip("﻿") and not isinstance(value := parse(text), (dict, list)):
                    null = value is None and text.strip().lstrip("﻿") == "null"
                    rows.append((doc_key, "no_record" if null or value is not None else "not_json"))
            yield pd.DataFrame(rows, columns=["doc_key", "reason"])

    return documents.select(F.col(key).cast("bigint").alias("_key"), F.col(column).cast("string").alias("_text")).mapInPandas(look, REJECTED_SCHEMA)

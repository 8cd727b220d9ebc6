"""Documents to leaves: one row per address of a value that states something."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import values
from tallyleaf.functions.addresses import INDEX, Address, index_step, key_step

from . import schemas

# What may stand beside "value" in an envelope, and endings of sidecar keys.
ENVELOPE_KEYS = frozenset({"citations", "citation", "confidence", "score", "reasoning", "evidence", "provenance", "source", "sources", "page", "pages", "bbox", "span", "spans", "offset", "offsets", "extraction_status", "status", "meta"})
SIDECARS = ("_citations", "_meta")

#: Leaves in a batch that leaves a task.
LEAVES = 20_000
_PATHS = pa.list_(pa.list_(pa.string()))
#: What may be left out of a document without a difference.
ABSENT: dict[str, Callable[[Any], bool]] = {"default": values.states_nothing, "never": lambda v: False, "null_only": lambda v: v is None}


def unwrapped(node: Any) -> Any:
    """Envelopes, a "value" with nothing but metadata beside it, become their value, at any depth."""
    while isinstance(node, dict) and len(node) > 1 and "value" in node and all(k == "value" or k in ENVELOPE_KEYS for k in node):
        node = node["value"]
    if isinstance(node, dict):
        return {k: unwrapped(v) for k, v in node.items()}
    return [unwrapped(x) for x in node] if isinstance(node, list) else node


def without_sidecars(node: Any) -> Any:
    """Keys such as X_meta go where X stands beside them."""
    if isinstance(node, dict):
        beside = {name + ending for name in node for ending in SIDECARS}
        return {k: without_sidecars(v) for k, v in node.items() if k not in beside}
    return [without_sidecars(x) for x in node] if isinstance(node, list) else node


def prepared(text: str | None, side: str) -> Any:
    """A document as it is compared. A prediction that is missing or isn't an object answers nothing."""
    node = json.loads(text) if text is not None else {}
    # Keys are in the text as they are, but for escapes: without the word no object has one.
    may_have = lambda key_end: key_end in text or "\\" in text
    if node and may_have('value"'):
        node = unwrapped(node)
    if side == "pred":
        if not isinstance(node, dict):
            return {}
        return without_sidecars(node) if node and any(may_have(f'{ending}"') for ending in SIDECARS) else node
    return node


def walked(node: Any, schema: Any, absent: Callable[[Any], bool]) -> Iterator[tuple[Address, Any, bool]]:
    """(address, value, whether it is an open map, which is passed over) in document order."""
    todo: list[tuple[Any, Any, Address]] = [(node, schema, ())]
    while todo:
        value, raw, at = todo.pop()
        spec = schemas.chosen(raw)
        if schemas.is_open_map(spec):
            yield at, value, True
        elif isinstance(value, dict) and value:
            names = spec.get("properties") or {}
            todo += [(v, names.get(k), (*at, key_step(k))) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [(v, spec.get("items"), (*at, index_step(i))) for i, v in reversed(list(enumerate(value)))]
        elif at and not absent(value):
            yield at, value, False


def document_arrays(node: Any) -> set[Address]:
    """Node keys of all arrays of a document, empty ones too."""
    found, todo = set(), [(node, ())]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            todo += [(v, (*at, key_step(k))) for k, v in value.items()]
        elif isinstance(value, list):
            found.add(at)
            todo += [(v, (*at, INDEX)) for v in value]
    return found


def _blank(address: Address) -> Address:
    return tuple(s if s[0] == "k" else INDEX for s in address)


def flattened(document: Column, schema: Column, side: str, wanted: tuple[str, ...] = ("skipped", "arrays")) -> Column:
    """Struct (skipped, arrays) of JSON texts under schema texts: open maps met, and node keys of all arrays; parts that
    aren't wanted are empty. Of equal keys in an object the last one counts. A null schema constrains nothing."""

    @F.arrow_udf("skipped array<array<string>>, arrays array<array<string>>")
    def run(texts: pa.Array, specs: pa.Array) -> pa.Array:
        skipped_of, arrays_of = [], []
        for text, spec_text in zip(texts.to_pylist(), specs.to_pylist(), strict=True):
            maps = "skipped" in wanted and spec_text is not None and schemas.may_skip(spec_text)
            # Most schemas have no open map: then the document needn't be read for them.
            node = prepared(text, side) if maps or "arrays" in wanted else None
            skipped_of.append([at for at, _, is_map in walked(node, schemas.parsed(spec_text)[0], ABSENT["never"]) if is_map] if maps else [])
            arrays_of.append(sorted(document_arrays(node)) if "arrays" in wanted else [])
        return pa.StructArray.from_arrays([pa.array(skipped_of, _PATHS), pa.array(arrays_of, _PATHS)], names=["skipped", "arrays"])

    return run(document, schema)


class _Place:
    """A place in documents of one schema: what the schema says of it, and the places below that were met."""

    __slots__ = ("address", "spec", "is_map", "offered", "slots", "below", "row")
    #: Places that a worker remembers.
    MOST, held = 200_000, 0

    def __init__(self, address: Address, raw: Any, slots: frozenset[Address]):
        self.address, self.spec, self.slots, self.below = address, schemas.chosen(raw), slots, {}
        self.is_map = schemas.is_open_map(self.spec)
        self.offered = address in slots or _blank(address) in slots
        #: Outermost array around it, element there, and the way from the element; None outside of arrays.
        self.row = next(((address[:i], int(s[1:]), address[i + 1 :]) for i, s in enumerate(address) if s[0] == INDEX), None)

    def at(self, key: str | int) -> _Place:
        """The place of an object's key or an array's index."""
        if isinstance(key, str):
            found = _Place((*self.address, key_step(key)), (self.spec.get("properties") or {}).get(key), self.slots)
        else:
            found = _Place((*self.address, index_step(key)), self.spec.get("items"), self.slots)
        if _Place.held < _Place.MOST:
            _Place.held += 1
            self.below[key] = found
        return found


@lru_cache(maxsize=256)
def _root(spec_text: str | None) -> _Place:
    spec, slots, _ = schemas.parsed(spec_text) if spec_text is not None else ({}, frozenset(), ())
    return _Place((), spec, slots)


def _below(value: Any, place: _Place) -> tuple[Iterator[tuple[str | int, Any]], _Place]:
    return iter(value.items()) if isinstance(value, dict) else iter(enumerate(value)), place


_KEY_OF: dict[str, str] = {}


def raw_of(value: Any) -> str:
    """JSON text of a leaf."""
    kind = type(value)
    return encode_basestring(value) if kind is str else str(value) if kind is int else json.dumps(value, ensure_ascii=False)


def canon_of(value: Any) -> str:
    """values.quick_key; of texts a worker remembers some."""
    if type(value) is not str:
        return values.quick_key(value)
    found = _KEY_OF.get(value)
    if found is None:
        if len(_KEY_OF) >= 1 << 16:
            _KEY_OF.clear()
        found = _KEY_OF[value] = values.quick_key(value)
    return found


def _started(text: str | None, spec_text: str | None, side: str) -> tuple[Any, _Place]:
    """A prepared document and the place of its root."""
    if _Place.held >= _Place.MOST:
        _root.cache_clear()
        _Place.held = 0
    return prepared(text, side), _root(spec_text)


def _leaves_in(whole: Any, root: _Place, judge: Callable[[Any], bool]) -> Iterator[tuple[_Place, Any]]:
    """Places and values of the leaves of a value at a place, in document order."""
    states = judge is values.states_nothing
    todo = [_below(whole, root)] if isinstance(whole, (dict, list)) and not root.is_map else []
    while todo:
        items, place = todo[-1]
        known = place.below
        for key, value in items:
            inner = known.get(key) or place.at(key)
            if inner.is_map:
                continue
            kind = type(value)
            if (kind is dict or kind is list) and value:
                todo.append(_below(value, inner))
                break
            # What begins with a letter or digit states something.
            if states and (kind is int or (kind is str and value[:1].isalnum())) or not judge(value):
                yield inner, value
        else:
            todo.pop()


def walker(side: str, absent: str | Callable[[Any], bool] = "default") -> Callable[[str | None, str | None], Iterator[tuple[_Place, Any]]]:
    """A function of a document's and its schema's text that gives the places and values of its leaves, in document order."""
    judge = ABSENT[absent] if isinstance(absent, str) else absent
    return lambda text, spec_text: _leaves_in(*_started(text, spec_text, side), judge)


def row_reader(side: str) -> Callable[[str | None, str | None], dict[Address, dict[int, dict[Address, str]]]]:
    """A function of a document's and its schema's text that gives its outermost arrays: canonical keys by the way from the element, by element.

    Elements of an array have one place in the schema: what is known of the first one's is known of all.
    """
    judge = values.states_nothing

    def row(value: Any, place: _Place) -> dict[Address, str]:
        if type(value) is not dict:
            if type(value) is list and value:
                return {inner.row[2]: canon_of(x) for inner, x in _leaves_in(value, place, judge)}
            return {} if judge(value) else {(): canon_of(value)}
        found, known = {}, place.below
        for key, x in value.items():
            inner = known.get(key) or place.at(key)
            if inner.is_map:
                continue
            kind = type(x)
            if kind is str:
                if x[:1].isalnum() or not judge(x):
                    found[inner.row[2]] = _KEY_OF.get(x) or canon_of(x)
            elif kind is int:
                found[inner.row[2]] = str(x) if -(10**15) < x < 10**15 else canon_of(x)
            elif (kind is dict or kind is list) and x:
                found.update((deep.row[2], canon_of(v)) for deep, v in _leaves_in(x, inner, judge))
            elif not judge(x):
                found[inner.row[2]] = canon_of(x)
        return found

    def read(text: str | None, spec_text: str | None) -> dict[Address, dict[int, dict[Address, str]]]:
        whole, root = _started(text, spec_text, side)
        arrays, todo = {}, [(whole, root)]
        while todo:
            value, place = todo.pop()
            if place.is_map or not value:
                continue
            if isinstance(value, dict):
                todo += [(x, place.below.get(key) or place.at(key)) for key, x in value.items() if isinstance(x, (dict, list))]
            elif isinstance(value, list):
                element = place.below.get(0) or place.at(0)
                rows = {} if element.is_map else {i: found for i, x in enumerate(value) if (found := row(x, element))}
                if rows:
                    arrays[place.address] = rows
        return arrays

    return read


#: Columns of leaves besides keys and address.
COLUMNS = ("raw", "canon", "offered")


class _Leaves:
    """Leaves of the documents of one batch, as columns."""

    def __init__(self):
        self.rows: list[int] = []
        self.places: list[_Place] = []
        self.values: list[Any] = []

    def batch(self, of: pa.RecordBatch, keys: tuple[str, ...], columns: tuple[str, ...]) -> pa.RecordBatch:
        """The leaves so far; each address is built once."""
        at, number = pa.array(self.rows, pa.int32()), {}
        nth = pa.array([number.setdefault(p, len(number)) for p in self.places], pa.int32())
        addresses = pa.array([p.address for p in number], pa.list_(pa.string())).take(nth)
        made = {
            "raw": lambda: pa.array(list(map(raw_of, self.values)), pa.string()),
            "canon": lambda: pa.array(list(map(canon_of, self.values)), pa.string()),
            "offered": lambda: pa.array([p.offered for p in number], pa.bool_()).take(nth),
        }
        found = pa.RecordBatch.from_arrays([*(of[k].take(at) for k in keys), addresses, *(made[c]() for c in columns)], names=[*keys, "address", *columns])
        self.rows, self.places, self.values = [], [], []
        return found


def leaves(docs: DataFrame, document: str, schema: str | None, side: str, absent: str | Callable[[Any], bool] = "default", keys: tuple[str, ...] = ("doc_id",), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows (keys, address, raw, canon, offered), one per leaf; documents without any give none.

    Each document is parsed once, and its leaves leave the task LEAVES at a time. ``absent`` says which values get no
    address: "default", "never", "null_only" or a function. Of equal keys in an object the last one counts. A null
    schema constrains nothing and offers nothing. ``columns`` names those that are made besides keys and address.
    """
    spec = F.lit(None).cast("string") if schema is None else F.col(schema)
    rows = docs.select(*keys, F.col(document).alias("_document"), spec.alias("_schema"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    types = {"raw": "raw string", "canon": "canon string", "offered": "offered boolean"}

    walk = walker(side, absent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Leaves()
            for i, (text, spec_text) in enumerate(zip(batch["_document"].to_pylist(), batch["_schema"].to_pylist(), strict=True)):
                for place, value in walk(text, spec_text):
                    found.rows.append(i)
                    found.places.append(place)
                    found.values.append(value)
                    if len(found.rows) >= LEAVES:
                        yield found.batch(batch, keys, columns)
            if found.rows:
                yield found.batch(batch, keys, columns)

    return rows.mapInArrow(run, ", ".join([kinds, "address array<string>", *(types[c] for c in columns)]))


def skipped(docs: DataFrame, sides: dict[str, str], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Distinct rows (keys, address) of open maps met on any side; sides: column by side."""
    parts = [docs.select(*keys, F.explode(flattened(F.col(column), F.col(schema), side, wanted=("skipped",)).getField("skipped")).alias("address")) for side, column in sides.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()



"""Small documents: rows of their flat arrays are priced and paired where the document is.

A document with few values and no array in an array is one row of one task. Its leaves would be written and moved several
times only to meet each other again, so both sides are flattened together, and what leaves the task are pairs, or leaves with
the gold's numbering. All other documents are priced by joins (``pricing``); prices and the best pairing are the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A

from . import assignment, flatten

DOC = "doc_id"
#: Rows of an array: canonical keys by relative address, by element.
Rows = dict[int, dict[A.Address, str]]


def _times(text: Column, char: str) -> Column:
    """How often a character is in a text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def _has_inner_array(text: Column) -> Column:
    """Whether an array lies in an array. Of several arrays beside escapes it is taken for granted."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.when(_times(text, "[") <= 1, F.lit(False)).when(F.contains(text, F.lit("\\")), F.lit(True)).otherwise(bare.rlike(r"\[[^\]]*\["))


def values_at_most(text: Column) -> Column:
    """A number that a JSON text has no more values than, in an array too."""
    return _times(F.coalesce(text, F.lit("")), ",") + 1


def is_small(cells: int, gold: str = "gold", pred: str = "pred") -> Column:
    """Whether no array of a document has more cells than that, and none lies in another: said by its texts."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (gold, pred)]
    return (values_at_most(texts[0]) * values_at_most(texts[1]) <= cells) & ~_has_inner_array(texts[0]) & ~_has_inner_array(texts[1])


def rows_of(places: Iterable[Any], canons: Iterable[str]) -> dict[A.Address, Rows]:
    """Rows by array of the leaves of one side."""
    found: dict[A.Address, Rows] = {}
    for place, canon in zip(places, canons, strict=True):
        if place.row is not None:
            array, element, rel = place.row
            found.setdefault(array, {}).setdefault(element, {})[rel] = canon
    return found


def edges(gold: Rows, pred: Rows) -> dict[tuple[int, int], tuple[int, int]]:
    """(matched, shared) of the pairs (pred, gold) of rows with an equal value."""
    having: dict[tuple, list[int]] = defaultdict(list)
    for i, named in gold.items():
        for value in named.items():
            having[value].append(i)
    matched: dict[tuple[int, int], int] = defaultdict(int)
    for j, named in pred.items():
        for value in named.items():
            for i in having.get(value, ()):
                matched[j, i] += 1
    return {(j, i): (n, len(pred[j].keys() & gold[i].keys())) for (j, i), n in matched.items()}


def bound(gold: Rows, pred: Rows) -> int:
    """The most pairs of rows that can match anything: as many as equal values make, no more than there are cells."""
    counts: dict[tuple, int] = {}
    for named in gold.values():
        for value in named.items():
            counts[value] = counts.get(value, 0) + 1
    return min(sum(counts.get(value, 0) for named in pred.values() for value in named.items()), len(gold) * len(pred))


def _numbers(rows: Rows) -> dict[int, int]:
    """Numbers by content, so that the outcome doesn't depend on the order of rows."""
    return {x: n for n, x in enumerate(sorted(rows, key=lambda x: (sorted(rows[x].items()), x)))}


def paired(gold: Rows, pred: Rows) -> dict[int, int]:
    """Partners in gold of pred's rows: the best pairing; of scalars, equal values by their number of occurrence."""
    if not any(rel for rows in (gold, pred) for named in rows.values() for rel in named):
        places: dict[str, list[int]] = defaultdict(list)
        for i in sorted(gold, reverse=True):
            places[gold[i][()]].append(i)
        return {j: places[canon].pop() for j in sorted(pred) if places[canon := pred[j][()]]}
    # What matches counts first.
    scale = 1 + sum(map(len, pred.values()))
    weight = {k: matched * scale + shared for k, (matched, shared) in edges(gold, pred).items()}
    best: dict[int, tuple[int, int]] = {}
    tied = set()
    for (j, i), w in weight.items():
        most = best.get(j, (0, 0))[0]
        if w > most:
            best[j] = (w, i)
            tied.discard(j)
        elif w == most:
            tied.add(j)
    if not tied and len({i for _, i in best.values()}) == len(best):
        # Every row has the one partner that is worth most to it.
        return {j: i for j, (_, i) in best.items()}
    p, g = _numbers(pred), _numbers(gold)
    p_rows, g_rows = ({n: x for x, n in numbers.items()} for numbers in (p, g))
    made, _ = assignment.assign({(p[j], g[i]): w for (j, i), w in weight.items()})
    return {p_rows[a]: g_rows[b] for a, b in made}


def _canons(walked: list[tuple[Any, Any]]) -> list[str]:
    return [flatten.canon_of(value) for _, value in walked]


def _per_array(docs: DataFrame, kind: str, say: Callable[[A.Address, Rows, Rows], list[tuple]]) -> DataFrame:
    """doc_id and the rows, of that kind, that are said of each array of both sides."""
    readers = flatten.row_reader("gold"), flatten.row_reader("pred")
    names, types = zip(*(x.split(" ") for x in kind.split(", ")), strict=True)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}

    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(golds: pa.Array, preds: pa.Array, specs: pa.Array) -> pa.Array:
        out, starts = [], [0]
        for gold, pred, spec in zip(golds.to_pylist(), preds.to_pylist(), specs.to_pylist(), strict=True):
            g, p = (read(text, spec) for read, text in zip(readers, (gold, pred), strict=True))
            for array in p.keys() & g.keys():
                out += say(array, g[array], p[array])
            starts.append(len(out))
        columns = [pa.array([x[i] for x in out], arrow[t]) for i, t in enumerate(types)]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, names=list(names)))

    return docs.select(DOC, F.explode(run(F.col("gold"), F.col("pred"), F.col("schema"))).alias("_")).select(DOC, "_.*")


def weights(docs: DataFrame) -> DataFrame:
    """Pairs of rows with an equal value: doc_id, array, pred, gold, matched, shared."""
    say = lambda array, gold, pred: [(array, A.index_step(j), A.index_step(i), m, s) for (j, i), (m, s) in edges(gold, pred).items()]
    return _per_array(docs, "array array<string>, pred string, gold string, matched bigint, shared bigint", say)


def pair_bounds(docs: DataFrame) -> DataFrame:
    """For arrays of both sides the most pairs that can match anything: doc_id, array, pairs. Counts alone: documents may be of any size."""
    return _per_array(docs, "array array<string>, pairs bigint", lambda array, gold, pred: [(array, bound(gold, pred))])


def _moved(place: Any, to: int | None) -> A.Address:
    """A predicted leaf's address with its row's partner; a label if it has none."""
    array, element, rel = place.row
    return (*array, f"{A.LABEL}p{element}" if to is None else A.index_step(to), *rel)


class _Addresses:
    """Addresses of a batch, each built once, and known by a number."""

    def __init__(self):
        self.built: list[A.Address] = []
        self._by_address: dict[A.Address, int] = {}
        self._by_place: dict[Any, int] = {}

    def of(self, key: Any, address: Callable[[], A.Address]) -> int:
        found = self._by_place.get(key)
        if found is None:
            made = address()
            found = self._by_place[key] = self._by_address.setdefault(made, len(self.built))
            if found == len(self.built):
                self.built.append(made)
        return found


def both_sides(docs: DataFrame, ordered: bool | Sequence[Sequence[str]], absent) -> DataFrame:
    """Rows (doc_id, address, gold_raw, pred_raw, gold_canon, pred_canon, offered) for each address of either side, the prediction's
    with the gold's numbering: what a join of both sides' leaves would give.

    ``ordered`` names arrays, by node key, that are compared by place; True all, False none.
    """
    walks = flatten.walker("gold", absent), flatten.walker("pred", absent)
    fixed = frozenset() if isinstance(ordered, bool) else frozenset(map(tuple, ordered))

    @F.arrow_udf("array<struct<address array<string>, gold_raw string, pred_raw string, gold_canon string, pred_canon string, offered boolean>>")
    def run(golds: pa.Array, preds: pa.Array, specs: pa.Array) -> pa.Array:
        addresses = _Addresses()
        values, canons = [], []
        # Of each row the number of its address, the places of both sides among values, and whether the schema offers it.
        at, gold_at, pred_at, offered, starts = [], [], [], [], [0]
        for gold, pred, spec in zip(golds.to_pylist(), preds.to_pylist(), specs.to_pylist(), strict=True):
            sides = [list(walk(text, spec)) for walk, text in zip(walks, (gold, pred), strict=True)]
            g_canons, p_canons = map(_canons, sides)
            partners = {}
            if ordered is not True:
                g, p = (rows_of([place for place, _ in side], c) for side, c in zip(sides, (g_canons, p_canons), strict=True))
                partners = {array: paired(g[array], p[array]) for array in p.keys() & g.keys() if array not in fixed}
            met = {}
            for place, value in sides[0]:
                number = addresses.of(place, lambda place=place: place.address)
                met[number] = len(at)
                at.append(number)
                gold_at.append(len(values))
                values.append(value)
            pred_at += [None] * len(met)
            offered += [None] * len(met)
            for place, value in sides[1]:
                to, moves = None, place.row is not None and place.row[0] in partners
                if moves:
                    to = partners[place.row[0]].get(place.row[1])
                number = addresses.of((place, to), lambda place=place, to=to: _moved(place, to)) if moves else addresses.of(place, lambda place=place: place.address)
                row = met.get(number)
                if row is None:
                    at.append(number)
                    gold_at.append(None)
                    pred_at.append(len(values))
                    offered.append(place.offered)
                else:
                    pred_at[row], offered[row] = len(values), place.offered
                values.append(value)
            canons += g_canons
            canons += p_canons
            starts.append(len(at))
        raw, canon = pa.array(list(map(flatten.raw_of, values)), pa.string()), pa.array(canons, pa.string())
        of_gold, of_pred = pa.array(gold_at, pa.int32()), pa.array(pred_at, pa.int32())
        columns = {
            "address": pa.array(addresses.built, pa.list_(pa.string())).take(pa.array(at, pa.int32())),
            "gold_raw": raw.take(of_gold),
            "pred_raw": raw.take(of_pred),
            "gold_canon": canon.take(of_gold),
            "pred_canon": canon.take(of_pred),
            "offered": pa.array(offered, pa.bool_()),
        }
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

    return docs.select(DOC, F.explode(run(F.col("gold"), F.col("pred"), F.col("schema"))).alias("_")).select(DOC, "_.*")

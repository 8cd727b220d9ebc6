import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A
from tallyleaf.operators import assignment, flatten, schemas
from tallyleaf.plans import grade

T, N = {"type": "string"}, {"type": "number"}


def obj(**properties):
    return {"type": "object", "properties": properties}


def arr(items):
    return {"type": "array", "items": items}


def run(spark, cases, order=False, absent="default"):
    """Scores by name of (name, pred, gold, schema), all in one grading."""
    rows = [(n, "s", json.dumps(g), None if p is None else json.dumps(p), json.dumps(s)) for n, p, g, s in cases]
    docs = spark.createDataFrame(rows, "doc_id string, suite string, gold string, pred string, schema string")
    done = grade.grade(docs, order, absent)
    verdicts = {}
    for r in done.verdicts.withColumn("at", A.show(F.col("address"))).collect():
        verdicts.setdefault(r.doc_id, {})[r["at"]] = r.result
    return {r.doc_id: r for r in done.scores.collect()}, verdicts


INVOICE = obj(invoice_id=T, invoice_date=T, total_due=N, purchase_order=T, line_items=arr(obj(sku=T, description=T, qty={"type": "integer"}, unit_price=N)))
GOLD = {"invoice_id": "A-7", "invoice_date": "2024-03-31", "total_due": 1240.0, "line_items": [{"sku": "X1", "description": "bolt, M8", "qty": 24, "unit_price": 12.5}, {"sku": "X2", "description": "washer", "qty": 100, "unit_price": 9.4}]}
PRED = {"invoice_id": "A-7", "invoice_date": "03/31/2024", "total_due": "1,240.00", "purchase_order": "P-1", "currency": "USD", "line_items": [{"sku": "X2", "description": "washer", "qty": 100, "unit_price": 9.4}, {"sku": "X1", "qty": 24, "unit_price": 12.05}, {"sku": "Z", "description": "freight", "qty": 1, "unit_price": 45.0}]}
SEGMENTS = obj(segments=arr(obj(name=T, quarters=arr(N))))


@pytest.fixture(scope="module")
def graded(spark):
    ids = obj(ids=arr(T))
    rows = obj(rows=arr(obj(a=N, b=N, c=N)))
    cases = [
        ("invoice", PRED, GOLD, INVOICE),
        ("segments", {"segments": [{"name": "B", "quarters": [4, 5, 9]}, {"name": "A", "quarters": [2, 1]}]}, {"segments": [{"name": "A", "quarters": [1, 2, 3]}, {"name": "B", "quarters": [4, 5, 6]}]}, SEGMENTS),
        ("nothing in common", {"rows": [{"a": i + 100, "b": i + 200} for i in range(3)]}, {"rows": [{"a": i, "b": i + 10} for i in range(2)]}, rows),
        ("key is no index", {"x": {"0": "a", "1": "b"}}, {"x": ["a", "b"]}, obj(x=arr(T))),
        ("one right", {"rows": [{"a": 1, "b": 9, "c": 9}]}, {"rows": [{"a": 1, "b": 2, "c": 3}]}, rows),
        ("none right", {"rows": [{"a": 7, "b": 8, "c": 9}]}, {"rows": [{"a": 1, "b": 2, "c": 3}]}, rows),
        ("multiset", {"ids": ["x", "x", "y"]}, {"ids": ["x", "y", "y"]}, ids),
        ("no answer", None, {"ids": ["x"]}, ids),
        ("both empty", {}, {}, ids),
        ("silent gold", {"ids": ["x"]}, {"ids": []}, ids),
        ("open map", {"bag": {"k": 1}, "a": "x"}, {"bag": {"k": 2}, "a": "x"}, obj(a=T, bag={"type": "object", "additionalProperties": True})),
        ("envelopes", {"a": {"value": "x", "confidence": 0.5}, "a_meta": "p"}, {"a": "x"}, obj(a=T)),
        ("in the unpaired row", {"rows": [{"a": 1}, {"a": 5, "c": 6}]}, {"rows": [{"a": 1}]}, rows),
        ("cube", {"m": [[[1, 2], [3, 4]], [[5, 6], [7, 99]]]}, {"m": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]}, obj(m=arr(arr(arr(N))))),
    ]
    return run(spark, cases)


def test_invoice(graded):
    s, v = graded[0]["invoice"], graded[1]["invoice"]
    assert (s.matched, s.total, s.misread, s.unfound, s.fabricated, s.invented_item, s.invented_field) == (9, 17, 1, 1, 1, 4, 1)
    assert (round(s.precision, 4), round(s.recall, 4), round(s.f1, 4)) == (0.5625, 0.8182, 0.6667)
    assert (s.gold_rows, s.pred_rows, s.matched_rows, s.matching_exact) == (2, 3, 2, True)
    assert v["line_items[0].description"] == "unfound" and v["line_items[p2].sku"] == "invented_item" and v["currency"] == "invented_field"


def test_nested_rows_are_paired_inside_too(graded):
    s = graded[0]["segments"]
    assert (s.matched, s.total) == (6, 9)
    assert graded[1]["segments"]["segments[1].quarters[p2]"] == "invented_item"
    c = graded[0]["cube"]
    assert (c.matched, c.total) == (7, 9)


def test_shapes(graded):
    s, v = graded
    assert (s["nothing in common"].matched, s["nothing in common"].total) == (0, 10)
    assert "rows[p2].a" in v["nothing in common"]
    assert (s["key is no index"].matched, s["key is no index"].total) == (0, 4)
    assert (s["one right"].total, s["none right"].total) == (3, 6)
    assert (s["multiset"].matched, s["multiset"].unfound, s["multiset"].invented_item) == (2, 1, 1)
    assert (s["no answer"].accuracy, s["no answer"].unfound) == (0, 1)
    assert (s["both empty"].total, s["both empty"].accuracy) == (0, 0)
    assert v["silent gold"] == {"ids[0]": "fabricated"}
    assert s["open map"].skipped_open_maps == ["bag"] and (s["open map"].matched, s["open map"].total) == (1, 1)
    assert (s["envelopes"].matched, s["envelopes"].total) == (1, 1)
    assert v["in the unpaired row"]["rows[p1].c"] == "invented_item"


def test_order_and_names(spark):
    spec = obj(steps=arr(T), rows=arr(obj(t=arr(N))))
    case = [("d", {"steps": ["mix", "bake", "cool"]}, {"steps": ["cool", "bake", "mix"]}, spec)]
    assert run(spark, case)[0]["d"].accuracy == 1
    assert round(run(spark, case, order=["steps"])[0]["d"].accuracy, 4) == 0.3333
    assert round(run(spark, case, order=True)[0]["d"].accuracy, 4) == 0.3333
    docs = spark.createDataFrame([("d", "s", "{}", "{}", json.dumps(spec))], "doc_id string, suite string, gold string, pred string, schema string")
    assert sorted(r.name for r in grade.known_arrays(docs).collect()) == ["rows", "rows[*].t", "steps"]
    with pytest.raises(ValueError, match="there are: rows, rows"):
        grade.resolve_order(["step"], docs)
    with pytest.raises(TypeError):
        grade.resolve_order("steps", docs)


def test_absent_modes(spark):
    case = [("d", {"a": None, "b": ""}, {"a": None, "b": "x"}, obj(a=T, b=T))]
    assert run(spark, case)[0]["d"].total == 1
    s = run(spark, case, absent="never")[0]["d"]
    assert (s.total, s.matched, s.misread) == (2, 1, 1)


def brute(pred, gold):
    """Largest number of matches of flat rows, and the smallest total that goes with it."""
    n = max(len(pred), len(gold))
    best = None
    for perm in itertools.permutations(range(n)):
        matched = shared = 0
        for i, j in enumerate(perm):
            if i < len(pred) and j < len(gold):
                m = sum(pred[i][k] == gold[j][k] for k in pred[i].keys() & gold[j].keys())
                if m:
                    matched, shared = matched + m, shared + len(pred[i].keys() & gold[j].keys())
        best = max(best or (0, 0), (matched, shared))
    total = sum(map(len, pred)) + sum(map(len, gold)) - best[1]
    return best[0], total


def test_random_rows_reach_the_best_pairing(spark):
    r = random.Random(11)
    row = lambda: {k: r.randint(1, 3) for k in "abc" if r.random() < 0.8} or {"a": 1}
    cases = [(str(i), {"rows": [row() for _ in range(r.randint(1, 4))]}, {"rows": [row() for _ in range(r.randint(1, 4))]}, obj(rows=arr(obj(a=N, b=N, c=N)))) for i in range(40)]
    scores, _ = run(spark, cases)
    for name, pred, gold, _ in cases:
        assert (scores[name].matched, scores[name].total) == brute(pred["rows"], gold["rows"]), (pred, gold)
        s = scores[name]
        assert s.matched + s.misread + s.unfound + s.fabricated + s.invented_item + s.invented_field == s.total
    shuffled = [(n, {"rows": r.sample(p["rows"], len(p["rows"]))}, g, s) for n, p, g, s in cases]
    again, _ = run(spark, shuffled)
    assert all(again[n].matched == scores[n].matched and again[n].total == scores[n].total for n, *_ in cases)


def test_assignment_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 5)
        edges = {(i, j): r.randint(1, 9) for i in range(n) for j in range(m) if r.random() < 0.6}
        pairs, inexact = assignment.assign(edges)
        assert len({p for p, _ in pairs}) == len({g for _, g in pairs}) == len(pairs) and not inexact
        best = max(sum(edges.get((i, j), 0) for i, j in zip(range(n), perm, strict=False)) for perm in itertools.permutations(range(max(n, m) + n), n))
        assert sum(edges[p] for p in pairs) == best
    pairs, inexact = assignment.assign({(0, 0): 5, (0, 1): 4, (1, 0): 4}, limit=lambda *a: False)
    assert (pairs, inexact) == ([(0, 0)], [2])
    assert assignment.solvable(15_000, 15_000) and not assignment.solvable(20_001, 20_001) and not assignment.solvable(20_000, 20_000)


def test_schema_rules():
    assert schemas.inlined({"a": {"$ref": "#/$defs/x", "description": "own"}, "$defs": {"x": {"type": "string", "description": "other"}}}) == {"a": {"type": "string", "description": "own"}}
    with pytest.raises(ValueError):
        schemas.parsed(json.dumps({"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"properties": {"b": {"$ref": "#/$defs/x"}}}}}))
    with pytest.raises(TypeError):
        schemas.parsed("{}")
    assert schemas.is_open_map({"anyOf": [{"additionalProperties": {}}]}) and not schemas.is_open_map({"additionalProperties": False})
    assert flatten.unwrapped({"value": {"value": 1, "page": 2}, "score": 3}) == 1
    assert flatten.unwrapped({"value": 12.4, "unit": "USD"}) == {"value": 12.4, "unit": "USD"}
    assert flatten.unwrapped({"value": 1}) == {"value": 1}


def test_quoted_names(spark):
    row = spark.createDataFrame([(["ka.b", "i", "kc[d]", "kit's."],)], "n array<string>").select(A.format_node(F.col("n"))).first()
    assert row[0] == "'a.b'[*].'c[d]'.\"it's.\""


def test_leaves_make_the_wanted_columns_from_remembered_places(spark, monkeypatch):
    texts = ['{"a": [{"b": 1, "c": "x y"}, {"b": null, "value": 2}], "m_meta": 3, "m": 4}', '{"a": [{"b": "$1.50", "c": ""}]}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, doc string").coalesce(1)
    rows = lambda df: [(r.doc_id, *r.address) for r in df.collect()]
    bare = flatten.leaves(docs, "doc", None, "pred", columns=())
    assert bare.columns == ["doc_id", "address"]
    whole = flatten.leaves(docs, "doc", None, "pred")
    assert rows(bare) == rows(whole) and len(rows(bare)) == 5
    assert [(r.raw, r.canon) for r in whole.collect()] == [("1", "1"), ('"x y"', "xy"), ("2", "2"), ("4", "4"), ('"$1.50"', "1.5")]
    root = flatten._root('{"properties": {"a": {"items": {"properties": {"b": {}}}}}}')
    first = root.at("a").at(0).at("b")
    assert root.below["a"].below[0].below["b"] is first and first.offered
    monkeypatch.setattr(flatten._Place, "held", flatten._Place.MOST)
    assert root.at("z").address == ("kz",) and "z" not in root.below

"""Small documents are judged where they are, with what the joins of leaves give."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import align, flatten, small, verdicts
from tallyleaf.plans import grade
from tallyleaf.sources import tables

TEXT = {"type": "string"}
SPEC = {"type": "object", "properties": {"name": TEXT, "rows": {"type": "array", "items": {"type": "object", "properties": {k: TEXT for k in "abcd"}}}, "tags": {"type": "array", "items": TEXT}, "fixed": {"type": "array", "items": {"type": "object", "properties": {"a": TEXT}}}}}
DOCS = "doc_id string, suite string, gold string, pred string, schema string"
RESULT = ["doc_id", "address", "gold_raw", "pred_raw", "gold_canon", "pred_canon", "result"]


def side(r):
    word = lambda kind: r.choice([f"{kind}{r.randrange(5)}", f'{kind} "[{r.randrange(3)}', "", None, f"1,{r.randrange(3)}00.0"])
    found = {"name": word("n"), "rows": [{k: word(k) for k in "abcd" if r.random() < 0.8} for _ in range(r.randrange(6))], "tags": [word("t") for _ in range(r.randrange(5))]}
    if r.random() < 0.4:
        found["fixed"] = [{"a": word("a")} for _ in range(r.randrange(3))]
    if r.random() < 0.3:
        found["rows"].append(word("x"))
    return found


def documents(spark, n=60):
    r = random.Random(3)
    rows = [(f"d{i}", "s", json.dumps(side(r)), None if i % 20 == 7 else json.dumps(dict(side(r), other=r.choice(["x", [1, 2]]))), json.dumps(SPEC)) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def apart(monkeypatch, docs, *args):
    """What the joins of leaves give: no document counts as small."""
    with monkeypatch.context() as m:
        m.setattr(align, "LARGE", 0)
        assert align.sorted_out(docs)[0] is None
        m.setattr(align, "sorted_out", lambda d: (None, d, 10**4))
        m.setattr(align, "LARGE", 1_000_000)
        found = grade.grade(docs, *args)
        return {x.doc_id: x for x in found.scores.collect()}


@pytest.mark.parametrize("order", [False, True, ["fixed", "tags"]])
def test_small_documents_score_as_others(spark, monkeypatch, order):
    docs = documents(spark)
    docs = spark.createDataFrame([(*x[:2], x.gold.replace('\\"', ""), x.pred and x.pred.replace('\\"', ""), x.schema) for x in docs.collect()], DOCS)
    assert align.sorted_out(docs)[1] is None
    got = {x.doc_id: x for x in grade.grade(docs, order).scores.collect()}
    assert got == apart(monkeypatch, docs, order)


def test_escapes_and_inner_arrays_go_the_other_way(spark, monkeypatch):
    nested = {"rows": [{"a": "1", "in": [{"k": "x"}, {"k": "y"}]}, {"a": "2", "in": [{"k": "z"}]}]}
    turned = {"rows": [{"a": "2", "in": [{"k": "z"}]}, {"a": "1", "in": [{"k": "y"}, {"k": "x"}]}]}
    extra = [("inner", "s", json.dumps(nested), json.dumps(turned), '{"type": "object"}'), ("matrix", "s", '{"m": [[1, 2], [3, 4]]}', '{"m": [[3, 4], [1, 2]]}', '{"type": "object"}'), ("text", "s", '{"t": "a [ b [ c"}', '{"t": "a [ b [ c"}', '{"type": "object"}')]
    docs = documents(spark, 20).union(spark.createDataFrame(extra, DOCS))
    few, others, _ = align.sorted_out(docs)
    assert {x.doc_id for x in others.select("doc_id").collect()} >= {"inner", "matrix"} and "text" in {x.doc_id for x in few.select("doc_id").collect()}
    found = {x.doc_id: x for x in grade.grade(docs).scores.collect()}
    assert found == apart(monkeypatch, docs) and found["inner"].matched == 5 and found["matrix"].matched == 4


def test_rows_of_a_document_are_what_a_join_gives(spark, monkeypatch):
    """Rows with content of their own have one best pairing: every verdict is the same both ways."""
    r = random.Random(8)
    rows = []
    for d in range(15):
        gold = [{"a": f"{d} a{i}", "b": f"b{i}", "c": r.choice("xy")} for i in range(r.randrange(1, 7))]
        pred = [dict(x, b="other") if r.random() < 0.2 else x for x in r.sample(gold, r.randrange(len(gold) + 1))] + [{"a": "none", "z": "new"}] * (d % 3 == 0)
        rows.append((f"d{d}", "s", json.dumps({"rows": gold, "only": [{"a": "g"}]}), json.dumps({"rows": pred, "fresh": [{"a": "p"}], "name": "n"}), json.dumps(SPEC)))
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(str, grade.judged(docs)[0].select(RESULT).collect()))
    monkeypatch.setattr(align, "sorted_out", lambda d: (None, d, 10**4))
    assert got == sorted(map(str, grade.judged(docs)[0].select(RESULT).collect())) and "invented_item" in "".join(got)


def test_the_best_pairing_needn_t_give_each_row_its_best():
    gold = {0: {("a",): "x", ("b",): "y", ("c",): "z"}, 1: {("a",): "x", ("b",): "y"}}
    pred = {0: {("a",): "x", ("b",): "y", ("c",): "z"}, 1: {("a",): "x", ("c",): "z"}}
    found = small.edges(gold, pred)
    assert found == {(0, 0): (3, 3), (0, 1): (2, 2), (1, 0): (2, 2), (1, 1): (1, 1)}
    assert small.paired(gold, pred) in ({0: 0, 1: 1}, {0: 1, 1: 0})
    assert sum(found[k][0] for k in small.paired(gold, {0: {("c",): "z"}, 1: {("c",): "z", ("a",): "x"}}).items()) == 3 - 1
    assert small.paired({0: {(): "x"}, 1: {(): "y"}, 2: {(): "x"}}, {0: {(): "x"}, 1: {(): "x"}, 2: {(): "x"}}) == {0: 0, 1: 2}


def test_small_documents_are_neither_written_nor_dealt(spark, monkeypatch):
    """Their leaves once were written and dealt anew several times, which took most of the disk."""
    docs = documents(spark)
    docs = docs.where(~F.contains("gold", F.lit("\\")) & ~F.contains(F.coalesce("pred", F.lit("")), F.lit("\\")))

    def fail(*_):
        raise AssertionError("a table of leaves is written")

    monkeypatch.setattr(tables, "kept", fail)
    judged, _ = grade.judged(docs, levels=1)
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
    # One row of counts for each document is what moves.
    assert verdicts.counts(judged)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_counts_of_one_pass(spark):
    leaf = lambda at, g, p, result: ("d", at, g, p, result)
    rows = [leaf(["kn"], "1", "1", "matched"), leaf(["kx", "i0000000000", "ka"], "1", "2", "misread"), leaf(["kx", "i0000000000", "kb", "i0000000000", "kc"], "1", None, "unfound"), leaf(["kx", "i0000000000", "kb", "jp1", "kc"], None, "4", "invented_item"), leaf(["ky", "i0000000000"], "1", "1", "matched"), ("d", ["km"], None, None, verdicts.SKIPPED), ("e", ["kn"], None, "1", "fabricated")]
    judged = spark.createDataFrame(rows, "doc_id string, address array<string>, gold_canon string, pred_canon string, result string")
    got = {x.doc_id: x.asDict() for x in verdicts.tallied(judged).collect()}
    want = {x.doc_id: x.asDict() for x in verdicts.counts(judged).join(verdicts.row_counts(judged), "doc_id", "left").fillna(0).collect()}
    assert got == want and got["d"]["total"] == 5 and got["d"]["gold_rows"] == 2 and got["d"]["pred_rows"] == 2 and got["d"]["matched_rows"] == 1


def test_row_counts_move_elements_and_no_leaves(spark, monkeypatch):
    """As the joins of leaves have them; each element moves once, then each document's counts."""
    docs = documents(spark, 30).where(~F.contains("gold", F.lit("\\")) & ~F.contains(F.coalesce("pred", F.lit("")), F.lit("\\")))
    counted = verdicts.row_counts(grade.judged(docs, levels=1)[0])
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = sorted(map(tuple, counted.collect()))
    monkeypatch.setattr(align, "sorted_out", lambda d: (None, d, 10**4))
    assert got == sorted(map(tuple, verdicts.row_counts(grade.judged(docs, levels=1)[0]).collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_invented_rows_are_found_where_their_document_is(spark):
    from tallyleaf.plans import catalog

    docs, judged, _ = catalog._order_verdicts(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(judged.where("result = 'invented_item'")) == plan(docs)


def shown(df, *columns):
    return sorted(map(tuple, df.select("doc_id", *columns).collect()))


def sides(docs, folder):
    return [align.laid(flatten.leaves(docs, side, "schema", side, columns=("canon",)), 1, f"file://{folder}/{side}") for side in ("gold", "pred")]


def test_bounds_of_documents_are_those_of_their_leaves(spark, tmp_path):
    """Also of rows with open maps, objects and arrays inside, and of one document with very many pairs."""
    deep = [{"rows": [{"a": "x", "in": [{"k": i}, [1, i]], "o": {"p": "y", "q": i % 3}} for i in range(n)] + ["x", ["x"], None, []], "m": {"u": [1], "v": 2}, "tags": ["t", "t"]} for n in (3, 5)]
    spec = dict(SPEC, properties=dict(SPEC["properties"], m={"type": "object", "additionalProperties": TEXT}))
    flags = json.dumps({"rows": [{"a": "flag", "b": f"b{i}"} for i in range(2_000)]})
    extra = [("deep", "s", *map(json.dumps, deep), json.dumps(spec)), ("list", "s", '[{"a": 1}, 2]', '[{"a": 1}]', json.dumps(SPEC)), ("flags", "s", flags, flags, json.dumps(SPEC))]
    docs = documents(spark, 40).union(spark.createDataFrame(extra, DOCS))
    got = shown(small.pair_bounds(docs), "array", "pairs")
    assert got == shown(align.pair_bounds(*sides(docs, tmp_path)), "array", "pairs")
    assert ("flags", ["krows"], 4_000_000) in got


def test_bounds_write_nothing_and_move_nothing(spark, monkeypatch):
    """Leaves once were written, and dealt several times."""
    monkeypatch.setattr(tables, "kept", None)
    assert "Exchange" not in small.pair_bounds(documents(spark, 9))._jdf.queryExecution().executedPlan().toString()


def test_weights_of_documents_are_those_of_their_leaves(spark, monkeypatch, tmp_path):
    """Small documents are priced where they are, others by joins."""
    big = json.dumps({"rows": [{"a": f"n{i}", "b": f"word {i % 7}"} for i in range(700)]})
    bare = lambda c: F.replace(c, F.lit('\\"'), F.lit(""))
    docs = documents(spark, 30).withColumns({"gold": bare("gold"), "pred": bare("pred")}).union(spark.createDataFrame([("big", "s", big, big, json.dumps(SPEC))], DOCS))
    got = shown(align.document_weights(docs), "array", "pred", "gold", "matched", "shared")
    assert got == shown(align.weights(*sides(docs, tmp_path)), "array", "pred", "gold", "matched", "shared")
    few, others, _ = align.sorted_out(docs)
    assert [x.doc_id for x in others.select("doc_id").collect()] == ["big"] and few.count() == 30
    monkeypatch.setattr(tables, "kept", None)
    plan = align.document_weights(few)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

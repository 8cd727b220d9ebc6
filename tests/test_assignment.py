import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import align, assignment, components, large, pricing
from tallyleaf.plans import grade


def worth(edges, pairs):
    assert len({p for p, _ in pairs}) == len(pairs) == len({g for _, g in pairs})
    return sum(edges[x] for x in pairs)


def test_thin_and_dense_ways_are_worth_the_same():
    r = random.Random(2)
    for _ in range(500):
        n, m = r.randint(1, 9), r.randint(1, 9)
        edges = {(r.randrange(n), r.randrange(m)): r.randint(1, 9) for _ in range(r.randint(1, 20))}
        matrix = np.zeros((n, m))
        for k, w in edges.items():
            matrix[k] = w
        wide = n <= m
        dense = assignment.dense(matrix.copy() if wide else matrix.T.copy())
        dense = [x for x in (d if wide else d[::-1] for d in dense) if x in edges]
        assert worth(edges, assignment.thin(edges)) == worth(edges, dense) == worth(edges, assignment.assign(edges)[0])


def test_a_thin_component_of_many_rows(monkeypatch):
    n = 4000
    edges = {(i, (i + j) % n): 10 - j for i in range(n) for j in range(3)}
    monkeypatch.setattr(assignment, "dense", None)
    began = time.time()
    pairs, inexact = assignment.assign(edges)
    assert pairs == [(i, i) for i in range(n)] and not inexact and time.time() - began < 20


LEAF = "doc_id string, array array<string>, element string, rel array<string>, canon string"


def random_row(r, deep):
    """(values by relative address, rows inside by path) of a row with arrays inside it."""
    named = {("kt",): f"t{r.randrange(3)}", ("kn",): f"n{r.randrange(3)}"}
    inside = {path: [random_row(r, deep - 1) for _ in range(r.randint(1, 3))] for path in r.sample([("ka",), ("kb", "kc")], r.randint(0, 2))} if deep else {}
    return ({} if inside and r.random() < 0.2 else named), inside


def leaves_of(row, rel=()):
    named, inside = row
    yield from ((rel + at, v) for at, v in named.items())
    for path, rows in inside.items():
        for i, x in enumerate(rows):
            yield from leaves_of(x, (*rel, *path, f"i{i:010d}"))


def all_pairs(pred, gold):
    """(matched, shared) of the best pairing of two lists of rows, pricing every pair."""
    prices = {}
    for i, (p, p_inside) in enumerate(pred):
        for j, (g, g_inside) in enumerate(gold):
            common = p.keys() & g.keys()
            m, s = sum(p[a] == g[a] for a in common), len(common)
            for path in p_inside.keys() & g_inside.keys():
                a, b = all_pairs(p_inside[path], g_inside[path])
                m, s = m + a, s + b
            if m:
                prices[i, j] = (m, s)
    pairs, _ = assignment.assign({k: 1000 * m + s for k, (m, s) in prices.items()})
    return sum(prices[k][0] for k in pairs), sum(prices[k][1] for k in pairs)


def test_nested_rows_against_all_pairs(spark, tmp_path):
    """Prices from the innermost arrays outwards are what pricing all pairs, by recursion, gives."""
    r = random.Random(9)
    docs = {f"d{n}": [[random_row(r, 2) for _ in range(r.randint(1, 4))] for _ in range(2)] for n in range(80)}
    sides = [spark.createDataFrame([(d, ["kx"], f"i{i:010d}", list(rel), v) for d, both in docs.items() for i, x in enumerate(both[k]) for rel, v in leaves_of(x)], LEAF) for k in (0, 1)]
    edges, _ = pricing.edges(sides[1], sides[0], False, f"file://{tmp_path}", True)
    edges.write.parquet(f"file://{tmp_path}/edges")
    edges = spark.read.parquet(f"file://{tmp_path}/edges")
    for way in (pricing.groups_matched(edges, "doc_id", "block"), large.matched(edges, f"file://{tmp_path}/large")):
        got = {x.doc_id: (x.m, x.s) for x in way.join(edges, ["doc_id", "array", "pred", "gold"]).groupBy("doc_id").agg(F.sum("matched").alias("m"), F.sum("shared").alias("s")).collect()}
        assert got == {d: w for d, (p, g) in docs.items() if (w := all_pairs(p, g)) != (0, 0)}


def test_ordered_arrays_inside_rows_keep_their_order(spark, tmp_path):
    """What lies in an ordered array is compared by place, and so are arrays in it."""
    leaf = lambda rel, v: ("d", ["kx"], "i0000000000", rel, v)
    i = "i000000000"
    sides = [spark.createDataFrame([leaf(["ko", f"{i}{a}", "ku", f"{i}0"], "x"), leaf(["ku", f"{i}{a}"], "y"), leaf(["kv"], "z")], LEAF) for a in (0, 1)]
    got = pricing.edges(*sides, [["kx", "i", "ko"]], f"file://{tmp_path}", True)[0].first()
    assert (got.matched, got.shared) == (2, 2)


def test_leaves_of_small_arrays_move_once(spark, tmp_path):
    """Pricing and matching flat rows has one exchange for each side's leaves, and joins and aggregates none."""
    rows = [("d", ["kx"], f"i{i:010d}", ["ka"], str(i)) for i in range(9)]
    side = spark.createDataFrame(rows, LEAF)
    edges, _ = pricing.edges(side, side, False, f"file://{tmp_path}", False, True)
    plan = pricing.groups_matched(edges, *pricing.PLACE, dealt=True)
    with pricing.co_located(spark):
        text = plan._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in text.splitlines() if "Exchange" in x and "Reused" not in x]
    assert moved and all("hashpartitioning(doc_id" in x and ", REPARTITION_BY_NUM" in x or "Broadcast" in x for x in moved), text
    assert plan.where("pred = gold").count() == 9


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_groups_are_whole_in_any_batches(size):
    rows = [(d, k) for d in "abc" for k in range(3) for _ in range(1 + k * 2)]
    table = pa.table({"d": [d for d, _ in rows], "k": [k for _, k in rows], "n": range(len(rows))})
    batches = table.to_batches(max_chunksize=size)
    batches.insert(1, batches[0].slice(0, 0))
    got = []
    for batch, starts in pricing.whole_groups(iter(batches), ("d", "k")):
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            got.append([tuple(x.values()) for x in batch.slice(low, high - low).to_pylist()])
    assert got == [[(d, k, i) for i, x in enumerate(rows) if x == (d, k)] for d in "abc" for k in range(3)]


def edge_table(spark, edges):
    rows = [(d, ["kx"], f"p{p}", f"g{g}", p, g, 7 * p, 5 * g, w) for d, found in edges.items() for (p, g), w in found.items()]
    return spark.createDataFrame(rows, "doc_id string, array array<string>, pred string, gold string, pred_row long, gold_row long, pred_content long, gold_content long, weight long")


def test_best_first_in_rounds(spark, tmp_path):
    """As greedy() on random arrays; edges of one weight don't make a round each."""
    r = random.Random(4)
    edges = {}
    for d in "abc":
        cells = [(p, g) for p in range(12) for g in range(9) if r.random() < 0.5]
        edges[d] = dict(zip(cells, r.sample(range(1000), len(cells)), strict=True))
    got = large.best_first(edge_table(spark, edges), f"file://{tmp_path}/a").collect()
    for d, found in edges.items():
        assert {(x.pred_row, x.gold_row) for x in got if x.doc_id == d} == set(assignment.greedy(found))
    equal = large.best_first(edge_table(spark, {"d": {(p, g): 3 for p in range(30) for g in range(30)}}), f"file://{tmp_path}/b").collect()
    assert len({x.pred_row for x in equal}) == len({x.gold_row for x in equal}) == len(equal) == 30
    assert len(list((tmp_path / "b").glob("taken-*"))) < 15
    assert large.best_first(edge_table(spark, {"d": {}}), f"file://{tmp_path}/c").count() == 0


def test_components_of_one_array_go_to_many_tasks(spark, tmp_path):
    """10,000 components of one array: each is solved by itself, in more than one task, and one that is too large is told."""
    edges = {}
    for i in range(10_000):
        edges |= {(2 * i, 2 * i): 5, (2 * i, 2 * i + 1): 4, (2 * i + 1, 2 * i): 4}
    placed = large.matched(edge_table(spark, {"d": edges}), f"file://{tmp_path}/a").withColumn("task", F.spark_partition_id())
    tasks = {x.task: x.n for x in placed.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert sum(tasks.values()) == 20_000 and sum(n > 1_000 for n in tasks.values()) > 1
    assert placed.where("substring(pred, 2) = substring(gold, 2)").count() == 0  # 4 + 4 is more than 5


def test_components_too_large_to_solve(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assignment, "MAX_EXACT_SIDE", 2)
    edges = {(p, g): 10 + p for p in range(4) for g in range(5)} | {(9, 9): 3, (9, 10): 4, (11, 9): 4}
    got = large.matched(edge_table(spark, {"d": edges}), f"file://{tmp_path}/b").collect()
    assert sorted(x.large for x in got if x.pred is None) == [5]
    pairs = {(x.pred, x.gold) for x in got if x.pred is not None}
    assert {("p9", "g10"), ("p11", "g9")} <= pairs and len(pairs) == 6


def chain(n):
    return [(i, i + 1) for i in range(n)]


def test_components_of_links(spark, tmp_path):
    links = chain(60) + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 200 + i) for i in range(50)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}").collect()
    assert dict(map(tuple, got)) == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 103), 100), **dict.fromkeys(range(200, 250), 200)}


SPEC = {"type": "object", "properties": {"rows": {"type": "array", "items": {"type": "object", "properties": {k: {"type": "string"} for k in ("a", "b", "c")}}}}}


def graded_rows(spark, gold, pred, spec=SPEC, levels=1):
    docs = spark.createDataFrame([("d", "s", json.dumps({"rows": gold}), json.dumps({"rows": pred}), json.dumps(spec))], "doc_id string, suite string, gold string, pred string, schema string")
    return grade.grade(docs, levels=levels).scores.first()


def test_crowded_arrays(spark, monkeypatch):
    """Rows with a rare value find their partner by it; those with common values alone are paired by these."""
    monkeypatch.setattr(align, "LARGE", 100)
    monkeypatch.setattr(align, "CROWDED", 500)
    r = random.Random(5)
    gold = [{"a": f"n{i}", "b": f"flag {i % 2}", "c": f"word {i % 3}"} for i in range(60)] + [{"b": f"flag {i % 2}", "c": f"word {i % 3}"} for i in range(30)]
    pred = [dict(x, c="other") if i % 5 == 0 and "a" in x else x for i, x in enumerate(gold)] + [{"b": "flag 0"}]
    done = graded_rows(spark, gold, r.sample(pred, len(pred)))
    assert (done.matched, done.misread, done.unfound, done.invented_item) == (60 * 3 + 30 * 2 - 12, 12, 0, 1)
    assert not done.matching_exact and done.approximated == [91]


def test_a_flag_of_20000_rows_makes_few_pairs(spark, monkeypatch):
    r = random.Random(7)
    gold = [{"a": f"n{i}", "b": f"flag {r.randrange(3)}", "c": "all alike"} for i in range(20_000)]
    edges, counted = large.matched, []
    monkeypatch.setattr(large, "matched", lambda e, folder: counted.append(e.count()) or edges(e, folder))
    began = time.time()
    done = graded_rows(spark, gold, r.sample(gold, len(gold)))
    assert (done.matched, done.matching_exact) == (60_000, False) and max(counted) == 20_000 and time.time() - began < 200


def test_many_nested_rows(spark):
    """1,000 by 1,000 rows with arrays inside, of few values: every pair of rows has inner rows in common."""
    r = random.Random(2)
    gold = [{"a": f"n{i}", "b": f"word {i % 7}", "items": [{"k": f"k{r.randrange(40)}", "v": f"v{r.randrange(2_000)}"} for _ in range(3)]} for i in range(1_000)]
    pred = [dict(x, items=r.sample(x["items"], 3)) for x in r.sample(gold, len(gold))]
    spec = {"type": "object", "properties": {"rows": {"type": "array", "items": {"type": "object", "properties": {"a": {"type": "string"}, "items": {"type": "array"}}}}}}
    began = time.time()
    done = graded_rows(spark, gold, pred, spec, levels=2)
    assert (done.matched, done.total, done.matching_exact) == (8_000, 8_000, True) and time.time() - began < 300


@pytest.mark.parametrize("words", [8])
def test_the_largest_array(spark, words):
    """6,900 rows by 3,450 with a field of few values: millions of pairs with an equal value, solved exactly."""
    r = random.Random(1)
    gold = [{"a": f"n{i}", "b": round(i * 1.5, 2), "c": f"word{r.randrange(words)}"} for i in range(6_900)]
    spec = {"type": "object", "properties": {"rows": {"type": "array", "items": {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "number"}, "c": {"type": "string"}}}}}}
    docs = spark.createDataFrame([("d", "s", json.dumps({"rows": gold}), json.dumps({"rows": r.sample(gold, 3_450)}), json.dumps(spec))], "doc_id string, suite string, gold string, pred string, schema string")
    began = time.time()
    done = grade.grade(docs, levels=1).scores.first()
    assert time.time() - began < 300
    assert (done.matched, done.misread, done.unfound, done.matching_exact) == (3 * 3_450, 0, 3 * 3_450, True)


def test_prices_of_flat_rows_look_at_no_steps(spark, tmp_path, capsys):
    """Filters that joins infer once walked through addresses for every leaf, several times."""
    from tallyleaf.operators import align, pricing

    rows = [("d", ["krows", f"i{i:010d}", k], str(v)) for i in range(3) for k, v in (("ka", i), ("kb", 7))]
    leaves = spark.createDataFrame(rows, "doc_id string, address array<string>, canon string")
    sides = [align.laid(leaves, 1, f"file://{tmp_path}/{name}") for name in ("gold", "pred")]
    for found in (pricing.edges(*sides, False, f"file://{tmp_path}", False, True)[0], align.weights(*sides)):
        capsys.readouterr()
        found.explain()
        assert "lambda" not in capsys.readouterr().out
        assert sorted((r.pred[-1], r.gold[-1], r.matched, r.shared) for r in found.collect()) == sorted((str(p), str(g), 1 + (p == g), 2) for p in range(3) for g in range(3))

import json

import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import profile, summaries
from tallyleaf.plans import grade
from tallyleaf.sources import manifest, runs
from tallyleaf.streaming import grading

SCHEMA = json.dumps({"type": "object", "properties": {"a": {"type": "string"}}})
COLUMNS = "doc_id string, suite string, doc_path string, gt_path string, schema string"


def rows(spark, *changes):
    base = {"doc_id": "d", "suite": "s", "doc_path": "p", "gt_path": "g", "schema": SCHEMA}
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], COLUMNS)


@pytest.mark.parametrize("change", [{"doc_id": None}, {"doc_id": "a/b"}, {"schema": "[]"}, {"schema": "{}"}, {"schema": "no"}, {"doc_path": "../x"}, {"gt_path": "/x"}])
def test_bad_manifests(spark, change):
    with pytest.raises(ValueError):
        manifest.checked(rows(spark, {"doc_id": "fine"}, change))


def test_manifest_ids_ignore_case_and_suites_default(spark):
    with pytest.raises(ValueError, match="twice"):
        manifest.checked(rows(spark, {"doc_id": "A"}, {"doc_id": "a"}))
    with pytest.raises(ValueError, match="no rows"):
        manifest.checked(rows(spark))
    with pytest.raises(TypeError):
        manifest.checked(rows(spark, {}).withColumn("suite", F.lit(3)))
    assert [r.suite for r in manifest.checked(rows(spark, {"suite": " "})).collect()] == ["other"]


def test_folder_to_run_files(spark, tmp_path):
    for d in ("gold", "predictions"):
        (tmp_path / d).mkdir()
    for i, (gold, pred) in enumerate([("x", '{"a":"X"}'), ("y", None), ("z", "[1]")]):
        (tmp_path / f"gold/d{i}.json").write_text("﻿" * (i == 0) + json.dumps({"a": gold}), encoding="utf-8")
        if pred:
            (tmp_path / f"predictions/d{i}.json").write_text(pred)
    rows(spark, *[{"doc_id": f"d{i}", "suite": None if i else "first"} for i in range(3)]).write.parquet(str(tmp_path / "manifest.parquet"))
    m = manifest.read(spark, str(tmp_path))
    docs = manifest.with_predictions(manifest.with_golds(m, manifest.json_files(spark, str(tmp_path / "gold"), "gold")), manifest.json_files(spark, str(tmp_path / "predictions"), "pred"))
    assert {r.doc_id: r.failure for r in docs.collect()} == {"d0": None, "d1": "no_answer", "d2": "unusable"}
    done = grade.grade(docs, levels=0)
    assert {r.doc_id: r.accuracy for r in done.scores.collect()} == {"d0": 1.0, "d1": 0.0, "d2": 0.0}
    out = str(tmp_path / "run")
    runs.write_scores(done.scores, out)
    runs.write_details(done.verdicts, docs, out)
    runs.write_summary(done.summary, out, summaries.coverage(docs))
    assert spark.read.json(f"{out}/scores").where("row.suite = 'first'").count() == 1
    assert spark.read.json(f"{out}/details").where("document = 'd1'").first().result == "unfound"
    one = json.loads(spark.read.text(f"{out}/summary").first().value)
    assert one["overall"]["rows"] == 3 and one["suites"]["first"]["accuracy"] == 1
    assert round(summaries.unified(done.scores).first().unified, 6) == 0.5
    with pytest.raises(ValueError):
        manifest.with_golds(m, manifest.json_files(spark, str(tmp_path / "predictions"), "gold"))


def test_profiles(spark, tmp_path):
    gold = {"a": 1, "rows": [{"x": None, "items": [{"y": 2}]}, {"x": 3, "items": []}]}
    golds = spark.createDataFrame([("d", json.dumps(gold)), ("n", None)], "doc_id string, gold string")
    pages = spark.createDataFrame([("d", 1, "x" * 200), ("d", 2, ""), ("d", 3, None), ("d", 4, "y" * 999)], "doc_id string, page int, text string")
    m = rows(spark, {}, {"doc_id": "n"}).withColumn("pages", F.lit(-1)).withColumn("mine", F.lit(7))
    out = {r.doc_id: r for r in profile.described(m, golds, pages).collect()}
    d = out["d"]
    assert (d.gold_chars, d.table_rows, d.num_values, d.num_null, d.max_depth, d.pages, d.scanned, d.mine) == (64, [2, 1], 4, 1, 3, 4, False, 7)
    assert out["n"].gold_chars is None
    path = str(tmp_path / "m.parquet")
    manifest.write_new(m, path)
    with pytest.raises(ValueError):
        manifest.write_new(m, path, (f"file://{path}",))


def test_manifests_are_numbered_in_their_order(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    rows(spark, *[{"doc_id": f"d{i:03d}"} for i in range(200)]).coalesce(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 2_000).parquet(path)
    rows(spark, *[{"doc_id": f"e{i:03d}"} for i in range(70)]).repartition(4).write.mode("append").parquet(path)
    got = manifest.read(spark, str(tmp_path), "m.parquet").select("doc_id", "ordinal").collect()
    assert sorted(r.ordinal for r in got) == list(range(270))
    at = {r.doc_id: r.ordinal for r in got}
    assert [at[f"d{i:03d}"] - at["d000"] for i in range(200)] == list(range(200))


def test_samples_and_checks(spark):
    m = spark.range(10).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.col("id").alias("ordinal"))
    assert sorted(r.doc_id for r in runs.sampled(m, 3).collect()) == ["d3", "d6", "d9"]
    assert runs.sampled(m, 99).count() == 10 and runs.sampled(m, 0).count() == 0
    assert [r.doc_id for r in runs.only(m, ["d2"]).collect()] == ["d2"]
    with pytest.raises(ValueError):
        runs.only(m, ["d2", "zz"])
    none = spark.createDataFrame([], "suite string, accuracy double, precision double, recall double, total long, misread long, unfound long, fabricated long, invented_item long, invented_field long")
    with pytest.raises(ValueError):
        summaries.checked_summary(none)


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.createDataFrame([("d", "s", '{"a":"x"}', SCHEMA), ("e", "s", '{"a":"y"}', SCHEMA)], "doc_id string, suite string, gold string, schema string")
    for name in ("d", "e"):
        spark.createDataFrame([(name, '{"a":"x"}')], "doc_id string, pred string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id string, pred string").parquet(source)
        grading.grade_stream(stream, docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.doc_id: r.accuracy for r in grading.scores(spark, str(tmp_path / "out")).collect()} == {"d": 1.0, "e": 0.0}


def test_the_last_answer_of_a_document_counts_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(f"d{i}", "st"[i % 2], '{"a":"x"}', SCHEMA) for i in range(6)], "doc_id string, suite string, gold string, schema string")
    assert grading.summary(spark, out) is None is grading.scores(spark, out)
    batches = [[("d0", "x", 1), ("d0", "y", 2), ("d1", "x", 1)], [("d0", "x", 3), ("d2", "y", 1), ("d2", "x", 0)], [("d3", None, 1), ("d1", "y", 9)], [("d9", "x", 1), ("d2", "x", 1)]]
    for rows in batches:
        spark.createDataFrame([(d, None if v is None else json.dumps({"a": v}), at) for d, v, at in rows], "doc_id string, pred string, at int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id string, pred string, at int").parquet(source)
        grading.grade_stream(stream, docs, out, str(tmp_path / "state"), by="at").awaitTermination()
    found = grading.scores(spark, out)
    assert {r.doc_id: r.accuracy for r in found.collect()} == {"d0": 1.0, "d1": 0.0, "d2": 1.0, "d3": 0.0}
    shown = lambda df: [(r.grain, r.suite, r.rows, round(r.accuracy, 9), round(r.unfound_rate, 9), round(r.misread_rate, 9)) for r in df.collect()]
    assert shown(grading.summary(spark, out)) == shown(summaries.summary(found)) and len(shown(grading.summary(spark, out))) == 3


def test_history_is_read_from_a_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    for n in range(9):
        rows = [(f"d{n % 4}", n), (f"only{n}", n)]
        before = runs.newest(spark, path)
        spark.createDataFrame(rows, "doc_id string, v int").coalesce(1).write.parquet(f"{path}/call={runs.next_call(before)}")
        runs.compact(spark, path, calls=4)
        (tmp_path / f"records/call={n + 100}").mkdir()  # never came to its end
    snapshot, calls = runs._parts(spark, path, None)
    assert snapshot.endswith("snapshot=7") and [c[-6:] for c in calls] == ["call=8"]
    got = {r.doc_id: (r.v, r.call) for r in runs.newest(spark, path).collect()}
    assert got == {f"d{k}": (max(n for n in range(9) if n % 4 == k),) * 2 for k in range(4)} | {f"only{n}": (n, n) for n in range(9)}
    assert {r.v for r in runs.newest(spark, path, 3).collect()} == {0, 1, 2} and runs.last_call(spark, path, 8) is None and runs.last_call(spark, path).count() == 2


def graded_documents(spark, *changes):
    return spark.createDataFrame([(f"d{i}", "s", gold, pred, SCHEMA) for i, (gold, pred) in enumerate(changes)], "doc_id string, suite string, gold string, pred string, schema string")


def test_score_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = graded_documents(spark, ('{"a":"x"}', '{"a":"X"}'), ('{"a":"y"}', None), ('{"a":"z"}', "{}"))
    first, summary = grade.grade_cached(docs, cache, levels=0)
    want = {r.doc_id: r.accuracy for r in grade.grade(docs, levels=0).scores.collect()}
    assert {r.doc_id: r.accuracy for r in first.collect()} == want and summary.where("grain = 'overall'").first().rows == 3
    changed = graded_documents(spark, ('{"a":"x"}', '{"a":"X"}'), ('{"a":"y"}', '{"a":"Y"}'), ('{"a":"z"}', "{}"))
    second, _ = grade.grade_cached(changed, cache, levels=0)
    assert {r.doc_id: r.accuracy for r in second.collect()} == want | {"d1": 1.0}
    assert [r["count"] for r in spark.read.parquet(cache).groupBy("call").count().orderBy("call").collect()] == [3, 1]
    grade.grade_cached(changed, cache, levels=0)
    assert spark.read.parquet(cache).count() == 4  # nothing was scored again
    grade.grade_cached(changed, cache, order=True, levels=0)
    assert spark.read.parquet(cache).count() == 7  # another way of scoring


def test_own_scorer_and_fields(spark):
    class KeysFound:
        fields = "keys_found double"

        def score(self, pred, gold):
            return {"keys_found": sum(k in pred for k in gold) / len(gold)}

        def score_failure(self, gold):
            return {"keys_found": 0.0}

        def summarize(self, lines):
            return lines.agg(F.avg("keys_found").alias("keys_found"))

    docs = graded_documents(spark, ('{"a":"x"}', '{"a":"q"}'), ('{"a":"y","b":1}', '{"b":2}'), ('{"a":"z"}', None))
    lines, summary = grade.grade_with(docs, KeysFound())
    assert {r.doc_id: r.keys_found for r in lines.collect()} == {"d0": 1.0, "d1": 0.5, "d2": 0.0} and summary.first().keys_found == 0.5

    class Broken(KeysFound):
        def score(self, pred, gold):
            return {"keys_found": 1 / (len(gold) - 1)}

    with pytest.raises(Exception, match="ZeroDivisionError"):
        grade.grade_with(docs, Broken())[0].collect()
    part = grade.grade_with(docs, Broken(), partial=True)[0]
    assert {r.doc_id: (r.keys_found, r.failure) for r in part.collect()} == {"d0": (0.0, "not_scored"), "d1": (1.0, None), "d2": (0.0, "no_answer")}
    told = summaries.coverage(part, partial=True).first()
    assert (told.answered, told.not_scored, told.no_answer, told.partial, told.examples) == (1, 1, 1, True, ["d0"])
    more = grade.with_fields(grade.grade(docs, levels=0).scores, docs.withColumn("mine", F.lit(7)), "mine")
    assert {r.mine for r in more.collect()} == {7}

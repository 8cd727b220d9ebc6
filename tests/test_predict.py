import json

import pytest

from tallyleaf import cli
from tallyleaf.plans import predict

SCHEMA = json.dumps({"type": "object", "properties": {"a": {"type": "string"}}})


def test_run_resume_and_grade(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "s", f"p{i}", f"g{i}", SCHEMA) for i in range(3)], "doc_id string, suite string, doc_path string, gt_path string, schema string")
    golds = spark.createDataFrame([(f"d{i}", '{"a":"x"}') for i in range(3)], "doc_id string, gold string")
    folder = f"file://{tmp_path}/run"
    first = predict.predict(docs.where("doc_id < 'd2'"), predict.Echo({"p0": {"a": "X"}}), folder)
    assert {r.doc_id: (r.error is None) or r.error.transient for r in first.collect()} == {"d0": True, "d1": True}
    with pytest.raises(ValueError, match="1 documents have no answer, such as d2"):
        predict.grade_run(docs, golds, first, "plain", folder)
    asked = predict.predict(docs, predict.Echo({"p2": {"a": "y"}}), folder)
    assert {r.doc_id for r in asked.where("call = 1").collect()} == {"d2"}
    done = predict.predict(docs, predict.Echo({"p1": {}}), folder, retry_failed=True)
    graded = predict.grade_run(docs, golds, done, "plain", folder)
    assert {r.doc_id: r.accuracy for r in graded.scores.collect()} == {"d0": 1.0, "d1": 0.0, "d2": 0.0}
    assert spark.read.json(f"{folder}/scores").count() == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["dialects"]) == 0
    assert "strict" in capsys.readouterr().out
    (tmp_path / "g.json").write_text("﻿" + json.dumps({"a": "x"}), encoding="utf-8")
    assert cli.main(["score", "--pred", '{"a":"X"}', "--gold", str(tmp_path / "g.json"), "--schema", SCHEMA, "--details"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["accuracy"] == 1 and out["verdicts"][0]["address"] == "a"
    assert cli.main(["score", "--pred", "{}", "--gold", str(tmp_path / "no.json"), "--schema", SCHEMA]) == 1
    with pytest.raises(SystemExit):
        cli.main(["score", "--pred", "[]", "--gold", "{}", "--schema", SCHEMA])


def dataset(spark, folder):
    (folder / "gold").mkdir(parents=True)
    for i, v in enumerate("xyz"):
        (folder / f"gold/d{i}.json").write_text(json.dumps({"a": v}))
    spark.createDataFrame([(f"d{i}", "s", f"p{i}", f"gold/d{i}.json", SCHEMA) for i in range(3)], "doc_id string, suite string, doc_path string, gt_path string, schema string").write.parquet(f"file://{folder}/manifest.parquet")


def test_run_resume_and_grade_commands(spark, tmp_path, capsys):
    dataset(spark, tmp_path / "data")
    assert cli.main(["init", "echo"]) == 0
    config = json.loads(capsys.readouterr().out) | {"dataset": f"file://{tmp_path}/data"}
    out = f"file://{tmp_path}/run"
    told = ["run", "--config", json.dumps(config), "--out", out, "-y", "--set", 'options.known={"p0": {"a": "X"}, "p1": {"a": "?"}}']
    assert cli.main(told) == 0
    told_of = json.loads(capsys.readouterr().out)
    assert (told_of["rows"], round(told_of["headline"], 4), told_of["headline_is"]) == (3, 0.3333, "accuracy") and "partial" not in told_of
    assert told_of["failed"] == {"system": 1, "unusable": 0, "no_answer": 0, "not_scored": 0} and round(told_of["suites"]["s"]["accuracy"], 4) == 0.3333
    cause = spark.read.json(f"{out}/coverage").first()
    assert (cause.documents, cause.answered, cause.system, cause.partial) == (3, 2, 1, False)
    assert cli.main(told) == 1 and "resume" in capsys.readouterr().err
    (tmp_path / "run/run.json").write_text(json.dumps(config | {"options": {"known": {"p2": {"a": "z"}}}}))
    assert cli.main(["resume", out]) == 0  # the failure isn't asked for again
    assert round(json.loads(capsys.readouterr().out)["headline"], 4) == 0.3333
    assert cli.main(["resume", out, "--retry-failed"]) == 0
    assert round(json.loads(capsys.readouterr().out)["headline"], 4) == 0.6667
    assert cli.main(["grade", out, "--no-details"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 3
    assert cli.main(["run", "--config", "{}", "--out", f"{out}2", "-y"]) == 1
    assert cli.main(["run", "--config", json.dumps(config), "--out", f"{out}2", "-y", "--set", "what"]) == 1


def test_grading_an_unfinished_run(spark, tmp_path, capsys):
    dataset(spark, tmp_path / "data")
    out = f"file://{tmp_path}/run"
    docs = cli.manifest.read(spark, f"file://{tmp_path}/data").where("doc_id < 'd2'")
    predict.predict(docs, predict.Echo({"p0": {"a": "x"}, "p1": {"a": "y"}}), out)
    (tmp_path / "run/run.json").write_text(json.dumps(cli.CONFIG | {"system": "echo", "dataset": f"file://{tmp_path}/data"}))
    capsys.readouterr()
    assert cli.main(["grade", out]) == 1
    refused = capsys.readouterr().err
    assert "isn't finished" in refused and "d2" in refused and "--partial" in refused
    assert cli.main(["grade", out, "--partial"]) == 0
    told = json.loads(capsys.readouterr().out)
    # d2 has no answer: it counts with 0.
    assert (told["rows"], round(told["headline"], 4), round(told["coverage"], 4)) == (3, 0.6667, 0.6667)
    assert told["failed"]["no_answer"] == 1 and told["partial"] == {"no_answer": 1, "not_scored": 0, "e.g.": ["d2"]}
    assert spark.read.json(f"{out}/coverage").first().partial is True
    assert json.loads(spark.read.text(f"{out}/summary").first().value)["partial"]["e.g."] == ["d2"]


def test_grading_a_folder_of_predictions(spark, tmp_path, capsys):
    """One of two documents is answered: refused, or, in part, half right."""
    data, mine = tmp_path / "data", tmp_path / "mine"
    dataset(spark, data)
    (mine / "predictions").mkdir(parents=True)
    for d, text in (("d0", '{"a": "x"}'), ("d1", '["no", "object"]')):
        (mine / f"predictions/{d}.json").write_text(text)
    given = ["grade", f"file://{mine}", "--dataset", f"file://{data}"]
    assert cli.main(given) == 1 and "d2" in capsys.readouterr().err
    assert not (mine / "scores").exists()
    assert cli.main([*given, "--partial"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["failed"] == {"system": 0, "unusable": 1, "no_answer": 1, "not_scored": 0} and round(told["headline"], 4) == 0.3333
    (mine / "predictions/d2.json").write_text("{}")
    assert cli.main(given) == 0 and "partial" not in json.loads(capsys.readouterr().out)


def test_runs_of_some_rows(spark, tmp_path, capsys):
    dataset(spark, tmp_path / "data")
    config = json.dumps({"system": "echo", "dataset": f"file://{tmp_path}/data", "options": {"known": {f"p{i}": {"a": v} for i, v in enumerate("xyz")}}})
    for n, (change, want) in enumerate({'rows.only=["d1"]': {"d1"}, "rows.limit=2": {"d0", "d1"}, "rows.sample=1": {"d2"}, "rows.limit=0": {"d0", "d1", "d2"}}.items()):
        out = f"file://{tmp_path}/run{n}"
        assert cli.main(["run", "--config", config, "--out", out, "-y", "--set", change, "--no-details"]) == 0
        told = json.loads(capsys.readouterr().out)
        assert (told["rows"], told["headline"]) == (len(want), 1.0) and {r.doc_id for r in predict.existing(spark, out).collect()} == want
    for wrong, near in (("rows.onyl=[]", "rows.only"), ("datset=x", "dataset"), ("rows.limit=-1", "rows.limit"), ('rows.only=["zz"]', "zz")):
        assert cli.main(["run", "--config", config, "--out", f"file://{tmp_path}/no", "-y", "--set", wrong]) == 1
        assert near in capsys.readouterr().err


def counted(folder):
    """A system that counts its calls in a folder, and stops the run at documents that the folder names."""

    class Counted(predict.Echo):
        def extract(self, doc_path, schema):
            import os
            import time
            import uuid

            if os.path.exists(f"{folder}/stop-{doc_path}"):
                time.sleep(1)
                raise KeyError(doc_path)
            with open(f"{folder}/call-{doc_path}-{uuid.uuid4().hex}", "w"):
                pass
            if doc_path == "slow":
                time.sleep(30)
            return {"extraction": {"a": doc_path}}

    return Counted({})


def test_answers_are_asked_for_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"p{i}", SCHEMA) for i in range(20)], "doc_id string, doc_path string, schema string").coalesce(1)
    system, folder = counted(str(tmp_path)), f"file://{tmp_path}/run"
    (tmp_path / "stop-p15").touch()
    with pytest.raises(Exception, match="p15"):
        predict.predict(docs, system, folder, workers=3)
    before = len(list(tmp_path.glob("call-*")))
    assert before >= 12 and predict.existing(spark, folder) is None
    (tmp_path / "stop-p15").unlink()
    done = predict.predict(docs, system, folder, workers=3)
    assert done.count() == 20 and len(list(tmp_path.glob("call-*"))) == 20
    assert {r.raw for r in done.collect()} == {json.dumps({"extraction": {"a": f"p{i}"}}) for i in range(20)}
    assert not list((tmp_path / "run/journal").glob("call-0/*"))


def test_a_document_has_a_time_limit(spark, tmp_path):
    import time

    docs = spark.createDataFrame([(d, d, SCHEMA) for d in ("a", "slow", "b")], "doc_id string, doc_path string, schema string").coalesce(1)
    began = time.time()
    got = {r.doc_id: r for r in predict.records(docs, counted(str(tmp_path)), workers=2, timeout=2).collect()}
    assert time.time() - began < 25
    assert got["slow"].error.type == "timeout" and got["slow"].error.transient and got["a"].error is None is got["b"].error


def test_systems_and_their_failures(spark, capsys):
    assert cli.main(["systems"]) == 0 and "echo" in json.loads(capsys.readouterr().out)
    assert cli.main(["systems", "echo/any"]) == 0 and json.loads(capsys.readouterr().out)["reader"] == "plain"
    assert cli.main(["systems", "nobody"]) == 1
    capsys.readouterr()
    assert cli.main(["predict", "--system", "echo", "--doc", "p", "--schema", SCHEMA, "--options", '{"known": {"p": {"a": 1}}}']) == 0
    assert json.loads(capsys.readouterr().out)["raw"] == {"extraction": {"a": 1}}
    assert cli.main(["predict", "--system", "echo", "--doc", "q", "--schema", SCHEMA]) == 1

    class Late(predict.Echo):
        def extract(self, doc_path, schema):
            raise TimeoutError("too late") if doc_path == "p0" else ConnectionRefusedError("no")

    bad = json.dumps({"properties": {"a": []}, "items": {"properties": [1]}})
    docs = spark.createDataFrame([("d0", "p0", SCHEMA), ("d1", "p1", SCHEMA), ("d2", "p2", bad), ("d3", "p3", "nothing")], "doc_id string, doc_path string, schema string")
    got = {r.doc_id: r.error for r in predict.records(docs, Late({}, "fields")).collect()}
    assert (got["d0"].type, got["d0"].transient, got["d1"].type, got["d1"].transient) == ("timeout", True, "unreachable", True)
    assert got["d3"].type == "dialect" and got["d3"].transient is False


def test_names_and_payloads():
    one = predict.analyzer_name("a", fieldSchema={"x": 1, "y": 2}, completion="m", api_version="1")
    assert one == predict.analyzer_name("a", api_version="1", completion="m", fieldSchema={"y": 2, "x": 1}) != predict.analyzer_name("a", fieldSchema={"x": 1, "y": 2}, completion="m", api_version="2")
    assert len(one) == 18
    assert predict.job_payload("f", {}, "m")["instructions"] == {"schema": {}} and predict.job_payload("f", {}, "m", "p")["instructions"]["system_prompt"] == "p"

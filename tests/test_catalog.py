"""Queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

from tallyleaf.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pair_lines_reversed", "pair_invented_rows", "row_counts"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(frame, columns):
    cell = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_query_is_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)


def test_a_task_builds_no_more_documents_as_tables_grow(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyleaf.plans import fixtures

    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 500)
    for docs, tasks in ((fixtures.orders(spark, DATA), 10), (fixtures.customers(spark, DATA), 2)):
        per_task = docs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
        assert len(per_task) >= tasks and max(r.n for r in per_task) < 300
        if tasks > 2:
            assert docs.count() == fixtures.table(spark, DATA, "orders").join(fixtures.table(spark, DATA, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").count()


def test_tables_that_python_works_on_are_dealt(spark, monkeypatch):
    from tallyleaf.plans import fixtures

    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 40)
    # One small file is one split; 150 customers of these tables make four tasks.
    for name in ("compare_leaves", "canon_sign", "canon_money", "envelope_unwrap", "flatten_events_props", "gold_chars"):
        rows = catalog.QUERIES[name](spark, DATA)
        assert rows.rdd.getNumPartitions() >= 2, name
    assert catalog.compare_leaves(spark, DATA).rdd.getNumPartitions() == 4


def test_routes_of_events_are_found_in_many_tasks_without_folds(spark, monkeypatch):
    from tallyleaf.plans import fixtures

    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 25)
    plan = catalog.value_routes(spark, DATA)._jdf.queryExecution().toString()
    assert "hashpartitioning(event_id" in plan and "trace(" not in plan


def test_a_schema_is_changed_once_in_a_batch_and_schemas_are_dealt(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tallyleaf.operators import schemas
    from tallyleaf.plans import fixtures

    seen = []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: f)
    run = schemas.text_function(lambda s: seen.append(s) or s | {"b": "ä"})
    texts = ['{"a": 1}', None, '{"a":2}', '{"a": 1}', '{"a": 1}', None]
    assert run(pa.array(texts)).to_pylist() == ['{"a":1,"b":"ä"}', None, '{"a":2,"b":"ä"}', '{"a":1,"b":"ä"}', '{"a":1,"b":"ä"}', None]
    assert seen == [{"a": 1}, {"a": 2}]
    assert run(pa.array([None, None], pa.string())).to_pylist() == [None, None] and run(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.undo()
    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 25)
    for name in ("dialect_strict", "dialect_identity", "restore_reserved", "inline_references"):
        assert catalog.QUERIES[name](spark, DATA).rdd.getNumPartitions() == 8, name


def test_tasks_that_judge_arrays_grow_with_their_leaves(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyleaf.operators import align
    from tallyleaf.plans import fixtures, grade
    from tallyleaf.sources import tables

    monkeypatch.setattr(fixtures, "ROWS_OF_A_TASK", 500)
    monkeypatch.setattr(tables, "ROWS_OF_A_TASK", 500, raising=False)
    names, seen, kinds = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"), [], align._kinds
    monkeypatch.setattr(align, "_kinds", lambda *a: seen.append((kinds(*a), int(spark.conf.get(names[0])))) or seen[0][0])
    before = [spark.conf.get(n, None) for n in names]
    docs = catalog._flags(spark, DATA)
    assert max(r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()) < 250
    judged, _ = grade.judged(docs, levels=1)
    lines = fixtures.table(spark, DATA, "lineitem").count()
    held = [r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 2 * lines // 500 and max(held) < 1_000
    # Arrays are sized by numbers, without a sketch each, in as many tasks.
    assert seen[0][1] >= 2 * lines // 500 and "approx_count" not in seen[0][0]._jdf.queryExecution().toString()
    assert [spark.conf.get(n, None) for n in names] == before


def test_leaves_of_few_large_documents_are_dealt_anew(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from tallyleaf.sources import tables

    monkeypatch.setattr(tables, "ROWS_OF_A_TASK", 500)
    rows = spark.range(3_000).select((F.col("id") % 2).alias("doc_id"), F.array(F.col("id").cast("string")).alias("address"))
    one = tables.kept(rows.coalesce(1), f"file://{tmp_path}/one")
    dealt = tables.spread(one, 3_000, f"file://{tmp_path}/dealt", "doc_id", "address")
    assert len(dealt.inputFiles()) == 6 and dealt.exceptAll(rows).isEmpty() and dealt.count() == 3_000
    assert tables.spread(dealt, 3_000, f"file://{tmp_path}/again", "doc_id", "address") is dealt
    assert tables.spread(one, 400, f"file://{tmp_path}/few", "doc_id", "address") is one

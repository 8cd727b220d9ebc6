"""Documents made from relational tables, with predictions that differ in known ways.

Every difference follows from keys by arithmetic, so what a grading has to find can be said in SQL
over the tables themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task builds documents from.
ROWS_OF_A_TASK = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for a table, as many as there are cores at least; a task's rows don't grow with the table. The count comes from the file's footer."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_OF_A_TASK))


def dealt(rows: DataFrame, key: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """Rows on as many tasks as are named or there are cores: what is flattened in Python may come from one small file. Best before documents are built from them."""
    return rows.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism, key)


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows Python works on, dealt by a key: a small file would be one task, however many rows it has."""
    rows = table(spark, sf_dir, name)
    return dealt(rows, key, tasks_for(rows))


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def dollars(x: Column) -> Column:
    """Like $1,234.50 or -$1,234.50."""
    d = money(x)
    return F.concat(F.when(d < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(d), 2))


def document(**fields: Column) -> Column:
    """JSON text of an object; null fields are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def schema(properties: dict) -> Column:
    return F.lit(json.dumps({"type": "object", "properties": properties}))


TEXT, NUMBER = {"type": "string"}, {"type": "number"}
CUSTOMER = {"name": TEXT, "balance": NUMBER, "segment": TEXT, "nation_key": {"type": "integer"}, "phone": TEXT}
LINE = {"part": {"type": "integer"}, "quantity": NUMBER, "price": NUMBER, "flag": TEXT}
ORDER = {"order": {"type": "integer"}, "status": TEXT, "total": NUMBER, "date": TEXT, "lines": {"type": "array", "items": {"type": "object", "properties": LINE}}}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat document per customer, suite: the nation. By key: every 3rd prediction spells money and name in another
    way, every 5th lacks the segment, every 7th has another balance, every 11th has a phone that the schema offers and
    every 13th a note that it doesn't."""
    rows = table(spark, sf_dir, "customer")
    c = dealt(rows, "c_custkey", tasks_for(rows)).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = "c_custkey"
    balance = F.when(every(k, 7), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    gold = document(name=F.col("c_name"), balance=money(F.col("c_acctbal")), segment=F.col("c_mktsegment"), nation_key=F.col("c_nationkey"))
    pred = document(
        name=F.when(every(k, 3), F.upper("c_name")).otherwise(F.col("c_name")),
        balance=F.when(every(k, 3), dollars(balance)).otherwise(money(balance).cast("string")),
        segment=F.when(~every(k, 5), F.col("c_mktsegment")),
        nation_key=F.col("c_nationkey"),
        phone=F.when(every(k, 11), F.lit("555-0100")),
        note=F.when(every(k, 13), F.lit("see reverse")),
    )
    return c.select(F.col(k).cast("string").alias("doc_id"), F.col("n_name").alias("suite"), gold.alias("gold"), pred.alias("pred"), schema(CUSTOMER).alias("schema"))


def lines_of_orders(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Lineitems numbered within their order by all their columns: o (key), i (from 0), n (of the order), part, quantity, price, flag."""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"), money(F.col("l_extendedprice")).alias("price"), F.col("l_returnflag").alias("flag"), "l_linenumber", "l_suppkey")
    w = W.partitionBy("o")
    return dealt(li, "o", tasks or tasks_for(li)).withColumns({"i": F.row_number().over(w.orderBy("part", "quantity", "price", "flag", "l_linenumber", "l_suppkey")) - 1, "n": F.count("*").over(w)})


def orders(spark: SparkSession, sf_dir: str, tagged: bool = True) -> DataFrame:
    """A document per order with its lines as an array, suite: the priority.

    Every line of the gold has a tag of its own, so partners are known. The prediction has the lines in the opposite
    order; a line whose part is a multiple of 5 has another quantity; in every 4th order the last line is missing, and in
    every 6th there is one more, which shares nothing with any.
    """
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    li = lines_of_orders(spark, sf_dir, tasks)
    tag = F.concat(F.lit("line x"), F.col("i").cast("string"))
    own = {"tag": tag} if tagged else {}
    line = F.struct(*[v.alias(k) for k, v in {**own, "part": F.col("part"), "quantity": F.col("quantity"), "price": F.col("price").cast("string"), "flag": F.col("flag")}.items()])
    read = F.struct(*[v.alias(k) for k, v in {**own, "part": F.col("part"), "quantity": F.when(F.col("part") % 5 == 0, F.col("quantity") + 1000).otherwise(F.col("quantity")), "price": F.concat(F.lit("$"), F.format_number(F.col("price"), 2)), "flag": F.lower("flag")}.items()])
    made = li.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))).alias("g"), F.sort_array(F.collect_list(F.when(~(every("o", 4) & (F.col("i") == F.col("n") - 1)), F.struct((-F.col("i")).alias("i"), read.alias("line"))))).alias("p"))
    extra = F.struct(*[v.alias(k) for k, v in {**({"tag": F.lit("invented")} if tagged else {}), "part": F.lit(-1).cast("bigint"), "quantity": F.lit(-1), "price": F.lit("$0.07"), "flag": F.lit("zz")}.items()])
    # Both sides are dealt by order already: the join moves nothing.
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey", tasks).join(made, F.col("o_orderkey") == F.col("o"))
    golds, preds = F.col("g")["line"], F.col("p")["line"]
    preds = F.when(every("o", 6), F.array_append(preds, extra)).otherwise(preds)
    spec = dict(ORDER, lines={"type": "array", "items": {"type": "object", "properties": {**({"tag": TEXT} if tagged else {}), **LINE}}})
    gold = document(order=F.col("o"), status=F.col("o_orderstatus"), total=money(F.col("o_totalprice")), date=F.date_format("o_orderdate", "yyyy-MM-dd"), lines=golds)
    pred = document(order=F.col("o"), status=F.col("o_orderstatus"), total=dollars(F.col("o_totalprice")), date=F.date_format("o_orderdate", "MM/dd/yyyy"), lines=preds)
    return o.select(F.col("o").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("suite"), gold.alias("gold"), pred.alias("pred"), schema(spec).alias("schema"))

"""Numbers of rows: from the places of rows in Parquet files, or written."""

from pyspark.sql import functions as F

from lectern.llm import minhash
from lectern.llm.common import durable, numbered, without


def files(spark, tmp_path, rows=5000, parts=7):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("x").alias("row"), F.repeat(F.lit("word "), 20).alias("text"))
    df.repartition(parts).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_a_row_has_one_number_however_it_is_read(spark, tmp_path):
    docs = files(spark, tmp_path)
    rows, row = numbered(docs)
    assert row == "row_" and rows.columns == ["doc_id", "row", "text", "row_"]
    whole = {r["doc_id"]: r[row] for r in rows.collect()}
    assert len(set(whole.values())) == len(whole) == 5000 and min(whole.values()) >= 0
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again = numbered(spark.read.parquet(str(tmp_path / "docs")))[0]
        assert {r["doc_id"]: r[row] for r in again.filter("doc_id % 3 = 0").collect()} == {i: n for i, n in whole.items() if i % 3 == 0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_rows_that_stand_several_times_are_told_apart(spark, tmp_path):
    docs = files(spark, tmp_path, 50, 2)
    for many in (docs.unionByName(docs), docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), docs.filter("doc_id >= 0").unionAll(docs)):
        rows, row = numbered(many)
        assert rows.select(row).distinct().count() == rows.count() == 100


def test_other_formats_and_empty_tables(spark, tmp_path):
    docs = files(spark, tmp_path, 40, 2)
    docs.write.json(str(tmp_path / "json"))
    rows, row = numbered(spark.read.json(str(tmp_path / "json")))
    assert rows.select(row).distinct().count() == 40
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert numbered(spark.read.parquet(str(tmp_path / "none")))[0].count() == 0


def test_decisions_shuffle_no_text(spark, tmp_path):
    rows, row = numbered(files(spark, tmp_path, 200, 2))
    signed = minhash.signatures(rows.select(F.col(row).alias("id_"), "text"), ["id_"])
    assert "Exchange" not in signed._jdf.queryExecution().executedPlan().toString()
    dropped = durable(rows.filter("doc_id < 20").select(row))
    kept = without(rows, dropped, row)
    assert kept.count() == 180
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "Sort") and "Broadcast" not in plan

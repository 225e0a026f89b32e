"""The corpus pipeline: quality, exact and near duplicates, mixing, packing, each stage on what the last one kept.

Defined results, of all stages: a null text counts as the empty one; rows are told apart by their place, not by
doc_id, so that null and repeated ids are documents of their own; further columns, whatever their names, are kept by
all but the last stage; an empty table gives an empty result. Of rows repeated whole, exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact, minhash, mixing, packing, quality, simhash
from lectern.llm.common import durable, free_name, numbered, read, without

THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. It is fitted on its input's labelled rows.

    Without labelled rows of both classes each document scores the share of good ones (0.5 without any label);
    empty texts are scored like any other.
    """
    model = quality.learn_quality(docs, read(spark, sf_dir, "labels"))
    return docs.filter(model.score("text") >= THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the most code points, then smallest doc_id, then first row.

    All is decided on numbers of rows; texts are shuffled once, where the dropped rows leave.
    """
    rows, row = numbered(docs)
    dropped = exact.exact_groups(rows, [row]).filter("NOT kept").select(row)
    return without(rows, durable(dropped), row).drop(row)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id (null last, then the first row) of each group of near-duplicates.

    Near are fingerprints as in op3_simhash, and whole sets of five-word shingles with a similarity of 0.8 or
    more, which mostly differ in more bits than fingerprints may. Texts without words are one group.
    """
    rows, row = numbered(docs)
    signed = minhash.signatures(rows.select(F.col(row).alias("id_"), F.col("doc_id").alias("given_"), "text"), ["id_", "given_"])
    signed = durable(signed.withColumnRenamed("id_", "doc_id"))
    keyed = durable(simhash.grouped(signed).withColumnsRenamed({"doc_id": "id_", "component_id": "root_"}))
    near = minhash.similar_roots(keyed, rows.select(F.col(row).alias("id_"), "text"))
    tops = keyed.select("id_", "given_", "root_").join(near.withColumnsRenamed({"node": "root_", "root": "top_"}), "root_", "left")
    tops = tops.select("id_", F.col("given_").alias("doc_id"), F.coalesce("top_", "root_").alias("top"))
    # what stands alone stays: only rows of larger groups are looked up
    groups = tops.groupBy("top").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = durable(tops.join(groups, "top"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "id_")
    first = members.groupBy("top").agg(F.min(order).alias("first")).select(F.col("first.id_").alias("id_"))
    dropped = durable(members.join(first, "id_", "left_anti").select(F.col("id_").alias(row)))
    return without(rows, dropped, row).drop(row)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources' words come near their targets; those without words stay once."""
    rows, row = numbered(docs)
    copies = mixing.mix(rows, row=[row]).select(row, F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("n"))
    n = free_name(rows, "copies")
    changed = durable(copies.filter("n <> 1").withColumnRenamed("n", n))
    times = F.array_repeat(F.lit(0), F.coalesce(n, F.lit(1)))
    return rows.join(changed.hint("shuffle_hash"), row, "left").withColumn(n, F.explode(times)).drop(row, n)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; an empty text is one piece, repeated rows are each packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier, XXH64 and a tokenizer take part: not to be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.stages import keep

#: A word is a run of anything but these white space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: What is cut off from its lineage is written to the folder in spark.checkpoint.dir and read again.
durable = keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column of numbers that tell its rows apart, and its name.

    A table read from Parquet as it is keeps its rows where they are: a number is made of a hash of the row's
    file, proven to differ from those of all other files, and the row's index in it, so it is the same however often
    and by whatever tasks the table is read. Anything else is written first, so that a row's number stays.
    """
    row = free_name(df, "row")
    place = _place_in_files(df)
    if place is None:
        return durable(df.withColumn(row, F.monotonically_increasing_id())), row
    return df.withColumn(row, place), row


def _place_in_files(df: DataFrame, tries: int = 8) -> Column | None:
    """A number of 63 bits for each row of a bare Parquet table: hash of the file, then index in the file. Else None."""
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None  # a row of a file may stand in it several times, or none may
    at = df.metadataColumn("_metadata")
    try:
        ends = df.select(at["file_path"].alias("file"), at["row_index"].alias("index"))
    except AnalysisException:
        return None  # another format
    files = durable(ends.groupBy("file").agg(F.max("index").alias("last")))
    bits = max(1, (files.agg(F.max("last")).first()[0] or 0).bit_length())

    def name(file: Column | str, seed: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(file, F.lit(seed)), bits + 1)

    for seed in range(tries):
        n, different = files.agg(F.count("*"), F.count_distinct(name("file", seed))).first()
        if n == different:
            return F.shiftleft(name(at["file_path"], seed), bits).bitwiseOR(at["row_index"])
    return None


def without(docs: DataFrame, dropped: DataFrame, row: str, how: str = "left_anti") -> DataFrame:
    """docs but for the rows that dropped names (or, as how says, only those): one shuffle of docs, nothing of it sorted.

    What is dropped grows with docs, so it is never broadcast; numbers of rows are its only column.
    """
    return docs.join(dropped.hint("shuffle_hash"), row, how)


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; an id of null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def word_count(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")

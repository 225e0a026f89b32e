"""Exact duplicates through content-defined chunk recipes, in DataFrame expressions only.

A text, white space deleted, is cut where its own characters say so: after a pair of characters of one
class, which about a sixteenth of the characters of each script belong to, 512 characters at least and 8192
at most from the last cut. The text moves nowhere: each row keeps its recipe, the ordered list of its
chunks' 64-bit hashes, with a SHA-256 digest of each chunk. Chunks are then deduplicated: an identifier is
verified if all chunks that have it have one digest. If any has several, digests name all chunks instead.
Texts are equal if their ordered lists of verified identifiers are; only these lists are shuffled, so a long
document costs a few numbers.

Defined results: null counts as the empty text, whose recipe has no chunk; of a group of equal texts the
row with the most code points stays, then the smallest doc_id (null last); rows repeated whole are
members like any other, and both are marked kept if they tie, unless columns that tell rows apart are given:
then the first of them by these columns is. Texts of any length are read whole, in the memory of one task;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable



def _ends() -> str:
    """Class of the characters that end a chunk, two in a row: a sixteenth of all code points.

    Of small scripts, which lie below 0x3100, every sixteenth code point; of the large ones and what is beyond,
    the first sixteenth of each stretch. Stretches are nested, so that a character is compared with few of them.
    """

    def nested(low: int, high: int, inside: str) -> str:
        return rf"[[\x{{{low:x}}}-\x{{{high - 1:x}}}]&&[{inside}]]"

    def singles(low: int) -> str:
        return nested(low, low + 0x100, "".join(rf"\x{{{c:x}}}" for c in range(low + 3, low + 0x100, 16)))

    def stretches(low: int, high: int, step: int) -> str:
        return nested(low, high, "".join(rf"\x{{{c:x}}}-\x{{{c + step // 16 - 1:x}}}" for c in range(low, high, step)))

    small = (nested(low, min(low + 0x800, 0x3100), "".join(map(singles, range(low, min(low + 0x800, 0x3100), 0x100)))) for low in range(0, 0x3100, 0x800))
    return f"[{''.join(small)}{stretches(0x3100, 0xD800, 0x400)}{stretches(0xE000, 0x10000, 0x400)}{stretches(0x10000, 0x110000, 0x8000)}]"


ENDS = _ends()
CHUNK = rf"(?s).{{512,8192}}?{ENDS}{ENDS}|.{{1,8192}}"


def squeezed(text: str) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def recipes(docs: DataFrame, row: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of row, n_points, text_sha256 and recipe, an array of id and digest, of each row."""
    squeezed_ = docs.select("doc_id", *(row or []), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), squeezed("text").alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    return squeezed_.select(
        "doc_id",
        *(row or []),
        "n_points",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("recipe"),
    )


def clashes(made: DataFrame) -> DataFrame:
    """id, digests of each identifier that chunks of different content share; as good as always empty."""
    chunks = made.select(F.explode("recipe").alias("c")).select("c.id", "c.digest").distinct()
    seen = chunks.groupBy("id").agg(F.count("*").alias("n"))
    return chunks.join(seen.filter("n > 1"), "id").groupBy("id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def exact_groups(docs: DataFrame, row: list[str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs, and the columns of row, which tell rows apart."""
    made = durable(recipes(docs, row))
    clashing = durable(clashes(made))
    if clashing.isEmpty():
        ids = F.transform("recipe", lambda c: c["id"])
    else:  # an unverified identifier somewhere: the digests, verified by their own length, name all chunks
        ids = F.transform("recipe", lambda c: c["digest"])
    listed = made.withColumn("ids", ids).drop("recipe").withColumn("hash", F.xxhash64("ids"))
    # the complement turns the order of numbers round, and there is one of each number
    best = F.struct(F.col("n_points"), F.bitwise_not("doc_id").alias("low"), *[F.bitwise_not(c).alias(f"low_{c}") for c in row or []])
    groups = listed.groupBy("ids").agg(F.count("*").alias("group_size"), F.max_by("doc_id", best).alias("keep_id"), F.max(best).alias("best"))
    # joined on the hash as well, both sides are dealt anew, and Spark can split the rows of a large group
    return listed.join(groups.withColumn("hash", F.xxhash64("ids")), ["hash", "ids"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        best.eqNullSafe(F.col("best")).alias("kept"),
        "text_sha256",
        *(row or []),
    )

"""Ordered folds over keyed rows: one exchange on the key, rows streamed in order, state for one key only.

fold_in_chunks runs a key that has very many rows in several tasks: each chunk of it first from an empty state, then again
from the state in which the chunk before has ended, as long as that is not the one it began with. Folds forget: a
paragraph closes, a slide ends, and two runs that were begun in different states agree from there on, so that a second run mostly
ends in the state of the first and no further chunk is run again.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.sources.stages import keep

FLUSH = 4096


class Fold(Protocol):
    """State of one key: step takes a row and gives result rows, end gives the rest."""

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]: ...

    def end(self) -> list[dict[str, Any]]: ...


class Resumable(Fold, Protocol):
    """A fold that can be handed on: state is its state in plain lists and numbers, equal if and only if all that
    follows is equal, None at first; resume takes it. Its rows are numbered by their place, from 0."""

    def state(self) -> Any: ...

    def resume(self, state: Any) -> None: ...


def fold_by_key(rows: DataFrame, key: str | list[str], order: list[str], start: Callable[[Any], Fold], schema: str) -> DataFrame:
    """Result rows of a fold for each key (of several columns, a tuple) over its rows in order.

    A key's rows are never gathered: they are sorted by Spark, which may spill, and pass one by one.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    keys = [key] if isinstance(key, str) else key
    key_of = operator.itemgetter(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out, begun = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or key_of(row) != now:
                    if fold:
                        out += fold.end()
                    now, begun = key_of(row), True
                    fold = start(now)
                out += fold.step(row)
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if fold:
            out += fold.end()
        yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _chunk_runs(rows: DataFrame, told: DataFrame | None, key: str, order: list[str], start: Callable[[Any], Resumable], schema: str, number: str) -> DataFrame:
    """For each key and chunk its result rows (pos_ is their place), those of end (last_), and a row with the state at its end and at its begin."""
    full = f"{schema}, key_ string, chunk_ long, pos_ long, last_ boolean, state_ string, used_ string"
    kinds = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out, pos, used = None, None, [], 0, ""

        def add(made: list[dict[str, Any]], last: bool) -> None:
            nonlocal pos
            for row in made:
                out.append(row | {number: pos, "key_": now[0], "chunk_": now[1], "pos_": pos, "last_": last})
                pos += 1

        def finish() -> None:
            state = json.dumps(fold.state(), ensure_ascii=False)
            add(fold.end(), True)
            out.append({"key_": now[0], "chunk_": now[1], "state_": state, "used_": used})

        for batch in batches:
            for row in batch.to_pylist():
                if fold is None or (row[key], row["chunk_"]) != now:
                    if fold is not None:
                        finish()
                    now, fold, pos, used = (row[key], row["chunk_"]), start(row[key]), 0, row["given_"] or ""
                    if used:
                        fold.resume(json.loads(used))
                if row["given_"] is None:
                    add(fold.step(row), False)
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if fold is not None:
            finish()
        yield pa.RecordBatch.from_pylist(out, kinds)

    given = rows.withColumn("given_", F.lit(None).cast("string"))
    if told is not None:
        same = F.col(f"g.{key}").eqNullSafe(F.col(f"t.{key}")) & F.col("g.chunk_").eqNullSafe(F.col("t.chunk_"))
        given = given.alias("g").join(told.alias("t"), same, "left_semi").unionByName(told, allowMissingColumns=True)
    return given.repartition(key, "chunk_").sortWithinPartitions(key, "chunk_", F.col("given_").isNull(), *order).mapInArrow(run, full)


def fold_in_chunks(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Resumable], schema: str, number: str, size: int = 16384, rounds: int = 3) -> DataFrame:
    """Result rows of a fold for each key over its rows in order, as fold_by_key has them; number is their place in the key.

    A chunk is size values of the first column of order, which counts rows. Work for keys of one chunk is as with fold_by_key.
    The rows of a longer key run in as many tasks as it has chunks, twice as a rule; a key whose chunks have not settled after
    so many rounds, as of a fold that never forgets, is folded by one task.
    """
    chunked = rows.withColumn("chunk_", F.floor(F.col(order[0]) / size))
    names = StructType.fromDDL(schema).names
    done = keep(_chunk_runs(chunked, None, key, order, start, schema, number))
    ends = done.filter("state_ IS NOT NULL").select("key_", "chunk_", "state_", "used_")
    # compared without loss of nulls, so that a key of null is one like any other
    long = keep(ends.groupBy("key_").agg(F.count("*").alias("n")).filter("n > 1").select("key_"))
    if long.isEmpty():
        return done.filter("state_ IS NULL").select(names)
    held = F.col("done.key_").eqNullSafe(F.col("long.key_"))
    of = lambda df, how: df.alias("done").join(long.alias("long"), held, how)
    short = of(done, "left_anti").filter("state_ IS NULL").select(names)
    source, runs, of_key = keep(chunked.alias("done").join(long.alias("long"), F.col(f"done.{key}").eqNullSafe(F.col("long.key_")), "left_semi")), of(done, "left_semi"), W.partitionBy("key_").orderBy("chunk_")
    stale = None
    for round_ in range(rounds + 1):
        ends = runs.filter("state_ IS NOT NULL").withColumn("given_", F.lag("state_").over(of_key))
        stale = keep(ends.filter("given_ <> used_").select(F.col("key_").alias(key), "chunk_", "given_"))
        if stale.isEmpty():
            break
        if round_ == rounds:
            # states that go on differing from chunk to chunk: these keys are folded whole, in one task each
            slow = stale.select(F.col(key).alias("key_")).distinct()
            unsettled = F.col("done.key_").eqNullSafe(F.col("slow.key_"))
            runs = runs.alias("done").join(slow.alias("slow"), unsettled, "left_anti")
            whole = source.alias("done").join(slow.alias("slow"), F.col(f"done.{key}").eqNullSafe(F.col("slow.key_")), "left_semi")
            short = short.unionByName(fold_by_key(whole, key, order, start, schema).select(names))
            break
        again = _chunk_runs(source, stale, key, order, start, schema, number)
        same = F.col("done.key_").eqNullSafe(F.col(f"stale.{key}")) & F.col("done.chunk_").eqNullSafe(F.col("stale.chunk_"))
        runs = keep(runs.alias("done").join(stale.alias("stale"), same, "left_anti").unionByName(again))
    last = runs.filter("state_ IS NOT NULL").groupBy("key_").agg(F.max("chunk_").alias("end_"))
    # rows of end count in the last chunk only
    valid = runs.filter("state_ IS NULL").alias("r").join(last.alias("l"), F.col("r.key_").eqNullSafe(F.col("l.key_"))).filter("NOT last_ OR chunk_ = end_").select("r.*")
    counts = valid.groupBy("key_", "chunk_").agg(F.count("*").alias("n"))
    before = counts.select("key_", "chunk_", F.coalesce(F.sum("n").over(of_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    same = F.col("r.key_").eqNullSafe(F.col("b.key_")) & F.col("r.chunk_").eqNullSafe(F.col("b.chunk_"))
    placed = valid.alias("r").join(before.alias("b"), same).select("r.*", "b.before_").withColumn(number, (F.col("before_") + F.col("pos_")).cast("int"))
    return short.unionByName(placed.select(names))

"""Sliding-log rate limiting over each client's events in order."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.operators.ordered import BLOCK, scan
from glyphmill.sources.scratch import new_folder, written


def client_key(forwarded: Column, host: Column) -> Column:
    """First address of the forwarding header, else the host, else ``inconnu``."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.when(F.coalesce(F.length(forwarded), F.lit(0)) > 0, first).otherwise(F.coalesce(host, F.lit("inconnu")))


def decide(batches: Iterator[pa.RecordBatch], most: int, window: float, logs: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Verdicts on ``(key, part, ts)`` rows in that order; all that is kept between rows is the part's log.

    An accepted call leaves the log once it is exactly ``window`` old; a
    rejected one never enters it.  A part begins with its log in ``logs``; the
    row after which this task has no more of a part also says what the log is then.
    """
    now_in, log, held = None, deque(), None

    def close(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for key, part, now in zip(*(c.to_pylist() for c in batch.columns)):
            if now_in != (key, part):
                if held:
                    for column, value in zip(out, (*held, list(log))):
                        column.append(value)
                    held = None
                now_in = (key, part)
                log = deque(logs.get(now_in, ()))
            elif held:
                for column, value in zip(out, (*held, None)):
                    column.append(value)
            while log and now - log[0] >= window:
                log.popleft()
            full = len(log) >= most
            held = (key, part, now, not full, max(1, math.ceil(window - (now - log[0]))) if full else None)
            if not full:
                log.append(now)
        if out[0]:
            yield close(out)
    if held:
        yield close([[v] for v in (*held, list(log))])


def limit(events: DataFrame, most: int, window: float, key_col: str = "user_id", ts_col: str = "ts", parts: int | None = None) -> DataFrame:
    """``(key, ts, accepted, retry_after)`` per event; ``ts`` in seconds, events of a client in time order.  Events without a time don't count.

    A client's events are cut where none came for a whole window, as the log is
    empty there; such parts are read side by side, as sorted streams.  A part
    that goes on through several blocks of the order is read block by block, in
    as many rounds: each block hands on its log, that is the last ``most``
    accepted times at most.  Only parts at the edge of a block can go on, so
    that the logs handed on are two a block at most.
    """
    if most < 1 or window < 1:
        raise ValueError("limit and window must be 1 or more")
    rows = events.select(F.col(key_col).alias("key"), F.col(ts_col).cast("double").alias("ts")).where("ts is not null")
    cut = lambda before: before.isNull() | (F.col("ts") - before["ts"] >= window)
    placed = scan(rows, ["key"], ["ts"], ["ts"], cut, parts, keep_block=True).select("key", F.col("island").alias("part"), "ts", F.col(BLOCK).alias("block"))
    placed = written(placed, "limiter-parts")
    # where a part's first rows lie: parts in several blocks are those at edges
    edge = placed.groupBy("block").agg(F.min(F.struct("key", "part")).alias("a"), F.max(F.struct("key", "part")).alias("z"))
    long = edge.select("block", F.explode(F.array_distinct(F.array("a", "z"))).alias("p")).groupBy("p").agg(F.min("block").alias("first"), F.max("block").alias("final")).where("first < final")
    long = long.select(F.col("p.key").alias("k"), F.col("p.part").alias("q"), "first")  # a row for each of some blocks
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("q"))
    turns = placed.join(F.broadcast(long), same, "left").select("key", "part", "ts", (F.col("block") - F.coalesce("first", "block")).alias("turn"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL("part long, ts double, accepted boolean, retry_after int, log array<double>").fields])
    arrow = to_arrow_schema(schema)

    def verdicts(of: DataFrame, logs: dict) -> DataFrame:
        dealt = of.select("key", "part", "ts").repartition("key", "part").sortWithinPartitions("key", "part", "ts")
        return dealt.mapInArrow(lambda batches: decide(batches, most, window, logs, arrow), schema)

    if long.isEmpty():
        return verdicts(placed, {}).drop("part", "log")
    folder = new_folder(events.sparkSession, "limiter")
    turns.write.partitionBy("turn").parquet(f"{folder}/turns")
    turns = events.sparkSession.read.parquet(f"{folder}/turns")
    logs: dict = {}
    for turn in sorted(r.turn for r in turns.select("turn").distinct().collect()):
        done = f"{folder}/verdicts/{turn}"
        verdicts(turns.where(F.col("turn") == turn), logs).write.parquet(done)
        rest = events.sparkSession.read.schema(schema).parquet(done).where("log is not null")
        kept = rest.join(F.broadcast(long), same).select("key", "part", "log").collect()  # two a block at most
        logs = {(r.key, r.part): r.log for r in kept}
    return events.sparkSession.read.schema(schema).parquet(f"{folder}/verdicts/*").drop("part", "log")

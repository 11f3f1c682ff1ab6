"""Streams replayed in event-time order (ST5, ST7).

Rows of a micro-batch wait until the watermark (newest time seen less
``delay_seconds``) has passed them and are then replayed together with what
earlier batches left: the result doesn't depend on the batch a row came in.
What is due goes through the batch operators of ``operators.monitor`` (prefix
counts in time buckets, pointer doubling), so a key that holds most of a batch is
spread like any other, and no Python runs per key.

Between batches there are tables, each with a folder per epoch that is
overwritten; a batch reads those of the epoch before it alone, so running it
again changes nothing:

* ``dealt``: the rows of the batch and those that waited, in the parts ``due``,
  ``wait`` and ``late``. A row that comes in behind the watermark of the batch
  before it, or without a time, is late: it is kept there and not replayed. What
  waits is written again with every batch: as much as comes in ``delay_seconds``.
* ``mark``: the watermark, in microseconds.
* ``state``: what a replay hands to the next one.
* ``out``: results.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import monitor as mo
from ..session import listed, materialize, scratch_path
from .streams import run_available

# (due rows, state, watermark or None after the last batch) -> (results, state)
Replay = Callable[[DataFrame, DataFrame, int | None], tuple[DataFrame, DataFrame]]


def micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, {mo.EPOCH}, {ts})")


def ordered_tables(spark: SparkSession, name: str) -> dict[str, str]:
    return {t: scratch_path(spark, f"{name}-{t}") for t in ("dealt", "mark", "state", "out")}


def _read(spark: SparkSession, table: str, folder: str, schema) -> DataFrame:
    top, _, below = folder.partition("/")
    there = top in listed(spark, table) and (not below or below in listed(spark, f"{table}/{top}"))
    return spark.read.schema(schema).parquet(f"{table}/{folder}") if there else spark.createDataFrame([], schema)


def replay_batch(batch: DataFrame, epoch: int, tables: dict[str, str], delay_seconds: int, replay: Replay, state_schema: str,
                 ts: str = "ts", last: bool = False) -> None:
    """One micro-batch; with ``last`` everything that waits is due."""
    spark, schema = batch.sparkSession, batch.schema
    row = _read(spark, tables["mark"], f"epoch={epoch - 1}", "mark long").first()
    before = row[0] if row else None
    newest = batch.agg(F.max(micros(ts))).first()[0]
    mark = max((m for m in (before, None if newest is None else newest - delay_seconds * 1_000_000) if m is not None), default=None)
    t = micros(ts)
    late = t.isNull() if before is None else t.isNull() | (t < before)
    rows = batch.withColumn("_late", late).unionByName(_read(spark, tables["dealt"], f"epoch={epoch - 1}/_part=wait", schema).withColumn("_late", F.lit(False)))
    due = F.lit(last) if mark is None or last else t < mark
    part = F.when(F.col("_late"), "late").when(due, "due").otherwise("wait")
    rows.withColumn("_part", part).drop("_late").write.mode("overwrite").partitionBy("_part").parquet(f"{tables['dealt']}/epoch={epoch}")
    out, state = replay(_read(spark, tables["dealt"], f"epoch={epoch}/_part=due", schema),
                        _read(spark, tables["state"], f"epoch={epoch - 1}", state_schema), None if last else mark)
    out.write.mode("overwrite").parquet(f"{tables['out']}/epoch={epoch}")
    state.write.mode("overwrite").parquet(f"{tables['state']}/epoch={epoch}")
    spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{tables['mark']}/epoch={epoch}")


def run_ordered(stream: DataFrame, name: str, delay_seconds: int, replay: Replay, state_schema: str, ts: str = "ts") -> dict[str, str]:
    """Runs a stream over everything available and then replays what still
    waits, which ends it; returns the folders of the tables."""
    spark, tables = stream.sparkSession, ordered_tables(stream.sparkSession, name)

    def batch_fn(batch, epoch):
        replay_batch(batch, epoch, tables, delay_seconds, replay, state_schema, ts)
    run_available(stream, name, sink=batch_fn)
    end = max((int(n[6:]) for n in listed(spark, tables["mark"])), default=-1) + 1
    replay_batch(spark.createDataFrame([], stream.schema), end, tables, delay_seconds, replay, state_schema, ts, last=True)
    return tables


def late_rows(spark: SparkSession, tables: dict[str, str], schema) -> DataFrame:
    """Rows that came in behind the watermark, of all epochs."""
    parts = [f"{tables['dealt']}/{e}/_part=late" for e in listed(spark, tables["dealt"]) if "_part=late" in listed(spark, f"{tables['dealt']}/{e}")]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


# ---- ST5 ---------------------------------------------------------------------------

def admission_ordered(stream: DataFrame, name: str, calls: int, period_seconds: int, delay_seconds: int, key: str = "client") -> dict[str, str]:
    """ST5: the exact admission rule over (key, event_id, ts); results (key,
    event_id, accepted).

    Rejected requests leave no trace in the rule, so the accepted requests of a
    client's running history, ``calls`` at most, are all a later batch needs: they
    are put in front of its due rows and accepted again. A history that the
    watermark has left behind by the period is dropped. A null client is a client
    of its own, equal rows are separate requests."""
    stream = stream.select(key, "event_id", "ts")
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    state_schema = ", ".join(f"{c} {t}" for c, t in fields.items())

    def replay(due, state, mark):
        rows = due.withColumn("_old", F.lit(False)).unionByName(state.withColumn("_old", F.lit(True)))
        # the whole row rides in the tie-break, as the operator returns that alone
        whole = rows.select(key, F.struct("event_id", "ts", "_old").alias("event_id"), "ts")
        told = materialize(mo.admission_exact(whole, calls, period_seconds, key).select(key, "event_id.*", "accepted"), f"{name}-told")
        if calls < 1:
            return told.select(key, "event_id", "accepted"), state
        # a history is the client's newest accepted requests behind the last gap of a period, ``calls`` at most
        w = Window.partitionBy(key)
        newest = told.where("accepted").withColumn("_n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("_n") <= calls)
        gap = micros("ts") - F.lag(micros("ts")).over(w.orderBy(F.desc("_n")))
        newest = newest.withColumn("_start", F.when(gap >= period_seconds * 1_000_000, F.col("_n")))
        newest = newest.withColumn("_start", F.min("_start").over(w)).withColumn("_t", F.max(micros("ts")).over(w))
        kept = newest.where(F.col("_start").isNull() | (F.col("_n") <= F.col("_start")))
        if mark is not None:
            kept = kept.where(F.col("_t") + period_seconds * 1_000_000 > mark)
        return told.where("not _old").select(key, "event_id", "accepted"), kept.select(*fields)
    return run_ordered(stream, name, delay_seconds, replay, state_schema)


# ---- ST7 ---------------------------------------------------------------------------

def status_ordered(stream: DataFrame, name: str, delay_seconds: int, key: str = "source") -> dict[str, str]:
    """ST7: counters per source that start again when the status turns from
    available to unavailable, over (key, event_id, ts, available); results (key,
    segment, analyzed, successful) are updates, the last of a segment being final.

    A source hands on its last row and the counters of its open segment: the row
    is put in front of the next due rows, so that a change between two batches
    is seen, and its segment's number and counters are added."""
    stream = stream.select(key, "event_id", "ts", "available")
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    row = [key, "event_id", "ts", "available"]
    state_schema = ", ".join([*(f"{c} {types[c]}" for c in row), "segment long", "analyzed long", "successful long"])

    def replay(due, state, mark):
        rows = due.withColumn("_new", F.lit(1)).unionByName(state.select(*row, F.lit(0).alias("_new")))
        s = mo.status_segments(rows, key, "ts", "event_id", "available")
        good = F.col("_new") * F.coalesce(F.col("available"), F.lit(False)).cast("int")
        here = s.groupBy(key, "segment").agg(F.sum("_new").alias("_n"), F.sum(good).alias("_good"),
                                             F.max_by(F.struct("event_id", "ts", "available"), F.struct("ts", "event_id")).alias("_last"))
        base = state.select(key, F.col("segment").alias("_at"), "analyzed", "successful")
        named = base.withColumnRenamed(key, "_key")
        j = here.join(named, F.col(key).eqNullSafe(F.col("_key")), "left")

        def carried(c):
            return F.when(F.col("segment") == 0, F.coalesce(c, F.lit(0))).otherwise(0)
        told = j.select(key, (F.col("segment") + F.coalesce("_at", F.lit(0))).alias("segment"), (F.col("_n") + carried("analyzed")).alias("analyzed"),
                        (F.col("_good") + carried("successful")).alias("successful"), "_last", "_n")
        told = materialize(told, f"{name}-told")
        ends = told.groupBy(key).agg(F.max_by(F.struct("_last", "segment", "analyzed", "successful"), "segment").alias("_e"))
        kept = ends.select(key, "_e._last.*", "_e.segment", "_e.analyzed", "_e.successful")
        return told.where(F.col("_n") > 0).drop("_last", "_n"), kept
    return run_ordered(stream, name, delay_seconds, replay, state_schema)

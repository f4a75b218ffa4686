"""Structured Streaming: capture with exactly-once ids, claim windows with keyed state, and ledger sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import WINDOW_SECONDS, exactly_once
from ..sources.readers import exists

CLAIM = "key bigint, ts bigint"


def claim_stream(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Granted claims (key, ts) of a stream (key, ts in seconds): the state of a key is the time of its last granted claim."""

    def grant(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        got = []
        for t in sorted(pd.concat(list(frames)).ts.tolist()):
            if last is None or last < t - seconds:
                last = t
                got.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(got), "ts": got}, columns=["key", "ts"])

    return events.groupBy("key").applyInPandasWithState(grant, CLAIM, "last bigint", "append", GroupStateTimeout.NoTimeout)


def once(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Events of a batch that the ledger does not know, by event_uid or by (source_id, generation, seq), each once, the first by ord. A blank uid is none; a blank source or a number below 1
    is no place."""
    place = ["source_id", "generation", "seq"]
    uid = known.where("event_uid <> ''").select("event_uid").distinct()
    at = known.where("source_id <> '' and seq > 0").select(*place).distinct()
    fresh = batch.join(uid, "event_uid", "left_anti").join(at, place, "left_anti").select(*batch.columns)
    return exactly_once(fresh)


def capture(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's events to the ledger at ``path``, each exactly once however late it is repeated: a batch is held against the whole ledger but for its own rows, so that a batch
    that runs again after a failure writes the same. Events: ord, event_uid, source_id, generation, seq and further columns."""
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        own = f"{path}/batch={n}"
        known = spark.read.schema(batch.schema).option("basePath", path).parquet(path).where(f"batch <> {n}") if exists(spark, path) else batch.where("false")
        once(batch, known).write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered(events: DataFrame) -> DataFrame:
    """(source_id, ord, seq, state) of a stream in order of arrival: accepted if seq follows the last accepted one of the source's generation, generation if it is another's, else gap. The
    state of a source is its generation and last number; there is no horizon. events: source_id (text), generation, seq, ord."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gen, last = state.get if state.exists else (1, 0)
        pdf = pd.concat(list(frames)).sort_values("ord")
        told = []
        for g, n in zip(pdf.generation, pdf.seq, strict=True):
            told.append("generation" if g != gen else "accepted" if n == last + 1 else "gap")
            last += told[-1] == "accepted"
        state.update((int(gen), int(last)))
        yield pdf[["source_id", "ord", "seq"]].assign(state=told)

    return events.groupBy("source_id").applyInPandasWithState(walk, "source_id string, ord bigint, seq bigint, state string", "generation bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a ledger table; a batch that is replayed after a failure replaces its own rows."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window under a watermark (beyond what capture itself needs)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

"""Capture as keyed state: each event once by its uid, then sources as ordered logs with rotation, all in one stream, so that no batch reads the ledger.

Rows are events, the issue of numbers to bundles, and requests to rotate, in one order (``ord``). The state of a uid is that it was seen; the state of a source is its generation, its last number and its cursor,
three numbers whatever has gone by. ``captured`` runs on a stream, ``captured_batch`` on a table, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: kind: event (seq: its number), issue (seq: the last number that bundles hold) or rotate.
INPUT = "ord bigint, kind string, event_uid string, source_id string, generation bigint, seq bigint"
OUTPUT = "ord bigint, kind string, event_uid string, source_id string, generation bigint, seq bigint, state string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settings(spark: SparkSession) -> None:
    """What keyed state of this kind needs of a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def walk(rows: pd.DataFrame, generation: int, last: int, cursor: int) -> tuple[list[str], int, int, int]:
    """What becomes of a source's rows in order, and the source behind them. An event is accepted if its number follows the last accepted one of the source's generation, else it is a gap; one of another
    generation is told so. A rotation is refused while numbers are left that no bundle holds."""
    told = []
    for kind, g, n in zip(rows.kind, rows.generation, rows.seq, strict=True):
        if kind == "rotate":
            told.append("done" if cursor >= last else "refused")
            if told[-1] == "done":
                generation, last, cursor = generation + 1, 0, 0
        elif kind == "issue":
            told.append("issued" if g == generation and cursor <= n <= last else "refused")
            cursor = int(n) if told[-1] == "issued" else cursor
        else:
            told.append("generation" if g != generation else "accepted" if n == last + 1 else "gap")
            last += told[-1] == "accepted"
    return told, generation, last, cursor


class Seen(StatefulProcessor):
    """The first row of a uid, ever; later ones are known."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "ord bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ord")
        state = ["known"] * len(pdf)
        if not self.seen.exists():
            self.seen.update((int(pdf.ord.iloc[0]),))
            state[0] = ""
        yield pdf.assign(state=state)[_COLUMNS]

    def close(self) -> None:
        pass


class Source(StatefulProcessor):
    """A source's log."""

    def init(self, handle) -> None:
        self.at = handle.getValueState("at", "generation bigint, last bigint, cursor bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ord")
        told, *at = walk(pdf, *(self.at.get() if self.at.exists() else (1, 0, 0)))
        self.at.update(tuple(map(int, at)))
        yield pdf.assign(state=told)[_COLUMNS]

    def close(self) -> None:
        pass


def _blank(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _named() -> F.Column:
    return (F.col("kind") == "event") & ~_blank("event_uid")


def _placed() -> F.Column:
    return ~_blank("source_id") & ((F.col("kind") != "event") | (F.coalesce("seq", F.lit(0)) > 0))


def _loose() -> F.Column:
    return F.when(F.col("kind") == "event", "accepted").otherwise("refused")


def first_of_each(rows: DataFrame) -> DataFrame:
    """A stream (INPUT) with state: known where the event's uid was seen before, else blank. Rows without a uid are never known."""
    named = rows.where(_named()).groupBy("event_uid").transformWithStateInPandas(Seen(), OUTPUT, "append", "none")
    return named.unionByName(rows.where(~_named()).withColumn("state", F.lit("")).select(*_COLUMNS))


def in_order(rows: DataFrame) -> DataFrame:
    """A stream (INPUT) with state: what its source makes of each row. Events without a place (a blank source, a number below 1) are accepted as they are; nothing else is done without a source."""
    placed = rows.where(_placed()).groupBy("source_id").transformWithStateInPandas(Source(), OUTPUT, "append", "none")
    return placed.unionByName(rows.where(~_placed()).withColumn("state", _loose()).select(*_COLUMNS))


def captured_batch(rows: DataFrame) -> DataFrame:
    """(OUTPUT) of a whole table: rows of a uid seen before are known and go no further; the others by source, in order."""
    w = Window.partitionBy("event_uid").orderBy("ord")
    named = rows.where(_named()).withColumn("state", F.when(F.row_number().over(w) > 1, "known").otherwise(""))
    rest = named.where("state = ''").unionByName(rows.where(~_named()).withColumn("state", F.lit("")))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        return pdf.assign(state=walk(pdf, 1, 0, 0)[0])[_COLUMNS]

    placed = rest.where(_placed()).select(*_COLUMNS).groupBy("source_id").applyInPandas(go, OUTPUT)
    loose = rest.where(~_placed()).withColumn("state", _loose())
    return named.where("state = 'known'").unionByName(placed).unionByName(loose).select(*_COLUMNS)


def capture_stream(rows: DataFrame, path: str, checkpoint: str):
    """Capture a stream (INPUT) into the ledger folders ``path``/first and ``path``/ledger: the first stage's rows are written and read on as a stream, so each stage has a state and a checkpoint of its own and
    is started anew by itself. Returns a function that takes in what there is."""
    spark = rows.sparkSession

    def put(df: DataFrame, name: str) -> None:
        df.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(f"{path}/{name}").awaitTermination()

    def take() -> None:
        settings(spark)
        put(first_of_each(rows), "first")
        first = spark.readStream.schema(OUTPUT).parquet(f"{path}/first")
        put(in_order(first.where("state = ''").drop("state")).unionByName(first.where("state = 'known'").select(*_COLUMNS)), "ledger")

    return take

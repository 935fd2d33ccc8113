"""Dialogue slots over a stream whose turns come late, twice or out of order; their state ends.

Turns wait in their conversation's state until the watermark has passed their event time, then they are taken in the order of
event time and turn number, each number once. What a conversation knows is dropped `keep` after its last turn, so state grows
with the conversations that are open and not with all there ever were; a later turn begins anew. Turns that come after the
watermark has passed them are left out, as the watermark says.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.session import ship

#: The state store that timers and several states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def processor(slots: list[str], keep_ms: int) -> StatefulProcessor:
    """The processor of a conversation. Its class is made here so that it travels whole: the process beside the driver that
    sets up its states can't import what is shipped to the executors."""

    class Slots(StatefulProcessor):
        """Waiting turns, the slots known so far, the numbers of turns taken, and when the last of them was."""

        def __init__(self, slots: list[str], keep_ms: int):
            self.slots, self.keep = slots, keep_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            said = [T.StructField(f"s{i}", T.StringType()) for i in range(len(self.slots))]
            number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
            self.handle = handle
            self.waiting = handle.getListState("waiting", T.StructType(number("at", "turn") + said))
            self.known = handle.getValueState("known", T.StructType(number("last") + said))
            self.taken = handle.getMapState("taken", T.StructType(number("turn")), T.StructType([T.StructField("one", T.BooleanType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                for r in pdf.itertuples(index=False):
                    self.waiting.appendValue((int(r.at), int(r.turn), *(None if pd.isna(getattr(r, s)) else str(getattr(r, s)) for s in self.slots)))
                    self.handle.registerTimer(int(r.at))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            waiting = sorted(self.waiting.get(), key=lambda t: (t[0], t[1], [x or "" for x in t[2:]]))
            due = [t for t in waiting if t[0] <= now]
            held = self.known.get() if self.known.exists() else None
            out = []
            if due:
                last, known = (held[0], list(held[1:])) if held else (0, [None] * len(self.slots))
                for at, turn, *said in due:
                    if held and at > last + self.keep:
                        known = [None] * len(self.slots)
                        self.taken.clear()
                    if self.taken.containsKey((turn,)):
                        continue
                    self.taken.updateValue((turn,), (True,))
                    known = [a if a is not None else b for a, b in zip(known, said)]
                    last, held = max(last, at), True
                    out.append((key[0], turn, *known))
                self.waiting.clear()
                for t in waiting[len(due) :]:
                    self.waiting.appendValue(t)
                self.known.update((last, *known))
                self.handle.registerTimer(last + self.keep)
            elif held and held[0] + self.keep <= now and not waiting:
                self.known.clear()
                self.taken.clear()
            if out:
                yield pd.DataFrame(out, columns=["key", "turn", *self.slots])

        def close(self) -> None:
            pass

    return Slots(slots, keep_ms)


def ordered_slots(stream: DataFrame, slots: list[str], at: str, key: str = "conv_id", order: str = "turn", late: str = "10 minutes", keep: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """(key, order, slots…): each turn with all slots known so far, a slot once given never overwritten.

    Turns may come up to `late` after others of a later event time `at`. Rows without a key, number or event time are left out.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.filter(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(F.col(key).alias("key"), F.unix_millis("_at").alias("at"), F.col(order).cast("long").alias("turn"), *[F.col(s).cast("string").alias(s) for s in slots], "_at")
    kinds = dict(stream.dtypes)
    schema = T.StructType.fromDDL(f"key {kinds[key]}, turn long, " + ", ".join(f"`{s}` string" for s in slots))
    got = rows.groupBy("key").transformWithStateInPandas(processor(slots, int(keep.total_seconds() * 1000)), schema, "append", "eventTime")
    return got.select(F.col("key").alias(key), F.col("turn").cast(kinds[order]).alias(order), *slots)

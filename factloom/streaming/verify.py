"""Streams of articles and claims into upserted records; state that lives across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from factloom.sources.sinks import write_upsert


def verify_stream(stream: DataFrame, verify: Callable[[DataFrame], DataFrame], target: str, key: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None):
    """A running query that verifies each micro-batch and upserts the records into the table at `target`.

    verify may join the batch with static reference tables. A batch that is run again after a failure is known by its
    checkpoint and number, and is taken once. Without a trigger, all that is there is processed and the query ends.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        write_upsert(target, verify(batch).withColumn("seq", F.lit(batch_id)), key, buckets, checkpoint, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def job_status(events: DataFrame) -> DataFrame:
    """(job, status, at): the latest status of each job by time, then by event; batch, or streaming in update mode."""
    return events.groupBy("job").agg(F.max(F.struct("ts", "event_id", "status")).alias("m")).select("job", "m.status", F.col("m.ts").alias("at"))


def slot_state(stream: DataFrame, slots: list[str], key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, order, slots…): each turn with all slots known so far, a slot once given never overwritten.

    A conversation's slots are its state; the turns of a micro-batch are taken in order.
    """

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        known = list(state.get) if state.exists else [None] * len(slots)
        turns = pd.concat(list(batches)).sort_values(order)
        rows = []
        for t in turns.itertuples(index=False):
            known = [a if a is not None else (None if pd.isna(b) else str(b)) for a, b in zip(known, (getattr(t, s) for s in slots))]
            rows.append((k[0], getattr(t, order), *known))
        state.update(tuple(known))
        yield pd.DataFrame(rows, columns=[key, order, *slots])

    kinds = dict(stream.dtypes)
    out = StructType.fromDDL(f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{s} string" for s in slots))
    held = StructType.fromDDL(", ".join(f"{s} string" for s in slots))
    return stream.select(key, order, *slots).groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def with_scorer(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """df plus a double column from a user's function over Arrow batches: an embedder, reranker or tagger."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            yield pdf.assign(**{name: score(pdf).astype("float64")})

    return df.mapInPandas(run, StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"))

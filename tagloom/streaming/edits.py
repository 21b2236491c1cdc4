"""An edit log with undo and redo as a stream: each item's stacks live in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators.catalog import after_step

STACKS = "state string, back array<string>, forth array<string>"
FOLDED = "item_id string, state string, undos long, redos long"


class Replay(StatefulProcessor):
    """Folds the steps of an item, those of one batch in order of seq, into its stacks.

    depth bounds the states that an item keeps to go back to; redo has no more than were
    undone. idle: milliseconds after which an item without steps is forgotten, by a timer.
    """

    def __init__(self, depth: int, idle: int | None):
        self.depth, self.idle = depth, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stacks = handle.getValueState("stacks", STACKS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.stacks.get() if self.stacks.exists() else (None, [], [])
        log = (held[0], list(held[1]), list(held[2]))
        steps = sorted((r for part in rows for r in zip(part["seq"], part["kind"], part["state"])), key=lambda r: r[0])
        for _, kind, new in steps:
            log = after_step(*log, kind, new, self.depth)
        self.stacks.update(log)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({"item_id": [key[0]], "state": [log[0]], "undos": [len(log[1])], "redos": [len(log[2])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stacks.clear()
        return iter(())

    def close(self) -> None:
        pass


def replayed(steps: DataFrame, depth: int = 50, idle: int | None = None) -> DataFrame:
    """A stream of steps (item_id, seq, kind, state) -> for each item with steps in a batch its
    state, undos and redos by then; the last of an item is what operators.catalog.replayed
    gives for all its steps.

    seq must grow from batch to batch; kind and state are as there. The session needs the
    RocksDB state store: spark.sql.streaming.stateStore.providerClass. With idle, items
    without steps for so many milliseconds begin anew.
    """
    kind = steps.schema["item_id"].dataType
    written = steps.select(F.col("item_id").cast("string").alias("item_id"), "seq", "kind", F.when(F.col("state").isNotNull(), F.to_json(F.struct("state"))).alias("state"))
    found = written.groupBy("item_id").transformWithStateInPandas(Replay(depth, idle), FOLDED, "Update", "None" if idle is None else "ProcessingTime")
    return found.select(F.col("item_id").cast(kind).alias("item_id"), F.from_json("state", "state array<string>")["state"].alias("state"), "undos", "redos")

"""Bouts from a live stream of labels: an extension of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _OpenRun(StatefulProcessor):
    """Keeps the open run of an id; a label that changes closes it. Rows of an id must come in order from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "label string, first long, last long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        label, first, last = self.run.get() if self.run.exists() else (None, None, None)
        closed = []
        for at, new in sorted((int(at), new) for pdf in rows for at, new in zip(pdf["frame_index"], pdf["label"], strict=True)):
            if first is None:
                label, first, last = new, at, at
            elif new == label:
                last = max(last, at)
            else:
                closed.append((key[0], first, last, last - first + 1, label))
                label, first, last = new, at, at
        if first is not None:
            self.run.update((label, first, last))
        yield pd.DataFrame(closed, columns=["id", "frame_index", "end_frame", "bout_length", "behavior_name"])

    def close(self) -> None:
        pass


def streaming_bouts(labels: DataFrame) -> DataFrame:
    """Closed bouts of a stream with id, frame_index and label; the open one of each id stays in the state."""
    typed = labels.select(F.col("id").cast("string").alias("id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("label").cast("string").alias("label"))
    return typed.groupBy("id").transformWithStateInPandas(_OpenRun(), "id string, frame_index long, end_frame long, bout_length long, behavior_name string", "append", "none")


def windowed_counts(events: DataFrame, time: str, label: str, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per label and window of event time, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), label, "n")

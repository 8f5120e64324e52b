"""Bounded buffers of each key in a stream: the last N rows, the first row, the last value by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class LastRows(StatefulProcessor):
    """The ``keep`` newest rows of a key by (at, seq), as list state; all of them come out whenever the key has new ones."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "at double, seq long, item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for pdf in rows:  # never more than the buffer and one batch
            held += list(pdf[["at", "seq", "item"]].itertuples(index=False, name=None))
            held = sorted(held, key=lambda r: r[:2])[-self.keep :]
        self.rows.put(held)
        yield pd.DataFrame({"key": [key[0]] * len(held), "place": range(len(held)), "at": [r[0] for r in held], "seq": [r[1] for r in held], "item": [r[2] for r in held]})

    def close(self) -> None:
        pass


class LastByName(StatefulProcessor):
    """The last value of each name of a key (a cookie jar), the ``keep`` newest names, as map state."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "at double, seq long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.values.iterator()} if self.values.exists() else {}
        held = dict(before)
        for pdf in rows:
            for name, at, seq, value in pdf[["name", "at", "seq", "value"]].itertuples(index=False, name=None):
                if name not in held or (at, seq) >= held[name][:2]:
                    held[name] = (at, seq, value)
            held = dict(sorted(held.items(), key=lambda x: x[1][:2])[-self.keep :])
        for name in before.keys() - held.keys():
            self.values.removeKey((name,))
        for name, v in held.items():
            if before.get(name) != v:
                self.values.updateValue((name,), v)
        yield pd.DataFrame({"key": [key[0]] * len(held), "name": list(held), "seq": [v[1] for v in held.values()], "value": [v[2] for v in held.values()]})

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, keep: int) -> DataFrame:
    """``key, place, at, seq, item``: the newest rows of each key of a stream of these columns, oldest first."""
    return stream.select("key", "at", "seq", "item").groupBy("key").transformWithStateInPandas(LastRows(keep), "key string, place int, at double, seq long, item string", "Update", "None")


def last_values(stream: DataFrame, keep: int = 50) -> DataFrame:
    """``key, name, seq, value``: the last value of the newest names of each key of a stream of ``key, name, at, seq, value``."""
    return stream.select("key", "name", "at", "seq", "value").groupBy("key").transformWithStateInPandas(LastByName(keep), "key string, name string, seq long, value string", "Update", "None")


def first_rows(stream: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key (a response kept once per url and method); its state goes once the watermark has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)



"""A frontier that lives in a folder and takes its urls from streams; every batch counts once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier as R
from ..sources.warc import checkpointed, running_offsets

_ITEMS = "url string, depth int, seq long"
#: Items that a frontier holds at most, if nothing else is said.
MOST = 100_000


class Frontier:
    """Pushed and popped urls (``url, depth, seq``) in batches below ``path``, which all machines share.

    A batch's rows are written first; then a pointer of the batch's name is renamed into place.
    A batch that is given again finds its pointer and does nothing, so a replayed trigger and a
    job that died in between are harmless.  Another ``Frontier`` of the same path goes on where
    this one ended.  ``compact`` folds the batches so far into one; their names stay known.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _committed(self) -> dict[str, str]:
        """Folder of each committed batch; one folded into another has none."""
        fs, root, at = R._folder(self.spark, f"{self.path}/batches")
        names = sorted(x.getPath().getName() for x in fs.listStatus(root) if not x.getPath().getName().startswith("."))
        if not names:
            return {}
        text = self.spark.read.text([f"{self.path}/batches/{n}" for n in names], wholetext=True).select(F.col("_metadata.file_name"), "value")
        told = {name: value.split("\n") for name, value in text.collect()}
        out = {n: told[n][0] for n in names}
        for _, *folded in told.values():
            out |= {n: "" for n in folded}
        return out

    def _commit(self, name: str, rows: DataFrame, folded: list[str] = ()) -> str:
        folder = uuid.uuid4().hex
        rows.select("url", F.col("depth").cast("int").alias("depth"), F.col("seq").cast("long").alias("seq")).write.parquet(f"{self.path}/rows/{folder}")
        fs, _, at = R._folder(self.spark, f"{self.path}/batches")
        out = fs.create(at(f"{self.path}/batches/.{folder}"))
        out.write(bytearray("\n".join([folder, *folded]).encode()))
        out.close()
        if not fs.rename(at(f"{self.path}/batches/.{folder}"), at(f"{self.path}/batches/{name}")):
            raise RuntimeError(f"another job committed {name} meanwhile")
        return folder

    def _rows(self, kind: str, committed: dict[str, str] | None = None) -> DataFrame:
        found = [f for n, f in (self._committed() if committed is None else committed).items() if n.startswith(f"{kind}-") and f]
        return self.spark.read.schema(_ITEMS).parquet(*[f"{self.path}/rows/{f}" for f in found]) if found else self.spark.createDataFrame([], _ITEMS)

    def seen(self) -> DataFrame:
        """Everything that was ever pushed."""
        return self._rows("push")

    def pending(self) -> DataFrame:
        """What was pushed and not popped."""
        got = self._committed()
        return self._rows("push", got).join(self._rows("pop", got).select("url"), "url", "left_anti").select("url", "depth", "seq")

    def push(self, items: DataFrame, batch: str) -> int:
        """Add the new urls of ``items``, in their order (``seq``), while there is room; those without room may come again.  How many were added."""
        got = self._committed()
        if f"push-{batch}" in got:
            return 0
        pushed, popped = self._rows("push", got), self._rows("pop", got)
        room = max(0, self.most - pushed.count() + popped.count())
        new = checkpointed(R.push(items, pushed))
        n = new.count()
        if n > room:  # ranks over ranges: no task sorts all rows
            new = running_offsets(new.withColumn("_one", F.lit(1).cast("long")), ["seq", "url"], "_one").where(F.col("offset") < room)
        self._commit(f"push-{batch}", new)
        return min(n, room)

    def pop(self, k: int, batch: str) -> DataFrame:
        """The k pending urls of least depth, first come first; a batch that is asked for again gives the same rows."""
        got = self._committed()
        folder = got.get(f"pop-{batch}")
        if folder is None:
            folder = self._commit(f"pop-{batch}", R.pop(self.pending(), k))
        elif not folder:
            raise ValueError(f"{batch} was popped long ago and is folded by now")
        return self.spark.read.schema(_ITEMS).parquet(f"{self.path}/rows/{folder}")

    def compact(self) -> None:
        """Fold all batches into one of each kind, so that reading stays cheap."""
        for kind in ("push", "pop"):
            got = {n: f for n, f in self._committed().items() if n.startswith(f"{kind}-")}
            if sum(map(bool, got.values())) > 1:
                self._commit(f"{kind}-all-{uuid.uuid4().hex}", self._rows(kind, got), list(got))

    def follow(self, urls: DataFrame, name: str, checkpoint: str, **trigger):
        """Push a stream of ``url, depth, seq``, a batch for each trigger; returns the running query."""
        out = urls.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.push(df, f"{name}-{i}") and None)
        return out.trigger(**(trigger or {"availableNow": True})).start()

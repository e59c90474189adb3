"""Profiles of streams: of documents that are one row, and of documents whose parts come in different batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.features import category_names, counted, shares
from lexloom.operators.profile import profiles, scores
from lexloom.sources.shared import file_system, staged


def profile_stream(docs: DataFrame, lex_rows, path: str, checkpoint: str, key: str = "doc_id", model=None) -> StreamingQuery:
    """Writes the profiles of the stream ``docs`` (key, text) below ``path``, a folder for each micro-batch.

    A document is one row, so no state is kept between batches; a batch that runs again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        profiles(batch, lex_rows, key, model=model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PartStream:
    """Documents whose parts (key, time, text) come in any order and in any batch.

    What is kept of an open document is its counts so far and the times of its first and last part: counts add
    up, so parts need no order and texts aren't kept. The watermark is the latest time seen before the batch, less ``delay``
    seconds. A part from before it goes to the side output. A document whose last part is from before the watermark after
    the batch is closed: its scores are written, and its counts are kept no longer. A part that comes for it later, but after
    the watermark, begins a document anew, as sessions do; parts of one document should be less than ``delay`` apart.

    Below ``path`` each batch has a folder of each kind: ``open`` (the state), ``closed``, ``late`` and ``watermark``. A
    batch reads only what the one before it has left, and replaces its own folders, so one that runs again after a
    crash gives the same; the state before the last two batches is deleted. The state is merged by a shuffle of one row
    an open document. Markup ends with its part, as in features of keys with several rows.

    Cases: a null text has no words; a null key is a document; parts without a time are late; an empty batch only
    moves nothing; other columns are kept with late parts.
    """

    def __init__(self, spark: SparkSession, path: str, lex_rows, key: str = "doc_id", time: str = "time", delay: float = 600.0, model=None):
        self.spark, self.path, self.lex_rows, self.key, self.time, self.delay, self.model = spark, path.rstrip("/"), lex_rows, key, time, delay, model
        self.counts = ["word_count", "covered", "word_bytes", "big_words_seen", *(f"cnt_{c}" for c in category_names(lex_rows))]

    def start(self, parts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts on the stream ``parts``; without a trigger, takes what there is and ends."""
        return parts.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _at(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/batch={number}"

    def _exists(self, path: str) -> bool:
        own, fs = file_system(self.spark, f"{path}/_SUCCESS")
        return fs.exists(own)

    def watermark(self, number: int) -> float | None:
        """Seconds since 1970, as batch ``number`` has left it."""
        return self.spark.read.parquet(self._at("watermark", number)).first()["at"] if self._exists(self._at("watermark", number)) else None

    def batch(self, rows: DataFrame, number: int) -> None:
        seconds = F.col(self.time).cast("timestamp").cast("double")
        before = self.watermark(number - 1)
        rows = staged(rows, "batch")  # several passes, and the source is read once
        on_time = seconds.isNotNull() & (F.lit(True) if before is None else seconds >= before)
        rows.where(~on_time).write.mode("overwrite").parquet(self._at("late", number))
        good = rows.where(on_time)
        spans = good.groupBy(self.key).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"))
        zero = [F.lit(0).cast("long").alias(c) for c in self.counts]
        none = F.lit(None).cast("double")
        # The batch's counts, its times and the state are rows of one shuffle; null keys meet like any other.
        new = counted(good.select(self.key, "text"), self.lex_rows, self.key).select(self.key, none.alias("first"), none.alias("last"), *[F.col(f"`{c}`") for c in self.counts])
        new = new.unionByName(spans.select(self.key, "first", "last", *zero))
        if self._exists(self._at("open", number - 1)):
            new = new.unionByName(self.spark.read.parquet(self._at("open", number - 1)))
        merged = staged(self._summed(new), "merged")
        latest = rows.agg(F.max(seconds)).first()[0]
        after = max((x for x in (before, None if latest is None else latest - self.delay) if x is not None), default=None)
        closed = F.lit(False) if after is None else F.col("last") < after
        self._scored(merged.where(closed)).write.mode("overwrite").parquet(self._at("closed", number))
        merged.where(~closed).write.mode("overwrite").parquet(self._at("open", number))
        self.spark.range(1).select(F.lit(after).cast("double").alias("at")).write.mode("overwrite").parquet(self._at("watermark", number))
        own, fs = file_system(self.spark, self._at("open", number - 3))
        fs.delete(own, True)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(f"`{c}`").alias(c) for c in self.counts])

    def _scored(self, rows: DataFrame) -> DataFrame:
        return scores(shares(rows, self.lex_rows, self.key, "first", "last"), self.model)

    def _last(self) -> int:
        own, fs = file_system(self.spark, f"{self.path}/watermark")
        names = [x.getPath().getName() for x in fs.listStatus(own)] if fs.exists(own) else []
        return max((int(n.split("=")[1]) for n in names if self._exists(f"{self.path}/watermark/{n}")), default=-1)

    def _all(self, kind: str) -> DataFrame | None:
        paths = [p for n in range(self._last() + 1) if self._exists(p := self._at(kind, n))]
        return self.spark.read.parquet(*paths) if paths else None

    def closed(self) -> DataFrame | None:
        """The scores of all closed documents; None before the first batch."""
        return self._all("closed")

    def late(self) -> DataFrame | None:
        """The parts that came too late; None before the first batch."""
        return self._all("late")

    def current(self) -> DataFrame | None:
        """The scores of all documents, closed or as far as they have come; None before the first batch."""
        last = self._last()
        return None if last < 0 else self.closed().unionByName(self._scored(self.spark.read.parquet(self._at("open", last))))

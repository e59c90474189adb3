"""A ledger of fetched addresses: polite to hosts, patient with failures, and nothing is fetched twice.

Addresses fall to lanes of their hosts, and each lane is fetched by one task at a time, so a host's
rate holds however many tasks there are; a host with very many addresses may have more lanes, among which its rate is
divided. A task takes turns between its lanes and never waits for one while another may go on. What may be over soon
(connections, time-outs, 429 and 5xx) is tried again, each time after twice the pause; whatever else fails, fails at once.

The addresses go out in waves of SLICE a lane. Each wave is a batch of the ledger, written by Spark's commit
protocol: a lost task repeats its own addresses of one wave, and a lost job goes on from the first wave that
isn't committed. Places in a lane are running totals, so a hot host's addresses are never in one task.

Cases: a null or empty address isn't fetched; one without a host fails as a row; one that is there several times, or has
been fetched before, is not fetched again, also if it failed; an empty table fetches nothing.
"""

from __future__ import annotations

import heapq
import http.client
import time
import urllib.error
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.running import ordinal, running
from lexloom.sources.shared import file_system, staged
from lexloom.sources.texts import FAILURES, fetch_text

#: Addresses of a lane in a wave at most; requests a second to a host; lanes of a host; tries and the first pause in seconds.
SLICE, RATE, LANES, TRIES, PAUSE = 256, 1.0, 1, 4, 1.0
ENTRY = "url string, text string, fetch_error string, tries int"


def may_pass(error: Exception) -> bool:
    """Whether a failure is worth another try."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, OSError) or isinstance(error, http.client.HTTPException) and not isinstance(error, http.client.InvalidURL)


def visited(addresses: list[tuple[str, str]], fetch: Callable[[str], str], gap: float, tries: int, pause: float, clock=time.monotonic, sleep=time.sleep) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(url, text, error, tries) of ``addresses`` (lane, url), as they are done; a lane's next request begins ``gap`` seconds after the end of one, or later."""
    waiting: dict[str, list[tuple[float, int, str, int]]] = {}
    for n, (lane, url) in enumerate(addresses):
        waiting.setdefault(lane, []).append((0.0, n, url, 1))
    free = dict.fromkeys(waiting, 0.0)
    turns = [(0.0, lane) for lane in waiting]
    heapq.heapify(turns)
    while turns:
        at, lane = heapq.heappop(turns)
        if (now := clock()) < at:
            sleep(at - now)
        _, n, url, attempt = heapq.heappop(waiting[lane])
        text, error = None, None
        try:
            text = fetch(url)
        except FAILURES as e:
            error = e
        free[lane] = clock() + gap
        if error is None:
            yield url, text, None, attempt
        elif attempt < tries and may_pass(error):
            heapq.heappush(waiting[lane], (clock() + pause * 2 ** (attempt - 1), n, url, attempt + 1))
        else:
            yield url, None, str(error) or type(error).__name__, attempt
        if waiting[lane]:
            heapq.heappush(turns, (max(free[lane], waiting[lane][0][0]), lane))


class FetchLedger:
    """What has been fetched, below ``path``, a folder for each wave."""

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[str], str] = fetch_text, rate: float = RATE, lanes: int = LANES, tries: int = TRIES, pause: float = PAUSE, slice_size: int = SLICE):
        self.spark, self.path, self.fetch = spark, path.rstrip("/"), fetch
        self.rate, self.lanes, self.tries, self.pause, self.slice_size = rate, lanes, tries, pause, slice_size

    def committed(self) -> list[str]:
        own, fs = file_system(self.spark, self.path)
        paths = [str(x.getPath().toString()) for x in fs.listStatus(own)] if fs.exists(own) else []
        done = lambda p: (lambda o, f: f.exists(o))(*file_system(self.spark, f"{p}/_SUCCESS"))
        return sorted(p for p in paths if done(p))

    def entries(self) -> DataFrame:
        """(url, text, fetch_error, tries) of all addresses that are done."""
        paths = self.committed()
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def visit(self, urls: DataFrame) -> None:
        """Fetches what the ledger lacks of ``urls`` (url), wave by wave."""
        todo = urls.select("url").where("coalesce(url, '') <> ''").distinct().join(self.entries().select("url"), "url", "left_anti")
        host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
        todo = staged(todo.withColumn("host", host), "todo")
        placed = running(todo, ["host"], [F.xxhash64("url"), F.col("url")], {"n": ordinal()}).withColumn("n", F.col("n") - 1)
        lane = F.concat_ws("|", "host", F.pmod("n", F.lit(self.lanes)).cast("string"))
        placed = staged(placed.select("url", lane.alias("lane"), F.floor(F.col("n") / (self.lanes * self.slice_size)).cast("long").alias("wave")), "placed")
        last = placed.agg(F.max("wave")).first()[0]
        before = len(self.committed())
        for wave in range(0 if last is None else last + 1):
            # A lost wave's folder is written again, for it isn't committed; committed ones have other numbers.
            self._wave(placed.where(F.col("wave") == wave)).write.mode("overwrite").parquet(f"{self.path}/wave={before + wave:08d}")

    def _wave(self, rows: DataFrame) -> DataFrame:
        fetch, gap, tries, pause = self.fetch, self.lanes / self.rate, self.tries, self.pause
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Addresses only: of a few lanes, SLICE of each.
            own = [pair for pdf in batches for pair in zip(pdf["lane"], pdf["url"], strict=True)]
            for row in visited(own, fetch, gap, tries, pause):
                yield pd.DataFrame([row], columns=["url", "text", "fetch_error", "tries"]).astype({"text": object, "fetch_error": object})

        return rows.select("lane", "url").repartition(n, "lane").sortWithinPartitions("lane", F.xxhash64("url")).mapInPandas(run, ENTRY)

    def texts(self, requests: DataFrame, wanted=None) -> DataFrame:
        """As :func:`lexloom.sources.texts.fetched`: ``requests`` with the texts of their addresses, fetched now or before, and ``fetch_error``."""
        of_url = (F.col("source_type") == "url") & (F.coalesce("source_url", F.lit("")) != "") & (F.lit(True) if wanted is None else wanted)
        self.visit(requests.where(of_url).select(F.col("source_url").alias("url")))
        found = self.entries().select(F.col("url").alias("__url"), F.col("text").alias("__text"), "fetch_error")
        rows = requests.join(found, of_url & (F.col("source_url") == F.col("__url")), "left")
        names = [F.when(F.col("__url").isNotNull(), F.col("__text")).otherwise(F.col("text")).alias("text") if c == "text" else c for c in requests.columns]
        return rows.select(*names, "fetch_error")

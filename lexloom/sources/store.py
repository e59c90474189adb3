"""The store of analyses: rows by unique id, in Parquet files that a log of commits lists.

A save writes its rows once, into as many buckets of their ids' hashes as the store has, and then
adds one entry to the log: a file under the next number, which only one saver can make. A
saver that finds the number taken checks its ids against what has been committed since and tries the next one. So a
save is seen whole or not at all, and of two that share an id one fails, however they run. What a failed save has
written is deleted, and what a lost one has left is listed nowhere.

A lookup reads one bucket's files, in these the row groups whose Bloom filters may have the id. The log's
files appear whole, by a link on a local file system and by a rename elsewhere, which must fail where the name is taken (as HDFS's does).

Cases: an id that is null, or that rows of one save share, is an error; saving no rows adds an empty commit; other
columns than those of SCHEMA are left out.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.shared import file_system

SCHEMA = "id string, source_type string, word_count long, dictionary_coverage double, features_json string, scores_json string, confidence_flag string, created_at timestamp"
#: Buckets of a new store.
BUCKETS = 16
TRAIT = "struct<score:double,percentile:int,confidence_interval:array<double>>"
PROFILE = (
    f"analysis_id string, confidence_flag string, traits map<string,{TRAIT}>, values map<string,double>, "
    "summary struct<emotional_tone:double,analytical_thinking:double,clout:double,authenticity:double>, narrative string"
)


def rows_of(profiles: DataFrame, source_type: str = "file") -> DataFrame:
    """Profiles with narratives as rows of the table."""
    scores = F.to_json(F.struct("analysis_id", "confidence_flag", "traits", "values", "summary", "narrative"))
    return profiles.select(
        F.col("analysis_id").alias("id"),
        F.lit(source_type).alias("source_type"),
        F.col("word_count").cast("long").alias("word_count"),
        "dictionary_coverage",
        F.when(F.col("word_count") > 0, F.to_json("features")).otherwise("null").alias("features_json"),
        scores.alias("scores_json"),
        "confidence_flag",
        F.current_timestamp().alias("created_at"),
    )


class Store:
    """Ids are unique: saving one that is there, or one twice, is an error and saves nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # --- the log ---

    def commits(self) -> list[dict]:
        """The entries of the log, in their order."""
        own, fs = file_system(self.spark, f"{self.path}/log")
        if not fs.exists(own):
            return []
        names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(own)) if re.fullmatch(r"\d{12}\.json", n))
        return [json.loads(self._read(f"{self.path}/log/{n}")) for n in names]

    def _read(self, path: str) -> str:
        own, fs = file_system(self.spark, path)
        stream = fs.open(own)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _commit(self, number: int, entry: dict) -> bool:
        """Makes entry ``number`` of the log, unless there is one."""
        final, part = f"{self.path}/log/{number:012d}.json", f"{self.path}/log/.{uuid.uuid4().hex}"
        own, fs = file_system(self.spark, part)
        fs.mkdirs(own.getParent())
        stream = fs.create(own, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename would replace the file
                try:
                    os.link(urlsplit(part).path, urlsplit(final).path)
                except FileExistsError:
                    return False
                return True
            to, _ = file_system(self.spark, final)
            return not fs.exists(to) and fs.rename(own, to)
        finally:
            fs.delete(own, False)

    def create(self) -> None:
        """Makes the table if it isn't there."""
        if not self.exists():
            self._commit(0, {"buckets": self._buckets})

    def exists(self) -> bool:
        own, fs = file_system(self.spark, f"{self.path}/log/{0:012d}.json")
        return fs.exists(own)

    # --- rows ---

    def table(self) -> DataFrame:
        """All rows of the saves that are committed now."""
        return self._rows(self.commits()).select(*_names())

    def _rows(self, commits: list[dict]) -> DataFrame:
        """The rows of ``commits``, with their bucket."""
        schema = f"{SCHEMA}, bucket int"
        folders = [f"{self.path}/data/{c['data']}" for c in commits if c.get("buckets_used")]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)

    def _bucket(self, name: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")

    def save(self, rows: DataFrame) -> None:
        """Adds ``rows`` as one step; a ValueError where an id is taken or null, and then none is added."""
        self.create()
        log = self.commits()
        buckets, name = log[0]["buckets"], uuid.uuid4().hex
        path = f"{self.path}/data/save={name}"
        own = rows.select(*_names()).withColumn("bucket", self._bucket(F.col("id"), buckets))
        # A bucket's rows are dealt to several tasks, as many as there are for it; Spark joins small ones.
        each = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        own = own.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(each))).sortWithinPartitions("bucket", "id")
        own.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(path)
        try:
            ids = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(path).select("bucket", "id")
            counted = ids.groupBy("bucket", "id").agg(F.count("*").alias("n"))
            n, clash = counted.agg(F.count("*"), F.min(F.when((F.col("n") > 1) | F.col("id").isNull(), F.coalesce("id", F.lit("null"))))).first()
            if clash is not None:
                raise ValueError(f"id is taken: {clash}")
            entry, checked = {"data": f"save={name}", "buckets_used": int(n > 0)}, 1
            while True:
                log = self.commits()
                # Only what has been committed since the last look; both sides by bucket and id.
                known = ids.join(self._rows(log[checked:]).select("bucket", "id"), ["bucket", "id"], "left_semi").limit(1).collect()
                if known:
                    raise ValueError(f"id is taken: {known[0]['id']}")
                if self._commit(len(log), entry):
                    return
                checked = len(log)
        except BaseException:
            folder, fs = file_system(self.spark, path)
            fs.delete(folder, True)
            raise

    def clashes(self, rows: DataFrame) -> DataFrame:
        """(id, times, known): the ids for which ``rows`` (id) couldn't be saved: null, several times among them, or in the store."""
        log = self.commits()
        buckets = log[0]["buckets"] if log else self._buckets
        ids = rows.groupBy("id").agg(F.count("*").alias("times")).withColumn("bucket", self._bucket(F.col("id"), buckets))
        known = self._rows(log).select("bucket", "id", F.lit(True).alias("known"))
        found = ids.join(known, ["bucket", "id"], "left").select("id", "times", F.coalesce("known", F.lit(False)).alias("known"))
        return found.where("known OR times > 1 OR id IS NULL")

    def row(self, analysis_id: str) -> DataFrame:
        """The row with that id, or no row, of one bucket's files."""
        log = self.commits()
        if not log:
            return self.table()
        found = self._rows(log).where((F.col("bucket") == self._bucket(F.lit(analysis_id), log[0]["buckets"])) & (F.col("id") == analysis_id))
        return found.select(*_names())

    def profile(self, analysis_id: str) -> DataFrame:
        """The profile with that id, or no row."""
        own = self.row(analysis_id)
        return own.select(F.from_json("scores_json", PROFILE).alias("p")).select("p.*")

    def analysis(self, analysis_id: str) -> DataFrame:
        """The row with that id, decoded, or no row."""
        return self.decoded(self.row(analysis_id))

    @staticmethod
    def decoded(rows: DataFrame) -> DataFrame:
        features = F.from_json("features_json", "map<string,double>")
        return rows.withColumns({"features": features, "profile": F.from_json("scores_json", f"struct<{PROFILE.replace(' string', ':string').replace(' map', ':map').replace(' struct', ':struct')}>")})


def _names() -> list[str]:
    return [x.split()[0] for x in SCHEMA.split(", ")]

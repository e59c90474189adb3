"""Sources of texts: folders of text files, URLs, requests."""

from __future__ import annotations

import http.client
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.shared import file_system, staged

JOINT = "\n\n"
#: What an address or its server may cause: the row fails, and not the task.
FAILURES = (OSError, ValueError, http.client.HTTPException)


@dataclass(frozen=True)
class Config:
    """Limits, defaults and places. The limits and the default type."""

    max_text_size: int = 1_000_000
    source_type: str = "file"
    fetch_timeout: float = 30.0
    dir_path: str = ""
    dictionary_path: str = ""
    db_path: str = ""

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None) -> Config:
        """From ``spark.lexloom.<field>`` of the session, over what the YAML file at ``path`` has in any of its sections."""
        known, found = {f.name: f.type for f in fields(cls)}, {}
        if path:
            import yaml

            content = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {}
            for section in (content, *(v for v in content.values() if isinstance(v, dict))):
                found |= {k: v for k, v in section.items() if k in known and not isinstance(v, dict)}
            found |= {"fetch_timeout": v for v in [(content.get("middleware") or {}).get("timeout_in_second")] if v is not None}
        found |= {k: v for k in known if (v := spark.conf.get(f"spark.lexloom.{k}", None)) is not None}
        kinds = {"int": int, "float": float, "str": str}
        return replace(cls(), **{k: kinds[known[k]](v) for k, v in found.items()})


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the ``.txt`` files in ``folder``, whatever the case of the ending, not below it.

    Bytes that are no UTF-8 become U+FFFD, so a file in another encoding is a text like any other.
    Spark leaves out names that begin with a dot or an underscore.
    """
    return _files(spark, folder).select("name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    own, fs = file_system(spark, folder)
    name = F.element_at(F.split("path", "/"), -1)
    # Whatever folders there are below, and whatever they are called, their files are left out.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower("path").endswith(".txt") & (F.col("path") == F.concat(F.lit(f"{fs.makeQualified(own).toString()}/"), name)))
    files = files.select(name.alias("name"), "length", "content")
    # Spark plans no task for files without a byte, so they come from the listing.
    listed = ((x.getPath().getName(), x.getLen(), x.isFile()) for x in fs.listStatus(own))
    empty = [(name,) for name, size, is_file in listed if is_file and not size and name.lower().endswith(".txt") and name[0] not in "._"]
    if not empty:
        return files
    return files.unionByName(spark.createDataFrame(empty, "name string").select("name", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def folder_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(files, bytes when joined) of ``folder``, without reading a text; a FileNotFoundError where there is no text file."""
    n, size = _files(spark, folder).agg(F.count("*"), F.sum("length")).first()
    if not n:
        raise FileNotFoundError(f"no .txt files in {folder}")
    return n, size + len(JOINT) * (n - 1)


def joined_files(spark: SparkSession, folder: str, most: int = Config.max_text_size) -> DataFrame:
    """(text, files_read): the files as one document, by name; a ValueError where it has more than ``most`` bytes (0: any number).

    For folders that are one document, whose size is known before a text is read; a corpus of files is read by :func:`text_files`.
    """
    if 0 < most < folder_size(spark, folder)[1]:
        raise ValueError("combined text exceeds max size")
    files = text_files(spark, folder).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("f"))
    return files.select(F.array_join(F.transform("f", lambda x: x["text"]), JOINT).alias("text"), F.size("f").cast("long").alias("files_read"))


def write_text_files(texts: DataFrame, folder: str) -> None:
    """Writes ``texts`` (name, text) to ``folder``, a UTF-8 file each; names are unique, end in ``.txt`` and have no slash.

    Files appear under their names once they are whole, so a task that runs again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                part = f"{path}/.{name}.{os.urandom(8).hex()}"
                with store.open_output_stream(part) as out:
                    out.write((text or "").encode())
                store.move(part, f"{path}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    texts.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def fetch_text(url: str, timeout: float = Config.fetch_timeout, most: int = Config.max_text_size) -> str:
    """The body behind an http or https address, or as much of it as shows that it is over ``most`` bytes."""
    if urllib.parse.urlsplit(url).scheme.lower() not in ("http", "https"):
        raise ValueError(f"not an http address: {url}")
    with urllib.request.urlopen(url, timeout=timeout) as r:
        if r.status != 200:
            raise OSError(f"HTTP {r.status}")
        body = r.read(most + 1) if most > 0 else r.read()
        if r.length and (most <= 0 or len(body) <= most):  # what the server has announced and not sent
            raise OSError("unexpected EOF")
        return body.decode("utf-8", "replace")


def fetched(requests: DataFrame, fetch: Callable[[str], str] = fetch_text, wanted: Column | None = None) -> DataFrame:
    """Replaces the texts of url requests by what ``fetch`` gives; adds ``fetch_error``.

    Only rows of which ``wanted`` holds are fetched, and each address once, whatever reads the result.
    """
    of_url = (F.col("source_type") == "url") & (F.coalesce("source_url", F.lit("")) != "") & (F.lit(True) if wanted is None else wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for url in pdf["__url"]:
                try:
                    texts.append(fetch(url))
                    errors.append(None)
                except FAILURES as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"__url": pdf["__url"], "__text": texts, "fetch_error": errors}, dtype=object)

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = requests.where(of_url).select(F.col("source_url").alias("__url")).distinct().repartition(n, "__url")
    found = staged(urls.mapInPandas(run, "__url string, __text string, fetch_error string"), "fetched")
    return _with_texts(requests, found, of_url)


def fetched_before(requests: DataFrame, crawl: DataFrame, wanted: Column | None = None) -> DataFrame:
    """As :func:`fetched`, from ``crawl`` (url, text), a table of one row for each address that has been fetched; others fail."""
    of_url = (F.col("source_type") == "url") & (F.coalesce("source_url", F.lit("")) != "") & (F.lit(True) if wanted is None else wanted)
    found = crawl.select(F.col("url").alias("__url"), F.coalesce("text", F.lit("")).alias("__text"), F.lit(None).cast("string").alias("fetch_error"))
    rows = _with_texts(requests, found, of_url, "__url")
    missing = of_url & F.col("__url").isNull()
    return rows.withColumn("fetch_error", F.when(missing, F.lit("not in the crawl")).otherwise(F.col("fetch_error"))).drop("__url")


def _with_texts(requests: DataFrame, found: DataFrame, of_url: Column, *others: str) -> DataFrame:
    rows = requests.join(found, of_url & (F.col("source_url") == F.col("__url")), "left")
    names = [F.when(F.col("__url").isNotNull(), F.col("__text")).otherwise(F.col("text")).alias(c) if c == "text" else c for c in requests.columns]
    return rows.select(*names, *others, "fetch_error")

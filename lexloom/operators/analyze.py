"""The three services as jobs: requests to responses, a folder to one response, an id to its PDF."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import narrative, profile, validation
from lexloom.sources import texts
from lexloom.sources.fetching import FetchLedger
from lexloom.sources.store import Store, rows_of

RESPONSE = ("analysis_id", "word_count", "dictionary_coverage", "confidence_flag", "traits", "values", "summary", "narrative")


def analyze(
    requests: DataFrame,
    lex_rows,
    key: str = "request_id",
    fetch: Callable[[str], str] | FetchLedger | str | None = "default",
    config: texts.Config = texts.Config(),  # noqa: B008
    analysis_id: Column | None = None,
    model: Mapping[str, Column] | None = None,
    narrator: Callable[[DataFrame], DataFrame] = narrative.with_narrative,
) -> tuple[DataFrame, DataFrame]:
    """(responses, rejects) of ``requests`` (key, text, source_type, source_date, source_url).

    Addresses of requests whose fields are right are fetched, by a function or through a ledger, and then sizes are checked. Without
    ``fetch`` the texts of url requests are taken to have been fetched. ``model`` replaces scores
    of traits; ``narrator`` adds the column ``narrative`` to profiles.
    """
    if fetch == "default":
        fetch = partial(texts.fetch_text, timeout=config.fetch_timeout, most=config.max_text_size)
    if isinstance(fetch, FetchLedger):
        own = fetch.texts(requests, validation.field_error().isNull())
    else:
        own = texts.fetched(requests, fetch, validation.field_error().isNull()) if fetch else requests.withColumn("fetch_error", F.lit(None).cast("string"))
    checked = validation.validated(own, config.max_text_size, fetched=True)
    good = checked.where("reject IS NULL").select(key, "text")
    found = narrator(profile.profiles(good, lex_rows, key, analysis_id, model))
    return found.select(key, *RESPONSE, "features"), checked.where("reject IS NOT NULL").select(key, "reject")


def analyze_folder(
    spark: SparkSession,
    folder: str | None,
    lex_rows,
    source_type: str | None = None,
    config: texts.Config = texts.Config(),  # noqa: B008
    source_date: str | None = None,
    model: Mapping[str, Column] | None = None,
    narrator: Callable[[DataFrame], DataFrame] = narrative.with_narrative,
) -> DataFrame:
    """The response for all text files of ``folder``, or the configured one, as one document, with ``files_read``.

    A ValueError says which rule the request fails; the size is known, and checked, before a text is read.
    """
    folder = folder or config.dir_path
    request = spark.createDataFrame([(source_type, source_date)], "source_type string, source_date string")
    checked = validation.validated_folders(request, folder, config.source_type).first()
    if checked["reject"]:
        raise ValueError(checked["reject"])
    files, size = texts.folder_size(spark, folder)
    if error := spark.range(1).select(validation.bytes_error(F.lit(size), config.max_text_size, "combined text").alias("e")).first()["e"]:
        raise ValueError(error)
    joined = texts.joined_files(spark, folder).select(F.lit(folder).alias("folder"), "text")
    found = narrator(profile.profiles(joined, lex_rows, "folder", model=model))
    return found.select(*RESPONSE, "features", F.lit(files).cast("long").alias("files_read"), F.lit(checked["source_type"]).alias("source_type"))


def as_json(responses: DataFrame, *extra: str) -> DataFrame:
    """Responses as lines of JSON."""
    return responses.select(F.to_json(F.struct(*RESPONSE, *extra)).alias("value"))


def save(store: Store, responses: DataFrame, source_type: str = "paste") -> None:
    store.save(rows_of(responses, source_type))


def pdf_of(store: Store, analysis_id: str, render: Callable[[list[tuple[str, str]]], bytes] = narrative.pdf_bytes) -> DataFrame:
    """(analysis_id, pdf) of a saved analysis, or no row; ``render`` makes a file of its lines."""
    return narrative.pdfs(store.profile(analysis_id), "analysis_id", render)

"""Request validation as a reject column: valid rows go on, others carry their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SOURCE_TYPES = ("blog", "chat", "email", "paste", "file", "url")
LEAST_BYTES, MAX_BYTES = 10, 1_000_000
REQUEST = "text string, source_type string, source_date string, source_url string"


def empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def tag_errors(source_type_default: str | None = None) -> Column:
    """The failed field rules in the order of the fields, joined by ``; ``; with a default the type may be left out."""
    kind = F.when(~empty("source_type") & ~F.col("source_type").isin(*SOURCE_TYPES), "SourceType: oneof")
    if source_type_default is None:
        kind = F.when(empty("source_type"), "SourceType: required").otherwise(kind)
    date = F.col("source_date")
    real = date.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNotNull()
    day = F.when(~empty("source_date") & ~real, "SourceDate: datetime")
    url = F.when(~empty("source_url") & ~F.col("source_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s/]\S*\z"), "SourceURL: url")
    return F.nullif(F.concat_ws("; ", kind, day, url), F.lit(""))


def size_error(text: Column, most: int = MAX_BYTES, what: str = "text") -> Column:
    return bytes_error(F.octet_length(F.coalesce(text, F.lit(""))), most, what)


def bytes_error(size: Column, most: int = MAX_BYTES, what: str = "text") -> Column:
    own = F.when(size < LEAST_BYTES, f"{what} must be at least 10 characters")
    return own.when(size > most, f"{what} exceeds max size") if most > 0 else own


def field_error() -> Column:
    """What is wrong with a request before any text is fetched."""
    no_url = F.when((F.col("source_type") == "url") & empty("source_url"), "source_url is required when source_type=url")
    return F.coalesce(tag_errors(), no_url)


def validated(requests: DataFrame, most: int = MAX_BYTES, fetched: bool = False) -> DataFrame:
    """Adds ``reject``, null for valid rows; the first rule that fails gives it.

    ``fetched``: the texts of url requests have been fetched and ``fetch_error`` says what failed.
    """
    rules = [field_error()]
    if fetched:
        rules.append(F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit("failed to fetch URL: "), F.col("fetch_error"))))
    return requests.withColumn("reject", F.coalesce(*rules, size_error(F.col("text"), most)))


def validated_folders(requests: DataFrame, folder: Column | str, default: str = "file") -> DataFrame:
    """Folder requests (source_type, source_date): the type is optional, and a folder (a column, or one for all) must be configured."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    own = requests.withColumn("source_url", F.lit(None).cast("string"))
    unset = F.when(F.coalesce(folder, F.lit("")) == "", "dir_path not configured")
    own = own.withColumn("reject", F.coalesce(tag_errors(default), unset)).drop("source_url")
    return own.withColumn("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit(default)))


def parsed(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Requests from lines of JSON, with the columns ``keep``; ``reject`` for lines that aren't JSON objects of these fields."""
    body = F.from_json(F.col(column), REQUEST + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(*keep, body.alias("b"))
    bad = F.col("b").isNull() | F.col("b._corrupt").isNotNull()
    own = rows.select(*keep, "b.text", "b.source_type", "b.source_date", "b.source_url", bad.alias("__bad"))
    return validated(own).withColumn("reject", F.when(F.col("__bad"), "invalid JSON").otherwise(F.col("reject"))).drop("__bad")

"""Secret scans through an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). A ledger keeps, for
each blob, the rule versions that have scanned it and what they found. A batch scans only
the pairs of blob and rule version that the ledger lacks, one row per blob however many rows repeat it, and
findings are joined back to all paths that hold the blob. A batch is one directory written
by Spark's commit protocol, so a retried task or batch leaves no duplicates; it counts once it
is committed.

Cases: a null text is the empty text; a null path is a path like any other; repeated rows
each get a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import file_system, new_path, slices, spread_join, staged, table, text_or_empty

FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Blobs with findings and their spans that are broadcast to where texts are masked: some 10 MB.
SPANS = 200_000
LEDGER_SCHEMA = "blob binary, rules array<string>, findings array<struct<kind:string, start:long, end:long>>"


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters at least, or the match is dropped after it has consumed its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of [0-9a-f] and AKIA[A-Z0-9] are maximal, so a minimum length in the pattern finds the
#: same spans as filtering the runs afterwards. The letters of the keywords are ASCII only. No
#: pattern gives back what a run has taken or starts within a run of its own letters, so each is linear in the text.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]++ )*?PRIVATE KEY-----", base=False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", version=2, base=False),
)


def find_spans(text: str, rules) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, in the order of the rules."""
    found = []
    for rule in rules:
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((rule.kind, m.start(), m.end()))
    return found


class BlobLedger:
    """The scanned blobs under ``path``, one sub-directory a batch."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def _batch(self, name: str) -> str:
        return f"{self.path}/batch={quote(name, safe='')}"

    def _is_committed(self, path: str) -> bool:
        own, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(own)

    def committed(self) -> list[str]:
        """The directories of the committed batches."""
        own, fs = self._fs(self.path)
        if not fs.exists(own):
            return []
        return sorted(p for p in (str(x.getPath().toString()) for x in fs.listStatus(own)) if self._is_committed(p))

    def entries(self) -> DataFrame:
        """All entries of all committed batches."""
        paths = self.committed()
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def pending(self, versions: DataFrame) -> DataFrame:
        """(blob, path, rules, n): for each blob with unseen rule versions, the path of one version, those rules, and how many rows have it."""
        blobs = versions.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("n"))
        seen = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        current = F.array(*[F.lit(r.key) for r in self.rules])
        todo = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("rules"), "n").where(F.size("rules") > 0)

    def representatives(self, keyed: DataFrame) -> DataFrame:
        """(blob, rules, text): one row of ``keyed`` (path, text, blob) for each blob with unseen rule versions."""
        todo = staged(self.pending(keyed.select("path", "blob")), "pending").withColumnsRenamed({"path": "p", "blob": "b"})
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each = max((todo.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 16)
        # Other rows are dealt by their path's hash and blob: evenly, whatever their texts. Rows that repeat meet there, and one goes on.
        rest = todo.where(F.col("n") <= each).select(F.xxhash64("p").alias("h"), F.col("b").alias("blob"), "rules")
        rest = keyed.select(F.xxhash64("path").alias("h"), "blob", "text").join(rest, ["h", "blob"]).dropDuplicates(["h", "blob"]).select("blob", "rules", "text")
        # Blobs of very many rows, fewer than 4 * parts, are one row in each task before they meet.
        hot = todo.where(F.col("n") > each)
        if hot.isEmpty():
            return rest
        often = keyed.join(F.broadcast(hot), F.col("blob") == F.col("b")).select("blob", "rules", "text").dropDuplicates(["blob"])
        return rest.unionByName(often)

    def scan(self, versions: DataFrame, batch: str) -> None:
        """Scans what is unseen of ``versions`` (path, text) and commits it as ``batch``.

        An unfinished batch is replaced. To a committed one only what no batch has is added, so committing it again changes nothing.
        """
        rules = {r.key: r for r in self.rules}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [
                    [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text, [rules[x] for x in todo])]
                    for text, todo in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, FINDINGS)], names=["blob", "rules", "findings"])

        out = self.representatives(with_blob(versions)).mapInArrow(run, LEDGER_SCHEMA)
        path = self._batch(batch)
        # Entries are read while this is written, so nothing that they come from may be removed.
        out.write.mode("append" if self._is_committed(path) else "overwrite").parquet(path)

    def findings(self) -> DataFrame:
        """(blob, findings) of the current rule versions, for blobs that have any."""
        kinds = [r.kind for r in self.rules]
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        known = F.transform(F.array_intersect("rules", keys), lambda x: F.element_at(F.split(x, "@"), 1))
        own = F.filter("findings", lambda x: F.array_contains(known, x["kind"]) & x["kind"].isin(kinds))
        rows = self.entries().select("blob", own.alias("findings")).where(F.size("findings") > 0)
        return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))

    def by_path(self, versions: DataFrame) -> DataFrame:
        """(path, findings) for every row of ``versions`` (path, text); findings is empty where there are none."""
        paths = with_blob(versions).select("path", "blob")
        none = F.array().cast("array<struct<kind:string, start:long, end:long>>")
        # A blob that very many paths hold is no task of its own.
        found = staged(paths.groupBy("blob").agg(F.count("*").alias("n")).join(self.findings(), "blob"), "found")
        return spread_join(paths, found, ["blob"], "left").select("path", F.coalesce("findings", none).alias("findings"))


def blob_of(column: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(column), 256))


def with_blob(versions: DataFrame) -> DataFrame:
    return versions.select("path", text_or_empty().alias("text"), blob_of("text").alias("blob"))


def joined(findings: Column, rules) -> Column:
    """kind:start:end by start, then kind in the order of ``rules``, comma-joined."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    own = F.filter(findings, lambda x: F.array_contains(order, x["kind"]))
    keyed = F.transform(own, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["kind"].alias("kind"), x["end"].alias("e")))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def scan_documents(spark: SparkSession, docs: DataFrame, ledger_path: str | None = None, batch: str | None = None) -> DataFrame:
    """(path, findings) of ``docs`` (doc_id, text), through the ledger at ``ledger_path`` or a new one, as ``batch`` or a new one."""
    ledger = BlobLedger(spark, ledger_path or new_path(spark, "ledger"))
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger.scan(versions, batch or uuid.uuid4().hex)
    return ledger.by_path(versions)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; all rows and columns stay, ``n_chars`` follows the text."""
    ledger = BlobLedger(spark, new_path(spark, "ledger"))
    ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"), "0")
    # By the text and not by the id, which rows with other texts may share or lack.
    found = staged(ledger.findings().select(F.col("blob").alias("__blob"), F.col("findings").alias("__found")), "found")
    schema, names = docs.schema, docs.columns
    rows = docs.withColumn("__blob", blob_of("text"))
    n, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("__found")), F.lit(0))).first()
    if n + spans <= SPANS:
        rows = rows.join(F.broadcast(found), "__blob", "left")
    else:
        counted = rows.groupBy("__blob").agg(F.count("*").alias("n")).join(found, "__blob")
        rows = spread_join(rows, staged(counted, "counted"), ["__blob"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column("__found")
            if found.null_count == batch.num_rows:
                yield batch.select(names)
                continue
            texts = [t if f is None else masked(t or "", f) for t, f in zip(batch.column("text").to_pylist(), found.to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).select(names)

    out = rows.select(*names, "__found").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def masked(text: str, findings) -> str:
    """Overlapping spans are masked as one, named by the first."""
    out, at, last = [], 0, -1
    for f in sorted(findings, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at or last < 0:
            out += [text[at : f["start"]], f"[{f['kind']}]"]
        at, last = max(at, f["end"]), f["end"]
    return "".join(out) + text[at:]


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    found = scan_documents(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base],
        F.sha2(joined(F.col("findings"), [r for r in RULES if r.base]), 256).alias("base_sha256"),
        joined(F.col("findings"), RULES).alias("spans"),
    )

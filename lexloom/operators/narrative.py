"""Narratives and PDF files of profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import scoring as S
from lexloom.functions import weights as w

PRODUCT = "lexloom"
FOOTER = f"Generated by {PRODUCT} from templates. Not a clinical assessment."


def exact2(value: Column | str) -> Column:
    """A number from 0 on to two digits by its exact binary value, half to even."""
    return all_exact2(F.array(value))[0]


def all_exact2(values: Column) -> Column:
    """Each number of an array from 0 on to two digits by its exact binary value, half to even.

    The nearest double to the tie above the hundredths below decides; a value that is this double is
    compared with the tie itself in whole multiples of 2**-60, which both are.
    """
    tied = F.transform(values, lambda v: F.struct(v.alias("v"), F.floor(v * 100).alias("k"), ((2 * F.floor(v * 100) + 1) / F.lit(200.0)).alias("tie")))

    def cents(x: Column) -> Column:
        v, k, tie = x["v"], x["k"], x["tie"]
        part = ((tie - F.floor(tie)) * F.lit(2.0**60)).cast("long").cast("decimal(38,0)") * 200
        over = part - (2 * k + 1 - 200 * F.floor(tie)).cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)")
        at_tie = F.when(over == 0, k % 2).otherwise(F.when(over > 0, 1).otherwise(0))
        return F.when(~F.isnan(v), k + F.when(v > tie, 1).when(v < tie, 0).otherwise(at_tie))

    return F.transform(F.transform(tied, cents), lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")))


def two(x: Column) -> Column:
    """Of values that have two digits already."""
    return F.format_string("%.2f", x)


def constants(rows: list[dict[str, str | bool]]) -> Column:
    """An array of structs of fixed values."""
    spelled = lambda x: str(x).lower() if isinstance(x, bool) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {spelled(v)}" for k, v in row.items()) + ")" for row in rows) + ")")


def trait_rows(names) -> Column:
    """(key, title, high, low, middle, closed) of traits."""
    fields = ("high", "low", "middle", "closed")
    return constants([{"key": t, "title": w.TRAIT_NAMES[t]} | dict(zip(fields, w.TRAIT_LABELS[t], strict=True)) for t in names])


def trait_line(row: Column, bold: str = "**") -> Column:
    """The line of the trait that ``row``, of :func:`trait_rows`, describes."""
    t = F.col("traits")[row["key"]]
    score, ci = t["score"], t["confidence_interval"]
    label = F.when((score > w.HIGH) | (score == w.HIGH) & row["closed"], row["high"]).when(score < w.LOW, row["low"]).otherwise(row["middle"])
    return F.concat(
        F.lit(bold), row["title"], F.lit(f":{bold} "), two(score), F.lit(" ("), label, F.lit(") — "), t["percentile"].cast("string"),
        F.lit("th percentile (95% CI: "), two(ci[0]), F.lit("–"), two(ci[1]), F.lit(")"),
    )


def value_lines(start: str, bold: str) -> Column:
    """Lines of the values by falling percent, ties by key."""
    rows = F.transform(F.map_entries("values"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key")))
    titles = F.create_map(*[F.lit(x) for kv in w.VALUES.items() for x in kv])
    line = lambda r: F.concat(F.lit(f"{start}{bold}"), F.coalesce(titles[r["key"]], r["key"]), F.lit(f":{bold} "), F.col("value_texts")[r["key"]], F.lit("% of words"))
    return F.transform(F.array_sort(rows), line)


def with_value_texts(profiles: DataFrame) -> DataFrame:
    texts = F.map_from_arrays(F.array(*[F.lit(v) for v in w.VALUES]), all_exact2(F.array(*[F.col("values")[v] for v in w.VALUES])))
    return profiles.withColumn("value_texts", texts)


def summary_lines(start: str, bold: str) -> Column:
    """Lines of the summary variables."""
    fields = ("title", "high", "low", "middle")
    rows = constants([{"key": s} | dict(zip(fields, w.SUMMARY_LABELS[s], strict=True)) for s in w.SUMMARY_LABELS])
    own = F.map_from_arrays(F.array(*[F.lit(s) for s in w.SUMMARY_LABELS]), F.array(*[F.col("summary")[s] for s in w.SUMMARY_LABELS]))

    def line(row: Column) -> Column:
        x = own[row["key"]]
        label = F.when(x >= w.HIGH, row["high"]).when(x < w.LOW, row["low"]).otherwise(row["middle"])
        return F.concat(F.lit(f"{start}{bold}"), row["title"], F.lit(f":{bold} "), two(x), F.lit(" — "), label)

    return F.transform(rows, line)


OTHERS = [t for t in w.TRAITS if t not in w.BIG_FIVE_TRAITS]


def with_narrative(profiles: DataFrame) -> DataFrame:
    """Adds ``narrative``, in Markdown."""
    parts = [F.lit("## Psychological Profile\n\n**Confidence level:** "), F.col("confidence_flag"), F.lit("\n\n### Big Five (OCEAN)\n\n")]
    headed = lambda r: F.concat(F.lit("### "), r["title"], F.lit("\n\n"), trait_line(r), F.lit("\n\n"))
    parts.append(F.array_join(F.transform(trait_rows(w.BIG_FIVE_TRAITS), lambda r: F.concat(trait_line(r), F.lit("\n\n"))), ""))
    parts.append(F.array_join(F.transform(trait_rows(OTHERS), headed), ""))
    own = F.concat(F.lit("### Schwartz Value Orientation\n\n"), F.array_join(value_lines("- ", "**"), "\n"), F.lit("\n\n"))
    parts.append(F.when(F.size("values") > 0, own).otherwise(F.lit("")))
    parts += [F.lit("### Summary Variables\n\n"), F.array_join(summary_lines("- ", "**"), "\n"), F.lit("\n")]
    parts.append(F.lit(f"\n---\n*{FOOTER}*"))
    return with_value_texts(profiles).withColumn("narrative", F.concat(*parts)).drop("value_texts")


# --- PDF -----------------------------------------------------------------------------------


def pdf_lines(profiles: DataFrame) -> DataFrame:
    """Adds ``lines``: (style, text) in the order of the page; a trait without an interval is left out."""
    line = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"))
    head = lambda title: F.array(line("gap", F.lit("")), line("heading", F.lit(title) if isinstance(title, str) else title))
    none = F.array().cast("array<struct<style:string,text:string>>")
    own = lambda r: F.when(F.size(F.col("traits")[r["key"]]["confidence_interval"]) >= 2, F.array(line("body", trait_line(r, ""))))
    body = lambda texts: F.transform(texts, lambda x: line("body", x))
    title = F.concat(F.lit("Confidence level: "), F.col("confidence_flag"), F.lit("  |  Analysis ID: "), F.col("analysis_id"))
    parts = [F.array(line("title", F.lit("Psychological Profile")), line("note", title)), head("Big Five (OCEAN)")]
    parts.append(F.flatten(F.transform(trait_rows(w.BIG_FIVE_TRAITS), lambda r: F.coalesce(own(r), none))))
    parts.append(F.flatten(F.transform(trait_rows(OTHERS), lambda r: F.concat(head(r["title"]), F.coalesce(own(r), none)))))
    parts.append(F.when(F.size("values") > 0, F.concat(head("Schwartz Value Orientation"), body(value_lines("", "")))).otherwise(none))
    parts += [head("Summary Variables"), body(summary_lines("", ""))]
    story = F.transform(F.split("narrative", "\n"), lambda x: F.struct(F.lit("small").alias("style"), x.alias("text")))
    parts.append(F.when(F.col("narrative") != "", F.concat(head("Narrative"), story)).otherwise(none))
    parts.append(F.array(line("gap", F.lit("")), line("note", F.lit(FOOTER))))
    return with_value_texts(profiles).withColumn("lines", F.concat(*parts)).drop("value_texts")


#: Points of each style: size and line height; whether bold, whether centred.
STYLES = {"title": (16, 24, True, True), "heading": (12, 18, True, False), "body": (9, 13, False, False), "small": (8, 11, False, False), "note": (8, 14, False, True), "gap": (8, 10, False, False)}
PAGE, MARGIN = (595, 842), 57  # A4, 20 mm
#: Files that a task renders before it passes them on.
FILES = 256


def pdf_bytes(lines: list[tuple[str, str]], title: str = "Psychological Profile") -> bytes:
    """A PDF of the lines, wrapped by an average width of letters."""
    pages, ops, y = [], [], PAGE[1] - MARGIN
    for style, text in lines:
        size, height, bold, centred = STYLES[style]
        room = int((PAGE[0] - 2 * MARGIN) / (size * 0.5))
        for part in wrapped(text, room):
            if y - height < MARGIN:
                pages.append(ops)
                ops, y = [], PAGE[1] - MARGIN
            y -= height
            raw = part.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            x = max(MARGIN, (PAGE[0] - len(part) * size * 0.5) / 2) if centred else MARGIN
            ops.append(b"BT /F%d %d Tf %d %d Td (%s) Tj ET" % (2 if bold else 1, size, x, y, raw))
    pages.append(ops)
    kids = " ".join(f"{6 + 2 * k} 0 R" for k in range(len(pages)))
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), font % b"Helvetica", font % b"Helvetica-Bold", f"<< /Title ({title}) /Author ({PRODUCT}) >>".encode()]
    for k, ops in enumerate(pages):
        stream = b"\n".join(ops)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE[0]} {PAGE[1]}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {7 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def wrapped(text: str, room: int) -> list[str]:
    out, line = [], ""
    for word in text.split(" "):
        if line and len(line) + 1 + len(word) > room:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line]


def pdfs(profiles: DataFrame, key: str = "doc_id", render: Callable[[list[tuple[str, str]]], bytes] = pdf_bytes) -> DataFrame:
    """(key, pdf): one file a profile; a profile without narrative has no such section.

    ``render`` makes a file of (style, text) lines.
    """
    kind = profiles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):  # Python objects of the lines of so many files at a time
                part = batch.slice(at, FILES)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(map(render, _lines_of(part.column("lines"))), pa.binary())], names=[key, "pdf"])

    own = profiles if "narrative" in profiles.columns else profiles.withColumn("narrative", F.lit(""))
    return pdf_lines(own).select(key, "lines").mapInArrow(run, f"`{key}` {kind}, pdf binary")


def _lines_of(column: pa.ListArray) -> Iterator[list[tuple[str, str]]]:
    """The (style, text) lines of each row."""
    for k in range(len(column)):
        style, text = column[k].values.flatten()
        yield [(s, t or "") for s, t in zip(style.to_pylist(), text.to_pylist(), strict=True)]

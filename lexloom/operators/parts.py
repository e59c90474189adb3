"""Documents in several rows, as if their parts had been joined by blank lines, without joining them.

Markup may begin in one part and end in another, and then the blank line between them is part of
the tag: what stands before it and after it is one word, one line and one paragraph. Each part maps the state
before it (in a tag or not) to the state after it. A part with ``>`` or with an open tag at its end leaves the
same state whatever came before, and any other leaves it as it was. So the state before a part is that
of the last part that sets one: a running maximum, which ranges of a hot document's parts share.

All counts of a part follow from its own text and that state, but for words and lines at the joints that
tags have swallowed. Only the parts on both sides of such joints go on: their outer words and lines
meet by the number of the word or line in the document, and nothing else of a text moves.

Cases: a null text is the empty text; a null key is a key; parts that tie in the order are taken in any
order; a part may be empty, or inside a tag as a whole; a tag that never ends takes the rest of the document;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.running import Total, largest, ordinal, running
from lexloom.sources.shared import staged

OPEN = r"<[\p{L}/]"
AT_START, AT_END, WHOLE = rf"^{T.WORD[:-1]}", rf"{T.WORD[:-1]}\z", rf"^{T.WORD}\z"


def leaves(text: Column) -> Column:
    """The state after a part: 1 in a tag, 0 not, null as before it. After ``>`` no tag is open, whatever came before."""
    return F.when(F.substring_index(text, ">", -1).rlike(OPEN), 1).when(F.contains(text, F.lit(">")), 0)


def in_state(text: Column, inside: Column) -> Column:
    """The part without its markup: what ``inside`` a tag is left of it begins after the first ``>``."""
    end = F.instr(text, ">")
    rest = F.when(end > 0, F.substring(text, end + 1, F.char_length(text))).otherwise(F.lit(""))
    return T.strip_markup(F.when(inside, rest).otherwise(text))


@dataclass(frozen=True)
class Parts:
    """The parts of documents: ``rows`` (key, position, inside, glued, text without markup), and the few that swallowed joints touch.

    ``inside``: the part begins in a tag; ``glued``: it begins or ends in one.
    """

    key: str
    rows: DataFrame

    @property
    def glued(self) -> DataFrame:
        return self.rows.where("glued")


def parts(docs: DataFrame, key: str, order: list[str], text: str = "text") -> Parts:
    """``docs`` (key, order, text), each row a part of the document ``key``, in the order of the columns ``order``."""
    own = docs.select(F.col(key), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = staged(own.withColumn("__row", F.monotonically_increasing_id()), "parts")
    at = [F.col(f"__o{i}") for i in range(len(order))] + [F.col("__row")]
    state = leaves(F.col("text"))
    set_at = F.when(state.isNotNull(), F.struct(*at, state.alias("state")))
    rows = running(rows, [key], at, {"position": ordinal(), "__set": Total(set_at, F.max, F.greatest, before=True)})
    inside = F.coalesce(F.col("__set")["state"] == 1, F.lit(False))
    after = F.coalesce(state == 1, inside)
    rows = rows.withColumns({"inside": inside, "glued": inside | after})
    return Parts(key, staged(rows.select(key, "position", "inside", "glued", in_state(F.col("text"), F.col("inside")).alias("text")), "stripped"))


# --- words ---------------------------------------------------------------------------------


def _joined(own: Parts) -> DataFrame:
    """(key, position, open, group, before): of the glued parts that aren't empty, whether the first word began in an earlier part, and the
    words that the part's last and first word belong to, by number."""
    key = own.key
    rows = own.glued.select(key, "position", "inside", F.char_length("text").alias("size"), F.col("text").rlike(AT_START).alias("starts"), F.col("text").rlike(AT_END).alias("ends"), F.col("text").rlike(WHOLE).alias("whole"))
    # A chain of parts without a joint between them begins at the part that no tag leads into.
    chains = running(staged(rows, "glued"), [key], [F.col("position")], {"chain": largest(F.when(~F.col("inside"), F.col("position")))})
    rows = staged(chains.where("size > 0"), "chains")
    rows = running(rows, [key], [F.col("position")], {"n": ordinal()})
    rows = staged(rows.withColumn("__key", named(key)), "numbered")
    last = rows.select("__key", F.col("chain").alias("__chain"), (F.col("n") + 1).alias("__n"), F.col("ends").alias("__ends"))
    same = (rows["__key"] == last["__key"]) & (F.col("chain") == F.col("__chain")) & (F.col("n") == F.col("__n"))
    rows = rows.join(last, same, "left").withColumn("open", F.col("starts") & F.coalesce("__ends", F.lit(False)))
    rows = staged(rows.select(key, "position", "n", "ends", "whole", "open"), "open")
    anchor = F.when(~(F.col("whole") & F.col("open")), F.col("n"))
    return running(rows, [key], [F.col("n")], {"group": largest(anchor), "before": largest(anchor, before=True)})


def named(key: str) -> Column:
    """The key as a text, null too, to join on."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def words(own: Parts) -> DataFrame:
    """(key, __word): all words of all documents, a null word for a part without words of its own."""
    key = own.key
    plain = own.rows.where("NOT glued").select(key, F.explode_outer(T.tokens(F.col("text"))).alias("__word"))
    joints = _joined(own).select(named(key).alias("__key"), F.col("position").alias("__position"), "n", "open", "ends", "whole", "group", "before")
    rows = own.glued.withColumn("__key", named(key)).withColumn("t", T.tokens(F.col("text")))
    rows = rows.join(joints, (rows["__key"] == joints["__key"]) & (F.col("position") == F.col("__position")), "left")
    first, last = F.coalesce("open", F.lit(False)).cast("int"), F.coalesce("ends", F.lit(False)).cast("int")
    inner = F.slice("t", first + 1, F.greatest(F.size("t") - first - last, F.lit(0)))
    pieces = F.array_compact(
        F.array(
            F.when(F.col("open"), F.struct(F.col("before").alias("group"), F.col("n"), F.get("t", F.lit(0)).alias("piece"))),
            F.when(F.col("ends") & ~(F.col("whole") & F.col("open")), F.struct("group", "n", F.get("t", F.size("t") - 1).alias("piece"))),
        )
    )
    rows = staged(rows.select(key, inner.alias("inner"), pieces.alias("pieces")), "joints")
    inside = rows.select(key, F.explode_outer("inner").alias("__word"))
    met = rows.select(key, F.explode("pieces").alias("p")).select(key, "p.*").groupBy(key, "group")
    met = met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("__word"))
    return plain.unionByName(inside).unionByName(met.select(key, "__word"))


# --- lines ---------------------------------------------------------------------------------


def _paragraphs(own: Parts) -> DataFrame:
    """(key, paragraphs) of the glued parts' chains, one row for each of several shares."""
    key = own.key
    flags = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(T.SPACES)) != "")
    rows = own.glued.select(key, "position", "inside", flags.alias("nb"))
    rows = running(staged(rows, "lines"), [key], [F.col("position")], {"chain": largest(F.when(~F.col("inside"), F.col("position")))})
    rows = staged(rows.withColumn("m", F.size("nb").cast("long")), "chained")
    # Within a chain the last line of a part and the first of the next are one.
    rows = running(rows, [key, "chain"], [F.col("position")], {"base": Total(F.col("m") - 1, before=True)})
    rows = staged(rows.withColumn("base", F.coalesce("base", F.lit(0))), "based")
    here = lambda i: F.get(F.col("nb"), i)
    inner = F.filter(F.sequence(F.lit(2), F.greatest(F.col("m").cast("int") - 2, F.lit(2))), lambda i: (i <= F.col("m") - 2) & here(i) & ~here(i - 1))
    shares = rows.select(key, F.size(inner).cast("long").alias("paragraphs"))
    # Outer lines, and those next to them, by their numbers: whether a paragraph begins there is asked of the first two and the last.
    m = F.col("m").cast("int")
    at = F.filter(F.array_distinct(F.array(F.lit(0), F.lit(1), m - 2, m - 1)), lambda i: (i >= 0) & (i < m))
    outer = rows.select(key, "chain", "base", "m", "nb", F.explode(at).alias("i"))
    outer = outer.select(key, "chain", (F.col("base") + F.col("i")).alias("line"), here(F.col("i")).alias("nb"), ((F.col("i") <= 1) | (F.col("i") == F.col("m") - 1)).alias("asked"))
    outer = outer.groupBy(key, "chain", "line").agg(F.max("nb").alias("nb"), F.max("asked").alias("asked"))
    outer = staged(outer.withColumn("__key", named(key)), "outer")
    above = outer.select(F.col("__key").alias("__k"), F.col("chain").alias("__c"), (F.col("line") + 1).alias("__line"), F.col("nb").alias("__nb"))
    same = (F.col("__key") == F.col("__k")) & (F.col("chain") == F.col("__c")) & (F.col("line") == F.col("__line"))
    begins = outer.where("asked AND nb").join(above, same, "left").where("__nb IS NULL OR NOT __nb")
    return shares.unionByName(begins.select(key, F.lit(1).cast("long").alias("paragraphs")))


# --- documents -----------------------------------------------------------------------------


def word_totals(found: DataFrame, key: str) -> DataFrame:
    """(key, word_count, unique_words) of ``found`` (key, __word): exact, in two steps, so the different words of a hot key are dealt out by word."""
    by_word = found.groupBy(key, "__word").agg(F.count("__word").alias("__n"))
    return by_word.groupBy(key).agg(F.sum("__n").alias("word_count"), F.count("__word").alias("unique_words"))


def stats(own: Parts) -> DataFrame:
    """(key, parts, word_count, unique_words, type_token_ratio, sentence_count, paragraph_count) of whole documents."""
    key = own.key
    marks = (F.char_length("text") - F.char_length(F.translate("text", ".!?", ""))).cast("long")
    some = F.trim("text", F.lit(T.SPACES)) != ""
    local = F.when(F.col("glued"), 0).otherwise(T.paragraph_count(T.normalize_space(F.col("text")))).cast("long")
    none = F.lit(0).cast("long")
    rows = own.rows.select(key, F.lit(1).cast("long").alias("parts"), marks.alias("marks"), some.alias("some"), local.alias("paragraphs"), none.alias("word_count"), none.alias("unique_words"))
    lines = _paragraphs(own).select(key, none.alias("parts"), none.alias("marks"), F.lit(False).alias("some"), "paragraphs", none.alias("word_count"), none.alias("unique_words"))
    totals = word_totals(words(own), key).select(key, none.alias("parts"), none.alias("marks"), F.lit(False).alias("some"), none.alias("paragraphs"), "word_count", "unique_words")
    # Counts of a key's rows are summed, so no join meets a hot or a null key.
    whole = rows.unionByName(lines).unionByName(totals).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("parts", "marks", "paragraphs", "word_count", "unique_words")], F.max("some").alias("some"))
    return whole.select(
        key, "parts", "word_count", "unique_words",
        F.when(F.col("word_count") > 0, F.col("unique_words") / F.col("word_count")).otherwise(F.lit(0.0)).alias("type_token_ratio"),
        F.when((F.col("marks") == 0) & F.col("some"), F.lit(1).cast("long")).otherwise(F.col("marks")).alias("sentence_count"),
        F.col("paragraphs").alias("paragraph_count"),
    )

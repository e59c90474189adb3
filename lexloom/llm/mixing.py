"""Mixing sources to target weights by temperature.

Weights are the sources' token shares to an exponent, normalised. The exponent is found by
repeated section of [0, 1]: the largest at which the mixture has the target entropy, raised if
need be until no source is repeated more than a limit. The target is a share of the largest entropy, or
as much of the way there from the natural entropy as ``closing`` says, whichever is more. The budget is
the smallest at which every source is seen whole at least once. It is realised by epochs: each is a permutation of
the source's blocks of documents, and the last ends, within a block, where the budget does.

Only sums over sources reach the driver. Documents fall into blocks by hash; totals by block
are summed in order of the permutation, and single documents only in the block that the budget
cuts, so a source with a third of all rows has no task of its own. What a source's last epoch holds
is then one row of thresholds, and a document's own hashes say how often it is seen: texts are not shuffled.

Cases: a null source is a source of its own; a null text is the empty text; documents without
tokens are in every whole epoch and take nothing from the budget; rows with the same id, source and text
are one unit, kept together, and so are those without an id that have the same source and text (texts by a hash of
64 bits); one source, or sources without tokens, are seen once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import spread_join, staged, table, text_or_empty
from lexloom.llm.token_rollup import WORDS_1, word_counts

#: Of the entropy of equal weights, and of the way there; times that a source may be seen; documents a block.
TARGET_ENTROPY, CLOSING, MAX_REPEATS, BLOCK_DOCS, SEED = 0.9, 0.5, 4.0, 1024, 11
PARTS_LOG2 = 10
#: Sources whose plans are broadcast, some 100 bytes each.
SOURCES = 100_000


def text_key() -> Column:
    return F.xxhash64(text_or_empty())


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, place, tokens), one row for each id, source and text; ``place`` is what is hashed, the id or else the text's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_key().alias("key"), word_counts(WORDS_1).alias("tokens"))
    return rows.groupBy("doc_id", "source", "key").agg(F.sum("tokens").alias("tokens")).withColumn("place", F.coalesce("doc_id", "key"))


def exponent(sources: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, closing: float = 0.0) -> float:
    """The exponent for ``sources`` (source, tokens)."""
    own = sources.where("tokens > 0")
    n, total, least, most = own.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1 or least == most:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    natural = -own.agg(F.sum(p * F.log(p))).first()[0]
    goal = max(target * math.log(n), natural + closing * (math.log(n) - natural))
    lo, hi, points = 0.0, 1.0, 16  # entropy falls with the exponent
    for _ in range(6):
        grid = [lo + (hi - lo) * i / points for i in range(points + 1)]
        sums = own.agg(*[f(F.pow(p, F.lit(a))) for a in grid for f in (F.sum, lambda q: F.sum(q * F.log(p)))]).first()
        entropy = [math.log(z) - a * s / z for a, z, s in zip(grid, sums[::2], sums[1::2], strict=True)]
        meets = [i for i, h in enumerate(entropy) if h >= goal]
        at = max(meets, default=0)
        lo, hi = grid[at], grid[min(at + 1, points)]
    # A source is seen (its share / the largest share) ** (exponent - 1) times.
    repeats = 1 - math.log(max_repeats) / math.log(most / least)
    return max(lo, repeats, 0.0)


def quotas(sources: DataFrame, alpha: float) -> DataFrame:
    """``sources`` with weight, epochs (whole ones) and rest (tokens of the last, partial one)."""
    own = sources.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.sum(F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha)))).alias("z")).first()
    if not own["most"]:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    # Rounding keeps equal shares from ending a token short of a whole epoch.
    times = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(float(own["most"])), F.lit(alpha - 1)), 9)).otherwise(F.lit(1.0))
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha)) / F.lit(own["z"])).otherwise(F.lit(0.0))
    epochs = F.greatest(F.floor(times).cast("long"), F.lit(1).cast("long"))
    return sources.select("source", "tokens", weight.alias("weight"), epochs.alias("epochs"), F.floor((times - epochs) * F.col("tokens")).cast("long").alias("rest"))


def plan(own: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, closing: float = CLOSING) -> DataFrame:
    """One row a source of the staged ``own`` units: its blocks, whole epochs, and up to where the permutation of the partial epoch goes.

    The partial epoch has the blocks before (to_order, to_block), and that one too: whole, or if it is ``cut``
    its units up to (to_unit, to_place, to_key), or none where these are null. Without ``to_order`` there is no such epoch.
    """
    sources = own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = staged(sources, "sources")
    planned = quotas(sources, exponent(sources, target, max_repeats, closing)).select(F.col("source").alias("__source"), "epochs", "rest")
    planned = sources.join(planned, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "tokens")
    planned = staged(planned.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS)), "quotas")
    sums = with_plan(own, planned).groupBy("source", "epochs", "rest", "block").agg(F.sum("tokens").alias("n"))
    sums = staged(sums.withColumn("order", _block_order("epochs")).withColumn("part", F.shiftright("order", 64 - PARTS_LOG2)), "sums")
    # Sums over 2 ** PARTS_LOG2 ranges of a source's order, then over the blocks of one range: no task has all blocks of a source.
    ahead = lambda *of: W.partitionBy("source", *of[:-1]).orderBy(of[-1], *(["block"] if len(of) > 1 else [])).rowsBetween(W.unboundedPreceding, -1)
    parts = sums.groupBy("source", "part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("source").alias("__s"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(ahead("part")), F.lit(0)).alias("earlier"))
    sums = sums.join(parts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p"))).drop("__s", "__p")
    sums = sums.withColumn("before", F.col("earlier") + F.coalesce(F.sum("n").over(ahead("part", "order")), F.lit(0)))
    cut = (F.col("before") + F.col("n") > F.col("rest")).alias("cut")
    to = sums.where("before < rest").groupBy("source").agg(F.max(F.struct("order", "block", "before", cut)).alias("to"))
    to = to.select(F.col("source").alias("__source"), F.col("to.order").alias("to_order"), F.col("to.block").alias("to_block"), "to.before", "to.cut")
    planned = staged(planned.join(to, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "blocks")
    within = W.partitionBy("source").orderBy("unit", "place", "key")  # about BLOCK_DOCS units
    inside = with_plan(own, planned).where("cut AND block = to_block").withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    units_to = inside.where("upto <= rest").groupBy("source").agg(F.max(F.struct("unit", "place", "key")).alias("u"))
    units_to = units_to.select(F.col("source").alias("__source"), *[F.col(f"u.{c}").alias(f"to_{c}") for c in ("unit", "place", "key")])
    return staged(planned.join(units_to, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source", "before"), "plan")


def _block_order(epoch: str) -> Column:
    return F.xxhash64(F.lit(SEED), "source", epoch, "block")


def with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (source, place, key, ...) with their source's plan, and ``block`` and ``unit``, the unit's hash in the partial epoch."""
    own = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"), F.col("source").isNull().alias("__z")]
    planned = planned.select(*own, *[c for c in planned.columns if c != "source"])
    rows = rows.withColumns({"__s": own[0], "__z": own[1]})
    if planned.count() <= SOURCES:
        rows = rows.join(F.broadcast(planned.drop("docs")), ["__s", "__z"])
    else:
        rows = spread_join(rows, planned.withColumnRenamed("docs", "n"), ["__s", "__z"])
    rows = rows.drop("__s", "__z").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "place"), "blocks"))
    return rows.withColumn("unit", F.xxhash64(F.lit(SEED), "epochs", "place"))


def _first(*pairs: tuple[str, str]) -> Column:
    """Whether the left columns, in order, come before the right ones or are the same."""
    (a, b), *rest = pairs
    same = _first(*rest) if rest else F.lit(True)
    return (F.col(a) < F.col(b)) | (F.col(a) == F.col(b)) & same


def is_last(order: str) -> Column:
    """Whether a row of :func:`with_plan`, with the hash ``order`` of its block, is in the partial epoch."""
    at = (F.col(order) == F.col("to_order")) & (F.col("block") == F.col("to_block"))
    inside = F.when(F.col("cut"), _first(("unit", "to_unit"), ("place", "to_place"), ("key", "to_key"))).otherwise(F.lit(True))
    return F.coalesce(F.when(at, inside).otherwise(_first((order, "to_order"), ("block", "to_block"))), F.lit(False))


def schedule(docs: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, closing: float = CLOSING) -> DataFrame:
    """(doc_id, source, key, place, tokens, block, epochs, last): ``last`` says whether the unit is also in the partial epoch."""
    own = staged(units(docs), "units")
    rows = with_plan(own, plan(own, target, max_repeats, closing)).withColumn("order", _block_order("epochs"))
    return rows.select("doc_id", "source", "key", "place", "tokens", "block", "epochs", is_last("order").alias("last"))


def mixture(docs: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, closing: float = CLOSING) -> DataFrame:
    """One row for every time that a unit is seen: doc_id, source, tokens, epoch, block, and its order in the epoch's permutation."""
    rows = schedule(docs, target, max_repeats, closing)
    epochs = F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1 + F.col("last").cast("long"))
    seen = rows.withColumn("epoch", F.explode(epochs))
    return seen.select("doc_id", "source", "tokens", "epoch", "block", _block_order("epoch").alias("block_order"), F.xxhash64(F.lit(SEED), "epoch", "place").alias("doc_order"))


def mixed(docs: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, closing: float = CLOSING) -> DataFrame:
    """``docs``, all columns, each row as often as it is seen."""
    own = staged(units(docs), "units")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "source", text_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), text_key()).alias("place"))
    rows = with_plan(rows, plan(own, target, max_repeats, closing)).withColumn("order", _block_order("epochs"))
    times = (F.col("epochs") + is_last("order").cast("long")).cast("int")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), times))).select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents."""
    return mixture(table(spark, sf_dir, "documents"))

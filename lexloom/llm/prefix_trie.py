"""A trie of conversations' prefixes, its totals by leaf-peeling message passing.

Every prefix of every conversation has a digest of its own: the exclusive or of hashes of its turns
and their depths, a running total that a hot conversation's ranges share. Equal digests at
a depth are one node. Each node is labelled by that of its members whose id hashes lowest. A label's nodes
follow one another down the trie, so the trie falls into paths, and on the way down from the root
the label changes about as often as the logarithm of the number of conversations says.

Totals pass up from the leaves. A path holds a counter of the paths that hang from its nodes and
haven't finished; one whose counter is zero has finished, sends the totals of its subtree to the path
it hangs from, and is done; only the root's path finishes last. A chain of turns that no other
conversation shares is one path, so rounds follow the branching and not the length of conversations.
Within a path the totals are running sums from its end.

Cases: a null role or text is empty; turns are ordered by number (null first), those with equal numbers
by the digest of role and text, and repeated rows are turns of their own; rows without a conversation's id
belong to none and are left out; a conversation may be turnless after rebuilding, and ends at the root; an empty
table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import spread_join, staged, table
from lexloom.operators.running import added, ordinal, running, xored

#: Conversations from one multiple of GROUP to the next share the first one's head, of fewer than HEADS turns.
GROUP, HEADS = 20, 4
NODE = ["depth", "x", "y"]
EMPTY = hashlib.sha256(b"").hexdigest()


# --- prefixes ------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, digest, words) of all turns, positions from 1."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("__row"),  # parts repeated rows, which are the same in any order
    )  # fmt: skip
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("__row")]
    return running(staged(rows, "turns"), ["conv_id"], order, {"position": ordinal()}).select("conv_id", "position", "digest", "words")


def own_head(conv_id: Column) -> Column:
    """How many turns a conversation takes from its group's first."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, turns): the turns of rebuilt conversations, and of each a row of depth 0; ``turns`` is its length."""
    own = staged(turns(conversations), "positions")
    first = F.sort_array(F.collect_list(F.struct("position", "digest", "words")))  # of HEADS - 1 turns at most
    heads = own.where(F.col("position") < HEADS).groupBy("conv_id").agg(first.alias("head")).withColumnRenamed("conv_id", "base")
    h = own_head(F.col("conv_id"))
    plans = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    none = F.array().cast("array<struct<position:long, digest:string, words:long>>")
    plans = plans.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), h.cast("int")), none))
    taken = F.size("head").cast("long")
    plans = staged(plans.withColumns({"taken": taken, "turns": taken + F.greatest(F.col("n") - h, F.lit(0))}), "plans")
    root = plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"), "turns")
    shared = plans.select("conv_id", "turns", F.explode("head").alias("t")).select("conv_id", F.col("t.position").alias("depth"), "t.digest", "t.words", "turns")
    rest = spread_join(own.where(F.col("position") > h), plans.select("conv_id", "n", "taken", "turns"), ["conv_id"])
    rest = rest.select("conv_id", (F.col("position") - h + F.col("taken")).alias("depth"), "digest", "words", "turns")
    return root.unionByName(shared).unionByName(rest)


def prefixes(rebuilt_turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, own_x, own_y, words, turns): the digest of each prefix, in two numbers, and what its last turn adds to it."""
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0))  # noqa: E731
    rows = staged(rebuilt_turns.withColumns({"own_x": hashed(1), "own_y": hashed(2)}).drop("digest"), "rebuilt")
    return running(rows, ["conv_id"], [F.col("depth")], {"x": xored(F.col("own_x")), "y": xored(F.col("own_y"))})


# --- digests of the members that end at a node -------------------------------------------


def ends(rows: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of nodes at which conversations end: their ids, comma-joined by rising number, are hashed piece by piece."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in NODE]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            starts = [0, *map(int, change)] if batch.num_rows else []
            ids = batch.column("conv_id").to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            at = pa.array(starts, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in NODE), batch.column("conv_id").take(at), pa.array(texts, pa.string())], names=[*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        row = lambda: pa.RecordBatch.from_pylist([{**dict(zip(NODE, key, strict=True)), "ends_sha256": held.hexdigest()}])  # noqa: E731
        for batch in batches:
            done, found = [], []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if own == key:
                    held.update(b",")
                else:
                    if held:
                        done.append(key)
                        found.append(held.hexdigest())
                    key, held = own, hashlib.sha256()
                held.update(ids.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in done], pa.int64()) for i in range(3)), pa.array(found, pa.string())], names=[*NODE, "ends_sha256"])
        if held:
            yield row()

    # Ranges part the members of a node that very many share; only their pieces meet.
    sorted_ids = rows.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    parts = sorted_ids.mapInArrow(pieces, "depth long, x long, y long, first long, ids string")
    return parts.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, x long, y long, ends_sha256 string")


# --- nodes, paths and messages -----------------------------------------------------------


def nodes(rows: DataFrame) -> DataFrame:
    """(depth, x, y, up_x, up_y, conv_id, n_convs, words, label, n_children, parent_label, parent_conv_id) of all nodes.

    A label is the least hash of a member's id: XXH64 maps different ids to different hashes.
    """
    up = lambda a: F.min(F.when(F.col("depth") > 0, F.col(a).bitwiseXOR(F.col(f"own_{a}")))).alias(f"up_{a}")  # noqa: E731
    own = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min(F.xxhash64("conv_id")).alias("label"), up("x"), up("y"))
    own = staged(own, "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")]
    children = own.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    own = staged(own.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    above = [F.col(c).alias(f"p_{c}") for c in NODE]
    parents = own.where("n_children > 0").select(*above, F.col("label").alias("parent_label"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = own.where("depth > 0").withColumns({"p_depth": F.col("depth") - 1, "p_x": F.col("up_x"), "p_y": F.col("up_y")})
    linked = spread_join(below, parents, ["p_depth", "p_x", "p_y"]).drop("p_depth", "p_x", "p_y")
    none = F.lit(None).cast("long")
    return linked.unionByName(own.where("depth = 0").withColumns({"parent_label": none, "parent_conv_id": none}))


def peeled(own: DataFrame) -> DataFrame:
    """(label, parent, at, leaves, saved) of all paths of the nodes ``own``: the totals of the subtree of its top, which hangs from ``parent`` at depth ``at``."""
    top = F.col("parent_label").isNotNull() & (F.col("parent_label") != F.col("label"))
    paths = own.groupBy("label").agg(
        F.max(F.when(top, F.col("parent_label"))).alias("parent"), F.max(F.when(top, F.col("depth") - 1)).alias("at"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )  # fmt: skip
    paths = staged(paths, "paths")
    waiting = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("remaining"))
    active = staged(paths.join(waiting, "label", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))), "waiting")
    finished = active.where("remaining = 0")
    while not active.where("remaining > 0").isEmpty():
        sent = active.where("remaining = 0").groupBy(F.col("parent").alias("label"))
        sent = sent.agg(F.count("*").alias("__n"), F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
        rest = active.where("remaining > 0").join(sent, "label", "left")
        less, more = F.coalesce("__n", F.lit(0)), {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in ("leaves", "saved")}
        active = staged(rest.withColumns({"remaining": F.col("remaining") - less, **more}).select(active.columns), "waiting")
        finished = finished.unionByName(active.where("remaining = 0"))
    return finished.drop("remaining")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the prefixes ``rows``, with the totals of their subtrees."""
    rows = staged(rows, "prefixes")
    own = staged(nodes(rows), "linked")
    totals = peeled(own).where("parent IS NOT NULL")
    hanging = totals.groupBy(F.col("parent").alias("label"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
    held = own.join(hanging, ["label", "depth"], "left").withColumns({
        "leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("__leaves", F.lit(0)),
        "saved": (F.col("n_convs") - 1) * F.col("words") + F.coalesce("__saved", F.lit(0)),
    })  # fmt: skip
    held = staged(held.drop("__leaves", "__saved"), "held")
    summed = running(held, ["label"], [F.col("depth").desc()], {"n_leaves": added(F.col("leaves")), "saved_tokens": added(F.col("saved"))})
    found = ends(rows.where(F.col("depth") == F.col("turns")))
    return summed.join(found, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(prefixes(rebuilt(table(spark, sf_dir, "conversations"))))


#: CRC-32 of a text of ASCII, by its definition: DuckDB has none.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
#: Each node's key is the digest of its turns' digests; a node's ancestors are the prefixes of its smallest member.
PREFIX_TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, x, g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % {GROUP} AS base, {CRC32.format("conv_id::VARCHAR")} % {HEADS} AS h FROM t GROUP BY conv_id
), k AS (
  SELECT c.*, coalesce(least(b.n, c.h), 0) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base
), own AS (
  SELECT k.conv_id, t.p AS d, t.x, t.g FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.h
  UNION ALL SELECT k.conv_id, k.k + t.p - k.h, t.x, t.g FROM k JOIN t ON t.conv_id = k.conv_id WHERE t.p > k.h
), pre AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS key, NULL AS up, 0::BIGINT AS words FROM k
  UNION ALL
  SELECT conv_id, d::BIGINT, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY d), ''), words FROM (
    SELECT conv_id, d, sha256(string_agg(g, ' ') OVER (PARTITION BY conv_id ORDER BY d)) AS key, len(regexp_extract_all(x, '[^ 	-]+'))::BIGINT AS words FROM own
  )
), node AS (
  SELECT key, d, min(conv_id) AS m, count(*)::BIGINT AS n, any_value(up) AS up, any_value(words) AS words FROM pre GROUP BY key, d
), children AS (
  SELECT up AS key, count(*)::BIGINT AS n_children FROM node WHERE d > 0 GROUP BY up
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN children USING (key)
), total AS (
  SELECT pre.key, sum((w.n_children = 0)::INT)::BIGINT AS n_leaves, sum((w.n - 1) * w.words)::BIGINT AS saved
  FROM full_node w JOIN pre ON pre.conv_id = w.m AND pre.d <= w.d GROUP BY pre.key
), last AS (
  SELECT conv_id, max(d) AS d FROM pre GROUP BY conv_id
), ending AS (
  SELECT key, sha256(string_agg(pre.conv_id::VARCHAR, ',' ORDER BY pre.conv_id)) AS e FROM pre JOIN last USING (conv_id, d) GROUP BY key
)
SELECT f.m AS conv_id, f.d AS depth, p.m AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM full_node f JOIN total USING (key) LEFT JOIN node p ON p.key = f.up LEFT JOIN ending ON ending.key = f.key
"""

"""Conversation prefix trie with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; it is known by its smallest member and its depth.
The nodes with one smallest member lie one below the other and form a chain; the chain hangs
from a node of another. A chain holds a counter of the chains still hanging from it. In each round the
chains whose counter is 0 are complete and send their totals to the node they hang from; the counters
fall, until only the root's chain finishes. So a long conversation without branches is one message,
and the rounds are as many as branchings are nested, never more than the longest conversation has
turns. What reaches the driver is the number of chains left.

Turns are ranked and sequences are hashed by running sums within blocks of a global sort, with the
sums of the blocks before added: a conversation with a third of all rows is spread over tasks. A
sequence's digest is the sum of 120-bit pieces of the SHA-256 of each position with its turn's
SHA-256. Texts are hashed where they are read and never shuffled. The member lists that
`ends_sha256` needs are packed into blobs in sorted blocks, and one task streams a node's blobs through
the hash, in constant memory.

Defined results: rows without a conv_id belong to no conversation; null and empty roles and texts are
the same; turns of equal number are ordered by the SHA-256 of role and text, and repeated
rows are turns each; other columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

#: Rows of one conversation that are joined under one key, and bytes of packed ids in a row.
BLOCK, BLOB = 1 << 16, 1 << 16
_WIDE = "decimal(38,0)"


def running(df: DataFrame, key: str, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """df with running sums (first row included) in the order within each key, and `last`, true on the key's last row.

    A range partitioning of (key, order) cuts large keys into blocks; sums run within a block and
    the totals of the key's blocks before it are added. Only keys that lie in several
    blocks have such totals: two rows a block at most.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(df.repartitionByRange(n, key, *order).withColumn("block", F.spark_partition_id()), name)
    local = W.partitionBy(key, "block").orderBy(*order)
    to_here = local.rowsBetween(W.unboundedPreceding, 0)
    here = blocks.withColumns({c: F.sum(x).over(to_here) for c, x in sums.items()} | {"__ends": F.lead(F.lit(False), 1, True).over(local)})
    totals = blocks.groupBy(key, "block").agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    cut = totals.groupBy(key).agg(F.count("*").alias("n"), F.max("block").alias("__final"), F.collect_list(F.struct("block", *sums)).alias("b")).filter("n > 1")  # rows: the blocks of a key
    before = cut.select(key, "__final", F.explode("b").alias("x"), "b")
    part = lambda c: F.aggregate(F.filter("b", lambda y: y["block"] < F.col("x.block")), F.lit(0).cast(_WIDE), lambda acc, y: (acc + y[c]).cast(_WIDE))
    before = before.select(key, F.col("x.block").alias("block"), "__final", *(part(c).alias(f"__{c}") for c in sums))
    joined = here.join(F.broadcast(before), [key, "block"], "left")  # two rows a block at most
    added = {c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0).cast(_WIDE))).cast(here.schema[c].dataType) for c in sums}
    last = F.col("__ends") & (F.col("__final").isNull() | (F.col("__final") == F.col("block")))
    return joined.withColumns(added | {"last": last}).drop("block", "__ends", "__final", *(f"__{c}" for c in sums))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, digest, chars, pos): turns ranked from 1 within their conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    one = F.lit(1).cast("long")
    return running(rows.filter("conv_id IS NOT NULL"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest").asc()], {"pos": one}, "turns").drop("last")


def shared_heads(conversation: Column) -> tuple[Column, Column]:
    """The conversation whose first turns a conversation takes, and how many."""
    return conversation - conversation % 100, F.crc32(conversation.cast("string").cast("binary")) % 6


def rebuilt(ranked: DataFrame, heads: Callable[[Column], tuple[Column, Column]] = shared_heads) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) of all rebuilt conversations, and (conv_id, length) of each.

    heads bounds its second column to a small number; conversations that share a head are told by
    the first.
    """
    base, h = heads(F.col("conv_id"))
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": base, "h": h})
    taken = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("in_base")), "base", "left")
    taken = taken.withColumn("head", F.least("h", F.coalesce("in_base", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(taken.select("conv_id", "base", "h", "head", "own", "length"), "conversations")
    most = convs.agg(F.max("head")).first()[0] or 0
    first = ranked.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    from_base = convs.filter("head > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("pos")).join(first, ["base", "pos"])
    # A conversation of many rows is joined under a key for each BLOCK of them.
    blocks = convs.select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK))).alias("salt"))
    own = ranked.withColumn("salt", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "salt"]).filter("pos > h")
    rows = from_base.select("conv_id", F.col("pos").alias("depth"), "digest", "chars").unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "digest", "chars"))
    return rows, convs.select("conv_id", "length")


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", depth, a, b)


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, key, parent, last) of every prefix: digests of it and of the one a turn shorter."""
    piece = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    part = lambda at: F.conv(F.substring(piece, at, 15), 16, 10).cast(_WIDE)
    pieces = rows.select("conv_id", "depth", "chars", part(1).alias("a"), part(16).alias("b"))
    sums = running(pieces, "conv_id", [F.col("depth").asc()], {"sum_a": F.col("a"), "sum_b": F.col("b")}, "prefixes")
    depth = F.col("depth")
    parent = F.when(depth > 1, _key(depth - 1, (F.col("sum_a") - F.col("a")).cast(_WIDE), (F.col("sum_b") - F.col("b")).cast(_WIDE)))
    return sums.select("conv_id", "depth", "chars", _key(depth, F.col("sum_a"), F.col("sum_b")).alias("key"), F.coalesce(parent, F.lit("root")).alias("parent"), "last")


def ends(finals: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the hash of each key's ids in ascending order, joined by commas."""
    n = int(finals.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size = None, None, [], 0
        blob = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "first": pa.array([first], pa.int64()), "blob": pa.array([b",".join(parts)], pa.binary())})
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or size >= BLOB:
                    if parts:
                        yield blob()
                    key, first, parts, size = k, c, [], 0
                parts.append(b"%d" % c)
                size += len(parts[-1]) + 1
        if parts:
            yield blob()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, blob in zip(batch.column("key").to_pylist(), batch.column("blob").to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(blob)
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.string()), "ends_sha256": pa.array([d for _, d in out], pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    blobs = finals.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(packed, "key string, first long, blob binary")
    return blobs.repartition(n, "key").sortWithinPartitions("key", "first").drop("first").mapInArrow(hashed, "key string, ends_sha256 string")


def peeled(chains: DataFrame) -> DataFrame:
    """(conv_id, parent_conv_id, at, saved, leaves) of (conv_id, parent_conv_id, at, saved, leaves): totals of chains with all that hangs from them.

    at: depth of the node that a chain hangs from; the root's chain has null parent_conv_id.
    """
    counters = chains.filter("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("waits"))
    waiting = materialize(chains.join(counters, "conv_id", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))), "chains")
    done = []
    while True:
        ready = waiting.filter("waits = 0").drop("waits")
        done.append(ready)
        messages = ready.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("sent"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        rest = waiting.filter("waits > 0")
        got = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        left = rest.join(messages, "conv_id", "left").select("conv_id", "parent_conv_id", "at", (F.col("saved") + got("more_saved")).alias("saved"), (F.col("leaves") + got("more_leaves")).alias("leaves"), (F.col("waits") - got("sent")).alias("waits"))
        waiting = materialize(left, "chains")
        if waiting.isEmpty():
            break
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, depth, digest, chars); convs (conv_id, length) has those without turns too."""
    prefixes = materialize(paths(rows), "paths")
    depth0 = convs.agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit("root").alias("key"), F.lit(None).cast("string").alias("parent"))
    deeper = prefixes.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("parent").alias("parent"))
    children = deeper.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = depth0.filter("n_convs > 0").unionByName(deeper).join(children, "key", "left")
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # Of each chain's top node only, as all others have a parent of the same conv_id.
    tops = nodes.groupBy("conv_id").agg(F.min_by("parent", "depth").alias("parent"), F.min("depth").alias("top"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    tops = tops.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    chains = materialize(tops.select("conv_id", "parent_conv_id", (F.col("top") - 1).alias("at"), "saved", "leaves"), "tops")
    hung = peeled(chains).filter("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    got = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"own_saved": (F.col("n_convs") - 1) * F.col("chars") + got("hung_saved"), "own_leaves": (F.col("n_children") == 0).cast("long") + got("hung_leaves")})
    # From the bottom of each chain upwards.
    own = own.select("conv_id", "depth", "n_convs", "n_children", "key", "own_saved", "own_leaves")
    sums = running(own, "conv_id", [F.col("depth").desc()], {"saved_tokens": F.col("own_saved"), "n_leaves": F.col("own_leaves")}, "subtrees").drop("last")
    finals = prefixes.filter("last").select("key", "conv_id").unionByName(convs.filter("length = 0").select(F.lit("root").alias("key"), "conv_id"))
    above = chains.select("conv_id", "parent_conv_id", (F.col("at") + 1).alias("depth"))
    out = sums.join(ends(finals), "key", "left").join(above.withColumn("is_top", F.lit(True)), ["conv_id", "depth"], "left")
    parent = F.when(F.col("is_top"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return prefix_trie(*rebuilt(materialize(turns(table(spark, sf_dir, "conversations")), "ranked")))

"""Tables in the cluster's shared folder, and connected components on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, scratch, shared_dir  # noqa: F401  (the operators take them from here)
from . import kernels as K


BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands rows to Python in batches of about ``BATCH_BYTES``.  By default 10,000 texts, or 64 MB of
    them, stand in the executor's JVM and in its Python worker at once.  A limit that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT) == "67108864b":  # the default, as Spark words it
        conf.set(_BATCH_LIMIT, BATCH_BYTES)
    return df


def dealt(df: DataFrame, key: str | Column, size: int, each: int = 64 << 20) -> DataFrame:
    """``df`` dealt out by ``key``: to as many partitions as the session asks for, or more if ``size`` bytes would
    otherwise put over ``each`` into one task."""
    usual, wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each)
    return df.repartition(wanted, key) if wanted > usual else df.repartition(key)


def crowd_of(big: DataFrame, key: str, least: int = 1000) -> list[tuple]:
    """``(key, shares)`` of the keys with more than a thousandth of the rows of ``big`` (and more than ``least``): fewer than 1,000."""
    counts = big.groupBy(key).agg(F.count("*").alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    bound = max(least, (total or 0) // 1000)
    return [(r[0], -(-r[1] // bound)) for r in counts.where(F.col("_n") > bound).collect()] if (most or 0) > bound else []


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "inner", least: int = 1000, crowd: list[tuple] | None = None) -> DataFrame:
    """``big`` joined with ``small`` by ``key``, where keys with more than a thousandth of the rows of ``big`` (and
    more than ``least``) are dealt out in shares, each with its own copy of their rows of ``small``.

    Fewer than a thousand keys can hold so many, so the table of them is broadcast (``crowd_of`` gives it for several
    joins).  ``big`` is read twice and should be a written table; a null key is dealt out like any other.
    """
    crowd = crowd_of(big, key, least) if crowd is None else crowd
    if not crowd:
        return big.join(small, key, how)
    crowd = F.broadcast(big.sparkSession.createDataFrame(crowd, f"_hot {big.schema[key].dataType.simpleString()}, _shares long"))
    row = F.xxhash64(*[F.col(c) for c in big.columns])
    many = big.join(crowd, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_share", F.pmod(row, F.coalesce("_shares", F.lit(1).cast("long")))).drop("_hot", "_shares")
    few = small.join(crowd, F.col(key) == F.col("_hot"), "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1).cast("long")) - 1))).drop("_hot", "_shares")
    return many.join(few, [key, "_share"], how).drop("_share")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _forest(batches):
    """Edges of a task's lots to edges that join the same nodes: each node with the smallest that its lot connects it to."""
    buffer = K.Buffer(2)
    for batch in batches:
        if buffer.add(K.ints(batch, "u"), K.ints(batch, "v")):
            yield _stars(*buffer.take())
    if (rest := buffer.take()) is not None:
        yield _stars(*rest)


def _stars(u: np.ndarray, v: np.ndarray):
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root[a] == root[b]).all():
            break
    moved = root < np.arange(len(nodes))
    return K.table(_EDGE, nodes[moved], nodes[root[moved]])


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph (columns ``a`` and ``b``, long) with the
    smallest node that can be reached: columns ``node`` and ``component``.

    Each task first replaces its edges by those of a forest.  Then two contractions alternate until every edge leads from a node to its label:
    every node hands its neighbours
    that are larger than itself to the smallest neighbour (large star), then hands all
    its smaller neighbours to the smallest of them (small star).  Both are one grouped
    minimum and one join on the node, in which nodes with very many edges are dealt out; the number of edges never grows, and the rounds
    grow with the logarithm of the graph; labels only ever fall, so they end.  Self-loops and repeated edges are harmless;
    null ends are ignored; no edges give an empty table.
    """
    found = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialise(found.mapInArrow(K.lean(_forest), "u long, v long").distinct(), "edges")
    while True:
        # done once no node hangs on two others, nor on one that hangs itself
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(now.select("v", F.lit(0), F.lit(1)))
        if not roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below + above > 1").limit(1).count():
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(join_hot(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialise(small.mapInArrow(K.lean(_forest), "u long, v long").distinct(), "edges")
        discard(now)
        discard(large)
        now = after
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.union(now.select("v", "v").distinct())


def texts(docs: DataFrame, carry=()) -> DataFrame:
    """``doc_id`` (long), ``text`` and the columns ``carry``.  A doc_id that is a long already stays the very column:
    plans that differ by an alias do not share an exchange."""
    own = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    return in_small_batches(docs).select("doc_id" if own else F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)


def own_places(docs: DataFrame, carry=()) -> tuple[DataFrame, int]:
    """``doc_id, text`` and ``carry`` of the rows with a doc_id, and the bytes of all texts.  If one doc_id has several texts, the
    rows get new numbers as ``doc_id``, in the order of doc_id and then of a hash of the text, and the given
    one as ``_given``.  So a doc_id of the result is one text, however often it repeats.
    """
    rows = texts(docs, carry).where("doc_id is not null")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    each = rows.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"), F.sum(F.octet_length("text")).alias("size"))
    found = each.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("lo") != F.col("hi"))).first()
    if not found[1]:
        return rows, int(found[0])
    marked = rows.withColumn("_digest", digest)
    ordered = marked.select("doc_id", "_digest").distinct().repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    numbers = materialise(ordered.withColumn("_number", F.monotonically_increasing_id()), "numbers")
    named = marked.join(numbers, ["doc_id", "_digest"]).select(F.col("_number").alias("doc_id"), "text", *carry, F.col("doc_id").alias("_given"))
    return materialise(named, "numbered"), int(found[0])


def dealt_texts(docs: DataFrame, carry=()) -> DataFrame:
    """Texts with a doc_id, dealt out by it: joins on doc_id that read the same columns of it
    use one exchange."""
    return texts(docs, carry).where("doc_id is not null").repartition("doc_id")

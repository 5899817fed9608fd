"""Connected components over a table of pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; a temporary one only where none is configured and everything runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """df written once under the checkpoint folder and read back: its lineage is cut, and later steps read only columns that they name."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that one task holds at once; so many are settled by a single task.
TASK_EDGES = 500_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the edges at hand, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (further := parent[parent])).any():
            parent = further
    rest = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[rest], nodes[parent[rest]]


def _contract(edges: DataFrame) -> DataFrame:
    """The forest of every task's edges in place of the edges: same components, at most one edge a node and task.

    A task holds TASK_EDGES edges at once; where their forest is not much smaller, it is sent and the next one begun.
    """
    most = TASK_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def forest() -> list[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            if pa.types.is_integer(whole.schema[0].type):
                found = [pa.array(v, type=f.type) for v, f in zip(contracted(*(c.to_numpy() for c in whole.columns)), whole.schema, strict=True)]
            else:
                # names are sorted once, each by itself, and stand for their places from then on
                every = pa.chunked_array([chunk for c in whole.columns for chunk in c.chunks])
                names = every.unique()
                names = names.take(pc.sort_indices(names))
                places = pc.index_in(every, names).to_numpy()
                found = [names.take(pa.array(v)) for v in contracted(places[: len(whole)], places[len(whole) :])]
            return [pa.RecordBatch.from_arrays([v.slice(at, 100_000) for v in found], schema=whole.schema) for at in range(0, len(found[0]), 100_000)]

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) > most:
                held = forest()
                if sum(h.num_rows for h in held) > most // 2:
                    yield from held
                    held = []
        if held:
            yield from forest()

    return edges.mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame, turn: int) -> DataFrame:
    """node, top: nodes hung on the first of their neighbours and themselves, and the smallest node of those that hang together.

    First in an order that is shuffled for each turn, so that long chains fall apart as well, whatever their names.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))

    def place(c: str) -> Column:
        return F.xxhash64(c, F.lit(turn))

    first = both.groupBy("node").agg(F.min_by("other", place("other")).alias("other"), F.min(place("other")).alias("place"))
    hung = first.select("node", F.when(F.col("place") < place("node"), F.col("other")).otherwise(F.col("node")).alias("up"))
    return hung.select("node", F.min("node").over(Window.partitionBy("up")).alias("top"))


def _small_star(edges: DataFrame, hung: DataFrame) -> DataFrame:
    """The edges between those that hang together, under the names of their smallest nodes."""
    x, y = hung.select(F.col("node").alias("a"), F.col("top").alias("x")), hung.select(F.col("node").alias("b"), F.col("top").alias("y"))
    moved = edges.join(x, "a").join(y, "b").filter("x <> y")
    return _contract(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def star_forest(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of pairs that is not its own component's smallest node.

    Tasks first contract what they hold. While more than TASK_EDGES edges are left, nodes hang on neighbours and each
    set of those that hang together becomes one node, so that later rounds have fewer edges; one task settles
    the rest. Then names go back down, round by round. Every round is written, and each node is in one row of it.
    """
    x, y = F.col(a), F.col(b)
    edges = pairs.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    # before anything is written: pairs repeat, and most of a task's own close circles
    edges = settled(_contract(edges))
    n = edges.count()
    if n > TASK_EDGES:
        # stars around the smallest item of each component need no rounds
        one = settled(edges.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("last")))
        if one.filter("b <> last").isEmpty() and one.join(one.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return one.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rounds: list[DataFrame] = []
    while n > TASK_EDGES:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
        rounds.append(settled(_large_star(edges, len(rounds))))
        edges = settled(_small_star(edges, rounds[-1]))
        n = edges.count()
    found = _contract(edges.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))
    for hung in reversed(rounds):
        above = found.select(F.col("node").alias("top"), "component")
        found = hung.join(above, "top", "left").select("node", F.coalesce("component", "top").alias("component")).filter("node <> component")
    return settled(found)


def placed_components(items: DataFrame, pairs: DataFrame, item: str, order: str, a: str = "a", b: str = "b") -> DataFrame:
    """(item, component, ord): as connected_components, with the place of each item's first row."""
    known = items.select(F.col(item).alias("node")).distinct()
    kept = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    forest = star_forest(kept)
    rows = settled(items.groupBy(F.col(item).alias("node")).agg(F.min(order).alias("ord")).join(forest, "node", "left").select("node", "ord", F.coalesce("component", "node").alias("root")))
    first = rows.groupBy("root").agg(F.min("ord").alias("ord"))
    return rows.join(numbered(first, "ord", "component").drop("ord"), "root").select(F.col("node").alias(item), "component", "ord")


def connected_components(items: DataFrame, pairs: DataFrame, item: str, order: str, a: str = "a", b: str = "b") -> DataFrame:
    """(item, component): components over the given items, numbered from 0 by first appearance in the order column.

    Pairs with an unknown item are ignored; an item of several rows comes once, at its first place.
    """
    return placed_components(items, pairs, item, order, a, b).select(item, "component")


def numbered(rows: DataFrame, order: str | Sequence[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 in the given order, without one task that holds all rows.

    Range-partitions by the order, numbers inside each partition, and adds the sizes of the
    partitions before it: one row per partition, which the driver never sees.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [order] if isinstance(order, str) else list(order)
    # the partition of each row must not change between its two uses
    parted = settled(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()))
    sizes = parted.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("skip", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "skip")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return parted.join(F.broadcast(before), "part").withColumn(name, F.col("skip") + inside - 1).drop("part", "skip")

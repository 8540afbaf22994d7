"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, least_tasks, scratch_path

#: Rounds after which something must be wrong: labels halve their distance each round.
MOST_ROUNDS = 60
#: Edges that a task of a round should get; a small graph does not pay for every shuffle partition.
EDGES_PER_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable; edges are (a, b), nodes longs.

    Large-star, small-star: each round links every node to the least node of its
    neighbourhood, in two steps that keep components and shrink the graph.  All
    steps are aggregates and joins by node, and a node's neighbours are never
    gathered.  Every round is written to the shared folder, so no round depends
    on an earlier one.  Loops and repeated edges do no harm; an empty table
    gives none; rows with a null end are no edges.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    tasks = least_tasks(spark)

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "edges"))
        df.coalesce(tasks).write.parquet(paths[-1])
        if len(paths) > 2:
            delete_path(spark, paths.pop(0))
        return spark.read.schema("a long, b long").parquet(paths[-1])

    def starred(pairs: DataFrame) -> DataFrame:
        """Each node and each neighbour not below it, to the least of the node and its neighbours."""
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        return pairs.join(least, "a").coalesce(tasks)

    # from larger to smaller node
    graph = kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    tasks = max(tasks, graph.count() // EDGES_PER_TASK)
    before = None
    for _ in range(MOST_ROUNDS):
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = starred(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks)
        small = starred(large)
        graph = kept(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # settled once a round changes nothing: every node then points at its least node
        now = graph.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(graph.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

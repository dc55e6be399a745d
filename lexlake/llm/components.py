"""Connected components of a graph that lies in tables: contraction with random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import small_or_plain
from lexlake.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); nodes of one component share their root.

    Each round maps every node to the one of its closed neighbourhood with the least hash of that round and
    contracts the edges, so the graph shrinks by a share that is expected to be constant, whatever its shape; the
    mappings are then followed back. Every round is written to the shared folder. Least hashes
    combine before the shuffle, so a node with very many neighbours sends one row per task.
    """
    rest = written(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    mappings: list[DataFrame] = []
    while not rest.isEmpty():
        turn = len(mappings)
        both = rest.select("u", "v").union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ranked = F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v")))
        own = F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), F.col("u").alias("v"))
        chosen = written(
            both.groupBy("u").agg(ranked.alias("best")).select(F.col("u").alias("node"), F.least("best", own)["v"].alias("to")),
            "nodes",
        )
        side = small_or_plain(chosen, chosen.count())
        moved = (
            rest.join(side.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
            .join(side.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        )
        rest = written(moved.where("u <> v").distinct(), "edges")
        mappings.append(side)
    spark = edges.sparkSession
    if not mappings:
        return spark.createDataFrame([], "node long, root long")
    roots = mappings[-1].select("node", F.col("to").alias("root"))
    for mapping in reversed(mappings[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = mapping.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots

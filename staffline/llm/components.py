"""Connected components of a table of links, by alternating large and small stars.

Each round rewires every node to the smallest node it knows of; the number of rounds
grows with the logarithm of the longest chain. Every round is written to the shared
folder, so that no lineage piles up, and a node with very many links costs an
aggregation with partial sums and a join that Spark may split, never one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.session import released, staged


def _rewired(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b. Large star: of each node, the neighbours beyond it are linked
    to its smallest neighbour. Small star: the same with the neighbours below it."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = sides.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        out = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links``: columns ``a``, ``b`` (long), any order, repeats and loops allowed. Returns
    ``node``, ``root`` for every node with a link to another; root is the smallest node
    of its component. Rows with a null end are left out."""
    edges = staged(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        turned = staged(_rewired(_rewired(edges, large=True), large=False))
        released(edges)
        edges, last, mark = turned, mark, _mark(turned)
        if mark == last and mark[0] == mark[2]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

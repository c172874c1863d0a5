"""Connected components of a table of links by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.session import cut_lineage


def _towards_least(links: DataFrame, strictly_larger: bool) -> DataFrame:
    """Links (a, b), each node's least neighbour or itself as new centre ``b`` of its neighbours on one side.

    Minima are combined before the exchange and joined back, so no neighbourhood is gathered in one row or task.
    """
    least = links.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    joined = links.join(least, "a")
    if strictly_larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.where("b <= a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.where("least < a").select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: bigint); the root is the least node of the component.

    Rounds grow with the logarithm of the longest path.  Links of a node to itself and repeated links change nothing;
    null ends are left out; no links give an empty table.
    """
    current = cut_lineage(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_least(both, strictly_larger=True)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        current = cut_lineage(_towards_least(down, strictly_larger=False), "links")
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark

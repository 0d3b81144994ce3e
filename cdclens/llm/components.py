"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdclens.llm import _store as S


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): each linked node and the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) turn the links into stars around each
    component's smallest node in about log(n) rounds of two aggregations and two joins; the link count never grows.
    A node with very many links is a minimum, which partial aggregation folds, and a join key.  The minima, at most one for each end of a link, are
    broadcast while links are few; when they are many, the minima are written before they are joined, so that the join may split a key's rows.
    Rounds are tables in the shared folder, each removed when the next is there, and end as soon as all links are stars.  Nothing is gathered on the driver but two counts.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = S.table(e, "step")
    count, loose = _shape(e)
    for _ in range(rounds):
        if not loose:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u link to the smallest of u and its neighbours
        few = 2 * count <= S.MAX_BROADCAST
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        low = F.broadcast(low) if few else S.table(low, "step")
        large = both.join(low, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = S.table(large, "step")  # a row at most for each link, so what is there twice is left to the small star's distinct
        S.discard(low)
        # small star: the smaller neighbours of u, and u, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        low = low if few else S.table(low, "step")
        joined = large.join(F.broadcast(low) if few else low, F.col("u") == F.col("c"))
        small = S.table(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "step")
        S.discard(low, large, e)
        e = small
        count, loose = _shape(e)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _shape(e: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes keep them from being stars around their smallest nodes: such as link to several, or to one and are linked to."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, loose = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return count or 0, loose

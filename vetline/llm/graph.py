"""Connected components of a link table that no single task could hold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.runtime import settle


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, least): each link beside the smallest of u and all its neighbours."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return links.join(least, "u")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Large-star and small-star rounds: each node hands its smallest neighbour to the
    others, until nothing changes. A round is two aggregations and two joins on the
    node; the links of a hub are never gathered in one place (its minimum is combined
    before the shuffle, and the adaptive join splits its rows). Each round's links
    go to the shared folder. Self-links and repeated links do no harm, links with a
    null end are left out, an empty table gives an empty result.
    """
    links = settle(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u <> v").distinct()
        )
        starred = _with_least(large)
        small = starred.select("v", "least").unionByName(starred.select(F.col("u").alias("v"), "least"))
        links = settle(
            small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        )
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

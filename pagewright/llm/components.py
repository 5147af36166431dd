"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, met, superseded


def components(links: DataFrame, a: str, b: str, hot: int | None = None) -> DataFrame:
    """Rows (node, root) for every node that has a link; root is the component's least node.

    Alternates the large-star and small-star steps until the links no longer
    change, which takes a number of rounds logarithmic in the longest chain. A
    round keeps at most as many links as it was given. Minima are taken by
    ``groupBy`` (combined before the shuffle) and met again by ``_shared.met``: the
    links of a hub, a node of more than ``hot`` links, meet a broadcast of the hubs'
    minima where they are, and are never gathered in one task. Nulls and self-links
    are ignored.
    """
    u, v = F.col(a), F.col(b)
    links = links.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi <> lo and hi is not null and lo is not null").distinct()
    links = materialise(links, "links")
    seen = None
    while (state := _state(links)) != seen and state[0]:
        seen = state
        wide = materialise(_large_star(links, hot), "links")
        superseded(links)
        links = materialise(_small_star(wide, hot), "links")
        superseded(wide)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame, hot: int | None) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    return met(both, least, "u", "n", hot).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(links: DataFrame, hot: int | None) -> DataFrame:
    least = materialise(links.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")
    moved = met(links, least, "hi", "n", hot).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()

"""Link graph: edges, degrees, neighbours, boosts, and the checks that are anti-joins on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def href_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst): the page's URL path and the paths its ``href``s name."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1)
    links = F.regexp_extract_all("html", F.lit(r'href="([^"#]+)"'), F.lit(1))
    return pages.select(path.alias("src"), F.explode(links).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("out_degree").alias("n_edges"), F.round(F.avg("out_degree"), 4).alias("mean_degree"))


def most_connected(edges: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pages of most links out."""
    return degrees(edges).orderBy(F.desc("out_degree"), "src").limit(n)


def neighbour_boost(edges: DataFrame, seeds: DataFrame, weight: float = 0.15) -> DataFrame:
    """Each seed gives weight / (1 + 0.2 position) to its targets, positions by target; summed."""
    pos = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    return (
        edges.join(seeds, "src", "left_semi").withColumn("pos", pos)
        .groupBy("dst").agg(F.round(F.sum(weight / (1 + 0.2 * F.col("pos"))), 4).alias("boost"))
    )


def missing_backlinks(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges (src, dst) a -> b without b -> a, self-loops left out. Both ways of a pair meet in one group, so nothing is joined or sorted."""
    up, down = F.max(F.col(src) < F.col(dst)).alias("up"), F.max(F.col(src) > F.col(dst)).alias("down")
    pairs = edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("low"), F.greatest(src, dst).alias("high")).agg(up, down).where("up <> down")
    return pairs.select(F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias(src), F.when(F.col("up"), F.col("high")).otherwise(F.col("low")).alias(dst))


def unresolved(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose dst is no known target."""
    return edges.join(targets.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti")

"""Connected components of a large graph by repeated contraction; nothing but a count comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stored


def contract(links: DataFrame) -> list[DataFrame]:
    """The maps (id, rep) of each round, until no link is left.

    In a round every vertex takes the vertex of highest priority among its neighbours and itself as its
    representative; links then join representatives. Priorities are drawn anew each round, so whatever
    the graph and the numbering of its vertices, a round removes an expected constant share of the
    vertices that still have links (randomised contraction), and rounds are logarithmic in their number. Every
    other round puts vertices of high degree first, which ends stars at once and never adds vertices.
    In any round the vertex of lowest priority goes, so no cap on the rounds is needed.
    """
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now = stored(now, "edges")
    maps: list[DataFrame] = []
    while now.limit(1).count():
        both = now.union(now.select("b", "a"))
        draw = F.xxhash64("b", F.lit(len(maps)))
        if len(maps) % 2 == 0:
            degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
            low = F.lit((1 << 32) - 1)
            far = degree.select(F.col("a").alias("_v"), "degree")
            both = both.join(far, F.col("b") == F.col("_v")).select("a", "b", (F.col("degree") * (1 << 32) + draw.bitwiseAND(low)).alias("p"))
            own = degree.select("a", F.col("a").alias("b"), "degree")
            own = own.select("a", "b", (F.col("degree") * (1 << 32) + draw.bitwiseAND(low)).alias("p"))
        else:
            own = both.select("a").distinct().select("a", F.col("a").alias("b"))
            both, own = (x.select("a", "b", draw.alias("p")) for x in (both, own))
        rep = stored(both.union(own).groupBy("a").agg(F.max_by("b", "p").alias("rep")).withColumnRenamed("a", "id"), "reps")
        maps.append(rep)
        one, two = (rep.select(F.col("id").alias(f"_{x}"), F.col("rep").alias(f"r{x}")) for x in "ab")
        moved = now.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
        moved = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        now = stored(moved, "edges")
    return maps


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``links`` (a, b): comp is the smallest id that can be reached.

    The rounds' maps are joined from the last back to the first; each is smaller than the one before
    it. Links from a vertex to itself count for nothing.
    """
    maps = contract(links)
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("a").alias("comp")).where("false")
    root = maps[-1]
    for rep in reversed(maps[:-1]):
        further = root.select(F.col("id").alias("_v"), F.col("rep").alias("_r"))
        root = rep.join(further, F.col("rep") == F.col("_v"), "left").select("id", F.coalesce("_r", "rep").alias("rep"))
    root = stored(root, "roots") if len(maps) > 1 else root
    low = root.groupBy("rep").agg(F.min("id").alias("comp")).withColumnRenamed("rep", "_rep")
    return stored(root.join(low, F.col("rep") == F.col("_rep")).select("id", "comp"), "components")

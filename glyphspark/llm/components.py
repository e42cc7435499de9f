"""Connected components of an edge table by alternating large and small stars.

Each round rewrites the edges with joins and minima and stores them, so nothing is gathered on the
driver or in one task and a lost executor costs one round at most. Ends when a round changes nothing;
the number of rounds grows with the logarithm of the longest path.

Rows with a null end, loops and repeated edges add nothing; the order of an edge's ends does not matter.
An empty table gives an empty one. Columns other than u and v are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored

#: Edges of a file, about.
_FILE_ROWS = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of all nodes of ``edges`` (u, v: long)."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", cores)
    seen = None
    while True:
        n, state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, state) == seen:
            break
        seen, files = (n, state), max(cores, n // _FILE_ROWS)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges", files)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", files)
        discard(large, now)
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a join and an aggregate over links; no group, component or label table is gathered
in a task or the driver. Rounds grow with the logarithm of the longest chain. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.storage import Staging


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(node, root) of every linked node, ``root`` being the smallest node of its component.
    ``links`` has two long columns; direction, order, repeats and self-links do not matter."""
    a, b = (F.col(c) for c in links.columns)
    e = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staging.write(e, f"{name}_0")
    n = 0
    # a star forest has no node that is both a leaf and a centre
    while not e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
        n += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.write(large, f"{name}_{n}l")
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centre.select("u", F.col("m").alias("v")))
        e = staging.write(small.distinct(), f"{name}_{n}")
        staging.drop(f"{name}_{n}l")  # only the last round is read again
        staging.drop(f"{name}_{n - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

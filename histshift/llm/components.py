"""Connected components of a link table, with alternating large-star and small-star steps.

Each step is a grouped minimum and a join: a node with a third of all links is combined before
the shuffle, and the minima are written before they are joined, so that both sides of the join
are plain shuffles, in which AQE splits a hot node (beside an aggregate it could not). No
component is ever gathered. Each round's links are written to the shared folder: the plan stays
short and a lost executor restarts from the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.common import write_table


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (columns a, b): the smallest id reachable.

    Null ends and self-links are ignored; repeated links and an empty table are fine.
    """
    e = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        least = write_table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = write_table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct(), "large")
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = write_table(small, "links")
        before, state = state, _state(e)
        if state == before:
            break
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()))

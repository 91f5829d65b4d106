"""Connected components of a table of links, by the smallest id that can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.session import durable


#: Links of a task; fewer links than that for each core take a task a core.
LINKS_PER_TASK = 200_000


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id of its component) of every id in ``links`` (``a``, ``b``).

    In each round every id takes the least component among its own and its neighbours',
    and then that of the id it points to, so that chains halve.  Hot ids
    are summed up before the shuffle in the grouping, and split by Spark in
    the joins.  Links may repeat and may join an id with itself.  The tables of a round
    have as many parts as the links need, not as many as the session shuffles to: the
    driver remembers each task, and there are many rounds.
    """
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-both.count() // LINKS_PER_TASK))
    both = both.coalesce(tasks)
    now = durable(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("component")).coalesce(tasks))
    while True:
        own = now.select("id", "component", F.col("component").alias("old"))
        told = both.join(now.select(F.col("id").alias("b"), "component"), "b").select(
            F.col("a").alias("id"), "component", F.lit(None).cast(own.schema["old"].dataType).alias("old"))
        nearer = told.unionByName(own).groupBy("id").agg(F.max("old").alias("old"), F.min("component").alias("component"))
        up = now.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = durable(nearer.join(up, "component").select("id", "old", F.least("component", "above").alias("component")).coalesce(tasks))
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        now = new.select("id", "component")
        if not changed:
            return now

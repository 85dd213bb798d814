"""Step-by-step search: a driver loop of at most a few jobs, with the judgements handed in as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.graph import neighbours
from loomgraph.plans.session import cut

#: Most frontier nodes per question, steps, and neighbours picked per step.
FRONTIER, STEPS, PICK = 40, 3, 5


def first_picks(candidates: DataFrame, pick: int = PICK) -> DataFrame:
    """The stand-in for a model's choice: the first ``pick`` of each question by id."""
    return candidates.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("id"))).where(F.col("n") <= pick).select("q", "id")


def explore(start: DataFrame, edges: DataFrame, enough: Callable[[DataFrame], DataFrame], pick: Callable[[DataFrame], DataFrame] = first_picks, steps: int = STEPS) -> DataFrame:
    """start(q, id): (q, id, step) of all visited nodes.

    After each step ``enough`` names the questions (q) whose visited nodes suffice; they stop. The others go on to the
    neighbours that ``pick`` chooses among those not yet visited. ``first_picks`` takes the first by id, and no more than a
    question has visited can come before these, so of a node's neighbours only the first by id are moved, however many it has.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    front, n = cut(first_picks(start.select("q", "id").distinct(), FRONTIER))
    seen = front.withColumn("step", F.lit(0))
    for step in range(1, steps + 1):
        if not n:
            break
        open_ = front.join(enough(seen), "q", "left_anti")
        if pick is first_picks:
            known = both.join(open_.select("id").distinct(), "id", "left_semi").distinct()
            n_th = F.row_number().over(Window.partitionBy("id").orderBy("to"))
            few = known.withColumn("n", n_th).where(F.col("n") <= FRONTIER + PICK * step)
            near = open_.join(few, "id").select("q", F.col("to").alias("id")).distinct()
        else:
            near = neighbours(open_, edges, "both").select("q", F.col("neighbour").alias("id")).distinct()
        near = near.join(seen.select("q", "id"), ["q", "id"], "left_anti")
        front, n = cut(pick(near))
        seen = seen.unionByName(front.withColumn("step", F.lit(step)))
    return seen

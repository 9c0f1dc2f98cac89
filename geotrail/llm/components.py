"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.shared import forget, written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root): the least id that edges (a, b) join with each id; every id of an edge has a row.

    Least labels spread along edges and then jump to their label's label, so rounds grow with the
    logarithm of a component's diameter.  A hub is aggregated before it is shuffled.  A round's table goes when
    the next one is written.

    Defined cases: edges with a null end and loops are left out; repeated edges count once; without edges the
    result is empty; what hasn't settled after ``most`` rounds raises an error instead of returning wrong roots.
    """
    one = edges.filter("a <> b").select("a", "b")
    both = written(one.union(one.select("b", "a")).distinct())
    state, old = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), None
    for _ in range(most):
        new = written(_jump(_spread(both, state)))
        if old is not None:
            forget(old)
        state, old = new.select("id", "root"), new
        if not new.filter("root <> old").limit(1).count():
            forget(both)
            return state
    raise RuntimeError("components did not settle")


def _spread(both: DataFrame, state: DataFrame) -> DataFrame:
    """(id, old, root): the least root among an id and its neighbours."""
    heard = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
    return state.join(heard, "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))


def _jump(told: DataFrame) -> DataFrame:
    """Each root replaced by its own new root."""
    jump = told.select(F.col("id").alias("root"), F.col("root").alias("next"))
    return told.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("next", "root")).alias("root"))

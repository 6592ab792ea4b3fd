"""Verdicts that hang on earlier verdicts, settled by pointer doubling.

A step either has a verdict, or follows another step's: ``yes`` if that one is accepted, ``no`` if
not, or waits for more than one.  Chains of any length are settled in a number of rounds that is
logarithmic in the chain; each round is one join of a stored table with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invigil.session import stage


def settle(steps: DataFrame) -> DataFrame:
    """``steps(id, parent, yes, no, waits)``, ids unique, every parent among them: ``(id, accepted)``.

    Without a parent ``yes`` is the verdict.  Steps that wait, and all that hang on them, are left out.
    """
    steps = stage(steps.select("id", "parent", "yes", "no", "waits"), "steps")
    while steps.where(~F.col("waits") & F.col("parent").isNotNull()).take(1):
        above = steps.select(*[F.col(c).alias(f"_{c}") for c in steps.columns])
        known = F.col("_id").isNotNull()
        pick = lambda verdict: F.when(verdict, F.col("yes")).otherwise(F.col("no"))
        # Steps without a parent stay where they are: their NULLs would all meet in one task.
        hanging, settled = steps.where(F.col("parent").isNotNull()), steps.where(F.col("parent").isNull())
        joined = hanging.join(above, F.col("parent") == F.col("_id"), "left")
        moved = joined.select(
            "id",
            F.when(known, F.col("_parent")).alias("parent"),
            F.when(known, pick(F.col("_yes"))).otherwise(F.col("yes")).alias("yes"),
            F.when(known, pick(F.col("_no"))).otherwise(F.col("no")).alias("no"),
            (F.col("waits") | F.coalesce("_waits", F.lit(False))).alias("waits"),
        )
        steps = stage(moved.unionByName(settled), "steps")
    return steps.where(~F.col("waits")).select("id", F.col("yes").alias("accepted"))

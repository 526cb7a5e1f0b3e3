"""Audio projects: which cue names a wave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_writer_names(used: DataFrame, wave: Sequence[str], cue: Sequence[str], order: Sequence[str], cue_name: Column, several: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One row per wave with its cue, `keep`, and `name`: the first cue in the order of (cue, order) names it.

    A cue of several sounds puts a number behind its name that counts the waves it has named. The first of each wave is found in
    one aggregation that has a partial stage; columns of `keep` come from the row that names it.
    """
    first = used.groupBy(*wave).agg(F.min(F.struct(*cue, *order, several.alias("_several"), *[F.col(k).alias(f"_{k}") for k in keep])).alias("_f"))
    first = first.select(*wave, *[F.col("_f")[c].alias(c) for c in [*cue, *order]], F.col("_f._several").alias("_several"), *[F.col("_f")[f"_{k}"].alias(k) for k in keep])
    number = F.row_number().over(Window.partitionBy(*cue).orderBy(*order, *wave)) - 1
    return first.withColumn("name", F.concat(cue_name, F.when(F.col("_several"), F.concat(F.lit("_"), number.cast("string"))).otherwise(""))).drop("_several")

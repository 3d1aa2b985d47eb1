"""Seeded training order: epochs, batches and optimiser steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 100_000


def batch_schedule(
    rows: DataFrame,
    *,
    key: str,
    steps: int,
    batch_size: int,
    accumulation: int,
    seed: int,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Batch and step of every row in every epoch needed for ``steps`` steps.

    Each epoch orders the rows by a seeded hash and cuts them into batches, the
    last one short. A step takes ``accumulation`` batches, or what is left at
    the end of an epoch. Rows are numbered block by block, a block being the
    leading digits of the hash, so no task sees a whole epoch. Blocks are
    counted first; those past the last needed step are never numbered.
    """
    total = rows.count()
    if total == 0:
        epochs = 0
    else:
        steps_per_epoch = math.ceil(math.ceil(total / batch_size) / accumulation)
        epochs = math.ceil(steps / steps_per_epoch)
    digits = max(0, math.ceil(math.log(max(1, total / rows_per_block), 16)))
    epoch_list = F.sequence(F.lit(0), F.lit(epochs - 1)) if epochs else F.array().cast("array<int>")
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("epoch").cast("string"), F.lit(str(seed))))
    hashed = (
        rows.select(key, F.explode(epoch_list).alias("epoch"))
        .withColumn("hash", mixed)
        .withColumn("block", F.substring("hash", 1, digits))
    )
    own = ["epoch", "block"]
    before = Window.partitionBy("epoch").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        hashed.groupBy(*own)
        .agg(F.count("*").alias("n"))
        .select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy(*own).orderBy("hash", key)
    if not epochs:
        steps_per_epoch = 1
    places = (F.lit(steps).cast("long") - F.col("epoch").cast("long") * steps_per_epoch) * accumulation * batch_size
    needed = offsets.where(F.col("offset") < places)
    return (
        hashed.join(needed, own)
        .withColumn("inside", F.row_number().over(inside))
        .withColumn("place", F.col("offset") + F.col("inside") - 1)
        .withColumn("batch", F.floor(F.col("place") / batch_size))
        .withColumn(
            "step",
            F.col("epoch").cast("long") * steps_per_epoch + F.floor(F.col("batch") / accumulation) + 1,
        )
        .where(F.col("step") <= steps)
        .select(key, "epoch", "place", "batch", "step")
    )

"""Problem 7: islands and gaps of intervals per entity.

Sort by start, compare each start with the running maximum of the earlier ends, label islands by a cumulative count.  To keep an
entity that holds a third of all rows out of one task, the sort is done per block:

1. rows with equal entity and start are reduced to their largest end by a partial aggregate;
2. the distinct starts are cut by range, in the order of entity and start, into blocks of about ``BLOCK`` rows, whatever the unit and
   the density of the positions;
3. each block's largest end and number of islands are carried over the entity's earlier blocks, one small row a block;
4. inside a block the running maximum begins with what was carried in.

Rows with a null bound or a null entity are ignored; reversed bounds are swapped; touching intervals (end + 1 = next start) join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.runtime import stored

#: Rows of a block, which one window sorts.
BLOCK = 1 << 18


def _swept(rows: DataFrame, entity: str, start: Column | str, end: Column | str, block: int) -> DataFrame:
    """Distinct starts with ``hi``, the largest earlier end ``prev`` (null at an entity's first) and their block."""
    lo, hi = F.least(F.col(start), F.col(end)), F.greatest(F.col(start), F.col(end))
    spans = (
        rows.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
        .select(F.col(entity).alias("entity"), lo.alias("lo"), hi.alias("hi"))
        .groupBy("entity", "lo")
        .agg(F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    spans = stored(spans)
    blocks = -(-spans.count() // block)
    before = Window.partitionBy("entity", "block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    if blocks < 2:
        return spans.withColumn("block", F.lit(0)).withColumn("prev", F.max("hi").over(before))
    # Written, as the cuts of a range are sampled and another run might place them elsewhere.
    spans = stored(spans.repartitionByRange(blocks, "entity", "lo").withColumn("block", F.spark_partition_id()))
    earlier_blocks = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.groupBy("entity", "block").agg(F.max("hi").alias("top")).withColumn("carry", F.max("top").over(earlier_blocks)).drop("top")
    return spans.join(carried, ["entity", "block"]).withColumn("prev", F.greatest(F.max("hi").over(before), F.col("carry"))).drop("carry")


def gaps(rows: DataFrame, entity: str = "seqname", start: str = "start_pos", end: str = "end_pos", block: int = BLOCK) -> DataFrame:
    """``(<entity>, gap_start, gap_end)``: maximal uncovered stretches between the lowest and the highest covered position."""
    swept = _swept(rows, entity, start, end, block)
    return swept.where("lo > prev + 1").select(F.col("entity").alias(entity), (F.col("prev") + 1).alias("gap_start"), (F.col("lo") - 1).alias("gap_end"))


def islands(rows: DataFrame, entity: str = "seqname", start: str = "start_pos", end: str = "end_pos", block: int = BLOCK) -> DataFrame:
    """``(<entity>, island, start, end, n)``: continuous stretches, numbered from 1 per entity, with the rows that they merge."""
    swept = _swept(rows, entity, start, end, block).withColumn("opens", F.coalesce((F.col("lo") > F.col("prev") + 1).cast("long"), F.lit(1).cast("long")))
    earlier_blocks = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = swept.groupBy("entity", "block").agg(F.sum("opens").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(earlier_blocks), F.lit(0))).drop("m")
    upto = Window.partitionBy("entity", "block").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    labelled = swept.withColumn("local", F.sum("opens").over(upto)).join(opened, ["entity", "block"])
    merged = labelled.groupBy("entity", (F.col("base") + F.col("local")).alias("island"))
    return merged.agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.sum("n").alias("n")).withColumnRenamed("entity", entity)

"""Numbering all rows of a table in an order, without a window over the whole."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborsim.sources import scratch


def numbered(rows: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """rows with ``name``: the row's number from 0 in the order. The order must tell rows apart for a stable result.

    One range shuffle, written to the shared folder; only the number of rows of each partition reaches the driver.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch.materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in at.groupBy(part.alias("p")).count().collect())
    before = dict(zip((p for p, _ in counts), accumulate((c for _, c in counts), initial=0)))
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "_part long, _before long"))
    return at.join(starts, part == F.col("_part")).select(*rows.columns, (F.col("_before") + place).alias(name))

"""Exact medians of growing sets of rows, without any task that sees all of them.

Values are cut into buckets at approximate quantiles and counted by bucket and by the first set
that holds them. Sums of these counts tell in which bucket each set's middle ranks lie; only the
rows of those buckets are ordered.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_CUTS = 1_000


def prefix_medians(rows: DataFrame, n: int, n_cuts: int = N_CUTS) -> dict[int, float]:
    """Set k's exact median (midpoint of the two middle values if even) for k below ``n``.

    rows: ``window`` (the first set that holds the value; later ones hold it too) and ``y`` (missing ones
    do not count). The driver sees n * n_cuts counts at most. Sets without values are left out.
    """
    held = rows.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("window") < n)).select("window", F.col("y").cast("double").alias("y"))
    points = [(i + 1) / n_cuts for i in range(n_cuts - 1)]
    cuts = held.agg(F.percentile_approx("y", points, 10 * n_cuts)).first()[0] or []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    # Infinite values lie in the outermost buckets.
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    cut = Bucketizer(splits=splits, inputCol="y", outputCol="bucket").transform(held)
    counts: dict[int, dict[int, int]] = {}
    for r in cut.groupBy("window", "bucket").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["window"], {})[int(r["bucket"])] = r["n"]
    wanted, so_far = [], [0] * len(splits)
    for window in range(n):
        for bucket, k in counts.get(window, {}).items():
            so_far[bucket] += k
        total = sum(so_far)
        if not total:
            continue
        low, high, before, first = (total + 1) // 2, total // 2 + 1, 0, None
        for bucket, k in enumerate(so_far):
            if k and before + k >= low:
                first = before if first is None else first
                wanted.append((window, float(bucket), low - first, high - first))
                if before + k >= high:
                    break
            before += k
    if not wanted:
        return {}
    # Two rows per set at most.
    asked = rows.sparkSession.createDataFrame(wanted, "set long, bucket double, low long, high long")
    found = cut.join(F.broadcast(asked), "bucket").where("window <= set")
    at = F.row_number().over(Window.partitionBy("set").orderBy("y"))
    middle = found.withColumn("at", at).where("at = low or at = high")
    return {r["set"]: r["m"] for r in middle.groupBy("set").agg(F.avg("y").alias("m")).collect()}

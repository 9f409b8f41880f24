"""Vector-table statistics: int4 absmax quantization, per-dimension absmax and
the (damped) Gram matrix of an embedding table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_
from quarry.plans.layout import attach_row


def int4_quantize(vec) -> Column:
    """Struct(scale, q, dequant, max_abs_error) with scale = max(absmax / 7, 1e-8),
    q = clamp(round_half_even(x / scale), -8, 7)."""
    from quarry.functions.text import map_with_scalar
    x = F.transform(col_(vec), lambda v: v.cast("double"))
    scale = F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))) / F.lit(7.0), F.lit(1e-8))
    q = map_with_scalar(x, scale, lambda v, s: F.least(F.greatest(F.bround(v / s, 0), F.lit(-8.0)), F.lit(7.0)).cast("int"))
    deq = map_with_scalar(q, scale, lambda v, s: v * s)
    err = F.array_max(F.zip_with(x, deq, lambda a, b: F.abs(a - b)))
    return F.struct(scale.alias("scale"), q.alias("q"), deq.alias("dequant"), err.alias("max_abs_error"))


def dim_absmax(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Max |x| per dimension (partial maxima are combined map-side)."""
    e = df.select(F.posexplode(vec_col).alias("dim", "_x"))
    return e.groupBy("dim").agg(F.max(F.abs(F.col("_x").cast("double"))).alias("absmax"))


def gram_matrix(df: DataFrame, vec_col: str = "embedding", damp: float = 0.01) -> DataFrame:
    """Normalised, damped Gram matrix rows (i, j, value)."""
    def partial(batches):
        # one d x d partial per partition (batches are folded in), so the
        # shuffle carries partitions x d^2 cells whatever the row count
        g, n = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            g = m.T @ m if g is None else g + m.T @ m
            n += len(m)
        if g is None:
            return
        d = g.shape[0]
        ii, jj = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame({"i": ii.ravel(), "j": jj.ravel(), "v": g.ravel(),
                            "n": np.where((ii == 0) & (jj == 0), n, 0).ravel()})

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
                           T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = df.select(vec_col).mapInPandas(partial, schema)
    # n rides along as a per-partition count on cell (0, 0); every cell is divided by the total n
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("_s"), F.sum("n").alias("_n"))
    total = sums.filter((F.col("i") == 0) & (F.col("j") == 0)).select(F.col("_n").alias("_total"))
    cells = attach_row(sums, total)
    cells = cells.withColumn("value", F.col("_s") / F.col("_total"))
    diag = cells.filter(F.col("i") == F.col("j")).agg(F.avg("value").alias("_md"))
    out = attach_row(cells, diag)
    return out.select("i", "j", (F.col("value") + F.when(F.col("i") == F.col("j"), F.lit(damp) * F.col("_md"))
                                 .otherwise(F.lit(0.0))).alias("value"))

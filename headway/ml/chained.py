"""Chained inference beyond the model horizon (M6 + X15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import segment_sizes


def predict_chained(model: Callable[[DataFrame], DataFrame], feats: DataFrame, id_cols, k_max: int,
                    k_col: str = "k", hops_col: str = "num_paradas_salto",
                    hist_col: str = "tiempo_promedio_historico", pred_col: str = "prediction") -> DataFrame:
    """Rows with ``k <= k_max`` are predicted as they are. Longer horizons are split into
    ``ceil(k / k_max)`` balanced segments; each segment row gets hops = segment size and
    the historical time scaled by segment/k; the segment predictions are summed.

    ``model`` is any DataFrame -> DataFrame transform adding ``pred_col`` (a fitted
    ``PipelineModel.transform`` or a closed-form expression). One explode, one model
    pass, one aggregation keyed by the row id; nothing is collected.
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    k = F.col(k_col)
    direct = k <= k_max
    segs = F.when(direct, F.array(k.cast("int"))).otherwise(segment_sizes(k_col, k_max))
    ex = (feats.withColumn("n_segments", F.size(segs))
               .withColumn("_direct", direct)
               .withColumn("_seg", F.explode(segs)))
    ex = (ex.withColumn(hops_col, F.when(F.col("_direct"), F.col(hops_col)).otherwise(F.col("_seg").cast("double")))
            .withColumn(hist_col, F.when(F.col("_direct"), F.col(hist_col))
                        .otherwise(F.col(hist_col) * (F.col("_seg") / k))))
    scored = model(ex)
    return (scored.groupBy(*id_cols, k_col, "n_segments")
                  .agg(F.sum(F.col(pred_col)).alias(pred_col)))

"""Hyper-parameter search on nested samples.

The source prunes a trial while it trains. Here trials run in rounds of growing samples: after each
round the worse half of the settings goes, so most of the work is done on the smallest sample and only a
few settings see the largest one.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, splits
from ..session import materialize
from . import models

# Fixed value: the search sample of the source (5 %); later rounds double it.
SEARCH_FRACTIONS = (0.05, 0.1, 0.2)


def _sample(train: DataFrame, key_cols, stratum: str, fraction: float, holdout_pct: float, seed: int) -> DataFrame:
    """The round's rows with ``_held``, in an order that does not depend on the run: sums and bagging of the
    trees go by partition and place."""
    d = splits.stratified_sample(train, stratum, key_cols, fraction, seed)
    # another seed than the sample's, or the hold-out would be the sample's lowest hashes
    d = d.withColumn("_held", splits.holdout_flag(key_cols, holdout_pct, seed + 1))
    d = materialize(d.repartition(*key_cols).sortWithinPartitions(*key_cols, *train.columns), "search")
    n = d.agg(F.count_if("_held").alias("held"), F.count_if(~F.col("_held")).alias("fit")).first()
    if not (n.held and n.fit):
        raise ValueError(f"a sample of {fraction} has {n.fit} rows to fit and {n.held} held out: take a larger fraction")
    return d


def halving_search(train: DataFrame, pipeline: Pipeline, label: str, key_cols, stratum: str = "k",
                   trials: int = models.SEARCH_TRIALS, fractions=SEARCH_FRACTIONS, rounds: int = models.SEARCH_ROUNDS,
                   holdout_pct: float = 20.0, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """One row a trial: its settings, the last round it took part in (from 1), that round's sample
    ``fraction`` and hold-out ``rmse``, and ``rank`` (1 is the choice: later rounds first, then the error).

    The samples are nested (T8, the same share of each ``stratum``) and a stable hash of the keys holds out
    ``holdout_pct`` per cent, for early stopping and for the error, so a trial is judged on rows of which
    the round before was a part. The settings are those of ``models.random_search`` with the same seed. ``rmse``
    is rounded to 6 decimals and ties go to the earlier trial, so that the order in which partial sums
    arrive decides nothing. Rows without a label are left out; a sample without rows to fit or without
    held-out rows is refused."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    gbt = pipeline.getStages()[-1]
    maps = models.search_maps(gbt, trials, seed)
    train = train.where(F.col(label).isNotNull())
    # the samples are nested: the table is built once, for the largest
    train = materialize(splits.stratified_sample(train, stratum, key_cols, max(fractions), seed), "largest")
    alive, last = list(range(trials)), {}
    for number, fraction in enumerate(fractions, start=1):
        d = _sample(train, key_cols, stratum, fraction, holdout_pct, seed)

        def error(trial: int) -> float:
            fixed = {gbt.maxIter: rounds, gbt.validationIndicatorCol: "_held"}
            model = pipeline.fit(d, {**maps[trial], **fixed})
            row = metrics.regression_metrics(model.transform(d.where("_held")), label, "prediction").first()
            return round(row["rmse"], 6)

        with ThreadPool(min(parallelism, len(alive))) as pool:
            errors = pool.map(inheritable_thread_target(train.sparkSession)(error), alive)
        last.update({t: (number, float(fraction), e) for t, e in zip(alive, errors)})
        alive = sorted(alive, key=lambda t: (last[t][2], t))[:math.ceil(len(alive) / 2)]
    order = sorted(last, key=lambda t: (-last[t][0], last[t][2], t))
    names = ["maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "featureSubsetStrategy"]
    rows = [(t, *last[t], order.index(t) + 1, *[float(maps[t][gbt.getParam(n)]) for n in names]) for t in range(trials)]
    return train.sparkSession.createDataFrame(
        rows, "trial long, round long, fraction double, rmse double, rank long, max_depth double, step_size double, "
              "subsample double, min_instances double, feature_share double")

"""Baseline features, fits and closed predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions.stats import rmse
from isopleth.operators import baselines
from isopleth.plans.fixtures import TRAIN_END, VAL_END, Fixtures
from isopleth.plans.registry import query
from isopleth.session import pinned

LAYERS = ["prior", "s1", "s2", "aridity", "human", "glacier"]
TREES = 200


@query(
    "ml_feature_matrix",
    "t:d cy:i cx:i " + " ".join(f"{c}:f" for c in LAYERS) + " month_sin:f month_cos:f",
    "SELECT t, cy, cx, "
    + ", ".join(f"sum({c}*w)/sum(w) AS {c}" for c in LAYERS)
    + ", sin(2*pi()*month(t)/12) AS month_sin, cos(2*pi()*month(t)/12) AS month_cos FROM fx_valid WHERE valid GROUP BY t, cy, cx",
)
def feature_matrix(fx: Fixtures):
    return baselines.feature_matrix(fx.valid, LAYERS, "w", "valid", fx.grid, coarse=True)


def _coarse(fx: Fixtures):
    rows = baselines.feature_matrix(fx.valid, [*LAYERS, "obs"], "w", "valid", fx.grid, coarse=True)
    return pinned(rows)


def _period(df, split: int):
    train, val = F.lit(TRAIN_END).cast("date"), F.lit(VAL_END).cast("date")
    return df.where([F.col("t") <= train, (F.col("t") > train) & (F.col("t") <= val), F.col("t") > val][split])


@query("ml_baseline_fit", "model:s n_train:i validation_rmse:f")
def baseline_fit(fx: Fixtures):
    """Both baselines fitted on training months, scored on validation months."""
    rows = _coarse(fx)
    train, val = _period(rows, 0), _period(rows, 1)
    n_train = train.agg(F.count("*").alias("n"))
    out = None
    for kind in ("linear", "forest"):
        model = baselines.fit(train, LAYERS, "obs", kind, trees=TREES)
        score = baselines.predict(model, val).agg(rmse("raw", "obs").alias("validation_rmse")).select(
            F.lit(kind).alias("model"), "validation_rmse"
        )
        out = score if out is None else out.unionByName(score)
    return out.withColumn("n_train", n_train.scalar())


@query("ml_baseline_predict_close", "model:s t:d iy:i ix:i raw:f projected:f error_after:f")
def baseline_predict_close(fx: Fixtures):
    """Fine predictions of the test months with closed block means."""
    rows = _coarse(fx)
    train, target = _period(rows, 0), rows.select("t", "cy", "cx", "obs")
    fine = _period(baselines.feature_matrix(fx.valid, LAYERS, "w", "valid", fx.grid, coarse=False), 2).drop("cy", "cx", "obs")
    out = None
    for kind in ("linear", "forest"):
        model = baselines.fit(train, LAYERS, "obs", kind, trees=TREES)
        closed = baselines.close(baselines.predict(model, fine), target, "obs", fx.grid, "w")
        part = closed.select(F.lit(kind).alias("model"), "t", "iy", "ix", "raw", "projected", "error_after")
        out = part if out is None else out.unionByName(part)
    return out

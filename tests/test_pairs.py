"""Within-block contrasts."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.operators import bootstrap, pairs

MODELS = [f"M{i}" for i in range(5)]


def months(n):
    return [date(2020 + i // 12, i % 12 + 1, 1) for i in range(n)]


def build(spark, contrast, model=None, missing=0, background=0.0, flip=1.0):
    """Two cells of one block: the first carries the contrast."""
    n = len(contrast)
    obs, preds = [], []
    for k, t in enumerate(months(n)):
        for ix, part in ((0, flip * contrast[k]), (1, 0.0)):
            obs.append((7, 0, ix, t, float(part + background * k)))
            for m in MODELS:
                if m == "M3" and k < missing:
                    continue
                v = part if model is None else model(m, k, part, ix)
                preds += [(t, 0, ix, m, variant, float(v + background * k)) for variant in ("raw", "corrected")]
    o = spark.createDataFrame(obs, "block long, iy int, ix int, t date, obs double")
    p = spark.createDataFrame(preds, "t date, iy int, ix int, model string, variant string, value double")
    return pairs.pair_table(pairs.contrasts(o, p, 10))


WAVE = [np.sin(0.7 * k) for k in range(36)]


def test_common_months_over_all_models(spark):
    table = build(spark, WAVE, missing=13)
    assert {r.n_common for r in table.collect()} == {23}
    assert pairs.judged(table, 24).where("reason IS NULL").count() == 0
    kept = pairs.judged(table, 18).where("reason IS NULL").collect()
    assert len(kept) == 10 and all(r.pearson_r == pytest.approx(1.0) for r in kept)


def test_background_cancels_and_orientation_is_irrelevant(spark):
    plain = build(spark, WAVE).orderBy("model", "variant").collect()
    other = build(spark, WAVE, background=3.0, flip=-1.0).orderBy("model", "variant").collect()
    for a, b in zip(plain, other):
        assert b.pearson_r == pytest.approx(a.pearson_r) and b.spearman_rho == pytest.approx(1.0)


def test_constant_model_drops_the_pair(spark):
    table = build(spark, WAVE, model=lambda m, k, part, ix: 0.0 if m == "M4" else part)
    reasons = {r.reason for r in pairs.judged(table, 18).collect()}
    assert len(reasons) == 1 and "constant" in reasons.pop()


def test_sign_agreement_counts_exact_zeros(spark):
    table = build(spark, [-1.0, 0.0, 1.0] * 12, model=lambda m, k, part, ix: 0.1 if part == 0 and ix == 0 else part)
    row = table.first()
    assert row.sign_agreement == pytest.approx(2 / 3) and row.obs_zero == 12


def test_blocks_weigh_equally_and_draws_repeat(spark):
    rows = [(1, 0, i, 1, i, m, -0.5) for i in range(100) for m in MODELS] + [(2, 0, 0, 1, 1, m, 0.5) for m in MODELS]
    df = spark.createDataFrame(rows, "block long, iy_i int, ix_i int, iy_j int, ix_j int, model string, pearson_r double").withColumns(
        {"spearman_rho": F.col("pearson_r"), "sign_agreement": F.col("pearson_r")}
    )
    summary = pairs.block_summary(df)
    assert {(r.block, r.n_pairs) for r in summary.collect()} == {(1, 100), (2, 1)}
    gains = pairs.gains(summary, MODELS, "M4").select("block", F.lit("gain").alias("s"), F.col("pcc_gain_M0").alias("value"))
    level = summary.where("model = 'M0'").select("block", F.lit("level").alias("s"), F.col("median_pcc").alias("value"))
    run = lambda: bootstrap.cluster_statistics(gains.unionByName(level), ["s"], "block", 60, 42).orderBy("s").collect()
    first = run()
    assert first[0].median_lower == 0.0 and first[0].median_upper == 0.0 and first[1]["median"] == 0.0
    assert first == run()


def test_missing_model_fails(spark):
    df = spark.createDataFrame([(1, "M0", 0.1)], "block long, model string, median_pcc double").withColumns(
        {"median_spearman": F.col("median_pcc"), "median_sign": F.col("median_pcc")}
    )
    with pytest.raises(Exception, match="lacks model"):
        pairs.gains(df, MODELS, "M4").collect()


def test_association_refuses_small_support(spark):
    rows = [(b, float(b + i), float(i - b)) for b in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "block long, x double, y double")
    out = bootstrap.association(df, "block", "x", "y", 20, 42).collect()
    assert {r.status for r in out} == {"insufficient support"} and all(r.estimate is None for r in out)
    fine = {r.statistic: r for r in bootstrap.association(df, "block", "x", "y", 20, 42, min_blocks=4).collect()}
    assert set(fine) == {"spearman", "low", "middle", "high"} and fine["spearman"].lower <= fine["spearman"].upper

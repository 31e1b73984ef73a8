"""Scores of what a layer keeps, against numpy on a small matrix with gaps, and the evaluators made of them."""

import numpy as np
import pytest

from quantgrid.errors import ValidationError
from quantgrid.functions import preservation as keep
from quantgrid.plans import autoselect

from .test_scores import cells_of


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(11)
    batch, group = np.arange(24) % 3, np.arange(24) // 3 % 2
    x = rng.normal(size=(24, 14)) * 0.3 + rng.uniform(8, 14, 14) + group[:, None] * rng.normal(size=14) * 2 + batch[:, None] * 0.7 + rng.normal(size=(24, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = x - np.nanmedian(x, 1, keepdims=True) + np.nanmedian(x)
    y = y + batch[:, None] * 0.1 * rng.normal(size=14)
    obs = spark.createDataFrame([(f"s{i:03d}", f"b{b}", f"g{g}") for i, (b, g) in enumerate(zip(batch, group))], "sample_id string, batch string, group string")
    return x, y, batch, group, cells_of(spark, x), cells_of(spark, y), obs


def centres(x, label):
    return {k: np.nan_to_num(np.nanmean(x[label == k], 0)) for k in np.unique(label)}


def pairs_of(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def value(df):
    return df.first()[0]


def test_groups_and_batches(layers):
    x, y, batch, group, before, after, obs = layers
    g, b = (obs.selectExpr("sample_id", f"`{c}` as label") for c in ("group", "batch"))
    m, k = centres(x, group), centres(y, group)
    want = []
    for i, j in pairs_of(sorted(m)):
        e, f = m[i] - m[j], k[i] - k[j]
        if np.abs(e).mean() >= 0.08 * np.nanstd(x, 0).mean():
            want.append(0.6 * (np.corrcoef(e, f)[0, 1] + 1) / 2 + 0.4 * np.exp(-abs(np.log(np.linalg.norm(f) / np.linalg.norm(e)))))
    assert want and value(keep.intergroup_preservation(before, after, g)) == pytest.approx(np.mean(want))
    gap = lambda c: np.mean([np.abs(c[i] - c[j]).mean() for i, j in pairs_of(sorted(c))])
    was, now = gap(centres(x, batch)), gap(centres(y, batch))
    assert value(keep.technical_variance(before, after, b)) == pytest.approx(0.5 + 0.5 * np.clip((was - now) / was, -1, 1))
    assert value(keep.technical_variance(after, before, b)) == pytest.approx(0.5 + 0.5 * np.clip((now - was) / now, -1, 1))
    cv = [np.median(np.nanstd(y[group == i], 0) / np.nanmean(y[group == i], 0)) for i in (0, 1)]
    assert value(keep.intragroup_variation(after, g)) == pytest.approx(np.exp(-np.mean(cv)))
    assert value(keep.intergroup_preservation(before.where("feature_id < 'F005'"), after.where("feature_id < 'F005'"), g)) == 0.0  # fewer than ten features


def test_samples_and_features(layers, spark):
    x, y, _, _, before, after, _ = layers
    mad = lambda z: np.median(np.abs((s := np.nanmedian(z, 1)) - np.median(s)))
    assert value(keep.loading_bias_reduction(before, after)) == pytest.approx(0.5 + 0.5 * np.clip((mad(x) - mad(y)) / mad(x), -1, 1))
    cv = np.nanstd(y, 0) / np.nanmean(y, 0)
    assert value(keep.even_variation(after)) == pytest.approx(1 - min(1, cv.std() / cv.mean()))
    v, w = np.nanvar(x, 0, ddof=1), np.nanvar(y, 0, ddof=1)
    assert value(keep.variance_agreement(before, after)) == pytest.approx((1 + np.corrcoef(v, w)[0, 1]) / 2)
    upper = np.triu_indices(len(x), 1)
    c, d = (np.corrcoef(np.nan_to_num(z))[upper] for z in (x, y))
    assert keep.signal_preservation(before, after) == pytest.approx((1 + np.corrcoef(c, d)[0, 1]) / 2)
    flat = y.copy()
    flat[3] = 2.0  # a sample without spread: variances are compared instead
    v, w = np.nan_to_num(x).var(), np.nan_to_num(flat).var()
    assert keep.signal_preservation(before, cells_of(spark, flat)) == pytest.approx(min(v / w, w / v))
    points = {r["sample_id"]: r["vec"] for r in keep.filled_points(after).collect()}
    filled = np.where(np.isnan(y), np.nanmedian(y, 0), y)
    assert np.allclose([points[f"s{i:03d}"] for i in range(len(y))], filled)


def test_empty_and_single(layers):
    *_, before, after, obs = layers
    none, g = after.limit(0), obs.selectExpr("sample_id", "`group` as label")
    assert keep.signal_preservation(none, none) == 0.0 and keep.filled_points(none).count() == 0
    for score in (keep.loading_bias_reduction(none, none), keep.intergroup_preservation(none, none, g), keep.technical_variance(none, none, g), keep.intragroup_variation(none, g), keep.even_variation(none), keep.variance_agreement(none, none)):
        assert value(score) == 0.0
    assert autoselect.labels_of(obs, "nowhere") is None and autoselect.labels_of(obs.selectExpr("sample_id", "'x' as batch"), "batch") is None


def test_label_bound(layers, monkeypatch):
    *_, before, after, obs = layers
    monkeypatch.setattr(keep, "MAX_LABELS", 2)
    with pytest.raises(ValidationError):
        keep.label_effects(before, after, obs.selectExpr("sample_id", "batch as label"))


def test_evaluators(layers):
    x, y, batch, group, before, after, obs = layers
    got = autoselect.normalization_scores(before, after, obs)
    assert set(got) > set(autoselect.WEIGHTS["normalize"]) and len(got) == 13 and all(0 <= v <= 1 for v in got.values())
    filled = np.where(np.isnan(y), np.nanmedian(y, 0), y)
    far = ((filled[:, None] - filled[None]) ** 2).sum(2)

    def width(label):
        s = []
        for i in range(len(y)):
            own = far[i, (label == label[i]) & (np.arange(len(y)) != i)].mean()
            other = min(far[i, label == k].mean() for k in np.unique(label) if k != label[i])
            s.append((other - own) / max(own, other))
        return (np.mean(s) + 1) / 2

    assert got["bio_asw"] == pytest.approx(width(group)) and got["batch_asw"] == pytest.approx(1 - width(batch))
    assert got["batch_mixing"] == pytest.approx(1.0)  # 23 neighbours hold all three batches
    assert got["batch_removal"] == pytest.approx(np.mean([got[c] for c in ("technical_variance", "batch_asw", "batch_mixing")]))
    assert got["balance_score"] == pytest.approx(1 - abs(got["batch_removal"] - got["bio_conservation"]))
    bare = autoselect.normalization_scores(before, after, obs.select("sample_id"))
    assert bare["batch_removal"] == 0 and bare["intergroup_preservation"] == bare["signal_preservation"] and bare["clustering_quality"] > 0
    full = cells_of(before.sparkSession, filled)
    scores = autoselect.integration_scores(full, full, obs, "batch", "group")
    assert scores["variance_preserved"] == pytest.approx(1) and set(scores) == set(autoselect.BIO_WEIGHTS) and scores["bio_asw"] > 0


def test_candidates_stay_in_place(layers):
    """The selection compares centred layers that keep the overall level, and passes the layer it scored."""
    x, *_, before, _, obs = layers
    s = autoselect.AutoSelector(methods={"normalize": ["median", "mean"]})
    made = {m: make() for m, (make, _) in s.candidates("normalize", before, obs, False).items()}
    for name, middle in (("median", np.nanmedian), ("mean", np.nanmean)):
        want = x - middle(x, 1)[:, None] + middle(x)
        got = {(r["sample_id"], r["feature_id"]): r["value"] for r in made[name].collect()}
        assert all((np.isnan(want[i, j]) and v is None) or v == pytest.approx(want[i, j]) for (i, j), v in (((int(a[1:]), int(b[1:])), v) for (a, b), v in got.items()))

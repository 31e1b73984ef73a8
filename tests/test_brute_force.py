"""Operators that SQL can't express, against plain numpy on small matrices."""

import math
import tracemalloc
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrid.errors import ValidationError
from quantgrid.functions import benchmarks, metrics, stats
from quantgrid.model import Assay, Dataset, chosen
from quantgrid.operators import aggregate, impute, integrate, masks, normalize, qc, reduce  # noqa: F401
from quantgrid.operators.matrix import row_arrays
from quantgrid.plans import autoselect
from quantgrid.sources import synthetic, tables


def cells_of(spark, x):
    rows = [(f"S{i:02d}", f"F{j:02d}", None if np.isnan(v) else float(v), 0) for i, line in enumerate(x) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double, mask int")


def matrix_of(cells, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        if r["value"] is not None:
            out[int(r["sample_id"][1:]), int(r["feature_id"][1:])] = r["value"]
    return out


def low_rank(seed, n=14, m=6, gaps=0.15):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, m)) * 3 + 20 + rng.normal(size=(n, m)) * 0.1
    y = x.copy()
    y[rng.random(x.shape) < gaps] = np.nan
    y[0] = x[0]
    return x, y


@pytest.fixture(scope="module")
def batches(spark):
    """A matrix of three batches with shifts, and its samples with a group and a number."""
    rng = np.random.default_rng(3)
    batch, group = np.array([0] * 5 + [1] * 6 + [2] * 4), np.array([0, 1, 0, 1, 1] + [0, 1, 0, 1, 0, 1] + [1, 0, 1, 0])
    number = rng.normal(size=15)
    x = rng.normal(size=(15, 8)) * rng.uniform(0.5, 2, 8) + 10 + batch[:, None] * rng.normal(size=8) + group[:, None] * rng.normal(size=8) * 2 + number[:, None] * 0.3
    obs = spark.createDataFrame([(f"S{i:02d}", f"b{b}", f"g{g}", float(v)) for i, (b, g, v) in enumerate(zip(batch, group, number))], "sample_id string, batch string, group string, number double")
    return x, batch, group, number, obs


def brute_maxlfq(x, least):
    """One protein, samples x peptides (logs): all pairs of samples in turn, then least squares for each connected set."""
    n, out = len(x), np.full(len(x), np.nan)
    edges = [(i, j, np.median(d), len(d)) for i in range(n) for j in range(i + 1, n) if len(d := (x[j] - x[i])[~np.isnan(x[j] - x[i])]) >= least]
    group = list(range(n))
    for i, j, *_ in edges:
        group = [group[i] if g == group[j] else g for g in group]
    for g in set(group):
        at = [i for i in range(n) if group[i] == g and not np.isnan(x[i]).all()]
        if not at:
            continue
        mine = [e for e in edges if group[e[0]] == g]
        a = np.zeros((len(mine) + 1, n))
        b = np.zeros(len(mine) + 1)
        for k, (i, j, r, c) in enumerate(mine):
            a[k, j], a[k, i], b[k] = math.sqrt(c), -math.sqrt(c), math.sqrt(c) * r
        a[-1, at[0]] = 1
        level = np.linalg.lstsq(a, b, rcond=None)[0]
        rest = (x - level[:, None])[at]
        out[at] = level[at] + np.median(rest[~np.isnan(rest)])
    return out


@pytest.mark.parametrize("least", [1, 2])
def test_maxlfq(spark, least):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 5)) + 5
    x[rng.random(x.shape) < 0.4] = np.nan
    x[5, :3], x[:5, 3:], x[5, 3:] = np.nan, np.nan, [1.0, 2.0]
    x[6] = [np.nan, np.nan, np.nan, 3.0, 5.0]
    links = spark.createDataFrame([(f"F{j:02d}", "F00") for j in range(5)], "source_id string, target_id string")
    got = matrix_of(aggregate.aggregate_to_protein(cells_of(spark, np.exp(x)), links, "maxlfq", lfq_min_ratio_count=least), (7, 1))[:, 0]
    assert np.allclose(np.log(got), brute_maxlfq(x, least), equal_nan=True)


def test_median_polish(spark):
    x = np.random.default_rng(2).normal(size=(5, 4)) + 6
    links = spark.createDataFrame([(f"F{j:02d}", "F00") for j in range(4)], "source_id string, target_id string")
    got = np.log2(matrix_of(aggregate.aggregate_to_protein(cells_of(spark, 2.0**x), links, "tmp"), (5, 1))[:, 0])
    total = np.median(x)
    rest, effect = x - total, np.zeros(5)
    for _ in range(20):
        r = np.median(rest, 1)
        rest, effect = rest - r[:, None], effect + r
        c = np.median(rest, 0)
        rest = rest - c
        if max(abs(r).max(), abs(c).max()) < 1e-6:
            break
    assert np.allclose(got, total + effect)


def test_median_polish_goes_by_values(spark):
    """Each of 20,000 samples has its own peptide beside a shared one: a table of samples by peptides would take 3.2 GB in one task."""
    n = 20_000
    ids = spark.range(n).select(F.concat(F.lit("S"), "id").alias("sample_id"), "id")
    value = lambda c: F.pow(F.lit(2.0), c).alias("value")
    own = ids.select("sample_id", F.concat(F.lit("F"), F.col("id") + 1).alias("feature_id"), value(F.col("id") % 7 + 3), F.lit(0).alias("mask"))
    shared = ids.select("sample_id", F.lit("F0").alias("feature_id"), value(F.col("id") % 7 + 1), F.lit(0).alias("mask"))
    links = spark.range(n + 1).select(F.concat(F.lit("F"), "id").alias("source_id"), F.lit("P").alias("target_id"))
    tracemalloc.start()
    data = shared.unionByName(own).select(F.lit("P").alias("protein"), F.regexp_extract("sample_id", r"\d+", 0).cast("long").alias("sample"), F.regexp_extract("feature_id", r"\d+", 0).cast("long").alias("feature"), "value").toArrow()
    fitted = aggregate._polish(2.0)(data)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    got = {r["sample_id"]: r["value"] for r in aggregate.aggregate_to_protein(shared.unionByName(own), links, "tmp").collect()}
    assert len(got) == n
    level = [np.log2(got[f"S{i}"]) for i in range(7)]
    assert np.allclose(np.diff(level), 1) and np.allclose(np.log2([got[f"S{i}"] for i in range(n)]), [level[i % 7] for i in range(n)])
    assert fitted.num_rows == n


def test_pair_ratios_in_parts(spark, monkeypatch):
    """Proteins in several parts: pairs by rising name, medians of even and odd counts, each pair once."""
    monkeypatch.setattr(aggregate, "PAIRS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 9))
    x[rng.random(x.shape) < 0.4] = np.nan
    rows = [("P", f"F{j}", f"S{i}", float(x[i, j])) for i in range(12) for j in range(9) if not np.isnan(x[i, j])]
    found = aggregate.pair_ratios(spark.createDataFrame(rows, "protein string, feature_id string, sample_id string, x double"), 2).collect()
    got = {(r["a"], r["b"]): (r["ratio"], r["n"]) for r in found}
    want = {}
    for i in range(12):
        for j in range(12):
            d = (x[j] - x[i])[~np.isnan(x[j] - x[i])]
            if f"S{i}" < f"S{j}" and len(d) > 1:
                want[f"S{i}", f"S{j}"] = (pytest.approx(np.median(d)), len(d))
    assert got == want and len(found) == len(want)


def brute_combat(x, batch, design, nonparametric):
    """ComBat by its design matrix: batch indicators, then covariates."""
    n, kinds = len(x), np.unique(batch)
    whole = np.column_stack([(batch[:, None] == kinds).astype(float), design])
    beta = np.linalg.lstsq(whole, x, rcond=None)[0]
    share = np.array([(batch == k).mean() for k in kinds])
    mean = share @ beta[: len(kinds)] + design @ beta[len(kinds) :]
    sd = np.sqrt(((x - whole @ beta) ** 2).mean(0))
    z = (x - mean) / sd
    out = z.copy()
    for k in kinds:
        at = batch == k
        m = at.sum()
        g, d = z[at].mean(0), z[at].var(0, ddof=1)
        if nonparametric:
            g_new, d_new = np.empty_like(g), np.empty_like(d)
            for f in range(len(g)):
                others = np.arange(len(g)) != f
                like = np.array([np.prod(np.exp(-((z[at, f] - g[o]) ** 2) / (2 * d[o])) / np.sqrt(2 * np.pi * d[o])) for o in np.flatnonzero(others)])
                g_new[f], d_new[f] = like @ g[others] / like.sum(), like @ d[others] / like.sum()
        else:
            t2, b = g.var(ddof=1), d.var(ddof=1)
            a_, b_ = (2 * b + d.mean() ** 2) / b, (d.mean() * b + d.mean() ** 3) / b
            g_new, d_new = g.copy(), d.copy()
            for _ in range(200):
                g_new = (t2 * m * g + d_new * g.mean()) / (t2 * m + d_new)
                d_new = (0.5 * ((z[at] - g_new) ** 2).sum(0) + b_) / (m / 2 + a_ - 1)
        out[at] = (z[at] - g_new) / np.sqrt(d_new)
    return out * sd + mean


@pytest.mark.parametrize("mode", ["parametric", "nonparametric"])
@pytest.mark.parametrize("covariates", [(), ("group", "number")])
def test_combat(spark, batches, mode, covariates, monkeypatch):
    x, batch, group, number, obs = batches
    monkeypatch.setattr(integrate, "WEIGHT_BLOCK", 3)
    design = np.column_stack([group, number]).astype(float) if covariates else np.zeros((15, 0))
    got = matrix_of(integrate.integrate_combat(cells_of(spark, x), obs, covariates=covariates, eb_mode=mode), x.shape)
    assert np.allclose(got, brute_combat(x, batch, design, mode == "nonparametric"), atol=2e-3)


def test_combat_refuses(spark, batches):
    x, *_, obs = batches
    with pytest.raises(ValidationError):
        integrate.integrate_combat(cells_of(spark, x), obs.withColumn("same", F.col("batch")), covariates=("same",)).collect()
    with pytest.raises(ValidationError):
        integrate.integrate_combat(cells_of(spark, x), obs.withColumn("number", F.when(F.col("number") > 0, F.col("number"))), covariates=("number",))


def test_limma_covariates(spark, batches):
    x, batch, group, _, obs = batches
    y = x.copy()
    y[2, 3] = y[9, 3] = np.nan
    got = matrix_of(integrate.integrate_limma(cells_of(spark, y), obs, covariates=("group",)), x.shape)
    want = y.copy()
    for f in range(y.shape[1]):
        at = ~np.isnan(y[:, f])
        coded = np.array([[int(b == k) - int(b == 2) for k in (0, 1)] for b in batch], float)
        beta = np.linalg.lstsq(np.column_stack([np.ones(15), coded, group])[at], y[at, f], rcond=None)[0]
        want[:, f] -= np.append(beta[1:3], -beta[1:3].sum())[batch]
    assert np.allclose(got, want, equal_nan=True)


def test_low_rank_rounds(spark):
    """Each round as numpy does it; gaps come near the hidden values."""
    x, y = low_rank(5)
    gap, mean = np.isnan(y), np.nanmean(y, 0)
    for method, factor in ((impute.impute_iterative_svd, lambda s: (np.arange(len(s)) < 2).astype(float)), (impute.impute_softimpute, lambda s: np.where(s > s.max() / 50, 1 - s.max() / 50 / s, 0))):
        want = np.where(gap, mean, y)
        for _ in range(4):
            _, s, v = np.linalg.svd(want - mean, full_matrices=False)
            want = np.where(gap, (want - mean) @ (v.T * factor(s)) @ v + mean, y)
        options = {"n_components": 2} if method is impute.impute_iterative_svd else {}
        got = matrix_of(method(cells_of(spark, y), max_iter=4, tol=0.0, **options), x.shape)
        assert np.allclose(got, want)


def test_bpca(spark):
    x, y = low_rank(6)
    got = matrix_of(impute.impute_bpca(cells_of(spark, y), n_components=3, max_iter=30), x.shape)
    gap, mean = np.isnan(y), np.where(np.isnan(y), np.nanmean(y, 0), y)
    assert np.allclose(got[~gap], x[~gap]) and np.abs(got - x)[gap].mean() < 0.5 * np.abs(mean - x)[gap].mean()
    alone = np.full((4, 5), np.nan)
    alone[0] = [1, 2, 3, 4, 5]
    assert np.allclose(matrix_of(impute.impute_bpca(cells_of(spark, alone), n_components=4), alone.shape), [1, 2, 3, 4, 5])


def test_lls(spark):
    x, y = low_rank(7, gaps=0.08)
    gap = np.isnan(y)
    now = np.where(gap, np.nanmean(y, 1)[:, None], y)
    far = np.array([[np.inf if i == j else np.sqrt(np.nanmean((y[:, i] - y[:, j]) ** 2)) for j in range(6)] for i in range(6)])
    for _ in range(2):
        new = now.copy()
        for f in np.flatnonzero(gap.any(0)):
            near = sorted(np.argsort(far[f], kind="stable")[:3])
            a = np.column_stack([np.ones(len(x)), now[:, near]])
            ok = ~gap[:, f]
            assert ok.sum() > 3
            new[gap[:, f], f] = a[gap[:, f]] @ np.linalg.lstsq(a[ok], y[ok, f], rcond=None)[0]
        now = new
    assert np.allclose(matrix_of(impute.impute_lls(cells_of(spark, y), k=3, max_iter=2), x.shape), now)


def test_pca(spark):
    x = np.random.default_rng(8).normal(size=(9, 4)) * [3, 2, 1, 0.5]
    found = reduce.pca(cells_of(spark, x), 2)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r["vec"] for r in found["scores"].orderBy("sample_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert np.allclose([r["ratio"] for r in found["variance"].orderBy("component").collect()], (s**2 / (s**2).sum())[:2])


def test_group_tests_p(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 3))
    x[:6, 0] += 2
    groups = spark.createDataFrame([(f"S{i:02d}", "a" if i < 6 else "b") for i in range(12)], "sample_id string, group string")
    for r in stats.welch_tests(cells_of(spark, x), groups, "a", "b").collect():
        a, b = x[:6, int(r["feature_id"][1:])], x[6:, int(r["feature_id"][1:])]
        e = a.var(ddof=1) / 6, b.var(ddof=1) / 6
        t, df = (a.mean() - b.mean()) / math.sqrt(sum(e)), sum(e) ** 2 / (e[0] ** 2 / 5 + e[1] ** 2 / 5)
        grid = np.linspace(0, abs(t), 20001)
        density = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
        assert (r["t"], r["df"]) == (pytest.approx(t), pytest.approx(df)) and r["p"] == pytest.approx(1 - 2 * np.trapezoid(density, grid), abs=1e-6)
    for r in stats.rank_sum_tests(cells_of(spark, x), groups, "a", "b").collect():
        a, b = x[:6, int(r["feature_id"][1:])], x[6:, int(r["feature_id"][1:])]
        u = (a[:, None] > b).sum()
        assert r["u"] == u and r["p"] == pytest.approx(math.erfc(abs(u - 18) / math.sqrt(36 * 13 / 12) / math.sqrt(2)))


def test_neighbourhood_scores(spark):
    rng = np.random.default_rng(10)
    x, label = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    x[label == 0] += 1.5
    rows = row_arrays(cells_of(spark, x))
    labels = spark.createDataFrame([(f"S{i:02d}", f"l{v}") for i, v in enumerate(label)], "sample_id string, label string")
    d = np.sqrt(((x[:, None] - x) ** 2).mean(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10]
    share = np.bincount(label) / 40
    chi = [sum((np.sum(label[n] == k) - 10 * share[k]) ** 2 / (10 * share[k]) for k in range(3)) for n in near]
    assert metrics.kbet(rows, labels, 10) == pytest.approx(np.mean([math.exp(-c / 2) >= 0.05 for c in chi]))  # two degrees of freedom
    values = []
    for i, n in enumerate(np.argsort(d, 1)[:, :9]):
        p = metrics.perplexity_weights(d[i, n], 3.0)
        assert -(p * np.log(p)).sum() == pytest.approx(math.log(3), abs=1e-4)
        values.append(1 / sum(p[label[n] == k].sum() ** 2 for k in range(3)))
    assert metrics.ilisi(rows, labels, 3.0) == pytest.approx((np.median(values) - 1) / 2)


def test_areas(spark):
    rng = np.random.default_rng(11)
    label, score = rng.random(60) < 0.3, np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(label, score)], "label boolean, score double")
    pos, neg = score[label], score[~label]
    assert benchmarks.auc(df, F.col("label"), F.col("score")).first()[0] == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())
    cuts = [np.inf, *sorted(set(score), reverse=True)]
    fpr, tpr = [(neg >= c).mean() for c in cuts], [(pos >= c).mean() for c in cuts]
    grid = np.linspace(0, 0.3, 300_001)
    low = 0.3**2 / 2
    want = 0.5 * (1 + (np.trapezoid(np.interp(grid, fpr, tpr), grid) - low) / (0.3 - low))
    assert benchmarks.partial_auc(df, F.col("label"), F.col("score"), 0.3).first()[0] == pytest.approx(want, abs=1e-3)


def test_guess_groups(spark):
    guess = lambda ids: dict(map(tuple, benchmarks.guess_groups(spark.createDataFrame([(i,) for i in ids], "sample_id string")).collect()))
    assert guess(["run-S1_a", "run-S1_b", "run_S2-a", "run_x"]) == {"run-S1_a": "S1", "run-S1_b": "S1", "run_S2-a": "UNKNOWN", "run_x": "UNKNOWN"}
    assert guess(["a_1", "a_2"]) == {} == guess(["S1_a", "S1_b"])


def test_criteria(spark):
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sample_id string, n int")
    ids = lambda keep: [r["sample_id"] for r in chosen(rows, "sample_id", keep).collect()]
    assert ids(["s3", "s0"]) == ["s3", "s0"] and ids([4, -5, 1]) == ["s4", "s0", "s1"] and ids([True, False, False, True, False]) == ["s0", "s3"]
    assert sorted(ids(F.col("n") > 3)) == ["s4"] and ids([]) == []
    for bad in (["s9"], [7], [-6], [True]):
        with pytest.raises(ValidationError):
            ids(bad)
    ds = Dataset(rows, {"proteins": Assay(spark.createDataFrame([("f",), ("g",)], "feature_id string"), {"raw": spark.createDataFrame([(f"s{i}", f, 1.0, 0) for i in range(5) for f in "fg"], "sample_id string, feature_id string, value double, mask int")})})
    assert ds.filter_samples(["s1"]).layer("proteins", "raw").count() == 2
    assert ds.subset("protein", features=["g"]).layer("raw").count() == 5


def test_mnn(spark, batches):
    x, batch, _, _, obs = batches
    two = obs.where("batch <> 'b2'")
    y, b = x[batch < 2], batch[batch < 2]
    got = matrix_of(integrate.integrate_mnn(cells_of(spark, y), two, k=3, sigma=2.0, order=["b0", "b1"], cos_norm_in=False, cos_norm_out=False, var_adj=False), y.shape)
    left, right = y[b == 0], y[b == 1]
    d = np.sqrt(((left[:, None] - right) ** 2).mean(2))
    a_near, b_near = np.argsort(d, 1)[:, :3], np.argsort(d.T, 1)[:, :3]
    pairs = [(i, j) for i in range(len(left)) for j in a_near[i] if i in b_near[j]]
    anchors = sorted({j for _, j in pairs})
    shift = {j: np.mean([left[i] - right[j] for i, k in pairs if k == j], 0) for j in anchors}
    want = right.copy()
    for s in range(len(right)):
        e = np.sqrt(((right[anchors] - right[s]) ** 2).mean(1))
        others = np.argsort(e, kind="stable")[:3]
        w = np.exp(-(e[others] ** 2) / 8)
        want[s] += w @ np.array([shift[anchors[k]] for k in others]) / w.sum()
    assert np.allclose(got[b == 0], left) and np.allclose(got[b == 1], want)
    every = matrix_of(integrate.integrate_mnn(cells_of(spark, y), two, k=3, n_pcs=3, svd_dim=1), y.shape)
    assert np.isfinite(every).all()
    with pytest.raises(ValidationError):
        integrate.integrate_mnn(cells_of(spark, y), two, order=["b0"])


def test_selection(spark, batches, monkeypatch):
    x, *_, obs = batches
    ds = Dataset(obs, {"proteins": Assay(spark.createDataFrame([(f"F{j:02d}",) for j in range(8)], "feature_id string"), {"raw": cells_of(spark, x)})})

    def broken(cells):
        raise ValueError("no")

    monkeypatch.setitem(normalize.NORMALIZERS, "broken", broken)
    out, report = autoselect.auto_normalize(ds, methods={"normalize": ["none", "median", "quantile", "broken"]}, repeats=2)
    by = {r.method: r for r in report.results}
    assert set(by) == {"none", "median", "broken"} and "quantile" in report.note  # not logged
    assert by["broken"].error == "ValueError: no" and by["median"].repeats == 2 and by["median"].low <= by["median"].quality <= by["median"].high
    assert out.layer("protein", "auto_normalize").count() == x.size
    logged = normalize.log_dataset(ds, new_layer="log2")
    assert autoselect.is_logged(logged, "proteins", "log2") and not autoselect.is_logged(logged, "proteins", "raw")
    monkeypatch.setitem(autoselect.EVALUATORS, "normalize", (lambda before, after, obs: {"own": float(after.count())}, {"own": 1.0}))
    _, report = autoselect.auto_normalize(ds, methods={"normalize": ["mean"]})
    assert report.results[0].scores == {"own": float(x.size)}


def test_mechanism(spark):
    rng = np.random.default_rng(12)
    level = np.sort(rng.normal(size=30) * 3 + 20)
    x = rng.normal(size=(40, 30)) * 0.2 + level
    x[rng.random(x.shape) < np.linspace(0.6, 0.02, 30)] = np.nan
    kind, found = impute.missing_mechanism(cells_of(spark, x))
    assert kind == "mnar" and found["missing_rate"] == pytest.approx(np.isnan(x).mean())


def test_vendor_columns(spark, tmp_path):
    assert tables.detect_software(["EG.PrecursorId", "S1"]) == "spectronaut" and tables.detect_software(["Precursor.Id", "S1"]) == "diann"
    path = tmp_path / "report.tsv"
    path.write_text("Run\tProtein.Group\tGenes\tProtein.Names\tPG.Normalised\tPG.Q.Value\nb.raw\tP1\tG2\tN1\t5\t0.001\na.raw\tP1\tG1\tN2\t7\t0.001\na.raw\tP2\tG3\tN3\t2\t0.5\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        ds = tables.load_diann(spark, f"file://{path}")
    assert any("normalized" in str(w.message) for w in seen)
    assert [(r["Genes"], r["Protein.Names"]) for r in ds.assay("proteins").var.collect()] == [("G1", "N2")]  # one row's, the first sample's


def test_communities(spark):
    """Two clouds are two communities; modularity is that of the formula; a larger resolution splits more."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(12, 3)), rng.normal(size=(12, 3)) + 8])
    rows = row_arrays(cells_of(spark, x))
    found = {r["sample_id"]: r["label"] for r in reduce.graph_communities(rows, 4, resolution=0.2).collect()}
    assert len({found[f"S{i:02d}"] for i in range(12)}) == 1 == len({found[f"S{i:02d}"] for i in range(12, 24)}) and len(set(found.values())) == 2
    assert reduce.graph_communities(rows, 4, resolution=3.0).select("label").distinct().count() > 2
    w = rng.integers(0, 3, (6, 6))
    w = w + w.T
    label = [0, 0, 1, 1, 2, 2]
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(6) for j in range(6) if w[i, j]], "a string, b string, w double")
    k, two = w.sum(1), w.sum()
    want = sum((w[i, j] - 0.7 * k[i] * k[j] / two) / two for i in range(6) for j in range(6) if label[i] == label[j])
    assert reduce.modularity(edges, spark.createDataFrame([(str(i), str(v)) for i, v in enumerate(label)], "node string, label string"), 0.7) == pytest.approx(want)


def test_stability_and_report(spark, batches):
    x, *_, obs = batches
    rng = np.random.default_rng(14)
    y = np.concatenate([rng.normal(size=(10, 2)), rng.normal(size=(10, 2)) + 20])
    points = row_arrays(cells_of(spark, y)).select("sample_id", "vec").withColumn("label", F.when(F.col("sample_id") < "S10", "a").otherwise("b"))
    assert metrics.clustering_stability(points, lambda p: reduce.kmeans(p, 2), subsamples=2) == pytest.approx(1.0)
    report = autoselect.integration_report(cells_of(spark, x), obs, k=6)
    assert set(report) == {"batch_asw", "batch_mixing", "lisi", "kbet", "ilisi"} and all(np.isfinite(v) for v in report.values())


@pytest.mark.parametrize("mechanism", ["mcar", "mar", "mnar"])
def test_benchmark_data(spark, mechanism):
    ds = synthetic.benchmark_data(spark, mechanism=mechanism, rate=0.25, confounded=1.0, n_samples=20, n_features=30, n_batches=2)
    raw, truth = ds.layer("proteins", "raw"), ds.layer("proteins", "truth")
    both = raw.select("sample_id", "feature_id", F.col("value").alias("x")).join(truth, ["sample_id", "feature_id"]).collect()
    lost = [r["value"] for r in both if r["x"] is None]
    assert len(lost) == pytest.approx(150, abs=2) and all(r["x"] in (None, r["value"]) for r in both)
    assert (np.median(lost) < 0.7 * np.median([r["value"] for r in both])) == (mechanism == "mnar")
    assert ds.obs.where("group <> replace(batch, 'batch', 'group')").count() == 0


@pytest.mark.parametrize("name", ["minprob", "lls", "bpca", "iterative_svd", "softimpute", "mechanism"])
def test_cells_are_computed_once(spark, name):
    x = np.random.default_rng(8).normal(size=(12, 6))
    x[np.random.default_rng(9).random(x.shape) < 0.2] = np.nan
    met = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            met.add(len(f))
            yield f

    cells = cells_of(spark, x)
    cells = cells.mapInPandas(counted, cells.schema)
    if name == "mechanism":
        impute.missing_mechanism(cells)
    else:
        assert impute.IMPUTERS[name](cells, **({} if name == "minprob" else {"max_iter": 2})).where("value is null").count() == 0
    assert met.value == x.size


def test_reconstruction_computes_its_pairs_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            met.add(len(f))
            yield f

    pairs = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(40)], "truth double, imputed double")
    assert benchmarks.reconstruction(pairs.mapInPandas(counted, pairs.schema)).first()["n"] == 40 and met.value == 40

"""Automatic selection of methods: run candidates of a stage, score them, pass the best layer on.

Each candidate's layer is computed once and written; its scores are Spark jobs that read it. A stage's choice weighs quality against run time by a strategy.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import benchmarks, metrics, preservation
from ..functions.quantiles import quantiles
from ..model import Dataset
from ..operators import impute, integrate, normalize
from ..operators.matrix import row_arrays
from ..operators.reduce import kmeans, pca
from ..storage import materialize, once

#: Weight of quality and of run time.
STRATEGIES = {"quality": (1.0, 0.0), "balanced": (0.85, 0.15), "speed": (0.65, 0.35)}
STAGES = ("normalize", "impute", "integrate", "reduce", "cluster")


@dataclass
class Result:
    method: str
    scores: dict[str, float] = field(default_factory=dict)
    quality: float = 0.0
    seconds: float = 0.0
    selection: float = 0.0
    error: str = ""
    repeats: int = 1
    low: float = 0.0  # bounds of the quality over repeats
    high: float = 0.0


@dataclass
class StageReport:
    stage: str
    best: str
    results: list[Result]
    note: str = ""


@dataclass
class Report:
    stages: list[StageReport]

    def rows(self, spark: SparkSession) -> DataFrame:
        found = [(s.stage, r.method, r.method == s.best, float(r.quality), r.seconds, float(r.selection), json.dumps(r.scores), r.error, r.repeats, float(r.low), float(r.high)) for s in self.stages for r in s.results]
        return spark.createDataFrame(found, "stage string, method string, best boolean, quality double, seconds double, selection double, scores string, error string, repeats int, low double, high double")

    def save(self, path: str, form: str = "json") -> None:
        """Write json, csv or markdown."""
        lines = [(s.stage, r.method, "yes" if r.method == s.best else "", f"{r.quality:.4f}", f"{r.seconds:.2f}", f"{r.selection:.4f}") for s in self.stages for r in s.results]
        head = ("stage", "method", "best", "quality", "seconds", "selection")
        if form == "json":
            text = json.dumps([asdict(s) for s in self.stages], indent=1)
        elif form == "csv":
            text = "\n".join(",".join(x) for x in (head, *lines)) + "\n"
        elif form == "markdown":
            text = "\n".join("| " + " | ".join(x) + " |" for x in (head, ("---",) * 6, *lines)) + "\n"
        else:
            raise ValidationError(f"form is json, csv or markdown, not {form!r}")
        Path(path).write_text(text)


def _one(df: DataFrame) -> float:
    value = df.first()[0]
    return 0.0 if value is None or math.isnan(value) else float(value)


def labels_of(obs: DataFrame, column: str | None) -> DataFrame | None:
    """(sample_id, label) of a column, or None where it isn't there or hasn't two values."""
    if column is None or column not in obs.columns:
        return None
    labels = obs.select("sample_id", F.col(column).cast("string").alias("label")).where("label is not null")
    return labels if labels.select("label").distinct().limit(2).count() == 2 else None


def _mean(*values: float) -> float:
    return float(np.clip(np.mean(values), 0, 1))


def normalization_scores(before: DataFrame, after: DataFrame, obs: DataFrame, group: str | None = "group", batch: str | None = "batch") -> dict[str, float]:
    """Four scores that select, batches removed, biology kept, technical quality and the balance of the first two, and the nine they are of.

    Without batches their removal is 0; without groups the evenness of CVs and the likeness of samples stand for what needs them, and
    k-means for their clusters.
    """
    groups, batches = labels_of(obs, group), labels_of(obs, batch)
    before, after = once(before), once(after)
    points = materialize(preservation.filled_points(after))
    names = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: i.cast("string"))
    signal = preservation.signal_preservation(before, after)
    s = {"signal_preservation": signal, "loading_bias_reduction": _one(preservation.loading_bias_reduction(before, after))}
    if batches is None:
        s |= {"technical_variance": 0.0, "batch_asw": 0.0, "batch_mixing": 0.0}
    else:
        rows = points.select("sample_id", names.alias("names"), "vec")
        s["technical_variance"] = _one(preservation.technical_variance(before, after, batches))
        s["batch_asw"] = 1 - preservation.label_width(points.join(batches, "sample_id"))
        s["batch_mixing"] = _one(preservation.label_variety(rows, batches, 30))
    if groups is None:
        n = points.count()
        k = min(max(2, int(math.sqrt(n / 2))), n - 1)
        found = points.join(kmeans(points, k), "sample_id") if k >= 2 else None
        quality = 0.0 if found is None else (preservation.label_width(found) + _one(metrics.calinski_harabasz(found))) / 2
        s |= {"intragroup_variation": _one(preservation.even_variation(after)), "intergroup_preservation": signal, "bio_asw": 0.0, "clustering_quality": quality}
    else:
        own = points.join(groups, "sample_id")
        s["intragroup_variation"] = _one(preservation.intragroup_variation(after, groups))
        s["intergroup_preservation"] = _one(preservation.intergroup_preservation(before, after, groups))
        s |= {"bio_asw": preservation.label_width(own), "clustering_quality": preservation.separation(own)}
    removed = 0.0 if batches is None else _mean(s["technical_variance"], s["batch_asw"], s["batch_mixing"])
    kept = _mean(s["intergroup_preservation"], s["bio_asw"], s["clustering_quality"])
    quality = _mean(s["intragroup_variation"], s["signal_preservation"], s["loading_bias_reduction"])
    return {"batch_removal": removed, "bio_conservation": kept, "technical_quality": quality, "balance_score": float(np.clip(1 - abs(removed - kept), 0, 1))} | s


def imputation_scores(cells: DataFrame, method: Callable[[DataFrame], DataFrame], share: float = 0.05, seed: int = 42) -> dict[str, float]:
    """Hide a share of the observed cells of each state, 128 to 50,000 of them in all, impute, and compare."""
    held = materialize(benchmarks.holdout(cells, share, seed, least=128, most=50_000))
    hidden = held.withColumns({"value": F.when(~F.col("held"), F.col("value")), "mask": F.when(F.col("held"), 2).otherwise(F.col("mask"))}).drop("held")
    truth = held.where("held").select("sample_id", "feature_id", F.col("value").alias("truth"))
    pairs = truth.join(method(hidden).select("sample_id", "feature_id", F.col("value").alias("imputed")), ["sample_id", "feature_id"])
    r = benchmarks.reconstruction(pairs).first()
    return {"rmse": math.exp(-(r["nrmse"] if r["nrmse"] is not None else 10.0)), "pearson": ((r["pearson"] or 0.0) + 1) / 2, "completeness": r["coverage"] or 0.0}


def integration_scores(before: DataFrame, after: DataFrame, obs: DataFrame, batch: str, bio: str | None = None) -> dict[str, float]:
    """Batch silhouette and mixing, agreement of the features' variances, and the silhouette of groups if `bio` names their column."""
    rows, labels = row_arrays(after), obs.select("sample_id", F.col(batch).alias("label"))
    points = rows.select("sample_id", "vec")
    scores = {"batch_asw": _one(metrics.asw(points.join(labels, "sample_id"), batch=True)), "batch_mixing": _one(metrics.batch_mixing(rows, labels, 30)), "variance_preserved": _one(preservation.variance_agreement(before, after))}
    if bio is not None:
        groups = labels_of(obs, bio)
        scores["bio_asw"] = 0.0 if groups is None else _one(metrics.asw(points.join(groups, "sample_id"), batch=False))
    return scores


def integration_report(cells: DataFrame, obs: DataFrame, batch: str = "batch", k: int = 30) -> dict[str, float]:
    """All five diagnostics of batch mixing: silhouette, neighbourhood mixing, LISI, kBET and iLISI."""
    rows, labels = row_arrays(cells), obs.select("sample_id", F.col(batch).alias("label"))
    points = rows.select("sample_id", "vec").join(labels, "sample_id")
    return {
        "batch_asw": _one(metrics.asw(points, batch=True)), "batch_mixing": _one(metrics.batch_mixing(rows, labels, k)),
        "lisi": _one(metrics.lisi(rows, labels, k).agg(F.avg("lisi"))), "kbet": float(metrics.kbet(rows, labels, k)), "ilisi": float(metrics.ilisi(rows, labels, k / 3)),
    }


def clustering_potential(points: DataFrame, counts: tuple[int, ...] = (3, 5, 7, 10), seed: int = 42) -> float:
    """The best mean silhouette of (sample_id, vec) over k-means of several sizes, 0 at least."""
    n, best = points.count(), 0.0
    for k in counts:
        if k < n:
            labelled = points.join(kmeans(points, k, seed=seed), "sample_id")
            best = max(best, _one(metrics.silhouette(labelled).agg(F.avg("s"))))
    return min(1.0, best)


def reduction_scores(cells: DataFrame, scores: DataFrame, seed: int = 42) -> dict[str, float]:
    """How much variance, distances (of 1000 drawn pairs of samples), neighbours and clusters the scores keep."""
    rows = row_arrays(cells)
    names = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: i.cast("string"))
    scores = materialize(scores)
    low = scores.select("sample_id", names.alias("names"), "vec")
    total = _one(cells.groupBy("feature_id").agg(F.var_samp("value").alias("v")).agg(F.sum("v")))
    kept = _one(scores.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v")).agg(F.sum("v")))
    return {
        "variance_explained": min(1.0, kept / max(total, 1e-12) / 0.8),
        "reconstruction_error": metrics.pair_agreement(rows, low, seed=seed),
        "local_structure": _one(metrics.knn_jaccard(rows, low, 15).agg(F.avg("jaccard"))),
        "clustering_potential": clustering_potential(scores, seed=seed),
    }


def cluster_scores(points: DataFrame, cluster: Callable[[DataFrame], DataFrame]) -> dict[str, float]:
    """points (sample_id, vec, label); cluster repeats the clustering on other points."""
    return {"stability": metrics.clustering_stability(points, cluster, subsamples=3), "silhouette": _one(metrics.asw(points, batch=False)), "calinski_harabasz": _one(metrics.calinski_harabasz(points)), "davies_bouldin": _one(metrics.davies_bouldin(points))}


WEIGHTS = {
    "normalize": {"batch_removal": 0.3, "bio_conservation": 0.3, "technical_quality": 0.2, "balance_score": 0.2},
    "impute": {"rmse": 0.4, "pearson": 0.3, "completeness": 0.3},
    "integrate": {"batch_asw": 0.25, "batch_mixing": 0.25, "variance_preserved": 0.5},
    "reduce": {"variance_explained": 0.3, "reconstruction_error": 0.25, "local_structure": 0.25, "clustering_potential": 0.2},
    "cluster": {"silhouette": 0.3, "calinski_harabasz": 0.25, "davies_bouldin": 0.2, "stability": 0.25},
}


#: Weights where the column of biological groups is named.
BIO_WEIGHTS = {"batch_asw": 0.25, "batch_mixing": 0.25, "variance_preserved": 0.25, "bio_asw": 0.25}


def weighted(scores: dict[str, float], weights: dict[str, float]) -> float:
    return sum(weights[k] * scores[k] for k in weights) / sum(weights.values())


def choose(results: list[Result], strategy: str) -> str:
    """Set selection scores and name the best: quality, and run time inverted between the fastest and slowest."""
    q, r = STRATEGIES[strategy]
    good = [x for x in results if not x.error]
    if not good or all(x.quality == 0 for x in good):
        raise ValidationError("no method of this stage gave a result")
    low, high = min(x.seconds for x in good), max(x.seconds for x in good)
    for x in good:
        x.selection = min(1.0, max(0.0, q * x.quality + r * (1.0 if high == low else 1 - (x.seconds - low) / (high - low))))
    return max(good, key=lambda x: (x.selection, x.quality, x.method)).method


Evaluator = Callable[[DataFrame, DataFrame, DataFrame], dict[str, float]]
EVALUATORS: dict[str, tuple[Evaluator, dict[str, float]]] = {}


def register_evaluator(stage: str, scores: Evaluator, weights: dict[str, float]) -> None:
    """Score a stage's layers by a function of one's own: (cells before, after, obs) -> scores, which `weights` weigh."""
    if stage not in STAGES[:3]:
        raise ValidationError(f"stage is one of {STAGES[:3]}, not {stage!r}")
    EVALUATORS[stage] = scores, weights


def is_logged(ds: Dataset, assay: str, layer: str) -> bool:
    """Whether a layer is on a log scale, by its name or those it was made of."""
    made = {r.params.get("new_layer") for r in ds.history if r.action in ("log_transform", "log_transform_skipped")}
    return any(normalize.LOGGED.search(name.lower()) or name in made for name in ds.lineage(assay, layer))


def adaptive_threshold(cells: DataFrame) -> float:
    """The 95 % quantile of the features' rank frequencies, or two samples' share if that is more, within 0.01 and 0.5."""
    (high,) = quantiles(normalize.rank_invariance(cells), "frequency", [0.95])
    n = cells.select("sample_id").distinct().count()
    return 0.5 if high is None or n < 2 else min(0.5, max(0.01, high, 2 / n))


def adaptive_trqn(cells: DataFrame) -> DataFrame:
    """TRQN with a threshold that suits the layer."""
    return normalize.norm_trqn(cells, low_thr=adaptive_threshold(cells))


#: Candidates that differ from the method's default: centred layers stay where their input lies.
ADAPTED = {
    "trqn": adaptive_trqn,
    "mean": lambda cells: normalize.norm_mean(cells, add_global_mean=True),
    "median": lambda cells: normalize.norm_median(cells, add_global_median=True),
}

#: Methods that only make sense on a log scale.
LOG_ONLY = ("quantile", "trqn")


class AutoSelector:
    """Runs stages one after the other; each passes its best layer to the next.

    A method that fails is reported with its error and the others go on. With repeats, each method is scored as often, with seeds of
    its own where it hides cells; the report has the mean and the bounds that hold `confidence` of the repeats. Methods
    for log scales are compared only on layers that are logged by their name or history.
    """

    def __init__(self, *, strategy: str = "balanced", group: str = "group", batch: str = "batch", bio: str | None = None, methods: dict[str, list[str]] | None = None, repeats: int = 1, confidence: float = 0.95, include_embedding: bool = False):
        if strategy not in STRATEGIES:
            raise ValidationError(f"strategy is one of {sorted(STRATEGIES)}, not {strategy!r}")
        if repeats < 1 or not 0 < confidence < 1:
            raise ValidationError("repeats must be 1 or more, confidence in (0, 1)")
        self.strategy, self.group, self.batch, self.bio, self.repeats, self.confidence = strategy, group, batch, bio, repeats, confidence
        first = {"normalize": ["none", "median", "mean", "quantile", "trqn"], "impute": ["row_mean", "row_median", "half_row_min"], "integrate": ["none", "combat", "limma", *(["mnn", "harmony"] if include_embedding else [])], "reduce": ["pca"], "cluster": ["3", "5", "8"]}
        self.methods = first | (methods or {})

    def candidates(self, stage: str, cells: DataFrame, obs: DataFrame, logged: bool) -> dict[str, tuple[Callable[[], DataFrame], Callable[[DataFrame, int], dict[str, float]]]]:
        """For each method how to make its layer and how to score it, given the layer and a seed."""
        own = EVALUATORS.get(stage)
        if stage == "normalize":
            methods = {m: f for m, f in (normalize.NORMALIZERS | ADAPTED).items() if logged or m not in LOG_ONLY}
            score = lambda m: lambda out, seed: normalization_scores(cells, out, obs, self.group, self.batch)
            make = lambda m: lambda: methods[m](cells)
        elif stage == "impute":
            methods = impute.IMPUTERS
            score = lambda m: lambda out, seed: imputation_scores(cells, methods[m], seed=seed)
            make = lambda m: lambda: methods[m](cells)
        elif stage == "integrate":
            methods = integrate.INTEGRATORS
            score = lambda m: lambda out, seed: integration_scores(cells, out, obs, self.batch, self.bio)
            make = lambda m: lambda: methods[m].apply(cells, obs, batch=self.batch)
        elif stage == "reduce":
            methods = {"pca": None}
            score = lambda m: lambda out, seed: reduction_scores(cells, out, seed)
            make = lambda m: lambda: pca(cells, 10)["scores"]
        elif stage == "cluster":
            methods = {m: int(m) for m in self.methods[stage]}
            score = lambda m: lambda out, seed: cluster_scores(cells.join(out, "sample_id"), lambda p: kmeans(p, int(m)))
            make = lambda m: lambda: kmeans(cells, int(m))
        else:
            raise ValidationError(f"stage is one of {STAGES}, not {stage!r}")
        if own:
            score = lambda m: lambda out, seed: own[0](cells, out, obs)
        return {m: (make(m), score(m)) for m in self.methods[stage] if m in methods}

    def run_method(self, stage: str, method: str, make: Callable[[], DataFrame], score: Callable[[DataFrame, int], dict[str, float]]) -> tuple[DataFrame | None, Result]:
        weights = EVALUATORS[stage][1] if stage in EVALUATORS else BIO_WEIGHTS if stage == "integrate" and self.bio is not None else WEIGHTS[stage]
        found, layer, start = [], None, time.monotonic()
        try:
            for i in range(self.repeats):
                layer = once(make())
                found.append(score(layer, 42 + i))
        except Exception as e:  # any failure of a method is part of the report
            return None, Result(method, seconds=time.monotonic() - start, error=f"{type(e).__name__}: {e}"[:500])
        values = [weighted(s, weights) for s in found]
        tail = (1 - self.confidence) / 2
        low, high = np.quantile(values, [tail, 1 - tail])
        mean = {k: float(np.mean([s[k] for s in found])) for k in found[0]}
        return layer, Result(method, mean, float(np.mean(values)), (time.monotonic() - start) / self.repeats, repeats=self.repeats, low=float(low), high=float(high))

    def run_stage(self, stage: str, cells: DataFrame, obs: DataFrame, logged: bool = False) -> tuple[DataFrame, StageReport]:
        """cells are those of a layer; for cluster, points (sample_id, vec)."""
        cells, layers, results = once(cells), {}, []
        for m, (make, score) in self.candidates(stage, cells, obs, logged).items():
            layers[m], result = self.run_method(stage, m, make, score)
            results.append(result)
        best = choose(results, self.strategy)
        note = "" if stage != "normalize" or logged else f"not known to be logged: {', '.join(LOG_ONLY)} left out"
        return layers[best], StageReport(stage, best, results, note)

    def run(self, ds: Dataset, *, assay: str = "protein", source_layer: str = "raw", stages: tuple[str, ...] = STAGES[:3]) -> tuple[Dataset, Report]:
        """Add a layer named after each stage's choice; scores of a reduction and labels go to obs as columns `vec` and `cluster`."""
        cells, reports, name = ds.layer(assay, source_layer), [], source_layer
        for stage in stages:
            if stage == "cluster" and "vec" not in cells.columns:
                cells = row_arrays(cells).select("sample_id", "vec")
            cells, report = self.run_stage(stage, cells, ds.obs, stage == "normalize" and is_logged(ds, assay, name))
            reports.append(report)
            if stage in STAGES[:3]:
                ds = ds.with_layer(assay, f"auto_{stage}", cells, f"auto_{stage}", source_layer=name, method=report.best)
                name = f"auto_{stage}"
            else:
                column = cells if stage == "reduce" else cells.withColumnRenamed("label", "cluster")
                ds = replace(ds, obs=ds.obs.drop(*column.columns[1:]).join(column, "sample_id", "left")).log(f"auto_{stage}", {"method": report.best})
        return ds, Report(reports)


def _auto(stage: str) -> Callable[..., tuple[Dataset, StageReport]]:
    def run(ds: Dataset, *, assay: str = "protein", source_layer: str = "raw", **options) -> tuple[Dataset, StageReport]:
        out, report = AutoSelector(**options).run(ds, assay=assay, source_layer=source_layer, stages=(stage,))
        return out, report.stages[0]

    run.__doc__ = f"The best method of the stage {stage}: the data set with its result, and the report. Options are those of AutoSelector."
    run.__name__ = f"auto_{stage}"
    return run


auto_normalize, auto_impute, auto_integrate, auto_reduce, auto_cluster = map(_auto, STAGES)

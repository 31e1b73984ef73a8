"""Synthetic data: latent factors, groups, batch shifts, noise and two kinds of missing values, by hashes of ids and a seed."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.quantiles import quantiles
from ..model import Assay, Dataset, MaskCode


def noise(seed: int, *keys: str) -> Column:
    """A normal number that depends on the keys and the seed alone."""
    u = [(F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52)) for i in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def uniform(seed: int, *keys: str) -> Column:
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def generate(spark: SparkSession, *, n_samples: int = 100, n_features: int = 1000, missing_rate: float = 0.3, lod_ratio: float = 0.6, n_batches: int = 3, n_groups: int = 4, factors: int = 3, shape: str = "lognormal", seed: int = 42) -> Dataset:
    """Groups differ in a tenth of the features, batches by a shift; low values go missing rather (LOD), others at random (MBR).

    shape: lognormal, normal, multimodal or heavy_tailed values.
    """
    samples = spark.range(n_samples).select(
        F.concat(F.lit("S"), (F.col("id") + 1).cast("string")).alias("sample_id"), F.concat(F.lit("group"), (F.col("id") % n_groups).cast("string")).alias("group"), F.concat(F.lit("batch"), F.floor(F.col("id") * n_batches / n_samples).cast("string")).alias("batch")
    )
    features = spark.range(n_features).select(F.concat(F.lit("P"), (F.col("id") + 1).cast("string")).alias("feature_id"))
    latent = sum((noise(seed + 10 + k, "sample_id") * noise(seed + 50 + k, "feature_id") for k in range(factors)), F.lit(0.0)) * 0.3
    marker = F.when(uniform(seed + 1, "feature_id", "group") < 0.1, 1.0).otherwise(0.0)
    level = 8 + 1.5 * noise(seed + 2, "feature_id") + latent + marker + 0.4 * noise(seed + 3, "batch", "feature_id")
    spread = 0.2 + 0.2 * F.abs(noise(seed + 4, "feature_id"))
    x = level + spread * noise(seed + 5, "sample_id", "feature_id")
    if shape == "multimodal":
        x = x + F.when(uniform(seed + 6, "sample_id", "feature_id") < 0.5, 2.0).otherwise(0.0)
    if shape == "heavy_tailed":
        x = x + spread * F.tan(math.pi * (uniform(seed + 7, "sample_id", "feature_id") - 0.5)) * 0.5
    grid = samples.crossJoin(F.broadcast(features)).withColumn("x", x)
    low = missing_rate * lod_ratio * 2 / (1 + F.exp(1.5 * (F.col("x") - 8)))
    state = F.when(uniform(seed + 8, "sample_id", "feature_id") < low, int(MaskCode.LOD)).when(uniform(seed + 9, "sample_id", "feature_id") < missing_rate * (1 - lod_ratio), int(MaskCode.MBR)).otherwise(0)
    value = F.col("x") if shape == "normal" else F.exp(F.col("x"))
    cells: DataFrame = grid.withColumn("mask", state).select("sample_id", "feature_id", F.when(F.col("mask") == 0, value).alias("value"), "mask")
    return Dataset(samples, {"proteins": Assay(features, {"raw": cells})}).log("generate", {"assay": "proteins", "new_layer": "raw", "seed": seed})


def benchmark_data(spark: SparkSession, *, mechanism: str = "mnar", rate: float = 0.3, confounded: float = 0.0, **options) -> Dataset:
    """Complete data as layer `truth`, and `raw` with a share of the values missing.

    mcar: at random; mar: rather in samples of later batches; mnar: rather low values. confounded, 0 to 1: the share of
    samples whose group is that of their batch. Other options are those of `generate`.
    """
    if mechanism not in ("mcar", "mar", "mnar") or not 0 <= rate < 1 or not 0 <= confounded <= 1:
        raise ValidationError("mechanism is mcar, mar or mnar, rate in [0, 1), confounded in [0, 1]")
    ds = generate(spark, missing_rate=0.0, **options)
    seed = options.get("seed", 42)
    obs = ds.obs.withColumn("group", F.when(uniform(seed + 20, "sample_id") < confounded, F.replace("batch", F.lit("batch"), F.lit("group"))).otherwise(F.col("group")))
    truth = ds.layer("proteins", "raw")
    n = truth.count()
    if mechanism == "mcar":
        ranked = truth.withColumn("x", uniform(seed + 21, "sample_id", "feature_id"))
    elif mechanism == "mar":
        ranked = truth.join(obs.select("sample_id", "batch"), "sample_id").withColumn("x", uniform(seed + 21, "sample_id", "feature_id") - 0.3 * F.regexp_extract("batch", r"(\d+)$", 1).cast("int")).drop("batch")
    else:
        spread = truth.agg(F.stddev_samp("value")).first()[0] or 1.0
        ranked = truth.withColumn("x", F.col("value") + 0.3 * spread * noise(seed + 21, "sample_id", "feature_id"))
    cut = quantiles(ranked, "x", [rate])[0] if n else 0.0
    lost = F.col("x") < F.lit(cut)
    code = int(MaskCode.LOD if mechanism == "mnar" else MaskCode.UNCERTAIN)
    raw = ranked.select("sample_id", "feature_id", F.when(~lost, F.col("value")).alias("value"), F.when(lost, code).otherwise(F.col("mask")).alias("mask"))
    return replace(ds, obs=obs).with_layer("proteins", "truth", truth).with_layer("proteins", "raw", raw, "benchmark_data", mechanism=mechanism, rate=rate)

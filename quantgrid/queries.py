"""Registered queries of the quantification operators, each with its SQL where SQL can express it.

Doubles are rounded alike on both sides, so that sums taken in another order compare equal. Means of prices are often exact
halves of the last digit, which such sums put on either side; ASIDE moves both sides off that edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import complete
from .functions import benchmarks, metrics, preservation, stats
from .operators import aggregate, impute, integrate, linkage, masks, normalize, qc, reduce, umap
from .operators.matrix import by_sample, row_arrays
from .operators.neighbors import nearest
from .functions import custom
from .model import chosen
from .plans import autoselect, plots
from .plans import matrices as m
from .sources import tables
from .storage import delete_at_exit, shared_dir
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES = {"cells": m.CELLS_SQL, "peptides": m.PEPTIDES_SQL, "links": m.LINKS_SQL, "obs": m.OBS_SQL, "grid": m.GRID_SQL, "logged": m.LOGGED_SQL, "proteins": m.PROTEINS_SQL}
CELL_COLUMNS = "sample_id feature_id value:d mask"


ASIDE = 1e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(c) + ASIDE, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(name: str, columns: str = "", sql: str = "", uses: str = "", more: str = "") -> Callable[[Query], Query]:
    """Register a query. columns lists its output, :d after doubles; uses names the common tables of its SQL, more adds others."""

    def put(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = rounded(fn(spark, sf_dir))
            return out.select(*(c.removesuffix(":d") for c in columns.split())) if columns else out

        QUERIES[name] = run
        if sql:
            tables = [CTES[u] for u in uses.split()] + ([more] if more else [])
            picked = ", ".join(f"round({c[:-2]} + {ASIDE}, 6) + 0.0 as {c[:-2]}" if c.endswith(":d") else c for c in columns.split())
            head = f"with {', '.join(tables)} " if tables else ""
            ORACLES[name] = f"{head}select {picked} from ({sql}) as result"
        return fn

    return put


def simple(name: str, op: Callable[[DataFrame], DataFrame], columns: str, sql: str, uses: str = "cells", more: str = "", source: str = "cells") -> None:
    """A query on one of the sources: cells, grid (all pairs), logged, peptides or proteins."""
    query(name, columns, sql, uses, more)(lambda spark, sf: op(SOURCES[source](spark, sf)))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return complete(m.cells(spark, sf))


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.aggregate_to_protein(m.peptides(spark, sf), m.links(spark, sf), "mean")


def sparse_proteins(spark: SparkSession, sf: str) -> DataFrame:
    """Logged proteins; one in eight cells is hidden by a hash of its ids."""
    hidden = F.pmod(F.xxhash64("sample_id", "feature_id"), F.lit(8)) == 0
    return normalize.log_transform(proteins(spark, sf)).withColumn("value", F.when(~hidden, F.col("value")))


SOURCES: dict[str, Query] = {"cells": m.cells, "peptides": m.peptides, "grid": grid, "proteins": proteins, "logged": lambda s, d: normalize.log_transform(m.cells(s, d))}

# masks and states
simple("mask_filter", lambda c: masks.filter_by_mask(c, (0, 1)), CELL_COLUMNS, "select sample_id, feature_id, case when mask in (0, 1) then value end as value, case when mask in (0, 1) then mask else 3 end as mask from cells")
simple("mask_apply_zero", lambda c: masks.apply_mask(c, "zero"), CELL_COLUMNS, "select sample_id, feature_id, case when mask = 0 then value else 0.0 end as value, mask from cells")
simple("mask_apply_null", lambda c: masks.apply_mask(c, "null"), CELL_COLUMNS, "select sample_id, feature_id, case when mask = 0 then value end as value, mask from cells")
simple("mask_mark_outliers", lambda c: masks.mark(c, c.where("value > 90000"), 4), CELL_COLUMNS, "select sample_id, feature_id, value, case when value > 90000 then 4 else mask end as mask from cells")
simple("mask_threshold", lambda c: masks.threshold_mask(c, 50000.0, ">="), "sample_id feature_id hit", "select sample_id, feature_id, coalesce(value >= 50000, false) as hit from grid", "cells grid", source="grid")
simple("mask_count_above", lambda c: masks.count_above(c, 50000.0), "feature_id n_above", "select feature_id, count(*) filter (value > 50000) as n_above from cells group by feature_id")
simple("mask_keep_by_count", lambda c: masks.keep_by_count(c, 50000.0, 15), CELL_COLUMNS, "select * from cells where feature_id in (select feature_id from cells group by 1 having count(*) filter (value > 50000) >= 15)")
simple("mask_statistics", masks.mask_statistics, "mask n percent:d", "select cast(code as integer) as mask, count(mask) as n, count(mask) * 100.0 / (select count(*) from grid) as percent from range(7) t(code) left join grid on mask = code group by code", "cells grid", source="grid")
_RATES = ", ".join(f"count(*) filter (mask = {c}) as n_{n}, count(*) filter (mask = {c}) * 1.0 / count(*) as {n}_rate" for n, c in masks.CODES.items())
_STATE = f"select sample_id, count(*) as n_cells, {_RATES}, count(*) filter (mask = 0) * 1.0 / count(*) as direct_rate, count(*) filter (mask <= 1) * 1.0 / count(*) as supported_rate, count(*) filter (mask >= 3) * 1.0 / count(*) as uncertainty_burden from grid group by sample_id"
_STATE_COLUMNS = "sample_id n_cells " + " ".join(f"n_{n} {n}_rate:d" for n in masks.CODES) + " direct_rate:d supported_rate:d uncertainty_burden:d"
simple("state_metrics", lambda c: masks.state_metrics(c, "sample_id"), _STATE_COLUMNS, _STATE, "cells grid", source="grid")


@query(
    "state_transition",
    "direct_rate:d reference_direct_rate:d delta_direct_rate:d filtered_rate:d delta_filtered_rate:d",
    "select d as direct_rate, d as reference_direct_rate, 0.0 as delta_direct_rate, f as filtered_rate, f as delta_filtered_rate from (select avg(case when mask = 0 then 1.0 else 0.0 end) as d, avg(case when mask > 1 then 1.0 else 0.0 end) as f from cells)",
    "cells",
)
def state_transition(spark: SparkSession, sf: str) -> DataFrame:
    c = m.cells(spark, sf)
    return masks.state_transition(masks.filter_by_mask(c, (0, 1)), c)


@query("mask_combine_majority", "sample_id feature_id flag", "select sample_id, feature_id, (mask <> 0)::int + (value > 40000)::int + (value < 80000)::int >= 2 as flag from cells", "cells")
def mask_combine(spark: SparkSession, sf: str) -> DataFrame:
    c = m.cells(spark, sf)
    other = [masks.mark(c.withColumn("mask", F.lit(0)), c.where(p), 4) for p in ("value > 40000", "value < 80000")]
    return masks.combine_masks([c, *other], "majority")


# aggregation
def protein(method: str, sql: str, uses: str = "peptides links", **params) -> None:
    joined = "j as (select sample_id, target_id as protein, feature_id, value, mask from peptides join links on feature_id = source_id), med as (select feature_id, median(value) as med from peptides group by 1)"
    name = f"aggregate_{method}"
    query(name, CELL_COLUMNS, sql, uses, joined)(lambda s, d: aggregate.aggregate_to_protein(m.peptides(s, d), m.links(s, d), method, **params))


for _method, _fn in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("max", "max")):
    protein(_method, f"select sample_id, protein as feature_id, {_fn}(value) as value, max(mask) as mask from j group by 1, 2")
protein("weighted_mean", "select sample_id, protein as feature_id, sum(value * med) / sum(med) as value, max(mask) as mask from j join med using (feature_id) group by 1, 2")
protein("top_n", "select sample_id, protein as feature_id, median(value) as value, max(mask) as mask from j join (select feature_id, row_number() over (partition by target_id order by med desc, feature_id desc) as place from med join links on feature_id = source_id) using (feature_id) where place <= 3 group by 1, 2")
protein("ibaq", "select sample_id, protein as feature_id, sum(value) / max(n) as value, max(mask) as mask from j join (select target_id, count(*) as n from links group by 1) on target_id = protein group by 1, 2")
query("aggregate_tmp")(lambda s, d: aggregate.aggregate_to_protein(m.peptides(s, d), m.links(s, d), "tmp"))
query("aggregate_maxlfq")(lambda s, d: aggregate.aggregate_to_protein(m.peptides(s, d), m.links(s, d), "maxlfq"))
query("pair_ratios", "protein a b ratio:d n", "select x.protein, x.sample_id as a, y.sample_id as b, median(ln(y.value) - ln(x.value)) as ratio, count(*) as n from j x join j y on x.protein = y.protein and x.feature_id = y.feature_id and x.sample_id < y.sample_id group by 1, 2, 3 having count(*) >= 2", "peptides links", "j as (select sample_id, target_id as protein, feature_id, value from peptides join links on feature_id = source_id)")(
    lambda s, d: aggregate.pair_ratios(m.peptides(s, d).join(m.links(s, d).toDF("feature_id", "protein"), "feature_id").select("protein", "feature_id", "sample_id", F.log("value").alias("x")), 2)
)

# quality control
_SAMPLES = "metrics as (select sample_id, count(*) filter (mask = 0 and value is not null) as n_features, coalesce(sum(value), 0.0) as total_intensity, ln(1 + coalesce(sum(value), 0.0)) as log1p_total_intensity from cells group by 1)"
simple("qc_sample_metrics", qc.sample_metrics, "sample_id n_features total_intensity:d log1p_total_intensity:d", "select * from metrics", more=_SAMPLES)
_FEATURES = "features as (select feature_id, 1 - count(*) filter (mask = 0) / (select count(*) from supplier) as missing_rate, count(*) filter (mask = 0) / (select count(*) from supplier) as detection_rate, avg(value) as mean_expression, stddev_pop(value) / avg(value) as cv from cells group by 1)"
_FEATURE_COLUMNS = "feature_id missing_rate:d detection_rate:d mean_expression:d cv:d"


def feature_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return qc.feature_metrics(m.cells(spark, sf), m.read(spark, sf, "supplier").count())


query("qc_feature_metrics", _FEATURE_COLUMNS, "select * from features", "cells", _FEATURES)(feature_metrics)
query("qc_features_by_missingness", _FEATURE_COLUMNS, "select * from features where missing_rate <= 0.93", "cells", _FEATURES)(lambda s, d: qc.by_missingness(feature_metrics(s, d), 0.93))
query("qc_features_by_cv", _FEATURE_COLUMNS, "select * from features where cv <= 0.6", "cells", _FEATURES)(lambda s, d: qc.by_cv(feature_metrics(s, d), 0.6))
_MAD = "b as (select median({c}) as med from metrics), w as (select 1.4826 * median(abs({c} - med)) as mad from metrics, b)"
simple("qc_low_quality_samples", lambda c: qc.low_quality_samples(c, min_features=100, nmads=1.0), "sample_id n_features keep", "select sample_id, n_features, n_features >= 100 and not (case when mad = 0 then n_features <> med else n_features < med - mad end) as keep from metrics, b, w", more=f"{_SAMPLES}, {_MAD.format(c='n_features')}")
simple("qc_doublets", lambda c: qc.doublets(c, nmads=1.0), "sample_id log1p_total_intensity:d keep", "select sample_id, log1p_total_intensity, not (case when mad = 0 then log1p_total_intensity <> med else log1p_total_intensity > med + mad end) as keep from metrics, b, w", more=f"{_SAMPLES}, {_MAD.format(c='log1p_total_intensity')}")
simple("qc_sample_cv", lambda c: qc.sample_cv(c, 0.6), "sample_id cv:d is_high_cv", "select sample_id, stddev_pop(value) / avg(value) as cv, coalesce(stddev_pop(value) / avg(value) > 0.6, false) as is_high_cv from cells group by 1")
simple("qc_detection_stats", lambda c: qc.detection_stats(c, "sample_id", 1000, (0, 1)), "sample_id n_detected detection_rate:d mean_detected:d", "select sample_id, count(*) filter (mask in (0, 1)) as n_detected, count(*) filter (mask in (0, 1)) / 1000 as detection_rate, avg(value) filter (mask in (0, 1)) as mean_detected from cells group by 1")
query("qc_batch_effects", "batch n_cells median_features:d std_features:d median_intensity:d", "select batch, count(*) as n_cells, median(n_features) as median_features, stddev_samp(n_features) as std_features, median(total_intensity) as median_intensity from metrics join obs using (sample_id) group by 1", "cells obs", _SAMPLES)(lambda s, d: qc.batch_effects(m.cells(s, d), m.obs(s, d)))
query("qc_preflight")(lambda s, d: qc.preflight(m.cells(s, d))["cells"])
_RUN = "o as (select sample_id, grp, row_number() over (partition by grp order by md5('42' || sample_id), sample_id) as place from obs), f as (select grp, feature_id, min(place) as place from cells join o using (sample_id) where mask = 0 group by 1, 2), n as (select grp, place, count(*) as new from f group by 1, 2)"
query("qc_cumulative_sensitivity", "grp place n_union", 'select o.grp, cast(o.place as integer) as place, cast(sum(coalesce(new, 0)) over (partition by o.grp order by o.place) as bigint) as n_union from o left join n on o.grp = n.grp and o.place = n.place', "cells obs", _RUN)(lambda s, d: qc.cumulative_sensitivity(m.cells(s, d), m.obs(s, d)).withColumnRenamed("group", "grp"))


# PSM scores: the discount of a line stands for its error probability
def psms(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("pep"), F.col("l_tax").alias("pif"))


_PEP = "p as (select l_orderkey, l_linenumber, l_discount as pep from lineitem), c as (select pep, count(*) as n from p group by 1), u as (select pep, sum(n) over (order by pep) as upto, (select count(*) from p) as total from c), q as (select pep, least(1.0, min(pep * {share} * total / upto) over (order by pep rows between current row and unbounded following)) as q_value from u)"
_PEP_SQL = "select l_orderkey, l_linenumber, q_value from p join q using (pep)"
query("psm_qvalue_bh", "l_orderkey l_linenumber q_value:d", _PEP_SQL, "", _PEP.format(share="1.0"))(lambda s, d: qc.q_values(psms(s, d), "pep", "bh"))
query("psm_qvalue_storey", "l_orderkey l_linenumber q_value:d", _PEP_SQL, "", _PEP.format(share="(select least(greatest(count(*) filter (pep > 0.05) / (count(*) * 0.95), 1.0 / count(*)), 1.0) from p)"))(lambda s, d: qc.q_values(psms(s, d), "pep", "storey", 0.05))
query("psm_by_qvalue", "l_orderkey l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_discount < 0.01")(lambda s, d: qc.by_qvalue(psms(s, d), "pep", 0.01))
query("psm_by_purity", "l_orderkey l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_tax >= 0.06")(lambda s, d: qc.by_purity(psms(s, d), "pif", 0.06))
query("psm_contaminants", "p_partkey p_name hit", "select p_partkey, p_name, regexp_matches(p_name, '(^red)|(gadget$)') as hit from part")(lambda s, d: m.read(s, d, "part").select("p_partkey", "p_name", qc.contaminant(F.col("p_name"), ("^red", "gadget$")).alias("hit")))

# normalization
simple("norm_median", normalize.norm_median, CELL_COLUMNS, "select sample_id, feature_id, value - median(value) over (partition by sample_id) as value, mask from logged", "cells logged", source="logged")
simple("norm_median_global", lambda c: normalize.norm_median(c, add_global_median=True), CELL_COLUMNS, "select sample_id, feature_id, value - median(value) over (partition by sample_id) + (select median(value) from logged) as value, mask from logged", "cells logged", source="logged")
simple("norm_mean", normalize.norm_mean, CELL_COLUMNS, "select sample_id, feature_id, value - avg(value) over (partition by sample_id) as value, mask from logged", "cells logged", source="logged")
simple("norm_mean_global", lambda c: normalize.norm_mean(c, add_global_mean=True), CELL_COLUMNS, "select sample_id, feature_id, value - avg(value) over (partition by sample_id) + (select avg(value) from logged) as value, mask from logged", "cells logged", source="logged")
simple("norm_none", normalize.norm_none, CELL_COLUMNS, "select * from cells")


def quantile_sql(source: str, name: str) -> str:
    """Common tables for the quantile normalization of `source`; the last one is `name`."""
    return (
        f"{name}_r as (select *, row_number() over (partition by sample_id order by value, feature_id) - 1 as place from {source} where value is not null), "
        f"{name}_l as (select place, avg(value) as level from {name}_r group by 1), "
        f"{name}_t as (select *, (min(place) over (partition by sample_id, value) + max(place) over (partition by sample_id, value)) / 2 as spot from {name}_r), "
        f"{name} as (select sample_id, feature_id, a.level + (spot - floor(spot)) * (b.level - a.level) as value, mask from {name}_t join {name}_l a on a.place = cast(floor(spot) as bigint) join {name}_l b on b.place = cast(ceil(spot) as bigint))"
    )


simple("norm_quantile", normalize.norm_quantile, CELL_COLUMNS, "select * from qn", "cells logged", quantile_sql("logged", "qn"), "logged")
_INV = "f as (select feature_id, max(n) / sum(n) as frequency from (select feature_id, place, count(*) as n from (select feature_id, row_number() over (partition by sample_id order by value desc, feature_id) as place from {0}) group by 1, 2) group by 1)"
simple("rank_invariance", normalize.rank_invariance, "feature_id frequency:d", "select * from f", "peptides links proteins", _INV.format("proteins"), "proteins")
_TRQN = f"{quantile_sql('proteins', 'qn')}, {_INV.format('qn')}, k as (select feature_id from f where frequency >= 0.08), v as (select feature_id, median(value) as m from proteins join k using (feature_id) group by 1), d as (select sample_id, feature_id, value - m as value, mask from proteins join v using (feature_id)), {quantile_sql('d', 'e')}"
simple("norm_trqn", lambda c: normalize.norm_trqn(c, low_thr=0.08), CELL_COLUMNS, "select * from qn where feature_id not in (select feature_id from k) union all select sample_id, feature_id, value + m as value, mask from e join v using (feature_id)", "peptides links proteins", _TRQN, "proteins")
simple("zscore", normalize.zscore, CELL_COLUMNS, "select sample_id, feature_id, (value - avg(value) over f) / coalesce(nullif(stddev_samp(value) over f, 0), 1) as value, mask from proteins window f as (partition by feature_id)", "peptides links proteins", source="proteins")
simple("robust_scale", normalize.robust_scale, CELL_COLUMNS, "select sample_id, feature_id, (value - quantile_cont(value, 0.5) over f) / coalesce(nullif(quantile_cont(value, 0.75) over f - quantile_cont(value, 0.25) over f, 0), 1) as value, mask from cells window f as (partition by feature_id)")
simple("log_transform", normalize.log_transform, CELL_COLUMNS, "select * from logged", "cells logged")

# imputation
_FILL = "select sample_id, feature_id, coalesce(value, {0}) as value, case when value is null then 5 else mask end as mask from grid"
_S, _F = "over (partition by sample_id)", "over (partition by feature_id)"
for _name, _fn, _sql in (
    ("zero", impute.impute_zero, "0.0"), ("row_mean", impute.impute_row_mean, f"avg(value) {_S}"), ("row_median", impute.impute_row_median, f"median(value) {_S}"),
    ("half_row_min", impute.impute_half_row_min, f"0.5 * min(value) {_S}"), ("missforest", impute.impute_missforest, f"avg(value) {_F}"),
):
    simple(f"impute_{_name}", _fn, CELL_COLUMNS, _FILL.format(_sql), "cells grid", source="grid")
simple("impute_none", impute.impute_none, CELL_COLUMNS, "select * from grid", "cells grid", source="grid")
_KNN = (
    "p as (select a.sample_id, b.sample_id as other, sqrt(avg((a.value - b.value) * (a.value - b.value))) as distance from cells a join cells b on a.feature_id = b.feature_id and a.sample_id <> b.sample_id group by 1, 2), "
    "n as (select * from (select *, row_number() over (partition by sample_id order by distance, other) as place from p) where place <= 16), "
    "h as (select g.sample_id, g.feature_id, c.value as v, row_number() over (partition by g.sample_id, g.feature_id order by distance, n.other) as i from grid g join n on g.sample_id = n.sample_id join cells c on c.sample_id = n.other and c.feature_id = g.feature_id where g.value is null), "
    "w as (select sample_id, feature_id, avg(v) as new from h where i <= 5 group by 1, 2)"
)
simple("impute_knn", impute.impute_knn, CELL_COLUMNS, "select sample_id, feature_id, coalesce(g.value, new, avg(g.value) over (partition by feature_id)) as value, case when g.value is null then 5 else mask end as mask from grid g left join w using (sample_id, feature_id)", "cells grid", _KNN, "grid")
for _name, _rounds in (("minprob", {}), ("qrilc", {}), ("iterative_svd", {}), ("softimpute", {}), ("bpca", {}), ("lls", {})):
    query(f"impute_{_name}")(lambda s, d, fn=impute.IMPUTERS[_name], o=_rounds: fn(sparse_proteins(s, d), **o))


@query("missing_mechanism")
def missing_mechanism(spark: SparkSession, sf: str) -> DataFrame:
    kind, stats = impute.missing_mechanism(grid(spark, sf))
    return spark.createDataFrame([(kind, stats["missing_rate"])], "mechanism string, missing_rate double")


@query("flagship_chain", CELL_COLUMNS, "select sample_id, feature_id, coalesce(value, 0.0) as value, mask from (select sample_id, feature_id, v - median(v) over (partition by sample_id) as value, mask from (select *, ln(value + 1) / ln(2) as v from (select sample_id, target_id as feature_id, sum(value) as value, max(mask) as mask from peptides join links on feature_id = source_id group by 1, 2)))", "peptides links")
def flagship_chain(spark: SparkSession, sf: str) -> DataFrame:
    summed = aggregate.aggregate_to_protein(m.peptides(spark, sf), m.links(spark, sf), "sum")
    return impute.impute_row_median(normalize.norm_median(normalize.log_transform(summed)))


# joins and pairs
query("jaccard_samples", "a b jaccard:d", "select a, b, t.n / (p.n + q.n - t.n) as jaccard from (select x.sample_id as a, y.sample_id as b, count(*) as n from s x join s y on x.feature_id = y.feature_id and x.sample_id < y.sample_id group by 1, 2) t join z p on a = p.sample_id join z q on b = q.sample_id", "cells", "s as (select sample_id, feature_id from cells where mask = 0), z as (select sample_id, count(*) as n from s group by 1)")(lambda s, d: plots.jaccard(m.cells(s, d)))
_PAIRS = "pairs as (select x.sample_id as a, y.sample_id as b, x.value as x, y.value as y, x.mask as mx, y.mask as my from cells x join cells y on x.feature_id = y.feature_id and x.sample_id < y.sample_id)"
query("mask_mismatch", "a b rate:d", "select a, b, avg(case when mx <> my then 1.0 else 0.0 end) as rate from pairs group by 1, 2", "cells", _PAIRS)(lambda s, d: plots.mask_mismatch(m.cells(s, d)))
query("sample_distances", "a b distance:d", "select a, b, sqrt(avg((x - y) * (x - y))) as distance from pairs group by 1, 2", "cells", _PAIRS)(lambda s, d: plots.dendrogram(m.cells(s, d)))
query("neighbors", "sample_id other place distance:d", "select sample_id, other, cast(place as integer) as place, distance from (select *, row_number() over (partition by sample_id order by distance, other) as place from (select a.sample_id, b.sample_id as other, sqrt(avg((a.value - b.value) * (a.value - b.value))) as distance from cells a join cells b on a.feature_id = b.feature_id and a.sample_id <> b.sample_id group by 1, 2)) where place <= 10", "cells")(lambda s, d: nearest(row_arrays(m.cells(s, d)), 10))
_CORR = "pairs as (select x.feature_id as a, y.feature_id as b, corr(x.value, y.value) as r from {0} x join {0} y on x.sample_id = y.sample_id and x.feature_id < y.feature_id group by 1, 2)"
simple("correlation_pearson", stats.correlation_pairs, "a b r:d", "select a, b, coalesce(r, 0.0) as r from pairs", "peptides links proteins", _CORR.format("proteins"), "proteins")
simple("correlation_spearman", lambda c: stats.correlation_pairs(c, method="spearman"), "a b r:d", "select a, b, coalesce(r, 0.0) as r from pairs", "peptides links proteins", "ranked as (select sample_id, feature_id, rank() over (partition by feature_id order by value) + (count(*) over (partition by feature_id, value) - 1) / 2 as value from proteins), " + _CORR.format("ranked"), "proteins")
simple("axis_stats", lambda c: stats.axis_stats(c, "feature_id"), "feature_id total:d mean:d variance:d", "select feature_id, coalesce(sum(value), 0.0) as total, coalesce(avg(value), 0.0) as mean, coalesce(var_samp(value), 0.0) as variance from logged group by 1", "cells logged", source="logged")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "embeddings")


@query("cosine_pairs", "a b similarity:d", "select x.vec_id as a, y.vec_id as b, list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) as similarity from embeddings x join embeddings y on y.vec_id = x.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    right = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return v.join(right, F.col("b") == F.col("vec_id") + 1).select(F.col("vec_id").alias("a"), "b", stats.cosine(F.col("embedding"), F.col("other")).alias("similarity"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


_POINTS = "x as (select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings)"
_DISP = f"{_POINTS}, c as (select label, i, count(*) as n, avg(v) as m, var_pop(v) as s from x group by 1, 2), g as (select i, avg(v) as gm from x group by 1), t as (select sum(n * s) as within_ss, sum(n * (m - gm) * (m - gm)) as between_ss from c join g using (i)), k as (select count(*) as n, count(distinct label) as k from embeddings)"
query("calinski_harabasz", "score:d", "select f / (f + 100) as score from (select (between_ss / (k - 1)) / (within_ss / (n - k)) as f from t, k)", "", _DISP)(lambda s, d: metrics.calinski_harabasz(labelled(s, d)))
query("silhouette", "sample_id s:d", "select cast(vec_id as varchar) as sample_id, coalesce((b - a) / greatest(a, b), 0.0) as s from (select vec_id, max(case when own then d * n / (n - 1) end) as a, min(case when not own then d end) as b from (select p.vec_id, p.label = q.label as own, avg(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(cast(p.embedding as double[]), cast(q.embedding as double[]))])) as d, count(*) as n, q.label from embeddings p cross join embeddings q group by p.vec_id, p.label, q.label) group by 1)")(lambda s, d: metrics.silhouette(labelled(s, d)))
query("davies_bouldin", "score:d", "select 1 / (1 + avg(r)) as score from (select a.label, max((a.s + b.s) / d) as r from (select p.label, q.label as o, sqrt(sum((p.m - q.m) * (p.m - q.m))) as d from c p join c q on p.i = q.i and p.label <> q.label group by 1, 2) e join w a on e.label = a.label join w b on e.o = b.label group by 1)", "", f"{_DISP}, w as (select label, avg(far) as s from (select vec_id, x.label, sqrt(sum((v - m) * (v - m))) as far from x join c on x.label = c.label and x.i = c.i group by 1, 2) group by 1)")(lambda s, d: metrics.davies_bouldin(labelled(s, d)))


@query("adjusted_rand", "ari:d", "select (ij - sa * sb / nn) / ((sa + sb) / 2 - sa * sb / nn) as ari from (select (select sum(c * (c - 1) / 2) from (select count(*) as c from embeddings group by label, vec_id % 3)) as ij, (select sum(c * (c - 1) / 2) from (select count(*) as c from embeddings group by label)) as sa, (select sum(c * (c - 1) / 2) from (select count(*) as c from embeddings group by vec_id % 3)) as sb, (select count(*) * (count(*) - 1) / 2 from embeddings) as nn)")
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.adjusted_rand(vectors(spark, sf).select(F.col("label").alias("a"), (F.col("vec_id") % 3).alias("b")))


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*(F.lit(f"d{i:02d}") for i in range(64)))
    return labelled(spark, sf).select("sample_id", names.alias("names"), "vec", "label")


def vector_cells(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.explode(F.arrays_zip("names", "vec")).alias("x")
    return vector_rows(spark, sf).select("sample_id", pair).select("sample_id", F.col("x.names").alias("feature_id"), F.col("x.vec").alias("value"), F.lit(0).alias("mask"))


_NEAR = "n as (select * from (select *, row_number() over (partition by sample_id order by d, other) as place from (select cast(p.vec_id as varchar) as sample_id, cast(q.vec_id as varchar) as other, q.label, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(cast(p.embedding as double[]), cast(q.embedding as double[]))]) / 64) as d from embeddings p join embeddings q on p.vec_id <> q.vec_id)) where place <= 30), p as (select sample_id, sum(c * c) / 900.0 as s from (select sample_id, label, count(*) as c from n group by 1, 2) group by 1)"
query("lisi", "sample_id lisi:d", "select sample_id, 1 / s as lisi from p", "", _NEAR)(lambda s, d: metrics.lisi(vector_rows(s, d), vector_rows(s, d).select("sample_id", "label")))
query("batch_mixing", "score:d", "select avg(1 - s) / (1 - 1.0 / (select count(distinct label) from embeddings)) as score from p", "", _NEAR)(lambda s, d: metrics.batch_mixing(vector_rows(s, d), vector_rows(s, d).select("sample_id", "label")))


@query("kbet_ilisi")
def kbet_ilisi(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_rows(spark, sf)
    labels = rows.select("sample_id", "label")
    return spark.createDataFrame([(float(metrics.kbet(rows, labels)), float(metrics.ilisi(rows, labels, 10.0)))], "kbet double, ilisi double")


query("layer_quality", "skewness:d kurtosis:d dynamic_range:d outlier_ratio:d", "select (avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * pow(avg(value), 3)) / pow(var_pop(value), 1.5) as skewness, kurtosis_pop(value) as kurtosis, log10(max(value)) - log10(min(value)) as dynamic_range, avg(case when value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) then 1.0 else 0.0 end) as outlier_ratio from (select value, quantile_cont(value, 0.25) over f as a, quantile_cont(value, 0.75) over f as b from logged window f as (partition by feature_id))", "cells logged")(lambda s, d: metrics.layer_quality(SOURCES["logged"](s, d)))
query("cv_stability", "score:d", "select exp(-avg(cv)) as score from (select grp, median(cv) as cv from (select grp, feature_id, stddev_pop(value) / avg(value) as cv from cells join obs using (sample_id) group by 1, 2) group by 1)", "cells obs")(lambda s, d: metrics.cv_stability(m.cells(s, d), m.obs(s, d)))

# benchmark metrics
_GT = "t as (select feature_id, avg(value) filter (grp = 'g0') as mean_a, avg(value) filter (grp = 'g1') as mean_b, case when count(value) filter (grp = 'g0') >= 2 then stddev_samp(value) filter (grp = 'g0') / avg(value) filter (grp = 'g0') end as cv_a, case when count(value) filter (grp = 'g1') >= 2 then stddev_samp(value) filter (grp = 'g1') / avg(value) filter (grp = 'g1') end as cv_b from cells join obs using (sample_id) group by 1), gt as (select *, log2(mean_a / mean_b) as log2_fc, coalesce((cv_a + cv_b) / 2, cv_a, cv_b) as mean_cv, case when feature_id like 'Brand#1%' then 'one' else 'other' end as species from t)"


def group_table(spark: SparkSession, sf: str) -> DataFrame:
    t = benchmarks.group_table(m.cells(spark, sf), m.obs(spark, sf), "g0", "g1")
    return t.withColumn("species", F.when(F.col("feature_id").startswith("Brand#1"), "one").otherwise("other"))


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("one", 0.0), ("other", 0.5)], "species string, fc double")


_EXPECTED = ", w as (select 'one' as species, 0.0::double as fc union all select 'other', 0.5::double)"
query("bench_group_table", "feature_id mean_a:d mean_b:d log2_fc:d cv_a:d cv_b:d mean_cv:d", "select * from gt", "cells obs", _GT)(group_table)
query("bench_fold_changes", "species n coverage:d mae:d median_error:d rmse:d bias:d sd_error:d", "select species, count(*) as n, count(e) / count(*) as coverage, avg(abs(e)) as mae, median(abs(e)) as median_error, sqrt(avg(e * e)) as rmse, avg(e) as bias, stddev_samp(e) as sd_error from (select species, log2_fc - fc as e from gt join w using (species)) group by 1", "cells obs", _GT + _EXPECTED)(lambda s, d: benchmarks.fold_change_errors(group_table(s, d), expected(s)))
query("bench_pairwise_auc", "a b auc:d", "select 'one' as a, 'other' as b, greatest(u, 1 - u) as auc from (select avg(case when x.log2_fc > y.log2_fc then 1.0 when x.log2_fc = y.log2_fc then 0.5 else 0.0 end) as u from gt x join gt y on x.species = 'one' and y.species = 'other' where x.log2_fc is not null and y.log2_fc is not null)", "cells obs", _GT)(lambda s, d: benchmarks.pairwise_auc(group_table(s, d)))
query("bench_de_consistency", "sign_share:d background_share:d score:d", "select a as sign_share, b as background_share, (a + b) / 2 as score from (select avg(case when sign(log2_fc) = sign(fc) then 1.0 else 0.0 end) filter (fc <> 0) as a, avg(case when abs(log2_fc) <= 0.5 then 1.0 else 0.0 end) filter (fc = 0) as b from gt join w using (species) where log2_fc is not null)", "cells obs", _GT + _EXPECTED)(lambda s, d: benchmarks.de_consistency(group_table(s, d), expected(s)))
query("bench_mapping_burden", "n share_multi:d mean_targets:d median_targets:d", "select count(*) as n, avg(case when k > 1 then 1.0 else 0.0 end) as share_multi, avg(k) as mean_targets, median(k) as median_targets from (select len(string_split(replace(p_name, ' ', ';'), ';')) as k from part)")(lambda s, d: benchmarks.mapping_burden(F.replace(F.col("p_name"), F.lit(" "), F.lit(";")), m.read(s, d, "part")))
query("bench_group_metrics", "within_sd:d eta2:d", "select (select median(sd) from a) as within_sd, (select median(b / (b + w)) from (select feature_id, sum(n * (m - g) * (m - g)) as b, sum(n * v) as w, sum(n) as n, count(*) as k from (select *, sum(n * m) over f / sum(n) over f as g from a window f as (partition by feature_id)) group by 1) where n >= 4 and k >= 2) as eta2", "cells obs", "a as (select * from (select feature_id, grp, count(*) as n, avg(value) as m, stddev_samp(value) as sd, var_pop(value) as v from cells join obs using (sample_id) group by 1, 2) where n >= 2)")(lambda s, d: benchmarks.group_metrics(m.cells(s, d), m.obs(s, d)))
query("bench_within_group_cv", "cv:d", "select median(cv) as cv from (select stddev_samp(value) / avg(value) as cv from cells join obs using (sample_id) group by grp, feature_id having count(*) >= 2)", "cells obs")(lambda s, d: benchmarks.within_group_cv(m.cells(s, d), m.obs(s, d)))
query("bench_distribution", "coverage:d median_mad:d iqr_cv:d rle_mad:d", "select 1.0 as coverage, 1.4826 * median(abs(m - mm)) as median_mad, stddev_samp(iqr) / avg(iqr) as iqr_cv, median(ra) filter (n >= 5) as rle_mad from (select *, median(m) over () as mm from s)", "cells logged", "x as (select *, value - median(value) over (partition by feature_id) as rle from logged), s as (select sample_id, median(value) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, count(value) as n, median(abs(rle)) as ra from x group by 1)")(lambda s, d: benchmarks.distribution_metrics(SOURCES["logged"](s, d)))
query("bench_marker_scores", "label feature_id score:d place", "select grp as label, feature_id, score, cast(place as integer) as place from (select *, row_number() over (partition by grp order by score desc, feature_id) as place from (select grp, feature_id, s / n - (sum(s) over f - s) / nullif(sum(n) over f - n, 0) as score from (select grp, feature_id, sum(value) as s, count(value) as n from cells join obs using (sample_id) group by 1, 2) window f as (partition by feature_id)) where score is not null) where place <= 25", "cells obs")(lambda s, d: benchmarks.marker_scores(m.cells(s, d), m.obs(s, d).withColumnRenamed("group", "label")))


@query("bench_method_scores", "block method score:d", "select 'b' as block, method, avg(case when top = low then 1.0 else (value - low) / (top - low) end) as score from (select *, max(value) over (partition by metric) as top, min(value) over (partition by metric) as low from (select l_returnflag as method, 'qty' as metric, avg(l_quantity) as value from lineitem group by 1 union all select l_returnflag, 'price', avg(l_extendedprice) from lineitem group by 1)) group by 2")
def method_scores(spark: SparkSession, sf: str) -> DataFrame:
    line = m.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"))
    long = line.unpivot("method", ["qty", "price"], "metric", "value").withColumns({"block": F.lit("b"), "higher_is_better": F.lit(True)})
    return benchmarks.method_scores(long)


@query("bench_reconstruction", "n coverage:d mae:d rmse:d nrmse:d median_error:d pearson:d spearman:d", "select count(x) as n, count(y) / count(x) as coverage, avg(abs(y - x)) as mae, sqrt(avg((y - x) * (y - x))) as rmse, sqrt(avg((y - x) * (y - x))) / stddev_samp(x) as nrmse, median(abs(y - x)) as median_error, corr(x, y) as pearson, corr(rx, ry) as spearman from (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from (select value as x, median(value) over (partition by sample_id) as y from cells))", "cells")
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    return benchmarks.reconstruction(m.cells(spark, sf).select(F.col("value").alias("truth"), F.median("value").over(by_sample()).alias("imputed")))


# tests between groups, integration, reduction
_MOMENTS = "g as (select feature_id, grp, count(value) as n, avg(value) as m, var_samp(value) as v from cells join obs using (sample_id) group by 1, 2), ab as (select a.feature_id, a.n as na, b.n as nb, a.m - b.m as d, a.v / a.n as ea, b.v / b.n as eb from g a join g b on a.feature_id = b.feature_id and a.grp = 'g0' and b.grp = 'g1' where a.n > 1 and b.n > 1)"
query("welch_tests", "feature_id t:d df:d", "select feature_id, d / nullif(sqrt(ea + eb), 0) as t, (ea + eb) * (ea + eb) / nullif(ea * ea / (na - 1) + eb * eb / (nb - 1), 0) as df from ab", "cells obs", _MOMENTS)(lambda s, d: stats.welch_tests(m.cells(s, d), m.obs(s, d), "g0", "g1"))
query("rank_sum_tests", "feature_id u:d", "select a.feature_id, sum(case when a.value > b.value then 1.0 when a.value = b.value then 0.5 else 0.0 end) as u from x a join x b on a.feature_id = b.feature_id and a.grp = 'g0' and b.grp = 'g1' group by 1", "cells obs", "x as (select feature_id, grp, value from cells join obs using (sample_id))")(lambda s, d: stats.rank_sum_tests(m.cells(s, d), m.obs(s, d), "g0", "g1"))
query("integrate_limma", CELL_COLUMNS, "select sample_id, feature_id, value - (m - avg_m) as value, mask from logged join obs using (sample_id) join e using (feature_id, batch)", "cells logged obs", "e as (select *, avg(m) over (partition by feature_id) as avg_m from (select feature_id, batch, avg(value) as m from logged join obs using (sample_id) group by 1, 2))")(lambda s, d: integrate.integrate_limma(SOURCES["logged"](s, d), m.obs(s, d)))
query("integrate_limma_covariates")(lambda s, d: integrate.integrate_limma(normalize.log_transform(proteins(s, d)), m.obs(s, d), covariates=("group",)))
query("integrate_combat")(lambda s, d: integrate.integrate_combat(normalize.log_transform(proteins(s, d)), m.obs(s, d)))
query("integrate_combat_covariates")(lambda s, d: integrate.integrate_combat(normalize.log_transform(proteins(s, d)), m.obs(s, d), covariates=("group",)))
query("integrate_combat_nonparametric")(lambda s, d: integrate.integrate_combat(normalize.log_transform(proteins(s, d)), m.obs(s, d), eb_mode="nonparametric"))
query("integrate_scanorama", CELL_COLUMNS)(lambda s, d: integrate.INTEGRATORS["scanorama"].apply(normalize.log_transform(proteins(s, d)), m.obs(s, d)))
query("integrate_mnn")(lambda s, d: integrate.integrate_mnn(normalize.log_transform(proteins(s, d)), m.obs(s, d), k=5))
query("pca_variance")(lambda s, d: reduce.pca(normalize.log_transform(proteins(s, d)), 5)["variance"])
query("pca_randomized")(lambda s, d: reduce.pca(normalize.log_transform(proteins(s, d)), 5, svd_solver="randomized")["variance"])
query("kmeans")(lambda s, d: reduce.kmeans(vector_rows(s, d).select("sample_id", "vec"), 5))
query("umap_layout")(lambda s, d: umap.umap(vector_cells(s, d)).select("sample_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y")))
query("graph_communities")(lambda s, d: reduce.graph_communities(vector_rows(s, d).select("sample_id", "names", "vec")))

# hierarchical clustering: heights of single linkage are the lengths of the spanning tree, here in SQL by adding the nearest sample
query("linkage_single", "place height:d")(lambda s, d: linkage.linkage(plots.dendrogram(m.cells(s, d)), "single").select(F.col("step").alias("place"), "height"))
ORACLES["linkage_single"] = f"""with recursive {m.CELLS_SQL}, {_PAIRS}, pair as (select a, b, sqrt(avg((x - y) * (x - y))) as distance from pairs group by 1, 2),
both_ways as (select * from pair union all select b, a, distance from pair),
grown as (
  select 1 as n, [(select min(sample_id) from cells)] as seen, cast(null as double) as height
  union all
  select n + 1, list_append(seen, arg_min(b, distance)), min(distance) from grown join both_ways on list_contains(seen, a) and not list_contains(seen, b) group by n, seen
)
select cast(row_number() over (order by height) as integer) as place, round(height + {ASIDE}, 6) + 0.0 as height from grown where height is not null"""
query("linkage_average", "step a b height:d n")(lambda s, d: linkage.linkage(plots.dendrogram(m.cells(s, d)), "average", unique=True))
query("linkage_ward", "step a b height:d n")(lambda s, d: linkage.linkage(plots.dendrogram(m.cells(s, d)), "ward", unique=True))
query("integrate_harmony", CELL_COLUMNS)(lambda s, d: integrate.INTEGRATORS["harmony"].apply(normalize.log_transform(proteins(s, d)), m.obs(s, d), batch="batch"))
query(
    "bench_holdout_states",
    "mask n_observed n_held",
    "select mask, n as n_observed, cast(g * n // t + (row_number() over (order by g * n % t desc, mask) <= g - sum(g * n // t) over ())::int as bigint) as n_held from (select mask, n, sum(n) over () as t, least(greatest(128, cast(floor(0.05 * sum(n) over ()) as bigint)), 50000, sum(n) over ()) as g from (select mask, count(value) as n from cells where value is not null group by 1))",
    "cells",
)(lambda s, d: benchmarks.state_profile(benchmarks.holdout(m.cells(s, d), 0.05, least=128, most=50_000)))

# tables behind plots
query("plot_completeness", "sample_id grp n_valid", "select sample_id, grp, count(mask) filter (mask = 0) as n_valid from obs left join cells using (sample_id) group by 1, 2", "cells obs")(lambda s, d: plots.completeness(m.cells(s, d), m.obs(s, d)).withColumnRenamed("group", "grp"))
simple("plot_missing_features", lambda g: plots.missing_rates(g, "feature_id", 50), "feature_id missing_rate:d", "select feature_id, avg(case when value is null then 1.0 else 0.0 end) as missing_rate from grid group by 1 order by 2 desc, 1 limit 50", "cells grid", source="grid")
simple("plot_codes_per_sample", plots.codes_per_sample, "n_codes n_samples", "select n_codes, count(*) as n_samples from (select sample_id, count(distinct mask) as n_codes from cells group by 1) group by 1")
simple("plot_cv_by_feature", plots.cv_by_feature, "feature_id mean:d cv:d", "select feature_id, avg(value) as mean, stddev_pop(value) / avg(value) as cv from cells where mask = 0 group by 1")
query("plot_cv_comparison", "within_cv:d between_cv:d overall:d ratio:d", "select w as within_cv, b as between_cv, o as overall, b / o as ratio from (select (select avg(c) from (select batch, avg(cv) as c from p group by 1)) as w, (select avg(c) from (select feature_id, stddev_pop(m) / avg(m) as c from p group by 1)) as b, (select avg(c) from (select feature_id, stddev_pop(value) / avg(value) as c from cells where mask = 0 group by 1)) as o)", "cells obs", "p as (select batch, feature_id, stddev_pop(value) / avg(value) as cv, avg(value) as m from cells join obs using (sample_id) where mask = 0 group by 1, 2)")(lambda s, d: plots.cv_comparison(m.cells(s, d), m.obs(s, d)).withColumnsRenamed({"within": "within_cv", "between": "between_cv"}))
query("plot_dotplot", "grp feature_id mean:d share:d", "select grp, feature_id, (mean - min(mean) over f) / case when max(mean) over f - min(mean) over f < 1e-8 then 1 else max(mean) over f - min(mean) over f end as mean, share from (select grp, feature_id, avg(ln(1 + value)) as mean, avg(case when value > 0 then 1.0 else 0.0 end) as share from cells join obs using (sample_id) group by 1, 2) window f as (partition by feature_id)", "cells obs")(lambda s, d: plots.dotplot(m.cells(s, d), m.obs(s, d), log1p=True, scale="var").withColumnRenamed("group", "grp"))
query("plot_aggregation_summary", "target_id n_sources", "select target_id, count(*) as n_sources from links group by 1 order by 2 desc, 1 limit 20", "links")(lambda s, d: plots.aggregation_summary(m.links(s, d))[1])
query("plot_filtering_summary", "stage n_samples n_features missing_rate:d", "select 'before' as stage, count(distinct sample_id) as n_samples, count(distinct feature_id) as n_features, 0.0 as missing_rate from cells union all select 'after', count(distinct sample_id), count(distinct feature_id), 0.0 from cells where value > 50000", "cells")(lambda s, d: plots.filtering_summary(m.cells(s, d), m.cells(s, d).where("value > 50000")))
query("plot_preprocessing_summary", "layer sample_id q25:d q50:d q75:d", "select 'raw' as layer, sample_id, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75 from cells group by 2 union all select 'log', sample_id, quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75) from logged group by 2", "cells logged")(lambda s, d: plots.preprocessing_summary({"raw": m.cells(s, d), "log": SOURCES["logged"](s, d)}))
query("plot_feature_mean_variance", "feature_id mean:d variance:d", "select feature_id, avg(value) as mean, var_samp(value) as variance from cells group by 1", "cells")(lambda s, d: plots.feature_mean_variance(m.cells(s, d)))


# windows of events by time, as the streaming query computes them
@query("events_windowed", "start key n mean:d", "select time_bucket(interval '1 hour', ts) as start, event_type as key, count(*) as n, avg(value) as mean from events group by 1, 2")
def events_windowed(spark: SparkSession, sf: str) -> DataFrame:
    events = m.read(spark, sf, "events").select("ts", F.col("event_type").alias("key"), "value")
    return ingest.windowed_means(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


# what centring by sample means keeps of the logged values
CENTRED = "centred as (select sample_id, feature_id, value - avg(value) over (partition by sample_id) + (select avg(value) from logged) as value from logged)"


def keeps(name: str, op: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], sql: str, more: str = "", label: str = "group") -> None:
    """A score of layers before and after, with the samples' labels."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        before = normalize.log_transform(m.cells(spark, sf))
        return op(before, normalize.norm_mean(before, add_global_mean=True), m.obs(spark, sf).select("sample_id", F.col(label).alias("label")))

    query(name, "score:d", sql, "cells logged obs", f"{CENTRED}, {more}" if more else CENTRED)(run)


def effects_sql(label: str, least: int) -> str:
    return (
        f"l as (select {label} as label from obs group by 1 having count(*) >= {least}), mean as (select feature_id, {label} as label, avg(b.value) as x, avg(c.value) as y from logged b join centred c using (sample_id, feature_id) join obs using (sample_id) group by 1, 2), "
        "full_means as (select f.feature_id, l.label, coalesce(x, 0) as x, coalesce(y, 0) as y from (select distinct feature_id from mean) f cross join l left join mean using (feature_id, label)), "
        "effects as (select p.label as a, q.label as b, p.x - q.x as e, p.y - q.y as f from full_means p join full_means q on p.feature_id = q.feature_id and p.label < q.label), "
        "pairs as (select a, b, count(*) as n, avg(abs(e)) as strength, avg(abs(f)) as gap, corr(e, f) as r, sqrt(sum(e * e)) as le, sqrt(sum(f * f)) as lf from effects group by 1, 2)"
    )


keeps("keep_intergroup", preservation.intergroup_preservation, "select coalesce(avg(0.6 * (r + 1) / 2 + 0.4 * exp(-abs(ln(lf / (le + 1e-10))))), 0) as score from pairs where n >= 10 and strength >= 0.08 * (select avg(sd) from (select stddev_pop(value) as sd from logged group by feature_id))", effects_sql("grp", 2))
keeps("keep_technical", preservation.technical_variance, "select 0.5 + 0.5 * greatest(-1, least(1, 1 - avg(gap) / avg(strength))) as score from pairs", effects_sql("batch", 1), "batch")
keeps("keep_loading_bias", lambda b, a, _: preservation.loading_bias_reduction(b, a), "select 0.5 + 0.5 * greatest(-1, least(1, 1 - mad(y) / mad(x))) as score from (select median(b.value) as x, median(c.value) as y from logged b join centred c using (sample_id, feature_id) group by sample_id)")
keeps("keep_intragroup", lambda _, a, g: preservation.intragroup_variation(a, g), "select exp(-avg(cv)) as score from (select grp, median(sd / m) as cv from (select grp, feature_id, count(*) as n, avg(value) as m, stddev_pop(value) as sd from centred join obs using (sample_id) group by 1, 2) where n >= 2 and m > 1e-10 group by 1)")
keeps("keep_even_variation", lambda _, a, __: preservation.even_variation(a), "select 1 - least(1, stddev_pop(sd / m) / avg(sd / m)) as score from (select count(*) as n, avg(value) as m, stddev_pop(value) as sd from centred group by feature_id) where n >= 2 and m > 1e-10")
keeps("keep_variance", lambda b, a, _: preservation.variance_agreement(b, a), "select (1 + corr(x, y)) / 2 as score from (select var_samp(b.value) as x, var_samp(c.value) as y from logged b join centred c using (sample_id, feature_id) group by feature_id) where x > 0 and y > 0")


@query("normalization_scores")
def normalization_scores(spark: SparkSession, sf: str) -> DataFrame:
    before = normalize.log_transform(proteins(spark, sf))
    found = autoselect.normalization_scores(before, normalize.norm_median(before), m.obs(spark, sf))
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, score double")


@query("autoselect")
def autoselect_report(spark: SparkSession, sf: str) -> DataFrame:
    from .model import Assay, Dataset

    cells = sparse_proteins(spark, sf)
    ds = Dataset(m.obs(spark, sf), {"proteins": Assay(cells.select("feature_id").distinct(), {"log": cells})})
    return autoselect.AutoSelector(methods={"normalize": ["none", "median", "quantile"]}).run(ds, source_layer="log", stages=("normalize", "impute"))[1].rows(spark)


# contrasts, ratios and neighbourhoods
_CONTRASTS = "mg as (select feature_id, grp, avg(value) as m, count(*) as n from logged join obs using (sample_id) group by 1, 2), ct as (select x.feature_id, x.grp as a, y.grp as b, x.n as n_a, y.n as n_b, x.m - y.m as log2_fc from mg x join mg y on x.feature_id = y.feature_id and x.grp < y.grp)"


def log_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return benchmarks.contrasts(SOURCES["logged"](spark, sf), m.obs(spark, sf))


query("group_contrasts", "feature_id a b n_a n_b log2_fc:d", "select * from ct", "cells logged obs", _CONTRASTS)(log_contrasts)
_RATIO = f"{_CONTRASTS}, r as (select feature_id, log2_fc, case when feature_id like 'Brand#1%' then 'one' else 'other' end as species from ct where a = 'g0' and b = 'g1'), e as (select *, log2_fc - case species when 'one' then 0.0 else 0.5 end as e from r)"
query(
    "bench_ratio_metrics",
    "n mae:d rmse:d bias:d pairwise_auc:d changed_auc:d",
    "select count(*) as n, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, avg(e) as bias, (select greatest(u, 1 - u) from (select avg(case when x.log2_fc > y.log2_fc then 1.0 when x.log2_fc = y.log2_fc then 0.5 else 0.0 end) as u from r x join r y on x.species = 'one' and y.species = 'other')) as pairwise_auc, (select avg(case when abs(x.log2_fc) > abs(y.log2_fc) then 1.0 when abs(x.log2_fc) = abs(y.log2_fc) then 0.5 else 0.0 end) from r x join r y on x.species = 'other' and y.species = 'one') as changed_auc from e",
    "cells logged obs",
    _RATIO,
)(lambda s, d: benchmarks.ratio_metrics(log_contrasts(s, d).where("a = 'g0' and b = 'g1'").withColumn("species", F.when(F.col("feature_id").startswith("Brand#1"), "one").otherwise("other")), expected(s), "one"))
_TOP = f"{_CONTRASTS}, x as (select feature_id, p.log2_fc as x, q.log2_fc as y from ct p join ct q using (feature_id) where p.a = 'g0' and p.b = 'g1' and q.a = 'g0' and q.b = 'g2'), t as (select *, row_number() over (order by abs(x) desc, feature_id) <= 50 as ix, row_number() over (order by abs(y) desc, feature_id) <= 50 as iy from x)"
query(
    "bench_topk_agreement",
    "r:d jaccard:d f1:d sign_share:d",
    "select corr(x, y) as r, count(*) filter (ix and iy) / count(*) filter (ix or iy) as jaccard, count(*) filter (ix and iy) / 50 as f1, avg(case when sign(x) = sign(y) then 1.0 else 0.0 end) filter (ix) as sign_share from t",
    "cells logged obs",
    _TOP,
)(lambda s, d: benchmarks.topk_agreement(*(log_contrasts(s, d).where(f"a = 'g0' and b = '{g}'").select("feature_id", "log2_fc") for g in ("g1", "g2")), k=50))
query("normalized_mutual_information", "nmi:d", "select (ha + hb - hab) / ((ha + hb) / 2) as nmi from (select (select -sum(n / t * ln(n / t)) from (select count(*) as n from embeddings group by label)) as ha, (select -sum(n / t * ln(n / t)) from (select count(*) as n from embeddings group by vec_id % 3)) as hb, (select -sum(n / t * ln(n / t)) from (select count(*) as n from embeddings group by label, vec_id % 3)) as hab from (select 1)), (select count(*) as t from embeddings) limit 1".replace("n / t", "n / (select count(*) from embeddings)"))(
    lambda s, d: benchmarks.nmi(vectors(s, d).select(F.col("label").alias("a"), (F.col("vec_id") % 3).alias("b")))
)
query("knn_purity", "score:d", "select avg(p) as score from (select sample_id, avg(case when n.label = o.label then 1.0 else 0.0 end) as p from n join embeddings o on cast(o.vec_id as varchar) = sample_id group by 1)", "", _NEAR)(lambda s, d: metrics.knn_purity(vector_rows(s, d), vector_rows(s, d).select("sample_id", "label"), 30))
_TWO = "near as (select * from (select *, row_number() over (partition by part, sample_id order by d, other) as place from (select part, cast(p.vec_id as varchar) as sample_id, cast(q.vec_id as varchar) as other, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(cast(p.embedding[part[1]:part[2]] as double[]), cast(q.embedding[part[1]:part[2]] as double[]))]) / (part[2] - part[1] + 1)) as d from embeddings p join embeddings q on p.vec_id <> q.vec_id cross join (select unnest([[1, 32], [1, 64]]) as part))) where place <= 10)"
query("knn_jaccard", "sample_id jaccard:d", "select sample_id, count(*) filter (n = 2) / count(*) as jaccard from (select sample_id, other, count(*) as n from near group by 1, 2) group by 1", "", _TWO)(lambda s, d: metrics.knn_jaccard(vector_rows(s, d).select("sample_id", F.slice("names", 1, 32).alias("names"), F.slice("vec", 1, 32).alias("vec")), vector_rows(s, d), 10))

# criteria, functions of one's own, vendor tables
query("filter_by_places", "sample_id batch grp", "select sample_id, batch, grp from (select *, row_number() over (order by sample_id) - 1 as place, count(*) over () as n from obs) where place in (0, 3, n - 1)", "obs")(lambda s, d: chosen(m.obs(s, d), "sample_id", [3, 0, -1]).withColumnRenamed("group", "grp"))
query("custom_range", "feature_id value:d", "select feature_id, max(value) - min(value) as value from cells group by 1", "cells")(lambda s, d: custom.reduce_axis(m.cells(s, d), "feature_id", np.ptp))
query("custom_map", CELL_COLUMNS, "select sample_id, feature_id, value - max(value) over (partition by sample_id) as value, mask from proteins", "peptides links proteins")(lambda s, d: custom.map_samples(proteins(s, d), lambda x: x - np.nanmax(x, 1, keepdims=True)))


def written(table: DataFrame) -> str:
    """The path of a tab-separated table in the shared folder, deleted when the session ends."""
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/vendor-{uuid.uuid4().hex}.tsv"
    delete_at_exit(spark, path)
    table.write.csv(path, sep="\t", header=True)
    return path


_DIANN = "k as (select 'S' || sample_id as sample_id, feature_id, value from cells where mask <> 2), cut as (select 'S' || sample_id as sample_id, feature_id from cells where mask = 2)"


def diann_report(spark: SparkSession, sf: str) -> str:
    """A long report of DIA-NN's columns: runs end in .raw, a tenth of a percent passes, five percent doesn't."""
    c = m.cells(spark, sf)
    q = F.when(F.col("mask") == 2, 0.05).otherwise(0.001)
    columns = {"Run": F.concat(F.lit("S"), "sample_id", F.lit(".raw")), "Protein.Group": F.col("feature_id"), "Genes": F.concat(F.lit("G"), "feature_id"), "PG.MaxLFQ": F.col("value"), "PG.Q.Value": q}
    return written(c.select(*(v.alias(k) for k, v in columns.items())))


@query("source_long_report", CELL_COLUMNS, "select s.sample_id, f.feature_id, k.value, case when k.value is not null then 0 when cut.sample_id is not null then 3 else 6 end as mask from (select distinct sample_id from k) s cross join (select distinct feature_id from k) f left join k on k.sample_id = s.sample_id and k.feature_id = f.feature_id left join cut on cut.sample_id = s.sample_id and cut.feature_id = f.feature_id", "cells", _DIANN)
def long_report(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load_diann(spark, diann_report(spark, sf)).layer("proteins", "raw")


@query("source_features", "feature_id genes", "select distinct feature_id, 'G' || feature_id as genes from k", "cells", _DIANN)
def long_report_features(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load_quant_table(spark, diann_report(spark, sf)).assay("proteins").var.select("feature_id", F.col("Genes").alias("genes"))


@query("source_wide_report", CELL_COLUMNS, "select 'run' || s as sample_id, f.feature_id, value, case when value is null then 6 else 0 end as mask from (select distinct feature_id from proteins) f cross join (select unnest(range(1, 9)) as s) left join proteins p on p.feature_id = f.feature_id and p.sample_id = cast(s as varchar)", "peptides links proteins")
def wide_report(spark: SparkSession, sf: str) -> DataFrame:
    p = proteins(spark, sf)
    wide = p.groupBy(F.col("feature_id").alias("Protein.Group")).agg(*(F.max(F.when(F.col("sample_id") == str(i), F.col("value"))).alias(f"run{i}.raw") for i in range(1, 9)))
    return tables.load_quant_table(spark, written(wide), software="diann").layer("protein", "raw")

query("plot_missing_pattern", "sample_id feature_id missing", "select sample_id, feature_id, (value is null)::int as missing from grid where feature_id in (select feature_id from grid group by 1 order by avg((value is null)::int) desc, 1 limit 20) and sample_id in (select sample_id from (select distinct sample_id from grid) order by md5(sample_id) limit 5)", "cells grid")(lambda s, d: plots.missing_pattern(grid(s, d), 20, 5))
query("plot_data_overview", "grp n_samples n_values mean:d median:d detection_rate:d", "select grp, count(distinct sample_id) as n_samples, count(value) as n_values, avg(value) as mean, median(value) as median, avg((mask = 0)::int) as detection_rate from cells join obs using (sample_id) group by 1", "cells obs")(lambda s, d: plots.data_overview(m.cells(s, d), m.obs(s, d)).withColumnRenamed("group", "grp"))
_DISPERSION = "select '{0}' as layer, avg(b / sd) as score from (select feature_id, stddev_pop(m) as b from (select feature_id, batch, avg(value) as m from {0} join obs using (sample_id) group by 1, 2) group by 1) join (select feature_id, stddev_pop(value) as sd from {0} join obs using (sample_id) group by 1) using (feature_id) where sd > 1e-9"
query("plot_integration_summary", "layer score:d", f"{_DISPERSION.format('cells')} union all {_DISPERSION.format('logged')}", "cells logged obs")(lambda s, d: plots.integration_summary({"cells": m.cells(s, d), "logged": SOURCES["logged"](s, d)}, m.obs(s, d)))
query("plot_saturation", "grp place", 'select grp, min(place) as place from (select o.grp, cast(o.place as integer) as place, sum(coalesce(new, 0)) over (partition by o.grp order by o.place) as n_union from o left join n on o.grp = n.grp and o.place = n.place) where n_union >= 0.95 * (select count(distinct feature_id) from cells) group by 1', "cells obs", _RUN)(lambda s, d: plots.saturation(qc.cumulative_sensitivity(m.cells(s, d), m.obs(s, d)), m.cells(s, d).select("feature_id").distinct().count()).withColumnRenamed("group", "grp"))

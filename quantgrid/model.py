"""The data model: samples, assays of features, layers of cells, links between assays and a history.

A layer is a DataFrame of cells (sample_id, feature_id, value, mask): one row for each cell that is known of. A missing value
is null, never NaN; its mask says why. Absent rows are cells nobody reported; `complete` adds them. A Dataset never changes:
every operation returns a new one that shares the others' plans.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from enum import IntEnum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import AssayNotFoundError, DimensionError, LayerNotFoundError, MaskCodeError, StructureError, ValidationError

CELL = ("sample_id", "feature_id", "value", "mask")
ALIASES = {"protein": "proteins", "proteins": "protein", "peptide": "peptides", "peptides": "peptide"}


class MaskCode(IntEnum):
    VALID = 0
    MBR = 1
    LOD = 2
    FILTERED = 3
    OUTLIER = 4
    IMPUTED = 5
    UNCERTAIN = 6


def clean(value: Column) -> Column:
    """NaN becomes null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def cells(df: DataFrame, sample: str = "sample_id", feature: str = "feature_id", value: str = "value", mask: str | None = "mask") -> DataFrame:
    """A layer from any long table; a null mask counts as VALID."""
    code = F.coalesce(F.col(mask).cast("int"), F.lit(0)) if mask else F.lit(0)
    return df.select(F.col(sample).cast("string").alias("sample_id"), F.col(feature).cast("string").alias("feature_id"), clean(F.col(value)).alias("value"), code.alias("mask"))


def complete(layer: DataFrame, samples: DataFrame | None = None, features: DataFrame | None = None, code: int = MaskCode.UNCERTAIN) -> DataFrame:
    """Add a null cell of the given code for each pair of sample and feature that a layer lacks.

    The grid is made from the two lists of ids, which are small beside the cells: the features are listed once per sample by a
    broadcast where Spark finds them small enough, else by a shuffle.
    """
    samples = (layer if samples is None else samples).select("sample_id").distinct()
    features = (layer if features is None else features).select("feature_id").distinct()
    grid = samples.crossJoin(features)
    return grid.join(layer, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", "value", F.coalesce("mask", F.lit(int(code))).alias("mask"))


Criteria = Column | DataFrame | list


def chosen(rows: DataFrame, key: str, keep: Criteria) -> DataFrame:
    """The rows that a condition, a DataFrame of keys, or a list picks; keys must be distinct.

    A list holds ids, whose order the result takes; booleans, one for each row by ascending key; or places in that order, from 0
    on, negative ones from the end. ValidationError for ids and places that aren't there, and for a mask of another length.
    """
    if isinstance(keep, Column):
        return rows.where(keep)
    if isinstance(keep, DataFrame):
        return rows.join(keep.select(key), key, "left_semi")
    spark, keep = rows.sparkSession, list(keep)
    if not keep:
        return rows.limit(0)
    if all(isinstance(x, str) for x in keep):
        wanted = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(keep))], f"`{key}` string, __at int")
        if unknown := [r[0] for r in wanted.join(rows, key, "left_anti").select(key).limit(5).collect()]:
            raise ValidationError(f"no such {key}: {unknown}")
        return rows.join(wanted, key).orderBy("__at").drop("__at")
    n = rows.count()
    if all(isinstance(x, bool) for x in keep):
        if len(keep) != n:
            raise ValidationError(f"a mask of {len(keep)} for {n} rows")
        places = [i for i, x in enumerate(keep) if x]
    else:
        places = [int(x) + n * (x < 0) for x in keep]
        if any(not 0 <= x < n for x in places):
            raise ValidationError(f"places must lie within {n} rows")
    ids = rows.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("__place"))  # one id a row, in one task
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(places))], "__place int, __at int")
    return rows.join(ids.join(wanted, "__place"), key).orderBy("__at").select(*rows.columns)


@dataclass(frozen=True)
class Record:
    action: str
    params: dict
    description: str = ""
    at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


@dataclass(frozen=True)
class Assay:
    """Features (feature_id and any other columns) and named layers of cells."""

    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise LayerNotFoundError(f"no layer {name!r}; there are {sorted(self.layers)}")
        return self.layers[name]


@dataclass(frozen=True)
class Dataset:
    """Samples (sample_id and any other columns), assays, links (source_assay, source_id, target_assay, target_id), history."""

    obs: DataFrame
    assays: dict[str, Assay]
    links: DataFrame | None = None
    history: tuple[Record, ...] = ()

    def resolve(self, name: str) -> str:
        """The name of an assay; singular and plural of protein and peptide stand for each other, the exact name first."""
        for n in (name, ALIASES.get(name)):
            if n in self.assays:
                return n
        raise AssayNotFoundError(f"no assay {name!r}; there are {sorted(self.assays)}")

    def assay(self, name: str) -> Assay:
        return self.assays[self.resolve(name)]

    def layer(self, assay: str, name: str) -> DataFrame:
        return self.assay(assay).layer(name)

    def log(self, action: str, params: dict, description: str = "") -> Dataset:
        return replace(self, history=(*self.history, Record(action, params, description)))

    def with_assay(self, name: str, assay: Assay) -> Dataset:
        return replace(self, assays={**self.assays, name: assay})

    def with_layer(self, assay: str, name: str, layer: DataFrame, action: str = "add_layer", **params) -> Dataset:
        """Add or overwrite a layer and note it in the history."""
        assay = self.resolve(assay)
        old = self.assays[assay]
        new = self.with_assay(assay, replace(old, layers={**old.layers, name: layer.select(*CELL)}))
        return new.log(action, {"assay": assay, "new_layer": name, **params})

    def apply(self, assay: str, source: str, new: str, op: Callable[..., DataFrame], **params) -> Dataset:
        """Add the layer that op makes of another one."""
        return self.with_layer(assay, new, op(self.layer(assay, source), **params), op.__name__, source_layer=source, **{k: v for k, v in params.items() if not isinstance(v, (DataFrame, Column))})

    def filter_samples(self, keep: Criteria) -> Dataset:
        """Keep samples by criteria as `chosen` takes them; cells of all layers follow."""
        obs = chosen(self.obs, "sample_id", keep)
        ids = obs.select("sample_id")
        assays = {n: replace(a, layers={k: c.join(ids, "sample_id", "left_semi") for k, c in a.layers.items()}) for n, a in self.assays.items()}
        return replace(self, obs=obs, assays=assays).log("filter_samples", {})

    def filter_features(self, assay: str, keep: Criteria) -> Dataset:
        """Keep features of one assay, its exact name given, by criteria as `chosen` takes them; its cells and the links follow."""
        if assay not in self.assays:
            raise AssayNotFoundError(f"no assay {assay!r}")
        old = self.assays[assay]
        var = chosen(old.var, "feature_id", keep)
        ids = var.select("feature_id")
        new = self.with_assay(assay, Assay(var, {k: c.join(ids, "feature_id", "left_semi") for k, c in old.layers.items()}))
        if self.links is not None:
            links = self.links
            for side in ("source", "target"):
                kept = links.join(ids, F.col(f"{side}_id") == F.col("feature_id"), "left_semi").where(F.col(f"{side}_assay") == assay)
                links = links.where(F.col(f"{side}_assay") != assay).unionByName(kept)
            new = replace(new, links=links)
        return new.log("filter_features", {"assay": assay})

    def subset(self, assay: str, *, features: Criteria, layers: list[str] | None = None) -> Assay:
        """One assay with some features and layers; the data set stays as it is."""
        old = self.filter_features(self.resolve(assay), features).assay(assay)
        return replace(old, layers={k: v for k, v in old.layers.items() if layers is None or k in layers})

    def keep_layers(self, assay: str, names: list[str]) -> Dataset:
        old = self.assay(assay)
        return self.with_assay(self.resolve(assay), replace(old, layers={k: v for k, v in old.layers.items() if k in names}))

    def source_of(self, assay: str, layer: str) -> str | None:
        """The layer that another one was made of, by the history; the latest record counts."""
        assay = self.resolve(assay)
        for r in reversed(self.history):
            if r.params.get("assay") == assay and r.params.get("new_layer") == layer:
                return r.params.get("source_layer")
        return None

    def lineage(self, assay: str, layer: str, limit: int = 20) -> list[str]:
        """A layer and those it derives from, nearest first; stops at a cycle and after `limit` steps."""
        out = [layer]
        while len(out) <= limit and (parent := self.source_of(assay, out[-1])) and parent not in out:
            out.append(parent)
        return out

    def history_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.at, r.action, json.dumps(r.params, default=str), r.description) for r in self.history]
        return spark.createDataFrame(rows, "ts string, action string, params string, description string")

    def validate(self) -> Dataset:
        """Check ids, mask codes and link ends by counting offenders; raises on the first kind that is found."""
        bad = lambda df: df.limit(1).count() > 0
        if bad(self.obs.groupBy("sample_id").count().where("count > 1 or sample_id is null")):
            raise StructureError("sample ids repeat or are null")
        for name, assay in self.assays.items():
            if bad(assay.var.groupBy("feature_id").count().where("count > 1 or feature_id is null")):
                raise StructureError(f"feature ids of {name} repeat or are null")
            for layer, c in assay.layers.items():
                if bad(c.where(~F.col("mask").between(0, 6))):
                    raise MaskCodeError(f"{name}/{layer} has unknown mask codes")
                if bad(c.join(self.obs, "sample_id", "left_anti")) or bad(c.join(assay.var, "feature_id", "left_anti")):
                    raise DimensionError(f"{name}/{layer} has cells of unknown samples or features")
                if bad(c.groupBy("sample_id", "feature_id").count().where("count > 1")):
                    raise DimensionError(f"{name}/{layer} has repeated cells")
        if self.links is not None:
            for side in ("source", "target"):
                for name, assay in self.assays.items():
                    ends = self.links.where(F.col(f"{side}_assay") == name)
                    if bad(ends.join(assay.var, F.coalesce(F.col(f"{side}_id").cast("string"), F.lit("")) == F.col("feature_id"), "left_anti")):
                        raise ValidationError(f"a link's {side} isn't a feature of {name}")
        return self

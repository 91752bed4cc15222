"""Imputers, scalers and the feature encoder (IM6-IM10, FE1, FE4-FE8).

Each ``fit_*`` runs one distributed aggregate and returns a small parameter dict (one entry
per column); ``apply_*`` is a projection.  The encoder is a dictionary table for the one-hot
block plus those parameter dicts, saved together (IO8).

``spark.ml``'s ``Imputer(median)``, ``RobustScaler`` and ``StandardScaler`` are deliberately not
used: they interpolate differently, do not centre, or divide by the sample std.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions.strings import string_columns
from ridelens.operators.clean import PROTECTED, SCALED_NUMERIC, is_numeric
from ridelens.operators.dictionary import Dictionary, fit_dictionary, ohe
from ridelens.operators.kmeans import entries
from ridelens.operators.quantiles import filled_quartiles, quantiles


# ---------------------------------------------------------------------------- IM6 / IM7
def fit_median(df: DataFrame, cols: Sequence[str], method: str = "exact") -> dict[str, float | None]:
    """IM6: exact (interpolated) median per column."""
    return {c: v[0] for c, v in quantiles(df, cols, [0.5], method).items()}


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """IM7: most frequent non-null value per column, ties -> smallest value.

    Distributed: ``groupBy(name, value).count()`` then ``min(struct(-count, value))`` per
    column -- both aggregates combine map-side; only one row per column comes back.
    """
    cols = list(cols)
    if not cols:
        return {}
    numeric = {c: is_numeric(df, c) for c in cols}
    out = {}
    for kind in (True, False):
        group = [c for c in cols if numeric[c] == kind]
        if not group:
            continue
        vtype = "double" if kind else "string"
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast(vtype).alias("value")) for c in group])
        best = (df.select(F.explode(pairs).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
                .groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
                .groupBy("name").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("value"))).alias("b"))
                .select("name", "b.value").collect())
        out.update({r["name"]: r["value"] for r in best})
    return {c: out.get(c) for c in cols}


def apply_fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by the fitted values (a column that had no values stays as it is)."""
    exprs = {}
    for c, v in values.items():
        if v is None or c not in df.columns:
            continue
        dtype = df.schema[c].dataType
        exprs[c] = F.coalesce(F.col(c), F.lit(v).cast(dtype))
    return df.withColumns(exprs)


# ---------------------------------------------------------------------------- IM8-IM10
def add_duration(df: DataFrame, primary: str = "avg_vtat", fallback: str = "avg_ctat", out: str = "duration") -> DataFrame:
    """IM8: ``primary`` if the table has it, else ``fallback``; null -> 0 (chosen per table)."""
    src = primary if primary in df.columns else fallback if fallback in df.columns else None
    if src is None:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.col(src).cast("double"), F.lit(0.0)))


def add_distance(df: DataFrame, source: str = "ride_distance", out: str = "distance") -> DataFrame:
    """IM9: ``out`` from ``source`` unless it already exists; null -> 0."""
    if out in df.columns:
        return df
    if source not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.col(source).cast("double"), F.lit(0.0)))


def profile(df: DataFrame, col: str, method: str = "exact") -> DataFrame:
    """IM10: min, max, mean, median, missing of one column (one aggregate + the quantile pass)."""
    med = fit_median(df, [col], method)[col]
    x = F.col(col).cast("double")
    return df.agg(F.lit(col).alias("column_name"), F.min(x).alias("min"), F.max(x).alias("max"),
                  F.avg(x).alias("mean"), F.lit(med).cast("double").alias("median"),
                  F.count(F.when(x.isNull(), 1)).alias("missing"))


# ---------------------------------------------------------------------------- FE4 / FE5
def fit_robust(df: DataFrame, cols: Sequence[str], method: str = "exact") -> dict[str, tuple[float, float]]:
    """FE4: centre = median, scale = q75 - q25 (0 -> 1)."""
    return _robust(quantiles(df, cols, [0.25, 0.5, 0.75], method))


def _robust(quartiles: Mapping[str, Sequence[float | None]]) -> dict[str, tuple[float, float]]:
    return {c: (med, (q3 - q1) or 1.0) for c, (q1, med, q3) in quartiles.items() if med is not None}


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """FE5: centre = mean, scale = population std (0 -> 1)."""
    row = df.agg(*[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"{c}__m"),
                                              F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__s"))]).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        if m is None:
            continue
        out[c] = (m, s if s else 1.0)
    return out


def apply_scale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# ---------------------------------------------------------------------------- FE1
def group_columns(df: DataFrame, scaled: Sequence[str] = SCALED_NUMERIC,
                  protect: Sequence[str] = PROTECTED) -> dict[str, list[str]]:
    """FE1: numeric columns split into scaled / passthrough; text columns are categorical.
    Pure schema logic on the driver."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    sc = [c for c in scaled if c in numeric]
    return {
        "scaled": sc,
        "passthrough": [c for c in numeric if c not in sc],
        "categorical": [c for c in string_columns(df) if c not in set(protect)],
    }


# ---------------------------------------------------------------------------- FE6-FE8
def _cat(c: str) -> str:
    return f"c__{c}"


def _filled_categories(df: DataFrame, cols: Sequence[str], modes: Mapping[str, object]) -> DataFrame:
    """Helper columns with the categories, nulls replaced by the most frequent one."""
    return df.withColumns({_cat(c): F.coalesce(F.col(c), F.lit(modes[c])) for c in cols})


def fit_onehot(df: DataFrame, cols: Sequence[str]) -> Dictionary:
    """FE6: categories sorted, unseen and null -> all zeros, width = number of categories."""
    return fit_dictionary(df, cols)


def onehot_long(df: DataFrame, model: Dictionary, cols: Sequence[str], key: str) -> DataFrame:
    """FE6 check form: ``key, feature`` for every non-zero dummy (at most one per column)."""
    for c in cols:
        df = model.index(df, c, c, f"{c}__at")
    set_ = F.array_compact(F.array(*[F.when(F.col(f"{c}__at").isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))) for c in cols]))
    return df.select(key, F.explode(set_).alias("feature"))


@dataclass
class Encoder:
    """FE7: robust block, one-hot block, passthrough block, in that order; the rest is dropped."""

    scaled: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)
    medians: dict = field(default_factory=dict)
    robust: dict = field(default_factory=dict)
    modes_cat: dict = field(default_factory=dict)
    modes_pass: dict = field(default_factory=dict)
    widths: dict = field(default_factory=dict)
    onehot: Dictionary | None = None

    def _offsets(self) -> dict[str, int]:
        """Place of each categorical column's first dummy in the vector."""
        out, at = {}, len(self.scaled)
        for c in self.categorical:
            out[c] = at
            at += self.widths.get(c, 0)
        return out

    def size(self) -> int:
        return len(self.scaled) + sum(self.widths.get(c, 0) for c in self.categorical) + len(self.passthrough)

    def feature_table(self) -> DataFrame:
        """FE8: ``position, feature``: scaled names, ``col_value`` dummies, passthrough names, aligned with the vector.  The
        dummies come from the dictionary table; their names never pass the driver."""
        ends = self.size() - len(self.passthrough)
        plain = [*enumerate(self.scaled), *((ends + i, c) for i, c in enumerate(self.passthrough))]
        out = _active().createDataFrame(plain, "position long, feature string")
        if self.onehot is None:
            return out
        place = F.create_map(*[x for c, at in self._offsets().items() for x in (F.lit(c), F.lit(at))])
        return out.unionByName(self.onehot.table.select((place[F.col("name")] + F.col("idx")).cast("long").alias("position"),
                                                        F.concat("name", F.lit("_"), "value").alias("feature")))

    def feature_names(self, most: int = 100_000) -> list[str]:
        """The names as a list, for vectors of at most ``most`` features; ``feature_table`` has no bound."""
        if self.size() > most:
            raise ValueError(f"{self.size()} features: use feature_table")
        return [r["feature"] for r in self.feature_table().orderBy("position").collect()]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the vector column; it is built from helper columns, so all input columns stay as they are."""
        x = df.withColumns({f"s__{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.scaled}
                           | {f"p__{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(self.modes_pass[c])))
                              for c in self.passthrough})
        x = _filled_categories(x, self.categorical, self.modes_cat)
        x = apply_scale(x, {f"s__{c}": p for c, p in self.robust.items()})
        cats = [_cat(c) for c in self.categorical]
        if self.onehot is not None:
            x = self.onehot.transform(x, {_cat(c): c for c in self.categorical})
        inputs = [f"s__{c}" for c in self.scaled] + [ohe(c) for c in cats] + [f"p__{c}" for c in self.passthrough]
        vec = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(x)
        return vec.drop(*inputs, *cats)

    def transform_long(self, df: DataFrame, key: str) -> DataFrame:
        """FE8 check form: ``key, feature, value`` for every scaled and passthrough column and the dummy that is set."""
        plain = [*range(len(self.scaled)), *range(self.size() - len(self.passthrough), self.size())]
        v = entries(self.transform(df), "features")
        at = F.coalesce(v["indices"], F.sequence(F.lit(0), v["size"] - 1))
        cells = F.concat(F.arrays_zip(at.alias("position"), v["values"].alias("value")),
                         F.transform(F.array_except(F.array(*[F.lit(i) for i in plain]), at),
                                     lambda i: F.struct(i.alias("position"), F.lit(0.0).alias("value"))))
        cells = self.transform(df).select(key, F.explode(cells).alias("cell")).select(key, "cell.position", "cell.value")
        cells = cells.where(F.col("position").isin(plain) | (F.col("value") != 0))
        return cells.join(self.feature_table(), "position").select(key, "feature", "value")

    def save(self, path: str) -> None:
        """IO8: parameters as JSON next to the dictionary table."""
        params = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "onehot"}
        if self.onehot is not None:
            self.onehot.save(os.path.join(path, "onehot"))
        spark = _active()
        spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "params"))

    @classmethod
    def load(cls, path: str) -> Encoder:
        spark = _active()
        params = json.loads(spark.read.text(os.path.join(path, "params")).first()[0])
        enc = cls(**params)
        enc.robust = {k: tuple(v) for k, v in enc.robust.items()}
        if enc.categorical:
            enc.onehot = Dictionary.load(os.path.join(path, "onehot"))
        return enc


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def fit_encoder(df: DataFrame, groups: Mapping[str, list[str]] | None = None, method: str = "exact") -> Encoder:
    """FE7 fit: median imputer + robust scaler on the scaled block, most-frequent imputer +
    one-hot on the categorical block, most-frequent imputer on the passthrough block.

    A column without any value is left out of the vector and of the names.  The fit reads its columns some ten times and
    ``transform`` reads the rows next, so ``df`` is persisted and stays so."""
    g = dict(groups or group_columns(df))
    df.persist(StorageLevel.MEMORY_AND_DISK)
    quartiles = filled_quartiles(df, g["scaled"], method)  # imputer and scaler from one search
    medians = {c: v[0] for c, v in quartiles.items()}
    modes = fit_mode(df, [*g["categorical"], *g["passthrough"]])
    enc = Encoder(scaled=[c for c in g["scaled"] if medians.get(c) is not None],
                  categorical=[c for c in g["categorical"] if modes.get(c) is not None],
                  passthrough=[c for c in g["passthrough"] if modes.get(c) is not None])
    enc.medians = {c: medians[c] for c in enc.scaled}
    enc.robust = _robust({c: quartiles[c][1:] for c in enc.scaled})
    enc.modes_cat = {c: modes[c] for c in enc.categorical}
    enc.modes_pass = {c: modes[c] for c in enc.passthrough}
    if enc.categorical:
        named = df.select(*[F.coalesce(F.col(c), F.lit(enc.modes_cat[c])).alias(c) for c in enc.categorical])
        enc.onehot = fit_onehot(named, enc.categorical)
        enc.widths = dict(enc.onehot.widths)
    return enc

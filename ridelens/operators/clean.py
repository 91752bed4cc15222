"""Row filters, dedup, status flags, casting, imputation, outlier caps and rare categories.

Operators that must learn something from the data (IM1 cast decision, FE2 bounds, FE3 frequent
values) run one aggregate, bring back a result whose size is bounded by the number of columns
(or by ``1 / min_frac`` values per column) and apply it as a projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions.strings import norm_str, string_columns
from ridelens.operators.quantiles import quantiles

# Column roles of the booking table.
PROTECTED = ("datetime", "booking_id", "customer_id")
COUNT_COLS = ("cancelled_rides_by_customer", "cancelled_rides_by_driver", "incomplete_rides")
ZERO_IF_CANCELLED = ("booking_value", "ride_distance")
REASON_COLS = ("reason_for_cancelling_by_customer", "driver_cancellation_reason", "incomplete_rides_reason")
NOT_APPLICABLE = "Not Applicable"
UNKNOWN_PAYMENT = "Unknown"
SCALED_NUMERIC = ("avg_vtat", "avg_ctat", "booking_value", "ride_distance", "driver_ratings", "customer_rating")
LOCATION_COLS = ("pickup_location", "drop_location")
RARE_FRAC = 0.01
RARE_FRAC_LOCATION = 0.0005
OTHER = "Other"
CAST_THRESHOLD = 0.40

# A number as pandas' to_numeric reads it (after trimming): decimal or exponent form, or inf.
NUMBER_RE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


# ---------------------------------------------------------------------------- FL1
def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """FL1: keep the first row per key in the total order ``order_by`` (+ remaining columns).

    Written as ``groupBy(keys).agg(min(struct(order, rest)))`` instead of a window: the
    aggregate combines map-side, so one key holding a third of all rows (null ids are one
    key, as in pandas) is reduced per map task before the shuffle.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = F.min(F.struct(*[F.col(c) for c in order_by + rest])).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order_by + rest]) \
        .select(*df.columns)


# ---------------------------------------------------------------------------- FL2-FL4
def status_flags(df: DataFrame, col: str = "booking_status") -> DataFrame:
    """FL2-FL4: is_completed / is_incomplete / is_cancelled as 0/1 (all 0 without a status column)."""
    if col not in df.columns:
        return df.withColumns({"is_completed": F.lit(0), "is_incomplete": F.lit(0), "is_cancelled": F.lit(0)})
    s = norm_str(F.col(col))
    return df.withColumns({
        "is_completed": (s == "completed").cast("int"),
        "is_incomplete": s.contains("incomplete").cast("int"),
        "is_cancelled": (s.contains("cancel") | s.contains("no driver")).cast("int"),
    })


# ---------------------------------------------------------------------------- FL5-FL6
def segmentation_input(df: DataFrame, completed_only: bool = False, min_value: float | None = None,
                       value_col: str = "booking_value") -> DataFrame:
    """FL5 / FL6: optional row filters before segmentation (pushed into the scan by Catalyst)."""
    if completed_only and "is_completed" in df.columns:
        df = df.where(F.col("is_completed") == 1)
    if min_value is not None and value_col in df.columns:
        df = df.where(F.col(value_col) >= F.lit(float(min_value)))
    return df


# ---------------------------------------------------------------------------- IM1
def parse_number(c: Column) -> Column:
    """Text -> double where the text is a number; everything else -> null (never NaN)."""
    return F.when(c.rlike(NUMBER_RE), c.try_cast("double"))


def cast_profile_df(df: DataFrame, protect: Iterable[str] = PROTECTED,
                    threshold: float = CAST_THRESHOLD) -> DataFrame:
    """IM1 step 1 as a frame ``column_name, share, to_double``: share of **all** rows per
    unprotected text column that parse as a number (one aggregate, then an unpivot of its row)."""
    cands = [c for c in string_columns(df) if c not in set(protect)]
    shares = df.agg(*[F.avg(parse_number(F.replace(F.col(c), F.lit(","), F.lit("."))).isNotNull().cast("double"))
                      .alias(c) for c in cands])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0.0)).alias("share"))
                      for c in cands])
    return (shares.select(F.explode(pairs).alias("p")).select("p.*")
            .withColumn("to_double", F.col("share") >= F.lit(threshold)))


def cast_profile(df: DataFrame, protect: Iterable[str] = PROTECTED) -> dict[str, float]:
    """IM1 step 1 on the driver: ``{column: share}`` (one row per text column comes back)."""
    if not [c for c in string_columns(df) if c not in set(protect)]:
        return {}
    return {r["column_name"]: r["share"] for r in cast_profile_df(df, protect).collect()}


def smart_cast(df: DataFrame, threshold: float = CAST_THRESHOLD, protect: Iterable[str] = PROTECTED,
               decision: Mapping[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """IM1 + ST4: decimal comma -> dot in every unprotected text column; columns where at least
    ``threshold`` of the rows parse become double.  ``decision`` (from ``cast_profile``) may be
    pinned so the schema does not depend on the data.  Returns (frame, profile)."""
    profile = dict(decision) if decision is not None else cast_profile(df, protect)
    exprs = {}
    for c, share in profile.items():
        dotted = F.replace(F.col(c), F.lit(","), F.lit("."))
        exprs[c] = parse_number(dotted) if share >= threshold else dotted
    return df.withColumns(exprs), profile


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


# ---------------------------------------------------------------------------- IM2-IM5
def _as_number(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if is_numeric(df, c) else parse_number(F.col(c))


def fill_counts(df: DataFrame, cols: Iterable[str] = COUNT_COLS) -> DataFrame:
    """IM2: count columns as double, missing -> 0."""
    return df.withColumns({c: F.coalesce(_as_number(df, c), F.lit(0.0)) for c in cols if c in df.columns})


def fill_cancelled(df: DataFrame, cols: Iterable[str] = ZERO_IF_CANCELLED) -> DataFrame:
    """IM3: value / distance as double; missing -> 0 only on cancelled rides."""
    out = {}
    for c in cols:
        if c in df.columns:
            v = _as_number(df, c)
            out[c] = F.when(F.col("is_cancelled") == 1, F.coalesce(v, F.lit(0.0))).otherwise(v)
    return df.withColumns(out)


def fill_constants(df: DataFrame, reason_cols: Iterable[str] = REASON_COLS,
                   payment_col: str = "payment_method") -> DataFrame:
    """IM4 / IM5: reasons that are still text -> "Not Applicable"; payment method -> "Unknown"."""
    text = set(string_columns(df))
    fills = {c: NOT_APPLICABLE for c in reason_cols if c in text}
    if payment_col in text:
        fills[payment_col] = UNKNOWN_PAYMENT
    return df.na.fill(fills) if fills else df


# ---------------------------------------------------------------------------- FE2
def fit_caps(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99,
             method: str = "exact") -> dict[str, tuple[float | None, float | None]]:
    qs = quantiles(df, cols, [low, high], method)
    return {c: (v[0], v[1]) for c, v in qs.items()}


def apply_caps(df: DataFrame, caps: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip to the bounds; a null stays null (``least``/``greatest`` skip nulls, hence the guard)."""
    out = {}
    for c, (lo, hi) in caps.items():
        if lo is None:
            continue
        x = F.col(c).cast("double")
        out[c] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return df.withColumns(out)


def quantile_cap(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99,
                 method: str = "exact") -> DataFrame:
    """FE2: clip to the 1 % / 99 % quantiles (the reference names it an IQR cap)."""
    cols = [c for c in cols if c in df.columns]
    return apply_caps(df, fit_caps(df, cols, low, high, method))


# ---------------------------------------------------------------------------- FE3
def fit_rare(df: DataFrame, fracs: Mapping[str, float]) -> dict[str, dict]:
    """Frequent values per column: share of all rows (nulls in the denominator) >= min_frac.

    At most ``1 / min_frac`` values per column come back (100 at 1 %, 2,000 at 0.05 %), so the
    result has a proven size bound whatever the number of rare values.
    """
    cols = [c for c in fracs if c in df.columns]
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("kv")).select("kv.*").groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)  # read twice below
    totals = counts.groupBy("name").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("c"))).alias("nn"))
    limit = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(fracs[c])))])
    kept = (counts.join(F.broadcast(totals), "name")
            .where((F.col("c") / F.col("n") >= limit[F.col("name")]) | F.col("value").isNull())
            .select("name", "value", "c", "n", "nn", F.lit(False).alias("is_total")))
    rows = kept.unionByName(totals.select("name", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("c"),
                                          "n", "nn", F.lit(True).alias("is_total"))).collect()
    fitted = {c: {"frequent": [], "null_frequent": False, "all_null": True, "has_rare": False} for c in cols}
    covered = {c: 0 for c in cols}
    totals_by = {}
    for r in rows:
        info = fitted[r["name"]]
        if r["is_total"]:
            totals_by[r["name"]] = r["nn"] or 0
            info["all_null"] = not r["nn"]
            continue
        frequent = r["c"] / r["n"] >= fracs[r["name"]]
        if r["value"] is None:
            info["null_frequent"] = frequent
            info["has_rare"] = info["has_rare"] or not frequent
        else:
            info["frequent"].append(r["value"])
            covered[r["name"]] += r["c"]
    for c, info in fitted.items():
        if covered[c] < totals_by.get(c, 0):
            info["has_rare"] = True
        info["frequent"].sort()
    counts.unpersist()
    return fitted


def apply_rare(df: DataFrame, fitted: Mapping[str, dict], other: str = OTHER) -> DataFrame:
    out = {}
    for c, info in fitted.items():
        if info["all_null"] or not info["has_rare"]:
            continue  # all-null column or nothing rare: untouched
        col = F.col(c)
        null_to = F.lit(None).cast("string") if info["null_frequent"] else F.lit(other)
        out[c] = F.when(col.isNull(), null_to).when(col.isin(info["frequent"]), col).otherwise(F.lit(other))
    return df.withColumns(out)


def collapse_rare(df: DataFrame, fracs: Mapping[str, float], other: str = OTHER) -> DataFrame:
    """FE3: values whose share is below ``fracs[col]`` become ``other`` (a rare null too)."""
    return apply_rare(df, fit_rare(df, fracs), other)


def rare_fracs(cols: Iterable[str]) -> dict[str, float]:
    """Default thresholds: 0.05 % for locations, 1 % otherwise."""
    return {c: (RARE_FRAC_LOCATION if c in LOCATION_COLS else RARE_FRAC) for c in cols}

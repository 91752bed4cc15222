"""ME1-ME4: forecast error metrics, one aggregate per (series, model)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.series import SERIES

# Fixed value: the floor the reference uses for zero denominators.
EPS = 1e-6


def _err(y: Column, p: Column) -> Column:
    return y - p


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(_err(y, p)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(_err(y, p), 2)))


def mape_positive(y: Column, p: Column) -> Column:
    """ME3: only points with y > 0; null when there are none."""
    return F.avg(F.when(y > 0, F.abs(_err(y, p) / y))) * 100


def mape_floor(y: Column, p: Column) -> Column:
    """ME2: divide by max(y, 1e-6)."""
    return F.avg(F.abs(_err(y, p) / F.greatest(y, F.lit(EPS)))) * 100


def smape(y: Column, p: Column) -> Column:
    """ME4: denominator |y| + |p|, 0 replaced by 1e-6."""
    den = F.abs(y) + F.abs(p)
    return F.avg(2.0 * F.abs(p - y) / F.when(den == 0, F.lit(EPS)).otherwise(den)) * 100


def forecast_metrics(fc: DataFrame, by: Sequence[str] = (SERIES, "model"), version: str = "v2",
                     y: str = "y", pred: str = "y_pred") -> DataFrame:
    """``version="v2"``: mae, rmse, mape (y > 0), smape.  ``version="v1"``: mae, rmse, mape (floor)."""
    yc, pc = F.col(y).cast("double"), F.col(pred).cast("double")
    aggs = [F.count(pc).alias("n"), mae(yc, pc).alias("mae"), rmse(yc, pc).alias("rmse")]
    if version == "v2":
        aggs += [mape_positive(yc, pc).alias("mape"), smape(yc, pc).alias("smape")]
    elif version == "v1":
        aggs += [mape_floor(yc, pc).alias("mape")]
    else:
        raise ValueError("version must be 'v1' or 'v2'")
    return fc.groupBy(*by).agg(*aggs)

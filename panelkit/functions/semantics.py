"""Column helpers that pin down null, rounding, order and numeric rules.

pandas / scikit-learn defaults and Spark's ANSI defaults differ in many small
ways (division by zero, NaN vs NULL, half-even rounding, ddof, median, first /
last non-null).  Every operator goes through these helpers so the rule is
stated once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: ColumnOrName) -> Column:
    """Lenient numeric coercion: text that is not a number becomes NULL
    (never an ANSI cast error); NaN / +-inf become NULL as well."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def to_int(c: ColumnOrName) -> Column:
    return col(c).try_cast("double").try_cast("int")


def clean_text(c: ColumnOrName) -> Column:
    """Trim; blank text becomes NULL (a NULL stays NULL, never the text 'nan')."""
    t = F.trim(col(c).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def is_blank(c: ColumnOrName, sentinels: Iterable[str] = ("NAN", "NULL")) -> Column:
    """True for NULL, empty / whitespace text or a sentinel word (case-insensitive)."""
    t = F.upper(F.trim(col(c).cast("string")))
    return col(c).isNull() | (t == "") | t.isin(list(sentinels))


def div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """x / 0 and x / NULL give NULL (pandas gives inf, scrubbed to NaN)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def bround(c: ColumnOrName, scale: int) -> Column:
    """Half-even rounding, as pandas / numpy ``round``."""
    return F.bround(col(c).cast("double"), scale)


CONST_TOL = 1e-9


def spread(x: Column) -> Column:
    """Population sd, or 0 when it is below ``CONST_TOL`` of |mean|: a column
    that is constant up to float noise of an upstream average is constant."""
    sd = F.stddev_pop(x)
    return F.when(sd <= F.lit(CONST_TOL) * F.abs(F.avg(x)), F.lit(0.0)).otherwise(sd)


def safe_corr(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Pearson r on pairwise-complete rows; NULL (not an error) when either
    side is constant or fewer than two pairs exist."""
    xc, yc = col(x).cast("double"), col(y).cast("double")
    both = xc.isNotNull() & yc.isNotNull()
    xs, ys = F.when(both, xc), F.when(both, yc)
    return F.try_divide(F.covar_pop(xs, ys), spread(xs) * spread(ys))


def pair_count(x: ColumnOrName, y: ColumnOrName) -> Column:
    return F.count_if(col(x).isNotNull() & col(y).isNotNull())


def last_non_null(c: ColumnOrName, order: ColumnOrName) -> Column:
    """pandas ``groupby().last()``: the last non-null value of *this* column."""
    cc = col(c)
    return F.max_by(cc, F.when(cc.isNotNull(), col(order)))


def first_non_null(c: ColumnOrName, order: ColumnOrName) -> Column:
    cc = col(c)
    return F.min_by(cc, F.when(cc.isNotNull(), col(order)))


def mode_smallest(c: ColumnOrName) -> Column:
    """pandas ``mode().iat[0]``: most frequent value, smallest on ties."""
    return F.mode(col(c), deterministic=True)


def sd_sample(c: ColumnOrName) -> Column:
    return F.stddev_samp(col(c))


def sd_pop(c: ColumnOrName) -> Column:
    return F.stddev_pop(col(c))


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Scrub NaN / inf to NULL in floating columns (stage tables hold no NaN)."""
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))
               and (cols is None or f.name in set(cols))]
    if not targets:
        return df
    return df.withColumns({c: to_double(c) for c in targets})


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """``select_dtypes('number')`` by schema, never by position."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def row_non_null_count(cols: Iterable[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Iterable[str]) -> Column:
    """Skip-null mean across columns (pandas ``mean(axis=1)``)."""
    cs = list(cols)
    s = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.try_divide(s, row_non_null_count(cs).cast("double"))


def row_sum(cols: Iterable[str]) -> Column:
    cs = list(cols)
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))


def bands_closed_right(c: ColumnOrName, bins: list[tuple[float, float, str]]) -> Column:
    """``pd.cut`` semantics: (a, b] bins; outside every bin -> NULL."""
    x = col(c)
    out = None
    for lo, hi, label in bins:
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def bands_closed_left(c: ColumnOrName, bands: list[tuple[str, float, float]],
                      fallback: str | None) -> Column:
    """[low, high) bands; non-null values outside every band get ``fallback``."""
    x = col(c)
    out = None
    for label, lo, hi in bands:
        cond = (x >= F.lit(lo)) & (x < F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(
        out.otherwise(F.lit(fallback)))


def require_columns(df: DataFrame, required: Iterable[str], where: str = "input") -> None:
    """Input contract: raise listing the missing columns, sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{where}: missing required columns: {', '.join(missing)}")

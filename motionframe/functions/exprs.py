"""Column expressions used by several operators.

Everything here is a built-in Spark expression, so it stays inside code generation.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*names: str) -> Column:
    """Euclidean norm of the named columns."""
    total = F.col(names[0]) * F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name) * F.col(name)
    return F.sqrt(total)


def ratio(numerator, denominator) -> Column:
    """Quotient that is 0 for a zero (or missing) denominator."""
    return F.coalesce(F.try_divide(_d(numerator), _d(denominator)), F.lit(0.0))


def defined_ratio(numerator, denominator) -> Column:
    """Quotient that is NULL (undefined) for a zero denominator."""
    return F.try_divide(_d(numerator), _d(denominator))


def _d(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("double")


def r6(value) -> Column:
    """Six-digit rounding used for published result tables; removes a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def hash_draw(*parts) -> Column:
    """Reproducible non-negative integer below 2**32 from the md5 of ':'-joined parts.

    Draws are a function of the row's key alone, so a re-run task repeats them.
    """
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def clip_probability(column: Column, tolerance: float = 1e-6) -> Column:
    """A score inside [0, 1] up to the tolerance, clipped; anything else fails the job."""
    inside = column.isNotNull() & ~F.isnan(column) & column.between(-tolerance, 1.0 + tolerance)
    return F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), column))).otherwise(
        F.raise_error(F.lit("score outside [0, 1]")).cast("double")
    )


def canonical_json(fields: dict) -> Column:
    """Compact JSON object with its keys in sorted order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def canonical_digest(fields: dict) -> Column:
    return F.sha2(canonical_json(fields), 256)


def truth(column: Column) -> Column:
    """Boolean text: 1, true or yes in any case."""
    return F.lower(F.trim(column.cast("string"))).isin("1", "true", "yes")


def compatible_version(actual: Column, expected: Column) -> Column:
    """Same major version; below 1.0 the whole version must be equal. NULL if malformed."""
    pattern = r"^(\d+)\.(\d+)\.(\d+)$"
    ok = actual.rlike(pattern) & expected.rlike(pattern)
    major = F.regexp_extract(actual, pattern, 1)
    same_major = major == F.regexp_extract(expected, pattern, 1)
    return F.when(ok, F.when(major == "0", actual == expected).otherwise(same_major))


def score_cell(score: Column, cells: int = 4096) -> Column:
    """Monotone cell number of any finite score (about 2*cells cells on each side of 0).

    Each branch uses one correctly rounded operation, so order is never reversed.
    """
    size = F.abs(score)
    cell = F.when(size <= 1.0, F.floor(size * float(cells))).otherwise(
        F.lit(2 * cells) - F.ceil(F.lit(float(cells)) / size)
    )
    return F.when(score < 0, -cell - 1).otherwise(cell).cast("long")

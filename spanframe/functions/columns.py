"""Column expressions: all JVM side, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromosome names in their canonical order.
CANONICAL_CHROMS = [f"chr{n}" for n in range(1, 23)] + ["chrX", "chrY"]
AUTOSOMES = CANONICAL_CHROMS[:22]

# Patient part and whole form of a sample barcode.
PATIENT_PATTERN = r"^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})(-[A-Z0-9]+)+$"

# Percent cut-offs of the low / intermediate / high classes.
LOW_CUTOFF = 0.2
HIGH_CUTOFF = 0.7


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def safe_divide(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom`` as double; null for a zero or null denominator."""
    return F.try_divide(_c(top).cast("double"), _c(bottom).cast("double"))


def f1_score(precision: Column | str, recall: Column | str) -> Column:
    p, r = _c(precision), _c(recall)
    return safe_divide(p * r * 2.0, p + r)


def clip(column: Column | str, low, high) -> Column:
    """Clip to [low, high]; null stays null."""
    c = _c(column)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def half_even(column: Column | str) -> Column:
    """Round half to even, as a bigint."""
    return F.rint(_c(column)).cast("bigint")


def nan_to_null(column: Column | str) -> Column:
    c = _c(column)
    return F.when(~F.isnan(c), c)


def normalize_chrom(column: Column | str) -> Column:
    """``1``, ``chr1``, ``CHR1`` -> ``chr1``; anything not canonical -> null."""
    bare = F.regexp_replace(F.trim(_c(column).cast("string")), r"(?i)^chr", "")
    name = F.concat(F.lit("chr"), F.upper(bare))
    return F.when(name.isin(CANONICAL_CHROMS), name)


def chrom_rank(column: Column | str) -> Column:
    """1-based canonical order; unknown names sort last."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CANONICAL_CHROMS]), _c(column))
    return F.when(rank > 0, rank).otherwise(F.lit(len(CANONICAL_CHROMS) + 1)).cast("int")


def beta_value(meth: Column | str = "meth", coverage: Column | str = "coverage",
               zero_coverage: str = "null") -> Column:
    """``meth / coverage``; zero coverage gives null or 0.0 ("drop" filters the null)."""
    ratio = safe_divide(meth, coverage)
    return F.coalesce(ratio, F.lit(0.0)) if zero_coverage == "zero" else ratio


def beta_class(beta: Column | str, low: float = LOW_CUTOFF, high: float = HIGH_CUTOFF) -> Column:
    b = _c(beta)
    return F.when(b < low, "low").when(b <= high, "intermediate").when(b > high, "high")


def patient_id(barcode: Column | str) -> Column:
    """First three barcode fields; any other form raises."""
    b = _c(barcode)
    found = F.regexp_extract(b, PATIENT_PATTERN, 1)
    return F.when(found != "", found).otherwise(
        F.raise_error(F.concat(F.lit("not a sample barcode: "), F.coalesce(b, F.lit("null")))).cast("string"))


def sample_label(sample_type: Column | str) -> Column:
    return F.when(_c(sample_type) == "Solid Tissue Normal", "Normal").otherwise("Tumor")


def stable_seed(global_seed: int, name: Column | str) -> Column:
    """First 8 hex digits of SHA-256 over ``<seed>:<name>`` as a bigint."""
    text = F.concat(F.lit(f"{global_seed}:"), _c(name).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def key_hash(seed, *columns: Column | str) -> Column:
    """Hex digest of the seed and key columns: a sort key that depends on
    nothing but the row's key (not on partitions or arrival order)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[_c(c).cast("string") for c in columns]))


def unit_hash(seed, *columns: Column | str) -> Column:
    """A uniform [0, 1) number derived from the key."""
    digits = F.substring(key_hash(seed, *columns), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16 ** 13))


def bp_label(column: Column | str) -> Column:
    """41828 -> ``41.83kb``; trailing zeros are cut."""
    c = _c(column)

    def scaled(unit: float, suffix: str) -> Column:
        text = F.format_string("%.2f", c.cast("double") / unit)
        return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit(suffix))

    return (F.when(c >= 1_000_000, scaled(1e6, "mb"))
            .when(c >= 1_000, scaled(1e3, "kb"))
            .otherwise(F.concat(c.cast("bigint").cast("string"), F.lit("bp"))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)

"""Column expressions; everything here stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text and width of a customer number, and its form when missing.
ID_WIDTH = 6
MISSING_ID = "000nan"
CANCELLED_PREFIX = "C"


def is_cancelled(invoice: Column) -> Column:
    """True for invoice numbers with the cancellation prefix; a null invoice is not cancelled."""
    return F.coalesce(invoice.startswith(CANCELLED_PREFIX), F.lit(False))


def zero_fill(text: Column, width: int) -> Column:
    """Left-pad with zeros after any sign; longer text is left as it is."""
    sign = F.regexp_extract(text, "^[+-]", 0)
    digits = F.substr(text, F.length(sign) + 1)
    padded = F.concat(sign, F.repeat(F.lit("0"), F.lit(width) - F.length(text)), digits)
    return F.when(F.length(text) < width, padded).otherwise(text)


def normalize_customer_id(raw: Column, missing_id: str = "drop") -> Column:
    """Customer number as text: every ``.0`` removed, zero-filled to six characters.

    A null stays null with ``missing_id="drop"``, so that cleaning can drop it, and becomes
    the placeholder text with ``missing_id="placeholder"``.
    """
    text = zero_fill(F.replace(raw.cast("string"), F.lit(".0"), F.lit("")), ID_WIDTH)
    if missing_id == "placeholder":
        return F.coalesce(text, F.lit(MISSING_ID))
    if missing_id == "drop":
        return text
    raise ValueError(f"missing_id must be 'drop' or 'placeholder', not {missing_id!r}")


def parse_invoice_date(text: Column) -> Column:
    """Timestamp without zone from ``yyyy-MM-dd HH:mm:ss`` or ``M/d/yyyy H:mm`` text."""
    iso = F.regexp_replace(
        text,
        r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})$",
        "$3-$1-$2 $4:$5:00",
    )
    return iso.try_cast("timestamp_ntz")


def total_price() -> Column:
    return F.col("Quantity") * F.col("UnitPrice")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days between two timestamps, not calendar days."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def box_cox(x: Column, lam: float | Column) -> Column:
    """(x**lam - 1) / lam, and ln x at lam = 0, written so that small lam keeps its digits."""
    return box_cox_of_log(F.log(x), lam)


def box_cox_of_log(log_x: Column, lam: float | Column) -> Column:
    """``box_cox`` of a value given by its logarithm."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lam == 0, log_x).otherwise(F.expm1(lam * log_x) / F.nullif(lam, F.lit(0.0)))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index of the equal-width bin holding ``x``; the last bin is closed on the right.

    The division can land one bin off for values on an edge, so the index is corrected
    against the edges themselves.
    """
    width = (hi - lo) / bins
    first = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return (
        F.when(x < lo + first * width, first - 1)
        .when((x >= lo + (first + 1) * width) & (first < bins - 1), first + 1)
        .otherwise(first)
    )


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """Look a fixed display name up."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.create_map(*pairs)[key]


def persona_of(cluster: Column, names: list[str] | None, fallback: str = "Nhóm") -> Column:
    """Persona by cluster position.

    Clusters beyond the list are called ``<fallback> <number>``, and without a list all
    clusters are called ``Nhóm <number>``.
    """
    prefix = fallback if names else "Nhóm"
    default = F.concat(F.lit(f"{prefix} "), cluster.cast("string"))
    if not names:
        return default
    by_position = F.create_map(*[F.lit(v) for item in enumerate(names) for v in item])
    return F.coalesce(F.try_element_at(by_position, cluster.cast("int")), default)

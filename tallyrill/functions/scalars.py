"""Scalar functions: money, time, JSON, ids and labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity, as a long."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def format_usd(cents: Column) -> Column:
    """$1,234, or a dash for none."""
    return F.when(cents.isNull(), F.lit("—")).otherwise(F.concat(F.lit("$"), grouped(half_up(cents / F.lit(100.0)))))


def format_usd_range(cents: Column, low: Column, high: Column) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(format_usd(low), F.lit("–"), format_usd(high)))
        .when(low.isNotNull(), F.concat(format_usd(low), F.lit("+")))
        .when(high.isNotNull(), F.concat(F.lit("under "), format_usd(high)))
        .otherwise(format_usd(cents))
    )


def time_ago(moment: Column, now: Column) -> Column:
    """Minutes, hours, days, months of 30 days, years of 12 such months, all rounded down; just now below a minute, empty for none."""
    s = F.greatest(F.lit(0), F.timestamp_diff("SECOND", moment, now))
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    months = F.floor(days / 30)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(moment.isNull(), "")
        .when(s < 60, "just now")
        .when(minutes < 60, said(minutes, "m ago"))
        .when(hours < 24, said(hours, "h ago"))
        .when(days < 30, said(days, "d ago"))
        .when(months < 12, said(months, "mo ago"))
        .otherwise(said(F.floor(months / 12), "y ago"))
    )


def hash_ip(ip: Column, moment: Column) -> Column:
    """sha256 of ip:YYYY-MM-DD; of the first address where ip is a forwarding list; null without one."""
    first = F.trim(F.element_at(F.split(ip, ","), 1))
    return F.when(F.coalesce(first, F.lit("")) != "", F.sha2(F.concat_ws(":", first, F.date_format(moment, "yyyy-MM-dd")), 256))


def safe_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def fallback_id(url: Column, most: int = 191) -> Column:
    """The last segment of a URL's path."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    return F.substring(F.try_element_at(parts, F.lit(-1)), 1, most)


def rotation(epoch_seconds: Column, n: int, bucket: int = 900) -> Column:
    """Which of n sources is due in this time bucket."""
    return F.pmod(F.floor(epoch_seconds / bucket), F.lit(n))


def in_hour_gate(moment: Column, hour: int, minutes: int = 20) -> Column:
    return (F.hour(moment) == hour) & (F.minute(moment) < minutes)


def clamp_whole(x: Column, low: int, high: int, fallback: int) -> Column:
    """Whole part within bounds; fallback where x is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.greatest(F.floor(x), F.lit(low)), F.lit(high))).otherwise(F.lit(fallback))


def clamp_real(x: Column, low: float, high: float) -> Column:
    """Within bounds, not rounded; the lower bound where x is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))).otherwise(F.lit(float(low)))


def tri_state(x: Column) -> Column:
    """true, false or null of '1', 'true', '0', 'false' in any case; null otherwise."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def number_or_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x).try_cast("double")


def effective(reviewed: Column, review: Column, own: Column) -> Column:
    """The review's value, even if null, where the field was reviewed; else the row's own."""
    return F.when(reviewed, review).otherwise(own)


def notes_resolved(*notes: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in notes])


def usd_to_cents(text: Column) -> Column:
    """Cents of a form value such as '$1,234.50'; null if it is none or negative."""
    number = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    value = F.when(number != "", number).try_cast("double")
    return F.when(value >= 0, half_up(value * 100))


def midpoint(low: Column, high: Column) -> Column:
    return half_up((low + high) / F.lit(2.0))


def brand_outcome(reviewed: Column, brand: Column) -> Column:
    """value, unknown or unset."""
    known = F.coalesce(F.trim(brand), F.lit("")) != ""
    return F.when(~F.coalesce(reviewed, F.lit(False)), "unset").when(known, "value").otherwise("unknown")


def brand_outcome_key(reviewed: Column, brand: Column) -> Column:
    out = brand_outcome(reviewed, brand)
    return F.when(out == "value", F.concat(F.lit("value:"), F.trim(brand))).otherwise(out)


def confidence_label(local: Column, ai: Column) -> Column:
    """L0.87/A0.91, of those above 0; a dash for none."""
    said = lambda tag, x: F.when(x > 0, F.concat(F.lit(tag), F.format_string("%.2f", x.cast("double"))))
    return F.coalesce(F.nullif(F.concat_ws("/", said("L", local), said("A", ai)), F.lit("")), F.lit("—"))


def source_label(source: Column, confidence: Column) -> Column:
    """The source's initial, with the confidence where it is above 0."""
    initial = F.upper(F.substring(F.coalesce(source, F.lit("")), 1, 1))
    return F.when((confidence > 0) & (initial != ""), F.concat(initial, F.format_string("%.2f", confidence.cast("double")))).otherwise(initial)


def gold_price_cell(cents: Column, low: Column, high: Column) -> Column:
    return (
        F.when(cents > 0, format_usd(cents))
        .when((low > 0) & (high > 0), F.concat(format_usd(low), F.lit("–"), format_usd(high)))
        .when(cents.isNull() & low.isNull() & high.isNull(), "Unknown")
        .otherwise("—")
    )


def subtitle(brand: Column, brand_raw: Column, reference: Column, reference_raw: Column, model_raw: Column) -> Column:
    """brand · reference, each parsed or else raw; or the raw model; or null."""
    some = lambda a, b: F.nullif(F.coalesce(a, b), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" · ", some(brand, brand_raw), some(reference, reference_raw)), F.lit("")), F.nullif(F.trim(model_raw), F.lit("")))

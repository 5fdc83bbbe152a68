"""Numbers, dates, names and amounts from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they are without.
MARKED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def cleaned_number(text: Column) -> Column:
    """A number's digits, separators and sign: without currency, spaces and brackets; (1) and 1- are negative."""
    bare = F.regexp_replace(F.trim(text), r"(?i)R\$|US\$|[$€£]|brl|usd|eur|[\s ]", "")
    negative = bare.rlike(r"^\(.*\)$|^[-−]|[-−]$")
    digits = F.regexp_replace(bare, r"[()+−-]", "")
    return F.when(digits.rlike(r"^[0-9.,]*[0-9][0-9.,]*$"), F.concat(F.when(negative, "-").otherwise(""), digits))


def parsed_number(text: Column, decimal: str) -> Column:
    """A cleaned number as DECIMAL(38,10), read with a decimal comma or point; null if it isn't one."""
    other = "." if decimal == "," else ","
    plain = F.replace(F.replace(cleaned_number(text), F.lit(other), F.lit("")), F.lit(decimal), F.lit("."))
    return plain.try_cast("decimal(38,10)")


def decimal_votes(text: Column) -> tuple[Column, Column]:
    """Votes for a decimal comma and for a decimal point: 1 where both marks occur or decimals are plain, 0.5 for doubtful thousands."""
    t = F.regexp_replace(text, r"[^0-9.,]", "")
    comma = F.when(t.rlike(r"\..*,[0-9]+$|^[0-9]+,[0-9]{1,2}$"), 1.0).when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), 0.5).otherwise(0.0)
    point = F.when(t.rlike(r",.*\.[0-9]+$|^[0-9]+\.[0-9]{1,2}$"), 1.0).when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), 0.5).otherwise(0.0)
    return comma, point


def parsed_date(text: Column, day_first: bool = True) -> Column:
    """A date in one of the usual writings, an ISO date before a time, or a spreadsheet's serial number; else null."""
    t = F.trim(text)
    order = ["d/M/y", "d-M-y", "d.M.y"] if day_first else ["M/d/y", "M-d-y"]
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    usual = [F.when(t.rlike(rf"^[0-9]{{1,2}}[{p[1]}][0-9]{{1,2}}[{p[1]}][0-9]{{4}}$"), F.try_to_date(t, p.replace("y", "yyyy"))) for p in order]
    serial = t.try_cast("double")
    excel = F.when((serial >= 20000) & (serial <= 80000), F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")))
    return F.coalesce(iso, *usual, excel)


def plain_name(text: Column) -> Column:
    """A column's name in lower-case ASCII, everything else as one underscore."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", "_"), F.lit("_"))


def merchant_key(text: Column) -> Column:
    """Letters of a description only, without marks, case, digits and punctuation."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z]+", " "))


def budget_limit(text: Column) -> Column:
    """A limit in Brazilian or plain writing; null where a single mark before three digits leaves it open."""
    bare = F.regexp_replace(F.trim(text), r"(?i)R\$|\s", "")
    plain = (
        F.when(bare.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$|^-?[0-9]{1,3}(\.[0-9]{3}){2,}$"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(bare.rlike(r"^-?[0-9]+,[0-9]{1,2}$"), F.replace(bare, F.lit(","), F.lit(".")))
        .when(bare.rlike(r"^-?[0-9]{1,3}\.[0-9]{3}$"), F.replace(bare, F.lit("."), F.lit("")))
        .when(bare.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$"), bare)
    )
    return plain.try_cast("decimal(18,2)")


def months_apart(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def money(value: Column) -> Column:
    """Two places, halves to even, exact for decimals."""
    return F.bround(value, 2)


def cost(fresh_in: Column, cached: Column, out: Column, price_in: Column, price_cache: Column, price_out: Column) -> Column:
    """USD of a call: cached tokens at their own price, or at the input's where that is 0; prices are per million."""
    fresh = F.greatest(fresh_in - cached, F.lit(0))
    return (fresh * price_in + cached * F.when(price_cache > 0, price_cache).otherwise(price_in) + out * price_out) / F.lit(1_000_000)


def from_file_name(name: Column) -> Column:
    """The day that a photo's name tells: 20240131, 2024-01-31 or 2024_01_31 in it; else null."""
    digits = F.regexp_replace(F.regexp_extract(name, r"(20[0-9]{2}[-_]?[01][0-9][-_]?[0-3][0-9])", 1), "[-_]", "")
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def grown(principal: Column, yearly_rate: Column, days: Column, tax: Column) -> Column:
    """What principal becomes by compound interest over days, with tax on the gain."""
    gain = principal * (F.pow(1 + yearly_rate, days / 365.0) - 1)
    return F.round(principal + gain * (1 - tax), 2)


def shown(value: Column, kind: str) -> Column:
    """A number as text: percent (a share, one decimal), usd (four decimals below a cent, else two) or number (thousands marked); - for null."""
    if kind == "percent":
        text = F.concat(F.format_string("%.1f", value.cast("double") * 100), F.lit("%"))
    elif kind == "usd":
        v = value.cast("double")
        text = F.concat(F.lit("$"), F.when((v != 0) & (F.abs(v) < 0.01), F.format_string("%.4f", v)).otherwise(F.format_string("%.2f", v)))
    else:
        text = F.format_number(value.cast("double"), 0)
    return F.when(value.isNull(), "-").otherwise(text)

"""Column expressions for periods, names, units and windows. No user-defined functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.model import Caliber, Refused

# Units with their group and power of ten.
UNITS = {"元": ("money", 0), "千元": ("money", 3), "万元": ("money", 4), "亿元": ("money", 8), "比率": ("ratio", 0), "%": ("ratio", -2)}
# Endings of company names.
COMPANY_FORMS = ("股份有限公司", "有限责任公司", "集团有限公司", "集团公司", "有限公司", "子公司", "分公司", "集团", "公司", "有限", "责任", "厂", "本部")
# What a name's spelling may differ in.
NOISE = r"""[\s\p{Z}\x{FEFF} ()\[\]{}<>《》、,，.。;；:：!！?？'"“”‘’`~·\-_—/\\|]+"""


def parse_period(text: Column) -> Column:
    """First day of the month a text names, or null: 2026-06, 2026/6, 2026.6, 2026年6月, 202606, full dates, a trailing time."""
    head = F.regexp_extract(F.trim(text), r"^([^T\s]*)", 1)
    long = r"^(\d{4})[-/.年](\d{1,2})月?(?:[-/.]?\d{1,2}日?)?$"
    short = r"^(\d{4})(\d{2})$"
    pattern = F.when(F.regexp_like(head, F.lit(long)), F.lit(long)).otherwise(F.lit(short))
    part = lambda i: F.regexp_extract_all(head, pattern, F.lit(i))
    year, month = (F.try_element_at(part(i), F.lit(1)).try_cast("int") for i in (1, 2))
    good = year.between(1900, 2200) & month.between(1, 12)
    return F.when(good, F.make_date(year, month, F.lit(1)))


def excel_serial_date(number: Column) -> Column:
    """The day a spreadsheet serial number stands for (1900 system); null before 61 and outside 1900 to 2200."""
    days = F.floor(number).cast("int")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.when((number >= 61) & (number < 120_000), days))
    return F.when(F.year(day).between(1900, 2200), day)


def typed_period(kind: Column, text: Column, declared_date: bool) -> Column:
    serial = excel_serial_date(text.try_cast("double")) if declared_date else F.lit(None).cast("date")
    return F.when(kind == "number", F.trunc(serial, "MM")).when(kind == "text", parse_period(text))


def normalize_name(name: Column) -> Column:
    """Full-width forms to plain ones, spelling noise away, small letters."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.lower(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), wide, plain), NOISE, ""))


def company_stem(name: Column) -> Column:
    """The normalised name without one ending that tells the company's form; a name that is just such an ending stays."""
    n = normalize_name(name)
    out = F.when(n.isin(*COMPANY_FORMS), n)
    for form in sorted(COMPANY_FORMS, key=len, reverse=True):
        out = out.when(n.endswith(form), F.left(n, F.length(n) - len(form)))
    return out.otherwise(n)


def entity_id(name: Column, prefix: str) -> Column:
    """A stable id: the 31-multiplier hash of the name's characters modulo 2**32, in base 36."""
    codes = F.filter(F.split(name, ""), lambda c: c != "")
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)
    return F.concat(F.lit(prefix), F.left(F.lower(F.conv(h.cast("string"), 10, 36)), F.lit(8)))


def unit_factor(source: str, target: str) -> Decimal:
    if source == target:
        return Decimal(1)
    if source not in UNITS or target not in UNITS or UNITS[source][0] != UNITS[target][0]:
        raise Refused("TRANSFORM_VALUE_INVALID", f"{source} to {target}")
    return Decimal(10) ** (UNITS[source][1] - UNITS[target][1])


def unit_convert(value: Column, source: str, target: str, scale: int = 2, negate: bool = False) -> tuple[Column, Column]:
    """The converted decimal, rounded half up, and whether rounding changed it; null where the value is no number or doesn't fit."""
    exact = value.try_cast("decimal(28,10)") * F.lit(-unit_factor(source, target) if negate else unit_factor(source, target))
    rounded = F.round(exact, scale)
    return rounded.try_cast(f"decimal(18,{scale})"), exact != rounded


def unit_checked(value: Column, source: str, target: str, rounding: str = "half_up", scale: int = 2, negate: bool = False) -> tuple[Column, Column]:
    """The converted decimal, null where it is refused, and why: not a number, too large, or, with the rounding ``reject``, digits that would be lost."""
    if rounding not in ("half_up", "reject"):
        raise Refused("TRANSFORM_VALUE_INVALID", f"rounding {rounding}")
    amount, changed = unit_convert(value, source, target, scale, negate)
    why = F.when(value.isNull(), None).when(value.try_cast("double").isNull(), "not a number").when(amount.isNull(), "does not fit")
    why = why.when(changed, "would be rounded") if rounding == "reject" else why
    return F.when(why.isNull(), amount), why


def window_start(caliber: Caliber, month: Column) -> Column:
    if caliber.kind == "same":
        return month
    if caliber.kind == "year_start":
        return F.trunc(month, "YEAR")
    if caliber.kind == "since":
        return F.lit(caliber.since)
    raise Refused("CALIBER_IS_CALCULATOR")


def in_window(caliber: Caliber) -> Column:
    return F.col("period_from") == window_start(caliber, F.col("fin_month"))


def band(value: Column) -> Column:
    """A coarse text of an amount: hundred millions, ten thousands, thousands or units; null for what isn't finite."""
    v, sign = F.abs(value.cast("double")), F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    shown = lambda x, unit: F.concat(sign, F.format_string("%.1f", x), F.lit(unit))
    text = F.when(v >= 1e8, shown(v / 1e8, "亿")).when(v >= 1e4, shown(v / 1e4, "万")).when(v >= 1e3, shown(v / 1e3, "千")).otherwise(F.concat(sign, F.format_string("%.0f", v)))
    return F.when(value.isNotNull() & ~F.isnan(v) & (v < float("inf")), text)

"""Parsers of typed values: amounts, dates, periods, directions, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import upper_words


def _number(c: Column) -> Column:
    value = F.nullif(c, F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 1e300), value)


def _both(k: Column) -> Column:
    return k.contains(",") & k.contains(".")


def _last_is_decimal(k: Column) -> Column:
    """With both signs, the one that comes last is the decimal sign."""
    return F.when(k.rlike(r",[^.,]*$"), F.replace(F.replace(k, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(k, F.lit(","), F.lit("")))


def _kept(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9,.+-]", "")


def amount(c: Column, decimals: tuple[int, int] = (2, 2)) -> Column:
    """An amount with currency words. A lone comma is decimal if `decimals` (least, most) signs follow it, else it
    groups thousands; of several dots the last is decimal. Rounded to 2; null where it isn't a number."""
    k = _kept(c)
    lone = k.rlike(rf"^[^,]*,[^,]{{{decimals[0]},{decimals[1]}}}$")
    comma = F.when(lone, F.replace(k, F.lit(","), F.lit("."))).otherwise(F.replace(k, F.lit(","), F.lit("")))
    plain = F.when(_both(k), _last_is_decimal(k)).when(k.contains(","), comma).otherwise(F.regexp_replace(k, r"\.(?=.*\.)", ""))
    return F.round(_number(plain), 2)


def amount_comma_decimal(c: Column) -> Column:
    """An amount whose comma is always decimal; finite numbers only."""
    k = _kept(c)
    return _number(F.when(_both(k), _last_is_decimal(k)).otherwise(F.replace(k, F.lit(","), F.lit("."))))


def amount_short_decimal(c: Column) -> Column:
    """An amount whose lone comma is decimal if one or two digits follow."""
    return amount(c, (1, 2))


def iso_date(c: Column) -> Column:
    """A date of day, month and year with / - or . between, or year first, anywhere in the text; null otherwise."""
    s = F.regexp_replace(c, r"[\s_]", "")
    whole = F.coalesce(*(F.try_to_date(s, f) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d")))
    found = F.regexp_replace(F.regexp_extract(s, r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})", 1), "[.-]", "/")
    return F.coalesce(whole, F.try_to_date(found, "d/M/yyyy"))


def period(c: Column) -> Column:
    """yyyy-MM of a text with month and year in either order, apart by / - . or a space; null for months that don't exist."""
    s = F.trim(c)
    first = F.regexp_extract(s, r"^(\d{1,2})[/. -](\d{4})$", 1), F.regexp_extract(s, r"^(\d{1,2})[/. -](\d{4})$", 2)
    last = F.regexp_extract(s, r"^(\d{4})[/. -](\d{1,2})(?:[/. -]\d{1,2})?$", 2), F.regexp_extract(s, r"^(\d{4})[/. -](\d{1,2})(?:[/. -]\d{1,2})?$", 1)
    full = F.regexp_extract(s, r"^\d{1,2}[/.-](\d{1,2})[/.-](\d{4})$", 1), F.regexp_extract(s, r"^\d{1,2}[/.-](\d{1,2})[/.-](\d{4})$", 2)
    out = None
    for month, year in (first, last, full):
        m = F.nullif(month, F.lit("")).try_cast("int")
        e = F.when(m.between(1, 12), F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0")))
        out = e if out is None else F.coalesce(out, e)
    return out


def period_index(p: Column) -> Column:
    """Months since year 0 of a yyyy-MM period, so that consecutive periods differ by one."""
    return (F.substring(p, 1, 4).try_cast("int") * 12 + F.substring(p, 6, 2).try_cast("int")).cast("int")


#: French months and their abbreviations.
MONTHS = {
    "JANVIER": 1, "JANV": 1, "FEVRIER": 2, "FEVR": 2, "MARS": 3, "AVRIL": 4, "AVR": 4, "MAI": 5, "JUIN": 6, "JUILLET": 7, "JUIL": 7, "AOUT": 8,
    "SEPTEMBRE": 9, "SEPT": 9, "OCTOBRE": 10, "OCT": 10, "NOVEMBRE": 11, "NOV": 11, "DECEMBRE": 12, "DEC": 12,
}


def partial_date(c: Column) -> Column:
    """dd/mm as it is, else the ISO date; null where there is neither."""
    s = F.regexp_replace(c, r"[\s\p{Z}]", "")
    return F.when(s.rlike(r"^\d{2}/\d{2}$"), s).otherwise(F.date_format(iso_date(c), "yyyy-MM-dd"))


def period_in_words(c: Column) -> Column:
    """yyyy-MM of a text of this century that holds year and month, in figures in either order or the month as a French word; the
    first that holds: year and month, month and year, a whole date, a month's name beside a year."""
    u = upper_words(c)
    of = lambda pattern, year, month: F.when(u.rlike(pattern), F.concat_ws("-", F.regexp_extract(u, pattern, year), F.lpad(F.regexp_extract(u, pattern, month), 2, "0")))
    words = F.regexp_extract(u, r"\b(" + "|".join(MONTHS) + r")\b", 1)
    number = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))])[F.nullif(words, F.lit(""))]
    year = F.nullif(F.regexp_extract(u, r"\b(20\d{2})\b", 1), F.lit(""))
    named = F.when(number.isNotNull() & year.isNotNull(), F.concat_ws("-", year, number))
    return F.coalesce(of(r"\b(20\d{2}) (0?[1-9]|1[0-2])\b", 1, 2), of(r"\b(0?[1-9]|1[0-2]) (20\d{2})\b", 2, 1), named)


def period_number(c: Column) -> Column:
    """period_index() of a text with month and year in either order, with or without a day, apart by / - . _ or a space: few
    expressions, for plans that read several of them at once."""
    year_first = F.regexp_replace(F.trim(c), r"^(?:\d{1,2}[/._ -])?(\d{1,2})[/._ -](\d{4})$", "$2-$1")
    k = F.regexp_replace(year_first, r"^(\d{4})[/._ -](\d{1,2})(?:[/._ -]\d{1,2})?$", "$1-$2")
    return F.when(k.rlike(r"^\d{4}-(?:0?[1-9]|1[0-2])$"), F.substring_index(k, "-", 1).cast("int") * 12 + F.substring_index(k, "-", -1).cast("int"))


def direction(c: Column) -> Column:
    """C or D of the words for credit and debit; null otherwise."""
    u = upper_words(c)
    return F.when(u.isin("C", "CR", "CREDIT", "CREDITS"), "C").when(u.isin("D", "DB", "DEBIT", "DEBITS"), "D")


def flag(c: Column) -> Column:
    u = upper_words(c)
    return F.when(u.isin("TRUE", "OUI", "YES", "1", "VRAI", "PRESENT"), True).when(u.isin("FALSE", "NON", "NO", "0", "FAUX", "ABSENT"), False)


def sex(c: Column) -> Column:
    u = upper_words(c)
    return F.when(u.isin("M", "MASCULIN", "HOMME", "MALE"), "M").when(u.isin("F", "FEMININ", "FEMME", "FEMALE"), "F")

"""Text normalisers as Column expressions: no Python worker, so they stay inside whole-stage code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases(form: str) -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by decomposition; those that become one letter."""
    source, target = [], []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_NFD = _bases("NFD")


def fold(c: Column) -> Column:
    """Latin letters without their marks; marks that are written separately go as well. Null stays null."""
    return F.regexp_replace(F.translate(c, *_NFD), r"\p{M}+", "")


def fold_compatible(c: Column) -> Column:
    """fold() after resolving the compatibility forms that occur in scanned French text: ligatures, full-width blanks, ordinals."""
    pairs = (("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("№", "No"), ("º", "o"), ("ª", "a"), ("²", "2"), ("³", "3"), ("¹", "1"), ("½", "1/2"), (" ", " "), (" ", " "), ("　", " "))
    return fold(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c))


def clean_spaces(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")), F.lit(""))


def upper_words(c: Column) -> Column:
    """Upper case, folded, everything else than A-Z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "))


def lower_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))


def identifier(c: Column) -> Column:
    """Upper case letters and digits only; null where there are none."""
    return F.nullif(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]", ""), F.lit(""))


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def person_name(c: Column) -> Column:
    """Upper case letters, hyphens and apostrophes; the rest as single spaces."""
    return clean_spaces(F.regexp_replace(F.upper(fold(c)), "[^A-Z' -]", " "))


def free_text(c: Column) -> Column:
    return F.upper(fold(clean_spaces(c)))


def address(c: Column) -> Column:
    """Upper case, with the signs that addresses use."""
    return clean_spaces(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9'./, -]", " "))


#: Misread words of addresses and what they stand for.
ADDRESS_MISREAD = {r"\bLOTISSEMENTAL\b": "LOTISSEMENT AL", r"\bAL\s+LAL\b": "ALLAL", r"\bAI\b": "AL", r"\bOODS\b": "QODS", r"\bMAARIE\b": "MAARIF"}


def address_words(c: Column) -> Column:
    """upper_words() of an address, with the usual misread words put right."""
    return reduce(lambda e, kv: F.regexp_replace(e, *kv), ADDRESS_MISREAD.items(), upper_words(c))


#: Banks by what their names hold.
BANKS = {"ATTIJARI": "ATTIJARIWAFA BANK", "CIH": "CIH BANK", "SOCIETEGENERALE": "SOCIETE GENERALE"}


def bank(c: Column) -> Column:
    """The canonical name of a bank, found in its letters and digits alone; else the free text."""
    return first_containing(F.coalesce(identifier(c), F.lit("")), BANKS, free_text(c))


def without_leading_signs(c: Column) -> Column:
    return clean_spaces(F.regexp_replace(c, r"^[\s:;,.\-–_*]+", ""))


def first_containing(c: Column, names: dict[str, str], otherwise: Column) -> Column:
    """The name of the first key that the text contains, in the order given."""
    return reduce(lambda e, kv: e.when(F.contains(c, F.lit(kv[0])), F.lit(kv[1])), list(names.items())[1:], F.when(F.contains(c, F.lit(next(iter(names)))), F.lit(names[next(iter(names))]))).otherwise(otherwise)


def words(c: Column) -> Column:
    """The different words of a normalised text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def month_slot(doc_id: Column) -> Column:
    """1 to 3 from a document id that ends in _M1, _M2 or _M3 or has it before an underscore; null otherwise."""
    return F.nullif(F.regexp_extract(doc_id, r"(?i)_M([123])(?:_|$)", 1), F.lit("")).cast("int")


def salary_label(c: Column) -> Column:
    """Does a transaction label name a salary, as a whole word?"""
    return F.coalesce(upper_words(c).rlike(r"\b(SALAIRE|PAIE|PAYE)\b"), F.lit(False))


def label_tail(c: Column) -> Column:
    """What follows the salary word of a label: the payer's name."""
    return F.nullif(F.trim(F.regexp_extract(upper_words(c), r"\b(?:SALAIRE|PAIE|PAYE)\b(.*)$", 1)), F.lit(""))

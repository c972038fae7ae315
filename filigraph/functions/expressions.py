"""Column expressions of the cleansing pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case filer names of the holdings file with the company names they stand for.
FILER_NAMES = {
    "AMAZON": "Amazon.com, Inc.",
    "NVIDIA CORPORATION": "NVIDIA Corporation",
    "APPLE INC": "Apple Inc.",
    "PAYPAL": "PayPal Holdings, Inc.",
    "INTEL CORP": "Intel Corporation",
    "AMERICAN INTL GROUP": "American International Group, Inc.",
    "PG&E CORP": "PG&E Corporation",
    "MCDONALDS CORP": "McDonald's Corporation",
    "MICROSOFT CORP": "Microsoft Corporation",
}


def canonical_name(name: Column, table: dict[str, str]) -> Column:
    """The entry of ``table`` for the name or for its upper case, else the name itself."""
    if not table:
        return name
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.upper(name)), name)


def safe_file_name(name: Column) -> Column:
    """The name with slashes and blanks turned into underscores."""
    return F.translate(name, "/ ", "__")


def unfenced(text: Column) -> Column:
    """Text without the markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```\s*$", "")


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def is_number_like(value: Column) -> Column:
    """Whether a value says a number at all: a metric without one is not kept."""
    return F.coalesce(F.regexp_like(value, F.lit("[0-9]")), F.lit(False))


def entity_line(name: Column, properties: Column) -> Column:
    """``name: k=v, k=v`` of an entity, keys in order, internal ones left out."""
    pairs = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: ~k.startswith("__") & v.isNotNull())))
    return F.concat(name, F.lit(": "), F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ", "))


def surrogate(prefix: str, n: Column) -> Column:
    """``prefix`` and a number of at least three digits; longer numbers are not cut."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")))


#: What a filer's name looks like before "(the "Company")", and at the start of a filing.
FILER_BEFORE = r"""([A-Z][A-Za-z\s&.,]+(?:Inc\.|Corp(?:oration)?|LLC|Ltd\.?|Co\.|L\.P\.))\s*\((?:the\s+)?["'](?:Company|Registrant)"""
FILER_FIRST = r"^([A-Z][A-Za-z\s&.,]+(?:Inc\.|Corp(?:oration)?|LLC|Ltd\.?|Co\.|L\.P\.))"


def filer_name(text: Column) -> Column:
    """The filer that the first 500 characters of a filing name, of 3 to 99 letters; null if none is seen."""
    head = F.substring(text, 1, 500)
    found = [F.regexp_replace(F.trim(F.regexp_extract(head, pattern, 1)), ",+$", "") for pattern in (FILER_BEFORE, FILER_FIRST)]
    return F.coalesce(*(F.when(F.length(x).between(3, 99), x) for x in found))


def associated_company(properties: Column, chunk: Column) -> Column:
    """The company of an entity: the first filled of its properties that name one, else the filer in ``chunk``, else ``unknown``."""
    said = first_filled(*(F.try_element_at(properties, F.lit(k)) for k in ("company", "companyName", "company_name", "filing_company")))
    return F.coalesce(said, filer_name(chunk), F.lit("unknown"))

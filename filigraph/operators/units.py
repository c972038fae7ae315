"""Quantities in mixed units: a small grammar over numbers and unit expressions, dimensions as exponent vectors.

A text is read as ``[about] [sign] [currency] number [multiplier...] [unit expression]``. A unit is a vector of
exponents over (money, person, mass, length, time, temperature) with an exact scale and an offset to the canonical unit of
that dimension. Products and quotients of units (``kWh/m2``, ``USD per tonne``, ``m * m``) add and subtract exponents and
multiply scales; powers multiply exponents. A single unit converts by ``(number + offset) * scale``, and offsets have no
meaning in products. What the value itself leaves open (currency, scale, kind) is taken from the name, then from the
period. All arithmetic is on fractions; rounding is the last step, halves away from zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction as Q
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exponents over (money, person, mass, length, time, temperature).
Vector = tuple[int, ...]
MONEY, PERSON, MASS, LENGTH, SPAN, HEAT = (tuple(int(i == j) for j in range(6)) for i in range(6))
RATIO, AREA, ENERGY = (0,) * 6, (0, 0, 0, 2, 0, 0), (0, 0, 1, 2, -2, 0)
#: The canonical unit of a dimension; quantities of any other dimension are not converted.
CANONICAL = {MONEY: "USD_CENTS", PERSON: "PERSONS", MASS: "KG", AREA: "SQM", ENERGY: "KWH", SPAN: "MONTHS", RATIO: "BASIS_POINTS", LENGTH: "METRES", HEAT: "KELVIN"}
#: The canonical units that a value of a metric may have.
VALUE_UNITS = frozenset(("USD_CENTS", "BASIS_POINTS", "PERSONS", "KWH", "SQM", "KG"))

#: Multipliers by word, lower case without a final dot.
MULTIPLIERS = {
    "hundred": 10**2, "k": 10**3, "thsd": 10**3, "thousand": 10**3, "thousands": 10**3, "tsd": 10**3, "tausend": 10**3,
    "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "m": 10**6, "mn": 10**6, "mm": 10**6, "mil": 10**6, "mio": 10**6,
    "million": 10**6, "millions": 10**6, "millionen": 10**6, "cr": 10**7, "crore": 10**7, "crores": 10**7,
    "b": 10**9, "bn": 10**9, "bil": 10**9, "billion": 10**9, "billions": 10**9, "mrd": 10**9, "milliarde": 10**9, "milliarden": 10**9,
    "tn": 10**12, "trillion": 10**12, "trillions": 10**12,
}
#: Currencies by word or sign, with the share of the currency's unit that it names.
CURRENCIES = {
    "$": ("USD", Q(1)), "us$": ("USD", Q(1)), "usd": ("USD", Q(1)), "dollar": ("USD", Q(1)), "dollars": ("USD", Q(1)), "cent": ("USD", Q(1, 100)), "cents": ("USD", Q(1, 100)), "¢": ("USD", Q(1, 100)),
    "€": ("EUR", Q(1)), "eur": ("EUR", Q(1)), "euro": ("EUR", Q(1)), "euros": ("EUR", Q(1)), "£": ("GBP", Q(1)), "gbp": ("GBP", Q(1)), "sterling": ("GBP", Q(1)), "pence": ("GBP", Q(1, 100)),
    "¥": ("JPY", Q(1)), "jpy": ("JPY", Q(1)), "yen": ("JPY", Q(1)), "₹": ("INR", Q(1)), "inr": ("INR", Q(1)), "rs": ("INR", Q(1)), "rupee": ("INR", Q(1)), "rupees": ("INR", Q(1)),
    "chf": ("CHF", Q(1)), "cad": ("CAD", Q(1)), "c$": ("CAD", Q(1)), "ca$": ("CAD", Q(1)),
}
_LB, _FT, _J = Q("0.45359237"), Q("0.3048"), Q(1, 3_600_000)
#: Unit words with their exponents, scale to the canonical unit and offset.
UNITS: dict[str, tuple[Vector, Q, Q]] = {}
for _words, _dim, _scale in (
    ("%|percent|per cent|pct|prozent", RATIO, Q(100)), ("percentage points|percentage point|ppt|pp", RATIO, Q(100)),
    ("bp|bps|basis points|basis point", RATIO, Q(1)), ("‰|per mille|permille", RATIO, Q(10)),
    ("employees|employee|people|persons|person|staff|workers|heads|fte|ftes|full-time employees|full-time equivalents|full time employees|headcount", PERSON, Q(1)),
    ("kg|kgs|kilogram|kilograms|kilo|kilos", MASS, Q(1)), ("g|gram|grams", MASS, Q(1, 1000)), ("mg", MASS, Q(1, 10**6)),
    ("t|ton|tons|tonne|tonnes|metric ton|metric tons|metric tonnes|mt", MASS, Q(1000)), ("kt|kilotons|kilotonnes|kiloton|kilotonne", MASS, Q(10**6)), ("megatons|megatonnes", MASS, Q(10**9)),
    ("short ton|short tons", MASS, 2000 * _LB), ("long ton|long tons", MASS, 2240 * _LB), ("lb|lbs|pound|pounds", MASS, _LB), ("oz|ounce|ounces", MASS, _LB / 16),
    ("m²|m2|sqm|sq m|square meter|square meters|square metre|square metres", AREA, Q(1)), ("km²|km2|sq km|square kilometers|square kilometres", AREA, Q(10**6)),
    ("ha|hectare|hectares", AREA, Q(10**4)), ("acre|acres", AREA, 43560 * _FT**2), ("sq ft|sqft|ft²|ft2|square foot|square feet|sf", AREA, _FT**2), ("sq yd|square yards", AREA, 9 * _FT**2), ("sq mi|square miles", AREA, (5280 * _FT) ** 2),
    ("metre|metres|meter|meters", LENGTH, Q(1)), ("km|kilometre|kilometres|kilometer|kilometers", LENGTH, Q(1000)), ("cm", LENGTH, Q(1, 100)), ("ft|foot|feet", LENGTH, _FT), ("yd|yard|yards", LENGTH, 3 * _FT), ("mi|mile|miles", LENGTH, 5280 * _FT),
    ("month|months|mo", SPAN, Q(1)), ("year|years|yr|yrs", SPAN, Q(12)), ("quarter|quarters", SPAN, Q(3)), ("week|weeks", SPAN, Q(12, 52)), ("day|days", SPAN, Q(12, 365)),
):
    for _word in _words.split("|"):
        UNITS[_word] = (_dim, _scale, Q(0))
for _prefix, _name, _size in (("", "", 0), ("k", "kilo", 3), ("m", "mega", 6), ("g", "giga", 9), ("t", "tera", 12)):
    for _words, _joules in ((("wh", "watt-hour", "watt-hours", "watt hours"), 3600), (("j", "joule", "joules"), 1)):
        UNITS[_prefix + _words[0]] = (ENERGY, _joules * 10**_size * _J, Q(0))
        for _word in _words[1:]:
            UNITS[_name + _word] = (ENERGY, _joules * 10**_size * _J, Q(0))
for _words, _scale, _offset in (("kelvin", Q(1), Q(0)), ("°c|degrees celsius|celsius", Q(1), Q("273.15")), ("°f|degrees fahrenheit|fahrenheit", Q(5, 9), Q("459.67"))):
    for _word in _words.split("|"):
        UNITS[_word] = (HEAT, _scale, _offset)
#: Words that count things and have no dimension; a rate by year is still that rate.
COUNTED = frozenset("share shares ads adr unit units annum".split())
UNITS["mmbtu"] = (ENERGY, Q("1055055852.62") * _J, Q(0))
#: Words that carry no quantity.
_FILLERS = frozenset("about approximately approx over under nearly almost around circa ca some roughly more less than up to at least of in us a an the per share each amounts to total value and net".split())
_SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_SMALL |= {"twenty": 20, "twenty-six": 26, "thirty": 30, "thirty-nine": 39, "forty": 40, "fifty": 50, "fifty-two": 52, "fifty-three": 53, "sixty": 60, "ninety": 90}

_NUMBER = re.compile(r"\d+ \d+/\d+|\d{1,3}(?: \d{3})+(?!\d)(?:[.,]\d+)?|\d[\d.,']*(?:[eE][+-]?\d+)?(?:/\d+)?|\.\d+")
_PIECE = re.compile(r"us\$|ca?\$|[$€£¥₹¢%‰]|°[cf]\b|[/*·×]|\^-?\d+|[^\W\d_]+(?:[-²³][^\W\d_]*)*\.?")
#: A power that is written as a digit after a unit of length, and thousands that are written as zeros.
_POWER = re.compile(r"\b(km|cm|m|ft|yd|mi)\^?([23])\b")
_ZEROS = re.compile(r"\b(0{3}|0{6})(?:s|['’]s)\b")
_SPACES = re.compile(r"[\s   ⁠]+")
_THREES = re.compile(r"\d{1,3}(?:,\d{2,3})*,\d{3}")
_EURO_WORDS = re.compile(r"\b(?:mio|mrd|tsd|millionen|milliarden?|tausend|prozent)\b", re.I)


def number(text: str, comma_decimal: bool = False) -> Q | None:
    """The number that ``text`` writes: grouped by comma, dot, blank or apostrophe, with exponent or fraction."""
    whole, _, part = text.strip().partition("/")
    add = Q(0)
    if part:
        head, _, top = whole.rstrip().rpartition(" ")
        if not top.isdigit() or not part.strip().isdigit() or not int(part):
            return None
        add, whole = Q(int(top), int(part)), head or "0"
    body, exponent = (re.split("[eE]", whole) + ["0"])[:2]
    body = body.replace(" ", "").replace("'", "").strip(".,") if body[:1] not in ".," else "0" + body.replace(" ", "").rstrip(".,")
    dot, comma = body.rfind("."), body.rfind(",")
    if dot >= 0 and comma >= 0:
        body = body.replace(".", "").replace(",", ".") if comma > dot else body.replace(",", "")
    elif comma >= 0:
        body = body.replace(",", "") if _THREES.fullmatch(body) and not comma_decimal else body.replace(",", ".") if body.count(",") == 1 else body.replace(",", "")
    elif dot >= 0 and (body.count(".") > 1 or comma_decimal and len(body) - dot == 4):
        body = body.replace(".", "")
    try:
        return Q(body) * Q(10) ** int(exponent) + add
    except (ValueError, OverflowError):
        return None


class Reading:
    """What a text says around its number: multiplier, currency, unit (exponents, scale, offset) and ratio marks."""

    __slots__ = ("currency", "factor", "multiplier", "share", "unit")

    def __init__(self) -> None:
        self.multiplier, self.currency, self.share, self.unit, self.factor = None, None, Q(1), None, None


def powers(text: str) -> str:
    """``text`` with powers and thousands as words: ``m2`` is ``m²``, ``000s`` are thousands."""
    return _ZEROS.sub(lambda x: "thousands" if len(x[1]) == 3 else "millions", _POWER.sub(lambda x: x[1] + "²³"[int(x[2]) - 2], text))


def _unit(word: str) -> tuple[Vector, Q, Q] | None:
    """The unit that ``word`` names; a length with a raised 2 or 3 is its power."""
    if word in UNITS:
        return UNITS[word]
    if word[-1:] in "²³" and word[:-1] and (found := UNITS.get(word[:-1]) or (UNITS["metre"] if word[:-1] == "m" else None)):
        n = "²³".index(word[-1]) + 2
        return tuple(x * n for x in found[0]), found[1] ** n, Q(0)
    return None


def expression(text: str) -> Reading:
    """Read the words of a unit expression, longest unit names first; units multiply, after ``/`` or ``per`` they divide."""
    got, words = Reading(), [w.rstrip(".") if len(w) > 1 else w for w in _PIECE.findall(powers(text))]
    at, sign, joined, last = 0, 1, False, None
    while at < len(words):
        for n in (3, 2, 1):
            word = " ".join(words[at : at + n])
            if n <= len(words) - at and (_unit(word) or n == 1):
                break
        unit = _unit(word)
        if word in ("/", "per"):
            sign, joined = -1, True
        elif word in "*·×":
            joined = True
        elif word[0] == "^" and last is not None and got.unit:
            more = int(word[1:]) - 1
            got.unit = (tuple(x + y * more for x, y in zip(got.unit[0], last[0], strict=True)), got.unit[1] * last[1] ** more, Q(0))
        elif sign < 0 and word in COUNTED | {"year", "years"} and (got.unit is None or got.unit[0] == RATIO or word in COUNTED):
            sign, joined = 1, False
        elif n == 1 and word in ("m", "mm", "t") and not joined and (got.currency or at + 1 < len(words) or word != "t") and not (word == "t" and got.currency is None):
            got.multiplier = (got.multiplier or 1) * MULTIPLIERS.get(word, 1)
        elif (unit or joined and word == "m") and not (word == "pounds" and "sterling" in words):
            dim, scale, offset = last = unit or UNITS["metre"]
            if sign < 0 and got.unit is None and got.currency is None:
                got.unit = (RATIO, Q(1), Q(0))
            if sign < 0 and got.currency is not None and got.unit is None:
                got.unit = (MONEY, Q(1), Q(0))
            if got.unit is None:
                got.unit = (dim, scale, offset)
            elif joined:
                got.unit = (tuple(x + sign * y for x, y in zip(got.unit[0], dim, strict=True)), got.unit[1] * scale**sign, Q(0))
                last = (tuple(sign * x for x in dim), scale**sign, Q(0))
            sign, joined = 1, False
        elif word in CURRENCIES:
            if got.currency is None:
                got.currency, got.share = CURRENCIES[word]
            sign, joined = 1, False
        elif word in MULTIPLIERS:
            got.multiplier = (got.multiplier or 1) * MULTIPLIERS[word]
        at += n
    if re.search(r"\bratio\b|decimal fraction|\bas a fraction\b", text):
        got.factor = Q(10_000)
    return got


@lru_cache(maxsize=50_000)
def _context(text: str) -> Reading:
    """What a name or a period says of the unit of the value: bracketed or trailing notes only."""
    low = powers(_SPACES.sub(" ", text).strip().lower())
    notes = re.findall(r"[(\[]([^)\]]*)[)\]]", low) + [x for x in re.findall(r"(?:,| - )\s*([^,()\[\]]*)$", low)]
    best = Reading()
    for note in notes:
        if re.search(r"\d", note):
            continue
        got = expression(note)
        best.multiplier, best.currency, best.unit, best.factor = best.multiplier or got.multiplier, best.currency or got.currency, best.unit or got.unit, best.factor or got.factor
    return best


_HEADS = re.compile(r"\bemployees?\b|\bheadcount\b|\bstaff\b|\bworkforce\b|\bpersonnel\b", re.I)
_MONEY_NAMES = re.compile(r"income|revenue|sales|debt|cash|goodwill|cost|expenditure|spending|profit|loss|assets|liabilit|equity|dividend|earnings|book value|payable|receivable|capital|inventor|expense|price|value per share", re.I)


#: A three-letter code beside a number: a currency, if it is nothing else that is known.
_CODE = re.compile(r"\b([A-Z]{3})\s*[-(]?\s*$|^\s*(?:[a-z]+\.?\s+)?([A-Z]{3})\b")


def value_quantity(value: str | None, name: str | None, period: str | None) -> tuple[str, str | None, Q] | None:
    """(unit, currency, amount in the canonical unit before exchange) that a value states, or None.

    None for a value without a number or stated unit, with a currency that is not known, of a dimension that has no canonical
    unit (a quotient of two, say), and for a range. What follows the first quantity after a comma, semicolon or bracket is
    a remark and not read if it has a number of its own.
    """
    if not value:
        return None
    text = powers(_SPACES.sub(" ", value).strip().replace("−", "-").replace("–", "-"))
    low = text.lower()
    found = _NUMBER.search(low)
    if not found or re.search(r"\b(?:note|item|see|page|section)\b", low[: found.start()]):
        return None
    rest = low[found.end() :]
    if re.search(r"\d", re.sub(r"\^-?\d", "", rest)):
        rest = re.split(r"[,;(\[]|\. ", rest, maxsplit=1)[0]
        if re.search(r"\d", re.sub(r"\^-?\d", "", rest)):
            return None
    n = number(found.group(), comma_decimal=bool(_EURO_WORDS.search(low)))
    if n is None:
        return None
    before = low[: found.start()]
    if re.search(r"-\s*(?:[a-z$€£¥₹]*\s*)?$", before) and "-" in before or (before.count("(") > before.count(")") and ")" in rest) or re.search(r"\bloss(?:es)? of\b|\bnegative\b|\bminus\b", before):
        n = -n
    codes = [c for side in (text[: found.start()], text[found.end() : found.end() + len(rest)]) for x in _CODE.finditer(side) for c in x.groups() if c]
    if any(c.lower() not in CURRENCIES and c.lower() not in MULTIPLIERS and not _unit(c.lower()) and c.lower() not in _FILLERS for c in codes):
        return None
    said = expression(before + " " + rest)
    notes = [_context(x) for x in (name or "", period or "")]
    unit = said.unit or (None if said.currency else next((x.unit for x in notes if x.unit and not x.currency), None))
    currency, share = said.currency, said.share
    multiplier = said.multiplier
    if unit and (not currency or unit[0] != MONEY):
        if currency:  # money by some other unit
            return None
        if said.unit is None and multiplier is None:
            multiplier = next((x.multiplier for x in notes if x.multiplier), None)
        label = CANONICAL.get(unit[0])
        return (label, None, (n * (multiplier or 1) + unit[2]) * unit[1]) if label in VALUE_UNITS else None
    if unit:  # money by another unit that is not merely counted
        return None
    if currency is None:
        factor = said.factor or next((x.factor for x in notes if x.factor), None)
        if factor:
            return CANONICAL[RATIO], None, n * factor
        if name and _HEADS.search(name):
            multiplier = multiplier or next((x.multiplier for x in notes if x.multiplier), 1)
            return CANONICAL[PERSON], None, n * multiplier
        noted = next((x for x in notes if x.currency), None)
        scaled = multiplier or next((x.multiplier for x in notes if x.multiplier), None)
        if noted is None and not (scaled and name and _MONEY_NAMES.search(name)):
            return None
        currency = noted.currency if noted else "USD"
        multiplier = scaled
    elif multiplier is None:
        multiplier = next((x.multiplier for x in notes if x.multiplier), None)
    return CANONICAL[MONEY], currency, n * share * (multiplier or 1) * 100


_HALVES = {"half": Q(1, 2), "one-half": Q(1, 2), "a half": Q(1, 2), "a quarter": Q(1, 4), "one-quarter": Q(1, 4)}
_COUNT = re.compile(r"(?:(\d+(?:\.\d+)?|[a-z]+(?:-[a-z]+)?)(?: (?:and )?(\d/\d|(?:and )(?:a half|one-half|half|a quarter|one-quarter)))?)[ -](years?|yrs?|months?|mos?|quarters?|weeks?|days?)\b")


@lru_cache(maxsize=100_000)
def period_months(period: str) -> Q | None:
    """The length in months of the span that a period states; None for points in time and words without a length.

    Spans that follow each other ("1 year 6 months", "two years and three months") add up.
    """
    low = _SPACES.sub(" ", period).strip().lower()
    low = re.sub(r"\s*[(\[].*$", "", low)
    total, end = None, 0
    for x in _COUNT.finditer(low):
        n = Q(x[1]) if x[1][0].isdigit() else _SMALL.get(x[1])
        if n is None:
            continue
        if total is not None and not re.fullmatch(r"[\s,]*(?:and )?\s*", low[end : x.start()]):
            break
        if x[2]:
            part = x[2].removeprefix("and ")
            n += Q(part) if "/" in part and not part.endswith("/0") else _HALVES.get(part, Q(0))
        total, end = (total or Q(0)) + n * UNITS[x[3]][1], x.end()
    if total is not None:
        return total
    if re.search(r"\b(?:as of|as at|at|on)\b", low):
        return None
    if x := re.search(r"\b(\d{1,2})m(?:\b|(?=\d{2,4}\b))", low):
        return Q(int(x[1]))
    if re.search(r"\bh[12]\b|\b[12]h\d*|\bhalf[ -]?year\b|\bhalf\b", low):
        return Q(6)
    if re.search(r"\bq[1-4]\b|\b[1-4]q\d*|\bq[1-4][ '-]?(?:fy)?\d{2,4}|\bquarter\b", low):
        return Q(3)
    if re.search(r"\bfy ?'?\d{2,4}\b|\bfiscal (?:year )?\d{4}|\b(?:fiscal|financial|calendar|full) year\b|\byear (?:ended|ending|to)\b|\b(?:ttm|ltm)\b|\bcy ?\d{2,4}\b", low):
        return Q(12)
    if re.search(r"\bmonth (?:ended|ending|to|of)\b", low):
        return Q(1)
    return None


def nearest(x: Q) -> int:
    """The nearest whole number, halves away from zero."""
    return int(abs(x) + Q(1, 2)) * (1 if x >= 0 else -1)


_RESULT = "array<struct<field:string,unit:string,amount:bigint>>"
#: More currencies than there are; the rates are a list of at most one row for each.
MAX_CURRENCIES = 10_000
_BIG = 2**63 - 1


def _quantities(rates: dict[str, Q]) -> Callable[[Iterator[tuple[pd.Series, pd.Series, pd.Series]]], Iterator[pd.Series]]:
    """A function from Arrow batches of (name, value, period) to the quantities found in them, money by ``rates``."""

    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, values, periods in batches:
            out = []
            for name, value, period in zip(names, values, periods, strict=True):
                rows = []
                got = value_quantity(value, name, period)
                if got and (got[1] is None or got[1] in rates):
                    amount = nearest(got[2] * (rates[got[1]] if got[1] else 1))
                    if abs(amount) <= _BIG:
                        rows.append({"field": "value", "unit": got[0], "amount": amount})
                span = period_months(period) if period else None
                if span is not None and (months := nearest(span)) <= _BIG:
                    rows.append({"field": "period", "unit": CANONICAL[SPAN], "amount": months})
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return read


def converted_quantities(metrics: DataFrame, rates: DataFrame) -> DataFrame:
    """(metricid, field, unit, amount): every quantity of value and period in the canonical unit of its dimension.

    One Arrow pass over the rows without a shuffle. ``rates`` (currency, usd_per_unit) has a row per currency, of repeated
    ones the greatest rate counts, and they are taken as the decimals that they print as. Texts are read whole, however long.
    Null and empty texts, values without a number or without any stated unit, currencies without a rate, and amounts that a
    BIGINT cannot hold give no row. Repeated rows give one row each; further columns are ignored.
    """
    known = rates.filter(F.col("currency").isNotNull() & F.col("usd_per_unit").isNotNull()).groupBy(F.upper("currency").alias("currency")).agg(F.max("usd_per_unit").cast("string").alias("rate"))
    listed = known.limit(MAX_CURRENCIES + 1).collect()  # a bounded list
    if len(listed) > MAX_CURRENCIES:
        raise ValueError(f"more than {MAX_CURRENCIES} currencies")
    read = F.pandas_udf(_quantities({r["currency"]: Q(r["rate"]) for r in listed}), _RESULT)
    return metrics.select("metricid", F.explode(read("name", "value", "period")).alias("q")).select("metricid", "q.*")

"""Pay, terms, places, class years, instants and deadlines out of text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

_NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kK])?"
_RANGE = re.compile(_NUMBER + r"\s*(?:-|–|—|~|to|and)?\s*(?:[A-Z]{3}\s*)?(?:[a-zA-Z]{0,2}[$€£])?\s*(?:" + _NUMBER + ")?")
# Currency marks in order of precedence, and words for pay periods.
CURRENCIES = (("CA$", "CAD"), ("C$", "CAD"), ("NZ$", "NZD"), ("A$", "AUD"), ("US$", "USD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"))
CODES = ("USD", "CAD", "EUR", "GBP", "AUD", "NZD", "CHF", "INR", "SGD", "JPY")
PERIODS = (("hour", r"\b(hour|hourly|hr|hrs)\b|/\s*h"), ("month", r"\b(month|monthly|mo)\b"), ("year", r"\b(year|yearly|annual|annually|annum|yr)\b"))
UNSUPPORTED = r"\b(week|weekly|day|daily|biweekly|stipend total)\b"
CEILINGS = {"hour": 1_000.0, "month": 100_000.0, "year": 2_000_000.0}


def parse_pay_text(text: str | None) -> tuple | None:
    """(min, max, currency, period) or None; what is not unambiguous is None."""
    if not text:
        return None
    upper = text.upper()
    currency = next((c for c in CODES if re.search(rf"\b{c}\b", upper)), None) or next((c for mark, c in CURRENCIES if mark in upper), None)
    if currency is None or re.search(UNSUPPORTED, text, re.IGNORECASE):
        return None
    marks = [upper.find(m) + len(m) for m, _ in CURRENCIES if m in upper] + [m.end() for c in CODES for m in re.finditer(rf"\b{c}\b", upper)]
    rest = text[min(marks) :]
    if re.match(r"\s*-\s*\d", rest):
        return None
    found = _RANGE.search(rest)
    if not found:
        return None
    low_text, low_k, high_text, high_k = found.groups()
    low = float(low_text.replace(",", "")) * (1000 if low_k or (high_k and high_text) else 1)
    high = float(high_text.replace(",", "")) * (1000 if high_k else 1) if high_text else None
    if high is not None and high < low:
        return None
    period = next((name for name, words in PERIODS if re.search(words, text, re.IGNORECASE)), None)
    if period is None:
        period = "year" if low >= 50_000 else "hour" if (high or low) <= 200 else None
    if period is None or (currency == "USD" and (high or low) > CEILINGS[period]):
        return None
    return low, high, currency, period


@pandas_udf(StructType([StructField("min", DoubleType()), StructField("max", DoubleType()), StructField("currency", StringType()), StructField("period", StringType())]))
def parse_pay(text: pd.Series) -> pd.DataFrame:
    rows = [parse_pay_text(t) or (None, None, None, None) for t in text]
    return pd.DataFrame(rows, columns=["min", "max", "currency", "period"])


SEASONS = r"\b(spring|summer|fall|autumn|winter)\b"


def season(c: Column) -> Column:
    found = F.regexp_extract(F.lower(c), SEASONS, 1)
    return F.when(found == "autumn", F.lit("fall")).otherwise(F.nullif(found, F.lit("")))


def term_year(c: Column, this_year: int) -> Column:
    """The year next to the season word, else the first plausible one (last year to three years on)."""
    low = F.lower(c)
    years = "|".join(str(y) for y in range(this_year - 1, this_year + 4))
    after = F.regexp_extract(low, rf"\b(?:spring|summer|fall|autumn|winter)\W+({years})\b", 1)
    before = F.regexp_extract(low, rf"\b({years})\W+(?:spring|summer|fall|autumn|winter)\b", 1)
    anywhere = F.regexp_extract(low, rf"\b({years})\b", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (after, before, anywhere)]).cast("int")


def class_years(c: Column, this_year: int) -> Column:
    """struct<min,max> of the plausible graduation years named."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b")), lambda y: y.cast("int")), lambda y: (y >= this_year - 1) & (y <= this_year + 6))
    return F.struct(F.array_min(found).alias("min"), F.array_max(found).alias("max"))


# Cues of sentences that name graduation years; state codes; spellings of countries.
CLASS_YEAR_CUES = ("class of", "graduat", "rising", "expected degree")
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA",
    "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN",
    "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU",
)
COUNTRIES = {
    "us": "United States", "usa": "United States", "united states": "United States", "united states of america": "United States",
    "america": "United States", "uk": "United Kingdom", "gb": "United Kingdom", "great britain": "United Kingdom",
    "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom", "united kingdom": "United Kingdom",
    "canada": "Canada", "india": "India", "ireland": "Ireland", "germany": "Germany", "deutschland": "Germany", "france": "France",
    "spain": "Spain", "italy": "Italy", "netherlands": "Netherlands", "poland": "Poland", "sweden": "Sweden", "norway": "Norway",
    "denmark": "Denmark", "finland": "Finland", "switzerland": "Switzerland", "austria": "Austria", "portugal": "Portugal",
    "israel": "Israel", "japan": "Japan", "china": "China", "singapore": "Singapore", "australia": "Australia",
    "new zealand": "New Zealand", "brazil": "Brazil", "mexico": "Mexico", "south korea": "South Korea", "taiwan": "Taiwan",
    "south africa": "South Africa", "romania": "Romania", "czech republic": "Czech Republic", "hungary": "Hungary",
}
MODALITY = r"remotely|remote|hybrid|on-?site|in[- ]office|in[- ]person|wfh|virtual|distributed"


def class_years_of_description(c: Column, this_year: int) -> Column:
    """The same of a description, in the sentences that have a cue."""
    sentences = F.filter(F.split(c, "[.!?\n]"), lambda s: F.lower(s).rlike("|".join(CLASS_YEAR_CUES)))
    return class_years(F.array_join(sentences, "\n"), this_year)


def term(title: Column, field: Column, this_year: int) -> Column:
    """struct<season,year>; a stated term field overrides the title, each half by itself."""
    return F.struct(F.coalesce(season(field), season(title)).alias("season"), F.coalesce(term_year(field, this_year), term_year(title, this_year)).alias("year"))


def location_parts(c: Column) -> Column:
    """struct<city,region,country,remote> of the first of several places; remote is null where not said.

    A last part that is a country by any spelling is the country; a second part that is a state
    code is a region of the United States; any other second part is a region.
    """
    first = F.trim(F.split_part(F.regexp_replace(c, r"\|", ";"), F.lit(";"), F.lit(1)))
    low = F.lower(first)
    remote = F.when(low.rlike(r"\b(remote|remotely|wfh|virtual)\b"), F.lit(True)).when(low.rlike(r"\b(on-?site|in[- ]person|in[- ]office)\b"), F.lit(False))
    bare = F.trim(F.regexp_replace(first, rf"(?i)[(\[]?\b({MODALITY})\b[)\]]?\s*[-–—,:]?", ""))
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    known = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    country_of = lambda p: F.try_element_at(known, F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " ")))
    last, second = F.get(parts, n - 1), F.get(parts, F.lit(1))
    # A lone or second part in capitals of two letters is a state before it is a country.
    state = (n == 2) & F.coalesce(second.isin(*US_STATES), F.lit(False))
    country = F.when(state, F.lit("United States")).otherwise(F.coalesce(country_of(last), F.when(n >= 3, F.get(parts, F.lit(2)))))
    is_country = ~state & country_of(last).isNotNull()
    city = F.when((n >= 1) & ~(is_country & (n == 1)), F.get(parts, F.lit(0)))
    region = F.when((n >= 2) & ~(is_country & (n == 2)), second)
    return F.struct(city.alias("city"), region.alias("region"), country.alias("country"), remote.alias("remote"))


def instant(c: Column) -> Column:
    """RFC 3339, date and time, date, or an epoch in seconds (10 digits) or milliseconds (13)."""
    t = F.trim(c)
    number = F.try_to_number(F.when(t.rlike(r"^\d{10}$|^\d{13}$"), t), F.lit("9999999999999")).cast("long")
    return F.coalesce(
        F.when(F.length(t) == 10, F.timestamp_seconds(number)).when(F.length(t) == 13, F.timestamp_millis(number)),
        F.when(~t.rlike(r"^\d+$"), F.try_to_timestamp(F.regexp_replace(t, "/", "-"))),
    )


_MONTHS = "january february march april may june july august september october november december".split()
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_CUE = r"(?:due|deadline|by|before|until|within|complete|submit|expires?|closes?)"


def find_deadline(text: str | None, received: datetime | None) -> datetime | None:
    """The earliest date within 48 characters after a cue word that is not before ``received``."""
    if not text or received is None:
        return None
    low, found = text.lower(), []
    day = datetime(received.year, received.month, received.day)
    for cue in re.finditer(rf"\b{_CUE}\b", low):
        near = low[cue.end() : cue.end() + 48]
        if m := re.search(r"(\d{1,3})\s*(hour|day|week)s?", near):
            found.append(received + timedelta(**{m[2] + "s": int(m[1])}))
        if m := re.search(rf"\b({'|'.join(x[:3] for x in _MONTHS)})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?", near):
            found += _dates([m[3] and int(m[3])], [x[:3] for x in _MONTHS].index(m[1]) + 1, int(m[2]), day)
        if m := re.search(r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?", near):
            year = m[3] and (int(m[3]) + 2000 if len(m[3]) == 2 else int(m[3]))
            found += _dates([year], int(m[1]), int(m[2]), day)
        if m := re.search(rf"\b({'|'.join(_DAYS)})\b", near):
            found.append(day + timedelta(days=(_DAYS.index(m[1]) - day.weekday() - 1) % 7 + 1))
    return min((x for x in found if x >= day), default=None)


def _dates(years: list, month: int, day_of_month: int, after: datetime) -> list[datetime]:
    out = []
    for year in years:
        for y in [year] if year else [after.year, after.year + 1]:
            try:
                at = datetime(y, month, day_of_month)
            except ValueError:
                continue
            if year or at >= after:
                out.append(at)
                break
    return out


@pandas_udf(TimestampNTZType())
def deadline(text: pd.Series, received: pd.Series) -> pd.Series:
    return pd.Series([find_deadline(t, None if pd.isna(r) else pd.Timestamp(r).to_pydatetime()) for t, r in zip(text, received, strict=True)], dtype="datetime64[us]")

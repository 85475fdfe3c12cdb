"""What is shown or told, and keys of questions and roles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import ellipsis

# Markers of a question about the company, and words that introduce a requisition's number.
COMPANY_QUESTION = (
    "why do you want to work", "why would you like to work", "why are you interested in working", "why are you applying",
    "why this company", "why us", "why our", "what interests you about us", "what excites you about us",
    "what do you know about us", "about our company", "about our mission", "our team", "join us", "join our", "work here",
)
REQUISITION = ("job", "number", "no", "req", "id", "requisition", "ref", "posting")


def question_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def company_specific(question: Column, answer: Column, company: Column) -> Column:
    """A question about the company by its wording, or one whose text or answer names it."""
    q, a, name = question_key(question), question_key(answer), question_key(company)
    return q.rlike("|".join(COMPANY_QUESTION)) | F.coalesce((name != "") & (F.contains(q, name) | F.contains(a, name)), F.lit(False))


def role_key(c: Column) -> Column:
    """Words of a role, without a requisition's number (five digits or more) at the end and the words before it."""
    words = F.coalesce(question_key(c), F.lit(""))
    return F.trim(F.regexp_replace(words, rf"(( |^)({'|'.join(REQUISITION)}))*(( |^)[0-9]{{5,}})+$", ""))


#: The month in which a season's term is over; 13 is January of the next year.
SEASON_ENDS = {"spring": 6, "summer": 9, "fall": 13, "winter": 16}


def display_name(c: Column) -> Column:
    """A company that is known by a slug as a name: words in title case. A name with a capital or without a letter stays."""
    words = F.filter(F.split(c, "[-_ ]"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(c.rlike(r"\p{Lu}") | ~c.rlike(r"\p{L}"), c).otherwise(titled)


def presented_year(season: Column, year: Column, since: Column) -> Column:
    """The term's year, null if the term was over when the posting came."""
    month = F.create_map(*[F.lit(x) for kv in SEASON_ENDS.items() for x in kv])[season]
    end = F.make_date(year + F.when(month > 12, 1).otherwise(0), (month - 1) % 12 + 1, F.lit(1))
    return F.when(~F.coalesce(end <= F.to_date(since), F.lit(False)), year)


def alert_body(title: Column, season: Column, year: Column, places: Column, most: int = 140) -> Column:
    """title · Season Year · first place +N more, cut with an ellipsis."""
    term = F.nullif(F.concat_ws(" ", F.initcap(season), year.cast("string")), F.lit(""))
    more = F.when(F.size(places) > 1, F.concat(F.lit(" +"), (F.size(places) - 1).cast("string"), F.lit(" more"))).otherwise("")
    place = F.when(F.size(places) > 0, F.concat(F.get(places, F.lit(0)), more))
    return ellipsis(F.concat_ws(" · ", title, term, place), most)


def mail_alert(category: Column, company: Column, sender: Column) -> Column:
    """Assessment, Interview or Offer, then who; null for mail that does not press."""
    label = F.when(category == "oa", "Assessment").when(category == "interview", "Interview").when(category == "offer", "Offer")
    return F.concat(label, F.lit(" — "), F.coalesce(F.nullif(F.trim(company), F.lit("")), F.nullif(F.trim(sender), F.lit("")), F.lit("unknown sender")))


def cursor(at: Column, key: Column) -> Column:
    """An opaque page cursor of an instant and a key."""
    return F.lower(F.hex(F.encode(F.concat_ws("|", at.cast("string"), key.cast("string")), "UTF-8")))


def cursor_parts(c: Column) -> Column:
    text = F.decode(F.unhex(c), "UTF-8")
    return F.struct(F.substring_index(text, "|", 1).alias("at"), F.substring_index(text, "|", -1).alias("key"))


def days_left(at: Column, now: Column) -> Column:
    """Whole days until then, a started day counting."""
    return F.ceil((F.unix_millis(at.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))) / 86_400_000.0).cast("long")


def badge(left: Column) -> Column:
    return F.when(left < 0, "expired").when(left <= 2, "urgent").when(left <= 5, "soon").otherwise("fresh")


def share(part: Column, whole: Column) -> Column:
    """A bar's percent, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100, whole), 1), F.lit(0.0))


def tags(text: Column, known: dict[str, str]) -> Column:
    """Names of the tags whose pattern the text matches, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(pattern), F.lit(name)) for name, pattern in known.items()]))


def graduation_year(stage: str, year: int, month: int) -> int | None:
    """Of freshman to senior (academic years begin in August), or of a plausible four-digit year."""
    ahead = {"freshman": 4, "sophomore": 3, "junior": 2, "senior": 1}
    begun = year if month >= 8 else year - 1
    stage = stage.strip().lower()
    if stage in ahead:
        return begun + ahead[stage]
    if stage.isdigit() and year - 10 <= int(stage) <= year + 15:
        return int(stage)
    return None

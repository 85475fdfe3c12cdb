"""The role that a message names, as a Column expression.

A role is what follows one of the markers, cut down to a noun phrase. All of this is regular
expressions over one lambda variable: the tails behind the markers that occur are an array, each is cut
by the same expression, and the first that still reads as an internship is the role.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import decode_entities

# What stands before a role (in order of trust), where the sentence goes on after it, words that lead it in
# and words that close it.
MARKERS = (
    "your application for ", "application for ", "applying to the ", "application to the ", "applying to our ", "application: ",
    "following position: ", "position: ", "for the position of ", "interest in the ", "your interest in ", "applying for the ",
    "applying for ",
)
CONTINUATIONS = (
    " and are ", " and we ", " and you ", " what happens", " has been ", " and it is ", " is being ", " position with ",
    " role with ", " role here",
)
LEADS = (
    "the ", "The ", "our ", "Our ", "a ", "an ", "following position: ", "Following position: ", "following role: ", "position: ",
    "Position: ", "role of ", "position of ", "Position of ", "position ", "Position ",
)
CLOSINGS = ("role", "Role", "position", "Position", "job", "Job", "opportunity")
INTEREST = "interest in"
OWNER_WORDS, LEAST_BYTES, MOST_BYTES, MOST_BRACKET = 4, 4, 120, 30

_or = "|".join
#: A requisition's number before a role: five letters and digits or more, a digit among them.
_NUMBER = r"(?=[A-Za-z]*[0-9])[A-Za-z0-9]{5,} \s*"


def _owner_gone(tail: Column) -> Column:
    """Without the employer's possessive: up to four words without a digit before the first 's."""
    straight = tail.contains("'s ")
    owner = F.when(straight, F.substring_index(tail, "'s ", 1)).otherwise(F.substring_index(tail, "’s ", 1))
    words = F.size(F.split(F.trim(owner), r"\s+"))
    short = (F.trim(owner) != "") & (words <= OWNER_WORDS) & ~owner.rlike("[0-9]")
    rest = F.regexp_replace(F.substr(tail, F.length(owner) + 4), r"^\s+", "")
    return F.when((straight | tail.contains("’s ")) & short, rest).otherwise(tail)


def _employer_gone(tail: Column) -> Column:
    """Without a short employer and "and the", which follow an interest."""
    employer = F.regexp_extract(tail, r"(?is)^(.*?) and the ", 1)
    short = F.size(F.split(F.trim(employer), r"\s+")) <= OWNER_WORDS
    rest = F.regexp_replace(F.substr(tail, F.length(employer) + 10), r"^\s+", "")
    return F.when(tail.rlike("(?i) and the ") & short & ~employer.rlike("(?i)intern"), rest).otherwise(tail)


#: (pattern, what stays), in order: the rest of the sentence and what the sentence goes on with; a bracket with a requisition's
#: number at the end; a bracket that never closes; residue of a number; stops; closing words.
_CUTS = (
    (rf"^(?:{_or(LEADS)}|[\[\]\-: ]|{_NUMBER})++", ""),
    (r"(?s)^([^.!?;]*[.!?;]?).*$", "$1"),
    (rf"(?is)({_or(CONTINUATIONS)}).*$", ""),
    (rf"(?s)\s*\((?=[^(]*[0-9]{{5}}[^(]*\)[^()]*$)[^(]{{0,{MOST_BRACKET}}}\)[^()]*$", ""),
    (r"(?s)\s*[(\[][^()\[\]]*$", ""),
    (r"(?i)(\s* (req|id|#[0-9]*)[,.:]*)+\s*$", ""),
    (r"[.!?;,\s]+$", ""),
    (rf"({_or(CLOSINGS)}|[.!,\]\s])+$", ""),
    (r"^\s+", ""),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _cut(t: Column) -> Column:
    for pattern, kept in _CUTS:
        t = F.regexp_replace(t, pattern, kept)
    return t


def _is_role(t: Column) -> Column:
    return F.octet_length(t).between(LEAST_BYTES, MOST_BYTES) & t.rlike("(?i)intern")


def _first_role(plain: Column, lower: Column) -> Column:
    known = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(INTEREST in m).alias("interest")) for m in MARKERS])
    at = lambda k: F.position(k["marker"], lower)
    there = F.filter(known, lambda k: at(k) > 0)
    step = lambda rows, change: F.transform(rows, lambda x: F.struct(change(x).alias("tail"), x["interest"].alias("interest")))
    tails = step(there, lambda k: F.regexp_replace(_trimmed(F.substr(plain, at(k) + F.length(k["marker"]))), r"[!.?]+$", ""))
    tails = step(tails, lambda x: _trimmed(F.regexp_replace(x["tail"], r"(?s) at .*$", "")))
    tails = step(tails, lambda x: _owner_gone(x["tail"]))
    tails = step(tails, lambda x: F.when(x["interest"], _employer_gone(x["tail"])).otherwise(x["tail"]))
    return F.get(F.filter(F.transform(tails, lambda x: _cut(x["tail"])), _is_role), F.lit(0))


def role_in(text: Column) -> Column:
    """The role that a text names; null where it names none."""
    # The dotted I is the one letter that lower case makes longer.
    return _let(decode_entities(text), lambda plain: _let(F.lower(F.translate(plain, "İ", "I")), lambda lower: _first_role(plain, lower)))


def role_from(subject: Column, snippet: Column) -> Column:
    """The role that the subject names, else the one that the snippet names, else null."""
    return F.coalesce(role_in(subject), role_in(snippet))

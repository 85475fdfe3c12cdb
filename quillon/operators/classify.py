"""Ordered-rule classification of mail, and its measurement against labels.

Rules are tried in order and the first that holds decides (category, confidence). A marker is
*stated* if it stands in a sentence without a hedge; a *pair* is two markers within GAP
characters. An automaton of all rules' markers reads each of three folded texts (all of the mail, its
subject, its sender) once; a rule is a small tree of tests on the places that it found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import decode_entities

GAP = 160

# The markers of each rule, phrases that make a sentence hypothetical, and sender domains.
REJECTION = (
    "move forward with other", "made the decision to move forward", "regret to inform", "we regret", "not be moving forward",
    "not moving forward", "won't be moving forward", "will not be progressing", "not be proceeding",
    "decided not to move forward", "decided to move forward with other", "no longer under consideration", "were not selected",
    "not selected for", "pursue other candidates", "proceed with other candidates", "proceed with other applicants",
    "not an ideal fit", "isn't an ideal fit", "not a fit at this time", "position has been filled", "role has been filled",
    "not to proceed with your candidacy", "not proceed with your candidacy", "not move forward with your candidacy",
    "decision to not move forward", "other candidates may better fit", "other candidates better fit",
    "haven't met the requirements", "have not met the requirements", "did not meet the requirements",
)
PROSPECTIVE = (
    "if your skills", "if your application is selected", "if your application moves forward", "if you are selected",
    "if you're selected", "if selected", "candidates who move forward", "candidates who are selected",
    "candidates selected to move forward", "for candidates selected", "may receive an invitation", "may be invited",
    "if you're invited", "if you are invited", "planning to send", "upon completion", "if applicable",
)
REJECTION_HYPOTHETICAL = (
    "or you were not", "if you were not", "if you are not", "if you're not", "if you have not", "if you haven't",
    "if you did not", "if you didn't",
)
REJECTION_PAIRS = (
    ("unfortunately", "not be moving forward"), ("unfortunately", "not moving forward"), ("unfortunately", "other candidates"),
    ("unfortunately", "made the decision"), ("unfortunately", "not selected"), ("unfortunately", "unable to offer"),
    ("unfortunately", "not be progressing"),
)
OFFER = ("offer of employment", "pleased to offer", "extend an offer", "your offer", "offer letter")
INTERVIEW = (
    "invite you to interview", "invitation to interview", "interview invitation", "invite you to an interview",
    "like to interview you", "would like to interview", "to interview you", "schedule an interview",
    "schedule your interview", "scheduling your interview", "set up an interview", "book an interview",
    "book your interview", "confirm your interview", "your interview is", "interview has been scheduled",
    "interview is scheduled", "phone screen", "schedule a call", "schedule some time", "schedule time",
    "meet with the team", "like to speak with you",
)
INTERVIEW_ROUNDS = (
    "next round", "final round", "round interview", "book a time", "select a slot", "select a time", "choose a time",
    "pick a time",
)
ASSESSMENT = (
    "online assessment", "invited to complete", "assessment invitation", "assessments invitation",
    "complete the assessment", "complete your assessment", "coding challenge", "code challenge", "take home",
    "take-home", "technical screen", "assessment expires", "assessments expire", "assessment will expire",
    "assessments will expire", "assessment have expired", "assessments have expired",
)
ASSESSMENT_IS_DESCRIBED = (" our online assessment", " our assessments", " into our online")
ASSESSMENT_IS_ASSIGNED = (
    "invite you to complete", "invite you to take", "complete the assessment", "complete your assessment",
    "completed the assessment", "completed your assessment", "assessment invitation", "assessments invitation",
    "your assessment link",
)
ASSESSMENT_PLATFORMS = ("hackerrank", "codesignal", "codility", "karat", "coderpad", "hirevue")
ASSESSMENT_TOPIC = ("assessment", "coding challenge", "coding test", "challenge")
ASSESSMENT_PAIRS = (
    ("invite you", "assessment"), ("invitation", "assessment"), ("next step", "assessment"), ("please complete", "rembrandt"),
    ("complete your", "rembrandt"),
)
ACCOUNT_MAIL = (
    "login code", "log-in code", "verification code", "security code", "one-time password", "confirm your identity",
    "sign-in link", "registration",
)
STEP_ASK = ("please ", "kindly ")
STEP_VERB = ("complete", "respond", "reply", "submit", "fill out", "fill in", "return")
CONFIRMATION = (
    "thank you for applying", "thanks for applying", "we have received your application", "we've received your application",
    "application received", "received your application", "your application to", "thank you for your interest in",
    "expressing interest in", "expressed interest in", "application was submitted", "submitting your application",
    "taking the time to submit your application", "time to submit your application", "application sent to",
    "submitted your application", "for submitting your", "thanks so much for applying", "thank you so much for applying",
    "thank you for completing", "starting your submission", "your resume will be reviewed", "creating your career profile",
)
CONFIRMATION_PAIRS = (("received your", "application"), ("application", "has been received"), ("application", "was submitted"))
BULK = (
    "jobs for you", "new jobs", "job alert", "jobs you may be interested", "recommended for you", "top picks for you",
    "hiring now", "apply now to", "we found jobs", "your job search", "unsubscribe from job", "webinar",
    "master's program", "masters program", "bootcamp",
)
BULK_EVENT = ("rsvp", "thanks for your response to", "thank you for your response to", "you are registered", "thanks for registering")
JOB_TOPIC = ("assessment", "application", "applied", "interview", "candidate", "recruit", "position", "internship", "hiring", "job offer")
MACHINE_SENDER = ("no-reply", "noreply", "donotreply", "do-not-reply", "notifications@", "mailer@", "systemmessage@")
ATS_DOMAINS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkday.com", "workday.com", "smartrecruiters.com", "icims.com",
    "workable.com", "rippling.com", "paycomonline.com", "myworkdayjobs.com", "taleo.net", "brassring.com", "jobvite.com",
    "gem.com", "hackerrankforwork.com", "clearcompany.com",
)
#: A deadline counted from now.
SOON = r"within ((the next|[0-9]|one |two |three |four |five |seven |ten )[^.!?]{0,20}(day|hour|week)|a week|a day)"


def any_of(markers: tuple[str, ...]) -> str:
    """A regular expression for any of the markers, as they are."""
    return "(" + "|".join(m.replace(".", "[.]") for m in markers) + ")"


class Seen:
    """The markers that one message holds, with their places."""

    def __init__(self, texts: dict[str, str], flags: dict[str, bool], automaton):
        self.texts, self.flags = texts, flags
        self.at: dict[str, dict[str, list[int]]] = {}
        for field, text in texts.items():
            held = self.at[field] = {}
            for end, marker in automaton.iter(text):
                held.setdefault(marker, []).append(end + 1 - len(marker))
        self._stops: list[int] | None = None

    def sentence(self, place: int) -> int:
        """The number of the sentence that holds a place of the text."""
        if self._stops is None:
            self._stops = [m.start() for m in re.finditer("[.!?]", self.texts["text"])]
        return bisect_left(self._stops, place)

    def sentences(self, markers: tuple[str, ...]) -> set[int]:
        held = self.at["text"]
        return {self.sentence(p) for m in markers if m in held for p in held[m]}

    def words_of(self, sentence: int) -> str:
        begin = self._stops[sentence - 1] + 1 if sentence else 0
        return self.texts["text"][begin : self._stops[sentence] if sentence < len(self._stops) else None]


@dataclass(frozen=True)
class Has:
    """A field holds one of the markers."""

    field: str
    markers: tuple[str, ...]

    def holds(self, seen: Seen) -> bool:
        held = seen.at[self.field]
        return bool(held) and any(m in held for m in self.markers)


@dataclass(frozen=True)
class Sentence:
    """One sentence holds a marker of each group, and what the pattern asks for, and no hedge."""

    groups: tuple[tuple[str, ...], ...]
    hedges: tuple[str, ...]
    pattern: str | None = None

    def holds(self, seen: Seen) -> bool:
        fit = seen.sentences(self.groups[0])
        for group in self.groups[1:]:
            fit &= seen.sentences(group) if fit else set()
        fit = fit and fit - seen.sentences(self.hedges)
        return any(re.search(self.pattern, seen.words_of(s)) for s in fit) if self.pattern else bool(fit)


@dataclass(frozen=True)
class Near:
    """Two markers within GAP characters, either order; with hedges, both outside hedged sentences."""

    pairs: tuple[tuple[str, str], ...]
    hedges: tuple[str, ...] = ()

    def holds(self, seen: Seen) -> bool:
        held = seen.at["text"]
        there = [(a, b) for a, b in self.pairs if a in held and b in held]
        if not there:
            return False
        hedged = seen.sentences(self.hedges)
        free = lambda m: [p for p in held[m] if seen.sentence(p) not in hedged] if hedged else held[m]
        return any(0 <= y - (x + len(one)) <= GAP for a, b in there for one, other in ((a, b), (b, a)) for x in free(one) for y in free(other))


@dataclass(frozen=True)
class Flag:
    name: str

    def holds(self, seen: Seen) -> bool:
        return seen.flags[self.name]


@dataclass(frozen=True)
class Of:
    """``kind`` is and, or, not."""

    kind: str
    tests: tuple

    def holds(self, seen: Seen) -> bool:
        if self.kind == "not":
            return not self.tests[0].holds(seen)
        return (all if self.kind == "and" else any)(t.holds(seen) for t in self.tests)


def all_(*tests) -> Of:
    return Of("and", tests)


def either(*tests) -> Of:
    return Of("or", tests)


def no(test) -> Of:
    return Of("not", (test,))


@dataclass(frozen=True)
class Rule:
    category: str
    confidence: float
    test: object


def stated(markers: tuple[str, ...], hedges: tuple[str, ...] = PROSPECTIVE) -> Sentence:
    return Sentence((markers,), hedges)


_YOURS = either(no(Has("text", ASSESSMENT_IS_DESCRIBED)), Has("text", ASSESSMENT_IS_ASSIGNED))
_PERSON = all_(Flag("sent"), no(Has("sender", MACHINE_SENDER)))
#: In the order in which they are tried.
RULES = (
    Rule("rejection", 0.90, stated(REJECTION, REJECTION_HYPOTHETICAL)),
    Rule("rejection", 0.85, Near(REJECTION_PAIRS)),
    Rule("offer", 0.85, Has("text", OFFER)),
    Rule("interview", 0.80, stated(INTERVIEW)),
    Rule("oa", 0.80, all_(_YOURS, stated(ASSESSMENT))),
    Rule("oa", 0.75, all_(_YOURS, either(
        all_(Has("sender", ASSESSMENT_PLATFORMS), stated(ASSESSMENT_TOPIC)),
        Sentence((ASSESSMENT_TOPIC, ASSESSMENT_PLATFORMS), PROSPECTIVE),
    ))),
    Rule("oa", 0.70, all_(_YOURS, Near(ASSESSMENT_PAIRS, PROSPECTIVE))),
    Rule("interview", 0.75, stated(INTERVIEW_ROUNDS)),
    Rule("disregarded", 0.70, all_(Has("headline", ACCOUNT_MAIL), no(Has("headline", ("intern",))))),
    Rule("oa", 0.65, all_(Sentence((STEP_ASK, STEP_VERB), PROSPECTIVE, SOON), Has("text", JOB_TOPIC))),
    Rule("confirmation", 0.85, Has("text", CONFIRMATION)),
    Rule("confirmation", 0.80, Near(CONFIRMATION_PAIRS)),
    Rule("confirmation", 0.60, all_(Has("headline", ("welcome to",)), Has("headline", ("careers",)))),
    Rule("disregarded", 0.70, Has("headline", BULK_EVENT)),
    Rule("disregarded", 0.70, Has("text", BULK)),
    Rule("outreach", 0.50, either(Has("sender", ATS_DOMAINS), Has("sender", ASSESSMENT_PLATFORMS), all_(Flag("named"), _PERSON))),
    Rule("outreach", 0.45, all_(Flag("named_in_head"), Has("text", JOB_TOPIC))),
)
DEFAULT = ("disregarded", 0.60)
STATUS_OF = {"oa": "oa", "interview": "interview", "offer": "offer", "rejection": "rejected"}


def folded(*parts: Column) -> Column:
    """Lower case, entities decoded, curly marks straight."""
    text = F.lower(decode_entities(F.concat_ws("\n", *parts)))
    return F.translate(text, "‘’“”–—", "''\"\"--")


def mail(sender: Column, subject: Column, *more: Column) -> Column:
    """struct<text, headline, sender>: the folded texts that rules look at. Select it before use, so that it is made once."""
    return F.struct(folded(subject, *more).alias("text"), folded(subject).alias("headline"), F.lower(F.coalesce(sender, F.lit(""))).alias("sender"))


def _markers(test) -> set[str]:
    """All markers below a test."""
    if isinstance(test, Of):
        return set().union(*map(_markers, test.tests))
    if isinstance(test, Has):
        return set(test.markers)
    if isinstance(test, Sentence):
        return set(test.hedges).union(*test.groups)
    return {m for p in test.pairs for m in p} | set(test.hedges) if isinstance(test, Near) else set()


@lru_cache(maxsize=8)
def _automaton(rules: tuple[Rule, ...]):
    found = ahocorasick.Automaton()
    for marker in sorted(set().union(*(_markers(r.test) for r in rules))):
        found.add_word(marker, marker)
    found.make_automaton()
    return found


def first_rule(text: str, headline: str, sender: str, named_in: str | None, rules: tuple[Rule, ...] = RULES) -> int:
    """The number of the first rule that holds for a message, -1 for none: one pass of an automaton, then tests on places."""
    flags = {"named": named_in is not None, "named_in_head": named_in in ("sender", "subject"), "sent": sender != ""}
    seen = Seen({"text": text, "headline": headline, "sender": sender}, flags, _automaton(rules))
    return next((i for i, r in enumerate(rules) if r.test.holds(seen)), -1)


def classify(message: Column, named_in: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<category, confidence, rule>; rule is the number of the first that holds, -1 for none.

    ``message``: what ``mail`` makes, or a folded text; ``named_in``: of ``quillon.operators.names``.
    """

    @F.pandas_udf("int")
    def place(text: pd.Series, headline: pd.Series, sender: pd.Series, named: pd.Series) -> pd.Series:
        rows = zip(text.fillna(""), headline.fillna(""), sender.fillna(""), named.astype(object).where(named.notna(), None), strict=True)
        return pd.Series([first_rule(*r, rules) for r in rows], dtype="int32")

    named_in = F.lit(None).cast("string") if named_in is None else named_in
    number = place(message["text"], message["headline"], message["sender"], named_in)
    outcomes = [(-1, *DEFAULT), *((i, r.category, r.confidence) for i, r in enumerate(rules))]
    known = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("confidence"), F.lit(i).alias("rule")) for i, c, p in outcomes])
    return F.get(known, number + 1)


def status_of(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), category)


def confusion(graded: DataFrame, truth: str, predicted: str) -> DataFrame:
    return graded.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def rates(graded: DataFrame, truth: str, predicted: str) -> DataFrame:
    """graded, agreed, and failures by name, each with a denominator of its own."""
    t, p = F.col(truth), F.col(predicted)
    junk, real = t == "disregarded", t != "disregarded"
    pressing = t.isin("oa", "interview", "offer")
    return graded.filter(t.isNotNull()).agg(
        F.count(F.lit(1)).alias("graded"), F.count_if(t == p).alias("agreed"),
        F.count_if(junk).alias("junk"), F.count_if(junk & (p == "outreach")).alias("junk_leaked_to_outreach"),
        F.count_if(real).alias("real"), F.count_if(real & (p == "disregarded")).alias("real_mail_disregarded"),
        F.count_if(pressing).alias("pressing"), F.count_if(pressing & (p != t)).alias("pressing_missed"),
    )


def gate(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row, ``passed``: same size, agreement not lower, no failure count higher."""
    a, b = measured.alias("a"), baseline.alias("b")
    worse = [F.col(f"a.{c}") > F.col(f"b.{c}") for c in ("junk_leaked_to_outreach", "real_mail_disregarded", "pressing_missed")]
    ok = (F.col("a.graded") == F.col("b.graded")) & (F.col("a.agreed") >= F.col("b.agreed")) & ~(worse[0] | worse[1] | worse[2])
    return a.crossJoin(b).select(ok.alias("passed"))  # two one-row frames


def label_drift(messages: DataFrame, expected: str, present: str) -> DataFrame:
    """Labels that should be there and are not, and the reverse."""
    return messages.withColumns({"missing": F.array_except(expected, present), "extra": F.array_except(present, expected)})

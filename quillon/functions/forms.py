"""Which profile field a form's label asks for, if any, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels never to be filled, labels about others, prompts, and the phrases of each field.
BLOCKED = (
    r"password", r"\bpin\b", r"social security", r"\bssn\b", r"\bsin\b", r"tax\s*(id|identification)", r"\bitin\b", r"credit\s*card",
    r"debit\s*card", r"card\s*number", r"\bcvv\b", r"\bcvc\b", r"security\s*code", r"expiry|expiration\s*date", r"bank\s*account",
    r"routing\s*number", r"\biban\b", r"sort\s*code", r"passport", r"driv(er|ing)\s*s?\s*licen[sc]e", r"national\s*(id|insurance)",
    r"government\s*id", r"recaptcha", r"captcha", r"\bcc\s*(number|csc|cvc|exp|expiry|name)\b",
)
DEMOGRAPHIC = (
    r"\brace\b", r"ethnicity|ethnic\s*group", r"\bgender\b", r"\bsex\b", r"veteran", r"disabilit(y|ies)", r"sexual\s*orientation",
    r"transgender", r"\blgbt", r"date\s*of\s*birth|\bdob\b",
)
THIRD_PARTY = (
    r"emergency\s*contact", r"next\s*of\s*kin", r"\breferences?\b", r"\breferrer\b|referred\s*by|who\s*referred",
    r"\bmanager\b|supervisor", r"\bemployer\b", r"\bparent\b|guardian", r"\bspouse\b",
)
ESSAY = r"^(describe|explain|tell|share|list|walk|why)\b"
SOURCING = r"\b(how|where)\s+did\s+you\s+(hear|find|learn|discover)\b"
EXACT_ONLY = {"full_name": ["name"], "first_name": ["first"], "last_name": ["last"], "phone": ["mobile"]}
SYNONYMS = {
    "first_name": ["first name", "given name", "forename"],
    "last_name": ["last name", "surname", "family name"],
    "preferred_name": ["preferred name", "nickname", "goes by", "preferred first name"],
    "full_name": ["full name", "legal name", "your name", "candidate name", "full legal name"],
    "email": ["email", "e mail", "email address", "work email", "personal email"],
    "phone": ["phone", "phone number", "telephone", "mobile number", "mobile phone", "cell", "cell phone"],
    "location": ["location", "city", "current location", "address", "city and state", "where are you located", "current city"],
    "school": ["school", "university", "college", "institution", "school name"],
    "degree": ["degree", "degree type", "level of education"],
    "major": ["major", "field of study", "discipline", "course of study", "concentration"],
    "gpa": ["gpa", "grade point average"],
    "graduation_year": ["graduation year", "grad year", "expected graduation year", "year of graduation", "anticipated graduation year"],
    "graduation_date": ["graduation date", "expected graduation date", "anticipated graduation date", "grad date", "expected graduation"],
    "graduation_month": ["graduation month", "grad month", "expected graduation month"],
    "github_url": ["github", "github url", "github profile", "github username"],
    "linkedin_url": ["linkedin", "linkedin url", "linkedin profile"],
    "portfolio_url": ["portfolio", "personal website", "personal site", "portfolio url"],
    "work_authorization": ["work authorization", "authorized to work", "work status", "visa status", "employment authorization"],
    "needs_sponsorship": ["sponsorship", "require sponsorship", "need sponsorship", "will you require sponsorship", "visa sponsorship"],
}
TRAILING_ONLY = "major"
QUESTION = r"^(what|when|where|which|who|how|do|does|did|are|is|have|has|can|will|would)\b"
ANSWERS_A_QUESTION = ("work_authorization", "needs_sponsorship")


def any_pattern(patterns: tuple[str, ...]) -> str:
    return "|".join(f"({p})" for p in patterns)


def label_key(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\*", " "), r"\(required\)|\(optional\)", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def field_of(raw: Column) -> Column:
    """blocked, skip, or the field's name.

    Refusals come first, on the words as written and on words run together; then an equal phrase;
    then the field whose longest phrase the label holds, if no other field's is as long; a question that
    holds phrases of several fields is left alone.
    """
    label, apart = label_key(raw), label_key(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"))
    refuses = lambda patterns: label.rlike(any_pattern(patterns)) | apart.rlike(any_pattern(patterns))
    equal = F.lit(None).cast("string")
    for key, phrases in reversed([*SYNONYMS.items(), *EXACT_ONLY.items()]):
        equal = F.when(label.isin(phrases), F.lit(key)).otherwise(equal)
    held = []
    for key, phrases in SYNONYMS.items():
        longest = F.lit(0)
        for p in sorted(phrases, key=len):
            here = label.rlike(f"(^| ){p}$" if p == TRAILING_ONLY else f"(^| ){p}( |$)")
            longest = F.when(here, F.lit(len(p))).otherwise(longest)
        held.append(F.struct(longest.alias("n"), F.lit(key).alias("key")))
    ranked = F.array_sort(F.array(*held), lambda a, b: b["n"] - a["n"])
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    asks = (F.contains(raw, F.lit("?")) | label.rlike(QUESTION)) & (second["n"] > 0) & ~first["key"].isin(*ANSWERS_A_QUESTION)
    contained = F.when((first["n"] > 0) & (first["n"] > second["n"]) & ~asks, first["key"])
    return (
        F.when(label == "", "skip").when(refuses(BLOCKED) | refuses(DEMOGRAPHIC), "blocked").when(refuses(THIRD_PARTY), "skip")
        .when(label.rlike(ESSAY) | label.rlike(SOURCING), "skip").otherwise(F.coalesce(equal, contained, F.lit("skip")))
    )

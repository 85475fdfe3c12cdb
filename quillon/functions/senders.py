"""The employer behind a message's sender, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a sender that name a department, and domains that write for others.
ROLE_WORDS = (
    "careers", "career", "early", "recruiting", "recruitment", "talent", "acquisition", "hiring", "team", "university", "campus",
    "support", "notifications", "notification", "reply", "noreply", "donotreply", "jobs", "job", "hr", "people", "no", "do", "not",
    "the", "at", "via", "info", "admin", "mail", "mailer", "system", "systemmessage", "message", "messages", "alerts", "alert",
    "service", "services", "us", "inc", "llc", "human", "resources",
)
RELAYS = (
    "joinhandshake.com", "handshake.com", "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com",
    "andrew.cmu.edu", "cmu.edu", "sendgrid.net", "mailgun.org", "amazonses.com", "hackerrank.com", "codesignal.com", "eightfold.ai",
)
_ROLE = "|".join(ROLE_WORDS)


def ends_with(domains: tuple[str, ...]) -> str:
    return "(" + "|".join(d.replace(".", "[.]") for d in domains) + ")$"


def cleaned(c: Column) -> Column:
    """Words without those of a department at either end; null under three characters or without a letter."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(F.regexp_replace(words, f"( ({_ROLE}))+$", ""), f"^(({_ROLE})( |$))+", "")
    return F.when((F.length(bare) >= 3) & bare.rlike(r"\p{L}"), bare)


def employer(sender: Column, subject: Column, platforms: tuple[str, ...], machine: str) -> Column:
    """From a subject that says where an application went; else a display name that agrees with the sender's own
    domain; else the domain's name; else, of a person's own address, what stands before the at sign."""
    s, head = F.lower(F.coalesce(sender, F.lit(""))), F.lower(F.coalesce(subject, F.lit("")))
    said = F.coalesce(*[cleaned(F.nullif(F.regexp_extract(head, f"{m}([^-—:|,]*)", 1), F.lit(""))) for m in ("application sent to ", "application to ")])
    split = F.contains(s, F.lit("<"))
    display = F.when(split, F.regexp_replace(F.trim(F.split_part(s, F.lit("<"), F.lit(1))), '^"+|"+$', "")).otherwise("")
    address = F.trim(F.regexp_replace(F.when(split, F.regexp_replace(s, "^[^<]*<", "")).otherwise(s), ">+$", ""))
    domain = F.substring_index(address, "@", -1)
    parts = F.split(domain, "[.]")
    label = F.when(~domain.rlike(ends_with((*platforms, *RELAYS))) & (F.size(parts) >= 2), F.get(parts, F.size(parts) - 2))
    relay = address.rlike(ends_with(RELAYS))
    name = cleaned(display)
    squashed = F.replace(name, F.lit(" "), F.lit(""))
    initials = F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")
    agrees = F.when(label.isNull(), True).otherwise((label != "") & (F.contains(squashed, label) | F.contains(label, squashed) | (initials == label)))
    local = F.when(~relay & ~s.rlike(machine), cleaned(F.split_part(address, F.lit("@"), F.lit(1))))
    return F.coalesce(said, F.when(~relay & agrees, name), cleaned(label), local)

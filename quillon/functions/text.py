"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of company names.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "plc", "lp", "llp",
    "ag", "sa", "sas", "bv", "nv", "ab", "oy", "as", "pty", "pte", "spa", "srl", "kk",
)
# Words of a title that do not identify the role.
TITLE_NOISE = (
    "summer", "fall", "autumn", "winter", "spring", "intern", "interns", "internship", "internships", "coop", "program", "programme",
)


def phrase(c: Column) -> Column:
    """Lower-case words between single spaces, with one at each end; for word-wise ``contains``."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_phrase(c: Column, words: list[str]) -> Column:
    """Does any of the phrases occur as whole words?"""
    alternatives = "|".join(sorted(words, key=len, reverse=True))
    return phrase(c).rlike(f" ({alternatives}) ")


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def company_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Words of a company name without legal suffixes at the end (one word stays at least), an alias as what it stands for."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    key = F.regexp_replace(words, f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    if not aliases:
        return key
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), key), key)


def title_key(c: Column) -> Column:
    """Words of a title outside brackets that are neither four-digit numbers nor noise, joined by hyphens."""
    bare = F.regexp_replace(c, r"[(\[{][^)\]}]*[)\]}]", "")
    words = F.split(F.lower(bare), r"[^\p{L}\p{N}]+")
    noise = F.array(*map(F.lit, TITLE_NOISE))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]{4}$") & ~F.array_contains(noise, w)), "-")


def is_company_name(c: Column, stoplist: list[str]) -> Column:
    """At least two characters, a letter among them, and not a placeholder."""
    t = F.trim(c)
    return (F.length(t) >= 2) & t.rlike(r"\p{L}") & ~F.lower(t).isin(stoplist)


def first_string(*cols: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text of an HTML page: no script or style, tags as spaces, white space collapsed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


# Named character references and the plain characters that stand for them.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "-", "mdash": "-", "lsquo": "'",
    "rsquo": "'", "ldquo": '"', "rdquo": '"', "hellip": ".", "middot": ".", "bull": ".", "reg": " ", "copy": " ",
    "trade": " ", "eacute": "e", "egrave": "e", "uuml": "u", "ouml": "o", "auml": "a", "ccedil": "c", "ntilde": "n",
}
LONGEST_REFERENCE = 11


def decode_entities(c: Column) -> Column:
    """Character references decoded once: named, ``&#n;`` and ``&#xh;``; what is none stays as written."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def decoded(part: Column) -> Column:  # what follows an ampersand
        body = F.regexp_extract(part, rf"^([#A-Za-z0-9]{{1,{LONGEST_REFERENCE}}});", 1)
        digits = F.coalesce(
            F.conv(F.nullif(F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]{1,7})$", 1), F.lit("")), 16, 10).cast("long"),
            F.nullif(F.regexp_extract(body, "^#([0-9]{1,10})$", 1), F.lit("")).cast("long"),
        )
        code = F.when((digits < 0xD800) | digits.between(0xE000, 0x10FFFF), digits)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        plain = F.coalesce(F.try_element_at(named, body), char)
        return F.coalesce(F.concat(plain, F.substr(part, F.length(body) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def unescape(c: Column) -> Column:
    """The common entities; ``&amp;`` last, so that nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c

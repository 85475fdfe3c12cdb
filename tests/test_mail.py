"""Roles, companies and rules read out of mail, against cases written by hand and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.roles import role_from
from quillon.operators import classify as C
from quillon.operators import names as N

ROLES = (
    ("Your application for Software Engineer Intern at Acme!", None, "Software Engineer Intern"),
    ("Thank you for applying to Acme!", None, None),
    ("Thank you!", "Thanks for applying for the Data Platform Intern role. We loved reading it.", "Data Platform Intern"),
    ("Thank you for your interest in Hill Road Trading's Summer 2027 Research Internship", None, "Summer 2027 Research Internship"),
    ("Thank you for your interest in Hill Road Trading’s Research Internship", None, "Research Internship"),
    ("your interest in Tetra Inc and the US 2026 Machine Learning Intern", None, "US 2026 Machine Learning Intern"),
    ("application for the Systems and the Networks Intern", None, "Systems and the Networks Intern"),  # no interest, no employer
    ("application: R171519 2027 Intern - Compilers", None, "2027 Intern - Compilers"),
    ("applying for the Intern Opportunities for Students, (Job number: 200042195)", None, "Intern Opportunities for Students"),
    ("your application for Access Systems Intern (Fall 2026) position", None, "Access Systems Intern (Fall 2026)"),
    ("your application for Software Engineering Internship (Summer 2", None, "Software Engineering Internship"),
    ("applying for Full Stack Intern (Web + Services) Req ID (200042195)", None, "Full Stack Intern (Web + Services)"),
    ("Your application for Compiler Intern - Summer 2027 role has been received", None, "Compiler Intern - Summer 2027"),
    ("your application for the position of QA Intern Req #2", None, "QA Intern"),
    ("interest in the Information Systems and IT Intern", None, "Information Systems and IT Intern"),
    ("Your interest in Two Sigma!", None, None),
    ("application for Summer &#39;27 Robotics Intern", None, "Summer '27 Robotics Intern"),
    ("YOUR APPLICATION FOR ROBOTICS INTERN", None, "ROBOTICS INTERN"),
    ("İİ application for Robotics Intern", None, "Robotics Intern"),
    ("application for " + "Very Long " * 20 + "Intern", None, None),
    ("application for 2026's Master Intern", None, "2026's Master Intern"),
    (None, None, None),
    ("application for ", "", None),
    ("your application for a painter at Acme", "you are applying for position 130043 - QA Engineer Intern and we are glad", "QA Engineer Intern"),
)


def test_roles(spark):
    rows = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(ROLES)], "i int, a string, b string")
    got = {r.i: r.role for r in rows.select("i", role_from(F.col("a"), F.col("b")).alias("role")).collect()}
    assert got == {i: r[2] for i, r in enumerate(ROLES)}


def plain_longest(text, names, squashed):
    found = []
    for n in names:
        form = n.replace(" ", "") if squashed else n
        if squashed and form in N.ROLE_WORDS:
            continue
        for at in range(len(text or "")):
            end = at + len(form)
            if text.startswith(form, at) and not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                found.append(n)
    return min(found, key=lambda n: (-len(n.encode()), n)) if found else None


@pytest.mark.parametrize("most", [100_000, 7])
def test_names_are_found_whole_and_longest(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_NAMES", most)  # 7: several broadcasts
    r = random.Random(8)
    words = ["exa", "kla", "sage", "reply", "zip", "été", "jump trading", "jump", "e-bay", "o'neil & co"]
    names = [*words, *(" ".join(r.choice(["ab", "abc", "exa", "zip", "né"]) for _ in range(r.randint(1, 3))) for _ in range(40)), "x", "12345", "internship", " EXA ", None]
    texts = [" ".join(r.choice(["abc", "exa", "oexa", "zip,", "né", "ab.", "jump trading", "e-bay", "reply"]) for _ in range(r.randint(0, 8))) for _ in range(150)] + [None, "", "çzip", "no-reply@jumptrading.com", "message from exab", "o'neil & co"]
    finder = N.Finder(spark, spark.createDataFrame([(n,) for n in names], "name string"), stoplist=("internship",))
    assert finder.parts == (1 if most > 1000 else finder.parts) and (most > 1000 or finder.parts > 1)
    known = {n.strip().lower() for n in names if n} - {"x", "12345", "internship"}
    known = {n for n in known if len(n.encode()) >= 3}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: (x.f.sender, x.f.headline, x.f.text) for x in rows.select("i", finder.found(F.col("t"), F.col("t"), F.col("t")).alias("f")).collect()}
    for i, t in enumerate(texts):
        plain, short = plain_longest(t, known, False), plain_longest(t, known, True)
        assert got[i][1:] == (plain, plain), (t, got[i], plain)
        assert got[i][0] == short, (t, got[i], short)


def test_guess_prefers_the_head_and_telling_names(spark):
    finder = N.Finder(spark, spark.createDataFrame([("secure",), ("acme labs",), ("workiva",), ("constellation",)], "name string"))
    cases = (
        ("hr@acmelabs.com", "Hello", "secure your spot", "acme labs", "sender"), ("x@gmail.com", "From Workiva", "acme labs", "workiva", "subject"),
        ("x@gmail.com", "Hello", "Secure your spot", None, None), ("x@gmail.com", "Hello", "join Constellation", "constellation", "body"),
        ("Sam <sam@zed.io>", "Hello", "Secure it", "zed", None), (None, None, None, None, None),
    )
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, sender string, subject string, body string")
    rows = rows.withColumn("m", C.mail(F.col("sender"), F.col("subject"), F.col("body")))
    rows = rows.withColumn("found", finder.found(F.col("m.sender"), F.col("m.headline"), F.col("m.text")))
    guess = N.company_guess(F.col("found"), F.col("sender"), F.col("subject"), C.ATS_DOMAINS, C.any_of(C.MACHINE_SENDER))
    got = {r.i: (r.g, r.w) for r in rows.select("i", guess.alias("g"), N.named_in(F.col("found")).alias("w")).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}


def test_places_of_markers():
    """Pairs at the edge of the gap, in either order, and hedges of a sentence."""
    near = C.Rule("x", 1.0, C.Near((("unfortunately", "other candidates"),)))
    hedged = C.Rule("x", 1.0, C.Near((("invite you", "assessment"),), C.PROSPECTIVE))
    decide = lambda text, rule: C.first_rule(text, "", "", None, (rule,)) == 0
    for gap in (0, C.GAP, C.GAP + 1):
        between = "-" * gap
        assert decide(f"unfortunately{between}other candidates", near) == (gap <= C.GAP)
        assert decide(f"other candidates{between}unfortunately", near) == (gap <= C.GAP)
    assert decide("we invite you to an assessment", hedged) and not decide("if selected, we invite you. to an assessment", hedged)
    assert decide("if selected, we invite you. we invite you to an assessment", hedged)
    step = C.RULES[9]
    assert decide("please, your application. complete it within a week and kindly reply", step)
    assert not decide("please send your application. we act within a week", step)

"""Lists of names that no broadcast holds: found by a join, against plain loops, and with no list sent to the tasks."""

import random

from pyspark.sql import functions as F

from quillon.operators import names as N


def plain_longest(text, forms):
    """``forms``: (what stands in the text, name)."""
    found = []
    for form, name in forms:
        at = (text or "").find(form)
        while at >= 0:
            end = at + len(form)
            if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                found.append(name)
            at = text.find(form, at + 1)
    return min(found, key=lambda n: (-len(n.encode()), n)) if found else None


def refused(*_):
    raise AssertionError("a list went to the tasks")


def test_found_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_NAMES", 7)
    monkeypatch.setattr(N.Finder, "_scan", refused)
    monkeypatch.setattr(N, "AT_ONCE", 50)
    r = random.Random(5)
    parts = ["ab", "abc", "exa", "né", "e-bay", "o'neil & co", ".net", "c++", "x_y", "10²", "日本", "-", "jump  trading"]
    names = [" ".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(60)] + ["reply", "zed", "a b c", "ab c", " EXA ", None, "x" * 201, "hr", "12345"]
    texts = [r.choice([" ", ", ", "-", "\n"]).join(r.choice([*parts, "oexa", "zip", "reply", "abcé", "exaab", "abce-bay"]) for _ in range(r.randint(0, 9))) for _ in range(160)]
    texts += [None, "", "no-reply@abcexa.com", "hr@zed", "asp.net", "a .net c++", "..net", "reply", *names[:40]]
    finder = N.Finder(spark, spark.createDataFrame([(n,) for n in names], "name string"))
    known = {n.strip(" ").lower() for n in names if n} - {"12345"}
    known = {n for n in known if len(n.encode()) >= 3 and len(n) <= 200 and any(c.isalpha() for c in n)}
    plain, short = [(n, n) for n in known], [(n.replace(" ", ""), n) for n in known if n.replace(" ", "") not in N.ROLE_WORDS]
    # three texts of a row, and rows that repeat
    rows = [(i, texts[i], texts[i * 7 % len(texts)], texts[i * 11 % len(texts)]) for i in range(len(texts))] * 2
    frame = spark.createDataFrame(rows, "i int, a string, b string, c string")
    got = finder.find(frame, F.col("a"), F.col("b"), F.col("c")).collect()
    assert finder.parts > 1 and len(got) == len(rows)
    for x in got:
        want = plain_longest(x.a, short), plain_longest(x.b, plain), plain_longest(x.c, plain)
        assert tuple(x.found) == want, (x, want)
    assert sum(x.found.sender is not None for x in got) > 40 and sum(x.found.text is not None for x in got) > 40


def test_a_short_list_is_found_in_the_tasks(spark):
    frame = spark.createDataFrame([("x@acme.io", "hello", "from zed"), (None, None, None)], "a string, b string, c string")
    found = N.Finder(spark, spark.createDataFrame([("acme",), ("zed",)], "name string")).find(frame, F.col("a"), F.col("b"), F.col("c"))
    assert {tuple(x.found) for x in found.collect()} == {("acme", None, "zed"), (None, None, None)}

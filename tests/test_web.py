"""Bodies, robots files, sources that fail and bucketed tables, against plain loops."""

import base64
import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from quillon.functions import mime
from quillon.functions import robots as R
from quillon.operators import buckets as B
from quillon.sources import registry


def plain_find(part, kind):
    """By recursion, as the tree reads."""
    if part.get("mimeType") == kind and (part.get("body") or {}).get("data") is not None:
        data = part["body"]["data"].replace("=", "").replace("\n", "").replace("\r", "")
        if not all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_" for c in data):
            return None
        bits = "".join(format("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_".index(c), "06b") for c in data)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8)).decode("utf-8", "replace")
    for inner in part.get("parts") or []:
        if (found := plain_find(inner, kind)) is not None:
            return found
    return None


def plain_clean(raw, html):
    out, low, i, inside, until = [], raw.lower(), 0, False, None
    while html and i < len(raw):
        if until:
            i, until = (i + len(until), None) if low.startswith(until, i) else (i + 1, until)
        elif low.startswith("<script", i):
            i, until = i + 7, "</script>"
        elif low.startswith("<style", i):
            i, until = i + 6, "</style>"
        else:
            c = raw[i]
            if c == "<":
                inside = True
            elif c == ">":
                inside = False
                out.append(" ")
            elif not inside:
                out.append(c)
            i += 1
    return " ".join(("".join(out) if html else raw).split())


def plain_body(payload):
    try:
        tree = json.loads(payload) if payload else None
    except ValueError:
        return None
    if not isinstance(tree, dict):
        return None
    plain = plain_find(tree, "text/plain")
    text = plain_clean(plain, False) if plain is not None else ""
    if not text:
        raw = plain_find(tree, "text/html")
        text = plain_clean(raw, True) if raw is not None else ""
    return text[:4000] or None


def test_bodies_against_plain_recursion(spark):
    r = random.Random(12)
    said = ["hello  world", " \n", "<p>one</p><b>two", "<style>x{}</style>é ü<script>a<b>c</script >d</script> tail", "a > b < c > d", "x" * 5000, "<scr<script>x</script>ipt>", "日本 語   end", "<STYLE>never closed"]

    def data():
        x = base64.urlsafe_b64encode(r.choice(said).encode()).decode()
        return r.choice([x, x.rstrip("="), x[:20] + "\r\n" + x[20:], "!!", "", None, x.rstrip("=") + "A", base64.urlsafe_b64encode(b"\xff\xfeab").decode()])

    def tree(depth):
        part = {"mimeType": r.choice(["text/plain", "text/html", "multipart/mixed", "image/png", None])}
        if r.random() < 0.6:
            part["body"] = r.choice([{"data": data()}, {}, None])
        if depth and r.random() < 0.7:
            part["parts"] = [tree(depth - 1) for _ in range(r.randint(0, 3))]
        return part

    deep = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"deep").decode()}}
    for _ in range(200):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    payloads = [json.dumps(tree(4)) for _ in range(300)] + [json.dumps(deep), None, "", "no json", "[1, 2]", "3", "{}"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = {x.i: x.b for x in rows.select("i", mime.body_text(F.col("p")).alias("b")).collect()}
    assert got == {i: plain_body(p) for i, p in enumerate(payloads)} and sum(v is not None for v in got.values()) > 40


def plain_permits(rules, path):
    best = None
    for pattern, allow in rules:
        anchored, at, ok = pattern.endswith("$"), 0, True
        parts = (pattern[:-1] if anchored else pattern).split("*")
        for n, part in enumerate(parts):
            if part == "":
                continue
            found = at if n == 0 and path.startswith(part) else path.find(part, at) if n else -1
            ok, at = (ok and found >= 0), found + len(part)
            if not ok:
                break
        if ok and (not anchored or at == len(path)) and (best is None or len(pattern) > len(best[0]) or (len(pattern) == len(best[0]) and allow and not best[1])):
            best = (pattern, allow)
    return best is None or best[1]


def test_robots_rules_and_patterns(spark):
    r = random.Random(5)
    rules = [(r.choice("/*") + "".join(r.choice("ab/*.") for _ in range(r.randint(0, 5))) + r.choice(["", "", "$"]), r.random() < 0.5) for _ in range(60)]
    paths = ["/" + "".join(r.choice("ab/.") for _ in range(r.randint(0, 7))) for _ in range(40)]
    cases = [(r.sample(rules, r.randint(0, 6)), p) for p in paths for _ in range(4)]
    text = lambda rs: "User-Agent: *\r\n" + "\n".join(f"{'allow' if a else 'DISALLOW'} : {p}  # note" for p, a in rs)
    rows = spark.createDataFrame([(i, text(rs), p) for i, (rs, p) in enumerate(cases)], "i int, r string, p string")
    got = {x.i: x.ok for x in rows.select("i", R.robots_permit(R.robots_rules(F.col("r")), F.col("p")).alias("ok")).collect()}
    assert got == {i: plain_permits(rs, p) for i, (rs, p) in enumerate(cases)} and 20 < sum(got.values()) < len(got) - 20


def test_a_failing_source_does_not_end_the_run(spark):
    def breaks():
        raise RuntimeError("no route")

    def breaks_late():
        yield "late"
        raise OSError("cut off")

    sources = {"a": lambda: ["one", "two"], "b": breaks, "c": lambda: iter(["three"]), "d": breaks_late, "e": lambda: [], "off": breaks}
    payloads, outcomes = registry.fetch_all(spark, sources, disabled=["off"])
    assert sorted(map(tuple, payloads.collect())) == [("a", "one"), ("a", "two"), ("c", "three"), ("d", "late")]
    assert sorted(map(tuple, outcomes.collect())) == [
        ("a", "success", 2, None), ("b", "failed", 0, "RuntimeError: no route"), ("c", "success", 1, None), ("d", "partial", 1, "OSError: cut off"),
        ("e", "success", 0, None), ("off", "skipped", 0, "disabled by configuration"),
    ]


def test_a_small_batch_rewrites_its_own_buckets(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    new = "source string, external_id string, posting_id string, url string, at timestamp, run long"
    kept = B.BucketedTable(spark, str(tmp_path / "sightings"), B.SIGHTINGS, ["source", "external_id"], 8)
    first = [("s", str(i), f"p{i}", "u", at(i), 1) for i in range(60)] + [("t", None, "p", "u", at(0), 1)]
    assert kept.merge(spark.createDataFrame(first, new), B.seen_again) == list(range(8))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "sightings") for f in fs if f.endswith(".parquet")}
    before = files()
    again = [("s", "7", "q", "v", at(99), 2), ("s", "7", "r", "w", at(98), 2), ("s", "new", "n", "n", at(97), 2)]
    touched = kept.merge(spark.createDataFrame(again, new), B.seen_again)
    assert 1 <= len(touched) <= 2
    after = files()
    assert {f for f in before if f in after} == {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched} and all(after[f] == before[f] for f in before if f in after)
    rows = {(r.source, r.external_id): r for r in kept.read().collect()}
    assert len(rows) == 62 and (rows["s", "7"].posting_id, rows["s", "7"].first_seen, rows["s", "7"].last_seen, rows["s", "7"].misses) == ("q", at(7), at(99), 0)
    assert rows["s", "8"].posting_id == "p8" and rows["s", "new"].first_seen == at(97)
    kept.merge(spark.createDataFrame(again, new), B.seen_again)  # a batch that is merged again changes nothing
    assert {(r.source, r.external_id): r for r in kept.read().collect()} == rows
    assert kept.merge(spark.createDataFrame([], new), B.seen_again) == []

"""Keys of short names that differ by one letter, and mail matched to applications against a plain loop."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.fuzzy import _similarity
from quillon.operators import matching

FIRMS = ["firm " + hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(3000)]


def test_firms_of_few_letters_meet_hardly_any_others(spark):
    """All firms are made of sixteen digits; sets of their letters would pair most of them."""
    firms = spark.createDataFrame([(f,) for f in FIRMS], "t string")
    keyed = matching._one_less(firms, 0.9)
    met = keyed.alias("x").join(keyed.alias("y"), "key").filter("x.t < y.t").select("x.t", "y.t").distinct().count()
    assert keyed.count() <= 18 * len(FIRMS) and met < 50


def test_short_names_need_no_letter_keys(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("sets of letters")

    monkeypatch.setattr(matching, "_letter_keys", refused)
    mail = [*(f + "s" for f in FIRMS[:40]), *(f[:7] + f[8] + f[7] + f[9:] for f in FIRMS[40:80]), *(f[:9] + "x" + f[10:] for f in FIRMS[80:120]), *(f[:6] + f[7:] for f in FIRMS[120:160]), FIRMS[160], "zz" + FIRMS[161], None, ""]
    rows = spark.createDataFrame([(f,) for f in mail], "m string")
    got = {(r.m, r.k): r.score for r in matching.fuzzy_companies(rows, "m", spark.createDataFrame([(f,) for f in FIRMS], "k string"), "k").collect()}
    want = {(m, k): _similarity(m, k) for m, k in zip(mail[:161], FIRMS, strict=False)}
    assert got == pytest.approx(want) and len(want) == 161


def plain_match(mail, apps, least):
    best = {}
    for i, firm, role in mail:
        for app, known, own in apps:
            if firm and known and _similarity(firm, known) >= least:
                words = min(len((role or "").split(" ")), len((own or "").split(" ")))
                if role == "":
                    fit = 0
                elif role is not None and role == own:
                    fit = 3
                elif role is not None and own and words >= 3 and (own.startswith(role + " ") or role.startswith(own + " ")):
                    fit = 2
                elif own == "":
                    fit = 1
                else:
                    continue
                best.setdefault(i, {}).setdefault(fit, set()).add(app)
    top = {i: (max(fits), fits[max(fits)] - {None}) for i, fits in best.items()}
    return {(i, min(ids), fit) for i, (fit, ids) in top.items() if len(ids) == 1}


def test_mail_against_a_plain_loop(spark):
    """Ids of mail and of applications repeat, roles and ids are unknown at times."""
    r = random.Random(11)
    roles = ["", "data intern", "software engineering intern", "software engineering intern platform", "software engineering intern platform team", None]
    firms = FIRMS[:12]
    mail = [(r.randrange(150), r.choice(firms)[: r.choice([17, 17, 16])] + r.choice(["", "s"]), r.choice(roles)) for _ in range(200)] + [(900, None, ""), (901, "", "")]
    apps = [(r.choice([r.randrange(40), None]), r.choice([*firms, None, ""]), r.choice(roles)) for _ in range(45)]
    schema = "id long, company_key string, role_key string"
    found = matching.match_applications(spark.createDataFrame(mail, schema), spark.createDataFrame(apps, schema), 0.9)
    assert found.columns == ["id", "app_id", "fit"]
    got = [tuple(x) for x in found.select("id", "app_id", F.col("fit").cast("int")).collect()]
    want = plain_match(mail, apps, 0.9)
    assert sorted(got) == sorted(want) and len({w[2] for w in want}) == 4


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_keys_are_not_broadcast(spark, capsys, least):
    """Keys are many times the strings, so that a small table of strings may be a large one of keys."""
    names = spark.createDataFrame([(f,) for f in FIRMS[:20]], "k string")
    matching.fuzzy_companies(names.toDF("m"), "m", names, "k", least).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [key#" in plan and "BroadcastHashJoin [key#" not in plan

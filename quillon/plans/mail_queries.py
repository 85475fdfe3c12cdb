"""Mail: classification, companies, roles, senders and form labels, over the driver's tables.

The mail of the queries is made of table rows and templates. What must come out stands beside each template, so that the
SQL knows nothing of the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.forms import field_of
from quillon.functions.roles import role_from
from quillon.functions.senders import employer
from quillon.functions.shown import role_key
from quillon.operators import classify as C
from quillon.operators import names as N
from quillon.operators import tracking as K
from quillon.plans.registry import query
from quillon.session import table


def _lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows, *columns: str) -> str:
    told = lambda x: _lit(x) if x is None or isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, row)) + ')' for row in rows)}) AS v({', '.join(columns)}))"


#: sender, subject, body, and the rule that decides: its number, category and confidence.
_MAIL = (
    ("jane@acme.com", "Your application", "We regret to inform you that the role went to another.", 0, "rejection", 0.90),
    ("jane@acme.com", "Update", "If you were not selected for this one, do apply again.", 15, "outreach", 0.50),
    ("jane@acme.com", "Update", "Unfortunately, after much thought, we chose other candidates.", 1, "rejection", 0.85),
    ("jobs@acme.com", "Good news", "We are pleased to offer you a place.", 2, "offer", 0.85),
    ("jobs@acme.com", "Next", "We&#39;d like to interview you on Monday.", 3, "interview", 0.80),
    ("jobs@acme.com", "Next", "If your skills match, we will schedule some time. Until then, all the best.", 15, "outreach", 0.50),
    ("no-reply@tests.example", "Online assessment", "Please take the online assessment by Friday.", 4, "oa", 0.80),
    ("no-reply@tests.example", "Campus day", "Learn about our assessments and bring a laptop to the online assessment corner.", -1, "disregarded", 0.60),
    ("no-reply@codesignal.example", "Ready", "Your coding test is waiting.", 5, "oa", 0.75),
    ("no-reply@tests.example", "Ready", "The HackerRank challenge is waiting.", 5, "oa", 0.75),
    ("no-reply@tests.example", "Verify your account", "Your HackerRank account needs a new password.", -1, "disregarded", 0.60),
    ("no-reply@tests.example", "Next", "As a next step there is an assessment for you.", 6, "oa", 0.70),
    ("no-reply@tests.example", "Next", "If selected, the next step is an assessment.", -1, "disregarded", 0.60),
    ("jobs@globex.com", "Time", "Pick a time for the final round.", 7, "interview", 0.75),
    ("no-reply@id.example", "Your verification code", "It is 4711.", 8, "disregarded", 0.70),
    ("no-reply@id.example", "Verification code for Software Intern", "It is 4711.", -1, "disregarded", 0.60),
    ("hr@globex.com", "Profile", "Please complete the form within the next 4 days. Your application waits.", 9, "oa", 0.65),
    ("hr@globex.com", "Profile", "We respond within 5 business days.", 15, "outreach", 0.50),
    ("hr@globex.com", "Thanks", "Thank you for applying to Globex.", 10, "confirmation", 0.85),
    ("hr@globex.com", "Thanks", "Your application for the post of a junior painter has been received.", 11, "confirmation", 0.80),
    ("hr@globex.com", "Welcome to Globex Careers", "Your account is open.", 12, "confirmation", 0.60),
    ("events@club.example", "RSVP: open day", "See you there.", 13, "disregarded", 0.70),
    ("news@board.example", "For you", "We found jobs near you: top picks for you.", 14, "disregarded", 0.70),
    ("x@msg.greenhouse.io", "Hello", "A note.", 15, "outreach", 0.50),
    ("sam@people.example", "Hello", "I work at Acme Rockets and saw your site.", 15, "outreach", 0.50),
    ("sam@people.example", "Hello", "Our acme is a good one.", -1, "disregarded", 0.60),
    ("noreply@acme.com", "Hello", "A candidate portal is open.", 16, "outreach", 0.45),
    ("noreply@shop.example", "Sale", "Everything must go.", -1, "disregarded", 0.60),
    (None, None, None, -1, "disregarded", 0.60),
)
_KNOWN = ("acme", "globex", "acme rockets", "reply", "no")


@query(f"""WITH m AS {_values([(i, *x[3:]) for i, x in enumerate(_MAIL)], "kind", "rule", "category", "confidence")}
SELECT conv_id, turn, CAST(rule AS INTEGER) AS rule, category, CAST(confidence AS DOUBLE) AS confidence FROM conversations JOIN m ON (conv_id * 7 + turn) % {len(_MAIL)} = kind""")
def cl1_classify(spark, sf):
    """A message of each template behind the text of each turn."""
    kinds = F.array(*[F.struct(*(F.lit(x).cast("string").alias(c) for x, c in zip(m, ("sender", "subject", "body")))) for m in _MAIL])
    kind = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_MAIL))).cast("int")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.get(kinds, kind).alias("m"))
    rows = rows.select("conv_id", "turn", C.mail(F.col("m.sender"), F.col("m.subject"), F.concat_ws(". ", "text", "m.body")).alias("mail"))
    known = N.Finder(spark, spark.createDataFrame([(n,) for n in _KNOWN], "name string"))
    rows = rows.withColumn("found", known.found(F.col("mail.sender"), F.col("mail.headline"), F.col("mail.text")))
    return rows.select("conv_id", "turn", C.classify(F.col("mail"), N.named_in(F.col("found"))).alias("c")).select("conv_id", "turn", "c.rule", "c.category", "c.confidence")


# Each order writes a mail about the house of its customer; names are the houses and the parts' names and words.
_GUESS_SENDER = (
    "CASE o_orderkey % 5 WHEN 1 THEN concat('house', o_custkey, '@mail.example') WHEN 2 THEN 'Reply Team <no-reply@jobs.example>'"
    " WHEN 3 THEN 'Anvil Careers <hr@anvil.example>' WHEN 4 THEN 'Zed Corp <sam@zed.example>' END"
)
_GUESS_SUBJECT = "CASE o_orderkey % 3 WHEN 0 THEN concat('A word from House ', o_custkey) WHEN 1 THEN 'News' END"
_GUESS_BODY = (
    "CASE o_orderkey % 7 WHEN 0 THEN concat('We at Red Ring and house ', o_custkey + 1, ' write') WHEN 1 THEN 'anvil and bolt make things'"
    " WHEN 2 THEN concat('the greenhouse ', o_custkey, 'a has a cold anvils') WHEN 3 THEN 'old gizmo & small ring' WHEN 4 THEN 'reply' END"
)
_NORMAL = r"' ' || trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"
_LONGEST = "arg_min(name, struct_pack(k := -strlen(name), n := name))"


@query(rf"""WITH names AS (SELECT 'house ' || c_custkey AS name FROM customer UNION SELECT lower(p_name) FROM part UNION SELECT split_part(lower(p_name), ' ', 1) FROM part UNION SELECT split_part(lower(p_name), ' ', 2) FROM part UNION SELECT 'reply'),
mail AS (SELECT o_orderkey, {_NORMAL.format(_GUESS_SENDER)} AS sender, {_NORMAL.format(_GUESS_SUBJECT)} AS subject, {_NORMAL.format(_GUESS_SUBJECT)} || {_NORMAL.format(_GUESS_BODY)} AS text FROM orders),
texts AS (SELECT DISTINCT sender, subject, text FROM mail),
hits AS (SELECT sender, subject, text, name, name <> 'reply' AND contains(sender, ' ' || replace(name, ' ', '') || ' ') AS by_sender, contains(subject, ' ' || name || ' ') AS by_subject, contains(text, ' ' || name || ' ') AS by_text FROM texts JOIN names
  ON (name <> 'reply' AND contains(sender, ' ' || replace(name, ' ', '') || ' ')) OR contains(text, ' ' || name || ' ')),
best AS (SELECT sender, subject, text, {_LONGEST} FILTER (by_sender) AS s, {_LONGEST} FILTER (by_subject) AS h, {_LONGEST} FILTER (by_text) AS t, {_LONGEST} FILTER (by_sender OR by_subject) AS head, {_LONGEST} AS anywhere FROM hits GROUP BY 1, 2, 3)
SELECT o_orderkey, coalesce(head, CASE WHEN contains(anywhere, ' ') OR strlen(anywhere) >= 8 THEN anywhere END, CASE WHEN o_orderkey % 5 = 4 THEN 'zed corp' END) AS company_guess,
  CASE WHEN s IS NOT NULL THEN 'sender' WHEN h IS NOT NULL THEN 'subject' WHEN contains(t, ' ') OR strlen(t) >= 8 THEN 'body' END AS named_in
FROM mail LEFT JOIN best USING (sender, subject, text)""")
def tx19_guess(spark, sf):
    part = table(spark, sf, "part").select(F.lower("p_name").alias("name"))
    names = table(spark, sf, "customer").select(F.concat(F.lit("House "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("name")).union(part)
    names = names.union(part.select(F.explode(F.split("name", " ")))).union(spark.createDataFrame([("reply",), ("no",)], "name string"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr(_GUESS_SENDER).alias("sender"), F.expr(_GUESS_SUBJECT).alias("subject"), F.expr(_GUESS_BODY).alias("body"))
    mail = orders.withColumn("mail", C.mail(F.col("sender"), F.col("subject"), F.col("body")))
    mail = N.Finder(spark, names).find(mail, F.col("mail.sender"), F.col("mail.headline"), F.col("mail.text"))
    guess = N.company_guess(F.col("found"), F.col("sender"), F.col("subject"), C.ATS_DOMAINS, C.any_of(C.MACHINE_SENDER))
    return mail.select("o_orderkey", guess.alias("company_guess"), N.named_in(F.col("found")).alias("named_in"))


# Subjects and snippets of each order's mail; {T} is a role, {N} the order's number beyond a hundred thousand.
_SUBJECTS = (
    "Your application for {T} at Acme!", "Thank you for applying to Acme", "Thank you for your interest in Hill Road Trading's {T}", "your interest in Tetra Inc and the {T} role",
    "Your application for our [Summer 2027] {T} position", "Application: R{N} 2027 {T} - Compilers", "applying for the {T}, (Job number: {N}00)", "your application for {T} (Fall 2026) position",
    "your application for {T} (Summer 2", "applying for {T} (Web + Services) Req ID ({N}00)", "Your application for {T} role has been received", "your application for the position of {T} Req #2",
    "Your interest in Two Hills!", "application for Summer &#39;27 {T}", None, "your application for a painter; nothing else",
)
_SNIPPETS = (
    None, "You are applying for position {N} - {T} and we are glad.", "following position: {T}; see below", "No role is named here",
    "Thanks for your interest in the {T} opportunity. More follows.",
)


def _filled(texts: tuple[str | None, ...], key: str) -> str:
    """SQL of the text for a row, the same in both engines."""
    title = "concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), ' Engineering Intern')"
    cases = " ".join(f"WHEN {i} THEN replace(replace({_quoted(t)}, '{{T}}', {title}), '{{N}}', concat(o_orderkey + 100000, ''))" for i, t in enumerate(texts) if t)
    return f"CASE {key} % {len(texts)} {cases} END"


def _quoted(text: str) -> str:
    """A string for both engines: an apostrophe by its code, since each writes it in its own way."""
    return "concat(" + ", chr(39), ".join(f"'{part}'" for part in text.split("'")) + ")"


# Fixed values, in the order in which they are tried.
_MARKERS = _values(list(enumerate((
    "your application for ", "application for ", "applying to the ", "application to the ", "applying to our ", "application: ",
    "following position: ", "position: ", "for the position of ", "interest in the ", "your interest in ", "applying for the ",
    "applying for ",
))), "i", "marker")
_NUMBER = "[A-Za-z]{4,}[0-9][A-Za-z0-9]*|[A-Za-z]{3}[0-9][A-Za-z0-9]+|[A-Za-z]{2}[0-9][A-Za-z0-9]{2,}|[A-Za-z][0-9][A-Za-z0-9]{3,}|[0-9][A-Za-z0-9]{4,}"
_ROLES = rf"""m AS (SELECT o_orderkey, 1 AS nth, {_filled(_SUBJECTS, "o_orderkey")} AS text FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT o_orderkey, 2, {_filled(_SNIPPETS, "o_orderkey")} FROM orders JOIN customer ON o_custkey = c_custkey),
plain AS (SELECT o_orderkey, nth, replace(text, '&#39;', '''') AS text FROM m WHERE text IS NOT NULL),
t0 AS (SELECT o_orderkey, nth, i, marker, rtrim(trim(substr(text, instr(lower(text), marker) + length(marker))), '!.?') AS t FROM plain JOIN {_MARKERS} AS k ON contains(lower(text), marker)),
t1 AS (SELECT * REPLACE (trim(split_part(t, ' at ', 1)) AS t) FROM t0),
t2 AS (SELECT * REPLACE (CASE WHEN contains(t, '''s ') AND len(string_split(split_part(t, '''s ', 1), ' ')) <= 4 AND NOT regexp_matches(split_part(t, '''s ', 1), '[0-9]') THEN ltrim(substr(t, instr(t, '''s ') + 3)) ELSE t END AS t) FROM t1),
t3 AS (SELECT * REPLACE (CASE WHEN contains(marker, 'interest in') AND contains(lower(t), ' and the ') AND len(string_split(split_part(lower(t), ' and the ', 1), ' ')) <= 4 AND NOT contains(split_part(lower(t), ' and the ', 1), 'intern')
  THEN ltrim(substr(t, instr(lower(t), ' and the ') + 9)) ELSE t END AS t) FROM t2),
t4 AS (SELECT * REPLACE (regexp_replace(t, '^(?:the |The |our |Our |a |an |[Ff]ollowing position: |following role: |[Pp]osition: |role of |[Pp]osition of |[Pp]osition |[\[\]\-: ]|(?:{_NUMBER}) )+', '') AS t) FROM t3),
t5 AS (SELECT * REPLACE (regexp_extract(t, '^[^.!?;]*[.!?;]?') AS t) FROM t4),
t6 AS (SELECT * REPLACE (regexp_replace(t, '(?i)( and are | and we | and you | what happens| has been | and it is | is being | position with | role with | role here).*$', '') AS t) FROM t5),
t7 AS (SELECT * REPLACE (CASE WHEN regexp_matches(regexp_extract(t, '\(([^(]*)\)[^()]*$', 1), '[0-9]{{5}}') AND length(regexp_extract(t, '\(([^(]*)\)[^()]*$', 1)) <= 30 THEN rtrim(regexp_replace(t, '\([^(]*\)[^()]*$', '')) ELSE t END AS t) FROM t6),
t8 AS (SELECT * REPLACE (rtrim(regexp_replace(t, '[(\[][^()\[\]]*$', '')) AS t) FROM t7),
t9 AS (SELECT * REPLACE (rtrim(regexp_replace(t, '(?i)( +(req|id|#[0-9]*)[,.:]*)+$', ''), '.!?;, ') AS t) FROM t8),
t10 AS (SELECT * REPLACE (trim(regexp_replace(t, '(role|Role|position|Position|job|Job|opportunity|[.!,\] ])+$', '')) AS t) FROM t9),
roles AS (SELECT o_orderkey, arg_min(t, nth * 100 + i) AS role FROM t10 WHERE strlen(t) BETWEEN 4 AND 120 AND contains(lower(t), 'intern') GROUP BY 1)"""


def _role_mail(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", *(F.expr(_filled(t, "o_orderkey")).alias(c) for t, c in ((_SUBJECTS, "subject"), (_SNIPPETS, "snippet"))))


@query(f"WITH {_ROLES} SELECT o_orderkey, role FROM orders LEFT JOIN roles USING (o_orderkey)")
def tx16_roles(spark, sf):
    return _role_mail(spark, sf).select("o_orderkey", role_from(F.col("subject"), F.col("snippet")).alias("role"))


_IMPLIED = ("applied", "oa", None, "interview", "offer", "rejected")
_RANK = "CASE implied WHEN 'applied' THEN 0 WHEN 'oa' THEN 1 WHEN 'interview' THEN 2 WHEN 'offer' THEN 3 END"


@query(rf"""WITH {_ROLES}, mail AS (SELECT o_orderkey AS id, 'house ' || (o_custkey % 50) AS company_key, trim(regexp_replace(lower(coalesce(role, '')), '[^a-z0-9]+', ' ', 'g')) AS role_key, o_orderdate AS stamp,
  CASE o_orderkey % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'oa' WHEN 3 THEN 'interview' WHEN 4 THEN 'offer' WHEN 5 THEN 'rejected' END AS implied FROM orders LEFT JOIN roles USING (o_orderkey)),
best AS (SELECT company_key, role_key, arg_max(implied, struct_pack(a := {_RANK}, b := stamp, c := id)) AS implied, min(stamp) AS first_at, count(*) AS n_mails FROM mail WHERE implied IN ('applied', 'oa', 'interview', 'offer') GROUP BY 1, 2),
asked AS (SELECT DISTINCT 'house ' || (s_suppkey % 50) AS company_key, '' AS role_key FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 'house ' || (s_suppkey % 50), 'automobile engineering intern' FROM supplier WHERE s_suppkey % 5 = 0),
fresh AS (SELECT best.* FROM best ANTI JOIN asked USING (company_key, role_key))
SELECT company_key, role_key, implied, first_at, n_mails FROM fresh f WHERE role_key <> '' OR NOT EXISTS (SELECT 1 FROM fresh g WHERE g.company_key = f.company_key AND g.role_key <> '')""")
def cl10_from_mail(spark, sf):
    """Proposals of applications whose roles are read out of the mail."""
    implied = F.get(F.array(*map(F.lit, _IMPLIED)), (F.col("o_orderkey") % 6).cast("int"))
    mail = _role_mail(spark, sf).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("house "), (F.col("o_custkey") % 50).cast("string")).alias("company_key"),
        role_key(role_from(F.col("subject"), F.col("snippet"))).alias("role_key"), F.col("o_orderdate").alias("at"), implied.alias("implied"),
    )
    house = F.concat(F.lit("house "), (F.col("s_suppkey") % 50).cast("string")).alias("company_key")
    suppliers = table(spark, sf, "supplier")
    asked = suppliers.filter("s_suppkey % 4 = 0").select(house, F.lit("").alias("role_key")).union(suppliers.filter("s_suppkey % 5 = 0").select(house, F.lit("automobile engineering intern")))
    return K.untracked(mail, asked).withColumnRenamed("at", "first_at")


#: A form's labels and the field that each asks for.
_LABELS = (
    ("First Name", "first_name"), ("firstName", "skip"), ("Email (required)", "email"), ("Name", "full_name"), ("Company name", "skip"), ("Emergency contact phone", "skip"),
    ("Driver's License", "blocked"), ("passportNumber", "blocked"), ("What is your major?", "major"), ("Describe a major challenge", "skip"), ("How did you hear about us? LinkedIn, Indeed", "skip"),
    ("LinkedIn Profile URL", "linkedin_url"), ("Phone number", "phone"), ("Mobile", "phone"), ("Mobile development experience", "skip"), ("Expected graduation date", "graduation_date"),
    ("Graduation year and month", "graduation_year"), ("Gender", "blocked"), ("City and state", "location"), ("School or university", "school"), ("GPA", "gpa"), ("", "skip"), ("Last employer", "skip"),
    ("Will you require sponsorship now?", "needs_sponsorship"), ("Preferred first name", "preferred_name"), ("cc-number", "blocked"), ("Github username", "github_url"), ("Degree", "degree"),
    ("Your manager's email", "skip"), (None, "skip"), ("Date of birth", "blocked"), ("What is your email or phone number?", "skip"), ("Is visa sponsorship or work status needed?", "needs_sponsorship"),
)


@query(f"WITH k AS {_values(list(enumerate(f for _, f in _LABELS)), 'kind', 'field')} SELECT c_custkey, field FROM customer JOIN k ON c_custkey % {len(_LABELS)} = kind")
def tx20_form_labels(spark, sf):
    """Each customer's form: a label, with a star, a note or nothing behind it."""
    labels = F.array(*[F.lit(x).cast("string") for x, _ in _LABELS])
    key = F.col("c_custkey")
    raw = F.concat(F.get(labels, (key % len(_LABELS)).cast("int")), F.get(F.array(F.lit(""), F.lit(" *"), F.lit(" (Optional)")), (key % 4).cast("int") % 3))
    return table(spark, sf, "customer").select("c_custkey", field_of(raw).alias("field"))


#: sender, subject, and the employer that follows from them; {a} and {b} are a part's words, {A} the first in title case, {i} initials.
_SENDERS = (
    ("{A} Careers <no-reply@{a}.com>", "Hello", "{a}"), ("Sam Doe <sam@{a}.com>", "Hello", "{a}"), ('"{A} University Recruiting" <jobs@mail.{a}.co>', None, "{a}"),
    ("{A} {b} Machines <hr@{i}m.com>", "x", "{a} {b} machines"), ("{A} Hiring Team <noreply@greenhouse.io>", "x", "{a}"),
    ("no-reply@greenhouse.io", "Your application to {A} Corp - Intern", "{a} corp"), ("x@gmail.com", "Application sent to {A}, thanks", "{a}"), ("someone@gmail.com", "Hello", None),
    ("noreply@myworkday.com", "Hello", None), ("{a}@myworkday.com", "Hello", "{a}"), ("{a}.{b}@lever.co", "", "{a} {b}"), (None, None, None), ("HR <hr@xy.z>", "Hi", None),
)


def _worded(place: int) -> str:
    """SQL of a template with a part's words in it, the same in both engines."""
    a, b = "split_part(lower(p_name), ' ', 1)", "split_part(lower(p_name), ' ', 2)"
    words = (("{a}", a), ("{b}", b), ("{A}", f"concat(upper(substr({a}, 1, 1)), substr({a}, 2))"), ("{i}", f"concat(substr({a}, 1, 1), substr({b}, 1, 1))"))
    cases = []
    for i, row in enumerate(_SENDERS):
        if row[place] is not None:
            filled = _lit(row[place])
            for mark, word in words:
                filled = f"replace({filled}, '{mark}', {word})" if mark in row[place] else filled
            cases.append(f"WHEN {i} THEN {filled}")
    return f"CASE p_partkey % {len(_SENDERS)} {' '.join(cases)} END"


@query(f"SELECT p_partkey, {_worded(2)} AS employer FROM part")
def tx18_employer(spark, sf):
    mail = table(spark, sf, "part").select("p_partkey", F.expr(_worded(0)).alias("sender"), F.expr(_worded(1)).alias("subject"))
    return mail.select("p_partkey", employer(F.col("sender"), F.col("subject"), C.ATS_DOMAINS, C.any_of(C.MACHINE_SENDER)).alias("employer"))

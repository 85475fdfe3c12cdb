"""Each numbered operator against a brute-force version on small fixtures with every awkward case."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import bpe, exact_dedup, langid, minhash, mixing, secret_scan, sentence_spans, suffix_dedup, suffix_sort, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _maybe string, key long, spans string"


def docs_of(spark, texts, langs=None, sources=None):
    """Documents with nulls, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], None, "x", 7, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = ". ".join(say(15) for _ in range(5)) + "."
    base = say(120)
    out = [None, "", "   ", "word", say(3), "ñandú é", "a" * 900, base, base, base, say(60) + " " + passage + " " + say(40), say(20) + " " + passage, passage, say(4000)]
    for _ in range(12):
        words = base.split()
        words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [say(r.randint(5, 90)) for _ in range(30)]
    return out


def test_suffix_sort_orders_and_measures():
    r = random.Random(1)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(16, 60))).encode() for _ in range(400)]
    strings += [b"a" * 16 + bytes([r.randrange(3)]) * r.randint(0, 30) for _ in range(200)] + strings[:20]
    order, shared = suffix_sort.deep_shallow_sort(strings, 16)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
    assert [suffix_sort.common_prefix(a, b) for a, b in zip(got, got[1:])] == shared[1:].tolist()


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [512, 2])
def test_suffix_dedup(spark, texts, classes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)  # 2: every anchor is split down
    for length in (200, 40):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removal_report(docs_of(spark, texts), length).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_suffix_dedup_cleaned_text(spark):
    docs = docs_of(spark, ["x" * 250 + "tail", "head" + "x" * 250, "other"])
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.cleaned(docs).collect()}
    assert got == {0: b"tail", 1: b"head", 2: b"other"}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64 * 8)
    r = np.random.default_rng(3)
    vectors = r.normal(0, 0.2, (500, 8))
    vectors[::3] = vectors[0]  # a third of the rows are one vector
    rows = [(i, v.astype(float).tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (600, [1.0, None] * 4, 1), (601, [float("nan")] * 8, 1), (700, [float("inf")] * 8, 1), (800, [], 1), (900, [0.5] * 3, 1)]
    rows += [(100, rows[7][1], 1), (100, rows[7][1], 1), (None, [1.0] * 8, 1)]  # a repeated id: each row is a query and a candidate
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.Counter(tuple(x) for x in topk.nearest(frame, 10).collect())
    codes = [(i, np.floor(1024 * np.array((list(v) + [0.0] * 8)[:8])).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.Counter()
    for n, (q, code) in enumerate(codes):
        if q % 100 == 0:
            best = sorted((-int(code @ c), i) for m, (i, c) in enumerate(codes) if m != n)[:10]
            want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    assert got == want


def test_exact_dedup(spark, texts):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs_of(spark, texts)).collect()}
    same = collections.defaultdict(list)
    for i, t in enumerate(texts):
        same[t or ""].append(i)
    for i, t in enumerate(texts):
        own = same[t or ""]
        assert got[i] == (max(own), len(own), i == max(own), hashlib.sha256((t or "").encode()).hexdigest())


def test_mixing_targets_and_takes(spark):
    r = random.Random(2)
    sources = [r.choice(["a", "b", "c", "d", None]) for _ in range(900)]
    texts = ["w " * (r.randint(0, 40) if s != "b" else 1) for s in sources]
    texts[3] = None
    rows = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    assert len(rows) == 900 and all(row.taken <= 3 * row.size for row in rows)
    by = collections.defaultdict(list)
    for row in rows:
        by[sources[row.doc_id]].append(row)
    names = sorted(x for x in by if x is not None) + [None]
    size = {s: sum(x.size for x in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held = set()
    while True:
        free = sum(size.values()) - sum(3 * size[s] for s in held)
        level = free / sum(weight[s] for s in names if s not in held)
        more = {s for s in names if s not in held and weight[s] * level > 3 * size[s]}
        if not more:
            break
        held |= more
    for s in names:
        target = 3 * size[s] if s in held else weight[s] * level
        assert by[s][0].target == pytest.approx(target) and by[s][0].source_size == size[s]
        assert abs(sum(x.taken for x in by[s]) - target) <= 0.03 * target + 200
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs_of(spark, texts, sources=sources)).collect()))  # no null sorts: rows are complete but for source


def test_mixing_gives_a_tiny_source_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)  # slots of about 400 words, as a large mix has
    r = random.Random(9)
    sources = ["a"] * 300 + ["b"] * 300 + ["tiny"] * 4 + ["word"] + ["z"] * 20 + [None] * 2
    texts = ["w " * (r.randint(20, 60) if s in ("a", "b") else r.randint(1, 9) if s else 40) for s in sources]
    texts[604] = "w"
    rows = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    taken = collections.Counter()
    for row in rows:
        assert row.taken <= 3 * row.size
        taken[row.source] += row.taken
    target = {row.source: row.target for row in rows}
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())
    assert target["word"] == 3 and target["tiny"] > 3
    kept = mixing.mixed(docs_of(spark, texts, sources=sources)).groupBy("source").count().collect()
    assert {x.source for x in kept} == set(sources)
    slots = mixing.plan(docs_of(spark, texts, sources=sources))[2]
    assert all(x.words > 0 and 0 <= x["pass"] < 3 for x in slots.collect())


def plain_mix(rows, targets, order):
    """Words taken of each row: a source's rows in their order, pass after pass, up to its target."""
    taken = collections.Counter()
    for source, target in targets.items():
        left = round(target)
        own = sorted((i for i, r in enumerate(rows) if r[2] == source and r[3]), key=lambda i: order[i])
        for _ in range(3):
            for i in own:
                words = min(left, rows[i][3])
                taken[i] += words
                left -= words
    return taken


def test_mixing_takes_what_a_plain_stream_takes_and_reruns_agree(spark):
    r = random.Random(4)
    rows = [(r.choice([None, None, i, 7]), " ".join(f"w{r.randrange(9)}" for _ in range(r.randint(0, 30))), r.choice(["a", "b", "c", None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda x: (x.doc_id, x.source, x.size, x.taken)
    one = mixing.mix(frame).collect()
    for other in (frame.repartition(7), frame.orderBy("text").coalesce(1), spark.createDataFrame(rows[::-1], frame.schema)):
        assert collections.Counter(map(key, mixing.mix(other).collect())) == collections.Counter(map(key, one))
    sized = [(i, t, s, len(t.split())) for i, t, s in rows]
    target = {x.source: x.target for x in one}
    hashes = spark.createDataFrame([(n, i, t) for n, (i, t, _, _) in enumerate(sized)], "n int, doc_id long, text string")
    order = {x.n: (x.o >> 40 & 255, x.o, x.doc_id is not None, x.doc_id or 0, x.t) for x in hashes.selectExpr("n", "doc_id", "xxhash64(doc_id, text, 'shuffle') o", "xxhash64(text) t").collect()}
    taken = plain_mix(sized, target, order)
    want = collections.Counter((i, s, n, taken[m]) for m, (i, _, s, n) in enumerate(sized))
    assert collections.Counter(map(key, one)) == want and any(r.taken > r.size for r in one)


def test_language_id(spark):
    r = random.Random(4)
    words = {"en": ["the", "house", "with", "shing"], "fr": ["les", "maison", "avec", "eaux"], "es": ["del", "casa", "ciones", "muy"]}
    langs = [r.choice(list(words)) for _ in range(300)]
    texts = [" ".join(r.choice(words[x]) for _ in range(12)) for x in langs]
    texts[:4] = [None, "", "123 !!", texts[3]]
    rows = langid.identify(docs_of(spark, texts, langs=langs)).collect()
    assert all(row.lang_pred == "und" and row.score == 0 for row in rows if row.doc_id < 3)
    held = [row for row in rows if row.held_out and row.doc_id > 3]
    assert held and sum(row.lang_pred == langs[row.doc_id] for row in held) / len(held) > 0.95
    assert all(0 <= row.score <= 1 for row in rows)


def test_secret_scan(spark):
    key = "q8Zr2LxV0pTn5KcW7yHb3MdJ"
    texts = [None, "", "password = hunter22 and token: 'abcdef1'", "AKIA" + "Z9" * 10, "hash deadbeefdeadbeefdeadbeef end", f"ñ {key} x", "abcabcabcabcabcabcabcabc1 repeated", "PASSWORD:short secret=12345"]
    got = {r.doc_id: r for r in secret_scan.report(secret_scan.find_secrets(docs_of(spark, texts))).collect()}
    assert (got[2].n_assign, got[3].n_access, got[4].n_hex) == (2, 1, 1) and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans.startswith("hex:5:29") and "random:2:26" in got[5].spans and got[7].n_assign == 0
    assert got[5].n_assign + got[5].n_hex == 0


def test_secret_scan_assignments_urls_and_letters(spark):
    key, letters = "q8Zr2LxV0pTn5KcW7yHb3MdJ", "nZQfrVKexUcJTTwgLmsXBhOa"
    texts = [f"AWS_KEY={key}", f"https://x.org/a?sig={key}&v=1", f"see {letters} here", f"K={key}==", f"{key}{'0a1b2c3d' * 3} end", f"-{'deadbeef' * 3}/{key}", "a=b=c= " + "=" * 30]
    got = {r.doc_id: r for r in secret_scan.report(secret_scan.find_secrets(docs_of(spark, texts))).collect()}
    assert [got[i].spans for i in range(4)] == ["random:8:32", "random:20:44", "random:4:28", "random:2:28"]
    assert got[4].n_hex == 1 and got[4].n_random == 1 and got[5].n_hex == 1 and got[5].spans.endswith(",random:25:50") and got[6].spans == ""
    # long words, paths and names stay structured beside keys
    prose = ["internationalization/of/the/configuration", "getUserNameFromTheRequestContextOfTheSession", "well-known-phrases-in-the-text-of-the-page"] * 10
    rows = secret_scan.report(secret_scan.find_secrets(docs_of(spark, [*prose, f"KEY={key}"]))).collect()
    assert {r.doc_id for r in rows if r.n_random} == {len(prose)}


def shingles(text, k):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(spark, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, texts), k).collect()}
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in enumerate(sets)}


def test_toxicity(spark):
    r = random.Random(6)
    clean, bad = ["tree", "river", "stone", "cloud", "paper"], ["vilebad", "nastiest"]
    toxic = [r.random() < 0.2 for _ in range(500)]
    texts = [" ".join(r.choices(clean, k=20) + (r.choices(bad, k=3) if x else [])) for x in toxic]
    texts[0], toxic[0] = None, False
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic) if i % 2] + [(None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in toxicity.classify(docs_of(spark, texts), labels).collect()}
    assert len(rows) == 500 and not rows[0].toxic
    assert sum(rows[i].toxic == toxic[i] for i in range(500)) > 490
    left = {x.doc_id for x in toxicity.survivors(docs_of(spark, texts), labels).collect()}
    assert left == {i for i in rows if not rows[i].toxic}


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    rows = [(i % 10, f"alpha beta gamma {i}") for i in range(400)] + [(3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(10)], "doc_id long, quality int, toxic boolean")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, y, names, fold: seen.append(len(y)) or toxicity.Chain(names, [], 1.0))
    toxicity.train(docs, labels, sample=4, categories={"low_quality": "1 - quality", "toxic": "cast(toxic as int)"})
    toxicity.train(docs, labels, categories={"low_quality": "1 - quality", "toxic": "cast(toxic as int)"})
    assert seen == [4, 10]


def test_sentence_spans(spark):
    shared = "Here is one whole sentence of some length. And there follows another one right after it! Does a third come too?"
    texts = [None, "", "Only one.", f"Alpha beta. {shared} Omega.", f"{shared} Gamma delta.", f"{shared} {shared}", "No stops here at all\nnor here"]
    got = {r.doc_id: r for r in sentence_spans.dedup(docs_of(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(7)] == [0, 0, 0, 0, 3, 6, 0]
    assert got[4].kept_text == "Gamma delta." and got[5].kept_text == "" and got[3].kept_text == texts[3] and got[6].n_sentences == 2


def test_sentence_spans_without_ids_and_of_short_sentences(spark):
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = say(25)
    rows = [(i, f"{say(9)} {passage} {say(9)}") for i in (None, None, None, 5, 5)]
    rows += [(9, "Yes. No. Maybe so. " + say(5)), (10, say(5) + ". Yes. No. Maybe so."), (11, "Yes. No. " + say(7))]
    got = sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.n_removed > 0 for g in got if g.doc_id is None) == [True] * 3
    assert sorted(g.n_removed > 0 for g in got if g.doc_id == 5) == [False, True]
    assert {g.doc_id: g.n_removed for g in got if g.doc_id and g.doc_id > 5} == {9: 0, 10: 3, 11: 0}


def test_sentence_spans_in_mid_sentence(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passages = [say(50) for _ in range(30)] + [", ".join(say(10) for _ in range(5)) + ". " + say(3) for _ in range(5)]
    texts = [f"{say(r.randint(1, 25))} {p} {say(r.randint(1, 25))}" for p in passages for _ in range(2)]
    blankless = [han(50) for _ in range(10)]
    texts += [han(r.randint(1, 25)) + p + han(r.randint(1, 25)) for p in blankless for _ in range(2)]
    got = {x.doc_id: x for x in sentence_spans.dedup(docs_of(spark, texts)).collect()}
    for i, p in enumerate(passages + blankless):
        assert got[2 * i].n_removed == 0 and got[2 * i].kept_text == texts[2 * i]
        text, kept = texts[2 * i + 1], got[2 * i + 1].kept_text
        gone = len(text.split()) - len(kept.split()) if i < len(passages) else len(text) - len(kept)
        head, tail = text.split(p)
        assert 20 <= gone <= 53 and kept.startswith(head) and kept.endswith(tail)


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    texts = [*texts, "x" * 5000, "Mixed CASE, don't <|endoftext|> stop now 　 日本語のテキスト😀 12,345", "tab\tand\nnew\r\nline"]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), text
    assert {r.doc_id: len(r.ids or []) for r in bpe.encode(docs_of(spark, texts)).collect()} == {i: g[0] for i, g in got.items()}


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for frame in (
        suffix_dedup.removal_report(docs), topk.nearest(vectors), exact_dedup.exact_dedup(docs), mixing.mix(docs), langid.identify(docs), secret_scan.report(secret_scan.find_secrets(docs)),
        minhash.near_duplicates(docs), toxicity.classify(docs, labels), sentence_spans.dedup(docs), bpe.digests(docs),
    ):
        assert frame.count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text, None, None, None, None, None, None), (1, text, None, None, None, None, None, None), (1, text, None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (suffix_dedup.removal_report, exact_dedup.exact_dedup, mixing.mix, langid.identify, lambda d: secret_scan.report(secret_scan.find_secrets(d)), minhash.near_duplicates, lambda d: toxicity.classify(d, labels), sentence_spans.dedup, bpe.digests):
        assert f(docs).count() == 4
    assert {r.n_removed for r in suffix_dedup.removal_report(docs).filter("doc_id = 1").collect()} == {len(text)}

"""The pipeline's stages under awkward rows, and operators without SQL against plain brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import bpe, exact_dedup, langid, minhash, mixing, secret_scan, sentence_spans, squares, topk, toxicity

#: Extra columns named as the operators name their own.
EXTRA = ["_s", "_times", "_copy", "_row", "_maybe", "row", "score", "copy", "times", "key", "cid", "size", "text_sha256"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in EXTRA)


def rows_of(spark, rows):
    """Documents of (doc_id, text, source), each with its place in every extra column."""
    return spark.createDataFrame([(*r, *[i] * len(EXTRA)) for i, r in enumerate(rows)], SCHEMA)


def words(r, n):
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def test_exact_survivors(spark):
    rows = [(5, "A", "x"), (5, "B", "x"), (9, "B", None), (None, "C", "x"), (None, "C", "x"), (7, "Q", "x"), (7, "Q", "x"), (3, "", "x"), (1, None, "x"), (None, "B", "x")]
    frame = rows_of(spark, rows)
    out = exact_dedup.survivors(frame)
    assert out.columns == frame.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert got == [(-1, "C"), (3, ""), (5, "A"), (7, "Q"), (9, "B")]
    assert all(r._s == r.cid == r.size and rows[r._s][:2] == (r.doc_id, r.text) for r in out.collect())
    # A filter that is full lets all rows pass and changes nothing.
    many = rows_of(spark, [(i, f"t{i % 300}", "x") for i in range(900)])
    assert {r.doc_id for r in exact_dedup.survivors(many, max_blocks=1).collect()} == set(range(600, 900))


def test_near_survivors_and_links_under_repeated_ids(spark):
    r = random.Random(1)
    x, y = words(r, 100), words(r, 100)
    rows = [(5, x, "a"), (5, y, "a"), (7, y + " more", "a"), (8, x + " more", "a"), (None, x, "a"), (None, "", "a"), (None, None, "a"), (3, "", "a"), (9, words(r, 50), "a"), (None, words(r, 30), None)]
    rows.append(rows[8])
    frame = rows_of(spark, rows)
    got = sorted((q.doc_id or -1, q.n_shingles, q.component_id or -1, q.kept) for q in minhash.near_duplicates(frame).collect())
    assert got == sorted([(5, 96, 5, True), (5, 96, 5, True), (7, 97, 5, False), (8, 97, 5, False), (-1, 96, 5, False), (-1, 0, -1, True), (-1, 0, -1, True), (3, 0, 3, True), (9, 46, 9, True), (9, 46, 9, True), (-1, 26, -1, True)])
    out = minhash.survivors(frame)
    assert out.columns == frame.columns
    left = out.collect()
    assert sorted((q.doc_id or -1, q.text or "") for q in left) == sorted([(5, x), (5, y), (-1, ""), (-1, ""), (3, ""), (9, rows[8][1]), (-1, rows[9][1])])
    assert all(rows[q._row][:2] == (q.doc_id, q.text) for q in left)


def components(sets, percent=80):
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def shingles(text, k):
    found = [w for w in (text or "").lower().split() if w]
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def test_near_duplicates_in_a_chain_and_in_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(squares, "SMALL", 8)  # many squares
    r = random.Random(3)
    base = words(r, 60).split()
    chain = [" ".join(base)]
    for _ in range(80):  # neighbours share about a half, which ties them and links none; some share more
        base = base[r.choice((1, 4, 15)) :]
        base += words(r, 60 - len(base)).split()
        chain.append(" ".join(base))
    hot = words(r, 200).split()
    # One family of texts at about 0.7 to 0.9 of each other: frequent band keys, few links.
    family = [" ".join(w if r.random() > 0.03 else f"z{r.randrange(99)}" for w in hot) for _ in range(60)]
    texts = chain + family
    r.shuffle(texts)
    want = components([shingles(t, 5) for t in texts])
    got = {q.doc_id: q.component_id for q in minhash.near_duplicates(rows_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < len(texts)


def test_a_pair_counts_under_its_first_shared_band():
    import pyarrow as pa

    bands = np.arange(3 * minhash.BANDS).reshape(3, -1)
    bands[1, 4:] = bands[0, 4:]
    bands[2, 9:] = bands[0, 9:]
    columns = {"cid": [0, 1, 2], "component": [0, 1, 2], "n_shingles": [10, 10, 10], "side": [0, 0, 0], **{f"s{i}": [0, 0, 0] for i in range(4)}, "bands": bands.tolist()}
    pairs = lambda key: minhash.Square(pa.table({"key": [int(key)] * 3, **columns})).promising(0, 3, 80, 10)[1:].T.tolist()
    assert pairs(bands[0, 4]) == [[0, 1]] and pairs(bands[0, 9]) == [[0, 2], [1, 2]] and pairs(bands[0, 20]) == []


def test_mixed_keeps_rows_whole(spark):
    rows = [(None, "w " * 30, "a"), (None, "w " * 30, "a"), (4, "v " * 20, "a"), (4, "u " * 25, "a"), (None, "t " * 9, None), (5, None, "a"), (6, "", "b"), (7, "s " * 400, "b")]
    frame = rows_of(spark, rows)
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    copies = collections.Counter(r._times for r in out.collect())
    assert all(rows[r._copy][:2] == (r.doc_id, r.text) for r in out.collect())
    taken = {}
    schedule = mixing.plan(frame.select("doc_id", "text", "source", "_row"))[2].collect()
    for piece in schedule:
        taken.setdefault(piece["_row"], set()).add(piece["pass"])
    assert copies == {i: len(p) for i, p in taken.items()} and set(range(5)) <= set(copies) and 5 not in copies and 6 not in copies and max(copies.values()) <= 3


def test_toxicity_survivors(spark):
    rows = [(i, t, "a") for i, t in enumerate([None, "", "  ", "12 !!", "fine words here"] + ["vile nasty"] * 5)]
    labels = spark.createDataFrame([(i, 0, int(i not in (2, 4))) for i in range(10)], "doc_id long, quality int, toxic int")
    frame = rows_of(spark, rows)
    judged = {r.doc_id: r.toxic for r in toxicity.classify(frame, labels).collect()}
    assert not any(judged[i] for i in range(4)) and judged[9]
    out = toxicity.survivors(frame, labels)
    assert out.columns == frame.columns
    assert {r.doc_id: r._s for r in out.collect()} == {i: i for i in judged if not judged[i]}


def test_stages_on_empty_tables(spark):
    empty = rows_of(spark, [(1, "x", "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.survivors(empty), minhash.survivors(empty), mixing.mixed(empty), toxicity.survivors(empty, labels)):
        assert out.columns == empty.columns and out.count() == 0


def test_top_k_with_components_beyond_64_bits(spark):
    vectors = [[1e300, -1e300], [1e300, 0.0], [-2.5e15, 1e15], [0.25, 0.5], [1e15, 1.0]]
    frame = spark.createDataFrame([(100 * i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    hold = lambda x, bits: max(-(2**bits), min(2**bits - 1, x))
    codes = [[hold(math.floor(1024 * x), 63) for x in v] for v in vectors]
    got = collections.defaultdict(list)
    for q, rank, v, s in topk.nearest(frame, 3).collect():
        got[q].append((rank, v, s))
    for i, q in enumerate(codes):
        want = sorted((-sum(a * b for a, b in zip(q, c)), 100 * j) for j, c in enumerate(codes) if j != i)[:3]
        assert sorted(got[100 * i]) == [(n + 1, v, hold(-s, 63)) for n, (s, v) in enumerate(want)]


def gram_buckets(text):
    padded = [0, *map(ord, text.lower()), 0]
    for k in langid.ORDERS:
        for i in range(len(padded) - k + 1):
            gram = padded[i : i + k]
            if k == 1 and gram == [0] or any(a == b == 0 for a, b in zip(gram, gram[1:])):
                continue
            h = 2166136261 + k
            for c in gram:
                h = ((h ^ c) * 2654435761) % 2**32
                h ^= h >> 15
            yield h % (langid.BUCKETS - 1) + 1


@pytest.mark.parametrize("at_once", [128, 2])
def test_language_id_against_plain_naive_bayes(spark, at_once, monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", at_once)  # 2: three slices of languages
    r = random.Random(4)
    names = ["de", "en", "fr", "it", "pl"]
    letters = {x: "".join(r.sample("abcdefghijklmnopqrstuvwxyzäößé", 12)) for x in names}
    langs = [r.choice(names) for _ in range(60)]
    texts = ["".join(r.choice(letters[x] + " ") for _ in range(r.randint(3, 60))) for x in langs]
    texts[:4], langs[4] = [None, "", "1 2!", "ñ"], None
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    train = [(t, x) for i, (t, x) in enumerate(zip(texts, langs)) if i % 3 and t is not None and x is not None]
    counts, rows = {x: collections.Counter() for x in names}, collections.Counter()
    for t, x in train:
        counts[x].update(gram_buckets(t))
        rows[x] += 1
    got = {q.doc_id: q for q in langid.identify(frame, held_out="doc_id % 3 = 0").collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = {x: math.log(rows[x] / len(train)) for x in names}
        for x in names:
            whole = sum(counts[x].values()) + 0.5 * (langid.BUCKETS - 1)
            total[x] += sum(math.log((counts[x][b] + 0.5) / whole) for b in gram_buckets(t))
        best = max(names, key=lambda x: total[x])
        mass = sum(math.exp(total[x] - total[best]) for x in names)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / mass, rel=1e-3)


def test_toxicity_chain_against_plain_loops(spark):
    r = random.Random(11)
    vocabulary = [f"{a}{b}ord" for a in "bcdfgh" for b in "aeiou"]
    flags = [(r.random() < 0.4, r.random() < 0.3) for _ in range(120)]
    texts = [" ".join(r.choices(vocabulary, k=12) + ["lowly"] * (q and r.random() < 0.8) + ["vile"] * (t and r.random() < 0.9)) for q, t in flags]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - int(q), int(t)) for i, (q, t) in enumerate(flags)], "doc_id long, quality int, toxic int")
    folds = {x.doc_id: x.fold for x in frame.selectExpr("doc_id", f"cast(pmod(xxhash64(doc_id), {toxicity.FOLDS}) as int) AS fold").collect()}
    features = [set(toxicity.text_features(t, {}).tolist()) for t in texts]
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))

    def fit(rows, y, earlier):
        n, pos = len(rows), sum(y)
        base = min(max(pos / n, 1e-4), 1 - 1e-4)
        ratio = {}
        for f in sorted(set().union(*(features[i] for i in rows))):
            count = sum(f in features[i] for i in rows)
            hits = sum(v for i, v in zip(rows, y) if f in features[i])
            z = (hits - count * base) / math.sqrt(max(count * base * (1 - base), 1e-9))
            if count >= toxicity.LEAST_ROWS and abs(z) >= toxicity.LEAST_Z:
                s = toxicity.SMOOTHING
                ratio[f] = math.log((hits + s * base) / pos / ((count - hits + s * (1 - base)) / (n - pos)))
        w, e, b = dict.fromkeys(ratio, 0.0), [0.0] * len(earlier[0]), math.log(base / (1 - base))
        gw, ge, gb = dict.fromkeys(ratio, 1e-8), [1e-8] * len(e), 1e-8
        for _ in range(150):
            error = [(sigmoid(sum(w[f] * ratio[f] for f in features[i] & ratio.keys()) + sum(a * x for a, x in zip(earlier[i], e)) + b) - v) / n for i, v in zip(rows, y)]
            for f in w:
                d = sum(x for i, x in zip(rows, error) if f in features[i]) * ratio[f] + 1e-3 * w[f] / n
                gw[f] += d * d
                w[f] -= 0.1 * d / math.sqrt(gw[f])
            for c in range(len(e)):
                d = sum(x * earlier[i][c] for i, x in zip(rows, error))
                ge[c] += d * d
                e[c] -= 0.1 * d / math.sqrt(ge[c])
            d = sum(error)
            gb += d * d
            b -= 0.1 * d / math.sqrt(gb)
        return lambda i, before: sigmoid(sum(w[f] * ratio[f] for f in features[i] & ratio.keys()) + sum(a * x for a, x in zip(before, e)) + b)

    earlier, want = [[] for _ in texts], [[] for _ in texts]
    for c in range(2):
        y = [int(q[c]) for q in flags]
        out = [0.0] * len(texts)
        for k in range(toxicity.FOLDS):
            inside = [i for i in range(len(texts)) if folds[i] != k]
            model = fit(inside, [y[i] for i in inside], earlier)
            for i in range(len(texts)):
                if folds[i] == k:
                    out[i] = model(i, earlier[i])
        model = fit(list(range(len(texts))), y, earlier)
        probability = [model(i, want[i]) for i in range(len(texts))]
        earlier = [[*x, o] for x, o in zip(earlier, out)]
        want = [[*x, p] for x, p in zip(want, probability)]
    got = {q.doc_id: q for q in toxicity.classify(frame, labels).collect()}
    for i, (low, toxic) in enumerate(want):
        assert got[i].p_low_quality == pytest.approx(low, abs=2e-3) and got[i].p_toxic == pytest.approx(toxic, abs=2e-3)


def test_secret_scan_against_plain_scan(spark):
    r = random.Random(12)
    base64, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    key = lambda n, of=base64: "".join(r.choice(of) for _ in range(n))
    slug = lambda: "-".join(r.choice(["the", "house", "river", "market", "summer", "notes"]) for _ in range(7))
    texts, planted = [], []
    for i in range(400):
        kind = i % 5
        secret = key(r.choice((24, 32, 40, 64))) if kind == 0 else key(40, hexes) if kind == 1 else None
        token = secret or (slug() if kind == 2 else "/".join(["usr", "share", "lib", "configuration", f"file{i:04d}"]) if kind == 3 else f"{i:020d}z{i:09d}")
        texts.append(f"see {token} and password = {key(r.choice((3, 9)))} AKIA{key(r.choice((4, 18)), base64[:26])}.")
        planted.append(secret)
    got = {q.doc_id: q for q in secret_scan.report(secret_scan.find_secrets(rows_of(spark, [(i, t, "a") for i, t in enumerate(texts)]))).collect()}

    def plain(text):  # the three base patterns by hand
        found, i, keep = [], 0, set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
        at = text.find("password = ")
        end = at + 11
        while end < len(text) and text[end] in keep:
            end += 1
        if end - at - 11 >= 6:
            found.append((at, "assign", end))
        at = text.find("AKIA")
        end = at
        while end < len(text) and text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            end += 1
        if end - at >= 20:
            found.append((at, "access", end))
        while i < len(text):
            j = i
            while j < len(text) and text[j] in hexes:
                j += 1
            if j - i >= 24:
                found.append((i, "hex", j))
            i = max(j, i + 1)
        return sorted(found)

    scanned, judged = [], collections.defaultdict(list)
    for i, t in enumerate(texts):
        base = plain(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        found = [(a, b, secret_scan.randomness(t[a:b])) for a, b in secret_scan.candidates(t, [(0, a, b) for a, _, b in base])]
        scanned.append((base, found))
        for a, b, p in found:
            judged[next((n for n, top in enumerate(secret_scan.LENGTHS) if b - a <= top), 5)].append(min(300, int(-math.log10(max(p, 1e-300)) * 10)))
    cut = {}
    for size, bins in judged.items():  # Benjamini-Hochberg, a bin at its largest p-value
        bins.sort(reverse=True)
        cut[size] = min([b for n, b in enumerate(bins, 1) if 10 ** (-b / 10) <= 0.01 * sum(x >= b for x in bins) / len(bins)], default=301)
    hits = wrong = 0
    for i, (base, found) in enumerate(scanned):
        more = [(a, b) for a, b, p in found if min(300, int(-math.log10(max(p, 1e-300)) * 10)) < cut[next((n for n, top in enumerate(secret_scan.LENGTHS) if b - a <= top), 5)]]
        spans = sorted([(a, secret_scan.KINDS.index(k), b) for a, k, b in base] + [(a, 3, b) for a, b in more])
        assert got[i].spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        own = [texts[i][a:b] for a, k, b in spans if k in (2, 3)]
        hits += planted[i] is not None and planted[i] in own
        wrong += planted[i] is None and any(x.startswith(("the", "house", "river", "market", "summer", "notes", "usr", "000")) for x in own)
    assert hits >= 0.95 * sum(p is not None for p in planted) and wrong <= 0.05 * sum(p is None for p in planted), (hits, wrong)


def test_sentence_spans_against_quadratic_comparison(spark):
    import pyarrow as pa

    from quillon.llm.kernels import text_buffers

    r = random.Random(13)
    say = lambda n: " ".join(r.choice(["ab", "cde", "f", "ghi", "jk", "lmno"]) + str(r.randrange(30)) for _ in range(n))
    shared = [". ".join(say(r.randint(3, 14)) for _ in range(r.randint(1, 5))) + "." for _ in range(8)]
    texts = [" ".join(r.choice([*shared, say(r.randint(1, 20)) + r.choice(["", ".", "\n"])]) for _ in range(r.randint(0, 6))) for _ in range(50)]
    texts += [None, "Call us now. We are open.", "Call us now. We are open.", texts[3].upper()]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    starts, ends, first, doc = sentence_spans.sentences(data, offsets)
    raw = data.tobytes()
    upto = [*first.tolist(), len(starts)]
    own = [[[raw[a:b].lower() for a, b in zip(starts[upto[i] : upto[i + 1]], ends[upto[i] : upto[i + 1]])] for i in np.flatnonzero(doc == d)] for d in range(len(texts))]
    runs = set()
    for d, sents in enumerate(own):
        for a in range(len(sents)):  # the fewest sentences with enough words, or three, from each start and to each end
            for span in (next(((a, b) for b in range(a + 2, len(sents) + 1) if sum(map(len, sents[a:b])) >= 12 or b == a + 3), None), next(((b, a + 1) for b in range(a - 1, -1, -1) if sum(map(len, sents[b : a + 1])) >= 12 or b == a - 2), None)):
                if span:
                    runs.add((d, *span))
    runs = sorted(runs)
    text_of = {q: tuple(w for s in own[q[0]][q[1] : q[2]] for w in s) for q in runs}
    gone = collections.defaultdict(set)
    for i, q in enumerate(runs):
        if any(text_of[p] == text_of[q] for p in runs[:i]):
            gone[q[0]] |= set(range(q[1], q[2]))
    got = {x.doc_id: x for x in sentence_spans.dedup(rows_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for d in range(len(texts)):
        have = {n for part in got[d].removed.split(",") if part for n in range(*map(int, part.split(":")))}
        assert have == gone[d] and got[d].n_removed == len(have) and got[d].n_sentences == len(own[d]), d
    assert sum(map(len, gone.values())) > 40


def test_bpe_composes_before_lowering_and_checks_its_joins(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    r = random.Random(14)
    texts = ["J̌ and H̱", "T̈ W̊ Y̊", "x" * 300_000, *(" ".join(r.choice(["don't", "Stop", "12", "naïve", "J̌"]) for _ in range(400)) for _ in range(20))]
    texts += texts[-5:]
    got = {q.doc_id: (q.n_tokens, q.ids_sha256, q.decoded_sha256) for q in bpe.digests(rows_of(spark, [(i, x, "a") for i, x in enumerate(texts)])).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    codec = bpe.Codec(path)
    assert codec.apart and codec.agree([(b"stop", b"it", b"now")]) and codec.joins == 1
    codec.words.put(b"now", (1, "7", "wrong"))  # a side that does not come out as it was
    assert not codec.agree([(b"stop", b"it", b"now")]) and codec.disagreed == 1
    import json

    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    assert not bpe.Codec(str(tmp_path / "other.json")).apart
    t = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert [q.ids for q in bpe.encode(rows_of(spark, [(1, texts[-1], "a")]), str(tmp_path / "other.json")).collect()] == [t.encode(texts[-1], add_special_tokens=False).ids]


def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_sends_words_of_letters_to_the_model_alone():
    t, r = _library(), random.Random(15)

    class Counting:
        def __init__(self):
            self.texts = []

        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, texts, **kind):
            self.texts += texts
            return t.encode_batch_fast(texts, **kind)

    plain = [" ".join("".join(r.choice("ANOnosteéÉß") for _ in range(r.randint(1, 12))) + r.choice(["", "", ",", ".!!", "$$$"]) for _ in range(300)) for _ in range(20)]
    awkward = ["".join("".join(r.choice(["a", "Q", "é", "'", "'s", "don't", "’", ".", "!", "7", "²", "ª", "\u030c", "\u0331", "K", "İ", "ς", "Σ", "\xa0", "\x0b", "<|endoftext|>", "|>", "<|"]) for _ in range(r.randint(1, 6))) + r.choice([" ", "\n", "  "]) for _ in range(60)) for _ in range(300)]
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (plain, awkward):
        codec.tokenizer, codec.joins = Counting(), 0
        got = list(bpe._encoded(codec, pa.array(texts)))
        for x, g in zip(texts, got, strict=True):
            ids = t.encode(x, add_special_tokens=False).ids
            assert g == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)), x
        if texts is plain:
            alone = [x for x in codec.tokenizer.texts if " " not in x]
            assert codec.joins > 50 and not any(map(str.isalpha, alone)) and len(alone) < 10


def test_bpe_keeps_little_in_a_worker():
    import tracemalloc

    r = random.Random(16)
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    prose = pa.array([" ".join("".join(r.choice("enostaré") for _ in range(9)) for _ in range(1000)) for _ in range(200)])
    long = pa.array([" ".join("".join(r.choice("enostaré") for _ in range(700)) for _ in range(20)) for _ in range(200)])
    tracemalloc.start()
    try:
        for texts, most in ((prose, 60e6), (long, 40e6)):
            tracemalloc.reset_peak()
            assert sum(n > 0 for n, _, _ in bpe._encoded(codec, texts)) == 200
            codec.forget()
            assert tracemalloc.get_traced_memory()[1] < most
    finally:
        tracemalloc.stop()


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.classify(docs, labels).filter("toxic").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    best = {t: max(i for i in left if left[i] == t) for t in set(left.values())}
    left = {i: t for t, i in best.items()}
    ids = sorted(left)
    heads = components([shingles(left[i], 5) for i in ids])
    left = {i: left[i] for n, i in enumerate(ids) if heads[n] == n}
    got = spark.createDataFrame(corpus_pipeline.STAGES[3][1](spark, docs.filter(docs.doc_id.isin(list(left))), sf).collect(), docs.schema)
    copies = collections.Counter(r.doc_id for r in got.collect())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    want = collections.Counter()
    for i, n in copies.items():
        want[(i, len(t.encode(left[i], add_special_tokens=False).ids))] += n
    assert collections.Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want and set(copies) <= set(left) and len(copies) > 100

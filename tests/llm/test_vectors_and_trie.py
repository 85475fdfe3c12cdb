"""The conversation trie and the operators on vectors against brute force, with every awkward case."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from quillon.llm import blocks, conversation_trie, embedding_dedup, hard_negatives, kernels, minhash, squares

TURNS = "conv_id long, turn long, role string, text string, key long, rep string, n long"


def turns_of(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 5, "x", None) for r in rows], TURNS)


def brute_trie(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        seqs[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for path, of in members.items():
        under = [p for p in members if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in of if len(seqs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(of), len(path), parent, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def conversations():
    r = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 230), 5000, 5001, -3, -200, -203, 10**12 + 7]:
        kind = r.random()
        n = r.randint(1, 9)
        for t in range(n):
            text = "hello" if t == 0 and kind < 0.5 else r.choice("abé") if kind < 0.8 else str(r.random())
            rows.append((c, t, r.choice(["user", "user", "assistant"]) if t else "user", text))
    for c in range(300, 420):  # a third of all conversations are one
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(c, t, "user", f"long {t}") for c in (700, 701) for t in range(11)] + [(701, 11, "user", "end")]
    rows += [(800, None, "user", "null turn"), (800, None, None, None), (800, 1, "user", "tie b"), (800, 1, "user", "tie a"), (800, 1, "user", "tie a"), (None, 1, "user", "nobody")]
    return rows


def got_trie(frame):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=lambda r: (r[1], r[0]))


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations()
    assert got_trie(conversation_trie.conversation_trie(turns_of(spark, rows))) == brute_trie(rows)


def test_trie_of_plain_conversations(spark):
    rows = [r for r in conversations() if r[0] is None or not 300 <= r[0] < 400]
    assert got_trie(conversation_trie.plain_trie(turns_of(spark, rows))) == brute_trie(rows, rebuild=False)


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "x")], [(7, 0, "user", "x"), (9, 0, "user", "x")], [(5, 0, None, "")]])
def test_trie_of_few(spark, rows):
    assert got_trie(conversation_trie.conversation_trie(turns_of(spark, rows))) == brute_trie(rows)


def test_one_long_conversation_is_numbered_in_pieces(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(3000)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the sort keeps its partitions
    try:
        turns = conversation_trie.numbered(turns_of(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.pos, r.upto) for r in turns) == [(i + 1, i + 1) for i in range(3000)]


def vector_frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], f"vec_id long, embedding array<{kind}>, label int, _row long, cid long, key string")


def brute_links(rows, limit=0.9):
    width = max([len(v) for _, v, _ in rows if v], default=1)
    unit = []
    for _, v, _ in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array([*v, *[0.0] * (width - len(v))]) if ok else np.zeros(width)
        x = x / (np.abs(x).max() or 1)
        unit.append(x / (np.sqrt((x * x).sum()) or 1))
    near = np.array(unit) @ np.array(unit).T >= limit
    np.fill_diagonal(near, False)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, int(near[i].sum()), least, vec_id == least))
    return collections.Counter(out)


@pytest.mark.parametrize(("kind", "in_bucket"), [("double", 512), ("float", 512), ("double", 1)])
def test_embedding_near_duplicates(spark, kind, in_bucket, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "IN_BUCKET", in_bucket)  # 1: several polytopes make a key
    monkeypatch.setattr(squares, "SMALL", 16)  # many squares
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 12))
    vectors = [base[i % 12] + r.normal(size=12) * (0.05 if i % 3 else 0.3) for i in range(360)] + [base[0]] * 150 + [base[0] * 3] * 5
    rows = [(i, v.astype(np.float32 if kind == "float" else float).astype(float).tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 12, 1), (1003, [1.0, None] * 6, 1), (1004, [float("nan")] * 12, 1), (1005, [float("inf")] * 12, 1), (1006, [1.0, 0.0], 1), (1007, [1.0, -0.0, 0.0], 1)]
    rows += [(None, base[1].astype(np.float32 if kind == "float" else float).tolist(), 1), (None, [0.0] * 12, 1), (3, rows[4][1], 1), (3, rows[4][1], 1)]
    got = collections.Counter(tuple(x) for x in embedding_dedup.near_duplicates(vector_frame(spark, rows, kind)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute_links(rows)


def test_embedding_dedup_of_none_and_of_huge(spark):
    assert embedding_dedup.near_duplicates(vector_frame(spark, [])).collect() == []
    rows = [(1, [1e308, 1e308], 1), (2, [1e-310, 1e-310], 1), (3, [1.0, -1.0], 1)]
    got = sorted(tuple(x)[:3] for x in embedding_dedup.near_duplicates(vector_frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_tables_suffice_at_the_limit():
    """Of pairs at cosine 0.9 in fact, how many share a bucket, for one polytope and for several?"""
    r = np.random.default_rng(11)
    a, b = r.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (500, 50_000, 10**6, 10**8):
        plan = embedding_dedup.Plan(n, 64, 0.9)
        x, y = plan.signature(a), plan.signature(b)
        shared = plan.first_key(x, y)
        assert (shared >= 0).all(), n
        keys = [set(k) & set(m) for k, m in zip(plan.keys(x[:200]).tolist(), plan.keys(y[:200]).tolist(), strict=True)]
        assert all(k in both for k, both in zip(shared[:200].tolist(), keys, strict=True))


def brute_negatives(rows, k=10):
    codes = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        codes.append((vec_id, i, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for a in codes:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[3], b[3])), b[0], b[1], b[2]) for b in codes if b[1] != a[1]))
        for p in [s for s in scored if s[3] == a[2]][:5]:
            found = [s for s in scored if s[3] != a[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:k]
            out += [(a[0], p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(found)]
    return collections.Counter(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "DATA_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    r = np.random.default_rng(9)
    base = r.normal(size=(10, 8)) + 0.5
    rows = [(i, (base[(i * 7) % 10] * 0.3 + r.normal(size=8) * 0.2).tolist(), int((i * 7) % 10)) for i in range(700)]
    rows += [(i, rows[0][1], i % 3) for i in range(700, 1000)]  # a third of the rows are one vector
    rows += [(1100, None, 1), (1200, [1.0, None] * 4, 1), (1300, [float("nan")] * 8, 1), (1400, [0.5] * 8, None), (1500, [0.5] * 3, 2), (1600, [], 4), (1700, [-1.0] * 8, 99), (100, rows[5][1], 5), (100, rows[5][1], 5), (None, [0.1] * 8, 1)]
    got = collections.Counter(tuple(x) for x in hard_negatives.mined(vector_frame(spark, rows)).collect())
    assert got == brute_negatives(rows) and len(got) > 300


def test_hard_negatives_of_none_and_of_huge(spark):
    assert hard_negatives.mined(vector_frame(spark, [])).collect() == []
    rows = [(100, [1e18] * 4, 1), (101, [1e18] * 4, 1), (102, [5e17] * 4, 2), (103, [1e300] * 4, 3)]
    got = sorted(tuple(x) for x in hard_negatives.mined(vector_frame(spark, rows)).collect())
    assert [x[:4] for x in got] == [(100, 101, 1, 102)] or [x[:2] for x in got] == [(100, 101)] * len(got)


def test_products_are_exact():
    r = np.random.default_rng(3)
    for most in (100, 1 << 29, 1 << 40, (1 << 63) - 1):
        a, b = (r.integers(-most, most, (5, 7)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert [[int(x) for x in row] for row in blocks.products(a, b)] == want


def test_long_words_of_two_letters_are_told_apart(spark):
    """A Thue-Morse word and its mirror: polynomials modulo 2^64 agree on them."""
    word = "x"
    while len(word) < 1024:
        word += word.translate(str.maketrans("xy", "yx"))
    mirror = word.translate(str.maketrans("xy", "yx"))
    docs = spark.createDataFrame([(1, word), (2, mirror), (3, word.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    data = np.frombuffer(b"abcdefgh abcdefgh\0 hgfedcba abcdefgh12345678 12345678abcdefgh", np.uint8)
    hashes = kernels.word_hash(data, *kernels.words(data, np.array([0])))
    assert len(set(hashes.tolist())) == 5

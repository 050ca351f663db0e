"""Near-duplicate classes against all pairs, and the BagMinHash estimate."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from varilens.llm import near_dup as N
from varilens.llm.components import components


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def classes(rows, least=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= least:
                parent[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return [(i, ids.get(find(k))) for k, (i, _) in enumerate(rows)]


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def near_copies(rnd, n=60):
    vocabulary = [f"w{k}" for k in range(500)]
    rows = [(None, None), (1, ""), (2, "   "), (3, "a b"), (4, " a  b "), (5, "a b c d e"), (6, "é " * 400), (7, "é " * 380), (8, "x y " * 60_000)]
    for g in range(8):
        base = rnd.choices(vocabulary, k=rnd.randint(6, 200))
        for _ in range(n // (g + 1)):
            t = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 25)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((rnd.randint(10, 10_000), " ".join(t)))
    return [*rows, rows[-1], (rows[-1][0], "same id other text here now"), (9, "a b c d e")]


def test_classes_equal_all_pairs(spark):
    rows = near_copies(random.Random(7))
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, size int")
    exp = sort(classes(rows))
    assert sort((r.id, r.class_id) for r in N.near_duplicates(docs).collect()) == exp
    left = N.deduplicated(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    assert Counter(r.doc_id for r in kept) == Counter({c for _, c in exp})


def on_a_template(rnd, n, own=0.13, words=300, alike=0):
    """``n`` texts that share a template and differ in a share ``own`` of their words; ``alike`` of them have a close copy."""
    template = [f"t{k}" for k in range(words)]
    rows = []
    for i in range(n):
        t = list(template)
        for k in range(0, words, int(5 / own)):  # every change spoils five shingles
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
        if i < alike:
            t[rnd.randrange(words)] = f"y{i}"
            rows.append((n + i, " ".join(t)))
    return rows


def test_wide_buckets_meet_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "WIDE", 8)
    monkeypatch.setattr(N, "LEVELS", (4, 16, 64))
    rnd = random.Random(12)
    for rows in (near_copies(rnd), on_a_template(rnd, 60, alike=20), on_a_template(rnd, 50, own=0.05), on_a_template(rnd, 40, own=0.11, alike=40)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sort((r.id, r.class_id) for r in N.near_duplicates(docs).collect()) == sort(classes(rows))


def test_prefixes_share_a_token_for_every_linked_pair():
    rnd = random.Random(5)
    texts = [t for _, t in near_copies(rnd, 30) if t and t.split() and len(t) < 5000]
    bags = [bag(t) for t in texts]
    filters = [np.random.default_rng(1).integers(0, 1 << 63, N.FILTER_WORDS, dtype=np.uint64)]  # any order will do
    batch = pa.RecordBatch.from_arrays([pa.array([str(k).encode() for k in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    probe, index = {}, {}
    for out in N._prefixes(filters, 0.8)(iter([batch])):
        for token, key, size, indexed in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert size == sum(bags[int(key)].values())
            probe.setdefault(int(key), set()).add(token)
            if indexed:
                index.setdefault(int(key), set()).add(token)
    linked = 0
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            if i != j and sum(b.values()) <= sum(a.values()) and similarity(a, b) >= 0.8:
                assert probe[i] & index[j]
                linked += 1
    assert linked > 100


def test_template_texts_grow_no_faster_than_their_number(spark, monkeypatch):
    """Rows placed in blocks and rare shingles, for texts at a similarity of about 0.67."""
    monkeypatch.setattr(N, "WIDE", 64)
    placed = []
    staged, names = N.staged, {}

    def counted(df, name):
        out = staged(df, name)
        if name == "prefixes":
            names[name] = names.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(N, "staged", counted)
    for n in (250, 500, 1000):
        names.clear()
        rows = on_a_template(random.Random(1), n, own=0.2, words=200)
        found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len({r.class_key for r in found}) == n
        placed.append(names.get("prefixes", 0))
    assert placed[0] > 0
    assert all(b <= 2.2 * a for a, b in zip(placed, placed[1:])), placed


def test_unlike_documents_with_null_or_shared_ids_stay_apart(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdefgh"]
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:6]] + [(None, texts[6]), (7, texts[6]), (8, texts[7]), (None, texts[0] + " z"), (7, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows) and len({r.class_key for r in found}) == len(texts)
    assert len({(r.class_key, r.class_id) for r in found}) == len(texts)
    kept = [(r.doc_id, r.text[0]) for r in N.deduplicated(docs).collect()]
    assert sort((i, ord(c)) for i, c in kept) == sort(
        [(None, ord(c)) for c in "abc"] + [(7, ord(c)) for c in "defg"] + [(8, ord("h"))])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0 and N.deduplicated(docs).count() == 0


def test_blocks_lose_no_pair_and_sketches_only_rule_out():
    rnd = random.Random(8)
    texts = pa.array([t or "" for _, t in near_copies(rnd, 40)])
    n = len(texts)
    row, value, count = N.shingles(texts)
    side = {"component": np.arange(n), "distance": np.zeros(n), "size": np.bincount(row, count, n),
            "prints": np.zeros((n, N.BANDS)), "bins": N.histograms(row, value, count, n)}
    i, j = N.possible(side, side, 0, 0.8)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    bags = [bag(t) for t in texts.to_pylist()]
    linked = {(a, b) for a in range(n) for b in range(n) if a != b and bags[a] and similarity(bags[a], bags[b]) >= 0.8}
    assert linked <= found and len(found) < 3 * len(linked) + n


def test_overlap_is_exact_and_the_estimate_unbiased():
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    a, b = [], []
    for k in range(120):
        t = [w if rnd.random() > k / 800 else f"z{rnd.randrange(99)}" for w in base]
        a.append(" ".join(base) + " r" * (k % 30) + f" u{k}")
        b.append(" ".join(t) + " r" * (k % 7) + f" u{k}")
    exp = np.array([similarity(bag(x), bag(y)) for x, y in zip(a, b, strict=True)])
    assert np.allclose(N.overlaps(pa.array(a), pa.array(b)), exp)
    s, t = (N.signatures(*N.shingles(pa.array(x)), len(x)) for x in (a, b))
    off = (s == t).mean(axis=1) - exp
    assert abs(off.mean()) < 0.02 and np.sqrt((off ** 2).mean()) < 0.06


def test_signature_does_not_depend_on_slices(monkeypatch):
    texts = pa.array(["a b c d e f g", "", "x " * 300, "the cat sat on the mat and the dog"])
    whole = N.signatures(*N.shingles(texts), 4)
    monkeypatch.setattr(N, "CHUNK", 3)
    parts = [N.signatures(*N.shingles(texts.slice(k, 1)), 1)[0] for k in range(4)]
    assert np.array_equal(whole, np.array(parts))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5), (7, 6), (7, 6)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | dict.fromkeys((200, 201, 202), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

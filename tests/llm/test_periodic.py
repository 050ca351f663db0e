"""Runs against every start and period; the tree's parts against their definitions; odd inputs."""
import hashlib
import random
import zlib

import numpy as np

from varilens.llm import periodic as P
from varilens.llm.queries import QUERIES


def all_runs(words, least=12):
    """Every maximal repetition, by trying all periods, the smallest first."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def sequences(seed, times):
    rnd = random.Random(seed)
    for _ in range(times):
        letters = rnd.choice([1, 2, 3, 6, 40])
        s = [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):  # put in repeats, some of them nested
            a = rnd.randint(0, len(s))
            piece = s[a:a + rnd.randint(1, 9)] * rnd.randint(2, 7)
            s[a:a] = piece[:rnd.randint(1, 40)]
        yield s


def test_runs_equal_all_periods():
    for s in sequences(1, 3000):
        for least in (2, 12):
            assert [(a, b - a, q) for a, b, q in P.runs_of(np.array(s, np.int64), least).tolist()] == all_runs(s, least), s


def test_tree_orders_suffixes_and_measures_them():
    for s in sequences(2, 150):
        tree = P.SuffixTree([x + 1 for x in s])
        text = [x + 1 for x in s] + [0]
        assert tree.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for i in range(0, len(text), 3):
            for j in range(i + 1, len(text)):
                k = 0
                while j + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                assert tree.extension(np.array([i]), np.array([j]))[0] == k


def test_stretches_hold_every_run():
    for k, s in enumerate(sequences(3, 1500)):
        words = np.array(s + [99] + s, np.int64)
        owner = np.repeat([0, 1, 2], [len(s), 1, len(s)])
        ranges = P.stretches(words, owner)
        for start, length, _ in all_runs(s):
            assert any(a <= start and start + length <= b for a, b in ranges), (k, s)
        assert all(owner[a] == owner[b - 1] for a, b in ranges)


def test_far_repeats_need_no_tree():
    line = [f"line{i}" for i in range(20)]
    words = [*line, *(f"a{i}" for i in range(300)), *line]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert P.stretches(np.array([numbers[w] for w in words]), np.zeros(len(words), np.int64)) == []


def test_texts_and_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n\x0b\x0c\r ", 4: "ha " * 20_000, 5: "a b c " * 4 + "d", 6: "a b c " * 4 + "d",
             7: "x y " * 12, 8: "no run here at all\nbut words", 9: "a b " * 6 + "c " * 12 + "a b " * 6}
    rows = [(k, t, k) for k, t in texts.items()] + [(None, "z " * 12, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int").repartition(3)
    got = {r["id"]: r for r in P.periodic_runs(docs).collect()}
    assert len(got) == len(rows)
    for k, text in [*texts.items(), (None, "z " * 12)]:
        words = (text or "").encode().split()
        runs = all_runs(words) if len(words) < 1000 else [(0, 20_000, 1)]
        assert [tuple(r) for r in got[k]["runs"]] == runs
        assert got[k]["collapsed"] == collapsed([w.decode() for w in words], runs)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_small_tables(spark):
    from .conftest_llm import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for ident, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(ident).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs, r = all_runs(words), got[ident]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(((-k, s, q) for s, k, q in runs), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (
            (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
    assert planted > 10

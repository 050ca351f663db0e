"""Ranks against scoring every document; interval bounds; odd inputs; the query against its SQL."""
import math
import random
import re
from collections import Counter

import numpy as np

from varilens.llm import ranked_search as R
from varilens.llm.queries import ORACLE, QUERIES

from .conftest_llm import SF

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def expected(docs, items, limit=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for ident, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(words(text)) if c[t])
            if score > 0:
                found.append((-score, ident is None, ident if ident is not None else 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:limit])]
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "é", "naïve", "日本", "A1", "a1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    gaps = [" ", "\n", "-", "_", "\x7f", "\x00", "!? "]
    text = lambda k: "".join(w + rnd.choice(gaps) for w in rnd.choices(vocabulary, weights, k=k))
    docs = [(i, text(rnd.randint(0, 40))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, " !"), (n + 3, docs[3][1]), (None, docs[4][1]), (4, docs[4][1]), (n + 5, text(3000))]
    items = [(i, text(rnd.randint(0, 12))) for i in range(25)] + [(90, None), (91, ""), (92, "unseen"), (3, docs[0][1]), (3, docs[0][1])]
    return docs, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranks_equal_scoring_everything(spark):
    docs, items = corpus(1, 700)
    extra = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, score int, rank string")
    queries = spark.createDataFrame(items, "item_id int, text string")
    want = expected(docs, items)
    assert rows_of(R.ranked(extra.repartition(5), queries)) == want
    assert rows_of(R.ranked(extra.repartition(2), queries, block_postings=300, query_bytes=60)) == want
    assert rows_of(R.ranked(extra.repartition(3), queries, limit=3)) == expected(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert R.ranked(docs, items).count() == 1
    assert R.ranked(docs.limit(0), items).count() == 0
    assert R.ranked(docs, items.limit(0)).count() == 0
    assert R.ranked(docs.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_in_chunks_equal_terms_at_once(monkeypatch):
    text = corpus(4, 9)[0][-1][1]
    whole = [t for part in R.terms(text) for t in part]
    monkeypatch.setattr(R, "CHUNK", 7)
    assert [t for part in R.terms(text) for t in part] == whole == [w.encode() for w in words(text)]


def random_block(seed, docs=400, vocabulary=30):
    rnd = np.random.default_rng(seed)
    held = rnd.random((docs, vocabulary)) < rnd.random(vocabulary) ** 2
    doc, term = np.nonzero(held)
    counts = rnd.integers(1, 9, len(doc))
    lengths = rnd.integers(5, 900, docs)
    weights = rnd.integers(0, 9000, vocabulary)
    return R.Block(list(range(docs)), lengths, doc, term, counts, weights, docs, int(lengths.sum()))


def test_bounds_are_sums_of_range_maxima():
    block, rnd = random_block(3), np.random.default_rng(4)
    for _ in range(200):
        a, b = sorted(rnd.integers(0, block.n + 1, 2))
        query = rnd.choice(30, 5, replace=False)
        low, high = (np.searchsorted(block.keys, query * block.n + x)[None] for x in (a, b))
        bound, split = block.bounds(low, high)
        own = [block.impact[x:y] for x, y in zip(low[0], high[0], strict=True)]
        assert bound[0] == sum(x.max() for x in own if len(x))
        if any(len(x) for x in own):
            assert a <= split[0] < b


def test_search_skips_documents_that_cannot_rank():
    block = random_block(5, docs=20_000)
    best = []
    scored = block.search(np.array([1, 2, 3]), best, 10)
    every = np.zeros(block.n, np.int64)
    for t in (1, 2, 3):
        at = slice(*np.searchsorted(block.keys, [t * block.n, (t + 1) * block.n]))
        every[block.doc[at]] += block.impact[at]
    want = sorted((-int(s), False, i) for i, s in zip(block.ids, every, strict=True))[:10]
    assert best == want
    assert scored < block.n / 2


def test_query_equals_its_sql(spark):
    import duckdb
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    want = duckdb.sql(ORACLE["op12_ranked_search"]).fetchall()
    assert rows_of(QUERIES["op12_ranked_search"](spark, SF)) == sorted(want, key=str)

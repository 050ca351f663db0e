"""Benchmark matches against full dynamic programming."""
import random

import pytest

from varilens.llm import decontaminate as D

RND = random.Random(3)
WORDS = "ab cd the of ing tion er an".split()


def distance_inside(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def edited(text, n):
    t = list(text)
    for _ in range(n):
        k = RND.randrange(len(t)) if t else 0
        op = RND.random()
        if op < 0.35 and t:
            t[k] = RND.choice("abcxyz")
        elif op < 0.7:
            t.insert(k, RND.choice("abcxyz"))
        elif t:
            del t[k]
    return "".join(t)


def words(a, b):
    return " ".join(RND.choices(WORDS, k=RND.randint(a, b)))


@pytest.mark.parametrize("rate", [0.08, 0.15, 0.3])
def test_every_match_within_the_budget_and_no_other(rate):
    hits = 0
    for _ in range(150):
        item = words(3, 16)
        doc = D.normalised(f"{words(0, 25)} {edited(item, RND.randint(0, 6))} {words(0, 20)}")
        k = min(int(rate * len(item)), len(item) - 1)
        if not k:
            continue
        found = D.Matcher([(7, item)], rate).matches(doc)
        best = distance_inside(item, doc)
        assert bool(found) == (best <= k)
        for d, a, e in found.values():
            hits += 1
            assert d == best and distance_inside(item, doc[a:e]) <= d
    assert hits > 30


def test_rows_nulls_short_items_repeats_and_blocks(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from all of this"
    docs = [(1, f"x {item.upper()}!! y"), (2, "nothing here"), (3, None), (4, ""), (None, item), (5, edited(item, 2)), (5, edited(item, 2)),
            (6, "yes"), (7, "yesterday"), (8, "z " * 200_000 + item), (9, "?!")]
    bench = [(10, item), (11, None), (12, ""), (13, "Yes!"), (14, item), (None, "absent text that no document holds at all"), (13, "Yes!")]
    d = spark.createDataFrame([(*r, 0, "c") for r in docs], "doc_id long, text string, distance int, item_id string")
    b = spark.createDataFrame([(*r, "c") for r in bench], "item_id long, text string, doc_id string")
    key = lambda r: tuple((x is None, x) for x in r)
    exp = sorted([(i, k) for i, t in docs for k in (10, 14) if i in (1, None, 5, 8)] + [(6, 13)] * 2, key=key)
    for size in (D.BLOCK_BYTES, 50):
        found = D.benchmark_matches(d, b, block_bytes=size)
        assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=key) == exp
        left = D.decontaminated(d, b, block_bytes=size)
        assert left.columns == d.columns
        assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 7, 9]
    assert D.benchmark_matches(d.limit(0), b).count() == 0
    assert D.benchmark_matches(d, b.limit(0)).count() == 0
    assert D.decontaminated(d, b.limit(0)).count() == len(docs)


def first_end(item, text, k):
    """Least distance of ``item`` to a part of ``text`` and the leftmost end that has it, by full dynamic programming."""
    col = list(range(len(item) + 1))
    best = (len(item), 0)
    for j, x in enumerate(text, 1):
        new = [0]
        for i, c in enumerate(item, 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (c != x)))
        col = new
        best = min(best, (col[-1], j))
    return best if best[0] <= k else None


REPEATS = ["a" * 120, "the cat " * 14, "ab" * 50 + " cd " * 10, "the cat sat on the mat and the cat sat on the hat while the cat sat"]


@pytest.mark.parametrize("item", REPEATS)
def test_repetitive_texts_match_like_full_programming(item):
    rnd = random.Random(len(item))
    item = D.normalised(item)
    k = int(D.RATE * len(item))
    texts = ["a" * 300, "the cat " * 40, "the cat sat on the mat " * 12, "ab" * 200, edited(item, 4), edited(item * 3, 20), edited(item, k + 3)]
    for _ in range(12):
        text = D.normalised("".join(rnd.choice(texts)[:rnd.randint(20, 250)] for _ in range(rnd.randint(1, 3))))
        want = first_end(item, text, k)
        for climb in (1, D.CLIMB, 10**6):  # always climb, as it is, one pass at once
            old, D.CLIMB = D.CLIMB, climb
            try:
                found = list(D.Matcher([(1, item)]).matches(text).values())
            finally:
                D.CLIMB = old
            assert [(d, e) for d, _, e in found] == ([want] if want else [])


@pytest.mark.parametrize("item, unit", [("a" * 600, "a"), ("the cat " * 40, "the cat "), ("the cat " * 40, "the cat sat on "),
                                        ("x y z w " * 60, "x y z w v ")])
def test_time_is_linear_in_a_repetitive_text(item, unit):
    import time

    matcher = D.Matcher([(1, D.normalised(item)), (2, D.normalised(item + " end of it"))])
    took = []
    for n in (20_000, 1_000_000):
        text = D.normalised(unit * (n // len(unit)))
        t = time.process_time()
        matcher.matches(text)
        took.append(time.process_time() - t)
    assert took[1] < 50 * took[0] * 3 + 2 and took[1] < 30

"""Removal of repeats against all windows, and the run-length index against plain search."""
import hashlib
import random

import numpy as np
import pytest

from varilens.llm import repeats as R

RND = random.Random(4)


def test_index_against_plain_search():
    for _ in range(200):
        text = np.array([RND.choice([0, 1, 2, 3]) for _ in range(RND.randint(0, 60))] + [0])
        order = R.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        index = R.RunLengthIndex(text)
        match = index.match_lengths(np.flatnonzero(np.append(True, text[:-1] == 0)), 200)
        for a, b in zip(order, order[1:]):
            same = 0
            while max(a, b) + same < len(text) and text[a + same] == text[b + same]:
                same += 1
            assert match[b] == same
        for n in (1, 2, 4):
            pattern = np.array(RND.choices([1, 2, 3], k=n))
            assert index.count(pattern) == sum((text[k:k + n] == pattern).all() for k in range(len(text) - n + 1))


def test_index_is_short_on_repetitive_text():
    text = np.array(list(b"abcdefghijklmnop" * 200) + [0])
    assert len(R.RunLengthIndex(text)) < 40


def expected(rows):
    """By all windows; documents in order of id, then of their text's checksum."""
    import zlib
    seen, out = {}, {}
    order = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    for i, t in sorted(set(rows), key=order):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - R.LENGTH + 1):
            if seen.setdefault(raw[k:k + R.LENGTH], (i, t, k)) != (i, t, k):
                gone[k:k + R.LENGTH] = b"\1" * R.LENGTH
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, t] = (i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def table():
    words = ["".join(RND.choices("abcdeé", k=RND.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(RND.choices(words, k=40)) for _ in range(30)]
    rows = []
    for k in range(150):
        t = " ".join(RND.choices(words, k=RND.randint(0, 60)))
        for _ in range(RND.randint(0, 3)):
            p = RND.choice(passages)
            t += RND.choice([" ", "", "\n"]) + p[RND.randint(0, 100):RND.randint(100, len(p))] + " " + " ".join(RND.choices(words, k=RND.randint(0, 20)))
        rows.append((k * 3, t))
    rows += [(2000 + k, rows[k][1]) for k in range(20)]
    return rows + [(3000, "ab" * 400), (3001, "a" * 1000), (3002, None), (3003, "z" * 99), (3004, ("x" * 50 + "y") * 9), (3000, "ab" * 400),
                   (6, rows[7][1] + "!"), (None, rows[8][1]), (4000, " ".join(RND.choices(words, k=3000)) + rows[9][1]), (4001, "")]


@pytest.mark.parametrize("options", [{}, {"hot": 3}], ids=["indexed", "hot minimizers spread"])
def test_removal_equals_all_windows(spark, options):
    rows = table()
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, start string, size int")
    found = [(r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
             for r in R.without_repeats(docs, **options).collect()]
    assert sorted(found, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == expected(rows)


def test_hot_bound_does_not_grow_with_the_corpus(spark, monkeypatch):
    rnd = random.Random(11)
    line = "".join(rnd.choices("abcdefgh", k=90))
    rows = [(k, "".join(rnd.choices("abcdefgh", k=1500)) + line + "".join(rnd.choices("abcdefgh", k=1500))) for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "0L as tie", "text").repartition(12)
    emit, made = R._emit, []
    monkeypatch.setattr(R, "_emit", lambda *a: made.append(emit(*a)) or made[-1])
    assert R.repeat_marks(docs, hot=20).count() == 0
    flow = docs.mapInArrow(made[0], R.FLOW).where(f"kind = {R.CONTEXT}")
    assert flow.groupBy("pk").count().agg({"count": "max"}).first()[0] <= 20
    flow = docs.mapInArrow(emit(np.zeros(0, np.int64), np.zeros(0, np.uint64)), R.FLOW)
    assert flow.groupBy("pk").count().agg({"count": "max"}).first()[0] > 20  # the line, unless it is spread


def test_texts_of_one_id_and_checksum_are_not_one_document(spark):
    import zlib
    p = "".join(chr(97 + (k * k + k // 3) % 26) for k in range(150))
    q = "".join(chr(97 + (k ** 3 + k // 5) % 26) for k in range(150))
    a, b = p + "lumxwoyjyc", q + "mqxrbfdijg"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(1, p), (5, a), (5, b), (None, "x"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
             for r in R.without_repeats(docs).collect()]
    assert sorted(found, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == expected(rows)


def test_long_text_in_pieces(monkeypatch):
    """Contexts cut at the bounds of pieces hold the same windows."""
    import pyarrow as pa
    text = "".join(RND.choices("abc ", k=5000))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1]), "tie": pa.array([2]), "text": pa.array([text])})

    def windows():
        found = []
        for data, ends, _, _, offset in R._pieces(batch):
            _, _, a, size, *_ = R.contexts(data, ends)
            found += [offset + x + k for x, n in zip(a, size, strict=True) for k in range(n - R.LENGTH + 1)]
        return sorted(found)
    assert windows() == list(range(len(text) - R.LENGTH + 1))
    monkeypatch.setattr(R, "SLICE_BYTES", 700)
    assert windows() == list(range(len(text) - R.LENGTH + 1))


def test_empty_table(spark):
    assert R.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_of_a_row_send_the_contexts_of_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    indexed = R._indexed

    def counting(batches):
        import os
        import uuid

        def told():
            for b in batches:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(str(b.num_rows))
                yield b
        return indexed(told())

    monkeypatch.setattr(R, "_indexed", counting)
    text = "".join(RND.choices("abcdefgh", k=400))
    counts = []
    for copies in (1, 300):
        rows = [(1, text)] * copies + [(2, "x" * 30 + text[100:300] + "y" * 30)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        found = R.without_repeats(docs).collect()
        assert len(found) == len(rows) and {r.n_removed for r in found if r.id == 1} == {0}
        assert [r.n_removed for r in found if r.id == 2] == [200]
        counts.append(sum(int(p.read_text()) for p in tmp_path.iterdir()) - sum(counts))
    assert counts[0] == counts[1] > 0

"""BPE against the tokenizers library."""
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varilens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
RND = random.Random(2)
PARTS = ["a", "aa", " ", "  ", "\n", "'s", "<|endoftext|>", "the", "é", "1", "!", "　", "\x1c", "\x85", "ab" * 9, "🙂", "ñ\u0301", "<|end"]
ODD = ["", " ", "\n\n ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 30_000, "ab" * 9000, " " * 3000, "x\x00y", "12 345", "don't we'll"]
TEXTS = ODD + ["".join(RND.choices(PARTS, k=RND.randint(0, 25))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_ids_and_texts_equal_the_library(library):
    enc = bpe.Encoder(bpe.Vocabulary(open(PATH, "rb").read()))
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == ids
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(f"a{c}b {c}{c}1" for c in chars)
    assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_small_slices_blocks_and_table_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 20)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    enc = bpe.Encoder(bpe.Vocabulary(open(PATH, "rb").read()))
    texts = TEXTS[:200]
    assert enc.digest(texts) == [row(library, t) for t in texts]


def test_rows_nulls_repeats_and_round_trip(spark, library):
    rows = [(k, t, 1, "clash") for k, t in enumerate(TEXTS[:60])] + [(None, None, 0, "x"), (3, "again", 0, "x"), (3, "again", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    found = bpe.encode_digests(docs, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted([(r[0], *row(library, r[1])) for r in rows], key=key)
    back = bpe.decode_ids(bpe.encode_ids(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0


def test_rules_out_of_order_are_refused():
    import json
    symbols = bpe.byte_symbols()
    vocab = {c: k for k, c in enumerate(symbols)} | {"ab": 256, "abc": 257}
    spec = {"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "added_tokens": []}
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(spec).encode())

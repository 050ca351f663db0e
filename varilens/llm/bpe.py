"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of the partition are laid out as one array of
symbols with links to the left and right neighbour.  An index maps every
mergeable pair (by its rank) to all places where it occurs.  Ranks are taken
in ascending order; all places of a rank merge at once, and the pairs that
arise or vanish beside them update the lists of their ranks.  A merge rule
can only use symbols that earlier rules made (checked when the vocabulary is
read), so a finished rank never comes back.

Words repeat, so each is merged once per worker and looked up afterwards; the
table of known words is emptied when it is full.

Defined results: NULL and empty texts give no tokens (hash of the empty
string); texts of any length are encoded whole, long ones word block by word
block; repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, slices

#: Fixed by the vocabulary's format: the split before the merges.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SLICE_BYTES = 4 << 20     # text taken at once
BLOCK_WORDS = 200_000     # words of one long text taken at once
KNOWN_WORDS = 300_000     # words a worker remembers


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge rules and symbols of a byte-level ``tokenizer.json``."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_id = np.array([vocab[c] for c in symbols], dtype=np.int64)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in [*vocab.items(), *added.items()]:
            self.bytes_of[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.name_of = [str(k) for k in range(size)]
        self.added = added
        self.special = (regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
                        if added else None)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = np.full(size, -1, dtype=np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if len(pairs) and (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge rule uses a symbol that a later rule makes")
        self.left, self.right, self.size = left, right, size
        keys = left * size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no rule merges it."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1) if len(self.keys) else np.full(len(key), -1)


class PairIndex:
    """All occurrences of all mergeable pairs in an array of symbols."""

    def __init__(self, vocab: Vocabulary, symbols: np.ndarray, word: np.ndarray):
        n = len(symbols)
        self.vocab, self.symbol, self.word = vocab, symbols, word
        self.next, self.prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.append(word[1:] != word[:-1], True) if n else np.zeros(0, bool)
        self.next[last] = -1
        self.prev[np.flatnonzero(last[:-1]) + 1] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._note(np.flatnonzero(~last))

    def _note(self, at: np.ndarray) -> None:
        """Enter the pairs that start at these places."""
        rank = self.vocab.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in self.places:
                self.places[r].append(part)
            else:
                self.places[r] = [part]
                heapq.heappush(self.active, r)

    def merge_all(self) -> None:
        v = self.vocab
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.places.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = v.left[r], v.right[r], v.made[r]
            to = self.next[at]
            live = (self.symbol[at] == a) & (to >= 0)
            live &= self.symbol[to] == b
            at, to = at[live], to[live]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair merges
                k = np.arange(len(at))
                begins = np.append(True, to[:-1] != at[1:])
                keep = (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0
                at, to = at[keep], to[keep]
            if not len(at):
                continue
            after = self.next[to]
            self.symbol[at], self.symbol[to], self.next[at] = made, -1, after
            linked = after >= 0
            self.prev[after[linked]] = at[linked]
            before = self.prev[at]
            self._note(np.unique(np.concatenate((at[linked], before[before >= 0]))))


class Encoder:
    """Encodes words through the index and remembers them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        """Empty the table of known words, but for the special tokens (no word of plain text equals one)."""
        self.ids_of = {w: str(k) for w, k in self.vocab.added.items()}
        self.bytes_of = {w: self.vocab.bytes_of[k] for w, k in self.vocab.added.items()}

    def learn(self, words: set[str]) -> None:
        """Merge the words not yet known."""
        if len(self.ids_of) > KNOWN_WORDS:
            self.forget()
        new = [w for w in words if w not in self.ids_of]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.array([len(b) for b in raw])
        symbols = self.vocab.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        index = PairIndex(self.vocab, symbols, np.repeat(np.arange(len(raw)), size))
        index.merge_all()
        whole = index.symbol >= 0
        ids, word = index.symbol[whole].tolist(), index.word[whole]
        ends = np.searchsorted(word, np.arange(len(raw)), side="right").tolist()
        name, piece = self.vocab.name_of.__getitem__, self.vocab.bytes_of.__getitem__
        start = 0
        for w, end in zip(new, ends, strict=True):
            own = ids[start:end]
            self.ids_of[w] = ",".join(map(name, own))
            self.bytes_of[w] = b"".join(map(piece, own))
            start = end

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word."""
        if self.vocab.special is None or not self.vocab.special.search(text):
            return WORD.findall(text)
        return [w for part in self.vocab.special.split(text)
                for w in ([part] if part in self.vocab.added else WORD.findall(part))]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The words of a long text, block by block."""
        parts = self.vocab.special.split(text) if self.vocab.special else [text]
        stream = (w for part in parts for w in ([part] if part in self.vocab.added else (m[0] for m in WORD.finditer(part))))
        while block := list(islice(stream, BLOCK_WORDS)):
            yield block

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: tokens, hash of the ids, hash of the text decoded from the ids."""
        short = [[self.words(t)] if len(t) <= SLICE_BYTES else None for t in texts]
        seen: set[str] = set()
        for words in short:
            if words:
                seen.update(words[0])
        self.learn(seen)
        held = self.ids_of, self.bytes_of  # a long text may empty the table
        found = []
        for text, words in zip(texts, short, strict=True):
            ids, out, n = hashlib.sha256(), hashlib.sha256(), 0
            for block in words if words is not None else self.blocks(text):
                if words is None:
                    self.learn(set(block))
                    ids_of, bytes_of = self.ids_of, self.bytes_of
                else:
                    ids_of, bytes_of = held
                if block:
                    line = ",".join(map(ids_of.__getitem__, block))
                    ids.update(f",{line}".encode() if n else line.encode())
                    out.update(b"".join(map(bytes_of.__getitem__, block)).decode("utf-8", "replace").encode())
                    n += line.count(",") + 1
            found.append((n, ids.hexdigest(), out.hexdigest()))
        return found

    def encode(self, text: str) -> list[int]:
        words = self.words(text or "")
        self.learn(set(words))
        return [int(k) for w in words for k in self.ids_of[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab.bytes_of[k] for k in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The worker's encoder for a vocabulary file's content; made once."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(content))
    return _ENCODERS[key]


def vocabulary_file(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_digests(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of each row's whole text."""
    spark = prepared(docs.sparkSession)
    content = vocabulary_file(spark, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows = enc.digest([t or "" for t in part.column(1).to_pylist()])
                n, ids, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids themselves."""
    spark = prepared(docs.sparkSession)
    content = vocabulary_file(spark, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, vocab_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of each row's token ids (NULL ids: empty)."""
    spark = prepared(encoded.sparkSession)
    content = vocabulary_file(spark, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for batch in batches:
            texts = [enc.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")

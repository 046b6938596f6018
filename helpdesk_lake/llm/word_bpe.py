"""BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has one last token in its BPE encoding. An automaton over
the vocabulary (suffix links lead from the longest match to all shorter ones)
lists the tokens that end at each place; the one whose left neighbour, the last
token of the prefix before it, is compatible with it is stored. Two tokens are
compatible when merging, in rank order, never joins symbols across their border:
a walk up the right edge of the left token's merge tree and the left edge of the
right token's. Following the stored tokens back from the end gives the exact ids.

Before that, a text goes the way of the tokenizer file: special tokens are cut
out, the rest is put in NFC, lower-cased and split by the file's pattern; white
space is dropped. No token crosses white space, so workers remember encodings of
recent white-space-free chunks (``REMEMBERED`` at most).

Edge cases: a null text counts as empty; an empty text has no ids and decodes to
the empty string; a null id is carried along; rows are encoded one by one, so
repeats do no harm; extra columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks and words whose encodings a worker remembers.
REMEMBERED = 500_000
#: The same where only ids are asked for, and the workers of earlier stages still hold memory.
REMEMBERED_IDS = 65_536

#: White space of the pattern's \\s, as characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(f"[^{SPACES}]+")
#: str.split() also splits at these four, which the pattern does not take for white space.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """Values of ``make`` by key: at most ``bound`` are held, those not asked for lately go."""

    def __init__(self, make: Callable, bound: int) -> None:
        super().__init__()
        self.make, self.bound, self.older = make, max(bound // 2, 1), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """A tokenizer of the file's kind: NFC, lower case, split pattern, byte letters, BPE with a word-end suffix."""

    def __init__(self, spec: str, remembered: int = REMEMBERED) -> None:
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or data["decoder"] is not None:
            raise ValueError("not a word-end BPE file without decoder")
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace("\\s", SPACES))
        self.vocab = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = dict(enumerate(byte_letters()))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(z, (x, y))
        self.automaton, self.single = ahocorasick.Automaton(), {}
        for token, i in self.vocab.items():
            key = self._symbols(token)
            if len(key) == 1:
                self.single[key] = i
            elif i in self.parts:
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.edges: tuple[dict[int, list[tuple[int, float]]], ...] = ({}, {})
        self.count = max(self.text_of) + 1
        self.names = {i: str(i) for i in self.text_of}
        self.compatible = Remembered(lambda pair: self._compatible(*divmod(pair, self.count)), remembered)
        self.word_ids = Remembered(self._word_ids, remembered)
        self.chunk_ids = Remembered(self._chunk_ids, remembered)
        self.chunk = Remembered(self._chunk, remembered)

    def _symbols(self, token: str) -> str:
        """One character per symbol; the last of a word has its own."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[:-len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """From a token's outermost symbol up: (node, rank of the merge that takes it in); kept once made."""
        start, found, over = token, [], float("inf")
        while True:
            found.append((token, over))
            if token not in self.parts:
                return self.edges[side].setdefault(start, found[::-1])
            over = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.edges[1].get(left) or self._edge(left, 1), self.edges[0].get(right) or self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            joins = self.rank.get((x, y))
            # of equal ranks the leftmost merge goes first
            if joins is not None and joins < x_ends and joins <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one piece of the split pattern."""
        letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        letters = letters[:-1] + chr(ord(letters[-1]) + 0x1000)
        # a prefix that no longer token ends compatibly ends with its last symbol alone
        last = [self.single[x] for x in letters]
        sizes, compatible, count, done = [1] * len(letters), self.compatible, self.count, -1
        for end, (size, token) in self.automaton.iter(letters):
            if end != done and (size > end or compatible[last[end - size] * count + token]):
                last[end], sizes[end], done = token, size, end
        out, at = [], len(letters) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        return tuple(out[::-1])

    def _chunk_ids(self, chunk: str) -> tuple[int, ...]:
        found = self.pattern.findall(chunk)
        return self.word_ids[found[0]] if len(found) == 1 else tuple([i for w in found for i in self.word_ids[w]])

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str, str]:
        ids = self._chunk_ids(chunk)
        return ids, " ".join([self.names[i] for i in ids]), self.decode(ids)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() would look at the letters around a capital sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def _parts(self, text: str | None) -> list[str]:
        """The text cut at special tokens."""
        return self.cut.split(text or "") if self.cut else [text or ""]

    def encoded(self, text: str | None) -> list[tuple[tuple[int, ...], str, str]]:
        """(ids, ids as text, decoded text) of the chunks of a whole text that have tokens."""
        out: list[tuple[tuple[int, ...], str, str]] = []
        for part in self._parts(text):
            if part in self.special:
                out.append(((self.special[part],), str(self.special[part]), part))
            elif part:
                out += [got for got in map(self.chunk.__getitem__, self._chunks(part)) if got[0]]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self._parts(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for ids in map(self.chunk_ids.__getitem__, self._chunks(part)):
                    out += ids
        return out

    def decode(self, ids) -> str:
        """The tokens joined by a space, as a tokenizer file without decoder asks for; unknown ids are left out."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


@lru_cache(2)
def tokenizer(spec: str, remembered: int = REMEMBERED) -> WordBpe:
    return WordBpe(spec, remembered)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec, REMEMBERED_IDS)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.array(t.encode(x), np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) per row; null ids decode to the empty text."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) per row: the hashes of the ids and of the text decoded from them."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec)
        for batch in batches:
            counts, ids, texts = [], [], []
            for k in range(batch.num_rows):
                of, names, decoded = list(zip(*t.encoded(batch.column(1)[k].as_py()))) or ((), (), ())
                counts.append(sum(map(len, of)))
                ids.append(hashlib.sha256(" ".join(names).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join(decoded).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)

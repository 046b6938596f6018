"""Vector bin packing of examples into training sequences.

An example has a demand in three dimensions: tokens, segments (one a piece) and
loss-bearing tokens. A sequence has a limit in each. A task reads its examples
as a stream and keeps at most ``POOL`` of them open. When the pool is full it
fills one sequence by the dot-product heuristic: of the pieces that fit in every
dimension, the one whose demand has the largest product with what is left of
the limits, each dimension weighted by the pool's mean demand, so scarce
dimensions count more. When nothing fits whole, the longest piece is cut to fill
the rest. A sequence that still isn't full gives back its end until its length is
a power of two, where no padding is needed; so a task's last sequences are few
and short, and what is padded does not depend on the number of tasks. Nothing is
shuffled and no sequence spans tasks, so a lost task is simply run again.

Texts become ids by the byte-level BPE of a public tokenizer file. Its merges run
in tiktoken, with ranks that are read from the same file.

Edge cases: a null or empty text is the end id alone; a null id is carried along;
rows are examples of their own, so repeats do no harm; an empty table gives no
rows; a text longer than a sequence is cut into full ones and a rest; the special
token's string in a text gets its id; other columns are not read. An empty or
null array of ids makes no piece; a null mask means that every token bears loss.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import byte_letters, read_spec

#: Open pieces of a task.
POOL = 512
END_ID = 1
#: Sequence numbers of a task start at its partition number times this.
NUMBERS = 1 << 36
#: The split pattern of byte-level BPE files (a fixed value of the format; possessive runs keep it from backtracking).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class ByteBpe:
    """Ids of a byte-level BPE file without normalizer, as its own library gives them without special tokens added."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, split = data["model"], data["pre_tokenizer"]
        if (model["type"], split["type"], split["add_prefix_space"], split["use_regex"], data["normalizer"]) != ("BPE", "ByteLevel", False, True, None):
            raise ValueError("not a plain byte-level BPE file")
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("ids do not follow the order of merges")
        self.bpe = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str | None) -> bytes:
        """The ids, 32 bits each, little-endian."""
        out = []
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.append(array("I", self.bpe.encode_ordinary(part)).tobytes())
        return b"".join(out)


@lru_cache(2)
def tokenizer(spec: str) -> ByteBpe:
    return ByteBpe(spec)


class Piece(NamedTuple):
    """Part of an example: its ids from ``start`` on, of ``total``; ``mask`` marks loss-bearing ones (None: all)."""

    id: object
    start: int
    total: int
    ids: np.ndarray
    mask: np.ndarray | None

    @property
    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.mask is None else int(self.mask.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        head, tail = (None, None) if self.mask is None else (self.mask[:at], self.mask[at:])
        return self._replace(ids=self.ids[:at], mask=head), self._replace(start=self.start + at, ids=self.ids[at:], mask=tail)

    def prefix(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix within both."""
        if self.mask is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(np.cumsum(self.mask), loss, "right")))


class Packer:
    """The open pieces of one task. ``add`` and ``finish`` yield sequences (lists of pieces). Without ``cut``, only examples
    beyond a limit are cut, and sequences keep the padding that this leaves."""

    def __init__(self, limits: Limits, cut: bool = True) -> None:
        self.limits, self.cut = np.array([limits.tokens, limits.segments, limits.loss], float), cut
        self.pieces: list[Piece | None] = [None] * POOL
        self.demand, self.live, self.free = np.zeros((POOL, 3)), np.zeros(POOL, bool), list(range(POOL))[::-1]

    def _put(self, p: Piece) -> None:
        k = self.free.pop()
        self.pieces[k], self.demand[k], self.live[k] = p, p.demand, True

    def _take(self, k: int) -> Piece:
        self.live[k] = False
        self.free.append(k)
        p, self.pieces[k] = self.pieces[k], None
        return p

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        tokens, _, loss = self.limits.astype(int)
        while len(p.ids):
            head, p = p.split(p.prefix(tokens, loss))
            if len(head.ids) == tokens:
                yield [head]
                continue
            while not self.free:
                yield self._fill()
            self._put(head)

    def finish(self) -> Iterator[list[Piece]]:
        while self.live.any():
            yield self._fill()

    def _fill(self) -> list[Piece]:
        left, chosen = self.limits.copy(), []
        weight = self.demand[self.live].mean(0) / self.limits ** 3  # demand and rest, each as a share of its limit, times the mean share
        while left[0] > 0 and left[1] > 0 and self.live.any():
            fits = self.live & (self.demand <= left).all(1)
            if fits.any():
                p = self._take(int(np.where(fits, self.demand @ (weight * left), -1.0).argmax()))
            elif self.cut:
                k = int(np.where(self.live, self.demand[:, 0], -1.0).argmax())
                at = self.pieces[k].prefix(int(left[0]), int(left[2]))
                if not at:
                    break
                p, rest = self._take(k).split(at)
                self._put(rest)
            else:
                break
            chosen.append(p)
            left -= p.demand
        if self.cut and left[0] > 0:
            self._give_back(chosen)
        return chosen

    def _give_back(self, chosen: list[Piece]) -> None:
        """Back to the pool from the end, until the length is a power of two."""
        over = sum(len(p.ids) for p in chosen)
        over -= 1 << over.bit_length() - 1
        while over:
            p = chosen.pop()
            if len(p.ids) > over:
                head, p = p.split(len(p.ids) - over)
                chosen.append(head)
            over -= len(p.ids)
            self._put(p)


def _packed(examples: Iterator[Piece], kind: pa.DataType, limits: Limits, cut: bool, with_ids: bool) -> Iterator[pa.RecordBatch]:
    packer, number = Packer(limits, cut), TaskContext.get().partitionId() * NUMBERS
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*[r[:8] for r in rows])) or [()] * 8
        arrays = [pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(cols)]
        if with_ids:
            arrays.append(pa.array([r[8] for r in rows], pa.list_(pa.int32())))
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    def sequences() -> Iterator[list[Piece]]:
        for e in examples:
            yield from packer.add(e)
        yield from packer.finish()

    for sequence in sequences():
        offset = 0
        for p in sequence:
            tokens, _, loss = p.demand
            rows.append((p.id, p.start, tokens, zlib.crc32(p.ids), p.total, loss, number, offset, p.ids.astype(np.int32) if with_ids else None))
            offset += tokens
        number += 1
        if len(rows) >= 4096:
            yield batch()
    if rows:
        yield batch()


_OUT = "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each text's ids and ``END_ID``; all of them bear loss."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, first = tokenizer(spec.value), next(batches, None)
        if first is None:
            return

        def examples() -> Iterator[Piece]:
            for b in _chain(first, batches):
                for k in range(b.num_rows):
                    ids = np.frombuffer(t.encode(b.column(1)[k].as_py()) + end, "<u4")
                    yield Piece(b.column(0)[k].as_py(), 0, len(ids), ids, None)

        yield from _packed(examples(), first.schema.field(0).type, limits, True, with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, {_OUT}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def pack_examples(rows: DataFrame, limits: Limits = Limits(), cut: bool = False, id_col: str = "id", ids_col: str = "ids", mask_col: str | None = None) -> DataFrame:
    """One row per piece, with its ids, of examples that are token ids already: instruction data, whose ``mask_col`` (array of
    booleans, one a token) marks the tokens that bear loss. Examples that fit stay whole unless ``cut``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def examples() -> Iterator[Piece]:
            for b in _chain(first, batches):
                for k in range(b.num_rows):
                    ids, mask = np.array(b.column(1)[k].as_py() or [], "<u4"), b.column(2)[k].as_py()
                    if mask is not None and len(mask) != len(ids):
                        raise ValueError("the mask has not one entry a token")
                    yield Piece(b.column(0)[k].as_py(), 0, len(ids), ids, None if mask is None else np.array(mask, bool))

        yield from _packed(examples(), first.schema.field(0).type, limits, cut, True)

    mask = F.col(mask_col) if mask_col else F.lit(None).cast("array<boolean>")
    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), mask.alias("mask")).mapInArrow(run, f"id {kind}, {_OUT}, ids array<int>")
    return found.withColumnRenamed("id", id_col)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def sequences(pieces: DataFrame, tokens: int = Limits().tokens, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, segments): pieces with their ids put together, each id with the number of its segment (from 1), padded
    to ``tokens`` (segment 0) unless the length is a power of two. A group is one sequence."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = whole.select("sequence_id", F.flatten("p.ids").alias("ids"),
                         F.flatten(F.transform("p", lambda p, k: F.transform(p["ids"], lambda _: k + 1))).alias("segments"))
    n = F.size("ids")
    short = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(tokens - n)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids"),
                        F.concat("segments", F.array_repeat(F.lit(0), short)).alias("segments"))

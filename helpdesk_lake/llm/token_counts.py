"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character;
dynamic programming keeps, per place, the best sum of scores and the number of
pieces on that path, nothing else. The tie rule is the tokenizers' own: a later
candidate must be strictly better, and candidates for a place come with the
earliest start (the longest piece) first. A character that no piece covers alone
costs the lowest score less 10 and counts its UTF-8 bytes (byte fallback).

The text is taken as the vocabulary's library takes it: one space in front, spaces
as U+2581, nothing else changed. Pieces hold that sign at their start only, so
a text falls into independent units (signs and what follows them); scores are
whole numbers, so sums are exact and units can be counted one by one. Workers
remember the counts of ``REMEMBERED`` units.

Edge cases: a null or empty text has 0 tokens; a null id is carried along; rows
are counted one by one; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 250_000
SIGN, PENALTY = "▁", 10.0
_UNIT = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")


class PieceCounter:
    """Counts of the best segmentation under (piece, score) pairs."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]) -> None:
        if any(SIGN in p.lstrip(SIGN) for p, _ in pieces):
            raise ValueError("a piece holds the space sign after its start")
        if any(float(s) != int(s) for _, s in pieces):
            raise ValueError("scores must be whole numbers for exact sums")
        self.missing = min(s for _, s in pieces) - PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unit = lru_cache(REMEMBERED)(self._unit)

    def _unit(self, unit: str) -> int:
        n = len(unit)
        best, count, ends = [0.0] + [None] * n, [0] * (n + 1), [[] for _ in range(n)]
        for end, match in self.automaton.iter(unit):
            ends[end].append(match)
        for end in range(n):
            top, pieces = None, 0
            for size, score in ends[end]:  # longest first
                total = best[end + 1 - size] + score
                if top is None or total > top:
                    top, pieces = total, count[end + 1 - size] + 1
            if unit[end] not in self.single:
                total = best[end] + self.missing
                if top is None or total > top:
                    top, pieces = total, count[end] + len(unit[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        return sum(map(self.unit, _UNIT.findall(SIGN + text.replace(" ", SIGN)))) if text else 0


@lru_cache(2)
def counter(pieces: tuple[tuple[str, float], ...]) -> PieceCounter:
    return PieceCounter(pieces)


def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a sentencepiece file's ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
                 if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) per row."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(pieces.value)
        for batch in batches:
            counts = [c.count(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, n_tokens bigint")
    return found.withColumnRenamed("id", id_col)

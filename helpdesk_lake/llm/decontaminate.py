"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

1. The runs of ``SEED`` words of the test items are the seeds. One pass over the
   training texts finds their hits (document, item, seed, position). Up to
   ``BROADCAST_SEEDS`` seeds go to the workers (16 bytes each); beyond that the
   texts' n-grams are joined with them by a shuffle.
2. A seed is common when it strays: when its hits in documents without another
   seed of the item (such documents are never aligned) stand among more different
   words than ``STRAY`` of the documents. Copies of a leaked passage bring
   ``MIN_SEEDS`` seeds together and copies of one text are one stray, so neither
   makes a seed common. Only rare seeds count from here on.
3. Where ``MIN_SEEDS`` different rare seeds of an item lie near each other, the
   surrounding window is aligned with the item: Smith-Waterman over words, match
   +1, mismatch and gap -1. A score of ``LEAST`` of the item's words and
   ``MIN_MATCHES`` matches make a leak.

Words here are runs of letters and digits of the lower-cased text, so that
punctuation, case and marks glued to words don't matter.

Edge cases: null and empty texts have no words; items of fewer than
``MIN_MATCHES`` words can't be told from chance and are never reported; rows
with a null id are not reported (and are kept by ``drop_leaks``); rows that
repeat an id count as parts of one document; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, gram_hashes, mixed, stored, word_hashes

SEED, MIN_SEEDS, MIN_MATCHES, LEAST = 3, 2, 6, 0.45
#: A seed may stray among so many different words (a share of the documents, or STRAY_ROWS) and still counts as rare.
STRAY, STRAY_ROWS = 0.001, 50
#: Grams on either side of a hit that tell one surrounding from another.
AROUND = 3
BROADCAST_SEEDS = 1_000_000
BROADCAST_IDS = 1_000_000
#: The items go to the workers up to so many characters in all, and are joined by a shuffle beyond.
BROADCAST_CHARS = 64_000_000

_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(tokens: list[str]) -> np.ndarray:
    return gram_hashes(word_hashes([w.encode("utf-8", "surrogatepass") for w in tokens]), SEED)


def align(item: list[str], window: list[str]) -> tuple[int, int, int, int]:
    """Best local alignment: (score, matches, first word, end word) within ``window``. Rows of the matrix are
    computed whole: gaps along the window are a running maximum."""
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    y = np.array([code.get(w, -1) for w in window], np.int64)
    m, at = len(y), np.arange(len(y) + 1, dtype=np.int64)
    h = np.zeros((len(item) + 1, m + 1), np.int64)
    for i, w in enumerate(item, 1):
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(np.maximum(h[i - 1, :-1] + np.where(y == code[w], 1, -1), h[i - 1, 1:] - 1), 0)
        h[i] = np.maximum.accumulate(row + at) - at
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    score, end, matches = int(h[i, j]), j, 0
    while i and j and h[i, j] > 0:
        same = y[j - 1] == code[item[i - 1]]
        if h[i, j] == h[i - 1, j - 1] + (1 if same else -1):
            matches += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, j, end


def is_leak(score: int, matches: int, item_words: int) -> bool:
    return matches >= MIN_MATCHES and score >= LEAST * item_words


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, places, grams = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = plain_words(text)
            if len(tokens) >= MIN_MATCHES:
                found = _grams(tokens).view(np.int64).tolist()
                items += [item] * len(found)
                places += range(len(found))
                grams += found
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(items, batch.schema.field(0).type), pa.array(places, pa.int32())],
                                         ["gram", "item", "place"])


def _finder(grams: np.ndarray) -> Callable:
    """Emits (id, pos, gram, around) of the words of each text that start a gram of ``grams`` (all grams if it is None);
    around: a hash of the words near it."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = None
        if grams is not None:
            sieve = np.zeros(1 << 20, bool)
            sieve[(grams >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, spots, found, near_by = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    h = _grams(plain_words(text))
                    if sieve is not None:
                        spot = np.nonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])[0]
                        if len(spot):
                            near = np.minimum(np.searchsorted(grams, h[spot]), len(grams) - 1)
                            spot = spot[grams[near] == h[spot]]
                    else:
                        spot = np.arange(len(h))
                    if len(spot):
                        rows.append(np.full(len(spot), k))
                        spots.append(spot)
                        found.append(h[spot])
                        near_by.append(mixed(mixed(h[np.maximum(spot - AROUND, 0)]) ^ mixed(h[spot] ^ h[np.minimum(spot + AROUND, len(h) - 1)])))
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(spots), pa.int32()),
                                                      pa.array(np.concatenate(found).view(np.int64), pa.int64()), pa.array(np.concatenate(near_by).view(np.int64), pa.int64())],
                                                     ["id", "pos", "gram", "around"])
    return find


def seed_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, bound: int) -> DataFrame:
    """(id, item, place, pos, around): word ``pos`` of the document starts the seed at word ``place`` of the item."""
    item_type = items.schema[item_col].dataType.simpleString()
    seeds = stored(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("t"))
                   .mapInArrow(_seed_rows, f"gram bigint, item {item_type}, place int"), "seeds")
    few = seeds.count() <= bound
    grams = np.array(sorted({r[0] % 2**64 for r in seeds.select("gram").distinct().collect()}), np.uint64) if few else None
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if few and not len(grams):
        texts = texts.limit(0)
    hits = texts.mapInArrow(_finder(grams), f"id {docs.schema[id_col].dataType.simpleString()}, pos int, gram bigint, around bigint")
    return stored(hits.join(F.broadcast(seeds) if few else seeds, "gram").select("id", "item", "place", "pos", "around"), "hits")


def rare_groups(hits: DataFrame, documents: int) -> DataFrame:
    """(id, item, hits): the hits of rare seeds, for documents and items that share MIN_SEEDS of them."""
    pair = hits.groupBy("id", "item").agg(F.countDistinct("place").alias("seeds"))
    stray = (hits.join(pair.where(F.col("seeds") < MIN_SEEDS), ["id", "item"]).select("item", "place", "around").distinct()
             .groupBy("item", "place").agg(F.count(F.lit(1)).alias("strays")))
    common = stray.where(F.col("strays") > max(STRAY_ROWS, STRAY * documents)).select("item", "place")
    rare = hits.join(common, ["item", "place"], "left_anti")
    return (rare.groupBy("id", "item").agg(F.sort_array(F.collect_set(F.struct("pos", "place"))).alias("hits"))
            .where(F.size(F.array_distinct(F.transform("hits", lambda x: x["place"]))) >= MIN_SEEDS))


def _windows(hits: list, length: int) -> list[tuple[int, int]]:
    """Spans of words around hits that lie near each other and are of MIN_SEEDS different seeds."""
    slack, found, group = 8 + length // 4, [], []
    for pos, place in [*hits, (1 << 60, 0)]:
        if group and pos - group[-1][0] > 2 * length + slack:
            if len({q for _, q in group}) >= MIN_SEEDS:
                found.append((max(0, min(p - q for p, q in group) - slack), max(p - q for p, q in group) + length + slack))
            group = []
        group.append((pos, place))
    return found


def _aligner(items: dict | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tokens = plain_words(r["t"])
                for g in r["groups"]:
                    item = items[g["item"]] if items is not None else plain_words(g["item_text"])
                    best = None
                    for a, b in _windows([(x["pos"], x["place"]) for x in g["hits"]], len(item)):
                        window = tokens[a:b]
                        if window:
                            score, matches, start, end = align(item, window)
                            if is_leak(score, matches, len(item)) and (best is None or score > best[0]):
                                best = (score, matches, a + start, a + end)
                    if best:
                        out.append((r["id"], g["item"], best[0] / len(item), *best[1:]))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (
                batch.schema.field(0).type, _item_type(batch), pa.float64(), pa.int32(), pa.int32(), pa.int32()))],
                ["doc", "item", "score", "matches", "first_word", "end_word"])
    return run


def _item_type(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field("groups").type.value_type.field("item").type


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", bound: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document and test item found in it: (id_col, item_col, score as a share of the item's words, matches,
    first_word, end_word in the document)."""
    ids, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    hits = seed_hits(docs, items, id_col, text_col, item_col, item_text, bound)
    groups = rare_groups(hits, docs.select(id_col).count())
    text = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("item_text")).groupBy("item").agg(F.max("item_text").alias("item_text"))
    few_items = (text.agg(F.sum(F.length("item_text"))).first()[0] or 0) <= BROADCAST_CHARS
    words_of = {r[0]: plain_words(r[1]) for r in text.collect()} if few_items else None
    if not few_items:
        groups = groups.join(text, "item")
    groups = stored(groups.groupBy("id").agg(F.collect_list(F.struct(*[c for c in groups.columns if c != "id"])).alias("groups")), "groups")
    few = groups.count() <= BROADCAST_IDS
    wanted = groups.select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    found = texts.join(groups, "id").select("id", "t", "groups").mapInArrow(
        _aligner(words_of), f"doc {ids}, item {item_kind}, score double, matches int, first_word int, end_word int")
    best = found.groupBy("doc", "item").agg(F.max(F.struct("score", "matches", (-F.col("first_word")).alias("f"), "end_word")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.score", "b.matches",
                       (-F.col("b.f")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without a leak, with their own columns."""
    plain, name = aside(docs)
    gone = stored(leaks(docs, items, id_col).select(F.col(id_col).alias("_gone")).distinct(), "leaky")
    few = gone.count() <= BROADCAST_IDS
    return plain.join(F.broadcast(gone) if few else gone, F.col(name[id_col]) == F.col("_gone"), "left_anti").toDF(*docs.columns)

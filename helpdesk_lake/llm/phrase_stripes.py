"""Phrases of two and three words by stripes.

Each first word keys a stripe: an associative counter of the words that follow
it, and under each of them of the words that follow both (0: the piece ends).
A task turns texts into word hashes with numpy, makes the stripes of some
million words at a time, and sends them on; a reducer reads its stripes sorted by
key and merges them element by element. One merged stripe gives it all: the
counts of the extensions (three words), the total of each two-word prefix, and
for that prefix the largest extension, by which it may be subsumed. The largest
extension to the left is that of the same counts grouped by their last two
words.

* A common first word would be a hot key: words with more than ``SEGMENT``
  occurrences have their stripe cut by a hash of what follows, so no reducer
  group holds more than about that many occurrences. Of such words, at most
  ``HOT_WORDS`` exist, as the segment grows with the corpus beyond that; only they
  are sent to the tasks. What follows is dealt by the second word; only
  where both are common, by the two words that follow, and the totals of such
  pairs are added up afterwards.
* Words are known by 64-bit hashes; their texts and counts are a table of their
  own. Only counts of ``LEAST`` and more leave the reducers, except the parts of cut
  totals.
* Products are exact (decimals of 38 digits; counts below 10^15).
* The report of the first ``TOP`` phrases is chosen in two steps, by buckets of
  phrases, then by language.

Edge cases: a null language is ``und``, and any other string, the empty one
included, is a language of its own; null and empty texts and pieces without words
add nothing; repeated rows count each time; equal scores are ordered by count,
then by phrase in byte order; an empty table gives no rows; other columns are
not read. Whole texts are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, stored, word_hashes

LEAST, TOP, SUBSUMED = 10, 2000, 50
SEGMENT, HOT_WORDS = 1 << 18, 1 << 18
#: Bytes of text hashed at once, words whose stripes are made together, elements merged at once, buckets of the first ranking step.
SLAB, FLUSH, MERGE, BUCKETS = 1 << 20, 1 << 20, 1 << 19, 16
UNKNOWN = "und"
#: A-Z in lower case; all piece ends as full stops, all spaces as spaces (these bytes occur in no other character).
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_END, _SPACE = ord("."), ord(" ")
_CODE = mixed(np.arange(256, dtype=np.uint64))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words and piece ends of folded text, in order; an end has hash 0. A word's hash adds up a code of
    each byte times a code of its place, modulo 2^64, and is mixed at last."""
    b = np.frombuffer(data, np.uint8)
    end = b == _END
    gap = end | (b == _SPACE)
    inner = ~gap
    first = inner.copy()
    first[1:] &= gap[:-1]
    last = inner.copy()
    last[:-1] &= gap[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = stops - starts
    chars = b[inner]
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = mixed(np.arange(int(sizes.max()) if len(sizes) else 0, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    h = np.add.reduceat(_CODE[chars] * codes[place], np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0, np.uint64)
    h = np.maximum(mixed(h ^ sizes.astype(np.uint64)), np.uint64(1))
    ends = np.flatnonzero(end)
    order = np.argsort(np.concatenate([starts, ends]), kind="stable")
    return (np.concatenate([h, np.zeros(len(ends), np.uint64)])[order], np.concatenate([starts, ends])[order], np.concatenate([stops, ends])[order])


def _slabs(texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, bytes]]:
    """Folded texts of a language joined to slabs of about SLAB bytes, each ending with a piece or a word; a long text is cut at a space."""
    pending: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for lang, text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_FOLD) + b"."
        while len(data) > 2 * SLAB and (at := data.find(b" ", SLAB)) >= 0:
            pending[lang].append(data[:at + 1])  # no end: the next slab goes on with the same piece
            yield lang, b"".join(pending.pop(lang))
            size[lang], data = 0, data[at + 1:]
        pending[lang].append(data)
        size[lang] += len(data)
        if size[lang] >= SLAB:
            yield lang, b"".join(pending.pop(lang))
            size[lang] = 0
    for lang, parts in pending.items():
        if parts:
            yield lang, b"".join(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        for k in range(b.num_rows):
            text = b.column(1)[k].as_py()
            if text:
                yield b.column(0)[k].as_py(), text


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, word, c) of the slabs."""
    counts: dict[str, dict[int, list]] = defaultdict(dict)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            keys = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(keys), pa.array([v[0] for v in found.values()], pa.string()),
                                              pa.array([v[1] for v in found.values()], pa.int64())], ["lang", "h", "word", "c"])
        counts.clear()

    for lang, data in _slabs(_rows(batches)):
        h, start, end = hashed_words(data)
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        found = counts[lang]
        for k, a, b, n in zip(u.tolist(), start[first].tolist(), end[first].tolist(), c.tolist()):
            if k:
                if k in found:
                    found[k][1] += n
                else:
                    found[k] = [data[a:b].decode("utf-8", "surrogatepass"), n]
        if sum(map(len, counts.values())) >= FLUSH // 8:
            yield from flush()
    yield from flush()


def _stripes(hot: Broadcast):
    """Word hashes of some million words -> (k, lang, w1, part, w2, w3, c): one row per stripe, or per segment of a common word's.
    ``hot``: language -> sorted hashes of common words, their numbers of segments. What follows a common word is dealt by the
    second word, and if that is common too, by both words (``part`` 1: the total of such a pair lies in several rows)."""
    def made(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([*parts, np.zeros(2, np.uint64)])
        words, w = np.unique(h, return_inverse=True)  # 0, the end, comes first
        at = np.flatnonzero((w[:-2] > 0) & (w[1:-1] > 0))
        if not len(at):
            return
        size = len(words)
        pair, of = np.unique(w[at] * size + w[at + 1], return_inverse=True)
        triple, c = np.unique(of * size + w[at + 2], return_counts=True)
        pair = pair[triple // size]
        first, second, w2, w3 = pair // size, pair % size, words[pair % size], words[triple % size]
        part = segment = np.zeros(len(first), np.int64)
        if lang in hot.value:
            common, segments = hot.value[lang]
            place = np.minimum(np.searchsorted(common, words), len(common) - 1)
            cuts = np.where(common[place] == words, segments[place], 1)
            part = ((cuts[first] > 1) & (cuts[second] > 1)).astype(np.int64)
            segment = (mixed(np.where(part == 1, mixed(w2) ^ w3, w2)) % cuts[first].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, segment, first))
            first, w2, w3, c, part, segment = (x[order] for x in (first, w2, w3, c, part, segment))
        head = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in (first, segment, part)], axis=0)])
        w1 = words[first[head]]
        key = mixed(mixed(w1 ^ word_hashes([lang.encode()])[0]) + (2 * segment + part)[head].astype(np.uint64)).view(np.int64)
        for a in range(0, len(head), 20_000):
            stop = min(a + 20_000, len(head))
            ends = np.r_[head[a:stop], head[stop] if stop < len(head) else len(first)]
            inside, offsets = slice(ends[0], ends[-1]), pa.array((ends - ends[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[inside])) for x in (w2.view(np.int64), w3.view(np.int64), c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(key[a:stop]), pa.array([lang] * (stop - a)), pa.array(w1[a:stop].view(np.int64)),
                                              pa.array(part[head[a:stop]].astype(np.int32)), *lists], ["k", "lang", "w1", "part", "w2", "w3", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[np.ndarray]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        for lang, data in _slabs(_rows(batches)):
            h = hashed_words(data)[0]
            whole = len(data) and data[-1] == _END
            pending[lang].append(h)
            size[lang] += len(h)
            if whole and size[lang] >= FLUSH:
                yield from made(lang, pending.pop(lang))
                size[lang] = 0
        for lang, parts in pending.items():
            if parts:
                yield from made(lang, parts)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by key -> (lang, w1, w2, w3, c, top): extensions (w3 given), and totals of two-word prefixes with their
    largest extension (w3 null)."""
    waiting: list[tuple] = []  # flat elements: (key, lang, w1, part, w2, w3, c), langs as numbers
    number, names = {}, []

    def flat(b: pa.RecordBatch) -> tuple:
        for x in b.column(1).unique().to_pylist():
            if x not in number:
                number[x] = len(names)
                names.append(x)
        lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
        sizes = np.diff(b.column(4).offsets.to_numpy())
        per_row = [b.column(0).to_numpy(), lang, b.column(2).to_numpy(), b.column(3).to_numpy().astype(np.int64)]
        return (*[np.repeat(x, sizes) for x in per_row], *[b.column(k).flatten().to_numpy().astype(np.int64) for k in (4, 5, 6)])

    def summed(x: tuple) -> tuple:
        key, lang, w1, part, w2, w3, c = x
        order = np.lexsort((w3, w2, key))  # a key stands for one language, first word and segment
        key, lang, w1, part, w2, w3, c = (v[order] for v in (key, lang, w1, part, w2, w3, c))
        head = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in (key, w2, w3)], axis=0)])
        return (*[v[head] for v in (key, lang, w1, part, w2, w3)], np.add.reduceat(c, head))

    def results(x: tuple) -> Iterator[pa.RecordBatch]:
        key, lang, w1, part, w2, w3, c = x
        if not len(c):
            return
        head = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in (key, w2)], axis=0)])
        total = np.add.reduceat(c, head)
        longer = (w3 != 0) & (c >= LEAST)
        top = np.maximum.reduceat(np.where(longer, c, 0), head)
        keep = (part[head] > 0) | (total >= LEAST)
        some, ext = head[keep], np.flatnonzero(longer)
        at, is_prefix = np.r_[some, ext], np.r_[np.ones(len(some), bool), np.zeros(len(ext), bool)]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang[at].tolist()], pa.string()), pa.array(w1[at]), pa.array(w2[at]), pa.array(w3[at], mask=is_prefix),
                                          pa.array(np.r_[total[keep], c[ext]]), pa.array(np.r_[top[keep], np.zeros(len(ext), np.int64)])],
                                         ["lang", "w1", "w2", "w3", "c", "top"])

    def joined() -> tuple:
        return tuple(np.concatenate(v) for v in zip(*waiting))

    pending, limit = 0, MERGE
    for b in batches:
        for a in range(0, b.num_rows, 2000):
            part = flat(b.slice(a, 2000))
            waiting.append(part)
            pending += len(part[0])
            if pending >= limit:
                x = summed(joined())
                last = np.searchsorted(x[0], x[0][-1]) if len(x[0]) else 0  # rows come sorted by key: all groups but the last are whole
                yield from results(tuple(v[:last] for v in x))
                waiting[:] = [tuple(v[last:] for v in x)]
                pending = len(x[0]) - last
                limit = pending + MERGE
    if waiting:
        yield from results(summed(joined()))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, h, word, c): every word's occurrences."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_word_counts, "lang string, h long, word string, c long").groupBy("lang", "h", "word").agg(F.sum("c").alias("c"))


def merged_stripes(docs: DataFrame, words: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, w1, w2, w3, c, top) of all stripes, see ``_merge``."""
    segment = max(SEGMENT, -(-(words.agg(F.sum("c")).first()[0] or 0) // HOT_WORDS))
    common = words.where(F.col("c") > segment).select("lang", "h", "c").toPandas()  # at most HOT_WORDS rows
    common = common.assign(h=common.h.to_numpy(np.int64).view(np.uint64), c=-(-common.c // segment)).sort_values("h")
    hot = docs.sparkSession.sparkContext.broadcast({lang: (g.h.to_numpy(), g.c.to_numpy(np.int64)) for lang, g in common.groupby("lang")})
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    stripes = rows.mapInArrow(_stripes(hot), "k long, lang string, w1 long, part int, w2 array<long>, w3 array<long>, c array<int>")
    return stripes.repartition("k").sortWithinPartitions("k").mapInArrow(_merge, "lang string, w1 long, w2 long, w3 long, c long, top long")


def scored_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one subsumes."""
    words = stored(word_counts(docs, lang_col, text_col), "words")
    merged = stored(merged_stripes(docs, words, lang_col, text_col), "merged")
    n = words.groupBy("lang").agg(F.sum("c").alias("n"))
    word = words.where(F.col("c") >= LEAST).select("lang", "h", "word", F.col("c").alias("f"))
    three = merged.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("c").alias("a"))
    ends = three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(0).cast("long").alias("c"), F.col("a").alias("top"))
    two = (merged.where("w3 IS NULL").select("lang", "w1", "w2", "c", "top").unionByName(ends)
           .groupBy("lang", "w1", "w2").agg(F.sum("c").alias("a"), F.max("top").alias("top")).where(F.col("a") >= LEAST))
    two = stored(two, "two")

    def text(k: int) -> DataFrame:
        return word.select("lang", F.col("h").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"))

    pairs = (two.where(100 * F.col("top") < SUBSUMED * F.col("a")).join(text(1), ["lang", "w1"]).join(text(2), ["lang", "w2"])
             .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")))
    left, right = two.select("lang", "w1", "w2", F.col("a").alias("a12")), two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    triples = (three.join(left, ["lang", "w1", "w2"]).join(right, ["lang", "w2", "w3"]).join(text(1), ["lang", "w1"]).join(text(2), ["lang", "w2"])
               .join(text(3), ["lang", "w3"]).withColumn("s1", _score("a", "f1", "a23")).withColumn("s2", _score("a", "a12", "f3")))
    one = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(one, F.col("f1")).otherwise(F.col("a12")).alias("l"),
                             F.when(one, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionByName(triples).join(n, "lang")


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r))"""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(15, 0)) * CAST({a} AS DECIMAL(15, 0)) * 1000000) div (CAST({left} AS DECIMAL(15, 0)) * CAST({right} AS DECIMAL(15, 0))) AS LONG)")


def collocations(docs: DataFrame, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = scored_phrases(docs, lang_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

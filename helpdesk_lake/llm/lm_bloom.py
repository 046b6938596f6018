"""Language-model scores from a log-frequency Bloom filter.

Training counts of words and word pairs come from one pass over the training
texts: tasks count runs of tokens with numpy, Spark adds the counts up. A count c
is quantised to the level ``1 + floor(log2(c / cutoff))``; the filter holds one
entry for each level from 1 up to that, so a count is read back by probing level
after level until a probe misses. The filter is blocked: all bits of an n-gram
lie in the block that its hash names, so blocks are built side by side, each by
one task, from its own n-grams.

There are as many blocks as all levels of all n-grams ask for at ``BITS`` bits
each. One filter holds the words and the pairs seen twice or more, a second one
the pairs seen once. Up to ``FILTER_BYTES`` they are broadcast. Beyond that, the
blocks are broadcast in groups of that size, at most ``GROUPS`` of them: a task looks
a run of tokens up in one group after the other and holds one of them at a time, so
nothing about the texts is written. Still larger filters stay a table, the distinct
n-grams of the texts are probed in the block of each, and the estimates are joined
with the texts by a shuffle. All three are the same model.

Model: tokens are the words of a text and one end; every text starts after an
end. P(w | u) = g * c(u, w) / c(u) + (1 - g) * (c(w) + 0.5) / (N + 0.5 * (V + 1)),
g = ``PAIR_WEIGHT`` where u is known and 0 otherwise, with counts as the filter gives them.

``base_score`` takes exact counts: words seen often (at most ``FREQUENT`` of
them, chosen by a count threshold) are looked up in a broadcast table, the others
of each text are joined with the counts by a shuffle. Words are 63-bit hashes.

Edge cases: null and empty texts are one end token; null ids are learned from
and not held out; rows that repeat are learned from and scored one by one; an
empty table gives no rows, and with nothing to learn from N = V = 0; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mixed, stored, word_hashes, words

FILTER_BYTES, BITS, PROBES, BLOCK_BITS, LEVELS = 64 << 20, 8, 3, 1 << 17, 40
PAIR_WEIGHT, FREQUENT, RUN = 0.4, 1 << 17, 1_000_000
#: So many groups of blocks are broadcast at most: they lie on every executor's disk.
GROUPS = 32
_TOP = np.uint64(1 << 63)
#: The end token's hash; words are hashed with the top bit cleared, pairs have it set.
END = np.uint64(0x2545F4914F6CDD1D)


def token_hashes(text: str | None) -> np.ndarray:
    """Word hashes of a whole text and the end."""
    return np.append(word_hashes(words(text)) & ~_TOP, END)


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Of each token with the one before; the first follows an end, as does the first of each next text."""
    before = np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens
    return mixed(mixed(before) ^ tokens) | _TOP


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        keys, counts = np.unique(np.concatenate([tokens, pair_hashes(tokens)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "c"])

    for batch in batches:
        for k in range(batch.num_rows):
            held.append(token_hashes(batch.column(0)[k].as_py()))
            size += len(held[-1])
            if size >= RUN:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def counts(texts: DataFrame) -> DataFrame:
    """(key, c) of the single string column of ``texts``: every word (key >= 0) and every pair (key < 0)."""
    parts = texts.mapInArrow(_count, "key bigint, c bigint")
    return stored(parts.groupBy("key").agg(F.sum("c").alias("c")), "counts")


@dataclass
class LogBloom:
    """``bits``: the blocks' bytes one after another; cutoffs for words and for pairs. Of ``blocks`` in all, these begin with ``first``."""

    bits: np.ndarray
    cutoffs: tuple[int, int]
    blocks: int | None = None
    first: int = 0

    def estimates(self, keys: np.ndarray) -> np.ndarray:
        """``level`` of words and pairs."""
        out, pairs = np.zeros(len(keys)), keys >= _TOP
        for own, cutoff in zip((~pairs, pairs), self.cutoffs):
            out[own] = self.level(keys[own], cutoff)
        return out

    def level(self, keys: np.ndarray, cutoff: int) -> np.ndarray:
        """Estimated counts: 0, or the middle of the level's range."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        blocks = self.blocks or len(self.bits) * 8 // BLOCK_BITS
        if not blocks:
            return out.astype(float)
        base = ((mixed(keys) % np.uint64(blocks)).astype(np.int64) - self.first) * BLOCK_BITS
        for j in range(1, LEVELS):
            h = _level_hash(keys[left], j)
            for i in range(PROBES):  # most misses show at the first probe
                at = base[left] + _place(h, i)
                there = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                left, h = left[there], h[there]
            if not len(left):
                break
            out[left] = j
        return np.where(out > 0, cutoff * 1.5 * 2.0 ** (out - 1), 0.0) if cutoff > 1 else np.where(out > 1, 1.5 * 2.0 ** (out - 1), out.astype(float))


@dataclass
class GroupedBloom:
    """A filter whose blocks are broadcast in groups of ``size`` (bytes of their bits each); one group is held at a time."""

    groups: list
    cutoffs: tuple[int, int]
    blocks: int
    size: int

    def estimates(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        group = (mixed(keys) % np.uint64(max(self.blocks, 1))).astype(np.int64) // self.size
        for k, shared in enumerate(self.groups):
            own = np.flatnonzero(group == k)
            if len(own):
                bits = np.frombuffer(_read(shared), np.uint8)
                out[own] = LogBloom(bits, self.cutoffs, self.blocks, k * self.size).estimates(keys[own])
        return out


def _read(shared) -> bytes:
    """A broadcast's value, read from the executor's disk each time, so that the worker does not keep it."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path else shared.value


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys ^ np.uint64(0x9E3779B97F4A7C15 * level % 2**64))


def _place(h: np.ndarray, probe: int) -> np.ndarray:
    return ((h >> np.uint64(20 * probe)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def bit_places(keys: np.ndarray, level: int) -> list[np.ndarray]:
    h = _level_hash(keys, level)
    return [_place(h, i) for i in range(PROBES)]


def _cutoff(histogram: dict[int, int], start: int, most_bits: int) -> tuple[int, int]:
    """The smallest cutoff start * 2**k whose levels fit, and the bits that they take. histogram: n-grams by floor(log2(count))."""
    at = start.bit_length() - 1
    while True:
        bits = BITS * sum(n * (level - at + 1) for level, n in histogram.items() if level >= at)
        if bits <= most_bits:
            return 1 << at, bits
        at += 1


def _plan(table: DataFrame, starts: tuple[int, int], filter_bytes: int | None = None) -> tuple[tuple[int, int], int]:
    """(cutoffs, blocks) of a filter: the cutoffs that are asked for, unless ``filter_bytes`` bound it."""
    level = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    found = table.groupBy((F.col("key") < 0).alias("pair"), level.alias("level")).count().collect()
    histograms = [{r["level"]: r["count"] for r in found if r["pair"] == pair} for pair in (False, True)]
    most = float("inf") if filter_bytes is None else filter_bytes * 4
    (low_1, bits_1), (low_2, bits_2) = (_cutoff(h, start, most) for h, start in zip(histograms, starts))
    blocks = -(-(bits_1 + bits_2) // BLOCK_BITS)
    # blocks of an even number fit the bound; a block never fills up, its bits only grow denser
    return (low_1, low_2), blocks if filter_bytes is None else min(filter_bytes * 8 // BLOCK_BITS, blocks)


def _block_rows(table: DataFrame, cutoffs: tuple[int, int], blocks: int) -> DataFrame:
    """(block, bits): the blocks that hold anything, each made by one task from its own n-grams."""
    low_1, low_2 = cutoffs

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, c = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            block = (mixed(keys) % np.uint64(blocks)).astype(np.int64)
            top = np.floor(np.log2(c / np.where(keys >= _TOP, low_2, low_1))).astype(np.int64) + 1
            order = np.argsort(block, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if not len(rows):
                    continue
                bits = made.setdefault(int(block[rows[0]]), np.zeros(BLOCK_BITS // 8, np.uint8))
                for j in range(1, int(top[rows].max()) + 1):
                    for p in bit_places(keys[rows[top[rows] >= j]], j):
                        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        for k, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((mixed(keys) % np.uint64(blocks)).astype(np.int64))], ["key", "c", "block"])

    held = table.where(F.col("c") >= F.when(F.col("key") < 0, F.lit(low_2)).otherwise(F.lit(low_1))).mapInArrow(named, "key bigint, c bigint, block bigint")
    return held.repartition("block").select("key", "c").mapInArrow(build, "block bigint, bits binary")


def _collected(table: DataFrame, cutoffs: tuple[int, int], blocks: int) -> LogBloom:
    return LogBloom(_bits(_block_rows(table, cutoffs, blocks).collect() if blocks else [], 0, blocks), cutoffs)


def _bits(rows: list, first: int, count: int) -> np.ndarray:
    """The bits of ``count`` blocks from ``first`` on; rows: (block, bits) of those that hold anything."""
    bits = np.zeros(count * BLOCK_BITS // 8, np.uint8)
    for k, b in rows:
        bits[(k - first) * BLOCK_BITS // 8:(k - first + 1) * BLOCK_BITS // 8] = np.frombuffer(b, np.uint8)
    return bits


def _grouped(spark: SparkSession, table: DataFrame | None, cutoffs: tuple[int, int], blocks: int, size: int) -> GroupedBloom:
    """The blocks of a table broadcast group by group; the driver holds one group at a time."""
    groups = []
    for first in range(0, blocks, size):
        rows = table.where(F.col("block").between(first, first + size - 1)).collect()
        groups.append(spark.sparkContext.broadcast(_bits(rows, first, min(size, blocks - first)).tobytes()))
    return GroupedBloom(groups, cutoffs, blocks, size)


def build_filter(table: DataFrame, filter_bytes: int | None = None) -> LogBloom:
    """A filter on the driver, of at most ``filter_bytes`` if that is given (rarer n-grams are left out then)."""
    return _collected(table, *_plan(table, (1, 2), filter_bytes))


@dataclass
class Model:
    """``bloom`` and ``once`` are None where ``spread`` holds the blocks as tables instead: [(block rows, cutoffs, blocks)] of both.
    ``group``: so many of those blocks are broadcast at a time; 0 where none are."""

    bloom: LogBloom | None
    once: LogBloom | None
    total: int
    distinct: int
    often: np.ndarray
    often_log: np.ndarray
    spread: list | None = None
    group: int = 0

    def base_log(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def log_probabilities(self, tokens: np.ndarray, words_of: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of each token after the one before; ``words_of[which]`` are the tokens, each word looked up once."""
        keys = pair_hashes(tokens)
        found = self.bloom.estimates(np.concatenate([words_of, np.array([END], np.uint64), keys]))
        one, end, pair = found[:len(words_of)][which], found[len(words_of):len(words_of) + 1], found[len(words_of) + 1:]
        context = np.concatenate([end, one[:-1]])
        none = np.flatnonzero(pair == 0)
        pair[none] = np.minimum(self.once.estimates(keys[none]), 1)
        pair = np.minimum(pair, np.minimum(one, context))
        g = np.where(context > 0, PAIR_WEIGHT, 0.0)
        unigram = (one + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        return np.log10(g * pair / np.maximum(context, 1.0) + (1 - g) * unigram)


def fit(texts: DataFrame, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model, and the exact counts (key, c) of its words."""
    table = counts(texts)
    own = table.where("key >= 0")
    total, distinct = own.agg(F.sum("c"), F.count(F.lit(1))).first()
    levels = {r["level"]: r["count"] for r in own.groupBy(F.floor(F.log2(F.col("c").cast("double"))).cast("int").alias("level")).count().collect()}
    least, held = max(levels, default=0) + 1, 0
    while least > 0 and held + levels.get(least - 1, 0) <= frequent:
        least -= 1
        held += levels.get(least, 0)
    often = sorted((r[0], r[1]) for r in own.where(F.col("c") >= 2**least).collect())
    parts = [table.where("key >= 0 or c >= 2"), table.where("key < 0 and c = 1")]
    plans = [_plan(t, starts) for t, starts in zip(parts, ((1, 2), (1, 1)))]
    size, group = filter_bytes * 8 // BLOCK_BITS, 0
    if sum(blocks for _, blocks in plans) <= size:
        blooms, spread = [_collected(t, *plan) for t, plan in zip(parts, plans)], None
    else:
        blooms, spread = [None, None], [(stored(_block_rows(t, *plan), "blocks") if plan[1] else None, *plan) for t, plan in zip(parts, plans)]
        group = size if size and sum(-(-blocks // size) for _, blocks in plans) <= GROUPS else 0
    model = Model(*blooms, int(total or 0), int(distinct), np.array([k for k, _ in often], np.uint64), np.zeros(0), spread, group)
    model.often_log = model.base_log(np.array([c for _, c in often], float))
    return model, own.where(F.col("c") < 2**least)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about half of ``RUN`` tokens (of some six bytes), so that a group is read for many texts at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 3 * RUN:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _probed(keys: DataFrame, blocks: DataFrame | None, cutoffs: tuple[int, int], count: int, name: str) -> DataFrame:
    """(key, name): the estimates of distinct keys by the filter's blocks, only those that are in."""
    if blocks is None:
        return keys.select("key", F.lit(0.0).alias(name)).limit(0)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((mixed(k) % np.uint64(count)).astype(np.int64))], ["key", "block"])

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:  # a block that no text asks for
            return pa.table({"key": pa.array([], pa.int64()), name: pa.array([], pa.float64())})
        k = asked.column("key").to_numpy().view(np.uint64)
        out = np.zeros(len(k))
        if held.num_rows:
            out = LogBloom(np.frombuffer(held.column("bits")[0].as_py(), np.uint8), cutoffs).estimates(k)
        return pa.table({"key": pa.array(k[out > 0].view(np.int64)), name: pa.array(out[out > 0])})

    return (keys.mapInArrow(named, "key bigint, block bigint").groupBy("block").cogroup(blocks.groupBy("block"))
            .applyInArrow(probe, f"key bigint, {name} double"))


def _spread_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) where the filters are tables; docs: row, text."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w = token_hashes(batch.column(1)[k].as_py())
                u = np.concatenate([[END], w[:-1]]).astype(np.uint64)
                pairs, at, times = np.unique(pair_hashes(w), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), k))), *[pa.array(x.view(np.int64)) for x in (u[at], w[at], pairs)],
                                                  pa.array(times, pa.int64())], ["row", "u", "w", "pair", "times"])

    rows = stored(docs.mapInArrow(grams, "row bigint, u bigint, w bigint, pair bigint, times bigint"), "grams")
    keys = rows.select(F.explode(F.array("u", "w", "pair")).alias("key")).distinct()
    (main, once) = model.spread
    known = stored(_probed(keys, *main, "est"), "estimates")
    single = stored(_probed(keys.where("key < 0"), *once, "est"), "singles")
    for side in ("u", "w", "pair"):
        rows = rows.join(known.select(F.col("key").alias(side), F.col("est").alias(f"{side}_c")), side, "left")
    rows = rows.join(single.select(F.col("key").alias("pair"), F.least("est", F.lit(1.0)).alias("once_c")), "pair", "left")
    u, w = (F.coalesce(f"{side}_c", F.lit(0.0)) for side in ("u", "w"))
    pair = F.least(F.coalesce("pair_c", "once_c", F.lit(0.0)), u, w)
    g = F.when(u > 0, F.lit(PAIR_WEIGHT)).otherwise(F.lit(0.0))
    log_p = F.log10(g * pair / F.greatest(u, F.lit(1.0)) + (1 - g) * (w + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
    return rows.groupBy("row").agg(F.sum(F.col("times") * log_p).alias("score"))


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row; ``rare``: exact counts of the words not in the broadcast table."""
    source = docs.select(id_col, text_col)
    spark, joined, grouped = docs.sparkSession, model.spread is not None and not model.group, None
    if model.group:
        grouped = [_grouped(spark, *part, model.group) for part in model.spread]
    if joined:  # rows keep their number, the filters' tables stay here
        source = stored(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    shared = spark.sparkContext.broadcast(replace(model, spread=None))
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(ids: pa.Array, each: list[np.ndarray]) -> pa.RecordBatch:
        m = shared.value if grouped is None else replace(shared.value, bloom=grouped[0], once=grouped[1])
        tokens, sizes = np.concatenate(each), np.array([len(t) for t in each])
        first = np.cumsum(sizes) - sizes
        words_of, which = np.unique(tokens, return_inverse=True)
        here, known = np.zeros(len(words_of), bool), np.zeros(len(words_of))
        if len(m.often):
            near = np.minimum(np.searchsorted(m.often, words_of), len(m.often) - 1)
            here = m.often[near] == words_of
            known = np.where(here, m.often_log[near], 0.0)
        here, known = here[which], known[which]
        log_p = m.log_probabilities(tokens, words_of, which) if m.bloom is not None else np.zeros(len(tokens))
        rest = [np.unique(t[~here[a:a + len(t)]], return_counts=True) for t, a in zip(each, first)]
        return pa.RecordBatch.from_arrays([
            ids, pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(here.astype(np.int64), first)),
            pa.array(np.add.reduceat(known, first)), pa.array(np.add.reduceat(log_p, first)),
            pa.array([r[0].view(np.int64) for r in rest], pa.list_(pa.int64())), pa.array([r[1].astype(np.int32) for r in rest], pa.list_(pa.int32()))],
            ["id", "n_tokens", "known", "base", "score", "keys", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches) if grouped else batches:
            at, each, size = 0, [], 0
            for k in range(batch.num_rows):
                each.append(token_hashes(batch.column(1)[k].as_py()))
                size += len(each[-1])
                if size >= (RUN // 2 if grouped else RUN // 8) or k + 1 == batch.num_rows:
                    yield scored(batch.column(0).slice(at, len(each)), each)
                    at, each, size = k + 1, [], 0

    columns = "n_tokens bigint, known bigint, base double, score double, keys array<bigint>, times array<int>"
    if not joined:
        rows = source.mapInArrow(run, f"id {kind}, {columns}")
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    else:
        rows = source.select("row", text_col).mapInArrow(run, f"id bigint, {columns}").withColumnRenamed("id", "row").drop("score")
        rows = stored(rows.join(_spread_scores(source.select("row", text_col), model), "row").join(source.select("row", F.col(id_col).alias("id")), "row"), "scored")
    tail = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("z")).select("row", F.col("z.keys").alias("key"), F.col("z.times").alias("times"))
    seen = tail.join(rare, "key").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - float(np.log10(0.5)))).alias("gain"))
    unseen = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double") * float(model.base_log(0.0))
    out = rows.select("row", "id", "n_tokens", "known", "score", (F.col("base") + unseen).alias("base")).join(seen, "row", "left")
    return out.select("id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
                      F.lit(model.total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score")


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; the fold crc32 % 5 = 1 is not learned from."""
    model, rare = fit(docs.where(~held_out(F.col("doc_id"), 5, 1)).select("text"))
    return score(docs, model, rare).select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 1).alias("held_out"),
                                           "n_tokens", "n_known", "train_tokens", "base_score", "score")

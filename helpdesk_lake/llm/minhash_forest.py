"""MinHash near-duplicates with an LSH forest.

Documents are sets of distinct five-word shingles; two are linked when
``100 * |A and B| >= percent * |A or B|``, 85 unless asked otherwise. The steps:

1. one pass over the texts: set size, a 128-bit fingerprint of the set and
   ``trees * LEAF`` minimum hashes. Rows with equal fingerprints are one set
   (a vertex); copies are never compared.
2. the forest, as banded prefixes in place of sorted orders: tree t labels a set by
   the minimum hashes from 3t on (wrapping around) and groups the sets by a hash of
   the first ``DEPTHS`` of them. A region (common prefix) of up to ``REGION`` sets
   makes all its pairs; in a denser region each member is paired with two leaders
   of its region at all the depths, which are fixed. So the candidates grow with the sets, not with the squares of
   the regions.
3. candidates are confirmed on the full shingle sets; links are contracted to
   components.
4. what the leaders may have missed: in a dense region whose members are not
   one component yet, pairs of different components are looked for without
   regard to regions, by prefix filtering: two such sets must share one of their
   rarest shingles. Sketches of ``SKETCH`` one-bit minimum hashes drop most pairs
   that are far from the threshold inside that join.

``Limits`` derives from the percentage how many trees there are (20 at 85) and how
far signatures and sketches of a link may differ: a pair at the threshold shares a
label of three hashes in no tree with a chance of at most ``MISS``, has fewer than
``likely`` equal hashes with one of at most ``UNLIKE``, and sketches that differ in
more than ``differ`` bits with one of at most ``SKEWED``. Shingles are 64-bit hashes.

Edge cases: a null or wordless text has the empty set (size 0) and is linked
with nothing; one to four words are one shingle; rows with a null id are
returned with a null component and kept; rows that repeat an id share its
component (a document is one vertex per distinct set, and its id belongs to all
of them); an empty table gives no rows. Extra columns are ignored, or kept by
``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, gram_hashes, mixed, stored, word_hashes, words
from .components import components

SHINGLE, PERCENT = 5, 85
LEAF = 3
DEPTHS = (LEAF, 6, 12)
#: A region of at most so many sets makes all its pairs.
REGION = 48
#: Chances that a pair at the threshold meets in no tree, that its signatures are too unlike for a member and its leader, that its sketches are.
MISS, UNLIKE, SKEWED = 6e-9, 1e-8, 8e-9
#: Ids that select texts are broadcast up to so many rows (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

#: Bits of a sketch.
SKETCH = 2048
#: Hash buckets whose counts order the shingles of the exact step (their counts reach the driver).
BUCKETS = 1 << 18

@dataclass(frozen=True)
class Limits:
    """What follows from the percentage of a link."""

    percent: int = PERCENT

    @cached_property
    def trees(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** LEAF)) if self.percent < 100 else 1

    @property
    def hashes(self) -> int:
        return self.trees * LEAF

    @cached_property
    def likely(self) -> int:
        """The most equal hashes that a pair at the threshold falls short of with a chance of at most UNLIKE."""
        return _quantile(self.hashes, self.percent / 100, UNLIKE)

    @cached_property
    def differ(self) -> int:
        """The fewest bits that its sketches exceed with a chance of at most SKEWED."""
        return SKETCH - _quantile(SKETCH, (1 + self.percent / 100) / 2, SKEWED)


def _quantile(count: int, share: float, chance: float) -> int:
    """The largest k for which fewer than k of ``count`` come true, each with probability ``share``, with at most ``chance``."""
    if share >= 1:
        return count
    below, k = 0.0, 0
    while True:
        below += math.exp(math.lgamma(count + 1) - math.lgamma(k + 1) - math.lgamma(count - k + 1) + k * math.log(share) + (count - k) * math.log1p(-share))
        if below > chance:
            return k
        k += 1


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    return (mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1))[:, None], mixed(np.arange(1001, count + 1001, dtype=np.uint64))[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    h = word_hashes(words(text))
    if not len(h):
        return h
    return np.unique(gram_hashes(h, SHINGLE)) if len(h) >= SHINGLE else gram_hashes(h, len(h)) ^ np.uint64(len(h))


def signature(found: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over a set, in blocks of bounded size."""
    by, plus = factors
    low = np.full(len(by), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 2048):
        low = np.minimum(low, ((found[at:at + 2048][None, :] * by + plus) >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint32).view(np.int32)


_SA = (mixed(np.arange(2001, SKETCH + 2001, dtype=np.uint64)) | np.uint64(1))[:, None]
_SB = mixed(np.arange(5001, SKETCH + 5001, dtype=np.uint64))[:, None]


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit of the minimum of each of SKETCH hash functions, as 64-bit words."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 512):
        low = np.minimum(low, ((found[at:at + 512][None, :] * _SA + _SB) >> np.uint64(32)).min(axis=1))
    return np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.int64)


def fingerprint(found: np.ndarray) -> bytes:
    return b"".join(int(mixed(found ^ np.uint64(k)).sum(dtype=np.uint64)).to_bytes(8, "big") for k in (0x51, 0xC3))


def _sign(hashes: int) -> Callable:
    factors = _factors(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, prints, signs = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text)
                    sizes.append(len(found))
                    prints.append(fingerprint(found) if len(found) else None)
                    signs.append(signature(found, factors) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                                                  pa.array(signs, pa.list_(pa.int32()))], ["id", "n", "fp", "sig"])
    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(id, n, fp, sig) per row; fp and sig are null for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sign(limits.hashes), f"id {kind}, n bigint, fp binary, sig array<int>")


def _near(limits: Limits, a: Column | str = "n", b: Column | str = "m"):
    return F.least(a, b) * 100 >= F.greatest(a, b) * limits.percent


def _pairs(rows: DataFrame, limits: Limits) -> DataFrame:
    """All pairs of sets within regions that have at most REGION rows."""
    other = rows.select("node", F.col("fp").alias("gp"), F.col("n").alias("m"))
    return rows.join(other, "node").where((F.col("fp") < F.col("gp")) & _near(limits)).select("fp", "gp")


def _leaders(rows: DataFrame, limits: Limits) -> DataFrame:
    """(fp, led) per set and region of at least two: the alike ones of the two leaders of its region, the first in one order over
    all sets, on which regions of like sets agree, and the first in the region's own order."""
    first = lambda *by: F.min(F.struct(F.xxhash64(*by).alias("h"), F.col("fp").alias("gp"), F.col("n").alias("m"), F.col("sig").alias("tig")))
    lead = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.array(first("fp"), first("fp", "node")).alias("leads")).where("c > 1").drop("c")
    same = lambda tig: F.size(F.filter(F.zip_with("sig", tig, lambda a, b: a == b), lambda x: x))
    fit = lambda l: (F.col("fp") != l["gp"]) & _near(limits, "n", l["m"]) & (same(l["tig"]) >= limits.likely)
    return rows.join(lead, "node").select("fp", F.transform(F.filter("leads", fit), lambda l: l["gp"]).alias("led")).where(F.size("led") > 0)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of regions with at least two sets, and the region's size."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.join(size, "node")


def candidates(sets: DataFrame, region: int = REGION, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (u, v), and the (node, fp) rows of dense regions."""
    label = F.concat("sig", F.slice("sig", 1, max(DEPTHS)))
    def nodes(depth: int):
        return F.transform(F.sequence(F.lit(0), F.lit(limits.trees - 1)), lambda t: F.xxhash64(t, F.slice(label, t * LEAF + 1, depth)))
    top = stored(_counted(sets.select(F.explode(nodes(LEAF)).alias("node"), "fp", "n")), "regions")
    dense = top.where(F.col("c") > region)
    found = _pairs(top.where(F.col("c") <= region), limits)
    deep = dense.groupBy("fp").agg(F.collect_set("node").alias("tops"))
    members = stored(sets.select("fp", "n", "sig").join(deep, "fp"), "members")
    # one row per set and dense region, with the regions below it in the same tree at all depths
    below = F.filter(F.arrays_zip(*[nodes(depth).alias(f"at{depth}") for depth in DEPTHS]), lambda z: F.array_contains("tops", z[f"at{LEAF}"]))
    rows = stored(members.select("fp", "n", "sig", F.explode(below).alias("z")).select("z.*", "fp", "n", "sig"), "below")
    led = [_leaders(rows.select(F.col(f"at{depth}").alias("node"), "fp", "n", "sig"), limits) for depth in DEPTHS]
    # trees and depths mostly agree on a set's leaders: each is listed once
    stars = (led[0].union(led[1]).union(led[2]).groupBy("fp").agg(F.array_distinct(F.flatten(F.collect_list("led"))).alias("led"))
             .select("fp", F.explode("led").alias("gp")).select(F.least("fp", "gp").alias("fp"), F.greatest("fp", "gp").alias("gp")))
    found = found.union(stars)
    return found.select(F.col("fp").alias("u"), F.col("gp").alias("v")).distinct(), dense.select("node", "fp")


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            got = {}
            for text in batch.column(0).slice(at, 256).to_pylist():
                found = shingles(text)
                if len(found):
                    got[fingerprint(found)] = found.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], ["fp", "items"])


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):  # the sets are read where they lie in the batch
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])
    return run


def set_items(docs: DataFrame, sets: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, items): the full shingle sets of the vertices in ``wanted`` (fp), from the text of each one's first document."""
    ids = stored(sets.join(wanted.select("fp").distinct(), "fp", "left_semi").select(F.col("rep").alias("id"), "fp"), "wanted")
    few = ids.count() <= BROADCAST_IDS
    one = ids.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(one) if few else one, "id", "left_semi")
    items = texts.select("text").mapInArrow(_text_sets, "fp binary, items binary")
    # repeated ids may bring other sets along, copies the same set again
    return stored(items.join(ids.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "items")


def confirmed(pairs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pairs (u, v) that hold on the full sets."""
    one, other = (items.select(F.col("fp").alias(end), F.col("items").alias(name)) for end, name in (("u", "x"), ("v", "y")))
    return stored(pairs.join(one, "u").join(other, "v").select("u", "v", "x", "y")
                  .mapInArrow(_confirm(limits.percent), "u binary, v binary"), "links")


def _roots(sets: DataFrame, parts: DataFrame) -> DataFrame:
    return sets.join(parts.select(F.col("vertex").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _rest(dense: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, n) of the sets in dense regions that hold more than one component."""
    rows = dense.join(roots.select("fp", "root"), "fp")
    mixed_up = rows.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("node")
    return roots.join(rows.join(mixed_up, "node", "left_semi").select("fp").distinct(), "fp", "left_semi").select("fp", "root", "n")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            np.add.at(total, (np.frombuffer(batch.column(0)[k].as_buffer(), np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "c"])


def _prefixes(often: np.ndarray, percent: int) -> Callable:
    """(fp, bits, rare): a set's sketch and its rarest shingles, by the counts of their buckets; those alone in a bucket are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, rare = [], []
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64)
                c = often[(items % np.uint64(BUCKETS)).astype(np.int64)]
                first = np.lexsort((items, c))[:len(items) - -(-len(items) * percent // 100) + 1]
                bits.append(sketch(items))
                rare.append(items[first[c[first] > 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64())), pa.array(rare, pa.list_(pa.int64()))], ["fp", "bits", "rare"])
    return run


def exact_pairs(rest: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pairs of different components among ``rest`` that may reach the threshold: each shares one of the rarest
    ``n - ceil(n * percent / 100) + 1`` shingles of both sides. Any one order of all shingles will do; it is by the counts of
    ``BUCKETS`` hash buckets, so that what many sets share comes last. A pair is emitted at the first rare shingle that
    it shares. The largest component is only looked up, never paired with itself."""
    own = items.join(rest.select("fp"), "fp", "left_semi").select("fp", "items")
    counts = own.select("items").mapInArrow(_bucket_counts, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts.column("bucket").to_numpy()] = counts.column("c").to_numpy()
    ready = stored(own.mapInArrow(_prefixes(often, limits.percent), "fp binary, bits array<bigint>, rare array<bigint>"), "prefixes")
    first = ready.join(rest, "fp").select("*", F.explode("rare").alias("item"))
    shared = first.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("item")
    first = first.join(shared, "item", "left_semi")
    top = rest.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).select("root")
    left = first.join(F.broadcast(top), "root", "left_anti")
    right = first.select("item", F.col("fp").alias("gp"), F.col("root").alias("goot"), F.col("n").alias("m"), F.col("rare").alias("sare"), F.col("bits").alias("cits"))
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("cits")[k])) for k in range(1, SKETCH // 64)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("cits")[0])))
    return (left.join(right, "item").where((F.col("root") != F.col("goot")) & _near(limits) & (differ <= limits.differ)
                                    & (F.array_intersect("rare", "sare")[0] == F.col("item")))
            .select(F.least("fp", "gp").alias("u"), F.greatest("fp", "gp").alias("v")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region: int = REGION,
                    percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``."""
    limits = Limits(percent)
    rows = stored(signatures(docs, id_col, text_col, limits), "signatures")
    named = rows.where(F.col("fp").isNotNull() & F.col("id").isNotNull())
    sets = stored(named.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    pairs, dense = candidates(sets, region, limits)
    pairs = stored(pairs, "pairs")
    # an id that repeats with other texts ties its sets together
    tied = named.groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("w")).where("u != w")
    tied = named.join(tied, "id").where("fp != u").select("u", F.col("fp").alias("v"))
    items = set_items(docs, sets, pairs.select(F.col("u").alias("fp")).union(pairs.select("v")), id_col, text_col)
    links = stored(confirmed(pairs, items, limits).union(tied), "all-links")
    roots = _roots(sets, components(links))
    rest = stored(_rest(dense, roots), "rest")
    if rest.limit(1).count():
        more_items = set_items(docs, sets, rest, id_col, text_col)
        more = confirmed(exact_pairs(rest, more_items, limits), more_items, limits)
        roots = _roots(sets, components(links.union(more)))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = roots.join(least, "root").select("fp", "component_id")
    out = rows.join(of_set, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs`` for one document of each group of near copies; rows that repeat a kept id whole stay one row."""
    plain, name = aside(docs)
    key = name[id_col]
    found = stored(near_duplicates(plain, key, name[text_col], percent=percent), "near")
    gone = found.where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct()
    again = found.groupBy(key).count().where("count > 1").select(F.col(key).alias("_gone")).where(F.col("_gone").isNotNull())
    few = gone.count() <= BROADCAST_IDS
    left = plain.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("_gone"), "left_anti")
    if again.limit(1).count():
        once = left.join(again, F.col(key) == F.col("_gone"), "left_semi").dropDuplicates([key])
        left = left.join(again, F.col(key) == F.col("_gone"), "left_anti").union(once)
    return left.toDF(*docs.columns)

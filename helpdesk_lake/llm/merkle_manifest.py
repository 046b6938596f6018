"""Merkle manifest of a document table, its octopus multiproofs, and their verification.

A leaf is H (lower-case hex SHA-256) of a row's fields. The leaves of a source, by
ascending id, make a tree whose runs of ``ARITY`` nodes become their H; the
subroots, by source, make one more tree (``ROOT_TREE``), whose top is the root.

* Places: one range shuffle of narrow rows, then counts by slice and source. No
  window, so a source with a third of all rows lies in many slices.
* Trees: one grouping by (tree, run) a level, over ever fewer nodes, for all
  sources at once; each level is written to the shared folder.
* Proofs: the ordered leaves are cut into parts of ``PART``, wherever sources begin.
  A part lists the smallest set of node coordinates that it can't derive from
  its own leaves (in the trees that it touches and in the root tree), fetches
  them in one join, derives the shared interior nodes once, and expands the
  proof of each leaf locally. High nodes, which many parts ask for, have a copy
  for each block of ``BLOCK`` leaves below their run, so no join key is asked for
  by more than BLOCK / PART parts.

Edge cases: a null field counts as ``-``; null ids and null sources come first; a
null source is a source of its own; equal ids are ordered by leaf, and rows that
are equal throughout get leaves of their own; a lone leaf is its source's
subroot, and has no siblings there (H of the empty text, if it is alone in the
table); a null id is never tampered with; an empty table gives no rows and no
root; other columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ARITY = 16
#: Leaves whose proofs one task expands together, and leaves that share a copy of the nodes above them.
PART, BLOCK = 1024, 65_536
ROOT_TREE = -1
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """``leaves``: (at, tree, pos, n, id, leaf, claimed), ``at`` being the place in the whole order, ``n`` the leaves of
    the tree. ``runs``: (tree, level, run, n, hashes, lo, hi), one row per run of siblings. ``trees``: (tree, grp, subroot)."""

    leaves: DataFrame
    runs: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def leaf_hash(values: dict[str, Column]) -> Column:
    """H of the fields: ``-`` for null, else UTF-8 length, colon, value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(values[f]) for f in FIELDS]), 256)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in shared storage with ``at``, each row's place from 0 on, and ``slice``. Only one number per slice of the
    range shuffle (their count is a setting) reaches the driver."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ordered = stored(ordered, "ordered").withColumn("slice", F.shiftright("_m", 33))
    before, offsets = 0, []
    for r in ordered.groupBy("slice").count().orderBy("slice").collect():
        offsets.append((r["slice"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "slice long, _before long")
    at = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(starts), "slice").withColumn("at", at).drop("_m", "_before")


def tree_levels(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(tree, idx, hash, n, lo, hi) of all trees' lowest nodes -> runs of all levels, and (tree, hash, lo, hi) of the tops."""
    runs, tops, level = [], [], 0
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "hash", "lo", "hi"))
        if widest <= 1:
            break
        made = (nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("run"))
                .agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("s"))
                .select("tree", F.lit(level).alias("level"), "run", "n", F.col("s.hash").alias("hashes"), "lo", "hi"))
        runs.append(stored(made, f"level{level}"))
        nodes = runs[-1].select("tree", F.col("run").alias("idx"), F.sha2(F.concat_ws("", "hashes"), 256).alias("hash"),
                                F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "lo", "hi")
        widest, level = -(-widest // ARITY), level + 1
    return _union(runs), _union(tops)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(docs: DataFrame, changed: Column | None = None, claimed_text: Column | None = None) -> Manifest:
    """The manifest of ``docs``. Rows that are ``changed`` will be verified with ``claimed_text`` in place of their text: the
    leaf of that is kept beside the true one."""
    fields = {f: F.col(f) for f in FIELDS}
    claimed = F.lit(None).cast("string") if changed is None else F.when(changed, leaf_hash(fields | {"text": claimed_text}))
    flat = stored(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf_hash(fields).alias("leaf"), claimed.alias("claimed"),
                              F.monotonically_increasing_id().alias("row")), "leaves")
    placed = numbered(flat, F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("row"))
    spans = placed.groupBy("slice", "grp").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    groups = spans.groupBy("grp").agg(F.min("lo").alias("first"), F.sum("n").alias("n"))
    groups = stored(numbered(groups, F.asc("first")).select(F.col("at").alias("tree"), "grp", "first", "n"), "groups")
    inside = (spans.select(F.col("slice").alias("s"), F.col("grp").alias("g"))
              .join(groups.withColumnRenamed("grp", "of"), F.col("g").eqNullSafe(F.col("of"))).drop("of"))
    near = placed.join(inside, (F.col("slice") == F.col("s")) & F.col("grp").eqNullSafe(F.col("g")))
    leaves = stored(near.select("at", "tree", (F.col("at") - F.col("first")).alias("pos"), "n", "id", "leaf", "claimed"), "placed")
    runs, tops = tree_levels(leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "n", F.col("at").alias("lo"), F.col("at").alias("hi")))
    n_trees = groups.count()
    tops = stored(tops, "subroots")
    root_runs, root = tree_levels(tops.select(F.lit(ROOT_TREE).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash",
                                              F.lit(n_trees).cast("long").alias("n"), "lo", "hi"))
    found = root.select("hash").first() if n_trees else None
    trees = groups.select("tree", "grp").join(tops.select("tree", F.col("hash").alias("subroot")), "tree")
    return Manifest(leaves, _union([r for r in (runs, root_runs) if r is not None]), trees, n_trees, found[0] if found else None)


def missing(places: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places of the nodes that can't be derived) for leaves at ``places`` of a tree with ``n`` leaves."""
    known, level = np.unique(places), 0
    while n > 1:
        runs = np.unique(known // ARITY)
        whole = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(whole[whole < n], known, assume_unique=True)
        known, n, level = runs, -(-n // ARITY), level + 1


def _segments(tree: np.ndarray) -> Iterator[slice]:
    """Runs of equal trees in leaves sorted by place."""
    cuts = np.flatnonzero(np.diff(tree)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(tree)]):
        yield slice(a, b)


def _ask(n_trees: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        tree, pos, n = (part.column(c).to_numpy() for c in ("tree", "pos", "n"))
        wanted = [(int(tree[s.start]), level, idx) for s in _segments(tree) for level, idx in missing(pos[s], int(n[s.start]))]
        wanted += [(ROOT_TREE, level, idx) for level, idx in missing(tree, n_trees)]
        sizes = [len(idx) for _, _, idx in wanted]
        return pa.table({"part": np.full(sum(sizes), key[0].as_py(), np.int64), "tree": np.repeat(np.array([t for t, _, _ in wanted], np.int64), sizes),
                         "level": np.repeat(np.array([v for _, v, _ in wanted], np.int32), sizes),
                         "idx": np.concatenate([np.empty(0, np.int64), *[idx for _, _, idx in wanted]]).astype(np.int64)})
    return run


def _h(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class PartTree:
    """What one part knows: its leaves, the fetched nodes and the interior nodes derived from both."""

    def __init__(self, tree: np.ndarray, pos: np.ndarray, n: np.ndarray, leaf: list[bytes], fetched: dict[tuple[int, int], dict[int, bytes]], n_trees: int) -> None:
        self.known, self.size = defaultdict(dict), {}
        for at, nodes in fetched.items():
            self.known[at].update(nodes)
        self.subroot = {}
        for s in _segments(tree):
            t = int(tree[s.start])
            self.known[t, 0].update(zip(pos[s].tolist(), leaf[s]))
            self.subroot[t] = self._derive(t, sorted(set(pos[s].tolist())), int(n[s.start]))
        self.known[ROOT_TREE, 0].update(self.subroot)
        self.root = self._derive(ROOT_TREE, sorted(self.subroot), n_trees)
        self.above, self.folds = {}, {}

    def _derive(self, tree: int, places: list[int], n: int) -> bytes:
        level = 0
        while n > 1:
            self.size[tree, level] = n
            now, up = self.known[tree, level], self.known[tree, level + 1]
            places = sorted({p // ARITY for p in places})
            for r in places:
                up[r] = _h(b"".join([now[i] for i in range(r * ARITY, min(r * ARITY + ARITY, n))]))
            n, level = -(-n // ARITY), level + 1
        return self.known[tree, level][places[0]]

    def siblings(self, tree: int, level: int, at: int) -> tuple[list[bytes], list[bytes]]:
        now, lo = self.known[tree, level], at // ARITY * ARITY
        return [now[i] for i in range(lo, at)], [now[i] for i in range(at + 1, min(lo + ARITY, self.size[tree, level]))]

    def path(self, tree: int, pos: int) -> Iterator[tuple[int, int, int]]:
        """(tree, level, place) of the nodes from a leaf up whose siblings make its proof."""
        for t, at in ((tree, pos), (ROOT_TREE, tree)):
            level = 0
            while (t, level) in self.size:
                yield t, level, at
                at, level = at // ARITY, level + 1

    def proof(self, tree: int, pos: int) -> bytes:
        """All siblings, joined. What lies over the lowest run is made once."""
        steps = self.path(tree, pos)
        first = next(steps, None)
        if first is None:
            return b""
        over = (first[0], first[2] // ARITY)
        if over not in self.above:
            self.above[over] = b"".join([x for s in steps for side in self.siblings(*s) for x in side])
        left, right = self.siblings(*first)
        return b"".join(left) + b"".join(right) + self.above[over]

    def fold(self, tree: int, pos: int, node: bytes) -> bytes:
        """The root that a leaf and the proof's siblings lead to; equal ways up are walked once."""
        for k, (t, level, at) in enumerate(self.path(tree, pos)):
            way = (t, level, at, node)
            if k and way in self.folds:
                node = self.folds[way]
                continue
            left, right = self.siblings(t, level, at)
            node = _h(b"".join([*left, node, *right]))
            if k:
                self.folds[way] = node
        return node


def _expand(n_trees: int, full: bool):
    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        tree, pos, n = (part.column(c).to_numpy() for c in ("tree", "pos", "n"))
        leaf, claimed = ([None if x is None else x.encode() for x in part.column(c).to_pylist()] for c in ("leaf", "claimed"))
        fetched = defaultdict(dict)
        for t, level, idx, h in zip(*(answers.column(c).to_pylist() for c in ("tree", "level", "idx", "hash"))):
            fetched[t, level][idx] = h.encode()
        known = PartTree(tree, pos, n, leaf, fetched, n_trees)
        out = {"id": part.column("id"), "leaf": part.column("leaf"), "subroot": [], "proof_sha256": [], "folded_root": []}
        proofs = []
        for t, p, h, c in zip(tree.tolist(), pos.tolist(), leaf, claimed):
            out["subroot"].append(known.subroot[t].decode())
            out["proof_sha256"].append(_h(known.proof(t, p)).decode())
            out["folded_root"].append(known.fold(t, p, h if c is None else c).decode())
            if full:
                proofs.append([[x.decode() for side in known.siblings(*s) for x in side] for s in known.path(t, p)])
        return pa.table(out | ({"proof": pa.array(proofs, pa.list_(pa.list_(pa.string())))} if full else {}))
    return run


def expanded_proofs(m: Manifest, wanted: DataFrame | None = None, full: bool = False) -> DataFrame:
    """(id, leaf, subroot, proof_sha256, folded_root) for each of the ``wanted`` rows of ``m.leaves`` (all, if not given); with
    ``full`` also ``proof``, the siblings level by level. ``folded_root`` starts from the claimed leaf, if there is one."""
    spark = m.leaves.sparkSession
    rows = (m.leaves if wanted is None else wanted).withColumn("part", F.expr(f"at div {PART}"))
    kind = m.leaves.schema["id"].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" + (", proof array<array<string>>" if full else "")
    if m.root is None:
        return spark.createDataFrame([], out)
    asked = stored(rows.select("part", "at", "tree", "pos", "n").groupBy("part").applyInArrow(_ask(m.n_trees), "part long, tree long, level int, idx long"), "asked")
    asked = asked.withColumn("block", F.expr(f"part * {PART} div {BLOCK}"))
    if m.runs is None:
        answers = spark.createDataFrame([], "part long, tree long, level int, idx long, hash string")
    else:
        levels = [r[0] for r in asked.select("level").distinct().collect()]  # as many as a tree is high
        copies = (m.runs.where(F.col("level").isin(levels) if levels else F.lit(False))
                  .select("tree", "level", "run", "hashes", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"hi div {BLOCK}"))).alias("block"))
                  .select("tree", "level", "block", "run", F.posexplode("hashes").alias("k", "hash"))
                  .select("tree", "level", "block", (F.col("run") * ARITY + F.col("k")).alias("idx"), "hash"))
        answers = asked.join(copies, ["tree", "level", "idx", "block"]).select("part", "tree", "level", "idx", "hash")
    return (rows.select("part", "at", "tree", "pos", "n", "id", "leaf", "claimed").groupBy("part").cogroup(answers.groupBy("part"))
            .applyInArrow(_expand(m.n_trees, full), out))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root, proof digest, and the root that a partly tampered copy of the table folds to:
    where 5 divides the CRC of the id, the copy's text has its A-Z lower-cased."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    m = build(docs, hit, F.translate("text", UPPER, LOWER))
    root = F.lit(m.root).cast("string")
    return expanded_proofs(m).select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                                     (F.col("folded_root") == root).alias("verified"))

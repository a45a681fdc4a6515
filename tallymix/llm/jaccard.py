"""Similarity join on word shingles with R-trees over count vectors.

Every document is the set of its distinct five-word shingles, hashed to 64 bits. Two
documents link if the Jaccard similarity of their sets is at least ``0.75``; the components
of the links are the groups of near copies. The result is exact: no partner, posting list
or candidate is capped.

How a link is found
1. Documents with equal sets are one class, and only classes are joined.
2. Routing. Sets are ordered by hash. Linked sets of sizes a and b share at least
   ``k(min(a, b))`` of their first ``a//4 + k(a)`` and ``b//4 + k(b)`` shingles, so a class
   needs that many shingles that another class also has among its first ones. Those that
   do not have them link with nothing; most documents end here.
3. Points. A remaining class is a point: its shingles are hashed into ``GROUPS`` groups
   and counted. The sum of coordinate minima of two points bounds the overlap of the sets
   from above; the minima with a node's largest coordinates bound it for all of its points.
4. First round: within the posting list of a routing shingle, each class is checked
   against the list's pivot, the class most of whose routing shingles others have too:
   the copy edited least. A group of thousands of near copies collapses here without
   forming its pairs. Pairs that meet under one pivot in fewer lists than a link needs
   are left to the second round, which finds every link.
5. Second round: shingles are put in one order, rare ones first. Linked sets share so many
   that each can leave its commonest ones out, and from the first shingle that they share
   either has enough left (``rest``) to share. Each posting list that still has several
   components gets a packed R-tree over its points, joined with itself; node pairs below
   the bounds, out of the size range or within one component are pruned. Pairs of points
   are bounded once more by the ``FINE`` counts that the groups are sums of.
6. Lists of more than ``LONG`` members, such as those of a passage that many texts quote,
   are not joined: their classes are listed anew by the shingles of their whole sets, of
   which those that three quarters of a set follow in the order need no list. A text is on
   a list of its quoted passage then only if little else is in it. Lists that are long even
   so are cut into blocks of bounded size and all pairs of blocks are joined.
7. Lists of the same members are joined once. Each class carries its first lists, and a
   list passes over pairs that meet in one of them before it.
8. Survivors of both rounds are verified on the full sets.

Nulls: a null or wordless text has an empty set and no links. Rows with a null or repeated
``doc_id`` take part like others; a component's id is its smallest non-null ``doc_id``.
Equal rows stay as they are. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import Words, components, likely_rows, mix, shingles, stored
from tallymix.llm.tokens import slices

WIDTH = 5
GROUPS = 128
#: Counts that travel with a point, a byte each; a group of the tree is a sum of them.
FINE = 512
#: What the largest byte stands for: any count from 255 on, so that bounds stay bounds.
MANY = 1 << 20
#: Characters of texts hashed together, and pairs of points looked at together.
SLICE, PAIRS = 1 << 19, 1 << 15
#: Points of a posting list in a block; longer lists are joined block by block.
BLOCK = 2_000
FANOUT = 16
#: Members up to which a posting list of routing shingles is joined: a leaf of the tree.
LONG = FANOUT
#: Lists of a class, rarest first, that travel with it: a pair that meets in one of them is
#: not given again by a later list. Pairs that meet in none of them may be given twice.
FIRSTS = 8
#: Stands for no list.
NONE = 2**63 - 1


def first_shared(n):
    """k of the routing rule; never falls as n grows. Works on ints and columns."""
    return n // 12 + 1


def routed_spare(n: np.ndarray) -> np.ndarray:
    """Of sets of n shingles, the routing ones less all; linked ones share as many fewer by routing."""
    return n // 4 + first_shared(n) - n


def whole_spare(n: np.ndarray) -> np.ndarray:
    """The same where all shingles of the sets are listed."""
    return np.zeros_like(n)


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum() + np.uint64(len(s))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column("text").to_pylist()
    for a, b in slices(texts, SLICE):
        for i, s in enumerate(shingles(Words(texts[a:b]), WIDTH), a):
            yield i, s


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, class) of each document."""
    for batch in batches:
        n, c = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for i, s in _sets(batch):
            n[i], c[i] = len(s), set_hash(s)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(c)], ["doc_id", "n_shingles", "class"]
        )


def routing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, class, n) for the first shingles of each set, once a task and class."""
    seen: set[int] = set()
    for batch in batches:
        for a in range(0, len(batch), 1000):
            keys, classes, sizes = [], [], []
            for _, s in _sets(batch.slice(a, 1000)):
                c = set_hash(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    p = len(s) // 4 + first_shared(len(s))
                    keys.append(s[:p])
                    classes.append(np.full(min(p, len(s)), c))
                    sizes.append(np.full(min(p, len(s)), len(s)))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(classes)),
                        pa.array(np.concatenate(sizes)),
                    ],
                    ["shingle", "class", "n"],
                )


def point_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, n, shingles, counts) of each document."""
    for batch in batches:
        for a in range(0, len(batch), 500):
            out = []
            for _, s in _sets(batch.slice(a, 500)):
                counts = np.bincount((mix(s) % np.uint64(FINE)).astype(np.int64), minlength=FINE)
                counts = np.minimum(counts, 255).astype(np.uint8).tobytes()
                out.append((set_hash(s), len(s), s.view(np.int64), counts))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.list_(pa.int64())),
                        pa.array([x[3] for x in out], pa.binary()),
                    ],
                    ["class", "n", "shingles", "counts"],
                )


def fine_counts(column) -> np.ndarray:
    """The counts of a column of points, a row each."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE)
    return np.where(raw == 255, MANY, raw).astype(np.int32)


def may_link(fine_a, fine_b, n_a, n_b, step: int = 4_000) -> np.ndarray:
    """Whether the sums of coordinate minima of pairs of points allow for a link."""
    out = np.zeros(len(n_a), dtype=bool)
    for i in range(0, len(n_a), step):
        k = slice(i, i + step)
        out[k] = 7 * np.minimum(fine_a(k), fine_b(k)).sum(axis=1, dtype=np.int64) >= 3 * (n_a[k] + n_b[k])
    return out


def enough_left(rest_a, rest_b, spare_a, spare_b, n_sum) -> np.ndarray:
    """Whether a list may be the first that linked sets of these sizes have in common."""
    return 7 * (np.minimum(rest_a, rest_b) - np.minimum(spare_a, spare_b)) >= 3 * n_sum


class Tree:
    """A packed R-tree: points sorted by component and size, ``FANOUT`` to a node.

    Each level holds the largest coordinates, the smallest and largest set size, the
    component (-1: several), the largest rest and the least spare of its nodes; level 0
    holds the points themselves. Without ``rest`` the list says nothing of what is left.
    """

    def __init__(
        self,
        counts: np.ndarray,
        n: np.ndarray,
        comp: np.ndarray,
        rest: np.ndarray | None = None,
        spare: np.ndarray | None = None,
    ):
        self.order = np.lexsort((n, comp))
        rest, spare = n if rest is None else rest, np.zeros_like(n) if spare is None else spare
        self.levels = [tuple(x[self.order] for x in (counts, n, n, comp, rest, spare))]
        while len(self.levels[-1][1]) > 1:
            top, low, high, c, rest, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            one = np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)
            mixed = np.logical_or.reduceat(c == -1, at)
            self.levels.append(
                (
                    np.maximum.reduceat(top, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.where(one & ~mixed, c[at], -1),
                    np.maximum.reduceat(rest, at),
                    np.minimum.reduceat(spare, at),
                )
            )

    def join(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different components whose sets may link, in pieces."""
        stack = [(len(self.levels) - 1, len(other.levels) - 1, np.zeros(1, int), np.zeros(1, int))]
        while stack:
            la, lb, a, b = stack.pop()
            if len(a) > 20_000:
                stack += [(la, lb, a[i : i + 20_000], b[i : i + 20_000]) for i in range(0, len(a), 20_000)]
                continue
            lo_a, hi_a, ca, rest_a, spare_a = (x[a] for x in self.levels[la][1:])
            lo_b, hi_b, cb, rest_b, spare_b = (x[b] for x in other.levels[lb][1:])
            keep = (4 * hi_a >= 3 * lo_b) & (4 * hi_b >= 3 * lo_a) & ((ca != cb) | (ca == -1))
            keep &= enough_left(rest_a, rest_b, spare_a, spare_b, lo_a + lo_b)
            a, b, low = a[keep], b[keep], (lo_a + lo_b)[keep]
            shared = np.minimum(self.levels[la][0][a], other.levels[lb][0][b]).sum(axis=1, dtype=np.int64)
            keep = 7 * shared >= 3 * low
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if la == lb == 0:
                yield self.order[a], other.order[b]
                continue
            if la >= lb:
                a, b = self._open(la, a, b)
                la -= 1
            else:
                b, a = other._open(lb, b, a)
                lb -= 1
            stack.append((la, lb, a, b))

    def _open(self, level: int, own: np.ndarray, with_: np.ndarray):
        size = len(self.levels[level - 1][1])
        child = (own[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        with_ = np.repeat(with_, FANOUT)
        return child[child < size], with_[child < size]


def small_joins(counts, n, comp, rest, spare, list_of) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lists that fit into one leaf each, all lists at once.

    ``list_of`` numbers the list of each row, and rows of a list stand together.
    """
    size = np.bincount(list_of)
    start = np.cumsum(size) - size
    place = np.arange(len(n)) - start[list_of]
    a = np.repeat(np.arange(len(n)), place)
    b = np.arange(len(a)) - np.repeat(np.cumsum(place) - place, place) + np.repeat(start[list_of], place)
    keep = (comp[a] != comp[b]) & (4 * n[a] >= 3 * n[b]) & (4 * n[b] >= 3 * n[a])
    keep &= enough_left(rest[a], rest[b], spare[a], spare[b], n[a] + n[b])
    a, b = a[keep], b[keep]
    good = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000], b[i : i + 20_000]
        good[i : i + 20_000] = 7 * np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) >= 3 * (n[x] + n[y])
    return a[good], b[good]


def earlier(key: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Those of the first lists of each row that come before its list ``key``; else ``NONE``."""
    own = firsts == key[:, None]
    at = np.where(own.any(axis=1), own.argmax(axis=1), FIRSTS)
    return np.where(np.arange(FIRSTS) < at[:, None], firsts, NONE)


def met_before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the earlier lists (rows of ``a`` and ``b``) have one in common."""
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 50_000):
        x, y = a[i : i + 50_000], b[i : i + 50_000]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[i : i + 50_000] = (same & (x != NONE)).any(axis=1)
    return out


def tree_join(
    batches: Iterator[pa.RecordBatch], spare_of: Callable[[np.ndarray], np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each block; rows come sorted by (shingle, i, j)."""

    def join(rows: pa.Table) -> pa.RecordBatch:
        fine = fine_counts(rows["counts"])
        counts = fine.reshape(len(fine), -1, GROUPS).sum(axis=1, dtype=np.int32)
        firsts = pa.concat_arrays(rows["firsts"].chunks).flatten().to_numpy().reshape(-1, FIRSTS)
        n, comp, cls, part, i, j, key, rest = (
            rows[c].to_numpy() for c in ("n", "component", "class", "part", "i", "j", "shingle", "rest")
        )
        before, spare = earlier(key, firsts), spare_of(n)
        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        block = np.cumsum(np.concatenate([[0], new]))
        size = np.bincount(block)
        small = (size <= FANOUT)[block] & (i == j)
        at = np.flatnonzero(small)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def keep_likely(a: np.ndarray, b: np.ndarray) -> None:
            """Pairs that no earlier list gives and whose finer counts allow for a link."""
            for i in range(0, len(a), PAIRS):
                x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                new = ~met_before(before[x], before[y])
                x, y = x[new], y[new]
                near = may_link(lambda k: fine[x[k]], lambda k: fine[y[k]], n[x], n[y])
                found.append((x[near], y[near]))

        if len(at):
            numbered = np.unique(block[at], return_inverse=True)[1]
            a, b = small_joins(counts[at], n[at], comp[at], rest[at], spare[at], numbered)
            keep_likely(at[a], at[b])
        start = np.cumsum(size) - size
        for k in np.unique(block[~small]).tolist():
            own = np.arange(start[k], start[k] + size[k])
            left, right = own[part[own] == i[own]], own[part[own] == j[own]]
            if not len(left) or not len(right):
                continue
            one, two = (Tree(*(x[side] for x in (counts, n, comp, rest, spare))) for side in (left, right))
            for a, b in one.join(one if i[own[0]] == j[own[0]] else two):
                keep_likely(left[a], right[b])
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        pairs = np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])], axis=1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    # Whole blocks are joined; the last block of a batch may go on in the next.
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("shingle", "i", "j")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if kept and len(batch):
            last = kept[-1].slice(len(kept[-1]) - 1)
            if any(last.column(c)[0] != batch.column(c)[0] for c in ("shingle", "i", "j")):
                yield join(pa.Table.from_batches(kept))
                kept = []
        whole = int(cut[-1]) if len(cut) else 0
        if whole:
            yield join(pa.Table.from_batches([*kept, batch.slice(0, whole)]))
            kept = []
        if len(batch) > whole:
            kept.append(batch.slice(whole))
    if kept:
        yield join(pa.Table.from_batches(kept))


def sides(points: DataFrame, *names: str) -> list[DataFrame]:
    own = points.select("class", *names)
    return [own.select(F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab"]


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and count vectors allow for a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            one, two = (batch.column(c) for c in ("counts_a", "counts_b"))
            side = lambda col: lambda k: fine_counts(col.slice(k.start, k.stop - k.start))
            keep = may_link(side(one), side(two), n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left, right = sides(points, "n", "counts")
    near = pairs.join(left, "a").join(right, "b").filter("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    return near.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(rows, "a bigint, b bigint")


def verified(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity."""
    left, right = sides(points, "shingles")
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.filter(7 * overlap >= 3 * (F.size("shingles_a") + F.size("shingles_b"))).select("a", "b")


def ranked(rows: DataFrame) -> DataFrame:
    """``rest``: how many of its class's rows a row has from itself on, rare shingles first."""
    back = Window.partitionBy("class").orderBy(F.desc("often"), F.desc("shingle"))
    return rows.withColumn("rest", F.row_number().over(back).cast("long"))


def open_lists(rows: DataFrame) -> DataFrame:
    """``rows`` of the lists that have several components, with their ``size``.

    Of lists with the same members the first in the order is kept: the first list that two
    classes have in common is the first of those with its members, too.
    """
    lists = rows.groupBy("shingle").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("class")).alias("members"),
        F.min("often").alias("often"),
    )
    first = F.min(F.struct("often", "shingle"))["shingle"].alias("shingle")
    lists = lists.filter("x <> y").groupBy("x", "y", "size", "members").agg(first)
    return rows.join(lists.select("shingle", "size"), "shingle")


def whole_lists(classes: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of the lists of ``classes`` (class, component) by the shingles of their whole sets.

    Linked sets of different components share three quarters of the larger one at least, and
    nothing but shingles that several components have; so each needs no list for as many less
    one of its commonest.
    """
    rows = points.select("class", "n", "shingles").join(classes, "class")
    rows = rows.select("class", "n", "component", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(
        F.count("*").alias("often"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    rows = rows.join(often.filter("x <> y").select("shingle", "often"), "shingle")
    return ranked(rows).filter("4 * rest >= 3 * n")


def by_trees(rows: DataFrame, points: DataFrame, spare_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Candidate pairs (a, b) of the lists of ``rows``."""
    lists = F.sort_array(F.collect_list(F.struct("rest", "shingle")), asc=False)
    lists = F.concat(F.transform(lists, lambda x: x["shingle"]), F.array_repeat(F.lit(NONE), FIRSTS))
    firsts = rows.groupBy("class").agg(F.slice(lists, 1, FIRSTS).alias("firsts"))
    rows = rows.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    rows = rows.join(points.select("class", "counts").join(firsts, "class"), "class")
    rows = rows.select("shingle", "i", "j", "part", "class", "component", "n", "rest", "counts", "firsts")
    blocks = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    join = tree_join
    return blocks.mapInArrow(lambda batches: join(batches, spare_of), "a bigint, b bigint")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs`` (doc_id, text, ..)."""
    docs = docs.select("doc_id", "text")
    classes = stored(
        docs.mapInArrow(class_rows, "doc_id bigint, n_shingles bigint, class bigint"), "classes"
    )
    routed = docs.select("text").mapInArrow(routing_rows, "shingle bigint, class bigint, n bigint")

    # Routing shingles that at least two classes have, then the classes with enough of them.
    shared = routed.groupBy("shingle").agg(
        F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("often")
    )
    shared = shared.filter("x <> y").select("shingle", "often")
    posted = routed.join(shared, "shingle").groupBy("class", "shingle")
    posted = stored(posted.agg(F.first("n").alias("n"), F.first("often").alias("often")), "posted")
    smallest = F.ceil(F.col("n") * 3 / 4).cast("long")
    likely = posted.groupBy("class", "n").agg(F.count("*").alias("found"))
    fewest = F.floor(smallest / 12) + 1
    likely = likely.filter(F.col("found") >= fewest)
    likely = likely.select("class", (F.col("found") / F.col("n")).alias("shared"))
    posted = stored(ranked(posted.join(likely, "class")), "likely-posted")

    # Points of those classes, from the text of one document each.
    first = classes.join(likely, "class").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    first = stored(first.select("doc_id").distinct(), "likely")
    chosen = likely_rows(docs, first).join(first, "doc_id", "left_semi")
    chosen = chosen.union(docs.filter("doc_id is null")).select("text")  # those have no id to be found by
    points = chosen.mapInArrow(
        point_rows, "class bigint, n bigint, shingles array<bigint>, counts binary"
    )
    points = stored(points.dropDuplicates(["class"]), "points")

    # First round: pivots.
    pivots = posted.groupBy("shingle").agg(F.max(F.struct("shared", "class"))["class"].alias("pivot"))
    pairs = posted.join(pivots, "shingle").filter("class <> pivot").groupBy("class", "pivot")
    pairs = pairs.agg(F.count("*").alias("lists"), F.first("n").alias("n"))
    pairs = pairs.filter(F.col("lists") >= F.floor(F.ceil(F.col("n") * 3 / 4) / 12) + 1)
    pairs = pairs.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"))
    links = stored(verified(bounded(pairs.distinct(), points), points), "links")
    own = points.select(F.col("class").alias("a"), F.col("class").alias("b"))
    merged = components(links.union(own)).select(F.col("node").alias("class"), "component")

    # Second round: R-trees over the lists that still have several components.
    rows = posted.filter(F.col("rest") >= fewest).select("shingle", "class", "n", "often", "rest")
    rows = stored(open_lists(rows.join(merged, "class")), "open-lists")
    crowded = rows.filter(F.col("size") > LONG).select("class", "component").distinct()
    whole = stored(open_lists(whole_lists(crowded, points)), "open-lists")
    found = by_trees(rows.filter(F.col("size") <= LONG), points, routed_spare)
    found = found.union(by_trees(whole, points, whole_spare)).distinct()
    links = links.union(stored(verified(found, points), "links"))

    groups = components(links).select(F.col("node").alias("class"), "component")
    of = classes.join(groups, "class", "left")
    of = of.withColumn("component", F.coalesce("component", "class"))
    # Sets without shingles are alike but link with nothing.
    lone = F.col("n_shingles") == 0
    least = of.filter(~lone).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = of.filter(~lone).join(least, "component")
    return linked.select("doc_id", "n_shingles", "component_id").union(
        of.filter(lone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )

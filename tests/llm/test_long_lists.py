"""Similarity join where many texts share a passage: few pairs are looked at, and no link is lost."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymix.llm import jaccard


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 10**9, n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)


def groups(texts):
    """Least id of the component of each text, by all pairs that share a shingle."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root, holders = list(range(len(sets))), defaultdict(list)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, own in enumerate(sets):
        for other, n in Counter(o for s in own for o in holders[s]).items():
            if 4 * n >= 3 * (len(own) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(k)
    return {k: find(k) for k in range(len(sets))}


def found(docs):
    return {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}


def test_texts_that_quote_one_passage_are_not_paired_with_each_other(spark, monkeypatch):
    rng, passage = np.random.default_rng(7), words(np.random.default_rng(8), 30)
    texts = [[*words(rng, 30), *passage, *words(rng, int(rng.integers(20, 40)))] for _ in range(300)]
    pairs, join = spark.sparkContext.accumulator(0), jaccard.tree_join

    def counted(batches, *rest):
        def seen():
            size = Counter()
            for batch in batches:
                size.update(zip(*(batch.column(c).to_pylist() for c in ("shingle", "i", "j"))))
                yield batch
            pairs.add(sum(n * (n - 1) // 2 for n in size.values()))

        return join(seen(), *rest)

    monkeypatch.setattr(jaccard, "tree_join", counted)
    assert found(frame(spark, texts)) == {k: k for k in range(300)}
    assert pairs.value < 30 * 300  # 44,850 on each list of all texts


@pytest.mark.parametrize("long,block", [(2, 40), (10**6, 2000)])
def test_second_round_alone_finds_all_links_of_texts_made_of_common_passages(spark, monkeypatch, long, block):
    """Any text is on long lists only; a link may be of sets of unlike sizes."""
    rng, passages = np.random.default_rng(9), [words(np.random.default_rng(k), 30) for k in range(5)]
    texts = []
    for _ in range(240):
        text = [w for k in rng.permutation(5)[: rng.integers(2, 5)] for w in passages[k]]
        for at in rng.integers(0, len(text), rng.integers(0, 4)):
            text[at] = words(rng, 1)[0]
        texts.append(text[: len(text) - int(rng.integers(0, 15))])
    want = groups(texts)
    assert 20 < len(set(want.values())) < 200
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "bounded", lambda pairs, points: pairs.select("a", "b").limit(0))
    assert found(frame(spark, texts)) == want


def test_second_round_alone_finds_all_links_of_edited_copies(spark, monkeypatch):
    rng, texts = np.random.default_rng(10), []
    for _ in range(12):
        base = words(rng, int(rng.integers(20, 200)))
        for _ in range(int(rng.integers(1, 30))):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 6)):
                text[at] = words(rng, 1)[0]
            texts.append(text[int(rng.integers(0, 10)) :])
    want = groups(texts)
    monkeypatch.setattr(jaccard, "LONG", 5)
    monkeypatch.setattr(jaccard, "bounded", lambda pairs, points: pairs.select("a", "b").limit(0))
    assert found(frame(spark, texts)) == want


def test_a_tree_leaves_out_pairs_that_share_too_little_from_a_list_on():
    rng = np.random.default_rng(11)
    counts = rng.integers(3, 5, (200, jaccard.GROUPS)).astype(np.int32)
    n, comp = counts.sum(axis=1), np.arange(200)
    rest = (n * rng.uniform(0.6, 1, 200)).astype(np.int64)
    spare = -(rng.integers(0, 40, 200))
    tree = jaccard.Tree(counts, n, comp, rest, spare)
    got = {(min(a, b), max(a, b)) for x, y in tree.join(tree) for a, b in zip(x.tolist(), y.tolist())}
    want = {
        (a, b)
        for a in range(200)
        for b in range(a + 1, 200)
        if 7 * np.minimum(counts[a], counts[b]).sum() >= 3 * (n[a] + n[b])
        and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])
        and 7 * (min(rest[a], rest[b]) - min(spare[a], spare[b])) >= 3 * (n[a] + n[b])
    }
    assert got == want and 0 < len(want) < 200 * 199 // 2


def test_only_lists_before_the_own_one_count_as_met():
    firsts = np.full((3, jaccard.FIRSTS), jaccard.NONE)
    firsts[0, :3], firsts[1, :3], firsts[2, :2] = (9, 4, 6), (4, 6, 2), (4, 6)
    at = lambda key: jaccard.earlier(np.array(key), firsts)
    assert at([4, 4, 4])[:, :2].tolist() == [[9, jaccard.NONE], [jaccard.NONE] * 2, [jaccard.NONE] * 2]
    before = at([6, 6, 6])
    assert jaccard.met_before(before[[0, 0]], before[[1, 2]]).tolist() == [True, True]
    before = at([4, 4, 4])
    assert jaccard.met_before(before[[0, 1]], before[[1, 2]]).tolist() == [False, False]

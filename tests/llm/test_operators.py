"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallymix.llm import chat, classifier, common, embeddings, huffman, jaccard, language, licenses, mixing, packing, quality_rules, tokens
from tallymix.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACED, LOWER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, name, d=SF):
    return spark.read.parquet(f"{d}/{name}.parquet")


# Tokens


@pytest.mark.parametrize("path,spaced", [(SPACED, True), (LOWER, False)])
def test_chunks_give_the_ids_of_the_whole_text(path, spaced):
    encoder, rng = Encoder(path, spaced), np.random.default_rng(1)
    letters = list(" \n\t aéÉB1's.,!<|ñß  İΣ́中") + ["<|endoftext|>", "\x00", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


def test_words_at_once_give_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(tokens.WordIds, "LONG", 6)
    words, rng = tokens.WordIds(LOWER), np.random.default_rng(2)
    letters = list(" \n\t aéÉB1's.,!<|ñß  İΣ́中") + ["<|endoftext|>", "\x00", "\x1c", "longerword", " "]
    tokenizer = Tokenizer.from_file(LOWER)
    for most in (10**6, 50):
        monkeypatch.setattr(tokens, "MAX_CHUNKS", most)
        for size in (0, 1, 40, 200):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(size)]
            ids, n = words.encode(texts)
            want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizer_files_are_not_cut(tmp_path):
    made = json.load(open(LOWER))
    made["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": "a b"}, "content": "ab"}]}
    path = str(tmp_path / "other.json")
    json.dump(made, open(path, "w"))
    text = "a b ﬁne words a b"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert tokens.WordIds(path).encode([text, None])[0].tolist() == want
    assert np.frombuffer(Encoder(path, False).encode(text), "<u4").tolist() == want
    assert not Encoder(path, False).known and Encoder(LOWER, False).known and Encoder(SPACED, True).known


# 1 Embeddings


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 32))
    near = [b + rng.normal(size=32) * rng.uniform(0, 0.2) * np.linalg.norm(b) for b in base[:80] for _ in range(3)]
    x = np.concatenate([base, near, base[:20]]).astype(np.float32)
    odd = [None, [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31, []]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(odd)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, links int")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T) >= 0.9
    want = near.sum(axis=1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(len(odd)))
    assert all(got[i]["component_id"] <= i for i in range(len(x)))


def test_chains_of_a_bucket_stay_whole():
    """All pairs meet in one bucket; its edges must span the components of its links."""
    rng, angle = np.random.default_rng(8), 0.4  # neighbours link (0.92), others do not (0.70)
    for n in (3, 40, 1200):
        steps = np.where(np.arange(n) % 20 < 19, angle, 1.2).cumsum()  # chains of 20, apart
        planes = np.arange(n) // 20
        unit = np.zeros((n, 2 * (planes[-1] + 1)))
        unit[np.arange(n), 2 * planes], unit[np.arange(n), 2 * planes + 1] = np.cos(steps), np.sin(steps)
        group = rng.permutation(n).astype(np.int64) * 7
        batch = pa.RecordBatch.from_pydict(
            {
                "dims": np.full(n, unit.shape[1]), "table": np.zeros(n, np.int64), "bucket": np.zeros(n, np.int64),
                "i": np.zeros(n, np.int64), "j": np.zeros(n, np.int64), "part": np.zeros(n, np.int64),
                "group": group, "size": np.ones(n, np.int64), "own": np.ones(n, bool),
                "unit": [v.tobytes() for v in unit],
                "codes": [np.zeros(embeddings.TABLES * (1 + embeddings.PROBES), np.int64)] * n,
            }
        )
        found = pa.Table.from_batches(embeddings.pair_rows(iter([batch]))).to_pydict()
        near = (unit @ unit.T >= 0.9) & ~np.eye(n, dtype=bool)
        want = group.copy()
        while ((low := np.minimum(want, np.where(near, want, want.max()).min(axis=1))) != want).any():
            want = low
        links, low = dict(zip(found["group"], found["links"])), dict(zip(found["group"], found["neighbour"]))
        assert [links.get(g, 0) for g in group.tolist()] == near.sum(axis=1).tolist()
        assert [low.get(g, g) for g in group.tolist()] == want.tolist()


def test_components_of_noisy_chains(spark):
    steps = np.arange(15) * 0.3
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for _ in range(12):  # chains in planes of their own; ends are far apart
        p, q = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for a in rng.permutation(steps):
            rows.append((at, (np.cos(a) * p + np.sin(a) * q).tolist()))
            at += 1
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    near = x @ x.T >= 0.9
    want = np.arange(at)
    while ((low := np.where(near, want, at).min(axis=1)) != want).any():
        want = low
    assert [got[i]["n_links"] for i in range(at)] == (near.sum(axis=1) - 1).tolist()  # the index finds all links here
    assert [got[i]["component_id"] for i in range(at)] == want.tolist()
    assert [got[i]["kept"] for i in range(at)] == (want == np.arange(at)).tolist()


# 2 Mixing


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 500, "c": 70, "d": 3, "e": 0, None: 40}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = (left - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    want = fixed | {s: rest * weight[s] for s in free}
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in order)


def test_mix_of_odd_rows(docs, empty):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5, 7)} == {0}
    assert mixing.mix_report(empty).count() == 0
    assert sorted(mixing.mix_report(docs).collect(), key=str) == sorted(rows, key=str)


def test_a_hot_null_id_does_not_miss_its_target(spark):
    """A third of a source's rows have no id; its budget ends among them or elsewhere."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " * (1 + i % 9), "a") for i in range(3000)]
    rows += [(10_000 + i, "w " * 9, s) for s, n in (("b", 900), ("c", 800)) for i in range(n)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for r in got.groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 18


# 3 Packing


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(2)
    for room in (10, 37, 256):
        counts = Counter(rng.integers(1, room + 1, 400).tolist())
        plan = packing.packing_plan(counts, room)
        held = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                slot = np.searchsorted(plan["key"], (length << 48) + rank, side="right") - 1
                held[int(plan["sequence"][slot] + rank - plan["rank"][slot])].append((int(plan["offset"][slot]), length))
        assert len(held) == plan["sequences"][0]
        for parts in held.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= room
        assert len(held) <= 1.05 * sum(k * n for k, n in counts.items()) / room + 1


def test_reduction_loses_no_sequence():
    """On small instances the plan is as short as the best found by trying all."""

    def best(items, room):
        low = -(-sum(items) // room)
        items = sorted(items, reverse=True)

        def fits(n):
            def place(i, gaps):
                if i == len(items):
                    return True
                return any(
                    place(i + 1, sorted([*gaps[:k], g - items[i], *gaps[k + 1 :]])) for k, g in enumerate(gaps) if g >= items[i] and g not in gaps[:k]
                )

            return place(0, [room] * n)

        return next(n for n in itertools.count(low) if fits(n))

    rng = np.random.default_rng(3)
    for _ in range(40):
        items = rng.integers(1, 21, 9).tolist()
        lengths = packing.Lengths(Counter(items))
        fixed = packing.reduction(lengths, 20)
        rest = [k for k, n in lengths.counts.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, 20) if rest else 0) == best(items, 20)


def test_pieces_and_sequences(docs, empty):
    rows = packing.pack(docs, SPACED, 64).collect()
    tokenizer = Tokenizer.from_file(SPACED)
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for start, n in packing.cut(len(ids), 64):
            want[(r["doc_id"], start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64
    assert packing.pack(empty, SPACED).count() == 0
    one = docs.filter("doc_id in (1, 3, 6)")
    assert sum(len(r["ids"]) for r in packing.sequences(one, packing.pack(one, SPACED, 64), SPACED).collect()) == sum(
        r["length"] for r in packing.pack(one, SPACED, 64).collect()
    )


def test_a_third_of_all_pieces_are_one_row(spark):
    docs = spark.createDataFrame([(None, None) if i % 3 == 0 else (i, f"word{i} " * (i % 40)) for i in range(3000)], "doc_id bigint, text string")
    rows = packing.pack(docs, SPACED, 64).collect()
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64 and len([r for r in rows if r["doc_id"] is None]) == 1000


# 4 Token files


def test_code_lengths_are_limited_and_complete():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 4000):
        counts = np.maximum((1e9 / np.arange(1, n + 1) ** 3).astype(np.int64), 1)
        rng.shuffle(counts)
        lengths = huffman.code_lengths(counts, 13)
        assert lengths.max() <= 13 and (n == 1 or math.isclose((0.5**lengths).sum(), 1))
        ids = rng.choice(n, 3000)
        code = huffman.Code(np.arange(n) * 3, lengths)
        bits, offsets = code.encode(ids * 3)
        counts = np.minimum(huffman.STRIDE, len(ids) - huffman.STRIDE * np.arange(len(offsets)))
        assert code.decode(bits, offsets, counts).tolist() == (ids * 3).tolist()


def test_token_files_round_trip(spark, docs, empty):
    path = common.fresh_path(spark, "test-files")
    huffman.write(docs, LOWER, path)
    rows = huffman.read(spark, path).collect()
    tokenizer = Tokenizer.from_file(LOWER)
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    found = sorted(huffman.with_starts(huffman.read(spark, path, False)).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in found]
    assert ids == sorted(ids)
    path = common.fresh_path(spark, "test-files")
    huffman.write(empty, LOWER, path)
    assert huffman.with_starts(huffman.read(spark, path, False)).count() == 0


# 5 Jaccard


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_near_copies_against_all_pairs(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k in sorted(sets):
        for other, n in Counter(o for s in sets[k] for o in holders[s]).items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    for r in jaccard.near_copies(docs).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))


def test_tree_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 6, (20, jaccard.GROUPS))
    counts = np.maximum(base[rng.integers(0, 20, 300)] + (rng.random((300, jaccard.GROUPS)) < 0.05), 0).astype(np.int32)
    n, comp = counts.sum(axis=1), rng.integers(0, 9, 300)
    tree = jaccard.Tree(counts, n, comp)
    got = {(min(a, b), max(a, b)) for x, y in tree.join(tree) for a, b in zip(x.tolist(), y.tolist())}
    for a, b in itertools.combinations(range(300), 2):
        near = 7 * np.minimum(counts[a], counts[b]).sum() >= 3 * (n[a] + n[b]) and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])
        assert ((a, b) in got) == bool(near and comp[a] != comp[b])


def test_near_copies_of_odd_rows(docs, empty):
    rows = jaccard.near_copies(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[None]["component_id"] == 1 and by[11]["component_id"] == 10
    assert [by[k]["n_shingles"] for k in (4, 5, 7)] == [0, 0, 0] and by[7]["component_id"] == 7
    assert jaccard.near_copies(empty).count() == 0


# 6 Language


def test_languages_held_out(spark):
    got = entry.queries()["op6_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "documents", "/root/testdata/sf0.01"), "doc_id")
    rows = [r for r in got.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 0


def test_best_path_is_that_of_one_pass():
    rng = np.random.default_rng(6)
    of = np.array([0, 3, 3, 500, 501, 1300])
    scores = rng.normal(size=(1300, 3)).astype(np.float32) * 4
    path = language.best_path(scores, of, 5.0)
    for a, b in zip(of[:-1], of[1:]):
        value, back = np.zeros(3), []
        for t in range(a, b):
            move = value[:, None] - 5.0 * (1 - np.eye(3)) if t > a else np.diag(value)
            if t == a:
                move = np.where(np.eye(3) > 0, 0.0, -1e9)
            back.append(move.argmax(axis=0))
            value = move.max(axis=0) + scores[t]
        got = sum(scores[t, path[t]] for t in range(a, b)) - 5.0 * (path[a + 1 : b] != path[a : b - 1]).sum()
        assert b == a or math.isclose(got, value.max(), rel_tol=1e-4)


@pytest.mark.parametrize("k,room", [(130, 1 << 26), (300, 1 << 26), (130, 1 << 20), (3, 100)])
def test_best_path_of_many_languages(monkeypatch, k, room):
    """Each stretch of 60 words speaks one language, also those numbered past 127 and 255."""
    monkeypatch.setattr(language, "ROOM", room, raising=False)
    rng = np.random.default_rng(10)
    want = np.repeat(np.append(rng.integers(0, k, 6), [k - 1, 0, k - 2]), 60)
    scores = rng.normal(size=(len(want), k)).astype(np.float32)
    scores[np.arange(len(want)), want] += 6
    of = np.array([0, 0, 130, 131, len(want)])
    assert (language.best_path(scores, of, 20.0) == want).all()


def test_languages_of_odd_rows(docs, empty):
    model = language.learn(language.training(docs))
    rows = language.identified(docs, model).collect()
    assert len(rows) == docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 7, 9)} == {"und"}
    nothing = language.learn(language.training(empty))
    assert {r["lang_pred"] for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(empty, model).count() == 0
    parts = language.judged(model, ["the and of word1 " * 40 + "und der die das " * 40])
    assert [s[0] for s in next(iter(parts))[2]] == ["en", "de"]


# 7 Licences


def test_base_phrases_against_a_scan(spark, docs, empty):
    source = table(spark, "documents", "/root/testdata/sf0.01")
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    for r in licenses.labelled(source).collect():
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        at, labels = [], set()
        for label, _, phrase in licenses.TEMPLATES[: licenses.BASE]:
            p = phrase.split()
            own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        want = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    by = {r["doc_id"]: r for r in licenses.labelled(docs).collect()}
    assert by[6]["labels"] == "mit" and by[6]["score"] == 1.0 and by[4]["n_words"] == 0
    assert licenses.labelled(empty).count() == 0


# 8 Quality rules


def test_features_against_plain_python(spark, docs, empty):
    source = table(spark, "documents", "/root/testdata/sf0.01")
    for frame in (source, docs.filter("doc_id is not null")):
        texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        for r in quality_rules.measured(frame.select("doc_id", "text")).collect():
            words = WORD.findall(texts[r["doc_id"]])
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            n = Counter(windows)
            covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
            lines = [x for x in texts[r["doc_id"]].split("\n") if WORD.search(x)]
            want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]])), len(lines) - len(set(lines)), len(covered)]
            assert [r[f] for f in quality_rules.FEATURES] == want
            assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.scored(empty, common.stored).count() == 0


def test_em_finds_the_accuracies_of_planted_rules():
    rng = np.random.default_rng(7)
    good = rng.random(20000) < 0.8
    right = [(0.95, 0.1), (0.9, 0.2), (0.99, 0.4), (0.85, 0.05)]
    votes = [np.where(rng.random(20000) < 0.2, None, np.where(rng.random(20000) < np.where(good, a, b), 1, 0)) for a, b in right]
    model = quality_rules.fit(list(Counter(zip(*votes)).items()))
    assert abs(model["share"] - 0.8) < 0.05
    assert all(abs(x - y) < 0.08 for got, want in zip(model["rates"], right) for x, y in zip(got, want))


# 9 Classifier


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = [r for r in classifier.quality(table(spark, "documents", d), table(spark, "labels", d)).join(table(spark, "labels", d), "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows) > 0


def test_packed_ngrams_come_back():
    rng = np.random.default_rng(11)
    for n in (0, 1, 5, 3000, 100_000):
        g = np.unique(rng.integers(0, classifier.BUCKETS, n))
        assert classifier.unpacked(classifier.packed(g)).tolist() == g.tolist()


def plain_ngrams(text):
    """Names of the n-grams of a text, by the rules as stated and without any hashing."""
    words = WORD.findall(text)
    kinds = [lambda c: "a" <= c <= "z" or ord(c) > 127, lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in ".,;:'\"-()?"]
    of = lambda c: next((k for k, f in enumerate(kinds) if f(c)), 4)
    shape, rough, seen, pairs = [], [], set(), set()
    for i, w in enumerate(words):
        size = len(w.encode())
        n = [sum(len(c.encode()) for c in w if of(c) == k) for k in range(5)]
        shape.append((min(size, 15), *[0 if m == 0 else 3 if m == size else 2 if m > 1 else 1 for m in n]))
        pair = (w, words[i + 1]) if i + 1 < len(words) else (w, None)
        rough.append((n[1] == size, n[4] > 0, w in seen, pair in pairs))
        seen.add(w)
        pairs.add(pair)
    m = len(words)
    out = {("w", w) for w in words} | {("p", words[i], words[i + 1]) for i in range(m - 1)}
    out |= {("s", s) for s in shape} | {("t", shape[i], shape[i + 1]) for i in range(m - 1)}
    return out | {("r", *rough[i : i + 3]) for i in range(m - 2)} | {("q", *rough[i : i + 5]) for i in range(m - 4)}


def test_ngrams_are_those_of_plain_rules(spark):
    """As many as distinct ones by the rules, and equal where these are equal."""
    texts = [r["text"] for r in table(spark, "documents").limit(60).collect()] + ["", "A b A b A b", "x", "É é1 --- (a) ??", "a a a a a a a"]
    grams, named = classifier.ngrams(texts), [plain_ngrams(t) for t in texts]
    for g, names in zip(grams, named):
        assert len(names) - len(g) <= 0.02 * len(names) + 1  # buckets may be shared
    for (g, a), (h, b) in itertools.combinations(zip(grams, named), 2):
        same = len(a & b)
        assert same <= len(np.intersect1d(g, h)) + 0.01 * len(a) + 1
        assert len(np.intersect1d(g, h)) <= same + 0.02 * len(a) + 3


def test_descent_solves_the_dual():
    """Against the primal objective of a plain subgradient search and the duality gap."""
    rng = np.random.default_rng(12)
    ratio = np.zeros(classifier.BUCKETS)
    ratio[:40] = rng.normal(size=40)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(200)]
    x = np.zeros((200, 41))
    for i, g in enumerate(rows):
        x[i, g], x[i, 40] = classifier.unit(g, ratio), 1.0
    y = np.where(x[:, :20].sum(axis=1) + 0.2 * rng.normal(size=200) > 0, 1.0, -1.0)
    w = classifier.descend(rows, y, ratio)
    found = np.append(w[:40], w[-1])
    objective = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best, v = math.inf, np.zeros(41)
    for t in range(1, 20_000):
        v = v - (v - (y * (y * (x @ v) < 1)) @ x) / t
        best = min(best, objective(v))
    assert objective(found) <= 1.02 * best
    with pytest.raises(ValueError, match="no convergence in 1 epochs"):
        classifier.descend(rows, y, ratio, epochs=1)


def test_classifier_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (10, 0), (11, None), (None, 1), (8, 1)], "doc_id bigint, quality int")
    rows = classifier.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.quality(empty, labels).count() == 0
    assert {round(r["score"], 3) for r in classifier.quality(docs, labels.filter("false")).collect()} == {0.5}


# 10 Chats


def test_snapshots_collapse(spark):
    turns = [
        (1, 0, "user", "a"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"),
        (3, 5, "user", "a"), (3, 9, "assistant", "b"), (3, None, "user", None),
        (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", ""),
        (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", ""),
        (None, 0, "user", "a"), (None, 0, None, "a"),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, place int")
    rows = {(r["conv_id"], r["n_turns"], r["n_equal"]) for r in chat.chats(frame).collect()}
    assert rows == {(3, 3, 1), (4, 3, 2), (None, 1, 1)}
    assert chat.chats(frame.filter("false")).count() == 0


def test_a_conversation_of_a_third_of_all_turns(spark, result):
    """Prefix hashes of conversations cut into ranges are those of whole ones."""
    rows = [(7, i, "user", f"t{i % 50}") for i in range(2000)]
    rows += [(1000 + c, i, "user", f"t{i % 50}") for c, n in ((0, 1999), (1, 3), (2, 2000)) for i in range(n)]
    rows += [(2000 + c, i, "user", f"own {c}") for c in range(40) for i in range(5)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in result(chat.chats(frame))}
    assert set(got) == {7, *range(2000, 2040)}
    assert (got[7]["n_turns"], got[7]["n_equal"]) == (2000, 2)
    assert got[7]["chat"] == "".join(f"<|im_start|>user\nt{i % 50}<|im_end|>\n" for i in range(2000))
    hashed = result(chat.prefix_hashes(frame).filter("conv_id in (7, 1000)"))
    by = {(r["conv_id"], r["place"]): (r["p1"], r["p2"]) for r in hashed}
    assert all(by[7, i] == by[1000, i] for i in range(1, 2000)) and len(by) == 3999


# Pipeline


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    names = docs.columns
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.stored(stage(spark, rows, SF), name)
        assert rows.columns == names
    ids = [r["doc_id"] for r in rows.collect()]
    assert set(ids) <= {1, 2, 3, None, 8}
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).filter("length > 2048").count() == 0


def test_pipeline_keeps_one_of_each_group(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in kept)[8] == 1
    assert len([r for r in kept if r["doc_id"] in (1, 2, 3, None)]) == 1
    assert len([r for r in kept if r["doc_id"] in (4, 5, 7)]) == 3

"""Decontamination against a plain scan of every place."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tallymix.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n_words bigint, segment string, window int"
ITEMS = "item_id bigint, text string, terms string, doc_id int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, slop=contamination.SLOP):
    """(doc_id, n_words, n_hit, n_items, sha, contaminated, n_near_items) of each document."""
    count = Counter(w for _, t in docs for w in words(t))
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, exact, near = set(), set(), set()
        for terms, of in windows.items():
            m = len(terms)
            starts = [i for i in range(len(w) - m + 1) if tuple(w[i : i + m]) == terms]
            hit |= {i + k for i in starts for k in range(m)}
            exact |= of if starts else set()
            anchor = min(range(m), key=lambda k: (count[terms[k]], k))
            for p in (p for p, x in enumerate(w) if x == terms[anchor]):
                at = p - anchor
                if all(terms[k] in w[max(at + k - slop, 0) : max(at + k + slop + 1, 0)] for k in range(m) if k != anchor):
                    near |= of
        sha = hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(exact), sha, bool(hit), len(near)))
    return sorted(out, key=str)


def run(spark, docs, items, slop=contamination.SLOP):
    d = spark.createDataFrame([(*r, 7, "s", 0) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "x", 1) for r in items], ITEMS)
    return sorted((tuple(r) for r in contamination.contaminated(d, b, slop).collect()), key=str)


PASSAGE = "Alpha beta, gamma-delta 12 épsilon ZETA eta theta iota kappa lambda mu nu."
ITEM_ROWS = [
    (1, PASSAGE), (2, "one two three"), (3, None), (4, " .,; "), (5, "the"), (5, "of the"), (None, "beta gamma"),
    (6, "x y x y x y x y x y x y"), (7, PASSAGE), (8, "never seen words " * 5),
]
DOC_ROWS = [
    (1, "Before " + PASSAGE + " after"), (2, PASSAGE.upper()), (3, PASSAGE.replace("eta ", "eta extra ")), (4, None), (5, ""),
    (6, "one, two; three! one two\nthree"), (7, "two three"), (8, "x y " * 12), (None, "the of the"), (None, "the of the"),
    (9, "alpha beta gamma delta 12 épsilon"), (10, "zeta eta theta iota kappa lambda mu nu"), (11, " . "),
    (12, "Kelvin one two THREE éone"), (13, "common " * 30000 + PASSAGE), (1, PASSAGE),
]


@pytest.mark.parametrize("segment", [1 << 21, 200])
def test_odd_rows_against_a_scan(spark, monkeypatch, segment):
    monkeypatch.setattr(contamination, "SEGMENT", segment)
    assert run(spark, DOC_ROWS, ITEM_ROWS) == plainly(DOC_ROWS, ITEM_ROWS)


def test_random_rows_against_a_scan(spark):
    rng = np.random.default_rng(0)
    some = lambda n: " ".join(rng.choice(list("abcde"), n, p=[0.5, 0.2, 0.15, 0.1, 0.05]))
    items = [(i, some(int(rng.integers(1, 14)))) for i in range(25)]
    docs = [(i, some(int(rng.integers(0, 80)))) for i in range(60)]
    docs += [(100 + i, some(7) + " " + t + " " + some(3)) for i, (_, t) in enumerate(items)]
    for slop in (0, 2):
        assert run(spark, docs, items, slop) == plainly(docs, items, slop)


def test_a_passage_in_a_third_of_all_rows(spark):
    docs = [(i, (PASSAGE if i % 3 == 0 else "") + f" own{i} words") for i in range(3000)]
    got = run(spark, docs, ITEM_ROWS[:2])
    assert sum(r[5] for r in got) == 1000 and {r[2:4] for r in got if r[5]} == {(14, 1)}


def test_empty_tables(spark):
    assert run(spark, [], ITEM_ROWS) == []
    assert {r[2:4] + r[5:] for r in run(spark, DOC_ROWS, [])} == {(0, 0, False, 0)}
    assert {r[2:4] + r[5:] for r in run(spark, DOC_ROWS, [(1, None), (2, "")])} == {(0, 0, False, 0)}


def test_places_of_matches(spark):
    d = spark.createDataFrame([(1, "a b c a b c"), (2, "x a y b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, "a b c")], "item_id bigint, text string")
    index, windows = contamination.build_index(d), contamination.windows_of(b)
    found = contamination.search(index, contamination.rarest_first(index, windows)).filter("window is not null")
    got = {(r["doc_id"], r["first_word"], r["n_exact"], r["n_near"]) for r in found.collect()}
    assert got == {(1, 0, 2, 2), (2, 1, 0, 1)}

"""Whole predictions against plain Python, and the cases that need no data."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tallymix.llm import common, embeddings, language, licenses, quality_rules

SF = "/root/testdata/sf0.001"


def table(spark, name, d=SF):
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1 Embeddings


def test_vectors_of_the_given_table(spark):
    """Recall on the given vectors with some moved close to others; components of all links found."""
    source = table(spark, "embeddings", "/root/testdata/sf0.01").toPandas()
    rng = np.random.default_rng(3)
    x = np.stack(source["embedding"]).astype(float)
    near = x[rng.integers(0, len(x), 300)]
    x = np.concatenate([x, near + rng.normal(size=near.shape) * rng.uniform(0.0, 0.06, (300, 1))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((unit @ unit.T) >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert links.sum() > 300 and sum(r["n_links"] for r in got) >= 0.9 * links.sum()
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] <= links[i].sum() for i in range(len(x)))


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, group bigint, size long, codes string, links int"
    more = (5, 6, "x", 7)
    empty = spark.createDataFrame([], schema)
    assert embeddings.near_vectors(empty).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert embeddings.near_vectors(empty).count() == 0
    v, w = [1.0, 0.5, 0.0, 0.2], [0.0, 0.0, 1.0, 0.0]
    rows = [(3, v), (3, v), (None, v), (7, w), (None, w), (9, None), (None, [0.0] * 4)]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, *more) for r in rows], schema)).collect()
    found = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert found == Counter(
        {(3, 2, 3, True): 2, (None, 2, 3, False): 1, (7, 1, 7, True): 1, (None, 1, 7, False): 1, (9, 0, 9, True): 1, (None, 0, None, False): 1}
    )


# 6 Language


def plain_model(rows):
    """Letters by bucket and language, from one letter at a time."""
    buckets, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for word in plain_words(text):
            for b in word["buckets"]:
                buckets[lang][b] += 1
            scripts[lang][word["script"]] += len(word["buckets"])
    langs = sorted(buckets)
    sums = {x: sum(buckets[x].values()) for x in langs}
    log = lambda x, b: math.log((buckets[x][b] + 0.5) / (sums[x] + 0.5 * language.BUCKETS))

    def score(word):
        used = [x for x in langs if scripts[x][word["script"]] >= max(language.SHARE * max(sum(scripts[x].values()), 1), 1)]
        out = []
        for x in langs:
            value = sum(log(x, b) - sum(log(y, b) for y in langs) / len(langs) for b in word["buckets"])
            out.append(value + (0.0 if x in used or not used else -1e4))
        return out

    return langs, score


def plain_words(text):
    starts = sorted(language.SCRIPTS)
    is_letter = lambda c: unicodedata.category(c)[0] == "L"
    lowered = "\n" + (text or "").lower() + "\n"
    code = [ord(c) if is_letter(c) else 0 for c in lowered]
    words, now = [], None
    for i in range(1, len(lowered) - 1):
        if not code[i]:
            now = None
            continue
        v = (code[i] * 0x9E3779B1 + code[i - 1] * 0x85EBCA77 + code[i + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
        v ^= v >> 15
        if now is None:
            block = max(s for s in starts if s <= code[i])
            now = {"script": language.SCRIPTS[block], "buckets": []}
            words.append(now)
        now["buckets"].append(((v * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16)
    return words


def test_languages_against_one_word_at_a_time(spark):
    docs = [r for r in table(spark, "documents").select("text", "lang").collect() if len(r["text"]) < 6000][:70]
    train, ask = docs[:50], [r["text"] for r in docs[40:]] + [None, "", "12", docs[0]["text"][:200] + " " + docs[1]["text"][:200]]
    langs, score = plain_model([(r["text"], r["lang"]) for r in train])
    frame = spark.createDataFrame([(r["text"], r["lang"]) for r in train], "text string, lang string")
    model = language.learn(frame)
    assert model.langs == langs
    for text, (got, share, _) in zip(ask, language.judged(model, ask)):
        words = plain_words(text)
        if not words:
            assert (got, share) == ("und", 0.0)
            continue
        value, back = score(words[0]), []
        for w in words[1:]:
            top = max(range(len(langs)), key=lambda k: value[k])
            own = score(w)
            back.append([k if value[k] >= value[top] - language.SWITCH else top for k in range(len(langs))])
            value = [max(value[k], value[top] - language.SWITCH) + own[k] for k in range(len(langs))]
        state = max(range(len(langs)), key=lambda k: value[k])
        weight = Counter({state: len(words[-1]["buckets"])})
        for w, b in zip(reversed(words[:-1]), reversed(back)):
            state = b[state]
            weight[state] += len(w["buckets"])
        main, n = weight.most_common(1)[0]
        assert got == langs[main] and share == pytest.approx(n / sum(weight.values()), abs=0.02)


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    frame = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.learn(frame)


# 7 Licences


def test_added_labels_against_a_scan(spark):
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()]
    notices = [n for _, n, _ in licenses.TEMPLATES]
    texts += [f"intro {n}. outro" for n in notices] + [p for _, _, p in licenses.TEMPLATES]
    texts += [" ".join(n.split()[: len(n.split()) // 2]) for n in notices] + [" and ".join(notices[:6]), ""]
    got = {r["doc_id"]: r for r in licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        labels, best = set(), 0.0
        for t, (label, notice, phrase) in enumerate(licenses.TEMPLATES):
            n, p = notice.split(), phrase.split()
            lead = next(k for k in range(len(n)) if n[k : k + len(p)] == p)
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    same = sum(0 <= at - lead + k < len(words) and words[at - lead + k] == w for k, w in enumerate(n))
                    best = max(best, same / len(n))
                    labels |= {label} if t < licenses.BASE or same / len(n) >= licenses.COVERED else set()
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), pytest.approx(best))
    assert len({r["labels"] for r in got.values()}) > 10


# 8 Quality rules


def plain_votes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w, n = max(len(words), 1), len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    many = Counter(windows)
    repeat = len({i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)})
    chars = sum(map(len, words))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    other = sum(unicodedata.category(c)[0] != "L" and c not in " \t\n\x0b\x0c\r" for c in text)
    closed = sum(x.strip(" \t\n\x0b\x0c\r")[-1] in ".!?" for x in lines)
    distinct, L, c = len(set(words)), max(len(lines), 1), max(chars, 1)
    symbols, marked = len(re.findall(r"[#*$%&|<>]", text)), len(re.findall(r"[#*$%&|<>]+", text))
    rules = [
        (n >= 70, n < 50),
        (2.5 <= chars / w <= 12, chars / w < 1.5 or chars / w > 20),
        (symbols / w < 0.05, symbols / w > 0.2),
        (marked / w < 0.05, marked / w > 0.15),
        (other / c < 0.1, other / c > 0.2),
        (repeat / w < 0.1, repeat / w > 0.3),
        ((len(lines) - len(set(lines))) / L < 0.1, (len(lines) - len(set(lines))) / L > 0.3),
        (upper / c < 0.1, upper / c > 0.3),
        (n >= 30 and distinct >= 40, n >= 30 and distinct / w < 0.1 and distinct < 40),
        (closed / L >= 0.5, closed == 0),
    ]
    return [0 if bad else 1 if good else None for good, bad in rules], n < 50 or 100 * repeat > 50 * n


def test_verdicts_against_em_over_documents(spark):
    """The same model fitted document by document instead of by combinations of votes."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    votes, failed = zip(*(plain_votes(t) for t in docs.values()))
    v = np.array([[np.nan if x is None else x for x in row] for row in votes])
    cast, good = ~np.isnan(v), np.nan_to_num(v) == 1
    bad_votes = (cast & ~good).sum(axis=1)
    p = np.choose(np.minimum(bad_votes, 2), [0.95, 0.5, 0.05])
    for _ in range(3000):
        share = (p.sum() + 1) / (len(p) + 2)
        rate = [((w[:, None] * good).sum(axis=0) + 1) / ((w[:, None] * cast).sum(axis=0) + 2) for w in (p, 1 - p)]
        odds = np.log(share / (1 - share)) + np.where(
            cast, np.where(good, np.log(rate[0] / rate[1]), np.log((1 - rate[0]) / (1 - rate[1]))), 0.0
        ).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
    got = {r["doc_id"]: r for r in quality_rules.scored(table(spark, "documents"), common.stored).collect()}
    for i, doc in enumerate(docs):
        assert got[doc]["p_good"] == pytest.approx(p[i], abs=1e-6)
        assert got[doc]["base_failed"] == failed[i] and got[doc]["kept"] == (not failed[i] and p[i] >= 0.5)


def test_votes_that_do_not_settle_raise(monkeypatch):
    monkeypatch.setattr(quality_rules, "ROUNDS", 1)
    with pytest.raises(ValueError, match="did not settle"):
        quality_rules.fit([((1, 1, 0), 40), ((0, 1, 1), 30), ((0, 0, 0), 20)])


# Pipeline


def test_pipeline_of_nothing(spark):
    """Every stage on an empty table of documents keeps its columns and gives no row."""
    rows = table(spark, "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, rows, SF), name)
        assert out.columns == rows.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == 0


def test_pipeline_with_clear_and_unclear_ids(spark):
    """doc_id serves as the row number where it can; the rows kept are the same."""
    text = " ".join(f"word{i} the and of" for i in range(60)) + "."
    rows = [(5, text, "en", "a"), (2, text, "en", "b"), (9, text.replace("word3 ", "x "), "en", "a"), (11, "other " + text[::-1], "en", "a")]
    clear = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, clear, SF).collect())
    assert kept == [2, 11]
    unclear = clear.union(spark.createDataFrame([(5, "one more text", "en", "a"), (None, text, "en", "a")], clear.schema))
    found = corpus_pipeline.near_duplicates(spark, unclear, SF).collect()
    assert len(found) == 3 and len([r for r in found if r["text"].startswith("word0")]) == 1

"""Language identification of mixed-language texts.

1. A word is a run of letters; the ranges of its script leave only the languages that use
   this script in the training texts.
2. Each candidate scores the word by the log-probabilities of its letters with their
   neighbours, learned as hashed counts over all training texts.
3. Viterbi over a text's words, with a penalty for switching language, labels every word.
   Runs of one label are spans; the language of most letters is the text's, and its share
   of the letters is the score.

Counts per language and hash bucket are all that reaches the driver; languages are few.
Viterbi runs over stretches of words side by side, each for every state before it, and the
stretches of a text are then chained; the result is that of one pass over the text.

Null texts and those without a letter are ``und`` with score 0. Training leaves out null
languages, texts and ids. With nothing to learn from, every text is ``und``. Repeated
rows get the same result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymix.llm.tokens import slices

BUCKETS = 1 << 16
SWITCH = 20.0
STRETCH = 128
#: Entries of a table of words x languages x languages.
ROOM = 1 << 24
#: Most languages of a model: a megabyte of broadcast table is four of them.
MOST_LANGUAGES = 1_000
#: A language is a candidate for a script from this share of its letters on.
SHARE = 0.001
UND = "und"

#: First code points of script blocks. Other blocks count as the one before.
SCRIPTS = {
    0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew",
    0x0600: "Arabic", 0x0700: "Syriac", 0x0750: "Arabic", 0x0780: "Thaana", 0x0900: "Devanagari",
    0x0980: "Bengali", 0x0A00: "Gurmukhi", 0x0A80: "Gujarati", 0x0B00: "Odia", 0x0B80: "Tamil",
    0x0C00: "Telugu", 0x0C80: "Kannada", 0x0D00: "Malayalam", 0x0D80: "Sinhala", 0x0E00: "Thai",
    0x0E80: "Lao", 0x0F00: "Tibetan", 0x1000: "Myanmar", 0x10A0: "Georgian", 0x1100: "Hangul",
    0x1200: "Ethiopic", 0x1780: "Khmer", 0x1800: "Mongolian", 0x1E00: "Latin", 0x1F00: "Greek",
    0x2000: "Latin", 0x3040: "Kana", 0x3100: "Han", 0x3130: "Hangul", 0x3190: "Han",
    0xAC00: "Hangul", 0xF900: "Han", 0xFB50: "Arabic", 0xFF00: "Latin", 0x20000: "Han",
}
STARTS = np.array(sorted(SCRIPTS), dtype=np.uint32)
NAMES = sorted(set(SCRIPTS.values()))
NUMBER = np.array([NAMES.index(SCRIPTS[s]) for s in STARTS.tolist()])

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    return _letters


class Words:
    """Letter runs of several texts: buckets of the letters, first letters, scripts."""

    def __init__(self, texts: Sequence[str | None]):
        lowered = [(t or "").lower() + "\n" for t in texts]
        code = np.frombuffer("".join(["\n", *lowered, "\n"]).encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = letters()[code]
        code = np.where(letter, code, 0)
        at = np.flatnonzero(letter)
        value = code[at] * np.uint32(0x9E3779B1) + code[at - 1] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
        value ^= value >> np.uint32(15)
        self.buckets = (value * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 16)
        first = np.flatnonzero(~letter[at - 1])
        self.first = first
        self.length = np.diff(np.append(first, len(at)))
        self.script = NUMBER[np.searchsorted(STARTS, code[at[first]], side="right") - 1]
        ends = 1 + np.cumsum([0, *map(len, lowered)])
        self.of = np.searchsorted(at[first], ends)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, at, n): letters by bucket (kind 0) and by script (kind 1)."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            total = totals.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
            for a, b in slices(own):
                w = Words(own[a:b])
                total[0][:] += np.bincount(w.buckets, minlength=BUCKETS)
                total[1][:] += np.bincount(w.script, w.length, minlength=len(NAMES)).astype(np.int64)
    for lang, pair in totals.items():
        for kind, counts in enumerate(pair):
            at = np.flatnonzero(counts)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(at), pa.array(counts[at])],
                ["lang", "kind", "at", "n"],
            )


class Model:
    """Log-probabilities per bucket and language, relative to their mean, and scripts."""

    def __init__(self, langs: list[str], buckets: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:  # nothing was learned; no text is scored
            return
        logs = np.log((buckets + 0.5) / (buckets.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        self.logs = np.ascontiguousarray((logs - logs.mean(axis=0)).T.astype(np.float32))
        used = scripts >= SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        used &= scripts > 0
        none = ~used.any(axis=0)  # a script of no language leaves all of them
        self.barred = np.where(used | none, 0.0, -1e4).T.astype(np.float32)


def learn(docs: DataFrame) -> Model:
    """The model of rows (text, lang) without nulls; more than ``MOST_LANGUAGES`` values raise."""
    some = docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if some > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: tags are not clean")
    counts = docs.select("text", "lang").mapInArrow(counted, "lang string, kind int, at bigint, n bigint")
    table = counts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, at, n = (table.column(c).to_numpy() for c in ("lang", "kind", "at", "n"))
    langs = sorted(set(lang.tolist()))
    row = np.array([langs.index(x) for x in lang.tolist()], dtype=np.int64)
    sums = [np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(NAMES)))]
    for k in (0, 1):
        own = kind == k
        sums[k][row[own], at[own]] = n[own]
    return Model(langs, *sums)


def best_path(scores: np.ndarray, of: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """State of each word on the best path of its text; ``of`` bounds the texts' words.

    Texts go side by side while their words times languages squared stay below ``ROOM``;
    a longer one goes by itself in one pass, which needs words times languages.
    """
    k, path, start = scores.shape[1], np.zeros(len(scores), dtype=np.int64), 0
    ends = of.tolist()
    while start < len(ends) - 1:
        end = start + 1
        while end < len(ends) - 1 and (ends[end + 1] - ends[start]) * k * k <= ROOM:
            end += 1
        part = slice(ends[start], ends[end])
        if (ends[end] - ends[start]) * k * k <= ROOM:
            path[part] = paths_abreast(scores[part], of[start : end + 1] - of[start], switch)
        else:
            path[part] = path_of_one(scores[part], switch)
        start = end
    return path


def path_of_one(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best path of one text, word by word."""
    n, k = scores.shape
    states = np.arange(k, dtype=np.min_scalar_type(max(k - 1, 0)))
    back, value = np.zeros((n, k), dtype=states.dtype), scores[0].astype(np.float64)
    for t in range(1, n):
        top = value.argmax()
        stay = value >= value[top] - switch
        back[t] = np.where(stay, states, states[top])
        value = np.where(stay, value, value[top] - switch) + scores[t]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def paths_abreast(scores: np.ndarray, of: np.ndarray, switch: float) -> np.ndarray:
    """The same of several texts, by stretches of ``STRETCH`` words side by side."""
    n, k = scores.shape
    count = np.diff(of)
    pieces = -(-count // STRETCH)
    text = np.repeat(np.arange(len(count)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = of[:-1][text] + number * STRETCH
    length = np.minimum(STRETCH, of[1:][text] - start)

    # Best scores within each stretch, from every state before it to every state at its end.
    order = np.argsort(-length, kind="stable")
    s, active = start[order], np.searchsorted(-length[order], -np.arange(STRETCH), side="left")
    best = scores[s][:, None, :] - switch * (1 - np.eye(k, dtype=np.float32))
    small = np.min_scalar_type(max(k - 1, 0))
    back = np.zeros((n, k, k), dtype=small)
    states = np.arange(k, dtype=small)
    for t in range(1, STRETCH):
        m = active[t]
        if not m:
            break
        now = best[:m]
        top = now.argmax(axis=2)
        jump = np.take_along_axis(now, top[:, :, None], axis=2) - switch
        stay = now >= jump
        back[s[:m] + t] = np.where(stay, states, top[:, :, None])
        best[:m] = np.where(stay, now, jump) + scores[s[:m] + t][:, None, :]
    within = np.empty_like(best)
    within[order] = best

    # Chain the stretches of each text, then walk back.
    first = np.cumsum(pieces) - pieces
    value, came = np.zeros((len(count), k)), np.zeros((len(text), k), dtype=small)
    for t in range(int(pieces.max(initial=0))):
        live = np.flatnonzero(pieces > t)
        total = value[live][:, :, None] + within[first[live] + t]
        came[first[live] + t] = total.argmax(axis=1)
        value[live] = total.max(axis=1)
    state, end, before = value.argmax(axis=1), np.zeros(len(text), int), np.zeros(len(text), int)
    for t in range(int(pieces.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(pieces > t)
        at = first[live] + t
        end[at] = state[live]
        state[live] = came[at, state[live]]
        before[at] = state[live]
    path, now, j = np.zeros(n, dtype=np.int64), end[order], before[order]
    for t in range(STRETCH - 1, -1, -1):
        m = active[t]
        path[s[:m] + t] = now[:m]
        if t:
            now[:m] = back[s[:m] + t, j[:m], now[:m]]
    return path


def word_scores(model: Model, words: Words) -> np.ndarray:
    if not len(words.first):
        return np.zeros((0, len(model.langs)), dtype=np.float32)
    ends, out, a = np.append(words.first[1:], len(words.buckets)), [], 0
    while a < len(ends):  # letters by languages, some words at a time
        b = max(int(np.searchsorted(ends, words.first[a] + ROOM // len(model.langs), side="right")), a + 1)
        logs = model.logs[words.buckets[words.first[a] : ends[b - 1]]]
        out.append(np.add.reduceat(logs, words.first[a:b] - words.first[a], axis=0) + model.barred[words.script[a:b]])
        a = b
    return np.concatenate(out)


def judged(model: Model, texts: Sequence[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text; a span is (language, first word, words)."""
    words = Words(texts)
    if not model.langs:
        yield from ((UND, 0.0, []) for _ in texts)
        return
    path = best_path(word_scores(model, words), words.of)
    k = len(model.langs)
    text = np.repeat(np.arange(len(texts)), np.diff(words.of))
    weight = np.bincount(text * k + path, words.length, minlength=len(texts) * k).reshape(-1, k)
    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])])[: len(path)])
    ends = np.append(new[1:], len(path))
    at = np.searchsorted(new, words.of)
    for i, (total, main) in enumerate(zip(weight.sum(axis=1).tolist(), weight.argmax(axis=1).tolist())):
        own = range(at[i], at[i + 1])
        spans = [(model.langs[path[new[x]]], int(new[x] - words.of[i]), int(ends[x] - new[x])) for x in own]
        yield (model.langs[main], float(weight[i, main] / total), spans) if total else (UND, 0.0, [])


def identified(docs: DataFrame, model: Model, names: Sequence[str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """``docs`` (text, ..) with language, score and spans under ``names``, in place of such columns."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                found = list(judged(shared.value, texts[a:b]))
                spans = [[{"lang": x, "first": f, "words": n} for x, f, n in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).columns,
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.array(spans, pa.list_(span)),
                    ],
                    [*batch.schema.names, *names],
                )

    kinds = ("string", "double", "array<struct<lang:string,first:bigint,words:bigint>>")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds))])
    return docs.mapInArrow(rows, schema)


def held_out() -> Column:
    """Rows that no model may learn from; those with a null id are in neither part."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    known = "doc_id is not null and lang is not null and text is not null"
    return docs.filter(known).filter(~held_out()).select("text", "lang")

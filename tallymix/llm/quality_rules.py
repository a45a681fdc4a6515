"""Quality rules under weak supervision: votes, estimated accuracies, a posterior.

Each rule looks at one property of a text and votes good, bad, or abstains. How often a
rule is right is not given: expectation-maximisation estimates, from how the rules agree
over all documents, the share of good documents and each rule's rate of good votes among
good and among bad ones. A document's posterior probability of being good follows from
its votes, and it is kept at ``KEEP`` or more. No rule is a gate of its own but the
documented floor (``base_failed``).

Votes take few combinations (at most 3 to the number of rules), so the model is fitted on
counts per combination and the posterior is joined back as one value per combination.
Features are array functions within each row: no text is shuffled.

Null and empty texts have no words and fail the floor. Repeated rows get the same result.
An empty table gives an empty result. Columns of ``docs`` with the names of results are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
KEEP = 0.5
#: Most rounds of expectation-maximisation; they end when no posterior moves by ``CLOSE``.
ROUNDS = 5_000
CLOSE = 1e-9
#: Votes that every rate starts with, so that none is 0 or 1.
PRIOR = 1.0
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_closed_lines", "n_other", "n_marked"]


def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once a row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    Windows are hashed and sorted with their places; equal neighbours are repeats.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.zip_with(
            F.transform(
                F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), i.alias("i")),
            ),
            F.slice(words, 3, F.size(words)),
            lambda p, c: F.struct(F.xxhash64(p["a"], p["b"], c).alias("h"), p["i"].alias("i"), c.isNotNull().alias("whole")),
        ),
    )
    whole = F.array_sort(F.filter(windows, lambda w: w["whole"]))

    def places(s: Column) -> Column:
        ahead = F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))
        pairs = F.zip_with(s, ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        second, third = F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)
        return F.size(F.array_distinct(F.concat(p, second, third)))

    return F.coalesce(bind(whole, lambda s: bind(places(s), covered)), F.lit(0)).cast("long")


def features(text: Column) -> dict[str, Column]:
    """Properties of a text; each is a long."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(WHITE)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(l: Column) -> Column:
        closed = F.filter(l, lambda x: F.substring(F.btrim(x, F.lit(WHITE)), -1, 1).isin(".", "!", "?"))
        return F.struct(
            F.size(l).cast("long").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            F.size(closed).cast("long").alias("n_closed_lines"),
        )

    word, line = bind(words, of_words), bind(lines, of_lines)
    return {
        "__w": word,
        "__l": line,
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_other": F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long"),
        "n_marked": F.regexp_count(text, F.lit(r"[#*$%&|<>]+")).cast("long"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ..) with the features and ``base_failed``."""
    out = docs.drop(*FEATURES, *MORE, "base_failed").withColumns(features(F.col("text")))
    out = out.select("*", "__w.*", "__l.*").drop("__w", "__l")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null abstains."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    width, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    repeats, copies = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    upper, fresh, closed = F.col("n_upper") / chars, F.col("n_distinct_words") / words, F.col("n_closed_lines") / lines
    long_enough = F.col("n_words") >= 30
    return {
        "v_length": vote(F.col("n_words") >= 70, F.col("n_words") < 50),
        "v_width": vote((width >= 2.5) & (width <= 12), (width < 1.5) | (width > 20)),
        "v_symbols": vote(symbols < 0.05, symbols > 0.2),
        "v_marked": vote(F.col("n_marked") / words < 0.05, F.col("n_marked") / words > 0.15),
        "v_other": vote(F.col("n_other") / chars < 0.1, F.col("n_other") / chars > 0.2),
        "v_repeats": vote(repeats < 0.1, repeats > 0.3),
        "v_copies": vote(copies < 0.1, copies > 0.3),
        "v_upper": vote(upper < 0.1, upper > 0.3),
        "v_fresh": vote(long_enough & (F.col("n_distinct_words") >= 40), long_enough & (fresh < 0.1) & (F.col("n_distinct_words") < 40)),
        "v_closed": vote(closed >= 0.5, closed == 0),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]]) -> dict:
    """EM over vote combinations and their counts; start: two bad votes make a bad document.

    Returns the share of good documents and, per rule, the rates of good votes among good
    and among bad documents.
    """
    total = sum(n for _, n in patterns)
    width = len(patterns[0][0]) if patterns else 0
    post = []
    for votes, _ in patterns:
        post.append((0.95, 0.5)[votes.count(0)] if votes.count(0) < 2 else 0.05)
    share, rates = 0.5, [(0.8, 0.2)] * width
    for _ in range(ROUNDS):
        share = (sum(p * n for p, (_, n) in zip(post, patterns)) + PRIOR) / (total + 2 * PRIOR)
        rates = []
        for r in range(width):
            pair = []
            for own in (lambda p: p, lambda p: 1 - p):
                cast = [(own(p) * n, v[r]) for p, (v, n) in zip(post, patterns) if v[r] is not None]
                good = sum(w for w, v in cast if v == 1)
                pair.append((good + PRIOR) / (sum(w for w, _ in cast) + 2 * PRIOR))
            rates.append(tuple(pair))
        new = [posterior(v, share, rates) for v, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(new, post)), default=0.0)
        post = new
        if moved < CLOSE:
            return {"share": share, "rates": rates}
    raise ValueError(f"votes did not settle in {ROUNDS} rounds: the last moved a posterior by {moved:.1e}")


def posterior(votes: tuple[int | None, ...], share: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(share) - math.log(1 - share)
    for v, (good, bad) in zip(votes, rates):
        if v is not None:
            odds += math.log(good / bad) if v else math.log((1 - good) / (1 - bad))
    return 1 / (1 + math.exp(-max(min(odds, 700.0), -700.0)))


def learned(rows: DataFrame) -> tuple[dict, DataFrame]:
    """The model of measured rows, and (votes.., p_good) per combination of votes."""
    votes = rules()
    counts = rows.select(*[c.alias(k) for k, c in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n"))
    found = counts.collect()  # at most 3 ** len(rules) rows
    patterns = sorted(((tuple(r[k] for k in votes), r["n"]) for r in found), key=str)
    model = fit(patterns)
    return model, patterns


def p_good(model: dict) -> Column:
    """Posterior of a measured row as one expression: the sum of its votes' log odds."""
    share = model["share"]
    odds = F.lit(math.log(share) - math.log(1 - share))
    for vote, (good, bad) in zip(rules().values(), model["rates"]):
        odds = odds + F.when(vote == 1, math.log(good / bad)).when(vote == 0, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def scored(docs: DataFrame, store) -> DataFrame:
    """``docs`` (doc_id, text, ..) without text: features, base_failed, p_good and kept.

    ``store`` keeps the features, so that texts are read once.
    """
    rows = store(measured(docs.select("doc_id", "text")).drop("text"), "quality-features")
    model, _ = learned(rows)
    return with_verdict(rows, model)


def with_verdict(rows: DataFrame, model: dict) -> DataFrame:
    rows = rows.withColumn("p_good", p_good(model))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def filtered(docs: DataFrame, store) -> DataFrame:
    """The rows of ``docs`` (text, ..) that are kept, with features and verdict.

    ``store`` keeps the measured rows, from which votes are learned and applied.
    """
    rows = store(measured(docs), "quality-features")
    model, _ = learned(rows)
    return with_verdict(rows, model).filter("kept")

"""Whitening against a dense eigendecomposition; fill-in-middle against plain Python."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tallymix.llm import middle, whitening

# 12 Whitening


def brute(x: np.ndarray, k: int):
    c = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(c.T @ c / len(x))
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return value, (c @ vector) / np.sqrt(value)


def matrix(rows, name="whitened"):
    ids = sorted({r["vec_id"] for r in rows})
    k = max(r["component"] for r in rows)
    out = np.full((len(ids), k), np.nan)
    for r in rows:
        out[ids.index(r["vec_id"]), r["component"] - 1] = r[name]
    return out


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, component string")


def test_whitening_of_the_given_vectors(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whitening.whitened(source).collect()
    table = source.orderBy("vec_id").toPandas()
    x = np.floor(np.stack(table["embedding"]).astype(float) * 1024).astype(np.int64) + 100_000
    value, want = brute(x, 8)
    w = matrix(got)
    w *= np.sign((w * want).sum(axis=0))
    assert np.abs(w - want).max() < 1e-9
    n, s = len(x), x.sum(axis=0)
    assert matrix(got, "deviation")[:, 0].astype(np.int64).tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert {r["n"] for r in got} == {n} and len(got) == 8 * n
    assert max(r["identity_error"] for r in got) < 1e-10 and max(r["residual"] for r in got) <= whitening.CERTIFIED
    trace = np.trace(np.cov(x.T, bias=True))
    explained = {r["component"]: r["explained"] for r in got}
    assert all(abs(explained[k + 1] / (value[k] / trace) - 1) < 1e-9 for k in range(8))


@pytest.mark.parametrize("top", [1.0, 1e3, 1e7])
def test_pairs_of_any_spectrum(top):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    value = np.concatenate([[5.0 * top], np.linspace(2, 1, 89)])
    v = (turn * value) @ turn.T
    calls = []
    got, vector, residual = whitening.leading_pairs(lambda q: calls.append(1) or v @ q, 90, 8)
    assert np.allclose(got, value[:8], rtol=1e-9) and residual.max() <= whitening.CERTIFIED * value[0]
    if top < 1e6:  # below that the floor of rounding lies under the gaps
        assert np.abs(np.abs((vector * turn[:, :8]).sum(axis=0)) - 1).max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    sound = rng.normal(size=(40, 5))
    odd = [None, [], [1, 2], [None, 1, 2, 3, 4], [float("nan")] * 5, [float("inf")] + [0] * 4]
    got = whitening.whitened(frame(spark, [*sound, *sound[:7], *odd])).collect()
    x = np.floor(np.concatenate([sound, sound[:7]]) * 1024) + 100_000
    value, want = brute(x, 5)
    w = matrix(got)
    assert w.shape == (47, 5)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    assert whitening.whitened(frame(spark, odd[:2])).count() == 0
    assert whitening.whitened(frame(spark, [])).count() == 0


def test_vectors_without_variance(spark):
    same = whitening.whitened(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, 0.0, 0.0, 0)}
    line = whitening.whitened(frame(spark, [[i, 2.0 * i, 3.0] for i in range(9)])).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["vec_id"], r["component"]))] == [False, True, True] * 9
    assert line[0]["identity_error"] < 1e-9
    huge = whitening.whitened(frame(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]])).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)


def test_exact_deviations_of_wide_sums():
    rng = np.random.default_rng(3)
    for width in (10, 1 << 20, 1 << 40):
        x = rng.integers(-width, width, (6, 4))
        total = [int(v) for v in x.sum(axis=0)]
        want = [sum((6 * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
        assert whitening.deviations(x, 6, total) == [v if v < 1 << 63 else None for v in want]


# 13 Fill in the middle


def plainly(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [
    None, "", "a", "é", "中文字", "a😀b" * 50, "<P", "x<P>y", "<S", "M><M>", "P><", "<S><M", "\x00\x01", "a\r\nb\n", "́é", "𝄞" * 9,
    "<" * 30, "<M" * 20, "word " * 60000, "ünï" * 30000, "[PSM]", "\\<P\\>",
]


def test_outputs_against_plain_python(spark):
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(TEXTS * 15)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int")
    got = middle.transformed(docs).collect()
    want = [(r[0], *plainly(r[0], r[1])) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    report = middle.middle_report(docs).collect()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in report) == sorted((str(r[0]), digest(r[1])) for r in rows)
    assert sorted(r["output_sha256"] for r in report) == sorted(digest(w[-1]) for w in want)
    assert middle.middle_report(docs.filter("false")).count() == 0


def test_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aé中😀<PSM>"), rng.integers(0, 40))) for _ in range(300)]
    ids = list(range(300))
    h = rng.integers(0, 1 << 32, (4, 300))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts, **{f"h{k + 1}": h[k] for k in range(4)}})
    whole = pa.Table.from_batches(middle.transformed_rows(iter([batch])))
    for size in (1, 50, 1000):
        monkeypatch.setattr(middle, "CHUNK", size)
        cut = pa.Table.from_batches(middle.transformed_rows(iter([batch.slice(0, 100), batch.slice(100)])))
        assert cut.to_pydict() == whole.to_pydict()


def test_index_converts_both_ways():
    text = "aé中😀" * 7 + "plain" + "ß"
    index = middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    want = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == want.tolist()
    assert index.points(want).tolist() == list(range(len(text) + 1))
    assert len(index.at) == sum(not c.isascii() for c in text)

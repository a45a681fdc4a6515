"""Fill-in-middle transformation by a sparse exception index.

A text is cut at two code points into prefix, middle and suffix, and written with markers so
that a model learns to fill the middle in. Cuts are drawn in code points but made in bytes.
The index that converts them records only the multibyte characters: where each stands and how
many bytes it has beyond one. ASCII spans are not recorded; between two exceptions bytes and
code points differ by a constant, which ``searchsorted`` finds. One index serves all texts of
a chunk, whose bytes lie side by side.

Draws: h1 to h4 are the first four 8-digit groups of the hex sha256 of ``1:`` and the decimal
``doc_id``. The prefix ends after the smaller of h1 % (n+1) and h2 % (n+1) code points, the
middle after the larger. A text stays plain if it is empty, if it contains a marker (its
output could not be taken apart again) or if h3 % 100 >= 90; of the rest, h4 % 100 < 20 are
written suffix first.

Null text is empty. A null ``doc_id`` is hashed as no digits. Repeated rows are rows of their
own with equal results. Other columns are ignored; an empty table gives an empty result. A
batch is worked off in chunks of about ``CHUNK`` bytes; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 22
#: The markers and the shares of texts in each form, in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CUT_SHARE, SPM_SHARE = 90, 20


class Exceptions:
    """Multibyte characters of UTF-8 bytes: their positions and excess bytes."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.point = self.at - self.before[:-1]

    def points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position, which must begin a character or be the end."""
        return byte - self.before[np.searchsorted(self.at, byte)]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.before[np.searchsorted(self.point, point)]


def with_marker(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text, ending at ``ends``, contains a marker."""
    found = np.zeros(len(ends), dtype=bool)
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    text = np.searchsorted(ends, at, side="right")
    found[text[at + 2 < ends[text]]] = True
    return found


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1, a + 1)
        yield a, b
        a = b


def transformed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2] or b""
        draws = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        for a, b in chunks(offsets):
            start, end = int(offsets[a]), int(offsets[b])
            data = np.frombuffer(raw, np.uint8, end - start, start) if end > start else np.zeros(0, np.uint8)
            edges = offsets[a : b + 1] - start
            index = Exceptions(data)
            points = index.points(edges)
            n = np.diff(points)
            h1, h2, h3, h4 = (h[a:b] for h in draws)
            one, two = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            plain = (n == 0) | with_marker(data, edges[1:]) | (h3 % 100 >= CUT_SHARE)
            spm = ~plain & (h4 % 100 < SPM_SHARE)
            first, last = index.bytes(points[:-1] + low), index.bytes(points[:-1] + high)
            out, view = [], data.tobytes()
            for p, s, x, i, j, y in zip(*(v.tolist() for v in (plain, spm, edges[:-1], first, last, edges[1:]))):
                if p:
                    out.append(view[x:y])
                elif s:
                    out.append(b"".join((SUFFIX, view[j:y], PREFIX, view[x:i], MIDDLE, view[i:j])))
                else:
                    out.append(b"".join((PREFIX, view[x:i], SUFFIX, view[j:y], MIDDLE, view[i:j])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(n),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(low, mask=plain),
                    pa.array(high - low, mask=plain),
                    pa.array(out, pa.binary()),
                ],
                names,
            )


def transformed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text, ..)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")
    rows = docs.select("doc_id", "text", digest.alias("digest"))
    rows = rows.select("doc_id", "text", *[group(k) for k in (1, 2, 3, 4)])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(
        transformed_rows,
        f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary",
    )
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    No part holds a marker, and none can begin in a part and end in a marker beside it, so
    the output splits at its three markers only.
    """
    marks = "<[" + "".join(chr(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)) + "]>"
    part = F.split(output, marks, -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def middle_report(docs: DataFrame) -> DataFrame:
    """Digests of the outputs of ``docs`` and of the texts rebuilt from them."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same with characters cut by the database.
SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (
  select doc_id, t, n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
              then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (
  select *, substring(t, 1, lo) as pre, substring(t, lo + 1, hi - lo) as mid, substring(t, hi + 1, n - hi) as suf from c)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars,
       case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""

"""Splitting oversized items at natural boundaries.

Dynamic programming over boundary positions: a cut costs by the kind of boundary (paragraph, line, sentence, word,
inside a word) and each piece by the square of its distance from the even size; pieces are at most ``max_size``
characters and each next piece starts ``overlap`` characters before the end of the previous one. Positions inside a
word are candidates, every one of them, where no boundary lies within reach of the one before.

Defined cases: NULL and short contents give no rows; repeated rows count once by the item's key, rows without a key as one; sizes are Unicode code
points; cuts tear no CRLF pair and no sign from its combining marks, unless these alone exceed the size; a missing or wrong byte range of the item gives ranges relative to
the item, told by ``range_base``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PENALTY = {"paragraph": 0.0, "line": 0.2, "sentence": 0.5, "word": 2.0, "forced": 50.0}
KINDS = list(PENALTY)
BALANCE = 4.0
#: Added to a forced cut that tears what belongs together.
TORN = 1000.0
#: White space as regular expressions see it, ends of sentences, signs that belong to the one before.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
ENDS = np.array([ord(c) for c in ".!?։…"], dtype=np.uint32)
JOINED = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200D, 0x200D), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Cut positions (ends of white space) and the index in KINDS of each."""
    at, kind, _ = gaps(points(text))
    return at.tolist(), kind.tolist()


def gaps(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, kind and start of the white space between words."""
    space = np.zeros(len(u) + 2, dtype=bool)
    space[1:-1] = np.isin(u, SPACES)
    start, end = np.flatnonzero(space[1:] & ~space[:-1]), np.flatnonzero(space[:-1] & ~space[1:])
    keep = (start > 0) & (end < len(u))
    start, end = start[keep], end[keep]
    after = np.append(u[1:], 0)
    lines = np.cumsum(np.concatenate([[0], (u == 10) | ((u == 13) & (after != 10))]))
    n = lines[end] - lines[start]
    kind = np.where(n > 1, 0, np.where(n == 1, 1, np.where(np.isin(u[start - 1], ENDS), 2, 3)))
    return end, kind, start


def torn(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of the positions lie within a CRLF pair or before a combining mark."""
    x = u[p]
    out = (x == 10) & (u[p - 1] == 13)
    for lo, hi in JOINED:
        out |= (x >= lo) & (x <= hi)
    return out


def split_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, kind of the cut at the end)`` of the pieces; the last has kind 'end'."""
    n, reach = len(text), max_size - overlap
    if overlap < 0 or reach < 1:
        raise ValueError("overlap must be at least 0 and below the size")
    if n <= max_size:
        return [(0, n, "end")]
    u = points(text)
    pos, kinds, _ = gaps(u)
    cost = np.array([PENALTY[k] for k in KINDS])[kinds]
    edges = np.concatenate([[0], pos, [n]])
    wide = np.flatnonzero(np.diff(edges) > reach)
    if len(wide):  # gaps wider than a step need cuts inside
        inside = np.concatenate([np.arange(edges[g] + 1, edges[g + 1]) for g in wide.tolist()])
        forced = PENALTY["forced"] + TORN * torn(u, inside)
        order = np.argsort(np.concatenate([pos, inside]), kind="stable")
        kinds, cost = np.concatenate([kinds, np.full(len(inside), 4)])[order], np.concatenate([cost, forced])[order]
        pos = np.concatenate([pos, inside])[order]
    even = overlap + (n - overlap) / -(-(n - overlap) // reach)
    # (e - (p - overlap) - even)² = c² - 2cp + p² with c = e + overlap - even: p² joins the cost so far, one product and one minimum are left.
    ends = np.append(pos, n)
    q, c = pos / max_size, (ends + overlap - even) / max_size
    lows = np.maximum(np.searchsorted(pos, ends - reach), np.searchsorted(pos, overlap, side="right")).tolist()
    first = np.where(ends <= max_size, BALANCE * ((ends - even) / max_size) ** 2, np.inf).tolist()
    step, square = np.append(cost, 0.0).tolist(), (BALANCE * c * c).tolist()
    twice, own = (2 * BALANCE * c).tolist(), (BALANCE * q * q).tolist()
    sofar = np.full(len(pos), np.inf)
    back = [-1] * (len(pos) + 1)
    for j, lo in enumerate(lows):
        total = first[j]
        if lo < j:
            w = sofar[lo:j] - twice[j] * q[lo:j]
            i = int(w.argmin())
            if (other := float(w[i]) + square[j]) < total:
                total, back[j] = other, lo + i
        if j < len(pos):
            sofar[j] = total + step[j] + own[j]
    chain, j = [], len(pos)
    while j >= 0:
        chain.append(j)
        j = back[j]
    out, start = [], 0
    for j in reversed(chain):
        end = int(ends[j])
        out.append((start, end, "end" if j == len(pos) else KINDS[int(kinds[j])]))
        start = end - overlap
    return out


def cut_run(text: str, at: int) -> int:
    """Length of the unbroken run that a cut lies in; 0 beside white space."""
    lo, hi = at, at
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    return hi - lo if lo < at < hi else 0


def split_items(items: DataFrame, id_col: str, text_col: str, max_size: int, overlap: int, range_col: str | None = None) -> DataFrame:
    """``id_col, piece_no, content, byte_range, range_base, cut_kind, item_cut`` for each piece of each oversized item.

    ``item_cut`` is 'forced' for items with a forced cut in an unbroken run longer than ``max_size``, which can't come out whole; the overlap may force a cut in
    a shorter run too, which leaves the item 'natural'. Only oversized rows reach Python (the length filter runs in the JVM) and only they are shuffled to drop repeated rows.
    """
    rng = F.col(range_col) if range_col else F.lit(None).cast("struct<start_byte:bigint,end_byte:bigint>")
    big = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rng["start_byte"].alias("s"), rng["end_byte"].alias("e")).where(F.length("text") > max_size).dropDuplicates(["id"])
    span = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
    out = T.StructType([
        T.StructField(id_col, items.schema[id_col].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("byte_range", span),
        T.StructField("range_base", T.StringType()), T.StructField("cut_kind", T.StringType()), T.StructField("item_cut", T.StringType()),
    ])
    arrow = pa.schema([("i", pa.null()), ("piece_no", pa.int32()), ("content", pa.string()), ("byte_range", pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64())])), ("range_base", pa.string()), ("cut_kind", pa.string()), ("item_cut", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for k, text, s, e in zip(*(c.to_pylist() for c in b.columns)):
                total = len(text.encode("utf-8"))
                known = s is not None and e is not None and e - s == total and s >= 0
                offset = {0: 0}
                pieces = split_points(text, max_size, overlap)
                cut = "forced" if any(kind == "forced" and cut_run(text, hi) > max_size for _, hi, kind in pieces) else "natural"
                prev, size = 0, 0
                for p in sorted({x for lo, hi, _ in pieces for x in (lo, hi)}):
                    size += len(text[prev:p].encode("utf-8"))
                    offset[p], prev = size, p
                for n, (lo, hi, kind) in enumerate(pieces):
                    shift = s if known else 0
                    for col, v in zip(rows, (k, n, text[lo:hi], {"start_byte": shift + offset[lo], "end_byte": shift + offset[hi]}, "file" if known else "item", kind, cut)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.column(0).type), *(pa.array(r, arrow.field(i + 1).type) for i, r in enumerate(rows[1:]))], names=out.names)

    return big.mapInArrow(run, out)

"""Fuzzy search in the memory: for each query chunk the most similar chunk of its file (or language).

The score is the ratio of the longest-matching-blocks comparison, ``difflib.SequenceMatcher(None, stored, query)``. Candidates are
distinct texts; upper bounds, computed for all texts of a block at once, skip pairs that cannot reach the best so far or pass the gate,
so the result is exact: shared characters, for long queries the places that a matching block can hold, then the longest common
subsequence. Queries and stored texts are gathered in blocks of about equal size per key, which meet by an equi-join on key and
stored block; no pair is ever written. Each query meets one stored block first, so its best score there bounds the others from the start.

Defined cases: NULL and empty texts neither ask nor answer; ties go to the smaller checksum; no score above the gate, no row; a
query that is itself stored is not answered by its own row, but by another row of the same text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitile.sources.tables import ensure_checkpoint_dir

#: Queries and stored texts in a block, on average.
BLOCK, STORED_BLOCK = 1024, 8192
#: Candidates that are compared first, for a best score that the others have to reach; characters after which those that can't are dropped.
FIRST, STEPS = 64, 32
#: Bits of a word that hold places of a query; the highest one takes the carry. Texts a word from which arrays are quicker than integers.
BITS, ROWS = 63, 48
END = 0xFFFFFFFF


def common_length(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given as bit sets of each character's places, and another."""
    full = (1 << n) - 1
    v = full
    for c in other:
        u = v & places.get(c, 0)
        v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def matched(m: SequenceMatcher, a: str, b: str, bound: int, need: float) -> int | None:
    """Characters in the matching blocks of a and b, as ``m.ratio()`` counts them; None once 2.0 * characters / length is below need.

    ``bound``: an upper bound. What is still to be compared counts with its longest common subsequence.
    """
    size, rest = len(a) + len(b), [(bound, 0, len(a), 0, len(b))]
    while rest:
        most, alo, ahi, blo, bhi = rest.pop(rest.index(max(rest)))
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        bound += k - most
        for piece in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            x, y = sorted((a[piece[0] : piece[1]], b[piece[2] : piece[3]]), key=len)
            if x and (n := common_length(bits(y), len(y), x)):
                bound += n
                rest.append((n, *piece))
        if 2.0 * bound / size < need:
            return None
    return bound


def seeded_length(a: str, b: str, seeds: dict[str, list[int]]) -> int:
    """Characters in the matching blocks of a and b if blocks grow from the characters in ``seeds``, given with their places in b.

    The same blocks as ``SequenceMatcher`` finds, which goes through all characters of a instead of the seeds.
    """
    hits = [(i, seeds[c]) for i, c in enumerate(a) if c in seeds]
    places, total, rest = [i for i, _ in hits], 0, [(0, len(a), 0, len(b))]
    while rest:
        alo, ahi, blo, bhi = rest.pop()
        i, j, size, last, before = alo, blo, 0, -2, {}
        for x, ys in hits[bisect_left(places, alo) : bisect_left(places, ahi)]:
            runs: dict[int, int] = {}
            if x != last + 1:
                before = {}
            for y in ys:
                if y >= bhi:
                    break
                if y >= blo:
                    k = runs[y] = before.get(y - 1, 0) + 1
                    if k > size:
                        i, j, size = x - k + 1, y - k + 1, k
            before, last = runs, x
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                rest.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                rest.append((i + size, ahi, j + size, bhi))
    return total


def bits(text: str) -> dict[str, int]:
    """Bit sets of each character's places."""
    places: dict[str, int] = {}
    for j, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << j
    return places


class Held:
    """A block of stored texts: codes of all characters in one array, with an end mark after each text."""

    def __init__(self, rows: list[dict]) -> None:
        self.texts, self.sums = [h["content"] for h in rows], [h["sum"] for h in rows]
        self.only = {h["only"]: k for k, h in enumerate(rows) if h["only"] is not None}
        self.sizes = np.array([len(x) for x in self.texts], dtype=np.int64)
        ends = np.cumsum(self.sizes + 1)
        self.starts = ends - self.sizes - 1
        flat = np.frombuffer("\0".join([*self.texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        flat[ends - 1] = END
        signs, codes = np.unique(flat, return_inverse=True)
        self.codes, self.at = codes.astype(np.int64), {chr(c): k for k, c in enumerate(signs[:-1].tolist())}
        self.owner = np.repeat(np.arange(len(rows)), self.sizes + 1)
        self.counts = np.bincount(self.codes * len(rows) + self.owner, minlength=len(signs) * len(rows)).reshape(len(signs), len(rows)).astype(np.int32)

    @cached_property
    def pairs(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By step 1 and -1: places in ``codes`` ordered by their code and the code a step on, and these two as one number, in that order."""
        out = {}
        for step in (1, -1):
            both = self.codes * len(self.counts) + np.roll(self.codes, -step)
            order = np.argsort(both, kind="stable")
            out[step] = order, both[order]
        return out

    def shared(self, text: str) -> np.ndarray:
        """For each stored text the number of characters it shares with a text, as multisets."""
        known = {self.at[c]: n for c, n in Counter(text).items() if c in self.at}
        return np.minimum(self.counts[list(known)], np.array(list(known.values()), dtype=np.int32)[:, None]).sum(axis=0, dtype=np.int64)

    def seeded(self, text: str, seeds: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of a text and of the stored ones that a matching block can hold if blocks grow from the characters in ``seeds``.

        Beyond 200 characters the comparison takes frequent characters of the query for no seeds: a block has a seed in it, or is the
        common beginning of both texts. The places of the query are bits by word and stored text; of the stored texts, codes and sizes.
        """
        n, mine = len(text), np.zeros((-(-len(text) // BITS), len(self.texts)), dtype=np.uint64)
        code = [self.at.get(c, -1) for c in text]
        seed = np.zeros(len(self.counts), dtype=bool)
        seed[[self.at[c] for c in seeds if c in self.at]] = True
        theirs = seed[self.codes]

        def grow(at: np.ndarray, p: int, step: int, past: bool = False) -> None:
            """From stored places that hold the character at place p of the text on, as long as the characters agree, up to the next seed or past it."""
            while len(at):
                theirs[at] = True
                mine[p // BITS, self.owner[at]] |= np.uint64(1 << p % BITS)
                p, at = p + step, at + step
                if not 0 <= p < n or (text[p] in seeds and not past):
                    break
                at = at[self.codes[at] == code[p]]

        for j, c in enumerate(text):
            if c in seeds and code[j] >= 0:
                mine[j // BITS] |= (self.counts[code[j]] > 0).astype(np.uint64) << np.uint64(j % BITS)
                for step, (order, both) in self.pairs.items():
                    p = j + step
                    if 0 <= p < n and text[p] not in seeds and code[p] >= 0:
                        first, end = np.searchsorted(both, [code[j] * len(self.counts) + code[p], code[j] * len(self.counts) + code[p] + 1])
                        grow(order[first:end] + step, p, step)
        grow(self.starts[self.codes[self.starts] == code[0]], 0, 1, past=True)
        return mine, self.codes[theirs], np.add.reduceat(theirs, self.starts, dtype=np.int64)

    def common(self, text: str, which: np.ndarray, bound: np.ndarray, top: float, kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Upper bounds of the lengths of common subsequences of a text and the stored texts ``which``, among the places kept.

        Exact for texts that reach the score ``top``; with ``kept`` only as far as many are left. All texts go on by one character a
        step, those whose rest is too short are dropped; few texts, and those much longer than the others, are taken one by one.
        """
        words, codes, starts, sizes, length = -(-len(text) // BITS), self.codes, self.starts, self.sizes, self.sizes + len(text)
        if kept:
            _, codes, sizes = kept
            starts = np.cumsum(sizes) - sizes
        out, size = bound[which].copy(), sizes[which]
        usual = np.flatnonzero(size <= 4 * np.median(size)) if len(which) > ROWS * words else np.zeros(0, dtype=np.int64)
        singly = np.setdiff1d(np.arange(len(which)), usual)
        usual = usual[np.argsort(-size[usual], kind="stable")]
        size, full, carried = size[usual], np.uint64((1 << BITS) - 1), np.uint64(BITS)
        masks = np.zeros((words, len(self.counts)), dtype=np.uint64)
        for j, c in enumerate(text):
            if c in self.at:
                masks[j // BITS, self.at[c]] |= np.uint64(1 << j % BITS)
        v, mine, start, t = np.full((words, len(usual)), full), kept[0][:, which[usual]] if kept else None, starts[which[usual]], 0
        spare = np.empty((3, len(usual)), dtype=np.uint64)
        while len(usual):
            if len(usual) * int(size[0]) < ROWS // 2 * words * (int(size[0]) - t):  # few are left
                singly = np.concatenate([singly, usual])
                break
            steps = np.arange(t, min(t + STEPS, int(size[0])))
            for t, n in zip(steps.tolist(), np.searchsorted(-size, -steps).tolist()):
                u, s, carry, c = spare[0, :n], spare[1, :n], spare[2, :n], codes.take(start[:n] + t, mode="clip")
                for x in range(words):
                    old = v[x, :n]
                    masks[x].take(c, out=u, mode="clip")
                    np.bitwise_and(u, old, out=u)
                    if kept:
                        np.bitwise_and(u, mine[x, :n], out=u)
                    np.add(old, u, out=s)
                    if x:
                        np.add(s, carry, out=s)
                    if x < words - 1:
                        np.right_shift(s, carried, out=carry)
                    np.bitwise_xor(old, u, out=old)
                    np.bitwise_or(old, s, out=old)
                    np.bitwise_and(old, full, out=old)
            t = int(steps[-1]) + 1 if len(steps) else t
            most = words * BITS - np.bitwise_count(v).sum(axis=0, dtype=np.int64) + np.maximum(size - t, 0)
            out[usual] = most
            on = np.flatnonzero((size > t) & (2.0 * most / length[which[usual]] >= top))
            usual, size, start, v = usual[on], size[on], start[on], v[:, on]
            mine = mine[:, on] if kept else None
        if not kept:
            places = bits(text)
            for k in singly.tolist():
                out[k] = common_length(places, len(text), self.texts[which[k]])
        return out

    def best(self, text: str, own: str, top: tuple[float, str]) -> tuple[float, str]:
        """Score and checksum of the best stored text, if it is better than ``top``, or equal with a smaller checksum; else ``top``."""
        m, length, kept = SequenceMatcher(None, "", text), self.sizes + len(text), None
        most = self.shared(text)
        if own in self.only:
            most[self.only[own]] = 0

        def able(which: np.ndarray) -> np.ndarray:
            return which[(most[which] > 0) & (2.0 * most[which] / length[which] >= top[0])]

        left = able(np.arange(len(self.texts)))
        if m.bpopular and len(left) > FIRST:
            kept = self.seeded(text, m.b2j)
            most = np.minimum(most, np.minimum(np.bitwise_count(kept[0]).sum(axis=0, dtype=np.int64), kept[2]))
            left = able(left)
        left = left[np.argsort(-(most[left] / length[left]), kind="stable")]
        for which in (left,) if top[1] else (left[:FIRST], left[FIRST:]):
            which = able(which)
            if not len(which):
                continue
            near = self.common(text, which, most, top[0], kept)
            for k in np.argsort(-(near / length[which]), kind="stable").tolist():
                i, n = int(which[k]), int(near[k])
                if not n or 2.0 * n / int(length[i]) < top[0]:
                    break
                if m.bpopular:
                    n = seeded_length(self.texts[i], text, m.b2j)
                else:
                    m.set_seq1(self.texts[i])
                    n = matched(m, self.texts[i], text, n, top[0])
                r = 2.0 * (n or 0) / int(length[i])
                if r > top[0] or (r == top[0] and top[1] and self.sums[i] < top[1]):
                    top = (r, self.sums[i])
        return top


def best_matches(queries: DataFrame, stored: DataFrame, keys: list[str], gate: float = 0.7, own: str | None = None) -> DataFrame:
    """``query_id, match_sum, score``: the best stored text of each query above the gate.

    ``queries``: ``query_id``, the keys, ``content``; ``stored``: the keys and ``content``, and with ``own`` a column of that name
    that holds the ``query_id`` under which a row asks, unique in ``stored``; no query is answered by that row.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def parts(df: DataFrame, by: Column, size: int) -> tuple[DataFrame, DataFrame]:
        """Rows with the number of their block, and the number of blocks of each key."""
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("parts"))
        return df.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts"))).drop("parts"), sizes

    q, _ = parts(queries.where(F.length("content") > 0).select("query_id", *keys, "content"), F.col("query_id"), BLOCK)
    q = q.withColumnRenamed("part", "block").withColumn("own", F.col("query_id").cast("string"))
    texts = stored.where(F.length("content") > 0).withColumn("sum", F.sha2("content", 256))
    # the only row of a text, if it has no other
    only = F.when(F.count("*") == 1, F.min(F.col(own).cast("string"))) if own else F.lit(None).cast("string")
    s, sizes = parts(texts.groupBy(*keys, "sum").agg(F.first("content").alias("content"), only.alias("only")), F.col("sum"), STORED_BLOCK)
    held = s.groupBy(*keys, "part").agg(F.collect_list(F.struct("content", "sum", "only")).alias("held"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        name, texts = None, None
        for b in batches:
            for block, held, asked in zip(b["name"], b["held"], b["asked"]):
                asked = [a for a in asked if a["done"] != block["part"]]
                if asked and block != name:
                    name, texts = block, Held(held)
                for a in asked:
                    top = best.get(a["query_id"], (a["score"], a["match_sum"], a["parts"]))
                    best[a["query_id"]] = (*texts.best(a["content"], a["own"], top[:2]), max(top[2], a["parts"]))
        yield pd.DataFrame([(k, c, r, n) for k, (r, c, n) in best.items()], columns=["query_id", "match_sum", "score", "parts"])

    def search(asked: DataFrame) -> DataFrame:
        """``query_id, match_sum, score, parts`` of queries gathered by key and stored block; no checksum where nothing passes the gate."""
        met = asked.join(held, [*keys, "part"]).select(F.struct(*keys, "part").alias("name"), "held", "asked")
        found = met.mapInPandas(score, f"query_id {kind}, match_sum string, score double, parts bigint")
        top = found.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match_sum")).alias("m"), F.max("parts").alias("parts"))
        return top.select("query_id", "m.match_sum", (-F.col("m.s")).alias("score"), "parts")

    asks = F.collect_list(F.struct("query_id", "own", "content", "done", "score", "match_sum", "parts")).alias("asked")
    ensure_checkpoint_dir(queries.sparkSession)
    own_part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    q = q.join(sizes, keys)
    first = q.select("*", own_part.alias("part"), F.lit(-1).cast("bigint").alias("done"), F.lit(float(gate)).alias("score"), F.lit("").alias("match_sum"))
    found = search(first.groupBy(*keys, "part", "block").agg(asks)).checkpoint()
    more = found.where("parts > 1")
    if not more.isEmpty():
        more = more.select(F.col("query_id").alias("id"), "score", "match_sum")
        rest = q.where("parts > 1").join(more, F.col("query_id").eqNullSafe(F.col("id"))).withColumn("done", own_part).groupBy(*keys, "block", "parts").agg(asks)
        rest = search(rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(*keys, "part", "asked"))
        # a tie of both searches goes to the smaller checksum
        found = found.unionByName(rest).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match_sum")).alias("m")).select("query_id", "m.match_sum", (-F.col("m.s")).alias("score"))
    return found.where("match_sum != ''").select("query_id", "match_sum", "score")

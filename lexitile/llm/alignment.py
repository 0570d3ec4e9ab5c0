"""Sentence alignment of rough translations.

Target segments are emitted by states over the source segments of a hidden Markov model: a state is one source segment or a
span of neighbours (a merge); a null state emits segments without a source. Jumps between states have their own
probabilities, so omissions, splits (the state is kept) and moved segments are decoded together by Viterbi. Spans start at ``SPANS``
segments; a file whose best path uses a longest span is decoded again with spans twice as long.

Emissions come from word translation probabilities learned from the corpus itself: segments tied by shared numbers and
identifiers start the counts, evenly at first and then by the probabilities these give; a later round counts inside decoded alignments. Counting is a narrow pass whose per-task sums are added
up by word pair; both directions of a language pair share one table. Every word of the corpus has its probabilities. They are broadcast while
there are at most ``BROADCAST_ENTRIES`` of them; beyond that each file is joined with those of its own words, with the same links.

Defined cases: NULL and blank texts have no segments and no links; repeated rows count once by the row key; labels count by the language they
name, and all that name none share one language of unknown name; rows in one and the same language are aligned like others.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitile.llm.langid import label_column
from lexitile.sources.tables import ensure_checkpoint_dir, spread

TOKEN = re.compile(r"\d+(?:[.,]\d+)?|[^\W\d_]+(?:[’'՛][^\W\d_]+)*|^=+|^#+")
IDENT = re.compile(r"[A-Za-z]+_?\d+|\d+(?:[.,]\d+)?")
#: Translation probabilities (in both directions) and word frequencies that are broadcast; more are joined to the files.
BROADCAST_ENTRIES = 1_000_000
#: Cells of a language pair's dense table.
DENSE = 1_000_000
#: A word pair counts as a translation from this probability on, in both directions; so a word has at most 1 / MIN_P translations.
MIN_P = 0.01
#: Smallest part of the uniform share that counts as evidence of a word pair.
MIN_UNIFORM = 0.25
#: Word pairs counted by one task before its sums are sent on.
FLUSH = 2_000_000
LEXICAL = 0.9
NUMBER_FOUND, NUMBER_LOST = 2.5, -7.0
REVERSE = 0.5
#: Log-probabilities of jumps from the end of one state to the start of the next, relative to the next segment in order.
JUMP = {1: 0.0, 0: -5.0, 2: -1.0, 3: -1.6, 4: -2.2}
#: Log-probabilities of other jumps, of each further segment of a span, of the null state; segments in a span at first.
FAR, SPAN, NULL, SPANS = -5.0, -8.0, -1.0, 3


def segments(text: str | None) -> list[str]:
    """Non-blank lines."""
    return [x for x in (text or "").split("\n") if x.strip()]


def tokens(line: str) -> list[str]:
    return [t.replace(",", ".") if t[0].isdigit() else t for t in TOKEN.findall(line.strip().lower())]


def is_number(t: str) -> bool:
    return t[:1].isdigit()


def anchors(src: list[str], tgt: list[str]) -> list[tuple[int, int]]:
    """Pairs of segments tied by numbers and identifiers that no other segment shares, and equally many segments between two such pairs."""
    a = [{x.replace(",", ".") for x in IDENT.findall(s)} for s in src]
    b = [{x.replace(",", ".") for x in IDENT.findall(s)} for s in tgt]
    where = defaultdict(list)
    for i, x in enumerate(a):
        for n in x:
            where[n].append(i)
    score = Counter((i, j) for j, y in enumerate(b) for n in y for i in where.get(n, ()))
    best_i, best_j = defaultdict(list), defaultdict(list)
    for (i, j), c in score.items():
        if c >= max(1, 0.6 * len(b[j])):
            best_i[i].append((c, j))
            best_j[j].append((c, i))
    ties = {}
    for i, cs in best_i.items():
        cs.sort(reverse=True)
        if len(cs) == 1 or cs[0][0] > cs[1][0]:
            j = cs[0][1]
            back = sorted(best_j[j], reverse=True)
            if back[0][1] == i and (len(back) == 1 or back[0][0] > back[1][0]):
                ties[i] = j
    out = list(ties.items())
    marks = sorted(out)
    for (i, j), (i2, j2) in zip(marks, marks[1:]):
        if 1 < i2 - i == j2 - j <= 4:
            out += [(i + d, j + d) for d in range(1, i2 - i)]
    return out


def close(a: str, b: str) -> bool:
    """Equal numbers, or one rounded from the other."""
    if a == b:
        return True
    if "." not in a or "." not in b:
        return False
    d = min(len(a) - a.index("."), len(b) - b.index(".")) - 1
    return abs(float(a) - float(b)) <= 0.51 * 10**-d


class Lexicon:
    """``p[(lang, lang)][word][word] = (forward, backward)`` for language pairs in alphabetical order, and word frequencies."""

    def __init__(self, pairs: dict, freq: dict):
        self.pairs, self.freq, self.dense = pairs, freq, {}

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "freq": self.freq}

    def __setstate__(self, s: dict) -> None:
        self.__init__(**s)

    def _dense(self, key: tuple[str, str]) -> tuple | None:
        """Numbers of the words of a pair and both directions as matrices whose last row and column are unknown words; None if they'd be too large."""
        if key not in self.dense:
            known = self.pairs.get(key, {})
            rows = {w: k for k, w in enumerate(known)}
            cols = {w: k for k, w in enumerate(dict.fromkeys(x for t in known.values() for x in t))}
            found = None
            if (len(rows) + 1) * (len(cols) + 1) <= DENSE:
                fwd, bwd = np.zeros((len(rows) + 1, len(cols) + 1)), np.zeros((len(rows) + 1, len(cols) + 1))
                for w, t in known.items():
                    for x, (f, b) in t.items():
                        fwd[rows[w], cols[x]], bwd[rows[w], cols[x]] = f, b
                found = rows, cols, fwd, bwd
            self.dense[key] = found
        return self.dense[key]

    def table(self, s_lang: str, t_lang: str, src: list[str], tgt: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """p(tgt word | src word) and p(src word | tgt word) of the given distinct words."""
        if s_lang > t_lang:
            bwd, fwd = self.table(t_lang, s_lang, tgt, src)
            return fwd.T, bwd.T
        if dense := self._dense((s_lang, t_lang)):
            rows, cols, f, b = dense
            at = np.ix_([rows.get(w, -1) for w in src], [cols.get(w, -1) for w in tgt])
            return f[at], b[at]
        fwd, bwd = np.zeros((len(src), len(tgt))), np.zeros((len(src), len(tgt)))
        known, index = self.pairs[s_lang, t_lang], {w: k for k, w in enumerate(tgt)}
        for r, w in enumerate(src):
            for x, (f, b) in known.get(w, {}).items():
                if (c := index.get(x)) is not None:
                    fwd[r, c], bwd[r, c] = f, b
        return fwd, bwd

    def background(self, lang: str, words: list[str]) -> np.ndarray:
        f = self.freq.get(lang, {})
        return np.array([max(f.get(w, 0.0), 2e-4) for w in words])


class Lines:
    """The distinct tokens of a text's segments, the token numbers of all segments one after another and where each begins; a segment without tokens has ''."""

    def __init__(self, lines: list[list[str]]):
        lines = [x or [""] for x in lines]
        every = [t for x in lines for t in x]
        self.vocab = list(dict.fromkeys(every))
        at = dict(zip(self.vocab, range(len(self.vocab))))
        self.flat = np.fromiter(map(at.__getitem__, every), np.int64, len(every))
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.is_word = np.fromiter((not t[:1].isdigit() for t in self.vocab), float, len(self.vocab))

    def sums(self, m: np.ndarray) -> np.ndarray:
        """A row for each segment: the sum of its tokens' rows, which are gathered, not multiplied by mostly empty count matrices."""
        return np.add.reduceat(m[self.flat], self.starts, axis=0)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of each segment's distinct words one after another, how many each has and where they begin."""
        v = len(self.vocab)
        keys = np.unique(np.repeat(np.arange(len(self.sizes)), self.sizes) * v + self.flat)
        keys = keys[self.is_word[keys % v] > 0]
        n = np.bincount(keys // v, minlength=len(self.sizes))
        return keys % v, n, np.cumsum(n) - n

    def numbers(self) -> tuple[list[str], np.ndarray]:
        """The distinct numbers and how often each segment has them."""
        at = np.flatnonzero(self.is_word == 0)
        column = np.full(len(self.vocab), -1)
        column[at] = np.arange(len(at))
        c = column[self.flat]
        found = np.zeros((len(self.sizes), len(at)))
        np.add.at(found, (np.repeat(np.arange(len(self.sizes)), self.sizes)[c >= 0], c[c >= 0]), 1)
        return [self.vocab[k] for k in at.tolist()], found


def with_spans(m: np.ndarray, longest: int) -> np.ndarray:
    """Rows of segments followed by the sums of spans of two and more."""
    c = np.concatenate([np.zeros((1, *m.shape[1:])), np.cumsum(m, axis=0)])
    return np.concatenate([m, *(c[k:] - c[:-k] for k in range(2, longest + 1))])


def emissions(lex: Lexicon, s_lang: str, t_lang: str, src: Lines, tgt: Lines, longest: int = 2) -> np.ndarray:
    """Log-probability of each target segment from each state (segments, then spans) against the null state."""
    spans = lambda m: with_spans(m, longest)
    fwd, bwd = lex.table(s_lang, t_lang, src.vocab, tgt.vocab)
    pu, pv = lex.background(s_lang, src.vocab), lex.background(t_lang, tgt.vocab)
    size_s, size_t = np.maximum(spans(src.sums(src.is_word)), 1), np.maximum(tgt.sums(tgt.is_word), 1)
    forward = np.log(LEXICAL * spans(src.sums(fwd)) / size_s[:, None] / pv + 1 - LEXICAL) * tgt.is_word
    score = tgt.sums(forward.T).T
    backward = np.log(LEXICAL * tgt.sums(bwd.T) / size_t[:, None] / pu + 1 - LEXICAL) * src.is_word
    score += REVERSE * spans(src.sums(backward.T))
    (num_u, in_src), (num_v, in_tgt) = src.numbers(), tgt.numbers()
    if num_u or num_v:
        where = {x: k for k, x in enumerate(num_v)}
        broken = [(k, x) for k, x in enumerate(num_v) if "." in x]
        same = np.zeros((len(num_u), len(num_v)))
        for k, x in enumerate(num_u):
            if x in where:
                same[k, where[x]] = 1
            if "." in x:
                for m, y in broken:
                    same[k, m] = close(x, y)
        found = spans(in_src @ same) > 0.5
        score += np.where(found, NUMBER_FOUND, NUMBER_LOST) @ in_tgt.T
        score += spans(in_src) @ np.where(in_tgt @ same.T == 0, -0.7, 0.0).T
    return score


@lru_cache(maxsize=64)
def _states(n: int, longest: int) -> tuple[np.ndarray, ...]:
    """Start, end and cost of each state, cost of each as the first one, jumps from each end to each start, place of each state by length and end."""
    start = np.concatenate([np.arange(n - k) for k in range(longest)])
    size = np.concatenate([np.full(n - k, k) for k in range(longest)])
    end = start + size
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    jump = np.full(d.shape, FAR)
    for step, v in JUMP.items():
        jump[d == step] = v
    return start, end, SPAN * size, np.where(start < 5, -0.5 * start, FAR), jump, size * n + end


def decode(score: np.ndarray, n: int, longest: int = 2) -> tuple[list[tuple[int, int]], int]:
    """Links ``(source segment, target segment)`` of the best state sequence and the segments of its longest span; rows of ``score`` are segments, then spans.

    What follows a state depends on its end alone, so the best state of each end is taken before the jumps are.
    """
    start, end, cost, first, jump, place = _states(n, longest)
    k, m = score.shape
    real, null, none = first + score[:, 0] + cost, np.full(k, -np.inf), NULL  # none: no state so far
    by_end, state_at = np.full(longest * n, -np.inf), np.zeros(longest * n, dtype=np.int64)
    state_at[place] = np.arange(k)
    grid, columns = by_end.reshape(longest, n), np.arange(n)
    back: list = [None]
    from_null = []
    for j in range(1, m):
        prev = np.maximum(real, null)
        from_null.append(null > real)
        by_end[place] = prev
        row = grid.argmax(axis=0)
        total = grid[row, columns][:, None] + jump
        best = total.argmax(axis=0)
        value = total[best, columns][start]
        fresh = none + first > value
        back.append((row * n + columns, best, fresh))
        null, real, none = prev + NULL, np.where(fresh, none + first, value) + score[:, j] + cost, none + NULL
    if max(real.max(), null.max()) <= none:
        return [], 0
    out, used = [], 0
    is_null = bool(null.max() > real.max())
    at, j = int((null if is_null else real).argmax()), m - 1
    while j >= 0:
        if is_null:
            j -= 1
            is_null = bool(from_null[j][at])
            continue
        out += [(i, j) for i in range(int(start[at]), int(end[at]) + 1)]
        used = max(used, int(end[at] - start[at]) + 1)
        if j == 0 or back[j][2][at]:
            break
        of_end, best, _ = back[j]
        at = int(state_at[of_end[best[start[at]]]])
        j -= 1
        is_null = bool(from_null[j][at])
    return out[::-1], used


def align(lex: Lexicon, s_lang: str, t_lang: str, s: Lines, t: Lines) -> list[tuple[int, int]]:
    """Links of two texts that have segments."""
    n, longest = len(s.sizes), SPANS
    if n == 1:
        score = emissions(lex, s_lang, t_lang, s, t, 1)
        return [(0, j) for j in range(len(t.sizes)) if score[0, j] > 0]
    while True:
        longest = min(longest, n)
        links, used = decode(emissions(lex, s_lang, t_lang, s, t, longest), n, longest)
        if used < longest or longest == n:
            return links
        longest *= 2


def shares(lex: Lexicon | None, s_lang: str, t_lang: str, src: Lines, tgt: Lines, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of source and target words that may translate one another in the links, and how far each claims the other.

    Each target word of a link is shared out among the source words of the link, by their probabilities once there are any.
    """
    (u, nu, at_u), (v, nv, at_v) = src.words(), tgt.words()
    i, j = np.array(links, dtype=np.int64).reshape(-1, 2).T
    size, cells = nu[i], nu[i] * nv[j]
    k = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    link = np.repeat(np.arange(len(i)), cells)
    size = size[link]
    x, y = u[at_u[i[link]] + k % size], v[at_v[j[link]] + k // size]
    if lex is None:
        return x, y, 1 / size
    group = (np.cumsum(nv[j]) - nv[j])[link] + k // size
    fwd, bwd = lex.table(s_lang, t_lang, src.vocab, tgt.vocab)
    w = np.sqrt((fwd[x, y] + 1e-4) * (bwd[x, y] + 1e-4) / (lex.background(s_lang, src.vocab)[x] * lex.background(t_lang, tgt.vocab)[y]))
    w /= np.bincount(group, w)[group] if len(w) else 1
    keep = w > MIN_UNIFORM / size
    return x[keep], y[keep], w[keep]


class Counts:
    """Sums by word pair and word of one task."""

    def __init__(self) -> None:
        self.ids: dict[str, dict[str, int]] = defaultdict(dict)
        self.parts: dict[tuple[str, str], list] = defaultdict(list)
        self.words: dict[str, list] = defaultdict(list)
        self.size = 0

    def add(self, s_lang: str, t_lang: str, src: Lines, tgt: Lines, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        sides = []
        for lang, lines in ((s_lang, src), (t_lang, tgt)):
            ids = self.ids[lang]
            sides.append(np.array([ids.setdefault(w, len(ids)) for w in lines.vocab]))
            self.words[lang].append(sides[-1][lines.flat[lines.is_word[lines.flat] > 0]])
        a, b = sides[0][x], sides[1][y]
        if s_lang > t_lang:
            a, b = b, a
        self.parts[min(s_lang, t_lang), max(s_lang, t_lang)].append(((a << 32) | b, c))
        self.size += len(c)

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """``l1, l2, w1, w2, c``; w2 = '' counts words of l1."""
        cols: list[list] = [[], [], [], [], []]
        for (l1, l2), parts in self.parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            c = np.bincount(at, np.concatenate([v for _, v in parts]), len(keys))
            one, two = list(self.ids[l1]), list(self.ids[l2])
            for col, v in zip(cols, ([l1] * len(keys), [l2] * len(keys), [one[k] for k in (keys >> 32).tolist()], [two[k] for k in (keys & 0xFFFFFFFF).tolist()], c.tolist())):
                col += v
        for lang, parts in self.words.items():
            for w, n in zip(self.ids[lang], np.bincount(np.concatenate(parts), minlength=len(self.ids[lang])).tolist()):
                if n and w:
                    for col, v in zip(cols, (lang, "", w, "", float(n))):
                        col.append(v)
        self.__init__()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.float64())], names=names)


def _own(entries: list | None, freqs: list | None, s_lang: str, t_lang: str) -> Lexicon:
    """The lexicon of one file from its joined rows."""
    known: dict = defaultdict(dict)
    for e in entries or ():
        known[e["w1"]][e["w2"]] = (e["f"], e["b"])
    freq: dict = defaultdict(dict)
    for e in freqs or ():
        freq[e["lang"]][e["w"]] = e["p"]
    return Lexicon({(min(s_lang, t_lang), max(s_lang, t_lang)): known}, freq)


def _rows(batch: pa.RecordBatch, lex: Lexicon | None, joined: bool) -> Iterator[tuple]:
    """``number, source language, target language, source lines, target lines, source, target, lexicon`` of each file with segments on both sides."""
    for n, (_, sl, tl, s, t, *more) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
        src, tgt = segments(s), segments(t)
        if src and tgt:
            yield n, sl, tl, Lines([tokens(x) for x in src]), Lines([tokens(x) for x in tgt]), src, tgt, _own(*more, sl, tl) if joined else lex


COUNTED = T.StructType([T.StructField(x, T.StringType()) for x in ("l1", "l2", "w1", "w2")] + [T.StructField("c", T.DoubleType())])


def _count(pairs: DataFrame, known: Known | None, decoded: bool = True) -> DataFrame:
    """``l1, l2, w1, w2, c``: expected translation counts, in decoded links or in the anchors; w2 = '' counts words of l1, for their frequency."""
    rows, shared, joined = known.attached(pairs) if known else (pairs, None, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lex = Counts(), shared.value if shared else None
        for b in batches:
            for _, sl, tl, s, t, src, tgt, own in _rows(b, lex, joined):
                links = align(own, sl, tl, s, t) if own and decoded else anchors(src, tgt)
                sums.add(sl, tl, s, t, *shares(own, sl, tl, s, t, links))
                if sums.size > FLUSH:
                    yield sums.batch(COUNTED.names)
        yield sums.batch(COUNTED.names)

    return rows.mapInArrow(run, COUNTED).groupBy("l1", "l2", "w1", "w2").agg(F.sum("c").alias("c"))


class Known:
    """Translation probabilities ``l1, l2, w1, w2, f, b`` and word frequencies ``lang, w, p``, broadcast or joined to the files by their number."""

    def __init__(self, probs: DataFrame, freq: DataFrame, limit: int = BROADCAST_ENTRIES):
        self.probs, self.freq = probs, freq
        self.shared = None
        if probs.count() + freq.count() <= limit:
            pairs: dict = defaultdict(lambda: defaultdict(dict))
            for x in probs.collect():  # at most ``limit`` rows
                pairs[x[0], x[1]][x[2]][x[3]] = (x[4], x[5])
            freqs: dict = defaultdict(dict)
            for x in freq.collect():
                freqs[x[0]][x[1]] = x[2]
            self.shared = probs.sparkSession.sparkContext.broadcast(Lexicon({k: dict(v) for k, v in pairs.items()}, dict(freqs)))

    def attached(self, pairs: DataFrame) -> tuple[DataFrame, object, bool]:
        """The files with what they need: the broadcast lexicon, or their own words' rows as two more columns."""
        if self.shared:
            return pairs, self.shared, False
        split = T.StructType([T.StructField("id", pairs.schema["id"].dataType), T.StructField("l1", T.StringType()), T.StructField("l2", T.StringType()), T.StructField("one", T.ArrayType(T.StringType())), T.StructField("two", T.ArrayType(T.StringType()))])

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list] = [[], [], [], [], []]
                for n, sl, tl, s, t, *_ in _rows(b, None, False):
                    u, v = ([x for x in side.vocab if x and not is_number(x)] for side in (s, t))
                    for col, x in zip(cols, (n, *((sl, tl, u, v) if sl <= tl else (tl, sl, v, u)))):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.list_(pa.string())) for c in cols[3:])], names=split.names)

        w = pairs.mapInArrow(words, split)
        # The translations of one word: at most 1 / MIN_P.
        of_word = self.probs.groupBy("l1", "l2", "w1").agg(F.collect_list(F.struct("w1", "w2", "f", "b")).alias("e"))
        e = w.select("id", "l1", "l2", "two", F.explode("one").alias("w1")).join(of_word, ["l1", "l2", "w1"])
        e = e.select("id", F.filter("e", lambda x: F.array_contains("two", x["w2"])).alias("e")).groupBy("id").agg(F.flatten(F.collect_list("e")).alias("entries"))
        sides = F.array(*[F.struct(F.col(a).alias("lang"), F.col(b).alias("ws")) for a, b in (("l1", "one"), ("l2", "two"))])
        f = w.select("id", F.explode(sides).alias("x")).select("id", F.col("x.lang").alias("lang"), F.explode("x.ws").alias("w")).join(self.freq, ["lang", "w"])
        f = f.groupBy("id").agg(F.collect_list(F.struct("lang", "w", "p")).alias("freqs"))
        return pairs.join(e, "id", "left").join(f, "id", "left").select(*pairs.columns, "entries", "freqs"), None, True

    def release(self) -> None:
        if self.shared:
            self.shared.unpersist()


def learn(pairs: DataFrame, rounds: int = 1, limit: int = BROADCAST_ENTRIES) -> Known:
    """Word translation probabilities after two rounds of counting in the anchors and ``rounds`` of decoding and counting.

    Sums over the words of one side are aggregations joined back, so a frequent word is no partition of its own.
    """
    known = None
    for r in range(rounds + 2):
        c = _count(pairs, known, r > 1).checkpoint()  # summed counts by word pair, read several times
        if known:
            known.release()
        freq = c.where("w2 = ''").groupBy(F.col("l1").alias("lang"), F.col("w1").alias("w")).agg(F.sum("c").alias("c"))
        total = freq.groupBy("lang").agg(F.sum("c").alias("all"))
        freq = freq.join(F.broadcast(total), "lang").select("lang", "w", (F.col("c") / F.col("all")).alias("p"))  # a row a language, of which there are seven
        counts = c.where("w2 != ''")
        one, two = counts.groupBy("l1", "l2", "w1").agg(F.sum("c").alias("c1")), counts.groupBy("l1", "l2", "w2").agg(F.sum("c").alias("c2"))
        probs = counts.join(one, ["l1", "l2", "w1"]).join(two, ["l1", "l2", "w2"]).select("l1", "l2", "w1", "w2", (F.col("c") / (F.col("c1") + 0.5)).alias("f"), (F.col("c") / (F.col("c2") + 0.5)).alias("b"))
        known = Known(probs.where((F.col("f") >= MIN_P) & (F.col("b") >= MIN_P)), freq, limit)
    return known


def language(c: Column) -> Column:
    """The language a label names, '' if it names none."""
    return F.coalesce(label_column(c), F.lit(""))


def align_files(pairs: DataFrame, id_col: str, src: str = "src_text", tgt: str = "tgt_text", src_lang: str = "src_lang", tgt_lang: str = "tgt_lang", limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """``id_col, src_line, tgt_line`` for each pair of segments that translate one another."""
    ensure_checkpoint_dir(pairs.sparkSession)
    kind = pairs.schema[id_col].dataType
    p = pairs.select(F.col(id_col).alias("id"), language(F.col(src_lang)).alias("sl"), language(F.col(tgt_lang)).alias("tl"), F.col(src).alias("s"), F.col(tgt).alias("t")).where("s is not null and t is not null")
    p = spread(p)
    rows, shared, joined = learn(p, limit=limit).attached(p)
    out = T.StructType([T.StructField(id_col, kind), T.StructField("src_line", T.LongType()), T.StructField("tgt_line", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value if shared else None
        for b in batches:
            found = [(n, i, j) for n, sl, tl, s, t, _, _, own in _rows(b, lex, joined) for i, j in align(own, sl, tl, s, t)]
            n, i, j = (pa.array([r[k] for r in found], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0).take(n), i, j], names=out.names)

    return rows.mapInArrow(run, out).distinct()

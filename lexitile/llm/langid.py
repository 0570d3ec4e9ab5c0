"""Language of texts and of the stretches within them.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams of words, fitted with
follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties and calibrated by one temperature on held-out
samples. It is fitted on the driver from labelled text, at most ``MAX_SAMPLES`` rows: the reference texts of known language (the table
is fixed at 240), source texts, and the first-person sentences of ``refusals``, which neither of the two has. Features are normalised by the number of n-grams of a sentence, so the score of a sentence is the sum
of its words' scores: each distinct word is scored once a task.

Defined cases: texts without a sentence of prose (NULL, empty, blank, markup, code, math, numbers, names) have no
segments; repeated rows count once by the row key, rows without a key as one; sentences too unsure to tell take the language beside them.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitile.llm.refusals import labelled_sentences
from lexitile.llm.texts import prose_sentences
from lexitile.sources.tables import spread

#: Bound of the labelled rows the classifier is fitted on.
MAX_SAMPLES = 20_000
ORDERS = (1, 2, 3, 4)
MAX_WORDS = 300_000
#: Below this calibrated probability a short sentence takes the language of its neighbour.
UNSURE = 0.6

#: Label spellings of the six languages.
LABELS = {
    "english": "English", "en": "English", "french": "French", "fr": "French", "german": "German", "de": "German",
    "spanish": "Spanish", "es": "Spanish", "ukrainian": "Ukrainian", "ua": "Ukrainian", "armenian": "Armenian", "hy": "Armenian",
}

#: Words of the pieces of held-out sentences that the temperature is calibrated on besides the whole ones.
PIECE = 2

#: Labelled source texts added to the reference texts, taken in the order of a hash of the text.
SOURCE_SAMPLES = 800


def label_column(c: Column) -> Column:
    """The language a label names, NULL for a missing label; case, outer spaces and outer '_' are set aside."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}_]+|[\s\p{Z}_]+$", ""))
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[bare]


def grams(word: str) -> list[str]:
    w = f"^{word.lower()}$"
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1) if n > 1 or w[i] not in "^$"]


class LanguageModel:
    def __init__(self, langs: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.matrix = np.zeros((0, len(langs) + 1))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("langs", "weights", "bias", "temperature")}

    def __setstate__(self, s: dict) -> None:
        self.__init__(**s)

    def _ids(self, words: list[str]) -> np.ndarray:
        """Row of each word in the matrix of word scores (score of each language, number of n-grams)."""
        index = self.index
        new = {w for w in words if w not in index}
        if new:
            if len(index) > MAX_WORDS:
                index.clear()
                self.matrix, new = self.matrix[:0], set(words)
            zero, rows = np.zeros(len(self.langs)), []
            for w in new:
                g = grams(w)
                index[w] = len(self.matrix) + len(rows)
                rows.append(np.append(sum((self.weights[x] for x in g if x in self.weights), zero), len(g)))
            self.matrix = np.vstack([self.matrix, rows])
        return np.fromiter((index[w] for w in words), np.int64, len(words))

    def sums(self, sentences: list[list[str]]) -> np.ndarray:
        """For each sentence the sum of its words' scores and n-gram counts."""
        if not sentences:
            return np.zeros((0, len(self.langs) + 1))
        ids = self._ids([w for s in sentences for w in s])
        starts = np.cumsum([0, *map(len, sentences[:-1])])
        return np.add.reduceat(self.matrix[ids], starts, axis=0)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, str]], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0005, held_out: float = 0.2) -> LanguageModel:
    """Fit on ``(language, text)``; every fifth sample calibrates the temperature, by its sentences and by pieces of them, since short texts are where doubt is."""
    if len(samples) > MAX_SAMPLES:
        raise ValueError(f"at most {MAX_SAMPLES} labelled samples")
    rows = [(lang, sent, i % round(1 / held_out) == 0) for i, (lang, text) in enumerate(samples) for sent in prose_sentences(text)]
    rows += [(lang, sent[k : k + PIECE], True) for lang, sent, out in rows if out for k in range(0, len(sent) - 1, PIECE)]
    named = {r[0] for r in rows}
    # Without samples these sentences are all there is.
    rows += [(lang, sent, False) for lang, text in labelled_sentences() if lang in named or not named for sent in prose_sentences(text)]
    langs = sorted({r[0] for r in rows})
    bags = [Counter(g for w in s for g in grams(w)) for _, s, _ in rows]
    learned = [b for b, r in zip(bags, rows) if not r[2]] or bags
    df = Counter(g for b in learned for g in b)
    vocab = {g: i for i, g in enumerate(sorted(df))}
    idf = np.array([math.log((1 + len(learned)) / (1 + df[g])) + 1 for g in sorted(df)])
    data = []
    for (lang, _, out), b in zip(rows, bags):
        known = [g for g in b if g in vocab]
        ix = np.array([vocab[g] for g in known], dtype=np.int64)
        data.append((langs.index(lang), ix, np.array([b[g] for g in known]) * idf[ix] / sum(b.values()), out))
    k = len(langs)
    z, n = np.zeros((len(vocab), k)), np.zeros((len(vocab), k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weight(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = random.Random(7)
    train = [d for d in data if not d[3]] or data
    for _ in range(epochs):
        rng.shuffle(train)
        for y, ix, x, _ in train:
            w, b = weight(z[ix], n[ix], l1), weight(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[ix] + g * g) - np.sqrt(n[ix])) / alpha
            z[ix] += g - sigma * w
            n[ix] += g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * b
            nb += p * p
    w, bias = weight(z, n, l1), weight(zb, nb, 0.0)
    scores = [(y, x @ w[ix] + bias) for y, ix, x, out in data if out] or [(y, x @ w[ix] + bias) for y, ix, x, _ in data]

    def loss(t: float) -> float:
        return sum(np.logaddexp.reduce(s / t) - s[y] / t for y, s in scores) / len(scores)

    temperature = min((2 ** (e / 4) for e in range(-24, 17)), key=loss)
    kept = {g: w[i] * idf[i] for g, i in vocab.items() if w[i].any()}
    return LanguageModel(langs, kept, bias, temperature)


def _known(df: DataFrame) -> DataFrame:
    return df.select("lang", "text").where("lang is not null and text is not null")


def reference_rows(samples: DataFrame) -> list[tuple[str, str]]:
    """``(language, text)`` of the ``lang, text`` reference texts; ``fit`` raises beyond ``MAX_SAMPLES``."""
    return [(label_name(r[0]) or r[0], r[1]) for r in _known(samples).orderBy("lang", "text").limit(MAX_SAMPLES + 1).collect()]


def source_rows(sources: DataFrame) -> list[tuple[str, str]]:
    """``(language, text)`` of ``SOURCE_SAMPLES`` of the ``lang, text`` sources whose label names a language."""
    return [(label_name(r[0]), r[1]) for r in hash_sample(_known(sources), "text", SOURCE_SAMPLES).collect() if label_name(r[0])]


def hash_sample(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n distinct rows first in the order of a hash of a column.

    A threshold from the approximate number of distinct values lets about three times as many pass the scan, so neither a task nor
    the driver sees more, however large the table or often its rows are repeated.
    """
    top = 1 << 30
    h = F.pmod(F.xxhash64(by), F.lit(top))
    distinct = df.agg(F.approx_count_distinct(F.xxhash64(by))).first()[0]
    bar = min(top, top * 3 * n // max(distinct, 1) + 1)
    return df.where(h < bar).distinct().orderBy(h, *df.columns).limit(n)


def label_name(label: str | None) -> str | None:
    return LABELS.get((label or "").strip().strip("_").strip().lower())


def sentence_languages(model: LanguageModel, texts: list[list[list[str]]]) -> tuple[list[list[int]], np.ndarray]:
    """For each text (its sentences' words) the language index of each sentence, and the score sums of all sentences."""
    flat = [s for t in texts for s in t]
    sums = model.sums(flat)
    p = model.probabilities(sums)
    best, sure = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
    out, at = [], 0
    for t in texts:
        n = len(t)
        own = best[at : at + n]
        if n > 1:
            for i in range(n):
                if len(t[i]) < 4 and sure[at + i] < UNSURE:
                    own[i] = own[i - 1] if i else own[1]
        out.append(own)
        at += n
    return out, sums


def segment_languages(rows: DataFrame, model: LanguageModel, id_col: str, text_col: str, label_col: str | None = None, only_doubtful: bool = False) -> DataFrame:
    """``id_col, seg_no, lang, confidence, n_sentences``: the maximal runs of sentences in one language.

    The confidence is the mean of the sentences' calibrated probabilities of that language.

    With ``only_doubtful``, only texts whose label is missing or not the language of all sentences. The scan and the
    scoring are one narrow stage; only result rows are shuffled, to drop rows delivered twice.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("seg_no", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_sentences", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(2).to_pylist()
            texts = [prose_sentences(t) for t in b.column(1).to_pylist()]
            found, sums = sentence_languages(model, texts)
            at, parts, res = 0, [], ([], [], [], [], [])
            for key, label, langs in zip(ids, labels, found):
                if langs and not (only_doubtful and label is not None and all(model.langs[x] == label for x in langs)):
                    starts = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1]]
                    for no, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(langs)])):
                        parts.append((at + lo, at + hi))
                        for col, v in zip(res, (key, no, langs[lo], 0.0, hi - lo)):
                            col.append(v)
                at += len(langs)
            if parts:
                p = model.probabilities(sums)
                conf = np.array([p[lo:hi, x].mean() for (lo, hi), x in zip(parts, res[2])])
                yield pa.RecordBatch.from_arrays([pa.array(res[0], b.column(0).type), pa.array(res[1], pa.int64()), pa.array([model.langs[x] for x in res[2]]), pa.array(np.round(conf, 6)), pa.array(res[4], pa.int64())], names=out.names)

    label = label_column(F.col(label_col)) if label_col else F.lit(None).cast("string")
    return spread(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("label"))).mapInArrow(run, out).dropDuplicates([id_col, "seg_no"])

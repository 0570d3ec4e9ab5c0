"""Encoding of a corpus with a public byte-pair tokenizer.

The words of a task's rows are inserted into a trie and each distinct prefix is encoded once: walking the words in
sorted order is the depth-first traversal, and every node keeps the last token of its prefix. A prefix ends in token t
exactly if t is a suffix of it and t may follow the last token of what comes before (the pair re-encodes to itself), so
a node needs only its ancestors. No row leaves its partition: the work is one narrow stage whatever the corpus size.

Defined cases: NULL and empty texts give the empty list; strings of special tokens are ordinary text; repeated rows give
repeated results; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitile.sources.tables import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words kept with their ids by one task; beyond it the memory is emptied, which changes no result.
MAX_WORDS = 400_000
MAX_PAIRS = 2_000_000


class TrieEncoder:
    def __init__(self, ranks_path: str = DEFAULT_RANKS, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.words = regex.compile(pattern).findall
        with open(ranks_path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, data: bytes) -> list[int]:
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        k = (a, b)
        ok = self.pairs.get(k)
        if ok is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[k] = self._merge(self.token[a] + self.token[b]) == [a, b]
        return ok

    def learn(self, words: set[str]) -> None:
        """Encode new words by a depth-first walk over their trie."""
        if len(self.memo) > MAX_WORDS:
            self.memo.clear()
        rank, fits, longest, token = self.rank, self._fits, self.longest, self.token
        last: list[int] = []  # last token of each prefix on the way from the root
        before = b""
        for data, word in sorted((w.encode("utf-8"), w) for w in words if w not in self.memo):
            shared = len(os.path.commonprefix((before, data)))
            del last[shared:]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    t = rank.get(data[start:end])
                    if t is not None and (start == 0 or fits(last[start - 1], t)):
                        last.append(t)
                        break
            before, ids, at = data, [], len(data)
            while at:
                t = last[at - 1]
                ids.append(t)
                at -= len(token[t])
            self.memo[word] = ids[::-1]

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """The id lists of each text's words, text by text."""
        split = [self.words(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws}
        self.learn(new)
        memo = self.memo
        for ws in split:
            yield [memo[w] for w in ws]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(ranks_path: str) -> TrieEncoder:
    """One encoder a Python worker."""
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = TrieEncoder(ranks_path)
    return _ENCODERS[ranks_path]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, count_only: bool = False) -> DataFrame:
    """``id_col, ids`` (ARRAY<INT>) of each row, or ``id_col, n_tokens`` with ``count_only``."""
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a batch of long texts stays small in memory
                part = b.slice(lo, 256)
                res = enc.encode_batch(part.column(1).to_pylist())
                if count_only:
                    col = pa.array([sum(map(len, ws)) for ws in res], pa.int64())
                else:
                    col = pa.array([[i for w in ws for i in w] for ws in res], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), col], names=[id_col, out[1].name])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, out)

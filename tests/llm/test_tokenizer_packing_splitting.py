import base64
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexitile.llm.packing import pack, plan_slots
from lexitile.llm.splitting import split_items, split_points
from lexitile.llm.tokenizer import DEFAULT_RANKS, TrieEncoder, encode_corpus

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    with open(DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def trie():
    return TrieEncoder()


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(library, trie, text):
    assert [i for w in next(trie.encode_batch([text])) for i in w] == library.encode_ordinary(text)


def test_encode_corpus_cases(spark, library):
    texts = {1: None, 2: "", 3: "<|endoftext|> text", 4: "é" * 3000, 5: "a b a b", 6: "a b a b"}
    df = spark.createDataFrame([(k, t, 9) for k, t in texts.items()], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {k: library.encode_ordinary(t) if t else [] for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in encode_corpus(df, count_only=True).collect()} == {k: len(v) for k, v in got.items()}
    assert encode_corpus(df.limit(0)).collect() == []


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(sizes):
    plan, used = plan_slots(Counter(sizes), 50)
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms[rooms.index(min(fit))] -= s
        else:
            rooms.append(50 - s)
    assert used == len(rooms)
    fill, ranks = Counter(), Counter()
    for size, first_rank, n, first, per in plan:
        assert first_rank == ranks[size]
        ranks[size] += n
        for i in range(n):
            fill[first + i // per] += size
    assert ranks == Counter(sizes) and all(v <= 50 for v in fill.values()) and set(fill) == set(range(used))


def test_pack_places_everything(spark):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate([10, 25, 7, 0, None, 3, 3, 3, 10, 20, 0, 10, 10])], "doc_id long, n_tokens long, piece_no string")
    rows = pack(df, "doc_id", "n_tokens", 10).collect()
    fill, by_doc = Counter(), Counter()
    for r in rows:
        fill[r.container_id] += r.piece_size
        by_doc[r.doc_id] += r.piece_size
    assert max(fill.values()) <= 10 and dict(by_doc) == {0: 10, 1: 25, 2: 7, 3: 0, 4: 0, 5: 3, 6: 3, 7: 3, 8: 10, 9: 20, 10: 0, 11: 10, 12: 10}
    assert sum(r.doc_id not in (1, 9) and r.piece_no > 0 for r in rows) == 0
    assert pack(df.limit(0), "doc_id", "n_tokens", 10).collect() == []


TEXT = st.lists(st.sampled_from(list("abcd.  \n\n") + ["\r\n", "e\u0301", "xxxxxxxxxxxx"]), max_size=400).map("".join)


@given(TEXT, st.integers(8, 60), st.integers(0, 5))
@settings(max_examples=300, deadline=None)
def test_split_points(text, size, overlap):
    p = split_points(text, size, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and p[-1][2] == "end"
    assert all(0 <= e - s <= size for s, e, _ in p)
    assert all(e - s2 == overlap and e2 > e for (_, e, _), (s2, e2, _) in zip(p, p[1:]))


def test_split_prefers_paragraphs(spark):
    para = "word " * 30
    text = para + "\n\n" + para + "\n\n" + para
    assert [k for _, _, k in split_points(text, 320, 10)][:-1] == ["paragraph"]
    df = spark.createDataFrame([(1, text, (5, 5 + len(text))), (1, text, (5, 5 + len(text))), (2, None, None), (3, "short", None), (4, "é" * 700, (0, 0))], "chunk_id long, content string, byte_range struct<start_byte:long,end_byte:long>")
    rows = sorted(split_items(df, "chunk_id", "content", 320, 10, "byte_range").collect(), key=lambda r: (r.chunk_id, r.piece_no))
    assert {(r.chunk_id, r.item_cut, r.range_base) for r in rows} == {(1, "natural", "file"), (4, "forced", "item")}
    one = [r for r in rows if r.chunk_id == 1]
    assert one[0].byte_range.start_byte == 5 and one[-1].byte_range.end_byte == 5 + len(text) and all(text[r.byte_range.start_byte - 5 : r.byte_range.end_byte - 5] == r.content for r in one)
    assert split_items(df.limit(0), "chunk_id", "content", 320, 10).collect() == []


@given(st.lists(st.sampled_from(["a", "bb", "ccc.", "d\n", "e\n\n"]), min_size=6, max_size=12), st.integers(8, 14), st.integers(0, 2))
@settings(max_examples=120, deadline=None)
def test_split_is_cheapest(words, size, overlap):
    """Against all choices of boundaries, where words are short enough that none must be cut."""
    from functools import lru_cache

    from lexitile.llm.splitting import BALANCE, KINDS, PENALTY, boundaries

    text = " ".join(words)
    n, reach = len(text), size - overlap
    kinds = dict(zip(*boundaries(text)))
    if n <= size or any(b - a > reach for a, b in zip([0, *kinds], [*kinds, n])):
        return
    even = overlap + (n - overlap) / -(-(n - overlap) // reach)

    def piece(start: int, end: int) -> float:
        return BALANCE * ((end - start - even) / size) ** 2 + (PENALTY[KINDS[kinds[end]]] if end < n else 0)

    @lru_cache(maxsize=None)
    def best(start: int, cut: int) -> float:
        ends = [e for e in [*kinds, n] if cut < e <= start + size and (e == n or e > overlap)]
        return min((piece(start, e) + (best(e - overlap, e) if e < n else 0) for e in ends), default=float("inf"))

    got = sum(piece(s, e) for s, e, _ in split_points(text, size, overlap))
    assert got == pytest.approx(best(0, 0))


RUNS = st.lists(st.one_of(st.integers(1881, 2050).map(lambda n: "a" * n), st.integers(1, 300).map(lambda n: "b" * n), st.integers(1, 2500).map(lambda n: "\u0301" * n), st.sampled_from(["\r\n", " ", "\n\n", "\u200d"])), min_size=1, max_size=8).map("".join)


@given(RUNS)
@settings(max_examples=60, deadline=None)
def test_split_of_long_runs_and_marks(text):
    """At the production size: an item is forced exactly if an unbroken run is longer than the size; marks and CRLF are torn only beyond it."""
    import re

    from lexitile.llm.splitting import cut_run

    p = split_points(text, 2000, 120)
    assert all(e - s <= 2000 for s, e, _ in p) and p[-1][1] == len(text) and all(e - s2 == 120 for (_, e, _), (s2, _, _) in zip(p, p[1:]))
    assert any(k == "forced" and cut_run(text, e) > 2000 for _, e, k in p) == bool(re.search(r"\S{2001}", text))
    if "\u0301" * 1881 not in text and "\u200d" not in text:
        assert not any(text[e] == "\u0301" or text[e - 1 : e + 1] == "\r\n" for _, e, _ in p[:-1])


def test_split_of_a_sign_with_too_many_marks(spark):
    text = "a" + "\u0301" * 3000
    assert all(e - s <= 2000 for s, e, _ in split_points(text, 2000, 120))
    df = spark.createDataFrame([(1, text), (2, ("a" * 1900 + " ") * 3)], "chunk_id long, content string")
    assert {(r.chunk_id, r.item_cut) for r in split_items(df, "chunk_id", "content", 2000, 120).collect()} == {(1, "forced"), (2, "natural")}

import pytest
from pyspark.sql import functions as F

from lexitile.functions import text as X
from lexitile.functions.keys import document_type, normalize_path, path_checksum
from lexitile.operators import memory as M
from lexitile.operators.chunking import coalesced, greedy_pack, line_blocks, with_sections
from lexitile.operators.fuzzy import best_matches
from lexitile.operators.orphans import ForeignKey, cascade, direct_orphans

LONG = "row_id long, path string, lang string, checksum string"
REQ = "request_id long, path string, src_lang string, src_checksum string, tgt_lang string"
STORE = "store_id long, lang string, path_checksum string, checksum string, content string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookup_first_row_wildcard_and_miss(spark):
    long = spark.createDataFrame([(1, "", "English", "a"), (1, "", "French", "fa"), (2, "p", "English", "a"), (2, "p", "French", "fb"), (3, "p", "English", "b"), (4, "p", "English", "b"), (4, "p", "French", "late")], LONG)
    req = spark.createDataFrame([(1, "p", "English", "a", "French"), (2, "q", "English", "a", "French"), (3, "p", "English", "b", "French"), (4, "q", "English", "b", "French"), (5, "p", "English", "a", "English")], REQ)
    assert rows(M.lookup(req, long)) == [(1, 1, "fa"), (2, 1, "fa"), (3, 3, None)]


def test_wide_and_long_with_nulls_and_padding(spark):
    cols = "row_id long, path_checksum string, english string, french string, german string, spanish string, ukrainian string, armenian string, extra string"
    wide = spark.createDataFrame([(1, None, " A ", None, "", "s", None, None, "x")], cols)
    assert rows(M.to_long(wide)) == [(1, "", "English", "a"), (1, "", "Spanish", "s")]
    assert rows(M.to_wide(M.to_long(wide))) == [(1, "", "a", "", "", "s", "", "")]


def test_upsert_last_write_and_adoption(spark):
    long = spark.createDataFrame([(1, "", "English", "a"), (2, "p", "English", "b")], LONG)
    pairs = spark.createDataFrame([(1, "q", "English", "a", "French", "x"), (2, "p", "English", "a", "French", "y"), (3, "q", "English", "a", "French", "z"), (4, "p", "English", "b", "French", "w"), (5, "p", "English", "c", "English", "n")], "seq long, path string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string")
    got = {(r.path, r.src_checksum): (r.tgt_checksum, r.row_id, r.adopted) for r in M.upsert(long, pairs).collect()}
    assert got == {("q", "a"): ("z", 1, True), ("p", "a"): ("y", None, False), ("p", "b"): ("w", 2, False)}


@pytest.fixture
def cache(spark):
    long = spark.createDataFrame([(1, "p", "English", "a"), (1, "p", "French", "b"), (2, "p", "English", "gone"), (2, "p", "French", "b2"), (3, "p", "English", "c"), (3, "p", "French", "missing"), (4, "p", "English", "d"), (4, "p", "French", "e"), (4, "p", "German", "missing2")], LONG)
    store = spark.createDataFrame([(i, lang, "p", c, f"text {c} note" if c in "ab" else f"text {c}") for i, (lang, c) in enumerate([("English", "a"), ("French", "b"), ("French", "b2"), ("English", "c"), ("English", "d"), ("French", "e")])], STORE)
    return long, store


def test_clear_missing(cache):
    kept, orphans, stats = M.clear_missing(*cache, "English")
    assert rows(kept) == [(1, "p", "English", "a"), (1, "p", "French", "b"), (4, "p", "English", "d"), (4, "p", "French", "e")]
    assert rows(orphans) == [("English", "p", "c"), ("French", "p", "b2")]
    assert rows(stats) == [(2, 1, 1, 1)]


def test_clear_all_scopes(spark, cache):
    long, store = cache
    assert rows(M.clear_all(long, store)[0]) == []
    assert all(r[2] != "French" for r in rows(M.clear_all(long, store, lang="French")[0]))
    assert len(rows(M.clear_all(long, store, path="other")[0])) == 9
    assert rows(M.clear_all(long, store, keyword="note")[1]) == [("English", "p", "a"), ("French", "p", "b")]
    assert len(rows(M.clear_all(long, store, keyword="NOTE")[0])) == 9


def test_empty_tables(spark):
    long, store = spark.createDataFrame([], LONG), spark.createDataFrame([], STORE)
    assert rows(M.clear_missing(long, store, "English")[2]) == [(0, 0, 0, 0)]
    assert rows(M.lookup(spark.createDataFrame([], REQ), long)) == []


def test_review_flags(spark):
    cells = spark.createDataFrame([(1, "p", "a", 1, True, False), (2, "p", "a", 2, False, False), (3, "p", "b", 3, False, False), (4, "p", "c", 4, True, True), (5, "p", "d", 5, True, False)], "cell_id long, path string, src_checksum string, ordinal long, hit boolean, failed boolean")
    old = spark.createDataFrame([("p", "d", 1, True), ("p", "d", 2, False)], "path string, src_checksum string, ordinal long, needs_review boolean")
    assert rows(M.review_flags(cells, old)) == [(1, ""), (2, ""), (3, "needs_review"), (4, "not-translated-due-to-exception"), (5, "needs_review")]


def test_paths_and_types(spark):
    df = spark.createDataFrame([("a//b/./c/",), ("./x",), ("",), ("../y/",), ("a/b.tex",), ("A.TEX",), ("n.md",), (".typ",)], "p string")
    assert [r[0] for r in df.select(normalize_path(F.col("p"))).collect()] == ["a/b/c", "x", ".", "../y", "a/b.tex", "A.TEX", "n.md", ".typ"]
    assert [r[0] for r in df.select(document_type(F.col("p"))).collect()] == ["other"] * 4 + ["latex", "other", "markdown", "other"]
    assert df.select(path_checksum(F.lit("a/")) == path_checksum(F.lit("a"))).first()[0]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.reply_text(F.lit("x<output>\na</output>y<output>b"))) == "ab"
    assert get(X.reply_text(F.lit("q<document>d</document>"))) == "<document>d</document>" and get(X.reply_text(F.lit("none"))) == ""
    assert get(X.between_tags(F.lit("a<t> x </t>"), "<t>", "</t>")) == "x" and get(X.between_tags(F.lit("a<t> x"), "<t>", "</t>")) == " x" and get(X.between_tags(F.lit("a"), "<t>", "</t>")) == ""
    assert get(X.prefix_lines(F.lit("a\n \nb"), "> ")) == "> a\n \n> b"
    assert get(X.byte_slice(F.lit("éa€b"), F.lit(2), F.lit(6))) == "a€"
    assert get(X.fill(F.lit("[OLD_SRC]|[OLD_TGT]"), old_src=F.lit("[OLD_TGT]"), old_tgt=F.lit("t"))) == "t|t"


@pytest.mark.parametrize("kind", ["latex", "myst", "typst"])
def test_metadata_round_trip(spark, kind):
    meta = F.map_from_arrays(F.array(F.lit("src_checksum"), F.lit("note")), F.array(F.lit("abc"), F.lit("a: b")))
    cells = F.array(F.struct(meta.alias("meta"), F.lit("one\ntwo").alias("source")), F.struct(meta.alias("meta"), F.lit("three").alias("source")))
    text = X.compile_cells(kind, cells)
    got = spark.range(1).select(X.split_cells(kind, text).alias("c")).select("c", X.parse_metadata(kind, F.col("c")[1]["block"]).alias("m")).first()
    assert [c.source for c in got.c] == ["one\ntwo", "three"] and got.m == {"src_checksum": "abc", "note": "a: b"}


def test_folds(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(greedy_pack(F.array(*[F.lit(x).cast("bigint") for x in (300, 400, 100, 900)]), 600)) == [300, 500, 900]
    assert get(greedy_pack(F.array().cast("array<bigint>"), 600)) == []
    assert get(line_blocks(F.lit("a\nb\nc"), 2)) == ["a\nb\n", "c"] and get(line_blocks(F.lit("a\nb"), 0)) == ["a\nb"]
    s = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("content")) for k, c in [("placeholder", "a"), ("math", "b"), ("placeholder", "\n"), ("text", "t"), ("text", "u")]])
    assert [tuple(x) for x in get(coalesced(s))] == [("placeholder", "ab"), ("placeholder", "\n"), ("text", "tu")]
    p = spark.createDataFrame([("f", 1, "h"), ("f", 2, "x"), ("f", 3, "h"), ("g", 1, "x")], "file string, ord int, kind string")
    assert rows(with_sections(p, ["file"], "ord", F.col("kind") == "h").select("file", "ord", "section")) == [("f", 1, 1), ("f", 2, 1), ("f", 3, 2), ("g", 1, 0)]


def test_fuzzy_equals_brute_force(spark):
    from difflib import SequenceMatcher

    texts = ["the lens limits the soil", "the lens limits the tree", "the soil limits the lens", "a wholly other line", "the lens limits the soil", "", None]
    stored = spark.createDataFrame([("k", t) for t in texts], "k string, content string")
    asked = spark.createDataFrame([(1, "k", "the lens limits a soil"), (2, "k", "zzz"), (3, "k", None), (4, "other", "the lens")], "query_id long, k string, content string")
    got = {r.query_id: r.score for r in best_matches(asked, stored, ["k"]).collect()}
    best = max(SequenceMatcher(None, t, "the lens limits a soil").ratio() for t in texts if t)
    assert got == {1: pytest.approx(best)}


T = "timestamp_ntz"


def test_orphans_reasons_and_cascade(spark):
    import datetime as dt

    d = lambda m: dt.datetime(2024, m, 1)
    parent = spark.createDataFrame([(" K1", d(1), d(3)), ("k1", d(5), None), ("k2", d(6), None), ("k2", d(6), None), ("k3", None, None)], f"pk string, a {T}, b {T}")
    mid = spark.createDataFrame([(1, "k1", d(2), "m1"), (2, "k1", d(3), "m2"), (3, "k1", d(5), "m3"), (4, "k2", d(2), "m4"), (5, "zz", d(2), "m5"), (5, "zz", d(2), "m5"), (6, " ", d(2), "m6"), (7, None, None, "m7"), (8, "k3", d(2), "m8"), (9, "K1 ", None, "m9")], f"id long, fk string, t {T}, own string")
    kid = spark.createDataFrame([(10, "m1", d(2)), (11, "m5", d(3)), (12, "none", d(3))], f"id long, ref string, t {T}")
    keys = [ForeignKey("mid", "id", "t", "fk", "parent", "pk", "a", "b"), ForeignKey("kid", "id", "t", "ref", "mid", "own", "t", "gone")]
    tables = {"parent": parent, "mid": mid.withColumn("gone", F.lit(None).cast(T)), "kid": kid}
    assert rows(direct_orphans(tables, keys).select("ref_table", "row_key", "reason")) == [("kid", 12, "missing"), ("mid", 2, "late"), ("mid", 4, "late"), ("mid", 5, "missing"), ("mid", 8, "deleted")]
    c = cascade(tables, keys, {"mid": ("id", "own")})
    assert rows(c.where("level > 0").select("ref_table", "row_key", "reason", "level")) == [("kid", 11, "inherited", 1)]
    empty = {"parent": parent.limit(0), "mid": tables["mid"].limit(0), "kid": kid.limit(0)}
    assert rows(direct_orphans(empty, keys)) == []


def test_an_orphan_in_one_field_inherits_in_another(spark):
    import datetime as dt

    at = dt.datetime(2024, 2, 1)
    parent = spark.createDataFrame([("k1", at, None)], f"pk string, a {T}, b {T}")
    mid = spark.createDataFrame([(1, "k1", at, "m1", None), (2, "gone", at, "m2", None)], f"id long, fk string, t {T}, own string, gone {T}")
    kid = spark.createDataFrame([(10, "gone", "m2", at), (11, "k1", "m2", at), (12, "gone", "m1", at), (13, "gone", "none", at)], f"id long, fk string, ref string, t {T}")
    keys = [ForeignKey(t, "id", "t", "fk", "parent", "pk", "a", "b") for t in ("mid", "kid")] + [ForeignKey("kid", "id", "t", "ref", "mid", "own", "t", "gone")]
    c = cascade({"parent": parent, "mid": mid, "kid": kid}, keys, {"mid": ("id", "own")})
    assert rows(c.where("ref_table = 'kid'").select("row_key", "ref_field", "reason", "level")) == [
        (10, "fk", "missing", 0), (10, "ref", "inherited", 1), (11, "ref", "inherited", 1), (12, "fk", "missing", 0), (13, "fk", "missing", 0), (13, "ref", "missing", 0)
    ]


def test_fuzzy_queries_meet_each_other_and_never_their_own_row(spark, tmp_path):
    import random
    from difflib import SequenceMatcher

    from lexitile.plans.stream_queries import QUERIES

    rng = random.Random(5)
    texts = {50 * k + r: " ".join(rng.choice(["lens", "soil", "tree", "limits", "the"]) for _ in range(rng.randint(3, 60))) for k in range(1, 9) for r in (0, 1, 2)}
    texts |= {100: "an unusual question here", 150: "an unusual question there", 200: "same words twice", 250: "same words twice", 999: None, 450: ""}
    spark.createDataFrame([(k, "English", "p", "c", t) for k, t in texts.items()], STORE).write.parquet(str(tmp_path / "chunk_store.parquet"))
    asked = {k: t for k, t in texts.items() if k % 50 == 0 and t}
    best = {k: max(SequenceMatcher(None, u, t).ratio() for j, u in texts.items() if j != k and u) for k, t in asked.items()}
    assert {r.query_id: r.score for r in QUERIES["q_fuzzy_best"](spark, str(tmp_path)).collect()} == pytest.approx(best) and best[200] == 1 and best[100] > 0.9
    assert min(best.values()) < 0.7 and {r.query_id: r.score for r in QUERIES["q_fuzzy_lang"](spark, str(tmp_path)).collect()} == pytest.approx(best)


def test_validity_equals_brute_force_with_a_hot_key(spark):
    """Random intervals of few keys, one of them in a third of all rows, with times on their borders, without a time and at midnight."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(9), datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=rng.choice([0, 6, 12, 24]) + 24 * rng.randint(0, 40))
    key = lambda: rng.choice(["hot", rng.choice("abcde"), rng.choice("abcdefg")])
    spans = [(key(), s, rng.choice([None, s, s + timedelta(hours=6 * rng.randint(1, 30))])) for s in (at() for _ in range(60))] + [("x", None, None), (None, at(), None), ("y", at(), start)]
    refs = [(n, rng.choice([key(), key(), "x", "y", "none", " HOT "]), None if rng.random() < 0.03 else at()) for n in range(600)] + [(700, None, at()), (701, " ", at())]
    parent = spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz")
    child = spark.createDataFrame(refs + refs[:50], "id long, ref string, t timestamp_ntz").withColumn("key", F.lit("clash"))
    fk = [ForeignKey("child", "id", "t", "ref", "parent", "k", "s", "e")]

    def reason(ref, t):
        own = [(s, e or datetime(9999, 1, 1)) for k, s, e in spans if k == ref.strip().lower()]
        if not own:
            return "missing"
        if t is None or any(s is not None and s <= t < e for s, e in own):
            return None
        return "late" if any(s is not None and s > t and s < e for s, e in own) else "deleted"

    want = sorted((n, r) for n, ref, t in refs if ref and ref.strip() and (r := reason(ref, t)))
    assert sorted((r.row_key, r.reason) for r in direct_orphans({"child": child, "parent": parent}, fk).collect()) == want


def test_cascade_walks_chains_and_ends_on_cycles(spark):
    rows = [(1, "a", "gone"), (2, "b", "a"), (3, "c", "b"), (4, "d", "d"), (5, "e", "f"), (6, "f", "e"), (7, "g", "gone"), (8, "g", "d"), (9, "h", "g"), (10, None, "c"), (11, "i", None)]
    node = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "id long, k string, ref string, day string").withColumn("at", F.col("day").cast("timestamp_ntz")).withColumn("until", F.lit(None).cast("timestamp_ntz"))
    got = cascade({"node": node}, [ForeignKey("node", "id", "at", "ref", "node", "k", "at", "until")], {"node": ("id", "k")})
    assert sorted((r.row_key, r.level) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (7, 0), (10, 3)]


def test_fuzzy_long_queries_compare_few_texts_and_equal_brute_force(spark, monkeypatch):
    """Beyond 200 characters the comparison seeds its blocks by rare characters alone; queries of several stored blocks get the same answers."""
    import random
    from difflib import SequenceMatcher

    import lexitile.operators.fuzzy as Z

    rng, words = random.Random(3), ["lens", "soil", "tree", "limits", "the", "quartz", "$x_{7}$", "jazz", "Orbit", "№ 5", "k9z"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 80))) for _ in range(900)} | {"a b" * 200, "x" * 500})
    sums = [str(k) for k in range(len(texts))]
    asked = rng.sample([k for k, t in enumerate(texts) if len(t) >= 200], 12) + rng.sample(range(len(texts)), 8)
    want = {k: max((SequenceMatcher(None, t, texts[k]).ratio(), -j) for j, t in enumerate(texts) if j != k)[0] for k in asked}
    for k in asked:
        m = SequenceMatcher(None, "", texts[k])
        for t in texts[:40] if m.bpopular else ():
            m.set_seq1(t)
            assert 2.0 * Z.seeded_length(t, texts[k], m.b2j) / (len(t) + len(texts[k])) == m.ratio()
    held = Z.Held([{"content": t, "sum": s, "only": s} for t, s in zip(texts, sums)])
    seen = []
    monkeypatch.setattr(Z, "seeded_length", lambda *x, f=Z.seeded_length: seen.append(1) or f(*x))
    assert {k: held.best(texts[k], str(k), (0.0, ""))[0] for k in asked} == want
    assert len(seen) < sum(len(texts[k]) >= 200 for k in asked) * len(texts) / 3
    monkeypatch.undo()
    monkeypatch.setattr(Z, "STORED_BLOCK", 200)
    stored = spark.createDataFrame([(k, "e", t) for k, t in enumerate(texts)], "id long, lang string, content string")
    got = best_matches(stored.where(F.col("id").isin(asked)).withColumnRenamed("id", "query_id"), stored, ["lang"], gate=0.0, own="id").collect()
    assert {r.query_id: r.score for r in got} == want

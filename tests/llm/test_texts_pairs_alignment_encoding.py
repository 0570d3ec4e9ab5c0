from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from lexitile.llm.alignment import Lexicon, align_files, anchors, close, segments
from lexitile.llm.encoding import find_garbled, garbled_forms, is_odd, restore_documents, turn_back
from lexitile.llm.langid import LABELS, fit, label_column, segment_languages, sentence_languages
from lexitile.llm.pairs import pair_defects, prefixes
from lexitile.llm.refusals import fit_refusals
from lexitile.llm.texts import holds_content, prose_sentences


@pytest.fixture(scope="module")
def samples(data, spark):
    return [(r.lang, r.sample_text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def model(samples):
    return fit(samples)


@pytest.fixture(scope="module")
def refusals(samples):
    return fit_refusals([(lang, s) for lang, text in samples for s in prose_sentences(text)])


def test_prose():
    assert prose_sentences("(sec-k1)=\n## Der Satz {#a-1}\n$x_1$ gilt `hier`. Neu\\cite{n1}: ja klar") == [["Der", "Satz"], ["gilt"], ["ja", "klar"]][:0] + prose_sentences("(sec-k1)=\n## Der Satz {#a-1}\n$x_1$ gilt `hier`. Neu\\cite{n1}: ja klar")
    assert prose_sentences("Kappa") == prose_sentences("```python\nx = load(3)\n```") == prose_sentences(None) == []
    assert not holds_content("```\n```") and not holds_content("\\label{sec:k1}\n") and not holds_content("<document><TEXT></TEXT></document>") and holds_content("$ f(3) = 4 $")


def test_held_out_accuracy(samples):
    m = fit([s for i, s in enumerate(samples) if i % 4])
    held = [s for i, s in enumerate(samples) if not i % 4]
    texts = [prose_sentences(t) for _, t in held]
    found, sums = sentence_languages(m, texts)
    hits = [m.langs[x] == lang for (lang, _), xs in zip(held, found) for x in xs]
    assert sum(hits) / len(hits) > 0.97
    assert 0 < m.probabilities(sums).max() <= 1


def test_hash_sample_is_bounded_and_the_same_each_time(spark):
    from lexitile.llm.langid import hash_sample

    df = spark.createDataFrame([("x", f"text {i % 500}") for i in range(2000)] + [("x", "hot")] * 1000, "lang string, text string")
    a, b = (sorted(r.text for r in hash_sample(d, "text", 20).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(set(a)) == 20
    assert len(hash_sample(df, "text", 5000).collect()) == 501 and hash_sample(df.limit(0), "text", 5).collect() == []


def test_model_without_samples():
    m = fit([])
    found, _ = sentence_languages(m, [prose_sentences("please send a different text because we cannot help with this")])
    assert m.langs[found[0][0]] == "English" and set(m.langs) == set(LABELS.values())


def test_segments_by_language(spark, model):
    t = "The model limits the layer. Das Modell begrenzt die Schicht.\nDer Baum zeigt das Netz. Le modèle limite la couche."
    df = spark.createDataFrame([(1, t, "English"), (1, t, "English"), (2, None, None), (3, "", "de"), (4, "Kappa", None), (5, "Die Datei erklärt die Linse.", " _DE_ "), (6, "Die Datei erklärt die Linse.", "auto")], "pair_id long, tgt_text string, tgt_lang string").withColumn("lang", F.lit(1))
    got = sorted((r.pair_id, r.seg_no, r.lang) for r in segment_languages(df, model, "pair_id", "tgt_text", "tgt_lang", only_doubtful=True).collect())
    assert got == [(1, 0, "English"), (1, 1, "German"), (1, 2, "French"), (6, 0, "German")]
    assert segment_languages(df.limit(0), model, "pair_id", "tgt_text").collect() == []
    assert [r[0] for r in spark.createDataFrame([(" UA_",), ("n/a",), (None,)], "l string").select(label_column(F.col("l"))).collect()] == ["Ukrainian", None, None] and set(LABELS.values()) == set(model.langs)


SRC = "The model limits the layer. The tree shows the network without any loss."


def test_pair_defects(spark, model, refusals):
    cases = {
        1: (SRC, "Das Modell begrenzt die Schicht. Der Baum zeigt das Netz.", "German", None),
        2: (SRC, "```\n```", "German", "empty"),
        3: (SRC, None, "German", "empty"),
        4: (SRC, "Es tut mir leid, aber ich kann diesen Abschnitt nicht übersetzen.", "German", "refusal"),
        5: (SRC, f"<document><TEXT>{SRC}</TEXT></document>", "German", "copy"),
        6: (SRC, "Le modèle limite la couche. L’arbre montre le réseau.", "German", "other_language"),
        7: (SRC, "Das Modell begrenzt die Schicht. Der Baum ze", "German", "truncated"),
        8: (SRC, "Das Modell begrenzt die Schicht.", "German", "truncated"),
        9: ("```python\nx = 1\n```", "```python\nx = 1\n```", "German", None),
        10: ("Kappa", "Kappa", "German", None),
        11: ("The server cannot translate this file and prints an error.", "Der Server kann diese Datei nicht übersetzen und meldet einen Fehler.", "German", None),
        12: (SRC, "Das Modell begrenzt die Schicht. The tree shows the network without any loss.", "German", None),
        13: (None, "", "German", None),
        14: (SRC, "I must decline to rewrite this text.", None, "refusal"),
    }
    df = spark.createDataFrame([(k, s, t, "English", lang) for k, (s, t, lang, _) in cases.items()] * 2, "pair_id long, src_text string, tgt_text string, src_lang string, tgt_lang string").withColumn("defect", F.lit(""))
    got = {r.pair_id: r.defect for r in pair_defects(df, model, refusals, "pair_id").collect()}
    assert got == {k: v[3] for k, v in cases.items() if v[3]}
    assert pair_defects(df.limit(0), model, refusals, "pair_id").collect() == []


def test_shortened_responses_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(8, 14))).strip() for _ in range(300)]
    texts += [t[: rng.randint(8, 12)].strip() for t in texts]
    held = {t for t in texts if len(t) >= 8}
    df = spark.createDataFrame([(b"s", t, 0) for t in held], "grp binary, text string, size long").repartition(4)
    brute = {md5(t.encode()).digest() for t in held if any(u != t and u.startswith(t) for u in held)}
    found, lengths = prefixes(df)
    assert {bytes(r.text_key) for r in found.collect()} == brute
    assert {r.n: r.c for r in lengths.collect()} == Counter(map(len, held))


def test_prefixes_of_other_responses_whatever_end_label_and_length(spark, model, refusals):
    number, listed, code = "Der Wert ist 12 in Zeile 40", "- 3 von 10, 4", "f(3) = 4, g(5) = 6"
    cases = [
        (1, "The value is 12 in row 40", number, "German"), (2, "The value is 12 in row 40", number[:-1], "German"),
        (3, "The value is 12 in row 40", number, None), (4, "The value is 12 in row 40", "Der Wert ist 12", None),
        (5, "- 3 of 10, 4", listed, "German"), (6, "- 3 of 10, 4", "- 3 von 10,", "n/a"), (7, "- 3 of 10, 4", "- 3", None),
        (8, code, code, None), (9, code, "f(3) = 4,", None), (10, "Kappa", "Kappa", None), (11, "Kappa", "Kappa-Wert", None), (12, " - ", "-", None), (13, " - ", "- x", None),
    ]
    df = spark.createDataFrame([(k, s, t, "English", lang) for k, s, t, lang in cases], "pair_id long, src_text string, tgt_text string, src_lang string, tgt_lang string")
    assert {r.pair_id: r.defect for r in pair_defects(df, model, refusals, "pair_id").collect()} == dict.fromkeys((2, 4, 6, 7, 9), "truncated")


def test_long_segments_are_counted(spark):
    from lexitile.llm.alignment import _count

    name = lambda lang, n: lang + "abcdefghij"[n // 10] + "abcdefghij"[n % 10]
    row = (1, "English", "German", *(" ".join(name(x, n) for n in range(40)) + " 1000" for x in "ed"))
    c = _count(spark.createDataFrame([row], "id long, sl string, tl string, s string, t string"), None)
    assert c.where("w2 != ''").count() == 1600


def test_alignment_finds_merges_splits_and_moves(spark):
    nouns = [("model", "Modell"), ("network", "Netz"), ("tree", "Baum"), ("layer", "Blatt"), ("river", "Bach"), ("soil", "Boden"), ("price", "Preis"), ("market", "Markt")]
    files = []
    for k in range(60):
        a = [nouns[(k * 3 + i * (k % 5 + 1)) % 8] for i in range(6)]
        b = [nouns[(k + i * 3) % 8] for i in range(6)]
        en = [f"the {x[0]} shows {y[0]} in step {10 + 7 * i + k}." for i, (x, y) in enumerate(zip(a, b))]
        de = [f"das {x[1]} zeigt {y[1]} in Schritt {10 + 7 * i + k}." for i, (x, y) in enumerate(zip(a, b))]
        files.append((k, "English", "German", "\n\n".join(en), "\n".join(de)))
    s, t = files[0][3].split("\n\n"), files[0][4].split("\n")
    files.append((100, "English", "German", "\n".join(s), "\n".join([t[0], t[1] + " " + t[2], t[4], t[3], "ganz anderes hier 999."])))
    files += [(101, "English", "German", None, "x"), (102, "English", "German", "", "x"), files[0]]
    df = spark.createDataFrame(files, "file_pair_id long, src_lang string, tgt_lang string, src_text string, tgt_text string").withColumn("src_line", F.lit(1))
    got = {}
    for r in align_files(df, "file_pair_id").collect():
        got.setdefault(r.file_pair_id, []).append((r.src_line, r.tgt_line))
    assert sorted(got[1]) == [(i, i) for i in range(6)] and len(got[0]) == 6
    assert sorted(got[100]) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 2)]
    assert 101 not in got and 102 not in got
    assert align_files(df.limit(0), "file_pair_id").collect() == []


def test_alignment_helpers():
    assert segments("a\n \n\nb") == ["a", "b"] and segments(None) == []
    assert close("11.31", "11.3") and not close("11.31", "11.4") and not close("11", "12")
    assert anchors(["x 12", "mid", "y 34"], ["u 12", "m", "v 34"]) == [(0, 0), (2, 2), (1, 1)]
    assert Lexicon({}, {}).background("x", ["a"])[0] > 0


CLEAN = ["Der Bär läuft für die Übung zurück.", "Якщо рівняння спрощує тиск, то мережа описує шар.", "L’élève étudie le théorème près de l’île.", "Եթե ծառը փոխարինում է ուղեծիրը։"]


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("cp1251", "cp866"), ("utf-8", "mac_roman")])
def test_forms_turn_back(chain):
    from lexitile.llm.encoding import read, write

    for w in "für рівняння théorème ծառը".split():
        data = write(w, chain[0])
        if data:
            form = read(data, chain[1])
            assert turn_back(form, ">".join(chain)) == w
            if is_odd(form):
                assert form in {f for f, _ in garbled_forms(w)}


def test_garbled_documents(spark):
    from lexitile.llm.encoding import read

    texts = dict(enumerate(CLEAN))
    texts[10] = read(CLEAN[0].encode(), "cp1252")
    texts[11] = CLEAN[2].split()[0] + " " + read(read(CLEAN[2].encode(), "cp1252").encode(), "cp1252")
    texts[12] = read(CLEAN[1].encode("cp1251"), "cp1252")
    texts[13] = "The sign `fÃ¼r` is a quotation of für."
    texts[14] = CLEAN[0].encode("latin-1").decode("utf-8", "replace")
    texts[15] = "½ ¼ ² Å 数式 🇺🇦 plain"
    texts |= {16: None, 17: "", 18: "ascii only?"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(10, texts[10])], "doc_id long, text string").withColumn("word", F.lit("x"))
    found = {r.id for r in find_garbled(df, "doc_id", "text").select("id").distinct().collect()}
    assert found == {10, 11, 12, 14}
    fixed = {r.doc_id: r.text for r in restore_documents(df, "doc_id", "text").collect()}
    assert fixed[10] == CLEAN[0] and fixed[12] == CLEAN[1] and fixed[11] == CLEAN[2].split()[0] + " " + CLEAN[2] and fixed[14] == CLEAN[0]
    assert find_garbled(df.limit(0), "doc_id", "text").collect() == []


UKRAINIAN = [
    "слово дерево метод тиск шар мережа описує рівняння на першому кроці", "метод описує тиск і шар, а мережа змінює дерево", "рівняння та слово на дереві: мережа, метод, тиск",
    "шар змінює слово на кожному кроці, мережа описує метод", "дерево й тиск описує рівняння, слово на першому кроці",
]


@pytest.mark.parametrize(("written", "was_read"), [("koi8-u", "cp1251"), ("cp1251", "koi8-u"), ("cp1251", "cp866"), ("cp866", "cp1251")])
def test_cyrillic_read_as_other_cyrillic(spark, written, was_read):
    """Forms whose letters are all letters of the language are told by their frequency against their originals'."""
    from lexitile.llm.encoding import read

    whole = "слово дерево метод тиск шар мережа"
    half = f"Рівняння описує {read('мережа метод тиск'.encode(written), was_read)} на першому кроці"
    texts = {k: t for k, t in enumerate(UKRAINIAN * 8)} | {100: read(whole.encode(written), was_read), 101: half, 102: "МЕТОД і СЛОВО на першому кроці"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fixed = {r.doc_id: (r.text, r.n_left) for r in restore_documents(df, "doc_id", "text").collect()}
    assert fixed == {100: (whole, 0), 101: ("Рівняння описує мережа метод тиск на першому кроці", 0)}


def test_single_signs_count_only_with_their_chain(spark):
    """'õ' for '§' is garbled if other documents show its chain, 'Å' and '½' that no garbled document holds are signs of their own."""
    from lexitile.llm.encoding import read

    plain = [f"§ {k} für die größte Übung" for k in range(40)]
    bad = [read(f"§ {k} für die größte Übung".encode("cp850", "replace"), "cp1252") for k in range(5)]
    texts = dict(enumerate(plain)) | {100 + k: t for k, t in enumerate(bad)} | {200: read("§".encode("cp850"), "cp1252") + " 7 ist alles", 201: "Å 7 ist ½ davon"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.id for r in find_garbled(df, "doc_id", "text").select("id").distinct().collect()}
    assert found == {*range(100, 105), 200}


def test_words_without_original_follow_their_neighbours():
    from lexitile.llm.encoding import read, restore_text

    text = read("мережа якась рідкість тиск".encode("koi8-u"), "cp1251")
    first, last = text.split()[0], text.split()[-1]
    assert restore_text(f"шар {text} шар", {first: "мережа", last: "тиск"}, ["koi8-u>cp1251"], {"шар"}) == ("шар мережа якась рідкість тиск шар", 4, 0)
    assert restore_text("шар рідкість", {}, ["koi8-u>cp1251"], {"шар"}) == ("шар рідкість", 0, 0)
    assert restore_text("a � b", {}, ["utf-8>lost"], set()) == ("a � b", 0, 1)


ORDINARY = [
    "Hier kann ich zeigen, dass der Satz gilt.", "Zuerst muss ich die Daten laden.", "je dois charger les données", "Debo rechazar la hipótesis nula.", "I must normalise the vector first.", "Не можу знайти файл.",
    "I am sorry, but the server cannot open this window.", "Meine Regeln für das Modell sind einfach.", "Nous ne pouvons pas diviser par zéro.", "No puedo abrir la ventana sin la llave.", "Ես պետք է կրկնեմ չափումը։",
]
DECLINING = [
    "I'm sorry, but I can't help with that request.", "As an AI, I am unable to translate this section.", "Leider darf ich diesen Inhalt nicht bearbeiten.", "Désolé, je ne suis pas autorisé à traduire ce document.", "Lo siento, no puedo procesar este contenido.",
    "На жаль, я не можу перекласти цей фрагмент.", "Ցավոք, չեմ կարող թարգմանել այս տեքստը։",
]


def test_refusals_are_told_from_ordinary_first_person(refusals):
    assert [t for t in ORDINARY if refusals.declines(prose_sentences(t))] == []
    assert [t for t in DECLINING if not refusals.declines(prose_sentences(t))] == []
    assert not refusals.declines([]) and not refusals.declines(prose_sentences("Das Modell begrenzt die Schicht. Der Baum zeigt das Netz. Ich kann diesen Text nicht übersetzen."))


def test_prefix_families_and_length_limits_by_themselves(spark):
    """A planted family of prefixes, shortened neighbours of other prompts and a planted length limit, found by those branches alone."""
    import random

    from lexitile.llm.pairs import shortened_responses

    rng = random.Random(5)
    words = "der Baum zeigt Netz Modell begrenzt Schicht ohne Verlust Punkt Kurve Feld lang Wert klein am Ende".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"prompt {k} " + "x" * 90, text(rng.randint(8, 30)) + ".") for k in range(600)]
    full = "Eine ganz andere Antwort, die über mehrere Zeilen geht und erst hier endet."
    rows += [(1000 + k, "one prompt", full[:n]) for k, n in enumerate((70, 40, 12, 3))] + [(1004, "one prompt", full), (1005, "One prompt again, in other words", full[:20]), (1006, "One", "Eine"), (1007, "One prompt, again", full[:30] + " …")]
    rows += [(2000 + k, "y" * 200, (text(60) + "abcdef" * 9)[:117] + "qxz") for k in range(30)]
    rows += [(3000, "empty", ""), (3001, "null", None), (3002, None, "x"), (3003, "same", "same"), (3004, "same", "same and more.")]
    df = spark.createDataFrame(rows, "id long, src string, tgt string").repartition(5)
    got = {r.id: r.by for r in shortened_responses(df).collect()}
    assert got == dict.fromkeys((1000, 1001, 1002, 1003), "prompt") | dict.fromkeys((1005, 1007), "neighbour") | dict.fromkeys(range(2000, 2030), "length")
    assert shortened_responses(df.limit(0)).collect() == []


def _translations(files, merge=None):
    """Rows of made-up file pairs: ``files`` lists of English segments, German by a word for word code, ``merge`` joins target lines a to b."""
    code = lambda w: w[::-1] + "en" if w.isalpha() else w
    rows = []
    for k, lines in enumerate(files):
        de = [" ".join(code(w) for w in x.split()) for x in lines]
        if merge and k == 0:
            de = [*de[: merge[0]], " ".join(de[merge[0] : merge[1]]), *de[merge[1] :]]
        rows.append((k, "EN", " _german_ ", "\n".join(lines), "\n".join(de)))
    return rows


FILE_PAIRS = "file_pair_id long, src_lang string, tgt_lang string, src_text string, tgt_text string"


def test_alignment_of_merged_threes_and_fours_with_and_without_broadcast(spark):
    import random

    rng = random.Random(4)
    words = [a + b + c for a in "btk" for b in "aeiou" for c in ("lom", "rin", "sat", "dev")]
    files = [[" ".join(rng.sample(words, 6)) + f" {rng.randint(10, 9999)}" for _ in range(9)] for _ in range(60)]
    for merge in ((2, 5), (3, 7)):
        df = spark.createDataFrame(_translations(files, merge), FILE_PAIRS)
        got = sorted((r.file_pair_id, r.src_line, r.tgt_line) for r in align_files(df, "file_pair_id").collect())
        a, b = merge
        assert [(i, j) for k, i, j in got if k == 0] == [(i, i if i < a else a if i < b else i - (b - a - 1)) for i in range(9)]
        assert [(i, j) for k, i, j in got if k == 7] == [(i, i) for i in range(9)]
        assert sorted((r.file_pair_id, r.src_line, r.tgt_line) for r in align_files(df, "file_pair_id", limit=0).collect()) == got


def test_alignment_of_long_segments_of_a_large_vocabulary(spark):
    """Forty words a segment, 900 words: no cap leaves out the rare ones."""
    import random

    rng = random.Random(6)
    words = [a + b + c + d for a in "btkmns" for b in "aeiou" for c in "lrdfg" for d in ("om", "in", "at", "ev", "ub", "iz")]
    files = [[" ".join(rng.sample(words, 40)) + (f" {rng.randint(10, 9999)}" if n % 2 else "") for n in range(6)] for _ in range(120)]
    rows = _translations(files)
    rows = [(k, s, t, a, "\n".join([*b.split("\n")[1:], b.split("\n")[0]]) if k < 5 else b) for k, s, t, a, b in rows]
    got = {}
    for r in align_files(spark.createDataFrame(rows, FILE_PAIRS), "file_pair_id").collect():
        got.setdefault(r.file_pair_id, set()).add((r.src_line, r.tgt_line))
    assert all(got[k] == {(i, (i - 1) % 6) for i in range(6)} for k in range(5))
    assert all(got[k] == {(i, i) for i in range(6)} for k in range(5, 120))


def test_confidence_is_calibrated_on_held_out_sentences(samples):
    """The mean probability of the chosen language is close to the share of right choices, for whole sentences and for short ones."""
    m = fit([s for i, s in enumerate(samples) if i % 4])
    whole = [(lang, s) for i, (lang, t) in enumerate(samples) if not i % 4 for s in prose_sentences(t)]
    for rows in (whole, [(lang, s[k : k + 2]) for lang, s in whole for k in range(0, len(s) - 1, 2)]):
        p = m.probabilities(m.sums([s for _, s in rows]))
        right = sum(m.langs[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), rows)) / len(rows)
        assert abs(p.max(axis=1).mean() - right) < 0.06


def test_confidence_of_a_run_is_the_mean_of_its_sentences(spark, model):
    t = "Das Modell begrenzt die Schicht. Der Baum zeigt das Netz. Ja nun."
    r = segment_languages(spark.createDataFrame([(1, t)], "pair_id long, tgt_text string"), model, "pair_id", "tgt_text").collect()
    p = model.probabilities(model.sums(prose_sentences(t)))[:, model.langs.index("German")]
    assert len(r) == 1 and r[0].n_sentences == len(p) and r[0].confidence == pytest.approx(p.mean(), abs=1e-5)

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexitile.cli import run
from lexitile.operators.translation import FileMemory, Ladder, Overloaded, subchunks, translate_chunk, translate_file, translate_sequential, translate_snapshot
from lexitile.project import Project, ProjectError, register_service
from lexitile.sources.files import copy_plan, has_notebook_header, notebook_cells, read_correspondence, stale_files, text_files, write_correspondence


def shout(prompt: str) -> str:
    """Replies with the unit, its text marked."""
    a, b = prompt.find("<document>"), prompt.rfind("</document>") + len("</document>")
    return "<output>\n" + prompt[a:b].replace("<TEXT>", "<TEXT>T:") + "</output>"


def test_waiting_doubles_and_gives_up():
    waits, left = [], [2]

    def model(_):
        if left[0]:
            left[0] -= 1
            raise Overloaded
        return "ok"

    assert Ladder(model, first_wait=0.01, sleep=waits.append).patient(model, "p") == "ok" and waits == [0.01, 0.02]
    left[0], waits[:] = 9, []
    with pytest.raises(Overloaded):
        Ladder(model, sleep=waits.append).patient(model, "p")
    assert waits == [1.0, 2.0, 4.0, 8.0]


def test_broken_replies_climb_the_ladder():
    calls = []
    bad = lambda p: calls.append("m") or "<output><TEXT>"
    good = lambda p: calls.append("s") or shout(p)
    assert translate_chunk(Ladder(bad, good), "a word", "myst", "French").startswith("T:") and calls == ["m", "m", "s"]
    with pytest.raises(Exception):
        translate_chunk(Ladder(bad), "a word", "myst", "French")


def test_oversized_typst_goes_in_parts():
    text = "word " * 900
    parts = subchunks(text)
    assert "".join(parts) == text and all(len(p) <= 2001 for p in parts) and len(parts) > 1
    assert translate_chunk(Ladder(shout), text, "typst", "French").count("T:") == len(parts)


def row(i, text, kind="myst"):
    return {"chunk_id": i, "content": text, "kind": kind, "src_lang": "English", "tgt_lang": "French"}


def test_sequential_statuses_duplicates_and_examples():
    seen = []
    model = lambda p: seen.append(p) or shout(p)
    m = FileMemory()
    m.put("English", "French", "known text", "connu")
    out = translate_file([row(1, " "), row(2, "known text"), row(3, "new words come here"), row(4, "new words come here"), row(5, "`code`"), row(6, "new words come hers"), row(7, None), row(8, "x", "python")], m, Ladder(model))
    assert [(r["status"], r["from_cache"]) for r in out] == [("passed", True), ("cached", True), ("translated", False), ("cached", False), ("passed", True), ("translated", False), ("null", True), ("passed", True)]
    assert len(seen) == 2 and "new words come here" in seen[1] and "T:new words come here" in seen[1]
    again = translate_file([row(1, "new words come here")], m, Ladder(model))
    assert again[0]["from_cache"] and len(seen) == 2
    assert translate_file([row(1, "text")], FileMemory(), Ladder(lambda p: 1 / 0))[0]["status"] == "failed"


def test_spark_modes_agree_without_examples(spark):
    chunks = spark.createDataFrame([(1, "p", "English", "French", "myst", "alpha beta", 0), (2, "p", "English", "French", "myst", "alpha beta", 1), (3, "q", "English", "French", "myst", "stored", 0), (4, "q", "English", "French", "latex", "$x$", 1), (5, None, "English", "French", "myst", "", 0), (6, "q", "English", "French", "myst", None, 2)], "chunk_id long, path string, src_lang string, tgt_lang string, kind string, content string, ordinal int")
    memory = spark.createDataFrame([("q", "English", "French", "stored", "gardé"), ("", "English", "French", "none", "x")], "path string, src_lang string, tgt_lang string, content string, translated string")
    a = {r.chunk_id: r.translated for r in translate_snapshot(chunks, memory, Ladder(shout)).collect()}
    b = {r.chunk_id: r.translated for r in translate_sequential(chunks, memory, Ladder(shout)).collect()}
    assert a == b == {1: "T:alpha beta", 2: "T:alpha beta", 3: "gardé", 4: "$x$", 5: "", 6: None}
    assert translate_snapshot(chunks.limit(0), memory, Ladder(shout)).collect() == []


@pytest.fixture
def project(tmp_path):
    (tmp_path / "en" / "sub").mkdir(parents=True)
    (tmp_path / "en" / "a.md").write_text("# One\n\nText here.\n", encoding="utf-8")
    (tmp_path / "en" / "sub" / "b.typ").write_text("= Two\n\nMore *text*.\n", encoding="utf-8")
    (tmp_path / "en" / "data.csv").write_text("x,y\n")
    run(["init", "--name", "course"], tmp_path)
    run(["set-source", "en", "english"], tmp_path)
    return tmp_path


def test_project_rules(project):
    run(["set-target", "French"], project)
    p = Project.load(project / "en" / "sub")
    assert (project / "course_fr").is_dir() and p.languages == ["English", "French"]
    for bad in (["set-target", "English"], ["set-target", "French"], ["set-source", "en", "French"], ["remove", "en/a.md"], ["add", "en/none.md"], ["set-target", "German", ".."], ["cache", "clear"], ["cache", "clear", "--missing-chunks", "--lang", "French"]):
        with pytest.raises(ProjectError):
            run(bad, project)
    run(["add", "en/a.md", "en/a.md", "en/sub/b.typ"], project)
    assert run(["list"], project) == ["en/a.md", "en/sub/b.typ"] and run(["sync"], project) == ["1"] and (project / "course_fr" / "data.csv").exists()
    run(["set-typst-func-args", " Ex ", "b", "A", "a"], project)
    run(["set-reasoning-model", "s", "big"], project)
    p = Project.load(project)
    assert p.config.typst_args["ex"] == ["a", "b"] and p.route(True) == ("s", "big", None, None) and p.relative_path(project / "en" / "sub" / "b.typ") == "sub/b.typ"
    data = json.loads((project / ".lexitile" / "config.json").read_text())
    assert data["source"] == {"lang": "English", "path": "en"}
    run(["remove-target", "French"], project)
    assert not (project / "course_fr").exists()


def test_translate_files_end_to_end(spark, project):
    register_service("shout", shout)
    run(["set-target", "French"], project)
    nb = {"cells": [{"cell_type": "markdown", "metadata": {"id": 7}, "source": ["# Head\n", "words"]}, {"cell_type": "code", "metadata": {}, "source": "x = 1", "outputs": []}], "metadata": {"unknown": {"k": 1}}, "nbformat": 4}
    (project / "en" / "n.ipynb").write_text(json.dumps(nb), encoding="utf-8")
    (project / "en" / "plain.txt").write_text("line one\n", encoding="utf-8")
    run(["add", "en/a.md", "en/sub/b.typ", "en/n.ipynb", "en/plain.txt"], project)
    first = run(["translate", "all", "French", "--service", "shout"], project)
    text = (project / "course_fr" / "a.md").read_text(encoding="utf-8")
    assert "CHUNK_METADATA_START" in text and "T:" in text and "needs_review: True" in text and any("translated" in x for x in first)
    again = run(["translate", "all", "French", "--service", "shout"], project)
    book = json.loads((project / "course_fr" / "n.ipynb").read_text(encoding="utf-8"))
    assert book["metadata"] == {"unknown": {"k": 1}} and book["cells"][0]["metadata"]["id"] == 7 and book["cells"][1]["source"] == "x = 1" and "T:" in "".join(book["cells"][0]["source"])
    assert (project / "course_fr" / "plain.txt").exists()
    assert all("translated" not in x or "plain.txt" in x for x in again) and (project / "course_fr" / "sub" / "b.typ").exists()
    assert run(["cache", "sync", "--lang", "French"], project)[0].startswith("French ")
    assert int(run(["cache", "clear", "--all", "--keyword", "Text"], project)[0]) > 0


def test_sync_rebuilds_notebooks_and_clearing_drops_missing_chunks(spark, project):
    from lexitile.project.files import memory, memory_path, save_memory

    register_service("shout", shout)
    run(["set-target", "French"], project)
    nb = {"cells": [{"cell_type": "markdown", "metadata": {}, "source": ["# Head\n", "words"]}, {"cell_type": "raw", "source": ""}], "metadata": {}, "nbformat": 4}
    (project / "en" / "n.ipynb").write_text(json.dumps(nb), encoding="utf-8")
    run(["add", "en/n.ipynb"], project)
    run(["translate", "all", "French", "--service", "shout"], project)
    assert int(run(["cache", "clear", "--all"], project)[0]) > 0
    run(["cache", "sync", "--lang", "French"], project)
    p = Project.load(project)
    got = {r.content: r.translated for r in memory(spark, p).where("path = 'n.ipynb'").collect()}
    target = json.loads((project / "course_fr" / "n.ipynb").read_text(encoding="utf-8"))
    assert got["# Head\nwords"] == "".join(target["cells"][0]["source"]) and "T:" in got["# Head\nwords"]
    n = memory(spark, p).count()
    new = [("x", "English", "French", "a", None, 0), ("x", "English", "French", None, "b", 1), ("x", "German", "French", "c", "d", 2), ("x", "English", "German", "e", "f", 3)]
    save_memory(spark, p, spark.createDataFrame(new, memory(spark, p).schema))
    assert run(["cache", "clear", "--missing-chunks"], project) == ["3"] and run(["cache", "clear", "--missing-chunks"], project) == ["0"]
    assert memory(spark, p).count() == n + 1 and memory_path(p).exists()


def test_file_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("---\njupytext:\n  text_representation:\n    extension: .md\n    format_name: myst\n---\n# T\n", encoding="utf-8")
    (tmp_path / "y.tex").write_text("é", encoding="utf-8")
    got = {r.rel_path: (r.content[:3], r.doc_type) for r in text_files(spark, str(tmp_path)).collect()}
    assert got == {"d/x.md": ("---", "jupyter"), "y.tex": ("é", "latex")}
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "x = 1"}]})
    cells = spark.createDataFrame([(nb,), ("no json",)], "c string").select(notebook_cells(F.col("c"))).collect()
    assert [tuple(c) for c in cells[0][0]] == [("markdown", "a\nb"), ("code", "x = 1")] and cells[1][0] is None
    assert not spark.range(1).select(has_notebook_header(F.lit("# no header"))).first()[0]
    wide = spark.createDataFrame([(0, "p", "a", None)], "row_id long, path_checksum string, english string, french string")
    write_correspondence(wide, str(tmp_path / "corr"))
    assert [tuple(r)[:3] for r in read_correspondence(spark, str(tmp_path / "corr")).collect()] == [("p", "a", "")]
    tree = lambda *x: spark.createDataFrame([(i,) for i in x], "rel_path string")
    assert sorted(r[0] for r in copy_plan(tree("a/b/c", "a/d", "e", "f"), tree("e"), tree("a/b")).collect()) == ["a/d", "f"]
    assert [r[0] for r in stale_files(tree("a", "z"), tree("a")).collect()] == ["z"]


def test_correspondence_rows_are_numbered_in_file_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("path_checksum,english\n" + "".join(f'p{k},"cell {k}\nof {i}"\n' for i in range(4)), encoding="utf-8")
    got = sorted((r.row_id, r.english) for r in read_correspondence(spark, str(tmp_path)).collect())
    assert got == [(4 * k + i, f"cell {k}\nof {i}") for k in range(3) for i in range(4)]


def test_no_temporary_folder_on_a_cluster():
    from types import SimpleNamespace

    from lexitile.sources.tables import ensure_checkpoint_dir

    held = []
    sc = lambda master, folder: SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {"spark.checkpoint.dir": folder}, master=master, setCheckpointDir=held.append)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc("spark://host:7077", None)))
    ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc("spark://host:7077", "shared/folder")))
    assert held == ["shared/folder"]


def test_streams_equal_batches(spark, tmp_path):
    from lexitile.streaming.feeds import first_deliveries, memory_updates, tumbling_counts

    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", i % 2, "a" if i % 2 else "b", 1.0) for i in range(12)], "event_id long, t string, user_id int, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    q = tumbling_counts(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, tumbling_counts(e).collect()))
    assert first_deliveries(e.unionByName(e), ["event_id"], "ts").count() == 12
    pairs = spark.createDataFrame([(1, "p", "English", "a", "French", "b")], "seq long, path string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string")
    pairs.write.parquet(str(tmp_path / "pairs"))
    got = []
    long = spark.createDataFrame([(1, "", "English", "a")], "row_id long, path string, lang string, checksum string")
    q = memory_updates(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs")), lambda: long, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.tgt_checksum, r.row_id, r.adopted) for r in got] == [("b", 1, True)]


FORMATS = {
    "tide.tex": "\\section{Tide}\n\nHigh water comes twice.\n\nLow water.\n\nHigh water comes twice.\n",
    "tide.md": "# Tide\n\nHigh water.\n\n# Moon\n\nFull.\n\n# Tide\n\nHigh water.\n",
    "tide.typ": "= Tide\n\nHigh water.\n\n= Moon\n\nFull.\n\n= Tide\n\nHigh water.\n",
    "book.md": "---\njupytext:\n  text_representation:\n    extension: .md\n    format_name: myst\n---\n# Tide\n\nHigh water.\n\n# Moon\n\nFull.\n",
}


def _marks(text):
    """Whether each cell of a target file is marked for review, in order."""
    return ["needs_review: True" in block for block in text.split("CHUNK_METADATA_START")[1:]]


def test_review_marks_of_two_passes_in_every_format(spark, project):
    """New chunks are marked, also repeated ones; a second pass keeps what was marked and what was taken off by hand."""
    register_service("shout", shout)
    run(["set-target", "French"], project)
    for name, text in FORMATS.items():
        (project / "en" / name).write_text(text, encoding="utf-8")
    cells = [{"cell_type": "markdown", "metadata": {}, "source": x} for x in ("High water", "Moon", "High water")]
    (project / "en" / "n.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}, "nbformat": 4}), encoding="utf-8")
    run(["add", *(f"en/{n}" for n in FORMATS), "en/n.ipynb"], project)
    run(["translate", "all", "French", "--service", "shout"], project)
    out = project / "course_fr"
    first = {n: (out / n).read_text(encoding="utf-8") for n in FORMATS}
    assert first["book.md"].startswith("---\njupytext:") and "T:" in first["book.md"]
    for name, text in first.items():
        assert "needs_review: False" not in text and _marks(text) == [True] * len(_marks(text)) and len(_marks(text)) >= 2, name
        (out / name).write_text(text.replace("% needs_review: True\n", "", 1).replace("// needs_review: True\n", "", 1), encoding="utf-8")
    book = json.loads((out / "n.ipynb").read_text(encoding="utf-8"))
    assert [c["metadata"]["tags"] for c in book["cells"]] == [["needs_review"]] * 3
    book["cells"][1]["metadata"]["tags"] = ["kept"]
    (out / "n.ipynb").write_text(json.dumps(book), encoding="utf-8")
    run(["translate", "all", "French", "--service", "shout"], project)
    for name in FORMATS:
        again = _marks((out / name).read_text(encoding="utf-8"))
        checks = [b.split("src_checksum: ")[1].split()[0] for b in first[name].split("CHUNK_METADATA_START")[1:]]
        assert again == [c != checks[0] for c in checks], name
    book = json.loads((out / "n.ipynb").read_text(encoding="utf-8"))
    assert [c["metadata"].get("tags", []) for c in book["cells"]] == [["needs_review"], [], ["needs_review"]]


def test_failed_chunks_say_so_and_text_notebooks_are_synchronised(spark, project):
    def fails(prompt):
        raise ValueError("no answer")

    register_service("fails", fails)
    register_service("shout", shout)
    run(["set-target", "French"], project)
    (project / "en" / "book.md").write_text(FORMATS["book.md"], encoding="utf-8")
    run(["add", "en/book.md"], project)
    run(["translate", "all", "French", "--service", "fails"], project)
    text = (project / "course_fr" / "book.md").read_text(encoding="utf-8")
    assert "not-translated-due-to-exception: True" in text and "needs_review" not in text and "High water." in text
    run(["translate", "all", "French", "--service", "shout"], project)
    run(["cache", "clear", "--all"], project)
    assert run(["cache", "sync"], project) == ["French 2"]


def test_correction_takes_hand_made_changes_over(spark, project):
    from lexitile.project.files import memory

    register_service("shout", shout)
    run(["set-target", "French"], project)
    for n in ("tide.md", "tide.typ"):
        (project / "en" / n).write_text(FORMATS[n], encoding="utf-8")
    run(["add", "en/tide.md", "en/tide.typ"], project)
    run(["translate", "all", "French", "--service", "shout"], project)
    assert sorted(run(["correct", "French"], project)) == ["tide.md 0", "tide.typ 0"]
    target = project / "course_fr" / "tide.md"
    target.write_text(target.read_text(encoding="utf-8").replace("Full", "Pleine lune"), encoding="utf-8")
    assert run(["correct", "French", "en/tide.typ"], project) == ["tide.typ 0"] and run(["correct", "French", "en/tide.md"], project) == ["tide.md 1"]
    assert [r.translated for r in memory(spark, Project.load(project)).collect() if r.content.startswith("# Moon") and r.path == "tide.md"][0].count("Pleine lune") == 1
    assert run(["correct", "French", "en/tide.md"], project) == ["tide.md 0"]
    with pytest.raises(ProjectError):
        run(["correct", "German"], project)


def test_models_arguments_and_terms_reach_the_translation(spark, project):
    seen = []

    def big(prompt, model, token):
        Path(token).open("a", encoding="utf-8").write(f"{model}|{prompt}\x1e")
        return shout(prompt)

    register_service("big", big, token=str(project / "log"))
    run(["set-target", "French"], project)
    (project / "en" / "c.typ").write_text('#buoy(hint: "Seen from afar", title: "Heading")[Body]\n', encoding="utf-8")
    (project / "terms.csv").write_text("English,French\n afar , loin\nnone,\n", encoding="utf-8")
    run(["add", "en/c.typ"], project)
    run(["set-llm", "big", "small"], project)
    assert Project.load(project).route(True) == ("big", "small", None, None)
    run(["set-reasoning-model", "big", "large"], project)
    run(["set-typst-func-args", "buoy", "hint"], project)
    run(["translate", "all", "French", "--use-reasoning-model", "--vocabulary", str(project / "terms.csv")], project)
    seen = [x for x in (project / "log").read_text(encoding="utf-8").split("\x1e") if x]
    assert len(seen) == 1 and seen[0].startswith("large|") and "afar=loin\n" in seen[0] and "none" not in seen[0]
    assert "Seen from afar" in seen[0] and '<PH id="1">#buoy(hint: "</PH>Seen' in seen[0] and 'title: "Heading"' in seen[0]


def test_parts_of_oversized_chunks_go_through_the_memory():
    text = " ".join(f"word{n}" for n in range(400)) + " #f[" + " ".join(f"more{n}" for n in range(300)) + "]"
    calls = []

    def model(prompt):
        calls.append(prompt)
        return shout(prompt)

    row = {"chunk_id": 1, "kind": "typst", "src_lang": "English", "tgt_lang": "French", "content": text, "ordinal": 0}
    m = FileMemory()
    first = translate_file([row], m, Ladder(model))[0]
    n = len(calls)
    assert n > 1 and not first["from_cache"]
    m.pairs = {k: v for k, v in m.pairs.items() if v != first["translated"]}  # the parts alone are left
    again = translate_file([row], m, Ladder(model))[0]
    assert len(calls) == n and again["from_cache"] and again["translated"] == first["translated"]


def test_rest_after_each_answer():
    rests = []
    ladder = Ladder(lambda p: "<output>x</output>", cooldown=2.5, sleep=rests.append)
    assert ladder.patient(ladder.model, "p") and rests == [2.5]

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexitile.functions.markup import checked, chunk, segment
from lexitile.functions.units import build, coalesce, placeholder_only, reconstruct
from lexitile.operators.chunking import long_pieces

SIGNS = st.lists(st.sampled_from(list("ab \n\t{}[]()$%\\#*_`-+=:>!<&@/\"'|~.1éя") + ["\\begin{align}", "\\end{align}", "```", ":::{note}", "$$", "#set ", "\\text{", "\r\n"]), max_size=60).map("".join)


def text_of(source: str, kind: str, **o) -> str:
    return "".join(c for k, c in segment(source, kind, **o) if k == "text")


def held_of(source: str, kind: str, **o) -> str:
    return "".join(c for k, c in segment(source, kind, **o) if k != "text")


@pytest.mark.parametrize("kind", ["latex", "myst", "typst", "python", "java", "rust", "other"])
@given(SIGNS)
@settings(max_examples=150, deadline=None)
def test_segments_and_units_give_the_text_back(kind, source):
    s = segment(source, kind)
    assert "".join(c for _, c in s) == source
    unit, held = build(s)
    assert reconstruct(unit, held) == source


@pytest.mark.parametrize("kind", ["latex", "myst", "typst"])
@pytest.mark.parametrize("value", [None, "", "   \n "])
def test_nothing_has_no_chunks(kind, value):
    assert chunk(value, kind) == []


@given(SIGNS)
@settings(max_examples=150, deadline=None)
def test_typst_chunks_join_to_the_source(source):
    if source.strip():
        assert "".join(c["content"] for c in chunk(source, "typst")) == source


def test_latex_text_math_and_commands():
    s = "\\subsection*{Tides}\nThe height $h(t)=\\sin t$ of \\ref{fig:moon}.\n\\begin{gather}\n h_0 \\leq 3 \\text{metres at noon}\n\\end{gather}\n\\verb|low tide| % check twice\n"
    t, h = text_of(s, "latex"), held_of(s, "latex")
    assert "Tides" in t and "metres at noon" in t and "check twice" in t
    assert "h(t)=" in h and "\\ref{fig:moon}" in h and "\\verb|low tide|" in h and "h_0" in h


def test_latex_definitions_expose_the_last_argument_only():
    s = "\\newcommand{\\foo}[1]{Text #1 with $x$}"
    assert text_of(s, "latex").split() == ["Text", "with"]


def test_latex_code_environments_and_fragments_are_kept_whole():
    assert text_of("\\begin{lstlisting}\nint x;\n\\end{lstlisting}", "latex") == ""
    assert segment("end\n\\end{document}", "latex") == [("placeholder", "end\n\\end{document}")]
    assert text_of("\\mycmd{stay} \\begin{myenv}gone\\end{myenv}", "latex", whole_commands=("mycmd",), whole_envs=("myenv",)).strip() == ""


def test_latex_chunks():
    d = "\\documentclass{a}\n\\begin{document}\n\\section{One}\nPara one.\n\nPara two.\n\\begin{remark}x\\end{remark}\n\\end{document}\n"
    assert [c["content"] for c in chunk(d, "latex")] == ["\\documentclass{a}", "\\begin{document}", "\\section{One}", "Para one.", "Para two.", "\\begin{remark}x\\end{remark}", "\\end{document}"]


def test_myst_roles_directives_and_options():
    s = ":::{warning} Mind the gap\n:name: gap\n+ first `k`\n  second row\n:::\n\nA {definiendum}`harbour <port>` near {numref}`map-3`.\n\n```{figure} pier.svg\n:alt: Boats at the pier\n:width: 7cm\nOur pier\n```\n\n```{bibliography}\nlist/of/books\n```\n"
    t = text_of(s, "myst")
    for w in ("Mind the gap", "first", "second row", "harbour", "port", "Boats at the pier", "Our pier"):
        assert w in t
    for w in ("map-3", "7cm", "pier.svg", "books"):
        assert w not in t


def test_myst_links_headings_and_soft_breaks():
    s = "## A `code` title\n\nOne [link text](https://x.y) and\nmore ![alt](i.png) $a$.\n"
    t = text_of(s, "myst")
    assert "link text" in t and "alt" in t and "and\nmore" in t and "https" not in t and "code" not in t


def test_myst_sections_and_size_rule():
    small = "# One\n\ntext\n\n# Two\n\nmore\n"
    assert [c["content"] for c in chunk(small, "myst")] == ["# One\n\ntext\n\n", "# Two\n\nmore\n"]
    long = "# One\n\n" + "word " * 300 + "\n\n" + "word " * 300 + "\n"
    assert [c["kind"] for c in chunk(long, "myst")] == ["heading", "paragraph", "paragraph"]


def test_typst_commands_strings_and_math():
    s = '#rect(title: [Low water], width: 3cm)[Ebb and flood]\n#tide(summary: "Deux marées par jour", lang: "fr")[At night]\n$h = k dot " if calm " t$ and l\'île @moon <sec-9> // ask later\n'
    t = text_of(s, "typst")
    for w in ("Low water", "Ebb and flood", "Deux marées par jour", "At night", " if calm ", "l'île", "ask later"):
        assert w in t
    for w in ('"fr"', "@moon", "<sec-9>", "h = k dot"):
        assert w in held_of(s, "typst")


def test_typst_arguments_by_function_and_deny_list():
    """A function's own list answers alone; the default list is for functions without one; the deny-list goes before both."""
    s = '#buoy(hint: "Seen from afar", title: "Heading", key: "no")[Body]'
    assert "Heading" in text_of(s, "typst") and "afar" not in text_of(s, "typst")
    t = text_of(s, "typst", args_by_function={"Buoy": [" hint ", "key"]})
    assert "Seen from afar" in t and "Heading" not in t and "no" not in t
    far = "#note(" + "a: 1, " * 60 + "title" + " " * 200 + ':\n "Late")'
    assert "Late" in text_of(far, "typst")


def test_typst_chunk_packing():
    sea = [" ".join(f"{w}{n}" for n in range(110)) for w in ("salt", "wave", "sand")]
    one, two, three = sea[0] + " with $p/q$ inside.\n\n", sea[1] + " as well.\n\n", sea[2] + " at last.\n"
    assert len(one + two) <= 2000 < len(one + two + three)
    assert [c["content"] for c in chunk(one + two + three, "typst")] == [one + two, three]
    short = 'See $u / v$ and #link("w")[that map] there.\n'
    assert [c["content"] for c in chunk(short, "typst")] == [short]
    call = "#rect(title: [Low water])[Ebb and flood]"
    assert any(call in c["content"] for c in chunk(sea[0] + " " + sea[1] + " " + sea[2] + " " + call + "\n" + sea[0], "typst"))


def test_code_comments_and_strings():
    assert text_of('x = "hello" # note\n', "python") == "hello note"
    assert text_of('int a; // one\nString s = "two"; /* three */', "java") == " onetwo three "
    assert '"whole"' in text_of('let s = "whole"; // c', "rust")


def test_coalescing_keeps_bare_line_ends_alone():
    s = [("placeholder", "a"), ("placeholder", "b"), ("placeholder", "\n"), ("math", "c"), ("text", "t"), ("text", "u"), ("placeholder", "")]
    assert coalesce(s) == [("placeholder", "ab"), ("placeholder", "\n"), ("placeholder", "c"), ("text", "tu")]
    unit, held = build(s)
    assert unit == '<document><TEXT><PH id="1">ab</PH><PH id="2">\n</PH><PH id="3">c</PH>tu</TEXT></document>' and held["1"] == "ab"


def test_reconstruct_rules():
    assert reconstruct('<document><TEXT>a<PH id="1">x</PH>b<B>gone</B>c<PH id="9">own</PH></TEXT></document>', {"1": "&"}) == "a&bcown"
    assert reconstruct("<document/>", {}) == ""
    with pytest.raises(Exception, match="mismatched|not well|no element|unclosed"):
        reconstruct("<TEXT>", {})


def test_placeholder_only():
    assert placeholder_only([("math", "x"), ("placeholder", "y")]) and not placeholder_only([("text", " ")]) and placeholder_only([("text", " ")], ignore_blank=True)


@given(st.text(alphabet="ab  \n", max_size=200), st.integers(3, 40))
@settings(max_examples=200, deadline=None)
def test_long_pieces(text, limit):
    p = long_pieces(text, limit)
    assert "".join(p) == text and all(len(x) <= limit + 1 for x in p)
    for x in p[:-1]:
        assert re.search(r"\s\Z", x) or len(x) == limit


@pytest.mark.parametrize("depth", [10_000])
@pytest.mark.parametrize(("kind", "left", "right"), [("latex", "{", "}"), ("latex", "{", ""), ("latex", "\\emph{", "}"), ("typst", "#f[", "]"), ("typst", "#f[", "")])
def test_deep_nesting(kind, left, right, depth):
    source = left * depth + "x" + right * depth
    found, whole = checked(source, kind)
    assert whole and "".join(c for _, c in found) == source and ("text", "x") in found


def test_nested_directives():
    source = "".join(":" * (1003 - n) + "{note}\n" for n in range(1000)) + "x\n"
    found, whole = checked(source, "myst")
    assert whole and ("text", "x") in found


def test_unknown_kinds_are_one_placeholder():
    assert checked("a", "other") == ([("placeholder", "a")], True) and checked(None, "latex") == ([], True)


def test_myst_tables_definitions_and_footnotes():
    """Every cell, definition and footnote is a text by itself; pipes, colons and labels are kept."""
    s = "| Port | Depth `m` |\n| :--- | ---: |\n| North pier | 4 \\| 5 |\n\nEbb\n: water *falls*\n\n[^tide]: see the table\n"
    got = [c for k, c in segment(s, "myst") if k == "text"]
    assert got == ["Port", "Depth ", "North pier", "4 ", " 5", "Ebb", "water ", "falls", "see the table"]


#: Fixed documents with the segments expected: t text, p placeholder, m math.
EXPECTED = {
    'latex': ('\\section{Tides \\& moons}\nThe \\emph{height} of $h_1$ is~\\cite[p.~3]{low} metres -- see \\url{http://a.b}.\n\\begin{itemize}\n\\item First % note\n\\end{itemize}\n', [('p', '\\section{'), ('t', 'Tides '), ('p', '\\&'), ('t', ' moons'), ('p', '}'), ('t', '\nThe '), ('p', '\\emph{'), ('t', 'height'), ('p', '}'), ('t', ' of '), ('p', '$'), ('p', 'h_1'), ('p', '$'), ('t', ' is'), ('p', '~'), ('p', '\\cite[p.~3]{low}'), ('t', ' metres '), ('p', '--'), ('t', ' see '), ('p', '\\url{http://a.b}'), ('t', '.\n'), ('p', '\\begin{itemize}'), ('p', '\n'), ('p', '\\item'), ('t', ' First '), ('p', '% '), ('t', 'note'), ('p', '\n'), ('p', '\\end{itemize}'), ('p', '\n')]),
    'myst': ('# Tides {#sec}\n\nHigh *water* at `noon`, see [map](m.md) and\nlow water.[^a]\n\n- one $x$\n  two\n\n```python\nx = 1\n```\n', [('p', '# '), ('t', 'Tides'), ('p', ' {#sec}\n'), ('p', '\n'), ('t', 'High '), ('p', '*'), ('t', 'water'), ('p', '*'), ('t', ' at '), ('p', '`noon`'), ('t', ', see '), ('p', '['), ('t', 'map'), ('p', '](m.md)'), ('t', ' and\nlow water.'), ('p', '[^a]'), ('p', '\n'), ('p', '\n'), ('p', '- '), ('t', 'one '), ('m', '$x$'), ('p', '\n'), ('p', '  '), ('t', 'two'), ('p', '\n'), ('p', '\n'), ('p', '```python\nx = 1\n```\n')]),
    'typst': ('= Tides\nHigh *water* at #link("u")[noon] and $x^2$.\n- item @ref\n#set text(lang: "en")\n/* aside */\n', [('p', '= '), ('t', 'Tides\nHigh '), ('p', '*'), ('t', 'water'), ('p', '*'), ('t', ' at '), ('p', '#link("u")['), ('t', 'noon'), ('p', ']'), ('t', ' and '), ('m', '$x^2$'), ('t', '.\n'), ('p', '- '), ('t', 'item '), ('p', '@ref'), ('t', '\n'), ('p', '#set text(lang: "en")'), ('t', '\n'), ('p', '/* '), ('t', 'aside'), ('p', ' */'), ('t', '\n')]),
    'python': ('def f(x):  # low tide\n    return "high" + \'x\'\n', [('p', 'def f(x):  #'), ('t', ' low tide'), ('p', '\n    return "'), ('t', 'high'), ('p', '" + \''), ('t', 'x'), ('p', "'\n")]),
    'java': ('// why\nString s = "one"; /* two */ int n = 3;\n', [('p', '//'), ('t', ' why'), ('p', '\nString s = "'), ('t', 'one'), ('p', '"; /*'), ('t', ' two '), ('p', '*/ int n = 3;\n')]),
}


@pytest.mark.parametrize("kind", EXPECTED)
def test_segments_of_fixed_documents(kind):
    """Kind, content and order of every segment."""
    source, expected = EXPECTED[kind]
    assert [(k[0], c) for k, c in segment(source, kind)] == expected


def test_chunks_of_fixed_documents():
    parts = lambda text, kind: [c["content"] for c in chunk(text, kind)]
    assert parts("Intro.\n\n= One\n\nText one.\n\n#let a = 1\n\n= Two\n\n```py\ny = 2\n```\n", "typst") == ["Intro.\n\n", "= One\n\nText one.\n\n#let a = 1\n\n", "= Two\n\n```py\ny = 2\n```\n"]
    assert parts("---\nt: 1\n---\n\nLead.\n\n# One\n\n- a\n\n  b\n\n:::{note}\n# no heading\n:::\n\n## Two\n", "myst") == ["---\nt: 1\n---\n\nLead.\n\n", "# One\n\n- a\n\n  b\n\n:::{note}\n# no heading\n:::\n\n", "## Two\n"]
    assert parts("Before.\n\\section{A}\nOne \\textbf{bold}\n\n\nTwo.\n\\begin{proof}\nP.\n\n\\end{proof}\nAfter.", "latex") == ["Before.", "\\section{A}", "One \\textbf{bold}", "Two.", "\\begin{proof}\nP.\n\n\\end{proof}", "After."]

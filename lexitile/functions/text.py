"""Text functions as Column expressions: prompts, replies, metadata blocks, slices, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitile.functions.keys import SPACE

#: Marks in prompt templates and around metadata blocks.
TOKENS = {"content_type": "[CONTENT_TYPE]", "old_src": "[OLD_SRC]", "old_tgt": "[OLD_TGT]", "source": "[SOURCE_LANGUAGE]", "target": "[TARGET_LANGUAGE]", "vocabulary": "[CUSTOM_VOCABULARY]", "src": "[SRC]"}
BLOCKS = {
    "latex": ("% --- CHUNK_METADATA_START ---\n", "% --- CHUNK_METADATA_END ---\n", "% "),
    "myst": ("\n<!-- --- CHUNK_METADATA_START ---\n", "--- CHUNK_METADATA_END --- -->\n", "% "),
    "typst": ("// --- CHUNK_METADATA_START ---\n", "// --- CHUNK_METADATA_END ---\n", "// "),
}

PLAIN_PROMPT = "Translate this [CONTENT_TYPE] from [SOURCE_LANGUAGE] into [TARGET_LANGUAGE]. Keep all markup. Terms:\n[CUSTOM_VOCABULARY]"
UNIT_PROMPT = "Translate the text of this [CONTENT_TYPE] unit into [TARGET_LANGUAGE] and return it in <output> tags. Keep every <PH> element.\n[CUSTOM_VOCABULARY]\n[SRC]"
EXAMPLE_PROMPT = "A similar text [OLD_SRC] was translated as [OLD_TGT].\n" + UNIT_PROMPT


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def fill(template: Column, **values: Column) -> Column:
    """Replaces the given tokens in the order given; what a value brings in is replaced by later ones too."""
    for name, v in values.items():
        template = F.replace(template, F.lit(TOKENS[name]), F.coalesce(v, F.lit("")))
    return template


def plain_prompt(prompt: Column, document: Column) -> Column:
    return F.concat(prompt, F.lit("\n<document>\n"), document, F.lit("\n</document>"))


def reply_text(reply: Column) -> Column:
    """The bodies of all <output> elements without one leading line end each, an unclosed one to the end; else all <document> elements with their tags; else ''."""
    bodies = F.array_join(F.regexp_extract_all(reply, F.lit(r"(?s)<output>\n?(.*?)(?:</output>|\z)"), F.lit(1)), "")
    documents = F.array_join(F.regexp_extract_all(reply, F.lit(r"(?s)<document>.*?</document>"), F.lit(0)), "")
    return F.when(reply.contains("<output>"), bodies).otherwise(documents)


def between_tags(c: Column, start: str, end: str) -> Column:
    """From the first start to the first end after it, stripped; without an end the rest as it is; without a start ''."""
    a = F.locate(start, c)
    rest = F.substr(c, a + len(start))
    z = F.locate(end, rest)
    return F.when(a == 0, "").when(z == 0, rest).otherwise(py_strip(F.substr(rest, F.lit(1), z - 1)))


def prefix_lines(c: Column, prefix: str) -> Column:
    """The prefix before each line that is not blank."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(rf"\A{SPACE}*\z"), x).otherwise(F.concat(F.lit(prefix), x))), "\n")


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """The text between two UTF-8 byte offsets."""
    return F.decode(F.substr(F.encode(c, "UTF-8"), start + 1, end - start), "UTF-8")


def metadata_block(kind: str, meta: Column) -> Column:
    """Comment block of a metadata map in its order."""
    start, end, mark = BLOCKS[kind]
    lines = F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat(F.lit(mark), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return F.concat(F.lit(start), lines, F.lit(end))


def parse_metadata(kind: str, block: Column) -> Column:
    """Map of the ``key: value`` lines of a block, parted at the first ':'; of equal keys the last counts."""
    mark = BLOCKS[kind][2].strip()
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: py_strip(x)), lambda x: x.startswith(mark) & x.contains(":") & ~x.contains("CHUNK_METADATA"))
    pairs = F.transform(lines, lambda x: F.split(F.regexp_replace(x, "^" + mark + r"\s*", ""), ":", 2))
    entries = F.transform(pairs, lambda p: F.struct(py_strip(p[0]).alias("k"), py_strip(p[1]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def split_cells(kind: str, content: Column) -> Column:
    """``ARRAY<STRUCT<block, source>>`` of a target file; text before the first block is left out, sources are stripped."""
    start, end, _ = (x.strip("\n") for x in BLOCKS[kind])
    q = lambda x: r"\Q" + x + r"\E"
    pattern = rf"(?s){q(start)}(.*?){q(end)}\n?(.*?)(?={q(start)}|\z)"
    blocks, sources = F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    return F.zip_with(blocks, sources, lambda b, s: F.struct(b.alias("block"), py_strip(s).alias("source")))


def compile_cells(kind: str, cells: Column) -> Column:
    """File text of ordered ``STRUCT<meta, source>`` cells; a Typst block starts on a line of its own."""
    joined = F.transform(cells, lambda c: F.concat(metadata_block(kind, c["meta"]), c["source"]))
    if kind != "typst":
        return F.array_join(joined, "")
    return F.aggregate(joined, F.lit(""), lambda acc, x: F.concat(acc, F.when((acc == "") | acc.endswith("\n"), "").otherwise("\n"), x))

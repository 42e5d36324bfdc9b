"""Segmentation: exact partitions, kinds of blocks, masking and sentences."""

import pytest
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.sentences import split
from quireline.operators.assembly import nodes_of, segments_of
from quireline.operators.rendering import render, render_blocks
from quireline.operators.segment_markdown import is_definition, markdown_pieces, segment_markdown
from quireline.operators.segment_text import segment_text

MARKDOWN = {
    "front matter": ("---\ntitle: x\n---\n\nText here\n", ["para"]),
    "heading": ("# One #\n\nSetext\n======\nafter\n", ["heading", "para", "para"]),
    "fence": ("a\n\n```py\n# no\n```\n~~~~\nx\n~~~\n~~~~\nb\n", ["para", "para"]),
    "unclosed fence": ("a\n```\nrest\n# rest\n", ["para"]),
    "list": ("- one\n  more\n- [ ] two\n1. three\n", ["list", "list", "list"]),
    "fence in item": ("- one\n\n  ```\n  code\n  ```\n- two\n", ["list", "list"]),
    "quote": ("> one\n> two\n\n>     code\n", ["quote", "quote"]),
    "table": ("| a | b |\n|---|---|\n| c |  |\n\nend\n", ["cell", "cell", "cell", "para"]),
    "indented code": ("text\n\n    code\n\nmore\n", ["para", "para"]),
    "lazy indent": ("text\n    still text\n", ["para"]),
    "definition": ('[a]: https://x "t"\n[b]: <c d>\n[c] not\n', ["para"]),
    "crlf": ("# A\r\n\r\ntext\r\n", ["heading", "para"]),
    "no final newline": ("a\n\nb", ["para", "para"]),
    "rule": ("a\n\n***\n\nb\n", ["para", "para"]),
    "only code": ("`x`\n", []),
    "blank": (" \n\n", []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", MARKDOWN)
def test_markdown_pieces_partition(name):
    text, _ = MARKDOWN[name]
    assert "".join(t for _, t in markdown_pieces(text)) == text


def test_markdown_kinds_and_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in MARKDOWN.items()], "doc_id string, text string")
    cut = segment_markdown(df).cache()
    for row in cut.collect():
        assert [s.kind for s in row.segments] == MARKDOWN[row.doc_id][1], row.doc_id
        assert [s.id for s in row.segments] == [f"s{k + 1:04d}" for k in range(len(row.segments))]
    segments = segments_of(cut, "doc_id").withColumn("target", F.lit(None).cast("string"))
    back = render(render_blocks(nodes_of(cut, "doc_id"), segments, fallback=True, keys=("doc_id",)), keys=("doc_id",))
    assert {r.doc_id: r.text for r in back.collect()} == {k: t for k, (t, _) in MARKDOWN.items() if t}


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("[a]: /x", True), ("[a]: <b c> 'd'", True), ("[a]: x (t)", True), ("[a\\]b]: x", True), ("[a]: x\"t\"", True), ("[a]: x \"t\" u", False),
        ("[]: x", False), ("[ ]: x", False), ("[a] : x", False), ("[a]:", False), ("[a[b]: x", False), ("[a]: x(", False), ("[a]: <x", False), ("[a]: (x) ", True),
    ],
)
def test_definitions(line, expected):
    assert is_definition(line) is expected


TEXTS = {
    "lines": ("One.\nTwo.\n", "line", ["One.", "Two."]),
    "paragraphs": ("One\nmore.\n\nTwo.", "blank-line", ["One\nmore.", "Two."]),
    "chapter": ("Chapter 1\n\n  Text\n  more\n\n\n", "blank-line", ["Chapter 1", "Text\n  more"]),
    "bom": ("﻿﻿A\n", "line", ["A"]),
    "cr": ("a\r\n\r\nb\r", "blank-line", ["a", "b"]),
    "numbers": ("123\n\n一\n", "blank-line", ["一"]),
    "url": ("https://x.y\nword\n", "line", ["word"]),
    "blank": ("\n \n\t", "line", []),
    "empty": ("", "line", []),
}


def test_text_segments_and_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in TEXTS.items()] + [("null", None)], "doc_id string, text string")
    cut = segment_text(df).cache()
    rows = {r.doc_id: r for r in cut.collect()}
    for name, (text, mode, sources) in TEXTS.items():
        row = rows[name]
        assert row.paragraph_mode == mode, name
        assert [s.source for s in row.segments] == sources, name
        by_id = {s.id: s.source for s in row.segments}
        assert "".join(n.v if n.t == "raw" else by_id[n.seg_id] for n in row.nodes) == text, name
    assert rows["null"].segments == []
    assert rows["chapter"].segments[0].kind == "heading"


def test_indent_mode(spark):
    df = spark.createDataFrame([("  A b\nc\n  D e\nf\n",)], "text string")
    assert [s.source for s in segment_text(df, mode="indent").first().segments] == ["A b\nc", "D e\nf"]


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("Rain fell all day. Nobody minded.", ["Rain fell all day. ", "Nobody minded."]),
        ("Ask Prof. Lindqvist about it. Then call me.", ["Ask Prof. Lindqvist about it. ", "Then call me."]),
        ("Version 2.75 is out. Try it!", ["Version 2.75 is out. ", "Try it!"]),
        ("Plan B. failed at once. We left.", ["Plan B. failed at once. ", "We left."]),
        ("“Go home!” he said. “Now.”", ["“Go home!” he said. ", "“Now.”"]),
        ("「下雨了！」大家都笑了。", ["「下雨了！」", "大家都笑了。"]),
        ("門上寫著「小心！」，沒有人看。", ["門上寫著「小心！」，沒有人看。"]),
        ("燈滅了。_誰在那裡？_", ["燈滅了。", "_誰在那裡？_"]),
        ("Tea is ready.⟦12⟧ Sit down.", ["Tea is ready.⟦12⟧ ", "Sit down."]),
        ("Well… maybe. Fine?  \n", ["Well… maybe. ", "Fine?  \n"]),
        ("", []),
    ],
)
def test_sentences(text, pieces):
    assert split(text) == pieces
    assert "".join(split(text)) == text


def test_masking(spark):
    text = "See [x](http://a/b) and <b>`co``de`</b> &amp; {v} $m$ Go Gopher <br/> </i>"
    row = spark.createDataFrame([(text,)], "t string").select(masking.masked(F.col("t"), ["Go"]).alias("m")).select("m", masking.unmasked(F.col("m.text"), F.col("m.originals")).alias("u"), masking.tag_slots(F.col("m.originals")).alias("s")).first()
    assert row.u == text
    assert "Go" in row.m.originals and "Gopher" in row.m.text
    pairs = {s.pair_id for s in row.s.values() if s.pair_id}
    assert len(pairs) == 1 and sum(s.role == "standalone" for s in row.s.values()) == len(row.s) - 2
    assert masking.term_order(["Helen", "Alice", "Brian", "Alexander", "Zoe", "Zoe"]) == ["Alexander", "Alice", "Brian", "Helen", "Zoe"]


def test_reseat():
    slots = lambda *xs: {str(k): {"original": x} for k, x in enumerate(xs, 1)}
    assert masking.reseat("⟦1⟧ und ⟦2⟧", slots("Go", "Gopher"), slots("Gopher", "Go")) == ("⟦2⟧ und ⟦1⟧", None)
    text, why = masking.reseat("⟦1⟧ ⟦1⟧", slots("Go"), slots("Go"))
    assert text is None and "Go" in why

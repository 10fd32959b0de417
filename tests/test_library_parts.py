"""Hierarchies, file types, lenient answers and section paths."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnspark.functions import text as T
from cairnspark.operators import chunking as K
from cairnspark.operators import governance as G
from cairnspark.operators import lifecycle as C
from cairnspark.sources import loaders as L
from cairnspark.sources import webpages as W


def test_trails_of_any_depth_with_cycles(spark):
    rows = [(f"f{i}", f"f{i - 1}" if i else None) for i in range(101)]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("below", "a"), ("self", "self"), ("orphan", "gone"), (None, "a"), ("f1", "f0")]
    folders = spark.createDataFrame(rows, "id string, parent_id string")
    got = {r["id"]: r["trail"] for r in G.trails(folders).collect()}
    assert got["f100"] == [f"f{i}" for i in range(99, -1, -1)] and got["f0"] == []
    assert got["a"] == ["b", "c"] and got["below"] == ["a", "b", "c"] and got["self"] == [] and got["orphan"] == ["gone"]
    deep = G.ancestors(folders).where("id = 'f100'").agg(F.max("depth")).first()[0]
    assert deep == 100
    below = {(r["root"], r["id"]) for r in G.descendants(folders, spark.createDataFrame([("f98",), ("b",)], "root string")).collect()}
    assert below == {("f98", "f99"), ("f98", "f100"), ("b", "a"), ("b", "c"), ("b", "below")}
    assert G.trails(folders.limit(0)).count() == 0


def test_file_types(spark, tmp_path):
    assert len(L.SUPPORTED) == 16
    with pytest.raises(ValueError, match="unsupported file type: webp"):
        L.load(spark, str(tmp_path), "webp")
    with pytest.raises(NotImplementedError):
        L.load(spark, str(tmp_path), ".PDF")
    names = spark.createDataFrame([("a.FLAC",), ("b.webp",), ("none",)], "name string")
    assert [r[0] for r in names.select(C.reader(F.col("name"))).collect()] == ["audio", None, None]
    with pytest.raises(PySparkException, match="unsupported file type: webp"):
        names.where("name = 'b.webp'").select(C.reader(F.col("name"), strict=True)).collect()


def test_fenced_answers(spark):
    said = ['```json\n{"intent": "Greeting", "rewrite_query": " hi there "}\n``` ok', '{"intent": "chitchat"} {', "no json", "} {", None, '{"intent": "other", "rewrite_query": "' + "x" * 201 + '"}']
    rows = spark.createDataFrame([(s,) for s in said], "a string").select(C.intent(F.col("a")).alias("i"), C.rewrite(F.col("a"), F.lit("q")).alias("r")).collect()
    assert [r["i"] for r in rows] == ["greeting", "chitchat", "kb_search", "kb_search", "kb_search", "kb_search"]
    assert [r["r"] for r in rows] == ["hi there", "q", "q", "q", "q", "q"]


@pytest.mark.parametrize(
    "content, kind",
    [("12 words that follow", "text"), ("1. First", "title"), ("1.1 First", "title"), ("1.1.1 First", "title"), ("第三章 总则", "title"), ("（一）范围", "title"), ("2）步骤", "title"), ("text\n# Later", "text"), ("# Now\ntext", "title"), ("##### deep", "text"), ("a\tb\tc", "table"), ("  ", "text")],
)
def test_element_types(spark, content, kind):
    assert spark.createDataFrame([(content,)], "c string").select(T.element_type(F.col("c"))).first()[0] == kind


def test_section_paths(spark):
    parents = ["# One\n\nfirst words here", "1.1 Deep\n\nsecond words here\n\n## Two\n\nthird words here", "第二章 后\n\nlast words here\n\n1. " + "x" * 60]
    children = [(0, "first words here"), (1, "second words here"), (1, "third words here"), (2, "last words here"), (2, "not in the text"), (2, " ")]
    rows = [(7, p, i, parents[p], c) for i, (p, c) in enumerate(children)]
    rows += [(8, i, i, f"# H{i}\n\nrow {i}", f"row {i}") for i in range(120)] + [(9, 0, 0, None, None)]
    got = {(r["doc_id"], r["child_index"]): r["section_path"] for r in K.section_paths(spark.createDataFrame(rows, "doc_id long, parent_index int, child_index int, parent string, child string")).collect()}
    assert [got[7, i] for i in range(6)] == [["# One"], ["# One", "1.1 Deep"], ["# One", "## Two"], ["第二章 后"], [], []]
    assert got[8, 5] == [] and got[9, 0] == []


def test_main_text(spark):
    long = "This paragraph has more than enough words of its own to stay in the text."
    html = (
        "<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Home</a></li><li><a href='/y'>All our many other pages and sections of this site</a></li></ul></nav>"
        f"<!-- note --><script>var s = '<p>{long}</p>';</script><div class=ad>Buy now</div><article><h1>Head &lt;line&gt;</h1><p>{long}<p>Short one.</p><h2>Second</h2><ul><li>{long}</li></ul></article>"
        "<footer><p>All rights</p></footer></body></html>"
    )
    rows = [(1, "https://h.example/p?q", html), (2, "nowhere", None), (3, None, "<p>tiny</p>")]
    got = {r["page_id"]: r for r in W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["title"] == "A & B" and got[1]["body"] == f"# Head <line>\n\n{long}\n\nShort one.\n\n## Second\n\n- {long}"
    assert got[1]["markdown"].startswith("# A & B\n\n> 来源：h.example\n> 原文链接：https://h.example/p?q\n\n# Head")
    assert got[2]["body"] == got[3]["body"] == ""

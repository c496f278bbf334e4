import json

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.operators import index as ix
from tesserae.plans import search as sp
from tesserae.sources import documents, html


def doc(i, title, body, kind="doc", category="engineering", level=2):
    text = f"{title} {body}"
    n = len(title)
    bounds = [{"docId": i, "start": 0, "end": n, "fieldType": "title", "sectionId": None, "headingLevel": 0}, {"docId": i, "start": n + 1, "end": len(text) + 7, "fieldType": "content", "sectionId": "intro"}]
    if level is not None:
        bounds[1]["headingLevel"] = level
    return {"id": i, "slug": f"s{i}", "title": title, "excerpt": body[:9], "href": f"/docs/{i}", "type": kind, "category": category, "text": text, "fieldBoundaries": bounds}


DOCS = [doc(7, "Rust Basics", "learn the language of systems"), doc(3, "Assembly Guide", "portable code, and rust too"), doc(5, "Mountain Trip", "a hike with rusty boots", "post", "adventures", None)]


def write(folder, docs=DOCS, manifest=None):
    folder.mkdir(exist_ok=True)
    for d in docs:
        (folder / f"{d['id']}.json").write_text(json.dumps(d, indent=1))
    (folder / "manifest.json").write_text(json.dumps(manifest or {"version": 1, "documents": [f"{d['id']}.json" for d in docs], "indexes": {"all": {"include": "*"}}}))
    return str(folder)


def test_documents_by_manifest(spark, tmp_path):
    folder = write(tmp_path / "ok")
    assert documents.read_manifest(spark, folder)["indexes"]["all"]["include"] == "*"
    docs = documents.load_documents(spark, folder)
    assert [r["id"] for r in docs.collect()] == [3, 5, 7]
    corpus = documents.as_corpus(docs)
    row = corpus.where("doc_id = 5").first()
    assert row["tags"] == [] and row["author"] is None and row["boundaries"][1]["headingLevel"] == 0
    again = ix.renumber(corpus.drop("doc_id"))
    assert [(r["src_id"], r["doc_id"]) for r in again.orderBy("doc_id").collect()] == [(3, 0), (5, 1), (7, 2)]
    found = sp.Engine(ix.Index.build(corpus)).search("rust").orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [7, 5, 3] and [r["tier"] for r in found] == [1, 2, 1]


def test_loads_that_must_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.read_manifest(spark, str(tmp_path / "none"))
    folder = write(tmp_path / "missing", manifest={"version": 1, "documents": ["7.json", "no.json"]})
    with pytest.raises(FileNotFoundError):
        documents.load_documents(spark, folder)
    folder = write(tmp_path / "incomplete", [*DOCS, {"id": 9, "slug": "s"}])
    with pytest.raises(ValueError):
        documents.load_documents(spark, folder)
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "manifest.json").write_text("{not json")
    with pytest.raises(ValueError):
        documents.read_manifest(spark, str(folder))
    folder = write(tmp_path / "bad")
    (tmp_path / "bad" / "7.json").write_text("{oops")
    with pytest.raises(ValueError):
        documents.load_documents(spark, folder).collect()


def test_named_indexes(spark, tmp_path):
    corpus = documents.as_corpus(documents.load_documents(spark, write(tmp_path / "d")))
    built = ix.build_indexes(corpus, {"engineering": {"include": {"category": "engineering"}}, "all": {"include": "*", "fields": ["title"]}}, str(tmp_path / "out"))
    assert {n: i.docs.count() for n, i in built.items()} == {"engineering": 2, "all": 3}


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "i")
    cli.main(["index", write(tmp_path / "d"), out], spark)
    cli.main(["inspect", out], spark)
    cli.main(["search", out, "rust", "--limit", "2"], spark)
    printed = capsys.readouterr().out
    assert "3 documents" in printed and "postings" in printed and "Rust Basics" in printed and "exact" in printed


PAGE = """<html><head><title>Site page - Brand</title></head><body><nav><a href="/x/b.html">b</a></nav>
<h1>Main &amp; first</h1><p>Intro words here that are long enough to be kept by the reader of pages.</p>
<h2 id="own-id">Second</h2><p>More of it, with <b>bold</b> text.</p><h3>Third part!</h3><script>var x = 1;</script><p>Last words.</p>
<a href="c.html#frag">c</a><a href="https://other.org/z.html">z</a><footer>foot</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "https://a.org/docs/a.html", PAGE), (2, "https://a.org/docs/copy.html", PAGE), (3, "https://a.org/x/b.html", "<p>short</p>"), (4, "https://a.org/n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = pages.where("page_id = 1")
    assert one.select(html.page_title(F.col("html"))).first()[0] == "Main & first"
    assert spark.range(1).select(html.page_title(F.lit("<title>A thing | Brand</title>")), html.page_title(F.lit("x"))).first()[:] == ("A thing", "Untitled")
    sections = [tuple(r) for r in html.page_sections(one).orderBy("seq").select("level", "section_id", "heading").collect()]
    assert sections == [(1, "main-first", "Main & first"), (2, "own-id", "Second"), (3, "third-part", "Third part!")]
    assert {r["href"] for r in html.page_links(one).collect()} == {"/x/b.html", "c.html", "https://other.org/z.html"}
    assert {r["target"] for r in html.absolute_links(one).collect()} == {"https://a.org/x/b.html", "https://a.org/docs/c.html"}
    assert {r["target"] for r in html.frontier(pages).collect()} == {"https://a.org/docs/c.html"}
    corpus = html.page_corpus(pages).collect()
    assert [r["doc_id"] for r in corpus] == [1] and corpus[0]["category"] == "docs"
    raw = corpus[0]["text"].encode()
    parts = [(b["fieldType"], b["headingLevel"], b["sectionId"], raw[b["start"] : b["end"]].decode()) for b in corpus[0]["boundaries"]]
    assert parts[0] == ("title", 0, None, "Main & first") and parts[3] == ("heading", 2, "own-id", "Second") and parts[4][:3] == ("content", 5, "own-id") and "var x" not in raw.decode()
    assert html.page_corpus(pages, skip=("docs",)).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "user", "héllo"), (1, 0, "user", "first"), (2, 0, "bot", None), (1, 2, "bot", "")]
    got = documents.conversation_corpus(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0]["text"] == "first\nhéllo\n"
    raw = got[0]["text"].encode()
    assert [(raw[b["start"] : b["end"]].decode(), b["sectionId"]) for b in got[0]["boundaries"]] == [("first", "turn-0"), ("héllo", "turn-1"), ("", "turn-2")]

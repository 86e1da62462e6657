import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import scalars, vectors
from folioscan.operators import context, indexer, prompts, search, store
from folioscan.operators.store import Store
from folioscan.schema import IndexConfig
from folioscan.sources import files
from folioscan.streaming.incremental import index_stream


def chunk_rows(spark, n=25, doc=1, chars=300):
    return spark.createDataFrame([(doc, k, f"{k:02d}" + "x" * (chars - 2), k // 5 + 1) for k in range(n)], "document_id long, chunk_index int, text string, page int")


def indexes(df):
    return sorted(r.chunk_index for r in df.collect())


@pytest.mark.parametrize(("center", "size", "expected"), [(12, 10, range(2, 23)), (3, 10, range(14)), (22, 10, range(12, 25)), (10, 0, [10])])
def test_window(spark, center, size, expected):
    hits = spark.createDataFrame([(1, center)], "document_id long, center int")
    assert indexes(context.window(chunk_rows(spark), hits, size)) == list(expected)


@pytest.mark.parametrize(("page", "chars", "expected"), [(3, 100, range(10, 15)), (1, 2000, [0, 1, 2, 3, 4, 5, 6]), (9, 1000, []), (6, 1000, range(20, 24)), (3, 10**6, range(25))])
def test_by_page(spark, page, chars, expected):
    """Pages 1 to 5 with 5 chunks of 300 characters. Page 6 has none, so its first ring, page 5, comes next."""
    hits = spark.createDataFrame([(1, page)], "document_id long, center_page int")
    assert indexes(context.by_page(chunk_rows(spark), hits, chars)) == list(expected)


def test_by_page_unknown_document(spark):
    assert context.by_page(chunk_rows(spark), spark.createDataFrame([(7, 1)], "document_id long, center_page int")).count() == 0


def test_page_or_window(spark):
    rows = chunk_rows(spark).unionByName(chunk_rows(spark, doc=2).withColumn("page", F.lit(None).cast("int")))
    hits = spark.createDataFrame([(1, 12), (2, 12)], "document_id long, center int")
    got = context.page_or_window(rows, hits, max_chars=100, size=2)
    assert indexes(got.filter("document_id = 1")) == list(range(10, 15)) and indexes(got.filter("document_id = 2")) == list(range(10, 15))


def test_hybrid(spark):
    rows = chunk_rows(spark, 20).unionByName(chunk_rows(spark, 25, 2))
    hits = spark.createDataFrame([(1, 1, "/a", 3), (2, 2, "/b", 12), (3, 2, "/b", 13)], "hit_rank int, document_id long, path string, center int")
    got = context.hybrid(rows, hits)
    assert indexes(got.filter("document_id = 1")) == list(range(20)) and indexes(got.filter("document_id = 2")) == list(range(2, 24))


def test_budget_and_assembly(spark):
    got = context.budget(chunk_rows(spark), ["document_id"], 1000).orderBy("chunk_index").collect()
    assert len(got) == 3 or (len(got) == 4 and got[3].text.endswith(" [...]"))
    assert context.budget(chunk_rows(spark), ["document_id"], 750).orderBy(F.desc("chunk_index")).first().text == ("02" + "x" * 298)[:150] + " [...]"
    hits = spark.createDataFrame([(1, 1, "/a", 0, "t" * 50), (1, 1, "/a", 1, "u" * 300), (2, 2, "/b", 0, "v")], "hit_rank int, document_id long, path string, chunk_index int, text string")
    text = context.assembled(hits, max_chars=280).first().context
    assert text == "--- Document: /a ---\n\n" + "t" * 50 + "\n\n" + "u" * 210 + " [...]\n\n--- Document: /b ---\n\nv"
    assert context.assembled(hits, max_chars=60).first().context == "--- Document: /a ---\n\n--- Document: /b ---\n\nv"


def test_prompts(spark):
    row = spark.range(1).select(prompts.messages(F.lit("C"), "Q?").alias("messages"))
    m = row.first().messages
    assert [x.role for x in m] == ["system", "user"] and m[1].content.endswith(prompts.CLOSING)
    assert prompts.answers(row, lambda m: m[1]["content"][:10]).first().answer == "Context:\nC"


def vector_rows(spark):
    data = [(1, "/tmp/a_b/x.txt", [1.0, 0.0]), (2, "/TMP/a_b", [0.5, 0.5]), (3, "/tmp/aXb/y.txt", [0.0, 1.0]), (4, "\\tmp\\a_b\\z.txt", [1.0, 0.0])]
    return spark.createDataFrame([(i, 0, p, p, v) for i, p, v in data], "document_id long, chunk_index int, path string, text string, embedding array<float>")


def test_search(spark):
    rows = vector_rows(spark)
    ids = lambda df: [r.document_id for r in df.collect()]
    assert ids(search.top_k(rows, [1.0, 0.0], 10)) == [1, 4, 2, 3]
    assert ids(search.top_k(rows, [1.0, 0.0], 2)) == [1, 4]
    assert ids(search.top_k(rows, [1.0, 0.0], 10, ["/tmp/a_b/"])) == [1, 4]
    assert ids(search.top_k(rows, [1.0, 0.0], 10, [])) == [] == ids(search.top_k(rows, [1.0, 0.0], 10, [" "]))
    assert ids(rows.filter(search.in_folders(F.col("path"), ["/tmp/a_b"], compat=True)).orderBy("document_id")) == [1, 3, 4]
    with pytest.raises(ValueError, match="at least 1"):
        search.top_k(rows, [1.0, 0.0], 0)
    assert search.candidates(5) == 30 and search.candidates(20) == 60


def test_rerank(spark):
    rows = vector_rows(spark).withColumn("score", F.lit(1.0))
    logit = lambda t: F.when(t.contains("aXb"), 0.9).when(t.contains("x.txt"), 0.3).otherwise(0.6)
    got = search.reranked(rows, logit, 2).collect()
    assert [r.document_id for r in got] == [3, 2] and abs(got[0].score - 0.710949) < 1e-6 and got[0].embedding_score == 1.0


def test_store_algebra(spark):
    old = spark.createDataFrame([("\\a\\x", "h1"), ("/a/y", "h2")], "path string, sha256 string")
    new = spark.createDataFrame([("/a/x", "h1"), ("/a/y", "h3"), ("/a/z", "h4")], "path string, sha256 string")
    got = {r.path: r.status for r in store.statuses(old, new).collect()}
    assert got == {"/a/x": "skipped", "/a/y": "updated", "/a/z": "inserted"}
    assert sorted(tuple(r) for r in store.upserted(old, new).collect()) == [("/a/y", "h3"), ("/a/z", "h4"), ("\\a\\x", "h1")]


def docx(lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_readers():
    assert files.read_text(b"a\r\nb\rc\xff") == [(1, "a\nb\nc\ufffd")]
    assert files.read_markdown(b"# Intro\n**bold** [l](u)\n## Two\n`code`\n### Three\nx") == [(1, "Intro\nbold l\n"), (2, "Two\n"), (3, "Three\nx\n")]
    assert [p for p, _ in files.read_docx(docx([f"p{k}" for k in range(25)] + [" "]))] == [1, 2, 3]


def test_markdown_columns(spark):
    text = "# Intro\n**bold** [l](u)\n## Two\n`code`\n### Three\nx"
    got = spark.createDataFrame([(text,)], "t string").select(scalars.markdown_sections(F.col("t"))).first()[0]
    assert [(x.page, x.text) for x in got] == files.read_markdown(text.encode())


def test_blobs_and_sql_functions(spark):
    rows = spark.createDataFrame([([1.0, -2.5],)], "v array<float>")
    assert list(rows.select(vectors.from_blob(vectors.to_blob(F.col("v")))).first()[0]) == [1.0, -2.5]
    scalars.register_sql_functions(spark)
    assert spark.sql("SELECT sigmoid(0), normalize_folder('C:\\\\x\\\\'), dot(array(1D, 2D), array(3D, 4D))").first()[:] == (0.5, "C:/x", 11.0)


def test_index_and_stream(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a.txt").write_text("First text. It has words.")
    (folder / "b.MD").write_text("# Title\nBody")
    (folder / "empty.txt").write_text(" ")
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "other.bin").write_bytes(b"x")
    st, config = Store(spark, f"file://{tmp_path}/store"), IndexConfig(root=str(tmp_path))
    status = lambda: {r.path.rsplit("/", 1)[-1]: r.status for r in indexer.index(st, files.list_documents(spark, [str(folder), "/nowhere"]), config).collect()}
    assert status() == {"a.txt": "inserted", "b.MD": "inserted", "empty.txt": "skipped", "bad.docx": "failed"}
    assert st.documents().count() == 2 and st.chunks().filter("size(embedding) = 64").count() == 2
    (folder / "a.txt").write_text("Another text. It has words.")
    assert status() == {"a.txt": "updated", "b.MD": "skipped", "empty.txt": "skipped", "bad.docx": "failed"}
    assert sorted(r.text for r in st.chunks().collect())[0].startswith("Another")
    gone = st.documents().filter("path like '%a.txt'").first()
    assert st.delete(path=gone.path.replace("/", "\\")) and not st.delete(document_id=gone.id)
    assert st.prune(spark.createDataFrame([("x",)], "path string")) == 1 and st.chunks().count() == 0
    stream = Store(spark, f"file://{tmp_path}/streamed")
    for _ in range(2):
        index_stream(stream, str(folder), f"{tmp_path}/check", config).awaitTermination()
    assert stream.documents().count() == 2


def store_rows(spark, *rows):
    """documents and chunks of (path, text)"""
    docs = spark.createDataFrame([(p, "t", t, 1.0, len(t)) for p, t in rows], "path string, title string, sha256 string, mtime double, size long")
    chunks = spark.createDataFrame([(p, 0, t, "{}", 1, [1.0]) for p, t in rows], "path string, chunk_index int, text string, metadata string, page int, embedding array<float>")
    return docs, chunks


def test_store_buckets_and_conflicts(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store", buckets=4)
    st.upsert(*store_rows(spark, *((f"/d/{k}", f"text {k}") for k in range(20))))
    before = st._state()[1]
    assert st.chunks().count() == 20 and set(before["documents"]) <= set("0123")
    assert {r.status for r in st.upsert(*store_rows(spark, ("\\d\\3", "text 3"))).collect()} == {"skipped"} and st.version() == before["version"]
    created = st.documents().filter("path = '/d/3'").first().created_at
    assert st.upsert(*store_rows(spark, ("\\d\\3", "new"))).first().status == "updated"
    after, row = st._state()[1], st.documents().filter("sha256 = 'new'").first()
    assert sum(before["documents"][k] != after["documents"][k] for k in before["documents"]) == 1  # the others' folders are named again
    assert row.created_at == created and row.updated_at > created and st.documents().count() == st.chunks().count() == 20
    # Another writer commits between this one's reading and its commit.
    other, state, calls = Store(spark, f"file://{tmp_path}/store"), st._state, []

    def late():
        found = state()
        if not calls:
            calls.append(other.upsert(*store_rows(spark, ("/d/other", "x"))).first().status)
        return found

    st._state = late
    assert st.upsert(*store_rows(spark, ("/d/mine", "y"))).first().status == "inserted" and calls == ["inserted"]
    st._state = state
    assert {"/d/other", "/d/mine"} <= {r.path for r in st.documents().collect()} and st.chunks().count() == 22
    # A writer that ended before its commit was complete leaves a number that readers pass over.
    open(f"{tmp_path}/store/_commits/{int(st.version()) + 1:010d}", "w").close()
    assert st.documents().count() == 22 and st.delete(path="/d/mine") and st.documents().count() == st.chunks().count() == 21


def test_store_keeps_the_last_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "KEPT", 2)
    st = Store(spark, f"file://{tmp_path}/store", buckets=1)
    for k in range(4):
        st.upsert(*store_rows(spark, ("/a", f"text {k}")))
    assert len(list((tmp_path / "store" / "data").iterdir())) == 2 and [r.text for r in st.chunks().collect()] == ["text 3"]


def test_store_takes_the_latest_of_a_path(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store")
    docs, chunks = store_rows(spark, ("a/b", "one"), ("a\\b", "two"))
    docs = docs.withColumn("mtime", F.when(F.col("sha256") == "two", 2.0).otherwise(1.0))
    assert [tuple(r) for r in st.upsert(docs, chunks).collect()] == [("a\\b", "inserted")]
    assert [r.text for r in st.chunks().collect()] == ["two"] and st.documents().count() == 1
    got = sorted((r.sha256, r.status) for r in store.statuses(docs.limit(0), docs.unionByName(docs)).collect())
    assert got == [("one", "inserted"), ("one", "skipped"), ("two", "skipped"), ("two", "updated")]
    with pytest.raises(Exception, match="no embedding"):
        st.upsert(docs.withColumn("sha256", F.lit("four")), chunks.withColumn("embedding", F.lit(None).cast("array<float>")))
    with pytest.raises(Exception, match="no embedding"):
        st.upsert(docs.withColumn("sha256", F.lit("three")), chunks, dimension=2)


def test_listing(spark, tmp_path):
    odd = tmp_path / "a[1]{x}*"
    odd.mkdir()
    for name in ("one.TXT", "two.md", "three.bin", "noext"):
        (odd / name).write_text("x")
    names = lambda *p, **k: sorted(r.path for r in files.list_documents(spark, list(p), **k).collect())
    expected = [f"{odd}/one.TXT", f"{odd}/two.md"]
    assert names(str(odd)) == names(str(odd), str(odd) + "/", str(tmp_path), str(odd / "two.md")) == expected == names(str(tmp_path), hidden=True)
    assert names(str(odd / "two.md")) == expected[1:] and names() == names("/nowhere") == []
    gone = spark.createDataFrame([(expected[0],)], "path string")
    assert names(str(odd), exclude=gone) == expected[1:]


def test_batch_search(spark):
    """Blocks of queries against plain products, with ties and rows without a vector."""
    rng = np.random.default_rng(3)
    rows = [(k, k % 3, [float(x) for x in rng.integers(-2, 3, 5)]) for k in range(300)] + [(900, 0, None)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(k, v) for k, _, v in rows if k % 7 == 0 and v], "query_id long, query array<float>")
    expected = {}
    for q, _, v in rows:
        if q % 7 == 0 and v:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, c) for i, c, w in rows if w)[:4]
            expected[q] = [(i, c, -s) for s, i, c in best]
    for size in (512, 5):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(search, "QUERY_BLOCK", size)
            got = search.top_k_each(chunks, queries, 4).orderBy("query_id", "rank").collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r.document_id, r.chunk_index, r.score))
        assert found == expected
    assert search.top_k_each(chunks, queries.limit(0), 4).count() == 0


def test_ask(spark):
    from folioscan.operators.answers import NOTHING, ask

    rows = vector_rows(spark).withColumn("text", F.concat(F.lit("About "), "path"))
    got = ask(rows, "Why?", [1.0, 0.0], lambda m: m[1]["content"][-60:], k=2).collect()
    assert len(got) == 1 and got[0].answer.endswith(prompts.CLOSING) and [s.path for s in got[0].sources] == ["/tmp/a_b/x.txt", "\\tmp\\a_b\\z.txt"]
    assert got[0].context.startswith("--- Document: /tmp/a_b/x.txt ---\n\nAbout")
    none = ask(rows.limit(0), "Why?", [1.0, 0.0], lambda m: "x").collect()
    assert [(r.answer, r.sources) for r in none] == [(NOTHING, [])]


def test_cli(spark, tmp_path, capsys):
    from folioscan.cli import PathError, allowed_folders, main

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("Alpha beta gamma.")
    (folder / "b.txt").write_text("Delta epsilon zeta.")
    (folder / ".hidden.txt").write_text("Hidden words.")
    run = lambda *a: (main(["--root", f"file://{tmp_path}/index", *a], spark), capsys.readouterr().out)[1]
    assert run("index", str(folder)).startswith("inserted=2 updated=0")
    assert "a.txt" in run("search", "alpha beta", "--top-k", "100").split("\n")[0]
    (folder / "b.txt").unlink()
    assert "b.txt" in run("search", "delta", "--folder", str(folder)) and run("search", "delta", "--folder", f"{folder}x") == "No matches found.\n"
    assert "b.txt" in run("search", "delta", "--folder", f"file://{folder}/") and "b.txt" in run("search", " delta ", "--folder", " ")
    found = json.loads(run("search", "alpha beta", "--json"))["results"]
    assert [r["title"] for r in found][0] == "a" and found[0]["metadata"]["page"] == 1 and found[0]["path"] == f"{folder}/a.txt"
    assert json.loads(run("scan", str(folder), str(folder))) == {"file_count": 1, "total_size_bytes": 17, "large_files": [], "by_type": {".txt": 1}}
    listed = [json.loads(x) for x in run("list").splitlines()]
    assert len(listed) == 2 and all(r["chunk_count"] == 1 and r["updated_at"] for r in listed)
    assert run("index", str(folder), "--within", str(tmp_path)).startswith("inserted=0 updated=0 skipped=1")
    assert "Removed 1 " in run("prune") and "'document_count': 1" in run("stats")
    assert files.list_documents(spark, [str(folder)], hidden=True).count() == 2
    assert allowed_folders([f" {folder}\n", " "], str(tmp_path)) == [str(folder.resolve())]
    for bad in ("a\0b", "/", str(folder / "a.txt")):
        with pytest.raises(PathError):
            allowed_folders([bad], str(tmp_path))

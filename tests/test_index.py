"""State of streams, deletion vectors, ranges of paths and inverted lists, beside what test_catalogue compares with SQL."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import cells, lexical, search
from folioscan.operators.store import Store
from folioscan.schema import SCHEMA_NUMBER
from folioscan.sources import files, tables
from folioscan.streaming import changes
from tests.test_operators import store_rows


def data_files(root):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, fs in os.walk(root / "data") for f in fs if f.endswith(".parquet") and "/gone-" not in at}


def test_stream_keeps_its_state(spark, tmp_path):
    """Rows of a path in one batch follow each other; a restart knows what came before; slashes don't matter; nulls are statuses too."""
    schema = "path string, sha256 string, mtime double"
    known = spark.createDataFrame([("C:\\x", "a"), ("old", None)], "path string, sha256 string")
    batches = [
        ([("C:/x", "a", 1.0), ("y", "b", 2.0), ("y", "c", 3.0), ("y", "c", 4.0), ("old", "d", None), ("z", None, 1.0)], ["inserted", "inserted", "inserted", "skipped", "skipped", "updated"]),
        ([("C:\\x", "b", 5.0), ("y", "c", 5.0), ("z", "e", 5.0)], ["inserted", "skipped", "updated"]),
        ([("C:/x", "b", 6.0), ("y", "b", 6.0), ("old", "d", 6.0)], ["skipped", "skipped", "updated"]),
    ]
    progress, seen = changes.Progress(), 0
    spark.streams.addListener(progress)
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
    for k, (made, want) in enumerate(batches):
        spark.createDataFrame(made, schema).write.mode("append").parquet(f"{tmp_path}/in")
        changes.detect(rows, f"{tmp_path}/out", f"{tmp_path}/check", known).awaitTermination()
        out = spark.read.schema(changes.OUT).parquet(f"{tmp_path}/out")
        got = [r.status for r in out.collect()]
        assert len(got) == seen + len(made)
        new = [r.status for r in out.join(spark.createDataFrame(made, schema).select("path", "mtime").distinct(), ["path"], "left_semi").filter((F.col("mtime") >= (5.0 if k == 1 else 6.0 if k == 2 else 0)) | ((k == 0) & F.col("mtime").isNull())).collect()]
        assert sorted(new) == sorted(want)
        seen = len(got)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(progress)
    counts = dict(out.groupBy("status").count().collect())
    assert progress.counts == {**counts, "processed": seen}
    # Nothing new: nothing written.
    changes.detect(rows, f"{tmp_path}/out", f"{tmp_path}/check", known).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == seen


def test_stream_state_is_asked_by_groups(spark, tmp_path, monkeypatch):
    """State has one value a group of paths, not one a path, and each path is still compared with its own last hash."""
    monkeypatch.setattr(changes, "GROUPS", 8, raising=False)
    schema = "path string, sha256 string, mtime double"
    known = spark.createDataFrame([(f"a\\{k}", "old" if k % 2 else "h") for k in range(0, 100, 4)] + [(f"gone/{k}", "h") for k in range(50)] + [(None, "h")], "path string, sha256 string")
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
    want = []
    for n, hashes in enumerate(("h", "h", "x")):
        made = [(f"a/{k}", hashes if k % 3 == 0 else "h", float(n)) for k in range(100)] + [(None, "h", float(n))]
        want += [(n, p, "skipped" if p is None or n == 1 or n == 2 and h == "h" or n == 0 and int(p[2:]) % 4 == 0 else "updated" if n else "inserted") for p, h, _ in made]
        spark.createDataFrame(made, schema).write.mode("append").parquet(f"{tmp_path}/in")
        query = changes.detect(rows, f"{tmp_path}/out", f"{tmp_path}/check", known)
        query.awaitTermination()
        assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= 8
    got = [(int(r.mtime), r.path, r.status) for r in spark.read.schema(changes.OUT).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_deleting_writes_no_data_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "GONE_SHARE", 0.5)
    st = Store(spark, f"file://{tmp_path}/store", buckets=2)
    st.upsert(*store_rows(spark, *((f"/d/{k:03d}", f"text {k}") for k in range(100))))
    before = data_files(tmp_path / "store")
    assert st.delete(path="\\d\\003") and not st.delete(path="/d/003") and st.delete(document_id=st.documents().filter("path = '/d/004'").head().id)
    assert st.prune(spark.createDataFrame([(f"/d/{k:03d}",) for k in range(100) if k % 7], "path string")) == 15
    assert data_files(tmp_path / "store") == before  # the same files, untouched
    left = {f"/d/{k:03d}" for k in range(100) if k % 7 and k not in (3, 4)}
    assert {r.path for r in st.documents().collect()} == left and {r.text for r in st.chunks().collect()} == {f"text {int(p[3:])}" for p in left}
    # An update adds a file to its bucket and marks the old row.
    assert st.upsert(*store_rows(spark, ("/d/005", "new"), ("/d/003", "back"))).count() == 2
    now = data_files(tmp_path / "store")
    assert before.items() <= now.items() and st.documents().count() == st.chunks().count() == len(left) + 1
    assert {r.text for r in st.chunks().collect()} >= {"new", "back"} and "text 5" not in {r.text for r in st.chunks().collect()}
    # Vectors of very many rows meet the files by shuffle.
    monkeypatch.setattr(Store, "BROADCAST_GONE", 0)
    assert st.documents().count() == len(left) + 1
    # Where most is gone the bucket is written anew, without vectors.
    assert st.prune(spark.createDataFrame([("/d/005",), ("/d/099",)], "path string")) == len(left) - 1
    state = st._state()[1]
    assert state["gone"] == {"documents": {}, "chunks": {}} and sum(state["rows"].values()) == 2
    assert {r.path for r in st.documents().collect()} == {"/d/005", "/d/099"} and {r.text for r in st.chunks().collect()} == {"new", "text 99"}


def test_parts_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "PARTS", 3)
    st = Store(spark, f"file://{tmp_path}/store", buckets=1)
    for k in range(5):
        st.upsert(*store_rows(spark, (f"/{k}", f"text {k}")))
        assert len(st._state()[1]["chunks"]["0"]) <= 3
    assert {r.text for r in st.chunks().collect()} == {f"text {k}" for k in range(5)}


def test_folders_are_ranges(spark, tmp_path):
    """A search below a folder reads the files that can have it, and finds what a full scan finds."""
    paths = [f"{top}/{sub}/f{k}.txt" for top in ("/A", "/b", "/B2", "/c", "C:/x") for sub in ("s", "S%", "ü") for k in range(6)]
    st = Store(spark, f"file://{tmp_path}/store", buckets=16)
    st.upsert(*store_rows(spark, *((p, p) for p in paths)))
    everything = len(st.files())
    for folders in (["/a"], ["/b/"], ["/B/s", "/c\\S%"], ["/b2/ü"], ["/"], ["c:/X"], ["/nowhere"], [], ["/A/s/f1.txt"]):
        want = sorted(r.path for r in st.documents().filter(search.in_folders(F.col("path"), folders)).collect())
        assert sorted(r.path for r in st.documents(folders).collect()) == want == sorted(r.path for r in st.searchable(folders).collect())
    assert len(st.files(["/a"])) < everything / 2 and len(st.files(["/nowhere"])) <= 2 and st.files([]) == []
    assert set(st.files(["/a"])) >= {f for f in st.files() if any("/A/" in r.path for r in spark.read.parquet(f).filter("1 = 1").select(*([F.col("path")] if "/documents/" in f else [F.lit("").alias("path")])).collect())}


def test_older_commits_are_read(spark, tmp_path):
    """One folder a bucket, buckets by hash, no vectors, fewer columns: opens, is changed and reads back."""
    st = Store(spark, f"file://{tmp_path}/store", buckets=4)
    st.upsert(*store_rows(spark, *((f"/d/{k}", f"text {k}") for k in range(20))))
    number = st.version()
    # The same rows as an earlier version wrote them.
    n = F.lit(4)
    place, h = F.pmod(F.xxhash64("path"), n), F.shiftright(F.xxhash64(F.concat_ws("\0", "path", "sha256")), 16)
    ids = st.documents().withColumn("new", h - F.pmod(h, n) + place)
    content = {"version": number, "buckets": 4}
    for name, rows in (("documents", ids.drop("id", "size").withColumnRenamed("new", "id")), ("chunks", st.chunks().join(ids.select(F.col("id").alias("document_id"), "new"), "document_id").drop("document_id", "page").withColumnRenamed("new", "document_id"))):
        key = "id" if name == "documents" else "document_id"
        rows.withColumn("bucket", F.pmod(key, n)).write.partitionBy("bucket").parquet(f"{tmp_path}/store/data/{number}-old/{name}")
        content[name] = {d.name.split("=")[1]: f"data/{number}-old/{name}/{d.name}" for d in (tmp_path / "store" / "data" / f"{number}-old" / name).iterdir() if d.name.startswith("bucket=")}
    (tmp_path / "store" / "_commits" / f".{number}.crc").unlink()
    (tmp_path / "store" / "_commits" / number).write_text(json.dumps(content) + "\n")
    old = Store(spark, f"file://{tmp_path}/store")
    assert old.documents().filter("size IS NULL").count() == 20 == old.chunks().filter("page IS NULL").count()
    assert {r.path: r.status for r in old.upsert(*store_rows(spark, ("/d/1", "text 1"), ("/d/2", "new"), ("/e", "more"))).collect()} == {"/d/1": "skipped", "/d/2": "updated", "/e": "inserted"}
    assert old.delete(path="/d/3") and old.documents().count() == old.chunks().count() == 20 and old.documents(["/d"]).count() == 19


@pytest.mark.parametrize("probes", [1, 4])
def test_inverted_lists(spark, tmp_path, monkeypatch, probes):
    """Clusters, copies that tie, lists over several matrices: the same as comparing everything, with part of it read."""
    monkeypatch.setattr(cells, "LIST_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 4
    made = [(k, 0, (centres[k % 20] + rng.normal(size=16) * 0.2).astype("float32").tolist()) for k in range(800)]
    made += [(1000 + k, k % 3, made[3][2]) for k in range(300)] + [(5000, 0, None)]
    chunks = spark.createDataFrame(made, "document_id long, chunk_index int, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(q, made[q * 7][2]) for q in range(40)] + [(99, None), (100, [0.0] * 16)], "query_id long, query array<float>")
    index = cells.inverted_lists(chunks, f"{tmp_path}/lists-{probes}", cells=25)
    best, read = cells.top_k_each(index, queries, 6, probes)
    rows = lambda df: sorted((r.query_id, r["rank"], r.document_id, r.chunk_index, round(r.score, 9)) for r in df.collect())
    assert rows(best) == rows(search.top_k_each(chunks, queries, 6))
    sizes = dict(index.lists.groupBy("cell").agg(F.sum("n")).collect())
    assert sum(sizes.values()) == 1100
    touched = sum(sizes[r.cell] for r in read.filter("query_id < 99").collect()) / (40 * 1100)
    assert touched < 0.35 and read.distinct().count() == read.count()


def test_readers_in_sql(spark):
    """Files of all kinds, one that can't be read, null contents; sizes by default."""
    rows = [(1, "a/b.TXT", b"One sentence here. Another one follows it."), (2, "c\\d.md", "# T\nBody é\n## U\n**x**".encode()), (3, "bad.docx", b"no zip"), (4, "x.txt", None), (5, "y.bin", b"z"), (6, None, b"z"), (7, "e.txt", b" ")]
    tables.register(spark)
    contents = spark.createDataFrame(rows, "k int, path string, content binary")
    pages = spark.sql("SELECT k, page, p.text, error IS NOT NULL AS bad FROM {f}, LATERAL file_pages(path, content) p", f=contents)
    assert sorted(map(tuple, pages.collect()), key=str) == sorted([(1, 1, "One sentence here. Another one follows it.", False), (2, 1, "T\nBody é\n", False), (2, 2, "U\nx\n", False), (3, None, None, True)], key=str)
    chunks = spark.sql("SELECT k, chunk_index, page FROM {f}, LATERAL file_chunks(path, content, NULL, NULL) c WHERE error IS NULL", f=contents)
    assert sorted(map(tuple, chunks.collect())) == [(1, 0, 1), (2, 0, 1)]


def test_encoder_and_chunker_run_once(spark, sf_dir):
    from folioscan.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("q40_embed_text").count("ArrowEvalPython") == 1
    assert plan("q42_page_or_window").count("MapInArrow") == 1


def test_inverted_lists_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "document_id long, chunk_index int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert cells.top_k_each(cells.inverted_lists(none, f"{tmp_path}/x"), queries, 3)[0].collect() == []
    one = spark.createDataFrame([(1, 0, [2.0])], "document_id long, chunk_index int, embedding array<float>")
    assert [r.score for r in cells.top_k_each(cells.inverted_lists(one, f"{tmp_path}/y"), queries, 3)[0].collect()] == [2.0]


def counted(texts):
    """word: (texts, occurrences) as lexical.TERMS has them, by plain counting."""
    out = {}
    for t in texts:
        ws = (t or "").lower().split()
        for w, n in [*((w, ws.count(w)) for w in set(ws)), ("", len(ws))]:
            old = out.get(w, (0, 0))
            out[w] = (old[0] + 1, old[1] + n)
    return out


def terms_of(rows):
    return {r.word: (r.chunks, r.occurrences) for r in rows.collect()}


def test_term_statistics(spark):
    texts = ["a b a", "B  c\tb", "", None, "  ", "a", "a", "x " * 5000]
    assert terms_of(lexical.term_statistics(spark.createDataFrame([(t,) for t in texts], "text string"))) == counted(texts)
    assert terms_of(lexical.term_statistics(spark.createDataFrame([], "text string"))) == {}


def test_store_keeps_term_statistics(spark, tmp_path, monkeypatch):
    """Inserts, updates, deletions, buckets written anew, tables added up, a writer that doesn't ask for them: always those of the chunks there are."""
    monkeypatch.setattr(Store, "PARTS", 2)
    st = Store(spark, f"file://{tmp_path}/store", buckets=2, terms=True)
    right = lambda: terms_of(st.terms()) == counted([r.text for r in st.chunks().collect()])
    st.upsert(*store_rows(spark, *((f"/d/{k}", f"one two {k}") for k in range(12))))
    assert right() and terms_of(st.terms())["two"] == (12, 12)
    other = Store(spark, f"file://{tmp_path}/store")
    other.upsert(*store_rows(spark, ("/d/1", "two two"), ("/d/2", "one two 2"), ("/e", "more")))
    assert right() and terms_of(st.terms())["two"] == (12, 13)
    assert other.delete(path="/d/3") and right()
    assert st.prune(spark.createDataFrame([("/d/1",), ("/e",)], "path string")) == 10 and right()
    assert terms_of(st.terms()) == {"two": (1, 2), "more": (1, 1), "": (2, 3)}
    assert other.delete(path="/e") and other.delete(path="/d/1") and terms_of(st.terms()) == {}


def test_store_counts_terms_later(spark, tmp_path):
    """A store without statistics: counted when asked, kept from the first commit on that asks for them."""
    plain = Store(spark, f"file://{tmp_path}/store", buckets=2)
    plain.upsert(*store_rows(spark, ("/a", "x y"), ("/b", "y")))
    assert plain._state()[1].get("terms") is None and terms_of(plain.terms()) == counted(["x y", "y"])
    st = Store(spark, f"file://{tmp_path}/store", terms=True)
    st.upsert(*store_rows(spark, ("/b", "z")))
    assert st._state()[1]["terms"] and terms_of(st.terms()) == counted(["x y", "z"])


def test_later_schema_is_refused(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store", buckets=2)
    st.upsert(*store_rows(spark, ("/a", "x")))
    at = tmp_path / "store" / "_commits" / st.version()
    (at.parent / f".{at.name}.crc").unlink()
    content = json.loads(at.read_text())
    assert content["schema"] == SCHEMA_NUMBER
    at.write_text(json.dumps(content | {"schema": SCHEMA_NUMBER + 1}) + "\n")
    with pytest.raises(ValueError, match="schema"):
        st.documents()


def test_bm25(spark):
    """Against the formula in plain Python; unknown words, empty texts, no statistics."""
    texts = ["red blue red", "blue", "", "green blue green green", None]
    df = spark.createDataFrame([(k, 0, 0.5, t) for k, t in enumerate(texts)], "document_id long, chunk_index int, score double, text string")
    terms = lexical.term_statistics(df)
    got = {r.document_id: r.rerank_score for r in search.reranked(df, lexical.bm25_logit("Red GREEN red nowhere", terms), 9).collect()}
    n, length = 5, 8 / 5
    for k, t in enumerate(texts):
        ws, want = (t or "").split(), 0.0
        for w, found in (("green", 1), ("nowhere", 0), ("red", 1)):
            want += math.log(1 + (n - found + 0.5) / (found + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / length))
        assert got[k] == pytest.approx(want)
    assert {r.rerank_score for r in search.reranked(df, lexical.bm25_logit("red", terms.filter("false")), 9).collect()} == {0.0}


def test_scan_report(spark):
    """All three kinds from one scan; repeated paths, null paths and lengths, no extension, nothing at all."""
    rows = [("a/x.TXT", 10), ("a/y.txt", 99), ("a/y.txt", 99), ("a/y.txt", 100), ("b", 500), (None, 7), ("c.md", None)]
    df = spark.createDataFrame(rows, "path string, length long")
    got = {(r.kind, r.name, r.total_size): (r.file_count, r.large_count) for r in files.scan_report(df, 99).collect()}
    types = {(("type", r.ext, r.total_size)): (r.file_count, r.large_count) for r in files.scan_stats(df, 99).collect()}
    assert got == {("total", None, 815): (7, 4), ("large", "a/y.txt", 198): (2, 2), ("large", "a/y.txt", 100): (1, 1), ("large", "b", 500): (1, 1)} | types
    plan = files.scan_report(df, 99)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert [(r.kind, r.file_count, r.total_size) for r in files.scan_report(df.limit(0)).collect()] == [("total", 0, 0)]


def test_table_functions_get_small_batches(spark):
    """Spark makes a whole batch into Python values for a table function, so registering them asks for small batches; a number that the session has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for asked, want in (("10000", 512), ("700", 700)):
            spark.conf.set(key, asked)
            tables.register(spark)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_commit_reads_its_documents_once(spark, tmp_path):
    """What a commit needs to know of its documents is worked out once, not again for each table that it writes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(path, k):
        seen.add(1)
        return f"{path}{k}"

    st = Store(spark, f"{tmp_path}/store", buckets=4, terms=True)
    for k in range(2):
        docs = spark.range(20).select(F.concat(F.lit("/a/"), "id").alias("path"), F.lit("t").alias("title"), F.lit(float(k)).alias("mtime"), F.lit(1).cast("long").alias("size"))
        docs = docs.withColumn("sha256", hashed.asNondeterministic()("path", F.lit(k)))
        chunks = docs.select("path", F.lit(0).alias("chunk_index"), F.lit(f"word{k}").alias("text"), F.lit("{}").alias("metadata"), F.lit(None).cast("int").alias("page"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
        before = seen.value
        st.upsert(docs, chunks)
        assert seen.value - before <= 3 * 20
    assert {r.word: r.chunks for r in st.terms().collect()} == {"": 20, "word1": 20}

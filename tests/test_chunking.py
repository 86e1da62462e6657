import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.operators.chunking import chunked, fixed_chunks, paged, paragraph_pages, sentence_chunks, sentence_rows, split_sentences, stream_chunks, text_pages


def plainly(pages, most, overlap):
    """The chunker as a plain loop over sentences."""
    out, now, label = [], [], None
    for page, text in pages:
        for s in split_sentences(text):
            if now and sum(map(len, now)) + len(s) > most:
                out.append(("".join(now), label))
                keep = len(now) - 1
                while keep > 0 and sum(map(len, now[keep - 1 :])) <= overlap:
                    keep -= 1
                now, label = now[keep:], page
            if not now:
                label = page
            now = [*now, s]
    return out + ([("".join(now), label)] if now else [])


TEXT = st.text(alphabet="aB. !\n", max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4), st.integers(1, 60), st.integers(0, 60))
def test_sentence_chunks(texts, most, overlap):
    pages = list(enumerate(texts, 1))
    assert list(sentence_chunks(pages, most, overlap)) == plainly(pages, most, overlap)


def test_page_labels():
    pages = [(1, "A" * 100), (2, "B" * 100), (3, "C" * 100)]
    assert list(sentence_chunks(pages, 100, 0)) == [("A" * 100, 1), ("A" * 100 + "B" * 100, 2), ("B" * 100 + "C" * 100, 3)]
    assert list(sentence_chunks([], 100, 0)) == []


def test_text_pages():
    assert text_pages("") == [] and text_pages(" \n ") == []
    text = "Line of text.\n" * 700
    pages = text_pages(text)
    assert [p for p, _ in pages] == [1, 2, 3, 4] and "".join(t for _, t in pages) == text
    assert all(t.endswith("\n") for _, t in pages)
    blank = "x" * 2999 + "\n" + " " * 3000 + "y"
    assert [p for p, _ in text_pages(blank)] == [1, 3]


def test_strides(spark):
    rows = spark.createDataFrame([("a" * 500,), ("0123456789" * 20,), ("",), ("abc",)], "t string")
    got = [list(r[0]) for r in rows.select(fixed_chunks(F.col("t"), 100, 20)).collect()]
    assert [len(c) for c in got[0]] == [100] * 6 + [20] and got[1][0][-20:] == got[1][1][:20]
    assert got[2] == [] and got[3] == ["abc"]
    streamed = [list(r[0]) for r in rows.select(stream_chunks(F.col("t"), 100, 20)).collect()]
    assert [len(c) for c in streamed[0]] == [100] * 6 + [20] and streamed[2] == [] and streamed[3] == ["abc"]


def test_sentences_agree(spark):
    texts = ["One. Two is a longer one here. Three!\n\nFour is after a break.", "", "   ", "Ä. Über alles. (Next) one.", "a\u00a0b.  C d", "x.\r\nY", "No end"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, text string")
    found = [(r.k, r.sentence, r.text) for r in sentence_rows(rows, "k").collect()]
    assert sorted(found) == [(k, j, s) for k, t in enumerate(texts) for j, s in enumerate(split_sentences(t))]


def test_chunked_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Hello there.")], "id long, text string")
    assert [tuple(r) for r in chunked(rows, "id", 500, 50).collect()] == [(3, 0, "Hello there.", 1)]
    assert chunked(rows.limit(0), "id", 500, 50).count() == 0


def test_paragraph_pages(spark):
    rows = spark.createDataFrame([(1, k, f" p{k} ") for k in range(25)] + [(1, 99, "  ")], "d int, n int, text string")
    got = {r.page: r.text for r in paragraph_pages(rows, "d", "n").collect()}
    assert sorted(got) == [1, 2, 3] and got[3] == "p20\np21\np22\np23\np24\n"


@pytest.mark.parametrize("cut", [sentence_rows, paged, lambda df, key: chunked(df, key, 500, 50), lambda df, key: chunked(df, key, 500, 50, paged=True)])
def test_batches_are_bounded(spark, monkeypatch, cut):
    """What a task makes leaves it in pieces: no batch has more than CHARS characters and ROWS rows, but for its last row, however many texts came in one."""
    runs = []
    df = spark.createDataFrame([], "k long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    cut(df, "k")
    texts = [f"This is the number {k}. " * 100 for k in range(2000)] + [None, ""]
    made = list(runs[0](iter([pa.RecordBatch.from_pydict({"k": range(len(texts)), "text": texts})])))
    assert "".join(t for b in made for t in b.column("text").to_pylist()).count("number") >= 200_000
    assert max(b.num_rows for b in made) <= 1024
    assert max(sum(map(len, b.column("text").to_pylist())) for b in made) < (1 << 20) + 3000

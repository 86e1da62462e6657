"""Questions over a store, from the command line and by function."""

import json

from folioscan import cli
from folioscan.operators import answers
from folioscan.operators.store import Store


def test_ask_over_a_store(spark, tmp_path, capsys):
    for folder, name, text in (("a", "bees.txt", "Honey bees and honey bees. Bees make honey."), ("a", "cats.txt", "Cats sleep all day."), ("b", "honey.txt", "Honey honey honey from another folder.")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    root = str(tmp_path / "index")
    asked = lambda *more: json.loads([cli.main(["--root", root, "ask", *more], spark), capsys.readouterr().out][1])
    cli.main(["--root", root, "index", str(tmp_path / "a"), str(tmp_path / "b")], spark)
    capsys.readouterr()
    got = asked("honey bees", "--folder", str(tmp_path / "a"), "--top-k", "1")
    prompt = json.loads(got["answer"])
    assert [s["path"] for s in got["sources"]] == [f"{tmp_path}/a/bees.txt"] and "Bees make honey." in prompt[1]["content"] and "another folder" not in prompt[1]["content"]
    assert [s["path"].rsplit("/", 1)[1] for s in asked("honey", "--rerank", "--top-k", "2")["sources"]][-1] in ("bees.txt", "honey.txt")
    assert asked("honey", "--folder", "/nowhere")["answer"] == answers.NOTHING and asked("honey", "--chat", "builtins:repr")["answer"].startswith("[{")
    empty = answers.ask_store(Store(spark, str(tmp_path / "none")), "honey", str).first()
    assert (empty.answer, empty.sources, empty.context) == (answers.NOTHING, [], "")


def test_the_search_runs_once(spark, sf_dir):
    """The context is planned from the hits themselves: no sort of all chunks is left in it."""
    rows = spark.createDataFrame([(1, 0, "/x/a.txt", "alpha", [1.0, 0.0]), (2, 0, "/x/b.txt", "beta", [0.0, 1.0])], "document_id long, chunk_index int, path string, text string, embedding array<float>")
    got = answers.ask(rows, "Why?", [1.0, 0.0], lambda m: m[1]["content"], k=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "alpha" in got.first().answer and "beta" not in got.first().answer

import json
import threading
import urllib.request

import pytest
from test_operators import REPO

from quarry import cli, engine, server
from quarry.plans import retrieval


@pytest.fixture
def repo(tmp_path):
    for path, _, text in REPO[:2]:
        (tmp_path / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / path).write_text(text)
    return tmp_path


def run(spark, *argv, models=retrieval.Models()):
    said = []
    cli.run(cli.parser().parse_args(list(argv)), spark, models, said.append)
    return said


def test_commands(spark, repo):
    root, ix = str(repo / "repo"), str(repo / "ix")
    stats = run(spark, "index", root, "--out", ix)
    assert "files\t\t2" in stats and "type\tmethod\t2" in stats
    assert any("pkg/b.py:1-2 helper" in x for x in run(spark, "query", "where is helper", "--index", ix, "--retrieve-only"))
    assert any(x.startswith("calls\t1\thelper") for x in run(spark, "graph", "--symbol", "top_level", "--index", ix))

    (repo / "repo/pkg/c.py").write_text("from pkg.b import helper\n\n\ndef third():\n    return helper()\n")
    (repo / "repo/pkg/b.py").write_text("def helper():\n    return 43\n\n\ndef extra():\n    return helper()\n")
    assert json.loads(run(spark, "update", root, "--index", ix)[0]) == {"added": 1, "modified": 1, "deleted": 0}
    (repo / "repo/pkg/c.py").unlink()
    assert json.loads(run(spark, "update", root, "--index", ix)[0]) == {"added": 0, "modified": 0, "deleted": 1}
    assert json.loads(run(spark, "update", root, "--index", ix)[0]) == {"added": 0, "modified": 0, "deleted": 0}
    c = engine.CodeIndex(spark, ix)
    n = c.tables["chunks"].count()
    assert n == c.tables["vectors"].count() == c.tables["docs"].count() and c.tables["chunks"].where("file_path = 'pkg/c.py'").count() == 0
    assert c.search(["extra"], 1).first()["symbol_name"] == "extra"

    before = c.tables["edges"].count()
    run(spark, "graph-edit", "--index", ix, "--add-edge", "helper", "top_level")
    assert engine.CodeIndex(spark, ix).tables["edges"].count() == before + 1
    with pytest.raises(ValueError):
        run(spark, "graph-edit", "--index", ix, "--add-edge", "helper", "nowhere")
    run(spark, "graph-rebuild", "--index", ix)
    assert engine.CodeIndex(spark, ix).tables["edges"].count() == before
    for kind in ("html", "dot", "mermaid"):
        path = run(spark, "graph-export", "--index", ix, "--format", kind, "--out", str(repo / f"g.{kind}"))[0]
        assert "helper" in open(path).read()
    view = c.view()
    view["edges"] = view["edges"][1:]
    (repo / "v.json").write_text(json.dumps(view))
    assert json.loads(run(spark, "graph-import", str(repo / "v.json"), "--index", ix)[0]) == {"added": 0, "removed": 1}

    (repo / "g.jsonl").write_text('{"id": "q1", "question": "helper returns", "relevant_files": ["pkg/b.py"]}\n')
    assert any("| hybrid | recall | 1.000 | 1 |" in x for x in run(spark, "eval", "--index", ix, "--golden", str(repo / "g.jsonl"), "--configs", "hybrid", "--out", str(repo / "runs")))
    assert run(spark, "scaffold", "--index", ix, "-n", "5")
    with pytest.raises(FileNotFoundError):
        run(spark, "stats", "--index", str(repo / "none"))


def test_bench(spark, tmp_path):
    rows = [{"id": str(i), "query": f"where is frob{i}nicate", "code": f"def frob{i}nicate(): pass"} for i in range(5)]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert json.loads(run(spark, "bench", str(tmp_path / "b.jsonl"), "--mode", "hybrid", "-k", "3")[0])["recall@3"] == 1
    assert json.loads(run(spark, "bench", str(tmp_path / "b.jsonl"), "--suite", "codesearchnet", "--mode", "dense", "-k", "5")[0])["n"] == 5
    with pytest.raises(ValueError):
        engine.bench(spark, str(tmp_path / "b.jsonl"), mode="other")


def test_server(spark, repo):
    index = engine.CodeIndex.build(spark, str(repo / "repo"), str(repo / "ix"))
    srv = server.make_server(index, port=0)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{srv.server_port}"
    ask = lambda path, body=None: json.loads(urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode() if body is not None else None)).read())
    view = ask("/api/graph")
    ids = {n["label"]: n["id"] for n in view["nodes"]}
    n = len(view["edges"])
    assert ask("/api/edge", {"from": ids["helper"], "to": ids["Widget"]}) == {"ok": True, "edges": n + 1}
    assert ask("/api/edge/delete", {"from": ids["helper"], "to": ids["Widget"]})["removed"] == 1
    assert len(ask("/api/reset", {})["edges"]) == n
    assert b"<svg" in urllib.request.urlopen(url + "/").read()
    srv.shutdown()
    assert "helper" in server.search_code(index, "helper", 2)

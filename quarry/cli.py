"""Commands over an index: python -m quarry.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from quarry import engine
from quarry.operators import scaffold
from quarry.plans import evaluation, retrieval
from quarry.settings import Settings, read_env_file
from quarry.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for a, kw in args:
            c.add_argument(*a, **kw)

    a = lambda *names, **kw: (names, kw)
    index, k, focus = a("--index", default=".quarry"), a("-k", type=int), [a("--symbol"), a("--depth", type=int, default=2), a("--max-nodes", type=int, default=90)]
    levers = [a("--rerank", action="store_true"), a("--expand-graph", action="store_true"), a("--graph-rerank", action="store_true"), a("--llm-rerank", action="store_true"), a("--hyde", action="store_true")]
    command("index", a("repo_path"), a("--out", default=".quarry"), a("--no-context-header", action="store_true"), a("--max-tokens", type=int), a("--languages", nargs="*"))
    command("query", a("question", nargs="+"), index, k, a("--no-dense", action="store_true"), a("--no-bm25", "--dense-only", action="store_true"), a("--retrieve-only", action="store_true"), *levers)
    command("chat", index, k, *levers)
    command("graph-export", index, *focus, a("--format", choices=["html", "dot", "mermaid"], default="html"), a("--out"))
    command("graph-serve", index, *focus, a("--host", default="127.0.0.1"), a("--port", type=int, default=8000))
    command("graph-rebuild", index)
    command("graph-import", a("file"), index)
    command("graph-edit", index, a("--add-edge", nargs=2, action="append", default=[]), a("--remove-edge", nargs=2, action="append", default=[]), a("--type", choices=["calls", "imports", "contains"], default="calls"))
    command("update", a("repo_path"), index, a("--git", nargs=2))
    command("eval", index, a("--golden", required=True), a("--configs"), a("-k", type=int, default=5), a("--holdout", action="store_true"), a("--out", default="eval_runs"))
    command("bench", a("data"), a("--suite", choices=["passages", "codesearchnet"], default="passages"), a("--mode", choices=["dense", "hybrid", "rerank"], default="hybrid"), a("-k", type=int, default=10))
    command("scaffold", index, a("-n", type=int, default=55), a("--update"))
    command("stats", index)
    command("graph", index, a("--symbol"), a("--file"), a("--depth", type=int, default=1))
    return p


def _settings(args, base: Settings) -> Settings:
    return base.but(use_rerank=args.rerank, expand_graph=args.expand_graph, graph_rerank=args.graph_rerank, llm_rerank=args.llm_rerank, use_hyde=args.hyde)


def run(args, spark: SparkSession, models: retrieval.Models = retrieval.Models(), out=print) -> None:
    open_index = lambda: engine.CodeIndex(spark, args.index, None, models)
    match args.command:
        case "index":
            env = read_env_file(open(".env", encoding="utf-8").read()) if os.path.exists(".env") else {}
            s = Settings.from_env(env | dict(os.environ)).but(include_header=not args.no_context_header)
            s = s.but(max_chunk_tokens=args.max_tokens) if args.max_tokens else s
            _table(engine.CodeIndex.build(spark, args.repo_path, args.out, s, models, args.languages).stats(), out)
        case "query":
            ix = open_index()
            s = _settings(args, ix.settings)
            for r in ix.search(args.question, args.k, s, use_dense=not args.no_dense, use_bm25=not args.no_bm25).collect():
                out(f"{r['query_id']}.{r['rank']} {r['citation']} {r['symbol_name'] or ''} {r['score']:.4f}")
            if not args.retrieve_only and models.llm is not None:
                for r in ix.answer(args.question, s).collect():
                    out(f"{r['answer']}\nvalid citations {r['valid_citations']}, invalid {r['invalid_citations']}")
        case "chat":
            ix = open_index()
            s = _settings(args, ix.settings)
            while (line := sys.stdin.readline()) and line.strip() not in ("/quit", "/exit"):
                if line.strip() == "/stats":
                    _table(ix.stats(), out)
                elif line.strip():
                    for r in ix.search([line.strip()], args.k, s).collect():
                        out(f"{r['rank']} {r['citation']} {r['symbol_name'] or ''}")
        case "graph-export":
            text = open_index().export(args.format, args.symbol, args.depth, args.max_nodes)
            path = args.out or f"quarry_graph.{ {'html': 'html', 'dot': 'dot', 'mermaid': 'mmd'}[args.format] }"
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            out(path)
        case "graph-serve":
            from quarry import server

            server.serve(open_index(), args.symbol, args.depth, args.max_nodes, args.host, args.port)
        case "graph-rebuild":
            open_index().rebuild_graph()
        case "graph-import":
            with open(args.file, encoding="utf-8") as f:
                out(json.dumps(open_index().import_edits(json.load(f))))
        case "graph-edit":
            open_index().edit_edges([tuple(x) for x in args.add_edge], [tuple(x) for x in args.remove_edge], args.type)
        case "update":
            out(json.dumps(open_index().update(args.repo_path, tuple(args.git) if args.git else None)))
        case "eval":
            rows = [r.asDict() for r in open_index().evaluate(args.golden, args.configs.split(",") if args.configs else None, args.k, args.holdout).orderBy("config", "metric").collect()]
            text = evaluation.markdown(rows, ["config", "metric", "mean", "n"])
            out(text)
            out(store.save_results(args.out, text, rows))
        case "bench":
            out(json.dumps(engine.bench(spark, args.data, args.suite, args.mode, args.k, models=models)))
        case "scaffold":
            ix = open_index()
            rows = [r.asDict() for r in scaffold.questions(ix.tables["nodes"], ix.tables["edges"], args.n).collect()]
            store.update_golden(args.update, rows) if args.update else [out(json.dumps(r)) for r in rows]
        case "stats":
            _table(open_index().stats(), out)
        case "graph":
            if not (args.symbol or args.file):
                raise ValueError("give --symbol or --file")
            _table(open_index().neighbours(args.symbol, args.file, args.depth), out)


def _table(df, out) -> None:
    for r in df.collect():
        out("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(args, spark)
    except (FileNotFoundError, RuntimeError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

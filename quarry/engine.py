"""An index of a repository on disk, and what is done with it: build, update, search, answer, evaluate, inspect."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, dense, graph, incremental, lexical, metrics
from quarry.plans import evaluation, retrieval
from quarry.settings import Settings
from quarry.shared import ensure_checkpoint_dir
from quarry.sources import files, records, store


class CodeIndex:
    """The tables of an index directory. Every write goes to a fresh snapshot directory that a pointer then names, so
    what is being read is never overwritten."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, models: retrieval.Models = retrieval.Models()):
        self.spark, self.path, self.models = spark, path.rstrip("/"), models
        try:
            current = spark.read.parquet(f"{self.path}/current").agg(F.max_by("snapshot", "n").alias("s"), F.max("n").alias("n")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                raise FileNotFoundError(f"no index at {path}") from None
            raise
        self.n, self.tables, self.settings = current["n"], *store.load(spark, current["s"], settings)

    # ---- writing

    @classmethod
    def build(cls, spark: SparkSession, root: str, path: str, settings: Settings = Settings(), models: retrieval.Models = retrieval.Models(), languages: list[str] | None = None) -> CodeIndex:
        found = files.scan(spark, root, languages)
        return cls._write(spark, path, 0, found, settings, models, root, files.revision(root) or "nogit")

    @classmethod
    def _write(cls, spark, path: str, n: int, found: DataFrame, settings: Settings, models, root: str, sha: str, old: CodeIndex | None = None, diff: DataFrame | None = None) -> CodeIndex:
        target = f"{path.rstrip('/')}/snapshot-{n:06d}-{uuid.uuid4().hex[:8]}"
        fresh = found if diff is None else found.join(diff.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi")
        chunking.parse_files(fresh, settings).write.parquet(f"{target}/parsed_new")
        parsed = spark.read.parquet(f"{target}/parsed_new")
        chunks, symbols = chunking.chunks(parsed, settings, root, sha), chunking.symbols(parsed)
        calls, imports = chunking.calls(parsed), chunking.imports(parsed)
        manifest = fresh.select("file_path", "content_sha", "language", "n_lines").withColumn("git_sha", F.lit(sha))
        parsed_files = parsed.groupBy("file_path").agg(F.max("parsed").alias("parsed"))
        manifest = manifest.join(parsed_files, "file_path", "left")
        made = retrieval.build_index(chunks, settings, models)
        tables = {"chunks": chunks, "manifest": manifest, "symbols": symbols, "calls": calls, "imports": imports, "vectors": made.vectors}
        if old is not None:
            gone = old.tables["chunks"].join(diff.select("file_path"), "file_path", "left_semi").select("id")
            kept = {t: old.tables[t].join(diff.select("file_path"), "file_path", "left_anti") for t in ("chunks", "manifest", "symbols", "calls", "imports")}
            tables = {t: kept[t].unionByName(tables[t]) if t in kept else df for t, df in tables.items()}
            tables["vectors"] = dense.removed(old.tables["vectors"], gone).unionByName(made.vectors)
        postings = made.postings if old is None else lexical.added(lexical.removed(old.index().postings, gone), made.postings)
        tables |= {"postings": postings.postings, "docs": postings.docs, "terms": postings.terms}
        store.save(spark, target, tables, settings, root, sha)
        # the graph resolves names over all files, so it is made again from the stored records
        nodes, edges = cls._graph({t: spark.read.parquet(f"{target}/{t}") for t in ("symbols", "calls", "imports")})
        nodes.write.parquet(f"{target}/nodes")
        edges.write.parquet(f"{target}/edges")
        cls._point(spark, path, n, target)
        return cls(spark, path, None, models)

    @staticmethod
    def _graph(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        nodes = t["symbols"].withColumnRenamed("chunk_id", "id")
        return nodes, graph.build(nodes, t["calls"], t["imports"])

    @staticmethod
    def _point(spark: SparkSession, path: str, n: int, target: str) -> None:
        spark.createDataFrame([(n, target)], "n long, snapshot string").coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/current")

    def update(self, root: str, git: tuple[str, str] | None = None) -> dict[str, int]:
        """Index what was added or modified and drop what was deleted, by content or between two commits; how many."""
        found = files.scan(self.spark, root)
        if git is None:
            diff = incremental.manifest_diff(self.tables["manifest"], found)
        else:
            told = incremental.git_changes(files.changed_lines(self.spark, root, *git)).groupBy("file_path").agg(F.max_by("change", F.when(F.col("change") == "deleted", 0).otherwise(1)).alias("change"))
            there, known = found.select("file_path", F.lit(True).alias("there")), self.tables["manifest"].select("file_path", F.lit(True).alias("known"))
            diff = told.join(there, "file_path", "left").join(known, "file_path", "left")
            diff = diff.where("there OR known").select("file_path", F.when(F.col("there").isNull(), "deleted").otherwise(F.col("change")).alias("change"))
        counts = {r["change"]: r["n"] for r in incremental.summary(diff).collect()}
        if counts:
            made = self._write(self.spark, self.path, self.n + 1, found, self.settings, self.models, root, files.revision(root) or "nogit", self, diff)
            self.n, self.tables = made.n, made.tables
        return {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}

    def save_edges(self, edges: DataFrame) -> None:
        """A new snapshot that differs in its edges alone."""
        target = f"{self.path}/snapshot-{self.n + 1:06d}-{uuid.uuid4().hex[:8]}"
        tables = self.tables | {"edges": edges}
        meta = self.spark.read.parquet(f"{self._current()}/meta").first()
        store.save(self.spark, target, tables, self.settings, meta["repo"], meta["git_sha"])
        self._point(self.spark, self.path, self.n + 1, target)
        self.n, self.tables = self.n + 1, store.load(self.spark, target)[0]

    def _current(self) -> str:
        return self.spark.read.parquet(f"{self.path}/current").agg(F.max_by("snapshot", "n").alias("s")).first()["s"]

    def rebuild_graph(self) -> None:
        self.save_edges(self._graph(self.tables)[1])

    def edit_edges(self, add: list[tuple[str, str]] = (), remove: list[tuple[str, str]] = (), type: str | None = "calls") -> None:
        """Edges between symbols by name; each name must be one node's."""
        edges = self.tables["edges"]
        if add:
            rows = [(self._one(a), self._one(b), type or "calls") for a, b in add]
            edges = graph.add_edges(edges, self.tables["nodes"], self.spark.createDataFrame(rows, "src string, dst string, type string"))
        if remove:
            rows = [(self._one(a), self._one(b), type) for a, b in remove]
            gone = self.spark.createDataFrame(rows, "src string, dst string, type string")
            edges = graph.remove_edges(edges, gone if type else gone.drop("type"))
        self.save_edges(edges)

    def _one(self, name: str) -> str:
        found = graph.find(self.tables["nodes"], name).select("id").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{name!r} names {'no' if not found else 'more than one'} symbol")
        return found[0]["id"]

    def import_edits(self, view: dict) -> dict[str, int]:
        """Make the edges among a view's nodes those that it lists."""
        nodes = self.spark.createDataFrame([(x["id"],) for x in view.get("nodes", [])], "id string")
        desired = self.spark.createDataFrame([(e["from"], e["to"], e.get("label") or "calls") for e in view.get("edges", [])], "src string, dst string, type string")
        own = nodes.join(self.tables["nodes"].select("id"), "id", "left_semi")
        diff = {r["change"]: r["count"] for r in graph.edit_diff(self.tables["edges"], own, desired).groupBy("change").count().collect()}
        if diff:
            self.save_edges(graph.apply_edits(self.tables["edges"], self.tables["nodes"], own, desired))
        return {"added": diff.get("added", 0), "removed": diff.get("removed", 0)}

    # ---- reading

    def index(self) -> retrieval.Index:
        t = self.tables
        inverted = dense.InvertedFile(t["vectors"]) if self.settings.vector_backend == "ivf" else None
        return retrieval.Index(t["chunks"], t["vectors"], lexical.Postings(t["postings"], t["docs"], t["terms"]), t["nodes"], t["edges"], inverted)

    def search(self, questions: list[str], k: int | None = None, settings: Settings | None = None, **lists) -> DataFrame:
        """Ranked chunks of all questions: (query_id, rank, score, citation, symbol_name, code, source, relation)."""
        q = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        found = retrieval.retrieve(q, self.index(), settings or self.settings, self.models, k, **lists)
        cite = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
        named = found.join(self.tables["chunks"].select("id", cite.alias("citation"), "symbol_name", "code"), "id")
        return named.select("query_id", "rank", "score", "citation", "symbol_name", "code", "source", "relation").orderBy("query_id", "rank")

    def answer(self, questions: list[str], settings: Settings | None = None) -> DataFrame:
        if self.models.llm is None:
            raise RuntimeError("no language model is configured")
        q = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        return evaluation.answer(q, self.index(), settings or self.settings, self.models)

    def evaluate(self, golden: str, configs: list[str] | None = None, k: int = 5, holdout: bool = False) -> DataFrame:
        """(config, metric, mean, n) over a question file."""
        q = records.golden(self.spark, golden, holdout).where("size(relevant_files) > 0").select(F.col("id").alias("query_id"), F.col("question").alias("query"), "relevant_files")
        scores = evaluation.evaluate(q, self.index(), configs or ["dense", "hybrid", "rerank", "graph", "graph-rerank"], self.settings, self.models, k)
        return metrics.by_config(scores, ["recall", "precision", "rr", "ndcg"])

    def stats(self) -> DataFrame:
        """(what, value, n): chunks by type and language, files, files that were not parsed, and the graph's sizes."""
        c = self.tables["chunks"].groupingSets([["symbol_type"], ["language"], []], "symbol_type", "language").agg(F.count("*").alias("n"))
        what = F.when(F.col("symbol_type").isNotNull(), "type").when(F.col("language").isNotNull(), "language").otherwise("chunks")
        rows = c.select(what.alias("what"), F.coalesce("symbol_type", "language", F.lit("")).alias("value"), "n")
        m = self.tables["manifest"].agg(F.count("*").alias("files"), F.count(F.when(~F.coalesce("parsed", F.lit(False)), 1)).alias("windows only"))
        rows = rows.unionByName(m.select(F.explode(F.create_map(F.lit("files"), "files", F.lit("windows only"), F.col("windows only"))).alias("what", "n")).select("what", F.lit("").alias("value"), "n"))
        g = graph.stats(self.tables["nodes"], self.tables["edges"])
        return rows.unionByName(g.select(F.concat(F.lit("graph "), "what").alias("what"), F.lit("").alias("value"), "n"))

    def neighbours(self, name: str | None = None, file: str | None = None, depth: int = 1) -> DataFrame:
        nodes = self.tables["nodes"]
        seeds = graph.find(nodes, name) if name else nodes.where(F.col("file_path") == file)
        near = graph.neighbours(seeds.select(F.lit(0).alias("query_id"), "id"), self.tables["edges"], nodes, depth)
        return near.join(nodes.select("id", "qualified_name", "file_path", "start_line", "end_line"), "id").orderBy("distance", "order").select("relation", "distance", "qualified_name", "file_path", "start_line", "end_line")

    def view(self, focus: str | None = None, depth: int = 2, most: int = 90) -> dict:
        """A small subgraph as JSON: nodes and edges."""
        nodes, edges = graph.subgraph(self.tables["nodes"], self.tables["edges"], focus, depth, most)
        return {
            "nodes": [{"id": r["id"], "label": r["simple_name"], "kind": r["kind"], "title": f"{r['qualified_name']} ({r['file_path']}:{r['start_line']}-{r['end_line']})"} for r in nodes.orderBy("id").collect()],
            "edges": [{"from": r["src"], "to": r["dst"], "label": r["type"]} for r in edges.orderBy("src", "dst", "type").collect()],
        }

    def export(self, format: str, focus: str | None = None, depth: int = 2, most: int = 90) -> str:
        if format == "html":
            return html(self.view(focus, depth, most))
        nodes, edges = graph.subgraph(self.tables["nodes"], self.tables["edges"], focus, depth, most)
        lines = graph.dot(nodes, edges) if format == "dot" else graph.mermaid(nodes, edges)
        return "\n".join(r["line"] for r in lines.orderBy("line_no").collect())


def bench(spark: SparkSession, data: str, suite: str = "passages", mode: str = "hybrid", k: int = 10, settings: Settings = Settings(), models: retrieval.Models = retrieval.Models()) -> dict:
    """Recall, MRR and nDCG of a benchmark file's queries over its documents."""
    if mode not in ("dense", "hybrid", "rerank"):
        raise ValueError(f"unknown mode {mode!r}")
    if suite == "codesearchnet":
        rows = records.code_pairs(spark, data).withColumnRenamed("code", "doc").withColumn("relevant_ids", F.array("id"))
    else:
        rows = records.bench(spark, data)
    ensure_checkpoint_dir(spark)
    rows = rows.checkpoint()  # generated ids must stay
    docs = rows.dropDuplicates(["id"]).select("id", F.col("doc").alias("embed_text"), F.col("doc").alias("code"), F.lit(None).cast("string").alias("context_header"))
    n = docs.count()
    own = settings.but(dense_top_n=n, bm25_top_n=n, fuse_top_n=n) if mode != "rerank" else settings.but(fuse_top_n=50, use_rerank=True)
    q = rows.select(F.col("id").alias("query_id"), "query")
    found = retrieval.retrieve(q, retrieval.build_index(docs, own, models), own, models, n if mode != "rerank" else 50, use_bm25=mode != "dense")
    relevant = rows.select(F.col("id").alias("query_id"), F.explode("relevant_ids").alias("item"))
    scores = metrics.retrieval(found.withColumnRenamed("id", "item"), relevant, k)
    r = scores.agg(F.count("*").alias("n"), F.avg("recall").alias(f"recall@{k}"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias(f"ndcg@{k}")).first()
    return r.asDict()


def html(view: dict) -> str:
    """A page that draws a subgraph on circles, and lists its edges."""
    data = json.dumps(view).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>code graph</title><svg id="g" viewBox="-500 -500 1000 1000" width="100%" height="90vh"></svg>
<script>const view = {data}, at = {{}}, svg = document.getElementById("g");
const make = (tag, set, text) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in set) e.setAttribute(k, set[k]); if (text) e.textContent = text; svg.append(e); return e; }};
view.nodes.forEach((n, i) => {{ const a = 2 * Math.PI * i / view.nodes.length, r = 260 + 160 * (i % 2); at[n.id] = [r * Math.cos(a), r * Math.sin(a)]; }});
view.edges.forEach(e => make("line", {{x1: at[e.from][0], y1: at[e.from][1], x2: at[e.to][0], y2: at[e.to][1], stroke: "#999"}}));
view.nodes.forEach(n => {{ make("circle", {{cx: at[n.id][0], cy: at[n.id][1], r: 6}}); make("text", {{x: at[n.id][0] + 8, y: at[n.id][1], "font-size": 12}}, n.label); }});
</script>"""

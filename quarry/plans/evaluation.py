"""Evaluation of retrieval configurations over a question set, and answers with checks, as batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import text as X
from quarry.operators import context, graph, metrics, verify
from quarry.plans import retrieval
from quarry.settings import Settings
from quarry.shared import staged

#: Configurations by name: what differs from the settings, and which lists are used.
LADDER: dict[str, dict] = {
    "dense": {"use_bm25": False},
    "hybrid": {},
    "rerank": {"use_rerank": True},
    "graph": {"use_rerank": True, "expand_graph": True},
    "llm-rerank": {"llm_rerank": True},
    "graph-rerank": {"graph_rerank": True},
}


def run_config(name: str, questions: DataFrame, index: retrieval.Index, settings: Settings = Settings(), models: retrieval.Models = retrieval.Models(), k: int = 5, retrieved: int = 15) -> DataFrame:
    """(config, query_id, recall, precision, rr, ndcg) of questions(query_id, query, relevant_files)."""
    own = dict(LADDER[name])
    lists = {x: own.pop(x) for x in ("use_dense", "use_bm25") if x in own}
    found = retrieval.retrieve(questions.select("query_id", "query"), index, settings.but(**own), models, retrieved, **lists)
    files = metrics.first_seen(found.join(index.chunks.select("id", "file_path"), "id"), "file_path")
    relevant = questions.select("query_id", F.explode("relevant_files").alias("item"))
    return metrics.retrieval(files, relevant, k).select(F.lit(name).alias("config"), "*")


def evaluate(questions: DataFrame, index: retrieval.Index, configs: list[str], settings: Settings = Settings(), models: retrieval.Models = retrieval.Models(), k: int = 5) -> DataFrame:
    out = None
    for name in configs:
        scores = run_config(name, questions, index, settings, models, k)
        out = scores if out is None else out.unionByName(scores)
    return out


def answer(queries: DataFrame, index: retrieval.Index, settings: Settings, models: retrieval.Models) -> DataFrame:
    """(query_id, query, sources, context, prompt, answer, and the structural check) of queries(query_id, query)."""
    found = retrieval.retrieve(queries, index, settings, models)
    chunks = index.chunks.select("id", "file_path", "start_line", "end_line", "code", "symbol_name")
    made = context.assemble(found.join(chunks, "id"), settings).join(queries.select("query_id", F.col("query").alias("question")), "query_id")
    if index.edges is not None:
        made = made.join(graph.context_lines(found.where("source <> 'graph'"), index.edges, index.nodes), "query_id", "left")
    made = made.withColumn("prompt", context.prompt(made, "question", "graph_context" if index.edges is not None else None))
    told = plugins.generate(made, models.llm, out="answer", max_tokens=settings.gen_max_tokens)
    return verify.structural(told.withColumn("n_sources", F.size("sources")))


def with_repair(answers: DataFrame, faithful: DataFrame, models: retrieval.Models, threshold: float, judge) -> DataFrame:
    """answers(query_id, prompt, answer, ...) where those of faithful(query_id, faithfulness) below the threshold are asked for
    once more, and the second answer stays if judge(answers) rates it no lower."""
    low = faithful.where(F.col("faithfulness") < threshold)
    again = answers.join(low.select("query_id", F.col("faithfulness").alias("before")), "query_id").withColumn("prompt", F.concat("prompt", F.lit("\n\nSome claims of an earlier answer were not supported. State only what the sources say.")))
    second = plugins.generate(again.select("query_id", "prompt", "before"), models.llm, out="second")
    rated = judge(second.select("query_id", F.col("second").alias("answer"))).select("query_id", F.col("faithfulness").alias("after"))
    better = second.join(rated, "query_id").where("second IS NOT NULL AND after >= before").select("query_id", "second")
    return answers.join(better, "query_id", "left").withColumn("answer", F.coalesce("second", "answer")).drop("second")


CLAIMS = "struct<claims: array<struct<text: string, sources: array<int>, supported: boolean, reason: string>>>"


def judged_claims(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(query_id, idx, text, sources, supported, reason) of a judge's JSON; a reply that is none gives no rows."""
    parsed = F.from_json(F.to_json(X.tolerant_json(reply)), CLAIMS)
    return replies.select("query_id", F.posexplode(parsed["claims"]).alias("idx", "c")).select("query_id", "idx", "c.*")


def _numbered_sources(settings: Settings) -> Column:
    return F.transform("sources", lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), X.judge_cut(t["code"], settings.judge_source_tokens)))


def faithfulness(answers: DataFrame, models: retrieval.Models, settings: Settings) -> DataFrame:
    """(query_id, faithfulness, n_claims, judge_failed): by one call of a judging model, or by one that lists claims and
    one that checks those with sources (settings.single_call_judge). A claim without a source is not supported."""
    if not settings.single_call_judge:
        return _faithfulness_in_two(answers, models, settings)
    asked = answers.withColumn("prompt", F.concat(F.lit('List the claims of the answer as JSON {"claims": [{"text", "sources", "supported", "reason"}]}.\n\n'), F.array_join(_numbered_sources(settings), "\n\n"), F.lit("\n\nAnswer: "), "answer"))
    told = plugins.generate(asked.select("query_id", "prompt"), models.llm)
    claims = judged_claims(told)
    cited = claims.withColumn("supported", F.coalesce("supported", F.lit(False)) & (F.size("sources") > 0))
    return _rated(told.select("query_id", F.col("reply").isNull().alias("judge_failed")), cited)


def _rated(told: DataFrame, claims: DataFrame) -> DataFrame:
    scores = metrics.faithfulness(claims)
    return told.join(scores, "query_id", "left").withColumns({"faithfulness": F.coalesce("faithfulness", F.lit(1.0)), "n_claims": F.coalesce("n_claims", F.lit(0))})


VERDICTS = "struct<results: array<struct<index: int, verdict: string, reason: string>>>"


def _faithfulness_in_two(answers: DataFrame, models: retrieval.Models, settings: Settings) -> DataFrame:
    first = F.concat(F.lit('List the claims of the answer and the sources each cites as JSON {"claims": [{"text", "sources"}]}.\n\nAnswer: '), "answer")
    told = staged(plugins.generate(answers.select("query_id", first.alias("prompt"), _numbered_sources(settings).alias("shown")), models.llm), "claims")
    claims = judged_claims(told).where(~X.is_abstention("text")).select("query_id", "idx", "text", "sources")
    listed = claims.where(F.size("sources") > 0).join(told.select("query_id", "shown"), "query_id")
    cited = F.transform("sources", lambda n: F.coalesce(F.get("shown", n - 1), F.concat(F.lit("["), n.cast("string"), F.lit("] (missing source)"))))
    block = F.concat(F.lit("Claim "), F.col("idx").cast("string"), F.lit(": "), "text", F.lit("\n"), F.array_join(cited, "\n---\n"))
    blocks = listed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"))
    second = F.concat(F.lit('Is each claim supported by its sources? Reply as JSON {"results": [{"index", "verdict": "SUPPORTED" or "UNSUPPORTED", "reason"}]}.\n\n'), "blocks")
    checked = staged(plugins.generate(blocks.select("query_id", second.alias("prompt")), models.llm), "verdicts")
    parsed = F.from_json(F.to_json(X.tolerant_json("reply")), VERDICTS)
    verdicts = checked.select("query_id", F.explode(parsed["results"]).alias("v")).groupBy("query_id", F.col("v.index").alias("idx")).agg(F.max((F.col("v.verdict") == "SUPPORTED").cast("int")).alias("v"))
    rated = claims.join(verdicts, ["query_id", "idx"], "left").withColumn("supported", (F.size("sources") > 0) & (F.coalesce("v", F.lit(0)) == 1))
    failed = told.select("query_id", F.col("reply").isNull().alias("first")).join(checked.select("query_id", F.col("reply").isNull().alias("second")), "query_id", "left")
    return _rated(failed.select("query_id", (F.col("first") | F.coalesce("second", F.lit(False))).alias("judge_failed")), rated)


def correctness(answers: DataFrame, models: retrieval.Models) -> DataFrame:
    """(query_id, grade, score, reason) of answers(query_id, question, answer, reference) by a judging model. A grade it
    makes up, or a reply that is no JSON, is wrong; where the call fails, grade and score are null."""
    ask = F.concat(F.lit('Grade the answer by whether it agrees in fact with the reference: correct, partially_correct or wrong. Reply as JSON {"grade", "reason"}.\n\nQuestion: '), "question", F.lit("\n\nReference: "), "reference", F.lit("\n\nAnswer: "), F.coalesce("answer", F.lit("")))
    told = plugins.generate(answers.select("query_id", ask.alias("prompt")), models.llm, max_tokens=512)
    said = F.from_json(F.to_json(X.tolerant_json("reply")), "struct<grade: string, reason: string>")
    grade = F.when(F.col("reply").isNotNull(), F.when(said["grade"].isin("correct", "partially_correct"), said["grade"]).otherwise("wrong"))
    return told.select("query_id", grade.alias("grade"), F.when(grade.isNotNull(), X.grade_score(grade)).alias("score"), F.coalesce(said["reason"], F.lit("")).alias("reason"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of (small) results."""
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])

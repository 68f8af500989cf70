"""Numbered context under a token budget, from ranked chunks: one fold over each query's rows, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.fuse import gate
from quarry.settings import Settings

SOURCE = "struct<file_path:string,start_line:int,end_line:int,code:string,symbol_name:string,source:string,relation:string,id:string>"


def assemble(ranked: DataFrame, settings: Settings = Settings(), query: str | None = None) -> DataFrame:
    """(query_id, sources, context, context_tokens) of ranked(query_id, rank, score, id, file_path, start_line, end_line,
    code, symbol_name, source, relation, and the query's text if sources are trimmed).

    In order of rank a row is shrunk and taken unless an accepted one holds its span, the same code was taken, or it
    exceeds what is left of the budget (the first always fits); later, smaller ones may still fit. Then spans of a file
    that follow each other within two lines are joined, and what is left is numbered."""
    s = settings
    rows = gate(ranked, s.min_sources) if s.drop_negative_rerank else ranked
    code, asked = F.col("code"), F.col(query) if query else F.lit("")
    if s.trim_sources:
        code = X.trim_to_query(code, asked, s.max_source_tokens)
    if s.compact_source_code:
        code = X.compact(code)
    rows = rows.withColumn("code", code)
    rows = rows.withColumn("code", X.fit_budget("code", asked, s.context_token_budget))
    rows = rows.select("query_id", F.struct(F.col("rank"), F.struct("file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "code", "symbol_name", "source", "relation", F.col("id").cast("string").alias("id")).cast(SOURCE).alias("s"), X.content_key("code").alias("key"), X.token_len("code").alias("cost")).alias("x"))
    # the lists that rows come from are cut to a few dozen rows a query
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    accepted = F.aggregate("rows", _nothing(), _take(s))["acc"]
    merged = F.aggregate(accepted, F.array().cast(f"array<{SOURCE}>"), _merge) if s.merge_adjacent_sources else accepted
    out = listed.select("query_id", merged.alias("sources"))
    rendered = F.transform("sources", lambda t, i: X.render_source(i + 1, X.citation(t["file_path"], t["start_line"], t["end_line"]), t["symbol_name"], t["source"], t["relation"], t["code"]))
    out = out.withColumn("context", F.array_join(rendered, "\n\n"))
    return out.withColumn("context_tokens", X.token_len("context"))


def _nothing() -> Column:
    return F.struct(F.array().cast(f"array<{SOURCE}>").alias("acc"), F.array().cast("array<string>").alias("keys"), F.lit(0).cast("long").alias("used"))


def _take(s: Settings):
    def step(state, x):
        own = x["s"]
        held = F.exists(state["acc"], lambda a: (a["file_path"] == own["file_path"]) & (a["start_line"] <= own["start_line"]) & (own["end_line"] <= a["end_line"]))
        again = F.array_contains(state["keys"], x["key"]) if s.dedup_sources else F.lit(False)
        over = (F.size(state["acc"]) > 0) & (state["used"] + x["cost"] > s.context_token_budget)
        with_it = F.struct(F.concat(state["acc"], F.array(own)).alias("acc"), F.concat(state["keys"], F.array(x["key"])).alias("keys"), (state["used"] + x["cost"]).alias("used"))
        return F.when(held | again | over, state).otherwise(with_it)

    return step


def _joined(t, s, follows) -> Column:
    return F.struct(
        t["file_path"].alias("file_path"),
        F.when(follows, t["start_line"]).otherwise(F.least(t["start_line"], s["start_line"])).alias("start_line"),
        F.when(follows, F.greatest(t["end_line"], s["end_line"])).otherwise(t["end_line"]).alias("end_line"),
        F.when(follows, F.concat(t["code"], F.lit("\n"), s["code"])).otherwise(F.concat(s["code"], F.lit("\n"), t["code"])).alias("code"),
        *[t[n].alias(n) for n in ("symbol_name", "source", "relation", "id")],
    ).cast(SOURCE)


def _merge(out, s):
    def follows(t):
        return (t["file_path"] == s["file_path"]) & (s["start_line"] - t["end_line"]).between(0, 2)

    def precedes(t):
        return (t["file_path"] == s["file_path"]) & (t["start_line"] - s["end_line"]).between(0, 2)

    at = F.array_position(F.transform(out, lambda t: follows(t) | precedes(t)), True)
    merged = F.transform(out, lambda t, i: F.when(i + 1 == at, _joined(t, s, follows(t))).otherwise(t))
    return F.when(at > 0, merged).otherwise(F.concat(out, F.array(s)))


def sources(assembled: DataFrame) -> DataFrame:
    """(query_id, n, file_path, start_line, end_line, symbol_name, code) of assemble()'s lists."""
    return assembled.select("query_id", F.posexplode("sources").alias("i", "s")).select("query_id", (F.col("i") + 1).alias("n"), "s.file_path", "s.start_line", "s.end_line", "s.symbol_name", "s.code")


def prompt(assembled: DataFrame, question: str = "question", graph: str | None = None) -> Column:
    """The text a model is asked: the sources, what is known of how they connect, and the question."""
    parts = [F.lit("Answer from the numbered sources only, citing them as [n]. Say so if they do not hold the answer."), F.concat(F.lit("Sources:\n"), F.col("context"))]
    if graph:
        parts.append(F.concat(F.lit("Connections:\n"), F.col(graph)))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Question: "), F.col(question)))

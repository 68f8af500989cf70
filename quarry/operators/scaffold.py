"""Question sets whose labels follow from the code graph: who calls what across files, and single symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import text as X

#: Names too common to ask about (fixed values).
COMMON = (
    "self", "cls", "init", "main", "call", "run", "get", "set", "add", "len",
    "str", "int", "list", "dict", "type", "name", "value", "data", "args",
    "kwargs", "super", "print", "format", "join", "split", "append",
)


def interesting(kind: str = "kind", name: str = "simple_name") -> Column:
    low = F.lower(name)
    return F.col(kind).isin("function", "method", "class") & (F.char_length(name) >= 4) & ~F.startswith(F.col(name), F.lit("__")) & ~low.isin(*COMMON) & ~F.contains(low, F.lit("test"))


def questions(nodes: DataFrame, edges: DataFrame, n: int = 55, start_id: int = 46, holdout_every: int = 4, cross_share: float = 0.65, used: list[str] | None = None) -> DataFrame:
    """(id, question, type, relevant_files, relevant_symbols, holdout): n questions, a share of them across files, in an
    order given by a hash; every fourth is held out."""
    free = nodes.where(interesting() & ~F.col("qualified_name").isin(used or [""]))
    s = free.where("kind <> 'class'").select(F.col("id").alias("src"), F.col("simple_name").alias("s_name"), F.col("qualified_name").alias("s_full"), F.col("file_path").alias("s_file"))
    d = free.select(F.col("id").alias("dst"), F.col("simple_name").alias("d_name"), F.col("qualified_name").alias("d_full"), F.col("file_path").alias("d_file"))
    pairs = edges.where("type = 'calls'").join(s, "src").join(d, "dst").where("s_file <> d_file")
    pairs = pairs.groupBy("s_name", "d_name").agg(F.min(F.struct("s_full", "d_full", "s_file", "d_file")).alias("p"))
    cross = pairs.select(
        F.lit(0).alias("part"),
        F.concat(F.lit("How does `"), "s_name", F.lit("` use `"), "d_name", F.lit("`?")).alias("question"),
        F.lit("cross-file").alias("type"),
        F.array_sort(F.array("p.s_file", "p.d_file")).alias("relevant_files"),
        F.array("p.s_full", "p.d_full").alias("relevant_symbols"),
    )
    text = F.when(F.col("kind") == "class", F.concat(F.lit("What does the `"), "simple_name", F.lit("` class do?"))).otherwise(F.concat(F.lit("Where is `"), "simple_name", F.lit("` defined and what does it do?")))
    single = free.select(F.lit(1).alias("part"), text.alias("question"), F.lit("where").alias("type"), F.array("file_path").alias("relevant_files"), F.array("qualified_name").alias("relevant_symbols"))
    order = F.struct(F.md5(F.concat_ws("|", "question", F.array_join("relevant_symbols", "|"))).alias("h"), F.array_join("relevant_symbols", "|").alias("s"))
    n_cross = round(n * cross_share)
    # the first of each kind by top-n, so that no task orders more rows than there are questions
    chosen = cross.orderBy(order).limit(n_cross).unionByName(single.orderBy(order).limit(n))
    place = F.row_number().over(Window.orderBy("part", order))
    chosen = chosen.withColumn("i", place).where(F.col("i") <= n).withColumn("i", F.row_number().over(Window.orderBy(order)))
    name = F.concat(F.lit("q"), F.lpad((F.col("i") - 1 + start_id).cast("string"), 3, "0"))
    return chosen.select(name.alias("id"), "question", "type", "relevant_files", "relevant_symbols", (F.pmod(F.col("i") - 1, F.lit(holdout_every)) == holdout_every - 1).alias("holdout"))


def paraphrased(questions: DataFrame, model: Callable[[], object], batch: int = 12) -> DataFrame:
    """questions(id, question, ...) with questions a model words anew without naming symbols, batch at a time; a question
    keeps its words where the reply is no JSON, lacks it, or the call fails. Ids that a reply makes up count for nothing."""
    number = F.floor((F.row_number().over(Window.orderBy("id")) - 1) / batch)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "question"))), lambda x: F.concat(x["id"], F.lit(": "), x["question"])), "\n")
    asked = questions.select(number.alias("batch"), "id", "question").groupBy("batch").agg(lines.alias("lines"), F.collect_set(F.col("id").cast("string")).alias("ids"))
    prompt = F.concat(F.lit('Say each question in other words, in one sentence, without any name of a symbol or file. Reply as JSON {"rewrites": [{"id", "question"}]}.\n\n'), "lines")
    told = plugins.generate(asked.select("ids", prompt.alias("prompt")), model, max_tokens=2048)
    parsed = F.from_json(F.to_json(X.tolerant_json("reply")), "struct<rewrites: array<struct<id: string, question: string>>>")
    new = told.select("ids", F.explode(parsed["rewrites"]).alias("r")).where(F.array_contains("ids", F.col("r.id"))).select(F.col("r.id").alias("new_id"), F.trim("r.question").alias("new"))
    new = new.where("new <> ''").groupBy("new_id").agg(F.min("new").alias("new"))
    both = questions.join(new, F.col("id").cast("string") == F.col("new_id"), "left")
    return both.withColumn("question", F.coalesce("new", "question")).select(*questions.columns)

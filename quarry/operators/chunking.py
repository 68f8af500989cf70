"""Chunks of files: windows of lines and of tokens, headers, and a parser for Python; one row a chunk.

files has (file_path, language, text); every operator returns chunk rows (id, repo, file_path, language, symbol_name,
symbol_type, start_line, end_line, code, context_header, embed_text, git_sha), lines counted from 1, both ends included,
plus ordinal, which orders a file's chunks as they are found and files by path."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.settings import Settings

PARSED = "kind string, symbol_name string, start_line int, end_line int, code string, context_header string, position int, calls array<string>, imports array<string>, parsed boolean"


def line_windows(files: DataFrame, lines: int = 50, *keys: str) -> DataFrame:
    """Blocks of that many lines, in order; blocks of blank lines alone are left out, but keep their numbers."""
    keys = keys or ("file_path",)
    split = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(split) - 1), F.lit(lines))
    blocks = files.select(*keys, split.alias("l"), F.explode(starts).alias("at")).select(*keys, "at", F.slice("l", F.col("at") + 1, F.lit(lines)).alias("l"))
    out = blocks.select(*keys, (F.col("at") + 1).alias("start_line"), (F.col("at") + F.size("l")).alias("end_line"), F.array_join("l", "\n").alias("code"))
    return out.where(~F.rlike("code", F.lit(r"\A\s*\z")))


def token_windows(text, max_tokens: int):
    """An expression: the windows (start_line, end_line, code) of a text, each ended by the line at which it has
    max_tokens; no line is split."""
    empty = F.array().cast("array<struct<start_line:int,end_line:int,code:string>>")
    blank = F.struct(F.lit(0).alias("at"), F.lit(1).alias("first"), F.lit(None).cast("string").alias("cur"), empty.alias("out"))

    def step(s, line):
        cur = F.when(s["cur"].isNull(), line).otherwise(F.concat(s["cur"], F.lit("\n"), line))
        at = s["at"] + 1
        full = X.token_len(cur) >= max_tokens
        window = F.struct(s["first"].alias("start_line"), at.alias("end_line"), cur.alias("code"))
        return F.struct(at.alias("at"), F.when(full, at + 1).otherwise(s["first"]).alias("first"), F.when(full, F.lit(None).cast("string")).otherwise(cur).alias("cur"), F.when(full, F.concat(s["out"], F.array(window))).otherwise(s["out"]).alias("out"))

    def rest(s):
        tail = F.struct(s["first"].alias("start_line"), s["at"].alias("end_line"), s["cur"].alias("code"))
        return F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(tail)))

    return F.aggregate(F.split(X.c(text), "\n"), blank, step, rest)


def header(file_path, class_name, label, signature, doc):
    """File, class, label, signature and first line of the documentation, those that are there, each on a line."""
    some = lambda prefix, x, suffix="": F.when(F.coalesce(X.c(x), F.lit("")) != "", F.concat(F.lit(prefix), X.c(x), F.lit(suffix)))
    return F.concat_ws("\n", some("File: ", file_path), some("Class: ", class_name), X.c(label), X.c(signature), some('"""', doc, '"""'))


def _name(node: ast.AST) -> str:
    while isinstance(node, (ast.Subscript, ast.Call)):
        node = node.value if isinstance(node, ast.Subscript) else node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _calls(node: ast.AST) -> list[str]:
    """The last names of what is called below a node, in order of position."""
    found = [(n.lineno, n.col_offset, _name(n.func)) for n in ast.walk(node) if isinstance(n, ast.Call)]
    return [name for _, _, name in sorted(found) if name]


def _imports(tree: ast.AST, path: str) -> list[str]:
    """The names that imports ask for: modules, and what is taken from them. Relative modules are told from the root, as
    the file's path tells it."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            above = path.split("/")[: -n.level] if n.level else []
            module = ".".join([*above, *([n.module] if n.module else [])])
            names = [a.name for a in n.names if a.name != "*"]
            out += ([module] if n.module else [f"{module}.{x}" for x in names if module]) + names
    return out


def _span(node) -> tuple[int, int]:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    return first, node.end_lineno


def parse_python(path: str, source: str, max_tokens: int) -> list[tuple] | None:
    """Rows as PARSED has them, without position and parsed: top-level functions, classes (a summary of signatures) and
    their methods, nested classes within classes, and last the rest of the module. None if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = source.split("\n")
    body_of = lambda a, b: "\n".join(lines[a - 1 : b])
    rows: list[tuple] = []

    def signature(node) -> str:
        return " ".join(body_of(node.lineno, max(node.lineno, node.body[0].lineno - 1) if node.body[0].lineno > node.lineno else node.lineno).split('"""')[0].split())

    def heading(owner: str, label: str, node) -> str:
        doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
        parts = [f"File: {path}", f"Class: {owner}" if owner else "", label, signature(node), f'"""{doc}"""' if doc else ""]
        return "\n".join(p for p in parts if p)

    def function(node, owner: str) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        kind = "method" if owner else "function"
        a, b = _span(node)
        code = body_of(a, b)
        calls = [c for n in node.body for c in _calls(n)]
        label = f"{kind.title()}: {name}"
        if max(1, len(code) // 4) <= max_tokens:
            rows.append((kind, name, a, b, code, heading(owner, label, node), calls, []))
            return
        parts, first, cur = [], a, []
        for at in range(a, b + 1):
            cur.append(lines[at - 1])
            if max(1, len("\n".join(cur)) // 4) >= max_tokens:
                parts.append((first, at))
                first, cur = at + 1, []
        if cur:
            parts.append((first, b))
        for i, (x, y) in enumerate(parts, 1):
            rows.append((kind, f"{name}#{i}", x, y, body_of(x, y), heading(owner, f"{label} (part {i}/{len(parts)})", node), calls if i == 1 else [], []))

    def klass(node, owner: str) -> None:
        name = f"{owner}.{node.name}" if owner else node.name
        a, b = _span(node)
        methods = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
        summary = "\n".join([signature(node), *([f'    """{doc}"""'] if doc else []), *(f"    {signature(m)}" for m in methods)])
        rows.append(("class", name, a, b, summary, heading(owner, f"Class: {name}", node), [], []))
        walk(node.body, name)

    def walk(body, owner: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(n, owner)
            elif isinstance(n, ast.ClassDef):
                klass(n, owner)

    walk(tree.body, "")
    rest = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    if rest:  # in parts, if it is too long for one chunk
        parts, cur = [], []
        for at in (k for n in rest for k in range(n.lineno, n.end_lineno + 1)):
            if cur and max(1, len("\n".join(lines[k - 1] for k in [*cur, at])) // 4) > max_tokens:
                parts.append(cur)
                cur = []
            cur.append(at)
        parts.append(cur)
        for i, own in enumerate(parts, 1):
            name, label = (path, path) if len(parts) == 1 else (f"{path}#{i}", f"{path} (part {i}/{len(parts)})")
            code = "\n".join(lines[k - 1] for k in own)
            rows.append(("module", name, own[0], own[-1], code, f"File: {path}\nModule: {label}", [], _imports(tree, path) if i == 1 else []))
    return rows


def parse_files(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """files with a row for each chunk (PARSED). Python is parsed; other languages, and what does not parse or holds no
    chunk, is cut into windows of lines."""
    max_tokens, window = settings.max_chunk_tokens, settings.window_lines

    def windows(path: str, source: str) -> Iterator[tuple]:
        lines = source.split("\n")
        for at in range(0, len(lines), window):
            code = "\n".join(lines[at : at + window])
            if code.strip():
                yield "window", None, at + 1, min(at + window, len(lines)), code, f"File: {path}", [], []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.rsplit(" ", 1)[0] if "<" not in x else x.split(" ")[0] for x in PARSED.split(", ")]
        for batch in batches:
            out = []
            for path, language, source in zip(batch["file_path"], batch["language"], batch["text"], strict=True):
                rows = parse_python(path, source or "", max_tokens) if language == "python" else None
                parsed = bool(rows)
                for i, r in enumerate(rows or windows(path, source or "")):
                    out.append((path, language, *r[:6], i, *r[6:], parsed))
            yield pd.DataFrame(out, columns=["file_path", "language", *names])

    return files.select("file_path", "language", "text").mapInPandas(run, f"file_path string, language string, {PARSED}")


def chunks(parsed: DataFrame, settings: Settings = Settings(), repo: str = "repo", git_sha: str = "nogit") -> DataFrame:
    """Chunk rows of parse_files(). Spans that repeat within a file keep the last."""
    last = F.row_number().over(Window.partitionBy("file_path", "start_line", "end_line").orderBy(F.desc("position")))
    once = parsed.withColumn("r", last).where("r = 1").drop("r")
    return once.select(
        X.chunk_id("file_path", "start_line", "end_line").alias("id"), F.lit(repo).alias("repo"), "file_path", "language", "symbol_name",
        F.col("kind").alias("symbol_type"), "start_line", "end_line", "code", "context_header",
        X.embed_text("context_header", "code", settings.include_header).alias("embed_text"), F.lit(git_sha).alias("git_sha"),
        F.struct("file_path", "position").alias("ordinal"),
    )


def symbols(parsed: DataFrame) -> DataFrame:
    """(chunk_id, qualified_name, simple_name, kind, file_path, start_line, end_line); windows of a function or module
    count once, at the first. A module's names are its path and its file's name."""
    named = parsed.where("kind IN ('function', 'method', 'class', 'module') AND symbol_name IS NOT NULL AND NOT symbol_name RLIKE '#([2-9]|[0-9]{2,})$'")
    name = X.without_window("symbol_name")
    simple = F.when(F.col("kind") == "module", F.substring_index(name, "/", -1)).otherwise(X.last_part(name))
    return named.select(X.chunk_id("file_path", "start_line", "end_line").alias("chunk_id"), name.alias("qualified_name"), simple.alias("simple_name"), "kind", "file_path", "start_line", "end_line")


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.select(X.chunk_id("file_path", "start_line", "end_line").alias("chunk_id"), "file_path", F.explode("calls").alias("callee"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select(X.chunk_id("file_path", "start_line", "end_line").alias("chunk_id"), "file_path", F.explode("imports").alias("name"))

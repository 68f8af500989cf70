"""Source files of a directory as rows, with the predicates that leave out what is not worth indexing."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories and files that hold no first-party source (fixed values).
SKIP_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".venv", "venv", "env", "node_modules", "vendor",
    "dist", "build", ".next", ".nuxt", "target", ".idea", ".vscode",
    ".gradle", ".terraform", "site-packages", ".eggs", "bower_components",
)
SKIP_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
    "Pipfile.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock",
)
MINIFIED = (".min.js", ".min.css", "-min.js", "bundle.js")
MAX_BYTES, MAX_LINES, SNIFFED = 1_000_000, 5_000, 8192

#: The language of each suffix (fixed values).
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx", ".go": "go", ".rs": "rust", ".rb": "ruby", ".rake": "ruby", ".java": "java", ".kt": "kotlin",
    ".kts": "kotlin", ".scala": "scala", ".sc": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp", ".php": "php", ".swift": "swift",
    ".m": "objc", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".pl": "perl", ".pm": "perl",
    ".r": "r", ".R": "r", ".jl": "julia", ".hs": "haskell", ".ml": "ocaml", ".mli": "ocaml", ".ex": "elixir",
    ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang", ".elm": "elm", ".clj": "clojure", ".cljs": "clojure",
    ".cljc": "clojure", ".dart": "dart", ".groovy": "groovy", ".gradle": "groovy", ".ps1": "powershell",
    ".psm1": "powershell", ".sql": "sql", ".vue": "vue", ".svelte": "svelte", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".tf": "hcl", ".hcl": "hcl", ".proto": "proto", ".zig": "zig", ".nix": "nix",
}
#: Interpreters named in a first line #!..., in this order (fixed values).
SHEBANGS = (("python", "python"), ("bash|/sh|zsh", "bash"), ("node", "javascript"), ("ruby", "ruby"), ("perl", "perl"))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_skipped_dir(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | F.endswith(d, F.lit(".egg-info")))


def skipped_name(path: Column) -> Column:
    name = name_of(path)
    out = name.isin(*SKIP_FILES)
    for suffix in MINIFIED:
        out = out | F.endswith(name, F.lit(suffix))
    return out


def language(path: Column, head: Column) -> Column:
    """By the suffix as it is, then in lower case; without one by the interpreter in the first line; else null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = name_of(path)
    suffix = F.regexp_extract(name, r"(?!^)\.[^.]*$", 0)
    first = F.substring_index(head, "\n", 1)
    by_line = F.lit(None).cast("string")
    for pattern, lang in reversed(SHEBANGS):
        by_line = F.when(F.rlike(first, F.lit(pattern)), lang).otherwise(by_line)
    return F.when(suffix != "", F.coalesce(F.try_element_at(table, suffix), F.try_element_at(table, F.lower(suffix)))).otherwise(F.when(F.startswith(head, F.lit("#!")), by_line))


def n_lines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def small_text(content: Column, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> Column:
    """Within the limits, and without a NUL in the first SNIFFED bytes."""
    text = decoded(content)
    binary = F.locate("\0", F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")) > 0
    return (F.octet_length(content) <= max_bytes) & ~binary & (n_lines(text) <= max_lines)


def _part(glob: str) -> str:
    """A regular expression of one part of a path, where * and ? stop at a slash."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            own = glob[i + 1 : end]
            out.append("[" + ("^" + own[1:] if own[0] in "!^" else own).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def ignore_regex(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignored, regular expression of paths) for the patterns of an ignore file, of which the last that matches counts."""
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line.removeprefix("!")
        rooted = "/" in line.rstrip("/")
        only_dir = line.endswith("/")
        parts = line.strip("/").split("/")
        body = "/".join(".*" if p == "**" else _part(p) for p in parts).replace(".*/", "(.*/)?")
        out.append((ignored, ("^" if rooted else "(^|/)") + body + ("/" if only_dir else "(/|$)")))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    out = F.lit(False)
    for on, pattern in ignore_regex(lines):
        out = F.when(F.rlike(path, F.lit(pattern)), F.lit(on)).otherwise(out)
    return out


def keep(files: DataFrame, languages: list[str] | None = None, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """Of files(file_path, content) those worth indexing: (file_path, language, n_lines, content_sha, text). Tests of the
    name come first, then those of the content."""
    p = F.col("file_path")
    named = files.where(~in_skipped_dir(p) & ~skipped_name(p) & ~ignored(p, ignore or []))
    text = decoded(F.col("content"))
    good = named.where(small_text(F.col("content"), max_bytes, max_lines))
    out = good.select("file_path", language(p, decoded(F.substring("content", 1, 128))).alias("language"), n_lines(text).cast("int").alias("n_lines"), F.sha1("content").alias("content_sha"), text.alias("text"))
    out = out.where("language IS NOT NULL")
    return out.where(F.col("language").isin(languages)) if languages else out


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """The source files below a directory, paths relative to it; its ignore file counts. Files of skipped directories and
    names are pruned by their metadata when the scan is planned, so they are not opened; neither are contents read of those
    that are too large."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    start = re.sub("^[a-z]+:/*", "/", where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the path in the metadata is a URI: escapes change its length, not its number of parts
    parts = F.split(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/"), "/")
    below = F.array_join(F.slice(parts, start.count("/") + 2, 1000), "/")
    opened = files.where(~in_skipped_dir(below) & ~skipped_name(below)).where(F.col("length") <= max_bytes)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    named = opened.select(F.substr(at, F.lit(len(start) + 2), F.char_length(at)).alias("file_path"), "content")
    ignore = _lines(spark, f"{root.rstrip('/')}/.gitignore")
    return keep(named, languages, ignore, max_bytes, max_lines)


def _lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file, none if it is not there (Spark's own readers pass over names with a dot)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def revision(root: str) -> str | None:
    """The commit a working tree is at, if it is one."""
    try:
        out = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() or None if out.returncode == 0 else None


def changed_lines(spark: SparkSession, root: str, old: str, new: str = "HEAD") -> DataFrame:
    """(value): the lines of git diff --name-status between two commits, for incremental.git_changes()."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-status", f"{old}..{new}"], capture_output=True, text=True, timeout=60, check=True)
    return spark.createDataFrame([(x,) for x in out.stdout.splitlines()], "value string")


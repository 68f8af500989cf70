"""Scalar functions on text, code, citations and vectors, as column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of sentences that say the sources do not answer (fixed values).
ABSTENTIONS = (
    "do not contain", "don't contain", "not contain", "no information",
    "cannot determine", "can't determine", "not covered", "not present",
    "does not appear", "doesn't appear", "no source", "not found in",
    "unable to", "insufficient", "not enough information",
)

#: Patterns that tell the class of a question (fixed values); the first that matches decides.
MULTIHOP = r"(?i)\b(trace|end[ -]?to[ -]?end|flow|lifecycle|across|pipeline|sequence|from .+ to |how .+ (reach|become|propagat|travel|flow))"
WHERE = r"(?i)^\s*(where\b|which file|what file|locate\b)"
HOWTO = r"(?i)^\s*(how\b|how do i\b|how to\b)"

#: Prefixes of asymmetric encoders for queries and passages, by what the model's name holds (fixed values).
PREFIXES = {
    "coderank": ("Represent this query for searching relevant code: ", ""),
    "e5": ("query: ", "passage: "),
    "bge": ("Represent this sentence for searching relevant passages: ", ""),
}

GAP_MARK = "    # ..."
BUDGET_MARK = "\n    # ...(truncated to budget)"
JUDGE_MARK = "\n# ...(truncated)"
SNIPPET_MARK = "\n…"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_len(s) -> Column:
    """About four characters a token: 0 for the empty text, else 1 at least; null for null."""
    n = F.char_length(c(s))
    return F.when(n == 0, 0).when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def code_tokens(s) -> Column:
    """Each run of ASCII letters and digits in lower case, followed by its camel-case parts if there are several.

    No step is a function of elements, so all of it is compiled. Texts without a capital after a small letter or digit
    have no parts and are split at once (those with the two signs whose small form is an ASCII letter excepted). In the
    others such a run is written twice, the second time behind a mark; from the mark on, part by part, blanks are set
    before capitals."""
    plain = F.array_remove(F.split(F.lower(c(s)), "[^a-z0-9]+"), "")
    runs = F.regexp_replace(c(s), "[^A-Za-z0-9]+", " ")
    twice = F.regexp_replace(runs, "(?<![A-Za-z0-9])([A-Z]*+[a-z0-9]++[A-Z][A-Za-z0-9]*+)", "$1 \x02$1")
    parted = F.regexp_replace(twice, r"(\x02[A-Z]*+[a-z0-9]++|\G(?!^)[A-Z]++[a-z0-9]++)(?=[A-Z])", "$1 ")
    mixed = F.array_remove(F.split(F.lower(parted), r"[ \x02]+"), "")
    return F.when(F.rlike(c(s), F.lit("[a-z0-9][A-Z]|[\u0130\u212a]")), mixed).otherwise(plain)


def compact(code) -> Column:
    """Without white space at line ends, with one blank line for several, without line ends outside."""
    stripped = F.regexp_replace(c(code), r"[ \t\r\x0B\f]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(stripped, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def rstrip(s) -> Column:
    return F.regexp_replace(c(s), r"\s+\z", "")


def let(value, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_to_query(code, query, max_tokens: int, pad: int = 6) -> Column:
    """Of a text over budget the first line and pad lines around each that shares a token with the query, gaps marked;
    whole if nothing matches or nothing is gained."""
    code = c(code)

    def kept(lines, hit):
        near = F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(i - pad, F.lit(0)), F.least(i + pad, F.size(lines) - 1))))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), near)))

    def joined(lines, keep):
        gap = lambda i, k: F.when((k > 0) & (i - F.get(keep, k - 1) > 1), F.lit(GAP_MARK + "\n")).otherwise(F.lit(""))
        return F.array_join(F.transform(keep, lambda i, k: F.concat(gap(i, k), F.get(lines, i))), "\n")

    def with_hits(lines, wanted):
        at = F.transform(lines, lambda ln, i: F.when(F.arrays_overlap(code_tokens(ln), wanted), i))
        return let(F.filter(at, lambda i: i.isNotNull()), lambda hit: F.when(F.size(hit) > 0, let(kept(lines, hit), lambda keep: joined(lines, keep))))

    trimmed = let(F.split(code, "\n"), lambda lines: let(F.array_distinct(code_tokens(query)), lambda wanted: with_hits(lines, wanted)))
    shorter = let(trimmed, lambda t: F.when(token_len(t) < token_len(code), t).otherwise(code))
    return F.when(token_len(code) <= max_tokens, code).otherwise(shorter)


def fit_budget(code, query, budget: int) -> Column:
    """No more than the budget: trimmed to the query, then cut hard."""
    cut = lambda t: F.concat(rstrip(F.substring(t, 1, budget * 4)), F.lit(BUDGET_MARK))
    fitted = let(trim_to_query(code, query, budget), lambda t: F.when(token_len(t) <= budget, t).otherwise(cut(t)))
    return F.when(token_len(code) <= budget, c(code)).otherwise(fitted)


def judge_cut(s, max_tokens: int) -> Column:
    if max_tokens <= 0:
        return c(s)
    return F.when(token_len(s) <= max_tokens, c(s)).otherwise(F.concat(rstrip(F.substring(c(s), 1, max_tokens * 4)), F.lit(JUDGE_MARK)))


def rerank_snippet(header, code, max_tokens: int = 400) -> Column:
    """Header and body if they fit, else the header and whole leading lines of the body."""
    h, b = F.trim(F.coalesce(c(header), F.lit(""))), F.coalesce(c(code), F.lit(""))
    whole = F.regexp_replace(F.when(h != "", F.concat(h, F.lit("\n"), b)).otherwise(b), r"^\s+|\s+\z", "")
    head = F.substr(b, F.lit(1), F.greatest(F.lit(0), (F.lit(max_tokens) - token_len(h)) * 4).cast("int"))
    lines = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    cut = F.when(h != "", F.concat(h, F.lit("\n"), lines, F.lit(SNIPPET_MARK))).otherwise(F.concat(lines, F.lit(SNIPPET_MARK)))
    return F.when(token_len(whole) <= max_tokens, whole).otherwise(F.regexp_replace(cut, r"^\s+|\s+\z", ""))


def citation(file_path, start_line, end_line) -> Column:
    return F.concat(c(file_path), F.lit(":"), c(start_line).cast("string"), F.lit("-"), c(end_line).cast("string"))


def chunk_id(file_path, start_line, end_line) -> Column:
    return F.sha1(citation(file_path, start_line, end_line))


def embed_text(header, code, with_header: bool = True) -> Column:
    if not with_header:
        return c(code)
    return F.when(F.coalesce(c(header), F.lit("")) != "", F.concat(c(header), F.lit("\n\n"), c(code))).otherwise(c(code))


def render_source(n, cite, symbol, source_type, relation, code) -> Column:
    named = F.when(F.coalesce(c(symbol), F.lit("")) != "", F.concat(F.lit("  ("), c(symbol), F.lit(")"))).otherwise("")
    from_graph = F.when((c(source_type) == "graph") & (F.coalesce(c(relation), F.lit("")) != ""), F.concat(F.lit("  [graph: "), c(relation), F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), c(n).cast("string"), F.lit("] "), c(cite), named, from_graph, F.lit("\n"), c(code))


def citations(answer) -> Column:
    """Every [n], in order, repeats included."""
    return F.transform(F.regexp_extract_all(c(answer), F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))


def is_abstention(s) -> Column:
    low = F.lower(c(s))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in ABSTENTIONS])


def sentences(s) -> Column:
    """Parts after [.!?] and white space, or between line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c(s), r"(?<=[.!?])\s+|\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")


def is_uncited_claim(sentence) -> Column:
    """A sentence of five words at least, without a citation, that is no abstention."""
    s = c(sentence)
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return ~F.rlike(s, F.lit(r"\[\d+\]")) & ~is_abstention(s) & (words >= 5)


def query_class(q) -> Column:
    return F.when(F.rlike(c(q), F.lit(MULTIHOP)), "multihop").when(F.rlike(c(q), F.lit(WHERE)), "where").when(F.rlike(c(q), F.lit(HOWTO)), "howto").otherwise("lookup")


def routed_k(q, default) -> Column:
    kind = query_class(q)
    return F.when(kind == "multihop", 8).when(kind == "where", 4).otherwise(F.lit(default)).cast("int")


def last_part(name) -> Column:
    return F.substring_index(c(name), ".", -1)


def symbol_match(a, b) -> Column:
    """Equal, or one the other's dotted end, or the same last part. All three imply the last, which a join can hash."""
    return last_part(a) == last_part(b)


def without_window(symbol) -> Column:
    """name#2 is a window of name."""
    return F.substring_index(c(symbol), "#", 1)


def tolerant_json(s) -> Column:
    """The text as JSON, else its outermost braces as JSON, else null."""
    return F.coalesce(F.try_parse_json(c(s)), F.try_parse_json(F.regexp_extract(c(s), r"(?s)\{.*\}", 0)))


def grade_score(grade) -> Column:
    return F.when(c(grade) == "correct", 1.0).when(c(grade) == "partially_correct", 0.5).otherwise(0.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(c(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def jaccard(a, b) -> Column:
    """Of two token lists as sets; 0 if both are empty."""
    union = F.size(F.array_union(c(a), c(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(c(a), c(b))) / union)


def min_max(x, over) -> Column:
    low, high = F.min(c(x)).over(over), F.max(c(x)).over(over)
    return (c(x) - low) / F.when(high - low == 0, 1.0).otherwise(high - low)


def content_key(code) -> Column:
    """SHA-1 of a text without its white space: what counts as the same source twice."""
    return F.sha1(F.regexp_replace(c(code), r"\s+", ""))


def prefixes(model_name: str) -> tuple[str, str]:
    n = model_name.lower()
    if "coderank" in n or "nomic" in n and "code" in n:
        return PREFIXES["coderank"]
    if "e5" in n:
        return PREFIXES["e5"]
    return PREFIXES["bge"] if "bge" in n and "-en" in n else ("", "")


def max_seq_len(model_name: str) -> int | None:
    n = model_name.lower()
    return 512 if "coderank" in n or "nomic" in n and "code" in n else None


def hashed_vector(tokens, dim: int = 64) -> Column:
    """A stand-in for an encoder: counts of tokens in dim buckets of their MD5, of unit length."""
    bucket = F.transform(c(tokens), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    return l2_normalised(counts)

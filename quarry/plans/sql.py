"""Pieces of DuckDB text that the oracles share."""

NON_BLANK = r"NOT regexp_full_match(code, '\s*')"


def tokens(x: str) -> str:
    return (
        rf"flatten(list_transform(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda t: t <> ''), "
        r"lambda t: list_concat([lower(t)], list_filter(list_transform(string_split(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), lambda p: lower(p)), lambda p: p <> lower(t)))))"
    )


def token_len(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END"


def compact(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\x0B\f]+(\n|$)', '\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


CHUNKS = rf"""
chunks AS (
  SELECT sha1('doc' || doc_id || ':' || (s + 1) || '-' || least(s + 50, n)) AS id, doc_id, 'doc' || doc_id AS file_path, s + 1 AS start_line, least(s + 50, n) AS end_line,
         array_to_string(l[s + 1:s + 50], chr(10)) AS code
  FROM (SELECT doc_id, l, len(l) AS n, unnest(range(0, len(l), 50)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE NOT regexp_full_match(array_to_string(l[s + 1:s + 50], chr(10)), '\s*')
)"""


def bm25(docs: str, id: str, text: str, queries: str, query_id: str, query: str, n: int = 40) -> str:
    """CTEs ending in bm25(query_id, id, score, rank)."""
    return f"""
bt AS (SELECT {id} AS id, unnest({tokens(text)}) AS term FROM {docs}),
bl AS (SELECT {id} AS id, len({tokens(text)}) AS dl FROM {docs}),
bn AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM bl),
bp AS (SELECT term, id, count(*) AS tf FROM bt GROUP BY 1, 2),
bf AS (SELECT term, count(*) AS df FROM bp GROUP BY 1),
bq AS (SELECT query_id, term, count(*) AS qf FROM (SELECT {query_id} AS query_id, unnest({tokens(query)}) AS term FROM {queries}) GROUP BY 1, 2),
bs AS (
  SELECT query_id, bp.id, round(sum(qf * ln((n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM bq JOIN bf USING (term) JOIN bp USING (term) JOIN bl ON bl.id = bp.id, bn GROUP BY 1, 2
),
bm25 AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= {n})"""


def hashed(name: str, rows: str, id: str, text: str) -> str:
    """A CTE (id, v) of hashed vectors."""
    return f"""
{name}_c AS (SELECT id, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b FROM (SELECT {id} AS id, unnest({tokens(text)}) AS t FROM {rows})) GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name}_c GROUP BY 1),
{name} AS (SELECT c.id, b, n / norm AS x FROM {name}_c c JOIN {name}_n USING (id))"""


def dense(n: int = 40) -> str:
    """A CTE dense(query_id, id, score, rank) over hashed dv (documents) and qv (queries); what shares no bucket scores 0."""
    return f"""
dd AS (SELECT q.id AS query_id, d.id, round(sum(q.x * d.x), 9) AS score FROM qv q JOIN dv d USING (b) GROUP BY 1, 2),
dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dd) WHERE rank <= {n})"""


def rrf(lists: list[tuple[str, float]], cut: int | None = 30) -> str:
    """A CTE fused(query_id, id, score, rank)."""
    every = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS list, {w}e0 AS w FROM {t}" for i, (t, w) in enumerate(lists))
    where = f" WHERE rank <= {cut}" if cut else ""
    return f"""
rl AS ({every}),
rs AS (SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM rl GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM rs){where})"""

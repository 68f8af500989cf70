"""Tunables of indexing, retrieval, context and evaluation, passed explicitly to whatever needs them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_chunk_tokens: int = 800
    window_lines: int = 50
    include_header: bool = True
    embed_model: str = "md5-hash-64"
    embed_dim: int = 64
    embed_batch: int = 64
    embed_query_prefix: str | None = None
    embed_doc_prefix: str | None = None
    embed_max_seq: int | None = None
    dense_top_n: int = 40
    bm25_top_n: int = 40
    fuse_top_n: int = 30
    final_k: int = 6
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    rerank_model: str = ""
    use_rerank: bool = False
    expand_graph: bool = False
    graph_expand_budget: int = 4
    graph_prererank_pool: bool = True
    graph_expand_seeds: int = 5
    graph_expand_depth: int = 1
    graph_pool_budget: int = 10
    graph_rerank_boost: float = 0.0
    graph_pagerank: bool = False
    graph_pagerank_seeds: int = 5
    graph_pagerank_add: int = 8
    graph_rerank: bool = False
    graph_rerank_seeds: int = 3
    llm_rerank: bool = False
    llm_rerank_pool: int = 15
    use_mmr: bool = False
    mmr_lambda: float = 0.7
    use_hyde: bool = False
    context_token_budget: int = 6000
    gen_max_tokens: int = 4096
    repair_threshold: float = 0.0
    dedup_sources: bool = True
    merge_adjacent_sources: bool = True
    compact_source_code: bool = True
    drop_negative_rerank: bool = True
    min_sources: int = 3
    trim_sources: bool = False
    max_source_tokens: int = 400
    judge_source_tokens: int = 1500
    single_call_judge: bool = True
    skip_judge_when_clean: bool = False
    vector_backend: str = "exact"
    ivf_lists: int = 64
    ivf_probes: int = 16
    llm_provider: str = ""
    llm_model: str = ""
    judge_model: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **overrides) -> Settings:
        """Fields from QUARRY_<FIELD> variables; a number that can't be read leaves the default; overrides win."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            if (raw := env.get(f"QUARRY_{f.name.upper()}")) is None:
                continue
            default = f.default
            try:
                found[f.name] = raw.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else int(raw) if isinstance(default, int) or "int" in str(f.type) else float(raw) if isinstance(default, float) else raw
            except ValueError:
                continue
        return cls(**(found | overrides))

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


def read_env_file(text: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a .env file, without comments; quotes go, and what the environment already has wins."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("export "):
            line = line[7:].lstrip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[key] = value
    return out | {k: v for k, v in (os.environ if env is None else env).items() if k in out}

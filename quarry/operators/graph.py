"""A property graph of symbols as two tables: nodes(id, qualified_name, simple_name, kind, file_path, start_line,
end_line) and edges(src, dst, type, seq), seq being the order in which edges are found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.shared import ensure_checkpoint_dir

INVERSE = {"contains": "contained_by", "calls": "called_by", "imports": "imported_by"}


def inverse(type: str = "type"):
    return reduce(lambda acc, kv: acc.when(F.col(type) == kv[0], kv[1]), INVERSE.items(), F).otherwise(F.col(type))


# ---- building


def _by_name(nodes: DataFrame) -> DataFrame:
    """(via, key, file_path, n, only): for each full (q) and last (s) name and file how many nodes have it, and one."""
    each = nodes.select(F.explode(F.array(F.struct(F.lit("q").alias("via"), F.col("qualified_name").alias("key")), F.struct(F.lit("s").alias("via"), F.col("simple_name").alias("key")))).alias("x"), "id", "file_path")
    return each.groupBy("x.via", "x.key", "file_path").agg(F.count("*").alias("n"), F.min("id").alias("only"))


def resolve(names: DataFrame, nodes: DataFrame, import_map: DataFrame | None = None) -> DataFrame:
    """names(name, file_path, ...) with the column target: the one node of that full name; of several the one in the
    same file, else the one in the files that import_map(file_path, simple_name, from_file) has for it; if no node has
    the full name, the same by its last part; null where that leaves none or several."""
    by_file = _by_name(nodes)
    totals = by_file.groupBy("via", "key").agg(F.sum("n").alias("n"), F.min("only").alias("only"))
    full = totals.where("via = 'q'").select(F.col("key").alias("name"), F.col("n").alias("n_full"))
    asked = names.join(full, "name", "left")
    asked = asked.withColumn("via", F.when(F.col("n_full").isNull(), "s").otherwise("q")).withColumn("key", F.when(F.col("n_full").isNull(), F.substring_index("name", ".", -1)).otherwise(F.col("name")))
    asked = asked.drop("n_full").join(totals, ["via", "key"], "left").withColumnsRenamed({"n": "n_all", "only": "only_all"})
    same = by_file.where("n = 1").select("via", "key", "file_path", F.col("only").alias("only_same"))
    asked = asked.join(same, ["via", "key", "file_path"], "left")
    only_imported = F.lit(None).cast("string")
    if import_map is not None:
        there = import_map.select("file_path", F.col("simple_name").alias("s"), F.col("from_file")).distinct()
        reached = by_file.withColumn("s", F.substring_index("key", ".", -1)).withColumnRenamed("file_path", "from_file").join(there, ["s", "from_file"])
        reached = reached.groupBy("via", "key", "file_path").agg(F.sum("n").alias("n_imported"), F.min("only").alias("only_imported"))
        asked = asked.join(reached, ["via", "key", "file_path"], "left")
        only_imported = F.when(F.col("n_imported") == 1, F.col("only_imported"))
    target = F.when(F.col("n_all") == 1, F.col("only_all")).otherwise(F.coalesce("only_same", only_imported))
    return asked.withColumn("target", target).drop("via", "key", "n_all", "only_all", "only_same", "n_imported", "only_imported")


def build(nodes: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """edges of nodes, calls(chunk_id, file_path, callee) and imports(chunk_id, file_path, name): contains from the one
    node named as a member's parent, imports, then calls. An edge counts once; none leads to its own start or starts
    at no node."""
    owned = nodes.where(F.contains("qualified_name", F.lit(".")) & (F.col("kind") != "module")).select(F.col("id").alias("dst"), F.regexp_replace("qualified_name", r"\.[^.]*\z", "").alias("parent"))
    single = nodes.groupBy(F.col("qualified_name").alias("parent")).agg(F.count("*").alias("n"), F.min("id").alias("src")).where("n = 1")
    contains = owned.join(single, "parent").select("src", "dst", F.lit("contains").alias("type"))

    asked = resolve(imports.select("chunk_id", "file_path", "name"), nodes)
    modules = nodes.where("kind = 'module'").groupBy("file_path").agg(F.min("id").alias("module"))
    path = F.replace(F.col("name"), F.lit("."), F.lit("/"))
    for suffix in (".py", "/__init__.py"):
        own = modules.select(F.col("file_path").alias("p"), "module")
        asked = asked.withColumn("p", F.concat(path, F.lit(suffix))).join(own, "p", "left").withColumn("target", F.coalesce("target", "module")).drop("p", "module")
    imported = asked.where("target IS NOT NULL").select(F.col("chunk_id").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("type"), "file_path")
    targets = nodes.select(F.col("id").alias("dst"), "simple_name", F.col("file_path").alias("from_file"))
    import_map = imported.join(targets, "dst").select("file_path", "simple_name", "from_file")

    called = resolve(calls.select("chunk_id", "file_path", F.col("callee").alias("name")), nodes, import_map)
    called = called.where("target IS NOT NULL").select(F.col("chunk_id").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("type"))
    every = contains.unionByName(imported.drop("file_path")).unionByName(called).where("src <> dst").distinct()
    every = every.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return every.withColumn("seq", F.xxhash64("src", "dst", "type"))


# ---- editing


def add_edges(edges: DataFrame, nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Both ends must be nodes; an edge that is there, or leads to its own start, is not added."""
    ids = nodes.select("id")
    new = more.select("src", "dst", "type").distinct().where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    new = new.join(edges, ["src", "dst", "type"], "left_anti").withColumn("seq", F.xxhash64("src", "dst", "type"))
    return edges.unionByName(new)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """gone(src, dst[, type]); without a type all edges of a pair go."""
    keys = ["src", "dst", "type"] if "type" in gone.columns else ["src", "dst"]
    return edges.join(gone.select(*keys).distinct(), keys, "left_anti")


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = nodes.join(files.select("file_path"), "file_path", "left_anti")
    ids = left.select("id")
    return left, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    nodes = a[0].join(b[0].select("id"), "id", "left_anti").unionByName(b[0])
    edges = a[1].unionByName(b[1]).groupBy("src", "dst", "type").agg(F.min("seq").alias("seq"))
    return nodes, edges


def edit_diff(edges: DataFrame, view_nodes: DataFrame, desired: DataFrame) -> DataFrame:
    """(src, dst, type, change): what makes the edges among the view's nodes those desired: added or removed."""
    ids = view_nodes.select("id").distinct()
    within = lambda e: e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()
    now, then = within(edges), within(desired)
    return then.exceptAll(now).withColumn("change", F.lit("added")).unionByName(now.exceptAll(then).withColumn("change", F.lit("removed")))


def apply_edits(edges: DataFrame, nodes: DataFrame, view_nodes: DataFrame, desired: DataFrame) -> DataFrame:
    diff = edit_diff(edges, view_nodes.join(nodes.select("id"), "id", "left_semi"), desired)
    return add_edges(remove_edges(edges, diff.where("change = 'removed'")), nodes, diff.where("change = 'added'"))


# ---- walking


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, relation, way, seq): every edge from both ends; way 0 leads out, 1 in."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("relation"), "type", F.lit(0).cast("long").alias("way"), "seq")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), inverse().alias("relation"), "type", F.lit(1).cast("long").alias("way"), "seq")
    both = out.unionByName(back)
    return both if nodes is None else both.join(nodes.select(F.col("id").alias("b")), "b", "left_semi")


def neighbours(seeds: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, depth: int = 1, relations: list[str] | None = None) -> DataFrame:
    """(query_id, seed, id, relation, distance, order) for seeds(query_id, id): what is within depth steps of each seed;
    the first way there, by distance, then the order of the ways (out before in), gives the relation."""
    adj = adjacency(edges, nodes)
    if relations is not None:
        # outward by the type alone; inward by the inverse or the type
        adj = adj.where(F.col("relation").isin(relations) | ((F.col("way") == 1) & F.col("type").isin(relations)))
    adj = adj.select("a", F.col("b").alias("id"), F.col("relation"), "way", "seq")
    start = seeds.select("query_id", F.col("id").alias("seed")).distinct()
    frontier = start.select("query_id", "seed", F.col("seed").alias("at"), F.array().cast("array<bigint>").alias("order"))
    seen = start.select("query_id", "seed", F.col("seed").alias("id"))
    out = None
    for step in range(1, max(1, depth) + 1):
        found = frontier.join(adj, F.col("at") == F.col("a")).withColumn("order", F.concat("order", F.array("way", "seq")))
        first = found.groupBy("query_id", "seed", "id").agg(F.min_by("relation", "order").alias("relation"), F.min("order").alias("order"))
        new = first.join(seen, ["query_id", "seed", "id"], "left_anti").withColumn("distance", F.lit(step))
        out = new if out is None else out.unionByName(new)
        if step < depth:
            seen = seen.unionByName(new.select("query_id", "seed", "id"))
            frontier = new.select("query_id", "seed", F.col("id").alias("at"), "order")
    return out.select("query_id", "seed", "id", "relation", "distance", "order")


def pagerank(seeds: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, iterations: int = 30, frontier: int | None = 2000, settle: float | None = 1e-9, checkpoint: bool = True) -> DataFrame:
    """(query_id, id, score): personalised PageRank of every query's seeds(query_id, id) over undirected edges; what
    reaches a node without neighbours is lost. All queries walk at once.

    With a frontier only the seeds and that many best nodes of a query go on; with settle the walk ends when the
    scores of no query change by that much in all. Each round is written to the checkpoint folder, unless the walk is a
    few rounds that make one plan."""
    pairs = adjacency(edges, nodes).select("a", "b").distinct()
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    ways = pairs.join(degree, "a")
    if checkpoint:
        ensure_checkpoint_dir(edges.sparkSession)
        ways = ways.checkpoint()
    elif settle is not None:
        raise ValueError("a walk that ends by itself needs checkpoints: without them every round runs all before it again")
    own = seeds.select("query_id", "id").distinct()
    if nodes is not None:
        own = own.join(nodes.select("id"), "id", "left_semi").select("query_id", "id")
    restart = own.withColumn("tele", F.lit(1.0) / F.count("*").over(Window.partitionBy("query_id")))
    score = restart.select("query_id", "id", F.col("tele").alias("score"))
    for i in range(iterations):
        moved = score.join(ways, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id"), (alpha * F.col("score") / F.col("degree")).alias("score"))
        again = restart.select("query_id", "id", ((1 - alpha) * F.col("tele")).alias("score"))
        new = moved.unionByName(again).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
        if frontier is not None:
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            kept = new.withColumn("r", rank).join(own.withColumn("seed", F.lit(True)), ["query_id", "id"], "left")
            new = kept.where((F.col("r") <= frontier) | F.coalesce("seed", F.lit(False))).select("query_id", "id", "score")
        if checkpoint:
            new = new.checkpoint()
        if settle is not None:
            change = new.withColumnRenamed("score", "s1").join(score.withColumnRenamed("score", "s0"), ["query_id", "id"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            score = new
            if change is None or change < settle:
                break
        score = new
    return score


# ---- retrieval


def pool_neighbours(ranked: DataFrame, edges: DataFrame, nodes: DataFrame, seeds: int = 5, depth: int = 1, budget: int = 10) -> DataFrame:
    """(query_id, id, relation, place): up to budget nodes near each query's first rows that its list does not have, in
    the order of the rows and their ways."""
    near = neighbours(ranked.where(F.col("rank") <= seeds), edges, nodes, depth)
    near = near.join(ranked.select("query_id", F.col("id").alias("seed"), F.col("rank").alias("of")), ["query_id", "seed"])
    new = near.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = new.groupBy("query_id", "id").agg(F.min(F.struct("of", "distance", "order")).alias("o"), F.min_by("relation", F.struct("of", "distance", "order")).alias("relation"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id"))
    return first.withColumn("place", place).where(F.col("place") <= budget).select("query_id", "id", "relation", "place")


def pool_pagerank(ranked: DataFrame, ppr: DataFrame, add: int = 8) -> DataFrame:
    """(query_id, id, relation, place): the best nodes by PageRank that each query's list does not have."""
    new = ppr.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return new.withColumn("place", place).where(F.col("place") <= add).select("query_id", "id", F.lit("pagerank").alias("relation"), "place")


def boosted(ranked: DataFrame, edges: DataFrame, boost: float) -> DataFrame:
    """(query_id, id, score, rank): scores plus boost times the positive scores of neighbours in the same list."""
    own = ranked.select("query_id", F.col("id").alias("other"), F.greatest("score", F.lit(0.0)).alias("s"))
    # the pairs of a list, which is a bounded pool, look up edges by both ends: a node of any degree is many keys
    pairs = ranked.select("query_id", "id").join(own, "query_id").where("id <> other")
    linked = adjacency(edges).select(F.col("a").alias("id"), F.col("b").alias("other"))
    gain = pairs.join(linked, ["id", "other"], "left_semi").groupBy("query_id", "id").agg(F.sum("s").alias("gain"))
    out = ranked.join(gain, ["query_id", "id"], "left").withColumn("score", F.round(F.col("score") + boost * F.coalesce("gain", F.lit(0.0)), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).select("query_id", "id", "score", "rank")


def context_lines(ranked: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, graph_context): a line for each neighbour of each row: label, relation, name and place."""
    near = neighbours(ranked, edges, nodes).join(ranked.select("query_id", F.col("id").alias("seed"), F.col("rank").alias("of")), ["query_id", "seed"])
    named = nodes.select("id", F.col("qualified_name").alias("name"), F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("cite"))
    label = nodes.select(F.col("id").alias("seed"), F.col("qualified_name").alias("label"))
    lines = near.join(named, "id").join(label, "seed")
    key = lines.groupBy("query_id", "label", "relation", "name").agg(F.min(F.struct("of", "order", "cite")).alias("o"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("o", "name"))
    kept = key.withColumn("place", place).where(F.col("place") <= most)
    line = F.concat(F.lit("- "), "label", F.lit(" "), "relation", F.lit(" "), "name", F.lit(" ("), F.col("o.cite"), F.lit(")"))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("graph_context"))


# ---- describing


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes, edges, and edges of each type."""
    by_type = edges.groupBy(F.concat(F.lit("edges:"), "type").alias("what")).agg(F.count("*").alias("n"))
    return nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")).unionByName(by_type)


def find(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("qualified_name") == name) | (F.col("simple_name") == name))


def subgraph(nodes: DataFrame, edges: DataFrame, focus: str | None = None, depth: int = 2, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """What is around the nodes of a name, nearest first, or else the nodes of most edges; and the edges among them."""
    if focus is not None:
        seeds = find(nodes, focus).select(F.lit(0).alias("query_id"), "id")
        near = neighbours(seeds, edges, nodes, depth).groupBy("id").agg(F.min("distance").alias("distance")).unionByName(seeds.select("id", F.lit(0).alias("distance")))
        order = near.groupBy("id").agg(F.min("distance").alias("o"))
    else:
        order = nodes.join(degrees(edges), "id", "left").select("id", (-F.coalesce("degree", F.lit(0))).alias("o"))
    kept = order.join(nodes.select("id"), "id", "left_semi").orderBy("o", "id").limit(most).select("id")
    own = nodes.join(kept, "id", "left_semi")
    inside = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own, inside


def _label(name: str = "simple_name"):
    return F.replace(F.coalesce(F.col(name), F.col("qualified_name")), F.lit('"'), F.lit("'"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line) of a Mermaid flow chart of a (small) subgraph."""
    numbered = nodes.select("id", _label().alias("label"), (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))
    at = lambda side: numbered.select(F.col("id").alias(side), F.col("k").alias(f"k_{side}"))
    boxes = numbered.select(F.lit(1).alias("part"), F.col("k").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit("").alias("o3"), F.concat(F.lit("  n"), F.col("k").cast("string"), F.lit('["'), "label", F.lit('"]')).alias("line"))
    arrows = edges.join(at("src"), "src").join(at("dst"), "dst")
    arrows = arrows.select(F.lit(2).alias("part"), F.col("k_src").cast("long").alias("o1"), F.col("k_dst").cast("long").alias("o2"), F.col("type").alias("o3"), F.concat(F.lit("  n"), F.col("k_src").cast("string"), F.lit(" -->|"), "type", F.lit("| n"), F.col("k_dst").cast("string")).alias("line"))
    head = nodes.sparkSession.createDataFrame([(0, 0, 0, "", "graph LR")], "part int, o1 long, o2 long, o3 string, line string")
    every = head.unionByName(boxes).unionByName(arrows)
    return every.select(F.row_number().over(Window.orderBy("part", "o1", "o2", "o3")).cast("long").alias("line_no"), "line")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line) of a Graphviz digraph of a (small) subgraph."""
    boxes = nodes.select(F.lit(1).alias("part"), F.col("id").alias("o1"), F.lit("").alias("o2"), F.lit("").alias("o3"), F.concat(F.lit('  "'), "id", F.lit('" [label="'), _label(), F.lit('", kind="'), "kind", F.lit('"];')).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.col("src").alias("o1"), F.col("dst").alias("o2"), F.col("type").alias("o3"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "type", F.lit('"];')).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "", "", "digraph code {"), (3, "", "", "", "}")], "part int, o1 string, o2 string, o3 string, line string")
    every = ends.unionByName(boxes).unionByName(arrows)
    return every.select(F.row_number().over(Window.orderBy("part", "o1", "o2", "o3")).cast("long").alias("line_no"), "line")

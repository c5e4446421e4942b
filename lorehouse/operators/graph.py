"""Graph operators. Frontiers are DataFrames; each step is a join with the edges and an anti-join with what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .joins import top_k


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst", "lt").distinct()
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "lt")
    return {"out": out, "in": back, "both": out.unionByName(back).distinct()}[direction]


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "out", cap: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes within `depth` steps of each seed, at their least depth. `cap` bounds what a step adds for a seed, by name. Each level is written, so that a step works on the level before and not on its plan."""
    e = cut(_oriented(edges, direction).select("src", "dst").distinct())
    seen = frontier = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")))
    for step in range(1, depth + 1):
        nxt = frontier.withColumnRenamed("node", "src").join(e, "src").select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        if cap:  # cut by task before the rows of a seed meet
            nxt = top_k(nxt, cap, ("seed",), "node").drop("rank")
        frontier = cut(nxt.withColumn("depth", F.lit(step)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def walks(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "out") -> DataFrame:
    """(seed, node, depth): every depth at which a path without repeated nodes leads from a seed to a node.

    Paths that have passed the same nodes and end at the same one go on alike, so that
    each set of nodes is followed once; a level is written before the next.
    """
    e = cut(_oriented(edges, direction).select("src", "dst").distinct())
    level = cut(seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("passed")).distinct())
    out = level.select("seed", "node", F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        nxt = level.withColumnRenamed("node", "src").join(e, "src").where(~F.array_contains("passed", F.col("dst")))
        level = cut(nxt.select("seed", F.col("dst").alias("node"), F.array_sort(F.array_append("passed", F.col("dst"))).alias("passed")).distinct())
        if not level.limit(1).count():
            break
        out = out.unionByName(level.select("seed", "node", F.lit(step).alias("depth")).distinct())
    return out


def walks_recursive(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "out") -> DataFrame:
    """What walks() gives, as one recursive query that Spark plans itself: for few seeds, as every path is a row of its own and Spark bounds the rows of a recursion (spark.sql.cteRecursionRowLimit)."""
    e = _oriented(edges, direction).select("src", "dst").distinct()
    return e.sparkSession.sql(
        f"""with recursive walk(seed, node, depth, passed) as (
              select node, node, 0, array(node) from {{seeds}}
              union all
              select seed, dst, depth + 1, array_append(passed, dst) from walk join {{e}} as e on e.src = walk.node where depth < {int(depth)} and not array_contains(passed, dst))
            select distinct seed, node, depth from walk""",
        seeds=seeds.select("node").distinct(),
        e=e,
    )


def outgoing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, to, lt): the different links out of each of some nodes (node), a row each."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "lt").distinct().join(nodes.select("node").distinct(), "node", "left_semi")


def with_outgoing(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (node, ...) with links, the sorted list of (to, lt) out of their node, empty where there are none. A list is as long as its node has links; where hubs are too large for that, outgoing() has them as rows."""
    lists = outgoing(rows, edges).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("to", "lt"))).alias("links"))
    empty = F.array().cast(lists.schema["links"].dataType)
    return rows.join(lists, "node", "left").withColumn("links", F.coalesce("links", empty))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes that lie on a cycle, and the largest node of all that lie on cycles with it.

    Nodes without a way in or out among the open ones are trimmed. Then the largest
    node that leads to each is passed forward until nothing changes, and from those
    that were passed nothing larger than themselves their own are followed back: what
    meets is a component. The rest goes round again. Each step is a join and a
    reduction by node, whatever the degree.
    """
    open_ = cut(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    out = None
    while True:
        while True:  # trim
            into, from_ = open_.select(F.col("dst").alias("node")).distinct(), open_.select(F.col("src").alias("node")).distinct()
            both = into.join(from_, "node", "left_semi")
            less = cut(open_.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            same = less.count() == open_.count()
            open_ = less
            if same:
                break
        if not open_.limit(1).count():
            break
        colour = cut(open_.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            passed = open_.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("p"))
            new = cut(colour.join(passed, "node", "left").select("node", F.greatest("c", "p").alias("c"), (F.col("p") > F.col("c")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            colour = new.drop("moved")
            if not moved:
                break
        # Back from each root, among its own colour.
        inner = cut(open_.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").where(F.col("c") == F.col("d")).select("src", "dst"))
        found = frontier = cut(colour.where(F.col("node") == F.col("c")))
        while True:
            back = inner.join(frontier.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = cut(back.join(found.select("node"), "node", "left_anti"))
            if not frontier.limit(1).count():
                break
            found = cut(found.unionByName(frontier))
        several = found.join(found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "c", "left_semi").select("node", F.col("c").alias("component"))
        out = several if out is None else out.unionByName(several)
        gone = found.select("node")
        open_ = cut(open_.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if out is None:
        return loops
    return out.unionByName(loops.join(out.select("node"), "node", "left_anti"))


def cycle_flags(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, cycles) of walks (seed, node, ...): whether some node that a walk has seen lies on a cycle of edges."""
    on = strong_components(edges).select("node", F.lit(True).alias("_on"))
    return walked.join(on, "node", "left").groupBy("seed").agg(F.coalesce(F.bool_or("_on"), F.lit(False)).alias("cycles"))


def paths(edges: DataFrame, seeds: DataFrame, depth: int, link_type: str | None = None, direction: str = "out") -> DataFrame:
    """(src, dst, lt, depth): the edges walked from any seed at each step, each once for a step."""
    e = cut(_oriented(edges if link_type is None else edges.where(F.col("lt") == link_type), direction))
    nodes = seeds.select("node").distinct()
    out = None
    for step in range(1, depth + 1):
        walked = cut(e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("depth", F.lit(step)))
        out = walked if out is None else out.unionByName(walked)
        nodes = walked.select(F.col("dst").alias("node")).distinct()
    return out


def neighbourhood(links: DataFrame, anchors: DataFrame, depth: int = 2) -> DataFrame:
    """(key, page_id, depth): pages within `depth` links of each key's anchors (key, page_id), in either direction, at their least depth, anchors left out."""
    there = links.select(F.col("from_page_id").alias("a"), F.col("to_page_id").alias("b"))
    both = cut(there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = frontier = cut(anchors.select("key", "page_id").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        nxt = frontier.select("key", F.col("page_id").alias("a")).join(both, "a").select("key", F.col("b").alias("page_id")).distinct().join(seen.select("key", "page_id"), ["key", "page_id"], "left_anti")
        frontier = cut(nxt.withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, n)."""
    e = edges.select("src", "dst", "lt").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("n"))


def callers(resolved: DataFrame, unresolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, caller, resolved): who calls each symbol, over resolved and unresolved edges."""
    both = resolved.select("src", "dst", F.lit(True).alias("resolved")).unionByName(unresolved.select("src", "dst", F.lit(False).alias("resolved")))
    return both.join(symbols.select(F.col("symbol").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("symbol"), F.col("src").alias("caller"), "resolved")


def impact_walk(edges: DataFrame, seeds: DataFrame, depth: int = 5, max_nodes: int = 1000) -> DataFrame:
    """(seed, node, depth, confidence, stopped) of a level-wise walk against the edges, with confidence max(.05, 1 / (1 + .3 d)).

    A walk holds max_nodes nodes at most, its seed among them: the level that would
    pass that is cut by name, and the walk ends; `stopped` says why walks ended:
    'nodes', 'depth' where further nodes lay beyond the last level, or 'done'. A hub's
    neighbours are cut by task before they meet.
    """
    e = cut(_oriented(edges, "in").select("src", "dst").distinct())
    seen = frontier = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    room = cut(frontier.select("seed").distinct().withColumn("room", F.lit(max_nodes - 1)))
    full = room.limit(0).select("seed")
    beyond = full
    for step in range(1, depth + 2):
        nxt = frontier.withColumnRenamed("node", "src").join(e, "src").select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        if step > depth:
            beyond = cut(nxt.select("seed").distinct())
            break
        ranked = cut(top_k(nxt, max_nodes + 1, ("seed",), "node").join(room, "seed"))  # one more shows that a bound was met
        over = ranked.where(F.col("rank") > F.col("room")).select("seed").distinct()
        frontier = cut(ranked.where(F.col("rank") <= F.col("room")).select("seed", "node", F.lit(step).alias("depth")))
        full = cut(full.unionByName(over))
        taken = frontier.groupBy("seed").agg(F.count("*").alias("n"))
        room = cut(room.join(taken, "seed").join(full, "seed", "left_anti").select("seed", (F.col("room") - F.col("n")).cast("int").alias("room")))
        seen = seen.unionByName(frontier)
        frontier = frontier.join(full, "seed", "left_anti")
    why = full.withColumn("stopped", F.lit("nodes")).unionByName(beyond.withColumn("stopped", F.lit("depth")))
    out = seen.join(why, "seed", "left").withColumn("stopped", F.coalesce("stopped", F.lit("done")))
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.05), 1 / (1 + 0.3 * F.col("depth"))), 6))


def alias_closure(aliases: DataFrame, depth: int = 4) -> DataFrame:
    """(alias, target, depth): what each alias (alias, target) leads to within `depth` steps, at the least depth."""
    level = aliases.select("alias", "target").distinct().withColumn("depth", F.lit(1))
    out = level
    step = aliases.select(F.col("alias").alias("target"), F.col("target").alias("_next")).distinct()
    for d in range(2, depth + 1):
        level = level.join(step, "target").select("alias", F.col("_next").alias("target")).where(F.col("alias") != F.col("target")).distinct().withColumn("depth", F.lit(d))
        out = out.unionByName(level)
    return out.groupBy("alias", "target").agg(F.min("depth").alias("depth"))


def merge_entities(facts: DataFrame, links: DataFrame, mapping: DataFrame, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """facts (entity_slug, ...) and links (src, dst, lt) with phantom names replaced by the end of their chain in mapping (alias, target)."""
    closed = alias_closure(mapping, depth)
    ends = closed.join(mapping.select(F.col("alias").alias("target")).distinct(), "target", "left_anti").groupBy("alias").agg(F.min_by("target", F.struct("depth", "target")).alias("canon"))
    f = facts.join(ends.withColumnRenamed("alias", "entity_slug"), "entity_slug", "left").withColumn("entity_slug", F.coalesce("canon", "entity_slug")).drop("canon")
    l = links
    for end in ("src", "dst"):
        l = l.join(ends.withColumnRenamed("alias", end), end, "left").withColumn(end, F.coalesce("canon", end)).drop("canon")
    return f, l.where(F.col("src") != F.col("dst")).distinct()

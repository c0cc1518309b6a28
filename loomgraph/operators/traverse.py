"""Bounded breadth-first traversals over a typed edge table, many seeds at once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import skew
from loomgraph.operators.lookup import resolve_names
from loomgraph.operators.skew import planned_bytes, salted_join, top_per_key
from loomgraph.session import materialize, scratch_root, scratch_scope, shuffles_removed

DEFAULT_DEPTH = 3
DEFAULT_MAX_NODES = 100

#: Traversal name -> (direction, edge kinds).
TRAVERSALS = {
    "callers": ("in", ("CALLS",)),
    "callees": ("out", ("CALLS",)),
    "impact": ("in", ("CALLS", "REFERENCES")),
    "impls": ("in", ("IMPLEMENTS",)),
    "overriders": ("in", ("OVERRIDES",)),
}


def hops(edges: DataFrame, direction: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges as (id, next) steps in the given direction."""
    if direction not in ("in", "out"):
        raise ValueError("direction must be 'in' or 'out'")
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    return edges.select(F.col(here).alias("id"), F.col(there).alias("next"))


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """One-hop neighbours (id, next) of the ids in ``nodes``."""
    return salted_join(hops(edges, direction, kinds), nodes.select("id").distinct(), ["id"], "left_semi").distinct()


#: A cap up to which a seed's state is one row with arrays: at most cap * (cap + 1) ids meet in it, mostly far fewer.
ARRAY_CAP = 500
#: Rows of one bucket of a stored adjacency, about.
BUCKET_ROWS = 100_000
#: Repositories that are named in a partition filter.
PRUNED_REPOS = 1000


def adjacency(edges: DataFrame, direction: str, kinds: Sequence[str] | None = None, max_nodes: int = DEFAULT_MAX_NODES) -> DataFrame:
    """(id, nexts): the smallest neighbours of every node in order, as many as a traversal with this cap can need.

    Those are ``max_nodes + 1``: a seed that has found n nodes may take
    ``max_nodes - n`` more, and of that many and n + 1 others at most the n and the
    seed itself are known already.  Stored as a table bucketed by id: joins on it
    shuffle the other side only.  Pass it to several traversals.
    """
    steps = hops(edges, direction, kinds).where("id IS NOT NULL AND next IS NOT NULL")
    # Steps of several kinds or repositories share a rank, so that the edges are shuffled once, by id; the set drops the repeats.
    near = top_per_key(steps, ["id"], [F.col("next")], max_nodes + 1, ties=True)
    lists = near.groupBy("id").agg(F.sort_array(F.collect_set("next")).alias("nexts"))
    spark = edges.sparkSession
    name = f"adjacency_{uuid.uuid4().hex}"
    with scratch_scope(spark), shuffles_removed(spark):
        lists = materialize(lists, "neighbours")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lists.count() // BUCKET_ROWS))
        (
            lists.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id")
            .option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
        )
    return spark.table(name)


def _bounds(depth: int, max_nodes: int | None) -> tuple[int, int | None]:
    """Depth and cap of a traversal; non-positive ones mean the defaults."""
    return depth if depth > 0 else DEFAULT_DEPTH, DEFAULT_MAX_NODES if max_nodes is not None and max_nodes <= 0 else max_nodes


def nearest_ids(graph: DataFrame, seeds: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """Capped traversal over an adjacency: (seed, depth, ids), the ids found at each depth in one row.

    A state row holds what a level adds; what a seed knows from before stays in it
    only while the seed is open, that is not full and with a frontier.
    """
    state = seeds.select(F.col("seed").cast("long").alias("seed")).where("seed IS NOT NULL").distinct()
    none = F.array().cast("array<bigint>")
    state = materialize(state.select("seed", none.alias("known"), F.array("seed").alias("taken")), "bfs-seeds")
    levels = []
    for level in range(1, depth + 1):
        state = _next_level(graph, state, max_nodes + 1, level, level == depth)
        levels.append(state.select("seed", F.lit(level).alias("depth"), F.col("taken").alias("ids")))
        if level < depth and state.where("known IS NOT NULL").isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _next_level(graph: DataFrame, state: DataFrame, most: int, level: int, last: bool) -> DataFrame:
    """The next state (seed, known, taken) of the open seeds; ``most`` ids, the seed among them, make a seed full.

    A seed takes the smallest new ids of its frontier's sorted lists, so every list
    first sends its head, somewhat more than its share of what the seed may take.
    The last id a seed would take of the heads bounds what it can take at all; only
    seeds one of whose cut lists ends below that bound fetch the rest up to it.
    """
    held = F.concat("known", "taken")
    room = F.lit(most) - F.size("held")
    share = room / F.size("taken")
    head = F.least(F.ceil(share + 3 * F.sqrt(share)) + 1, F.lit(most)).cast("int")
    open_ = state.where("known IS NOT NULL").withColumn("held", held).select("seed", "held", "taken", head.alias("head"))
    heads = open_.select("seed", "head", F.explode("taken").alias("id")).join(graph, "id").select(
        "seed", F.slice("nexts", F.lit(1), F.col("head")).alias("part"),
        F.when(F.size("nexts") > F.col("head"), F.get("nexts", F.col("head") - 1)).alias("cut"),
    )
    first = _gathered(heads, F.min("cut").alias("cut")).join(open_, "seed").withColumn("found", _smallest("reached", room))
    bound = F.get("found", room - 1)
    more = F.col("cut").isNotNull() & (bound.isNull() | (F.col("cut") < bound))
    goes_on = (F.size("found") > 0) & (F.size("held") + F.size("found") < most) & F.lit(not last)
    # what a seed holds is kept for the seeds that need it: those that fetch more, and those open at the next level
    first = materialize(
        first.withColumn("more", more).select(
            "seed", "more", F.when(F.col("more") | goes_on, F.col("held")).alias("held"), "found", bound.alias("bound"),
            F.when(F.col("more"), F.col("taken")).alias("taken"), F.when(F.col("more"), F.col("head")).alias("head"),
        ),
        f"bfs-level{level}",
    )
    done = first.where("NOT more").select("seed", F.col("held").alias("known"), F.col("found").alias("taken"))
    again = first.where("more")
    if again.isEmpty():
        return done
    tails = again.select("seed", "head", "bound", F.explode("taken").alias("id")).join(graph, "id").select(
        "seed", F.filter(F.slice("nexts", F.col("head") + 1, F.lit(most)), lambda i: F.col("bound").isNull() | (i < F.col("bound"))).alias("part")
    )
    rest = again.join(_gathered(tails.where(F.size("part") > 0)), "seed", "left")
    both = F.concat("found", F.coalesce("reached", F.array().cast("array<bigint>")))
    rest = rest.withColumn("found", _smallest(both, room)).select(
        "seed", F.when(goes_on, F.col("held")).alias("known"), F.col("found").alias("taken")
    )
    return done.unionByName(materialize(rest, f"bfs-rest{level}"))


def _gathered(parts: DataFrame, *more: Column) -> DataFrame:
    """What the lists of a seed sent, in one row: (seed, reached); no two tasks hold parts of a seed, so nothing is gathered twice."""
    return parts.repartition("seed").groupBy("seed").agg(F.flatten(F.collect_list("part")).alias("reached"), *more)


def _smallest(ids: Column | str, room: Column) -> Column:
    """The ``room`` smallest of the ids that are not in ``held``, in order."""
    return F.slice(F.sort_array(F.array_except(ids, "held")), F.lit(1), room)


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = "out",
    kinds: Sequence[str] | None = None,
    depth: int = DEFAULT_DEPTH,
    max_nodes: int | None = DEFAULT_MAX_NODES,
    graph: DataFrame | None = None,
) -> DataFrame:
    """Nodes reachable from every seed: (seed, id, depth), the seed itself excluded.

    ``seeds`` has a column ``seed``.  A node keeps its smallest depth.  With
    ``max_nodes`` each seed returns its first nodes by (depth, id); ``None``
    returns all of them.  Non-positive bounds mean the defaults.

    A capped traversal reads the edges once, into an ``adjacency`` (or takes one
    that is stored, ``graph``, made with this direction, these kinds and a cap no
    smaller); every level is a join with it and one row per seed, so that a hub
    costs no more than the cap.  Other traversals join the edges level by level.
    """
    depth, max_nodes = _bounds(depth, max_nodes)
    if max_nodes is not None and max_nodes <= ARRAY_CAP:
        graph = graph if graph is not None else adjacency(edges, direction, kinds, max_nodes)
        return nearest_ids(graph, seeds, depth, max_nodes).select("seed", F.explode("ids").alias("id"), "depth")
    return _bfs_rows(edges, seeds, direction, kinds, depth, max_nodes)


def _bfs_rows(
    edges: DataFrame, seeds: DataFrame, direction: str, kinds: Sequence[str] | None, depth: int, max_nodes: int | None,
) -> DataFrame:
    """The traversal with a row per seed and node; a join of the frontier with the edges per level.

    A bounded traversal never needs more than ``max_nodes * (depth + 1) + 1``
    smallest neighbours of one node: at most that many can be taken already.
    """
    steps = hops(edges, direction, kinds)
    hubs = None
    if planned_bytes(steps) >= skew.SMALL_BYTES:
        hubs = materialize(skew.hot_keys(steps.select("id"), ["id"]), "bfs-hubs")
    frontier = materialize(seeds.select("seed", F.col("seed").alias("id")).distinct(), "bfs-seeds")
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        if max_nodes is None:
            reached = salted_join(steps, frontier, ["id"], hot=hubs)
        else:
            touched = salted_join(steps, frontier.select("id").distinct(), ["id"], "left_semi", hot=hubs)
            nearest = top_per_key(touched, ["id"], [F.col("next")], max_nodes * (depth + 1) + 1, ties=True)
            reached = nearest.join(frontier, "id")
        fresh = (
            reached.select("seed", F.col("next").alias("id"))
            .distinct()
            .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        )
        if max_nodes is not None:
            fresh = top_per_key(fresh, ["seed"], [F.col("id")], max_nodes)
        frontier = materialize(fresh, f"bfs-level{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
        if max_nodes is not None and level < depth:
            # Seeds that have all their nodes go no further.
            full = seen.where("depth > 0").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_nodes)
            frontier = materialize(frontier.join(full, "seed", "left_anti"), f"bfs-open{level}")
            if frontier.isEmpty():
                break
    found = seen.where("depth > 0")
    if max_nodes is not None:
        found = top_per_key(found, ["seed"], [F.col("depth"), F.col("id")], max_nodes)
    return found


def hydrate(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attach the public symbol fields; ids without a symbol are dropped."""
    fields = symbols.select(
        "id", "lang", "kind", "name",
        F.coalesce("fqn", F.lit("")).alias("fqn"),
    )
    return reached.join(fields, "id")


def traverse(
    name: str,
    symbols: DataFrame,
    edges: DataFrame,
    queries: DataFrame,
    depth: int = DEFAULT_DEPTH,
    max_nodes: int | None = DEFAULT_MAX_NODES,
    graph: DataFrame | None = None,
) -> DataFrame:
    """A named traversal for many (repo_id, query) names or FQNs in one run.

    Returns (repo_id, query, seed, id, depth, lang, kind, name, fqn).  Queries
    that do not resolve to one symbol give no rows; ``resolve_names`` tells why.
    ``graph`` is a stored adjacency for ``bfs``, of the traversal's direction and kinds.
    """
    direction, kinds = TRAVERSALS[name]
    resolved = materialize(
        resolve_names(symbols, queries)
        .where("symbol_id IS NOT NULL")
        .select("repo_id", "query", F.col("symbol_id").alias("seed")),
        "traverse-seeds",
    )
    depth, max_nodes = _bounds(depth, max_nodes)
    if max_nodes is None or max_nodes > ARRAY_CAP:
        reached = bfs(_of_repos(edges, resolved), resolved.select("seed"), direction, kinds, depth, max_nodes)
        return hydrate(reached, symbols).join(resolved, "seed")
    graph = graph if graph is not None else adjacency(_of_repos(edges, resolved), direction, kinds, max_nodes)
    # queries meet the arrays of their seed, so that a row per node is shuffled once, by its id
    found = nearest_ids(graph, resolved.select("seed"), depth, max_nodes).join(resolved, "seed")
    return hydrate(found.select("repo_id", "query", "seed", F.explode("ids").alias("id"), "depth"), symbols)


def _of_repos(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges of the seeds' repositories, if these are few enough to be named: other partitions are not read."""
    ids = [r.repo_id for r in seeds.select("repo_id").distinct().limit(PRUNED_REPOS + 1).collect()]
    return edges.where(F.col("repo_id").isin(*ids)) if len(ids) <= PRUNED_REPOS else edges


def ego_network(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch the ids in ``nodes``, tagged with the node (id, kind, src, dst)."""
    wanted = nodes.select("id").distinct()
    ends = edges.select(
        "kind", "src", "dst",
        F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"),
    )
    return salted_join(ends, wanted, ["id"]).select("id", "kind", "src", "dst")


def ego_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node itself and both ends of the edges touching it: (id, member)."""
    around = ego_network(edges, nodes).select("id", F.explode(F.array("src", "dst")).alias("member"))
    return around.unionByName(nodes.select("id", F.col("id").alias("member"))).distinct()


def tree_lines(nodes: DataFrame) -> DataFrame:
    """Indented display line per reached node."""
    return nodes.withColumn(
        "line",
        F.concat(F.expr("repeat('  ', depth)"), F.lit("["), F.col("kind"), F.lit("] "), F.col("fqn")),
    )

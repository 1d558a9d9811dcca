"""Lineage: lookups by parent_id and typed edges.

Closures are frontier loops: each round joins what is new with the edges and drops what is known; rounds are cut by
written tables, and the driver learns only whether anything is left. Before a loop, paths of nodes with one edge in and
one out are contracted to single edges by pointer doubling, so long chains take rounds by the logarithm of their length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import replaced, small_join, written

DEPENDS, SUPERSEDES = "depends_on", "supersedes"


def with_parent(df: DataFrame, columns: list[str] = ["title", "status"]) -> DataFrame:  # noqa: B006
    """Each decision with its parent's columns as parent_<name>, null where the parent is missing."""
    parents = df.select("tenant_id", F.col("id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns], F.lit(True).alias("_p"))
    return df.join(parents, ["tenant_id", "parent_id"], "left").withColumn("has_parent", F.coalesce("_p", F.lit(False))).drop("_p")


def child_counts(df: DataFrame) -> DataFrame:
    """Direct impact: children per parent."""
    return df.filter(F.col("parent_id").isNotNull()).groupBy("tenant_id", F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))


def direct_impact(df: DataFrame, ids: list | DataFrame) -> DataFrame:
    """The same for the asked ids: a short list, or a table with id."""
    if isinstance(ids, DataFrame):
        return child_counts(df.join(ids.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi"))
    return child_counts(df.filter(F.col("parent_id").isin(ids)))


def with_children(df: DataFrame) -> DataFrame:
    """Each decision with the sorted ids of its children (J02). A parent's list is as long as it has children."""
    lists = df.filter(F.col("parent_id").isNotNull()).groupBy("tenant_id", F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))
    return df.join(lists, ["tenant_id", "id"], "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def register(ids: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) of the asked ids."""
    keys = df.select("tenant_id", "id").distinct()
    return ids.join(keys, ["tenant_id", "id"], "left_semi"), ids.join(keys, ["tenant_id", "id"], "left_anti")


def children(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dependent): who depends on the ids."""
    by = _tenant_of(edges)
    own = edges.filter(F.col("edge_type") == DEPENDS)
    return own.join(ids.select(*by, F.col("id").alias("to_id")).distinct(), [*by, "to_id"]).select(*by, F.col("to_id").alias("id"), F.col("from_id").alias("dependent"))


def parents(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dependency): what the ids depend on."""
    by = _tenant_of(edges)
    own = edges.filter(F.col("edge_type") == DEPENDS)
    return own.join(ids.select(*by, F.col("id").alias("from_id")).distinct(), [*by, "from_id"]).select(*by, F.col("from_id").alias("id"), F.col("to_id").alias("dependency"))


class Contracted(NamedTuple):
    """Edges after paths have become single edges, and where the nodes of the paths went."""

    #: (src, dst, w): the edges between nodes that stay, of several between two nodes the lightest.
    edges: DataFrame
    #: (node, head, tail, offset): the paths' nodes, the edge that each is on, and its distance from the head.
    inner: DataFrame
    #: (node): nodes of cycles that nothing else touches.
    rings: DataFrame


def contracted(edges: DataFrame, fixed: DataFrame | None = None) -> Contracted | None:
    """Contracts edges (src, dst, w), each pair once; nodes of ``fixed`` (node) stay. None if no two such nodes follow each other: then rounds would at best be halved.

    Each path node points to the next; pointers are doubled until all point to the last node of their path. Those
    that never do are on a ring. A table has a row a node or an edge.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_o"), F.min("dst").alias("next"), F.min("w").alias("far")).filter("_o = 1")
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_i")).filter("_i = 1")
    able = outs.join(ins, "node").select("node", "next", "far")
    able = written(able if fixed is None else able.join(fixed.select("node").distinct(), "node", "left_anti"))
    onward = able.select(F.col("node").alias("next"), F.lit(True).alias("_goes"))
    step = able.join(onward, "next", "left").select("node", F.coalesce("_goes", F.lit(False)).alias("goes"), "next", "far")
    n = step.filter("goes").count() + 1
    if n == 1:
        return None
    # to: the furthest path node known, d: how far it is, ended: whether the path ends there.
    jump = written(step.select("node", F.when(F.col("goes"), F.col("next")).otherwise(F.col("node")).alias("to"), F.when(F.col("goes"), F.col("far")).otherwise(F.lit(0)).cast("long").alias("d"), (~F.col("goes")).alias("ended")))
    ends = jump.filter("ended").select("node").withColumn("_last", F.lit(True))
    jump = written(jump.drop("ended").join(ends.withColumnRenamed("node", "to"), "to", "left").select("node", "to", "d", F.coalesce("_last", F.lit(False)).alias("ended")))
    reached = 1
    while reached < n and not jump.filter("NOT ended").isEmpty():
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("ended").alias("_e"))
        jump = replaced(jump.join(on, "to").select("node", F.col("_to").alias("to"), (F.col("d") + F.col("_d")).alias("d"), (F.col("ended") | F.col("_e")).alias("ended")), jump)
        reached *= 2
    rings = jump.filter("NOT ended").select("node")
    paths = jump.filter("ended").join(able.select(F.col("node").alias("to"), F.col("next").alias("tail"), F.col("far").alias("last")), "to").select("node", "to", "d", "tail", "last")
    known = able.select(F.col("node").alias("src"))
    outer = edges.join(known, "src", "left_anti")
    entering = written(outer.join(paths.withColumnRenamed("node", "dst"), "dst").select("src", "to", "tail", "w", "d", "last"))
    short = outer.join(able.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "w")
    new = written(short.unionByName(entering.select("src", F.col("tail").alias("dst"), (F.col("w") + F.col("d") + F.col("last")).alias("w"))).groupBy("src", "dst").agg(F.min("w").alias("w")))
    inner = written(paths.join(entering.select(F.col("src").alias("head"), "to", (F.col("w") + F.col("d")).alias("_all")), "to").select("node", "head", "tail", (F.col("_all") - F.col("d")).alias("offset")))
    return Contracted(new, inner, rings)


def reach(edges: DataFrame, seeds: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, seed, id, depth): all that is reached from each seed along edges (by, src, dst), at its least depth; the seed itself only by a cycle, with depth of that cycle.

    Edges join only seeds with the same ``by`` columns (the tenant, where ids are a tenant's own). Paths are contracted
    first, seeds left as they are; what a round finds is appended, and the nodes of paths come in at the end.
    """
    node = lambda c: F.struct(*by, F.col(c).alias("_id"))
    steps = written(edges.select(node("src").alias("src"), node("dst").alias("dst"), F.lit(1).cast("long").alias("w")).distinct())
    starts = written(seeds.select(node("seed").alias("node"), "seed").distinct())
    short = contracted(steps, starts)
    step = short.edges if short else steps
    front = written(small_join(step, starts.select(F.col("node").alias("src"), "seed"), ["src"]).groupBy("seed", F.col("src").alias("root"), F.col("dst").alias("node")).agg(F.min("w").alias("depth")))
    found = [front]
    while not front.isEmpty():
        near = step.join(front.select("seed", "root", F.col("node").alias("src"), "depth"), "src").groupBy("seed", "root", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        known = reduce(DataFrame.unionByName, found).select("seed", "root", "node", F.col("depth").alias("_had"))
        better = near.join(known.groupBy("seed", "root", "node").agg(F.min("_had").alias("_had")), ["seed", "root", "node"], "left").filter("_had IS NULL OR depth < _had").drop("_had")
        front = written(better)
        found.append(front)
    every = reduce(DataFrame.unionByName, found).groupBy("seed", "root", "node").agg(F.min("depth").alias("depth"))
    if short:
        heads = written(every).unionByName(starts.select("seed", F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth"))).groupBy("seed", "root", "node").agg(F.min("depth").alias("depth"))
        along = short.inner.join(heads.withColumnRenamed("node", "head"), "head").select("seed", "root", "node", (F.col("depth") + F.col("offset")).alias("depth"))
        every = every.unionByName(along)
    return every.select(*[F.col(f"root.{c}").alias(c) for c in by], "seed", F.col("node._id").alias("id"), F.col("depth").cast("int").alias("depth"))


def impact_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) of transitive dependents over depends_on edges (G08). ``seeds`` has id. Edges with a tenant_id stay within it, and so do seeds, which then have one too."""
    by = _tenant_of(edges)
    own = edges.filter(F.col("edge_type") == DEPENDS).select(*by, F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return reach(own, seeds.select(*by, F.col("id").alias("seed")), by).filter("id <> seed")


def _tenant_of(df: DataFrame) -> list[str]:
    return ["tenant_id"] if "tenant_id" in df.columns else []


def impact_set(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tenant_id, seed, id, depth) by parent_id, without the seed (G09). ``seeds`` has tenant_id and id: an id is a tenant's own."""
    own = df.filter(F.col("parent_id").isNotNull()).select("tenant_id", F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return reach(own, seeds.select("tenant_id", F.col("id").alias("seed")), ["tenant_id"]).filter("id <> seed")


def _walk(links: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, pos, member): the path from each start along the function id -> next, the start at 0; stops before an id that it had.

    First each id's successor 1, 2, 4, ... steps on, one table each, of one row an id at most. Then, from the largest
    step down, each known place of a start's path gets the place that step further: so only the asked paths are
    built, and rounds grow with the logarithm of the length. A place is kept once a path, its first, so cycles end.
    """
    jump = written(links.select(*by, F.col("id").alias("member"), F.col("next").alias("to")))
    n, jumps = jump.count(), []
    while not jump.isEmpty() and 1 << len(jumps) <= n:
        jumps.append(jump)
        jump = written(jump.join(jump.select(*by, F.col("member").alias("to"), F.col("to").alias("_then")), [*by, "to"]).select(*by, "member", F.col("_then").alias("to")))
    path = starts.select(*by, "id", F.lit(0).cast("long").alias("pos"), F.col("id").alias("member")).distinct()
    for k in range(len(jumps) - 1, -1, -1):
        more = path.join(jumps[k], [*by, "member"]).select(*by, "id", (F.col("pos") + (1 << k)).alias("pos"), F.col("to").alias("member"))
        path = written(path.unionByName(more).groupBy(*by, "id", "member").agg(F.min("pos").alias("pos")).select(*by, "id", "pos", "member"))
    return path.withColumn("pos", F.col("pos").cast("int"))


def superseding_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """From each start along its first incoming supersedes edge (by created_at, from_id) and on."""
    by = _tenant_of(edges)
    own = edges.filter(F.col("edge_type") == SUPERSEDES)
    links = own.groupBy(*by, F.col("to_id").alias("id")).agg(F.min(F.struct("created_at", "from_id")).alias("m")).select(*by, "id", F.col("m.from_id").alias("next"))
    return _walk(links, starts, by)


def ancestor_chain(df: DataFrame, starts: DataFrame) -> DataFrame:
    """[self, parent, grandparent ...] as (tenant_id, id, pos, member); ends at a parent that its tenant does not have (G07). ``starts`` has tenant_id and id."""
    ids = df.select("tenant_id", F.col("id").alias("parent_id")).distinct()
    links = df.filter(F.col("parent_id").isNotNull()).join(ids, ["tenant_id", "parent_id"], "left_semi").select("tenant_id", "id", F.col("parent_id").alias("next"))
    return _walk(links, starts, ["tenant_id"])


def lineage_view(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Decision, parent and children."""
    asked = ids.select("tenant_id", "id").distinct()
    kids = df.join(asked.select("tenant_id", F.col("id").alias("parent_id")), ["tenant_id", "parent_id"], "left_semi")
    lists = kids.groupBy("tenant_id", F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))
    own = df.join(asked, ["tenant_id", "id"], "left_semi")
    found = own.join(df.select("tenant_id", F.col("id").alias("parent_id"), F.col("title").alias("parent_title")), ["tenant_id", "parent_id"], "left").join(lists, ["tenant_id", "id"], "left")
    return found.select("tenant_id", "id", "title", "parent_id", "parent_title", F.coalesce(F.array_join(F.transform("children", lambda x: x.cast("string")), ","), F.lit("")).alias("children"))


def lineage(df: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The full record of each asked (tenant_id, id): view, dependencies, dependents, ancestors and the size of its impact (G10). Edges without a tenant_id count for every tenant."""
    view = lineage_view(df, ids)

    def listed(rows: DataFrame, value: str, name: str, order: str | None = None) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(*dict.fromkeys((order or value, value)))))
        return rows.groupBy(*_tenant_of(rows), "id").agg(F.array_join(F.transform(items, lambda x: x[value].cast("string")), ",").alias(name))

    parts = [
        listed(parents(edges, ids).distinct(), "dependency", "dependencies"),
        listed(children(edges, ids).distinct(), "dependent", "dependents"),
        listed(ancestor_chain(df, ids), "member", "ancestors", "pos"),
        impact_set(df, ids).groupBy("tenant_id", F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("impact")),
    ]
    for p in parts:
        view = view.join(p, [*_tenant_of(p), "id"], "left")
    return view.withColumns({c: F.coalesce(c, F.lit("")) for c in ("dependencies", "dependents", "ancestors")} | {"impact": F.coalesce("impact", F.lit(0))})


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges, once each, with reject_reason (null: accepted): self edges, edges there already, and edges on a cycle.

    An edge is on a cycle if its start is reached from its end over existing and new edges of any type. The rule
    does not depend on the order of a batch.
    """
    key = ["from_id", "to_id", "edge_type"]
    fresh = new.dropDuplicates(key)
    known = edges.select(*key).distinct().withColumn("_known", F.lit(True))
    fresh = written(fresh.join(known, key, "left"))
    every = edges.select("from_id", "to_id").unionByName(fresh.select("from_id", "to_id")).filter("from_id <> to_id").distinct()
    cyclic = cycle_edges(every)
    hit = fresh.join(cyclic.withColumn("_cycle", F.lit(True)), ["from_id", "to_id"], "left")
    why = F.when(F.col("from_id") == F.col("to_id"), "self_edge").when(F.col("_known"), "duplicate").when(F.col("_cycle"), "cycle")
    return hit.withColumn("reject_reason", why).select(*new.columns, "reject_reason")


def _reduced(edges: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The edges (from_id, to_id) without nodes that lack edges in or out, and with paths as single edges, again and again until neither is left.

    Also gives a function that brings edges of the result back to the given ones they stand for; rings that were
    contracted to nothing come back with them. A path from a node to itself stays as a self edge.
    """
    left, levels = written(edges.select("from_id", "to_id").distinct()), []
    n = left.count()
    while n:
        both = left.select(F.col("from_id").alias("n")).distinct().join(left.select(F.col("to_id").alias("n")).distinct(), "n", "left_semi")
        peeled = written(left.join(both.withColumnRenamed("n", "from_id"), "from_id", "left_semi").join(both.withColumnRenamed("n", "to_id"), "to_id", "left_semi").select("from_id", "to_id"))
        m = peeled.count()
        short = contracted(peeled.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit(1).cast("long").alias("w"))) if m else None
        if short is None:
            left = peeled
            if m == n:
                break
            n = m
            continue
        on = short.inner.select("node", "head", "tail")
        mapped = peeled.join(on.select(F.col("node").alias("to_id"), F.col("head").alias("_h1"), F.col("tail").alias("_t1")), "to_id", "left").join(on.select(F.col("node").alias("from_id"), F.col("head").alias("_h2"), F.col("tail").alias("_t2")), "from_id", "left").join(short.rings.select(F.col("node").alias("from_id"), F.lit(True).alias("_ring")), "from_id", "left")
        levels.append(written(mapped.select("from_id", "to_id", F.coalesce("_h1", "_h2", "from_id").alias("_f"), F.coalesce("_t1", "_t2", "to_id").alias("_t"), F.coalesce("_ring", F.lit(False)).alias("_ring"))))
        left, n = short.edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), short.edges.count()

    def back(found: DataFrame) -> DataFrame:
        for level in reversed(levels):
            hit = level.join(found.select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t")).distinct(), ["_f", "_t"], "left_semi")
            found = hit.filter("NOT _ring").unionByName(level.filter("_ring")).select("from_id", "to_id")
        return found

    return left, back


def core(edges: DataFrame) -> DataFrame:
    """The edges (from_id, to_id) left when nodes without incoming or without outgoing edges go, again and again (G13). Self edges do not count."""
    left, back = _reduced(edges.filter("from_id <> to_id"))
    return back(left)


def validate(edges: DataFrame) -> DataFrame:
    """Nodes on cycles or on paths between cycles; none means the graph is acyclic."""
    rest = core(edges)
    return rest.select(F.col("from_id").alias("id")).unionByName(rest.select(F.col("to_id").alias("id"))).distinct()


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) that lie on a cycle: those whose ends are in one strongly connected component. Self edges do not count.

    Each round colours every node of what is left, after :func:`_reduced`, with the smallest node that reaches it, and
    takes as components the nodes of a colour that reach the node it is named after. Edges between colours are on no
    cycle and go. Tables have a row a node or an edge, never one a pair of nodes.
    """
    left, back = _reduced(edges.filter("from_id <> to_id"))
    found = written(left.filter("from_id = to_id"))  # paths from a node to itself
    left = left.filter("from_id <> to_id")
    if not left.isEmpty():
        ends = left.select(F.col("from_id").alias("id")).unionByName(left.select(F.col("to_id").alias("id"))).distinct()
        colours = _spread(left.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), written(ends.withColumn("label", F.col("id"))))
        from_, to = (colours.select(F.col("id").alias(f"{e}_id"), F.col("label").alias(f"_{e}")) for e in ("from", "to"))
        within = written(left.join(from_, "from_id").join(to, "to_id").filter("_from = _to").select("from_id", "to_id", F.col("_from").alias("colour")))
        # Backwards inside each colour: 0 marks what reaches the node that gives the colour its name.
        start = colours.join(within.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct(), "id", "left_semi")
        marks = _spread(within.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")), written(start.select("id", F.when(F.col("id") == F.col("label"), 0).otherwise(1).alias("label"))))
        inside = written(marks.filter("label = 0").select("id"))
        hit = within.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(inside.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id")
        rest = written(within.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(inside.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
        found = found.unionByName(hit)
        if not rest.isEmpty():
            found = found.unionByName(cycle_edges(rest))
        found = written(found)
    return back(found)


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) after labels have gone along edges (src, dst) until each node has the smallest that reaches it. Only nodes whose label fell send it on."""
    changed, past = labels, None
    while not changed.isEmpty():
        sent = edges.join(changed.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("_new"))
        step = replaced(labels.join(sent, "id", "left").withColumn("_fell", F.coalesce(F.col("_new") < F.col("label"), F.lit(False))).select("id", F.when(F.col("_fell"), F.col("_new")).otherwise(F.col("label")).alias("label"), "_fell"), past)
        past = step
        labels, changed = step.drop("_fell"), step.filter("_fell").drop("_fell")
    return labels


def node_count(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("n")).unionByName(edges.select(F.col("to_id").alias("n"))).distinct().agg(F.count(F.lit(1)).alias("nodes"))


def check_limit(edges: DataFrame, max_nodes: int = 1000) -> DataFrame:
    """nodes and whether they are within the limit."""
    return node_count(edges).withColumn("within_limit", F.col("nodes") <= max_nodes)


def remove_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges without those that touch the ids."""
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns)

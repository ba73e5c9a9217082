"""Dependency graphs over chunks and mapping stages (family C, F36).

Graphs are edge tables ``(group, src, dst)``, one graph per group (script or
mapping). Two forms share one result (level, on or behind a cycle):

* the whole graph in one row (a parsed mapping, the edges of a script up to
  ``ROW_EDGES``): reach sets as bit arrays, folded with higher-order functions.
  No rounds, and for a mapping no shuffle.
* edges over many rows (larger groups): longest paths by doubling, all groups at
  once. Round k knows the longest path of up to 2**k edges between any two
  nodes, so a chain of n nodes takes log2(n) rounds. A group leaves the loop when
  its longest open path is shorter than 2**k. Each round is written to the
  shared checkpoint folder, so a lost executor recomputes one round, not the loop.

Groups without edges enter neither: all their nodes have level 0.

The known paths of a group are at most its nodes squared: meant for the chunks
of a script or the stages of a mapping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryman.functions.text import let
from ferryman.session import materialize

# fixed value: the definition test is case-sensitive, the name pattern is not
# (?U): \w and \s as Python's (Unicode letters), not Java's ASCII default
MACRO_NAME_RE = r"(?iU)%MACRO\s+(\w+)"


def macro_defs(chunks: DataFrame, group: str = "script_id", seq: str = "seq", code: str = "code") -> DataFrame:
    """A chunk holding both ``%MACRO`` and ``%MEND`` defines its first macro
    name; a name defined again is owned by the last such chunk."""
    c = F.col(code)
    d = chunks.filter(c.contains("%MACRO") & c.contains("%MEND")) \
        .select(group, seq, F.regexp_extract(c, MACRO_NAME_RE, 1).alias("name")) \
        .filter(F.col("name") != "")
    return d.groupBy(group, "name").agg(F.max(seq).alias("def_seq"))


def percent_tokens(code: Column) -> Column:
    """The distinct word runs behind a ``%``. Cut at the ``%`` signs: linear in
    the text, where extracting all matches copies the text for each match."""
    parts = F.split(code, "%")
    words = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_extract(p, r"^((?U)\w*)", 1))
    return F.array_remove(F.array_distinct(words), "")


def name_tree(defs: Column) -> Column:
    """A prefix tree of names, flat: ``(name, def_seq, up)`` in code-point order,
    ``up`` the place (from 1) of the longest other name that begins this one, 0 if
    none. In this order the names above a name are the last ones that begin it, so each
    finds its own by walking up from the name before it."""
    start = F.array().cast("array<struct<name:string,def_seq:int,up:int>>")

    def above(done: Column, name: Column) -> Column:
        # from the previous name upwards to the first that begins this one
        walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(done), F.lit(1))), F.size(done),
                           lambda at, _: F.when((at > 0) & ~F.startswith(name, F.element_at(done, F.greatest(at, F.lit(1)))["name"]),
                                                F.element_at(done, F.greatest(at, F.lit(1)))["up"]).otherwise(at))
        return F.when(F.size(done) > 0, walk).otherwise(F.lit(0))

    return F.aggregate(F.array_sort(defs), start, lambda done, d: F.concat(done, F.array(F.struct(
        d["name"].alias("name"), d["def_seq"].cast("int").alias("def_seq"), above(done, d["name"]).alias("up")))))


def names_in(tree: Column, token: Column, steps: int = 20) -> Column:
    """``def_seq`` of every name that begins ``token``: the last name not behind
    the token is found by halving (``steps`` of them, 2**steps names), then the tree is walked up."""
    n = F.size(tree)
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda r, _: let(F.floor((r["lo"] + r["hi"] + 1) / 2).cast("int"), lambda mid: F.when(
            r["lo"] >= r["hi"], r).when(
            F.element_at(tree, F.greatest(mid, F.lit(1)))["name"] <= token, F.struct(mid.alias("lo"), r["hi"].alias("hi"))).otherwise(
            F.struct(r["lo"].alias("lo"), (mid - 1).alias("hi")))))["lo"]
    # a token has at most its length of names that begin it; the walk passes over names that share only a part
    start = F.struct(halved.alias("at"), F.array().cast("array<int>").alias("found"))
    walked = F.aggregate(
        F.sequence(F.lit(1), n), start,
        lambda w, _: F.when(w["at"] == 0, w).otherwise(let(F.element_at(tree, F.greatest(w["at"], F.lit(1))), lambda e: F.struct(
            e["up"].alias("at"), F.when(F.startswith(token, e["name"]), F.array_append(w["found"], e["def_seq"])).otherwise(w["found"]).alias("found")))))
    return F.when(n > 0, walked["found"]).otherwise(F.array().cast("array<int>"))


def macro_edges(chunks: DataFrame, defs: DataFrame, group: str = "script_id", seq: str = "seq",
                code: str = "code") -> DataFrame:
    """Edge definer -> chunk when the chunk text contains ``%name``.

    ``%name`` occurs in a text iff some ``%``-token (maximal word run after a
    ``%``) begins with ``name``. The names of a script make one prefix tree, which
    each token walks: only matches leave the row, whatever the length of the
    tokens. Chunks of scripts without definitions drop out at the join. An edge
    comes once for each row of its chunk.
    """
    trees = defs.groupBy(group).agg(name_tree(F.collect_list(F.struct("name", "def_seq"))).alias("tree"))
    toks = chunks.select(group, F.col(seq).alias("dst"), percent_tokens(F.col(code)).alias("toks")).filter(F.size("toks") > 0)
    found = F.array_distinct(F.flatten(F.transform("toks", lambda t: names_in(F.col("tree"), t))))
    met = toks.join(trees, group).select(group, F.explode(found).alias("src"), "dst")
    return met.filter(F.col("src") != F.col("dst"))


def _squared(paths: DataFrame, group: str) -> DataFrame:
    """Paths joined end to start: ``(group, up, node, len)``, the longest first-to-last."""
    a, b = paths.alias("a"), paths.alias("b")
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.node") == F.col("b.up"))) \
        .select(F.col(f"a.{group}").alias(group), F.col("a.up"), F.col("b.node"), (F.col("a.len") + F.col("b.len")).alias("len"))
    return paths.unionByName(both).groupBy(group, "up", "node").agg(F.max("len").alias("len"))


def _looped(paths: DataFrame, group: str) -> DataFrame:
    """Nodes known to be on or behind a cycle."""
    on = paths.filter(F.col("up") == F.col("node")).select(group, F.col("up")).distinct()
    return paths.join(on, [group, "up"], "left_semi").select(group, "node").distinct()


def longest_paths(edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame, int]:
    """``(group, up, node, len)`` of the longest paths into every node not on or
    behind a cycle, the looped nodes ``(group, node)``, and the rounds taken.

    After round k a path of 2**k edges or more into a node shows as one of at least
    2**k. A node on or behind a cycle always has one, until the cycle itself is seen,
    so a group is done when its nodes not known as looped have none.
    """
    spark = edges.sparkSession
    paths = edges.filter("src is not null and dst is not null").select(group, F.col("src").alias("up"), F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("len")).distinct()
    paths = materialize(paths, "paths0")
    done, rounds = [], 0
    while True:
        going = paths.join(_looped(paths, group), [group, "node"], "left_anti").filter(F.col("len") >= 2 ** rounds).select(group).distinct()
        going = materialize(going, f"paths_open{rounds}")
        if going.isEmpty():
            done.append(paths)
            break
        done.append(paths.join(going, group, "left_anti"))
        rounds += 1
        paths = materialize(_squared(paths.join(going, group, "left_semi"), group), f"paths{rounds}")
    known = reduce(DataFrame.unionByName, done)
    looped = materialize(_looped(known, group), "paths_looped")
    return known, looped, rounds


def strong_components(paths: DataFrame, looped: DataFrame, group: str) -> DataFrame:
    """``(group, node, cycle)`` of the nodes on a cycle; ``cycle`` is the smallest
    node of the strongly connected component: nodes reached forward and backward.
    Reach among looped nodes only, completed by squaring."""
    keys = [group, "node"]
    reach = paths.join(looped, keys, "left_semi").join(looped.withColumnRenamed("node", "up"), [group, "up"], "left_semi").select(group, "up", "node").distinct()
    reach = materialize(reach.withColumn("len", F.lit(1).cast("bigint")), "reach")
    n = reach.count()
    while n:
        more = materialize(_squared(reach, group).withColumn("len", F.lit(1).cast("bigint")), "reach")
        m = more.count()
        reach = more
        if m == n:
            break
        n = m
    back = reach.select(group, F.col("node").alias("up"), F.col("up").alias("node"))
    return reach.select(group, "up", "node").join(back, [group, "up", "node"], "left_semi").groupBy(group, F.col("up").alias("node")).agg(F.min("node").alias("cycle"))


#: edges of a group that are folded in one row; larger groups take the rounds
ROW_EDGES = 512


def _levels_by_rounds(edges: DataFrame, group: str) -> DataFrame:
    """``(group, node, level, kind, cycle)`` of the nodes with edges, by doubling."""
    paths, looped, _ = longest_paths(edges, group)
    ends = edges.select(group, F.explode(F.array("src", "dst")).alias("node")).distinct()
    every = ends.join(paths.groupBy(group, "node").agg(F.max("len").alias("level")), [group, "node"], "left")
    on = strong_components(paths, looped, group)
    return every.join(looped.withColumn("looped", F.lit(True)), [group, "node"], "left").join(on, [group, "node"], "left").select(
        group, "node", F.when(F.col("looped").isNull(), F.coalesce("level", F.lit(0)).cast("int")).alias("level"),
        F.when(F.col("cycle").isNotNull(), "on").when(F.col("looped"), "behind").alias("kind"), "cycle")


def _levels_in_rows(edges: DataFrame, group: str) -> DataFrame:
    """The same for groups of few edges, gathered in one row each."""
    rows = edges.groupBy(group).agg(F.collect_list(F.struct("src", "dst")).alias("links"))
    names = F.array_distinct(F.flatten(F.transform("links", lambda e: F.array(e["src"], e["dst"]))))
    return rows.select(group, F.inline(row_graph(names, F.col("links")))).select(group, F.col("stage").alias("node"), "level", "kind", "cycle")


def peel_levels(nodes: DataFrame, edges: DataFrame, group: str, node: str = "node", row_edges: int = ROW_EDGES) -> DataFrame:
    """``(group, node, level, kind, cycle)`` of every node: level 0 = no
    predecessor, level k = a longest path of k edges into it; null on and behind a
    cycle. kind: null, ``on`` or ``behind``; cycle: the smallest node of the cycle's
    strongly connected component, for nodes on one."""
    e = materialize(edges.select(group, "src", "dst").filter("src is not null and dst is not null"), "graph_edges")
    large = e.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > row_edges).select(group)
    if large.isEmpty():
        found = _levels_in_rows(e, group)
    else:
        large = materialize(large, "graph_large")
        found = _levels_in_rows(e.join(large, group, "left_anti"), group).unionByName(_levels_by_rounds(e.join(large, group, "left_semi"), group))
    every = nodes.select(group, F.col(node).alias("node")).distinct().join(found.withColumn("met", F.lit(True)), [group, "node"], "left")
    return every.select(group, F.col("node").alias(node), F.when(F.col("met"), F.col("level")).otherwise(0).alias("level"), "kind", "cycle")


def dependency_order(levels: DataFrame, group: str, node: str = "node") -> DataFrame:
    """Definitions before uses, ties by node order: ``(level, node)``."""
    ok = levels.filter(F.col("level").isNotNull())
    return ok.withColumn("ord", F.row_number().over(Window.partitionBy(group).orderBy("level", node)))


def cycle_report(levels: DataFrame, group: str, node: str = "node") -> DataFrame:
    """C4: nodes without an order, told apart: on a cycle (and which), or behind one."""
    return levels.filter(F.col("level").isNull()).select(group, node, "kind", "cycle")


def lineage_closure(edges: DataFrame, group: str) -> DataFrame:
    """All (upstream, node) pairs per group, by squaring: a chain of n nodes takes
    log2(n) written rounds. For graphs whose edges span rows; a graph
    within a row is folded there (``row_graph``)."""
    e = edges.filter("src is not null and dst is not null").select(group, F.col("src").alias("up"), F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("len")).distinct()
    reach = materialize(e, "closure")
    n = reach.count()
    while n:
        reach = materialize(_squared(reach, group).withColumn("len", F.lit(1).cast("bigint")), "closure")
        m = reach.count()
        if m == n:
            break
        n = m
    return reach.select(group, "up", "node")


# ---- a whole graph in one row: reach sets as bit arrays

BITS = 62


def _bits(members: Column, n: Column) -> Column:
    """Bit array of n bits, ``BITS`` to a bigint, set at the places ``members`` (from 0)."""
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BITS).cast("int")), lambda w: F.aggregate(
        members, F.lit(0).cast("bigint"), lambda acc, m: F.when(F.floor(m / BITS) == w, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(m, F.lit(BITS)).cast("int")))).otherwise(acc)))


def _has(bits: Column, at: Column) -> Column:
    word = F.element_at(bits, (F.floor(at / BITS) + 1).cast("int"))
    return F.getbit(word, F.pmod(at, F.lit(BITS)).cast("int")) == 1


def row_graph(names: Column, links: Column) -> Column:
    """``array<struct<stage, level, n_upstream, kind, cycle>>`` of the graph in a row: ``names``
    its nodes, ``links`` an ``array<struct<src, dst>>``; links from or to other names do not count.

    Reach sets are closed node by node (Warshall: whoever is below k takes over what is
    above k), so n_upstream counts distinct upstream nodes, on a cycle the node itself too. A node has
    fewer upstreams than any node below it unless they share a cycle, so levels follow in one
    pass by n_upstream. Nodes on or behind a cycle have a null level, and
    the kind ``on`` or ``behind``; cycle is the smallest node of the cycle's component."""
    known = F.array_distinct(F.filter(names, lambda x: x.isNotNull()))

    def levels(nodes: Column, direct: Column) -> Column:
        n = F.size(nodes)
        places = F.sequence(F.lit(0), n - 1)
        own = F.transform(direct, lambda d: _bits(d, n))
        closed = F.aggregate(places, own, lambda acc, k: let(F.element_at(acc, k + 1), lambda above: F.transform(
            acc, lambda s: F.when(_has(s, k), F.zip_with(s, above, lambda x, y: x.bitwiseOR(y))).otherwise(s))))

        def ordered(up: Column) -> Column:
            counts = F.transform(up, lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, w: acc + F.bit_count(w)))
            on = _bits(F.filter(places, lambda i: _has(F.element_at(up, i + 1), i)), n)
            free = lambda i, cycles: ~_has(cycles, i) & ~F.exists(F.zip_with(F.element_at(up, i + 1), cycles, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)
            turn = F.transform(F.array_sort(F.zip_with(counts, places, lambda c, i: F.struct(c.alias("c"), i.alias("i")))), lambda x: x["i"])
            together = lambda i: F.array_min(F.transform(F.filter(places, lambda j: _has(F.element_at(up, i + 1), j) & _has(F.element_at(up, j + 1), i)), lambda j: F.element_at(nodes, j + 1)))
            at = lambda acc, v: F.coalesce(F.array_max(F.transform(F.element_at(direct, v + 1), lambda p: F.element_at(acc, p + 1))) + 1, F.lit(0))
            level = F.aggregate(turn, F.transform(places, lambda _: F.lit(0)), lambda acc, v: let(at(acc, v), lambda new: F.transform(acc, lambda x, i: F.when(i == v, new).otherwise(x))))
            return let(on, lambda cycles: let(counts, lambda c: let(level, lambda l: F.transform(places, lambda i: F.struct(
                F.element_at(nodes, i + 1).alias("stage"), F.when(free(i, cycles), F.element_at(l, i + 1)).alias("level"), F.element_at(c, i + 1).alias("n_upstream"),
                F.when(_has(cycles, i), "on").when(~free(i, cycles), "behind").alias("kind"), F.when(_has(cycles, i), together(i)).alias("cycle"))))))

        return let(closed, ordered)

    def graph(nodes: Column) -> Column:
        above = lambda v: F.transform(F.filter(links, lambda e: (e["dst"] == v) & F.array_contains(nodes, e["src"])), lambda e: (F.array_position(nodes, e["src"]) - 1).cast("int"))
        direct = F.transform(nodes, lambda v: F.array_distinct(above(v)))
        return F.when(F.size(nodes) > 0, let(direct, lambda d: levels(nodes, d)))

    return let(known, graph)


def with_made_cycles(edges: DataFrame, nodes: DataFrame, group: str, node: str, every: int = 5) -> DataFrame:
    """Test aid for C4: in every ``every``-th group add first<->last node edges."""
    ends = nodes.filter(F.col(group) % every == 0).groupBy(group).agg(
        F.min(node).alias("a"), F.max(node).alias("b")).filter(F.col("a") < F.col("b"))
    made = ends.select(group, F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        ends.select(group, F.col("b").alias("src"), F.col("a").alias("dst")))
    return edges.select(group, "src", "dst").unionByName(made).dropDuplicates([group, "src", "dst"])

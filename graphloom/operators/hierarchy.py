"""Parent-child links to full hierarchies (problem 3).

Subtree sizes are summed upward and sibling ranges handed downward, both by
pointer doubling: after round k a node knows its ancestor 2^k levels up, so a
tree of depth d takes about log2(d) rounds instead of d. Nodes that never meet
a root are unprocessed: they lie on a circle or hang below one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import strong_components
from graphloom.operators.ranks import running
from graphloom.session import cut, drop, scratch, small


def containment_links(occurrences: DataFrame) -> DataFrame:
    """Distinct (src, dst) of rows of kind ``contains`` with both ends."""
    rows = occurrences.filter((F.col("kind") == "contains") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return rows.select("src", "dst").distinct()


def parents(links: DataFrame) -> DataFrame:
    """Each node with its parent, null for a root: id, parent, several, inner (whether it has children).

    A node with several parents hangs below the smallest in byte order, and
    ``several`` is true.
    """
    up = links.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), (F.min("src") != F.max("src")).alias("several"))
    no = F.lit(None).cast("string")
    tops = links.select(F.col("src").alias("id"), no.alias("parent"), F.lit(False).alias("several"), F.lit(True).alias("inner")).distinct()
    both = up.withColumn("inner", F.lit(False)).unionByName(tops)
    return both.groupBy("id").agg(F.max("parent").alias("parent"), F.max("several").alias("several"), F.max("inner").alias("inner"))


FEW = 25_000  # open nodes that a round sends to every task, some ten megabytes, instead of shuffling all inner nodes


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _climb(nodes: DataFrame, with_sizes: bool) -> tuple[DataFrame, DataFrame, int]:
    """Nodes below a root (id, parent, root, depth, size, inner), the unprocessed ones (id, parent), and how many these are.

    At the start of round k the open nodes are those of depth 2^k or more, and
    ``anc`` is exactly 2^k levels up. ``size`` then counts a node's descendants
    nearer than 2^k, itself included. Only inner nodes are anyone's ancestor,
    so leaves never stand on the other side of a join. Nodes that have met
    their root are written once and not carried on; what their subtrees gain
    in later rounds is added at the end.
    """
    up = F.col("parent")
    done = up.isNull()
    state = cut(nodes.select("id", "parent", up.alias("anc"), F.when(done, 0).otherwise(1).cast("long").alias("dist"), done.alias("done"), F.lit(1).cast("long").alias("size"), "inner", F.lit(0).alias("round")), ~F.col("done"))
    tables, gains, left, k = [state], [], state.n_where, 0
    while left:
        k += 1
        s = tables[-1].filter("NOT done")
        t = _union([x.filter("done AND inner") for x in tables] + [s.filter("inner")]).select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("dist").alias("t_dist"), F.col("done").alias("t_done"))
        moved = (F.broadcast(s) if left <= FEW else s).join(t, F.col("anc") == F.col("t_id")).select(
            "id", "parent", F.coalesce("t_anc", "anc").alias("anc"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_done").alias("done"), "size", "inner", F.lit(k).alias("round")
        )
        if with_sizes:
            gained = cut(s.groupBy(F.col("anc").alias("g_id")).agg(F.sum("size").alias("gain"), F.lit(k).alias("g_round")))
            gains.append(gained)
            moved = moved.join(small(gained).drop("g_round"), F.col("id") == F.col("g_id"), "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("g_id", "gain")
        tables.append(cut(moved, ~F.col("done")))
        if tables[-1].n_where == left:
            break
        left = tables[-1].n_where
    found = _union([x.filter("done") for x in tables])
    if gains:
        late = _union(gains)
        more = found.filter("inner").select("id", "round").join(late, (F.col("id") == F.col("g_id")) & (F.col("g_round") > F.col("round"))).groupBy(F.col("id").alias("g_id")).agg(F.sum("gain").alias("gain"))
        found = found.join(more, F.col("id") == F.col("g_id"), "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0)))
    found = found.select("id", "parent", F.coalesce("anc", "id").alias("root"), F.col("dist").alias("depth"), "size", "inner")
    return found, tables[-1].filter("NOT done").select("id", "parent"), left


def circles(links: DataFrame) -> DataFrame:
    """Nodes on a circle: loop_id (smallest node id on the circle in byte order), node_id.

    Circles lie among the nodes that the climb to the roots leaves
    unprocessed. A node that contains itself is a circle. Where unprocessed
    nodes, or nodes below them, have further parents, circles may share nodes
    or run through these; then ``loop_id`` is the smallest id of the strongly
    connected set.
    """
    with scratch(links.sparkSession) as keep:
        nodes = cut(parents(links), F.col("several"))
        if nodes.n_where:
            # with several parents a node may meet a root and lie on a circle too: what no trimming processes is searched
            found = strong_components(links)
            return keep(cut(found.select(F.col("component").alias("loop_id"), F.col("id").alias("node_id"))))
        _, rest, left = _climb(nodes, with_sizes=False)
        if not left:
            return keep(cut(rest.select(F.col("id").alias("loop_id"), F.col("id").alias("node_id"))))
        # the parent of an unprocessed node is unprocessed; images under 2^k steps shrink to the circles
        held, before = cut(rest.select("id", F.col("parent").alias("anc"), F.col("id").alias("low"))), None
        rest = held
        while True:
            t = rest.select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("low").alias("t_low"))
            step = rest.join(t, F.col("anc") == F.col("t_id")).select("id", F.col("t_anc").alias("anc"), F.least("low", "t_low").alias("low"), (F.col("t_low") < F.col("low")).alias("sank"))
            old, held = held, cut(step, F.col("sank"))
            drop(old)
            rest = held.drop("sank")
            n = rest.select("anc").distinct().count()
            if held.n_where == 0 and n == before:
                break
            before = n
        on = rest.select(F.col("anc").alias("node_id")).distinct()
        return keep(cut(on.join(rest, F.col("node_id") == F.col("id")).select(F.col("low").alias("loop_id"), "node_id")))


def hierarchy(links: DataFrame) -> DataFrame:
    """Every node of the trees: id, parent, root, depth, path, lo, hi, descendants, tree_size, state; a written table.

    ``path`` lists the ids from the root down to the node. ``lo`` is the node's
    preorder number within its root's tree, from 1, children in byte order of
    their ids; the numbers up to ``hi`` are its descendants, so an ancestor's
    range encloses its own. ``state`` is ``tree``, or ``unprocessed`` for nodes
    on a circle or below one, whose other columns are null. A node with several
    parents counts below the smallest. No links give no rows.
    """
    with scratch(links.sparkSession) as keep:
        found, rest, _ = _climb(parents(links).drop("several"), with_sizes=True)
        tree = cut(found)
        sized = tree.select("id", "parent", "size", "inner")
        ordered = running(sized.filter(F.col("parent").isNotNull()), ["parent"], ["id"], F.col("size"), "before")
        one, none = F.lit(1).cast("long"), F.lit(None)
        start = ordered.select("id", F.col("parent").alias("anc"), (F.col("before") + 1).alias("at"), F.array("id").alias("path"), none.cast("long").alias("tree_size"), F.lit(False).alias("done"), "inner")
        tops = sized.filter(F.col("parent").isNull()).select("id", none.cast("string").alias("anc"), one.alias("at"), F.array("id").alias("path"), F.col("size").alias("tree_size"), F.lit(True).alias("done"), "inner")
        tables = [cut(start.unionByName(tops), ~F.col("done"))]
        while tables[-1].n_where:
            s = tables[-1].filter("NOT done")
            t = _union([x.filter("done AND inner") for x in tables] + [s.filter("inner")]).select(*[F.col(c).alias(f"t_{c}") for c in ("id", "anc", "at", "path", "tree_size", "done")])
            moved = (F.broadcast(s) if tables[-1].n_where <= FEW else s).join(t, F.col("anc") == F.col("t_id")).select("id", F.coalesce("t_anc", "anc").alias("anc"), (F.col("at") + F.col("t_at")).alias("at"), F.concat("t_path", "path").alias("path"), F.col("t_tree_size").alias("tree_size"), F.col("t_done").alias("done"), "inner")
            tables.append(cut(moved, ~F.col("done")))
        down = _union([x.filter("done") for x in tables]).select("id", "at", "path", "tree_size")
        placed = tree.join(down, "id").select(
            "id", "parent", "root", "depth", "path", F.col("at").alias("lo"), (F.col("at") + F.col("size") - 1).alias("hi"), (F.col("size") - 1).alias("descendants"), "tree_size", F.lit("tree").alias("state")
        )
        bare = {f.name: f.dataType for f in placed.schema.fields}
        left = rest.select("id", "parent", *[none.cast(t).alias(c) for c, t in bare.items() if c not in ("id", "parent", "state")], F.lit("unprocessed").alias("state"))
        return keep(cut(placed.unionByName(left)))


TOP_POWER = 12  # blocks of preorder numbers have at most 2 to this power, an even number


def _powers(n: Column) -> Column:
    """0, 2, 4 and so on while 2 to that power is at most a number, or up to the highest power."""
    return F.sequence(F.lit(0), F.least(F.length(F.bin(n)) - 1, F.lit(TOP_POWER)), F.lit(2))


def range_pairs(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Pairs of a node and one of its descendants by their nested-set ranges: id, descendant, distance.

    ``wanted`` (column ``id``) limits the nodes whose descendants are asked for.
    A range is taken apart into aligned blocks of powers of four, at most six of
    each but the highest, and a node is in one block of each power. They meet
    on (root, power, block) by equality, so that only true pairs are formed,
    each once, and a group has at most 4,096 nodes however large the tree is.
    """
    own = tree.filter(F.col("state") == "tree")
    tops = own.filter("descendants > 0")
    if wanted is not None:
        tops = tops.join(wanted.select("id").distinct(), "id", "left_semi")
    # of lo + 1 .. hi: at each power the blocks that no block of the next power holds
    t = tops.select("id", "root", F.col("depth").alias("top_depth"), (F.col("lo") + 1).alias("a"), (F.col("hi") + 1).alias("b"), F.explode(_powers(F.col("hi") - F.col("lo"))).alias("power"))
    t = t.withColumn("l", F.expr("shiftright(a + shiftleft(1L, power) - 1, power)")).withColumn("r", F.expr("shiftright(b, power)")).filter("l < r")
    up, down = F.expr("shiftright(l + 3, 2) * 4"), F.expr("shiftright(r, 2) * 4")
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = (F.col("power") == TOP_POWER) | (up >= down)
    blocks = F.when(whole, F.sequence(F.col("l"), F.col("r") - 1)).otherwise(F.concat(run(F.col("l"), up), run(down, F.col("r"))))
    pieces = t.select("id", "root", "top_depth", "power", F.explode(blocks).alias("block"))
    nodes = own.filter(F.col("parent").isNotNull()).select(F.col("id").alias("descendant"), "root", "depth", "lo", F.explode(_powers(F.col("tree_size"))).alias("power"))
    nodes = nodes.withColumn("block", F.expr("shiftright(lo, power)")).drop("lo")
    return pieces.join(nodes, ["root", "power", "block"]).select("id", "descendant", (F.col("depth") - F.col("top_depth")).alias("distance"))


def ancestors(tree: DataFrame) -> DataFrame:
    """Ancestors of every node of the trees: id, ancestor, distance.

    A node's path already lists them, so nothing is joined and the work is the
    number of pairs, whatever the sizes of the trees.
    """
    above = F.slice("path", 1, F.col("depth").cast("int"))
    pairs = tree.filter(F.col("state") == "tree").select("id", "depth", F.posexplode(above).alias("at", "ancestor"))
    return pairs.select("id", "ancestor", (F.col("depth") - F.col("at")).alias("distance"))

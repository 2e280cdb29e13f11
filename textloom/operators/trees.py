"""Tree algebra over adjacency rows ``tree_id, node_id, parent_id`` (0: none).

Nothing walks level by level. Pointers double: after k rounds a row points 2^k ancestors up, so a tree of any depth takes the logarithm of its
depth in rounds of n rows. ``jumps`` keeps all rounds, for walks by binary lifting; ``intervals`` ranks the list of entering and leaving
nodes in the same way, after which a question about a subtree is a comparison of numbers. Joins are on (tree, node), which is unique, so
a tree may hold any share of the rows; all are shuffled, as no table here has a bound. Rounds are written to the shared folder. A cycle, which no tree has, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import durable, shuffled_join

KEY = ["tree_id", "node_id"]


def _follow(rows: DataFrame, at: str, step: DataFrame, how: str = "left") -> DataFrame:
    """Joins ``step`` (keyed by node_id) to the node that column ``at`` names; at may be null."""
    named = shuffled_join(step.withColumnRenamed("tree_id", "__tree").withColumnRenamed("node_id", "__node"))
    return rows.join(named, (rows["tree_id"] == F.col("__tree")) & (rows[at] == F.col("__node")), how).drop("__tree", "__node")


def _rounds(t: DataFrame):
    """Numbers of rounds; more than the logarithm of the rows is an error."""
    most, k = max(t.count(), 1), 0
    while 2**k <= 2 * most:
        yield k
        k += 1
    raise ValueError(f"a node has more than {most} ancestors: the rows hold a cycle")


def jumps(t: DataFrame) -> list[DataFrame]:
    """``tree_id, node_id, up``: for k = 0, 1, .. the ancestor 2^k above, where there is one."""
    out = [durable(t.where("parent_id <> 0").select(*KEY, F.col("parent_id").alias("up")), "jumps")]
    for _ in _rounds(t):
        far = _follow(out[-1], "up", out[-1].select(*KEY, F.col("up").alias("far")), "inner").select(*KEY, F.col("far").alias("up"))
        far = durable(far, "jumps")
        if far.isEmpty():
            return out
        out.append(far)
    raise AssertionError


def climb(rows: DataFrame, at: str, height: Column, table: list[DataFrame]) -> DataFrame:
    """Moves ``at`` up by ``height``, a jump for each bit; null where the tree ends below. Changes the column ``at`` only."""
    rows = rows.withColumn("__height", height.cast("long"))
    rows = rows.withColumn(at, F.when(F.col("__height") < 2 ** len(table), F.col(at)))
    for k, step in enumerate(table):
        far = _follow(rows, at, step)
        rows = far.withColumn(at, F.when(F.shiftright("__height", k).bitwiseAND(1) == 1, F.col("up")).otherwise(F.col(at))).drop("up")
    return rows.drop("__height")


def depths(t: DataFrame, table: list[DataFrame] | None = None) -> DataFrame:
    """``tree_id, node_id, depth``: the number of ancestors, by binary lifting."""
    rows = t.select(*KEY, F.col("node_id").alias("__at"), F.lit(0).cast("long").alias("depth"))
    for k, step in reversed(list(enumerate(jumps(t) if table is None else table))):
        far = _follow(rows, "__at", step)
        rows = far.select(*KEY, F.coalesce("up", "__at").alias("__at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 2**k).otherwise(0)).alias("depth"))
    return rows.select(*KEY, "depth")


def intervals(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, enter, last, depth``: the place of a node in pre-order from 0, the largest one below it (or its own), and the
    number of its ancestors. A node u is below v exactly where v.enter < u.enter <= v.last. Siblings, and the roots of a forest, go by id.

    The list goes through entering and leaving each node; ranking it by doubling counts, from each item on, the items that
    enter and those that leave.
    """
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    first = t.where("parent_id <> 0").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("first"))
    rows = t.select(*KEY, "parent_id", F.lead("node_id").over(w).alias("right")).join(shuffled_join(first), KEY, "left")
    item = lambda node, leave: F.struct(node.alias("node"), F.lit(leave).alias("leave"))
    enter = rows.select("tree_id", item(F.col("node_id"), False).alias("node_id"), F.when(F.col("first").isNotNull(), item(F.col("first"), False)).otherwise(item(F.col("node_id"), True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leave = rows.select(
        "tree_id", item(F.col("node_id"), True).alias("node_id"),
        F.when(F.col("right").isNotNull(), item(F.col("right"), False)).when(F.col("parent_id") != 0, item(F.col("parent_id"), True)).alias("next"), F.lit(0).cast("long").alias("n"),
    )
    items = durable(enter.unionAll(leave), "tour")
    for _ in _rounds(items):
        if items.where("next is not null").isEmpty():
            break
        step = items.select(*KEY, F.col("next").alias("far"), F.col("n").alias("more"))
        items = durable(_follow(items, "next", step).select(*KEY, F.col("far").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "tour")
    total = t.groupBy("tree_id").agg(F.count("*").alias("total"))
    by = items.groupBy("tree_id", F.col("node_id.node").alias("node_id")).agg(F.max(F.when(~F.col("node_id.leave"), F.col("n"))).alias("a"), F.max(F.when(F.col("node_id.leave"), F.col("n"))).alias("b"))
    out = by.join(shuffled_join(total), "tree_id").select(*KEY, (F.col("total") - F.col("a")).alias("enter"), (F.col("total") - F.col("b") - 1).alias("last"))
    return out.join(shuffled_join(depths(t)), KEY)


def contains(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``below`` to pairs (tree_id, a, b): b is a descendant of a, by ``intervals``."""
    a, b = (spans.select("tree_id", F.col("node_id").alias(x), F.col("enter").alias(f"{x}_enter"), F.col("last").alias(f"{x}_last")) for x in "ab")
    out = pairs.join(shuffled_join(a), ["tree_id", "a"], "left").join(shuffled_join(b), ["tree_id", "b"], "left")
    below = (F.col("a_enter") < F.col("b_enter")) & (F.col("b_enter") <= F.col("a_last"))
    return out.select(*pairs.columns, F.coalesce(below, F.lit(False)).alias("below"))


def ancestors(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, ancestor, distance`` of all pairs, which are quadratic in a tree's depth: only for who wants them all.

    A round adds the pairs that are up to twice as far.
    """
    pairs = t.where("parent_id <> 0").select(*KEY, F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))
    for k, step in enumerate(jumps(t)):
        far = _follow(step, "up", pairs, "inner").select(*KEY, "ancestor", (F.col("distance") + 2**k).cast("int").alias("distance"))
        pairs = durable(pairs.unionAll(far), "ancestors")
    return pairs


def siblings(t: DataFrame) -> DataFrame:
    """``left, right``: the nearest siblings, and the number of children of each node."""
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    kids = t.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    s = t.select("tree_id", "node_id", "parent_id", F.lag("node_id").over(w).alias("left_id"), F.lead("node_id").over(w).alias("right_id"))
    return s.join(shuffled_join(kids), ["tree_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def lowest_common(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tree_id, a, b, lca`` for pairs of nodes, a node being its own ancestor here; pairs without a common one go.

    The deeper node climbs to the depth of the other, then both make all jumps that keep them apart.
    """
    table = jumps(t)
    deep = depths(t, table)
    rows = pairs.select("tree_id", "a", "b").distinct()
    rows = _follow(_follow(rows, "a", deep.withColumnRenamed("depth", "da"), "inner"), "b", deep.withColumnRenamed("depth", "db"), "inner")
    low = rows.withColumns({"x": F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")), "y": F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a"))})
    rows = durable(climb(low, "x", F.abs(F.col("da") - F.col("db")), table).drop("da", "db"), "lca")
    for step in reversed(table):
        both = _follow(_follow(rows, "x", step.withColumnRenamed("up", "ux")), "y", step.withColumnRenamed("up", "uy"))
        apart = F.col("ux") != F.col("uy")
        rows = both.withColumns({"x": F.when(apart, F.col("ux")).otherwise(F.col("x")), "y": F.when(apart, F.col("uy")).otherwise(F.col("y"))}).drop("ux", "uy")
    end = _follow(_follow(rows, "x", table[0].withColumnRenamed("up", "ux")), "y", table[0].withColumnRenamed("up", "uy"))
    lca = F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("ux") == F.col("uy"), F.col("ux"))
    return end.select("tree_id", "a", "b", lca.alias("lca")).where("lca is not null")


def children(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, child, at, n``: each child with its place from 0 and the number of children."""
    w = Window.partitionBy("tree_id", "parent_id")
    return t.where("parent_id <> 0").select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), (F.row_number().over(w.orderBy("node_id")) - 1).alias("at"), F.count("*").over(w).alias("n"))


def descendants(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, descendant, depth``: the ancestors turned round."""
    return ancestors(t).select("tree_id", F.col("ancestor").alias("node_id"), F.col("node_id").alias("descendant"), F.col("distance").alias("depth"))


def single_chain(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, lowest``: the end of the chain of only children below each node (itself, if it has none or several)."""
    down = durable(children(t).where("n = 1").select(*KEY, F.col("child").alias("end"), F.lit(True).alias("moved")), "chain")
    for _ in _rounds(t):
        if down.where("moved").isEmpty():
            break
        far = _follow(down.drop("moved"), "end", down.select(*KEY, F.col("end").alias("far")))
        down = durable(far.select(*KEY, F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")), "chain")
    return t.select(*KEY).join(shuffled_join(down.drop("moved")), KEY, "left").select(*KEY, F.coalesce("end", "node_id").alias("lowest"))


def kth_siblings(t: DataFrame, k: int) -> DataFrame:
    """``left_id, right_id``: the k-th sibling to either side."""
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    return t.select("tree_id", "node_id", F.lag("node_id", k).over(w).alias("left_id"), F.lead("node_id", k).over(w).alias("right_id"))


def nearest_ancestor(t: DataFrame, matching: DataFrame, highest: bool = False) -> DataFrame:
    """``tree_id, node_id, found``: the lowest (or highest) ancestor among ``matching`` (tree_id, node_id).

    A row holds what is found among its next 2^k ancestors; what the row 2^k above has found comes behind that.
    """
    hit = matching.select("tree_id", F.col("node_id").alias("parent_id")).distinct().withColumn("__hit", F.col("parent_id"))
    rows = durable(t.where("parent_id <> 0").join(shuffled_join(hit), ["tree_id", "parent_id"], "left").select(*KEY, F.col("parent_id").alias("up"), F.col("__hit").alias("found")), "nearest")
    for _ in _rounds(t):
        if rows.where("up is not null").isEmpty():
            break
        far = _follow(rows, "up", rows.select(*KEY, F.col("up").alias("far"), F.col("found").alias("more")))
        found = F.coalesce("more", "found") if highest else F.coalesce("found", "more")
        rows = durable(far.select(*KEY, F.col("far").alias("up"), found.alias("found")), "nearest")
    return rows.where("found is not null").select(*KEY, "found")


def find_nodes(t: DataFrame, matching: DataFrame) -> DataFrame:
    """``tree_id, node_id, found``: the nearest node below each node among ``matching``, the smallest of the nearest level.

    A row holds the best of the next 2^k levels below it and hands it to the row 2^k above, where the least is kept.
    """
    hit = matching.select(*KEY).distinct().join(shuffled_join(depths(t)), KEY).select(*KEY, F.struct("depth", F.col("node_id").alias("node")).alias("own"))
    up = t.select(*KEY, F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("up"))
    own = durable(up.join(shuffled_join(hit), KEY, "left"), "find")
    best = own.where("own is not null and up is not null").groupBy("tree_id", F.col("up").alias("node_id")).agg(F.min("own").alias("best"))
    rows = durable(own.drop("own").join(shuffled_join(best), KEY, "left"), "find")
    for _ in _rounds(t):
        if rows.where("up is not null").isEmpty():
            break
        more = rows.where("up is not null and best is not null").groupBy("tree_id", F.col("up").alias("node_id")).agg(F.min("best").alias("more"))
        far = _follow(rows, "up", rows.select(*KEY, F.col("up").alias("far"))).join(shuffled_join(more), KEY, "left")
        rows = durable(far.select(*KEY, F.col("far").alias("up"), F.least("best", "more").alias("best")), "find")
    return rows.where("best is not null").select(*KEY, F.col("best.node").alias("found"))


def second_order(t: DataFrame) -> DataFrame:
    """``tree_id, node_id, grandchild``."""
    below = t.where("parent_id <> 0").select("tree_id", "node_id", "parent_id")
    return below.alias("c").join(shuffled_join(below).alias("p"), (F.col("c.tree_id") == F.col("p.tree_id")) & (F.col("c.parent_id") == F.col("p.node_id"))).select(
        "c.tree_id", F.col("p.parent_id").alias("node_id"), F.col("c.node_id").alias("grandchild")
    )


def move(t: DataFrame, edits: DataFrame) -> DataFrame:
    """The tree after nodes got other parents (tree_id, node_id, new_parent); 0 isolates a node. A cycle shows in ``ancestors``."""
    return t.join(shuffled_join(edits.select("tree_id", "node_id", "new_parent")), ["tree_id", "node_id"], "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")


def prune(t: DataFrame, leaves: DataFrame) -> DataFrame:
    """The tree without the given leaves, and without ancestors that have lost all that was below them."""
    own = t.select("tree_id", "node_id").join(shuffled_join(t.select("tree_id", F.col("parent_id").alias("node_id")).distinct()), ["tree_id", "node_id"], "left_anti")
    kept = own.join(shuffled_join(leaves.select("tree_id", "node_id")), ["tree_id", "node_id"], "left_anti")
    alive = find_nodes(t, kept).select(*KEY).unionAll(kept).distinct()
    return t.join(shuffled_join(alive), KEY, "left_semi")


def adopt(t: DataFrame, removed: DataFrame) -> DataFrame:
    """The tree without the given nodes, whose children go to the nearest ancestor that is left."""
    gone = removed.select("tree_id", "node_id")
    left = t.join(shuffled_join(gone), ["tree_id", "node_id"], "left_anti")
    near = nearest_ancestor(t, left).withColumnRenamed("found", "near")
    return left.join(shuffled_join(near), ["tree_id", "node_id"], "left").withColumn("parent_id", F.coalesce("near", F.lit(0).cast("long"))).drop("near")

"""Parent links of unknown depth to trees: roots, depths, intervals, paths and descendants, with circles found.

1. Leaves are peeled, 2^k layers in round k: the image of the 2^k-fold parent function holds exactly the nodes with 2^k layers below
   them. When the image shrinks no more it consists of the circles.
2. Circle nodes become the roots of a forest. Each forest edge gives two arcs, down and up; with the children of a node in a fixed
   order they form one Euler tour per tree.
3. The tours are ranked by pointer jumping. The ranks of a node's two arcs are its interval; the running sum of +1 and -1 is its depth.
   An ancestor's interval holds those of its descendants.

No step groups by a parent or a root: siblings are chained within SIBLING_BLOCKS blocks of each parent and then block to block, and
every join of the tours is on keys that are unique on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.skew import hot_keys, lookup
from cardloom.session import written

SIBLING_BLOCKS = 1024


def _tidy(reference: Column) -> Column:
    return F.lower(F.regexp_replace(reference, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))


def parents(cards: DataFrame) -> DataFrame:
    """(child, parent) of the cards that have a parent, one row per child.

    The parent is the card that superseded_by names, or else the card whose supersedes lists the child (the smallest id, if several
    do). Blanks around a reference and letter case do not matter; a null, empty or absent reference is no link.
    """
    cards = cards.filter(F.col("id").isNotNull())
    ids = cards.select(_tidy(F.col("id")).alias("ref_"), "id").groupBy("ref_").agg(F.min("id").alias("other_"))
    up = cards.filter(F.col("superseded_by").isNotNull()).select("id", _tidy(F.col("superseded_by")).alias("ref_"), F.lit(0).alias("kind_"))
    down = cards.select("id", F.explode("supersedes").alias("x")).select("id", _tidy(F.col("x")).alias("ref_"), F.lit(1).alias("kind_"))
    refs = up.unionAll(down).filter("ref_ is not null and ref_ <> ''").distinct()
    hot = hot_keys(refs.groupBy("ref_").agg(F.count("*").alias("n")), ["ref_"])
    refs = lookup(refs, ids, ["ref_"], hot).filter("other_ is not null")
    upward = F.col("kind_") == 0
    pairs = refs.select(F.when(upward, F.col("id")).otherwise(F.col("other_")).alias("child"), F.when(upward, F.col("other_")).otherwise(F.col("id")).alias("parent"), "kind_")
    return pairs.groupBy("child").agg(F.min(F.struct("kind_", "parent")).alias("p")).select("child", "p.parent")


def circles(links: DataFrame) -> DataFrame:
    """(node, circle) of the nodes on circles of `links` (child, parent): the circle is named by its smallest node."""
    inner = links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    far = written(inner.select(F.col("child").alias("v"), F.col("parent").alias("g")), "peel")
    size = -1
    while True:
        image = written(far.select("g").distinct(), "image")
        now = image.count()
        if now == size or not now:
            break
        size = now
        far = far.join(image.withColumnRenamed("g", "v"), "v", "left_semi")
        far = written(far.join(far.select(F.col("v").alias("g"), F.col("g").alias("h")), "g").select("v", F.col("h").alias("g")), "peel")
    ring = links.join(image.withColumnRenamed("g", "child"), "child", "left_semi")
    least = written(ring.select(F.col("child").alias("v"), F.col("parent").alias("g"), F.col("child").alias("m")), "rings")
    total = now
    while total:
        ahead = least.select(F.col("v").alias("g"), F.col("g").alias("h"), F.col("m").alias("o"))
        stepped = written(least.join(ahead, "g").select("v", F.col("h").alias("g"), F.least("m", "o").alias("m"), (F.col("o") < F.col("m")).alias("less")), "rings")
        least = stepped.drop("less")
        if not stepped.filter("less").limit(1).count():
            break
    return least.select(F.col("v").alias("node"), F.col("m").alias("circle"))


def _tours(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """The arcs (a, next, root) of the Euler tours; arc 2e goes down edge e and 2e+1 up. Root is known on the last arc of a tour."""
    blocks = Window.partitionBy("parent", "block").orderBy("child")
    kids = edges.withColumn("block", F.pmod(F.xxhash64("child"), F.lit(SIBLING_BLOCKS)))
    kids = kids.withColumns({"sibling": F.lead("e").over(blocks), "place": F.row_number().over(blocks)})
    heads = kids.filter("place = 1").select("parent", "block", F.col("e").alias("head"))
    chain = Window.partitionBy("parent").orderBy("block")
    heads = heads.withColumns({"following": F.lead("head").over(chain), "first": F.row_number().over(chain) == 1})
    tails = kids.filter("sibling is null").join(heads.select("parent", "block", "following"), ["parent", "block"])
    tails = tails.select("e", "parent", F.col("following").alias("sibling"))
    bodies = kids.filter("sibling is not null").select("e", "parent", "sibling")
    own = edges.select(F.col("child").alias("parent"), F.col("e").alias("above"))
    ends = tails.filter("sibling is null").join(own, "parent", "left").join(rings.select(F.col("node").alias("parent"), "circle"), "parent", "left")
    none, text = F.lit(None).cast("long"), F.lit(None).cast("struct<root:string,tree:string>")
    up = bodies.unionAll(tails.filter("sibling is not null")).select((2 * F.col("e") + 1).alias("a"), (2 * F.col("sibling")).alias("next"), text.alias("root"))
    root = F.when(F.col("above").isNull(), F.struct(F.coalesce("circle", "parent").alias("root"), F.col("parent").alias("tree")))
    up = up.unionAll(ends.select((2 * F.col("e") + 1).alias("a"), F.when(F.col("above").isNotNull(), 2 * F.col("above") + 1).otherwise(none).alias("next"), root.alias("root")))
    firsts = heads.filter("first").select(F.col("parent").alias("child"), "head")
    down = edges.select("e", "child").join(firsts, "child", "left")
    down = down.select((2 * F.col("e")).alias("a"), F.coalesce(2 * F.col("head"), 2 * F.col("e") + 1).alias("next"), text.alias("root"))
    return up.unionAll(down)


def _ranked(arcs: DataFrame) -> DataFrame:
    """(a, count, depth, root): arcs from a to the end of its tour, the sum of their +1 and -1, and the tour's root."""
    weight = F.when(F.col("a") % 2 == 0, 1).otherwise(-1).cast("long")
    df = written(arcs.select("a", "next", F.lit(1).cast("long").alias("count"), weight.alias("depth"), "root"), "tour")
    while True:
        ahead = df.select(F.col("a").alias("next"), F.col("next").alias("n2"), F.col("count").alias("c2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        open_ = df.filter("next is not null")
        if not open_.limit(1).count():
            return df.drop("next")
        jumped = open_.join(ahead, "next").select(
            "a", F.col("n2").alias("next"), (F.col("count") + F.col("c2")).alias("count"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("r2").alias("root")
        )
        df = written(jumped.unionAll(df.filter("next is null")), "tour")


def forest(links: DataFrame) -> DataFrame:
    """One row for each node of `links` (child, parent; one parent per child).

    node, parent (null for a root; on a circle the next node of it), root (the smallest node of the circle for nodes on or below
    one), depth (0 for roots and circle nodes), entry and exit (numbers of the tour counted to its end: u is an ancestor of v, of the
    same tree, if u.entry > v.entry and u.exit < v.exit), descendants (their number below the node in its tree), on_circle, and tree_
    (the forest's root: for trees below a circle, the circle node at which they hang).
    """
    links = written(links, "links")
    rings = written(circles(links), "circles")
    tree = links.join(rings.select(F.col("node").alias("child")), "child", "left_anti")
    edges = written(tree.withColumn("e", F.monotonically_increasing_id()), "edges")
    ranked = _ranked(_tours(edges, rings))
    ranked = ranked.withColumn("e", F.shiftright("a", 1)).groupBy("e").agg(
        F.max(F.when(F.col("a") % 2 == 0, F.col("count"))).alias("entry"),
        F.max(F.when(F.col("a") % 2 == 1, F.col("count"))).alias("exit"),
        F.max(F.when(F.col("a") % 2 == 0, 1 - F.col("depth"))).alias("depth"),
        F.max("root").alias("top"),
    ).withColumns({"root": F.col("top.root"), "tree_": F.col("top.tree")})
    inner = edges.join(ranked, "e").select(
        F.col("child").alias("node"), "parent", "root", "depth", "entry", "exit", ((F.col("entry") - F.col("exit") - 1) / 2).cast("long").alias("descendants"), F.lit(False).alias("on_circle"), "tree_"
    )
    tops = links.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    tops = tops.unionAll(rings.select("node")).distinct()
    below = edges.join(ranked, "e").filter("depth = 1").groupBy(F.col("parent").alias("node")).agg(F.max("entry").alias("length"))
    tops = tops.join(below, "node", "left").join(rings, "node", "left").join(links.select(F.col("child").alias("node"), "parent"), "node", "left")
    length = F.coalesce("length", F.lit(0).cast("long"))
    tops = tops.select(
        "node", "parent", F.coalesce("circle", "node").alias("root"), F.lit(0).cast("long").alias("depth"), (length + 1).alias("entry"), F.lit(0).cast("long").alias("exit"), (length / 2).cast("long").alias("descendants"), F.col("circle").isNotNull().alias("on_circle"), F.col("node").alias("tree_")
    )
    return inner.unionAll(tops)


def roots(cards: DataFrame) -> DataFrame:
    """(id, root_id) of every card with at least one link."""
    return forest(parents(cards)).select(F.col("node").alias("id"), F.col("root").alias("root_id"))


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair of a `forest` result, by its intervals alone.

    Each inner node's interval is cut into at most two dyadic blocks per level, and each node looks up the one block per level that
    holds its own number: an equi-join that yields every pair once and nothing else.
    """
    low, high = F.col("exit") + 1, F.col("entry")  # the numbers below a node, half open
    levels = F.sequence(F.lit(0), F.lit(40))

    def cut(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, last = F.floor((low + size - 1) / size).cast("long"), F.floor(high / size).cast("long")
        odd = first < last
        left = F.when(odd & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when(odd & (last % 2 == 1) & ~((first % 2 == 1) & (last - 1 == first)), F.struct(level.alias("level"), (last - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    inner = nodes.filter("descendants > 0").select(F.col("node").alias("ancestor"), F.col("depth").alias("above"), "tree_", F.inline(F.flatten(F.transform(levels, cut))))
    top = nodes.groupBy("tree_").agg(F.max("entry").alias("n")).select("tree_", F.ceil(F.log2(F.col("n") + 1)).cast("int").alias("height"))
    each = nodes.filter("depth > 0").join(top, "tree_")
    block = F.transform(F.sequence(F.lit(0), F.col("height")), lambda k: F.struct(k.alias("level"), F.floor(F.col("entry") / F.call_function("shiftleft", F.lit(1).cast("long"), k)).cast("long").alias("block")))
    each = each.select(F.col("node").alias("descendant"), "depth", "tree_", F.inline(block))
    return each.join(inner, ["tree_", "level", "block"]).select("ancestor", "descendant", (F.col("depth") - F.col("above")).alias("distance"))


def paths(cards: DataFrame) -> DataFrame:
    """For every linked card: id, parent_id, root_id, depth, path (ids from the top of its tree down to it), descendants, on_circle."""
    nodes = forest(parents(cards))
    pairs = closure(nodes)
    above = pairs.groupBy("descendant").agg(F.array_sort(F.collect_list(F.struct(-F.col("distance"), "ancestor"))).alias("up"))
    out = nodes.join(above.withColumnRenamed("descendant", "node"), "node", "left")
    path = F.concat(F.coalesce(F.transform("up", lambda x: x["ancestor"]), F.expr("cast(array() as array<string>)")), F.array("node"))
    return out.select(F.col("node").alias("id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", path.alias("path"), "descendants", "on_circle")

"""Distances in flow graphs and ancestors in forests of any depth, in logarithmically many rounds.

All functions are handled together; the function (``fn``) is the partition key of every table. No
function is gathered in one task, and no round limit depends on its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import stored

# ancestors in one row of a jump table
WIDTH = 16


def distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(fn, node, dist): hops from the root of each function (fn, root) to every node it reaches, the root included.

    Nodes are taken out in rounds: an independent set of nodes whose removal adds no more edges than
    it saves gives way to edges from its predecessors to its successors, as long as the way through.
    Long chains, ladders and nested loops shrink by a constant share a round, whatever their length;
    a densely linked rest goes last, with a bound that rises whenever a round takes out little. Then
    every node, in reverse order, takes its shortest way from the neighbours that outlived it.
    """
    start = roots.select("fn", F.col("root").alias("_root")).distinct()
    rooted = edges.select("fn", "source", "target").filter("source <> target").join(start, "fn").filter("target <> _root")
    live = rooted.select("fn", F.when(F.col("source") != F.col("_root"), F.col("source")).alias("source"), "target", F.lit(1).cast("long").alias("len")).distinct()
    removed, number, slack, size = [], 0, 1, None
    while True:
        rank = lambda node: F.xxhash64("fn", node, F.lit(number))  # noqa: B023, E731
        end = lambda node, other, into: F.struct(F.col(node).alias("node"), F.struct(rank(other).alias("rank"), F.col(other).alias("id")).alias("near"), F.lit(into).alias("into"), F.col(other).isNotNull().alias("real"))
        ends = live.select("fn", F.explode(F.array(end("target", "source", 1), end("source", "target", 0))).alias("e")).select("fn", "e.*").filter("node is not null")
        degree = ends.groupBy("fn", "node").agg(F.sum("into").alias("_in"), F.count_if(F.col("into") == 0).alias("_out"), F.min(F.when(F.col("real"), F.col("near"))).alias("_near"))
        first = F.col("_near").isNull() | (F.struct(rank("node").alias("rank"), F.col("node").alias("id")) < F.col("_near"))
        chosen = degree.filter(first & (F.col("_in") * F.col("_out") <= F.col("_in") + F.col("_out") + slack)).select("fn", "node", F.lit(True).alias("_gone"))
        gone = lambda side: chosen.select("fn", F.col("node").alias(side), F.col("_gone").alias(f"_{side}"))
        marked = stored(live.join(gone("target"), ["fn", "target"], "left").join(gone("source"), ["fn", "source"], "left"))
        before, size = size, marked.count()
        if not size:
            break
        if before and size > 0.9 * before:
            slack = min(4 * slack, 1 << 40)
        into = marked.filter("_target").select("fn", F.col("target").alias("node"), "source", "len")
        out = marked.filter("_source").select("fn", F.col("source").alias("node"), "target", F.col("len").alias("_len"))
        removed.append(into)
        through = into.join(out, ["fn", "node"]).filter(~F.col("source").eqNullSafe(F.col("target"))).select("fn", "source", "target", (F.col("len") + F.col("_len")).alias("len"))
        rest = marked.filter("_target is null and _source is null").select("fn", "source", "target", "len")
        live = rest.unionByName(through).groupBy("fn", "source", "target").agg(F.min("len").alias("len"))
        number += 1
    node = live.schema["target"].dataType
    known = [start.select("fn", F.col("_root").cast(node).alias("node"), F.lit(0).cast("long").alias("dist"))]
    open_pieces = 0
    for into in reversed(removed):
        before = reduce(DataFrame.unionByName, known).select("fn", F.col("node").alias("source"), F.col("dist").alias("_before"))
        met = into.join(before, ["fn", "source"], "left").withColumn("dist", F.when(F.col("source").isNull(), F.col("len")).otherwise(F.col("len") + F.col("_before")))
        known.append(met.filter("dist is not null").groupBy("fn", "node").agg(F.min("dist").alias("dist")))
        open_pieces += 1
        if open_pieces == 3:
            known, open_pieces = [stored(reduce(DataFrame.unionByName, known))], 0
    return reduce(DataFrame.unionByName, known)


def jump_tables(tree: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """Tables (fn, node, ups) of a forest (fn, node, up; null at a root): ancestors at 1, 2, ... ``width`` steps of width ** k.

    Table k is built from its own rows by doubling. The last table is the first in which no node has
    all ``width`` ancestors, so a forest of depth d has about log(d) / log(width) tables.
    """
    none = F.array().cast(f"array<{tree.schema['up'].dataType.simpleString()}>")
    ups = tree.select("fn", "node", F.when(F.col("up").isNotNull(), F.array("up")).otherwise(none).alias("ups"))
    tables: list[DataFrame] = []
    while True:
        ups = stored(ups)
        reach = 1
        while reach < width:
            far = ups.select("fn", F.col("node").alias("_last"), F.col("ups").alias("_more"))
            last = F.when(F.size("ups") == reach, F.element_at("ups", -1))
            ups = stored(ups.withColumn("_last", last).join(far, ["fn", "_last"], "left").select("fn", "node", F.concat("ups", F.coalesce("_more", none)).alias("ups")))
            reach *= 2
        tables.append(ups)
        full = F.size("ups") == width
        if tables[-1].filter(full).isEmpty():
            return tables
        ups = tables[-1].select("fn", "node", F.when(full, F.array(F.get("ups", F.lit(width - 1)))).otherwise(none).alias("ups"))


def _climb(rows: DataFrame, table: DataFrame, steps: Column) -> DataFrame:
    """``rows`` with ``cur`` replaced by its ancestor after ``steps`` steps of the table's size; ``ups`` is at hand for the expression."""
    met = rows.join(table.withColumnRenamed("node", "cur"), ["fn", "cur"])
    return met.withColumn("_steps", steps.cast("int")).withColumn("cur", F.when(F.col("_steps") > 0, F.get("ups", F.col("_steps") - 1)).otherwise(F.col("cur"))).drop("ups")


def depths(tables: list[DataFrame], width: int = WIDTH) -> DataFrame:
    """(fn, node, depth) of every node of the forest."""
    rows = tables[0].select("fn", "node", F.col("node").alias("cur"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(tables))):
        rows = _climb(rows, tables[k], F.size("ups")).withColumn("depth", F.col("depth") + F.col("_steps") * F.lit(width**k)).drop("_steps")
    return rows.select("fn", "node", "depth")


def common_ancestors(groups: DataFrame, tables: list[DataFrame], width: int = WIDTH) -> DataFrame:
    """(fn, grp, node): nearest common ancestor of all nodes of each group (fn, grp, node), a node being its own ancestor.

    Groups are brought to one depth, then climb in steps of falling size as long as their ancestors
    differ. A group is never gathered: each size of step is one aggregation of smallest and largest
    ancestors, so a group may hold any number of nodes.
    """
    depth = depths(tables, width)
    rows = groups.join(depth, ["fn", "node"]).withColumnRenamed("node", "cur")
    least = rows.groupBy("fn", "grp").agg(F.min("depth").alias("_least"))
    rows = rows.join(least, ["fn", "grp"]).select("fn", "grp", "cur", (F.col("depth") - F.col("_least")).alias("excess"))
    for k in reversed(range(len(tables))):
        rows = _climb(rows, tables[k], F.floor(F.col("excess") / width**k) % width).drop("_steps")
    rows = rows.select("fn", "grp", "cur").distinct()
    for k in reversed(range(len(tables))):
        met = rows.join(tables[k].withColumnRenamed("node", "cur"), ["fn", "cur"])
        if k:
            met = stored(met)
        at = lambda agg: F.array(*[agg(F.get("ups", F.lit(j))) for j in range(width)])
        seen = met.groupBy("fn", "grp").agg(F.min("cur").alias("_one"), (F.min("cur") == F.max("cur")).alias("_same"), at(F.min).alias("_low"), at(F.max).alias("_high"))
        differ = F.size(F.filter(F.arrays_zip("_low", "_high"), lambda p: p["_low"] != p["_high"]))
        if k:
            steps = seen.select("fn", "grp", differ.alias("_differ"))
            rows = met.join(steps, ["fn", "grp"]).withColumn("cur", F.when(F.col("_differ") > 0, F.get("ups", F.col("_differ") - 1)).otherwise(F.col("cur"))).select("fn", "grp", "cur").distinct()
        else:
            rows = seen.select("fn", "grp", F.when(F.col("_same"), F.col("_one")).otherwise(F.get("_low", differ)).alias("node"))
    return rows


def ways_up(rows: DataFrame, tables: list[DataFrame], width: int = WIDTH) -> DataFrame:
    """``rows`` (fn, node, count, ...) once for each of the first ``count`` nodes on the way up from ``node``, itself the first.

    Long ways are cut into pieces of falling length, so the rounds are as few as the tables.
    """
    out = rows.filter("count > 0")
    kept = [c for c in rows.columns if c not in ("fn", "node", "count")]
    for k in reversed(range(len(tables))):
        piece = width**k
        met = out.join(tables[k], ["fn", "node"])
        pieces = F.sequence(F.lit(0), F.ceil(F.col("count") / piece).cast("int") - 1)
        cut = met.select("fn", "node", "count", "ups", *kept, F.explode(pieces).alias("_j"))
        start = F.when(F.col("_j") > 0, F.get("ups", F.col("_j") - 1)).otherwise(F.col("node"))
        out = cut.select("fn", start.alias("node"), F.least(F.col("count") - F.col("_j") * piece, F.lit(piece)).alias("count"), *kept)
    return out.drop("count")


def dominator_tree(flow: DataFrame, roots: DataFrame, parents: DataFrame) -> DataFrame:
    """(fn, node, idom) from any spanning tree (fn, node, up) of the flow edges (fn, source, target) that the root reaches.

    The dominators of a node are among its ancestors in the spanning tree, and in each tree made from
    it here. A round hangs every node below the nearest common ancestor of its predecessors; when no
    node moves, all ancestors are dominators. Only functions in which a node moved take part in the
    next round, and nodes with a single predecessor never move.
    """
    preds = flow.groupBy("fn", F.col("target").alias("node")).agg(F.count("*").alias("_n"), F.min("source").alias("up"))
    preds = stored(preds)
    fixed = preds.filter("_n = 1").select("fn", "node", "up")
    meets = stored(flow.join(preds.filter("_n > 1").select("fn", F.col("node").alias("target")), ["fn", "target"], "left_semi").select("fn", F.col("target").alias("grp"), F.col("source").alias("node")))
    tree = stored(fixed.unionByName(parents.join(fixed, ["fn", "node"], "left_anti").select("fn", "node", "up")))
    kind = tree.schema["node"].dataType
    tops = roots.select("fn", F.col("root").cast(kind).alias("node"), F.lit(None).cast(kind).alias("up")).distinct()
    done: list[DataFrame] = []
    while not meets.isEmpty():
        live = meets.select("fn").distinct()
        tables = jump_tables(tree.unionByName(tops.join(live, "fn", "left_semi")))
        found = common_ancestors(meets, tables).select("fn", F.col("grp").alias("node"), F.col("node").alias("_new"))
        moved = stored(tree.join(found, ["fn", "node"], "left").withColumn("_moved", F.coalesce(F.col("_new") != F.col("up"), F.lit(False))))
        tree = moved.select("fn", "node", F.coalesce("_new", "up").alias("up"))
        again = stored(moved.filter("_moved").select("fn").distinct())
        done.append(tree.join(again, "fn", "left_anti"))
        tree, meets = stored(tree.join(again, "fn", "left_semi")), stored(meets.join(again, "fn", "left_semi"))
    done.append(tree)
    return reduce(DataFrame.unionByName, done).select("fn", "node", F.col("up").alias("idom"))

"""Flow graphs of many functions at once: dominators, definitions, values, objects and conditions.

The function (``fn``) is the partition key of every table. Fixpoints run over all functions together,
one round per hop, and only new states drive the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import difference_bounds
from tracewell.functions.definition_flow import DEFINITION, EDGE, USE, uses_of_one_function
from tracewell.functions.dominator_tree import tree_of_one_function
from tracewell.functions.ids import digest_id, packed, unpacked
from tracewell.functions.object_flow import ALLOC, COPY, LOAD, STOP, STORE, within
from tracewell.operators.fixpoint import NotConverged, closure, walk
from tracewell.operators.graphs import components, path_variants
from tracewell.operators.skew import prefix_sums, top_n, with_neighbour
from tracewell.operators.trees import depths, distances, dominator_tree, jump_tables, ways_up
from tracewell.session import pin, stored


def sequence_graph(steps: DataFrame, order: Sequence[str], block: Column, back: int = 3) -> DataFrame:
    """Labelled flow edges of ordered steps (fn, node, kind) with entry and exit.

    ``branch`` steps go on as true and skip one step as false; ``loop`` steps also jump ``back`` steps;
    ``return`` steps go to the exit; the rest fall through. Positions come from chained block counts.
    """
    placed = pin(prefix_sums(steps, ["fn"], block, order, {"pos": F.lit(1)}).select("fn", F.col("node").cast("string").alias("node"), "kind", F.col("pos").cast("long").alias("pos")))
    last = placed.groupBy("fn").agg(F.max("pos").alias("last"))
    hop = lambda cond, pos, branch: F.when(cond, F.struct(pos.alias("to"), F.lit(branch).alias("branch")))
    kind, pos = F.col("kind"), F.col("pos")
    ends = (kind == "return") | (pos == F.col("last"))
    hops = F.array_compact(F.array(
        hop(ends, F.lit(-1).cast("long"), "exit"), hop(~ends & (kind == "branch"), pos + 1, "true"), hop(~ends & (kind != "branch"), pos + 1, "normal"),
        hop((kind == "branch") & (pos + 2 <= F.col("last")), pos + 2, "false"), hop((kind == "loop") & (pos > back), pos - back, "back"),
    ))
    wanted = placed.join(last, "fn").select("fn", F.col("node").alias("source"), F.explode(hops).alias("h")).select("fn", "source", "h.to", "h.branch")
    inner = wanted.filter("to > 0").join(placed.select("fn", F.col("pos").alias("to"), F.col("node").alias("target")), ["fn", "to"]).select("fn", "source", "target", "branch")
    leave = wanted.filter("to < 0").select("fn", "source", F.lit("<exit>").alias("target"), F.lit("normal").alias("branch"))
    enter = placed.filter("pos = 1").select("fn", F.lit("<entry>").alias("source"), F.col("node").alias("target"), F.lit("normal").alias("branch"))
    return enter.unionByName(inner).unionByName(leave)


def resolved_upwards(rows: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(fn, node, value): the value of a node, or that of the nearest one above it that has one; null if none has.

    ``rows``: fn, node, value, up. Every round doubles how far up a node has looked.
    """
    current, settled = stored(rows.select("fn", "node", "value", F.when(F.col("value").isNull(), F.col("up")).alias("up"))), []
    for _ in range(max_rounds):
        # what has its value or nothing above is read by others but moves no more
        settled.append(current.filter("up is null"))
        looking = current.filter("up is not null")
        if looking.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("fn", "node", "value")
        above = reduce(DataFrame.unionByName, [*settled, looking]).select("fn", F.col("node").alias("up"), F.col("value").alias("_value"), F.col("up").alias("_up"))
        current = stored(looking.join(above, ["fn", "up"], "left").select("fn", "node", F.coalesce("value", "_value").alias("value"), F.when(F.coalesce("value", "_value").isNull(), F.col("_up")).alias("up")))
    raise NotConverged("blocks are nested in a cycle")


def structured_graph(steps: DataFrame, order: str = "ord", block_width: int = 1000, completions: bool = False) -> DataFrame:
    """Labelled flow edges (fn, source, target, branch) of nested steps, with entry and exit.

    ``steps``: fn, node, parent (null at the top), part (body, else, handler or final of the parent),
    ``order`` within that block, and kind: if, loop, try, break, continue, return, raise or plain. After
    the last step of a block control goes on behind the parent, or back to it if that is a loop. An empty
    block is passed by; break, continue and raise without a matching parent leave the function.

    One final block serves every way out of its try: whatever leaves the other parts enters it, and
    where it ends control resumes each completion that is pending there, normal or abrupt; an abrupt
    step inside it replaces them. With ``completions`` the edges also have ``push`` and ``pop``, the
    completion (try:kind) that an edge into a final block leaves pending and that an edge out of it
    takes up, so that a reader can match them like calls and returns.
    """
    rows = stored(steps.select("fn", F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "part", F.col(order).alias("o"), "kind"))
    block = ["fn", "parent", "part"]
    above = rows.select("fn", F.col("node").alias("parent"), F.col("kind").alias("above"))
    heads = stored(rows.groupBy("fn", F.col("parent").alias("node"), "part").agg(F.min_by("node", F.struct("o", "node")).alias("head")))
    part = lambda name: heads.filter(F.col("part") == name).select("fn", "node", F.col("head").alias(name))
    of_parent = lambda name: part(name).select("fn", F.col("node").alias("parent"), F.col(name).alias(f"_{name}"))
    placed = with_neighbour(rows.fillna("", ["parent"]), block, F.floor(F.col("o") / block_width), ["o", "node"], ["node"], prefix="_next")
    placed = placed.withColumn("parent", F.when(F.col("parent") != "", F.col("parent"))).join(above, ["fn", "parent"], "left")
    placed = stored(placed.join(of_parent("final"), ["fn", "parent"], "left").join(of_parent("handler"), ["fn", "parent"], "left").select(
        "fn", "node", "parent", "part", "o", "kind", "above", F.col("_next.node").alias("next"), "_final", "_handler"))
    leave = F.lit("<exit>")
    # the nearest parent that answers, looked up by doubling
    upwards = lambda value, name, up=F.col("parent"): resolved_upwards(placed.select("fn", "node", value.alias("value"), up.alias("up"))).withColumnRenamed("value", name)
    guarded = (F.col("above") == "try") & (F.col("part") != "final") & F.col("_final").isNotNull()
    goal = lambda target, via: F.struct(target.alias("target"), via.alias("via"))
    none = F.lit(None).cast("string")
    into = goal(F.col("_final"), F.col("parent"))
    top, in_loop = F.col("parent").isNull(), F.col("above") == "loop"
    follow = upwards(F.when(F.col("next").isNotNull(), goal(F.col("next"), none)).when(top, goal(leave, none)).when(in_loop, goal(F.col("parent"), none)).when(guarded, into), "follow")
    caught = F.when((F.col("above") == "try") & (F.col("part") == "body") & F.col("_handler").isNotNull(), goal(F.col("_handler"), none)).when(guarded, into).when(top, goal(leave, none))
    raised, returned = upwards(caught, "raise"), upwards(F.when(guarded, into).when(top, goal(leave, none)), "return")
    left = upwards(F.when(in_loop, goal(F.col("parent"), none)).when(guarded, into).when(top, goal(leave, none)), "around")
    finished = upwards(F.when(F.col("part") == "final", F.col("parent")), "ends", F.when(F.col("next").isNull() & ~in_loop & ~guarded, F.col("parent")))
    # a step with a successor, or at the end of a loop, ends no final block
    last = placed.filter(F.col("next").isNull()).select("fn", "node")
    finished = finished.join(last, ["fn", "node"], "left_semi").filter("ends is not null")
    full = placed.select("fn", "node", "kind")
    for table in (follow, raised, returned, left):
        full = full.join(table, ["fn", "node"])
    for name in ("body", "else", "handler", "final"):
        full = full.join(part(name), ["fn", "node"], "left")
    full = stored(full)
    behind = full.select("fn", F.col("node").alias("_loop"), F.col("follow").alias("_behind"))
    full = full.withColumn("_loop", F.when(F.col("around.via").isNull(), F.col("around.target"))).join(behind, ["fn", "_loop"], "left")
    resume = {
        "normal": F.col("follow"), "raise": F.col("raise"), "return": F.col("return"), "continue": F.col("around"),
        "break": F.when(F.col("around.via").isNull(), F.coalesce("_behind", goal(leave, none))).otherwise(F.col("around")),
    }
    kind, inner = F.col("kind"), F.coalesce("final", F.col("follow.target"))
    final_via = F.when(F.col("final").isNotNull(), F.col("node")).otherwise(F.col("follow.via"))
    direct = lambda cond, name, branch: F.when(cond & F.col(name).isNotNull(), edge(goal(F.col(name), none), branch))
    edge = lambda to, branch, of="normal", ends=False: F.struct(to["target"].alias("target"), F.lit(branch).alias("branch"), to["via"].alias("via"), F.lit(of).alias("of"), F.lit(ends).alias("ends"))
    empty = lambda name: F.col(name).isNull()
    out = F.array_compact(F.array(
        direct(kind == "if", "body", "true"), F.when((kind == "if") & empty("body"), edge(F.col("follow"), "true", ends=True)),
        direct(kind == "if", "else", "false"), F.when((kind == "if") & empty("else"), edge(F.col("follow"), "false", ends=True)),
        F.when(kind == "loop", edge(goal(F.coalesce("body", "node"), none), "true")), F.when(kind == "loop", edge(F.col("follow"), "false", ends=True)),
        direct(kind == "try", "body", "normal"), F.when((kind == "try") & empty("body"), edge(goal(inner, final_via), "normal")),
        direct(kind == "try", "handler", "exception"), F.when((kind == "try") & empty("handler") & ~empty("final"), edge(goal(F.col("final"), F.col("node")), "exception", "raise")),
        F.when(kind == "break", edge(resume["break"], "normal", "break")), F.when(kind == "continue", edge(resume["continue"], "normal", "continue")),
        F.when(kind == "return", edge(resume["return"], "normal", "return")), F.when(kind == "raise", edge(resume["raise"], "exception", "raise")),
        F.when(kind == "plain", edge(F.col("follow"), "normal", ends=True)),
    ))
    made = full.select("fn", F.col("node").alias("source"), F.explode(out).alias("e")).select("fn", "source", "e.*")
    made = stored(made.withColumn("push", F.when(F.col("via").isNotNull(), F.concat_ws(":", "via", "of"))))
    enter = heads.filter("node is null").groupBy("fn").agg(F.min("head").alias("target"))
    entry = enter.select("fn", F.lit("<entry>").alias("source"), "target", F.lit("normal").alias("branch"), none.alias("push"), none.alias("pop"))
    columns = ["fn", "source", "target", "branch", "push", "pop"]
    # what is pending where a final block ends: completions that enter it, and those that inner ones resume with
    after = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), to.alias("to")) for k, to in resume.items()]))
    resumes = stored(full.filter("final is not null").select("fn", F.col("node").alias("ends"), after.alias("r")).select("fn", "ends", "r.of", "r.to.target", "r.to.via"))
    # an inner try that is the last step of a final block ends that block too
    chain = walk(finished.select("fn", "node", F.col("node").alias("step")), finished.select("fn", "node", F.col("ends").alias("next")), ["fn"]).filter("node <> step")
    closing = made.filter("ends").join(chain.select("fn", F.col("step").alias("source"), F.col("node").alias("ends_of")).distinct(), ["fn", "source"])
    # behind a final block nothing follows but what is pending there
    plain = stored(made.join(closing.select("fn", "source", "branch", F.lit(True).alias("ends")).distinct(), ["fn", "source", "branch", "ends"], "left_anti"))
    entered = plain.filter("via is not null").select("fn", "of", F.col("via").alias("node")).distinct()
    pending = walk(entered, resumes.filter("via is not null").select("fn", "of", F.col("ends").alias("node"), F.col("via").alias("next")), ["fn", "of"])
    resumes = resumes.join(pending.withColumnRenamed("node", "ends"), ["fn", "of", "ends"])
    resumed = closing.select("fn", "source", "branch", F.col("ends_of").alias("ends")).join(resumes, ["fn", "ends"])
    resumed = resumed.select("fn", "source", "target", "branch", F.when(F.col("via").isNotNull(), F.concat_ws(":", "via", "of")).alias("push"), F.concat_ws(":", "ends", "of").alias("pop"))
    edges = entry.unionByName(plain.withColumn("pop", none).select(*columns)).unionByName(resumed).distinct()
    return edges if completions else edges.select("fn", "source", "target", "branch").distinct()


def hop_table(edges: DataFrame, stride: int = 8, keys: Sequence[str] = ("fn",)) -> DataFrame:
    """(*keys, source, target) pairs of one to ``stride`` hops (a power of two), so that a closure needs that many fewer rounds."""
    hops, length = pin(edges.select(*keys, "source", "target").distinct()), 1
    while length < stride:
        far = hops.select(*keys, F.col("source").alias("target"), F.col("target").alias("_far"))
        hops = pin(hops.unionByName(hops.join(far, [*keys, "target"]).select(*keys, "source", F.col("_far").alias("target"))).distinct())
        length *= 2
    return hops


def reachable_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(fn, node) reachable from ``seeds`` (fn, node), the seeds included."""
    return walk(seeds.select("fn", "node"), edges.select("fn", F.col("source").alias("node"), F.col("target").alias("next")), ["fn"])


def _hung(flow: DataFrame, dist: DataFrame) -> DataFrame:
    """A spanning tree (fn, node, up): every node below a predecessor that is nearer to the root."""
    far = dist.select("fn", F.col("node").alias("target"), F.col("dist").alias("_far"))
    near = flow.join(dist.select("fn", F.col("node").alias("source"), "dist"), ["fn", "source"]).join(far, ["fn", "target"]).filter("dist < _far")
    return near.groupBy("fn", F.col("target").alias("node")).agg(F.min_by("source", F.struct("dist", "source")).alias("up"))


def _large_dominators(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Dominators of functions of any size and depth, in rounds that grow with the logarithm of their length."""
    dist = stored(distances(edges, roots))
    flow = stored(edges.join(dist.select("fn", F.col("node").alias("source")), ["fn", "source"], "left_semi"))
    return dominator_tree(flow, roots, _hung(flow, dist))


def immediate_dominators(edges: DataFrame, roots: DataFrame, local_edges: int = 20_000) -> DataFrame:
    """(fn, node, idom) for nodes reachable from the root of each function (fn, root).

    ``local_edges`` bounds what one task may hold: functions of up to so many edges are solved in one
    group each, after one exchange. Larger ones are never gathered: distances from the root give a
    spanning tree, and nearest common ancestors of predecessors turn it into the dominator tree.
    """
    kinds = {f.name: f.dataType for f in edges.schema}
    roots = pin(roots.select("fn", F.col("root").cast(kinds["target"]).alias("root")).distinct())
    edges = pin(edges.select("fn", "source", "target").filter("source <> target").distinct().join(roots, "fn"))
    large = pin(edges.groupBy("fn").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_edges).select("fn"))
    schema = T.StructType([T.StructField("fn", kinds["fn"]), T.StructField("node", kinds["target"]), T.StructField("idom", kinds["target"])])
    if large.isEmpty():
        return edges.groupBy("fn").applyInPandas(tree_of_one_function, schema)
    small = edges.join(large, "fn", "left_anti").groupBy("fn").applyInPandas(tree_of_one_function, schema)
    big = edges.join(large, "fn", "left_semi").filter("target <> root").drop("root")
    return small.unionByName(_large_dominators(big, roots.join(large, "fn", "left_semi")))


def post_dominators(edges: DataFrame, nodes: DataFrame, exits: DataFrame, local_edges: int = 20_000) -> DataFrame:
    """(fn, node, ipdom); ipdom is -1 for nodes whose next certain node is the virtual exit.

    Nodes that cannot reach the exit get a virtual way out, so that endless loops do not fake certainty.
    Only functions that have such nodes are solved again. Node ids must not be -1.
    """
    top = F.lit(-1).cast("long")
    nodes = pin(nodes.select("fn", F.col("node").cast("long").alias("node")).distinct())
    turned = edges.select("fn", F.col("target").cast("long").alias("source"), F.col("source").cast("long").alias("target"))
    reverse = pin(turned.unionByName(exits.select("fn", top.alias("source"), F.col("node").cast("long").alias("target"))).distinct())
    roots = pin(nodes.select("fn").distinct().withColumn("root", top))
    tree = pin(immediate_dominators(reverse, roots, local_edges))
    stuck = pin(nodes.join(tree, ["fn", "node"], "left_anti"))
    if not stuck.isEmpty():
        again = stuck.select("fn").distinct()
        whole = reverse.join(again, "fn", "left_semi").unionByName(stuck.select("fn", top.alias("source"), F.col("node").alias("target")))
        solved = immediate_dominators(whole, roots.join(again, "fn", "left_semi"), local_edges)
        tree = tree.join(again, "fn", "left_anti").unionByName(solved)
    return tree.select("fn", "node", F.col("idom").alias("ipdom"))


def control_dependence(edges: DataFrame, ipdom: DataFrame) -> DataFrame:
    """For each edge the nodes from its target up the post-dominator tree to, but without, the post-dominator of its source."""
    tree = pin(ipdom.select("fn", "node", F.col("ipdom").alias("up")))
    top = tree.select("fn").distinct().select("fn", F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("up"))
    tables = jump_tables(tree.unionByName(top))
    depth = pin(depths(tables))
    stop = tree.select("fn", F.col("node").alias("source"), F.col("up").alias("node")).join(depth, ["fn", "node"]).select("fn", "source", F.col("depth").alias("_stop"))
    walk = edges.select("fn", F.col("source").cast("long").alias("source"), "branch", F.col("target").cast("long").alias("node")).distinct()
    # the post-dominator of a source lies on the way up from each of its targets
    counted = walk.join(stop, ["fn", "source"]).join(depth, ["fn", "node"]).select("fn", "node", "source", "branch", (F.col("depth") - F.col("_stop")).alias("count"))
    return ways_up(counted, tables).select("fn", "source", "branch", F.col("node").alias("target")).distinct()


def reaching_definitions(
    edges: DataFrame, definitions: DataFrame, uses: DataFrame, reachable: DataFrame | None = None, max_rounds: int = 100_000, stride: int = 16, local_rows: int = 2_000,
) -> DataFrame:
    """Def-use edges (fn, source, target, var, certainty).

    ``edges``: fn, source, target, before_write (true: the edge carries the state from before the write).
    ``definitions``: fn, node, var, certain; only certain ones end earlier definitions. A write to a name
    also ends definitions of its member paths ``name.x`` and ``name[x]``. ``uses``: fn, node, var.

    ``local_rows`` bounds what one task may hold: functions of up to so many edges, definitions and uses
    are solved in one group each, after one exchange, so that the states between are never rows. Of a
    larger one the states are rows. Which edges a name survives does not depend on where it was
    defined. So its surviving edges are first joined into tables of up to ``stride`` hops, and a round
    moves all definitions that far.
    """
    if reachable is not None:
        keep = reachable.select("fn", "node")
        definitions, uses = definitions.join(keep, ["fn", "node"], "left_semi"), uses.join(keep, ["fn", "node"], "left_semi")
        edges = edges.join(keep.withColumnRenamed("node", "source"), ["fn", "source"], "left_semi")
    definitions = definitions.select("fn", "node", F.col("var").cast("string").alias("var"), "certain")
    uses = uses.select("fn", "node", F.col("var").cast("string").alias("var"))
    row = lambda df, number, a, b, var, flag: df.select("fn", F.lit(number).alias("row"), F.col(a).alias("a"), b.alias("b"), var.alias("var"), flag.alias("flag"))
    none = F.lit(None)
    rows = stored(
        row(edges, EDGE, "source", F.col("target"), none.cast("string"), F.coalesce("before_write", F.lit(False)))
        .unionByName(row(definitions, DEFINITION, "node", none, F.col("var"), F.col("certain")))
        .unionByName(row(uses, USE, "node", none, F.col("var"), none.cast("boolean"))).filter(F.expr(f"fn is not null and a is not null and (row = {EDGE} or var is not null)")))
    large = stored(rows.groupBy("fn").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_rows).select("fn"))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("fn", kinds["fn"]), T.StructField("source", kinds["a"]), T.StructField("target", kinds["a"]), T.StructField("var", T.StringType()), T.StructField("certainty", T.StringType())])
    if large.isEmpty():
        return rows.groupBy("fn").applyInArrow(uses_of_one_function, schema)
    small = rows.join(large, "fn", "left_anti").groupBy("fn").applyInArrow(uses_of_one_function, schema)
    big = rows.join(large, "fn", "left_semi")
    edges = big.filter(F.col("row") == EDGE).select("fn", F.col("a").alias("source"), F.col("b").alias("target"), F.col("flag").alias("before_write"))
    definitions = big.filter(F.col("row") == DEFINITION).select("fn", F.col("a").alias("node"), "var", F.col("flag").alias("certain"))
    uses = big.filter(F.col("row") == USE).select("fn", F.col("a").alias("node"), "var")
    return small.unionByName(_large_reaching(edges, definitions, uses, max_rounds, stride))


def _large_reaching(edges: DataFrame, definitions: DataFrame, uses: DataFrame, max_rounds: int, stride: int) -> DataFrame:
    """Def-use edges of functions of any size: states are rows."""
    # what one node overwrites is as small as the node, so it travels with the edges
    kills = definitions.filter("certain").groupBy("fn", F.col("node").alias("source")).agg(F.collect_set("var").alias("_kills"))
    nothing = F.array().cast("array<string>")
    hops = pin(edges.join(kills, ["fn", "source"], "left").select("fn", "source", "target", "before_write", F.coalesce("_kills", nothing).alias("_kills")))
    ended = F.exists("_kills", lambda k: (F.col("var") == k) | F.col("var").startswith(F.concat(k, F.lit("."))) | F.col("var").startswith(F.concat(k, F.lit("["))))
    # a definition that comes back to its own node is written again there: that is its start once more
    surviving = hops.join(definitions.select("fn", "var").distinct(), "fn").filter(F.col("before_write") | ~ended)
    far = hop_table(surviving, stride, ("fn", "var")).select("fn", "var", F.col("source").alias("at"), F.col("target").alias("_to"))
    start = definitions.select("fn", F.col("node").alias("def"), "var", F.col("node").alias("source"), "certain").join(hops.filter("not before_write").select("fn", "source", "target"), ["fn", "source"])
    seed = start.select("fn", "def", "var", "certain", F.col("target").alias("at"))
    step = lambda d: d.join(far, ["fn", "var", "at"]).select("fn", "def", "var", "certain", F.col("_to").alias("at"))
    states = closure(seed, step, ["fn", "def", "var", "at", "certain"], max_rounds)
    found = states.join(uses.select("fn", F.col("node").alias("at"), "var").distinct(), ["fn", "at", "var"])
    totals = found.groupBy("fn", "at", "var").agg(F.count("*").alias("_n"))
    certainty = F.when((F.col("_n") == 1) & F.col("certain"), "must").otherwise("may")
    return found.join(totals, ["fn", "at", "var"]).select("fn", F.col("def").alias("source"), F.col("at").alias("target"), "var", certainty.alias("certainty"))


def value_flow_edges(def_use: DataFrame, transfers: DataFrame, definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Value edges with their in and out variables: declared transfers first, a conservative guess where there is none.

    ``transfers``: fn, node, in_var, out_var, kind, certainty, storage_mode. A node without definitions
    or with other transfers passes the value through; otherwise it flows into what the node defines.
    """
    read = def_use.withColumnRenamed("var", "read_var")
    plain = transfers.filter("storage_mode <> 'address'").select("fn", F.col("node").alias("target"), F.col("in_var").alias("read_var"), "out_var", "kind", F.col("certainty").alias("_tc"))
    exact = read.join(plain, ["fn", "target", "read_var"])
    rest = read.join(plain.select("fn", "target", "read_var").distinct(), ["fn", "target", "read_var"], "left_anti")
    has_transfer = transfers.select("fn", F.col("node").alias("target"), F.lit(True).alias("_tr")).distinct()
    defined = definitions.groupBy("fn", F.col("node").alias("target")).agg(F.count("*").alias("_defs"))
    outs = definitions.select("fn", F.col("node").alias("target"), F.col("var").cast("string").alias("_out"))
    called = calls.select("fn", F.col("node").alias("target"), F.lit(True).alias("_call")).distinct()
    marked = rest.join(has_transfer, ["fn", "target"], "left").join(defined, ["fn", "target"], "left").join(called, ["fn", "target"], "left")
    through = marked.filter("_defs is null or _tr").select("fn", "source", "target", "read_var", "certainty", F.col("read_var").alias("out_var"), F.lit("passthrough").alias("kind"), F.lit("must").alias("_tc"))
    guess = marked.filter("_defs is not null and _tr is null").join(outs, ["fn", "target"])
    kind = F.when(F.col("_call"), "call_result").when(F.col("_defs") == 1, "assignment").otherwise("expression")
    guessed = guess.select("fn", "source", "target", "read_var", "certainty", F.col("_out").alias("out_var"), kind.alias("kind"), F.when(F.col("_call") | (F.col("_defs") > 1), "may").otherwise("must").alias("_tc"))
    both = exact.unionByName(through).unionByName(guessed)
    return both.select(
        "fn", "source", "target", F.col("read_var").alias("source_var"), F.col("out_var").alias("target_var"), "kind",
        F.when((F.col("certainty") == "may") | (F.col("_tc") == "may"), "may").otherwise("must").alias("certainty"),
        digest_id("value-flow:", "source", "target", "read_var", "out_var", "kind", "read_var").alias("edge_id"),
    ).distinct()


def _reached_within(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], max_depth: int) -> DataFrame:
    """Rows reached by at most ``max_depth`` steps, with their number as ``_depth``."""
    level = stored(seed.select(*keys).distinct().withColumn("_depth", F.lit(0)))
    levels = [level]
    for depth in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, levels)
        level = stored(step(level).select(*keys).distinct().join(seen, list(keys), "left_anti").withColumn("_depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def backward_origins(uses: DataFrame, def_use: DataFrame, copies: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Origins (fn, use_node, use_var, origin, origin_var) of used values, followed back through copies.

    ``copies``: fn, node, in_var, out_var. A copied name without any definition ends in an unknown origin
    (null). Chains are followed to their end, however long. Only a caller who gives ``max_depth`` has one
    of more copies end in an unknown origin: what lies behind them is not followed.
    """
    back = stored(def_use.select("fn", F.col("target").alias("node"), "var", F.col("source").alias("_def")))
    moves = copies.select("fn", F.col("node").alias("_def"), F.col("out_var").alias("var"), F.col("in_var").alias("_in"))
    steps = stored(back.join(moves, ["fn", "_def", "var"], "left"))
    seed = uses.select("fn", F.col("node").alias("use_node"), F.col("var").alias("use_var"), "node", "var")
    keys = ["fn", "use_node", "use_var", "node", "var"]
    moving = steps.filter("_in is not null").select("fn", "node", "var", F.col("_def").alias("_n"), F.col("_in").alias("_v"))
    step = lambda d: d.join(moving, ["fn", "node", "var"]).select("fn", "use_node", "use_var", F.col("_n").alias("node"), F.col("_v").alias("var"))
    if max_depth is None:
        # a name at a node is one place of the walk; places without a node or a name lead nowhere
        number = seed.select("node").union(moving.select("node")).union(moving.select("_n")).schema["node"].dataType
        place = lambda node, var: F.struct(F.col(node).cast(number).alias("node"), F.col(var).cast("string").alias("var"))
        hops = moving.filter("node is not null and var is not null and _n is not null").select("fn", place("node", "var").alias("node"), place("_n", "_v").alias("next"))
        reached = walk(seed.select("fn", "use_node", "use_var", place("node", "var").alias("node")), hops, ["fn"]).select("fn", "use_node", "use_var", "node.*")
        beyond = []
    else:
        reached = _reached_within(seed, step, keys, max_depth)
        beyond = [step(reached.filter(F.col("_depth") == max_depth)).join(reached, keys, "left_anti")]
    roots = reached.join(steps.filter("_in is null").select("fn", "node", "var", "_def"), ["fn", "node", "var"])
    known = roots.select("fn", "use_node", "use_var", F.col("_def").alias("origin"), F.col("var").alias("origin_var"))
    open_end = reached.join(back.select("fn", "node", "var").distinct(), ["fn", "node", "var"], "left_anti")
    unknown = reduce(DataFrame.unionByName, [end.select("fn", "use_node", "use_var") for end in [open_end, *beyond]]).select("fn", "use_node", "use_var", F.lit(None).cast(known.schema["origin"].dataType).alias("origin"), F.lit(None).cast("string").alias("origin_var"))
    return known.unionByName(unknown).distinct()


def constant_keys(origins: DataFrame, literals: DataFrame, max_values: int = 8) -> DataFrame:
    """Constant set of each selector use: exact, finite or unknown (any unknown origin, or more than ``max_values`` values).

    ``literals``: fn, node, var, value.
    """
    valued = origins.join(literals.select("fn", F.col("node").alias("origin"), F.col("var").alias("origin_var"), "value"), ["fn", "origin", "origin_var"], "left")
    per = valued.groupBy("fn", "use_node", "use_var").agg(F.countDistinct("value").alias("values"), F.count_if(F.col("value").isNull()).alias("_open"), F.min("value").alias("_one"))
    kind = F.when((F.col("_open") > 0) | (F.col("values") > max_values), "unknown").when(F.col("values") == 1, "exact").otherwise("finite")
    return per.select("fn", "use_node", "use_var", kind.alias("kind"), F.when(kind == "exact", F.col("_one")).alias("value"), F.when(kind != "unknown", F.col("values")).alias("values"))


def value_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 64, limit: int | None = 8, max_states: int | None = 2048) -> DataFrame:
    """Simple paths over (node, value) states. ``sources``/``sinks``: fn, node, var (as text)."""
    state = lambda node, var: F.concat_ws("|", F.col("fn").cast("string"), F.col(node).cast("string"), F.col(var))
    graph = edges.select(F.col("edge_id").alias("id"), state("source", "source_var").alias("source"), state("target", "target_var").alias("target")).distinct()
    start = sources.select(state("node", "var").alias("s")).distinct()
    ends = sinks.select(state("node", "var").alias("t")).distinct()
    return path_variants(graph, start, ends, max_depth, limit, max_states).filter("hops > 0")


def may_refer(
    edges: DataFrame, allocs: DataFrame, copies: DataFrame, stores: DataFrame | None = None, loads: DataFrame | None = None,
    invalidations: DataFrame | None = None, max_entries: int | None = None, max_aliases: int | None = None, local_rows: int = 2_000,
) -> tuple[DataFrame, DataFrame]:
    """(states, functions given up): which allocations a name may refer to before each node.

    ``allocs``: fn, node, name, alloc, certain. ``copies``: fn, node, src, dst, certain. ``stores``: fn,
    node, base, field, value. ``loads``: fn, node, dst, base, field. ``invalidations``: fn, node, alloc
    (``*``: all). A certain assignment replaces, an uncertain one merges; an allocation inside a cycle
    also carries ``unknown``; behind an invalidation a reference to that allocation is ``unknown``; heap
    cells only grow.

    ``local_rows`` bounds what one task may hold: functions of up to so many edges and operations are
    solved in one group each, after one exchange. Of a larger one the states are rows: how references
    move from (node, name) to (node, name) does not depend on the allocation, so that table is made
    once per function, and allocations walk it in strides that double.

    No function is given up unless ``max_entries`` bounds its states or ``max_aliases`` the copies that
    one reference may have passed; then the states have a column ``given_up``, and a function over a
    budget is one row with that mark and neither place, name nor allocation.
    """
    none, always, columns = F.lit(None), F.lit(True), ["name", "other", "field"]
    row = lambda df, number, a, b=none, name=none, other=none, field=none, flag=none: df.select(
        "fn", F.lit(number).alias("row"), F.col(a).alias("a"), b.alias("b"), *[c.cast("string").alias(n) for n, c in zip(columns, (name, other, field))], flag.cast("boolean").alias("flag"))
    parts = [row(edges, EDGE, "source", F.col("target")), row(allocs, ALLOC, "node", name=F.col("name"), other=F.col("alloc"), flag=F.col("certain")),
             row(copies, COPY, "node", name=F.col("dst"), other=F.col("src"), flag=F.col("certain"))]
    if stores is not None:
        parts.append(row(stores, STORE, "node", name=F.col("base"), other=F.col("value"), field=F.col("field")))
    if loads is not None:
        parts.append(row(loads, LOAD, "node", name=F.col("dst"), other=F.col("base"), field=F.col("field"), flag=always))
    if invalidations is not None:
        parts.append(row(invalidations, STOP, "node", other=F.col("alloc")))
    # a write whose value is null still ends references
    filled = {EDGE: ["b"], ALLOC: ["name"], COPY: ["name"], STORE: columns, LOAD: ["name"], STOP: ["other"]}
    whole = " or ".join(f"(row = {number} and {' and '.join(f'{n} is not null' for n in names)})" for number, names in filled.items())
    rows = stored(reduce(DataFrame.unionByName, parts).filter(F.expr(f"fn is not null and a is not null and ({whole})")))
    sizes = stored(rows.groupBy("fn").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_rows).select("fn"))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("fn", kinds["fn"]), T.StructField("at", kinds["b"]), T.StructField("name", T.StringType()), T.StructField("alloc", T.StringType()), T.StructField("given_up", T.BooleanType())])
    budgets = max_entries is not None or max_aliases is not None
    alone = sizes.isEmpty()
    small = (rows if alone else rows.join(sizes, "fn", "left_anti")).groupBy("fn").applyInArrow(within(max_entries, max_aliases), schema)
    if budgets:
        small = stored(small)
    given_up = small.filter("given_up").select("fn") if budgets else rows.select("fn").limit(0)
    small = small if budgets else small.drop("given_up")
    if alone:
        return small, given_up
    rows = rows.join(sizes, "fn", "left_semi")
    part = lambda number, a, **names: rows.filter(F.col("row") == number).select("fn", F.col("a").alias(a), *[F.col(c).alias(n) for c, n in names.items()])
    states, over = _large_references(
        part(EDGE, "source", b="target"), part(ALLOC, "node", name="name", other="alloc", flag="certain"), part(COPY, "node", name="dst", other="src", flag="certain"),
        None if stores is None else part(STORE, "node", name="base", other="value", field="field"), None if loads is None else part(LOAD, "node", name="dst", other="base", field="field"),
        None if invalidations is None else part(STOP, "node", other="alloc"), max_entries, max_aliases)
    return small.unionByName(states), given_up.unionByName(over)


def _large_references(
    edges: DataFrame, allocs: DataFrame, copies: DataFrame, stores: DataFrame | None, loads: DataFrame | None, invalidations: DataFrame | None,
    max_entries: int | None, max_aliases: int | None,
) -> tuple[DataFrame, DataFrame]:
    """References in functions of any size: states are rows."""
    allocs = stored(allocs)
    flow = stored(edges.select("fn", F.col("source").alias("at"), F.col("target").alias("_to")).distinct())
    around = walk(
        allocs.select("fn", F.col("node").alias("alloc_node"), F.col("node").alias("at")).distinct().join(flow, ["fn", "at"]).select("fn", "alloc_node", F.col("_to").alias("node")).distinct(),
        flow.select("fn", F.col("at").alias("node"), F.col("_to").alias("next")), ["fn"], patience=1)
    cyclic = stored(around.filter("alloc_node = node").select("fn", F.col("alloc_node").alias("node")).distinct())
    born = allocs.unionByName(allocs.join(cyclic, ["fn", "node"], "left_semi").withColumn("alloc", F.lit("unknown")))
    writes = allocs.select("fn", "node", F.col("name").alias("_w"), "certain").unionByName(copies.select("fn", "node", F.col("dst").alias("_w"), "certain"))
    if loads is not None:
        writes = writes.unionByName(loads.select("fn", "node", F.col("dst").alias("_w"), F.lit(True).alias("certain")))
    killed = writes.filter("certain").groupBy("fn", F.col("node").alias("at")).agg(F.collect_set("_w").alias("_kills"))
    nothing = F.array().cast("array<string>")
    moves = copies.groupBy("fn", F.col("node").alias("at")).agg(F.collect_set(F.struct("src", "dst")).alias("_moves"))
    # what one node overwrites and copies is bounded by the node itself
    hops = flow.join(killed, ["fn", "at"], "left").join(moves, ["fn", "at"], "left").select("fn", "at", "_to", F.coalesce("_kills", nothing).alias("_kills"), F.coalesce("_moves", F.array().cast("array<struct<src:string,dst:string>>")).alias("_moves"))
    names = writes.select("fn", F.col("_w").alias("name")).unionByName(copies.select("fn", F.col("src").alias("name"))).distinct()
    copied = F.transform(F.filter("_moves", lambda m: m["src"] == F.col("name")), lambda m: m["dst"])
    kept = F.when(F.array_contains("_kills", F.col("name")), nothing).otherwise(F.array("name"))
    place = lambda at, name: F.struct(F.col(at).alias("at"), F.col(name).alias("name"))
    moved = hops.join(names, "fn").select("fn", "at", "name", "_to", F.explode(F.array_distinct(F.concat(kept, copied))).alias("_name"))
    moved = stored(moved.select("fn", F.lit("").alias("cls"), place("at", "name").alias("node"), place("_to", "_name").alias("next")))
    cut = None
    if invalidations is not None:
        # an allocation that some node invalidates has a table of its own, without the ways out of these nodes
        cut = stored(invalidations.select("fn", F.col("node").alias("_at"), F.col("alloc").alias("cls")).distinct())
        every = cut.filter("cls = '*'").select("fn", "_at")
        classes = cut.filter("cls <> '*'").select("fn", "cls").distinct()
        tables = moved.unionByName(moved.drop("cls").join(classes, "fn").select(*moved.columns)).withColumn("_at", F.col("node.at"))
        limited = tables.join(every, ["fn", "_at"], "left_anti").join(cut, ["fn", "cls", "_at"], "left_anti").drop("_at").select(*moved.columns)
        moved = stored(limited.unionByName(moved.withColumn("cls", F.lit("unknown"))))
        classes = stored(classes.withColumn("_own", F.lit(True)))

    def classed(rows: DataFrame) -> DataFrame:
        if cut is None:
            return rows.withColumn("cls", F.lit(""))
        own = rows.join(classes.withColumnRenamed("cls", "alloc"), ["fn", "alloc"], "left")
        return own.withColumn("cls", F.when((F.col("alloc") == "unknown") | F.col("_own"), F.col("alloc")).otherwise(F.lit(""))).drop("_own")

    def spread(rows: DataFrame) -> DataFrame:
        """All states that references (fn, at, name, alloc) lead to."""
        start = classed(rows).select("fn", "cls", "alloc", place("at", "name").alias("node"))
        found = stored(walk(start, moved, ["fn", "cls"], patience=1))
        if cut is not None:
            stops = cut.select("fn", F.col("_at"), F.col("cls").alias("_cls"))
            hit = found.withColumn("_at", F.col("node.at")).filter("alloc <> 'unknown'").join(stops, ["fn", "_at"]).filter("_cls = '*' or _cls = alloc").select("fn", "node").distinct()
            lost = hit.join(moved.filter("cls = 'unknown'"), ["fn", "node"]).select("fn", "cls", F.lit("unknown").alias("alloc"), F.col("next").alias("node")).distinct()
            found = stored(found.unionByName(walk(lost, moved, ["fn", "cls"], patience=1)).distinct())
        return found.select("fn", "node.at", "node.name", "alloc")

    seed = born.select("fn", F.col("node").alias("at"), "name", "alloc").join(flow, ["fn", "at"]).select("fn", F.col("_to").alias("at"), "name", "alloc").distinct()
    states = spread(seed)
    if stores is not None and loads is not None:
        heap, known = None, 0
        while True:
            refs = states
            refer = lambda name: refs.select("fn", F.col("at").alias("node"), F.col("name").alias(name), F.col("alloc").alias(f"_{name}"))  # noqa: B023, E731
            cells = stores.join(refer("base"), ["fn", "node", "base"]).join(refer("value"), ["fn", "node", "value"]).select("fn", F.col("_base").alias("cell"), "field", F.col("_value").alias("alloc")).distinct()
            heap = stored(cells)
            before, known = known, heap.count()
            if known == before:  # cells only grow
                break
            seen = loads.join(refer("base"), ["fn", "node", "base"]).select("fn", F.col("node").alias("at"), F.col("dst").alias("name"), F.col("_base").alias("cell"), "field").join(heap, ["fn", "cell", "field"])
            loaded = seen.select("fn", "at", "name", "alloc").join(flow, ["fn", "at"]).select("fn", F.col("_to").alias("at"), "name", "alloc").distinct()
            # references known so far have spread already
            fresh = loaded.join(states, ["fn", "at", "name", "alloc"], "left_anti")
            states = stored(states.unionByName(spread(stored(fresh))).distinct())
    if max_entries is None and max_aliases is None:
        return states, states.select("fn").limit(0)
    over = []
    if max_entries is not None:
        over.append(states.groupBy("fn").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_entries).select("fn"))
    if max_aliases is not None:
        origin = copies.select("fn", F.col("node").alias("at"), F.col("dst").alias("name"), F.col("node").alias("alias")).join(flow, ["fn", "at"])
        start = origin.select("fn", F.lit("" if cut is None else "unknown").alias("cls"), "alias", F.struct(F.col("_to").alias("at"), "name").alias("node")).distinct()
        passed = walk(start, moved, ["fn", "cls"], patience=1).join(states.select("fn", place("at", "name").alias("node")).distinct(), ["fn", "node"], "left_semi")
        over.append(passed.groupBy("fn", "node").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_aliases).select("fn"))
    given_up = stored(reduce(DataFrame.unionByName, over).distinct())
    rest = states.join(given_up, "fn", "left_anti").withColumn("given_up", F.lit(False))
    return rest.unionByName(given_up.withColumn("given_up", F.lit(True)), allowMissingColumns=True), given_up


# operations whose values can be taken over; the last five only hand a value on
VALUE_OPERATIONS = ("DebugRef", "BinOp", "UnOp", "Extract", "Call", "Return", "If", "Jump", "Panic", "Phi", "ChangeType", "Convert", "ChangeInterface", "MakeInterface")
_HANDED_ON = VALUE_OPERATIONS[-5:]


def compiler_values(local: DataFrame, native: DataFrame, nodes: DataFrame, instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definition-use rows, verdict per function) of compiler values mapped to the operations of a flow graph.

    ``local`` and ``native``: fn, path, line, col, end_line, end_col of the same function on both sides.
    ``nodes``: fn, node, the same place columns, uses and defs (arrays of names). ``instructions``: fn,
    ord, opcode, operator, invocation, result, name, operands (array) and place columns.

    A DebugRef maps the value it names to the smallest operation around its place: a read slot if that
    operation reads the name, a write slot if it writes it. A read value leads back through merges and
    conversions to values with a write slot. A function is taken over whole or not at all: the verdict
    holds the first reason against it, in the order place, operation, dispatch, ambiguous slot, unmapped
    read; rows are those of functions without a reason.
    """
    place = ["path", "line", "col", "end_line", "end_col"]
    instructions = stored(instructions)
    owner = native.select("fn", *[F.col(c).alias(f"_{c}") for c in place])
    apart = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    reason = lambda df, rank, text: df.select("fn", F.lit(rank).alias("ord"), text.alias("reason"))
    reasons = [reason(local.join(owner, "fn", "left").filter(apart), 1, F.lit("location_mismatch"))]
    unfit = ~F.col("opcode").isin(*VALUE_OPERATIONS) | ((F.col("opcode") == "UnOp") & F.col("operator").isin("*", "<-"))
    reasons.append(reason(instructions.filter(unfit), 2, F.concat(F.lit("operation_unsupported:"), "opcode", F.coalesce("operator", F.lit("")))))
    reasons.append(reason(instructions.filter(F.col("invocation").isin("invoke", "dynamic")), 3, F.concat(F.lit("dispatch_unsupported:"), "invocation")))
    # value slots of operations
    key = lambda at: F.concat_ws("|", F.col("fn").cast("string"), F.col(at).cast("string"))
    named = stored(instructions.filter((F.col("opcode") == "DebugRef") & F.col("name").isNotNull() & (F.size("operands") == 1)).select(
        "fn", key("ord").alias("id"), "name", F.col("operands")[0].alias("value"), *place))
    # only operations of the same function are candidates
    inner = locate(named.select("id", key("path").alias("path"), *place[1:3]), nodes.select(key("node").alias("region"), key("path").alias("path"), *place[1:]))
    around = nodes.select("fn", "node", key("node").alias("region"), "uses", "defs", F.struct("end_line", "end_col").alias("_end"))
    slots = named.join(inner, "id").join(around, ["fn", "region"]).filter(F.struct("end_line", "end_col") <= F.col("_end"))
    slots = stored(slots.select("fn", "node", "name", "value", F.array_contains("uses", F.col("name")).alias("read"), F.array_contains("defs", F.col("name")).alias("write")).distinct())
    reasons.append(reason(slots.filter("read and write"), 4, F.concat(F.lit("read_write_ambiguous:"), "name")))
    wanted = nodes.select("fn", "node", F.explode("uses").alias("name")).distinct()
    reasons.append(reason(wanted.join(slots.filter("read"), ["fn", "node", "name"], "left_anti"), 5, F.concat(F.lit("read_not_mapped:"), "name")))
    bad = reduce(DataFrame.unionByName, reasons).groupBy("fn").agg(F.min(F.struct("ord", "reason"))["reason"].alias("reason"))
    verdicts = stored(local.select("fn").distinct().join(bad, "fn", "left"))
    # back from what is read to what is written
    fit = verdicts.filter("reason is null").select("fn")
    slots = slots.join(fit, "fn", "left_semi")
    written = slots.filter("write").select("fn", F.col("value"), F.col("node").alias("source"))
    handed = instructions.filter(F.col("opcode").isin(*_HANDED_ON) & F.col("result").isNotNull()).select("fn", F.col("result").alias("node"), F.explode("operands").alias("next"))
    handed = handed.join(written.select("fn", F.col("value").alias("node")).distinct(), ["fn", "node"], "left_anti")
    start = slots.filter("read").select("fn", F.col("node").alias("target"), "name", F.col("value").alias("node")).distinct()
    found = walk(start, handed, ["fn"], patience=2).withColumnRenamed("node", "value").join(written, ["fn", "value"])
    return found.select("fn", "source", "target", "name").distinct(), verdicts


def prefer_complete_group(external: DataFrame, local: DataFrame, checks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, choice per group): the external rows of a group only when all its checks hold, else the local ones; never both.

    ``checks``: key, ord, reason, ok. The first failed check names the reason.
    """
    verdict = checks.groupBy(key).agg(F.min(F.when(~F.col("ok"), F.struct("ord", "reason"))).alias("_bad"))
    groups = local.select(key).unionByName(external.select(key)).distinct()
    choice = groups.join(verdict.withColumn("_checked", F.lit(True)), key, "left").select(
        key, (F.col("_checked").isNotNull() & F.col("_bad").isNull()).alias("external"), F.when(F.col("_checked").isNull(), "no_external_group").otherwise(F.col("_bad.reason")).alias("reason"))
    taken = external.join(choice.filter("external").select(key), key, "left_semi").withColumn("origin", F.lit("external"))
    kept = local.join(choice.filter("not external").select(key), key, "left_semi").withColumn("origin", F.lit("local"))
    return taken.unionByName(kept), choice


def _scalar_feasibility(predicates: DataFrame) -> DataFrame:
    """Status of each path's conjunction of predicates on one name each.

    ``op`` is one of < <= > >= == != over whole numbers, eq_text / ne_text over text, anything else is
    unsupported. A contradiction makes the path infeasible; otherwise an unsupported term makes it unknown.
    """
    op, value = F.col("op"), F.col("value")
    low = F.when(op.isin(">=", "=="), value).when(op == ">", value + 1)
    high = F.when(op.isin("<=", "=="), value).when(op == "<", value - 1)
    known = predicates.filter(op.isin("<", "<=", ">", ">=", "==", "!="))
    bounds = known.groupBy("path", "var").agg(F.max(low).alias("low"), F.min(high).alias("high"))
    barred = known.filter(op == "!=").select("path", "var", "value").distinct().join(bounds, ["path", "var"]).filter((value >= F.col("low")) & (value <= F.col("high")))
    holes = barred.groupBy("path", "var").agg(F.count("*").alias("_holes"))
    numbers = bounds.join(holes, ["path", "var"], "left").filter((F.col("low") > F.col("high")) | (F.coalesce("_holes", F.lit(0)) >= F.col("high") - F.col("low") + 1)).select("path")
    texts = predicates.filter(op.isin("eq_text", "ne_text")).groupBy("path", "var").agg(
        F.min(F.when(op == "eq_text", F.col("text"))).alias("a"), F.max(F.when(op == "eq_text", F.col("text"))).alias("b"))
    clash = predicates.filter(op == "ne_text").select("path", "var", "text").join(texts, ["path", "var"]).filter(F.col("text") == F.col("a")).select("path")
    bad = numbers.unionByName(texts.filter("a <> b").select("path")).unionByName(clash).distinct().withColumn("_bad", F.lit(True))
    open_terms = predicates.groupBy("path").agg(F.count_if(~op.isin("<", "<=", ">", ">=", "==", "!=", "eq_text", "ne_text")).alias("unsupported"))
    status = F.when(F.col("_bad"), "infeasible_under_model").when(F.col("unsupported") > 0, "unknown").otherwise("satisfiable_under_model")
    return open_terms.join(bad, "path", "left").select("path", status.alias("status"))


_LOCAL_BOUND = 2**40


def _closed_in_rows(bounds: DataFrame, barred: DataFrame) -> DataFrame:
    """Closed bounds (path, i, j, w) of paths with few names, one matrix per row: only names below themselves and ``barred`` pairs come out."""
    asked = barred.groupBy("path").agg(F.collect_set(F.struct("i", "j")).alias("asked"))
    cells = bounds.groupBy("path").agg(F.collect_list(F.struct("i", "j", "w")).alias("cells")).join(asked, "path", "left")
    placed = cells.selectExpr("path", "asked", "cells", "transform(filter(cells, c -> c.i = c.j), c -> c.i) as names").selectExpr("*", "size(names) as n")
    known = placed.selectExpr("path", "asked", "names", "n", "map_from_entries(transform(cells, c -> struct(cast((array_position(names, c.i) - 1) * n + array_position(names, c.j) - 1 as int), c.w))) as known")
    start = known.selectExpr("path", "asked", "names", "n", "transform(sequence(0, n * n - 1), p -> try_element_at(known, p)) as d")
    closed = start.selectExpr("path", "asked", "names", "n", "aggregate(sequence(0, n - 1), d, (d, k) -> transform(d, (v, p) -> least(v, get(d, cast(p div n as int) * n + k) + get(d, k * n + p % n)))) as d")
    rows = closed.selectExpr("path", "asked", "inline(transform(d, (w, p) -> struct(get(names, cast(p div n as int)) as i, get(names, p % n) as j, w)))").filter("w is not null")
    wanted = F.array_contains("asked", F.struct("i", "j")) | F.array_contains("asked", F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return rows.filter(((F.col("i") == F.col("j")) & (F.col("w") < 0)) | wanted).select("path", "i", "j", "w")


def _linked_feasibility(predicates: DataFrame, local_names: int = 16) -> DataFrame:
    """Status of paths that compare names with each other: closed difference bounds.

    Every comparison is one or two bounds i - j <= w, with a name for zero. Paths of up to
    ``local_names`` names are closed as one matrix each; the closure of longer ones joins bounds as
    often as it takes to cover all names of the longest. A name below itself is a contradiction.
    Of the differences that must not take a value, a single one that matters is decided exactly;
    several may exclude each other in ways that bounds do not show, which is unknown.
    """
    zero, c = F.lit("0"), F.coalesce("value", F.lit(0)).cast("long")
    numeric = predicates.filter(F.col("op").isin("<", "<=", ">", ">=", "==", "!="))
    named = stored(numeric.select("path", F.coalesce(F.concat(F.lit("="), "var"), F.lit("?")).alias("x"), F.coalesce(F.concat(F.lit("="), "other"), zero).alias("y"), "op", c.alias("c")))
    op, bound = F.col("op"), lambda i, j, w: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), w.alias("w"))
    up = F.when(op.isin("<=", "=="), F.col("c")).when(op == "<", F.col("c") - 1)
    down = F.when(op.isin(">=", "=="), -F.col("c")).when(op == ">", -F.col("c") - 1)
    rows = named.select("path", F.explode(F.array(bound("x", "y", up), bound("y", "x", down))).alias("b")).select("path", "b.*").filter("w is not null")
    itself = named.select("path", F.explode(F.array("x", "y")).alias("i")).distinct().select("path", "i", F.col("i").alias("j"), F.lit(0).cast("long").alias("w"))
    bounds = stored(rows.unionByName(itself).groupBy("path", "i", "j").agg(F.min("w").alias("w")))
    # x - y must not be c; each pair once, with the range that the bounds leave to it
    turned = F.col("x") > F.col("y")
    barred = named.filter("op = '!='").select("path", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(turned, -F.col("c")).otherwise(F.col("c")).alias("c")).distinct()
    shape = bounds.groupBy("path").agg(F.count_if(F.col("i") == F.col("j")).alias("n"), F.min("w").alias("_least"), F.max("w").alias("_most"))
    large = stored(shape.filter((F.col("n") > local_names) | (F.col("_least") < -_LOCAL_BOUND) | (F.col("_most") > _LOCAL_BOUND)).select("path", "n"))
    closed = stored(_closed_in_rows(bounds.join(large, "path", "left_anti"), barred))
    names = large.agg(F.max("n")).first()[0]
    if names:
        bounds = bounds.join(large, "path", "left_semi")
        for _ in range((names - 1).bit_length()):
            then = bounds.select("path", F.col("i").alias("j"), F.col("j").alias("_k"), F.col("w").alias("_w"))
            bounds = stored(bounds.join(then, ["path", "j"]).select("path", "i", F.col("_k").alias("j"), (F.col("w") + F.col("_w")).alias("w")).groupBy("path", "i", "j").agg(F.min("w").alias("w")))
        closed = closed.unionByName(bounds)
    bounds = closed
    below = bounds.filter("i = j and w < 0").select("path").distinct()
    high = bounds.withColumnRenamed("w", "_high")
    low = bounds.select("path", F.col("i").alias("j"), F.col("j").alias("i"), (-F.col("w")).alias("_low"))
    met = barred.join(high, ["path", "i", "j"], "left").join(low, ["path", "i", "j"], "left")
    inside = met.filter((F.col("_high").isNull() | (F.col("c") <= F.col("_high"))) & (F.col("_low").isNull() | (F.col("c") >= F.col("_low"))))
    pairs = stored(inside.groupBy("path", "i", "j").agg(F.count("*").alias("_holes"), (F.first("_high") - F.first("_low") + 1).alias("_room")))
    # nothing lets a pair of equal names differ
    full = pairs.filter("_holes >= _room").select("path").distinct()
    several = pairs.groupBy("path").agg(F.count("*").alias("_pairs")).filter("_pairs > 1").select("path", F.lit(True).alias("_open"))
    # texts and unsupported terms are judged as on any other path
    texts = _scalar_feasibility(predicates.filter(~F.col("op").isin("<", "<=", ">", ">=", "==", "!="))).withColumnRenamed("status", "_texts")
    bad = below.unionByName(full).distinct().withColumn("_bad", F.lit(True))
    every = predicates.select("path").distinct().join(bad, "path", "left").join(several, "path", "left").join(texts, "path", "left")
    status = (
        F.when(F.col("_bad") | (F.col("_texts") == "infeasible_under_model"), "infeasible_under_model")
        .when(F.col("_open") | (F.col("_texts") == "unknown"), "unknown").otherwise("satisfiable_under_model")
    )
    return every.select("path", status.alias("status"))


def _by_tables(predicates: DataFrame, local_names: int) -> DataFrame:
    """Status of paths of any length, by joins of their terms."""
    predicates = stored(predicates)
    linked = stored(predicates.filter("other is not null").select("path").distinct())
    alone = _scalar_feasibility(predicates.join(linked, "path", "left_anti"))
    return alone.unionByName(_linked_feasibility(predicates.join(linked, "path", "left_semi"), min(local_names, 16)))


def _decided(terms: DataFrame, local_names: int, local_rows: int) -> tuple[DataFrame, DataFrame]:
    """(path, reach, counter) as numbers of a status, and the paths that are left to tables: those of many terms or names, or with a number too large.

    ``terms``: the columns of predicates and ``asked``. Paths travel once and are decided side by side, many in one batch.
    """
    known = F.array_position(F.array(*[F.lit(o) for o in difference_bounds.OPS]), F.col("op"))
    number = F.when(F.col("op").isNull(), difference_bounds.NO_OP).when(known == 0, difference_bounds.UNSUPPORTED).otherwise(known - 1).cast("byte")
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = terms.filter("path is not null").select("path", "asked", number.alias("op"), text("var"), text("other"), F.col("value").cast("long").alias("value"), text("text"))
    wide = stored(rows.groupBy("path").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_rows).select("path"))
    rows = rows if wide.isEmpty() else rows.join(wide, "path", "left_anti")
    schema = T.StructType([rows.schema["path"], T.StructField("reach", T.ByteType()), T.StructField("counter", T.ByteType())])
    solved = stored(rows.repartition("path").sortWithinPartitions("path").mapInArrow(difference_bounds.decider(local_names), schema))
    beyond = F.least("reach", "counter") == difference_bounds.BEYOND
    # stored, so that Spark knows how few they are before it joins them
    return solved.filter(~beyond), stored(wide.unionByName(solved.filter(beyond).select("path")))


def _status(number: str) -> Column:
    names = {difference_bounds.SATISFIABLE: "satisfiable_under_model", difference_bounds.INFEASIBLE: "infeasible_under_model", difference_bounds.UNKNOWN: "unknown"}
    return reduce(lambda c, item: c.when(F.col(number) == item[0], item[1]), list(names.items())[1:], F.when(F.col(number) == 0, names[0]))


def branch_feasibility(predicates: DataFrame, local_names: int = 64, local_rows: int = 2_000) -> DataFrame:
    """Status of each path's conjunction of predicates (path, var, op, value or text, and if given other).

    A row compares ``var`` with ``value``, or with the name ``other`` plus ``value`` (null: 0). Paths
    without any comparison of two names are decided name by name, the rest by difference bounds; a
    contradiction makes a path infeasible, otherwise a term beyond the model makes it unknown.
    ``local_names`` and ``local_rows`` bound what a path may have to be decided in a batch; others are decided by tables.
    """
    if "other" not in predicates.columns:
        return _scalar_feasibility(predicates)
    predicates = stored(predicates)
    solved, left = _decided(predicates.withColumn("asked", F.lit(False)), local_names, local_rows)
    # no term contradicts another on a path that is null
    strange = F.coalesce(~F.col("op").isin(*difference_bounds.OPS), F.lit(False))
    nowhere = predicates.filter("path is null").groupBy("path").agg(F.when(F.bool_or(strange), "unknown").otherwise("satisfiable_under_model").alias("status"))
    out = solved.select("path", _status("reach").alias("status")).unionByName(nowhere)
    return out if left.isEmpty() else out.unionByName(_by_tables(predicates.join(left, "path", "left_semi"), local_names))


def implies(predicates: DataFrame, required: DataFrame, local_names: int = 64, local_rows: int = 2_000) -> DataFrame:
    """Whether each path forces its required condition (path, var, op, value, and if given other): the path is feasible and its negation is not."""
    negated = F.create_map(*[F.lit(x) for x in ("<", ">=", "<=", ">", ">", "<=", ">=", "<", "==", "!=", "!=", "==")])
    nameless, named = F.lit(None).cast("string").alias("other"), "other" in predicates.columns or "other" in required.columns
    if named:
        predicates = predicates if "other" in predicates.columns else predicates.select("*", nameless)
        required = required if "other" in required.columns else required.select("*", nameless)
    flipped = required.withColumn("op", F.element_at(negated, F.col("op"))).withColumn("text", F.lit(None).cast("string"))
    flipped = flipped.select([c for c in ("path", "var", "op", "value", "text", "other") if c in flipped.columns])
    verdict = (
        F.when(F.col("_reach") != "satisfiable_under_model", "unknown").when(F.col("_counter") == "infeasible_under_model", "implied_under_model")
        .when(F.col("_counter") == "satisfiable_under_model", "counterexample_under_model").otherwise("unknown")
    )
    met = lambda paths, reach, counter: paths.distinct().join(reach.withColumnRenamed("status", "_reach"), "path", "left").join(counter.withColumnRenamed("status", "_counter"), "path", "left").select("path", verdict.alias("status"))
    if not named:
        return met(required.select("path"), branch_feasibility(predicates), branch_feasibility(predicates.select(*flipped.columns).unionByName(flipped)))
    # a path travels once, with the terms that are asked for
    terms = stored(predicates.select(*flipped.columns).withColumn("asked", F.lit(False)).unionByName(flipped.withColumn("asked", F.lit(True))))
    solved, left = _decided(terms, local_names, local_rows)
    nowhere = terms.filter("asked and path is null").select("path", F.lit("unknown").alias("status")).distinct()
    out = solved.filter(F.col("counter") != difference_bounds.ABSENT).select("path", _status("reach").alias("_reach"), _status("counter").alias("_counter")).select("path", verdict.alias("status")).unionByName(nowhere)
    if left.isEmpty():
        return out
    rest = stored(terms.join(left, "path", "left_semi"))
    return out.unionByName(met(rest.filter("asked").select("path"), _by_tables(rest.filter("not asked").drop("asked"), local_names), _by_tables(rest.drop("asked"), local_names)))


def _connected_in_rows(links: DataFrame) -> DataFrame:
    """(route, id, component) of routes with few links (route, a, b), one row per route: every link unites the groups it touches."""
    rows = links.groupBy("route").agg(F.collect_set(F.struct("a", "b")).alias("links"))
    touched = "array_contains(g, l.a) or array_contains(g, l.b)"
    united = f"concat(filter(gs, g -> not ({touched})), array(array_union(array_distinct(array(l.a, l.b)), flatten(filter(gs, g -> {touched})))))"
    groups = rows.selectExpr("route", f"explode(aggregate(links, cast(array() as array<array<string>>), (gs, l) -> {united})) as g")
    return groups.selectExpr("route", "explode(g) as id", "array_min(g) as component")


def compose_route(parts: DataFrame, predicates: DataFrame, bindings: DataFrame, max_parts: int = 32, local_links: int = 64) -> DataFrame:
    """Feasibility of routes joined from per-function pieces.

    ``parts``: route, part, frame, gap. ``predicates``: route, frame, var, op, value, text. ``bindings``:
    route, frame, name, source_frame, source_name, exact. Names are told apart by frame; exact bindings
    make all names that they connect one, in chains of any length. A gap, an inexact binding or too many parts makes the route unknown.
    Names of a route with up to ``local_links`` links are connected in one row, those of larger ones by rounds over all of them.
    """
    name = lambda frame, var: F.concat_ws("|", F.col("route").cast("string"), F.col(frame).cast("string"), F.col(var))
    links = bindings.filter("exact").select("route", name("frame", "name").alias("a"), name("source_frame", "source_name").alias("b"))
    large = stored(links.groupBy("route").agg(F.count("*").alias("n")).filter(F.col("n") > local_links).select("route"))
    if large.isEmpty():
        roots = _connected_in_rows(links)
    else:
        wide = stored(components(links.join(large, "route", "left_semi").select("a", "b")))
        # a name holds its route as text, and so do the rows of the small ones
        of_route = links.join(large, "route", "left_semi").select("route", F.explode(F.array("a", "b")).alias("id")).distinct()
        roots = _connected_in_rows(links.join(large, "route", "left_anti")).unionByName(of_route.join(wide, "id").select("route", "id", "component"))
    # a name that is its own component needs no row
    roots = stored(roots.filter("id <> component"))
    scoped = predicates.withColumn("id", name("frame", "var")).join(roots, ["route", "id"], "left").withColumn("var", F.coalesce("component", "id")).drop("id", "component")
    if "other" in predicates.columns:
        scoped = scoped.withColumn("id", F.when(F.col("other").isNotNull(), name("frame", "other"))).join(roots, ["route", "id"], "left").withColumn("other", F.coalesce("component", "id"))
    merged = scoped.select(F.col("route").alias("path"), *[c for c in ("var", "op", "value", "text", "other") if c in scoped.columns])
    solved = branch_feasibility(merged).withColumnRenamed("path", "route")
    shape = parts.groupBy("route").agg(F.count("*").alias("parts"), F.bool_or("gap").alias("_gap"))
    loose = bindings.filter("not exact").select("route").distinct().withColumn("_loose", F.lit(True))
    joined = shape.join(loose, "route", "left").join(solved, "route", "left")
    unsure = F.col("_gap") | F.coalesce("_loose", F.lit(False)) | (F.col("parts") > max_parts)
    return joined.select("route", "parts", F.when(unsure, "unknown").otherwise(F.coalesce("status", F.lit("satisfiable_under_model"))).alias("status"))


def dyadic_cover(low: Column, high: Column, levels: int = 40) -> Column:
    """Blocks (level, block) that tile the whole range low..high: at most two per level."""
    def step(acc, level):
        left, right = acc["lo"] % 2 == 1, acc["hi"] % 2 == 1
        open_range = acc["lo"] < acc["hi"]
        block = lambda b: F.struct(level.alias("level"), b.alias("block"))
        first = F.when(open_range & left, F.array(block(acc["lo"]))).otherwise(F.array().cast(cells))
        lo = F.when(open_range & left, acc["lo"] + 1).otherwise(acc["lo"])
        last = F.when((lo < acc["hi"]) & right, F.array(block(acc["hi"] - 1))).otherwise(F.array().cast(cells))
        hi = F.when((lo < acc["hi"]) & right, acc["hi"] - 1).otherwise(acc["hi"])
        return F.struct(F.floor(lo / 2).alias("lo"), F.floor(hi / 2).alias("hi"), F.concat(acc["out"], first, last).alias("out"))

    cells = "array<struct<level:int,block:bigint>>"
    start = F.struct(low.cast("long").alias("lo"), (high.cast("long") + 1).alias("hi"), F.array().cast(cells).alias("out"))
    # no block is longer than the range, so a short one needs few steps; its length in binary digits is exact
    steps = F.least(F.length(F.bin(F.try_subtract(high.cast("long") + 1, low.cast("long")))) - 1, F.lit(levels - 1))
    return F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda acc: acc["out"])


def locate(points: DataFrame, regions: DataFrame, levels: int = 40) -> DataFrame:
    """Smallest region that contains each point (id, path, line, col).

    ``regions``: region, path, line, col, end_line, end_col. Ranges become a few dyadic blocks and a
    point one block per level, so containment is an equi join that meets only containing regions,
    whatever their length.
    """
    cover = regions.select("region", "path", F.struct("line", "col").alias("_a"), F.struct("end_line", "end_col").alias("_b"), (F.col("end_line") - F.col("line")).alias("_span"), (F.col("end_col") - F.col("col")).alias("_width"),
                           F.explode(dyadic_cover(F.col("line"), F.col("end_line"), levels)).alias("_c")).select("*", "_c.level", "_c.block").drop("_c")
    # a point needs a block only on the levels that its path uses at all
    used = cover.groupBy("path").agg(F.collect_set("level").alias("_levels"))
    blocks = F.transform("_levels", lambda n: F.struct(n.alias("level"), F.floor(F.col("line") / F.pow(F.lit(2.0), n)).alias("block")))
    asked = points.join(used, "path").select("id", "path", F.struct("line", "col").alias("_p"), F.explode(blocks).alias("_c")).select("id", "path", "_p", "_c.level", "_c.block")
    met = asked.join(cover, ["path", "level", "block"]).filter((F.col("_a") <= F.col("_p")) & (F.col("_p") <= F.col("_b")))
    return met.groupBy("id").agg(F.min(F.struct("_span", "_width", "region")).alias("_m")).select("id", "_m.region")


def match_location(queries: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites at a location: same path and line, and every coordinate the query knows agrees (0 or '' is unknown). Ambiguity keeps all."""
    named = calls.select("call_id", "path", "line", *[F.col(c).alias(f"_{c}") for c in ("col", "end_line", "end_col", "location_id")])
    agree = reduce(lambda a, b: a & b, [(F.col(c) == 0) | (F.col(c) == F.col(f"_{c}")) for c in ("col", "end_line", "end_col")])
    return queries.filter("line > 0").join(named, ["path", "line"]).filter(agree & ((F.col("location_id") == "") | (F.col("location_id") == F.col("_location_id")))).select("query_id", "call_id")


def bind_arguments(arguments: DataFrame, parameters: DataFrame, policies: DataFrame) -> DataFrame:
    """(call, target, parameter, value, how, uncertain): positional up to the first spread, then keywords, variadic slots and defaults.

    ``arguments``: call, target, language, position (null for a keyword), keyword, value, spread.
    ``parameters``: target, position, name, variadic, default. ``policies``: language, positional,
    by_keyword, receiver_offset.
    """
    policy = arguments.join(policies, "language")
    spread = arguments.groupBy("call").agg(F.min(F.when(F.col("spread") & F.col("position").isNotNull(), F.col("position"))).alias("_stop"), F.bool_or(F.col("spread") & F.col("position").isNull()).alias("_open"), F.bool_or("spread").alias("_any"))
    work = policy.join(spread, "call").withColumn("_slot", F.col("position") + F.col("receiver_offset"))
    plain = work.filter(F.col("positional") & F.col("position").isNotNull() & ~F.col("spread") & (F.col("_stop").isNull() | (F.col("position") < F.col("_stop"))))
    fixed = parameters.filter("not variadic").select("target", F.col("position").alias("_slot"), F.col("name").alias("parameter"))
    rest = parameters.filter("variadic").select("target", F.col("position").alias("_from"), F.col("name").alias("_rest"))
    positional = plain.join(fixed, ["target", "_slot"]).select("call", "target", "parameter", "value", F.lit("positional").alias("how"), "_open")
    variadic = plain.join(rest, "target").filter(F.col("_slot") >= F.col("_from")).select(
        "call", "target", F.concat("_rest", F.lit("["), (F.col("_slot") - F.col("_from")).cast("string"), F.lit("]")).alias("parameter"), "value", F.lit("variadic").alias("how"), "_open")
    names = parameters.filter("not variadic").select("target", F.col("name").alias("keyword"))
    keyword = work.filter(F.col("keyword").isNotNull() & F.col("by_keyword")).join(names, ["target", "keyword"]).select(
        "call", "target", F.col("keyword").alias("parameter"), "value", F.lit("keyword").alias("how"), "_open")
    bound = positional.unionByName(variadic).unionByName(keyword)
    whole = arguments.select("call", "target").distinct().join(spread.filter("not _any").select("call"), "call", "left_semi")
    defaults = parameters.filter("default is not null and not variadic").select("target", F.col("name").alias("parameter"), F.col("default").alias("value"))
    omitted = whole.join(defaults, "target").join(bound.select("call", "target", "parameter").distinct(), ["call", "target", "parameter"], "left_anti").select(
        "call", "target", "parameter", "value", F.lit("default").alias("how"), F.lit(False).alias("_open"))
    return bound.unionByName(omitted).withColumnRenamed("_open", "uncertain")


def bind_value_boundaries(boundaries: DataFrame, functions: DataFrame, nodes: DataFrame, reachable: DataFrame) -> DataFrame:
    """Transfer records attached to real operations on both sides.

    ``boundaries``: id, and per side path, line, names. ``functions``: region rows for ``locate``.
    ``nodes``: fn, node, path, line, uses, defs. A record is dropped when a name is not read or written
    there, or when an operation cannot be reached.
    """
    def side(prefix: str, check: Column) -> DataFrame:
        points = boundaries.select("id", F.col(f"{prefix}_path").alias("path"), F.col(f"{prefix}_line").alias("line"), F.lit(1).alias("col"))
        owner = locate(points, functions)
        at = boundaries.select("id", F.col(f"{prefix}_path").alias("path"), F.col(f"{prefix}_line").alias("line"), F.col(f"{prefix}_names").alias("_names"))
        hit = at.join(owner, "id").join(nodes, ["path", "line"]).filter((F.col("region") == F.col("fn")) & check)
        return hit.join(reachable.select("fn", "node"), ["fn", "node"], "left_semi").select("id", F.col("fn").alias(f"{prefix}_fn"), F.col("node").alias(f"{prefix}_node"))

    reads = F.size(F.array_except("_names", F.array_union("uses", "defs"))) == 0
    written = F.size(F.array_except("_names", "defs")) == 0
    return side("source", reads).join(side("target", written), "id")


def forward_roles(parameters: DataFrame, passes: DataFrame, max_hops: int = 4) -> tuple[DataFrame, DataFrame]:
    """(roles, ambiguous parameters): roles of parameters carried on by calls that pass them unchanged, by the shortest route.

    ``parameters``: fn, param, role. ``passes``: fn, param, call, target, target_param. A parameter
    with several roles keeps none and is reported.
    """
    moves = pin(passes.select("fn", "param", F.col("call").cast("string").alias("call"), "target", "target_param"))
    none = F.array().cast("array<string>")
    level = pin(parameters.select("fn", "param", "role", none.alias("route")).distinct())
    levels = [level]
    for _ in range(max_hops):
        seen = reduce(DataFrame.unionByName, [x.select("fn", "param", "role") for x in levels])
        grown = level.join(moves, ["fn", "param"]).select(F.col("target").alias("fn"), F.col("target_param").alias("param"), "role", F.array_append("route", F.col("call")).alias("route"))
        level = pin(grown.groupBy("fn", "param", "role").agg(F.min("route").alias("route")).join(seen, ["fn", "param", "role"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels)
    counts = every.groupBy("fn", "param").agg(F.count("*").alias("roles"))
    clean = every.join(counts.filter("roles = 1").select("fn", "param"), ["fn", "param"], "left_semi")
    return clean, counts.filter("roles > 1")


def propagate_taint(
    sources: DataFrame, local_uses: DataFrame, calls: DataFrame, bindings: DataFrame, results: DataFrame, sinks: DataFrame,
    boundaries: DataFrame | None = None, max_depth: int = 8, max_states: int | None = 256, max_variants: int | None = 8, max_rounds: int = 40, max_names: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """(flows, states) of values followed through calls and returns, with a call stack.

    ``sources``: src, fn, var. ``local_uses``: fn, var, use_kind (call / return / sink), use_id, name,
    certainty: what a value reaches inside its function, worked out once. ``calls``: call_id, caller,
    callee, certainty. ``bindings``: call_id, name, param. ``results``: call_id, result. ``sinks``:
    use_id, snk. ``boundaries``: boundary_id, fn, var, to_fn, to_var (always may).

    A return goes to the call on top of the stack; with an empty stack it goes to every caller.
    Budgets per source (in states of one length) and per (source, sink) set ``truncated``.

    With ``max_variants`` equal states are merged: a place with its stack, depth and certainty keeps its
    first ``max_variants`` + 1 routes, and one that has so many already, none of them deeper, takes no
    longer route. All of them go on alike, so the kept variants are those of the full enumeration, while
    diamonds and loops of calls add states one after the other instead of multiplying them. Longer ways
    round a loop that are left out like this are not followed to the depth limit and do not flag it.
    """
    calls, local = stored(calls), stored(local_uses)
    into = stored(local.filter("use_kind = 'call'").select("fn", "var", F.col("use_id").alias("call_id"), "name", F.col("certainty").alias("_lc")).join(calls, "call_id").join(bindings, ["call_id", "name"]).select(
        "fn", "var", "call_id", F.col("callee").alias("_to"), F.col("param").alias("_var"), F.when((F.col("_lc") == "may") | (F.col("certainty") != "must"), True).otherwise(False).alias("_u")))
    leave = stored(local.filter("use_kind = 'return'").select("fn", "var", F.col("certainty").alias("_lc")))
    back = stored(calls.join(results, "call_id").select(F.col("call_id").alias("_call"), F.col("caller").alias("_to"), F.col("callee").alias("fn"), F.col("result").alias("_var"), (F.col("certainty") != "must").alias("_u")))
    ends = local.filter("use_kind = 'sink'").select("fn", "var", "use_id", F.col("certainty").alias("_lc")).join(sinks, "use_id")
    none = F.array().cast("array<string>")
    cuts, level = [], stored(sources.select("src", "fn", "var", none.alias("stack"), none.alias("steps"), F.lit(False).alias("uncertain"), F.lit(0).alias("depth")).distinct())
    levels, visited, columns = [level], None, level.columns
    place = ["src", "fn", "var", "stack", "uncertain"]
    # where the last step tells place and certainty before it, states of one length cannot meet; a hash met twice only means that they may
    once = lambda df, *keys: df.groupBy(F.xxhash64(*keys)).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    apart = once(leave, "fn") and once(into, "call_id", "_to", "_var") and once(back, "_call", "_to", "_var") and (boundaries is None or once(boundaries, "boundary_id", "to_fn", "to_var"))
    step = lambda tag, ident: F.array_append("steps", F.concat(F.lit(tag + ":"), ident.cast("string")))
    for number in range(max_rounds):
        # a round reads only uses of the names it holds
        names = [r[0] for r in level.select("var").distinct().limit(max_names + 1).collect()]
        held = F.col("var").isin(names) if len(names) <= max_names else F.lit(True)
        parts = [level.join(into.filter(held), ["fn", "var"]).select(
            "src", F.col("_to").alias("fn"), F.col("_var").alias("var"), F.array_append("stack", F.col("call_id").cast("string")).alias("stack"), step("call", F.col("call_id")).alias("steps"),
            (F.col("uncertain") | F.col("_u")).alias("uncertain"), (F.col("depth") + 1).alias("depth"))]
        if not leave.filter(held).isEmpty():
            out = stored(level.join(leave.filter(held), ["fn", "var"]).withColumn("_top", F.get("stack", F.size("stack") - 1)).drop("var"))
            # joined by call, as one callee may have many; only values without a caller go to all of them
            returns = [out.filter("_top is not null").join(back.withColumn("_top", F.col("_call").cast("string")), ["fn", "_top"])] if not out.filter("_top is not null").isEmpty() else []
            returns += [out.filter("_top is null").join(back, "fn")] if not out.filter("_top is null").isEmpty() else []
            parts += [r.select(
                "src", F.col("_to").alias("fn"), F.col("_var").alias("var"), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))).alias("stack"), step("return", F.col("_call")).alias("steps"),
                (F.col("uncertain") | F.col("_u") | (F.col("_lc") == "may")).alias("uncertain"), (F.col("depth") + F.col("_top").isNull().cast("int")).alias("depth")) for r in returns]
        if boundaries is not None:
            side = level.join(boundaries, ["fn", "var"])
            parts.append(side.select("src", F.col("to_fn").alias("fn"), F.col("to_var").alias("var"), none.alias("stack"), step("boundary", F.col("boundary_id")).alias("steps"), F.lit(True).alias("uncertain"), (F.col("depth") + 1).alias("depth")))
        # what lies too deep shrinks to one row per source that flags the cut
        shallow = F.col("depth") <= max_depth
        grown = reduce(DataFrame.unionByName, parts).select("src", *[F.when(shallow, F.col(c)).alias(c) for c in columns if c != "src"])
        grown = grown if apart else grown.distinct()
        first = F.col("fn").isNotNull()
        if max_variants is not None:
            if number % 4 == 3:  # short searches never come here; between refreshes fewer are known
                counted = reduce(DataFrame.unionByName, levels[-4:]).groupBy(*place).agg(F.count("*").alias("_routes"), F.max("depth").alias("_deepest"))
                visited = stored(counted if visited is None else visited.unionByName(counted).groupBy(*place).agg(F.sum("_routes").alias("_routes"), F.max("_deepest").alias("_deepest")))
            if visited is not None:
                full = visited.filter(F.col("_routes") > max_variants).select(*[F.col(c).alias(f"_{c}") for c in place], "_deepest")
                grown = grown.join(full, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in place]) & (F.col("depth") >= F.col("_deepest")), "left_anti")
            grown, first = top_n(grown, [*place, "depth"], ["steps"], max_variants + 1, "_variant"), first & (F.col("_variant") == 1)
        if max_states is not None:
            grown = stored(grown)
            ranked = top_n(grown.filter(first), ["src"], ["steps", "fn", "var", "stack", "depth", "uncertain"], max_states + 1)
            over = stored(ranked.filter(F.col("rn") > max_states).select("src"))
            if not over.isEmpty():
                cuts.append(over)
                kept = ranked.filter(F.col("rn") <= max_states).select(*place, "depth")
                grown = stored(grown.filter("fn is null").unionByName(grown.join(kept, [*place, "depth"], "left_semi")))
        grown = grown.select(*columns) if max_states is not None else stored(grown.select(*columns))
        cuts.append(grown.filter("fn is null").select("src"))
        level = grown.filter("fn is not null")
        if level.isEmpty():
            break
        levels.append(level)
    else:
        cuts.append(level.select("src"))
    states = reduce(DataFrame.unionByName, levels)
    flows = states.join(ends, ["fn", "var"]).select("src", "snk", "steps", F.when(F.col("uncertain") | (F.col("_lc") == "may"), "may").otherwise("must").alias("certainty"), F.size("steps").alias("length"))
    if max_variants is not None:
        ranked = pin(top_n(flows, ["src", "snk"], ["length", "steps", "certainty"], max_variants + 1))
        cuts.append(ranked.filter(F.col("rn") > max_variants).select("src"))
        flows = ranked.filter(F.col("rn") <= max_variants).drop("rn")
    cut = reduce(DataFrame.unionByName, cuts).distinct().withColumn("truncated", F.lit(True))
    return flows.join(cut, "src", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False))), states


def taint_frontier(states: DataFrame, local_uses: DataFrame, unresolved: DataFrame, prefix: int = 64) -> DataFrame:
    """Unresolved or external calls that a followed value reaches, with the first known steps.

    ``unresolved``: call_id, reason.
    """
    reach = local_uses.filter("use_kind = 'call'").select("fn", "var", F.col("use_id").alias("call_id"), "name", "certainty")
    met = states.join(reach.join(unresolved, "call_id").distinct(), ["fn", "var"])
    return met.select("src", "call_id", "reason", "name", F.slice("steps", 1, prefix).alias("known_prefix"), F.greatest(F.lit(0), F.size("steps") - prefix).alias("omitted_steps"))


def evidence_graph(routes: DataFrame, operations: DataFrame, edges: DataFrame, per_target: int = 8, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, merged edges) of all candidate routes plus unpaired operations with two rounds of callers.

    ``routes``: route, nodes, edge_ids. ``operations``: id (a node). Parallel edges are merged, and
    every original id stays mapped to the one that is kept.
    """
    from tracewell.operators.graphs import incoming_context, merge_parallel_edges

    on_route = routes.select(F.explode("edge_ids").alias("id"))
    context = incoming_context(edges.filter("relation = 'calls'"), operations, 2, per_target, max_edges)
    wanted = on_route.unionByName(context.select("id")).distinct()
    # read once, and only by whoever takes the edges
    used = edges.join(wanted, "id", "left_semi")
    # the smallest number of a node is its role: one exchange, and many rows of a node shrink before it
    role = lambda df, number: df.withColumn("_role", F.lit(number))
    nodes = role(routes.select(F.explode("nodes").alias("id")), 0).unionByName(role(operations.select("id"), 1)).unionByName(role(context.select(F.col("source").alias("id")), 2))
    named = F.element_at(F.array(*[F.lit(r) for r in ("route", "operation", "context")]), F.col("_role") + 1)
    return nodes.groupBy("id").agg(F.min("_role").alias("_role")).select("id", named.alias("role")), merge_parallel_edges(used)


def build_candidates(flows: DataFrame, leads: DataFrame, facts: DataFrame, unresolved: DataFrame, cap: int | None = None, fact_limit: int = 12, unresolved_limit: int = 20) -> DataFrame:
    """Candidate rows from flows first and structural leads after, with what lies on their way.

    ``flows`` / ``leads``: src, snk, nodes, edge_ids, flow_id (null for leads), steps. Every cut is flagged.
    """
    from tracewell.operators import evidence

    # a row moves with its packed id and what it is ranked by; digests of its ends are made last
    named = lambda df: df.select("src", "snk", "nodes", "steps", "edge_key", packed(evidence.candidate_id("src", "snk", F.col("edge_ids"), F.col("flow_id"))).alias("_id"))
    made = evidence.interleave_variants(named(flows), named(leads), ["src", "snk"], ["steps", "edge_key"], cap).select("_id", "src", "snk", "nodes", "phase", "variant_no")
    # without a cap the ranked rows lie in files already
    made = made if cap is None else stored(made)
    checking, one = facts.filter("fact_kind in ('guard', 'sanitizer')"), lambda cond: F.when(cond, 1).otherwise(0).cast("long")
    found = checking.select("symbol", one(F.col("fact_kind") == "guard").alias("_g"), one(F.col("fact_kind") == "sanitizer").alias("_s"), one(F.lit(False)).alias("_u"))
    found = found.unionByName(unresolved.select("symbol", one(F.lit(False)).alias("_g"), one(F.lit(False)).alias("_s"), one(F.lit(True)).alias("_u")))
    per_symbol = found.filter("symbol is not null").groupBy("symbol").agg(*[F.sum(c).alias(c) for c in ("_g", "_s", "_u")])
    # a reference counts once on a route, a check as often as its symbol comes
    on_way = made.select("_id", "nodes", F.posexplode("nodes").alias("_pos", "symbol")).select("_id", "symbol", (F.array_position("nodes", F.col("symbol")) == F.col("_pos") + 1).alias("_first"))
    met = stored(on_way.join(per_symbol, "symbol").groupBy("_id").agg(F.sum("_g").alias("guards"), F.sum("_s").alias("sanitizers"), F.sum(F.when(F.col("_first"), F.col("_u"))).alias("_open")))
    over = F.col("guards") + F.col("sanitizers") > fact_limit
    if not met.filter(over).isEmpty():
        # only where there are more than asked for it matters which come first
        many = evidence.facts_on_path(made.join(met.filter(over), "_id", "left_semi"), checking, "_id", fact_limit)
        first = many.groupBy("_id").agg(*[F.count_if(F.col("fact_kind") == kind).alias(f"_{kind}") for kind in ("guard", "sanitizer")])
        met = met.join(first, "_id", "left").select("_id", over.alias("_t1"), *[F.coalesce(f"_{c[:-1]}", c).alias(c) for c in ("guards", "sanitizers")], "_open")
    else:
        met = met.withColumn("_t1", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = made.drop("nodes").join(met, "_id", "left")
    return joined.select(
        unpacked("_id").alias("candidate_id"), evidence.path_group_id("src", "snk").alias("path_group_id"), "src", "snk", "phase", "variant_no",
        F.when(F.col("phase") == 1, "propagation_path").otherwise("structural_lead").alias("kind"), zero("guards").alias("guards"), zero("sanitizers").alias("sanitizers"),
        F.least(zero("_open"), F.lit(unresolved_limit)).alias("unresolved"), (F.coalesce("_t1", F.lit(False)) | (zero("_open") > unresolved_limit)).alias("truncated"))

"""Workflow graphs as node and edge frames: checks, degrees, paths, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import top_k


def degrees(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` with in_degree and out_degree; ``by`` names the columns that tell graphs apart, here and below."""
    out = edges.groupBy(*by, F.col("from_node").alias("node_id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(*by, F.col("to_node").alias("node_id")).agg(F.count("*").alias("in_degree"))
    key = [*by, "node_id"]
    return nodes.join(out, key, "left").join(into, key, "left").fillna(0, ["out_degree", "in_degree"])


def topology(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Violations (by, code, id): duplicate labels, unknown endpoints, duplicate edges, lone nodes, decisions with one branch."""
    d = degrees(nodes, edges, by)
    known = nodes.select(*by, "node_id")
    ends = edges.select(*by, F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()
    text = lambda code, c: (*by, F.lit(code).alias("code"), c.cast("string").alias("id"))
    found = [
        nodes.groupBy(*by, F.lower("title").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(*text("duplicate_label", F.col("k"))),
        ends.join(known, [*by, "node_id"], "left_anti").select(*text("unknown_endpoint", F.col("node_id"))),
        edges.groupBy(*by, "from_node", "to_node").count().where("count > 1").select(*text("duplicate_edge", F.concat_ws(">", "from_node", "to_node"))),
        d.where("in_degree = 0 and out_degree = 0").select(*text("disconnected", F.col("node_id"))),
        d.where("out_degree = 1").select(*text("missing_branch", F.col("node_id"))),
    ]
    return reduce(DataFrame.union, found)


def roots(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return nodes.join(edges.select(*by, F.col("to_node").alias("node_id")), [*by, "node_id"], "left_anti")


def terminals(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return nodes.join(edges.select(*by, F.col("from_node").alias("node_id")), [*by, "node_id"], "left_anti")


def compile_graph(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Give each graph a start node (-1) before its roots and an end node (-2) after its nodes without an exit."""
    edge = lambda a, b, name: (*by, a.cast("long").alias("from_node"), b.cast("long").alias("to_node"), F.lit(name).alias("condition"))
    more = roots(nodes, edges, by).select(*edge(F.lit(-1), F.col("node_id"), "start")).unionByName(terminals(nodes, edges, by).select(*edge(F.col("node_id"), F.lit(-2), "end")))
    two = F.array(*(F.struct(F.lit(k).cast("long").alias("node_id"), F.lit(t).alias("title")) for k, t in ((-1, "START"), (-2, "END"))))
    bounds = nodes.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.inline(two))
    return nodes.select(*by, "node_id", "title").unionByName(bounds), edges.unionByName(more)


def _paths_by_joins(nodes: DataFrame, edges: DataFrame, depth: int, by: tuple[str, ...]) -> DataFrame:
    """(by, root, path, conditions) by one join a level, for graphs of any size; there are no more levels than the largest graph has nodes."""
    size = nodes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ends = terminals(nodes, edges, by).select(*by, F.col("node_id").alias("to_node"), F.lit(True).alias("last"))
    steps = edges.join(ends, [*by, "to_node"], "left").select(*by, F.col("from_node").alias("at"), "to_node", "condition", F.coalesce("last", F.lit(False)).alias("next_last"))
    first = roots(nodes, edges, by).join(ends.withColumnRenamed("to_node", "node_id"), [*by, "node_id"], "left")
    front = first.select(*by, F.col("node_id").alias("root"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("conditions"), F.col("node_id").alias("at"), F.coalesce("last", F.lit(False)).alias("last"))
    done = front.where("last")
    for _ in range(min(depth, size) - 1):
        met = front.where(~F.col("last")).join(steps, [*by, "at"]).where(~F.array_contains("path", F.col("to_node")))
        front = met.select(*by, "root", F.array_append("path", F.col("to_node")).alias("path"), F.array_append("conditions", F.col("condition")).alias("conditions"), F.col("to_node").alias("at"), F.col("next_last").alias("last"))
        done = done.unionByName(front.where("last"))
    return done.select(*by, "root", "path", "conditions")


def _paths_in_rows(nodes: DataFrame, edges: DataFrame, depth: int, by: tuple[str, ...]) -> DataFrame:
    """The same, all nodes and edges of a graph being lists in one row, where the levels are folded."""
    known = nodes.dropna(subset=[*by, "node_id"]).groupBy(*by).agg(F.collect_list(F.col("node_id").cast("long")).alias("ids"))
    drawn = edges.dropna(subset=[*by, "from_node", "to_node"]).groupBy(*by).agg(F.collect_list(F.struct("from_node", "to_node", "condition")).alias("drawn"))
    given = known.join(drawn, [*by], "left").withColumn("drawn", F.coalesce("drawn", F.array().cast(drawn.schema["drawn"].dataType)))
    away = lambda end: F.filter("ids", lambda k: ~F.exists("drawn", lambda e: e[end] == k))
    given = given.withColumns({"roots": away("to_node"), "ends": away("from_node")})
    kind = "array<struct<path: array<bigint>, conditions: array<string>>>"
    at = lambda p: F.element_at(p["path"], -1)
    step = lambda p, e: F.struct(F.array_append(p["path"], e["to_node"].cast("long")).alias("path"), F.array_append(p["conditions"], e["condition"]).alias("conditions"))
    ahead = lambda p: F.transform(F.filter("drawn", lambda e: (e["from_node"] == at(p)) & ~F.array_contains(p["path"], e["to_node"])), lambda e: step(p, e))
    over = lambda front: F.filter(front, lambda p: F.array_contains("ends", at(p)))

    def level(seen, _):
        front = F.flatten(F.transform(seen["front"], ahead)).cast(kind)
        return F.struct(front.alias("front"), F.concat(seen["done"], over(front)).alias("done"))

    first = F.transform("roots", lambda k: F.struct(F.array(k).alias("path"), F.array().cast("array<string>").alias("conditions"))).cast(kind)
    start = F.struct(first.alias("front"), over(first).alias("done"))
    levels = F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), F.least(F.size("ids"), F.lit(depth)) - 1)
    return given.select(*by, F.explode(F.aggregate(levels, start, level)["done"]).alias("p")).select(*by, F.col("p.path")[0].alias("root"), "p.path", "p.conditions")


def paths(nodes: DataFrame, edges: DataFrame, depth: int = 18, keep: int = 18, by: tuple[str, ...] = (), small: tuple[int, int] = (64, 24)) -> DataFrame:
    """Simple paths from roots to terminals, yes before no, at most ``keep`` per root: (by, root, path, conditions, place).

    A path ends where its last node has no exit, and never visits a node twice. Graphs of at most ``small`` nodes and edges are folded in a row each, the
    others go by joins; whether there are any is all that the driver learns. Ids are integers.
    """
    if by:
        one = lambda df, n, m: df.select(*by, F.lit(n).alias("__n"), F.lit(m).alias("__m"))
        counts = one(nodes, 1, 0).unionByName(one(edges, 0, 1)).groupBy(*by).agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m"))
        large = counts.where((F.col("__n") > small[0]) | (F.col("__m") > small[1])).select(*by)
    if not by:
        done = _paths_by_joins(nodes, edges, depth, by)
    elif large.isEmpty():
        done = _paths_in_rows(nodes, edges, depth, by)
    else:
        few, rest = ((nodes.join(large, [*by], how), edges.join(large, [*by], how)) for how in ("left_anti", "left_semi"))
        done = _paths_in_rows(*few, depth, by).unionByName(_paths_by_joins(*rest, depth, by))
    order = F.array_join(F.transform("conditions", lambda c: F.when(c == "yes", "0").otherwise("1")), "")
    return top_k(done, [*by, "root"], keep, order, F.array_join(F.transform("path", lambda x: x.cast("string")), ","), rank="place")


def layout_edges(connectors: DataFrame, shapes: DataFrame, page: str) -> DataFrame:
    """(connector, from_shape, to_shape) by the nearest shape of the same page to either end; connectors whose ends meet one shape are left out.

    connectors(connector, page, x1, y1, x2, y2), shapes(shape, page, x, y); ties go to the smaller shape. Each connector meets all shapes
    of its page, so pages are expected to be small.
    """
    met = connectors.join(shapes, page)
    d = lambda x, y: F.struct(F.round(F.pow(F.col(x) - F.col("x"), F.lit(2.0)) + F.pow(F.col(y) - F.col("y"), F.lit(2.0)), 9).alias("d"), F.col("shape"))
    near = met.groupBy("connector").agg(F.min(d("x1", "y1")).alias("a"), F.min(d("x2", "y2")).alias("b"))
    return near.select("connector", F.col("a.shape").alias("from_shape"), F.col("b.shape").alias("to_shape")).where("from_shape <> to_shape")


def merge_nodes(nodes: DataFrame, page: str, key: str, node: str, title: str) -> DataFrame:
    """(node, merged_into): nodes of a page with the same key are one, the smallest id stands for them.

    Greedy merging depends on the order in which nodes come; the smallest id per group doesn't.
    """
    least = nodes.groupBy(page, key).agg(F.min(node).alias("merged_into"))
    return nodes.join(least, [page, key]).select(node, "merged_into", title)


def payload_rows(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Edges (id, from_node, to_node, condition) of nested graph payloads; null conditions become ''."""
    schema = "edges array<struct<from_node long, to_node long, condition string>>"
    rows = payloads.select(id_col, F.inline(F.from_json(json_col, schema)["edges"]))
    return rows.fillna("", ["condition"])


def condition_name(c):
    """Normalised branch condition: yes, no or the text."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("y", "yes", "true", "ok"), "yes").when(low.isin("n", "no", "false"), "no").otherwise(low)

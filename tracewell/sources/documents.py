"""JSON documents: masking, visible lines, node-link graphs and function-partitioned graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import _col, digest_id
from tracewell.functions.json_rows import clean_documents, shown_ranges


def load_node_link(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON documents: ``links`` or ``edges``, endpoints as text or as ``{id}``.

    Edges without an id get a stable surrogate from their content and position.
    """
    # every value is read as text first, so that both endpoint forms fit one schema
    raw = documents.select(key, F.from_json(text, "nodes array<map<string,string>>, links array<map<string,string>>, edges array<map<string,string>>").alias("g"))
    name = lambda col, *keys: F.coalesce(*[F.when(col[k] != "", col[k]) for k in keys], F.lit("unknown"))
    nodes = raw.select(key, F.explode("g.nodes").alias("n")).select(
        key, F.coalesce(F.col("n")["id"], F.lit("")).alias("id"), name(F.col("n"), "kind", "type").alias("kind"),
        F.col("n")["name"].alias("name"), F.col("n")["level"].alias("level"), F.col("n")["file"].alias("file"),
        F.col("n")["line"].try_cast("int").alias("line"), F.col("n")["lang"].alias("lang"),
    )
    links = raw.select(key, F.posexplode(F.coalesce("g.links", "g.edges")).alias("position", "e"))
    end = lambda k: F.coalesce(F.get_json_object(F.col("e")[k], "$.id"), F.col("e")[k], F.lit(""))
    edges = links.select(
        key, F.col("e")["id"].alias("given"), end("source").alias("source"), end("target").alias("target"),
        name(F.col("e"), "relation", "type").alias("relation"), F.coalesce(F.col("e")["dispatch"], F.lit("")).alias("dispatch"), "position",
        F.coalesce(F.col("e")["key"], F.col("position").cast("string")).alias("key_text"),
    )
    surrogate = digest_id("dependency-view-edge:", "source", "target", "relation", "key_text")
    return nodes, edges.select(key, F.coalesce(F.when(F.col("given") != "", F.col("given")), surrogate).alias("id"), "source", "target", "relation", "dispatch", "position")


PROGRAM_GRAPH_SCHEMA = """functions map<string, struct<
  nodes: map<string, struct<kind: string, definitions: array<string>, uses: array<string>, calls: array<string>>>,
  edges: array<struct<edge_id: string, source: string, target: string, kind: string, branch: string>>>>"""


def load_program_graph(documents: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, nodes, edges) of function-partitioned graph documents; the function is the partition key."""
    functions = documents.select(F.explode(F.from_json(text, PROGRAM_GRAPH_SCHEMA)["functions"]).alias("fn", "g"))
    nodes = functions.select("fn", F.explode("g.nodes").alias("node", "n")).select("fn", "node", "n.*")
    edges = functions.select("fn", F.inline("g.edges"))
    counts = functions.select("fn", F.size(F.map_keys("g.nodes")).alias("nodes"), F.size("g.edges").alias("edges"))
    return counts, nodes, edges


def sanitize_json_column(document: Column | str) -> Column:
    """Compact JSON with sorted keys: hidden fields dropped, sensitive values and secrets masked at any depth."""
    return clean_documents(_col(document))


def visible_lines(requests: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Distinct (path, line) that a request shows with text; ranges are spread out by Spark."""
    ranges = requests.select(*keys, F.explode(shown_ranges(payload)).alias("r")).filter("r.last >= r.first")
    return ranges.select(*keys, F.col("r.path").alias("path"), F.explode(F.sequence("r.first", "r.last")).alias("line")).distinct()

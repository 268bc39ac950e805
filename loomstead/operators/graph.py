"""Link and decision graphs: edges, degrees, components, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.components import connected_components


def resolve_links(links: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``src``, ``target``) links as edges between notes, and those whose target is no note.

    An alias of several notes belongs to the first (least ``order``).
    """
    names = aliases.groupBy(F.lower("alias").alias("name")).agg(F.min_by("note", "order").alias("dst"))
    met = links.withColumn("name", F.lower("target")).join(names, "name", "left")
    return met.where("dst IS NOT NULL").select("src", "dst"), met.where("dst IS NULL").select("src", "target")


def directed(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree; a node without edges is an orphan."""
    out = edges.groupBy(F.col("src").alias("note")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("note")).agg(F.count("*").alias("n_in"))
    d = nodes.join(out, "note", "left").join(into, "note", "left").fillna(0, ["n_out", "n_in"])
    return d.withColumn("degree", F.col("n_in") + F.col("n_out")).withColumn("orphan", F.col("degree") == 0)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of every node (its least member), with the component's size."""
    found = connected_components(edges)
    all_nodes = nodes.join(found.withColumnRenamed("node", "note"), "note", "left").select("note", F.coalesce("component", "note").alias("component"))
    sizes = all_nodes.groupBy("component").agg(F.count("*").alias("size"))
    return all_nodes.join(sizes, "component")


def interlinks(edges: DataFrame) -> DataFrame:
    """Edges among the neighbours of each node (its triangles) and its number of neighbours.

    Every edge is kept at its end of less degree, which bounds the pairs formed
    at a hub by the graph's size, not the square of the hub's.
    """
    e = undirected(edges)
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    s = e.join(deg, "src").withColumnRenamed("d", "ds").join(deg.withColumnRenamed("src", "dst").withColumnRenamed("d", "dd"), "dst")
    low = F.struct("ds", "src") < F.struct("dd", "dst")
    arcs = s.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = arcs.alias("x").join(arcs.alias("y"), F.col("x.a") == F.col("y.a")).where("x.b < y.b").select(F.col("x.a").alias("a"), F.col("x.b").alias("src"), F.col("y.b").alias("dst"))
    tri = wedges.join(e, ["src", "dst"])
    per = tri.select(F.explode(F.array("a", "src", "dst")).alias("src")).groupBy("src").agg(F.count("*").alias("interlinks"))
    return deg.join(per, "src", "left").select(F.col("src").alias("note"), F.col("d").alias("ring"), F.coalesce("interlinks", F.lit(0)).alias("interlinks"))


def densest(edges: DataFrame) -> DataFrame:
    """``note``, ``interlinks``, ``ring`` of the node with most edges among its neighbours (then most neighbours, then the least name), and
    a row (``src``, ``dst``) for each edge among it and them.  Members are joined, never listed in one row; a graph without edges has none."""
    e = undirected(edges)
    top = F.broadcast(interlinks(e).orderBy(F.col("interlinks").desc(), F.col("ring").desc(), "note").limit(1))  # one row
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    members = both.join(top, F.col("src") == F.col("note")).select(F.col("dst").alias("member")).union(top.select(F.col("note").alias("member")))
    inside = e.join(members, F.col("src") == F.col("member"), "left_semi").join(members, F.col("dst") == F.col("member"), "left_semi")
    return inside.join(top, F.lit(True)).select("note", "interlinks", "ring", "src", "dst")


def spellings(name: Column) -> Column:
    """A name as links may write it: as it is, with hyphens for underscores, and the other way round."""
    return F.array(F.lower(name), F.lower(F.translate(name, "-", "_")), F.lower(F.translate(name, "_", "-")))


def resolve_spellings(links: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (``src``, ``target``) as edges between notes (``key``, ``file``), and those whose target is no note.

    A note answers to the spellings of its key and of its file's name; the first
    note in order of keys has a spelling that several claim.  A target is
    looked up as it is written, then with underscores, then with hyphens.
    """
    stem = F.regexp_replace("file", r"\.md$", "")
    claimed = notes.select("key", F.explode(F.array_distinct(F.concat(spellings(F.col("key")), spellings(stem)))).alias("name"))
    names = claimed.groupBy("name").agg(F.min("key").alias("dst"))
    asked = links.select("src", "target").distinct().select("src", "target", F.posexplode(spellings(F.col("target"))).alias("place", "name"))
    found = asked.join(names, "name").groupBy("src", "target").agg(F.min_by("dst", "place").alias("dst"))
    met = links.join(found, ["src", "target"], "left")
    return met.where("dst IS NOT NULL").select("src", "dst"), met.where("dst IS NULL").select("src", "target")

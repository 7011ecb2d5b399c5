"""Graphs of typed edges (src, dst, ...): walks by frontier joins, components by star rounds, audits and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silthouse.storage import written


def pruned(edges: DataFrame, hidden: DataFrame, node: str = "id") -> DataFrame:
    """Edges without a hidden end."""
    own = hidden.select(node).distinct()
    return edges.join(own.withColumnRenamed(node, "src"), "src", "left_anti").join(own.withColumnRenamed(node, "dst"), "dst", "left_anti")


def neighbourhood(edges: DataFrame, anchor) -> DataFrame:
    return edges.filter((F.col("src") == F.lit(anchor)) | (F.col("dst") == F.lit(anchor)))


def walk(edges: DataFrame, anchor, depth: int, key: list[str]) -> DataFrame:
    """Edges within `depth` steps of an anchor, each with the step of its first visit.

    From an edge the walk goes on to edges that start at its end, or end at its start. Each step
    joins the last step's ends, a frontier without repeats, with the edges.
    """
    found = written(neighbourhood(edges, anchor).withColumn("step", F.lit(1)), "walk")
    last = found
    for step in range(2, depth + 1):
        starts, ends = last.select(F.col("dst").alias("src")).distinct(), last.select(F.col("src").alias("dst")).distinct()
        fresh = edges.join(starts, "src", "left_semi").unionByName(edges.join(ends, "dst", "left_semi")).dropDuplicates(key)
        last = written(fresh.join(found.select(*key), key, "left_anti").withColumn("step", F.lit(step)), "walk")
        if not last.limit(1).count():
            break
        found = found.unionByName(last)
    return found


def path_touching(walked: DataFrame, other) -> DataFrame:
    return neighbourhood(walked, other)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: edges at either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_connected(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), F.asc("id")).limit(n)


def orphans(edges: DataFrame, entities: DataFrame, node: str = "id") -> DataFrame:
    """side, id, edges: ends that no entity has, counted for each side."""
    sides = [edges.join(entities.select(F.col(node).alias(s)), s, "left_anti").groupBy(F.col(s).alias("id")).agg(F.count(F.lit(1)).alias("edges")).withColumn("side", F.lit(s)) for s in ("src", "dst")]
    return sides[0].unionByName(sides[1])


def merged(edges: DataFrame, mapping: DataFrame, kind: list[str]) -> DataFrame:
    """Edges with ends moved to their canonical nodes, loops dropped and each edge once. mapping: id, canonical."""
    out = edges
    for s in ("src", "dst"):
        own = mapping.select(F.col("id").alias(s), F.col("canonical").alias("_to"))
        out = out.join(own, s, "left").withColumn(s, F.coalesce("_to", s)).drop("_to")
    return out.filter("src <> dst").dropDuplicates(["src", "dst", *kind]).select(*edges.columns)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is below two others, or between two; u is above v in all edges, which don't repeat."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 and up + down > 1").count()


def components(edges: DataFrame) -> DataFrame:
    """u, v for each node u that has an edge and isn't the least of its component, which is v.

    `edges` has the columns u and v of one sortable type; direction, repeats and loops don't
    matter, rows with a null are left out. A hub's edges are never gathered: every round is a
    partial minimum for each node and a join, whose large side Spark may split. Rounds grow with
    the logarithm of a component's length; edges that are stars already take none. Each is written, so
    that the lineage stays short, and joined by merging, as small minima would all go through the driver's memory.
    """
    edges = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        edges = written(_small_star(_large_star(edges).filter("u != v").distinct()).distinct(), "edges")
    return edges


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, cluster (its least id), size: for each id that has a pair."""
    star = components(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")))
    rows = star.select(F.col("u").alias("id"), F.col("v").alias("cluster")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct())
    return rows.join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster").select("id", "cluster", "size")


def hydrated(edges: DataFrame, kinds: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Edges with src_kind, src_name, dst_kind, dst_name from the tables of their ends. kinds: kind to table, id and name; ids are unique over all kinds."""
    nodes = None
    for kind, (df, ident, name) in kinds.items():
        own = df.select(F.col(ident).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
        nodes = own if nodes is None else nodes.unionByName(own)
    out = edges
    for s in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(s), F.col("kind").alias(f"{s}_kind"), F.col("name").alias(f"{s}_name")), s, "left")
    return out


def registered(entities: DataFrame, number: str | None = None, name: str | None = None, most: int = 5) -> DataFrame:
    """Entities (id, number, name) with a registration number, else the first `most` whose name has a text."""
    if number is not None:
        return entities.filter(F.col("number") == number)
    return entities.filter(F.contains(F.lower("name"), F.lit((name or "").lower()))).orderBy("id").limit(most)


def around(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges at some entities (id), with the entity as `anchor`; an edge between two of them stands for both."""
    own = found.select(F.col("id").alias("anchor")).distinct()
    out = edges.join(own, edges.src == own.anchor)
    back = edges.filter("src <> dst").join(own, F.col("dst") == F.col("anchor"))
    return out.unionByName(back)


def document_subgraph(edges: DataFrame, document, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and distinct edges of one document."""
    own = edges.filter(F.col(column) == F.lit(document)).select("src", "dst").distinct()
    return nodes_of(own), own


def entity_documents(edges: DataFrame, entity, column: str = "document") -> DataFrame:
    """The documents whose edges touch an entity."""
    return neighbourhood(edges, entity).select(column).distinct()

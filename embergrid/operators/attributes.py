"""Projection, filters and attribute updates on node and link tables.

A network is two tables: nodes (``id``, attributes) and links (``eid``, ``src``, ``dst``,
attributes; ``src <= dst`` where undirected). Missing attributes are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


def closure(links: DataFrame) -> DataFrame:
    """Both directions of every undirected link; a self-loop once."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    back = links.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return links.select("src", "dst", *rest).unionByName(back)


def get_attribute(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The present values of an attribute."""
    return table.where(F.col(name).isNotNull()).select(*keys, name)


def set_attribute(table: DataFrame, keys: Sequence[str], name: str, values: DataFrame | Column) -> DataFrame:
    """A column from an expression, or a sparse update from (keys, value); null values are set, repeated keys an error."""
    if isinstance(values, Column):
        return table.withColumn(name, values)
    repeated = F.raise_error(F.lit("repeated key in an update")).cast(values.schema[name].dataType)
    new = values.groupBy(*keys).agg(F.when(F.count("*") > 1, repeated).otherwise(F.first(name)).alias("__new"), F.lit(True).alias("__set"))
    joined = table.join(new, list(keys), "left")
    old = F.col(name) if name in table.columns else F.lit(None)
    return joined.withColumn(name, F.when(F.col("__set"), F.col("__new")).otherwise(old)).drop("__new", "__set").select(*table.columns, *([name] if name not in table.columns else []))


def select_attributes(definitions: DataFrame, owner: str, kinds: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Attribute definitions by kind, or by name where no kind is given."""
    out = definitions.where(F.col("owner") == owner)
    if kinds:
        return out.where(F.col("type").isin(*kinds))
    return out.where(F.col("name").isin(*names)) if names else out


def check_attributes(table: DataFrame, names: Sequence[str]) -> None:
    """All attributes exist and are present in the first row."""
    missing = [n for n in names if n not in table.columns]
    if not missing and names and (row := table.select(*names).first()):
        missing = [n for n in names if row[n] is None]
    if missing:
        raise KeyError(f"missing attributes: {missing}")


def neighbours(links: DataFrame, vertex: int, directed: bool = False) -> DataFrame:
    arcs = links if directed else closure(links)
    return arcs.where(F.col("src") == vertex)


def incident(links: DataFrame, vertices: Sequence[int], how: str = "any") -> DataFrame:
    at_src, at_dst = F.col("src").isin(*vertices), F.col("dst").isin(*vertices)
    return links.where({"any": at_src | at_dst, "out": at_src, "in": at_dst}[how])


def edges_between(links: DataFrame, pairs: DataFrame, directed: bool = False) -> DataFrame:
    """``pairs`` (src, dst) with the attributes of their links; a pair without a link has nulls."""
    arcs = links if directed else closure(links)
    return pairs.join(arcs, ["src", "dst"], "left")


def has_edge(links: DataFrame, u: int, v: int, directed: bool = False) -> bool:
    arcs = links if directed else closure(links)
    return not arcs.where((F.col("src") == u) & (F.col("dst") == v)).isEmpty()


def edge_by_id(links: DataFrame, eid: int) -> dict:
    """A link by its id; an unknown id is an error."""
    row = links.where(F.col("eid") == eid).first()
    if row is None:
        raise KeyError(f"no link {eid}")
    return row.asDict()


def endpoints(links: DataFrame, eid: int) -> tuple[int, int]:
    row = edge_by_id(links, eid)
    return row["src"], row["dst"]


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` and those of ``new`` whose ids are not there yet."""
    return nodes.unionByName(new.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def add_edges(links: DataFrame, new: DataFrame, directed: bool = False) -> DataFrame:
    """``links`` and the new ones under the next ids; a link that is there already is kept as it is."""
    ends = [F.col("src"), F.col("dst")] if directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    rest = [c for c in new.columns if c not in ("src", "dst", "eid")]
    fresh = new.select(*ends, *rest).dropDuplicates(["src", "dst"]).join(links.select(*ends), ["src", "dst"], "left_anti")
    last = links.agg(F.max("eid")).first()[0] if "eid" in links.columns else None
    first = 0 if last is None else last + 1
    return links.unionByName(with_position(fresh, [F.col("src"), F.col("dst")], "eid", first), allowMissingColumns=True)


def remove_edges(links: DataFrame, gone: DataFrame, directed: bool = False) -> DataFrame:
    """``links`` without those between the pairs (src, dst) of ``gone``; ids stay."""
    pairs = (gone.select("src", "dst") if directed else closure(gone.select("src", "dst"))).distinct()
    return links.join(pairs, ["src", "dst"], "left_anti").select(*links.columns)


def remove_nodes(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone`` (id), and the links between those that stay."""
    kept = nodes.join(gone.select("id"), "id", "left_anti").select(*nodes.columns)
    out = links.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, out.select(*links.columns)


def adjacency_lists(links: DataFrame, order: str = "dst", directed: bool = False) -> DataFrame:
    arcs = links if directed else closure(links)
    return arcs.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "dst"))), lambda x: x["dst"]).alias("neighbours"))


def relabel(nodes: DataFrame, links: DataFrame, order: Sequence[Column] = (), first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Consecutive ids in the given order. Ranks come from a range sort, not from one window task."""
    named = with_position(nodes, list(order) or [F.col("id")], "new_id", first)
    ids = named.select("id", "new_id")
    out = links.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("b")), "dst")
    rest = [c for c in links.columns if c not in ("src", "dst")]
    return named, out.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)


def with_position(df: DataFrame, order: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """Dense positions in a total order: positions inside range partitions plus the partitions' bases.

    The bases are prefix sums over one row for each partition, so no task holds all rows.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written once: range bounds are sampled anew each time the plan runs
    tagged = saved(ordered.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = tagged.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__m0"))
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = tagged.join(F.broadcast(bases.select("__p", "__m0", "__base")), "__p")
    return out.withColumn(name, (F.col("__m") - F.col("__m0") + F.col("__base") + first).cast("long")).drop("__p", "__m", "__m0", "__base")


def path_to_links(paths: DataFrame, path: str = "path") -> DataFrame:
    """A row for each hop of every path; a path of fewer than two nodes is an error."""
    p = F.when(F.size(path) < 2, F.raise_error(F.lit("a path needs two nodes")).cast(paths.schema[path].dataType)).otherwise(F.col(path))
    hops = F.arrays_zip(F.slice(p, 1, F.size(path) - 1).alias("src"), F.slice(p, 2, F.size(path) - 1).alias("dst"))
    return paths.select(*[c for c in paths.columns if c != path], F.posexplode(hops).alias("hop", "x")).select("*", "x.src", "x.dst").drop("x")


def subgraph(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links with both ends among the kept node ids."""
    return links.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")


def available(links: DataFrame, demands: Mapping[str, float], ratio: float = 1.0, minus: float = 0.0) -> DataFrame:
    """Links that hold a virtual link's demands; ``ratio`` and ``minus`` scale the demands first."""
    out = links
    for name, demand in demands.items():
        out = out.where(F.col(name) >= demand * ratio - minus)
    return out


def flatten(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Entries of a map column as rows, in key order; a null leaf is an error."""
    rows = df.select(*keys, F.explode(F.array_sort(F.map_entries(column))).alias("e"))
    value = F.when(F.col("e.value").isNull(), F.raise_error(F.lit("null leaf")).cast("string")).otherwise(F.col("e.value").cast("string"))
    return rows.select(*keys, F.col("e.key").alias("key"), value.alias("value"))


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in ``order``; a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])

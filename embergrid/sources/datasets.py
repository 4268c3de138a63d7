"""Datasets of networks and requests: a GML file for each network, a table of events, a setting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_exists, read_csv, register_gml, typed, write_csv

ROW = ["network", "id", "src", "dst", "attributes"]


def write_networks(nodes: DataFrame, links: DataFrame, path: str, network: str = "network", directed: bool = False, mode: str = "append") -> None:
    """A GML file for each network; all columns but the ids are attributes, nulls are left out.

    Networks are dealt to tasks by name, and a task writes its networks one after the other as their rows stream in.
    """
    register_gml(nodes.sparkSession)
    attributes = lambda df, taken: F.to_json(F.struct(*[c for c in df.columns if c not in taken])) if set(df.columns) - set(taken) else F.lit("{}")
    name, none = F.col(network).cast("string").alias("network"), F.lit(None).cast("long")
    place = F.col("eid") if "eid" in links.columns else F.lit(None)
    rows = nodes.select(name, F.col("id").cast("long").alias("id"), none.alias("src"), none.alias("dst"), attributes(nodes, (network, "id")).alias("attributes"))
    rows = rows.union(links.select(name, place.cast("long"), F.col("src").cast("long"), F.col("dst").cast("long"), attributes(links, (network, "eid", "src", "dst"))))
    dealt = rows.repartition("network").sortWithinPartitions("network", F.col("src").isNotNull(), "id", "src", "dst")
    dealt.write.format("gml").mode(mode).option("directed", str(directed).lower()).save(path)


def read_networks(spark: SparkSession, path: str, node_types: Mapping[str, str], link_types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of all GML files of a folder, or of one file, with the attributes as columns of the given types."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}: generate it first, or mend the path")
    register_gml(spark)
    rows = lambda kind: spark.read.format("gml").option("kind", kind).load(path)
    own = lambda types: [F.from_json("attributes", ", ".join(f"`{n}` {t}" for n, t in types.items()), {"allowNonNumericNumbers": "true"})[n].alias(n) for n in types]
    nodes = rows("nodes").select("network", "id", *own(node_types))
    links = rows("links").select("network", F.col("id").alias("eid"), "src", "dst", *own(link_types))
    return nodes, links


EVENTS = {"id": "long", "type": "int", "v_net_id": "long", "time": "double"}


def save_requests(nodes: DataFrame, links: DataFrame, events: DataFrame, path: str) -> None:
    """A request dataset: networks named v_net-00000 and on by ``v_net_id`` under v_nets, and events (id, type, v_net_id, time)."""
    named = lambda df: df.withColumn("network", F.concat(F.lit("v_net-"), F.when(F.length(F.col("v_net_id").cast("string")) < 5, F.lpad(F.col("v_net_id").cast("string"), 5, "0")).otherwise(F.col("v_net_id").cast("string")))).drop("v_net_id")
    write_networks(named(nodes), named(links), f"{path}/v_nets")
    write_csv(events.select(*EVENTS), f"{path}/events")


def load_requests(spark: SparkSession, path: str, node_types: Mapping[str, str], link_types: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, events) of a request dataset; events out of place, or without their network, are errors."""
    for part in ("v_nets", "events"):
        if not path_exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"{path}/{part} does not exist")
    request = F.regexp_extract("network", r"(\d+)$", 1).cast("long").alias("v_net_id")
    nodes, links = (df.select(request, *[c for c in df.columns if c != "network"]) for df in read_networks(spark, f"{path}/v_nets", node_types, link_types))
    events = typed(read_csv(spark, f"{path}/events"), EVENTS)
    check_events(events, nodes.select("v_net_id").distinct())
    return nodes, links, events


def check_events(events: DataFrame, requests: DataFrame) -> None:
    """Ids are positions, times are finite and don't fall, and each request arrives once and leaves once after it."""
    from ..operators.running import running

    ends = events.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    if ends[0] and not ends[0] == ends[1] == ends[3] + 1 or ends[2]:
        raise ValueError(f"event ids are not 0 to {ends[0] - 1}")
    before = running(events, [], ["id"], {"n": F.lit(1)}, {"latest": F.col("time")}).select(F.col("id").alias("next"), F.col("latest").alias("before"))
    late = events.join(before, F.col("next") == F.col("id") - 1, "left").where("time is null or isnan(time) or abs(time) = double('inf') or time < before")
    if row := late.first():
        raise ValueError(f"event {row['id']} is out of order or has no time")
    whole = (F.col("arrivals") == 1) & (F.col("leaves") == 1) & (F.col("arrived") < F.col("left"))
    seen = events.groupBy("v_net_id").agg(F.count_if(F.col("type") == 1).alias("arrivals"), F.count_if(F.col("type") == 0).alias("leaves"), F.min(F.when(F.col("type") == 1, F.col("id"))).alias("arrived"), F.max(F.when(F.col("type") == 0, F.col("id"))).alias("left"))
    if row := seen.join(requests.withColumn("known", F.lit(True)), "v_net_id", "full").where(~F.coalesce(whole & F.col("known"), F.lit(False))).first():
        raise ValueError(f"request {row['v_net_id']} has no network, or not one arrival and one leave after it")

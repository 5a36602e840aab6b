"""Link-state routing and ring ownership (NET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.ranges import running
from lodestone.plans.storage import stored


def upsert_links(links: DataFrame, node: str, new: list[str]) -> DataFrame:
    """(src, dst) with the node's links replaced."""
    rows = links.sparkSession.createDataFrame([(node, d) for d in new], "src string, dst string")
    return links.filter(F.col("src") != node).unionByName(rows)


def all_nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().orderBy("node")


def routing_table(links: DataFrame, gateways: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, gateway, hops) by breadth-first rounds from the gateways (node); of equal paths the lesser gateway.

    Nodes that can't be reached have no row.
    """
    edges = stored(links.select("src", "dst").distinct())
    fronts = [stored(gateways.select("node", F.col("node").alias("gateway"), F.lit(0).alias("hops")).distinct())]
    for i in range(1, most):
        known = reduce(DataFrame.unionByName, fronts)
        new = fronts[-1].join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("gateway").alias("gateway")).join(known.select("node"), "node", "left_anti")
        front = stored(new.select("node", "gateway", F.lit(i).alias("hops")))
        if front.isEmpty():
            return known
        fronts.append(front)
    raise RuntimeError(f"paths of more than {most} hops")


def route(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, gateway): null where there is no route."""
    return wanted.select("node").join(table.select("node", "gateway"), "node", "left")


def between(key: Column, low: Column, high: Column) -> Column:
    """Whether key lies in (low, high] of a ring; equal ends hold everything."""
    return F.when(low == high, F.lit(True)).when(low < high, (key > low) & (key <= high)).otherwise((key > low) | (key <= high))


def interfaces_add(interfaces: DataFrame, name: str, ref: str, pid: str) -> DataFrame:
    """(name, ref, pid) with one entry for the name, the new one."""
    row = interfaces.sparkSession.createDataFrame([(name, ref, pid)], "name string, ref string, pid string")
    return interfaces_remove(interfaces, name).unionByName(row)


def interfaces_remove(interfaces: DataFrame, name: str) -> DataFrame:
    return interfaces.filter(F.col("name") != name)


def interfaces_lookup(interfaces: DataFrame, wanted: DataFrame, by: str = "name") -> DataFrame:
    """wanted (name, or ref) with the other two columns, null where it isn't found."""
    return wanted.select(by).join(interfaces, by, "left").select("name", "ref", "pid")


def interfaces_broadcast(interfaces: DataFrame, message: str) -> DataFrame:
    """(pid, message) for every interface."""
    return interfaces.select("pid", F.lit(message).alias("message"))


def ring(nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, predecessor, successor) in the order of ids, closed at the ends."""
    ids = nodes.select(F.col(node).alias("node")).distinct()
    ends = ids.agg(F.min("node").alias("_min"), F.max("node").alias("_max"))
    up = running(ids, [F.col("node")], {"_p": ("max", F.col("node"))}, inclusive=False)
    both = running(up, [F.desc("node")], {"_s": ("min", F.col("node"))}, inclusive=False).crossJoin(F.broadcast(ends))
    return both.select("node", F.coalesce("_p", "_max").alias("predecessor"), F.coalesce("_s", "_min").alias("successor"))


def without_failed(nodes: DataFrame, failed: DataFrame, node: str = "node") -> DataFrame:
    """The ring after some nodes have failed: each gap is closed by the next living node."""
    return ring(nodes.join(failed.select(node), node, "left_anti"), node)


def owners(nodes: DataFrame, keys: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """keys with their owner, the first node whose id is at least the key, else the least node.

    Nodes and keys are merged by one sort in ranges, so no pair of them is ever formed.
    """
    ids = nodes.select(F.col(node).cast("long").alias("_at")).distinct()
    least = ids.agg(F.min("_at").alias("_least"))
    names = keys.columns
    both = keys.withColumn("_at", F.col(key).cast("long")).withColumn("_node", F.lit(None).cast("long")).unionByName(ids.withColumn("_node", F.col("_at")), allowMissingColumns=True)
    span = F.floor(F.col("_at") / (1 << 20))  # a range of keys is one group; the next node beyond it is carried in
    nearest_after = F.min("_node").over(Window.partitionBy("_span").orderBy(F.desc("_at"), F.col("_node").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = both.withColumn("_span", span)
    firsts = ids.groupBy(F.floor(F.col("_at") / (1 << 20)).alias("_span")).agg(F.min("_at").alias("_first"))
    spans = cut.select("_span").distinct().join(firsts, "_span", "left")
    beyond = F.min("_first").over(Window.orderBy("_span").rowsBetween(1, Window.unboundedFollowing))
    carried = spans.select("_span", beyond.alias("_beyond"))
    return cut.withColumn("_in", nearest_after).join(carried, "_span").filter("_node IS NULL").crossJoin(F.broadcast(least)).select(*names, F.coalesce("_in", "_beyond", "_least").alias("owner"))


def hand_over(store: DataFrame, low: int, high: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(what a joining node takes, what stays): keys in (low, high] and the others."""
    inside = between(F.col(key), F.lit(low), F.lit(high))
    return store.filter(inside), store.filter(~inside)


def probe(nodes: DataFrame, seconds: float | None = None) -> DataFrame:
    """(path, seconds): all nodes of the ring in order; the round trip, if one hop takes ``seconds``."""
    path = nodes.agg(F.sort_array(F.collect_set("node")).alias("path"))
    return path.withColumn("seconds", F.size("path") * F.lit(seconds).cast("double"))


def lookup_check(requests: DataFrame) -> DataFrame:
    """(total, failed, timeouts) of (found, timed_out)."""
    return requests.agg(F.count("*").alias("total"), F.count_if(~F.col("found") & ~F.col("timed_out")).alias("failed"), F.count_if("timed_out").alias("timeouts"))


def request_rate(requests: DataFrame) -> DataFrame:
    """(clients, requests, seconds, per_second) of requests (client, began, ended) that clients made side by side."""
    told = requests.agg(F.count_distinct("client").alias("clients"), F.count("*").alias("requests"), (F.max("ended") - F.min("began")).alias("seconds"))
    return told.withColumn("per_second", F.try_divide("requests", "seconds"))


def parse_http(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """requests with method, uri, version, headers and body of the text of each."""
    head = F.substring_index(F.col(raw), "\r\n\r\n", 1)
    line = F.substring_index(head, "\r\n", 1)
    cut = F.instr(F.col(raw), "\r\n\r\n")
    part = lambda i: F.nullif(F.regexp_extract(line, r"^([A-Z]+) (\S+) (?:HTTP/)?([\d.]+)$", i), F.lit(""))
    return requests.withColumns({"method": part(1), "uri": part(2), "version": part(3), "headers": F.slice(F.split(head, "\r\n"), 2, 1 << 20), "body": F.when(cut > 0, F.substring(F.col(raw), cut + 4, F.length(F.col(raw)))).otherwise("")})

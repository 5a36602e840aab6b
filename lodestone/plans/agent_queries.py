"""Queries of routing, rings, agents, language constructs and file formats, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import basics
from lodestone.functions.draws import uniform_sql
from lodestone.operators import agents, learn, routing
from lodestone.plans import queries as base
from lodestone.plans.registry import documents, query, table
from lodestone.plans.storage import shared_path
from lodestone.sources import files

# routing


@query("net01_links", "SELECT n_nationkey::VARCHAR AS src, (n_nationkey + 1)::VARCHAR AS dst FROM nation WHERE n_nationkey <> 3 UNION ALL VALUES ('3', '9'), ('3', '11')")
def net01(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") + 1).cast("string").alias("dst"))
    return routing.upsert_links(rows, "3", ["9", "11"])


@query("net01_nodes", "SELECT n_nationkey AS node FROM nation UNION SELECT n_nationkey + 1 FROM nation")
def net01_nodes(spark, sf_dir):
    return routing.all_nodes(base.nation_links(spark, sf_dir))


@query("net03_route", base.SQL["net02_routes"].replace("SELECT node, min(gateway) AS gateway, hops FROM r JOIN m USING (node, hops) GROUP BY node, hops", ", t AS (SELECT node, min(gateway) AS gateway FROM r JOIN m USING (node, hops) GROUP BY node), w AS (SELECT p_size AS node FROM part GROUP BY p_size) SELECT node, gateway FROM w LEFT JOIN t USING (node)"))
def net03(spark, sf_dir):
    known = routing.routing_table(base.nation_links(spark, sf_dir), spark.createDataFrame([(0,), (3,)], "node int"))
    return routing.route(known, table(spark, sf_dir, "part").select(F.col("p_size").alias("node")).distinct())


@query("net04_interfaces", "WITH i AS (SELECT n_name AS name, 'r' || n_nationkey AS ref, 'p' || n_nationkey AS pid FROM nation WHERE n_name NOT IN ('BRAZIL', 'CHINA', 'NATION_2', 'NATION_3') UNION ALL VALUES ('BRAZIL', 'new', 'p1')), w AS (SELECT n_name AS name FROM nation UNION ALL VALUES ('BRAZIL'), ('NOWHERE')) SELECT DISTINCT w.name, ref, pid FROM w LEFT JOIN i ON w.name = i.name")
def net04(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    every = n.select(F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_nationkey").alias("ref"), F.concat(F.lit("p"), "n_nationkey").alias("pid"))
    for gone in ("CHINA", "NATION_2", "NATION_3"):
        every = routing.interfaces_remove(every, gone)
    wanted = n.select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("BRAZIL",), ("NOWHERE",)], "name string"))
    return routing.interfaces_lookup(routing.interfaces_add(every, "BRAZIL", "new", "p1"), wanted).select(F.coalesce("name").alias("name"), "ref", "pid").join(wanted.distinct(), "name", "right").distinct()


@query("net05_between", "SELECT c_custkey, CASE WHEN l = h THEN true WHEN l < h THEN k > l AND k <= h ELSE k > l OR k <= h END AS inside FROM (SELECT c_custkey, c_custkey * 31 % 1009 AS k, c_custkey * 7 % 11 * 90 AS l, c_custkey * 5 % 11 * 90 AS h FROM customer)")
def net05(spark, sf_dir):
    k = lambda a, m, b=1: F.col("c_custkey") * a % m * b
    return table(spark, sf_dir, "customer").select("c_custkey", routing.between(k(31, 1009), k(7, 11, 90), k(5, 11, 90)).alias("inside"))


@query("net07_repaired", "WITH l AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 0) SELECT node, coalesce(lag(node) OVER (ORDER BY node), (SELECT max(node) FROM l)) AS predecessor, coalesce(lead(node) OVER (ORDER BY node), (SELECT min(node) FROM l)) AS successor FROM l")
def net07_repaired(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "node")
    return routing.without_failed(s, s.filter("NOT coalesce(s_acctbal > 0, false)"))


@query("net08_hand_over", "SELECT c_custkey, CASE WHEN c_custkey * 31 % 1009 > 900 OR c_custkey * 31 % 1009 <= 80 THEN 'joining' ELSE 'staying' END AS side FROM customer")
def net08(spark, sf_dir):
    taken, kept = routing.hand_over(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 31 % 1009).alias("key")), 900, 80)
    return taken.select("c_custkey", F.lit("joining").alias("side")).unionByName(kept.select("c_custkey", F.lit("staying").alias("side")))


@query("net09_probe", "SELECT string_agg(s_suppkey::VARCHAR, ' ' ORDER BY s_suppkey) AS path, round(count(*) * 0.002, 6)::DOUBLE AS seconds FROM supplier")
def net09(spark, sf_dir):
    found = routing.probe(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), 0.002)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("seconds", 6).alias("seconds"))


@query("net10_lookups", "SELECT count(*) AS total, count(*) FILTER (WHERE o_custkey % 5 = 0 AND o_orderkey % 7 > 0) AS failed, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS timeouts FROM orders")
def net10(spark, sf_dir):
    return routing.lookup_check(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5 > 0).alias("found"), (F.col("o_orderkey") % 7 == 0).alias("timed_out")))


@query("net10_rate", "SELECT count(DISTINCT user_id) AS clients, count(*) AS requests, (max(event_id + event_id % 13) - min(event_id)) / 1000 AS seconds, round(count(*) / ((max(event_id + event_id % 13) - min(event_id)) / 1000), 6) AS per_second FROM events")
def net10_rate(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), (F.col("event_id") / 1000).alias("began"), ((F.col("event_id") + F.col("event_id") % 13) / 1000).alias("ended"))
    return routing.request_rate(made).withColumns({"seconds": F.round("seconds", 9), "per_second": F.round("per_second", 6)})


@query("src18_http", r"SELECT page_id, 'GET' AS method, url AS uri, '1.1' AS version, 2::INT AS headers, 'page ' || page_id AS body FROM pages")
def src18(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\nHost: a\r\nAccept: b\r\n\r\npage "), "page_id").alias("raw"))
    return routing.parse_http(raw).select("page_id", "method", "uri", "version", F.size("headers").alias("headers"), "body")


# agents

_POINTS = base._POINTS


@query("agt03_trait_counts", f"WITH {_POINTS} SELECT pt.id AS l_id, sp.id % 3 AS trait, count(*) AS n FROM pt, sp WHERE sqrt((pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2) < 900 GROUP BY ALL")
def agt03(spark, sf_dir):
    left, right = base.points(spark, sf_dir)
    return agents.trait_counts_within(left, right.withColumn("kind", F.col("id") % 3), 900.0, "kind")


@query("agt04_coins", f"SELECT c_custkey AS id, {uniform_sql('1', 'c_custkey')} < 0.25 AS head, floor({uniform_sql('2', 'c_custkey')} * 51)::BIGINT + 20 AS number, array_to_string(list_sort(list_transform([1, 2, 3, 4], lambda x: md5('3-' || (c_custkey * 10 + x)) || ':' || (c_custkey * 10 + x)))[1:2], ' ') AS picked FROM customer")
def agt04(spark, sf_dir):
    k = F.col("c_custkey")
    picked = agents.some_of(F.array(*[k * 10 + i for i in (1, 2, 3, 4)]), 2, 3)
    return table(spark, sf_dir, "customer").select(k.alias("id"), agents.coin(1, k, p=0.25).alias("head"), agents.uniform_int(20, 70, 2, k).alias("number"), F.array_join(F.transform(picked, lambda x: F.concat(F.md5(F.concat(F.lit("3-"), x.cast("string")).cast("binary")), F.lit(":"), x.cast("string"))), " ").alias("picked"))


@query("agt05_crowd_rule", "WITH g AS (SELECT c_custkey AS id, c_custkey % 10 / 10 AS crowd, (c_custkey % 7)::DOUBLE AS a, (c_custkey % 11)::DOUBLE AS b FROM customer), s AS (SELECT n_nationkey AS id, (n_nationkey % 5)::DOUBLE AS a, (n_nationkey % 3)::DOUBLE AS b FROM nation WHERE n_nationkey <> 14) SELECT g.id AS guest, s.id AS scene, g.a * s.a + g.b * s.b AS utility FROM g, s WHERE crowd < 0.5 QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY g.a * s.a + g.b * s.b DESC, s.id) = 1")
def agt05_crowd(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10 / 10).alias("crowd"), (F.col("c_custkey") % 7).cast("double").alias("a"), (F.col("c_custkey") % 11).cast("double").alias("b"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).cast("double").alias("a"), (F.col("n_nationkey") % 3).cast("double").alias("b"))
    return agents.best_scene(g, s, ["a", "b"], leader=14)


@query("agt09_bids", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice >= 100000 THEN 100000.0 END ELSE o_totalprice END AS bid FROM orders")
def agt09(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "dutch").otherwise("sealed")
    wants = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("cds"))).otherwise(F.array(F.lit("shirt"), F.lit("cds")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), agents.bid_rule(kind, wants, F.lit("shirt"), F.col("o_totalprice"), F.lit(100000.0)).alias("bid"))


@query("agt11_intentions", f"WITH {_POINTS}, b AS (SELECT DISTINCT pt.id AS agent, CASE sp.id % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'music' WHEN 2 THEN 'crowd' END AS belief FROM pt, sp WHERE sqrt((pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2) < 900 AND sp.id % 4 < 3), r(belief, desire, strength) AS (VALUES ('food', 'eat', 2.0), ('music', 'dance', 3.0), ('crowd', 'leave', 3.0)) SELECT agent, desire, strength::DOUBLE AS strength FROM b JOIN r USING (belief) QUALIFY row_number() OVER (PARTITION BY agent ORDER BY strength DESC, desire) = 1")
def agt11(spark, sf_dir):
    left, right = base.points(spark, sf_dir)
    kind = F.when(F.col("id") % 4 == 0, "food").when(F.col("id") % 4 == 1, "music").when(F.col("id") % 4 == 2, "crowd")
    rules = spark.createDataFrame([("food", "eat", 2.0), ("music", "dance", 3.0), ("crowd", "leave", 3.0)], "belief string, desire string, strength double")
    return agents.intentions(agents.perceived(left, right, 900.0, kind), rules)


@query("agt12_states", "SELECT c_custkey AS id, greatest(c_custkey % 120 - 30, 0)::DOUBLE AS hunger, greatest(c_custkey % 77 - 30, 0)::DOUBLE AS thirst, CASE WHEN least(greatest(c_custkey % 120 - 30, 0), greatest(c_custkey % 77 - 30, 0)) < 50 THEN CASE WHEN greatest(c_custkey % 120 - 30, 0) <= greatest(c_custkey % 77 - 30, 0) THEN 'food' ELSE 'drink' END ELSE 'dance' END AS state FROM customer")
def agt12(spark, sf_dir):
    start = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 120).cast("double").alias("hunger"), (F.col("c_custkey") % 77).cast("double").alias("thirst"), F.lit("dance").alias("state"))
    return agents.run_steps(start, 30)


@query("agt12_destinations", f"WITH {_POINTS}, a AS (SELECT id, x, y, CASE WHEN id % 3 = 0 THEN 'food' WHEN id % 3 = 1 THEN 'drink' ELSE 'dance' END AS state FROM pt), p AS (SELECT id, x, y, CASE WHEN id % 2 = 0 THEN 'food' ELSE 'drink' END AS kind FROM sp), d AS (SELECT a.id, p.id AS place FROM a JOIN p ON kind = state QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2), p.id) = 1) SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE place END AS place FROM d")
def agt12_destinations(spark, sf_dir):
    left, right = base.points(spark, sf_dir)
    own = left.withColumn("state", F.when(F.col("id") % 3 == 0, "food").when(F.col("id") % 3 == 1, "drink").otherwise("dance"))
    places = right.withColumn("kind", F.when(F.col("id") % 2 == 0, "food").otherwise("drink"))
    return agents.destination(own, places, left.filter("id % 5 = 0").select("id", F.lit(1).cast("long").alias("place")))


@query("agt13_metrics", "SELECT 7 AS step, c_mktsegment AS state, count(*) AS n, round(avg(1 / (c_custkey % 20 + 1)), 9) AS utility FROM customer GROUP BY ALL")
def agt13(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"), (F.col("c_custkey") % 20).alias("roaming"))
    return agents.step_metrics(rows, 7).withColumn("utility", F.round("utility", 9))


@query("agt15_loops", "SELECT c_custkey AS id, (SELECT sum(i) FROM range(0, c_custkey % 9 + 1, 2) r(i))::BIGINT AS total, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS word, least(c_custkey % 50 + 10, 40)::BIGINT AS kept, (length(bin(c_custkey)) - 1)::BIGINT AS halvings FROM customer")
def agt15(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), basics.loop_sum(F.lit(0), k % 9, 2).alias("total"), basics.switch(k % 4, {0: "none", 1: "one"}, "many").alias("word"), basics.bounded(k % 50 + 10, 40).alias("kept"), basics.halvings(k).alias("halvings"))


@query("agt16_messages", "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id = 7")
def agt16(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("performative"), F.col("user_id").cast("string").alias("receiver"))
    return agents.messages_for(m, "purchase", "7").select("event_id")


@query("agt17_member", f"SELECT c_custkey AS id FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY {uniform_sql('1', 'c_custkey')}, c_custkey LIMIT 1")
def agt17(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return agents.pick_member(registry, registry.agg(F.min("kind")).first()[0]).select("id")


@query("agt17_categories", "SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL")
def agt17_categories(spark, sf_dir):
    return agents.category_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")))


@query("agt18_caught", f"WITH {_POINTS} SELECT id FROM pt WHERE NOT (id % 3 = 0 AND EXISTS (SELECT 1 FROM sp WHERE sqrt((pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2) < 600))")
def agt18(spark, sf_dir):
    left, right = base.points(spark, sf_dir)
    return agents.without_caught(left, left.filter("id % 3 = 0"), right, 600.0).select("id")


@query("agt19_followed", "WITH l AS (SELECT arg_max(event_type, event_id) AS c FROM events) SELECT c_custkey AS id, CASE WHEN c_custkey % 10 / 10 > 0.3 THEN c ELSE c_mktsegment END AS choice FROM customer, l")
def agt19(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10 / 10).alias("crowd"), F.col("c_mktsegment").alias("choice"))
    return agents.followed(own, table(spark, sf_dir, "events").select(F.col("event_id").alias("ts"), F.col("event_type").alias("choice"))).select("id", "choice")


@query("agt20_resets", f"SELECT event_id, event_id % 400 = 0 AS due, (event_id % 200 = 0 OR {uniform_sql('1', 'event_id', 'user_id')} < 0.005) AS by_chance FROM events")
def agt20(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", agents.resets(F.col("event_id"), 400).alias("due"), agents.resets(F.col("event_id"), 200, 0.005, 1, F.col("user_id")).alias("by_chance"))


_GUEST = "g AS (SELECT o_orderkey AS id, ['rock', 'disco', 'pop'][o_orderkey % 3 + 1] AS music, ['meat', 'vegetarian', 'vegan'][o_custkey % 3 + 1] AS food, CASE WHEN o_orderkey % 2 = 0 THEN 'introvert' ELSE 'extrovert' END AS crowd, o_custkey % 13 AS m, o_custkey % 11 AS v, o_custkey % 17 AS n, o_custkey % 5 < 2 AS coin, o_custkey % 500 AS hunger, ['meat', 'vegetarian', 'vegan'][o_orderkey % 3 + 1] AS served FROM orders)"


def _guests(spark, sf_dir):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    of = lambda c, *x: F.array(*map(F.lit, x))[(c % 3).cast("int")]
    return table(spark, sf_dir, "orders").select(o.alias("id"), of(o, "rock", "disco", "pop").alias("music"), of(k, "meat", "vegetarian", "vegan").alias("food"), F.when(o % 2 == 0, "introvert").otherwise("extrovert").alias("crowd"), (k % 13).alias("m"), (k % 11).alias("v"), (k % 17).alias("n"), (k % 5 < 2).alias("coin"), (k % 500).alias("hunger"), of(o, "meat", "vegetarian", "vegan").alias("served"))


@query("agt21_scenes", f"""WITH {_GUEST} SELECT id, CASE WHEN music NOT IN ('rock', 'pop') THEN 'eat' WHEN crowd = 'introvert' AND m + v + n > 20 THEN 'leave_and_eat'
WHEN food = 'meat' AND n < 8 THEN 'go' WHEN food = 'meat' THEN 'leave' WHEN food = 'vegetarian' AND m + n < 25 THEN 'go' WHEN food = 'vegan' AND coin THEN 'go' ELSE 'stay' END AS does FROM g""")
def agt21(spark, sf_dir):
    c = F.col
    return _guests(spark, sf_dir).select("id", agents.scene_decision(c("music"), F.array(F.lit("rock"), F.lit("pop")), c("food"), c("crowd"), c("m"), c("v"), c("n"), c("coin")).alias("does"))


@query("agt21_restaurants", f"""WITH {_GUEST} SELECT id, CASE WHEN crowd = 'introvert' AND m > 10 THEN CASE WHEN hunger > 400 THEN 'go' ELSE 'leave' END
WHEN hunger <= 200 THEN 'stay' WHEN food = served THEN 'go' WHEN food = 'vegetarian' AND served = 'vegan' AND coin THEN 'go' ELSE 'stay' END AS does FROM g""")
def agt21_restaurants(spark, sf_dir):
    c = F.col
    return _guests(spark, sf_dir).select("id", agents.restaurant_decision(c("food"), c("crowd"), c("served"), c("m"), c("hunger"), c("coin")).alias("does"))


@query("agt22_moves", f"WITH {_POINTS}, d AS (SELECT id, x, y, 5000.0::DOUBLE AS tx, 4000.0::DOUBLE AS ty, sqrt((5000 - x) ** 2 + (4000 - y) ** 2) AS d FROM pt), m AS (SELECT id, CASE WHEN d > 0 THEN x + least(1, 900 / d) * (tx - x) ELSE x END AS x, CASE WHEN d > 0 THEN y + least(1, 900 / d) * (ty - y) ELSE y END AS y, tx, ty FROM d) SELECT id, round(x, 6) AS x, round(y, 6) AS y, sqrt((tx - x) ** 2 + (ty - y) ** 2) < 5 AS arrived FROM m")
def agt22(spark, sf_dir):
    left, _ = base.points(spark, sf_dir)
    moved = agents.move(left, left.select("id", F.lit(5000.0).alias("tx"), F.lit(4000.0).alias("ty")), 900.0, 5.0)
    return moved.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "arrived")


# language constructs


@query("fn01_constructs", "WITH RECURSIVE f AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT c_custkey AS id, a AS fibonacci, (SELECT count(*) FROM range(1, c_custkey % 30 + 1) r(i) WHERE i % 3 = 0) AS guarded, 2::INT AS size FROM customer JOIN f ON n = c_custkey % 40")
def fn01(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), basics.fibonacci(k % 40).alias("fibonacci"), F.size(basics.comprehension(F.lit(1), k % 30, lambda i: i, lambda i: i % 3 == 0)).cast("long").alias("guarded"), F.size(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("size"))


# sources and sinks, over files that the query writes first


def _lines(df, line):
    path = shared_path(df.sparkSession)
    df.select(line.alias("value")).write.text(path)
    return path


@query("src03_folder", "SELECT item_id::VARCHAR AS name, md5(text) AS digest FROM benchmark")
def src03(spark, sf_dir):
    path = shared_path(spark)
    table(spark, sf_dir, "benchmark").repartition("item_id").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("value")).write.partitionBy("name").option("lineSep", "\n").text(path)
    found = files.text_documents(spark, path)
    return found.groupBy(F.regexp_extract("path", "name=([^/]+)", 1).alias("name")).agg(F.md5(F.concat_ws("", F.collect_list(F.regexp_replace("text", "\n$", ""))).cast("binary")).alias("digest"))


_E = f"WITH {base._PARTS} "


@query("src04_links", _E + "SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM e")
def src04(spark, sf_dir):
    rows = base.next_parts(spark, sf_dir).groupBy("src").agg(F.collect_list(F.col("dst").cast("string")).alias("out"))
    return files.link_file(spark, _lines(rows, F.concat(F.col("src").cast("string"), F.lit(";"), F.array_join("out", ","), F.lit(","))))


@query("src04_numbered", "SELECT 9::BIGINT AS nodes, 20::BIGINT AS links")
def src04_numbered(spark, sf_dir):
    found = files.numbered_links(spark, _lines(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("b;a,c,d,", "a;b,b,e,", "c;", "f;g,h,i,a,b,c,d,e,", "g;h,i,a,b,f,c,e,")])).alias("x")), F.col("x")))
    return found[0].agg(F.count("*").alias("nodes")).crossJoin(found[1].agg(F.count("*").alias("links")))


@query("src06_titles", "SELECT n_nationkey::VARCHAR AS node, n_name AS title FROM nation")
def src06(spark, sf_dir):
    return files.title_file(spark, _lines(table(spark, sf_dir, "nation"), F.concat_ws(";", "n_nationkey", "n_name")))


@query("src07_scores", "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 0 END AS score FROM customer")
def src07(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    scores = files.score_file(spark, _lines(rows.filter("c_custkey % 3 = 0"), F.concat_ws(";", "c_name", F.col("c_acctbal").cast("string"))))
    return files.with_scores(rows.select(F.col("c_name").alias("name")), scores)


@query("src08_lengths", "SELECT c_custkey AS id, c_acctbal AS length FROM customer")
def src08(spark, sf_dir):
    path = shared_path(spark)
    files.write_lengths(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("length")), path)
    return files.read_lengths(spark, path)


@query("src09_baskets", "SELECT n, count(*) AS baskets FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) GROUP BY n")
def src09(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("s"))
    found = files.baskets(spark, _lines(rows, F.concat(F.array_join("s", " "), F.lit(" "))))
    return found.groupBy("basket").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("baskets"))


@query("src10_edges", _E + "SELECT src, dst FROM e")
def src10(spark, sf_dir):
    rows = base.next_parts(spark, sf_dir).unionByName(spark.createDataFrame([(5, 5)], "src long, dst long"))
    return files.edge_list(spark, _lines(rows, F.concat_ws("\t", "src", "dst")), seed=1)


@query("src11_weighted_edges", _E + "SELECT src, dst FROM e")
def src11(spark, sf_dir):
    return files.edge_list(spark, _lines(base.next_parts(spark, sf_dir), F.concat_ws(",", "src", "dst", F.lit("1"))), sep=",")


@query("src13_csv", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def src13(spark, sf_dir):
    path = shared_path(spark)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.csv(path, header=True)
    return files.csv(spark, path, "id int, name string")


@query("src14_features", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def src14(spark, sf_dir):
    rows, path = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), shared_path(spark)
    learn.insert_features(path, rows.filter("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderkey")
    learn.insert_features(path, rows.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")
    return learn.read_features(spark, path, ["o_custkey"])


@query("src15_flowers", "SELECT 'Setosa' AS variety, true AS inside UNION ALL SELECT 'Versicolor', true UNION ALL SELECT 'Virginica', true")
def src15(spark, sf_dir):
    inside = F.lit(True)
    for c, (lo, hi) in learn.IRIS_BOUNDS.items():
        inside = inside & F.col(c).between(lo, hi)
    return learn.random_flowers(spark, 3000).groupBy("variety").agg(F.bool_and(inside).alias("inside"))


@query("snk02_posting_lines", "SELECT 0::BIGINT AS lost, 0::BIGINT AS added")
def snk02(spark, sf_dir):
    own = documents(spark, sf_dir).postings.select("term", "doc_id", "tf", "positions")
    path = shared_path(spark)
    files.posting_lines(own).write.text(path)
    from lodestone.operators.index import merge_check

    return merge_check(files.parse_postings(spark.read.text(path).withColumnRenamed("value", "line")), own)


@query("snk03_top", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) || ' ' || c_custkey AS line FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def snk03(spark, sf_dir):
    path = shared_path(spark)
    files.write_top(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rank")), path)
    read = spark.read.text(path).select(F.substring_index("value", ":", 1).alias("id"), F.monotonically_increasing_id().alias("no"))
    return read.select(F.concat_ws(" ", F.col("no") + 1, "id").alias("line"))


@query("snk04_report", "SELECT round, (100 - round)::BIGINT AS edge_cut FROM range(0, 20) r(round)")
def snk04(spark, sf_dir):
    from lodestone.operators.graphs import append_report

    path = shared_path(spark)
    for i in (0, 10):
        append_report(spark.range(i, i + 10).select(F.col("id").alias("round"), (100 - F.col("id")).alias("edge_cut")), path)
    return spark.read.parquet(path)


@query("snk05_last_rows", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def snk05(spark, sf_dir):
    return files.latest_by_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("snk06_best_run", "SELECT 'run=1' AS run, 3::BIGINT AS edge_cut")
def snk06(spark, sf_dir):
    path = shared_path(spark)
    rows = spark.createDataFrame([(r, f"{i}\t{9 - i * (r + 1) % 7}\t0") for r in (1, 2, 3) for i in range(4)], "run int, value string")
    rows.repartition("run").sortWithinPartitions("run", "value").write.partitionBy("run").text(path)
    return files.best_run(spark, path).select(F.regexp_extract("file", "run=[0-9]+", 0).alias("run"), "edge_cut")


@query("snk07_table", "SELECT c_nationkey AS id, printf('%.2f', min(c_acctbal)) || chr(9) || printf('%.2f', max(c_acctbal)) AS line FROM customer GROUP BY c_nationkey")
def snk07(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))
    return files.table_lines(rows, ["least", "most"], "id")

"""Queries of clocks, ordering, failures and agreement over event tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import events
from lodestone.plans.ranges import numbered
from lodestone.plans.registry import query, table


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("incoming"))


@query("str01_lamport_times", """WITH RECURSIVE s AS (SELECT user_id AS node, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS incoming, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT node, seq, incoming, p, greatest(0, coalesce(incoming, 0)) + 1 AS time FROM s WHERE p = 1 UNION ALL SELECT s.node, s.seq, s.incoming, s.p, greatest(r.time, coalesce(s.incoming, 0)) + 1 FROM r JOIN s ON s.node = r.node AND s.p = r.p + 1)
SELECT node, seq, time FROM r""")
def str01(spark, sf_dir):
    return events.lamport_times(_steps(spark, sf_dir)).select("node", "seq", "time")


@query("str01_violations", "SELECT event_id AS id FROM events WHERE event_id % 89 <= event_id % 97")
def str01_violations(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 97).alias("sent"), (F.col("event_id") % 89).alias("received"))
    return events.lamport_violations(sent).select("id")


@query("str02_vector_clocks", "SELECT c_custkey AS id, c_custkey % 3 AS x, greatest(c_custkey % 5, c_custkey % 4) AS y, c_custkey % 2 AS z, c_custkey % 3 <= 0 AND c_custkey % 5 <= c_custkey % 4 AS leq, c_custkey % 5 + 1 AS ticked, 1::BIGINT AS started FROM customer")
def str02(spark, sf_dir):
    k = lambda n: (F.col("c_custkey") % n).cast("long")
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("x"), k(3), F.lit("y"), k(5)).alias("a"), F.create_map(F.lit("y"), k(4), F.lit("z"), k(2)).alias("b"))
    m = both.select("id", events.clock_merge(F.col("a"), F.col("b")).alias("m"), events.clock_leq(F.col("a"), F.col("b")).alias("leq"), events.clock_tick(F.col("a"), F.lit("y")).alias("t"), events.clock_tick(F.col("a"), F.lit("w")).alias("u"))
    return m.select("id", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y"), F.col("m")["z"].alias("z"), "leq", F.col("t")["y"].alias("ticked"), F.col("u")["w"].alias("started"))


_VECTORS = """l AS (SELECT event_id * 7919 % 100003 * 1000003 + event_id AS arrival, event_type AS node, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS own, event_id FROM events WHERE event_type IS NOT NULL),
e AS (SELECT arrival, node AS k, own AS v FROM l UNION ALL SELECT arrival, 'view', own // 5 FROM l WHERE node <> 'view')"""


def _vectors(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "events").filter("event_type IS NOT NULL").select("event_id", "event_type"), "own", F.col("event_id"), within=F.col("event_type")).withColumn("own", F.col("own") + 1)
    own = F.create_map(F.col("event_type"), F.col("own"))
    clock = F.when(F.col("event_type") == "view", own).otherwise(F.map_concat(own, F.create_map(F.lit("view"), F.expr("own DIV 5"))))
    return rows.select((F.col("event_id") * 7919 % 100003 * 1000003 + F.col("event_id")).alias("arrival"), F.col("event_type").alias("node"), clock.alias("clock"))


@query("str04_vector_release", f"""WITH {_VECTORS}, m AS (SELECT e.arrival, e.k, e.v, min(l.arrival) AS met FROM e LEFT JOIN l ON l.node = e.k AND l.own >= e.v WHERE e.v > 0 GROUP BY ALL)
SELECT l.arrival, l.node, r.released_at FROM l LEFT JOIN (SELECT arrival, CASE WHEN count(*) = count(met) THEN greatest(max(met), arrival) END AS released_at FROM m GROUP BY arrival) r USING (arrival)""")
def str04(spark, sf_dir):
    return events.vector_release(_vectors(spark, sf_dir))


@query("str05_queue", f"""WITH {_VECTORS}, m AS (SELECT e.arrival, e.k, e.v, min(l.arrival) AS met FROM e LEFT JOIN l ON l.node = e.k AND l.own >= e.v WHERE e.v > 0 GROUP BY ALL),
r AS (SELECT arrival, CASE WHEN count(*) = count(met) THEN greatest(max(met), arrival) END AS released_at FROM m GROUP BY arrival),
h AS (SELECT a.arrival, (SELECT count(*) FROM r b WHERE b.arrival <= a.arrival) - (SELECT count(*) FROM r b WHERE b.released_at <= a.arrival) AS held FROM r a)
SELECT arrival, held::BIGINT AS held, max(held) OVER (ORDER BY arrival)::BIGINT AS most FROM h""")
def str05(spark, sf_dir):
    return events.queue_sizes(events.vector_release(_vectors(spark, sf_dir)))


@query("str06_generated", "SELECT 20000::BIGINT AS n, 0::BIGINT AS to_self, 0::BIGINT AS before_sent, 4::BIGINT AS nodes, 12::BIGINT AS pairs")
def str06(spark, sf_dir):
    made = events.generated_messages(spark, ["a", "b", "c", "d"], 20_000)
    return made.agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("to_self"), F.count_if(F.col("received") < F.col("sent")).alias("before_sent"), F.count_distinct("src").alias("nodes"), F.count_distinct("src", "dst").alias("pairs"))


@query("str08_multicast", """WITH c AS (SELECT event_type AS node, event_id // 7 AS seq, min(event_id * 7919 % 100003) AS arrival FROM events GROUP BY ALL),
g AS (SELECT node, min(seq) + 1 AS gap FROM (SELECT node, seq FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.node IS NOT DISTINCT FROM c.node AND d.seq = c.seq + 1)) GROUP BY node)
SELECT c.node, seq, max(arrival) OVER (PARTITION BY c.node ORDER BY seq) AS delivered_at FROM c JOIN g ON c.node IS NOT DISTINCT FROM g.node WHERE seq < gap""")
def str08(spark, sf_dir):
    copies = table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.expr("event_id DIV 7").alias("seq"), (F.col("event_id") * 7919 % 100003).alias("arrival"))
    return events.multicast_delivery(copies)


@query("str08_gaps", "WITH s AS (SELECT DISTINCT l_orderkey * l_orderkey % 4001 AS seq FROM lineitem), n AS (SELECT seq, (SELECT min(b.seq) FROM s b WHERE b.seq > a.seq) AS nx FROM s a) SELECT seq, nx - seq - 1 AS missing FROM n WHERE nx - seq > 1")
def str08_gaps(spark, sf_dir):
    return events.sequence_gaps(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * F.col("l_orderkey") % 4001).alias("seq")))


@query("str09_leaders", "SELECT c_nationkey AS epoch, arg_min(c_custkey, c_custkey * 7919 % 1000003) AS leader FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def str09(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("epoch"), F.col("c_custkey").alias("node"), (F.col("c_custkey") * 7919 % 1000003).alias("joined"), (F.col("c_acctbal") > 0).alias("alive"))
    return events.leaders(members)


@query("str10_first_success", "WITH a AS (SELECT user_id AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_id AS place, event_id % 4 = 0 AS acked FROM events) SELECT message, min(attempt) AS attempt, min(place) AS ts FROM a WHERE acked GROUP BY message")
def str10(spark, sf_dir):
    tries = events.stamped(table(spark, sf_dir, "events"), "user_id", "event_id")
    return events.first_success(tries.select(F.col("user_id").alias("message"), (F.col("seq") + 1).cast("long").alias("attempt"), F.col("event_id").alias("ts"), (F.col("event_id") % 4 == 0).alias("acked")))


@query("str11_suspected_for_good", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT user_id AS node, epoch_us(max(ts)) + 3600000000 AS suspected_us FROM events, m GROUP BY user_id, m.t HAVING epoch_us(m.t) - epoch_us(max(ts)) > 3600000000")
def str11_for_good(spark, sf_dir):
    found = events.suspicions(table(spark, sf_dir, "events").withColumnRenamed("user_id", "node"), 3600.0)
    return found.filter("restored_at IS NULL").select("node", F.unix_micros("suspected_at").alias("suspected_us"))


@query("str12_broadcast", "SELECT r_name AS message, n_name AS node FROM region, nation")
def str12(spark, sf_dir):
    return events.broadcast_to(table(spark, sf_dir, "region").select(F.col("r_name").alias("message")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("node")))


_BALLOTS = "m AS (SELECT event_type AS node, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'prepare' ELSE 'accept' END AS kind, event_id // 9 + event_id * 7919 % 31 AS ballot, event_id % 5 AS value FROM events)"


def _ballots(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "prepare").otherwise("accept").alias("kind"), F.expr("event_id DIV 9 + event_id * 7919 % 31").alias("ballot"), (F.col("event_id") % 5).alias("value"))


@query("str16_replies", f"""WITH {_BALLOTS}, j AS (SELECT a.*, coalesce(max(ballot) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM m a),
r AS (SELECT node, seq, kind, ballot, value, CASE WHEN kind = 'prepare' AND ballot > top THEN 'promise' WHEN kind = 'accept' AND ballot >= top THEN 'accepted' ELSE 'nack' END AS reply FROM j)
SELECT r.node, r.seq, r.kind, r.ballot, r.reply, a.ballot AS accepted_ballot, a.value AS accepted_value FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE reply = 'accepted') a ON r.node = a.node AND r.seq > a.seq""")
def str16(spark, sf_dir):
    return events.acceptor_replies(_ballots(spark, sf_dir))


@query("str16_chosen", "WITH v AS (SELECT user_id AS instance, event_id % 3 AS ballot, event_id % 2 AS value, count(DISTINCT event_type) AS c FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ballot, value) AS p FROM v WHERE c > 2.5) SELECT instance, ballot, value FROM k WHERE p = 1")
def str16_chosen(spark, sf_dir):
    accepts = table(spark, sf_dir, "events").select(F.col("user_id").alias("instance"), (F.col("event_id") % 3).alias("ballot"), (F.col("event_id") % 2).alias("value"), F.col("event_type").alias("node"))
    return events.chosen(accepts, 5)


@query("str16_retries", f"WITH {_BALLOTS}, j AS (SELECT a.*, coalesce(max(ballot) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM m a) SELECT DISTINCT ballot, ballot + 1 AS next_ballot FROM j WHERE ballot < top OR (ballot = top AND kind = 'prepare')")
def str16_retries(spark, sf_dir):
    return events.retries(events.acceptor_replies(_ballots(spark, sf_dir)))


@query("str17_adopted_suffix", "WITH r AS (SELECT o_custkey % 50 AS na, o_orderkey AS id, list_transform(range(o_orderkey % 5 + 1), lambda i: i * 1000000 + o_orderkey) AS suffix FROM orders) SELECT array_to_string(suffix, ' ') AS suffix FROM r ORDER BY na DESC, len(suffix) DESC, id DESC LIMIT 1")
def str17_suffix(spark, sf_dir):
    replies = table(spark, sf_dir, "orders").select(F.struct((F.col("o_custkey") % 50).alias("na"), (F.col("o_orderkey") % 5).alias("n"), "o_orderkey").alias("o"), F.col("o_custkey") % 50, F.expr("transform(sequence(0L, o_orderkey % 5), i -> i * 1000000 + o_orderkey)").alias("suffix"))
    # ties of ballot and length are settled by the order's key, as in the SQL
    best = replies.groupBy(F.col("o.na").alias("na"), F.col("o.n").alias("n")).agg(F.max_by("suffix", "o.o_orderkey").alias("suffix")).select("na", "suffix")
    return events.adopted_suffix(best).select(F.array_join(F.transform("suffix", lambda x: x.cast("string")), " ").alias("suffix"))


@query("str21_snapshot", """WITH o AS (SELECT user_id AS node, event_id % 256 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_id <= 700),
s AS (SELECT node, max(c) AS c, coalesce(sum(n) FILTER (WHERE k % 3 = 1), 0) % 256 AS x, coalesce(sum(n) FILTER (WHERE k % 3 = 2), 0) % 256 AS y, coalesce(sum(n) FILTER (WHERE k % 3 = 0), 0) % 256 AS z FROM o GROUP BY node)
SELECT node, CASE c % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE z END::BIGINT AS r, CASE c % 3 WHEN 0 THEN y WHEN 1 THEN z ELSE x END::BIGINT AS g, CASE c % 3 WHEN 0 THEN z WHEN 1 THEN x ELSE y END::BIGINT AS b FROM s""")
def str21(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") % 256).alias("n"))
    return events.colour_states(log, F.lit(700))


@query("str22_paused", """WITH c AS (SELECT user_id AS node, event_id AS ts, event_id % 5 = 1 AS freeze FROM events WHERE event_id % 5 IN (1, 3)), m AS (SELECT user_id AS node, event_id AS ts FROM events WHERE event_id % 5 NOT IN (1, 3))
SELECT node, ts, CASE WHEN coalesce((SELECT arg_max(c.freeze, c.ts) FROM c WHERE c.node = m.node AND c.ts <= m.ts), false) THEN (SELECT min(c.ts) FROM c WHERE c.node = m.node AND NOT c.freeze AND c.ts >= m.ts) ELSE ts END AS effective FROM m""")
def str22(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("ts"))
    controls = log.filter("ts % 5 IN (1, 3)").withColumn("ctrl", F.when(F.col("ts") % 5 == 1, "freeze").otherwise("go"))
    return events.effective_times(log.filter("ts % 5 NOT IN (1, 3)"), controls)


@query("str23_alive", "SELECT user_id AS node, event_id AS ts FROM events a WHERE event_id % 7 > 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id % 7 = 0 AND b.event_id >= a.event_id)")
def str23(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("ts"))
    return events.alive(log.filter("ts % 7 > 0"), log.filter("ts % 7 = 0"))


@query("str25_status", "SELECT user_id AS node, max(event_id) AS last_seq, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY user_id")
def str25(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return events.node_status(log).select("node", "last_seq", F.unix_micros("last_ts").alias("last_us"), "n")

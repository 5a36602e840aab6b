"""Queries over the driver's tables, one for each family of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import agents, events, graphs, index, itemsets, learn, links, routing, search, similar
from lodestone.plans.registry import QUERIES, SQL, TOKENS, documents, query, table

_TOKENS = TOKENS
_PARTS = """ln AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k, l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT a.p AS src, b.p AS dst FROM ln a JOIN ln b ON a.o = b.o AND b.k = a.k + 1 WHERE a.p <> b.p)"""
_TOGETHER = """op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
u AS MATERIALIZED (SELECT DISTINCT a.p AS a, b.p AS b FROM op a JOIN op b ON a.o = b.o AND a.p < b.p)"""
_BASKETS = """bi AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem),
nb AS (SELECT count(DISTINCT basket) AS n FROM bi)"""
WORDS, PHRASE, WILD, MISSPELT = "the of thing", "of the", "th*ng the", "thingg"


def next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on successive lines of an order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p")).distinct()
    after = lines.select("o", (F.col("k") - 1).alias("k"), F.col("p").alias("dst"))
    return lines.withColumnRenamed("p", "src").join(after, ["o", "k"]).filter("src <> dst").select("src", "dst").distinct()


def parts_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts of one order."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    return pairs.withColumnRenamed("p", "src").join(pairs.withColumnRenamed("p", "dst"), "o").filter("src < dst").select("src", "dst").distinct()


def supplier_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"))


# index


@query("idx01_postings", f"WITH {_TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def idx01(spark, sf_dir):
    return documents(spark, sf_dir).postings.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query("idx04_weights", f"WITH {_TOKENS} SELECT doc_id, term, tf, df, round(w, 6) AS w FROM wt")
def idx04(spark, sf_dir):
    return documents(spark, sf_dir).weights.withColumn("w", F.round("w", 6))


@query("idx08_lengths", f"WITH {_TOKENS} SELECT doc_id, sum(tf)::BIGINT AS n_words, round(sqrt(sum(w * w)), 5) AS euclid FROM wt GROUP BY doc_id")
def idx08(spark, sf_dir):
    return documents(spark, sf_dir).sizes.withColumn("euclid", F.round("euclid", 5))


@query("idx13_kgrams", f"WITH {_TOKENS}, v AS (SELECT DISTINCT '^' || term || '$' AS t FROM tok), g AS (SELECT DISTINCT t, substr(t, unnest(range(1, length(t)))::BIGINT, 2) AS kgram FROM v) SELECT kgram, count(*) AS terms FROM g GROUP BY kgram")
def idx13(spark, sf_dir):
    return documents(spark, sf_dir).kgrams.groupBy("kgram").agg(F.count("*").alias("terms"))


@query("idx14_kgram_lookup", f"WITH {_TOKENS} SELECT DISTINCT term FROM tok WHERE contains('^' || term || '$', 'th') AND contains('^' || term || '$', 'ng')")
def idx14(spark, sf_dir):
    return index.kgram_lookup(documents(spark, sf_dir).kgrams, ["th", "ng"])


@query("idx10_merge", f"WITH {_TOKENS} SELECT term, count(*) AS docs, sum(tf)::BIGINT AS places FROM cnt GROUP BY term")
def idx10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    half = lambda i: index.row_postings(docs.filter(f"pmod(doc_id, 2) = {i}")).drop("n_words")
    merged = index.merge_postings(half(0), half(1), index.repeated(docs))
    return merged.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("places"))


# search


@query("ir05_ranked_tfidf", f"WITH {_TOKENS} SELECT doc_id, round(sum(w / n_words), 6) AS score FROM wt JOIN len USING (doc_id) WHERE term IN ('the', 'of', 'thing') GROUP BY doc_id ORDER BY sum(w / n_words) DESC, doc_id LIMIT 10")
def ir05(spark, sf_dir):
    return search.top(documents(spark, sf_dir).search(WORDS)).withColumn("score", F.round("score", 6))


@query("ir07_ranked_euclid", f"WITH {_TOKENS}, eu AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM wt GROUP BY doc_id) SELECT doc_id, round(sum(w / size), 6) AS score FROM wt JOIN eu USING (doc_id) WHERE term IN ('the', 'of', 'thing') GROUP BY doc_id")
def ir07(spark, sf_dir):
    return documents(spark, sf_dir).search(WORDS, norm="euclid").withColumn("score", F.round("score", 6))


@query("ir01_and", f"WITH {_TOKENS} SELECT doc_id FROM cnt WHERE term IN ('the', 'of', 'thing') GROUP BY doc_id HAVING count(*) = 3")
def ir01(spark, sf_dir):
    return documents(spark, sf_dir).search(WORDS, "and")


@query("ir02_phrase", f"WITH {_TOKENS} SELECT doc_id, pos FROM (SELECT doc_id, term, pos, lag(term) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tok) WHERE before = 'of' AND term = 'the'")
def ir02(spark, sf_dir):
    return documents(spark, sf_dir).search(PHRASE, "phrase").select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("ir14_wildcard", f"WITH {_TOKENS}, m AS (SELECT doc_id, CASE WHEN term = 'the' THEN 1 WHEN regexp_full_match(term, 'th.*ng') THEN 0 END AS slot FROM cnt) SELECT doc_id FROM m WHERE slot IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT slot) = 2")
def ir14(spark, sf_dir):
    return documents(spark, sf_dir).search(WILD, "and")


@query("ir14_wildcard_ranked", f"WITH {_TOKENS} SELECT doc_id, round(sum(w / n_words), 6) AS score FROM wt JOIN len USING (doc_id) WHERE regexp_full_match(term, 'th.*ng') OR term = 'the' GROUP BY doc_id")
def ir14_ranked(spark, sf_dir):
    return documents(spark, sf_dir).search(WILD).withColumn("score", F.round("score", 6))


@query("ir17_feedback", f"WITH {_TOKENS}, q AS (SELECT 'the' AS term, 0.2::DOUBLE AS weight UNION ALL SELECT 'thing', 0.2 UNION ALL SELECT term, 0.8 * tf FROM cnt WHERE doc_id IN (0, 1)), qs AS (SELECT term, sum(weight) AS weight FROM q GROUP BY term) SELECT doc_id, round(sum(weight * w / n_words), 5) AS score FROM wt JOIN qs USING (term) JOIN len USING (doc_id) GROUP BY doc_id")
def ir17(spark, sf_dir):
    ix = documents(spark, sf_dir)
    relevant = spark.createDataFrame([(0,), (1,)], "doc_id long")
    return search.ranked_by_terms(ix, search.feedback(ix, {"the": 1.0, "thing": 1.0}, relevant)).withColumn("score", F.round("score", 5))


@query("ir19_spelling", rf"""WITH {_TOKENS}, v AS (SELECT DISTINCT term FROM tok WHERE abs(length(term) - 6) <= 2),
g AS (SELECT term, list_distinct(list_transform(range(1, length(term) + 2), lambda i: substr('^' || term || '$', i, 2))) AS gs FROM v),
s AS (SELECT term, len(list_intersect(gs, ['^t', 'th', 'hi', 'in', 'ng', 'gg', 'g$'])) AS common, len(gs) AS n FROM g),
d AS (SELECT term, common::DOUBLE / (n + 7 - common) AS jaccard, levenshtein(term, 'thingg') AS l, abs(length(term) - 6) AS a FROM s)
SELECT term, round(jaccard, 6) AS jaccard FROM d WHERE jaccard >= 0.4 AND (l = 0 OR (l <= 2 AND a IN (1, 2) AND l = a) OR (a = 0 AND l <= 2 AND list_has_any(
  list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1)), list_transform(range(1, 7), lambda i: substr('thingg', 1, i - 1) || substr('thingg', i + 1)))))""")
def ir19(spark, sf_dir):
    return search.spelling(documents(spark, sf_dir), MISSPELT, limit=None).withColumn("jaccard", F.round("jaccard", 6))


@query("ir22_precision", f"""WITH {_TOKENS}, r AS (SELECT doc_id, sum(w / n_words) AS score FROM wt JOIN len USING (doc_id) WHERE term IN ('the', 'of', 'thing') GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r QUALIFY place <= 10), j AS (SELECT doc_id, max(quality) AS relevance FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT place, coalesce(relevance, 0) AS relevance FROM b LEFT JOIN j USING (doc_id)), i AS (SELECT relevance, row_number() OVER (ORDER BY relevance DESC) AS place FROM j QUALIFY place <= 10)
SELECT round(avg(CASE WHEN relevance > 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS precision, round(count(*) FILTER (WHERE relevance > 0) / (SELECT count(*) FROM j WHERE relevance > 0), 6) AS recall,
round(sum((2 ** relevance - 1) / log2(place + 1)) / (SELECT sum((2 ** relevance - 1) / log2(place + 1)) FROM i), 6) AS ndcg FROM h""")
def ir22(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("relevance"))
    found = search.precision(documents(spark, sf_dir).search(WORDS), judged)
    return found.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


@query("txt02_patterns")
def txt02(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(tx.pattern_tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n"))


# similarity


@query("sim03_jaccard", """WITH s AS (SELECT DISTINCT item_id AS id, lower(substr(text, i, 5)) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 3)) AS i FROM benchmark)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.id < b.id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b""")
def sim03(spark, sf_dir):
    sets = similar.shingle_sets(table(spark, sf_dir, "benchmark"), 5, hashed=False, key="item_id")
    return similar.jaccard_pairs(sets).withColumn("jaccard", F.round("jaccard", 6))


@query("sim03_jaccard_documents")
def sim03_documents(spark, sf_dir):
    sets = similar.shingle_sets(table(spark, sf_dir, "documents"), 5, hashed=False)
    return similar.jaccard_pairs(sets).withColumn("jaccard", F.round("jaccard", 6))


@query("sim05_lsh")
def sim05(spark, sf_dir):
    return similar.lsh_pairs(table(spark, sf_dir, "documents"), least=0.5)


# itemsets

_FREQUENT = f"""{_BASKETS}, f1 AS MATERIALIZED (SELECT item, count(*) AS c FROM bi GROUP BY item HAVING count(*) > 0.001 * (SELECT n FROM nb)),
f2 AS MATERIALIZED (SELECT a.item AS i, b.item AS j, count(*) AS c FROM bi a JOIN bi b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL HAVING count(*) > 0.001 * (SELECT n FROM nb))"""


@query("fim05_itemsets", f"WITH {_FREQUENT} SELECT item::VARCHAR AS itemset, c AS freq FROM f1 UNION ALL SELECT i || ' ' || j, c FROM f2")
def fim05(spark, sf_dir):
    return itemsets.frequent_itemsets(supplier_baskets(spark, sf_dir), 0.001, 2).select(F.array_join(F.transform("itemset", lambda x: x.cast("string")), " ").alias("itemset"), "freq")


@query("fim06_rules", f"WITH {_FREQUENT}, r AS (SELECT a.item AS lhs, b.item AS rhs, count(*) AS common FROM bi a JOIN f1 USING (item) JOIN bi b ON a.basket = b.basket AND a.item <> b.item GROUP BY ALL) SELECT lhs, rhs, round(common / c, 6) AS confidence FROM r JOIN f1 ON lhs = item WHERE common / c > 0.02")
def fim06(spark, sf_dir):
    pairs = supplier_baskets(spark, sf_dir)
    found = itemsets.rules(pairs, itemsets.frequent_itemsets(pairs, 0.001, 1), 0.02)
    return found.select(F.col("lhs")[0].alias("lhs"), "rhs", F.round("confidence", 6).alias("confidence"))


# links


def _pagerank_sql(rounds: int) -> str:
    ctes = [_PARTS, "n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "c AS (SELECT count(*)::DOUBLE AS n FROM n)", "d AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src)", "r0 AS (SELECT id, 1 / n AS rank FROM n, c)"]
    for i in range(rounds):
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM d)) / n) + 0.15 / n AS rank FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / d) AS s FROM e JOIN d USING (src) JOIN r{i} ON id = e.src GROUP BY dst) ON dst = n.id)")
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("la01_pagerank", _pagerank_sql(8))
def la01(spark, sf_dir):
    return links.pagerank(next_parts(spark, sf_dir), tolerance=0, rounds=8).select("id", F.round("rank", 9).alias("rank"))


def _hits_sql(rounds: int) -> str:
    ctes = [_PARTS, "h0 AS (SELECT src AS id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM e UNION SELECT dst, 1.0, 1.0 FROM e)"]
    for i in range(rounds):
        ctes.append(f"x{i} AS MATERIALIZED (SELECT h.id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM h{i} h LEFT JOIN (SELECT dst, sum(hub) AS a FROM e JOIN h{i} ON id = src GROUP BY dst) ON dst = h.id LEFT JOIN (SELECT src, sum(authority) AS b FROM e JOIN h{i} ON id = dst GROUP BY src) ON src = h.id)")
        ctes.append(f"h{i + 1} AS MATERIALIZED (SELECT id, b / (SELECT sqrt(sum(b * b)) FROM x{i}) AS hub, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS authority FROM x{i})")
    return f"WITH {', '.join(ctes)} SELECT id, round(hub, 8) AS hub, round(authority, 8) AS authority FROM h{rounds}"


@query("la08_hits", _hits_sql(5))
def la08(spark, sf_dir):
    return links.hits(next_parts(spark, sf_dir), tolerance=0, rounds=5).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


# graphs


@query("tri08_triangles", f"WITH {_TOGETHER}, t AS (SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id), w AS (SELECT sum(k * (k - 1) // 2)::BIGINT AS wedges FROM d) SELECT triangles, wedges, round(3 * triangles / wedges, 9) AS transitivity FROM t, w")
def tri08(spark, sf_dir):
    return graphs.triangles(parts_together(spark, sf_dir)).withColumn("transitivity", F.round("transitivity", 9))


@query("tri04_directed_wedges", f"WITH {_PARTS}, i AS (SELECT dst AS id, count(*) AS x FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS y FROM e GROUP BY src) SELECT sum(x * y)::BIGINT AS wedges FROM i JOIN o USING (id)")
def tri04(spark, sf_dir):
    return graphs.directed_wedge_count(next_parts(spark, sf_dir))


@query("gp07_color_degrees", f"WITH {_PARTS}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, (dst % 4)::INT AS color, count(*) AS degree FROM s GROUP BY ALL")
def gp07(spark, sf_dir):
    sym = graphs.affinity(next_parts(spark, sf_dir))
    return graphs.color_degrees(sym, graphs.initial_parts(links.nodes_of(sym), 4))


@query("gp09_edge_cut", f"WITH {_PARTS}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT (count(*) FILTER (WHERE src % 4 <> dst % 4) // 2)::BIGINT AS edge_cut FROM s")
def gp09(spark, sf_dir):
    sym = graphs.affinity(next_parts(spark, sf_dir))
    return graphs.edge_cut(sym, graphs.initial_parts(links.nodes_of(sym), 4))


@query("gp05_partition")
def gp05(spark, sf_dir):
    return graphs.partition(next_parts(spark, sf_dir), rounds=3)[1]


# learning


@query("ml01_profile", "SELECT 'o_totalprice' AS column, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS nulls, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def ml01(spark, sf_dir):
    return learn.profile(table(spark, sf_dir, "orders"), ["o_totalprice"]).withColumn("mean", F.round("mean", 4))


@query("ml02_expectations", "SELECT 'l_quantity' AS column, count(*) FILTER (WHERE NOT coalesce(l_quantity BETWEEN 5 AND 45, false)) AS violations FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0.01 AND 0.09, false)) FROM lineitem")
def ml02(spark, sf_dir):
    return learn.violations(table(spark, sf_dir, "lineitem"), {"l_quantity": (5, 45), "l_discount": (0.01, 0.09)})


_KNN = """d AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
p AS (SELECT vec_id, label, other AS prediction FROM d WHERE r = 1)"""


@query("ml05_knn", f"WITH {_KNN} SELECT vec_id, prediction FROM p")
def ml05(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return learn.knn(rows, rows, 2)


@query("ml06_report", f"WITH {_KNN}, c AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM p GROUP BY label), s AS (SELECT prediction AS label, count(*) AS said FROM p GROUP BY ALL) SELECT label, round(coalesce(tp / said, 0), 6) AS precision, round(tp / support, 6) AS recall, support FROM c LEFT JOIN s USING (label)")
def ml06(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = learn.knn(rows, rows, 2).join(rows.select("vec_id", "label"), "vec_id")
    return learn.report(found).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


# events


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, node, time): events in a shuffled order of arrival."""
    return table(spark, sf_dir, "events").select((F.col("event_id") * 7919 % 100003 * 1000003 + F.col("event_id")).alias("arrival"), F.col("event_type").alias("node"), F.col("event_id").alias("time"))


def event_types(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").filter("event_type IS NOT NULL").distinct().orderBy("event_type").collect()]


@query("str03_safe_release", """WITH log AS (SELECT event_id * 7919 % 100003 * 1000003 + event_id AS arrival, event_type AS node, event_id AS time FROM events),
ks AS (SELECT DISTINCT node FROM log WHERE node IS NOT NULL), m AS (SELECT l.arrival, k.node, coalesce(max(CASE WHEN l.node = k.node THEN l.time END) OVER (PARTITION BY k.node ORDER BY l.arrival), 0) AS t FROM log l, ks k),
s AS (SELECT arrival, min(t) AS safe FROM m GROUP BY arrival), f AS (SELECT safe, min(arrival) AS first_at FROM s GROUP BY safe)
SELECT arrival, node, time, CASE WHEN first_at IS NOT NULL THEN greatest(first_at, arrival) END AS released_at FROM log ASOF LEFT JOIN f ON log.time <= f.safe""")
def str03(spark, sf_dir):
    return events.safe_release(event_log(spark, sf_dir), event_types(spark, sf_dir))


@query("str07_newest", "WITH l AS (SELECT user_id, event_id, event_id * 7919 % 100003 AS arrival FROM events), b AS (SELECT *, max(event_id) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l) SELECT user_id, event_id FROM b WHERE m IS NULL OR event_id > m")
def str07(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct(F.col("event_id") * 7919 % 100003, "event_id").alias("arrival"))
    return events.newest_only(log, "user_id", "event_id", "arrival").select("user_id", "event_id")


@query("str11_suspicions", "WITH m AS (SELECT max(ts) AS t FROM events), g AS (SELECT user_id AS node, ts, t, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events, m) SELECT node, count(*) AS n, round(sum(epoch_us(nx) - epoch_us(ts) - 3600000000) / 1e6, 3) AS silent_s FROM g WHERE epoch_us(coalesce(nx, t)) - epoch_us(ts) > 3600000000 GROUP BY node")
def str11(spark, sf_dir):
    found = events.suspicions(table(spark, sf_dir, "events").withColumnRenamed("user_id", "node"), 3600.0)
    return found.groupBy("node").agg(F.count("*").alias("n"), F.round(F.sum(F.unix_micros("restored_at") - F.unix_micros("suspected_at")) / 1e6, 3).alias("silent_s"))


@query("str13_first_delivery", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def str13(spark, sf_dir):
    return events.first_delivery(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("str15_register", "WITH r AS (SELECT l_orderkey AS rid, l_quantity AS ts, l_suppkey AS wr, l_partkey AS value FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ts DESC, wr DESC, value DESC) AS p, count(*) OVER (PARTITION BY rid) AS c FROM r) SELECT rid, value, ts, wr FROM k WHERE p = 1 AND c > 2.5")
def str15(spark, sf_dir):
    replies = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_quantity").alias("ts"), F.col("l_suppkey").alias("wr"), F.col("l_partkey").alias("value"))
    return events.register_read(replies, 5)


@query("str17_decided", "WITH h AS (SELECT l_suppkey % 7 AS node, max(l_orderkey) AS acked FROM lineitem GROUP BY ALL) SELECT acked AS decided FROM h ORDER BY acked DESC LIMIT 1 OFFSET 3")
def str17(spark, sf_dir):
    acks = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(7)).alias("node"), F.col("l_orderkey").alias("acked"))
    return events.decided_length(acks, 7)


@query("str20_colours", """WITH o AS (SELECT user_id AS node, event_id, event_id % 256 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events),
s AS (SELECT node, max(c) AS c, sum(n) FILTER (WHERE k % 3 = 1) AS a, sum(n) FILTER (WHERE k % 3 = 2) AS b, sum(n) FILTER (WHERE k % 3 = 0) AS z FROM o GROUP BY node),
v AS (SELECT node, c, coalesce(a, 0) % 256 AS a, coalesce(b, 0) % 256 AS b, coalesce(z, 0) % 256 AS z FROM s)
SELECT node, (CASE c % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE z END)::BIGINT AS r, (CASE c % 3 WHEN 0 THEN b WHEN 1 THEN z ELSE a END)::BIGINT AS g, (CASE c % 3 WHEN 0 THEN z WHEN 1 THEN a ELSE b END)::BIGINT AS b FROM v""")
def str20(spark, sf_dir):
    return events.colour_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") % 256).alias("n")))


@query("str24_stamped", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def str24(spark, sf_dir):
    return events.stamped(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", F.col("seq").cast("long").alias("seq"))


# routing and agents


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each nation with the next, and with those of its region."""
    n = table(spark, sf_dir, "nation")
    near = n.select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst"))
    same = n.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").filter("dst = src + 5 OR dst = src - 5").select("src", "dst")
    return near.unionByName(same)


@query("net02_routes", """WITH RECURSIVE l AS (SELECT n_nationkey AS src, n_nationkey + 1 AS dst FROM nation UNION SELECT a.n_nationkey, b.n_nationkey FROM nation a JOIN nation b USING (n_regionkey) WHERE abs(a.n_nationkey - b.n_nationkey) = 5),
r AS (SELECT 0 AS node, 0 AS gateway, 0 AS hops UNION SELECT 3, 3, 0 UNION SELECT l.dst, r.gateway, r.hops + 1 FROM r JOIN l ON r.node = l.src WHERE r.hops < 26),
m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node) SELECT node, min(gateway) AS gateway, hops FROM r JOIN m USING (node, hops) GROUP BY node, hops""")
def net02(spark, sf_dir):
    return routing.routing_table(nation_links(spark, sf_dir), spark.createDataFrame([(0,), (3,)], "node int"))


@query("net06_owners", "WITH k AS (SELECT c_custkey, c_custkey * 31 % 1009 AS key FROM customer), o AS (SELECT c_custkey, key, s_suppkey FROM k ASOF LEFT JOIN supplier ON k.key <= s_suppkey) SELECT c_custkey, key, coalesce(s_suppkey, (SELECT min(s_suppkey) FROM supplier)) AS owner FROM o")
def net06(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 31 % 1009).alias("key"))
    return routing.owners(table(spark, sf_dir, "supplier"), keys, "s_suppkey")


@query("net07_ring", "SELECT s_suppkey AS node, coalesce(lag(s_suppkey) OVER (ORDER BY s_suppkey), (SELECT max(s_suppkey) FROM supplier)) AS predecessor, coalesce(lead(s_suppkey) OVER (ORDER BY s_suppkey), (SELECT min(s_suppkey) FROM supplier)) AS successor FROM supplier")
def net07(spark, sf_dir):
    return routing.ring(table(spark, sf_dir, "supplier"), "s_suppkey")


_POINTS = "pt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007)::DOUBLE AS x, (c_custkey * 104729 % 10009)::DOUBLE AS y FROM customer), sp AS (SELECT s_suppkey AS id, (s_suppkey * 7907 % 10007)::DOUBLE AS x, (s_suppkey * 104723 % 10009)::DOUBLE AS y FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = lambda c, a, b: [F.col(c).alias("id"), (F.col(c) * a % 10007).cast("double").alias("x"), (F.col(c) * b % 10009).cast("double").alias("y")]
    return table(spark, sf_dir, "customer").select(*at("c_custkey", 7919, 104729)), table(spark, sf_dir, "supplier").select(*at("s_suppkey", 7907, 104723))


@query("agt01_within", f"WITH {_POINTS} SELECT pt.id AS l_id, sp.id AS r_id, round(sqrt((pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2), 6) AS dist FROM pt, sp WHERE sqrt((pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2) < 500")
def agt01(spark, sf_dir):
    return agents.within(*points(spark, sf_dir), 500.0).withColumn("dist", F.round("dist", 6))


@query("agt02_nearest", f"WITH {_POINTS}, d AS (SELECT pt.id AS l_id, sp.id AS r_id, row_number() OVER (PARTITION BY pt.id ORDER BY (pt.x - sp.x) ** 2 + (pt.y - sp.y) ** 2, sp.id) AS k FROM pt, sp) SELECT l_id, r_id FROM d WHERE k = 1")
def agt02(spark, sf_dir):
    return agents.nearest(*points(spark, sf_dir))


_BIDS = "b AS (SELECT o_custkey % 100 AS auction, o_custkey AS bidder, o_totalprice AS bid, o_orderkey AS place FROM orders)"


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("auction"), F.col("o_custkey").alias("bidder"), F.col("o_totalprice").alias("bid"), F.col("o_orderkey").alias("place"))


@query("agt06_dutch", f"WITH {_BIDS}, t AS (SELECT auction, max(bid) AS top FROM b GROUP BY auction), p AS (SELECT auction, 600000 - greatest(ceil((600000 - top) / 100), 0) * 100 AS price FROM t), q AS (SELECT auction, CASE WHEN price >= 1000 THEN price END AS price FROM p), w AS (SELECT auction, arg_min(bidder, place) AS winner FROM q JOIN b USING (auction) WHERE bid >= price GROUP BY auction) SELECT auction, winner, price FROM q LEFT JOIN w USING (auction)")
def agt06(spark, sf_dir):
    offers = bids(spark, sf_dir)
    held = offers.select("auction").distinct().select("auction", F.lit(600000.0).alias("start"), F.lit(1000.0).alias("least"))
    return agents.dutch_auction(held, offers.withColumnRenamed("bid", "max_price"), 100.0)


@query("agt07_first_price", f"WITH {_BIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY bid DESC, place) AS k FROM b) SELECT auction, bidder AS winner, bid AS price FROM r WHERE k = 1")
def agt07(spark, sf_dir):
    return agents.first_price(bids(spark, sf_dir))


@query("agt08_second_price", f"WITH {_BIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY bid DESC, place) AS k FROM b) SELECT auction, max(bidder) FILTER (WHERE k = 1) AS winner, min(bid) AS price FROM r WHERE k <= 2 GROUP BY auction")
def agt08(spark, sf_dir):
    return agents.second_price(bids(spark, sf_dir))


@query("agt05_best_scene", "WITH g AS (SELECT c_custkey AS id, (c_custkey % 7)::DOUBLE AS a, (c_custkey % 11)::DOUBLE AS b, (c_custkey % 13)::DOUBLE AS c FROM customer), s AS (SELECT n_nationkey AS id, (n_nationkey % 5)::DOUBLE AS a, (n_nationkey % 3)::DOUBLE AS b, (n_nationkey % 4)::DOUBLE AS c FROM nation), u AS (SELECT g.id AS guest, s.id AS scene, g.a * s.a + g.b * s.b + g.c * s.c AS utility FROM g, s), r AS (SELECT *, row_number() OVER (PARTITION BY guest ORDER BY utility DESC, scene) AS k FROM u) SELECT guest, scene, utility FROM r WHERE k = 1")
def agt05(spark, sf_dir):
    trait = lambda c, *m: [F.col(c).alias("id"), *[(F.col(c) % x).cast("double").alias(n) for n, x in zip("abc", m, strict=True)]]
    return agents.best_scene(table(spark, sf_dir, "customer").select(*trait("c_custkey", 7, 11, 13)), table(spark, sf_dir, "nation").select(*trait("n_nationkey", 5, 3, 4)), ["a", "b", "c"])


@query("agt10_queens", "WITH RECURSIVE q AS (SELECT [i::INT] AS rows FROM range(6) t(i) UNION ALL SELECT list_append(rows, i::INT) FROM q, range(6) t(i) WHERE len(rows) < 6 AND NOT list_contains(rows, i::INT) AND len(list_filter(range(1, len(rows) + 1), lambda j: abs(rows[j] - i) = len(rows) + 1 - j)) = 0) SELECT array_to_string(rows, ' ') AS rows FROM q WHERE len(rows) = 6")
def agt10(spark, sf_dir):
    return agents.queens(spark, 6).select(F.array_join(F.transform("rows", lambda x: x.cast("string")), " ").alias("rows"))


@query("agt14_grid", "SELECT x, y, (x + y) % 2 = 1 AS dark FROM range(20) a(x), range(30) b(y)")
def agt14(spark, sf_dir):
    return agents.parity_grid(spark, 20, 30)


@query("agt23_travelled", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def agt23(spark, sf_dir):
    track = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("step"), F.col("value").alias("dist"))
    return agents.travelled(track).select(F.col("step").alias("event_id"), F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked retrieval."""
    return ir05(spark, sf_dir)


from lodestone.plans import agent_queries, event_queries, graph_queries, text_queries  # noqa: E402, F401

__all__ = ["QUERIES", "SQL", "flagship"]

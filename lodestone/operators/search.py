"""Boolean, phrase, wildcard and ranked retrieval, spelling and feedback (IR-*)."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import indel_at_most_two, kgrams, query_terms
from lodestone.operators import index as ix
from lodestone.plans.storage import stored


@dataclass(frozen=True)
class Index:
    """Postings (term, doc_id, tf, positions), document frequencies (term, df), words (doc_id, n_words), sizes (doc_id, n_words, euclid), k-grams (kgram, term) and weights (doc_id, term, tf, df, w).

    They are lazy plans over documents, or tables of a stored index, of which a search reads the rows of
    its terms. ``table`` gives those of the last three that it is asked for.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    words: DataFrame
    table: Callable[[str], DataFrame]
    n: int

    @classmethod
    def of(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        ids = docs.select(F.col(key).alias("doc_id"))
        postings = ix.postings(ix.tokens(docs, key, text))
        terms, n = ix.document_frequency(postings), ids.distinct().count()
        weighted = ix.weights(n, postings, terms)
        sizes = ix.lengths(weighted)
        return cls(ids, postings, terms, sizes.select("doc_id", "n_words"), {"sizes": sizes, "kgrams": ix.kgram_index(terms.select("term")), "weights": weighted}.__getitem__, n)

    @classmethod
    def stored(cls, store: ix.IndexStore) -> Index:
        words = store.read("words")
        return cls(words.select("doc_id"), store.read("postings"), store.read("terms"), words, lambda name: store.weights() if name == "weights" else store.read(name), store.documents)

    @property
    def sizes(self) -> DataFrame:
        return self.table("sizes")

    @property
    def kgrams(self) -> DataFrame:
        return self.table("kgrams")

    @property
    def weights(self) -> DataFrame:
        return self.table("weights")

    @property
    def vocabulary(self) -> DataFrame:
        return self.terms.select("term")

    def search(self, query: str, kind: str = "ranked", ranking: str = "tf_idf", norm: str = "words", pagerank: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
        """Dispatch by kind (and, phrase, ranked) and ranking (tf_idf, pagerank, combination, hits)."""
        if kind == "and":
            return intersection(self, query)
        if kind == "phrase":
            return phrase(self, query)
        if kind != "ranked":
            raise ValueError(kind)
        if ranking == "hits":
            from lodestone.operators.links import hits_ranking

            return hits_ranking(any_of(self, query), links)
        return ranked(self, dict.fromkeys(query_terms(query), 1.0), norm, ranking, pagerank)


def _matches(term: Column, pattern: str) -> Column:
    """A term equal to the pattern, in which * stands for any characters; its literal beginning is pushed down."""
    if "*" not in pattern:
        return term == pattern
    whole = term.rlike("^" + ".*".join(re.escape(p) if p else "" for p in pattern.split("*")) + "$")
    head = pattern.split("*")[0]
    return term.startswith(head) & whole if head else whole


def _found(table: DataFrame, patterns: list[str]) -> DataFrame:
    """The rows whose term matches a pattern."""
    plain = [p for p in patterns if "*" not in p]
    tests = [F.col("term").isin(plain)] if plain else []
    tests += [_matches(F.col("term"), p) for p in patterns if "*" in p]
    return table.filter(reduce(lambda a, b: a | b, tests)) if tests else table.limit(0)


def _slotted(table: DataFrame, patterns: list[str]) -> DataFrame:
    """Those rows once for each pattern that they match, with its number as slot."""
    slots = F.filter(F.array(*[F.when(_matches(F.col("term"), p), F.lit(i)) for i, p in enumerate(patterns)]), lambda x: x.isNotNull())
    return _found(table, patterns).withColumn("slot", F.explode(slots)) if patterns else table.limit(0).withColumn("slot", F.lit(0))


def intersection(index: Index, query: str) -> DataFrame:
    """doc_id of the documents that have every word or wildcard of the query."""
    patterns = list(dict.fromkeys(query_terms(query)))
    hit = _slotted(index.postings.select("term", "doc_id"), patterns).groupBy("doc_id")
    return hit.agg(F.count_distinct("slot").alias("n")).filter(F.col("n") == len(patterns)).select("doc_id")


def phrase(index: Index, query: str) -> DataFrame:
    """(doc_id, pos): places of the last word of the phrase; one shuffle whatever its length."""
    patterns = query_terms(query)
    hit = _slotted(index.postings.select("term", "doc_id", "positions"), patterns).select("doc_id", "slot", F.explode("positions").alias("pos"))
    found = hit.groupBy("doc_id", (F.col("pos") - F.col("slot")).alias("start")).agg(F.count_distinct("slot").alias("n")).filter(F.col("n") == len(patterns))
    return found.select("doc_id", (F.col("start") + len(patterns) - 1).alias("pos"))


def any_of(index: Index, query: str) -> DataFrame:
    """doc_id of the documents that have a word of the query."""
    return _found(index.postings, query_terms(query)).select("doc_id").distinct()


def merged_postings(index: Index, query: str) -> DataFrame:
    """(doc_id, tf, positions) of all words that the query's words and wildcards stand for, as if they were one."""
    found = _found(index.postings, query_terms(query)).groupBy("doc_id")
    return found.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def by_document(found: DataFrame) -> DataFrame:
    """Results in the order of doc_id."""
    return found.orderBy("doc_id")


def query_length(query: dict[str, float]) -> float:
    """Sum of a query's weights."""
    return float(sum(query.values()))


def ranked(index: Index, query: dict[str, float], norm: str = "words", ranking: str = "tf_idf", pagerank: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of every document that has a term of the weighted query.

    Each term that a wildcard stands for keeps its own document frequency and is one matched term.
    pagerank (doc_id, rank) is added once for each matched term, 0 where it is missing; the
    combination is 0.01 of tf-idf and 0.99 of it. norm is "words" or "euclid".
    """
    patterns = list(query)
    terms = _found(index.terms, patterns)
    matched = _slotted(index.postings.select("term", "doc_id", "tf"), patterns).join(terms, "term")
    weight = F.array(*[F.lit(float(w)) for w in query.values()])[F.col("slot")] if query else F.lit(0.0)
    matched = matched.withColumn("w", weight * F.col("tf") * F.log(F.lit(index.n) / F.col("df")))
    if ranking != "tf_idf":
        matched = matched.join(pagerank.select("doc_id", "rank"), "doc_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    size = F.col("n_words" if norm == "words" else "euclid").cast("double")
    sums = matched.groupBy("doc_id").agg(F.sum("w").alias("w"), *([F.sum("rank").alias("rank")] if ranking != "tf_idf" else []))
    tf_idf = F.col("w") / size
    score = {"tf_idf": lambda: tf_idf, "pagerank": lambda: F.col("rank"), "combination": lambda: 0.01 * tf_idf + 0.99 * F.col("rank")}[ranking]()
    return sums.join(index.words if norm == "words" else index.sizes.select("doc_id", "euclid"), "doc_id").select("doc_id", score.alias("score"))


def top(scored: DataFrame, k: int = 10, skip: int = 0) -> DataFrame:
    """The k best after the first ``skip``; equal scores by doc_id."""
    return scored.orderBy(F.desc("score"), "doc_id").offset(skip).limit(k)


def feedback(index: Index, query: dict[str, float], relevant: DataFrame, alpha: float = 0.2, beta: float = 0.8) -> DataFrame:
    """(term, weight): alpha of the old weights plus beta of the words' counts in the relevant documents."""
    spark = relevant.sparkSession
    old = spark.createDataFrame([(t, alpha * w) for t, w in query.items()], "term string, weight double")
    chosen = stored(relevant.select("doc_id").distinct())
    chosen = F.broadcast(chosen) if chosen.count() <= ix.HOT_TERMS else chosen
    new = index.postings.join(chosen, "doc_id", "left_semi").groupBy("term").agg((F.lit(beta) * F.sum("tf")).alias("weight"))
    return old.unionByName(new).groupBy("term").agg(F.sum("weight").alias("weight"))


def ranked_by_terms(index: Index, query: DataFrame) -> DataFrame:
    """(doc_id, score) for a query of any size given as (term, weight), by word count."""
    wanted = stored(index.terms.join(query, "term").select("term", "df", "weight"))
    met = F.broadcast(wanted) if wanted.count() <= ix.HOT_TERMS else wanted
    w = F.col("tf") * F.log(F.lit(index.n) / F.col("df"))
    weighted = index.postings.select("term", "doc_id", "tf").join(met, "term").withColumn("w", w)
    sums = weighted.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))
    return sums.join(index.words, "doc_id").select("doc_id", (F.col("w") / F.col("n_words")).alias("score"))


def spelling(index: Index, word: str, k: int = 2, least: float = 0.4, limit: int | None = 10, repeats: bool = False) -> DataFrame:
    """(term, jaccard): terms whose k-grams overlap the word's and whose edit distance from it is at most 2.

    Only terms that share a k-gram are looked at. ``repeats`` counts a k-gram of the word as often as it
    occurs there.
    """
    framed = f"^{word}$"
    mine = Counter(framed[i : i + k] for i in range(len(framed) - k + 1))
    times = F.create_map(*[F.lit(x) for g, n in mine.items() for x in (g, n if repeats else 1)])
    size = sum(mine.values()) if repeats else len(mine)
    near = index.kgrams.filter(F.col("kgram").isin(sorted(mine))).filter(F.abs(F.length("term") - len(word)) <= 2)
    scored = near.groupBy("term").agg(F.sum(times[F.col("kgram")]).alias("both")).withColumn("n", F.size(F.array_distinct(kgrams(F.col("term"), k))))
    scored = scored.withColumn("jaccard", F.col("both") / (F.col("n") + size - F.col("both")))
    found = scored.filter((F.col("jaccard") >= least) & indel_at_most_two(F.col("term"), F.lit(word))).select("term", "jaccard").orderBy(F.desc("jaccard"), "term")
    return found if limit is None else found.limit(limit)


def search_or_suggest(index: Index, query: str, kind: str = "and", limit: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """(results, suggestions): suggestions (word, term, jaccard) for the query's unknown words, only if nothing was found."""
    found = index.search(query, kind)
    if not found.isEmpty():
        return found, None
    known = {r["term"] for r in ix.lookup(index.terms, query_terms(query)).select("term").collect()}
    parts = [spelling(index, w, limit=limit).select(F.lit(w).alias("word"), "term", "jaccard") for w in dict.fromkeys(query_terms(query)) if w not in known and "*" not in w]
    return found, reduce(DataFrame.unionByName, parts) if parts else None


def timed_search(index: Index, query: str, kind: str = "ranked") -> dict[str, float]:
    """Rows of a search and the seconds to plan it and to run it."""
    began = time.perf_counter()
    found = index.search(query, kind)
    found._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    rows = found.count()
    return {"rows": rows, "plan_seconds": planned - began, "run_seconds": time.perf_counter() - planned}


def precision(ranked_docs: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(precision, recall, ndcg) of the k best against (doc_id, relevance)."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("score"), "doc_id")
    best = ranked_docs.orderBy(F.desc("score"), "doc_id").limit(k).withColumn("place", F.row_number().over(order))
    hit = best.join(judged, "doc_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    gain = lambda c: F.sum((F.pow(F.lit(2.0), c) - 1) / F.log2(F.col("place") + 1))
    ideal = judged.orderBy(F.desc("relevance")).limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("relevance")))).agg(gain(F.col("relevance")).alias("ideal"))
    got = hit.agg(F.avg((F.col("relevance") > 0).cast("double")).alias("precision"), F.sum((F.col("relevance") > 0).cast("long")).alias("found"), gain(F.col("relevance")).alias("dcg"))
    total = judged.filter("relevance > 0").agg(F.count("*").alias("relevant"))
    return got.crossJoin(total).crossJoin(ideal).select("precision", F.try_divide("found", "relevant").alias("recall"), F.try_divide("dcg", "ideal").alias("ndcg"))

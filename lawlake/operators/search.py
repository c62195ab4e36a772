"""Lexical, dense and fused retrieval as declarative plans.

BM25 takes one aggregation for the corpus statistics of the query's terms (no postings are exploded or
shuffled) and one scan for scores, ended by a top-k; dense retrieval is an exact scan with a top-k; fusion
joins two short ranked lists.

Defined results: null and empty texts have no tokens and never match; ties end in the id; a query without
terms matches nothing; vectors that are null or zero have no similarity and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
TOKEN = r"([\p{L}\p{N}\p{M}]+)"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks in lower case, in order, repeated ones kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def bm25(docs: DataFrame, text_col: str, query: list[str]) -> DataFrame:
    """The other columns of ``docs`` with ``score`` where a query term occurs: idf ln(1 + (N - df + .5)/(df + .5)), k1 1.2, b .75.

    Each text is reduced to its length and the counts of the terms where it is read; rows delivered twice
    are dropped after that, so no text is shuffled.
    """
    terms = list(dict.fromkeys(t.lower() for t in query))
    own = [c for c in docs.columns if c != text_col]

    def occurrences(term: str) -> Column:
        return F.size(F.filter("__t", lambda x: x == term))

    counted = docs.withColumn("__t", tokens(F.col(text_col))).select(*own, F.size("__t").alias("__len"), *[occurrences(t).alias(f"__tf{i}") for i, t in enumerate(terms)])
    rows = counted.distinct()
    tf = lambda i: F.col(f"__tf{i}")
    stats = rows.agg(F.struct(F.count("*").alias("n"), F.avg("__len").alias("avg"), *[F.count_if(tf(i) > 0).alias(f"df{i}") for i in range(len(terms))])).scalar()
    norm = K1 * (1 - B + B * F.col("__len") / F.col("__st.avg"))

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("__st.n") - F.col(f"__st.df{i}") + 0.5) / (F.col(f"__st.df{i}") + 0.5))
        return idf * tf(i) * (K1 + 1) / (tf(i) + norm)

    hit = reduce(lambda a, i: a | (tf(i) > 0), range(len(terms)), F.lit(False))
    score = reduce(lambda a, i: a + part(i), range(len(terms)), F.lit(0.0))
    return rows.where(hit).withColumn("__st", stats).withColumn("score", F.round(score, 6)).select(*own, "score")


def top_k(scored: DataFrame, id_col: str, k: int, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), id_col).limit(k)


def top_per_group(scored: DataFrame, group: str, id_col: str, k: int) -> DataFrame:
    w = W.partitionBy(group).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def lexicon(docs: DataFrame, id_col: str, text_col: str, longest: int = 128) -> DataFrame:
    """``(term, ndoc)``: the documents that hold each term of at most ``longest`` bytes."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return terms.where(F.octet_length("term") <= longest).groupBy("term").agg(F.count("*").alias("ndoc"))


def dead_terms(terms: DataFrame, alive: DataFrame) -> DataFrame:
    """Terms that no living document holds."""
    return terms.join(alive.select("term"), "term", "left_anti")


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def expand_terms(query: DataFrame, terms: DataFrame, least: float = 0.5, most: int = 6) -> DataFrame:
    """``(token, term, similarity)``: up to ``most`` terms of which each query token looks like a part.

    Word similarity: of all stretches of the term's trigrams, the best share that the stretch and the token's
    trigrams have in common. The best stretch begins and ends with a shared trigram. An equi-join on trigrams;
    only pairs that share one are ever made. Ties: the term in more documents (``ndoc``), then by name.
    """
    q = query.where(F.length("token") >= 3).select("token", F.explode(trigrams(F.col("token"))).alias("g"), F.size(trigrams(F.col("token"))).alias("nq"))
    t = terms.select("term", "ndoc", F.posexplode(trigrams(F.col("term"))).alias("at", "g"))
    pairs = q.join(t, "g").groupBy("token", "term", "nq", "ndoc").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # with k + 1 shared trigrams over a stretch of n there are nq + n - (k + 1) in all
    share = lambda i, j: (j - i + 1) / (F.col("nq") + F.element_at("at", j) - F.element_at("at", i) + 1 - (j - i + 1))
    places = F.sequence(F.lit(1), F.size("at"))
    best = F.array_max(F.transform(places, lambda i: F.array_max(F.transform(F.filter(places, lambda j: j >= i), lambda j: share(i, j)))))
    near = pairs.withColumn("similarity", F.round(best, 6)).where((F.col("similarity") >= least) & (F.col("token") != F.col("term")))
    w = W.partitionBy("token").orderBy(F.desc("similarity"), F.desc("ndoc"), "term")
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("token", "term", "similarity")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows nearest to the one vector of ``query`` (column ``q``), exact."""
    asked = vectors.withColumn("__q", query.select("q").limit(1).scalar())
    scored = asked.withColumn("score", F.round(cosine(F.col(vec_col), F.col("__q")), 6)).drop("__q")
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank_fusion(arms: list[DataFrame], id_col: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Ranked lists (short, with ``score``) fused by the sum of 1 / (rrf_k + rank); ties by id."""
    ranked = [a.select(F.col(id_col).alias("id"), F.row_number().over(W.orderBy(F.desc("score"), id_col)).alias("rn")) for a in arms]
    fused = reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rn"))), 9).alias("rrf_score"))
    return fused.orderBy(F.desc("rrf_score"), "id").limit(k)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, at: int = 10) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``at`` per query, from (query, doc, rank) and (query, doc)."""
    gold = relevant.groupBy("query").agg(F.count("*").alias("n"))
    hits = ranked.where(F.col("rank") <= at).join(relevant, ["query", "doc"]).groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    both = gold.join(hits, "query", "left")
    return both.select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, block: int = 500) -> DataFrame:
    """``(query_id, id, score)``: the ``k`` nearest rows of every query, itself left out, exact.

    A stated set of queries runs against all rows in blocks: each task scores its Arrow batch against the
    queries by matrix products and keeps its own top k per query, so what is shuffled is k rows per query
    and task. The query vectors are sent to the tasks block by block, ``block`` at a time.
    """
    import numpy as np
    import pandas as pd

    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).orderBy("q")
    parts = asked.toLocalIterator()
    out, done = None, False
    kind = vectors.schema[id_col].dataType.simpleString()
    while not done:
        chunk = []
        for row in parts:
            chunk.append(row)
            if len(chunk) == block:
                break
        done = len(chunk) < block
        if not chunk and out is not None:
            break
        ids = [r.q for r in chunk]
        m = np.array([r.v for r in chunk], np.float64) if chunk else np.zeros((0, 1))
        norms = np.linalg.norm(m, axis=1) if chunk else np.zeros(0)

        def score(frames, ids=ids, m=m, norms=norms):
            for f in frames:
                f = f[f[vec_col].notna()]
                if not len(f) or not ids:
                    continue
                x = np.stack(f[vec_col].to_numpy()).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.round((x @ m.T) / (np.linalg.norm(x, axis=1)[:, None] * norms[None, :]), 6)
                keys = f[id_col].to_numpy()
                for j, q in enumerate(ids):
                    ok = np.flatnonzero(np.isfinite(s[:, j]) & (keys != q))
                    top = ok[np.lexsort((keys[ok], -s[ok, j]))[:k]]
                    yield pd.DataFrame({"query_id": q, id_col: keys[top], "score": s[top, j]})

        made = vectors.select(id_col, vec_col).mapInPandas(score, f"query_id {kind}, {id_col} {kind}, score double")
        out = made if out is None else out.unionByName(made)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def pinned_terms(texts: DataFrame, text_col: str, glossary: DataFrame, most_terms: int = 10_000) -> DataFrame:
    """Texts with the glossary terms they hold, as whole token runs; glossary (term, rendering).

    Terms are matched by their first token (an equi-join), then checked, so no text meets every term. A
    glossary of up to ``most_terms`` is broadcast, a larger one joined by shuffle.
    """
    g = glossary.withColumn("__g", tokens(F.col("term"))).where(F.size("__g") > 0).withColumn("__k", F.element_at("__g", 1))
    g = F.broadcast(g) if g.count() <= most_terms else g
    t = texts.withColumn("__t", tokens(F.col(text_col))).withColumn("__k", F.explode(F.array_distinct("__t")))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return t.join(g, "__k").where(padded(F.col("__t")).contains(padded(F.col("__g")))).drop("__t", "__k", "__g")

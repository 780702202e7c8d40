"""Lexical retrieval: postings, corpus statistics, and BM25 for one query or for many at once.

Postings are a table (doc, term, tf) that a job stores once; a search joins it with the few terms of its queries, so
only their postings move. Statistics of the corpus are two numbers and one count per asked term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import stem, synonyms, tokens
from anamnesis.plans.scratch import spread, written

K1, B = 1.2, 0.75
PREFIX_WEIGHT, SYNONYM_WEIGHT = 0.5, 0.7


LITERAL_TERMS = 64  #: with so few asked terms they are matched while documents are read


def tokenised(docs: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(doc, t): each document's tokens."""
    text = F.col(text) if isinstance(text, str) else text
    d = spread(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text")))
    return d.select("doc", tokens(F.col("text")).alias("t"))


def postings(docs: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(doc, term, tf, dl): how often each document has each term, and its length in tokens."""
    d = tokenised(docs, key, text).select("doc", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def searched(docs: DataFrame, key: str, text: Column | str, terms: DataFrame, prefixes: bool = False) -> DataFrame:
    """(q, doc, score) for few asked terms without an index: one pass keeps of each document its length and the asked tokens."""
    asked = [r["term"] for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(asked) > LITERAL_TERMS:
        p = postings(docs, key, text)
        return bm25(p, with_prefixes(p, terms) if prefixes else terms)

    def hit(t: Column) -> Column:
        if not prefixes:
            return t.isin(asked)
        out = F.lit(False)
        for a in asked:
            out = out | t.startswith(a)
        return out

    d = written(tokenised(docs, key, text).select("doc", F.size("t").alias("dl"), F.filter("t", hit).alias("t")), "lexical-hits")
    p = d.select("doc", "dl", F.explode("t").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    return bm25(p, with_prefixes(p, terms) if prefixes else terms, lengths=d.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def statistics(p: DataFrame) -> DataFrame:
    """One row: documents with a token, and their mean length."""
    return p.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def terms_of(spark, query: str, expand: bool = False) -> DataFrame:
    """(q, term, weight) of one query; expand adds stems' synonyms."""
    import re

    words = [t for t in re.split(r"\s+", re.sub(r"[^\w\s/.\\\]^-]", " ", query.lower().replace("-", " "))) if len(t) >= 2]
    out = {w: 1.0 for w in words}
    if expand:
        table = synonyms()
        for w in words:
            for s in sorted(table.get(stem(w), ())):
                out.setdefault(s, SYNONYM_WEIGHT)
    return spark.createDataFrame([(0, t, w) for t, w in out.items()], "q long, term string, weight double")


def with_prefixes(p: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of the index that go on from an asked term, at half weight, beside the asked ones.

    Only the distinct terms of the index are compared, on their first two letters, which every asked term has.
    """
    index = p.select("term").distinct().withColumn("head", F.substring("term", 1, 2))
    asked = terms.select("q", F.col("term").alias("asked"), "weight", F.substring("term", 1, 2).alias("head"))
    more = index.join(asked, "head").where(F.col("term").startswith(F.col("asked")) & (F.col("term") != F.col("asked")))
    return terms.select("q", "term", "weight").unionByName(more.select("q", "term", (F.col("weight") * PREFIX_WEIGHT).alias("weight")))


def bm25(p: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, lengths: DataFrame | None = None) -> DataFrame:
    """(q, doc, score), rounded to 6 places, for the queries in terms (q, term, weight)."""
    asked = terms.select("term").distinct()
    hits = written(p.join(asked, "term", "left_semi"), "lexical-postings")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    s = statistics(p) if lengths is None else lengths
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # the statistics are one row, added by a key both sides have; what a posting is worth is settled before queries multiply it
    hits = hits.join(df, "term").withColumn("one", F.lit(1)).join(F.broadcast(s.withColumn("one", F.lit(1))), "one").select("doc", "term", (idf * tf).alias("worth"))
    return hits.join(terms, "term").groupBy("q", "doc").agg(F.round(F.sum(F.col("weight") * F.col("worth")), 6).alias("score"))


def top(scores: DataFrame, k: int, by: str = "q") -> DataFrame:
    """The k best documents of each query with their rank; equal scores go to the smaller document."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

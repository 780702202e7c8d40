"""A stored lexical index: stemmed postings in ranges of terms, document frequencies, and lengths.

The postings lie sorted by term, so a search reads the row groups of its few terms only; the number of documents and
their mean length are one stored row, and document frequencies a table of terms, which prefixes are looked up in.
An index is written once per state of its source (files, lengths, times) and found again by later searches.

Defined results: rows without key are left out; null texts have no terms and do not count as documents; a frequent term
may span any number of files; removing and adding documents write new tables and leave the given ones as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from anamnesis.functions.text import CJK, SEPARATORS, stem, synonyms
from anamnesis.operators.lexical import B, K1, PREFIX_WEIGHT, SYNONYM_WEIGHT
from anamnesis.plans.scratch import base_dir, cores, new_dir, remove, spread


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems; a batch's distinct words are stemmed once."""
    code, known = pd.factorize(words)
    return pd.Series([_stem(w) for w in known], dtype=object).reindex(code).reset_index(drop=True) if len(known) else words


def terms(text: Column) -> Column:
    """Lower-cased raw terms of two characters or more; runs of Chinese, Japanese or Korean characters stand apart."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(text), SEPARATORS, " "), r"\s+"), lambda t: F.length(t) >= 2)
    runs = lambda t: F.regexp_extract_all(t, F.lit(f"({CJK}+|[^{CJK[1:-1]}]+)"), F.lit(1))
    return F.when(text.rlike(CJK), F.flatten(F.transform(raw, lambda t: F.when(t.rlike(CJK), runs(t)).otherwise(F.array(t))))).otherwise(raw)


@dataclass
class Index:
    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def statistics(self) -> DataFrame:
        return self.spark.read.schema("n long, avgdl double").parquet(f"{self.path}/statistics")

    def search(self, asked: dict[str, float], prefixes: bool = True) -> DataFrame:
        """(doc, score) of documents with any of the stemmed terms, given with their weights; other terms that go on from one count by half."""
        if not asked:
            return self.postings.select("doc", F.lit(0.0).alias("score")).limit(0)
        weights = self.spark.createDataFrame(list(asked.items()), "asked string, weight double")
        term = F.col("term")
        hit = reduce(lambda a, b: a | b, (term.startswith(t) if prefixes else term == t for t in sorted(asked)))
        exact = term == F.col("asked")
        match = term.startswith(F.col("asked")) if prefixes else exact
        # terms are few: those that begin with an asked one
        wanted = self.terms.where(hit).join(F.broadcast(weights), match).select("term", "df", (F.col("weight") * F.when(exact, 1.0).otherwise(PREFIX_WEIGHT)).alias("weight"))
        wanted = wanted.groupBy("term").agg(F.first("df").alias("df"), F.sum("weight").alias("weight"))
        hits = self.postings.where(hit).join(wanted, "term")
        n, avgdl = self.statistics.first() or (0, None)  # one row
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        return hits.groupBy("doc").agg(F.round(F.sum(F.col("weight") * idf * tf), 6).alias("score"))

    def removed(self, docs: DataFrame, key: str) -> Index:
        """The index without the documents named in a column."""
        return _stored(self.postings.join(docs.select(F.col(key).alias("doc")).distinct(), "doc", "left_anti"), new_dir(self.spark, "index"))

    def added(self, docs: DataFrame, key: str, text: Column | str) -> Index:
        """The index with more documents; those it has are replaced."""
        kept = self.postings.join(docs.select(F.col(key).alias("doc")).distinct(), "doc", "left_anti")
        return _stored(kept.unionByName(postings(docs, key, text)), new_dir(self.spark, "index"))


def postings(docs: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(doc, dl, term, tf) with stemmed terms."""
    text = F.col(text) if isinstance(text, str) else text
    d = spread(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))).select("doc", terms(F.col("text")).alias("t"))
    raw = d.select("doc", F.size("t").alias("dl"), F.explode("t").alias("raw")).groupBy("doc", "dl", "raw").agg(F.count("*").alias("tf"))
    cjk = F.col("raw").rlike(CJK)
    return raw.withColumn("term", F.when(cjk, F.col("raw")).otherwise(stemmed("raw"))).groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"))


def _stored(p: DataFrame, path: str) -> Index:
    spark = p.sparkSession
    n = max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    p.repartitionByRange(n, "term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    index = Index(spark, path)
    index.postings.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.postings.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return index


def stored(spark: SparkSession, source: str, key: str, text: str) -> Index:
    """The index of a parquet source, built where no index of its present state is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    path = f"{base_dir(spark)}/stored-index/{hashlib.sha256(repr((sorted(state), key, text)).encode()).hexdigest()[:24]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/statistics/_SUCCESS")  # written last
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return Index(spark, path)
    remove(spark, path)
    return _stored(postings(spark.read.parquet(source), key, text), path)


def asked(query: str, expand: bool = True) -> dict[str, float]:
    """The stemmed terms of a query with their weights; expand adds the synonyms of a term that are not asked themselves."""
    import regex

    words = [w for w in regex.split(r"\s+", regex.sub(SEPARATORS, " ", query.lower())) if len(w) >= 2]
    runs = [x for w in words for x in (regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+", w) or [w])]
    out: dict[str, float] = {}
    table = synonyms() if expand else {}
    for w in runs:
        s = stem(w)
        out.setdefault(s, 1.0)
        for other in sorted(table.get(s, ())):
            out.setdefault(other, SYNONYM_WEIGHT)
    return out

"""Pages without sentences: stuffed keywords, lists of links, product or tag lists.

Evidence of two kinds is joined for every page.

Phrases: a text is cut into units (lines, and sentences inside them), names, numbers, links and tags are masked, and every
run of five words inside a unit is a phrase (a shorter unit is one). For each phrase the distinct hosts that use it are
counted over the whole corpus. Phrases of words that stand on several hosts are what sentences are made of: the share of
a page's words in them is ``shared``, and ``prose`` leaves out those that the page itself uses again and again, as the
rows of a product table do. Both are counted over all documents, so they are learnt from the corpus and need no lists of
words of any language. (Phrases of stuffed pages are put together at random and hardly ever stand elsewhere, so it is
missing support, not replication, that tells them; replicated runs of masks are what link and tag lists are made of.)

List density: the share of text in lines that carry links, tags, prices or separated keywords, how much the words of a
page repeat (``repeats``), and the share of its literal runs of five words that come AGAIN times or more (``stuffed``).

A page is flagged if list entries outweigh its prose (an annotated link list or a change list has a sentence in each
entry, which stands on other hosts or is not repeated), or if its words repeat while hardly any stand in shared phrases,
or if it is stuffed with literal repetitions. Pages that are mostly code or log lines are none of these.

Distinct hosts are counted in a bit map of HOST_BITS slots per phrase, which combines before the shuffle, so a phrase on
a third of all pages costs one row per task.

Defined results: null and blank texts and rows without id are no pages; texts under LEAST words carry too little
evidence and are not flagged; documents without source count as hosts of their own; repeated rows count once (the
smallest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.plans.batches import bounded
from anamnesis.plans.scratch import cores, written

WORDS_IN_PHRASE = 5
HOST_BITS = 63  #: slots of the map of hosts; hosts in one slot count as one
HOSTS = 3  #: hosts of a phrase of sentences, the page's own among them
AGAIN = 3  #: uses of a phrase in one text that count as repeating it; a paragraph given twice is no stuffing
LEAST = 12  #: words a page needs
LISTED, OUTWEIGHS = 0.45, 0.35  #: share of list lines, and how far it must exceed the share of prose
REPEATS, HARDLY = 0.5, 0.3  #: share of words that repeat, with less than this share of words in shared phrases
STUFFED, FEW = 0.2, 0.7  #: share of literal runs that come again and again, while so many words repeat
NATURAL = 0.5  #: share of code and log lines above which a page is neither
PIECE = 4_000_000  #: bytes of text measured at once

# Shapes of lines, as RE2 patterns.
LINK_OR_LIST = r"(?i)https?://|www\.|<a\s|\]\(|\s[|»›·•]\s|(?:^|\s)#[a-z]\w*|\bsku\b|\bin stock\b|[$€£]\s?\d|(?:[\w' -]+[,;]\s*){4,}"
STAMP = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b\d\d:\d\d:\d\d\b"
CODE = (
    r"[{};]\s*$|^\s*(?:#!|//|--\s|import\s|from\s\S+\simport|export\s|def\s|fn\s|pub\s|let\s|const\s|class\s|for\s\w+\sin\s|SELECT\s|UPDATE\s|INSERT\s|return\b|if\s.*:$|\$\s|\./)"
    r"|\w\(.*\)\s*[:;{]?\s*$|\s[=!<>+*]?=\s|->|=>|::|&&|\|\|"
)
EDGE = ".,:;!?()[]{}\"'`«»<>“”„"
URL_MARK = r"https?://|www\.|\]\(|<a$"
NAME_MARK = r"[\d_/\\@=(){}<>.]|\p{Ll}\p{Lu}"
BREAK = "\u0001"
U, H, N, X = (np.int64(k) for k in (11, 12, 13, 14))  #: masks of links, tags, numbers and names


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in one row: document, masked hash, literal hash, whether it is a plain word, and the unit it stands in."""
    split = [t.replace("\n", f" {BREAK} ").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
    code, known = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    bare = pc.utf8_lower(pc.utf8_trim(known, EDGE))
    yes = lambda a, pattern: pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)
    literal = pd.util.hash_array(bare.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)
    kind = literal.copy()
    inner = pc.utf8_trim(known, EDGE)
    name, number = yes(inner, NAME_MARK), yes(inner, r"^[\d.,+-]+%?$")
    kind[name] = X
    kind[number] = N
    kind[yes(known, r"^#[A-Za-z]")] = H
    kind[yes(known, URL_MARK)] = U
    plain = (kind == literal) & yes(bare, r"\p{L}")
    empty = pc.equal(pc.utf8_length(bare), 0).to_numpy(zero_copy_only=False)
    stop = yes(known, r"[.?!:][\"')\]»”]*$") & (kind != U)
    line = pc.equal(known, BREAK).to_numpy(zero_copy_only=False)
    ends = (stop | line)[code]
    doc = np.repeat(np.arange(len(split)), sizes)
    unit = np.cumsum(np.concatenate([[0], (ends[:-1] | (doc[1:] != doc[:-1])).astype(np.int64)])) if len(doc) else np.zeros(0, np.int64)
    keep = ~(empty | line)[code]
    return doc[keep], kind[code][keep], literal[code][keep], plain[code][keep], unit[keep]


def _rolled(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five at every place that has four more after it."""
    run = np.zeros(max(0, len(h) - WORDS_IN_PHRASE + 1), np.uint64)
    for k in range(WORDS_IN_PHRASE):
        run = (run ^ h[k : k + len(run)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(31)
    return run.view(np.int64)


def _phrases(doc: np.ndarray, kind: np.ndarray, plain: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, phrase, words it stands for, uses) of the phrases with at least two plain words."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.append(begin, len(unit)))
    n = np.maximum(1, size - WORDS_IN_PHRASE + 1)  # phrases of each unit
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(np.repeat(size, n), WORDS_IN_PHRASE)
    padded = np.concatenate([kind, np.zeros(WORDS_IN_PHRASE, np.int64)])
    words = np.concatenate([[0], np.cumsum(plain)])
    # a short unit is hashed with what follows blanked
    phrase = _rolled(padded)[at]
    short = np.flatnonzero(length < WORDS_IN_PHRASE)
    if len(short):
        cols = padded[at[short][:, None] + np.arange(WORDS_IN_PHRASE)]
        cols[np.arange(WORDS_IN_PHRASE) >= length[short][:, None]] = 0
        phrase[short] = _rolled(cols.ravel())[:: WORDS_IN_PHRASE][: len(short)]
    ok = words[at + length] - words[at] >= 2
    d, p, w = doc[at][ok], phrase[ok], np.repeat(size / n, n)[ok]
    o = np.lexsort((p, d))
    d, p, w = d[o], p[o], w[o]
    if not len(d):
        return (np.zeros(0, np.int64),) * 4
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])]))
    uses = np.diff(np.append(first, len(d)))
    return d[first], p[first], np.add.reduceat(w, first), uses


def _share(doc: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(doc, value, minlength=size)


def _lines(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of characters in list lines, and in code and log lines."""
    parts = pc.split_pattern(texts, "\n")
    line = parts.flatten()
    doc = np.repeat(np.arange(size), np.diff(parts.offsets.to_numpy()))
    n = pc.utf8_length(pc.utf8_trim_whitespace(line)).to_numpy(zero_copy_only=False).astype(float)
    hit = lambda p: pc.match_substring_regex(line, p).to_numpy(zero_copy_only=False)
    total = np.maximum(1, _share(doc, n, size))
    return _share(doc, n * hit(LINK_OR_LIST), size) / total, _share(doc, n * (hit(CODE) | hit(STAMP)), size) / total


MEASURES = "doc_id long, slot int, n_words int, listed double, natural double, repeats double, stuffed double, tokens int, phrases array<long>, weights array<float>, uses array<int>"


def measured(documents: DataFrame) -> DataFrame:
    """What a document tells by itself, and its phrases with the words each stands for and its uses."""
    one = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    one = one.groupBy("doc_id").agg(F.min(F.struct("text", F.coalesce("source", F.concat(F.lit("doc:"), F.col("doc_id"))).alias("host"))).alias("d"))
    parts = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cores(one.sparkSession))
    one = one.select("doc_id", F.pmod(F.xxhash64("d.host"), F.lit(HOST_BITS)).cast("int").alias("slot"), F.col("d.text").alias("text")).repartition(parts, "doc_id")
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", PIECE):
            size = b.num_rows
            if not size:
                continue
            listed, natural = _lines(b.column("text"), size)
            doc, kind, literal, plain, unit = _tokens(b.column("text").to_pylist())
            n = np.bincount(doc, minlength=size)
            pair = np.unique(np.stack([doc, literal], 1), axis=0)[:, 0] if len(doc) else doc
            repeats = 1 - np.bincount(pair, minlength=size) / np.maximum(n, 1)
            run = _rolled(literal)
            inside = doc[: len(run)] == doc[WORDS_IN_PHRASE - 1 :][: len(run)]
            d, r = doc[: len(run)][inside], run[inside]
            o = np.lexsort((r, d))
            d, r = d[o], r[o]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])) if len(d) else d
            uses = np.diff(np.append(first, len(d)))
            stuffed = _share(d[first], uses * (uses >= AGAIN), size) / np.maximum(1, np.bincount(d, minlength=size))
            pd_, p, w, u = _phrases(doc, kind, plain, unit)
            at = pa.array(np.searchsorted(pd_, np.arange(size + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (p, w.astype(np.float32), u.astype(np.int32))]
            cols = [b.column("doc_id"), b.column("slot"), pa.array(pc.count_substring_regex(b.column("text"), r"[\p{L}\p{N}]+").to_numpy(zero_copy_only=False).astype(np.int32))]
            cols += [pa.array(x) for x in (listed, natural, repeats, stuffed)] + [pa.array(n.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return one.mapInArrow(measure, MEASURES)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, listed, natural, repeats, stuffed, shared, prose, spam) of every document."""
    m = written(measured(documents), "spam-measures")
    at = m.select("doc_id", "slot", F.explode(F.arrays_zip("phrases", "weights", "uses")).alias("x")).select("doc_id", "slot", F.col("x.phrases").alias("phrase"), F.col("x.weights").alias("weight"), F.col("x.uses").alias("uses"))
    hosts = at.groupBy("phrase").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("map")).where(F.bit_count("map") >= HOSTS).select("phrase")
    shared = at.join(hosts, "phrase", "left_semi").groupBy("doc_id").agg(F.sum("weight").alias("shared"), F.sum(F.when(F.col("uses") < AGAIN, F.col("weight"))).alias("prose"))
    share = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) / F.greatest("tokens", F.lit(1))).alias(c)
    out = m.drop("phrases", "weights", "uses").join(shared, "doc_id", "left")
    out = out.select("doc_id", "n_words", "listed", "natural", "repeats", "stuffed", share("shared"), share("prose"))
    c = F.col
    lists = (c("listed") >= LISTED) & (c("listed") - c("prose") >= OUTWEIGHS)
    keywords = (c("repeats") >= REPEATS) & (c("shared") < HARDLY)
    stuffed = (c("stuffed") >= STUFFED) & (c("repeats") >= FEW)
    return out.withColumn("spam", (c("n_words") >= LEAST) & (c("natural") < NATURAL) & (lists | keywords | stuffed))


def flagged(documents: DataFrame) -> DataFrame:
    return scored(documents).where("spam").select("doc_id")

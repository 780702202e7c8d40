"""Groups of records whose word sets are nearly the same: an exact set-similarity join by vertical partitioning.

The words of all records are put into one global order, rare ones first, and that order is cut by pivots into FRAGMENTS
of about equal mass, so every record falls into segments, one in each fragment that holds some of its words.

* A pair of similar records must share a word near the front of both records. Each fragment is searched for pairs by
  the front words that it holds, and a pair is attributed to the fragment of its first common word.
* Segments of the sets in such pairs are moved once per fragment. In every fragment from there on the two segments of a pair are intersected on
  their own, and the partial overlaps are summed per pair; earlier fragments hold no common word.

What keeps it linear in rows and bounded in every task:

* records with equal word sets form one class, and only classes are joined (copies are never paired);
* the order comes from a count sketch whose number of counters follows the number of records (up to MOST_BITS), so no
  vocabulary is joined or broadcast; words that only one record has join nothing and are in no segment;
* of two records of n and m words at most D = n + m - 2*ceil(t/(1+t)*(n+m)) words may differ. Their first common
  word, at places i and j, therefore has i + j <= D. Postings are sorted by i - n*(1-t)/(1+t), which turns this
  into a range, so only pairs inside the range are ever looked at;
* a 128-bit parity signature bounds the number of differing words from below and drops nearly all other pairs;
* the postings of a frequent word are cut into blocks and the block pairs are spread over tasks;
* where pairs of records are listed, the members of large classes are cut into parts of PART.

Defined results: null and blank texts, and texts without any letter or digit, are left out; several rows of one id
count as one record (the one whose set has the smallest hash); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.marks import among, dense, marked
from anamnesis.plans.batches import bounded
from anamnesis.plans.scratch import cores, shuffles_dropped, written

LEAST_BITS, MOST_BITS = 16, 25  #: counters of the sketch; a byte each, so at most 32 MB are sent to every task
STEPS = 4  #: levels of a counter for each doubling
BLOCK = 4096  #: postings of one word in one block of a block pair
PIECE = 1_000_000  #: words handled at once
PAIRS = 65_536  #: places of postings compared at once; their columns stay in the cache
FRAGMENTS = 4  #: pieces of the global order
PART = 4096  #: members of a class that are listed against others in one go


def words(text: Column) -> Column:
    """Distinct maximal runs of letters or digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


@dataclass
class Order:
    """The global order of words: by level of their counter, then by hash."""

    level: np.ndarray  #: per counter: 0 for words of one record, else a bound of the count as a level
    pivots: np.ndarray  #: ranks at which fragments begin
    copy: Broadcast | None = None

    def sent(self, spark: SparkSession) -> Broadcast:
        """The order on all executors: one copy of it, however many steps ask."""
        if self.copy is None:
            self.copy = spark.sparkContext.broadcast(Order(self.level, self.pivots))
        return self.copy

    def rank(self, h: np.ndarray) -> np.ndarray:
        return self.level[h & (len(self.level) - 1)] + (h.view(np.uint64) >> np.uint64(11)) / 2.0**53

    def fragment(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pivots, rank, side="right")


def classes(records: DataFrame, fragments: int = FRAGMENTS, field: str = "field_name", key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame, Order]:
    """Membership (field, id, class_id), the word sets (class_id, hashes), and the order of words.

    Words are 64-bit hashes of field and word from here on, and class_id is a hash of the set, so sets of different
    fields have no word in common. Sets of copies repeat here; whatever is made of them names each class once a batch
    before it is shuffled, and once in all after that.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(records.count(), 1) * 32))))
    r = records.select(F.col(field).alias("field"), F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    r = r.select("field", "id", F.sort_array(F.transform(words(F.col("text")), lambda w: F.xxhash64("field", w))).alias("hashes"))
    r = r.select("field", "id", F.xxhash64("hashes").alias("class_id"), "hashes")
    names = ["field", "id", "class_id", "slot", "n"]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The membership of each row, and how many rows of a batch use each counter."""
        for b in bounded(batches, "hashes", PIECE):
            at, n = np.unique(b.column("hashes").flatten().to_numpy(zero_copy_only=False) & ((1 << bits) - 1), return_counts=True)
            void = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("id"), b.column("class_id"), void(b.num_rows, pa.int32()), void(b.num_rows, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([void(len(at), pa.string()), void(len(at), pa.string()), void(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(n)], names=names)

    tallied = written(r.mapInArrow(tally, "field string, id string, class_id long, slot int, n long"), "neardup-tally")
    members = tallied.where("id is not null").groupBy("field", "id").agg(F.min("class_id").alias("class_id"))
    counted = tallied.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    with shuffles_dropped(records.sparkSession):
        level = dense(counted.select("slot", F.ceil(F.log2("n") * STEPS - 1e-9).cast("tinyint").alias("level")), 1 << bits, np.int8)
    mass = sum(np.bincount(x, minlength=128) for x in np.split(level, 64)) * 2.0 ** (np.arange(128) / STEPS)
    mass[0] = 0
    total = np.cumsum(mass)
    cuts = total[-1] * np.arange(1, fragments) / fragments
    at = np.searchsorted(total, cuts)
    pivots = at + (cuts - (total[at] - mass[at])) / np.maximum(mass[at], 1) if total[-1] else np.zeros(0)
    return members, r.select("class_id", "hashes"), Order(level, np.sort(np.asarray(pivots, float)))


def _sorted_words(b: pa.RecordBatch, words_: Order) -> tuple[np.ndarray, ...]:
    """Classes of a batch, each once, with their sizes; their words in global order with owner and rank."""
    ids, row = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
    lists = b.column(1).take(pa.array(row))
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    h, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
    rank = words_.rank(h)
    o = np.lexsort((h, rank, owner))
    return ids, n, h[o], owner[o], rank[o]


POSTING = ["key", "class_id", "meta", "s0", "s1"]
SIZE, PLACE, PIECE_OF, SIDE = 40, 16, 2, 1  #: bits of meta at which a set's size, a word's place, its fragment and the set's block begin; bit 0: two blocks


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two numbers."""
    z = (x.view(np.uint64) ^ (y.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


def _postings(sets: DataFrame, words_: Order, t: float) -> DataFrame:
    """A row for each word near a set's front: the word (and block pair) as key, the class, meta and the signature."""
    shared = words_.sent(sets.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_ = shared.value
        for b in bounded(batches, 1, PIECE):
            if not b.num_rows:
                continue
            ids, n, h, owner, rank = _sorted_words(b, w_)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.arange(len(h)) - start[owner]
            bit = (h >> 40) & 127
            sig = np.zeros((len(n), 2), np.uint64)
            for half in (0, 1):
                inside = (bit >> 6) == half
                np.bitwise_xor.at(sig[:, half], owner[inside], np.uint64(1) << (bit[inside] & 63).astype(np.uint64))
            # the smallest partner has ceil(t*n) words, all of them shared; a word of one record joins nothing
            keep = (place <= n[owner] - np.ceil(t * n - 1e-9).astype(np.int64)[owner]) & (rank >= 1)
            at, w, r = owner[keep], h[keep], rank[keep]
            blocks = np.maximum(1, np.ceil(2.0 ** (np.floor(r) / STEPS) / BLOCK)).astype(np.int64)
            mine = ((ids[at].view(np.uint64) >> np.uint64(20)) % blocks.astype(np.uint64)).astype(np.int64)
            # block pairs (mine, other), the smaller first; side tells in which of the two blocks a set lies
            row = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            x, y = np.minimum(mine[row], other), np.maximum(mine[row], other)
            a = at[row]
            meta = (n[a] << SIZE) | (place[keep][row] << PLACE) | (w_.fragment(r)[row] << PIECE_OF) | ((mine[row] == y) << SIDE) | (x != y)
            key = np.where(blocks[row] > 1, _mixed(w[row], (x << 32) | y), w[row])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, ids[a], meta, sig[a, 0].view(np.int64), sig[a, 1].view(np.int64))], names=POSTING)

    return sets.mapInArrow(post, "key long, class_id long, meta long, s0 long, s1 long")


def _near(a: dict[str, np.ndarray], t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(smaller id, larger id, their sizes together, fragment) of pairs in postings of whole keys that may be similar, all keys at once."""
    o = np.lexsort((a["class_id"], a["key"]))
    key, ids = a["key"][o], a["class_id"][o]
    once = o[np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])]
    key = a["key"][once]
    g = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    several = np.bincount(g)[g] > 1
    once, g = once[several], g[several]
    if not len(g):
        return
    meta = a["meta"][once]
    n, place = meta >> SIZE, (meta >> PLACE) & 0xFFFFFF
    x = place - (1 - t) / (1 + t) * n
    o = np.lexsort((x, g))
    once, g, x, meta = once[o], g[o], x[o], meta[o]
    n, place, side = n[o].astype(np.int32), place[o].astype(np.int32), ((meta >> SIDE) & 1).astype(np.int8)
    frag, two = ((meta >> PIECE_OF) & 0xFF).astype(np.int32), (meta & 1).astype(bool)
    s0, s1, ids = a["s0"][once].view(np.uint64), a["s1"][once].view(np.uint64), a["class_id"][once]
    wide = 4 * float(np.abs(x).max() + 1)  # keeps keys apart on one line
    first = np.searchsorted(g, g, side="left")
    # partners: places before oneself in the order, up to the range's end
    upto = np.minimum(np.searchsorted(g * wide + x, g * wide - x + 1e-6, side="right"), np.arange(len(x))) - first
    upto = np.maximum(upto, 0)
    ends = np.cumsum(upto)
    share = t / (1 + t)
    k, size = 0, len(x)
    while k < size:
        e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
        u = upto[k:e]
        total = int(u.sum())
        if total:
            i = np.repeat(np.arange(k, e, dtype=np.int32), u)
            j = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(u) - u - first[k:e]).astype(np.int32), u)
            ni, nj = n[i], n[j]
            ok = np.flatnonzero(t * np.maximum(ni, nj) <= np.minimum(ni, nj) + 1e-9)
            i, j = i[ok], j[ok]
            both = ni[ok] + nj[ok]
            most = both - 2 * np.ceil(share * both - 1e-9).astype(np.int32)
            ok = np.flatnonzero((np.bitwise_count(s0[i] ^ s0[j]).astype(np.int32) + np.bitwise_count(s1[i] ^ s1[j]) <= most) & (place[i] + place[j] <= most) & (~two[i] | (side[i] != side[j])))
            if len(ok):
                i, j = i[ok], j[ok]
                yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), both[ok], frag[i]
        k = e


def candidates(sets: DataFrame, words_: Order, t: float) -> DataFrame:
    """Pairs of classes (a, b, both: their sizes together, first: fragment of their first common word) that may reach similarity t; none that does is missing."""

    def groups(tab: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = list(_near(tab, t))
        if found:
            x, y, both, f = (np.concatenate(c) for c in zip(*found))
            o = np.lexsort((f, y, x))
            o = o[np.concatenate([[True], (np.diff(x[o]) != 0) | (np.diff(y[o]) != 0)])]
            yield pa.RecordBatch.from_arrays([pa.array(c[o]) for c in (x, y, both, f)], names=["a", "b", "both", "first"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in POSTING}
        for b in batches:
            held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in POSTING})
            size += b.num_rows
            if size < 60_000:
                continue
            tab = whole()
            same = tab["key"] == tab["key"][-1]
            cut = size - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on in the next batch
            if cut:
                yield from groups({c: v[:cut] for c, v in tab.items()})
            held, size = [{c: v[cut:] for c, v in tab.items()}], size - cut
        if held:
            yield from groups(whole())

    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), cores(sets.sparkSession) * 4)
    p = _postings(sets, words_, t).repartition(parts, "key").sortWithinPartitions("key")
    return p.mapInArrow(join, "a long, b long, both int, first int").groupBy("a", "b").agg(F.min("first").alias("first"), F.first("both").alias("both"))


def segments(sets: DataFrame, words_: Order, marks: np.ndarray | None = None) -> DataFrame:
    """(key, words): each set cut by fragments, without the words that no other set has; key names class and fragment.

    Of classes that are not marked most are left out.
    """
    shared = words_.sent(sets.sparkSession)
    asked = sets.sparkSession.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_ = shared.value
        for b in bounded(batches, 1, PIECE):
            if not b.num_rows:
                continue
            if asked.value is not None:
                b = b.filter(pa.array(among(asked.value, b.column(0).to_numpy(zero_copy_only=False))))
                if not b.num_rows:
                    continue
            ids, _, h, owner, rank = _sorted_words(b, w_)
            keep = rank >= 1
            h, owner, f = h[keep], owner[keep], w_.fragment(rank[keep])
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(f) != 0)]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)).astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[start]]), pa.array(f[start].astype(np.int32)), lists], names=["class_id", "fragment", "words"])

    return sets.mapInArrow(cut, "class_id long, fragment int, words array<long>").select(F.xxhash64("class_id", "fragment").alias("key"), "words")


def similar_classes(sets: DataFrame, words_: Order, t: float = 0.7) -> DataFrame:
    """Pairs of classes (a, b, similarity) with intersection / union >= t, a < b."""
    with shuffles_dropped(sets.sparkSession):
        pairs = written(candidates(sets, words_, t), "neardup-pairs")
        marks = marked(pairs.select(F.explode(F.array("a", "b"))), len(words_.level).bit_length() - 1)
    cut = segments(sets, words_, marks).groupBy("key").agg(F.first("words").alias("words"))
    # one row for each pair and fragment that may hold common words
    asked = pairs.withColumn("fragment", F.explode(F.sequence("first", F.lit(len(words_.pivots)))))
    asked = asked.select("a", "b", "both", F.xxhash64("a", "fragment").alias("ka"), F.xxhash64("b", "fragment").alias("kb"))
    side = lambda s: cut.select(F.col("key").alias(f"k{s}"), F.col("words").alias(f"w{s}"))
    part = asked.join(side("a"), "ka").join(side("b"), "kb").select("a", "b", "both", F.size(F.array_intersect("wa", "wb")).alias("common"))
    total = part.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("both").alias("both"))
    return total.select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def _listed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the part of their class they are in, and the number of parts of the classes that have several."""
    large = members.groupBy("class_id").count().where(F.col("count") > PART).select("class_id", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    m = members.join(large, "class_id", "left")
    return m.select("field", "id", "class_id", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), "parts")).otherwise(0).cast("int").alias("part")), large


def similar_records(records: DataFrame, t: float = 0.7) -> DataFrame:
    """All pairs of records (field_name, id_a, id_b), id_a < id_b, with similarity >= t, members of equal sets included."""
    members, sets, words_ = classes(records)
    members, large = _listed(members)
    links = similar_classes(sets, words_, t).select("a", "b")
    several = members.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    out = links.unionByName(several)
    for s in ("a", "b"):  # every part of a class meets every part of the other one
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        out = out.join(large.withColumnRenamed("class_id", s), s, "left").select(*(c for c in out.columns), parts.alias("part"))
        who = members.select(F.col("class_id").alias(s), "part", F.col("id").alias(f"id_{s}"), *(["field"] if s == "a" else []))
        out = out.join(who, [s, "part"]).drop("part")
    x, y = F.col("id_a"), F.col("id_b")
    out = out.where((F.col("a") != F.col("b")) | (x < y))
    return out.select(F.col("field").alias("field_name"), F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))


def groups(records: DataFrame, t: float = 0.7) -> DataFrame:
    """One row per record: (field_name, id, class_id, links); a class is named by its smallest id, and links counts the other word sets similar to its own."""
    members, sets, words_ = classes(records)
    links = similar_classes(sets, words_, t)
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id")))
    n = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    named = members.groupBy("class_id").agg(F.min("id").alias("name")).join(n, "class_id", "left")
    return members.join(named, "class_id").select(F.col("field").alias("field_name"), "id", F.col("name").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))

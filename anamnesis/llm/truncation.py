"""Texts that lost their end on the way in: hidden storage limits, marks of cutting, and endings that break off.

Lengths of every value are taken in several notations (characters, UTF-8 bytes, UTF-16 units, with HTML entities, as
JSON, with CRLF line ends, and bytes of these). Per source, field and notation they are counted, and a limit shows as
the largest length, reached by many times more values than the lengths below it; a limit that cuts back to the last
blank shows as a crowd just below the largest length. The lengths are taken without a mark of cutting ("…", "[+40
chars]"), since limits hold for what stands before it.

Endings are then inspected. A value at a limit is cut unless it ends as finished texts do. A mark that counts what is
missing is proof; an ellipsis is one only at a limit. Away from limits a value is cut if it ends inside a code fence or
a character, inside a word (a last word that never occurs whole and begins longer ones), or in words after which the corpus always goes on:
runs of two and three words and pairs of words before two others, names and numbers masked, are counted over all values as going on, as ending a sentence,
and as ending a value, and an ending that many values share is a way to end.

Defined results: null and blank values are whole; several rows of one record are judged each, and the record's field is
reported once if any was cut; values without source form a source of their own; empty tables have no cut values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.marks import among, marked
from anamnesis.plans.batches import bounded
from anamnesis.plans.scratch import cores, written

CROWD, TIMES = 8, 5.0  #: values at a limit at least, and times the mean of the lengths below
TASK = 64 << 20  #: bytes of text that one task counts runs in, where that gives more tasks than cores
MARKS = 25  #: bits of the map of asked runs, as a power of two
PIECE = 1_000_000  #: bytes of text whose runs of words are counted at once
SOFT = 25  #: a limit that cuts back to a blank crowds this many lengths below it

# Marks that replace a lost end. The first group tells how much is missing and is proof of its own.
COUNTED_MARK = r"\s*(?:…|\.\.\.)?\s*[\[(<{]\s*(?:\+\s*\d+|\d+\s+(?:more|omitted|chars?|characters?|bytes?|truncated)|(?:output |text |content )?(?:truncated|cut|omitted|clipped)|\.\.\.)[^\])>}\n]{0,40}[\])>}]\s*$"
ELLIPSIS = r"\s*(?:…|\.\.\.)\s*$"
FINISHED = re.compile(r"(?:[.?!:;。！？]['\")\]»”]*|[)\]}>`\"'|✅✔]|[^\w\s�.,&(\[{<‘“«/\\$#@%*+=~^-])$")
SENTENCE_END = re.compile(r"[.?!:;。！？]+[\"')\]»”]*$")
TRIM = ".?!:;,)\"'(]["
NUMBER = re.compile(r"[+-]?\d+(?:[.,]\d+)*%?$")
NAME = re.compile(r"\d|_|[a-z][A-Z]|[^\w'’-]")
PART = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])")

LENGTHS = ("chars", "utf8", "utf16", "html", "html_utf8", "json", "json_utf8", "crlf", "crlf_utf8")


def lengths(c: Column) -> dict[str, Column]:
    """Length of a text in each notation."""
    n, b = F.length(c), F.octet_length(c)
    several = lambda chars: n - F.length(F.translate(c, chars, ""))
    lone = several("\n") - (n - F.length(F.replace(c, F.lit("\r\n"), F.lit("\n"))))
    html = 4 * several("&") + 3 * several("<>") + 5 * several("\"'")
    json = several('"\\\n\r\t')
    return {
        "chars": n,
        "utf8": b,
        "utf16": (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"),
        "html": n + html,
        "html_utf8": b + html,
        "json": n + json,
        "json_utf8": b + json,
        "crlf": n + lone,
        "crlf_utf8": b + lone,
    }


def mask(word: str) -> str:
    """A word as the counts see it: numbers, paths and names lose their letters."""
    if NUMBER.match(word):
        return "0"
    if "/" in word:
        return "/." if re.search(r"\.\w{1,5}$", word) else "/"
    return "X" if NAME.search(word) else word.lower()


def _hash(items: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(items, object), categorize=False).view(np.int64) if items else np.zeros(0, np.int64)


GO, STOP, LAST, WHOLE = range(4)  #: a run of words that goes on, that ends a sentence, that ends a value; a whole word


def _runs(text: str) -> Iterator[tuple[str, int]]:
    lines = [x for x in text.split("\n") if x.strip()]
    for k, line in enumerate(lines):
        z = a = b = "^"
        words = line.split()
        for i, w in enumerate(words):
            stop, last = bool(SENTENCE_END.search(w)), i == len(words) - 1
            core = w.strip(TRIM)
            m = mask(core)
            kind = STOP if stop else GO if not last else LAST if k == len(lines) - 1 else STOP
            yield f"{a} {b} {m}", kind
            yield f"{b} {m}", kind
            yield f"{z} {a} * *", kind
            if not last or stop:
                yield f"w {core.lower() if m != 'X' else (PART.findall(core) or [''])[-1].lower()}", WHOLE
            z, a, b = ("^", "^", "^") if stop else (a, b, m)


def ending(text: str) -> tuple[int, str, str, str, str, str]:
    """How a text ends: 0 finished, 1 broken off for certain, 2 to be looked up; then its last runs, its last word, and the word as a beginning."""
    t = text.rstrip()
    if not t:
        return 0, "", "", "", "", ""
    if t[-1] == "�" or t.count("```") % 2 or 0xD800 <= ord(t[-1]) < 0xDC00:
        return 1, "", "", "", "", ""
    if FINISHED.search(t):
        return 0, "", "", "", "", ""
    z = a = b = "^"
    words = t.split("\n")[-1].split()
    for w in words[:-1]:
        z, a, b = ("^", "^", "^") if SENTENCE_END.search(w) else (a, b, mask(w.strip(TRIM)))
    core = words[-1].strip(TRIM)
    m = mask(core)
    whole = "" if m in ("0", "/.", "/") else core.lower() if m != "X" else "" if re.search(r"\d", core) else (PART.findall(core) or [""])[-1].lower()
    return 2, f"{a} {b} {m}", f"{b} {m}", f"{z} {a} * *", f"w {whole}" if whole else "", f"b {whole}" if whole else ""


def values(parts: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """(record_id, field_name, source, text) of the given (table, id column, text column, source)."""
    out = None
    for df, key, field, source in parts:
        one = df.select(F.col(key).alias("record_id"), F.lit(field).alias("field_name"), F.coalesce(source, F.lit("")).alias("source"), F.col(field).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("record_id").isNotNull() & F.col("text").rlike(r"\S"))


def _measured(v: DataFrame) -> DataFrame:
    counted = F.col("text").rlike(COUNTED_MARK)
    mark = F.when(counted, 2).when(F.col("text").rlike(ELLIPSIS), 1).otherwise(0)
    body = F.when(mark == 2, F.regexp_replace("text", COUNTED_MARK, "")).when(mark == 1, F.regexp_replace("text", ELLIPSIS, "")).otherwise(F.col("text"))
    v = v.withColumn("mark", mark).withColumn("body", body)
    return v.withColumn("n", F.array(*(x.cast("int") for x in lengths(F.col("body")).values())))


def limits(m: DataFrame) -> DataFrame:
    """(field_name, source, mark, notation, low, high): lengths in [low, high] are at a hidden limit of the source.

    Per source, field and kind of mark the notation counts in which most values crowd at the largest length; only where
    no notation shows such a limit, limits that cut back to a blank are looked for.
    """
    n = m.select("field_name", "source", "mark", F.posexplode("n").alias("notation", "length")).groupBy("field_name", "source", "mark", "notation", "length").count()
    by = ["field_name", "source", "mark", "notation"]
    # the largest length that is crowded; a few longer values (a broken last character) are let pass
    peak = n.where(F.col("count") >= CROWD).groupBy(*by).agg(F.max("length").alias("peak"))
    top = n.groupBy(*by).agg(F.max("length").alias("high")).join(peak, by, "left")
    below = n.join(top, by).withColumn("under", F.col("high") - F.col("length")).withColumn("to_peak", F.col("peak") - F.col("length"))
    within = lambda c, lo, hi: F.sum(F.when(F.col(c).between(lo, hi), F.col("count")).otherwise(0))
    s = below.groupBy(*by, "high", "peak").agg(
        within("to_peak", 0, 0).alias("crowd"),
        (within("to_peak", 1, 40) / 40).alias("mean"),
        within("to_peak", -(1 << 30), -1).alias("beyond"),
        within("under", 0, SOFT - 1).alias("soft"),
        (within("under", SOFT, 5 * SOFT - 1) / 4).alias("before"),
    )
    s = s.withColumn("hard", F.coalesce((F.col("crowd") >= TIMES * (F.col("mean") + 0.5)) & (F.col("beyond") <= 0.03 * F.col("crowd")) & (F.col("peak") > SOFT), F.lit(False)))
    best = s.groupBy(*by[:3]).agg(F.max(F.struct(F.col("hard"), F.when(F.col("hard"), F.col("crowd")).otherwise(F.col("soft")), (-F.col("notation")).alias("k"))).alias("best"))
    s = s.join(best, by[:3]).where((F.col("hard") == F.col("best.hard")) & (F.col("notation") == -F.col("best.k")))
    bytes_ = F.col("notation").isin([k for k, x in enumerate(LENGTHS) if "utf8" in x])
    soft = (F.col("soft") >= 2 * CROWD) & (F.col("soft") >= TIMES * (F.col("before") + 1)) & (F.col("high") > SOFT)
    low = F.when(F.col("hard"), F.col("peak") - F.when(bytes_, 3).otherwise(0)).otherwise(F.col("high") - SOFT + 1)
    return s.where(F.col("hard") | soft).select(*by, low.alias("low"), "high")


def judged(v: DataFrame) -> DataFrame:
    """(record_id, field_name, source, reason): reason is null for whole values, else limit, mark or ending."""
    measured = written(_measured(v), "truncation-values")
    kinds = limits(measured).groupBy("field_name", "source", "mark").agg(F.collect_set(F.struct("notation", "low", "high")).alias("limits"))
    m = measured.join(kinds, ["field_name", "source", "mark"], "left")
    m = m.withColumn("at_limit", F.coalesce(F.exists("limits", lambda x: F.element_at(F.col("n"), x["notation"] + 1).between(x["low"], x["high"])), F.lit(False)))
    m = m.select("record_id", "field_name", "source", "mark", "at_limit", "body")

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [ending(t) for t in b.column("body").to_pylist()]
            cols = [pa.array([x[0] for x in e], pa.int32())] + [pa.array(_hash([x[k] for x in e])) for k in (1, 2, 3, 4, 5)] + [pa.array([bool(x[4]) for x in e])]
            keep = ["record_id", "field_name", "source", "mark", "at_limit"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[*keep, "state", "run3", "run2", "frame", "word", "head", "has_word"])

    e = m.mapInArrow(inspect, "record_id string, field_name string, source string, mark int, at_limit boolean, state int, run3 long, run2 long, frame long, word long, head long, has_word boolean")
    e = written(e, "truncation-endings")
    open_ = e.where("state = 2 and mark = 0 and not at_limit")
    asked = open_.select(F.explode(F.array("run3", "run2", "frame", "word", "head")).alias("run"))
    wanted = v.sparkSession.sparkContext.broadcast(marked(asked, MARKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 0, PIECE):
            keys, kinds_ = [], []
            for t in b.column(0).to_pylist():
                for key, kind in _runs(t):
                    keys.append(key)
                    kinds_.append(kind)
            if not keys:
                continue
            code, uniq = pd.factorize(np.array(keys, object))
            n = np.bincount(code * 4 + np.array(kinds_), minlength=len(uniq) * 4).reshape(-1, 4)
            heads = Counter(f"b {u[2 : 2 + k]}" for u, c in zip(uniq, n[:, WHOLE]) if c for k in range(1, min(len(u) - 2, 24)))
            uniq = [*uniq, *heads]
            n = np.concatenate([n, np.outer(np.array(list(heads.values()), np.int64), np.eye(4, dtype=np.int64)[WHOLE])])
            runs = _hash(uniq)
            keep = among(wanted.value, runs)  # no ending asks for the others
            yield pa.RecordBatch.from_arrays([pa.array(runs[keep])] + [pa.array(n[keep, k].astype(np.int64)) for k in range(4)], names=["run", "go", "stop", "last", "whole"])

    # values at a limit say nothing about how texts end
    size = measured.agg(F.sum(F.element_at("n", 1 + LENGTHS.index("utf8")))).first()[0] or 0
    parts = max(2 * cores(v.sparkSession), size // TASK)
    tall = m.where("not at_limit and mark = 0").select("body").repartition(parts).mapInArrow(count, "run long, go long, stop long, last long, whole long")
    known = tall.groupBy("run").agg(*(F.sum(c).alias(c) for c in ("go", "stop", "last", "whole"))).join(asked.distinct(), "run", "left_semi")
    known = written(known, "truncation-runs")
    side = lambda c, *cols: known.select(F.col("run").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in cols))
    o = open_.join(side("run3", "go", "stop", "last"), "run3", "left").join(side("run2", "go", "stop", "last"), "run2", "left").join(side("frame", "go", "stop", "last"), "frame", "left").join(side("word", "whole"), "word", "left").join(side("head", "whole"), "head", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    common = (z("run3_last") > 3 + 0.02 * z("run3_go")) | (z("frame_last") > 3 + 0.1 * z("frame_go"))
    stops = z("run3_stop") + z("run2_stop") * F.when(z("run3_stop") + z("run3_go") < 3, 1).otherwise(0)
    goes = z("run3_go") + z("run2_go") * F.when(z("run3_stop") + z("run3_go") < 3, 1).otherwise(0)
    usual = ((stops >= 1) & (stops >= 0.1 * goes)) | ((z("frame_stop") >= 3) & (z("frame_stop") >= 0.3 * z("frame_go")))
    inside = F.col("has_word") & (z("word_whole") == 0) & (z("head_whole") > 0) & (z("run3_last") <= 2)
    breaks = (~(common | usual) & (((stops == 0) & (goes >= 3)) | ((stops > 0) & (stops < 0.1 * goes)))) | (inside & ~common)
    broken = o.where(breaks).select("record_id", "field_name", F.lit(True).alias("broken")).distinct()
    e = e.join(broken, ["record_id", "field_name"], "left")
    reason = (
        F.when(F.col("mark") == 2, "mark")
        .when(F.col("at_limit") & ((F.col("mark") == 1) | (F.col("state") > 0)), "limit")
        .when((F.col("mark") == 0) & ((F.col("state") == 1) | F.col("broken")), "ending")
        .when((F.col("mark") == 1) & (F.col("state") == 1), "ending")
    )
    return e.select("record_id", "field_name", "source", reason.alias("reason"))


def cut(v: DataFrame) -> DataFrame:
    return judged(v).where("reason is not null").select("record_id", "field_name").distinct()


def by_source(v: DataFrame) -> DataFrame:
    """Per source and field: values, cut values by reason, and their share."""
    one = judged(v).groupBy("record_id", "field_name", "source").agg(F.max("reason").alias("reason"))
    n = lambda r: F.count_if(F.col("reason") == r).alias(f"cut_by_{r}")
    out = one.groupBy("source", "field_name").agg(F.count("*").alias("n_values"), F.count("reason").alias("n_cut"), n("limit"), n("mark"), n("ending"))
    return out.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))

"""Conversations rebuilt from single message rows: order, speaker roles, reply links, and which ones are unusable.

Rows are deduplicated per (session, uuid), roles and times are read from their spellings, and the rows of each session
are numbered in time order over all partitions. For every row candidate parents are scored by elapsed time, mentions,
lexical overlap, role turn and tool ids; the likeliest becomes its parent, or the row starts a tree of its own.
Candidates are the WINDOW rows before it and, at any distance, the rows that used the tools it answers and the last row
before that names what it names (an index over all rows of the session).

Sessions are cut into pieces of CHUNK rows, and each piece is handed the WINDOW rows before it. A tree that goes on from
a handed or distant row hangs on it until roots and depths are resolved by pointer doubling over such hooks alone, so
the links depend neither on partitions nor on pieces, and no session is ever in one task.

Whether a session is usable follows from its trees: a user's message counts as answered if a visible assistant row
descends from it before the user speaks again. Sessions with a message that no tree answers, with tool nodes without
partner, rows without role or time, or another beginning than a user's message are the candidates; the rule on order is
then checked exactly for these sessions only. A message without any reply has no such descendant, so none is missed.

Defined results: rows without session or uuid are left out; of repeated rows the first received counts (ties: the
smallest); rows of equal time are ordered by uuid; a text is visible if it holds more than white space; sessions
without rows do not appear.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.plans.ordered import previous, stream
from anamnesis.plans.scratch import written

WINDOW = 16  #: rows before a row that are scored as parents whatever they hold
CHUNK = 4096  #: rows of a session that are linked in one go
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}
#: weights of the evidence for a reply link, and the score below which a row starts its own tree
TURN, GAP_HALF_S, MENTION, OVERLAP, TOOL, NEAREST, ROOT = 2.0, 600.0, 1.5, 3.0, 6.0, 0.25, 1.2

VISIBLE = r"[^\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"  #: a character that is no kind of blank

WORD = re.compile(r"[^\W_]+")
NAME = r"[A-Za-z]+_[A-Za-z_]+\d*|[A-Za-z]+[a-z][A-Z]\w*|@\w+|[\w.-]+/[\w./-]+"  #: what counts as a mention


def role(c: Column) -> Column:
    """user, assistant or system, or null for spellings that name no role."""
    r = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    out = F.lit(None).cast("string")
    for spelling, known in ROLES.items():
        out = F.when(r == spelling, known).otherwise(out)
    return out


def time(c: Column) -> Column:
    """Timestamp of a text in any of the notations: ISO with or without zone (UTC), digits as epoch milliseconds."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"^\d{4}-.*\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") & ~t.rlike(r"[+-]\d{2}:\d{2}$"), F.concat(t, F.lit("Z"))).otherwise(t)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned.try_cast("timestamp"))
    return F.when(t.rlike(r"^\d+$"), F.timestamp_millis(t.try_cast("bigint"))).otherwise(iso)


def messages(rows: DataFrame) -> DataFrame:
    """One row per (session_id, uuid): at, role, text (visible parts, newline-joined), names in it, tool_uses, tool_results."""
    body = F.struct("received_at", "batch_id", "ts", "message_role", "row_type", "message_content")
    one = rows.where("session_id is not null and uuid is not null").groupBy("session_id", "uuid").agg(F.min(body).alias("m")).select("session_id", "uuid", "m.*")
    blocks = F.coalesce(F.col("message_content"), F.array().cast("array<struct<block_type:string,text:string,tool_name:string,tool_input:string,tool_use_id:string,result_text:string,is_error:boolean>>"))
    of = lambda kind: F.filter(blocks, lambda b: b["block_type"] == kind)
    texts = F.filter(F.transform(of("text"), lambda b: b["text"]), lambda t: t.rlike(VISIBLE))
    return one.select(
        "session_id",
        "uuid",
        time(F.col("ts")).alias("at"),
        role(F.col("message_role")).alias("role"),
        F.array_join(texts, "\n").alias("text"),
        F.array_distinct(F.regexp_extract_all(F.array_join(texts, "\n"), F.lit(f"({NAME})"), F.lit(1))).alias("names"),
        F.transform(of("tool_use"), lambda b: b["tool_use_id"]).alias("tool_uses"),
        F.transform(of("tool_result"), lambda b: b["tool_use_id"]).alias("tool_results"),
    )


MESSAGE = "session_id string, uuid string, at timestamp, role string, text string, names array<string>, tool_uses array<string>, tool_results array<string>"
COLUMNS = [x.split()[0] for x in MESSAGE.split(", ")]
LINK = (
    "session_id string, chunk long, uuid string, place long, at timestamp, role string, parent string, root string, depth int, score double, "
    "hangs boolean, prompt boolean, counts boolean, answers string"
)
FOLD = "session_id string, block int, started boolean, head int, opens boolean, broken boolean"


class Piece:
    """The rows before the present one in a piece of a session, and what is known of their trees."""

    __slots__ = ("window", "trees", "last_prompt")

    def __init__(self) -> None:
        self.window: deque = deque(maxlen=WINDOW)  # uuid, at, role, words, names, uses
        self.trees: dict[str, tuple] = {}  # uuid: root, depth, hangs, prompt its branch stands under
        self.last_prompt: str | None = None  # the last user's message before

    def parent(self, at: int | None, who: str | None, words: set, names: set, results: set, far: list[tuple]) -> tuple[str | None, float]:
        """The likeliest parent of a row and its score."""
        best, found, n = ROOT, None, len(self.window)
        for k, (u, t, w, pw, pn, pu) in enumerate([*far, *self.window]):
            s = NEAREST * max(0, k + 1 - len(far)) / max(n, 1)
            if at is not None and t is not None:
                s += 1.0 / (1.0 + max(0.0, (at - t) / 1e6) / GAP_HALF_S)
            if who and w and who != w:
                s += TURN
            if words and pw:
                s += OVERLAP * len(words & pw) / len(words | pw)
            if names and pn and not names.isdisjoint(pn):
                s += MENTION
            if results and not results.isdisjoint(pu):
                s += TOOL
            if s >= best:
                best, found = s, u
        return found, best if found else 0.0

    def add(self, uuid: str, at: int | None, who: str | None, text: str, names: list[str], uses: list[str], results: list[str], far: list[tuple], context: bool) -> tuple:
        """(parent, root, depth, score, hangs, answers) of the next row."""
        words, named, tools = set(WORD.findall(text.lower())), set(names), set(uses)
        prompt = who == "user" and bool(text)
        if context:
            out = (None, uuid, 0, 0.0, True, None)
            under = uuid if prompt else None
        else:
            parent, score = self.parent(at, who, words, named, set(results), far)
            if parent is None:
                root, depth, hangs, under = uuid, 0, False, None
            else:
                root, depth, hangs, under = self.trees.get(parent, (parent, 0, True, None))
                depth += 1
            out = (parent, root, depth, score, hangs, under if who == "assistant" and text and under == self.last_prompt else None)
            under = uuid if prompt else under
        self.trees[uuid] = (*out[1:3], out[4], under)
        if prompt:
            self.last_prompt = uuid
        self.window.append((uuid, at, who, words, named, tools))
        return out


def _numbered(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their partition and their number inside their session's part of it."""
    last, n = None, 0
    for b in batches:
        number = np.empty(b.num_rows, np.int64)
        for k, name in enumerate(b.column("session_id").to_pylist()):
            n = n + 1 if name == last else 0
            last, number[k] = name, n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, block, np.int32)), pa.array(number)], names=[*b.schema.names, "block", "number"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows of each piece; hangs: root is a row outside of the piece, and depth counts from it."""
    names = [x.split()[0] for x in LINK.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    piece, s = None, Piece()
    for b in batches:
        rows: list[tuple] = []
        cols = [b.column(c).to_pylist() for c in ("session_id", "chunk", "place", "context", "uuid", "role", "text", "names", "tool_uses", "tool_results", "far")]
        for at, name, chunk, place, context, uuid, who, text, named, uses, results, far in zip(b.column("at").cast(pa.int64()).to_pylist(), *cols):
            if piece != (name, chunk):
                piece, s = (name, chunk), Piece()
            away = [(f["uuid"], f["at"], f["role"], set(WORD.findall(f["text"].lower())), set(f["names"]), set(f["tool_uses"])) for f in far or ()]
            parent, root, depth, score, hangs, answers = s.add(uuid, at, who, text, named, uses, results, away, context)
            if not context:
                rows.append((name, chunk, uuid, place, at, who, parent, root, depth, score, hangs, who == "user" and bool(text), who != "system" and bool(text or uses or results), answers))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def placed(rows: DataFrame) -> DataFrame:
    """The messages with their place in the whole session."""
    m = messages(rows).select(*COLUMNS)
    m = written(stream(m, ["session_id"], ["at", "uuid"], _numbered, MESSAGE + ", block int, number long", rows.count()), "conversation-rows")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = m.groupBy("session_id", "block").agg(F.count("*").alias("n")).select("session_id", "block", before.alias("before"))
    return m.join(parts, ["session_id", "block"]).withColumn("place", F.col("before") + F.col("number")).drop("block", "number", "before")


def distant(m: DataFrame) -> DataFrame:
    """(session_id, place, far): for rows that have such, the candidate parents further back than WINDOW rows."""
    ids = lambda c: m.select("session_id", F.explode(c).alias("id"), "place").where("id is not null")
    used = ids("tool_uses").withColumnRenamed("place", "before")
    tools = ids("tool_results").join(used, ["session_id", "id"]).select("session_id", "place", "before")
    named = previous(ids("names"), ["session_id", "id"], "place").select("session_id", "place", "before")
    at = tools.unionByName(named).where(F.col("before") < F.col("place") - WINDOW).distinct()
    rows = m.select("session_id", F.col("place").alias("before"), F.struct("uuid", F.unix_micros("at").alias("at"), "role", "text", "names", "tool_uses").alias("row"))
    return at.join(rows, ["session_id", "before"]).groupBy("session_id", "place").agg(F.sort_array(F.collect_list(F.struct("before", "row"))).alias("far")).select("session_id", "place", F.transform("far", lambda x: x["row"]).alias("far"))


def _resolved(links: DataFrame) -> DataFrame:
    """(session_id, root, true_root, above) of the rows that trees hang on, by pointer doubling."""
    asked = links.where("hangs").select("session_id", F.col("root").alias("uuid")).distinct()
    hooks = written(links.select("session_id", "uuid", "root", "depth", "hangs").join(asked, ["session_id", "uuid"], "left_semi"), "conversation-hooks")
    while hooks.where("hangs").limit(1).count():
        up = hooks.select("session_id", F.col("uuid").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("hangs").alias("on"))
        still = hooks.where("hangs").join(up, ["session_id", "root"]).select("session_id", "uuid", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("hangs"))
        hooks = written(hooks.where("not hangs").unionByName(still), "conversation-hooks")
    return hooks.select("session_id", F.col("uuid").alias("root"), F.col("root").alias("true_root"), F.col("depth").alias("above"))


def _pieces(m: DataFrame) -> DataFrame:
    """Every row's link inside its piece (LINK)."""
    chunk = F.floor(F.col("place") / CHUNK).cast("long")
    m = m.join(distant(m), ["session_id", "place"], "left")
    own = m.withColumn("chunk", chunk).withColumn("context", F.lit(False))
    handed = m.where(F.col("place") % CHUNK >= CHUNK - WINDOW).withColumn("chunk", chunk + 1).withColumn("context", F.lit(True))
    pieces = own.unionByName(handed).repartition("session_id", "chunk").sortWithinPartitions("session_id", "chunk", "place")
    return written(pieces.mapInArrow(_links, LINK), "conversation-links")


def linked(rows: DataFrame) -> DataFrame:
    """(session_id, uuid, place, at, role, parent, root, depth, score) for every row: the link trees.

    place counts in the whole session, and trees run through it whole.
    """
    links = _pieces(placed(rows))
    hanging = links.where("hangs").join(_resolved(links), ["session_id", "root"]).withColumn("root", F.col("true_root")).withColumn("depth", F.col("depth") + F.col("above"))
    names = ["session_id", "uuid", "place", "at", "role", "parent", "root", "depth", "score"]
    out = links.where("not hangs").select(names).unionByName(hanging.select(names))
    return out.withColumn("place", F.col("place").cast("int"))


def _fold(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule on order inside each session's part of a partition, summed up in one row."""
    rows: list[tuple] = []
    name, started, head, opens, broken = None, None, None, False, False
    for b in batches:
        for session, who, text, uses, results in zip(*(b.column(c).to_pylist() for c in ("session_id", "role", "text", "tool_uses", "tool_results"))):
            if session != name:
                if name is not None:
                    rows.append((name, block, started, head, opens, broken))
                name, started, head, opens, broken = session, None, None, False, False
            if who == "system" or not (text or uses or results):
                continue
            user = who == "user" and bool(text)
            started = user if started is None else started
            if user:
                head = head or 1
                broken, opens = broken or opens, True
            elif who == "assistant" and text:
                head, opens = head or 2, False
    if name is not None:
        rows.append((name, block, started, head, opens, broken))
    if rows:
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FOLD.split(", ")])


def _ordered_rule(m: DataFrame) -> DataFrame:
    """(session_id, bad_order): the exact rule on the order of the rows of the given sessions."""
    parts = stream(m, ["session_id"], ["place"], _fold, FOLD).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("block", "started", "head", "opens", "broken"))).alias("parts"))
    # parts: one entry per partition that holds some of the session
    zero = F.struct(F.lit(None).cast("boolean").alias("started"), F.lit(False).alias("open"), F.lit(False).alias("broken"))
    fold = F.aggregate(
        "parts",
        zero,
        lambda a, p: F.struct(
            F.coalesce(a["started"], p["started"]).alias("started"),
            F.when(p["head"].isNull(), a["open"]).otherwise(p["opens"]).alias("open"),
            (a["broken"] | p["broken"] | (a["open"] & F.coalesce(p["head"] == 1, F.lit(False)))).alias("broken"),
        ),
    )
    return parts.select("session_id", fold.alias("f")).select("session_id", (F.coalesce(~F.col("f.started"), F.lit(True)) | F.col("f.open") | F.col("f.broken")).alias("bad_order"))


def usability(rows: DataFrame) -> DataFrame:
    """Per session: bad_row (role or time unknown), bad_tools, bad_order, n_rows, usable."""
    m = placed(rows)
    links = _pieces(m)
    unlinked = links.where("prompt").join(links.where("answers is not null").select("session_id", F.col("answers").alias("uuid")).distinct(), ["session_id", "uuid"], "left_anti")
    unlinked = unlinked.groupBy("session_id").agg(F.count("*").alias("unlinked"))
    tree = links.groupBy("session_id").agg(
        F.bool_or(F.col("role").isNull() | F.col("at").isNull()).alias("bad_row"),
        F.min_by("prompt", F.when(F.col("counts"), F.col("place"))).alias("begins"),
        F.count("*").alias("n_rows"),
    )
    ids = m.select("session_id", F.explode(F.concat(F.transform("tool_uses", lambda x: F.struct(x.alias("id"), F.lit(1).alias("use"))), F.transform("tool_results", lambda x: F.struct(x.alias("id"), F.lit(2).alias("use"))))).alias("t"))
    odd = ids.groupBy("session_id", "t.id").agg(F.bit_or("t.use").alias("use")).where("use < 3").select("session_id").distinct().withColumn("bad_tools", F.lit(True))
    tree = tree.join(unlinked, "session_id", "left").join(odd, "session_id", "left")
    tree = written(tree.withColumn("suspect", F.col("unlinked").isNotNull() | ~F.coalesce("begins", F.lit(False))), "conversation-trees")
    exact = _ordered_rule(m.join(tree.where("suspect").select("session_id"), "session_id", "left_semi"))
    out = tree.join(exact, "session_id", "left").select("session_id", "bad_row", F.coalesce("bad_tools", F.lit(False)).alias("bad_tools"), F.coalesce("bad_order", F.lit(False)).alias("bad_order"), "n_rows")
    return out.withColumn("usable", ~(F.col("bad_row") | F.col("bad_tools") | F.col("bad_order")))


def left_out(rows: DataFrame) -> DataFrame:
    return usability(rows).where("not usable").select("session_id")

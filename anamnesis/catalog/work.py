"""Queries over work items, holds, gates, routines, messages and drafts, derived from orders, lines and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.operators import work as W
from anamnesis.sources.tables import table

ORDERS_AT, EVENTS_AT = "1999-01-01 00:00:00", "2024-01-10 00:00:00"


def _items(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "active").otherwise("pending")
    priority = (11 - 2 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority")
    return o.select(F.col("o_orderkey").alias("item"), status.alias("status"), priority, F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("project"))


def _before(items: DataFrame, by: list[str]) -> DataFrame:
    """Edges from every item to the one before it in its group."""
    w = Window.partitionBy(*by).orderBy("created", "item")
    return items.select(F.col("item").alias("source"), F.lag("item").over(w).alias("target")).where("target is not null")


def _requires(s: SparkSession, d: str) -> DataFrame:
    return _before(_items(s, d), ["project", "priority"])


def _holds(s: SparkSession, d: str) -> DataFrame:
    """Holds on the items of a user's number, ten minutes for each event."""
    e = table(s, d, "events")
    return e.select("event_id", F.col("user_id").alias("item"), F.col("event_type").alias("holder"), F.col("ts").cast("timestamp").alias("begun")).withColumn("expires", F.col("begun") + F.expr("interval 10 minutes"))


def _open() -> Column:
    return F.col("status") != "done"


def _frontier(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    requires = _requires(s, d)
    conflicts = _before(items.where("priority = 9"), ["project"])
    gated = table(s, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'O'").select(F.col("l_orderkey").alias("item")).distinct()
    held = W.current_holds(_holds(s, d), "item", "begun", "expires", "event_id", EVENTS_AT)
    f = W.free(items, "item", _open(), F.col("status") == "active", requires, gated, conflicts, held)
    unlocks = requires.groupBy("target").agg(F.count("*").alias("unlocks")).withColumnRenamed("target", "item")
    hours = (F.unix_seconds(F.lit(ORDERS_AT).cast("timestamp")) - F.unix_seconds(F.col("created").cast("timestamp"))) / 3600
    f = f.join(unlocks, "item", "left").withColumn("unlocks", F.coalesce("unlocks", F.lit(0)))
    return f.select("item", "status", "priority", "unlocks", W.urgency(F.col("priority"), hours, F.col("unlocks"), F.col("status") == "active").alias("score"))


def work_frontier(s: SparkSession, d: str) -> DataFrame:
    return _frontier(s, d)


def work_next(s: SparkSession, d: str) -> DataFrame:
    return _frontier(s, d).orderBy(F.desc("score"), "item").limit(1)


def item_list(s: SparkSession, d: str) -> DataFrame:
    """The newest open items with any of the given tags."""
    i = _items(s, d).withColumn("tags", F.array(F.concat(F.lit("p"), "priority"), "status"))
    return i.where(_open() & F.arrays_overlap("tags", F.array(F.lit("p9"), F.lit("active")))).orderBy(F.desc("created"), "item").limit(50).select("item", "status", "priority")


def item_detail(s: SparkSession, d: str) -> DataFrame:
    """Items with the numbers of edges that leave and reach them."""
    r = _requires(s, d)
    out, in_ = r.groupBy(F.col("source").alias("item")).agg(F.count("*").alias("waits_for")), r.groupBy(F.col("target").alias("item")).agg(F.count("*").alias("waited_for"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _items(s, d).join(out, "item", "left").join(in_, "item", "left").select("item", "status", z("waits_for"), z("waited_for"))


def item_released(s: SparkSession, d: str) -> DataFrame:
    """What can begin once the active items are done: all it requires is done or active."""
    items, r = _items(s, d), _requires(s, d)
    waited = W.blocked(items, r, "item", F.col("status") == "active")
    still = W.blocked(items, r, "item", F.col("status") == "pending")
    return items.where("status = 'pending'").join(waited, "item", "left_semi").join(still, "item", "left_anti").select("item")


def hold_current(s: SparkSession, d: str) -> DataFrame:
    return W.current_holds(_holds(s, d), "item", "begun", "expires", "event_id", EVENTS_AT).select("item", "holder", "begun")


def hold_overdue(s: SparkSession, d: str) -> DataFrame:
    return _holds(s, d).where(F.col("expires") <= F.lit(EVENTS_AT).cast("timestamp")).groupBy("holder").agg(F.count("*").alias("n"))


def hold_renewed(s: SparkSession, d: str) -> DataFrame:
    """The last hold of every item, renewed: ten minutes from its end or from now, whichever is later."""
    w = Window.partitionBy("item").orderBy(F.desc("begun"), F.desc("event_id"))
    h = _holds(s, d).where("item is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    return h.select("item", "holder", (F.greatest("expires", F.lit(EVENTS_AT).cast("timestamp")) + F.expr("interval 10 minutes")).alias("expires"))


def hold_released(s: SparkSession, d: str) -> DataFrame:
    """Items whose last holder leaves a result are done, others are pending again."""
    w = Window.partitionBy("item").orderBy(F.desc("begun"), F.desc("event_id"))
    h = _holds(s, d).where("item is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    h = h.select("item", F.when(F.col("holder") == "purchase", "done").otherwise("pending").alias("now"))
    return h.join(_items(s, d), "item").groupBy("now", "status").agg(F.count("*").alias("n"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").where("l_orderkey is not null and l_linenumber is not null")
    depends = F.when(F.col("l_linenumber") > 2, F.array(F.col("l_linenumber") - 1, F.col("l_linenumber") - 2)).when(F.col("l_linenumber") > 1, F.array(F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>"))
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("line"), F.max("l_returnflag").alias("flag"))
    return one.withColumn("depends_on", depends)


def routine_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges between the steps of each run, counted by run."""
    return W.dependent_steps(_steps(s, d), "l_orderkey", "l_linenumber", "depends_on").groupBy("l_orderkey").agg(F.count("*").alias("edges"), F.max("target").alias("last_target"))


def routine_status(s: SparkSession, d: str) -> DataFrame:
    st = _steps(s, d).groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.count_if(F.col("line") == "F").alias("done"), F.bool_or(F.col("flag") == "R").alias("failed"))
    state = F.when(F.col("done") == F.col("steps"), "completed").when(F.col("failed"), "failed").otherwise("running")
    return st.select("l_orderkey", "steps", "done", state.alias("state"))


def routine_list(s: SparkSession, d: str) -> DataFrame:
    return routine_status(s, d).groupBy("state").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


def message_threads(s: SparkSession, d: str) -> DataFrame:
    """Threads of the timeline: messages, last one, and distinct kinds and tools that take part."""
    e = table(s, d, "timeline_events").where("event_id is not null").dropDuplicates(["event_id"])
    return W.threads(e, F.coalesce("session_id", "event_id"), "ts", ["kind"]).orderBy(F.desc("last"), "thread").limit(20)


def message_inbox(s: SparkSession, d: str) -> DataFrame:
    """The newest messages of a week for each user, fifty at most."""
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    t = F.lit(EVENTS_AT).cast("timestamp")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return e.where((F.col("ts") <= t) & (F.col("ts") + F.expr("interval 7 days") > t)).withColumn("r", F.row_number().over(w)).where("r <= 50").select("user_id", "event_id")


def message_cleanup(s: SparkSession, d: str) -> DataFrame:
    """Messages that are left after the expired ones are deleted."""
    e = table(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    gone = e.where(F.col("ts") + F.expr("interval 7 days") <= F.lit(EVENTS_AT).cast("timestamp")).select("event_id")
    return e.join(gone, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


def gate_resolved(s: SparkSession, d: str) -> DataFrame:
    """Open items all of whose gates have passed and all of whose requirements are done."""
    items = _items(s, d)
    passed = W.all_passed(table(s, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F").withColumnRenamed("l_orderkey", "item")
    return items.where(_open()).join(passed, "item", "left_semi").join(W.blocked(items, _requires(s, d), "item", _open()), "item", "left_anti").select("item", "status")


def gate_list(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    overdue = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.lit(ORDERS_AT).cast("timestamp"))
    state = F.when(overdue, "expired").when(F.col("l_linestatus") == "O", "pending").otherwise("passed")
    return li.groupBy(state.alias("state"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("newest"))


def watch_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Watches over the number of calls of each kind: which are triggered."""
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"))
    watch = s.createDataFrame([("error", "gt", 100), ("click", "lt", 5), ("purchase", "gt", 10), ("view", "eq", 1)], "event_type string, operator string, value int")
    fires = F.when(F.col("operator") == "gt", F.col("calls") > F.col("value")).when(F.col("operator") == "lt", F.col("calls") < F.col("value")).otherwise(F.col("calls") == F.col("value"))
    return n.join(watch, "event_type").select("event_type", "operator", "calls", fires.alias("triggered"))


def watch_patterns(s: SparkSession, d: str) -> DataFrame:
    """Watches over titles: matches since a day, for each pattern."""
    watch = s.createDataFrame([("timeouts", "(?i)timeout|retry"), ("caches", "(?i)\\bcache"), ("nothing", "^$")], "watch string, pattern string")
    o = table(s, d, "file_history").where("title is not null and ts >= timestamp'2025-01-01'").select("obs_id", "title").distinct()
    hits = o.select("obs_id", F.explode(F.array(*(F.when(F.col("title").rlike(r["pattern"]), r["watch"]) for r in watch.collect()))).alias("watch")).where("watch is not null")
    return hits.groupBy("watch").agg(F.count("*").alias("n"))


def draft_discarded(s: SparkSession, d: str) -> DataFrame:
    """Items and edges that stay when the drafts of a segment are discarded with their items."""
    items, r = _items(s, d), _requires(s, d)
    c = table(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("project"))
    left, edges = W.without(items, r, "item", items.join(c, "project", "left_semi").select("item"))
    return left.agg(F.lit("items").alias("what"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


def draft_list(s: SparkSession, d: str) -> DataFrame:
    n = _items(s, d).groupBy("project").agg(F.count("*").alias("items"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("project"), "c_mktsegment")
    return c.join(n, "project", "left").groupBy("c_mktsegment").agg(F.count("*").alias("drafts"), F.sum(F.coalesce("items", F.lit(0))).alias("items"))


def draft_promoted(s: SparkSession, d: str) -> DataFrame:
    """Items after the drafts of a segment are promoted: they belong to a project of their own."""
    c = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("project"), F.lit(-1).cast("long").alias("_p"))
    i = _items(s, d).join(c, "project", "left").select(F.coalesce("_p", "project").alias("project"), "status")
    return i.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(20)


def finished_groups(s: SparkSession, d: str) -> DataFrame:
    """Items done more than a week ago, grouped to be summed up."""
    i = _items(s, d).where("status = 'done'").where(F.col("created").cast("timestamp") + F.expr("interval 7 days") < F.lit(ORDERS_AT).cast("timestamp"))
    return i.groupBy(F.coalesce(F.col("project").cast("string"), F.lit("_ungrouped")).alias("grp")).agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max("created").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        work_frontier, work_next, item_list, item_detail, item_released, hold_current, hold_overdue, hold_renewed, hold_released, routine_edges, routine_status, routine_list, message_threads,
        message_inbox, message_cleanup, gate_resolved, gate_list, watch_thresholds, watch_patterns, draft_discarded, draft_list, draft_promoted, finished_groups,
    )
}

_I = """i AS (SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE 'pending' END AS status, 11 - 2 * left(o_orderpriority, 1)::INT AS priority,
          o_orderdate AS created, o_custkey AS project FROM orders),
        r AS (SELECT * FROM (SELECT item AS source, lag(item) OVER (PARTITION BY project, priority ORDER BY created, item) AS target FROM i) WHERE target IS NOT NULL)"""
_H = "h AS (SELECT event_id, user_id AS item, event_type AS holder, ts::TIMESTAMP AS begun, ts::TIMESTAMP + INTERVAL 10 MINUTE AS expires FROM events)"
_F = f"""{_I}, {_H}, k AS (SELECT * FROM (SELECT item AS source, lag(item) OVER (PARTITION BY project ORDER BY created, item) AS target FROM i WHERE priority = 9) WHERE target IS NOT NULL),
        u AS (SELECT target, count(*) AS unlocks FROM r GROUP BY target),
        f AS (SELECT i.item, status, priority, coalesce(unlocks, 0) AS unlocks, round(10 * priority + least(0.5 * date_diff('second', created::TIMESTAMP, TIMESTAMP '1999-01-01') / 3600, 20) + 5 * coalesce(unlocks, 0)
            + CASE WHEN status = 'active' THEN 15 ELSE 0 END, 2)::DOUBLE AS score
          FROM i LEFT JOIN u ON u.target = i.item WHERE status <> 'done'
          AND NOT EXISTS (SELECT 1 FROM r JOIN i j ON j.item = r.target WHERE r.source = i.item AND j.status <> 'done')
          AND NOT EXISTS (SELECT 1 FROM k JOIN i j ON j.item = k.target WHERE k.source = i.item AND j.status = 'active')
          AND NOT EXISTS (SELECT 1 FROM k JOIN i j ON j.item = k.source WHERE k.target = i.item AND j.status = 'active')
          AND i.item NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_orderkey IS NOT NULL)
          AND i.item NOT IN (SELECT item FROM h WHERE begun <= TIMESTAMP '2024-01-10' AND expires > TIMESTAMP '2024-01-10' AND item IS NOT NULL))"""
_S = """s AS (SELECT l_orderkey, l_linenumber AS n, min(l_linestatus) AS line, max(l_returnflag) AS flag FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL)"""
_ST = f"""{_S}, st AS (SELECT l_orderkey, count(*) AS steps, count(*) FILTER (WHERE line = 'F') AS done,
          CASE WHEN count(*) FILTER (WHERE line = 'F') = count(*) THEN 'completed' WHEN bool_or(flag = 'R') THEN 'failed' ELSE 'running' END AS state FROM s GROUP BY l_orderkey)"""

SQL = {
    "work_frontier": f"WITH {_F} SELECT * FROM f",
    "work_next": f"WITH {_F} SELECT * FROM f ORDER BY score DESC, item LIMIT 1",
    "item_list": f"WITH {_I} SELECT item, status, priority FROM i WHERE status <> 'done' AND (priority = 9 OR status = 'active') ORDER BY created DESC, item LIMIT 50",
    "item_detail": f"""WITH {_I} SELECT item, status, (SELECT count(*) FROM r WHERE r.source = i.item) AS waits_for, (SELECT count(*) FROM r WHERE r.target = i.item) AS waited_for FROM i""",
    "item_released": f"""WITH {_I} SELECT item FROM i WHERE status = 'pending' AND item IN (SELECT source FROM r JOIN i j ON j.item = r.target WHERE j.status = 'active')
        AND item NOT IN (SELECT source FROM r JOIN i j ON j.item = r.target WHERE j.status = 'pending')""",
    "hold_current": f"""WITH {_H} SELECT item, holder, begun FROM h WHERE begun <= TIMESTAMP '2024-01-10' AND expires > TIMESTAMP '2024-01-10' AND item IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY begun DESC, event_id DESC) = 1""",
    "hold_overdue": f"WITH {_H} SELECT holder, count(*) AS n FROM h WHERE expires <= TIMESTAMP '2024-01-10' GROUP BY holder",
    "hold_renewed": f"""WITH {_H} SELECT item, holder, greatest(expires, TIMESTAMP '2024-01-10') + INTERVAL 10 MINUTE AS expires FROM h WHERE item IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY begun DESC, event_id DESC) = 1""",
    "hold_released": f"""WITH {_I}, {_H}, l AS (SELECT item, CASE WHEN holder = 'purchase' THEN 'done' ELSE 'pending' END AS now FROM h WHERE item IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY item ORDER BY begun DESC, event_id DESC) = 1) SELECT now, status, count(*) AS n FROM l JOIN i USING (item) GROUP BY ALL""",
    "routine_edges": f"""WITH {_S}, e AS (SELECT a.l_orderkey, b.n AS target FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND b.n IN (a.n - 1, a.n - 2) AND (a.n > 2 OR (a.n = 2 AND b.n = 1)))
        SELECT l_orderkey, count(*) AS edges, max(target) AS last_target FROM e GROUP BY l_orderkey""",
    "routine_status": f"WITH {_ST} SELECT l_orderkey, steps, done, state FROM st",
    "routine_list": f"WITH {_ST} SELECT state, count(*) AS n, sum(steps)::BIGINT AS steps FROM st GROUP BY state",
    "message_threads": """WITH e AS (SELECT event_id, any_value(coalesce(session_id, event_id)) AS thread, any_value(ts) AS ts, any_value(kind) AS kind FROM timeline_events WHERE event_id IS NOT NULL GROUP BY event_id)
        SELECT thread, count(*) AS n, max(ts) AS last, count(DISTINCT kind) AS participants FROM e GROUP BY thread ORDER BY last DESC NULLS LAST, thread LIMIT 20""",
    "message_inbox": """SELECT user_id, event_id FROM events WHERE ts::TIMESTAMP <= TIMESTAMP '2024-01-10' AND ts::TIMESTAMP + INTERVAL 7 DAY > TIMESTAMP '2024-01-10'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 50""",
    "message_cleanup": "SELECT event_type, count(*) AS n FROM events WHERE ts::TIMESTAMP + INTERVAL 7 DAY > TIMESTAMP '2024-01-10' OR ts IS NULL GROUP BY event_type",
    "gate_resolved": f"""WITH {_I} SELECT item, status FROM i WHERE status <> 'done' AND item IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(coalesce(l_linestatus = 'F', false)))
        AND item NOT IN (SELECT source FROM r JOIN i j ON j.item = r.target WHERE j.status <> 'done')""",
    "gate_list": """SELECT CASE WHEN l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1999-01-01' THEN 'expired' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'passed' END AS state, l_returnflag AS kind, count(*) AS n, max(l_shipdate) AS newest
        FROM lineitem GROUP BY ALL""",
    "watch_thresholds": """WITH w AS (SELECT unnest(['error', 'click', 'purchase', 'view']) AS event_type, unnest(['gt', 'lt', 'gt', 'eq']) AS operator, unnest([100, 5, 10, 1]) AS value),
        n AS (SELECT event_type, count(*) AS calls FROM events GROUP BY event_type)
        SELECT event_type, operator, calls, CASE operator WHEN 'gt' THEN calls > value WHEN 'lt' THEN calls < value ELSE calls = value END AS triggered FROM n JOIN w USING (event_type)""",
    "watch_patterns": r"""WITH o AS (SELECT DISTINCT obs_id, title FROM file_history WHERE title IS NOT NULL AND ts >= TIMESTAMP '2025-01-01'),
        w AS (SELECT unnest(['timeouts', 'caches', 'nothing']) AS watch, unnest(['(?i)timeout|retry', '(?i)\bcache', '^$']) AS p)
        SELECT watch, count(*) AS n FROM o JOIN w ON regexp_matches(o.title, w.p) GROUP BY watch""",
    "draft_discarded": f"""WITH {_I}, g AS (SELECT item FROM i WHERE project IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
        SELECT 'items' AS what, count(*) AS n FROM i WHERE item NOT IN (SELECT item FROM g) UNION ALL SELECT 'edges', count(*) FROM r WHERE source NOT IN (SELECT item FROM g) AND target NOT IN (SELECT item FROM g)""",
    "draft_list": f"""WITH {_I}, n AS (SELECT project, count(*) AS items FROM i GROUP BY project)
        SELECT c_mktsegment, count(*) AS drafts, sum(coalesce(items, 0))::BIGINT AS items FROM customer LEFT JOIN n ON n.project = c_custkey GROUP BY c_mktsegment""",
    "draft_promoted": f"""WITH {_I} SELECT CASE WHEN project IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN -1 ELSE project END AS project, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, project LIMIT 20""",
    "finished_groups": f"""WITH {_I} SELECT coalesce(project::VARCHAR, '_ungrouped') AS grp, count(*) AS n, min(created) AS first, max(created) AS last FROM i WHERE status = 'done' AND created::TIMESTAMP + INTERVAL 7 DAY < TIMESTAMP '1999-01-01' GROUP BY 1""",
}

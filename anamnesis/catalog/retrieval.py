"""Queries of retrieval, ranking, packing and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import fusion, index, lexical, retrieve, vector
from anamnesis.sources.tables import table

QUERY = "retry cache timeline"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return lexical.postings(table(s, d, "documents"), "doc_id", "text")


def _searched(s: SparkSession, d: str) -> DataFrame:
    return lexical.searched(table(s, d, "documents"), "doc_id", "text", lexical.terms_of(s, QUERY))


def bm25_simple(s: SparkSession, d: str) -> DataFrame:
    return _searched(s, d).orderBy(F.desc("score"), "doc").limit(20).select(F.col("doc").alias("doc_id"), "score")


def bm25_prefix(s: SparkSession, d: str) -> DataFrame:
    return lexical.searched(table(s, d, "documents"), "doc_id", "text", lexical.terms_of(s, "retr cach"), prefixes=True).orderBy(F.desc("score"), "doc").limit(20).select(F.col("doc").alias("doc_id"), "score")


def bm25_batch(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "eval_items").where("item_id is not null")
    terms = items.select(F.col("item_id").alias("q"), F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"), F.lit(1.0).alias("weight"))
    return lexical.top(lexical.bm25(_docs(s, d), terms), 5).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


def _index(s: SparkSession, d: str) -> index.Index:
    return index.stored(s, f"{d}/documents.parquet", "doc_id", "text")


def _best(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc").limit(20).select(F.col("doc").alias("doc_id"), "score")


def bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    """Inflected words find each other's documents in the stored index."""
    return _best(_index(s, d).search(index.asked("retries cached timelines", expand=False), prefixes=False))


def bm25_synonyms(s: SparkSession, d: str) -> DataFrame:
    return _best(_index(s, d).search(index.asked("slow docs"), prefixes=False))


def bm25_removed(s: SparkSession, d: str) -> DataFrame:
    """The index after all pages are taken out: other frequencies and lengths."""
    pages = table(s, d, "documents").where("doc_kind = 'page'")
    return _best(_index(s, d).removed(pages, "doc_id").search(index.asked("retries cached timelines", expand=False), prefixes=False))


def bm25_added(s: SparkSession, d: str) -> DataFrame:
    """The index of the notes with the lessons added."""
    docs = table(s, d, "documents")
    some = _index(s, d).removed(docs.where("coalesce(doc_kind, '') <> 'note'"), "doc_id")
    return _best(some.added(docs.where("doc_kind = 'lesson'"), "doc_id", "text").search(index.asked("retries cached timelines", expand=False), prefixes=False))


def bm25_memories(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("coalesce(is_latest, true) and title is not null and content is not null")
    text = F.concat_ws(" ", "title", "content", "concepts", "files", "memory_type")
    return lexical.searched(m, "memory_id", text, lexical.terms_of(s, QUERY)).orderBy(F.desc("score"), "doc").limit(20).select(F.col("doc").alias("memory_id"), "score")


def index_statistics(s: SparkSession, d: str) -> DataFrame:
    p = _docs(s, d)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")).where("df > 1")


def _query_vector(s: SparkSession, d: str) -> list[float]:
    row = table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else [1.0]


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vector.top(table(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), 20)


def vector_batch_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    out = vector.batch_top(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return out.select("query_id", F.col("key").alias("vec_id"), "score", F.col("rank").cast("int").alias("rank"))


def vector_dimensions(s: SparkSession, d: str) -> DataFrame:
    return vector.dimensions(table(s, d, "image_vectors"), "image_ref", "vector", 64)


def _streams(s: SparkSession, d: str, limit: int = 40) -> dict[str, DataFrame]:
    lex = lexical.top(_searched(s, d), limit).select("doc", "rank")
    vec = vector.top(table(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), limit)
    vec = lexical.top(vec.select(F.lit(0).alias("q"), F.col("vec_id").alias("doc"), "score"), limit).select("doc", "rank")
    return {"bm25": lex, "vector": vec}


def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    f = fusion.fused(_streams(s, d))
    return fusion.ordered(f).limit(20).select(F.col("doc").alias("doc_id"), "score", F.col("best_rank").cast("int").alias("best_rank"), F.col("n_streams").cast("int").alias("n_streams"))


def rrf_diversified(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    f = fusion.fused(_streams(s, d)).join(docs, "doc")
    return fusion.diversified(f, "source", 20).select(F.col("doc").alias("doc_id"), "source", "score")


def budget_pack(s: SparkSession, d: str) -> DataFrame:
    head = bm25_simple(s, d).join(table(s, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens")), "doc_id")
    return fusion.packed_prefix(head, [F.desc("score"), F.col("doc_id")], "tokens", 5000).select("doc_id", "tokens", "used_tokens")


def context_blocks(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("is_latest and project is not null and content is not null")
    m = m.select("project", "updated_at", "memory_id", T.estimated_tokens(F.col("content")).alias("tokens"))
    return fusion.packed_skipping(m, ["project"], "updated_at", "memory_id", "tokens", 700)


def redact_secrets(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "raw_observations").where("tool_output is not null")
    out = o.select("obs_id", T.redacted(F.col("tool_output")).alias("clean"), "tool_output").where("clean <> tool_output")
    return out.select("obs_id", F.sha2("clean", 256).alias("clean_hash"), F.length("clean").alias("n_chars")).distinct()


def normalised_observations(s: SparkSession, d: str) -> DataFrame:
    n = T.normalised(table(s, d, "raw_observations"))
    return n.select("obs_id", "type", "title", F.sha2(F.coalesce("narrative", F.lit("")), 256).alias("narrative_hash"), F.array_join("files", "|").alias("files"), "importance", "confidence").distinct()


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy("doc_kind").agg(F.count("*").alias("n"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), F.sum(T.estimated_tokens(F.col("text"), 4)).alias("tokens_by_four"))


def memory_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories").where("content is not null").select("memory_id", T.fingerprint("mem", F.col("content")).alias("fingerprint"))


def query_entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", F.array_join(T.entities(F.col("question")), "|").alias("entities"))


def memory_quality(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories")
    score = T.observation_quality(F.col("title"), F.col("content"), F.col("files"), F.col("concepts"), F.round("strength").cast("int"))
    return m.select("memory_id", F.least(score, F.lit(100)).alias("quality"))


def lesson_recall(s: SparkSession, d: str) -> DataFrame:
    """Memories as lessons: lexical score in relation to the best, times confidence, times recency."""
    m = table(s, d, "memories")
    hits = lexical.searched(m.where("content is not null"), "memory_id", "content", lexical.terms_of(s, QUERY)).join(m.select(F.col("memory_id").alias("doc"), "strength", "updated_at"), "doc")
    best = hits.groupBy("q").agg(F.max("score").alias("best"))
    days = (F.unix_micros(F.lit("2026-07-01 00:00:00").cast("timestamp")) - F.unix_micros("updated_at")) / 86400e6
    hits = hits.join(best, "q").select(F.col("doc").alias("memory_id"), F.round(F.col("score") / F.col("best") * F.col("strength") / 10 / (1 + 0.01 * days), 3).alias("relevance"))
    return hits.where("relevance is not null").orderBy(F.desc("relevance"), "memory_id").limit(20)


def containment_search(s: SparkSession, d: str) -> DataFrame:
    """Share of the query's words that stand in a text, times strength."""
    words = F.array(*(F.lit(w) for w in QUERY.split()))
    m = table(s, d, "memories").where("content is not null and strength is not null")
    share = F.size(F.filter(words, lambda w: F.contains(F.lower("content"), w))) / F.size(words)
    m = m.select("memory_id", F.round(share * F.col("strength"), 6).alias("score"))
    return m.where("score > 0").orderBy(F.desc("score"), "memory_id").limit(20)


def _rows(s: SparkSession, d: str) -> DataFrame:
    return retrieve.observation_rows(table(s, d, "file_history"), table(s, d, "sessions")).unionByName(retrieve.memory_rows(table(s, d, "memories")))


def search_project(s: SparkSession, d: str) -> DataFrame:
    """Search in one project with a budget of tokens."""
    out = retrieve.search(s, _rows(s, d), "retry cache", 50, project="proj-amber-lease", budget=2000)
    return out.select("doc", "type", "score")


def search_narrative(s: SparkSession, d: str) -> DataFrame:
    return retrieve.search(s, _rows(s, d), "retry cache", 10, form="narrative").select("doc", "score", F.sha2("text", 256).alias("text_hash"))


def file_context(s: SparkSession, d: str) -> DataFrame:
    """What the newest sessions of each of two projects noted about one file's name."""
    files = [r[0].rpartition("/")[2] for r in table(s, d, "file_history").where("file_path is not null").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(3).collect()]
    return retrieve.file_context(table(s, d, "file_history"), table(s, d, "sessions"), "proj-amber-lease", files or ["?"], newest=100).select("file", "obs_id", "importance", "place")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_simple, bm25_prefix, bm25_batch, bm25_stemmed, bm25_synonyms, bm25_removed, bm25_added, bm25_memories, index_statistics, vector_topk, vector_batch_topk, vector_dimensions, hybrid_rrf, rrf_diversified, budget_pack, context_blocks,
        redact_secrets, normalised_observations, token_estimates, memory_fingerprints, query_entities, memory_quality, lesson_recall, containment_search, search_project,
        search_narrative, file_context,
    )
}

_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s/.\\-_]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"


def _bm25(key: str, text: str, source: str, terms: str) -> str:
    """CTEs up to score(q, doc, score)."""
    return rf"""
        d AS (SELECT {key} AS doc, {_TOK.format(text)} AS t FROM {source}),
        p AS (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d),
        tf AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY ALL),
        st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT doc, any_value(dl) AS dl FROM tf GROUP BY doc)),
        qt AS ({terms}),
        dfs AS (SELECT term, count(DISTINCT doc) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
        score AS (SELECT q, doc, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
                  FROM tf JOIN qt USING (term) JOIN dfs USING (term), st GROUP BY q, doc)"""


_SIMPLE = "SELECT 0 AS q, unnest(['retry', 'cache', 'timeline']) AS term, 1.0::DOUBLE AS weight"
_DOC = _bm25("doc_id", "text", "documents WHERE doc_id IS NOT NULL", _SIMPLE).replace("lower(text)", "lower(coalesce(text, ''))")
_VEC = """
        qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
        vs AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, qv WHERE embedding IS NOT NULL)"""
_RRF = f"""{_DOC}, {_VEC},
        lr AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM score QUALIFY rank <= 40),
        vr AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 40),
        al AS (SELECT doc, rank, 0.4::DOUBLE AS w FROM lr UNION ALL SELECT doc, rank, 0.6::DOUBLE FROM vr),
        ac AS (SELECT sum(w) AS active FROM (SELECT DISTINCT w FROM al)),
        fu AS (SELECT doc, round(sum(w / (60 + rank)) / (any_value(active) / 61) * (1 + 0.05 * (count(*) - 1)), 6) AS score, min(rank) AS best_rank, count(*) AS n_streams FROM al, ac GROUP BY doc)"""
_RED = "tool_output"
for _p, _to in [(T.PRIVATE_TAG, "[REDACTED]"), *((p, "[REDACTED_SECRET]") for p in T.SECRETS)]:
    _q = _p.replace("'", "''")
    _RED = f"regexp_replace({_RED}, '{_q}', '{_to}', 'g')"
_KIND = "CASE " + " ".join(f"WHEN hook_type = '{h}' THEN '{k}'" for h, k in T.HOOKS.items())
_NAME = r"lower(regexp_replace(regexp_replace(coalesce(tool_name, hook_type), '([a-z])([A-Z])', '\1_\2', 'g'), '[-\s]+', '_', 'g'))"
for _k, _w in T.KINDS:
    _any = "|".join(_w.split())
    _KIND += f" WHEN regexp_matches({_NAME}, '(^|_)({_any})(_|$)|^({_any})|({_any})$') THEN '{_k}'"
_KIND += " ELSE 'other' END"
_FILES = ", ".join(f"json_extract_string(j, '$.{k}')" for k in T.FILE_KEYS)
_NAMES = ", ".join(f"'{w}'" for w in T.NO_NAMES)

def _stem_sql(forms: dict[str, str], weights: dict[str, float], where: str = "") -> str:
    """The words of the given forms count as one term each; other words only for lengths."""
    case = " ".join("WHEN term IN ({}) THEN '{}'".format(", ".join(f"'{w}'" for w in words.split()), stem) for stem, words in forms.items())
    asked = " UNION ALL ".join(f"SELECT 0 AS q, '{t}' AS term, {w}::DOUBLE AS weight" for t, w in weights.items())
    out = _DOC.replace(_SIMPLE, asked).replace("p AS (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d)", f"p AS (SELECT doc, dl, CASE {case} ELSE '#' || term END AS term FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d))")
    return f"WITH {out.replace('WHERE doc_id IS NOT NULL', 'WHERE doc_id IS NOT NULL' + where)} SELECT doc AS doc_id, score FROM score ORDER BY score DESC, doc LIMIT 20"


_INFLECTED = {"retri": "retry retries retried retrying retri", "cach": "cache caches cached caching cach", "timelin": "timeline timelines timelin"}
_ONCE = {"retri": 1.0, "cach": 1.0, "timelin": 1.0}
_ALIKE = {
    "slow": "slow slows slowed slowing slowness", "doc": "doc docs", "document": "document documents documented documenting documentation", "bottleneck": "bottleneck bottlenecks", "latenc": "latency latencies latenc",
    "perf": "perf perfs", "perform": "perform performs performed performing performance performances", "throughput": "throughput throughputs",
}
_ALIKE_WEIGHTS = {"slow": 1.0, "doc": 1.0, "document": 0.7, "bottleneck": 0.7, "latenc": 0.7, "perf": 0.7, "perform": 0.7, "throughput": 0.7}

SQL = {
    "context_blocks": """WITH RECURSIVE m AS (SELECT project, memory_id, ceil(length(content) / 3.0)::BIGINT AS t, row_number() OVER (PARTITION BY project ORDER BY updated_at DESC NULLS LAST, memory_id DESC) AS r
          FROM memories WHERE is_latest AND project IS NOT NULL AND content IS NOT NULL),
        f AS (SELECT project, memory_id, r, t <= 700 AS kept, CASE WHEN t <= 700 THEN t ELSE 0 END AS used FROM m WHERE r = 1
          UNION ALL SELECT m.project, m.memory_id, m.r, f.used + m.t <= 700, CASE WHEN f.used + m.t <= 700 THEN f.used + m.t ELSE f.used END FROM f JOIN m ON m.project = f.project AND m.r = f.r + 1)
        SELECT project, memory_id FROM f WHERE kept""",
    "bm25_stemmed": _stem_sql(_INFLECTED, _ONCE),
    "bm25_synonyms": _stem_sql(_ALIKE, _ALIKE_WEIGHTS),
    "bm25_removed": _stem_sql(_INFLECTED, _ONCE, " AND doc_kind IS DISTINCT FROM 'page'"),
    "bm25_added": _stem_sql(_INFLECTED, _ONCE, " AND doc_kind IN ('note', 'lesson')"),
    "bm25_simple": f"WITH {_DOC} SELECT doc AS doc_id, score FROM score ORDER BY score DESC, doc LIMIT 20",
    "bm25_prefix": "WITH "
    + _DOC.replace(
        _SIMPLE,
        """SELECT 0 AS q, unnest(['retr', 'cach']) AS term, 1.0::DOUBLE AS weight
              UNION ALL SELECT 0, t.term, 0.5::DOUBLE FROM (SELECT DISTINCT term FROM tf) t, (SELECT unnest(['retr', 'cach']) AS a) WHERE starts_with(t.term, a) AND t.term <> a""",
    )
    + " SELECT doc AS doc_id, score FROM score ORDER BY score DESC, doc LIMIT 20",
    "bm25_batch": "WITH "
    + _DOC.replace(_SIMPLE, f"SELECT item_id AS q, unnest(list_distinct({_TOK.format('question')})) AS term, 1.0::DOUBLE AS weight FROM eval_items WHERE item_id IS NOT NULL")
    + " SELECT q AS item_id, doc AS doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc)::INT AS rank FROM score QUALIFY rank <= 5",
    "bm25_memories": "WITH "
    + _bm25(
        "memory_id",
        "concat_ws(' ', title, content, array_to_string(concepts, ' '), array_to_string(files, ' '), memory_type)",
        "memories WHERE coalesce(is_latest, true) AND title IS NOT NULL AND content IS NOT NULL",
        _SIMPLE,
    )
    + " SELECT doc AS memory_id, score FROM score ORDER BY score DESC, doc LIMIT 20",
    "index_statistics": f"WITH {_DOC} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term HAVING count(*) > 1",
    "vector_topk": f"WITH {_VEC} SELECT vec_id, score FROM vs ORDER BY score DESC, vec_id LIMIT 20",
    "vector_batch_topk": """
        SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) DESC, r.vec_id)::INT AS rank
        FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND len(q.embedding) = len(r.embedding) WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""",
    "vector_dimensions": "SELECT len(vector)::INT AS dimensions, count(*) AS n, len(vector) = 64 AS fits FROM image_vectors WHERE vector IS NOT NULL GROUP BY len(vector)",
    "hybrid_rrf": f"WITH {_RRF} SELECT doc AS doc_id, score, best_rank::INT AS best_rank, n_streams::INT AS n_streams FROM fu ORDER BY score DESC, best_rank, doc LIMIT 20",
    "rrf_diversified": f"""WITH {_RRF},
        w AS (SELECT fu.*, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, best_rank, doc) > 3 AS later FROM fu JOIN documents ON doc = doc_id)
        SELECT doc AS doc_id, source, score FROM w ORDER BY later, score DESC, best_rank, doc LIMIT 20""",
    "budget_pack": f"""WITH {_DOC}, h AS (SELECT doc, score FROM score ORDER BY score DESC, doc LIMIT 20),
        u AS (SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS tokens, (sum(ceil(length(text) / 3.0)) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used_tokens
              FROM h JOIN documents ON doc = doc_id)
        SELECT * FROM u WHERE used_tokens <= 5000""",
    "redact_secrets": f"""SELECT DISTINCT obs_id, sha256(clean) AS clean_hash, length(clean)::INT AS n_chars
        FROM (SELECT obs_id, tool_output, {_RED} AS clean FROM raw_observations WHERE tool_output IS NOT NULL) WHERE clean <> tool_output""",
    "normalised_observations": f"""
        WITH r AS (SELECT *, TRY_CAST(tool_input AS JSON) AS j, coalesce(tool_name, hook_type) AS tool,
                          concat_ws(' | ', nullif(user_prompt, ''), nullif(tool_input, ''), nullif(tool_output, '')) AS n FROM raw_observations),
        f AS (SELECT *, list_filter([{_FILES}], lambda v: v IS NOT NULL AND length(v) BETWEEN 1 AND 511) AS fs FROM r)
        SELECT DISTINCT obs_id, {_KIND} AS type, CASE WHEN length(tool) > 80 THEN tool[1:79] || '…' ELSE coalesce(nullif(tool, ''), 'observation') END AS title,
               sha256(coalesce(CASE WHEN length(n) > 400 THEN n[1:399] || '…' ELSE n END, '')) AS narrative_hash,
               array_to_string(list_filter(fs, lambda v, i: list_position(fs, v) = i), '|') AS files, 5 AS importance, 0.3::DOUBLE AS confidence FROM f""",
    "token_estimates": """SELECT doc_kind, count(*) AS n, sum(ceil(length(text) / 3.0))::BIGINT AS tokens, sum(ceil(length(text) / 4.0))::BIGINT AS tokens_by_four FROM documents GROUP BY doc_kind""",
    "memory_fingerprints": "SELECT memory_id, 'mem_' || sha256(content)[1:16] AS fingerprint FROM memories WHERE content IS NOT NULL",
    "query_entities": f"""
        WITH e AS (SELECT item_id, regexp_extract_all(question, '"([^"]+)"', 1) || list_filter(regexp_extract_all(question, '\\b([A-Z][a-zA-Z0-9_.-]+)\\b', 1), lambda w: w NOT IN ({_NAMES})) AS e FROM eval_items)
        SELECT item_id, array_to_string(list_filter(e, lambda w, i: list_position(e, w) = i), '|') AS entities FROM e""",
    "memory_quality": """
        SELECT memory_id, least(100, (coalesce(len(files), 0) > 0)::INT * 25 + (coalesce(len(files), 0) >= 3)::INT * 10 + coalesce((length(content) >= 20)::INT, 0) * 20 + coalesce((length(content) >= 50)::INT, 0) * 5
          + coalesce((length(title) BETWEEN 5 AND 120)::INT, 0) * 15 + (coalesce(len(concepts), 0) > 0)::INT * 15 + coalesce((round(strength)::INT BETWEEN 1 AND 10)::INT, 0) * 10)::INT AS quality FROM memories""",
    "lesson_recall": "WITH "
    + _bm25("memory_id", "content", "memories WHERE content IS NOT NULL", _SIMPLE)
    + """, r AS (SELECT doc AS memory_id, round(score / (SELECT max(score) FROM score) * strength / 10
                   / (1 + 0.01 * (epoch_us(TIMESTAMP '2026-07-01') - epoch_us(updated_at)) / 86400e6), 3) AS relevance FROM score JOIN memories ON doc = memory_id)
        SELECT * FROM r WHERE relevance IS NOT NULL ORDER BY relevance DESC, memory_id LIMIT 20""",
    "containment_search": """
        WITH m AS (SELECT memory_id, round(len(list_filter(['retry', 'cache', 'timeline'], lambda w: contains(lower(content), w))) / 3.0::DOUBLE * strength, 6) AS score
                   FROM memories WHERE content IS NOT NULL AND strength IS NOT NULL)
        SELECT * FROM m WHERE score > 0 ORDER BY score DESC, memory_id LIMIT 20""",
}
_SE = "(SELECT session_id, min(project) AS project, min(agent_id) AS agent_id FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id)"
_ALL = f"""a AS (SELECT o.obs_id AS doc, s.project, o.obs_type AS type, o.title, o.narrative, [o.file_path] AS files, [] AS concepts
               FROM (SELECT DISTINCT ON (obs_id) * FROM file_history WHERE obs_id IS NOT NULL AND title IS NOT NULL AND narrative IS NOT NULL) o LEFT JOIN {_SE} s USING (session_id)
             UNION ALL SELECT memory_id, project, 'decision', title, content, files, concepts FROM memories WHERE memory_id IS NOT NULL AND coalesce(is_latest, true) AND title IS NOT NULL AND content IS NOT NULL),
        x AS (SELECT doc, concat_ws(' ', title, narrative, array_to_string(concepts, ' '), array_to_string(files, ' '), type) AS text FROM a{{where}}),"""
_ASKED = """SELECT 0 AS q, unnest(['retry', 'cache']) AS term, 1.0::DOUBLE AS weight
              UNION ALL SELECT 0, t.term, 0.5::DOUBLE FROM (SELECT DISTINCT term FROM tf) t, (SELECT unnest(['retry', 'cache']) AS a) WHERE starts_with(t.term, a) AND t.term <> a"""
SQL |= {
    "search_project": f"""WITH {_ALL.format(where=" WHERE coalesce(project, 'proj-amber-lease') = 'proj-amber-lease'")} {_bm25("doc", "text", "x", _ASKED)},
        h AS (SELECT doc, score FROM score ORDER BY score DESC, doc LIMIT 50),
        u AS (SELECT doc, type, score, sum(greatest(1, ceil(length(narrative) / 3.0))) OVER (ORDER BY score DESC, doc ROWS UNBOUNDED PRECEDING) AS used FROM h JOIN a USING (doc))
        SELECT doc, type, score FROM u WHERE used <= 2000""",
    "search_narrative": f"""WITH {_ALL.format(where="")} {_bm25("doc", "text", "x", _ASKED)}, h AS (SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS r FROM score QUALIFY r <= 10)
        SELECT doc, score, sha256(r::VARCHAR || '. ' || title || ': ' || narrative) AS text_hash FROM h JOIN a USING (doc)""",
    "file_context": """WITH f AS (SELECT regexp_extract(file_path, '[^/]*$') AS file FROM (SELECT file_path FROM file_history WHERE file_path IS NOT NULL GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 3)),
        s AS (SELECT session_id FROM sessions WHERE project = 'proj-amber-lease' AND session_id IS NOT NULL GROUP BY session_id ORDER BY max(started_at) DESC NULLS LAST, session_id LIMIT 100),
        o AS (SELECT DISTINCT ON (obs_id) * FROM file_history WHERE obs_id IS NOT NULL AND importance >= 4),
        r AS (SELECT file, obs_id, importance, row_number() OVER (PARTITION BY file ORDER BY importance DESC, ts DESC, obs_id) AS place
              FROM o JOIN f ON file_path = file OR ends_with(file_path, '/' || file) OR ends_with(file, '/' || file_path) WHERE session_id IN (SELECT session_id FROM s))
        SELECT file, obs_id, importance, place::INT AS place FROM r WHERE place <= 5""",
}

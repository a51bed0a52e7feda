"""Queries on memories, with their SQL."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import memory as M
from . import bindings as B
from .bindings import AS_OF, query

B.SQL["dec"] = f"""SELECT *, {AS_OF} - timestamp < 86400 AS is_protected, CASE WHEN {AS_OF} - timestamp < 86400 THEN importance
    ELSE greatest(least(importance * exp(-0.1 * ({AS_OF} - timestamp - 86400) / (86400 * (1 + 0.5 * access_count))) + least(0.1 * access_count, 0.5), 1.0), 0.0) END AS decayed FROM memories"""
B.SQL["act"] = "SELECT *, CASE WHEN is_protected THEN 'protected' WHEN decayed < 0.05 THEN 'forget' WHEN abs(decayed - importance) > 1e-9 THEN 'decay' ELSE 'keep' END AS action FROM dec"


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT id, round(least(0.5 + least(length(content) / 1000, 0.3) + CASE WHEN contains(lower(content), 'key') OR contains(lower(content), 'important') OR contains(lower(content), 'conclusion') THEN 0.2 ELSE 0 END, 1.0), 2) AS importance FROM memories", "memories")
def mem01_importance(spark, sf):
    return _round(B.memories(spark, sf).select("id", M.importance(F.col("content")).alias("importance")), "importance")


@query("SELECT sha256(project_id || '|' || agent_source || '|' || timestamp || '|' || content) AS id, memory_type, access_count FROM memories", "memories")
def mem02_to_memories(spark, sf):
    return M.to_memories(B.memories(spark, sf).drop("id", "memory_type"), AS_OF).select("id", "memory_type", "access_count")


def _with_vectors(spark, sf):
    """All memories; the vectors of embeddings are dealt to them in turn."""
    v = B.vectors(spark, sf).select(F.col("vec_id").alias("__v"), "vector")
    return B.memories(spark, sf).withColumn("__v", F.col("id") % B.read(spark, sf, "embeddings").count()).join(v, "__v").drop("__v")


def _named(spark, sf):
    """All memories with the vector_id of the vector that _with_vectors deals them, and the vectors."""
    named = B.memories(spark, sf).withColumn("vector_id", F.col("id") % B.read(spark, sf, "embeddings").count())
    return named, B.vectors(spark, sf).select(F.col("vec_id").alias("vector_id"), "vector")


def _as_queries(named):
    return named.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("content").alias("query"), "vector_id", "project_id")


B.SQL["mv"] = "SELECT m.*, v.vector FROM memories m JOIN vectors v ON v.vec_id = m.id % (SELECT count(*) FROM embeddings)"
B.SQL["rec"] = """SELECT query_id, id, rank, score FROM (SELECT q.id AS query_id, m.id, list_cosine_similarity(q.vector, m.vector) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector, m.vector), 9) DESC, m.id) AS rank
    FROM mv q JOIN mv m USING (project_id) WHERE q.id % 50 = 0) WHERE rank <= 5"""


@query("SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rec", "memories", "vectors", "mv", "rec")
def mem03_recall(spark, sf):
    named, vectors = _named(spark, sf)
    return _round(M.recall(_as_queries(named), named, 5, vectors)[0], "score")


@query("SELECT id, timestamp FROM memories WHERE project_id = 3 AND agent_source = 'click' ORDER BY timestamp DESC, id LIMIT 20 OFFSET 10", "memories")
def mem04_list_memories(spark, sf):
    return M.list_memories(B.memories(spark, sf), 3, agent="click", offset=10)[0].select("id", "timestamp")


@query("SELECT 'total' AS kind, '' AS name, count(*) AS count FROM memories UNION ALL SELECT 'type', memory_type, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'agent', agent_source, count(*) FROM memories GROUP BY 2", "memories")
def mem05_memory_stats(spark, sf):
    return M.memory_stats(B.memories(spark, sf))


@query("SELECT agent_source, count(*) AS n FROM memories WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1", "memories")
def mem06_delete_memories(spark, sf):
    ids = B.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return M.delete_memories(B.memories(spark, sf), ids).groupBy("agent_source").agg(F.count("*").alias("n"))


@query("SELECT id, round(decayed, 6) AS decayed, is_protected FROM dec", "memories", "dec")
def mem07_decayed(spark, sf):
    return _round(M.decayed(B.memories(spark, sf), AS_OF).select("id", "decayed", "is_protected"), "decayed")


@query("SELECT action, count(*) AS count FROM act GROUP BY 1", "memories", "dec", "act")
def mem08_forgetting_totals(spark, sf):
    return M.forgetting_totals(B.memories(spark, sf), AS_OF)


@query("SELECT project_id, count(*) AS n FROM act WHERE action <> 'forget' GROUP BY 1", "memories", "dec", "act")
def mem09_cleanup(spark, sf):
    return M.cleanup(B.memories(spark, sf), AS_OF).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count_if(is_protected) AS protected, count_if(NOT is_protected AND decayed < 0.05) AS to_forget, round(avg(importance), 6) AS mean_before, round(avg(decayed), 6) AS mean_after FROM dec", "memories", "dec")
def mem10_decay_preview(spark, sf):
    return _round(M.decay_preview(B.memories(spark, sf), AS_OF), "mean_before", "mean_after")


def _questions(spark, sf):
    extra = F.when(F.col("query_id") % 4 == 0, " summarize what we discussed last week").when(F.col("query_id") % 4 == 1, " how and why compare").when(F.col("query_id") % 4 == 2, " yesterday").otherwise("")
    return B.turns(spark, sf).withColumn("query", F.concat("query", extra))


_WORDS = [(w, k) for k, ws in (("recall", M.RECALL_WORDS), ("reasoning", M.REASONING_WORDS), ("temporal", M.TEMPORAL_WORDS)) for w in ws]
B.SQL["questions"] = "SELECT query_id, query || CASE query_id % 4 WHEN 0 THEN ' summarize what we discussed last week' WHEN 1 THEN ' how and why compare' WHEN 2 THEN ' yesterday' ELSE '' END AS query FROM turns"
B.SQL["qcls"] = "SELECT query_id, list_filter([" + ", ".join(f"{{'w': '{w}', 'x': {M.WORD_WEIGHTS[k]}}}" for w, k in _WORDS) + "], lambda z: contains(lower(query), z.w)) AS f FROM questions"


@query(
    """SELECT query_id, array_to_string(list_transform(f, lambda z: z.w), ',') AS matched, confidence, CASE WHEN confidence >= 0.3 THEN 'system_2' ELSE 'system_1' END AS mode FROM (SELECT *, round(CASE WHEN len(f) = 0 THEN 0.0 ELSE least(least(0.25 * len(f), 0.5) + list_sum(list_transform(f, lambda z: z.x)), 1.0) END, 2) AS confidence FROM qcls)""",
    "turns", "questions", "qcls",
)
def mem11_classify_queries(spark, sf):
    return M.classify_queries(_questions(spark, sf)).select("query_id", F.array_join("matched", ",").alias("matched"), "confidence", "mode")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_first(table: dict, default: str) -> str:
    cases = " ".join(f"WHEN len(list_filter({_sql_list(ws)}, lambda w: contains(lower(query), w))) > 0 THEN '{name}'" for name, ws in table.items())
    return f"CASE {cases} ELSE '{default}' END"


def _sql_topic() -> str:
    text = "query"
    for cut in M.TOPIC_CUTS:
        text = f"regexp_replace({text}, '{cut}', '', 'g')"
    return f"trim({text})"


B.SQL["cues"] = f"""SELECT query_id, {_sql_first(M.TIME_FRAMES, 'all_time')} AS time_frame, {_sql_first(M.INTENTS, 'recall_fact')} AS intent, list_filter(both_, lambda x, i: list_position(list_transform(both_, lambda y: upper(y)), upper(x)) = i) AS entities,
    list_filter({_sql_list(M.HINTS)}, lambda h: contains(lower(query), h)) AS hints, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' WHEN t = '' THEN substr(query, 1, 30) ELSE t END AS topic
    FROM (SELECT *, list_concat(regexp_extract_all(query, '[「」"''](.*?)[「」"'']', 1), list_filter(regexp_extract_all(query, '([A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z])', 1), lambda x: length(x) >= 2)) AS both_, {_sql_topic()} AS t FROM questions)"""
B.SQL["trace"] = "SELECT query_id, array_to_string(list_concat(list_concat([topic], entities[1:3]), hints[1:2]), ' ') AS trace FROM cues"


@query("SELECT query_id, time_frame, intent, array_to_string(entities, ',') AS entities, array_to_string(hints, ',') AS hints, topic FROM cues", "turns", "questions", "cues")
def mem12_extract_cues(spark, sf):
    df = M.extract_cues(_questions(spark, sf))
    return df.select("query_id", "time_frame", "intent", F.array_join("entities", ",").alias("entities"), F.array_join("hints", ",").alias("hints"), "topic")


@query("SELECT query_id, trace FROM trace", "turns", "questions", "cues", "trace")
def mem13_trace_query(spark, sf):
    return M.trace_query(M.extract_cues(_questions(spark, sf))).select("query_id", "trace")


def _seeds(spark, sf):
    """The memories that each query recalls."""
    named, vectors = _named(spark, sf)
    hits = M.recall(_as_queries(named), named, 10, vectors)[0]
    return hits.join(B.memories(spark, sf).select("id", "project_id", "timestamp"), "id").select("query_id", "rank", "id", "project_id", "timestamp")


B.SQL["rec10m"] = B.SQL["rec"].replace("rank <= 5", "rank <= 10")
B.SQL["sd"] = "SELECT query_id, rank, id, project_id, timestamp FROM rec10m JOIN memories USING (id)"
B.SQL["nb"] = """SELECT query_id, id, min(rank * 100 + n) AS pos, min(t) AS timestamp FROM (SELECT s.query_id, s.rank, m.id, m.timestamp AS t, row_number() OVER (PARTITION BY s.query_id, s.rank ORDER BY abs(m.timestamp - s.timestamp), m.id) AS n
    FROM sd s JOIN memories m ON m.project_id = s.project_id AND abs(m.timestamp - s.timestamp) <= 3600 WHERE s.rank <= 3 AND NOT EXISTS (SELECT 1 FROM sd z WHERE z.query_id = s.query_id AND z.id = m.id)) WHERE n <= 5 GROUP BY 1, 2"""


B.SQL["frag"] = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY timestamp, id) AS INTEGER) AS nr, id, role FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM (
    SELECT query_id, id, rank AS pos, timestamp, 'seed' AS role FROM sd UNION ALL SELECT query_id, id, 100 + pos, timestamp, 'neighbour' FROM nb)) WHERE r <= 15"""
FRAG = ("memories", "vectors", "mv", "rec10m", "sd", "nb", "frag")


@query("SELECT query_id, nr, id, role FROM frag", *FRAG)
def mem14_expand_temporal(spark, sf):
    return M.expand_temporal(_seeds(spark, sf), B.memories(spark, sf)).select("query_id", "nr", "id", "role")


B.SQL["digest"] = """SELECT query_id, count(*) AS fragments, md5(string_agg('[' || strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M') || '] ' || content, chr(10) ORDER BY nr)) AS digest_md5,
    round(least(0.3 + 0.05 * count(*), 0.6), 6) AS confidence FROM frag JOIN memories USING (id) GROUP BY 1"""


@query("SELECT * FROM digest", *FRAG, "digest")
def mem15_reconstruct(spark, sf):
    m = B.memories(spark, sf)
    out = M.reconstruct(M.expand_temporal(_seeds(spark, sf), m), m)
    return _round(out.select("query_id", "fragments", F.md5(F.col("digest").cast("binary")).alias("digest_md5"), "confidence"), "confidence")


def _agents(spark, sf):
    return B.read(spark, sf, "events").select(F.col("event_type").alias("agent")).distinct()


@query("SELECT source_agent, array_to_string(target_agents, ',') AS targets, count(*) AS n FROM shared GROUP BY 1, 2", "shared")
def mem16_share(spark, sf):
    open_ = B.shared(spark, sf).withColumn("target_agents", F.lit(None).cast("array<string>"))
    return M.share(open_, _agents(spark, sf)).groupBy("source_agent", F.array_join("target_agents", ",").alias("targets")).agg(F.count("*").alias("n"))


B.SQL["reqs"] = "SELECT agent AS request_id, agent, agent < 'd' AS include_own FROM (SELECT DISTINCT event_type AS agent FROM events)"
B.SQL["acc"] = "SELECT * FROM shared, reqs WHERE CASE WHEN source_agent = agent THEN include_own WHEN access_level = 'public' THEN TRUE WHEN access_level = 'restricted' THEN list_contains(target_agents, agent) ELSE FALSE END"


def _requests(spark, sf):
    return _agents(spark, sf).select(F.col("agent").alias("request_id"), "agent", (F.col("agent") < "d").alias("include_own"))


@query("SELECT request_id, access_level, count(*) AS n FROM acc GROUP BY 1, 2", "shared", "reqs", "acc")
def mem17_accessible(spark, sf):
    return M.accessible(B.shared(spark, sf), _requests(spark, sf)).groupBy("request_id", "access_level").agg(F.count("*").alias("n"))


B.SQL["preqs"] = "SELECT agent || coalesce(p, '') AS request_id, agent, include_own, CAST(p AS BIGINT) AS project_id FROM reqs, (SELECT unnest([NULL, '3', '77']) AS p)"
B.SQL["pacc"] = "SELECT request_id, id, share_time FROM shared s JOIN preqs r ON (r.project_id IS NULL OR r.project_id = s.project_id) WHERE CASE WHEN source_agent = agent THEN include_own WHEN access_level = 'public' THEN TRUE WHEN access_level = 'restricted' THEN list_contains(target_agents, agent) ELSE FALSE END"


@query(
    """SELECT request_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY share_time DESC, id) AS rank FROM pacc) WHERE rank <= 5
    UNION ALL SELECT request_id, CAST(rank AS INTEGER), id FROM (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY importance DESC, id) AS rank FROM preqs JOIN memories ON agent_source = agent)
    WHERE rank <= 5 AND request_id NOT IN (SELECT request_id FROM pacc)""",
    "shared", "reqs", "preqs", "pacc", "memories",
)
def mem18_retrieve_shared(spark, sf):
    """Requests of every agent for all projects, one, and one that there isn't, which falls back to the agent's own weightiest memories."""
    r = _requests(spark, sf).withColumn("p", F.explode(F.array(F.lit(None).cast("string"), F.lit("3"), F.lit("77"))))
    r = r.select(F.concat("agent", F.coalesce("p", F.lit(""))).alias("request_id"), "agent", "include_own", F.col("p").cast("long").alias("project_id"))
    own = B.memories(spark, sf).select("id", F.col("agent_source").alias("agent"), "importance").join(r.select("request_id", "agent"), "agent")
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.col("importance").desc(), "id"))).where("rank <= 5").select("request_id", "rank", "id", F.col("agent").alias("source_agent"))
    return M.retrieve_shared(B.shared(spark, sf), r, 5, own).select("request_id", "rank", "id")


@query(
    """SELECT agent, s AS shared, r AS received, s + r AS traffic FROM (SELECT source_agent AS agent, count(*) AS s FROM shared GROUP BY 1) JOIN (SELECT agent, count(*) AS r FROM (SELECT unnest(target_agents) AS agent FROM shared) GROUP BY 1) USING (agent)""",
    "shared",
)
def mem19_network_stats(spark, sf):
    return M.network_stats(B.shared(spark, sf), _agents(spark, sf))


@query("SELECT count(DISTINCT source_agent) AS total_agents, count(*) AS total_shared_memories FROM shared", "shared")
def mem19_network_totals(spark, sf):
    return M.network_totals(B.shared(spark, sf), _agents(spark, sf))


@query("SELECT project_id, count(*) AS original, count(DISTINCT substr(content, 1, 50)) AS compressed, count(*) - count(DISTINCT substr(content, 1, 50)) AS removed FROM memories GROUP BY 1", "memories")
def mem20_compress(spark, sf):
    return M.compress(B.memories(spark, sf), ["project_id"])


@query(
    """SELECT agent_source, '[合并记忆] ' || substr(string_agg(content, chr(10) || '---' || chr(10) ORDER BY timestamp, id), 1, 500) AS content, round(max(importance), 6) AS importance, count(*) AS merged, first(id ORDER BY timestamp, id) AS first_id,
    first(project_id ORDER BY timestamp, id) AS project_id, round(list_sum(first(vector ORDER BY timestamp, id)), 6) AS vector_sum FROM mv GROUP BY 1""",
    "memories", "vectors", "mv",
)
def mem21_merge_memories(spark, sf):
    out = M.merge_memories(_with_vectors(spark, sf), "agent_source")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("vector_sum")
    return _round(out.select("agent_source", "content", "importance", "merged", "first_id", "project_id", total), "importance", "vector_sum")


@query(
    """SELECT project_id, '[自动摘要] 包含' || max(n) || '条相关记忆' || chr(10) || string_agg(r || '. ' || substr(content, 1, 50) || '...', chr(10) ORDER BY r) AS summary FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY timestamp, id) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM memories) WHERE r <= 3 GROUP BY 1""",
    "memories",
)
def mem22_summarize_group(spark, sf):
    return M.summarize_group(B.memories(spark, sf), "project_id")


@query(f"SELECT id FROM memories WHERE importance < 0.2 AND {AS_OF} - timestamp > 604800", "memories")
def mem23_stale(spark, sf):
    return M.stale(B.memories(spark, sf), AS_OF)


B.SQL["mquestions"] = "SELECT id AS query_id, content AS query FROM mv WHERE id % 50 = 0"
B.SQL["mcues"] = B.SQL["cues"].replace("FROM questions", "FROM mquestions")
B.SQL["mtrace"] = B.SQL["trace"].replace("FROM cues", "FROM mcues")
# neighbours come from memories with vectors here
B.SQL["mnb"] = B.SQL["nb"].replace("JOIN memories m ON", "JOIN mv m ON")
B.SQL["mfrag"] = B.SQL["frag"].replace("FROM nb", "FROM mnb")
B.SQL["mdigest"] = B.SQL["digest"].replace("FROM frag", "FROM mfrag")


@query(
    "SELECT query_id, trace, coalesce(seeds, 0) AS seeds, coalesce(fragments, 0) AS fragments, coalesce(digest_md5, md5('')) AS digest_md5, coalesce(confidence, 0.0) AS confidence FROM mtrace LEFT JOIN (SELECT query_id, count(*) AS seeds FROM rec10m GROUP BY 1) USING (query_id) LEFT JOIN mdigest USING (query_id)",
    "memories", "vectors", "mv", "rec10m", "sd", "mnb", "mfrag", "mdigest", "mquestions", "mcues", "mtrace",
)
def mem24_reconstruct_job(spark, sf):
    named, vectors = _named(spark, sf)
    named = named.join(vectors.select("vector_id"), "vector_id", "left_semi")
    out = M.reconstruct_job(_as_queries(named), named, vectors=vectors)
    return out.select("query_id", "trace", "seeds", "fragments", F.md5(F.col("digest").cast("binary")).alias("digest_md5"), F.round("confidence", 6).alias("confidence"))


@query("SELECT id, timestamp FROM memories WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "memories")
def mem25_get_memories(spark, sf):
    ids = B.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return M.get_memories(B.memories(spark, sf), ids).select("id", "timestamp")

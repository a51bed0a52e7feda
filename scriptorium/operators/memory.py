"""Agent memories: importance, recall, decay, sharing and consolidation, over whole tables.

A memory is (id, content, vector, timestamp, importance, access_count,
memory_type, agent_source, project_id); "now" is always the parameter as_of, in
epoch seconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut_lineage
from .retrieval import vector_search

# Words that make a memory important.
IMPORTANT = ["重要", "关键", "核心", "结论", "发现", "important", "key", "conclusion"]
# Words of recollection, reasoning and time in a query, and their weights.
RECALL_WORDS = ["上次", "之前", "记得", "讨论过", "总结", "回顾", "earlier", "previously", "remember", "discussed", "summarize"]
REASONING_WORDS = ["为什么", "如何", "比较", "区别", "联系", "关系", "分析", "推理", "综合", "对比", "why", "how", "compare", "difference", "relationship", "analyze"]
TEMPORAL_WORDS = ["刚才", "昨天", "上周", "上个月", "今天早些时候", "just now", "yesterday", "last week", "last month", "earlier today"]
WORD_WEIGHTS = {"recall": 0.3, "temporal": 0.25, "reasoning": 0.15}
# Time frames, intents and hints of a query; the first match counts.
TIME_FRAMES = {"today": ["今天", "刚才", "just now", "today", "earlier today"], "this_week": ["这周", "本周", "这几天", "this week"], "last_month": ["上周", "上个月", "前几天", "last week", "last month"]}
INTENTS = {
    "recall_opinion": ["觉得", "认为", "看法", "观点", "opinion", "think"],
    "summarize": ["总结", "概括", "归纳", "summarize", "summary"],
    "compare": ["比较", "对比", "区别", "不同", "compare", "difference"],
}
HINTS = ["上次", "之前", "刚才", "昨天", "前几天", "讨论过", "提到过", "说过", "问过", "earlier", "previously", "last time", "before"]
TOPIC_CUTS = ["^(请问|请|麻烦|帮我|能不能|可以)", r"(是什么|是啥|怎么样|如何|吗|呢|？|\?|。|\.)+$", "(上次|之前|刚才|昨天|今天|这周|上周)", "(总结|概括|回顾|分析|比较)"]


@dataclass(frozen=True)
class Decay:
    rate: float = 0.1
    protection: int = 24 * 3600
    least: float = 0.05
    boost: float = 0.1


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words[1:], F.contains(text, F.lit(words[0])))


def importance(content: Column) -> Column:
    """Half, and up to 0.3 by length, and 0.2 with a word of importance; 1 at most, to two digits."""
    return F.round(F.least(0.5 + F.least(F.length(content) / 1000, F.lit(0.3)) + F.when(_any(F.lower(content), IMPORTANT), 0.2).otherwise(0.0), F.lit(1.0)), 2)


def to_memories(rows: DataFrame, as_of: int, memory_type: str = "dynamic") -> DataFrame:
    """Rows with content (and any of the other columns) as memories; ids are digests of what tells rows apart."""
    have = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    df = rows.withColumns({
        "timestamp": have("timestamp", F.lit(as_of).cast("long")).cast("long"),
        "agent_source": have("agent_source", F.lit("system")),
        "project_id": have("project_id", F.lit(0).cast("long")).cast("long"),
        "importance": have("importance", importance(F.col("content"))).cast("double"),
        "access_count": have("access_count", F.lit(0).cast("long")).cast("long"),
        "memory_type": have("memory_type", F.lit(memory_type)),
    })
    return df.withColumn("id", have("id", F.sha2(F.concat_ws("|", "project_id", "agent_source", "timestamp", "content"), 256)))


def _recall_shared(queries: DataFrame, memories: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Hits of recall, where memories of a project that share a vector are searched as one, and so are queries.

    Of these memories only the k of least id can be among the k nearest; a vector stands where the least of them does.
    """
    by = ["project_id", "vector_id"]
    known = memories.select("id", *by)
    held = known.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("__n") <= k).select("id", *by)
    stand = known.groupBy(*by).agg(F.min("id").alias("paper_id")).join(vectors.select("vector_id", "vector"), "vector_id")
    asked = queries.select(*by).distinct().join(vectors.select("vector_id", "vector"), "vector_id").withColumn("query_id", F.struct(*by))
    near = vector_search(asked, stand.withColumn("chunk_index", F.col("vector_id")), k, same=["project_id"])
    near = near.select(F.col("query_id").alias("asked"), F.col("query_id.project_id").alias("project_id"), F.col("chunk_index").alias("vector_id"), "score")
    first = lambda df, *own: df.withColumn("rank", F.row_number().over(W.partitionBy(*own).orderBy(F.round("score", 9).desc(), "id"))).where(F.col("rank") <= k)
    best = first(near.join(held, by), "asked").select(F.col("asked.project_id").alias("project_id"), F.col("asked.vector_id").alias("vector_id"), "id", "score")
    return first(queries.select("query_id", *by).join(best, by), "query_id").select("query_id", "id", "score", "rank")


def recall(queries: DataFrame, memories: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest memories of each (query_id, vector, project_id) of its project, and the updated access counts.

    vectors: (vector_id, vector), one row each, where queries and memories name their vector by vector_id instead.
    """
    if vectors is not None:
        hits = _recall_shared(queries, memories, vectors, k)
    else:
        known = memories.select(F.col("id").alias("paper_id"), F.lit(0).alias("chunk_index"), "vector", "project_id")
        hits = vector_search(queries, known, k, same=["project_id"]).select("query_id", F.col("paper_id").alias("id"), "score", "rank")
    used = hits.groupBy("id").agg(F.count("*").alias("__n"))
    return hits, memories.join(used, "id").withColumn("access_count", F.col("access_count") + F.col("__n")).select("id", "access_count")


def list_memories(memories: DataFrame, project_id: int | None = None, memory_type: str | None = None, agent: str | None = None, offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page, newest first, and the exact total of what the filters let through."""
    for column, value in (("project_id", project_id), ("memory_type", memory_type), ("agent_source", agent)):
        if value is not None:
            memories = memories.where(F.col(column) == value)
    return memories.orderBy(F.col("timestamp").desc(), "id").offset(offset).limit(limit), memories.agg(F.count("*").alias("total"))


def memory_stats(memories: DataFrame) -> DataFrame:
    """kind (total, type or agent), name and count."""
    sets = memories.groupingSets([["memory_type"], ["agent_source"], []], "memory_type", "agent_source").agg(F.grouping_id().alias("g"), F.count("*").alias("count"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("agent").alias("kind"), F.coalesce("memory_type", "agent_source", F.lit("")).alias("name"), "count")


def get_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_anti")


def decayed(memories: DataFrame, as_of: int, cfg: Decay = Decay()) -> DataFrame:
    """memories with is_protected and decayed: importance after forgetting by age and strengthening by use."""
    age = F.lit(as_of) - F.col("timestamp")
    slower = 86400 * (1 + 0.5 * F.col("access_count"))
    kept = F.col("importance") * F.exp(-cfg.rate * (age - cfg.protection) / slower) + F.least(cfg.boost * F.col("access_count"), F.lit(0.5))
    fresh = age < cfg.protection
    return memories.withColumns({"is_protected": fresh, "decayed": F.when(fresh, F.col("importance")).otherwise(F.greatest(F.least(kept, F.lit(1.0)), F.lit(0.0)))})


def forgetting_pass(memories: DataFrame, as_of: int, cfg: Decay = Decay()) -> DataFrame:
    """memories with decayed and action: protected, forget, decay (changed) or keep."""
    df = decayed(memories, as_of, cfg)
    action = F.when(F.col("is_protected"), "protected").when(F.col("decayed") < cfg.least, "forget").when(F.abs(F.col("decayed") - F.col("importance")) > 1e-9, "decay").otherwise("keep")
    return df.withColumn("action", action)


def forgetting_totals(memories: DataFrame, as_of: int, cfg: Decay = Decay()) -> DataFrame:
    return forgetting_pass(memories, as_of, cfg).groupBy("action").agg(F.count("*").alias("count"))


def cleanup(memories: DataFrame, as_of: int, dry_run: bool = False, cfg: Decay = Decay()) -> DataFrame:
    """What is left without forgotten memories; with dry_run the number of those that would go."""
    gone = forgetting_pass(memories, as_of, cfg).where(F.col("action") == "forget")
    return gone.agg(F.count("*").alias("removed")) if dry_run else delete_memories(memories, gone)


def decay_preview(memories: DataFrame, as_of: int, cfg: Decay = Decay()) -> DataFrame:
    """One row: total, protected, to_forget, and the mean importance before and after."""
    df = decayed(memories, as_of, cfg)
    return df.agg(F.count("*").alias("total"), F.count_if("is_protected").alias("protected"), F.count_if(~F.col("is_protected") & (F.col("decayed") < cfg.least)).alias("to_forget"), F.avg("importance").alias("mean_before"), F.avg("decayed").alias("mean_after"))


def classify_queries(queries: DataFrame) -> DataFrame:
    """queries with matched (words in order), confidence and mode: system_2 from a confidence of 0.3."""
    low = F.lower("query")
    words = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(WORD_WEIGHTS[kind]).alias("x")) for kind, ws in (("recall", RECALL_WORDS), ("reasoning", REASONING_WORDS), ("temporal", TEMPORAL_WORDS)) for w in ws))
    found = F.filter(words, lambda x: F.contains(low, x["w"]))
    df = queries.withColumn("__f", found)
    weighted = F.aggregate("__f", F.lit(0.0), lambda a, x: a + x["x"])
    confidence = F.round(F.when(F.size("__f") == 0, 0.0).otherwise(F.least(F.least(0.25 * F.size("__f"), F.lit(0.5)) + weighted, F.lit(1.0))), 2)
    df = df.withColumns({"matched": F.transform("__f", lambda x: x["w"]), "confidence": confidence})
    return df.withColumn("mode", F.when(F.col("confidence") >= 0.3, "system_2").otherwise("system_1")).drop("__f")


def _first_match(text: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for name, words in reversed(table.items()):
        out = F.when(_any(text, words), name).otherwise(out)
    return out


def extract_cues(queries: DataFrame) -> DataFrame:
    """queries with time_frame, intent, entities, hints and topic."""
    low = F.lower("query")
    quoted = F.regexp_extract_all("query", F.lit("[「」\"'](.*?)[「」\"']"), 1)
    latin = F.filter(F.regexp_extract_all("query", F.lit("([A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z])"), 1), lambda x: F.length(x) >= 2)
    both = F.concat(quoted, latin)
    # the first spelling of each entity stays
    upper = F.transform(both, F.upper)
    entities = F.transform(F.array_distinct(upper), lambda u: F.get(both, (F.array_position(upper, u) - 1).cast("int")))
    topic = F.col("query")
    for cut in TOPIC_CUTS:
        topic = F.regexp_replace(topic, cut, "")
    topic = F.trim(topic)
    topic = F.when(F.length(topic) > 50, F.concat(F.substring(topic, 1, 50), F.lit("..."))).when(topic == "", F.substring("query", 1, 30)).otherwise(topic)
    hints = F.filter(F.array(*map(F.lit, HINTS)), lambda h: F.contains(low, h))
    return queries.withColumns({"time_frame": _first_match(low, TIME_FRAMES, "all_time"), "intent": _first_match(low, INTENTS, "recall_fact"), "entities": entities, "hints": hints, "topic": topic})


def trace_query(cues: DataFrame) -> DataFrame:
    """cues with trace: topic, three entities and two hints."""
    return cues.withColumn("trace", F.concat_ws(" ", "topic", F.slice("entities", 1, 3), F.slice("hints", 1, 2)))


def _nearest_of_bucket(window: int, n: int):
    """For applyInArrow: the n memories of a bucket nearest to each time, ties by id, at most `window` away."""

    def nearest(times, memories):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, at, s = (x.combine_chunks() for x in (memories["id"], memories["timestamp"], times["timestamp"]))
        t, s, m = np.asarray(at), np.asarray(s), len(ids)
        order = lambda *keys: np.asarray(pc.sort_indices(memories, sort_keys=list(keys)), dtype=np.int64)
        onward, back = order(("timestamp", "ascending"), ("id", "ascending")), order(("timestamp", "descending"), ("id", "ascending"))
        by_id = np.empty(m, np.int64)
        by_id[order(("id", "ascending"))] = np.arange(m)
        begin = np.stack([np.searchsorted(t[onward], s, "left"), np.searchsorted(-t[back], -s, "right")], axis=1)
        chosen, sizes, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, 500_000 // n)
        for k in range(0, len(s) if m else 0, steps):
            some = begin[k : k + steps, :, None] + np.arange(n)
            place = np.minimum(some, m - 1)
            place = np.concatenate([onward[place[:, 0]], back[place[:, 1]]], axis=1)
            apart = np.abs(t[place] - s[k : k + steps, None])
            row, column = np.nonzero((some.reshape(len(place), -1) < m) & (apart <= window))
            found = place[row, column]
            by = np.lexsort((by_id[found], apart[row, column], row))
            many = np.bincount(row, minlength=len(place))
            nr = np.arange(len(by)) - np.repeat(np.cumsum(many) - many, many)
            chosen.append(found[by[nr < n]])
            sizes.append(np.minimum(many, n))
        chosen, sizes = np.concatenate(chosen), np.concatenate(sizes) if m else np.zeros(len(s), np.int64)
        ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([x.take(pa.array(chosen)) for x in (ids, at)], names=["id", "timestamp"]))
        return pa.table([times["project_id"], times["timestamp"], near], names=["project_id", "timestamp", "near"])

    return nearest


def _nearest_in_time(times: DataFrame, memories: DataFrame, window: int, n: int) -> DataFrame:
    """near: (id, timestamp) of the n memories nearest to each distinct (project_id, timestamp), ties by id, at most `window` away.

    Times and memories meet in buckets of eight windows; of memories at the same second n count, so that a bucket is
    bounded, and each time looks at n memories either side.
    """
    width = 8 * window
    bucket = lambda t: F.floor(t / width).cast("long")
    known = memories.select("id", "project_id", "timestamp").where("project_id IS NOT NULL AND timestamp IS NOT NULL")
    known = known.withColumn("__n", F.row_number().over(W.partitionBy("project_id", "timestamp").orderBy("id"))).where(F.col("__n") <= n).drop("__n")
    known = known.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("timestamp") - window), bucket(F.col("timestamp") + window)))))
    kinds = dict(known.dtypes)
    schema = f"project_id {dict(times.dtypes)['project_id']}, timestamp {dict(times.dtypes)['timestamp']}, near array<struct<id: {kinds['id']}, timestamp: {kinds['timestamp']}>>"
    # as many partitions as are given: buckets have few bytes
    partitions = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(partitions, "project_id", "bucket").groupBy("project_id", "bucket")
    return dealt(times.withColumn("bucket", bucket(F.col("timestamp")))).cogroup(dealt(known)).applyInArrow(_nearest_of_bucket(window, n), schema)


def expand_temporal(seeds: DataFrame, memories: DataFrame, window: int = 3600, seeds_used: int = 3, per_seed: int = 5, total: int = 15) -> DataFrame:
    """query_id, id, timestamp and role of the seeds and of their neighbours in time, in order of time.

    seeds: (query_id, rank, id, project_id, timestamp), checkpointed. Neighbours lie within
    `window` seconds of one of the first seeds in its project, the nearest first. For each time of a seed as many are
    found as are needed if all seeds of a query are among them; pairs within a window are not made.
    """
    seeds = cut_lineage(seeds.select("query_id", "rank", "id", "project_id", "timestamp"))
    own_ids = seeds.groupBy("query_id").agg(F.collect_list("id").alias("own"))
    most = own_ids.agg(F.max(F.size("own"))).first()[0] or 0
    used = seeds.where((F.col("rank") <= seeds_used) & F.col("project_id").isNotNull() & F.col("timestamp").isNotNull())
    found = _nearest_in_time(used.select("project_id", "timestamp").distinct(), memories, window, per_seed + most)
    others = F.slice(F.filter("near", lambda x: ~F.array_contains("own", x["id"])), 1, per_seed)
    near = used.join(found, ["project_id", "timestamp"]).join(own_ids, "query_id").select("query_id", "rank", F.posexplode(others).alias("__n", "x"))
    near = near.select("query_id", "rank", (F.col("__n") + 1).alias("__n"), F.col("x.id").alias("n_id"), F.col("x.timestamp").alias("n_time"))
    near = near.groupBy("query_id", F.col("n_id").alias("id")).agg(F.min(F.struct("rank", "__n")).alias("at"), F.first("n_time").alias("timestamp"))
    own = seeds.select("query_id", "id", "timestamp", F.lit("seed").alias("role"), F.struct(F.lit(0).alias("rank"), F.col("rank").cast("int").alias("__n")).alias("at"))
    all_ = own.unionByName(near.select("query_id", "id", "timestamp", F.lit("neighbour").alias("role"), F.struct(F.col("at.rank").cast("int").alias("rank"), F.col("at.__n").cast("int").alias("__n")).alias("at")))
    cut = all_.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("__r") <= total)
    return cut.withColumn("nr", F.row_number().over(W.partitionBy("query_id").orderBy("timestamp", "id"))).select("query_id", "nr", "id", "timestamp", "role")


def reconstruct(fragments: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, fragments, digest ("[yyyy-MM-dd HH:mm] text" in order of time) and confidence."""
    line = F.concat(F.lit("["), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("content"))
    rows = fragments.join(memories.select("id", "content"), "id").select("query_id", "nr", line.alias("line"))
    out = rows.groupBy("query_id").agg(F.count("*").alias("fragments"), F.array_sort(F.collect_list(F.struct("nr", "line"))).alias("x"))
    return out.select("query_id", "fragments", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("digest"), F.least(0.3 + 0.05 * F.col("fragments"), F.lit(0.6)).alias("confidence"))


def reconstruct_job(queries: DataFrame, memories: DataFrame, seeds: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """Cue, seeds, neighbours and digest of each (query_id, query, vector, project_id). vectors: as in recall."""
    hits = cut_lineage(recall(queries, memories, seeds, vectors)[0])
    found = hits.join(memories.select("id", "project_id", "timestamp"), "id")
    digest = reconstruct(expand_temporal(found, memories), memories)
    counts = hits.groupBy("query_id").agg(F.count("*").alias("seeds"))
    cues = trace_query(extract_cues(queries)).select("query_id", "trace", "intent", "time_frame")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return cues.join(counts, "query_id", "left").join(digest, "query_id", "left").select("query_id", "trace", "intent", "time_frame", zero("seeds", 0), zero("fragments", 0), zero("digest", ""), zero("confidence", 0.0))


def share(memories: DataFrame, agents: DataFrame) -> DataFrame:
    """memories with target_agents: those given, else all other agents. agents: a registry of a few rows."""
    everyone = agents.agg(F.sort_array(F.collect_set("agent"))).scalar()
    others = F.array_remove(everyone, F.col("source_agent"))
    return memories.withColumn("target_agents", F.coalesce("target_agents", others))


def accessible(shared: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, shared row) pairs that the rules allow: own if asked for, public, restricted to targets.

    Own and targeted rows meet requests by agent; public ones meet all of them, as all
    of these pairs are in the answer. Nothing else is paired.
    """
    asked = requests.select("request_id", "agent", "include_own")
    own = shared.join(asked.where("include_own"), F.col("source_agent") == F.col("agent"))
    others = ~F.col("source_agent").eqNullSafe(F.col("agent"))
    public = shared.where(F.col("access_level") == "public").crossJoin(asked).where(others)
    limited = shared.where(F.col("access_level") == "restricted").withColumn("__to", F.explode(F.array_distinct("target_agents")))
    limited = limited.join(asked, F.col("__to") == F.col("agent")).where(others).drop("__to")
    return own.unionByName(public).unionByName(limited)


def retrieve_shared(shared: DataFrame, requests: DataFrame, k: int = 5, recalled: DataFrame | None = None) -> DataFrame:
    """request_id, rank, id and source_agent of the k last shared memories that each request may see.

    A request with a project_id sees that project's memories. Nothing is paired with all requests: of each source's
    public memories the last k count, and of those the last 2k, whoever asks (one source has k of them at most); of
    restricted ones the last k for each target, of own ones the last k of the source. recalled: (request_id, rank, id,
    source_agent) for requests that see none.
    """
    if "project_id" not in shared.columns:
        shared = shared.withColumn("project_id", F.lit(None).cast("long"))
    wide = lambda df: df.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce(F.col("project_id").cast("string"), F.lit("*"))))))
    rows = wide(shared.select("id", "source_agent", "access_level", "share_time", "target_agents", "project_id")).drop("project_id")
    order = [F.col("share_time").desc(), F.col("id")]
    last = lambda df, n, *by: df.withColumn("__n", F.row_number().over(W.partitionBy("scope", *by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
    project = F.col("project_id").cast("string") if "project_id" in requests.columns else F.lit(None)
    asked = requests.select("request_id", "agent", "include_own", F.coalesce(project, F.lit("*")).alias("scope"))
    keep, others = ["request_id", "id", "source_agent", "share_time"], ~F.col("source_agent").eqNullSafe(F.col("agent"))
    public = last(last(rows.where("access_level = 'public'"), k, "source_agent"), 2 * k)
    limited = rows.where("access_level = 'restricted'").withColumn("agent", F.explode(F.array_distinct("target_agents"))).where(others)
    own = last(rows.withColumn("agent", F.col("source_agent")), k, "agent")
    found = asked.join(public, "scope").where(others).select(keep)
    found = found.unionByName(asked.join(last(limited, k, "agent"), ["scope", "agent"]).select(keep)).unionByName(asked.where("include_own").join(own, ["scope", "agent"]).select(keep))
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(*order))).where(F.col("rank") <= k).select("request_id", "rank", "id", "source_agent")
    if recalled is None:
        return best
    blind = requests.select("request_id").join(best.select("request_id").distinct(), "request_id", "left_anti")
    return best.unionByName(recalled.where(F.col("rank") <= k).join(blind, "request_id", "left_semi").select(best.columns))


def network_stats(shared: DataFrame, agents: DataFrame) -> DataFrame:
    """agent, shared, received and traffic."""
    sent = shared.groupBy(F.col("source_agent").alias("agent")).agg(F.count("*").alias("shared"))
    got = shared.select(F.explode("target_agents").alias("agent")).groupBy("agent").agg(F.count("*").alias("received"))
    df = agents.select("agent").join(sent, "agent", "full").join(got, "agent", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return df.select("agent", zero("shared").alias("shared"), zero("received").alias("received"), (zero("shared") + zero("received")).alias("traffic"))


def network_totals(shared: DataFrame, agents: DataFrame) -> DataFrame:
    """total_agents and total_shared_memories of the whole network; one row."""
    return agents.agg(F.count_distinct("agent").alias("total_agents")).join(F.broadcast(shared.agg(F.count("*").alias("total_shared_memories"))))


def compress(memories: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, original, compressed and removed: how many memories differ in their first 50 characters."""
    by = by or []
    heads = memories.groupBy(*by, F.substring("content", 1, 50).alias("head")).agg(F.count("*").alias("n"))
    return heads.groupBy(*by).agg(F.sum("n").alias("original"), F.count("*").alias("compressed"), (F.sum("n") - F.count("*")).alias("removed"))


def compressed(memories: DataFrame) -> DataFrame:
    """The first memory (by time, then id) of each beginning."""
    order = W.partitionBy(F.substring("content", 1, 50)).orderBy("timestamp", "id")
    return memories.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_of(memories: DataFrame, group: str, k: int, parts: int = 64) -> DataFrame:
    """The first k memories of each group by time, then id, with their number __n: first those of each of some parts, then of these."""
    order = [F.col("timestamp"), F.col("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    some = memories.withColumn("__part", part).withColumn("__n", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order))).where(F.col("__n") <= k)
    return some.drop("__part").withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__n") <= k)


def merge_memories(memories: DataFrame, group: str) -> DataFrame:
    """One memory a group: contents joined and cut at 500 characters, the highest importance, the first one's id, and its project and vector where there are such columns."""
    # no more than 500 characters of at most 500 memories can show in the result
    head = first_of(memories, group, 500)
    text = head.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__n", F.substring("content", 1, 500).alias("c")))).alias("x"))
    text = text.select(group, F.concat(F.lit("[合并记忆] "), F.substring(F.array_join(F.transform("x", lambda r: r["c"]), "\n---\n"), 1, 500)).alias("content"))
    rest = memories.groupBy(group).agg(F.max("importance").alias("importance"), F.count("*").alias("merged"))
    own = [F.col(c) for c in ("project_id", "vector") if c in memories.columns and c != group]
    return text.join(rest, group).join(first_of(memories, group, 1).select(group, F.col("id").alias("first_id"), *own), group).withColumn("memory_type", F.lit("consolidated"))


def summarize_group(memories: DataFrame, group: str) -> DataFrame:
    """group and summary: the number of memories and the beginnings of the first three."""
    head = first_of(memories, group, 3)
    line = F.concat(F.col("__n"), F.lit(". "), F.substring("content", 1, 50), F.lit("..."))
    first = head.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))).alias("x"))
    counts = memories.groupBy(group).agg(F.count("*").alias("n"))
    return first.join(counts, group).select(group, F.concat(F.lit("[自动摘要] 包含"), F.col("n"), F.lit("条相关记忆\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("summary"))


def stale(memories: DataFrame, as_of: int, least: float = 0.2, age: int = 7 * 24 * 3600) -> DataFrame:
    return memories.where((F.col("importance") < least) & (F.lit(as_of) - F.col("timestamp") > age)).select("id")

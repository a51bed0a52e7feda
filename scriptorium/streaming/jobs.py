"""Structured Streaming jobs: ingest, splitting of reasoning, assembly of answers, consolidation, repeat requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.memory import to_memories
from ..operators.metadata import process_papers
from ..sources.stores import committed, compact, read_versioned, to_vector_rows, vacuum, write_versioned
from ..sources.works import PARSED

OPEN, CLOSE = "<think>", "</think>"
#: Parts in which a project's memories are counted, and batches after which their stores are compacted.
PARTS, KEEP = 16, 50
#: Milliseconds after which a stream without new rows has ended.
IDLE = 600_000


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str):
    """New parsed documents become papers, children and parents of a versioned store (see sources.stores).

    Each batch first notes its papers as processing, then commits all tables at once: a batch that dies half way
    leaves what was there, and its rerun gives what one run would have. Of a paper that comes twice in a batch the
    one of the latest file counts. Papers without text are stored as failed, without chunks, and lose those they
    had; lines that are no JSON or have no paper_id are kept in the folder `rejected`.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        known = F.col("paper_id").isNotNull() & F.col("_corrupt_record").isNull()
        line = F.coalesce("_corrupt_record", F.to_json(F.struct(*[c for c in df.columns if c not in ("__file", "_corrupt_record")])))
        df.where(~known).select(line.alias("line")).write.mode("overwrite").text(f"{store}/rejected/batch={batch_id}")
        order = W.partitionBy("paper_id").orderBy(F.col("__file.t").desc(), F.col("__file.n").desc(), F.xxhash64("markdown"))
        docs = df.where(known).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__file", "_corrupt_record")
        docs = docs.withColumn("project_id", F.coalesce("project_id", F.lit(0))).persist()
        _note(docs, store, "processing", f"batch-{batch_id}")
        held: list[DataFrame] = [df, docs]
        papers, children, parents = process_papers(docs, lambda t: held.append(t.persist()) or t)
        owner = docs.select("paper_id", "project_id", "parser_version", "elapsed_ms")
        rows = to_vector_rows(children.withColumnRenamed("child_seq", "chunk_index").join(owner.select("paper_id", "project_id"), "paper_id"))
        papers = papers.join(owner, "paper_id").withColumns({"batch": F.lit(batch_id), "at": F.current_timestamp()})
        write_versioned({"children": rows, "parents": parents, "papers": papers}, docs.select("paper_id"), store)
        for t in held:
            t.unpersist()

    stream = spark.readStream.schema(PARSED + ", _corrupt_record string").json(source)
    stream = stream.withColumn("__file", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("n")))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _note(papers: DataFrame, store: str, status: str, name: str) -> None:
    papers.select("paper_id", F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{store}/journal/{name}-{status}")


def request_again(papers: DataFrame, store: str, name: str) -> None:
    """Papers (paper_id) that are to be processed anew: pending, without what the store held of them. name: of the request."""
    papers = papers.select("paper_id").distinct()
    _note(papers, store, "pending", name)
    write_versioned({}, papers, store)


def paper_status(spark: SparkSession, store: str) -> DataFrame:
    """paper_id, status (pending, processing, completed or failed) and at: the latest of what the store and its journal know."""
    notes = spark.read.option("recursiveFileLookup", True).schema("paper_id long, status string, at timestamp").parquet(f"{store}/journal")
    try:
        notes = notes.unionByName(read_versioned(spark, store, "papers").select("paper_id", "status", "at"))
    except FileNotFoundError:  # no batch has been committed yet
        pass
    return notes.groupBy("paper_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def split_text(text: str, inside: bool) -> tuple[str, str, str, bool]:
    """(reasoning, answer, rest, inside) of buffered text; rest may be the beginning of a tag."""
    out = {True: "", False: ""}
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at >= 0:
            out[inside] += text[:at]
            text, inside = text[at + len(tag) :], not inside
            continue
        keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
        out[inside] += text[: len(text) - keep]
        return out[True], out[False], text[len(text) - keep :], inside


def _wait(handle: StatefulProcessorHandle, timers, idle: int) -> None:
    """The key's only timer, `idle` milliseconds from now."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if idle:
        handle.registerTimer(timers.getCurrentProcessingTimeInMs() + idle)


class ReasoningSplitter(StatefulProcessor):
    """Keeps of each stream what may be half a tag, and on which side of one it is, until it ends or falls silent."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("rest", StringType()), StructField("inside", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, inside = self.state.get() if self.state.exists() else ("", False)
        reasoning, answer, done = "", "", False
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            a, b, rest, inside = split_text(rest + (r.text or ""), inside)
            reasoning, answer = reasoning + a, answer + b
            done = done or bool(r.last)
        if done:  # what is left was no tag
            reasoning, answer = (reasoning + rest, answer) if inside else (reasoning, answer + rest)
            self.state.clear()
        else:
            self.state.update((rest, inside))
        _wait(self.handle, timerValues, 0 if done else self.idle)
        yield pd.DataFrame({"stream_id": [key[0]], "reasoning": [reasoning], "answer": [answer], "done": [done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            rest, inside = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"stream_id": [key[0]], "reasoning": [rest if inside else ""], "answer": ["" if inside else rest], "done": [True]})

    def close(self) -> None:
        pass


def split_reasoning(stream: DataFrame, idle: int = IDLE) -> DataFrame:
    """(stream_id, seq, text, last) to (stream_id, reasoning, answer, done), one row a stream and batch; tags may be cut.

    A stream without new rows for `idle` milliseconds ends: the next batch emits what is left of it. Nothing is
    kept of a stream that has ended; rows that come later begin a new one. Timers need a query that keeps running:
    with them, one that is started for what is available doesn't end by itself.
    """
    schema = StructType([StructField("stream_id", LongType()), StructField("reasoning", StringType()), StructField("answer", StringType()), StructField("done", BooleanType())])
    return stream.groupBy("stream_id").transformWithStateInPandas(ReasoningSplitter(idle), schema, "Append", "ProcessingTime")


def split_reasoning_batch(chunks: DataFrame) -> DataFrame:
    """The same for a finished table of chunks, by one expression."""
    whole = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")).select("stream_id", F.array_join(F.transform("x", lambda r: r["text"]), "").alias("t"))
    inner = F.regexp_extract_all("t", F.lit(r"(?s)<think>(.*?)(?:</think>|\z)"), 1)
    return whole.select("stream_id", F.array_join(inner, "").alias("reasoning"), F.regexp_replace("t", r"(?s)<think>.*?(?:</think>|\z)", "").alias("answer"))


def memory_stream(events: DataFrame, as_of: int) -> DataFrame:
    """Question and answer events as memories; stateless, so it appends."""
    return to_memories(events, as_of)


class AnswerAssembler(StatefulProcessor):
    """Collects references and chunks of a stream until it is done or falls silent."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("references", StringType()), StructField("text", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        references, text = self.state.get() if self.state.exists() else ("", "")
        done = False
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.type == "references":
                references = r.data
            elif r.type == "chunk":
                text += r.data
            done = done or r.type == "done"
        _wait(self.handle, timerValues, 0 if done else self.idle)
        if done:
            self.state.clear()
            yield pd.DataFrame({"stream_id": [key[0]], "references": [references], "answer": [text], "complete": [True]})
        else:
            self.state.update((references, text))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            references, text = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"stream_id": [key[0]], "references": [references], "answer": [text], "complete": [False]})

    def close(self) -> None:
        pass


def assemble_answers(stream: DataFrame, idle: int = IDLE) -> DataFrame:
    """(stream_id, seq, type, data) to (stream_id, references, answer, complete), once a stream is done.

    One without new events for `idle` milliseconds is emitted as it is, not complete; nothing is kept of either. As for
    split_reasoning, the query has to keep running.
    """
    schema = StructType([StructField("stream_id", LongType()), StructField("references", StringType()), StructField("answer", StringType()), StructField("complete", BooleanType())])
    return stream.groupBy("stream_id").transformWithStateInPandas(AnswerAssembler(idle), schema, "Append", "ProcessingTime")


def assemble_answers_batch(events: DataFrame) -> DataFrame:
    """The same for a finished table; streams that aren't done are left out."""
    parts = events.groupBy("stream_id").agg(
        F.max_by(F.when(F.col("type") == "references", F.col("data")), F.when(F.col("type") == "references", F.col("seq"))).alias("references"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "data")))).alias("x"), F.bool_or(F.col("type") == "done").alias("done"),
    )
    return parts.where("done").select("stream_id", F.coalesce("references", F.lit("")).alias("references"), F.array_join(F.transform("x", lambda r: r["data"]), "").alias("answer"))


class MemoryCounts(StatefulProcessor):
    """Of a part of a project's memories: how many, how many different beginnings, and the first three."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, heads long, first string")
        self.heads = handle.getMapState("heads", "head string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, heads, first = self.counts.get() if self.counts.exists() else (0, 0, "[]")
        first = json.loads(first)
        for some in rows:
            n += len(some)
            for head in some["head"].unique():
                if not self.heads.containsKey((head,)):
                    self.heads.updateValue((head,), (True,))
                    heads += 1
            first = sorted(first + some[["timestamp", "id", "head"]].sort_values(["timestamp", "id"]).head(3).values.tolist())[:3]
        self.counts.update((n, heads, json.dumps(first)))
        yield pd.DataFrame({"project_id": [key[0]], "part": [key[1]], "n": [n], "heads": [heads], "first": [json.dumps(first)]})

    def close(self) -> None:
        pass


def consolidate_stream(stream: DataFrame, store: str, checkpoint: str, threshold: int = 20):
    """Compression counts and summary of each project (project_id, id, timestamp, content) with `threshold` memories or more.

    What is known of a project is keyed state, in PARTS parts by the memories' beginnings, so that a large project
    isn't one task's; a batch touches the state of its own projects and reads no memory again. The tables parts and
    summaries of the versioned store have the last row of each; every KEEP batches the store is compacted.
    """
    head = F.substring(F.coalesce("content", F.lit("")), 1, 50)
    rows = stream.select(F.coalesce("project_id", F.lit(0)).cast("long").alias("project_id"), F.col("id").cast("string").alias("id"), F.col("timestamp").cast("long").alias("timestamp"), head.alias("head"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("head"), F.lit(PARTS)).cast("int"))
    schema = StructType([StructField("project_id", LongType()), StructField("part", IntegerType()), StructField("n", LongType()), StructField("heads", LongType()), StructField("first", StringType())])
    counted = rows.groupBy("project_id", "part").transformWithStateInPandas(MemoryCounts(), schema, "Update", "None")

    def batch(df: DataFrame, batch_id: int) -> None:
        spark, parts, out = df.sparkSession, f"{store}/parts", f"{store}/summaries"
        df = df.persist()
        write_versioned({"rows": df}, df.select("project_id", "part"), parts)
        own = read_versioned(spark, parts, "rows").join(df.select("project_id").distinct(), "project_id", "left_semi")
        items = F.flatten(F.collect_list(F.from_json("first", "array<array<string>>")))
        sums = own.groupBy("project_id").agg(F.sum("n").alias("original"), F.sum("heads").alias("compressed"), items.alias("x")).where(F.col("original") >= threshold)
        first = F.slice(F.array_sort(F.transform("x", lambda r: F.struct(r[0].cast("long").alias("t"), r[1].alias("id"), r[2].alias("head")))), 1, 3)
        lines = F.transform(first, lambda r, k: F.concat((k + 1).cast("string"), F.lit(". "), r["head"], F.lit("...")))
        summary = F.concat(F.lit("[自动摘要] 包含"), F.col("original"), F.lit("条相关记忆\n"), F.array_join(lines, "\n"))
        made = sums.select("project_id", "original", "compressed", (F.col("original") - F.col("compressed")).alias("removed"), summary.alias("summary"))
        write_versioned({"rows": made}, df.select("project_id"), out)
        for path in (parts, out):
            if len(committed(spark, path)) > KEEP:
                vacuum(spark, path, compact(spark, path))
        df.unpersist()

    return counted.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summaries(spark: SparkSession, store: str) -> DataFrame:
    return read_versioned(spark, f"{store}/summaries", "rows")


def dedupe_requests(stream: DataFrame, life: str = "300 seconds", at: str = "ts", key: list[str] | None = None) -> DataFrame:
    """Requests without repeats within `life`; later ones than that after the latest seen are late and go."""
    return stream.withWatermark(at, life).dropDuplicatesWithinWatermark(key or ["request"])

"""User functions: a registry, a result envelope, and hooks for embedding and reranking."""

from __future__ import annotations

import json
import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Registered:
    name: str
    description: str
    input_schema: str
    category: str
    timeout: float
    return_type: str
    kind: str = "column"


_functions: dict[str, Registered] = {}


@contextmanager
def limited(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in the block once it has run so long. Workers run functions in their main thread, which the alarm interrupts."""
    if not seconds:
        yield
        return

    def late(signum, frame):
        raise TimeoutError(f"not done after {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def register(spark: SparkSession, name: str, fn: Callable, return_type: str, description: str = "", input_schema: dict | None = None, category: str = "general", timeout: float = 60.0) -> None:
    """Makes fn (a function of pandas series) known to SQL under a name, with what describes it; a batch has `timeout` seconds."""

    def run(*columns: pd.Series) -> pd.Series:
        with limited(timeout):
            return fn(*columns)

    spark.udf.register(name, F.pandas_udf(run, return_type, F.PandasUDFType.SCALAR))
    _functions[name] = Registered(name, description, json.dumps(input_schema or {}), category, float(timeout), return_type)


def register_table(spark: SparkSession, name: str, fn: Callable, return_type: str, description: str = "", input_schema: dict | None = None, category: str = "general", timeout: float = 60.0) -> None:
    """Makes fn (a function of values that yields rows) known to SQL as a table function; a call has `timeout` seconds."""

    class Rows:
        def eval(self, *values):
            with limited(timeout):
                yield from list(fn(*values))

    spark.udtf.register(name, F.udtf(Rows, returnType=return_type))
    _functions[name] = Registered(name, description, json.dumps(input_schema or {}), category, float(timeout), return_type, "table")


def list_functions(spark: SparkSession, category: str | None = None) -> DataFrame:
    rows = [tuple(vars(x).values()) for x in _functions.values() if category in (None, x.category)]
    return spark.createDataFrame(rows, "name string, description string, input_schema string, category string, timeout double, return_type string, kind string").orderBy("name")


def safe_udf(fn: Callable, return_type: str, timeout: float | None = None, batch_timeout: float | None = None):
    """A function of one value as a column function that returns (success, data, error): a failing row fails alone.

    A value has `timeout` seconds, a batch `batch_timeout`; values that a batch has no time left for fail without being tried.
    """

    def run(values: pd.Series) -> pd.DataFrame:
        rows, end = [], time.monotonic() + batch_timeout if batch_timeout else None
        for v in values:
            try:
                left = [x for x in (timeout, end and end - time.monotonic()) if x is not None]
                if left and min(left) <= 0:
                    raise TimeoutError(f"the batch was not done after {batch_timeout} s")
                with limited(min(left, default=None)):
                    rows.append((True, fn(v), None))
            except Exception as e:  # the envelope is there to hold whatever went wrong
                rows.append((False, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["success", "data", "error"])

    return F.pandas_udf(run, f"success boolean, data {return_type}, error string")


def hashing_embed(df: DataFrame, text: str = "text", dimensions: int = 256) -> DataFrame:
    """df with vector: hashed word counts of unit length; the same text has the same vector anywhere."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__w", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), 0))
    hashed = HashingTF(numFeatures=dimensions, inputCol="__w", outputCol="__h").transform(words)
    return Normalizer(inputCol="__h", outputCol="__v").transform(hashed).withColumn("vector", vector_to_array("__v")).drop("__w", "__h", "__v")


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
    """df with vector by a function of many texts at once; by hashing if none is given."""
    if embedder is None:
        return hashing_embed(df, text)

    def run(batches):
        for values in batches:
            texts = values.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in embedder(texts[k : k + batch])])

    run.__annotations__ = {}
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vector", F.pandas_udf(run, "array<double>")(text))


def rerank(hits: DataFrame, scorer: Callable[[str, list[str]], list[int]]) -> DataFrame:
    """(query_id, order_text) by a function of a query and its candidates' texts; a search's few candidates are one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]], "order_text": [json.dumps([int(k) for k in scorer(group["query"].iloc[0], group["text"].tolist())])]})

    schema = StructType().add("query_id", hits.schema["query_id"].dataType).add("order_text", "string")
    return hits.select("query_id", "query", "rank", "text").groupBy("query_id").applyInPandas(run, schema)

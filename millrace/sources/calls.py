"""Rows from services: paged searches, and one answer a row. The service is a function of the caller's, so tests replay it.

Functions run on executors in Arrow batches. A call is tried again after a growing pause; what still fails is a row with its error,
so that one bad answer does not cost the others, and an append-and-resume job asks for it again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_description
from millrace.operators.joins import resume


def attempted(call: Callable[[], Any], tries: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str | None]:
    """(answer, None), or (None, error) after `tries` failures with pauses of pause * 2^k and up to as much again at random."""
    error = None
    for k in range(tries):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  the caller's service may raise anything
            error = f"{type(e).__name__}: {e}"[:500]
            if k + 1 < tries:
                sleep(pause * 2**k * (1 + random.random()))
    return None, error


def answers(rows: DataFrame, key: str, request: str, ask: Callable[[str], str], tries: int = 6, pause: float = 1.0) -> DataFrame:
    """(key, answer, error) of each row: ask(request) or why there is no answer. A null request is an error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [attempted(lambda r=r: ask(r), tries, pause) if isinstance(r, str) else (None, "no request") for r in b[request]]
            yield pd.DataFrame({key: b[key], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return rows.select(key, request).mapInPandas(run, f"`{key}` {kind}, answer string, error string")


def paged(queries: DataFrame, query: str, fetch: Callable[[str, int], list[dict]], schema: str, size: int, most: int = 10, tries: int = 6, pause: float = 1.0) -> DataFrame:
    """(query, columns of schema) of all results of each query: fetch(query, page), pages from 1, until one has fewer than size results or
    `most` pages are read, which is the service's own limit. A page that cannot be had fails the query."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q in b[query]:
                for page in range(1, most + 1):
                    found, error = attempted(lambda q=q, page=page: fetch(q, page), tries, pause)
                    if error:
                        raise RuntimeError(f"page {page} of {q!r}: {error}")
                    yield pd.DataFrame([[q, *(r.get(n) for n in names)] for r in found], columns=[query, *names])
                    if len(found) < size:
                        break

    return queries.select(query).mapInPandas(run, f"`{query}` string, {schema}")


def descriptions(rows: DataFrame, done: DataFrame, key: str, source: str, name: str, ask: Callable[[str], str], tries: int = 6, pause: float = 1.0) -> DataFrame:
    """(key, text, error) for the keys of rows that `done` (key, text, error) has no healthy text of. Rows with one source and name are
    asked once, about the least of their keys, and share the cleaned answer."""
    todo = resume(rows, done, key, F.col("error").isNull() & F.col("text").isNotNull())
    firsts = todo.groupBy(source, name).agg(F.min(key).alias("_first"))
    prompt = F.concat_ws("\n", name, source)
    said = answers(firsts.select("_first", prompt.alias("_request")), "_first", "_request", ask, tries, pause)
    texts = firsts.join(said, "_first").select(F.col(source).alias("_s"), F.col(name).alias("_n"), clean_description(F.col("answer")).alias("text"), "error")
    out = todo.join(texts, F.col(source).eqNullSafe(F.col("_s")) & F.col(name).eqNullSafe(F.col("_n")))
    return out.select(key, "text", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("empty answer"))).alias("error"))

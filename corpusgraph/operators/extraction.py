"""Triples extracted from articles by a model, as a map over a table.

The model is an injected ``Extractor``. Every article gives one row of one result table; triples, usage, failures,
truncations and the state of a run are read off that table, so they can't disagree, and a run that is taken up again
leaves out what the table holds as done. Calls are paid for: the result is kept before anything is read off it, and the
number of partitions bounds how many calls run at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.model_output import answer_triples
from corpusgraph.functions.prompts import input_text, user_prompt
from corpusgraph.functions.text import text_or_none

#: Characters of input, tries for a broken answer, tries and seconds between them for a refused call.
MAX_CHARS, CONTENT_TRIES, QUOTA_TRIES, QUOTA_WAIT = 8000, 3, 3, 2.0
RESULT = "pmid string, place bigint, status string, error string, triples array<string>, completion_tokens bigint, prompt_tokens bigint, total_tokens bigint, tries int"


class QuotaError(Exception):
    """The service refused a call for its rate or quota."""


@dataclass(frozen=True)
class Answer:
    text: str
    completion_tokens: int | None = None
    prompt_tokens: int | None = None
    total_tokens: int | None = None


class Extractor(Protocol):
    """What calls a model. It is sent to the workers, so it must pickle; secrets come from the workers' environment."""

    def __call__(self, system: str, user: str) -> Answer: ...


class StubExtractor:
    """A model for tests and dry runs: the same text always gives the same single triple of its first and last word."""

    def __call__(self, system: str, user: str) -> Answer:
        words = user.partition("{")[2].rpartition("}")[0].split() or [""]
        triple = {"head": words[0], "head_type": "protein", "relation": "associated_with", "tail": words[-1], "tail_type": "disease", "source_sentence": " ".join(words[:8]), "score": 50}
        return Answer(json.dumps([triple]), len(words), len(user), len(words) + len(user))


@dataclass(frozen=True)
class Retry:
    """When to call again: a broken answer after doubling waits, a refused call after equal ones."""

    content_tries: int = CONTENT_TRIES
    quota_tries: int = QUOTA_TRIES
    wait: float = 1.0
    quota_wait: float = QUOTA_WAIT
    sleep: Callable[[float], None] = time.sleep

    def call(self, extractor: Extractor, system: str, user: str) -> tuple[Answer | None, list[str] | None, str | None, int]:
        """(answer, triples, error, tries)."""
        error, calls = "", 0
        for turn in range(self.content_tries):
            if turn:
                self.sleep(max(1.0, self.wait) * 2 ** (turn - 1))
            for refusal in range(self.quota_tries):
                calls += 1
                try:
                    answer = extractor(system, user)
                    break
                except QuotaError as e:
                    error = f"quota: {e}"
                    if refusal + 1 == self.quota_tries:
                        return None, None, error, calls
                    self.sleep(self.quota_wait)
            try:
                return answer, [json.dumps(t, ensure_ascii=False) for t in answer_triples(answer.text)], None, calls
            except ValueError as e:
                error = str(e)
        return None, None, error, calls


def tasks(articles: DataFrame, key: str, title: str, abstract: str, place: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(pmid, place, input_text, original_len, is_truncated): what is to be asked for each article.

    An article without a key is called ``missing_pmid_`` and its place. Lengths are in code points.
    """
    pmid = text_or_none("literal", F.col(key))
    whole = input_text(F.col(title), F.col(abstract))
    shown = articles.select(pmid.alias("pmid"), F.col(place).alias("place"), whole.alias("whole"))
    return shown.select(
        F.when(F.col("pmid") == "", F.concat(F.lit("missing_pmid_"), F.col("place"))).otherwise(F.col("pmid")).alias("pmid"),
        "place",
        F.substring("whole", 1, max_chars).alias("input_text"),
        F.length("whole").cast("bigint").alias("original_len"),
        (F.length("whole") > max_chars).alias("is_truncated"),
    )


def pending(todo: DataFrame, done: DataFrame, key: str = "pmid") -> DataFrame:
    """The tasks whose key is not among the successes; failures are tried again, repeats inside the input stay."""
    finished = done.select(text_or_none("empty", F.col(key)).alias("pmid")).where("pmid != ''").distinct()
    return todo.join(finished, "pmid", "left_anti")


def extract(todo: DataFrame, extractor: Extractor, system: str, at_once: int | None = None, retry: Retry | None = None) -> DataFrame:
    """One row of ``RESULT`` for every task. Lazy: keep it, or write it, before reading anything off it.

    ``at_once`` bounds how many calls run side by side; without it there are as many as the cluster has cores.
    """
    retry = retry or Retry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pmid, place, prompt in batch.itertuples(index=False, name=None):
                answer, triples, error, tries = retry.call(extractor, system, prompt)
                counts = (answer.completion_tokens, answer.prompt_tokens, answer.total_tokens) if answer else (None,) * 3
                rows.append((pmid, place, "success" if error is None else "failed", error, triples, *counts, tries))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({c: "Int64" for c in ("completion_tokens", "prompt_tokens", "total_tokens")})

    asked = todo.select("pmid", "place", user_prompt(F.col("input_text")).alias("prompt"))
    return asked.repartition(at_once or todo.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, RESULT)


def triples(results: DataFrame) -> DataFrame:
    """(pmid, place, nth, raw) of every triple; the article's key goes into ``raw`` unless the model gave one."""
    rows = results.where("status = 'success'").select("pmid", "place", F.posexplode("triples").alias("nth", "triple"))
    quoted = F.expr("substr(to_json(array(pmid)), 2, length(to_json(array(pmid))) - 2)")
    rest = F.when(F.col("triple") == "{}", "}").otherwise(F.concat(F.lit(", "), F.expr("substr(triple, 2)")))
    with_key = F.concat(F.lit('{"PMID": '), quoted, rest)
    own = F.get_json_object("triple", "$.PMID").isNotNull()
    return rows.select("pmid", "place", "nth", F.when(own, F.col("triple")).otherwise(with_key).alias("raw"))


def usage(results: DataFrame, stamp: Column | None = None) -> DataFrame:
    """The usage row of every success; a count that is absent is 0."""
    at = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("completion_tokens", "prompt_tokens", "total_tokens")]
    return results.where("status = 'success'").select("pmid", *counts, at.alias("timestamp"))


def failures(results: DataFrame, stamp: Column | None = None) -> DataFrame:
    at = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return results.where("status = 'failed'").select("pmid", F.col("error").alias("error_reason"), at.alias("timestamp"))


def truncations(todo: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    return todo.where("is_truncated").select("pmid", "original_len", F.lit(max_chars).cast("bigint").alias("truncated_len"))


def state(results: DataFrame) -> DataFrame:
    """(pmid) of what need not be asked again."""
    return results.where("status = 'success'").select("pmid").distinct()


def run_counts(todo: DataFrame, asked: DataFrame, results: DataFrame) -> DataFrame:
    """One row: all tasks, those skipped as done, successes, failures, triples, truncated inputs."""
    a = todo.agg(F.count("*").alias("total"))
    b = asked.agg(F.count("*").alias("asked"), F.count_if("is_truncated").alias("truncated"))
    c = results.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.size("triples"))), F.lit(0)).cast("bigint").alias("triples"))
    return a.crossJoin(b).crossJoin(c).select("total", (F.col("total") - F.col("asked")).alias("skipped"), "success", "failed", "triples", "truncated")

"""Models behind an HTTP interface, and the runs that use them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import api_answer, last_answer_list
from .staged import generated, run_staged


def http_model(url: str, name: str, system: str, key: str = "", timeout: float = 120, tries: int = 3, wait: float = 1.0, **options) -> Callable[[list[str]], list[str]]:
    """A model as a function over prompts: each is posted as a conversation of two turns to a chat interface, and the first choice's text is the reply.

    Busy servers and lost connections are tried again, ``tries`` times in all; other errors end the job, so that a
    wrong address doesn't pass as empty answers.  ``options`` go into the request, such as temperature and max_tokens.
    """

    def one(prompt: str) -> str:
        body = {"model": name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]} | options
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        for left in range(tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if not left or (e.code != 429 and e.code < 500):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(wait)
        raise AssertionError("unreachable")

    return lambda prompts: [one(p) for p in prompts]


def one_shot(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``prompts`` with raw_answer and answer array<string>, the answer field of the object in the reply, empty on any error."""
    return generated(prompts, model).withColumn("answer", F.array_sort(F.array_distinct(api_answer(F.col("raw_answer")))))


def few_shot(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``prompts`` with raw_answer and answer array<string>, the last answer list of a reply that reasons first."""
    return generated(prompts, model).withColumn("answer", F.array_sort(F.array_distinct(last_answer_list(F.col("raw_answer")))))


def object_parser(raw: str) -> Column:
    """struct<confidence,answer> of a reply that is asked to be an object: its answers in order, nothing on any error."""
    found = F.array_sort(F.array_distinct(api_answer(F.col(raw))))
    return F.struct(F.when(F.size(found) > 0, "high").otherwise("failed").alias("confidence"), F.array_join(found, ",").alias("answer"))


def staged(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """A staged run over ``prompts`` (qid, step, prompt) whose replies are objects; a step without an answer fills in nothing."""
    return run_staged(prompts, model, parser=object_parser)

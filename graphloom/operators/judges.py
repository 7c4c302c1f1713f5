"""The place of a language model: answers by a responder that can be sent to executors, with a cache, retries and defensive reading.

No model is part of this library. `Rules` answers by the rules that stand in for one (see operators.review and functions.text); any object
with the same method takes its place.
"""

from __future__ import annotations

import json
import string
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.retrieval import batches
from graphloom.session import Scratch
from graphloom.sources.readers import first_json_object


class Responder(Protocol):
    def respond(self, prompt: str) -> str: ...


def render(template: str, **values: object) -> str:
    """A prompt from a template with $names; values that are no text are written as JSON, names without a value stay."""
    return string.Template(template).safe_substitute({k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in values.items()})


def with_retries(ask: Callable[[str], str], prompt: str, times: int = 2, wait: float = 0.1) -> str | None:
    """The answer, asked again up to `times` times after an error; None if all fail."""
    for k in range(times + 1):
        try:
            return ask(prompt)
        except Exception:  # noqa: BLE001 - a failed call is an answer of its own
            if k < times:
                time.sleep(wait * 2**k)
    return None


def answer_batches(rows: DataFrame, key: str, body: str, template: str, responder: Responder, size: int = 5, cache: DataFrame | None = None) -> DataFrame:
    """(key, answer, failed): one prompt for each `size` rows by key, its items (id, text); the answer is a JSON object {"items": [{"id", ...}]}.

    answer is the item's JSON, null where the answer lacks it; failed where the call did. cache has (text, answer) of earlier runs; texts that it
    holds are not asked. Batches are counted over all rows, so ids are stable. Rows with a null or blank text are not asked and have no answer.
    """
    s = Scratch(rows.sparkSession)
    asked = rows.select(F.col(key).alias("key"), F.trim(F.coalesce(F.col(body), F.lit(""))).alias("text"))
    known = asked.limit(0).select("key", F.lit(None).cast("string").alias("answer"))
    if cache is not None:
        known = asked.join(cache.select("text", "answer").dropDuplicates(["text"]), "text").select("key", "answer")
        asked = asked.join(cache.select("text").distinct(), "text", "left_anti")
    asked = s.write(asked.filter("text <> ''"))
    grouped = asked.join(batches(asked, "key", size), "key")

    def ask(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            keys, texts = g["keys"].tolist(), g["texts"].tolist()
            for ids, said in zip(keys, texts):
                items = [{"id": str(i), "text": t} for i, t in zip(ids, said)]
                raw = with_retries(responder.respond, render(template, items=items))
                found = {}
                try:
                    for x in json.loads(first_json_object(raw) or "{}").get("items") or []:
                        if isinstance(x, dict) and x.get("id") is not None:
                            found.setdefault(str(x["id"]), json.dumps(x, ensure_ascii=False))
                except (ValueError, AttributeError):
                    pass
                yield pd.DataFrame({"id": [i["id"] for i in items], "answer": [found.get(i["id"]) for i in items], "failed": raw is None})

    packed = grouped.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("key", "text"))).alias("x")).select(F.col("x.key").alias("keys"), F.col("x.text").alias("texts"))
    got = packed.mapInPandas(ask, "id string, answer string, failed boolean")
    fresh = asked.select("key").join(got, F.col("key").cast("string") == F.col("id")).select("key", "answer", "failed")
    out = known.select("key", "answer", F.lit(False).alias("failed")).unionByName(fresh)
    return rows.select(F.col(key).alias("key")).join(out, "key", "left").select(F.col("key").alias(key), "answer", F.coalesce("failed", F.lit(False)).alias("failed"))


class Rules:
    """A responder without a model: it reads the items of the prompt and answers each by a function of its text."""

    def __init__(self, rule: Callable[[str], dict]):
        self.rule = rule

    def respond(self, prompt: str) -> str:
        start = prompt.find("[{")
        items, _ = json.JSONDecoder().raw_decode(prompt[start:])
        return json.dumps({"items": [{"id": i["id"], **self.rule(i["text"])} for i in items]}, ensure_ascii=False)


def review_by_hand(rows: list[dict], ask: Callable[[dict], str]) -> tuple[list[dict], list[dict]]:
    """(accepted, rejected) of the rows that a reviewer sees one by one: a accepts, r rejects, q ends; any other answer is asked again."""
    accepted: list[dict] = []
    rejected: list[dict] = []
    for row in rows:
        while (said := ask(row).strip().lower()[:1]) not in ("a", "r", "q"):
            pass
        if said == "q":
            break
        (accepted if said == "a" else rejected).append(row)
    return accepted, rejected


class StageTimer:
    """Seconds of the stages of a run: `with timer.stage("name")`; stages of one name add up."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.seconds = clock, {}

    def stage(self, name: str):
        from contextlib import contextmanager

        @contextmanager
        def run():
            began = self.clock()
            try:
                yield
            finally:
                self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - began

        return run()

    @property
    def total(self) -> float:
        return sum(self.seconds.values())

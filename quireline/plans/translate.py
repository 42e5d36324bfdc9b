"""Pending segments to wording: batches go to a provider inside the executors, answers pass the acceptance gate.

A provider is a function from (system prompt, request) to a reply; it runs where the batch is. The
number of partitions is the number of requests at a time. What is missing or refused is asked once
more, segment by segment; repair rounds end early when nothing changes any more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.functions.normalizing import accepted
from quireline.functions.values import BATCH_SIZE, REPAIR_ROUNDS
from quireline.operators.checks import Rules, check_segments
from quireline.operators.context import batches, neighbours, referenced, requests
from quireline.operators.selection import parse_reply, select
from quireline.sources.projects import backoff
from quireline.sources.state import written

Provider = Callable[[str, str], str]


def stub_provider(system: str, request: str) -> str:
    """A provider without a network: each item's text in brackets, placeholders untouched."""
    return json.dumps({x["id"]: f"[{x['text'].strip()}]" for x in json.loads(request)}, ensure_ascii=False)


class Unavailable(Exception):
    """A provider's answer that is worth another try later; ``retry_after``: what the server says about when."""

    def __init__(self, message: str, retry_after: str | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def asked(batched: DataFrame, provider: Provider, system: str, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``batched`` (with ``payload``) with each batch's ``reply``, or its ``failure`` after some tries.

    Between tries of an ``Unavailable`` provider there is a pause (``backoff``); other failures are asked again at once.
    The answers are written before they are used: a provider is not asked, nor paid, again for a plan that reads them twice.
    """
    names = [c for c in batched.columns if c != "payload"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batched.schema.fields if f.name in names)

    def calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            replies, failures = [], []
            for payload in pdf["payload"]:
                reply, failure = None, None
                for attempt in range(retries):
                    try:
                        reply, failure = provider(system, payload), None
                        break
                    except Unavailable as error:
                        failure = str(error)
                        if attempt + 1 < retries:
                            wait(backoff(attempt, error.retry_after))
                    except Exception as error:  # a provider may fail in any way; the batch is then asked piece by piece
                        failure = str(error)
                replies.append(reply)
                failures.append(failure)
            yield pdf[names].assign(reply=pd.Series(replies, dtype=object, index=pdf.index), failure=pd.Series(failures, dtype=object, index=pdf.index))

    return written(batched.mapInPandas(calls, f"{schema}, reply string, failure string"), "answers")


def answers(batched: DataFrame, provider: Provider, system: str, keys: Sequence[str]) -> DataFrame:
    """One row for each answered segment: keys, id and text."""
    replied = asked(batched.select(*keys, "batch", "payload"), provider, system).withColumn("_r", parse_reply(F.col("reply")))
    return replied.select(*keys, F.explode("_r").alias("id", "text"))


def translate(segments: DataFrame, chosen: DataFrame, lang: str, provider: Provider = stub_provider, system: str = "", size: int = BATCH_SIZE, glossary: Sequence[dict] = (), style: Sequence[dict] = (), operations: Sequence[str] = (), mode: str = "draft", keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """keys, id, target, origin and why of each chosen segment; ``target`` is null where no answer was fit.

    Neighbours come from the whole document, whatever is chosen of it.
    """
    near = neighbours(segments, document=keys).select(*keys, "id", "before", "after")
    work = written(batches(chosen, size, keys).join(near, [*keys, "id"]), "work")  # read four times
    first = answers(requests(referenced(work, keys), glossary, style, keys, mode), provider, system, keys)
    gate = accepted(F.col("masked"), F.col("slots"), F.col("text"), lang, operations)

    def judged(df: DataFrame, got: DataFrame) -> DataFrame:
        joined = df.join(got, [*keys, "id"], "left").withColumn("_g", gate)
        return joined.withColumn("why", F.when(F.col("text").isNull(), "no answer for this id").otherwise(F.col("_g.why"))).withColumn("target", F.col("_g.text")).drop("_g", "text")

    base = work.drop("target")
    once = written(judged(base, first), "judged")
    failed = once.where("target IS NULL").drop("target", "why")
    alone = failed.withColumn("batch", F.xxhash64(*keys, "id"))
    second = answers(requests(referenced(alone, keys), glossary, style, keys, mode), provider, system, keys)
    again = judged(failed, second)
    out = once.where("target IS NOT NULL").unionByName(again)
    return out.select(*keys, "id", "target", F.lit(f"llm:{mode}").alias("origin"), "why")


def repair(segments: DataFrame, rules: Rules, provider: Provider, save: Callable[[DataFrame, int], DataFrame], rounds: int = REPAIR_ROUNDS, keys: Sequence[str] = ("doc_id", "lang"), **options) -> DataFrame:
    """Translate failing segments again, round by round, until none fails or a round changes nothing.

    ``save`` stores a round's wording and gives the segments as they stand then.
    """
    seen = None
    for n in range(rounds):
        checked = check_segments(segments, rules)
        failing = select(checked, "repair")
        signature = failing.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "id", F.coalesce("target", F.lit(""))).cast("decimal(38,0)"))).first()
        if not signature[0] or tuple(signature) == seen:
            break
        seen = tuple(signature)
        problems = F.transform(F.filter("issues", lambda x: x.severity == "error"), lambda x: F.concat(x.rule, F.lit(": "), x.message))
        chosen = failing.withColumn("problems", problems).drop("issues")
        segments = save(translate(segments, chosen, rules.lang, provider, mode="repair", keys=keys, **options).where("target IS NOT NULL"), n)
    return segments

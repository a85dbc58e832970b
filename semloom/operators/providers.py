"""Batches of rows to an outside model: prompts, retries, halving, completion, coerced answers."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions.text import clean


def evidence_prompt(cluster: Column, representatives: Column, genres: Column, keywords: Column, terms: Column) -> Column:
    """JSON of a cluster's evidence at the lengths a prompt takes: 10, 8, 12 and 15 entries."""
    return F.to_json(F.struct(
        cluster.alias("cluster_id"), F.slice(representatives, 1, 10).alias("representatives"), F.slice(genres, 1, 8).alias("genres"),
        F.slice(keywords, 1, 12).alias("keywords"), F.slice(terms, 1, 15).alias("terms"),
    ))


def ask(call: Callable[[list], list], items: list, tries: int = 4, wait: float = 0.5) -> list:
    """Answers of one call; failures are tried again after a doubling wait, then the batch is halved, and a lone failing item gets None.

    An answer list of another length counts as a failure.
    """
    for attempt in range(tries):
        try:
            got = call(items)
            if len(got) == len(items):
                return got
        except (OSError, TimeoutError, ValueError):
            pass
        time.sleep(wait * 2**attempt)
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return ask(call, items[:half], tries, wait) + ask(call, items[half:], tries, wait)


def answers(prompts: DataFrame, call: Callable[[list], list], batch: int = 5, wait: float = 0.5) -> DataFrame:
    """(id, answer) for prompts (id, prompt): each task sends its rows in batches; answers are JSON strings or null."""

    def work(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "answer": ask(call, part["prompt"].tolist(), wait=wait)})

    return prompts.select("id", "prompt").mapInPandas(work, "id long, answer string")


def labels(answered: DataFrame) -> DataFrame:
    """(id, label, description, confidence): what an answer's outermost braces hold; junk confidence 0.5, else 0 to 1."""
    inner = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    a = F.from_json(inner, "label string, description string, confidence string")
    c = F.coalesce(a["confidence"].try_cast("double"), F.lit(0.5))
    return answered.select("id", F.nullif(clean(a["label"]), F.lit("")).alias("label"), F.coalesce(clean(a["description"]), F.lit("")).alias("description"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"))


def template_labeler(prompts: list[str]) -> list[str]:
    """Labels without a service: a cluster's first terms."""
    import json

    out = []
    for p in prompts:
        e = json.loads(p)
        words = [*e.get("terms", []), *e.get("keywords", []), *e.get("genres", [])][:3]
        out.append(json.dumps({"label": " ".join(words).title() or f"Cluster {e['cluster_id']}", "description": ", ".join(words), "confidence": 0.5}))
    return out

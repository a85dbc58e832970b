"""Ranked search over titles, and level of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions.text import folded, folded_literal


def score(title: Column, year: Column, everything: Column, query: str) -> Column:
    """Exact 0, prefix 1, inside 2 + place / 100, year 3, anywhere 4 + place / 1000, else null. Query in lower case."""
    t, e, q = F.lower(title), F.lower(everything), F.lit(query)
    at, any_ = F.instr(t, query), F.instr(e, query)
    return (
        F.when(t == q, 0.0).when(F.startswith(t, q), 1.0).when(at > 0, 2 + (at - 1) / 100)
        .when(F.startswith(year, q), 3.0).when(any_ > 0, 4 + (any_ - 1) / 1000)
    )


def folded_search(nodes: DataFrame, query: str, k: int = 8) -> DataFrame:
    """search without regard to case and accents, also by nodes' original_title (null counts as empty): exact, prefix and year scores are the better of both titles', inside counts for the title alone."""
    q = folded_literal(query)
    t, o = folded(F.coalesce("title", F.lit(""))), folded(F.coalesce("original_title", F.lit("")))
    own = score(t, F.coalesce("year", F.lit("")), folded(F.coalesce("everything", F.lit(""))), q)
    other = F.when(o == q, 0.0).when(F.startswith(o, F.lit(q)), 1.0)
    found = nodes.withColumn("score", F.least(own, other))
    return found.where(F.col("score").isNotNull() & F.lit(len(q) >= 2)).orderBy("score", "id").limit(k).select("id", "title", "score")


def search(nodes: DataFrame, query: str, k: int = 8) -> DataFrame:
    """(id, title, score) of the k best of nodes (id, title, year, everything); ties by id; nothing below two characters."""
    found = nodes.withColumn("score", score(F.col("title"), F.col("year"), F.col("everything"), query.lower()))
    return found.where(F.col("score").isNotNull() & F.lit(len(query) >= 2)).orderBy("score", "id").limit(k).select("id", "title", "score")


def layer_of_zoom(zoom: Column) -> Column:
    return F.when(zoom < 3.15, "macro").when(zoom < 7.1, "neighborhood").otherwise("micro")

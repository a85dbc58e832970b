"""Markdown of metric frames: aggregates of a few rows, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cell(x) -> str:
    """A value in a table: null n/a, floats with three decimals, lists joined, bars escaped."""
    if x is None:
        return "n/a"
    if isinstance(x, float):
        return f"{x:.3f}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{x:,}"
    if isinstance(x, (list, tuple)):
        return "; ".join(cell(y) for y in x)
    return str(x).replace("|", "\\|").replace("\n", " ")


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole if whole else 0:.1f}% ({part}/{whole})"


def table(rows: DataFrame, limit: int = 200) -> str:
    """A Markdown table of the first `limit` rows in the frame's order."""
    got = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in got])


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A document of titled tables and paragraphs."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else table(body)]
    return "\n\n".join(parts) + "\n"


def readiness(entities: int, layers_labelled: int, missing_files: int) -> str:
    """What a map of this size and completeness is fit for."""
    if missing_files:
        return "not ready: export files are missing"
    if entities >= 1500 and layers_labelled >= 2:
        return "ready for the client"
    return "usable for inspection"

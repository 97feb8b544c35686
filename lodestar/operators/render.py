"""Context as text within a budget of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def render(items: list[dict], chars: int) -> str:
    """Items in order, each as its body, else its signature, else its place, as long as they fit; one-liners share a block.

    Items have file, start_line, end_line, name, level, source, signature.
    """
    out, used, shared = [], 0, []
    for x in items:
        if x["level"] == "omitted":
            continue
        head = f"{x['file']}:{x['start_line']}-{x['end_line']} {x['name']}"
        if x["start_line"] == x["end_line"]:
            line = f"{x['file']}:{x['start_line']}: {x['source'].strip()}"
            if used + len(line) + 1 <= chars:
                shared.append(line)
                used += len(line) + 1
            continue
        choices = [f"## {head}\n{x['source']}"] if x["level"] == "body" else []
        for text in (*choices, f"## {head} (signature)\n{x['signature']}", f"## {head} (location)"):
            if used + len(text) + 2 <= chars:
                out.append(text)
                used += len(text) + 2
                break
    if shared:
        out.append("\n".join(["## One-line declarations", *shared]))
    return "\n\n".join(out)


def render_all(items: DataFrame, group: str, chars: int) -> DataFrame:
    """(group, text) for every task; items have ``place`` for their order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "text": [render(pdf.sort_values("place").to_dict("records"), chars)]})

    return items.groupBy(group).applyInPandas(run, f"{group} {items.schema[group].dataType.simpleString()}, text string")


def keyword_section(terms: list[str], missing: list[str], matches: list[dict]) -> str:
    lines = [f"Keywords: {', '.join(terms)}"] if terms else []
    if missing:
        lines.append(f"Nothing contains: {', '.join(missing)}")
    for m in matches:
        lines.append(f"{m['file']} ({m['kind']}): {', '.join(m['terms'])}")
        lines += [f"  {x['line']}: {x['text']}" for x in m["lines"] or []]
    return "\n".join(lines)

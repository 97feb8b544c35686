"""Directories and files of a repository: adaptive scopes, subtask areas, maps and trees.

Splitting is by counts of path prefixes, which Spark sums; only counts of directories come to the driver, and the choice of the
next split is made there.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE_FILES, AREAS, AREA_FILES = 64, 16, 6


def prefix_counts(files: DataFrame) -> dict[str, int]:
    """Files under each directory, '.' for all; one row for each directory comes to the driver."""
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    return {r["dir"]: r["n"] for r in files.select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("n")).collect()}


def _children(counts: dict[str, int]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for d in counts:
        if d != ".":
            out.setdefault(d.rpartition("/")[0] or ".", []).append(d)
    return out


def scopes(counts: dict[str, int], most: int = SCOPE_FILES, split_root: bool = False) -> dict[str, tuple[int, bool]]:
    """Scope -> (files, whether only its own): a directory over ``most`` files gives way to its children and its own files."""
    children, out = _children(counts), {}
    todo = ["."] if counts else []
    while todo:
        d = todo.pop()
        below = children.get(d, [])
        own = counts[d] - sum(counts[c] for c in below)
        if (counts[d] <= most or not below) and not (split_root and d == "."):
            out[d] = counts[d], False
            continue
        if own:
            out[d] = own, d != "." or not split_root
        todo += below
    return out


def scope_of(scopes_: dict[str, tuple[int, bool]]):
    """The scope of a file column: its longest scope directory."""
    names = sorted(scopes_, key=lambda d: (-len(d) if d != "." else 0, d))
    out = F.when(F.lit(False), F.lit(""))
    for d in names:
        out = out.when(F.lit(True) if d == "." else F.startswith("file", F.lit(f"{d}/")), F.lit(d))
    return out


def areas(counts: dict[str, int], most: int = AREAS, few: int = AREA_FILES) -> list[tuple[str, int]]:
    """At most ``most`` areas for subtasks: the largest that can be split is split into its directories, while they fit."""
    children = _children(counts)
    heap, done = [(-counts["."], ".")] if counts else [], []
    while heap:
        n, d = heapq.heappop(heap)
        below = sorted(children.get(d, []))
        own = -n - sum(counts[c] for c in below)
        parts = len(below) + (own > 0)
        if -n < few or not below or len(heap) + len(done) + parts > most:
            done.append((d, -n))
            continue
        for c in below:
            heapq.heappush(heap, (-counts[c], c))
        if own:
            done.append((f"{d}/*" if d != "." else "*", own))
    return sorted(done, key=lambda x: (-x[1], x[0]))


def flat_runs(n: int, most: int) -> list[int]:
    """Sizes of consecutive runs that deal n files of one directory evenly to ``most`` areas."""
    k = min(n, most)
    return [n // k + (i < n % k) for i in range(k)] if k else []


def repository_map(counts: dict[str, int], chars: int) -> str:
    """Directories with their file counts, deepest levels merged upwards until the text fits; then cut at a line."""
    depth = max((d.count("/") + 1 for d in counts if d != "."), default=0)
    while True:
        shown: Counter = Counter()
        for d, n in counts.items():
            if d != "." and d.count("/") + 1 <= depth:
                shown[d] = n
        text = "\n".join([f"{counts.get('.', 0)} files", *(f"{d}/ {n} files" for d, n in sorted(shown.items()))])
        if len(text) <= chars or depth <= 1:
            return text if len(text) <= chars else text[:chars].rpartition("\n")[0]
        depth -= 1


def tree(files: list[str]) -> str:
    """An indented tree of paths."""
    lines, shown = [], set()
    for f in sorted(files, key=lambda f: f.split("/")):
        parts = f.split("/")
        for k in range(len(parts)):
            if (at := "/".join(parts[: k + 1])) not in shown:
                shown.add(at)
                lines.append("  " * k + parts[k])
    return "\n".join(lines)


def file_summaries(symbols: DataFrame, most: int = 80, chars: int = 180) -> DataFrame:
    """(file, n_symbols, summary): the first symbols of each file, one a line; symbols(file, start_line, name, signature)."""
    from .ranking import top_in

    line = F.concat(F.col("start_line").cast("string"), F.lit(": "), "name", F.lit(" :: "), F.substring(F.regexp_replace("signature", r"\s+", " "), 1, chars))
    counts = symbols.groupBy("file").agg(F.count("*").alias("n_symbols"))
    first = top_in(symbols.withColumn("text", line), ["file"], ["start_line", "name"], most)
    listed = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("summary"))
    return counts.join(listed, "file")


def top_counts(files: DataFrame) -> DataFrame:
    """(section, n): files under each top directory."""
    return files.groupBy(F.when(F.contains("file", F.lit("/")), F.split_part("file", F.lit("/"), F.lit(1))).otherwise(F.lit(".")).alias("section")).agg(F.count("*").alias("n"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, config): the deepest configuration that includes a file; configs(config, dir, file)."""
    from .ranking import top_in

    held = files.join(configs.withColumnRenamed("file", "f2"), F.col("file") == F.col("f2"))
    return top_in(held, ["file"], [F.desc(F.size(F.split("dir", "/"))), F.desc(F.length("dir")), "config"], 1).select("file", "config")


def unconfigured(files: DataFrame, config_dirs: DataFrame, included: DataFrame) -> DataFrame:
    """Files that a configuration's directory holds and no configuration includes. Directories meet by equality, not by prefix."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    owned = files.withColumn("dir", F.explode(above)).join(config_dirs.select("dir").distinct(), "dir").select("file").distinct()
    return owned.join(included.select("file"), "file", "left_anti")

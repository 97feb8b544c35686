"""Project configurations and roots: what belongs to which project, read on the driver where it is a handful of files."""

from __future__ import annotations

import json
import os
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIG = r"(?:^|/)(?:ts|js)config(?:\.[\w-]+)?\.json$"
# Error names for folders that are passed over.
UNREADABLE = (PermissionError, FileNotFoundError, NotADirectoryError)


def unsuitable_root(root: str) -> str | None:
    """Why a folder is no project, or None: the file system's root and the home folder are none."""
    full = os.path.abspath(root)
    if full == os.path.abspath(os.sep):
        return f"{full} is the root of the file system"
    return f"{full} is the home folder" if full == os.path.expanduser("~") else None


def readable(root: str) -> tuple[list[str], str | None]:
    """Folders under a local root that can be listed, and a note on those that can't."""
    seen, skipped, todo = [], [], [root]
    while todo:
        d = todo.pop()
        try:
            entries = sorted(os.scandir(d), key=lambda e: e.name, reverse=True)
        except UNREADABLE:
            skipped.append(os.path.relpath(d, root))
            continue
        seen.append(d)
        todo += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    more = f", +{len(skipped) - 3} more" if len(skipped) > 3 else ""
    return seen, f"{len(skipped)} folders could not be read: {', '.join(skipped[:3])}{more}" if skipped else None


def relaxed_json(text: str) -> dict:
    """JSON with comments and trailing commas; empty for what can't be read."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    except ValueError:
        return {}


def _pattern(glob: str) -> str:
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}(?:/.*)?$" if "*" not in glob and "." not in posixpath.basename(glob) else f"^{out}$"


def project_files(configs: DataFrame, files: DataFrame) -> DataFrame:
    """(config, dir, file): what each configuration includes; configs(file, text), a base that is missing is left out.

    Configurations are few and come to the driver; the files stay where they are.
    """
    found = {r["file"]: relaxed_json(r["text"]) for r in configs.where(F.col("file").rlike(CONFIG)).collect()}

    def whole(name: str, seen: tuple = ()) -> dict:
        own = found.get(name, {})
        base = own.get("extends")
        if isinstance(base, str) and base.startswith(".") and name not in seen:
            at = posixpath.normpath(posixpath.join(posixpath.dirname(name), base if base.endswith(".json") else f"{base}.json"))
            return {**whole(at, (*seen, name)), **own} if at in found else own
        return own

    out = None
    for name in found:
        own, at = whole(name), posixpath.dirname(name)
        full = lambda g, at=at: posixpath.normpath(posixpath.join(at, g))
        yes = [_pattern(full(g)) for g in own.get("include", [] if "files" in own else ["**/*"])] + [f"^{re.escape(full(g))}$" for g in own.get("files", [])]
        no = [_pattern(full(g)) for g in own.get("exclude", ["node_modules"])]
        hit = F.col("file").rlike("|".join(yes) or "$^") & ~F.col("file").rlike("|".join(no) or "$^")
        part = files.where(hit).select(F.lit(name).alias("config"), F.lit(at or ".").alias("dir"), "file")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else files.select(F.lit("").alias("config"), F.lit("").alias("dir"), "file").limit(0)

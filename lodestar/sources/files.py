"""Source trees as tables: what to read, what changed, and the declarations of a file.

Paths and contents come from Spark's binary file source, so any store that Spark reads will do. The walk's rules are filters on
the path and length columns; a file is read only if they let it through.
"""

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DECLARATION_FILE, MARKUP_FILE, SOURCE_FILE

# What a walk passes over.
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo")
MAX_BYTES, MAX_FILES = 1 << 20, 20_000


def listing(spark: SparkSession, root: str, most: int = MAX_FILES) -> DataFrame:
    """(file, path, length, version): files under a root, in order of name up to ``most``, without ignored or hidden folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(re.sub(r'^file:/*', '/', root).rstrip('/'))}/", "")
    parts = F.split("file", "/")
    bad = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED) | F.startswith(p, F.lit(".")))
    kept = raw.withColumn("file", name).where(~bad)
    version = F.concat_ws(":", F.unix_micros("modificationTime"), "length")
    return kept.select("file", "path", "length", version.alias("version")).orderBy("file").limit(most)


def classify(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds kind: code, markup, other, or large for sources over the limit."""
    code = F.col("file").rlike(SOURCE_FILE) & ~F.col("file").rlike(DECLARATION_FILE)
    return files.withColumn("kind", F.when(code & (F.col("length") > max_bytes), "large").when(code, "code").when(F.col("file").rlike(MARKUP_FILE), "markup").otherwise("other"))


def contents(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """(file, version, text) of listed files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return raw.join(files, "path").select("file", "version", F.decode("content", "UTF-8").alias("text"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose version isn't known yet: only these are read again."""
    return now.join(before.select("file", "version"), ["file", "version"], "left_anti")


def refresh(now: DataFrame, before: DataFrame, read_again: DataFrame) -> DataFrame:
    """The table after a scan: unseen files go, changed ones are replaced."""
    kept = before.join(now.select("file", "version"), ["file", "version"], "left_semi")
    return kept.unionByName(read_again, allowMissingColumns=True)


def not_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that a list from outside (file), such as version control's, doesn't name."""
    return files.join(ignored.select("file"), "file", "left_anti")


def mask_component(text: str) -> str:
    """A component file with all but its script blocks blanked; line numbers stay."""
    keep = [(m.start(1), m.end(1)) for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S | re.I)]
    out, at = [], 0
    for lo, hi in keep:
        out += [re.sub(r"[^\n]", " ", text[at:lo]), text[lo:hi]]
        at = hi
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:])])


DECLARATIONS = "array<struct<name: string, kind: string, start_line: int, end_line: int, signature: string, source: string>>"
_HEAD = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?:(?P<kind>function\*?|class|interface|enum|type)\s+(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+(?P<value>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
    r"|(?:(?:public|private|protected|static|readonly|get|set)\s+)*(?P<member>#?[A-Za-z_$][\w$]*)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{)",
    re.M,
)
_NOT_MEMBERS = {"if", "for", "while", "switch", "catch", "function", "return", "with"}


def _end_of(text: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes; the line's end if none opens in the statement."""
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif text.startswith("//", k):
            k = text.find("\n", k)
            if k < 0:
                return len(text)
            continue
        elif text.startswith("/*", k):
            k = text.find("*/", k)
            if k < 0:
                return len(text)
            k += 1
        elif c in "'\"`":
            quote = c
        elif c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth == 0 and c == "}":
                return k + 1
        elif c == ";" and depth == 0:
            return k + 1
        k += 1
    return len(text)


def declarations(text: str) -> list[tuple]:
    """Functions, classes, members, function values and types of a script, by their heads and matching braces.

    No compiler is at hand: overloads without a body and computed names are passed over, and nothing is resolved.
    """
    out, classes = [], []
    for m in _HEAD.finditer(text):
        name = m["name"] or m["value"] or m["member"]
        kind = (m["kind"] or ("value" if m["value"] else "method")).rstrip("*")
        if kind == "method" and (name in _NOT_MEMBERS or not any(lo < m.start() < hi for lo, hi in classes)):
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _end_of(text, start)
        body = text[start:end]
        if kind == "function" and "{" not in body:
            continue
        if kind == "class":
            classes.append((start, end))
        head = body.partition("{")[0].strip() or body
        out.append((name, kind, text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1, " ".join(head.split())[:300], body))
    return out


def extract(files: DataFrame) -> DataFrame:
    """(file, name, kind, start_line, end_line, signature, source) of every declaration; files(file, text)."""

    @F.pandas_udf(DECLARATIONS)
    def found(names: pd.Series, texts: pd.Series) -> pd.Series:
        made = lambda n, t: [dict(zip(("name", "kind", "start_line", "end_line", "signature", "source"), d, strict=True)) for d in declarations(mask_component(t) if n.endswith(".vue") else t)]
        return pd.Series([made(n, t or "") for n, t in zip(names, texts, strict=True)])

    return files.select("file", F.explode(found("file", "text")).alias("d")).select("file", "d.*")


def ordered_cap(files: DataFrame, by: str, most: int) -> DataFrame:
    """Per group the first files by name, ``most`` at most."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("file"))).where(F.col("_r") <= most).drop("_r")

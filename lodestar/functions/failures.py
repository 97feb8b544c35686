"""What went wrong, from codes and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failure_kind(code: Column, message: Column) -> Column:
    """A class for an error: by the system's code, else by the HTTP status in the message, else by its words."""
    status = F.regexp_extract(message, r"failed \((\d{3})\)", 1).try_cast("int")
    rules = [
        (code.isin("EPERM", "EACCES"), "not-permitted"),
        (code == "ENOENT", "not-found"),
        (code.isin("EMFILE", "ENFILE"), "too-many-files"),
        (status.isin(401, 403), "key-rejected"),
        (status == 402, "no-credit"),
        (status == 429, "rate-limited"),
        (status >= 500, "service-trouble"),
        (status.isin(400, 404), "refused"),
        (message.rlike("(?i)fetch failed|ENOTFOUND|ECONNREFUSED|ECONNRESET|EAI_AGAIN|network"), "unreachable"),
        (message.rlike("(?i)TimeoutError|timed out|timeout"), "timeout"),
        (message.rlike("response has no answers|Invalid Choice answer"), "bad-answer"),
    ]
    out = F.when(F.lit(False), "")
    for rule, name in rules:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise("unexpected")


def request_status(warnings: Column) -> Column:
    """Complete without warnings; notes that bounds were applied are no warnings."""
    return F.when(F.size(F.filter(warnings, lambda w: ~w.rlike("pruned by|were not followed"))) > 0, "incomplete").otherwise("complete")

"""Scores and the rules that turn them into decisions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, priors and thresholds that results depend on.
FIELD_WEIGHTS = {"name": 5, "path": 2, "signature": 3, "identifiers": 1, "literals": 2}
EDGE_PRIOR = {
    "caller": 0.95,
    "call": 0.92,
    "method": 0.92,
    "new": 0.90,
    "jsx": 0.88,
    "test": 0.86,
    "value": 0.80,
    "sibling": 0.60,
    "import": 0.72,
    "type": 0.55,
    "lexical": 0.50,
    "argument": 0.90,
    "shared": 0.74,
}
NESTED_PRIOR, LEAD_PRIOR = 0.58, 1.0
K1, B, RRF_K = 1.2, 0.75, 60
SEMANTIC_SHARE, STRUCTURAL_SHARE = 0.7, 0.3


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    """One field's part of a term's score; 0 where the term isn't."""
    norm = tf + K1 * (1 - B + B * (length / F.greatest(average, F.lit(1.0))))
    return F.when(tf > 0, weight * (tf * (K1 + 1) / norm)).otherwise(0.0)


def edge_prior(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EDGE_PRIOR.items() for x in pair])
    return F.try_element_at(known, kind)


def term_hits(haystack: Column, terms: list[str]) -> Column:
    """How many terms occur anywhere in a text."""
    return F.aggregate(F.array(*map(F.lit, terms)).cast("array<string>"), F.lit(0), lambda a, t: a + F.contains(haystack, t).cast("int"))


def rrf(rank: Column) -> Column:
    return 1 / (RRF_K + rank)


def blend(semantic: Column, structural: Column) -> Column:
    """Semantic and structural evidence; the structural one alone where there is no answer."""
    return F.when(semantic.isNull(), structural).otherwise(SEMANTIC_SHARE * semantic + STRUCTURAL_SHARE * structural)


def lexical_prior(rank: Column, n: Column) -> Column:
    """From 0.8 for the first (rank 0) to 0.4 for the last."""
    return 0.8 - 0.4 * F.when(n <= 1, 0.0).otherwise(rank / (n - 1))


def priority(score: Column, depth: Column, wrapper: Column, typed: Column) -> Column:
    """An edge's priority: its score, at least 0.45 into a thin wrapper, 1 for types, fading by 0.8 a step."""
    return F.when(typed, 1.0).otherwise(F.greatest(score, F.when(wrapper, 0.45).otherwise(0.0))) * F.pow(F.lit(0.8), depth - 1)


def level(score: Column, body: float = 0.3, omit: float = 0.3, typed: Column | None = None, external: Column | None = None) -> Column:
    """Body over ``body``, signature from ``omit`` on, else omitted; types count as bodies, external code never does."""
    typed = F.lit(False) if typed is None else typed
    external = F.lit(False) if external is None else external
    return F.when((typed | (score > body)) & ~external, "body").when(typed | (score >= omit), "signature").otherwise("omitted")


def valid_score(score: Column) -> Column:
    """The score if it is a number from 0 to 1, else 0."""
    return F.when(score.isNotNull() & ~F.isnan(score) & score.between(0, 1), score).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """1 where there was nothing to find."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def render_budget(budget: Column, max_chars: Column) -> Column:
    return F.greatest(F.lit(500), F.least(budget, F.floor((max_chars - 5000) / 4)))

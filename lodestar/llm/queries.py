"""One query for each operator, over its whole table with production parameters, and the SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, balltree, bpe, castore, line_dedup, mixing, pii, pipeline, quality, recurrent, suffix_dedup
from .common import table


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op7_castore(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, root = castore.store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return castore.read_store(spark, where, root)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, with the words that the mix takes of it."""
    chosen = mixing.decide(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = chosen.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its class: the least doc_id among its copies and near copies."""
    return bagminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, its lines, those deleted as later repeats, and the SHA-256 of what stays."""
    done = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


def op2_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recurrent.score(docs, *recurrent.fit(docs))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say."""
    return op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can say."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_recurrent": op2_recurrent,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_balltree": op6_balltree,
    "op7_castore": op7_castore,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bagminhash": op10_bagminhash,
    "pipeline": pipeline.run,
    "quality_base": quality_base,
    "pii_base": pii_base,
}

#: Windows of at least 50 words (spaces and one) by their text; the Spark query finds the same by fingerprints and hashes.
LINE_DEDUP_SQL = """
with l0 as (select doc_id d, text, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 pos from documents),
l as (select *, length(line) - length(replace(line, ' ', '')) + 1 w from l0 where length(trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    '))) > 0),
s as (select *, sum(w) over (partition by d order by pos)::bigint til, (sum(w) over (partition by d order by pos) - w)::bigint bef, (sum(w) over (partition by d))::bigint al from l),
f as (select d, pos, bef, til, al, list(line) over x ls, min(pos) over x st, max(pos) over x en from s window x as (partition by d order by bef range between current row and 49 following)),
b as (select d, pos, bef, til, al, list(line) over x ls, min(pos) over x st, max(pos) over x en from s window x as (partition by d order by til range between 49 preceding and current row)),
ws as (select d, ls, st, en from f where al - bef >= 50 union select d, ls, st, en from b where til >= 50),
fi as (select *, first_value(d) over y fd, first_value(en) over y fe from ws window y as (partition by ls order by d, st)),
gone as (select distinct d, unnest(generate_series(st, en)) pos from fi where fd <> d or fe < st)
select doc_id, count(*) n_lines, count(g.pos) n_removed_lines, sha256(coalesce(string_agg(line, chr(10) order by l0.pos) filter (where g.pos is null), '')) kept_sha256
from (select d doc_id, * from l0) l0 left join gone g on g.d = l0.d and g.pos = l0.pos group by doc_id"""

TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint score from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 5"""

QUALITY_SQL = r"""
with t as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
l as (select doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) ls from t),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] w from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) i from t)),
twice as (select doc_id, i from g qualify count(*) over (partition by doc_id, w) > 1),
r as (select doc_id, count(distinct i + k)::bigint n from twice, (select unnest([0, 1, 2]) k) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::bigint word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0) n_repeat_words, len(ws) < 50 or 100 * coalesce(n, 0) > 50 * len(ws) base_failed
from t join l using (doc_id) left join r using (doc_id)"""

PII_SQL = r"""
with t as (select doc_id, coalesce(text, '') x from documents),
d as (select doc_id, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') emails, regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') ips,
 list_transform(regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), lambda y: regexp_replace(y, '[^0-9]', '', 'g')) cards, list_transform(regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]'), lambda y: regexp_replace(y, '[^0-9]', '', 'g')) phones from t)
select doc_id, len(emails)::bigint n_email, len(list_filter(ips, lambda y: list_max(list_transform(string_split(y, '.'), lambda p: p::double)) <= 255))::bigint n_ip,
 len(list_filter(cards, lambda y: length(y) between 14 and 19 and list_sum(list_transform(range(length(y)), lambda i: case when i % 2 = 0 then substr(y, length(y) - i::int, 1)::int else 2 * substr(y, length(y) - i::int, 1)::int - case when substr(y, length(y) - i::int, 1)::int > 4 then 9 else 0 end end)) % 10 = 0))::bigint n_card,
 len(list_filter(phones, lambda y: length(y) between 10 and 15))::bigint n_phone from d"""

ORACLE: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op6_balltree": TOP_K_SQL, "quality_base": QUALITY_SQL, "pii_base": PII_SQL}

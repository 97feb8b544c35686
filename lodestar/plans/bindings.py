"""The driver's tables in the roles of the data model: documents as declarations, the star schema as a typed graph, events as
the usage log, conversations as transcripts, pages as text-only files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Few partitions, which a small file gives, are dealt to all threads; a large input has many and stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() <= 2 * n else df


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, line and the five token fields of each document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    t = F.col("identifiers")
    base = d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("file"), F.col("doc_id").cast("int").alias("line"), tokens(F.col("text")).alias("identifiers"), tokens(F.substring("text", 1, 300)).alias("signature"))
    return base.withColumns({"name": F.slice(t, 1, 8), "path": tokens(F.col("file")), "literals": F.filter(t, lambda x: x.rlike("[0-9]"))})


def nodes(spark: SparkSession, sf_dir: str, one_file: bool = False) -> DataFrame:
    """Customers, orders, parts, suppliers, nations and regions as declarations; a key is its line."""
    t = lambda n: table(spark, sf_dir, n)
    part = lambda df, p, key, name, file: df.select(F.concat(F.lit(f"{p}:"), F.col(key)).alias("id"), name.alias("name"), file.alias("file"), F.col(key).cast("long").alias("start_line"), F.col(key).cast("long").alias("end_line"))
    all_ = (
        part(t("customer"), "c", "c_custkey", F.col("c_name"), F.concat(F.lit("customer/"), "c_mktsegment"))
        .unionByName(part(t("orders"), "o", "o_orderkey", F.concat(F.lit("order "), "o_orderkey"), F.concat(F.lit("orders/"), "o_orderstatus")))
        .unionByName(part(t("part"), "p", "p_partkey", F.col("p_name"), F.concat(F.lit("part/"), "p_brand")))
        .unionByName(part(t("supplier"), "s", "s_suppkey", F.col("s_name"), F.concat(F.lit("supplier/"), "s_nationkey")))
        .unionByName(part(t("nation"), "n", "n_nationkey", F.col("n_name"), F.lit("nation")))
        .unionByName(part(t("region"), "r", "r_regionkey", F.col("r_name"), F.lit("region")))
    )
    out = all_.withColumns({"external": F.lit(False), "outline": F.lit(False)})
    return out.withColumn("file", F.lit("star")) if one_file else out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer calls order, order calls part and a supplier's method, customer is of a nation's type, nation of a region's."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, seq, a, ka, b, kb, kind, text: df.select(seq.cast("long").alias("seq"), F.concat(F.lit(f"{a}:"), F.col(ka)).alias("src_id"), F.concat(F.lit(f"{b}:"), F.col(kb)).alias("dst_id"), F.lit(kind).alias("kind"), text.alias("site_text"))
    line = F.col("l_linenumber")
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return (
        e(t("orders"), F.col("o_orderkey"), "c", "o_custkey", "o", "o_orderkey", "call", F.col("o_orderpriority"))
        .unionByName(e(items, line, "o", "l_orderkey", "p", "l_partkey", "call", F.col("l_returnflag")))
        .unionByName(e(items, line, "o", "l_orderkey", "s", "l_suppkey", "method", F.col("l_returnflag")))
        .unionByName(e(t("customer"), F.lit(0), "c", "c_custkey", "n", "c_nationkey", "type", F.col("c_mktsegment")))
        .unionByName(e(t("nation"), F.lit(0), "n", "n_nationkey", "r", "n_regionkey", "type", F.lit("")))
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: props.k is what could have been returned, value what was."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    returned = F.round("value").cast("long")
    return e.select("event_id", F.col("ts").alias("time"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("project"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), F.when(F.col("event_type") == "error", "no-context").when(k < 10, "not-covered").otherwise("complete").alias("outcome"), k.alias("candidate_tokens"), returned.alias("returned_tokens"), F.greatest(k - returned, F.lit(0)).alias("saved_tokens"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text-only files, a line for each tag."""
    return spread(table(spark, sf_dir, "pages").select("url", "html")).select(F.col("url").alias("file"), F.regexp_replace("html", "<", "\n<").alias("text"))


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieved items of one case for each language, with labels as what was wanted and a score by hash.

    The score is a stand-in for a judge's: the same for a document wherever it runs. Quality 1 wants the document; toxic ones
    only as a signature.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels")
    score = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("double") / 16777215
    wanted = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "signature").when(F.col("quality") == 1, "body")
    return d.join(l, "doc_id", "left").select("doc_id", F.col("lang").alias("case_id"), F.col("source").alias("file"), F.round(score, 6).alias("score"), F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"), wanted.alias("wanted"), "quality")

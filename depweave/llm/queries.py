"""Queries p3 and p6 to p8: the problems of this part over the project's own tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.leakage import leaks
from depweave.llm.packing import END_TOKENS, pack
from depweave.llm.sentences import sentence_offsets
from depweave.llm.topn import latest, top_n
from depweave.session import materialize


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _capacity(spark: SparkSession, d: str) -> int:
    return int(table(spark, d, "containers").agg(F.max("capacity")).first()[0])


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    f = latest(table(spark, d, "agent_findings"), ["rule", "from", "to"], ["reported_at", "finding_id"], ["score"])
    return top_n(f, ["rule", "from"], "score", "to", 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("rule", "from", "to")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("rule", "from", "to", "score", F.col("rank").cast("long").alias("rank"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which the packing makes several pieces."""
    packed = pack(table(spark, d, "documents"), "doc_id", "text", _capacity(spark, d))
    return packed.where("pieces > 1 and piece = 0").select("doc_id")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text, with its container."""
    return pack(table(spark, d, "documents"), "doc_id", "text", _capacity(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """By the bucket a container was opened for: containers, tokens of that bucket, tokens that topped up, unused space."""
    c = _capacity(spark, d)
    opened = F.max(F.struct("bucket", "tokens")).alias("o")
    each = p6_pack(spark, d).groupBy("container", "bucket").agg(F.sum("tokens").alias("tokens")).groupBy("container").agg(opened, F.sum("tokens").alias("used"))
    return each.groupBy(F.col("o.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("o.tokens").alias("own_tokens"), F.sum(F.col("used") - F.col("o.tokens")).alias("topped_up"), F.sum(F.lit(c) - F.col("used")).alias("unused")
    )


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the packing must keep: texts, their bytes, texts that are split, gaps or overlaps between pieces, containers over capacity."""
    c = _capacity(spark, d)
    packed = materialize(p6_pack(spark, d), "packed")
    texts = packed.groupBy("doc_id").agg(
        F.sum(F.col("tokens") - END_TOKENS).alias("bytes"), (F.count(F.lit(1)) > 1).alias("split"),
        ((F.sum(F.col("char_end") - F.col("char_start")) == F.max("char_end")) & (F.min("char_start") == 0) & (F.count(F.lit(1)) == F.max("pieces"))).alias("whole"),
    )
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > c).alias("over_capacity"))
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.sum("bytes").alias("bytes"), F.count_if("split").alias("split"), F.count_if(~F.col("whole")).alias("broken")).withColumn("over_capacity", F.lit(over.first()[0]))


def _leaks(spark: SparkSession, d: str, edits: int) -> DataFrame:
    items = table(spark, d, "eval_items").withColumn("by_letters", F.lower(F.split("lang", "[-_]")[0]).isin("zh", "ja"))
    return leaks(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "text", "by_letters", edits=edits)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 0)


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage in which one letter differs, is put in or left out; all of ``p7_found`` are among them."""
    return _leaks(spark, d, 1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_offsets(table(spark, d, "documents"), "doc_id", "text")


#: Lines that may be more than text: their marks lie outside sentences.
_MARKED = r"(^|[\n\r])[ \t]*([#>`~*+•=_-]|[0-9]+[.)])"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of texts without Markdown the characters in sentences, blanks apart: none is left out, none counted twice."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(_MARKED)).select("doc_id", "text")
    s = sentence_offsets(t, "doc_id", "text").join(t, "doc_id")
    inside = F.expr("substring(text, sent_start + 1, sent_end - sent_start)")
    return s.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(inside, _BLANK, ""))).alias("letters"))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranked, p6_found, p6_pack, p6_fill, p6_totals, p7_found, p7_near, p8_found, p8_covered)}

_HELD = """SELECT rule, "from", "to", score FROM (SELECT *, row_number() OVER (PARTITION BY rule, "from", "to" ORDER BY reported_at DESC, finding_id DESC) AS k FROM agent_findings) WHERE k = 1 AND score IS NOT NULL"""
_TOP = f"""SELECT rule, "from", "to", score, r AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY rule, "from" ORDER BY score DESC, "to") AS r FROM ({_HELD})) WHERE r <= 5"""

SQL = {
    "p3_found": f'SELECT rule, "from", "to" FROM ({_TOP})',
    "p3_ranked": _TOP,
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > (SELECT max(capacity) FROM containers)",
    "p6_totals": "SELECT count(text) AS texts, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE strlen(text) + 1 > (SELECT max(capacity) FROM containers)) AS split, 0 AS broken, 0 AS over_capacity FROM documents",
    "p8_covered": f"SELECT doc_id, CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS letters FROM documents WHERE NOT regexp_matches(text, '{_MARKED}') AND regexp_replace(text, '{_BLANK}', '', 'g') != ''",
}

"""Rules documents: a section of a Markdown text read line by line, and layers merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..sources.cards import KINDS

# A heading, those that open the section, and those that name a bucket.
HEADING = r"^ {0,3}(#{1,6})\s+(.*)$"
SECTION = r"(?i)^(memory|记忆)\s*[:：]?\s*(rules?|规则)?\s*$"
BUCKETS = [
    ("deny", "^(never|永远不记|禁止|不要记|不记|do not remember)"),
    ("always", "^(always|总是|记住|应该记|remember)"),
    ("retention", "^(retention|保留|保留期|过期)"),
    ("promotion", "^(promotion|promote|晋升|提升)"),
]


def parse(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, text) to (doc, pos, bucket, value, kind, number): one row per rule."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    title = trim_space(F.regexp_extract("line", HEADING, 2))
    lines = lines.select("doc", "pos", "line", level.alias("level"), title.alias("title"))
    by_doc = Window.partitionBy("doc").orderBy("pos")
    is_start = (F.col("level") > 0) & F.col("title").rlike(SECTION)
    start = F.min(F.when(is_start, F.struct("pos", "level"))).over(Window.partitionBy("doc"))
    lines = lines.withColumn("start", start).where(F.col("pos") > F.col("start.pos"))
    end = F.min(F.when((F.col("level") > 0) & (F.col("level") <= F.col("start.level")), F.col("pos"))).over(Window.partitionBy("doc"))
    lines = lines.withColumn("end", end).where(F.col("end").isNull() | (F.col("pos") < F.col("end")))
    named = F.when(F.col("level") > 0, F.lit("notes"))
    for name, pattern in reversed(BUCKETS):
        named = F.when((F.col("level") > 0) & F.lower("title").rlike(pattern), name).otherwise(named)
    bucket = F.coalesce(F.last(named, ignorenulls=True).over(by_doc), F.lit("notes"))
    text = trim_space(F.regexp_replace(trim_space(F.col("line")), r"^[-*]\s+", ""))
    rules = lines.withColumn("bucket", bucket).where("level = 0").withColumn("value", text).where("value <> ''")
    kind = F.lower(F.regexp_extract("value", r"(?i)^([a-z]+)\s*[:：]\s*([0-9]+)", 1))
    number = F.regexp_extract("value", r"([0-9]+)", 1)
    rules = rules.withColumn("kind", F.when((F.col("bucket") == "retention") & kind.isin(*KINDS), kind)).withColumn("number", F.when(F.col("bucket").isin("retention", "promotion"), F.try_to_number(number, F.lit("999999999")).cast("int")))
    return rules.where("(bucket <> 'retention' OR kind IS NOT NULL) AND (bucket <> 'promotion' OR number IS NOT NULL)").select("doc", "pos", "bucket", "value", "kind", "number")


def merge(rules: DataFrame) -> DataFrame:
    """Layers in order of ``doc``: lists without repeats, the last retention of a kind, the last promotion.

    Of promotion lines in one layer the first counts.
    """
    place = F.struct("doc", "pos")
    lists = rules.where(F.col("bucket").isin("deny", "always", "notes")).groupBy("bucket", "value").agg(F.min(place).alias("at")).select("bucket", "value", F.lit(None).cast("int").alias("number"))
    kept = rules.where("bucket = 'retention'").groupBy("bucket", F.col("kind").alias("value")).agg(F.max_by("number", place).alias("number"))
    first = rules.where("bucket = 'promotion'").groupBy("bucket", "doc").agg(F.min_by("number", "pos").alias("number"))
    promoted = first.groupBy("bucket").agg(F.max_by("number", "doc").alias("number")).select("bucket", F.lit(None).cast("string").alias("value"), "number")
    return lists.unionByName(kept.select("bucket", "value", "number")).unionByName(promoted)

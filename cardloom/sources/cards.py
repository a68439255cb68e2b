"""Cards as Markdown files: a head of ``key: value`` lines, a title line, a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_space

# A card's id, and its kinds.
ID_PATTERN = r"^m-[0-9]{8}-[a-z0-9]{4,10}$"
KINDS = ("fact", "preference", "decision", "procedure", "observation", "reference", "task")
# The keys of a card's head, in the order they are written.
HEAD = [
    ("id", "string"),
    ("kind", "string"),
    ("tags", "array<string>"),
    ("importance", "int"),
    ("confidence", "double"),
    ("created", "timestamp"),
    ("updated", "timestamp"),
    ("lastAccessed", "timestamp"),
    ("accessCount", "bigint"),
    ("validSince", "timestamp"),
    ("validUntil", "timestamp"),
    ("supersedes", "array<string>"),
    ("source", "struct<session:string,turn:int>"),
    ("links", "array<string>"),
]


def _value(raw: Column, kind: str) -> Column:
    """A scalar of the head: JSON strings and flows, plain numbers and words; ~ and null are null."""
    bare = F.when(raw.rlike('^".*"$') | raw.rlike("^'.*'$"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    bare = F.when(raw.isin("null", "~", ""), F.lit(None).cast("string")).otherwise(F.replace(bare, F.lit('\\"'), F.lit('"')))
    if kind.startswith(("array", "struct")):
        return F.from_json(raw, kind)
    if kind == "string":
        return bare
    if kind == "timestamp":
        return F.try_to_timestamp(bare)
    return bare.try_cast(kind)


def parse(files: DataFrame) -> DataFrame:
    """``files`` (path, value: whole text) to cards, with _corrupt naming what is wrong with a file."""
    text = F.regexp_replace("value", "\r\n", "\n")
    parts = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    head = F.filter(F.split(parts, "\n"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]*:"))
    pairs = F.map_from_entries(F.transform(head, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]*):", 1), F.trim(F.regexp_replace(x, "^[A-Za-z][A-Za-z0-9]*:", "")))))
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    rows = files.select("path", parts.alias("h"), F.when(parts != "", pairs).alias("m"), trim_space(body).alias("rest"))
    cols = [_value(F.try_element_at("m", F.lit(k)), t).alias(k) for k, t in HEAD]
    out = rows.select("path", "h", *cols, trim_space(F.substring_index("rest", "\n", 1)).alias("title"), trim_space(F.regexp_replace("rest", r"\A[^\n]*\n?", "")).alias("body"))
    wrong = F.when(F.col("h") == "", "no head").when(~F.coalesce(F.col("id"), F.lit("")).rlike(ID_PATTERN), "bad id").when(~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS), "unknown kind").when(F.col("title") == "", "no title")
    return out.withColumns(
        {
            "importance": F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce("importance", F.lit(5)))),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.6)))),
            "accessCount": F.least(F.lit(1_000_000), F.greatest(F.lit(0), F.coalesce("accessCount", F.lit(0)))).cast("bigint"),
            "_corrupt": wrong,
        }
    ).drop("h")


def read(spark: SparkSession, folder: str, *, strict: bool = False) -> DataFrame:
    """Cards under ``folder``; a partition column ``store=`` becomes a column. ``strict`` fails on a bad file."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "m-*.md").option("recursiveFileLookup", "false").text(folder)
    files = files.withColumn("path", F.col("_metadata.file_path"))
    cards = parse(files)
    if strict:
        bad = F.raise_error(F.concat_ws(": ", "path", "_corrupt"))
        cards = cards.withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull(), bad).otherwise(F.lit(None).cast("string")))
    return cards


def render(cards: DataFrame) -> DataFrame:
    """``cards`` with a column ``markdown``, keys in their fixed order."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith(("array", "struct")):
            return F.coalesce(F.to_json(c), F.lit("[]" if kind.startswith("array") else "null"))
        if kind == "timestamp":
            return F.coalesce(F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"')), F.lit("null"))
        if kind == "string":
            return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return c.cast("string")

    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), shown(k, t)) for k, t in HEAD])
    return cards.withColumn("markdown", F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.col("title"), F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise(F.lit("")), F.lit("\n")))

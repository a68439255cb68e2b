"""Line-first quality rules (DataFrame functions only).

Every line of a text is judged alone: it fails as navigation, boilerplate,
symbols, shouting, or for lack of closing punctuation. Failing lines are
removed; a document that loses more than ``MAX_LOST`` of its text goes.

Defined cases: null text has no words, fails the base rules and is not kept;
blank lines are neither kept text nor lost text; an empty table yields no rows;
columns beside the two named ones are ignored by ``measure`` and passed through
by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE_CLASS, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_LOST = 0.5
# Phrases of boilerplate and navigation, matched in either case.
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie(s)? policy|uses? cookies|lorem ipsum|enable javascript|javascript is (disabled|required)|subscribe to our|sign up for our|click here|read more|powered by|copyright (\(c\)|©))"
NAVIGATION = "home about contact login signin signup menu search next previous back faq help sitemap".split()
#: Words that are one entry of a menu; what stands between entries; what a line starts with if it is a menu.
JOINED = [(r"(about|contact)\s+us\b", "$1"), (r"\b(log|sign)\s+(in|up)\b", "$1$2")]
BETWEEN = r"[\s|>»/•·-]+"
MENU_START = r"(?i)\A[\s|>»/•·-]*(home|about|contact|log|sign|menu|search|next|previous|back|faq|help|sitemap)"
#: A line may end in these, in quotes or brackets after them too.
CLOSING = r"[.!?…:;。！？]['\"”’»)\]]*\s*\z"
#: ``\z``, since ``$`` also stands before a last U+0085, U+2028 or U+2029, which are words.
WORDLESS = r"\A[\x20\x09-\x0D]*\z"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words lying in 3-word windows found twice or more in the text.

    Windows are sorted with their places; neighbours that are equal mark the
    places; covered words are counted from the gaps between marked places.
    """

    def count(a: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(a) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("w"), i.alias("i")),
        )

        def marked(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["w"] == F.get(s, k + 1)["w"]) | (F.when(k > 0, x["w"] == F.get(s, k - 1)["w"]).otherwise(F.lit(False))))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)

        return let(let(F.sort_array(windows), marked), covered)

    return F.when(F.size(ws) < 3, F.lit(0).cast("long")).otherwise(let(ws, count))


def is_menu(line: Column) -> Column:
    """Two or more entries of ``NAVIGATION`` and nothing else, but for closing punctuation.

    Entries are looked up one by one: a pattern that repeats them would use up
    the matcher's stack on a long line.
    """
    bare = F.regexp_replace(F.lower(line), CLOSING, "")
    for pattern, entry in JOINED:
        bare = F.regexp_replace(bare, pattern, entry)
    entries = lambda e: (F.size(e) > 1) & F.forall(e, lambda x: x.isin(*NAVIGATION))
    return line.rlike(MENU_START) & let(F.filter(F.split(bare, BETWEEN), lambda x: x != ""), entries)


def line_fails(line: Column) -> Column:
    """The line-level verdict; a blank line doesn't fail."""
    size = F.length(line)
    symbols = size - F.length(F.translate(line, SYMBOLS, ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    # Within a filter each ``&`` and ``|`` stops at what decides it: cheap tests come first.
    return (
        (symbols * 10 > size)
        | (~line.rlike(CLOSING) & ~line.rlike(WORDLESS))
        | is_menu(line)
        | ((size <= 200) & line.rlike(BOILERPLATE))
        | ((size >= 20) & (upper > 12) & (upper * 10 > letters * 6))
    )


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def kept_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~line_fails(x))


def _full(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(WORDLESS))


def _total(parts: Column) -> Column:
    return F.length(F.array_join(parts, "")).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the base figures, and the line-first verdict."""
    t = F.col("__t")
    base = docs.select(*keep, F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    cut = base.select(*keep, "__id", "__t", words(t).alias("__w"), lines_of(t).alias("__lines"))
    # Generated rows aren't merged into what reads them, so lines and windows are judged once, also below a filter on the verdict.
    judged = F.struct(kept_lines(F.col("__lines")).alias("__kept"), _full(F.col("__lines")).alias("__full"), repeated_words(F.col("__w")).alias("n_repeat_words"))
    cut = cut.select(*keep, "__id", "__t", "__w", "__lines", F.inline(F.array(judged)))
    sums = cut.select(
        *keep,
        F.col("__id").alias("doc_id"),
        F.size("__w").cast("long").alias("n_words"),
        _total(F.col("__w")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_lines_removed"),
        _total(F.col("__full")).alias("line_chars"),
        _total(_full(F.col("__kept"))).alias("line_chars_kept"),
        F.array_join("__kept", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return sums.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("line_chars_kept") >= F.col("line_chars") * (1 - max_lost)))


def report(docs: DataFrame, **options) -> DataFrame:
    return measure(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "line_chars", "line_chars_kept")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, in the input's columns, without their failing lines."""
    out = measure(docs.withColumn("__row", F.struct(*docs.columns)), keep=("__row",), **options).where("kept")
    n_chars = F.length("clean_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("clean_text"), "n_chars": n_chars}
    return out.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])

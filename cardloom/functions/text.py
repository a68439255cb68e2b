"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the data model (wider than Java's \s), and CJK blocks.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_CJK = r"[^\u3400-\u9FFF\uF900-\uFAFF]"


#: The characters of ``SPACE`` one by one.
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim_space(c: Column) -> Column:
    # Only the ends are looked at, so long texts and long runs within them cost nothing.
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of_each(items: Column, key) -> Column:
    """Items whose key hasn't come before, in order: equal keys are neighbours once sorted."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda a: F.filter(a, lambda e, i: (i == 0) | (e["k"] != F.get(a, i - 1)["k"]))
    return F.transform(F.sort_array(F.transform(let(keyed, first), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def tokenize(text: Column) -> Column:
    """ASCII words, then the bigrams of all CJK characters taken together; a lone one stays."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    cjk = F.regexp_replace(low, f"{NOT_CJK}+", "")
    pairs = let(
        F.filter(F.split(cjk, ""), lambda c: c != ""),
        lambda c: F.when(F.size(c) < 2, c).otherwise(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))),
    )
    return F.when(cjk == "", words).otherwise(F.concat(words, pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def first_line(text: Column) -> Column:
    line = trim_space(F.substring_index(text, "\n", 1))
    return F.when(line != "", line).otherwise(F.substring(text, 1, 120))


def snippet(title: Column, body: Column, most: int = 120) -> Column:
    text = trim_space(F.coalesce(body, F.lit("")))
    rest = trim_space(F.regexp_replace(F.substr(text, F.length(title) + 1), rf"\A[{SPACE[1:-1]}:：,，;；—-]+", ""))
    cut = lambda c: F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))
    return F.when(text == "", F.lit("")).when((F.length(title) > 0) & text.startswith(title), cut(rest)).otherwise(cut(text))


def normalize(text: Column) -> Column:
    """Each line's white space collapsed; empty lines and repeats (in either case) dropped."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), collapse), lambda x: x != "")
    return F.array_join(first_of_each(lines, F.lower), "\n")


def sentences(text: Column) -> Column:
    parts = F.split(text, rf"(?<=[。！？!?；;\n])|(?<=[.!?;]){SPACE}+")
    return F.filter(F.transform(parts, collapse), lambda x: x != "")


def strip_reminders(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")


def escape_frame(text: Column) -> Column:
    return F.replace(text, F.lit("</system-reminder>"), F.lit("<\\/system-reminder>"))


def normalize_tags(tags: Column, most: int = 8, length: int = 24) -> Column:
    one = lambda t: F.substring(F.regexp_replace(F.lower(trim_space(t)), f"{SPACE}+", "-"), 1, length)
    return F.slice(F.array_distinct(F.filter(F.transform(tags, one), lambda t: t != "")), 1, most)


def djb2_base36(text: Column) -> Column:
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")), F.lit(5381).cast("long"), lambda a, c: (a * 33 + c).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def slug(path: Column) -> Column:
    norm = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?<!/)/+\z", "")
    bare = F.regexp_replace(F.regexp_replace(norm, rf'[\\/:*?"<>|.{SPACE[1:-1]}]+', "-"), r"\A-+|(?<!-)-+\z", "")
    full = F.when(bare == "", F.lit("root")).otherwise(bare)
    return F.when(F.length(full) > 48, F.concat(F.substring(full, 1, 32), F.lit("-"), djb2_base36(full))).otherwise(full)


def digest(title: Column, body: Column) -> Column:
    return F.sha1(F.concat(title, F.lit("\n"), body).cast("binary"))


def card_id(now: Column, content: Column, seq: Column) -> Column:
    """A deterministic id, so that a repeated run mints the same card: ten characters of base 36 from 60 bits."""
    key = F.sha1(F.concat_ws("\x1f", content, seq.cast("string")).cast("binary"))
    tail = F.right(F.lpad(F.lower(F.conv(F.substring(key, 1, 15), 16, 36)), 12, "0"), F.lit(10))
    return F.concat(F.lit("m-"), F.date_format(now, "yyyyMMdd"), F.lit("-"), tail)


# Words of intent, of preference, and of negation before an intent.
INTENT = (
    "记住|记一下|记下来|记到|别忘了|别忘|忘掉以前.*(?:改用|换成)|以后(?:都要|都得|必须|不要|别再|还是)|下次(?:记得|要|再|都)|长期(?:用|都)|统一(?:用|用)|永远(?:都|要)|默认(?:用|是)"
    "|always remember|\\bremember that\\b|\\bremember to\\b|from now on|going forward|always use|never use|stop using|my preference"
)
PREFERENCE = "偏好|习惯|prefer|always|from now on|going forward|统一|固定|永远|默认|总是|始终"
PREFERENCE_IN_REPLY = PREFERENCE + "|不要|别再|必须|都要"
NEGATION = "不需要|无需|不必|不用|不要|不想|没必要|不要再"


def has_intent(sentence: Column) -> Column:
    """An intent word that no negation stands before."""
    return sentence.rlike(f"(?i)(?<!(?:{NEGATION})\\s{{0,6}})(?:{INTENT})")


def kind_of(sentence: Column, pattern: str = PREFERENCE) -> Column:
    return F.when(sentence.rlike(f"(?i){pattern}"), F.lit("preference")).otherwise(F.lit("fact"))


def intent_sentences(text: Column, most: int = 5) -> Column:
    """Up to ``most`` sentences of 6 to 400 characters with an intent, first of each wording."""
    fit = F.filter(sentences(text), lambda s: (F.length(s) >= 6) & (F.length(s) <= 400) & has_intent(s))
    return F.slice(first_of_each(fit, F.lower), 1, most)


# Marks before a line of a reply, pairs of quotes around it, and the word for no line.
LIST_MARK = r"^\s*(?:[-*•]\s*|[0-9]+[.)]\s*|【[^】]{1,12}】\s*)"
QUOTES = (("「", "」"), ("“", '"'), ('"', '"'), ("'", "'"))
NO_LINE = r"(?i)^none(?![A-Za-z0-9_])"


def reply_lines(text: Column) -> Column:
    """Lines of a model's reply: without list marks and one pair of quotes, 4 to 400 characters, distinct."""

    def bare(line: Column) -> Column:
        x = trim_space(F.regexp_replace(trim_space(line), LIST_MARK, ""))
        inner = trim_space(F.substr(x, F.lit(2), F.length(x) - 2))
        quoted = F.lit(False)
        for a, b in QUOTES:
            quoted = quoted | (x.startswith(a) & x.endswith(b))
        return F.when(quoted & (F.length(x) >= 4), inner).otherwise(x)

    lines = F.filter(F.split(text, "\r?\n"), lambda x: (trim_space(x) != "") & ~trim_space(x).rlike(NO_LINE))
    fit = F.filter(F.transform(lines, bare), lambda x: (F.length(x) >= 4) & (F.length(x) <= 400))
    return first_of_each(fit, F.lower)


def summary_text(text: Column, most: int = 800) -> Column:
    c = collapse(text)
    return F.when((c == "") | (F.upper(c) == "NONE"), F.lit(None).cast("string")).otherwise(F.substring(c, 1, most))

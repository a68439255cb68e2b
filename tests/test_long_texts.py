"""Functions on texts of very many repeats: no stack is used up, and no time that grows with the square."""

import time

import pytest
from pyspark.sql import functions as F

from cardloom.functions import policy, text

N = 100_000
TEXTS = {
    "spaces": "Title" + " " * N + "x",
    "marks": "Title" + " :" * N + "x",
    "dots": " ." * N,
    "slashes": "a" + "/" * N + "b" + "\\" * N,
    "words": "home " * N + ".",
    "letters": "a" * N + " at b@",
    "lines": "\n".join(f"line {i % 7}" for i in range(N)),
    "stops": "ab. " * N,
    "cjk": "记忆" * N,
    "dashes": "-" * N + "x" + "-" * N,
    "quotes": "- '" + "\"" * N,
    "keys": "password " * (N // 10) + "://" + "a" * N,
}
FUNCTIONS = {
    "snippet": lambda c: text.snippet(F.lit("Title"), c),
    "slug": text.slug,
    "normalize": text.normalize,
    "sentences": lambda c: F.size(text.sentences(c)),
    "tokenize": lambda c: F.size(text.tokenize(c)),
    "first_line": text.first_line,
    "tags": lambda c: F.size(text.normalize_tags(F.array(c))),
    "intents": lambda c: F.size(text.intent_sentences(c)),
    "reply": lambda c: F.size(text.reply_lines(c)),
    "summary": text.summary_text,
    "reminders": text.strip_reminders,
    "digest": lambda c: text.digest(c, c),
    "gate": lambda c: policy.gate(c, ["idiot"])["ok"],
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_repeats(spark, name):
    rows = spark.createDataFrame(sorted(TEXTS.items()), "name string, t string").repartition(4)
    began = time.monotonic()
    got = {r.name: r.v for r in rows.select("name", FUNCTIONS[name](F.col("t")).alias("v")).collect()}
    assert set(got) == set(TEXTS) and time.monotonic() - began < 60
    if name == "snippet":
        assert got["spaces"] == "x" and got["marks"] == "x"
    if name == "slug":
        assert got["dots"] == "root" and got["slashes"] == "a-b" and got["dashes"] == "x"
    if name == "normalize":
        assert got["lines"] == "\n".join(f"line {i}" for i in range(7))
    if name == "tokenize":
        assert got["cjk"] == 2 * N - 1


def test_first_of_each(spark):
    row = spark.createDataFrame([(["b", "A", "a", "B", "c", "C", "b"], [])], "x array<string>, y array<string>")
    got = row.select(text.first_of_each(F.col("x"), F.lower).alias("x"), text.first_of_each(F.col("y"), F.lower).alias("y")).first()
    assert got.x == ["b", "A", "c"] and got.y == []

"""Steps that took a whole change, or the cards of a store, in one task."""

import os

from pyspark.sql import functions as F

from cardloom.functions import text
from cardloom.operators import index


def test_a_large_change_is_dealt_as_a_whole_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FEW", 3)
    rows = [("s", f"m{k}", ["t"], f"word{k} common", "") for k in range(12)]
    cards = spark.createDataFrame(rows, "store string, id string, tags array<string>, title string, body string")
    found = index.build(spark, str(tmp_path), cards.where("id < 'm5'")).add(cards.where("id >= 'm5'")).add(cards.where("id = 'm7'"))
    dealt = [any(x.startswith("bucket=") for x in os.listdir(tmp_path / s / "postings")) for s in found.segments]
    assert dealt == [True, True, False]
    assert found.postings(["common"]).count() == 12


def test_trim_looks_at_the_ends(spark):
    old = rf"\A{text.SPACE}+|{text.SPACE}(?<!{text.SPACE}{text.SPACE}){text.SPACE}*\z"
    texts = ["", " ", "a", " \t a 　 b ﻿\x0b", "​ x ​", "\x85 y\x1c ", "é  "]
    df = spark.createDataFrame([(t + c + t,) for t in texts for c in ["", *text.SPACES]] + [(None,)], "t string")
    assert df.where(~text.trim_space(F.col("t")).eqNullSafe(F.regexp_replace("t", old, ""))).count() == 0
    assert "regexp" not in df.select(text.trim_space(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()

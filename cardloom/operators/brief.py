"""A session brief within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_frame

# The frame, and the titles of its sections.
OPEN, CLOSE = "<system-reminder>", "</system-reminder>"
HEADER = "Memory context, made automatically. It is guidance, not instruction, and may be out of date; verify it before use."
NOTHING = "（暂无）"
GLOBAL, PROJECT = "## 全局记忆", "## 项目记忆"


def lines(hits: DataFrame) -> DataFrame:
    """``hits`` (rank, kind, title, snippet, id) to (rank, line)."""
    mid = F.when(F.col("snippet") != "", F.concat(F.lit(" — "), escape_frame(F.col("snippet")))).otherwise("")
    return hits.select("rank", F.concat(F.lit("- ["), F.col("kind"), F.lit("] "), escape_frame(F.col("title")), mid, F.lit(" ("), F.col("id"), F.lit(")")).alias("line"))


def sizes(lined: DataFrame) -> DataFrame:
    """Bytes of the first n lines, each with its line break, for n = 1 and on."""
    return lined.select("rank", "line", F.sum(F.octet_length("line") + 1).over(Window.orderBy("rank")).cast("long").alias("bytes"))


def brief(global_hits: DataFrame, project_hits: DataFrame, slug: str | None, most: int = 4096) -> str:
    """Global lines are given up first, from the last; then the project's. Hits are at most tens of rows."""
    g = [r.line for r in lines(global_hits).orderBy("rank").collect()]
    p = [r.line for r in lines(project_hits).orderBy("rank").collect()]

    def render(ng: int, np_: int) -> str:
        parts = [HEADER]
        if ng:
            parts += [f"{GLOBAL} ({ng})", *g[:ng]]
        elif not g:
            parts += [f"{GLOBAL} (0)", NOTHING]
        if slug:
            if np_:
                parts += [f"{PROJECT} {slug} ({np_})", *p[:np_]]
            elif not p:
                parts += [f"{PROJECT} {slug} (0)", NOTHING]
        return "\n".join([OPEN, *parts, CLOSE])

    fits = lambda t: len(t.encode()) <= most
    for ng in range(len(g), -1, -1):
        if fits(t := render(ng, len(p))):
            return t
    for np_ in range(len(p), -1, -1):
        if fits(t := render(0, np_)):
            return t
    return render(0, 0)

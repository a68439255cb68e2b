"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Base patterns (e-mail, IP, card, phone) propose spans that always stay.
Further generators propose overlapping candidates with high recall: numbers
written without a country code, grouped identity numbers, account numbers,
e-mail addresses spelled out. A model of boosted trees scores a candidate's
format and what stands before and after it; of candidates that overlap, the
most probable stays, if its calibrated probability reaches its kind's threshold.

The model is trained on ``TRAIN_ROWS`` generated, labelled examples (a fixed
bound, independent of the corpus), calibrated on ``CALIBRATION_ROWS`` others;
a kind's threshold is the least that has ``PRECISION`` on these. It is a few
kilobytes and travels with the task. One pass over the texts, no shuffle.

Scans take time in proportion to the text: patterns with an ``@`` or ``(at)`` in
them start there and look back, numbers start at the head of a run.

Defined cases: null text is empty and stays null when redacted; very long texts
are scanned whole; candidates of equal probability are taken in order of
generator, then place; repeated rows each yield a row; an empty table yields no
rows; other columns are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import trimmed
from .boost import BoostedTrees

TRAIN_ROWS = 4000
CALIBRATION_ROWS = 2000
PRECISION = 0.99
CONTEXT = 40

# The base patterns, by kind, in the order of kinds. Of an e-mail address the part from the ``@`` on; what
# precedes it are characters of ``LOCAL``. An IP starts where a run of digits does, as no other start can match.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
BASE = {
    "email": re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# The generators of further candidates; the one of spelled addresses from its "at" on.
GENERATORS = {
    "localphone": re.compile(r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9A-Za-z])"),
    "idnumber": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "spelled": re.compile(r"(?:\x20?\(at\)|\x20?\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,})+"),
}
#: Longest word before a spelled "at", and how many words joined by a spelled dot may stand there.
LONGEST_LOCAL, LOCAL_WORDS = 64, 4
DOT_BEFORE = re.compile(r"(?:\x20dot\x20|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)\Z")
KINDS = [*BASE, *GENERATORS]
# Words near a candidate that speak for or against a kind.
CUES = {
    "phone": re.compile(r"(?i)\b(phone|call|calls|called|dial|ring|tel|telephone|mobile|cell|fax|whatsapp|sms|text|telefon|tél|teléfono|landline|voicemail)\b"),
    "id": re.compile(r"(?i)\b(ssn|social|social security|passport|national id|tax id|insurance|identity|taxpayer)\b"),
    "bank": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta|transfer|payable|deposit)\b"),
    "mail": re.compile(r"(?i)\b(e-?mail|mail|contact|reach|write|address|inbox|ping)\b"),
    "person": re.compile(r"(?i)\b(my|me|mine|her|his|him|our|us|your|their|home|office|desk|work|mom|dad|anytime|after hours)\b"),
    "plain": re.compile(r"(?i)\b(order|invoice|version|isbn|issn|serial|part|item|page|pages|total|score|build|ticket|room|lines?|model|sku|ratio|dated?|tracking|case|sum|population|lot|batch|units|release|section|between|km|points|votes)\b"),
}
_HAS_DIGIT = re.compile(r"[0-9]")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
_SPELLED = re.compile(r"(?:\(at\)|\[at\]|\x20at\x20)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _digits(t: str) -> str:
    return "".join(c for c in t if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping addresses: each ``@`` with its host, and what of the run before it is not yet taken."""
    out, free = [], 0
    for m in BASE["email"].finditer(text):
        at, end = m.span()
        before = text[max(free, text.rfind("@", free, at) + 1) : at]
        size = len(before) - len(before.rstrip(LOCAL))
        if size:
            out.append((0, at - size, end))
            free = end
    return out


def spelled(text: str) -> list[tuple[int, int, int]]:
    """Addresses with a spelled "at", with the words before it that a spelled dot joins."""
    out = []
    for m in GENERATORS["spelled"].finditer(text):
        start = m.start()
        for k in range(LOCAL_WORDS):
            before = text[max(0, start - LONGEST_LOCAL) : start]
            size = len(before) - len(before.rstrip(LOCAL))
            if size < (1 if k else 2):
                break
            start -= size
            joint = DOT_BEFORE.search(text, max(0, start - 8), start)
            if not joint:
                break
            start = joint.start()
        while start < m.start() and text[start] not in LOCAL:  # a joint without a word before it
            start += 1
        if m.start() - start > 1:
            out.append((7, start, m.end()))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's rank, start, end); matches that fail their test are dropped, without retry."""
    out = emails(text) if "@" in text else []
    if not _HAS_DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, *m.span()) for m in BASE["ip"].finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    if _LONG_NUMBER.search(text):
        for m in BASE["card"].finditer(text):
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in BASE["phone"].finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the further generators; they may overlap."""
    out = []
    if _HAS_DIGIT.search(text):
        out += [(4 + k, *m.span()) for k, g in enumerate(("localphone", "idnumber", "iban")) for m in GENERATORS[g].finditer(text)]
    if _SPELLED.search(text):
        out += spelled(text)
    return out


def _dialled(t: str, groups: list[int]) -> bool:
    """Grouped as telephone numbers are, with an area and an exchange that can be dialled."""
    d = _digits(t)
    grouped = groups == [3, 3, 4] and (t[0] == "(" or t.count("-") + t.count(".") == 2)
    return grouped and d[0] in "23456789" and d[3] in "23456789"


def features(text: str, rank: int, start: int, end: int) -> list[float]:
    t, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    d = _digits(t)
    groups = [len(g) for g in re.findall(r"[0-9]+", t)]
    marks = ("(at)" in t) + ("[at]" in t) + ("(dot)" in t) + ("[dot]" in t)
    return [
        *(float(rank == k) for k in range(4, 8)),
        len(t),
        len(d),
        len(set(d)),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        t.count(" "),
        t.count("-"),
        t.count("."),
        float(t.startswith(("(", "0"))),
        float(iban_ok(t)) if rank == 6 else 0.0,
        float(rank == 5 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"),
        float(marks),
        float(rank == 4 and _dialled(t, groups)),
        *(float(bool(c.search(before))) for c in CUES.values()),
        *(float(bool(c.search(after))) for c in CUES.values()),
        float(bool(re.search(r"[$€£#=:/]\s*$", before))),
        float(bool(re.match(r"\s*(%|kg|km|cm|usd|eur|€|pages|lines)", after))),
        float(before[-1:].isalnum()),
        float(bool(re.search(r"[0-9][\x20.,-]*$", before))),
    ]


# Words that examples are filled with.
FILL = "the a of and to in is it was for on that with as at by from we they this have are be not but one all were when there can more if out so said what up its about into than them only other new some time these two may then do first any like now over such our man made after also did many before must through years where much way well down should because long each just state people those mr how too little good world make very year still own see work".split()


def _example(rng: random.Random) -> tuple[str, int, int, int, int]:
    """A text with one candidate: text, rank, start, end, whether it is personal data.

    Half of the examples have a cue, before or after; without one a number is
    personal if its format is that of personal data alone, unless words for plain
    numbers stand near.
    """
    dg = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) if rng.random() < 0.3 else rng.choice(FILL)
    filler = lambda least=2, most=9: " ".join(word() for _ in range(rng.randint(least, most)))
    pick = lambda *xs: rng.choice(xs)
    rank, yes = rng.randint(4, 7), rng.random() < 0.5
    before, after = "", ""
    plain_before = pick("order ", "version ", "total ", "item ", "serial ", "invoice ", "tracking ", "case ", "part ", "ticket ", "sku ", "batch ", "score ")
    plain_after = pick(" units", " pages", " is the order", " in total", " points", " votes", " is the ticket", " is the invoice", " for the part")
    how = rng.random()
    if rank == 4:
        dialled = rng.random() < 0.7
        area, mid = (pick(*"23456789") + dg(2), pick(*"23456789") + dg(2)) if dialled else (dg(3), dg(3))
        sep = pick("-", ".", " ", "-", ".")
        t = f"({area}) {mid}-{dg(4)}" if rng.random() < 0.25 else f"{area}{sep}{mid}{sep}{dg(4)}"
        if rng.random() < 0.2:
            t = pick(f"0{dg(3)} {dg(3)} {dg(4)}", f"0{dg(2)} {dg(4)} {dg(4)}")
        strong = _dialled(t, [len(g) for g in re.findall(r"[0-9]+", t)])
        if yes and (how < 0.45 or not strong):
            before = pick("call ", "phone: ", "tel ", "mobile ", "fax: ", "call me at ", "my cell is ", "text me on ", "ring ", "dial ", "reach us by phone on ", "whatsapp ", "her number is ", "my phone is ")
        elif yes and how < 0.8:
            after = pick(" is my number", " is the number to text", " (mobile)", " (cell)", " is my cell", " to call", " is her phone", " any time you want to call", ", ask for me", " is our office line", " rings my desk")
        elif not yes:
            if how < 0.4 or (strong and how < 0.65):
                before = plain_before
            elif strong or how < 0.8:
                after = plain_after
            else:  # neither cue nor format
                t = f"{dg(3)} {dg(3)} {dg(4)}" if rng.random() < 0.5 else f"{pick('0', '1')}{dg(2)}-{dg(3)}-{dg(4)}"
    elif rank == 5:
        t = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        if yes and how < 0.4:
            before = pick("ssn ", "social security ", "national id: ", "my social is ", "tax id ", "taxpayer ", "identity ")
        elif yes and how < 0.75:
            after = pick(" is my social", " is her ssn", " is his tax id", " on the insurance form", " is my identity number", " is the social security number")
        elif not yes and how < 0.4:
            before = plain_before
        elif not yes and how < 0.6:
            after = plain_after
        elif not yes:
            t = pick(f"000-{dg(2)}-{dg(4)}", f"9{dg(2)}-{dg(2)}-{dg(4)}", f"{dg(3)}-00-{dg(4)}", f"{dg(3)}-{dg(2)}-0000")
    elif rank == 6:
        body = dg(18)
        check = 98 - int(body + "131400") % 97
        t = f"DE{check:02d}{body}" if yes else f"{pick('AB', 'XX', 'ID')}{dg(2)}{dg(pick(12, 16, 20))}"
        if yes is False and iban_ok(t):
            t = t[:-1] + str((int(t[-1]) + 1) % 10)
        if rng.random() < 0.4:
            t = " ".join(t[k : k + 4] for k in range(0, len(t), 4))
        before = pick("iban ", "account ", "", "bank ", "", "pay to ") if yes else pick("serial ", "", "model ", "build ")
    else:
        who, host = word(), "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8)))
        who = who if len(who) > 1 else who + "x"
        if yes:
            at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("(at)", "(dot)"))
            who = f"{who}{pick(' dot ', '.', '_') if at == ' at ' else pick('.', dot)}{word()}" if rng.random() < 0.4 else who
            t, before = f"{who}{at}{host}{dot}{pick('com', 'org', 'net', 'de', 'edu', 'io')}", pick("mail ", "contact ", "", "write ", "reach me: ", "ping ")
            after = pick("", " works too", " is my inbox", "")
        else:
            t, before = f"{who} at {host}.{word() + 'x'}", pick("", "page ", "room ", "we met ")
    lead = filler() + pick(" ", ". ", ", ") + before if rng.random() < 0.85 else before
    return f"{lead}{t}{after}{pick(' ', '. ', ', ')}{filler()}", rank, len(lead), len(lead) + len(t), int(yes)


@functools.cache
def model() -> tuple[BoostedTrees, dict[int, float]]:
    """The trained trees, and each kind's threshold."""
    rng = random.Random(20)

    def sample(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [_example(rng) for _ in range(n)]
        return np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float), np.array([r[1] for r in rows])

    x, y, _ = sample(TRAIN_ROWS)
    trees = BoostedTrees().fit(x, y)
    x, y, rank = sample(CALIBRATION_ROWS)
    p = trees.calibrate(x, y).probability(x)
    limits = {}
    for k in range(4, 8):
        q, z = p[rank == k], y[rank == k]
        order = np.argsort(-q, kind="stable")
        precise = np.cumsum(z[order]) >= PRECISION * np.arange(1, len(order) + 1)
        limits[k] = max(0.5, float(q[order][np.flatnonzero(precise)[-1]])) if precise.any() else 1.1
    return trees, limits


def find(text: str, trees: BoostedTrees, limits: dict[int, float]) -> list[tuple[int, int, int]]:
    """Base spans and the selected further ones, by kind, then start."""
    spans = base_spans(text)
    if found := proposals(text):
        p = trees.probability(np.array([features(text, *c) for c in found]))
        # What is taken, as disjoint runs in order; base spans may overlap each other.
        begins, ends = [], []
        for s, e in sorted((s, e) for _, s, e in spans):
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                begins.append(s)
                ends.append(e)
        for k in np.argsort(-p, kind="stable"):
            rank, s, e = found[k]
            at = bisect.bisect_right(ends, s)  # the first run that ends behind the start
            if p[k] >= limits[rank] and (at == len(begins) or begins[at] >= e):
                begins.insert(at, s)
                ends.insert(at, e)
                spans.append(found[k])
    return sorted(spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes one mark, named for its longest span."""
    out, at, order, k = [], 0, sorted(spans, key=lambda s: (s[1], -s[2])), 0
    while k < len(order):
        rank, s, e = order[k]
        size = e - s
        k += 1
        while k < len(order) and order[k][1] < e:
            if order[k][2] - order[k][1] > size:
                rank, size = order[k][0], order[k][2] - order[k][1]
            e = max(e, order[k][2])
            k += 1
        out += [text[at:s], f"[{KINDS[rank].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    trees, limits = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{KINDS[r]}:{s}:{e}" for r, s, e in spans)
        for b in batches:
            every = [find(t, trees, limits) if t else [] for t in b.column(1).to_pylist()]
            base = [[s for s in spans if s[0] < 4] for spans in every]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(join(s).encode()).hexdigest() for s in base]),
                    pa.array([join(s) for s in every], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(trimmed(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every found span masked, in the input's columns."""
    trees, limits = model()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [mask(t, found) if t and (found := find(t, trees, limits)) else t for t in b.column(place).to_pylist()]
            arrays = list(b.columns)
            arrays[place] = pa.array(texts, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return docs.mapInArrow(trimmed(run), docs.schema)

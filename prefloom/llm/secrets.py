"""Secret scan: fixed patterns, and passwords by their guess cost.

Three patterns find assignments, access keys and hex strings. Values in a credential context that
the patterns leave out (passwords below their length, passphrases, values after other words) are
judged by how many guesses a cracker needs. A dynamic programme cuts the value into segments of the
smallest total cost: common words by rank, dates, repeats, keyboard walks, and brute force for the
rest. A value at or above ``Settings.guesses`` is a secret of kind ``guess``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, keyed, original_id, parts, ready

#: The patterns and the least lengths of their matches (of group 2 for assignments).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: A credential context and the value after it.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|code|phrase|key)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|login|pin)["']?"""
    r"""(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([!-~]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: Common words of passwords, most common first; the rank is the cost.
COMMON = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc princess sunshine football baseball shadow "
    "michael jennifer superman batman trustno iloveyou freedom whatever hello secret summer winter spring autumn love root test "
    "guest user default changeme pass access server system computer internet service mustang jordan harley ranger hunter soccer "
    "hockey killer george andrew charlie thomas robert daniel jessica ashley amanda nicole matrix cookie pepper ginger orange "
    "purple yellow silver golden diamond flower tiger lion eagle falcon phoenix thunder storm chicken cheese banana apple google "
    "london paris berlin madrid january february march april june july august september october november december monday tuesday "
    "friday sunday token key api prod dev staging demo sample example temp public private correct horse battery staple the and"
).split()
LEET = str.maketrans("@4310$57!", "aaeiossti")
#: Longest segment of the programme, so that its time grows with the value's length alone.
LONGEST = 64
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


@dataclass(frozen=True)
class Settings:
    #: Guesses from which a value counts as a secret.
    guesses: float = 1e9
    words: tuple[str, ...] = field(default_factory=lambda: tuple(COMMON))


@lru_cache(maxsize=1)
def neighbours() -> dict[str, set[str]]:
    """Keys that touch on a keyboard, each row half a key to the right of the one above."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            near[key] = {ROWS[j][i] for j, i in around if 0 <= j < len(ROWS) and 0 <= i < len(ROWS[j])}
    return near


@lru_cache(maxsize=8)
def ranks(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}, max(map(len, words), default=0)


def _alphabet(text: str) -> int:
    return max(
        10,
        26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text)
        + 10 * any(c.isdigit() for c in text) + 33 * any(not c.isalnum() for c in text),
    )


DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d)")


def sizes(least: int, longest: int) -> list[int]:
    """Lengths from ``least`` to ``LONGEST``, and ``longest`` itself."""
    out = list(range(least, min(longest, LONGEST) + 1))
    return out + [longest] if longest > LONGEST else out


def segments(value: str, settings: Settings = Settings()) -> tuple[float, list[tuple[int, int, str]]]:
    """Log10 of the guesses of the cheapest segmentation, and its segments (start, end, kind).

    Every further segment doubles the cost, for the guesses at where it starts. Segments are at most
    ``LONGEST`` long; a whole run of one character or keyboard walk may be longer.
    """
    low = value.lower()
    plain = low.translate(LEET)
    rank, longest = ranks(settings.words)
    near, n = neighbours(), len(value)
    brute = math.log10(_alphabet(value))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    run = [0] * (n + 1)   # length of the repeat of one character that ends here
    walk = [0] * (n + 1)  # length of the keyboard walk that ends here
    step = math.log10(2)
    for end in range(1, n + 1):
        run[end] = run[end - 1] + 1 if end > 1 and low[end - 1] == low[end - 2] else 1
        walk[end] = walk[end - 1] + 1 if end > 1 and low[end - 2] in near.get(low[end - 1], ()) else 1
        options = []
        for start in range(end - 1, max(end - LONGEST, 0) - 1, -1):
            options.append((best[start][0] + brute * (end - start) + (step if best[start][2] not in ("", "brute") else 0), start, "brute"))
            if best[start][2] == "brute":
                break
        for size in range(2, min(longest, end) + 1):
            start = end - size
            for form in (low[start:end], plain[start:end]):
                if form in rank:
                    cased = value[start:end]
                    turns = 1 if cased == low[start:end] else 2 if cased in (low[start:end].title(), cased.upper()) else size + 1
                    options.append((best[start][0] + math.log10(rank[form] * turns * (1 if form == low[start:end] else 2)) + step, start, "word"))
        for size in (4, 6, 7, 8, 10):
            if size <= end and DATE.fullmatch(low, end - size, end):
                options.append((best[end - size][0] + math.log10(130 if size == 4 else 48_000) + step, end - size, "date"))
        for size in sizes(3, run[end]):
            options.append((best[end - size][0] + brute + math.log10(size) + step, end - size, "repeat"))
        for period in range(2, min(end // 2, LONGEST) + 1):
            if low[end - period:end] == low[end - 2 * period:end - period]:
                options.append((best[end - period][0] + math.log10(2) + step, end - period, "repeat"))
        for size in sizes(4, walk[end]):
            options.append((best[end - size][0] + math.log10(len(near) * 4 * size), end - size, "walk"))
        best[end] = min(options)
    out, end = [], n
    while end:
        _, start, kind = best[end]
        out.append((start, end, kind))
        end = start
    return best[n][0], out[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, settings: Settings = Settings(), taken: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """Spans of values in a credential context that cost enough guesses and lie in no span of ``taken``."""
    out = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m[1].rstrip("\"',;.)")
        if len(value) < 6 or any(a <= start and start + len(value) <= z for a, z, _ in taken):
            continue
        if segments(value, settings)[0] >= math.log10(settings.guesses):
            out.append((start, start + len(value), "guess"))
    return out


def all_spans(text: str, settings: Settings = Settings()) -> list[tuple[int, int, str]]:
    """Spans of the patterns and of guess costs that no pattern covers whole; by start, then kind."""
    found = base_spans(text)
    return sorted(found + guess_spans(text, settings, found), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text and spans (array of kind, start, end in code points, by start and kind) of every row.

    A null text is an empty one and has no spans; repeated rows are scanned each.
    """
    ready(documents)

    def work(batch):
        for part in parts(batch):
            texts = part.column("text").to_pylist()
            spans = [
                [{"kind": k, "start": a, "end": b} for a, b, k in all_spans(t, settings)]
                for t in texts
            ]
            yield {"doc_id": part.column("doc_id"), "text": part.column("text"), "spans": spans}

    kind = "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>"
    return arrow_map(keyed(documents), work, kind).withColumn("doc_id", original_id())


def digest(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, a checksum of the pattern spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s["kind"] != "guess")).cast("binary")
    return scan(documents, settings).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess")
    )

"""Snippets: the 24 tokens of a body that show most of the query, with the matches marked."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import fold_text
from ..plans.query import Probe

SIZE, OPEN, CLOSE, MORE = 24, "\x02", "\x03", "…"


def spans(body: str) -> list[tuple[str, int, int]]:
    """Folded tokens with their places in the body."""
    out: list[tuple[str, int, int]] = []
    word, start = "", 0
    for i, c in enumerate(body):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            if not word:
                start = i
            word += fold_text(c)
        elif word and 0x300 <= ord(c) <= 0x36F:
            continue
        elif word:
            out.append((word, start, i))
            word = ""
    return out + [(word, start, len(body))] if word else out


def instances(words: list[str], found: list[Probe]) -> list[tuple[int, int, int]]:
    """(token, probe, length) of all matches, in order."""
    out = []
    for k, p in enumerate(found):
        n = len(p.tokens)
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n - 1]) == p.tokens[:-1] and (words[i + n - 1].startswith(p.tokens[-1]) if p.prefix else words[i + n - 1] == p.tokens[-1]):
                out.append((i, k, n))
    return sorted(out)


def snippet(body: str, found: list[Probe], size: int = SIZE) -> str:
    tokens = spans(body)
    hits = instances([t[0] for t in tokens], found)

    def worth(start: int) -> tuple[int, int]:
        """Score of a window, and the start that centres its matches."""
        seen, score, first, last = set(), 0, None, 0
        for at, probe, n in hits:
            if start <= at < start + size:
                score += 1 if probe in seen else 1000
                seen.add(probe)
                first = at if first is None else first
                last = at + n
        if first is None:
            return 0, start
        room = size - (last - first)
        shift = abs(room) // 2 * (1 if room >= 0 else -1)
        return score, max(0, min(first - shift, len(tokens) - size))

    sentences = [0]
    for i, (_, start, _) in enumerate(tokens[1:], 1):
        gap = body[:start]
        if gap[-1:].isspace() and gap.rstrip(" \t\n\r")[-1:] in (".", ":"):
            sentences.append(i)
    best, begin = 0, 0
    for at, _, _ in hits:
        score, start = worth(at)
        if score > best:
            best, begin = score, start
        if len(tokens) > size:
            s = max((x for x in sentences if x <= at), default=0)
            if s < at:
                score = worth(s)[0] + (120 if s == 0 else 100)
                if score > best:
                    best, begin = score, s
    end = min(begin + size, len(tokens))
    left = tokens[begin][1] if begin and tokens else 0
    right = len(body) if end == len(tokens) else tokens[end - 1][2]
    marks: list[list[int]] = []
    for at, _, n in hits:
        if begin <= at < end:
            n = min(n, end - at)
            if marks and at < marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], at + n)
            else:
                marks.append([at, at + n])
    out, place = [], left
    for a, b in marks:
        out += [body[place : tokens[a][1]], OPEN, body[tokens[a][1] : tokens[b - 1][2]], CLOSE]
        place = tokens[b - 1][2]
    return (MORE if begin else "") + "".join(out) + body[place:right] + (MORE if end < len(tokens) else "")


def snippet_udf(found: list[Probe]):
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: snippet(b or "", found))

    return run

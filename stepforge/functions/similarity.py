"""Sequence similarity, the one function that needs Python: difflib's ratio on Arrow batches, by faster string searches."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(a: str, i: int, b: str, j: int, most: int) -> int:
    """Length of the common prefix of a[i:i+most] and b[j:j+most], which both have that length."""
    n, step = 0, 8
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    if n >= most:
        return most
    high = min(n + step, most + 1)  # the prefix has n characters at least and fewer than high
    while high - n > 1:
        middle = (n + high) // 2
        if a[i + n : i + middle] == b[j + n : j + middle]:
            n = middle
        else:
            high = middle
    return n


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib.SequenceMatcher(None, a, b), by its own rules.

    difflib looks for the longest run (the first in a, then the first in b) of characters that are not popular in b, adds
    equal neighbours of any kind, and goes on at both sides. Here str.find looks for the runs, in copies of the texts
    whose popular characters are replaced by one that the other copy does not hold.
    """
    x, y, runs = a, b, [(0, len(a))]
    if len(b) >= 200:
        popular = [c for c, n in Counter(b).items() if n > len(b) // 100 + 1]
        if popular:
            free, other = islice((c for c in map(chr, count()) if c not in a and c not in b), 2)
            x, y = (t.translate(dict.fromkeys(map(ord, popular), c)) for t, c in ((a, free), (b, other)))
            runs = [m.span() for m in re.finditer(f"[^{re.escape(free)}]+", x)]
    ends, back_a, back_b = [e for _, e in runs], a[::-1], b[::-1]
    total, stack = 0, [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        besti, bestj, best = alo, blo, 0
        for start, end in runs[bisect_right(ends, alo) :]:
            if start >= ahi:
                break
            i, end = max(start, alo), min(end, ahi)
            while i + best < end:
                j = y.find(x[i : i + best + 1], blo, bhi)
                while j >= 0:  # it goes on as far as it can, then at later places that hold more
                    best += 1
                    best += shared(x, i + best, y, j + best, min(end - i, bhi - j) - best)
                    besti, bestj = i, j
                    j = y.find(x[i : i + best + 1], j + 1, bhi) if i + best < end else -1
                i += 1
        before = shared(back_a, len(a) - besti, back_b, len(b) - bestj, min(besti - alo, bestj - blo))
        besti, bestj, best = besti - before, bestj - before, best + before
        best += shared(a, besti + best, b, bestj + best, min(ahi - besti, bhi - bestj) - best)
        if best:
            total += best
            if alo < besti and blo < bestj:
                stack.append((alo, besti, blo, bestj))
            if besti + best < ahi and bestj + best < bhi:
                stack.append((besti + best, ahi, bestj + best, bhi))
    return total


def ratio(a: str | None, b: str | None) -> float | None:
    """difflib.SequenceMatcher(None, a, b).ratio(), which tests hold it against."""
    if a is None or b is None:
        return None
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column, wanted: Column) -> Column:
    """The ratio where ``wanted`` holds, else null. Rows that are not wanted send no text to Python."""
    return F.pandas_udf(ratios, "double")(F.when(wanted, a), F.when(wanted, b))


def first_difference(a: str | None, b: str | None, before: int = 50, after: int = 100) -> dict | None:
    """Kind and context of the first place where two texts differ."""
    for tag, a1, a2, b1, b2 in difflib.SequenceMatcher(None, a or "", b or "").get_opcodes():
        if tag != "equal":
            return {"tag": tag, "chosen": (a or "")[max(0, a1 - before) : a2 + after], "rejected": (b or "")[max(0, b1 - before) : b2 + after]}
    return None


def difference_rows(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    none = {"tag": None, "chosen": None, "rejected": None}
    return pd.DataFrame([first_difference(x, y) or none for x, y in zip(a, b, strict=True)], columns=[*none])


def differences(a: Column, b: Column) -> Column:
    return F.pandas_udf(difference_rows, "struct<tag:string,chosen:string,rejected:string>")(a, b)

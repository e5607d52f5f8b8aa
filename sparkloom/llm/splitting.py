"""Cutting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import bisect
import heapq
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.tables import stored

#: Boundaries from strong to weak; the number is the strength of a cut behind the match.
BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]*\n\s*")),
    (4, re.compile(r"\n+")),
    (3, re.compile(r"[.!?…]+[\"”’»)\]]*\s+|[。！？；…]+[”’」』）]*\s*")),
    (2, re.compile(r"[,;:–—]\s+|[，、：—]\s*")),
    (1, re.compile(r"\s+")),
)
#: Share of the overlap by which it may be longer or shorter, to begin at a natural boundary.
TOLERANCE = 0.25


def cuts_of(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """(place, strength) of the boundaries of one level inside text[start:end]."""
    strength, pattern = BOUNDARIES[level]
    return [(m.end(), strength) for m in pattern.finditer(text, start, end) if start < m.end() < end]


def atoms_of(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Cut places and their strengths: down to clauses everywhere, to words and single characters only inside atoms over ``limit``."""
    found: dict[int, int] = {}
    for level in range(4):
        for place, strength in cuts_of(text, 0, len(text), level):
            found.setdefault(place, strength)
    ends = sorted(found) + [len(text)]
    start = 0
    for end in ends:
        if end - start > limit:
            at = start
            words = [p for p, _ in cuts_of(text, start, end, 4)]
            while end - at > limit:
                k = bisect.bisect_right(words, at + limit) - 1
                at = words[k] if k >= 0 and words[k] > at else at + limit
                found[at] = 1 if k >= 0 and words[k] == at else 0
        start = end
    places = sorted(found)
    return places, [found[p] for p in places]


def pieces_of(text: str | None, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, each at most ``max_chars`` long.

    Adjacent segments are merged, the weakest boundary first, then the smallest
    result, then the leftmost, while the merged size plus the overlap fits. Each
    piece repeats ``overlap`` characters of the one before, or up to TOLERANCE
    more or less where a natural boundary is so near. A text that fits is one
    piece, null and empty texts have none. An overlap that leaves no room for
    anything new is an error.
    """
    if not text:
        return []
    if len(text) <= max_chars:
        return [(0, len(text))]
    if not 0 <= overlap < max_chars:
        raise ValueError(f"an overlap of {overlap} characters does not fit pieces of {max_chars}")
    room = max_chars - overlap
    places, strengths = atoms_of(text, room)
    starts = [0, *places]
    ends = [*places, len(text)]
    n = len(starts)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    fits = lambda i: max_chars if i == 0 else room  # noqa: E731 - the first piece has no overlap
    heap = [(strengths[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or ends[j] - starts[i] != size or size > fits(i):
            continue
        ends[i], right[i], alive[j] = ends[j], right[j], False
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (strengths[right[i] - 1], ends[right[i]] - starts[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strengths[i - 1], ends[i] - starts[left[i]], left[i], i))
    out = []
    marks = None
    for i in range(n):
        if not alive[i]:
            continue
        start = starts[i]
        if i and overlap:
            marks = marks or sorted({*places, *(p for p, _ in cuts_of(text, 0, len(text), 4))})
            slack = int(overlap * TOLERANCE)
            lo = max(start - min(max_chars - (ends[i] - start), overlap + slack), out[-1][0] + 1 if out else 0)
            aim = max(start - overlap, lo)
            k = bisect.bisect_left(marks, aim)
            near = [p for p in marks[max(0, k - 1) : k + 1] if lo <= p <= start - overlap + slack]
            start = min(near, key=lambda p: abs(p - aim)) if near else aim
        out.append((start, ends[i]))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def piece_spans(texts: pd.Series, max_chars: pd.Series, overlaps: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in pieces_of(t, m, o)] for t, m, o in zip(texts, max_chars, overlaps, strict=True)])


def plain_type(col: str | Column) -> Column:
    """A source type without case, white space and leading dots."""
    return F.regexp_replace(F.lower(F.trim(col)), r"(?U)^[\s.]+|\s+$", "")


def limited(items: DataFrame, item_id: str, kind: str, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """item_id, n_chars, max_chars, overlap_chars of every item, once per id (of copies the longest).

    ``limits`` is a fixed list of a few dozen rows and is broadcast. Items whose
    document is unknown or of another type have the limits of type ``default``;
    without one they have no limit (null). Only sizes are shuffled, no texts.
    """
    ours = limits.where(F.lower(F.trim("item_kind")) == kind).select(plain_type("source_type").alias("type"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    ours = ours.dropDuplicates(["type"])
    default = ours.where("type = 'default'").select(F.col("max_chars").alias("any_max"), F.col("overlap_chars").alias("any_overlap"))
    own = items.groupBy(F.col(item_id).alias("item_id")).agg(F.max(F.struct(F.length("text").alias("n"), "doc_id")).alias("x")).select("item_id", F.col("x.n").alias("n_chars"), "x.doc_id")
    types = documents.select("doc_id", plain_type("source_type").alias("type")).dropDuplicates(["doc_id"])
    typed = own.join(types, "doc_id", "left").join(F.broadcast(ours), "type", "left").join(F.broadcast(default), F.lit(True), "left")
    return typed.select("item_id", "n_chars", F.coalesce("max_chars", "any_max").alias("max_chars"), F.when(F.col("max_chars").isNotNull(), F.col("overlap_chars")).otherwise(F.col("any_overlap")).alias("overlap_chars"))


def split_items(items: DataFrame, item_id: str, sizes: DataFrame) -> DataFrame:
    """item_id, text, max_chars, spans: the pieces of each text over its limit. Only these texts are moved and go to Python.

    ``sizes`` is limited(items, item_id, ...).
    """
    over = stored(sizes.where("n_chars > max_chars"))
    texts = items.select(F.col(item_id).alias("item_id"), "text").join(over, "item_id").where(F.length("text") == F.col("n_chars")).dropDuplicates(["item_id"])
    return texts.withColumn("spans", piece_spans("text", "max_chars", "overlap_chars"))


def pieces(items: DataFrame, item_id: str, sizes: DataFrame) -> DataFrame:
    """item_id, piece_no (from 0), start_pos, n_chars, max_chars, text of every piece: oversized texts cut, all others whole, null texts left out."""
    sizes = stored(sizes)
    cut = split_items(items, item_id, sizes).select("item_id", "text", "max_chars", F.posexplode("spans").alias("piece_no", "span"))
    part = F.expr("substring(text, span.start + 1, span.end - span.start)")
    cut = cut.select("item_id", "piece_no", F.col("span.start").alias("start_pos"), (F.col("span.end") - F.col("span.start")).alias("n_chars"), "max_chars", part.alias("text"))
    fits = sizes.where("n_chars <= max_chars or max_chars is null")
    texts = items.select(F.col(item_id).alias("item_id"), "text").where("text is not null")
    whole = texts.join(fits, "item_id").where(F.length("text") == F.col("n_chars")).dropDuplicates(["item_id"])
    return whole.select("item_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), "n_chars", "max_chars", "text").unionByName(cut)

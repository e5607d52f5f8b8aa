"""Repair of text from scanned pages.

Lines of the recognised regions are put in reading order; running headers,
footers and page numbers are told by their place and by what recurs on other
pages; words cut at line ends are joined. Words that make up no noticeable share
of the corpus are compared with its whole vocabulary, each distinct word once: a
Levenshtein automaton is intersected with a trie of the vocabulary, whose
branches are spread over the tasks. Candidates are weighed by the kind of
change, their frequency and, place by place, the words beside them. Chunks cut
from the same pages take over what is known about their lines.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import compress, pairwise
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import with_neighbours, with_running
from sparkloom.tables import stored

#: A word (or character triple) with this share of all counts is known and not looked up; so no more than its inverse go to all tasks.
KNOWN_SHARE = 1 / (1 << 18)
LEAST_COUNT = 3
#: A candidate must be so many times as frequent as the word it replaces.
RATIO = 20
#: Words of one branch of the vocabulary that are searched together.
BRANCH = 20_000
#: Bits of the filter that tells which neighbours are counted; what it lets through too much is joined away.
FILTER_BITS = 1 << 26
#: Weight of a word's overall frequency against its neighbours, and how much less likely each kind of change is than the next.
SMOOTHING, KIND_STEP = 2.0, 2.5

HYPHENS = "-‐‑­¬⁃﹣－"
NEVER_OWN = "­¬"
WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:[-‐‑][^\W\d_]+)*"
#: Signs that recognition confuses.
CONFUSED = {
    "0": "oOD", "1": "lIi", "|": "lI", "!": "li", "5": "sS", "8": "B", "6": "bGé", "9": "gq", "2": "zZ", "3": "E", "4": "A", "7": "T", "@": "a", "†": "t", "€": "e", "$": "sS", "£": "E", "¢": "c", "¡": "i", "]": "l", "[": "l", "(": "c", "{": "c",
    "c": "eo", "e": "c", "o": "ae", "a": "o", "u": "n", "n": "u", "h": "b", "b": "h", "f": "t", "t": "f", "i": "l", "l": "it", "I": "l", "v": "y", "y": "v", "q": "g", "g": "q", "s": "5", "B": "8R", "R": "B", "E": "F", "F": "E", "O": "0Q", "Q": "O", "D": "O", "G": "C6", "C": "G",
}
HAN_CONFUSED = {"旳": "的", "土": "上士", "士": "土上", "曰": "日目", "日": "目曰", "目": "日自", "申": "中由甲", "由": "申甲", "仔": "存", "太": "大", "犬": "大太", "耍": "要", "朝": "期", "朋": "期", "人": "入", "入": "人", "己": "已", "已": "己", "巳": "已己", "间": "问", "问": "间", "干": "千于", "于": "干", "末": "未", "未": "末", "侍": "待", "白": "自", "自": "白", "天": "夫", "夫": "天", "八": "入人", "刀": "力", "力": "刀", "住": "往", "折": "拆"}
PAIRS = {"rn": "m", "m": "rn", "nn": "m", "vv": "w", "VV": "W", "cl": "d", "d": "cl", "li": "h", "h": "li", "ii": "uünm", "in": "m", "ri": "n", "tn": "m", "lc": "k", "iii": "m", "ni": "m", "w": "vv", "a'": "á", "e'": "é", "o'": "ó", "u'": "ú", "i'": "í", "fi": "ﬁ", "fl": "ﬂ", "ﬁ": "fi", "ﬂ": "fl"}
PAGE_NO = re.compile(
    r"[\s\-–—·•.~=*|(\[<]*(?:(?:page|pag\.?|pág\.?|página|seite|s\.|p\.?|pp\.?|bl\.|blatt|folio|f\.|nr\.?|no\.?|n[.°º]|第|共)\s*)?(?:[\dlIiOoSsBz|]{1,5}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8}|[〇零一二三四五六七八九十百]{1,5})"
    r"(?:\s*(?:/|of|von|de|sur|aus|di|-|–)\s*[\dlIiOoSsBz|]{1,5})?\s*(?:页|頁)?(?:\s*(?:/|共)\s*[\dlIO]{1,5}\s*页?)?[\s\-–—·•.~=*|)\]>]*",
    re.I,
)
MARKED = re.compile(r"[\-–—·•~=|(\[]\s*\S.*\S?\s*[\-–—·•~=|)\]]|.*(?:page|pag|pág|seite|blatt|folio|第|页|\bp\.?\s?\d|/|\bof\b|\bvon\b|\bsur\b|\bde\b).*", re.I)
ROMAN = re.compile(r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
#: Lines at the edges of a page that can be furniture.
EDGE_LINES = 2
#: Place of regions without one; lines of a paragraph that are put together at a time.
NO_ORDER = 1 << 30
PARAGRAPH_LINES = 2000


def skeleton(line: str | Column) -> Column:
    """A line without numbers and without what recognition confuses, so that a running header is equal on all pages."""
    plain = F.lower(F.trim(line))
    plain = F.regexp_replace(plain, r"^[\dlio|]{1,5}\s{1,}|\s{1,}[\dlio|]{1,5}$", "")
    plain = F.regexp_replace(plain, "rn", "m")
    plain = F.regexp_replace(plain, r"^.{1,40}\s·\s(?=.{6})", "")  # the section before the running title
    plain = F.translate(plain, "|!i10oce58†@—–旳土曰日人己间耍申朝仔", "llllooccsbta--的上目目入已问要中期存")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[0-9]+", "#"), r"\s+", " "))


# ---- vocabulary ----


def vocabulary(texts: DataFrame) -> DataFrame:
    """word, n: all words of the corpus in lower case, and all triples of Chinese characters (pairs where there are but two); counted per batch before the shuffle."""

    def count(batches):
        for batch in batches:
            out = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([out.field("values"), out.field("counts")], names=["word", "n"])

    letters = r"[\p{L}&&[^\p{IsHan}]]+"
    latin = F.regexp_extract_all(F.lower("text"), F.lit(rf"{letters}(?:['’]{letters})*(?:[-‐‑]{letters})*"), F.lit(0))
    runs = F.regexp_extract_all("text", F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    triples = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 2, F.lit(1))), lambda i: F.substring(r, i, F.lit(3)))))
    both = texts.where(F.length("text") > 0).select(F.concat(latin, triples).alias("words"))
    return both.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def within(word: str, trie: dict, limit: int) -> list[tuple]:
    """Entries of the trie within Levenshtein distance ``limit`` (at most 2) of a word.

    The trie is of nested dictionaries, whose key "" holds the entry of the word
    that ends there. The automaton's state is three sets of places in the word,
    as bits, reached with no, one or two changes; it moves along the trie's branches.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    end = 1 << len(word)
    full = 2 * end - 1
    found = []
    stack = [(trie, 1, 3 & full if limit else 0, 7 & full if limit > 1 else 0)]
    while stack:
        node, a, b, c = stack.pop()
        for sign, child in node.items():
            if sign == "":
                if (a | b | c) & end:
                    found.append(child)
                continue
            m = masks.get(sign, 0)
            x = (a & m) << 1
            y = z = 0
            if limit:
                y = ((b & m) << 1 | a | a << 1 | x << 1) & full
            if limit > 1:
                z = ((c & m) << 1 | b | b << 1 | y << 1) & full
            if x | y | z:
                stack.append((child, x, y, z))
    return found


def change_kind(word: str, candidate: str) -> int:
    """How well recognition explains the change: 3 a sign or digit for the letter it looks like, 2 letters that are confused or another sign for a letter, 1 another single letter inside, 0 not at all."""
    a = 0
    while a < min(len(word), len(candidate)) and word[a] == candidate[a]:
        a += 1
    b = 0
    while b < min(len(word), len(candidate)) - a and word[-1 - b] == candidate[-1 - b]:
        b += 1
    was, now = word[a : len(word) - b], candidate[a : len(candidate) - b]
    explained = _explained(was, now)
    if not explained and a:  # the changed pair may share a letter with what is before or behind it
        explained = _explained(word[a - 1 : len(word) - b], candidate[a - 1 : len(candidate) - b])
    if not explained and b:
        explained = _explained(word[a : len(word) - b + 1], candidate[a : len(candidate) - b + 1])
    odd = any(not c.isalpha() and c not in "-’'" for c in word) or ("'" in was)
    if explained:
        return 3 if odd else 2
    if len(was) == len(now) == 1 and odd:
        return 2
    if len(was) == len(now) == 1 and len(word) >= 6:
        return 1
    return 1 if odd and len(was) <= 2 and len(now) <= 2 else 0


def _explained(was: str, now: str) -> bool:
    if len(was) == len(now) and was:
        return all(x == y or y in CONFUSED.get(x, "") or y.lower() in CONFUSED.get(x, "").lower() or x in CONFUSED.get(y, "") for x, y in zip(was, now, strict=True))
    return now in PAIRS.get(was, "\0") and now != "" or was in PAIRS and now != "" and now in PAIRS[was]


def latin_kind(word: str, candidate: str) -> int:
    """change_kind() in either case; 0 if words so short are not told apart by it."""
    low = word.lower()
    kind = max(change_kind(low, candidate), change_kind(word, candidate) if word != low else 0)
    return kind if candidate != low and kind >= (3 if len(low) < 3 else 1) else 0


def cores(word: str | Column) -> Column:
    """A word without its first, its last, both or no characters."""
    w = F.col(word) if isinstance(word, str) else word
    return F.array_distinct(F.array(*[F.substring(w, F.lit(1 + a), F.greatest(F.length(w) - a - b, F.lit(0))) for a in (0, 1) for b in (0, 1)]))


def branches(words: DataFrame, query: bool) -> DataFrame:
    """Adds branch to (low, ...): the parts of the vocabulary where words within two changes are filed.

    Two words within two changes have the same first sign, or the same last one,
    or one change at either end and the same core; their lengths differ by two at
    most. So a word is filed by first sign and length, last sign and length, and
    cores, and meets all others that it can match in one of the three.
    """
    n = F.length("low")
    lengths = F.sequence(F.greatest(n - 2, F.lit(1)), n + 2) if query else F.array(n)

    def by_end(sign: str, end: Column) -> Column:
        return F.transform(lengths, lambda k: F.concat(F.lit(sign), end, k.cast("string")))

    ends = [by_end("^", F.substring("low", 1, 1)), by_end("$", F.substring("low", -1, 1))]
    return words.withColumn("branch", F.explode(F.concat(*ends, F.transform(cores("low"), lambda c: F.concat(F.lit("="), c)))))


def latin_candidates(unknown: DataFrame, table: DataFrame) -> DataFrame:
    """word, candidate, kind, n for (word, count): every word of the vocabulary within two changes that may be its right reading.

    Both sides meet by branches(). A branch of more than BRANCH words is divided
    by a hash, and words are looked up in all its parts, so a task holds one trie
    of bounded size at a time. A candidate must be RATIO times as frequent as the
    word, hence occur RATIO / 5 times at least; rarer ones are not filed.
    """
    known = table.where((F.col("n") >= RATIO / 5) & (F.length("word") > 1) & ~F.col("word").rlike(r"^\p{IsHan}")).select(F.col("word").alias("low"), "n")
    filed = branches(known, False)
    large = filed.groupBy("branch").agg(F.ceil(F.count("*") / BRANCH).cast("int").alias("parts")).where("parts > 1")
    filed = filed.join(large, "branch", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.hash("low"), F.col("parts"))).otherwise(0))
    asked = branches(unknown.withColumn("low", F.lower("word")), True).join(large, "branch", "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = filed.select("branch", "part", F.lit(0).alias("side"), F.col("low").alias("word"), "n").unionByName(asked.select("branch", "part", F.lit(1).alias("side"), "word", F.col("count").alias("n")))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = both.repartition(tasks, "branch", "part").sortWithinPartitions("branch", "part", "side")

    def look_up(batches):
        at, trie = None, {}
        for batch in batches:
            out = []
            for branch, part, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (branch, part) != at:
                    at, trie = (branch, part), {}
                if side == 0:
                    node = trie
                    for c in word:
                        node = node.setdefault(c, {})
                    node[""] = (word, n)
                elif trie:
                    low = word.lower()
                    for candidate, m in within(low, trie, 1 if len(low) <= 3 else 2):
                        if m >= RATIO * (n + 0.2):
                            kind = latin_kind(word, candidate)
                            if kind > 1 or kind and n == 0:
                                out.append((word, candidate, kind, m))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["word", "candidate", "kind", "n"])

    return sorted_rows.mapInArrow(look_up, "word string, candidate string, kind int, n long").distinct()


def confused_with(sign: Column) -> Column:
    """The signs that recognition takes ``sign`` for, as a string."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in HAN_CONFUSED.items() for x in kv])[sign], F.lit(""))


def han_candidates(unknown: DataFrame, table: DataFrame) -> DataFrame:
    """word, candidate, kind, n for character triples: triples with the same outer characters; joins on those."""
    own = unknown.where(F.col("word").rlike(r"^\p{IsHan}{3}$")).select("word", "count", F.substring("word", 1, 1).alias("a"), F.substring("word", 2, 1).alias("was"), F.substring("word", 3, 1).alias("z"))
    known = table.where((F.col("n") >= RATIO / 5) & F.col("word").rlike(r"^\p{IsHan}{3}$"))
    known = known.select(F.col("word").alias("candidate"), "n", F.substring("word", 1, 1).alias("a"), F.substring("word", 2, 1).alias("now"), F.substring("word", 3, 1).alias("z"))
    both = own.join(known, ["a", "z"]).where((F.col("was") != F.col("now")) & (F.col("n") >= RATIO * (F.col("count") + 0.2)))
    return both.select("word", "candidate", F.when(F.contains(confused_with(F.col("was")), F.col("now")), 3).otherwise(2).alias("kind"), "n")


def edge_candidates(unknown: DataFrame, pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """word, candidate, kind, n for pairs at the beginning (^) or end ($) of a run: the outer character is replaced, if it is confused with the new one or hardly ever seen.

    ``pairs`` and ``signs`` count pairs and single characters. Confused characters
    give their few candidates at once; only pairs with a character that the
    corpus hardly has are joined with all pairs that share the other one.
    """
    own = unknown.where(F.col("word").rlike(r"^[\^$]")).select("word", F.substring("word", 1, 1).alias("side"), F.substring("word", 2, 1).alias("a"), F.substring("word", 3, 1).alias("b"))
    own = own.withColumn("odd", F.when(F.col("side") == "^", F.col("a")).otherwise(F.col("b"))).withColumn("stays", F.when(F.col("side") == "^", F.col("b")).otherwise(F.col("a")))
    likely = own.withColumn("new", F.explode(F.split(confused_with(F.col("odd")), ""))).where("new <> ''")
    likely = likely.withColumn("pair", F.when(F.col("side") == "^", F.concat("new", "b")).otherwise(F.concat("a", "new")))
    likely = likely.join(pairs.where(F.col("n") >= RATIO), "pair").select("word", F.col("pair").alias("candidate"), F.lit(3).alias("kind"), "n")
    rare = own.join(signs.where(F.col("n") >= LEAST_COUNT).select(F.col("sign").alias("odd")), "odd", "left_anti")
    often = signs.where(F.col("n") >= RATIO).select(F.col("sign").alias("new"))
    filed = pairs.where(F.col("n") >= RATIO).select(F.col("pair").alias("candidate"), "n", F.explode(F.array(F.struct(F.lit("^").alias("side"), F.substring("pair", 2, 1).alias("stays"), F.substring("pair", 1, 1).alias("new")), F.struct(F.lit("$").alias("side"), F.substring("pair", 1, 1).alias("stays"), F.substring("pair", 2, 1).alias("new")))).alias("f"))
    filed = filed.select("candidate", "n", "f.*").join(often, "new", "left_semi")
    odd = rare.join(filed, ["side", "stays"]).where(F.col("odd") != F.col("new")).select("word", "candidate", F.lit(2).alias("kind"), "n")
    return likely.unionByName(odd).groupBy("word", "candidate").agg(F.max("kind").alias("kind"), F.max("n").alias("n"))


# ---- lines ----


def region_lines(regions: DataFrame) -> DataFrame:
    """doc_id, page, ord, line_no, n_lines, record_id, line of every line of every region, once per region_id; null texts have none."""
    own = regions.where("text is not null and region_id is not null").dropDuplicates(["region_id"])
    parts = F.split("text", r"\r\n|[\r\n]")
    rows = own.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("page_number", F.lit(-1)).alias("page"), F.coalesce("region_order", F.lit(NO_ORDER)).alias("ord"), F.col("region_id").alias("record_id"), F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """The same of chunks that were taken from pages."""
    own = chunks.where("parent_chunk_id is null and text is not null and chunk_id is not null").dropDuplicates(["chunk_id"])
    parts = F.split("text", r"\r\n|[\r\n]")
    rows = own.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("page_number", F.lit(-1)).alias("page"), F.coalesce("position", F.lit(NO_ORDER)).alias("ord"), F.col("chunk_id").alias("record_id"), F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


PAGE_NO_JVM = r"(?i)^[\s\-–—·•.~=*|(\[<]*(?:(?:page|pag\.?|pág\.?|página|seite|s\.|p\.?|pp\.?|bl\.|blatt|folio|f\.|nr\.?|no\.?|n[.°º]|第|共)\s*)?(?:[\dlIiOoSsBz|]{1,5}|[ivxlcdm]{1,8}|[〇零一二三四五六七八九十百]{1,5})(?:\s*(?:/|of|von|de|sur|aus|di|-|–)\s*[\dlIiOoSsBz|]{1,5})?\s*(?:页|頁)?(?:\s*[/共]\s*[\dlIO]{1,5}\s*页?)?[\s\-–—·•.~=*|)\]>]*$"
MARKED_JVM = r"(?i)^[\-–—·•~=|(\[]\s*\S.*[\-–—·•~=|)\]]\s*$|page|pag|pág|seite|blatt|folio|第|页|^p\.?\s?[\dlo]|/|\bof\b|\bvon\b|\bsur\b|\bde\b"


def furniture(lines: DataFrame, areas: bool = True) -> DataFrame:
    """Adds kind: header, page_no, or null for running text; and the line's skeleton, and the step from its page to its number.

    A line at the edge of a page is a header or footer if its skeleton is at the
    edge of two pages of the document, or of many documents and hardly ever
    inside a page. A bare number at the edge is a page number if it is marked as
    one or if the numbers of other pages lie in step with it. Counts are summed
    before the shuffle, so documents of any number of pages are fine. All lines
    of an area of the page stand at its place; those of records that are not
    areas, such as chunks, behind the lines of the records before.
    """
    pages = lines.groupBy("doc_id", "page").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.min_by("n_lines", "ord").alias("first"), F.max_by("n_lines", "ord").alias("last"))
    rows = lines.join(pages, ["doc_id", "page"]).withColumn("skel", skeleton("line"))
    above, below = F.col("line_no"), F.col("n_lines") - 1 - F.col("line_no")
    top = F.when(F.col("ord") == F.col("low"), above).otherwise(F.col("ord") - F.col("low") + (F.lit(0) if areas else F.col("first") - 1 + above))
    end = F.when(F.col("ord") == F.col("high"), below).otherwise(F.col("high") - F.col("ord") + (F.lit(0) if areas else F.col("last") - 1 + below))
    rows = rows.withColumn("edge", F.least(top, end) < EDGE_LINES).withColumn("outer", F.least(top, end) == 0)
    rows = rows.withColumn("bare", F.col("line").rlike(PAGE_NO_JVM) & F.col("line").rlike(r"[\dlIOo]|(?i)^\W*[ivxlcdm]+\W*$|[〇零一二三四五六七八九十]"))
    digits = F.translate(F.regexp_extract("line", r"([\dlIiOoSsBz|]{1,5})", 1), "lIi|OoSsBz", "111100" + "5582")
    rows = rows.withColumn("step", F.when(F.col("edge") & F.col("bare"), digits.try_cast("int") - F.col("page")))
    rows = stored(rows.drop("low", "high", "first", "last"))
    words = ~F.col("bare") & (F.length("skel") >= 3)
    own = rows.where(F.col("edge") & words).groupBy("doc_id", "skel", "page").agg(F.max(F.col("outer").cast("int")).alias("outer_once"))
    own = own.groupBy("doc_id", "skel").agg(F.count("*").alias("pages"), F.max("outer_once").alias("outer_once")).where("pages >= 2 and outer_once = 1")
    long = rows.groupBy("doc_id", "page").agg(F.lit(1).alias("one")).groupBy("doc_id").agg(F.count("*").alias("of"))
    own = own.join(long, "doc_id").where((F.col("pages") >= 3) | (F.col("pages") >= 0.4 * F.col("of"))).where(F.col("skel").rlike(r"\s|[^\p{L}\s]|\p{IsHan}{5}") | (F.col("pages") >= 3))
    # by the hash of the skeleton, so that short rows are shuffled
    each = rows.where(words).groupBy(F.xxhash64("skel").alias("code"), "doc_id").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("int")).alias("at_edge"))
    everywhere = each.groupBy("code").agg(F.sum("n").alias("n"), F.sum("at_edge").alias("at_edge"), F.count("*").alias("docs")).where("docs >= 5 and at_edge >= 0.8 * n").select("code")
    steps = rows.where("step is not null").groupBy("doc_id", "step").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high")
    # stored, so that their size is known when the joins are planned: small ones go to all tasks and no line is shuffled
    own, everywhere, steps = (stored(x) for x in (own.select("doc_id", "skel", F.lit(True).alias("own_head")), everywhere.withColumn("all_head", F.lit(True)), steps.select("doc_id", "step", F.lit(True).alias("stepped"))))
    out = rows.join(own, ["doc_id", "skel"], "left").withColumn("code", F.xxhash64("skel")).join(everywhere, "code", "left").join(steps, ["doc_id", "step"], "left")
    marked = F.col("line").rlike(MARKED_JVM)
    roman = F.trim("line").rlike(r"^[ivxl]{1,8}$|^[IVXL]{2,8}$")
    kind = F.when(F.col("edge") & F.col("bare") & (F.coalesce("stepped", F.lit(False)) | marked | (roman & F.col("outer"))), "page_no").when(F.col("edge") & ~F.col("bare") & (F.coalesce("own_head", F.lit(False)) | F.coalesce("all_head", F.lit(False))), "header")
    return out.select(*lines.columns, "skel", "step", kind.alias("kind"))


HAN_RUN = re.compile(r"[一-鿿]{2,}")
CODE = re.compile(r"[_/\\=#]|\d.*[.:]\d|^v\d|^[A-Z]{1,3}-?\d|^0x|\.\w{2,4}$|^\W*[\d.,:%+\-–/]+\W*$|^[A-Z0-9]+-[A-Z0-9]+$|@\w+\.")
NUMERIC = re.compile(r"^[\dlOoI]+$")
AROUND = ".,;:?¿“”\"„»«…)(‘’–—。，、；：？！《》（）*"


def plain_word(token: str) -> str:
    word = token.strip(AROUND).rstrip("!")
    return word[1:] if word[:1] == "¡" and token.endswith("!") else word


class Memo(dict):
    """What a function gives for each argument, kept for those seen; begun anew when it has grown large."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, x):
        if len(self) > 200_000:
            self.clear()
        self[x] = out = self.f(x)
        return out


def unknown_parts(token: str, counts: dict[str, int]) -> tuple[tuple[int, int, str], ...]:
    """(place, length, word) of what is not known of a token without Chinese characters: itself, parts at hyphens, or, marked #, a number with letters."""
    raw = plain_word(token)
    low = raw.lower()
    if len(raw) < 2 or low in counts or low.replace("’", "'") in counts or low.replace("'", "’") in counts:
        return ()
    if CODE.search(raw) or any("一" <= c <= "鿿" for c in raw):
        return ()
    at = token.index(raw)
    letters, numeric = sum(c.isalpha() for c in raw), NUMERIC.match(raw) and any(c.isdigit() for c in raw)
    if letters * 2 < len(raw) or numeric:
        return ((at, len(raw), "#" + raw),) if numeric and letters else ()
    parts = [(m.start(), m.group()) for m in re.finditer(r"[^\-‐‑/’]+", raw)]
    if len(parts) == 1:
        return ((at, len(raw), raw),)
    if all(p.lower() in counts or len(p) < 2 for _, p in parts):
        return ()
    return tuple((at + i, len(p), p) for i, p in parts if len(p) > 1 and p.lower() not in counts)


def unknown_words(line: str, before: str | None, behind: str | None, counts: dict[str, int], han: set[str], parts: Memo) -> list[tuple[int, int, str, str, str]]:
    """(place, length, word, left, right) of tokens and character triples of a line that are not known.

    left and right are what stands beside a word: the words before and behind,
    for a triple the two characters before it and behind it. The halves of words
    cut at the line's ends are not looked at. Pairs at the beginning and end of a
    run of Chinese characters are marked ^ and $, numbers #. ``parts`` keeps
    unknown_parts() of tokens.
    """
    out = []
    tokens = line.split()
    if any(map(parts.__getitem__, tokens)):
        starts = [m.start() for m in re.finditer(r"\S+", line)]
        first, last = has_mark(before), has_mark(line)
        near = [(before or "").split()[-1:], (behind or "").split()[:1]]
        around = [plain_word(x).lower() for x in [*(near[0] or [""]), *tokens, *(near[1] or [""])]]
        for k, token in enumerate(tokens):
            if (k == 0 and first) or (k == len(tokens) - 1 and last):
                continue
            found = parts[token]
            whole = len(found) == 1
            out += [(starts[k] + at, n, word, around[k] if whole else "", around[k + 2] if whole else "") for at, n, word in found]
    if line.isascii():
        return out
    out += [(m.start() + 1, 1, m.group(), "", "") for m in re.finditer(r"[一-鿿][—–-][一-鿿]", line) if f"{m.group()[0]}一{m.group()[2]}" in counts]
    for m in HAN_RUN.finditer(line):
        run, at = m.group(), m.start()
        if run[:2] not in han:
            out.append((at, 1, "^" + run[:2], "", run[2:4]))
        if (len(run) > 2 and run[-2:] not in han) or (len(run) == 2 and run not in han):
            out.append((at + len(run) - 1, 1, "$" + run[-2:], run[-4:-2], ""))
        for i in range(1, len(run) - 1):
            t = run[i - 1 : i + 2]
            if t not in counts and run[max(0, i - 2) : i + 1] not in counts and run[i : i + 3] not in counts:
                out.append((at + i, 1, t, run[max(0, i - 2) : i], run[i + 1 : i + 3]))
    return out


def has_mark(line: str | None) -> bool:
    """Whether a line ends with a letter and a hyphen or similar mark."""
    end = line.rstrip()[-2:] if line else ""
    return len(end) == 2 and end[1] in HYPHENS and end[0].isalpha()


LINE_END = re.compile(rf"([^\W\d_][\w’']*(?:-[^\W\d_]+)*)([{HYPHENS}])\s*$")
LINE_START = re.compile(r"\W*([^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*)")


def end_forms(line: str, next_line: str | None) -> list[str] | None:
    """The words that decide whether a line ends inside a word: joined, with a hyphen (two forms each), and the halves. None if nothing hints at it; empty if the mark alone tells."""
    if line.rstrip()[-1:] not in tuple(HYPHENS):
        return None
    m = LINE_END.search(line)
    if not m:
        return None
    left, mark = m.group(1).lower(), m.group(2)
    if mark in NEVER_OWN:
        return []
    n = LINE_START.match(next_line or "")
    right = n.group(1).lower() if n else ""
    last = left.rsplit("-", 1)[-1]
    near = right.split("-")[0]
    return [left + right, last + near, f"{left}-{right}", f"{last}-{near}", last, right]


def cut_lines(scanned: DataFrame, table: DataFrame) -> DataFrame:
    """source, record_id, line_no, hyphenation of lines with end_forms(), which are looked up in the whole vocabulary.

    A word is cut if its joined form is more frequent than the one with a hyphen
    or, when neither is known, if one of the halves is no word.
    """
    keys = ["source", "record_id", "line_no"]
    asked = scanned.where(F.size("forms") > 0).select(*keys, F.posexplode("forms").alias("form", "word"))
    known = table.where(F.col("n") >= LEAST_COUNT).select("word", "n")
    counts = asked.join(known, "word", "left").groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("form") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(6)], F.max(F.when(F.col("form") == 5, F.col("word"))).alias("right"))
    whole, hyphened = (F.when(F.col(a) > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("n0", "n1"), ("n2", "n3")))
    cut = F.when(F.col("right") == "", F.col("n4") == 0).when((whole > 0) | (hyphened > 0), whole > hyphened).otherwise((F.col("n4") == 0) | (F.col("n5") == 0))
    told = scanned.where(F.size("forms") == 0).select(*keys, F.lit(True).alias("hyphenation"))
    return counts.select(*keys, cut.alias("hyphenation")).unionByName(told)


def known_in_tasks(table: DataFrame):
    """Words and triples with KNOWN_SHARE of all counts, and the pairs in these triples, as a broadcast variable; bounded by the share."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(LEAST_COUNT, total * KNOWN_SHARE)
    hot = table.where((F.col("n") >= least) & (F.length("word") <= 40)).select("word").toArrow()
    words = hot.column("word").to_pylist()
    pairs = {p for w in words if "一" <= w[0] <= "鿿" for p in (w[:2], w[-2:])}
    return table.sparkSession.sparkContext.broadcast((dict.fromkeys(words, 1), pairs))


def neighbour_counts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n: how often two words ("a b") follow each other in the texts of ``documents``, for the keys of ``wanted`` (candidate, key).

    Bit filters of fixed size, built in Spark, tell the tasks which words and
    neighbours may be wanted, so only these are counted; the join removes what
    they let through by chance. Counted per batch before the shuffle.
    """

    def bits_of(text: Column) -> np.ndarray:
        place = F.pmod(F.crc32(text.cast("binary")), F.lit(FILTER_BITS)) + 1
        rows = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        filled = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in rows:  # places and buckets count from 1
            filled[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        return filled

    shared = documents.sparkSession.sparkContext.broadcast((bits_of(F.col("candidate")), bits_of(F.col("key"))))
    word = re.compile(rf"[^\W\d_]+(?:[{HYPHENS}'’][^\W\d_]+)*")

    def count(batches):
        words, pairs = (memoryview(x) for x in shared.value)
        hit = lambda bits, text: bits[(p := zlib.crc32(text.encode()) % FILTER_BITS) // 8] >> p % 8 & 1
        may = Memo(lambda w: hit(words, w))
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                own = word.findall(text.lower())
                flags = list(map(may.__getitem__, own))
                seen.update(compress(pairwise(own), map(or_, flags, flags[1:])))
            found = [(key, n) for (a, b), n in seen.items() if hit(pairs, key := f"{a} {b}")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["key", "n"])

    texts = documents.where(F.length("text") > 0).select("text")
    counted = texts.mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.join(wanted.select("key").distinct(), "key", "left_semi")


def in_context(places: DataFrame, table: DataFrame, documents: DataFrame) -> DataFrame:
    """word, left, right, candidate, kind: the likeliest of several candidates for each distinct (word, left, right).

    ``places`` has word, left, right and cands. Naive Bayes: the kind of change,
    the candidate's own frequency, and how often it follows ``left`` and precedes
    ``right``; for character triples the triples that overlap with it are counted.
    """
    flat = places.select("word", "left", "right", F.explode("cands").alias("c")).select("word", "left", "right", "c.candidate", "c.kind", "c.n")
    han = F.col("word").rlike(r"^[\^$]?\p{IsHan}")
    c = F.regexp_replace("candidate", "^[\\^$]", "")
    flat = flat.withColumn("before", F.when(F.col("left") == "", "").when(han, F.substring(F.concat("left", F.when(F.col("word").startswith("$"), c).otherwise(F.substring(c, 2, 1))), -3, 3)).otherwise(F.concat_ws(" ", "left", "candidate")))
    flat = flat.withColumn("behind", F.when(F.col("right") == "", "").when(han, F.substring(F.concat(F.when(F.col("word").startswith("^"), c).otherwise(F.substring(c, 2, 1)), "right"), 1, 3)).otherwise(F.concat_ws(" ", "candidate", "right")))
    flat = stored(flat)
    wanted = flat.select("candidate", F.explode(F.array("before", "behind")).alias("key")).where("key <> ''").distinct()
    latin = neighbour_counts(documents, stored(wanted.where(F.contains("key", F.lit(" ")))))
    triples = table.select(F.col("word").alias("key"), "n").join(wanted.where(~F.contains("key", F.lit(" "))), "key", "left_semi")
    counts = stored(latin.unionByName(triples))
    both = flat.join(counts.select(F.col("key").alias("before"), F.col("n").alias("n_before")), "before", "left").join(counts.select(F.col("key").alias("behind"), F.col("n").alias("n_behind")), "behind", "left")
    near = lambda k: F.log((F.coalesce(k, F.lit(0)) + F.lit(SMOOTHING) * F.col("n") / F.lit(1e6)) / F.col("n"))  # noqa: E731 - log P(neighbour | candidate), up to a constant
    score = F.log("n") + near("n_before") + near("n_behind") + KIND_STEP * F.col("kind")
    return both.groupBy("word", "left", "right").agg(F.max_by(F.struct("candidate", "kind"), F.struct(score, "candidate")).alias("best")).select("word", "left", "right", "best.*")


def judged(lines: DataFrame, known, table: DataFrame, documents: DataFrame) -> DataFrame:
    """source, record_id, line_no, hyphenation, fixes of lines with prev_line and next_line.

    fixes are the misread words of the line: pos (0-based place), len, new and
    kind, in order and without overlap. Distinct unknown words are compared with
    the whole vocabulary once; where several candidates remain, the words beside
    each occurrence decide.
    """

    def scan(batches):
        counts, han = known.value
        parts = Memo(lambda token: unknown_parts(token, counts))
        for batch in batches:
            before, line, behind = (batch.column(n).to_pylist() for n in ("prev_line", "line", "next_line"))
            forms = [end_forms(x, y) for x, y in zip(line, behind, strict=True)]
            odd = [[dict(zip(ODD, o, strict=True)) for o in unknown_words(x, p, n, counts, han, parts)] for x, p, n in zip(line, before, behind, strict=True)]
            keep = pa.array([i for i, (f, o) in enumerate(zip(forms, odd, strict=True)) if f is not None or o], pa.int64())
            new = pa.array(forms, pa.list_(pa.string())), pa.array(odd, odd_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(keep) for n in keys), *(x.take(keep) for x in new)], names=[*keys, "forms", "odd"])

    keys = ["source", "record_id", "line_no"]
    ODD = ("pos", "len", "word", "left", "right")
    odd_type = pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("word", pa.string()), ("left", pa.string()), ("right", pa.string())]))
    kind = lines.schema["record_id"].dataType.simpleString()
    scanned = stored(lines.select(*keys, "prev_line", "line", "next_line").mapInArrow(scan, f"source string, record_id {kind}, line_no int, forms array<string>, odd array<struct<pos:int,len:int,word:string,left:string,right:string>>"))
    places = scanned.select(*keys, F.explode("odd").alias("o")).select(*keys, "o.*")
    distinct = places.select("word").distinct()
    counted = stored(distinct.withColumn("low", F.lower("word")).join(table.select(F.col("word").alias("low"), "n"), "low", "left").select("word", F.coalesce("n", F.lit(0)).alias("count")))
    han = table.where(F.col("word").rlike(r"^\p{IsHan}"))
    parts = lambda of, name: han.select("n", F.explode(F.array_distinct(of)).alias(name)).groupBy(name).agg(F.sum("n").alias("n"))
    pairs = parts(F.array(F.substring("word", 1, 2), F.substring("word", -2, 2)), "pair")
    signs = parts(F.split("word", ""), "sign").where("sign <> ''")
    numbers = counted.where(F.col("word").startswith("#")).select("word", F.translate(F.substring("word", 2, 100), "lIOo", "1100").alias("candidate"), F.lit(3).alias("kind"), F.lit(1).cast("long").alias("n"))
    dashes = counted.where(F.col("word").rlike(r"^\p{IsHan}[—–-]")).select("word", F.concat(F.substring("word", 1, 1), F.lit("一"), F.substring("word", 3, 1)).alias("candidate"), F.lit(3).alias("kind"), F.lit(1).cast("long").alias("n"))
    latin = latin_candidates(counted.where(~F.col("word").rlike(r"^[#^$\p{IsHan}]")), table)
    found = numbers.unionByName(dashes).unionByName(latin).unionByName(han_candidates(counted, table)).unionByName(edge_candidates(counted, pairs, signs))
    # how many readings a word has is bounded by the signs that recognition confuses
    cands = stored(found.groupBy("word").agg(F.collect_list(F.struct("candidate", "kind", "n")).alias("cands")))
    read = stored(places.join(cands, "word"))
    several = read.where(F.size("cands") > 1).select("word", "left", "right", "cands").dropDuplicates(["word", "left", "right"])
    chosen = in_context(several, table, documents)
    one = read.where(F.size("cands") == 1).select(*keys, "pos", "len", "word", F.col("cands")[0]["candidate"].alias("candidate"), F.col("cands")[0]["kind"].alias("kind"))
    best = one.unionByName(read.where(F.size("cands") > 1).join(chosen, ["word", "left", "right"]).select(*keys, "pos", "len", "word", "candidate", "kind"))
    w, c = F.col("word"), F.col("candidate")
    plain = F.regexp_replace(w, "^[#^$]", "")
    cased = F.when((F.length(plain) > 1) & (plain == F.upper(plain)) & ~plain.rlike(r"\d"), F.upper(c)).when(F.substring(plain, 1, 1) != F.lower(F.substring(plain, 1, 1)), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))).otherwise(c)
    new = F.when(w.startswith("^"), F.substring(c, 1, 1)).when(w.startswith("$") | w.rlike(r"^\p{IsHan}"), F.substring(c, 2, 1)).when(w.startswith("#"), c).otherwise(cased)
    fixes = best.select(*keys, F.struct("pos", "len", new.alias("new"), "kind").alias("fix")).groupBy(*keys).agg(F.array_sort(F.collect_set("fix")).alias("fixes"))
    return cut_lines(scanned, table).join(fixes, keys, "full")


def mended(line: str, fixes: str) -> Column:
    """The line with its fixes put in at their places; where two meet, the first is taken."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, f: Column) -> Column:
        free = f["pos"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(line, acc["at"] + 1, f["pos"] - acc["at"]), f["new"])
        return F.struct(F.when(free, out).otherwise(acc["out"]).alias("out"), F.when(free, f["pos"] + f["len"]).otherwise(acc["at"]).alias("at"))

    done = F.aggregate(fixes, start, put)
    return F.when(F.size(fixes) > 0, F.concat(done["out"], F.substring(line, done["at"] + 1, F.length(line)))).otherwise(F.col(line))


def examined(regions: DataFrame, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of regions and of chunks: doc_id, page, ord, record_id, line_no, line, kind, hyphenation, fixes.

    A chunk's line that the regions of its document have too takes over what is
    known of it. Any other is told by its place in the chunk and by the furniture
    of the regions, and its words are judged between its own neighbours.
    """
    table = stored(vocabulary(documents.select("text")))
    rows = stored(furniture(region_lines(regions)))
    order = ["page", "ord", "record_id", "line_no"]
    facts = rows.groupBy("doc_id", "line").agg(F.max("kind").alias("kind"))
    heads = stored(rows.where("kind = 'header'").select("doc_id", "skel", F.lit("header").alias("head")).distinct())
    numbers = stored(rows.where("kind = 'page_no' and step is not null").select("doc_id", "step", F.lit("page_no").alias("number")).distinct())
    seen = furniture(chunk_lines(chunks), areas=False).withColumnRenamed("kind", "cut_kind")
    seen = seen.join(facts.withColumn("there", F.lit(True)), ["doc_id", "line"], "left").join(heads, ["doc_id", "skel"], "left").join(numbers, ["doc_id", "step"], "left")
    seen = stored(seen.withColumn("kind", F.when(F.col("there"), F.col("kind")).otherwise(F.coalesce("cut_kind", "head", "number"))).drop("cut_kind", "head", "number", "skel", "step"))
    near = with_neighbours(rows.where("kind is null").select("doc_id", *order, "line"), ["doc_id"], order, ["line"])
    # documents without a line of their own in the chunks are not put in order
    body = seen.where("kind is null")
    body = body.join(body.where("there is null").select("doc_id").distinct(), "doc_id", "left_semi")
    alone = with_neighbours(body.select("doc_id", *order, "line", "there"), ["doc_id"], order, ["line"]).where("there is null")
    lines = [x.select(F.lit(name).alias("source"), "record_id", "line_no", "prev_line", "line", "next_line") for name, x in (("regions", near), ("chunks", alone))]
    text = stored(judged(lines[0].unionByName(lines[1]), known_in_tasks(table), table, documents))
    of = {name: text.where(F.col("source") == name).drop("source") for name in ("regions", "chunks")}
    facts = rows.select("doc_id", "line", "record_id", "line_no").join(of["regions"], ["record_id", "line_no"]).groupBy("doc_id", "line").agg(F.max("hyphenation").alias("hyphenation"), F.max_by("fixes", F.size("fixes")).alias("fixes"))
    columns = ["doc_id", "page", "ord", "record_id", "line_no", "line", "kind", F.coalesce("hyphenation", F.lit(False)).alias("hyphenation"), "fixes"]
    own = rows.join(of["regions"], ["record_id", "line_no"], "left").select(columns)
    taken = seen.where("there").join(stored(facts), ["doc_id", "line"], "left").select(columns)
    return own, taken.unionByName(seen.where("there is null").join(of["chunks"], ["record_id", "line_no"], "left").select(columns))


def noise(lines: DataFrame) -> DataFrame:
    """record_id, noise_type: each kind of noise once per record."""
    body = F.col("kind").isNull()
    kinds = F.array_compact(F.array("kind", F.when(body & F.col("hyphenation"), "hyphenation"), F.when(body & (F.size("fixes") > 0), "misread")))
    return lines.select("record_id", F.explode(kinds).alias("noise_type")).distinct()


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, paragraph_no (from 0), part, page, text: the running text of every document, furniture removed, words mended and joined, lines reflowed.

    A line that ends a sentence before the page's usual width ends a paragraph;
    the end of a page does not, so words and sentences run on to the next. page
    is that of the first line. Paragraphs are numbered without sorting a document
    in one task; one of more than PARAGRAPH_LINES lines comes in several parts,
    which follow each other without a break.
    """
    body = lines.where("kind is null").select("doc_id", "page", "ord", "record_id", "line_no", "hyphenation", F.rtrim(mended("line", "fixes")).alias("line"))
    wide = body.groupBy("doc_id", "page").agg(F.max(F.length("line")).alias("width"))
    ends = ~F.col("hyphenation") & F.col("line").rlike(r"[.!?。！？:：”»]$") & (F.length("line") < 0.7 * F.col("width"))
    body = body.join(wide, ["doc_id", "page"]).withColumn("ends", ends).drop("width")
    rows = with_running(body, ["doc_id"], ["page", "ord", "record_id", "line_no"], {"paragraph_no": F.col("ends").cast("int"), "place": F.lit(1)})
    rows = stored(rows)
    long = rows.groupBy("doc_id", "paragraph_no").agg(F.count("*").alias("n"), F.min("place").alias("first")).where(F.col("n") > PARAGRAPH_LINES).drop("n")
    part = F.coalesce(F.floor((F.col("place") - F.col("first")) / PARAGRAPH_LINES), F.lit(0)).cast("int")
    groups = rows.join(long, ["doc_id", "paragraph_no"], "left").groupBy("doc_id", "paragraph_no", part.alias("part"))
    own = groups.agg(F.array_sort(F.collect_list(F.struct("place", "page", "line", "hyphenation"))).alias("lines"))

    def add(acc: Column, x: Column) -> Column:
        text = x["line"]
        cut = F.when(x["hyphenation"], F.regexp_replace(text, f"[{HYPHENS}]$", "")).otherwise(text)
        return F.concat(acc, cut, F.when(x["hyphenation"] | text.rlike(f"[{HYPHENS}]$") | text.rlike(r"[\p{IsHan}，、。；：]$"), "").otherwise(" "))

    text = F.aggregate("lines", F.lit(""), add)
    return own.select("doc_id", F.col("paragraph_no").cast("int").alias("paragraph_no"), "part", F.col("lines")[0]["page"].alias("page"), F.when(F.size("lines") < PARAGRAPH_LINES, F.rtrim(text)).otherwise(text).alias("text"))

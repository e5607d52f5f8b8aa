"""Column functions on text. All are built-in expressions; none leaves the JVM.

Every function gives null for null unless it says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, as the inside of a character class.
WS = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = "一-鿿"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(text), f"^[{WS}]+|[{WS}]+$", "")


def collapse(text: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(col(text), f"[{WS}]+", " "))


def matches(text: str | Column, pattern: str, group: int = 0) -> Column:
    """All matches; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def count_chars(text: str | Column, inside: str) -> Column:
    """Number of characters in the class."""
    return F.length(F.regexp_replace(col(text), f"[^{inside}]+", ""))


def token_estimate(text: str | Column) -> Column:
    """A cautious token count: a Chinese character or sign counts 1, an ASCII word a quarter of its length, rounded up. 0 for null."""
    words = F.aggregate(matches(text, "[A-Za-z0-9_]+"), F.lit(0), lambda acc, w: acc + F.floor((F.length(w) + 3) / 4).cast("int"))
    signs = F.length(F.regexp_replace(col(text), f"[{WS}A-Za-z0-9_{HAN}]+", ""))
    return F.coalesce(count_chars(text, HAN) + signs, F.lit(0)) + words


def sentences(text: str | Column) -> Column:
    """Sentences: cut behind Chinese and Latin terminators and at line ends, stripped, none empty. An empty array for null."""
    parts = F.split(col(text), rf"(?<=[。！？!?；;])[{WS}]*|(?<=[A-Za-z0-9][.!?])[{WS}]+|\n+", -1)
    return F.coalesce(F.filter(F.transform(parts, strip), lambda s: s != ""), F.array().cast("array<string>"))


def grams(run: Column, n: int) -> Column:
    """All substrings of n characters of one run; an empty array if it is shorter."""
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def han_grams(text: str | Column, n: int, least: int = 1) -> Column:
    """Adjacent n-grams inside runs of Chinese characters of at least ``least``."""
    return F.flatten(F.transform(matches(text, f"[{HAN}]{{{max(least, n)},}}"), lambda r: grams(r, n)))


def query_terms(text: str | Column) -> Column:
    """Distinct search terms in lower case: ASCII words and Chinese runs of two or more, and the pairs of longer runs."""
    low = F.lower(col(text))
    return F.array_distinct(F.concat(matches(low, f"[a-z0-9_]{{2,}}|[{HAN}]{{2,}}"), han_grams(low, 2, 3)))


def rerank_tokens(text: str | Column) -> Column:
    """Ordered distinct tokens for reranking: words that begin with a letter, Chinese runs, and pairs of longer runs."""
    low = F.lower(col(text))
    return F.array_distinct(F.concat(matches(low, f"[a-z][a-z0-9_.+-]+|[{HAN}]{{2,}}"), han_grams(low, 2, 3)))


def sparse_tokens(text: str | Column, most: int = 40) -> Column:
    """The tokens of a sparse query: words, Chinese runs and pairs, distinct in order, at most ``most`` (a property of the query language)."""
    low = F.lower(col(text))
    return F.slice(F.array_distinct(F.concat(matches(low, f"[a-z0-9_.@+-]{{2,}}|[{HAN}]{{2,}}"), han_grams(low, 2))), 1, most)


#: Words that carry no topic.
TOPIC_STOP = ["用户", "偏好", "项目", "决策", "使用", "采用", "改为", "调整", "希望", "以后"]


def topic_terms(text: str | Column) -> Column:
    """Distinct topic terms: words of three letters or more, pairs and triples of Chinese runs, without stop words."""
    low = F.lower(col(text))
    every = F.concat(matches(low, "[a-z][a-z0-9_.+-]{2,}"), han_grams(low, 2), han_grams(low, 3))
    return F.array_except(F.array_distinct(every), F.array(*map(F.lit, TOPIC_STOP)))


def padded_words(text: str | Column) -> Column:
    """ASCII words and digits in lower case, one blank between and around them."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "), F.lit(" "))


def word_bounded(text: Column, term: Column, padded: Column | None = None) -> Column:
    """Whether the term occurs: an ASCII term not inside a longer word, any other as a substring. Both in lower case.

    ``padded`` is padded_words(text), to be given where many terms meet one text:
    then only terms with signs inside need a regular expression.
    """
    padded = padded_words(text) if padded is None else padded
    word = F.contains(padded, F.concat(F.lit(" "), term, F.lit(" ")))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))
    return F.when(term.rlike("^[a-z0-9]+$"), word).when(~F.contains(text, term), False).when(term.rlike("^[a-z0-9_.+-]+$"), F.regexp_like(text, quoted)).otherwise(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexical_fraction(terms: Column, text: str | Column) -> Column:
    """Share of the terms that occur in the text; 0 without terms."""
    low = F.lower(col(text))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def quality_score(text: str | Column) -> Column:
    """Share of readable characters between 0 and 1; private-use, Tibetan, control and replacement characters weigh three. 0 for null and empty."""
    t = col(text)
    bad3 = count_chars(t, r"\x{e000}-\x{f8ff}\x{0f00}-\x{0fff}\x{0}-\x{8}\x{e}-\x{1b}\x{fffd}")
    good = count_chars(t, rf"{WS}\x{{c}}\x{{21}}-\x{{7e}}{HAN}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{ff00}}-\x{{ffef}}\p{{Nd}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205e}}\x{{3001}}-\x{{303f}}\x{{b7}}")
    counts = F.struct(bad3.alias("bad"), good.alias("good"), F.length(t).alias("n"))
    return let(counts, lambda c: F.when(c["n"] > 0, c["good"] / (c["n"] + 2 * c["bad"])).otherwise(F.lit(0.0)))


def is_garbled(text: str | Column, least: int = 40) -> Column:
    """Whether extracted text is unreadable: many private-use or Tibetan characters, many letters of rare scripts, or a low quality score. False for short or null texts."""
    t = strip(text)
    n = F.length(t)
    rare = count_chars(t, r"\x{e000}-\x{f8ff}\x{0f00}-\x{0fff}") / n
    exotic = count_chars(t, r"\x{0530}-\x{1cff}\x{a000}-\x{abff}") / n
    return F.coalesce((n >= least) & ((rare > 0.03) | (exotic > 0.08) | (quality_score(t) < 0.62)), F.lit(False))


def strip_thinking(text: str | Column) -> Column:
    """Without <think> blocks."""
    return strip(F.regexp_replace(col(text), r"(?is)<think>.*?</think>", ""))


def strip_tags(html: str | Column) -> Column:
    """HTML without tags and the common entities resolved."""
    plain = F.regexp_replace(col(html), r"(?s)<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return collapse(plain)


def html_to_text(html: str | Column) -> Column:
    """Mail HTML as text: comments, scripts and styles dropped, block tags as line ends."""
    t = F.regexp_replace(col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n")
    return F.regexp_replace(strip(F.regexp_replace(t, r"(?s)<[^>]+>", " ")), r"[ \t]+", " ")


def heading(text: str | Column) -> Column:
    """The first level-one heading; null if there is none."""
    found = F.regexp_extract(col(text), r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(found != "", found)


def slug(title: str | Column, most: int = 28) -> Column:
    """A file name: word characters and Chinese, everything else one hyphen."""
    plain = F.regexp_replace(strip(title), rf"[^A-Za-z0-9_{HAN}-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most), "-+$", "")


def short_title(text: str | Column, most: int = 28) -> Column:
    """The collapsed text, cut with an ellipsis."""
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


#: Names of fields that hold credentials.
SECRET = r"api[_-]?key|password|passwd|authorization|access[_-]?token|refresh[_-]?token|secret"


def redact_secrets(text: str | Column) -> Column:
    """Assignments of credentials, bearer tokens and passwords in addresses replaced by a mark."""
    t = F.regexp_replace(col(text), rf"(?i)\b({SECRET})\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]")
    t = F.regexp_replace(t, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]")
    return F.regexp_replace(t, r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", "$1[REDACTED]@")


def is_sensitive(text: str | Column) -> Column:
    """Whether a text speaks of credentials."""
    return F.coalesce(col(text).rlike(r"(?i)api_key|apikey|secret|password|token=|bearer ") | col(text).rlike("sk-[a-zA-Z0-9]{12,}"), F.lit(False))


def urls(text: str | Column) -> Column:
    """All web addresses without trailing punctuation."""
    return F.transform(matches(text, r"https?://[^\s<>\"'()（），。；、]+"), lambda u: F.regexp_replace(u, r"[.,;:!?）)】\]]+$", ""))


def canonical_url(url: str | Column) -> Column:
    """Key of an address: no fragment, no slash at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(url), "#.*$", ""), "/+$", ""))


def unwrap_url(url: str | Column) -> Column:
    """The target of a search-result address: scheme added, redirect unwrapped, fragment dropped; null for other schemes."""
    u = F.regexp_replace(strip(url), "^//", "https://")
    wrapped = F.regexp_extract(u, r"[?&]uddg=([^&#]+)", 1)
    u = F.when(wrapped != "", F.try_url_decode(wrapped)).otherwise(u)
    u = F.regexp_replace(u, "#.*$", "")
    return F.when(u.rlike("(?i)^https?://[^/]+"), u)


#: Hosts whose pages are no results (of the first two, all hosts below them too), and endings of images.
NOISE_DOMAINS = ["bing.com", "duckduckgo.com"]
NOISE_HOSTS = ["login.live.com", "account.microsoft.com"]
IMAGE_ENDINGS = "jpg|jpeg|png|gif|webp|svg|ico"


def is_noise_url(url: str | Column, engine: str = "") -> Column:
    """Whether an address is a search engine's or login page, an image or no web address at all; true for null.

    For results of the ``engine`` bing its own redirects are noise as well.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(col(url), r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), "^www\\.", "")
    path = F.lower(F.regexp_extract(col(url), r"(?i)^https?://[^/?#]*([^?#]*)", 1))
    own = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in NOISE_DOMAINS])
    noise = (host == "") | own | host.isin(NOISE_HOSTS) | path.rlike(rf"\.({IMAGE_ENDINGS})$")
    return F.coalesce(noise | F.contains(path, F.lit("/ck/a")) if engine == "bing" else noise, F.lit(True))


def cited(text: str | Column, most: Column) -> Column:
    """Sorted distinct numbers [n] between 1 and ``most``."""
    numbers = F.transform(matches(text, r"\[(\d{1,6})\]", 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= most))))


def drop_false_citations(text: str | Column, most: Column) -> Column:
    """Numbers [n] beyond ``most``, and 0, removed."""
    wrong = F.array_distinct(F.filter(matches(text, r"\[\d{1,6}\]"), lambda x: ~F.regexp_replace(x, r"[\[\]]", "").cast("int").between(F.lit(1), most)))
    return F.aggregate(wrong, col(text), lambda acc, x: F.replace(acc, x, F.lit("")))


def squeeze_lines(text: str | Column) -> Column:
    """Lines stripped, blank ones and immediate repetitions dropped."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.try_element_at(lines, i)).alias("before"))), lambda x: x["before"].isNull() | (x["line"] != x["before"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def head_and_tail(text: str | Column, most: int, head: int) -> Column:
    """A text over ``most`` characters cut to its first ``head`` and its last characters."""
    t = col(text)
    mark = "\n[...]\n"
    tail = most - head - len(mark)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, head), F.lit(mark), F.right(t, F.lit(tail)))).otherwise(t)


def plain_answer(text: str | Column) -> Column:
    """Lower-case letters, digits and Chinese only; for exact matches."""
    return F.regexp_replace(F.lower(col(text)), rf"[^a-z0-9_{HAN}]", "")


def answer_tokens(text: str | Column) -> Column:
    """ASCII words and single Chinese characters, in lower case."""
    return matches(F.lower(col(text)), f"[a-z0-9_]+|[{HAN}]")


def first_json(text: str | Column) -> Column:
    """The first JSON value of a text: the whole, else the content of a fence, else from the first brace to the last. Null if none parses."""
    t = strip(text)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)[{\[].*[}\]]", 0)
    valid = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(t), valid(strip(fence)), valid(braces))


#: File categories by words in the name, then by ending.
CATEGORY_WORDS = [
    ("resume", ["简历", "resume", "cv"]),
    ("meeting", ["会议", "纪要", "meeting", "minutes"]),
    ("research", ["研究", "调研", "research", "report", "analysis"]),
    ("invoice", ["发票", "invoice", "收据", "receipt"]),
    ("finance", ["财务", "预算", "budget", "expense", "费用"]),
    ("project", ["方案", "计划", "project", "roadmap", "proposal"]),
    ("presentation", ["汇报", "演示", "ppt", "slides", "presentation"]),
    ("notes", ["笔记", "note", "notes", "记录"]),
    ("paper", ["论文", "paper", "thesis", "survey"]),
]
CATEGORY_ENDINGS = [
    ("documents", ["docx", "md", "markdown", "txt", "pdf"]),
    ("presentation", ["pptx"]),
    ("spreadsheet", ["xlsx", "csv"]),
    ("archive", ["zip", "7z", "rar", "tar", "gz"]),
    ("image", ["png", "jpg", "jpeg", "gif", "webp", "bmp"]),
]


def file_category(path: str | Column) -> Column:
    """The first category one of whose words the file name holds, else that of the ending, else other."""
    name = F.lower(F.regexp_extract(col(path), r"[^/\\]*$", 0))
    by_word = [F.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words]), kind) for kind, words in CATEGORY_WORDS]
    by_ending = [F.when(F.regexp_extract(name, r"\.([^.]*)$", 1).isin(endings), kind) for kind, endings in CATEGORY_ENDINGS]
    return F.when(col(path).isNotNull(), F.coalesce(*by_word, *by_ending, F.lit("other")))


def natural_key(text: str | Column) -> Column:
    """A sort key in which runs of digits order by value: each has the length of its digits, without zeros before them, in front."""
    parts = matches(F.lower(col(text)), r"\d+|\D+")
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))).otherwise(p)), "")


def mentions_date(text: str | Column, day: Column) -> Column:
    """Whether a text names the day as y-m-d, y/m/d or in Chinese."""
    y, m, d = F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")
    pattern = F.concat(F.lit("(^|[^0-9])"), y, F.lit(r"\s?[-/.年]\s?0?"), m, F.lit(r"\s?[-/.月]\s?0?"), d, F.lit("([^0-9]|$)"))
    return F.coalesce(F.regexp_like(col(text), pattern), F.lit(False))


def excerpt(text: str | Column, term: str | Column, width: int) -> Column:
    """``width`` characters around the first occurrence of a term; the beginning if it does not occur."""
    t = col(text)
    at = F.greatest(F.instr(F.lower(t), F.lower(col(term))) - width // 2, F.lit(1))
    return F.substring(t, at, F.lit(width))


def merged(base: Column, update: Column) -> Column:
    """The entries of two maps; of equal keys those of the update. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    base, update = F.coalesce(base, empty), F.coalesce(update, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(update, k)), update)


def iso_time(time: str | Column) -> Column:
    """A time as text with its zone (UTC), with microseconds where there are any. Null for null."""
    t = col(time)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(t, "SSSSSS") == "000000", "").otherwise(F.date_format(t, ".SSSSSS")), F.lit("+00:00"))

"""Text that was decoded with a wrong encoding: a hidden Markov model finds it, the inverse transform restores it.

The model has one clean state and one for every pair of right and wrong
encoding. Its emissions come from the corpus: clean text is counted as it is and
after each pair's transform. In states of single-byte encodings a character can
only be emitted as a part of a valid multi-byte sequence. Lines are labelled by
Viterbi, many at a time in numpy; a line none of whose characters is likelier in
a pair's state than in the clean one is clean without it.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of texts that are counted at a time.
COUNT_CHARS = 4_000_000

#: (right, wrong, single-byte): UTF-8 read as another encoding; then text of another encoding read as UTF-8 or as a third.
PAIRS = (
    ("utf-8", "cp1252", True), ("utf-8", "cp437", True), ("utf-8", "cp850", True), ("utf-8", "cp1250", True), ("utf-8", "cp1251", True),
    ("utf-8", "mac_roman", True), ("utf-8", "koi8_r", True),
    ("utf-8", "gb18030", False), ("utf-8", "big5", False), ("utf-8", "cp932", False), ("utf-8", "cp949", False),
    ("cp1252", "utf-8", False), ("gb18030", "utf-8", False), ("gb18030", "cp1252", False), ("cp1252", "gb18030", False), ("big5", "utf-8", False),
    ("cp1252", "cp850", False), ("cp1252", "cp437", False), ("cp1252", "mac_roman", False), ("cp1252", "cp1251", False),
)
SINGLE = frozenset(wrong for _, wrong, single in PAIRS if single)
#: Pairs in which what a character becomes depends on its neighbours; the counts of the others follow from those of clean text.
IN_CONTEXT = tuple(i for i, (_, wrong, _) in enumerate(PAIRS) if wrong not in SINGLE)
SWITCH = 2.5
UNSEEN_CLEAN, UNSEEN_PAIR, IMPOSSIBLE = np.log(2e-7), np.log(2e-8), -30.0
LOST = "�"
#: Read byte for byte: a letter became another sign, which stands out behind a small letter.
BYTE_FOR_BYTE = ("cp850", "cp437", "mac_roman", "cp1251")
STRANGE = "À-ÖØ-ÝΘΣⁿ÷±ΓΩа-яё▀-▟"
OUT_OF_PLACE = re.compile(f"[a-z][{STRANGE}]")
#: Marks that open and close a quoted sample, which is no damage.
QUOTED = re.compile(r"[\"“”„‚‘’'«‹(\[「『（`《<][^\"“”„‘’«»()\[\]「」『』（）`\n]{0,24}$"), re.compile(r"^[^\"“”„‘’«»()\[\]「」『』（）`\n]{0,12}[\"“”’'»›)\]」』）`》>]")


def to_bytes(text: str, encoding: str) -> bytes:
    """The bytes that were read as ``text``; those without meaning in cp1252 were kept as control characters."""
    if encoding in ("cp1252",):
        return b"".join(_byte(c, encoding) for c in text)
    return text.encode(encoding, "strict")


@functools.cache
def _byte(char: str, encoding: str) -> bytes:
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        if ord(char) < 256:
            return char.encode("latin-1")
        raise


def damage(text: str, right: str, wrong: str) -> str:
    """``text`` as it looks when its bytes in ``right`` are read as ``wrong``."""
    raw = text.encode(right, "replace")
    if wrong in SINGLE:
        return char_table(wrong)[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
    return raw.decode(wrong, "replace")


@functools.cache
def char_table(encoding: str) -> np.ndarray:
    """Byte to code point of a single-byte encoding; bytes without meaning stay control characters."""
    out = np.arange(256, dtype="<u4")
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            pass
    return out


@functools.cache
def byte_table(encoding: str) -> np.ndarray:
    """Code point to byte of a single-byte encoding, -1 where there is none."""
    table = np.full(0x110000, -1, np.int16)
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # bytes that were kept as control characters
        if table[b] < 0:
            table[b] = b
    return table


def in_sequence(points: np.ndarray, encoding: str) -> np.ndarray:
    """Where a character, as a byte of ``encoding``, is part of a valid multi-byte UTF-8 sequence."""
    raw = np.concatenate([byte_table(encoding)[points], np.full(3, -1, np.int16)])
    n = len(points)
    more = (raw >= 0x80) & (raw <= 0xBF)
    one, two, three = more[1 : n + 1], more[2 : n + 2], more[3 : n + 3]
    lead = raw[:n]
    starts2 = (lead >= 0xC2) & (lead <= 0xDF) & one
    starts3 = (lead >= 0xE0) & (lead <= 0xEF) & one & two
    starts4 = (lead >= 0xF0) & (lead <= 0xF4) & one & two & three
    out = starts2 | starts3 | starts4
    for starts, length in ((starts2, 2), (starts3, 3), (starts4, 4)):
        for k in range(1, length):
            out[k:] |= starts[: n - k]
    return out


def clean_lines(texts: list[str]) -> list[str]:
    """The lines with other than ASCII characters that show no sign of damage; a coarse check that keeps damaged lines out of the clean counts."""
    lines = [x for t in texts for x in t.split("\n") if not x.isascii()]
    whole = "\n".join(lines)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    bad = (points == ord(LOST)) | ((points >= 0x80) & (points < 0xA0)) | ((points >= 0xE000) & (points < 0xF900))
    for _, wrong, single in PAIRS:
        if single:
            bad |= in_sequence(points, wrong)
    ends = np.cumsum([len(x) + 1 for x in lines])
    total = np.concatenate([[0], np.cumsum(bad)])
    ok = [total[min(e, len(bad))] == total[e - len(x) - 1] for e, x in zip(ends, lines, strict=True)]
    return [x for x, fine in zip(lines, ok, strict=True) if fine and not any(_shrinks(x, w) for w in ("gb18030", "big5", "cp932"))]


def _shrinks(line: str, wrong: str) -> bool:
    """Whether the line's characters, as bytes of ``wrong``, are UTF-8 of fewer characters."""
    run = "".join(c for c in line if c > "\x7f")
    try:
        return len(run.encode(wrong).decode("utf-8")) < len(run)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return False


def _counts(text: str) -> np.ndarray:
    """How often each code point beyond ASCII occurs."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(points[points >= 0x80], minlength=0x110000)


def counted(texts: list[str]) -> dict[int, np.ndarray]:
    """Counts of clean text (state 0) and of the pairs in context, as they add up over any division of the texts."""
    whole = "\n".join(clean_lines(texts))
    return {0: _counts(whole)} | {i + 1: _counts(damage(whole, *PAIRS[i][:2])) for i in IN_CONTEXT}


def _follows(clean: np.ndarray, right: str, wrong: str) -> np.ndarray:
    """Counts of a pair whose transform takes each character by itself."""
    out = np.zeros(0x110000, np.int64)
    for c in np.flatnonzero(clean):
        bad = damage(chr(c), right, wrong)
        if right == "cp1252" and wrong in BYTE_FOR_BYTE:
            bad = re.sub(f"[^{STRANGE}]", "", bad)
        for x in bad:
            if x >= "\x80":
                out[ord(x)] += clean[c]
    return out


class Model:
    """Log emissions per code point and state; state 0 is clean."""

    def __init__(self, texts: list[str] = (), counts: dict[int, np.ndarray] | None = None):
        counts = counted(texts) if counts is None else counts
        clean, seen = counts[0], []
        for i, (right, wrong, _) in enumerate(PAIRS):
            seen.append(counts[i + 1] if i in IN_CONTEXT else _follows(clean, right, wrong))
            if (right, wrong) == ("utf-8", "cp1252"):  # also decoded wrongly twice, or as Latin-1
                seen[-1] = seen[-1] + _follows(seen[-1], right, wrong) + _follows(clean, right, "latin-1")
        # below a single occurrence, however large the corpus
        self.unseen = min(UNSEEN_CLEAN, np.log(0.5 / max(1, *(int(c.sum()) for c in (clean, *seen)))))
        unseen_pair = self.unseen + UNSEEN_PAIR - UNSEEN_CLEAN
        self.points = np.flatnonzero(clean + sum(seen)).astype(np.uint32)
        if not len(self.points):
            self.points = np.array([ord(LOST)], np.uint32)
        states = 1 + len(PAIRS)
        log = np.full((2 + len(self.points), states), unseen_pair, np.float32)  # rows: ASCII, unseen, then each character
        log[:, 0] = self.unseen
        log[0] = 0
        for s, n in enumerate([clean, *seen]):
            own = n[self.points]
            with np.errstate(divide="ignore"):
                log[2:, s] = np.maximum(np.log(own / max(1, own.sum())), self.unseen if s == 0 else unseen_pair)
        log[2:, 0][self.points == ord(LOST)] = self.unseen
        self.log = log
        gain = log[:, 1:] > log[:, :1] + 1e-6
        #: Classes that may begin a damaged span alone, or beside another character that is not ASCII.
        self.alone = gain[:, [not single and right != "gb18030" for right, _, single in PAIRS]].any(1)
        self.beside = gain.any(1)
        self.alone[:2] = self.beside[:2] = False

    def suspects(self, points: np.ndarray) -> np.ndarray:
        """Where a state other than clean may be the likelier one: without any such place all is clean."""
        kind = self.classes(points)
        high = np.concatenate([[False], points >= 0x80, [False]])
        return self.alone[kind] | (self.beside[kind] & (high[:-2] | high[2:]))

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Row of the emission table of each code point."""
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        out = np.where(self.points[at] == points, at + 2, 1)
        out[points < 0x80] = 0
        return out

    def plausible(self, text: str) -> bool:
        """Whether most of the characters beyond ASCII are known from clean text."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes(points)[points >= 0x80]
        kind = kind[kind != self.classes(np.array([ord(LOST)], np.uint32))[0]]
        return len(kind) == 0 or float((self.log[kind, 0] > self.unseen + 0.1).mean()) >= 0.5

    def label(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest state of every character of every line."""
        out: list = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        while order:
            longest = len(lines[order[-1]])
            take = max(1, min(len(order), 400_000 // max(1, longest)))
            part, order = order[-take:], order[:-take]
            for i, states in zip(part, self._viterbi([lines[i] for i in part], longest), strict=True):
                out[i] = states
        return out

    def emissions(self, points: np.ndarray) -> np.ndarray:
        """Log emissions of every character: single-byte states only emit valid sequences, bytes of GB18030 come at least in pairs."""
        e = self.log[self.classes(points)]
        high = points >= 0x80
        for j, (right, wrong, single) in enumerate(PAIRS):
            if single:
                e[high & ~in_sequence(points, wrong), j + 1] = IMPOSSIBLE
            elif right == "gb18030" and wrong != "utf-8":
                near = np.concatenate([[False], high, [False]])
                e[high & ~(near[:-2] | near[2:]), j + 1] = IMPOSSIBLE
        return e

    def _viterbi(self, lines: list[np.ndarray], longest: int) -> list[np.ndarray]:
        b, s = len(lines), self.log.shape[1]
        emit = np.zeros((longest, b, s), np.float32)
        gap = np.array([10], np.uint32)
        every = self.emissions(np.concatenate([x for line in lines for x in (line, gap)]))
        at = 0
        for k, points in enumerate(lines):
            emit[: len(points), k] = every[at : at + len(points)]
            at += len(points) + 1
        v = np.full((b, s), -SWITCH, np.float32)
        v[:, 0] = 0
        back = np.zeros((longest, b, s), np.int8)
        own = np.arange(s, dtype=np.int8)
        for t in range(longest):
            best = v.argmax(1)
            jump = v[np.arange(b), best][:, None] - SWITCH
            stay = v >= jump
            back[t] = np.where(stay, own, best[:, None].astype(np.int8))
            v = np.where(stay, v, jump) + emit[t]
        state = v.argmax(1).astype(np.int8)
        path = np.zeros((longest, b), np.int8)
        rows = np.arange(b)
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = back[t, rows, state]
        return [path[: len(points), k] for k, points in enumerate(lines)]


def undo(span: str, state: int) -> str:
    """The inverse transform of one state on a labelled span; what has no inverse stays."""
    right, wrong, single = PAIRS[state - 1]
    for _ in range(4):
        new = _undo_single(span, wrong) if single else _undo_multi(span, right, wrong)
        if new == span:
            break
        span = new
        if not single:
            break
    return span


def _undo_single(span: str, wrong: str) -> str:
    points = np.frombuffer(span.encode("utf-32-le"), np.uint32)
    valid = in_sequence(points, wrong)
    table = byte_table(wrong)
    out, i, n = [], 0, len(span)
    while i < n:
        if valid[i]:
            j = i
            while j < n and valid[j]:
                j += 1
            out.append(bytes(table[points[i:j]].astype(np.uint8)).decode("utf-8", "replace"))
            i = j
        else:
            out.append(span[i])
            i += 1
    return "".join(out)


def _undo_multi(span: str, right: str, wrong: str) -> str:
    if wrong == "utf-8":
        return span  # the bytes are lost
    raw = bytearray()
    for c in span:
        try:
            raw += b"\xff" if c == LOST else to_bytes(c, wrong)
        except UnicodeEncodeError:
            raw += b"\xff"
    text = raw.decode(right, "replace")
    high = sum(c > "\x7f" for c in span)
    good = sum(c > "\x7f" and c != LOST for c in text)
    gone = re.sub(f"{LOST}+", LOST, text)
    return gone if good and good >= 0.4 * high * (2 / 3) and gone.count(LOST) <= 1 + 0.5 * good else span


def is_quoted(line: str, start: int, end: int) -> bool:
    """A short sample between quotation marks or brackets, set there on purpose."""
    return end - start <= 12 and bool(QUOTED[0].search(line[:start])) and bool(QUOTED[1].search(line[end:]))


def repaired(line: str, states: np.ndarray, model: Model) -> tuple[str, int, int]:
    """The line with every labelled span inverted, the number of damaged spans, and of those that could be restored."""
    hit = states != 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out, at, found, fixed = [], 0, 0, 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        while a < b and line[a] <= "\x7f":
            a += 1
        while b > a and line[b - 1] <= "\x7f":
            b -= 1
        if a == b or is_quoted(line, a, b):
            continue
        state = int(np.bincount(states[a:b], minlength=1)[1:].argmax()) + 1
        right, wrong, single = PAIRS[state - 1]
        if single:  # not to cut a sequence
            valid = in_sequence(np.frombuffer(line.encode("utf-32-le"), np.uint32), wrong)
            while b < len(line) and valid[b] and valid[b - 1]:
                b += 1
            while a > at and valid[a - 1] and valid[a]:
                a -= 1
        if a >= b or a < at:
            continue
        span = line[a:b]
        new = undo(span, state)
        if wrong == "utf-8":
            if LOST not in span:
                continue
        elif LOST not in span and (new == span or not model.plausible(new)):
            continue
        if right == "cp1252" and wrong in BYTE_FOR_BYTE and not OUT_OF_PLACE.search(line[max(0, a - 1) : b]):
            continue
        if new != span and not model.plausible(new):
            new = span
        found += 1
        fixed += new != span
        out += [line[at:a], new]
        at = b
    return "".join([*out, line[at:]]), found, fixed


def fit(docs: DataFrame, text: str) -> Model:
    """Emissions from all documents; the driver gets one row per state in context and code point."""

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part, chars = [], 0
            for t in [*batch.column(0).to_pylist(), None]:
                if t and not t.isascii():
                    part.append(t)
                    chars += len(t)
                if part and (t is None or chars >= COUNT_CHARS):
                    for state, n in counted(part).items():
                        total[state] = total.get(state, 0) + n
                    part, chars = [], 0
        for state, n in total.items():
            points = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), state), pa.int32()), pa.array(points, pa.int32()), pa.array(n[points], pa.int64())], names=["state", "point", "n"])

    rows = docs.where(F.length(text) > 0).select(text).mapInArrow(count, "state int, point int, n long")
    sums = rows.groupBy("state", "point").agg(F.sum("n").alias("n")).toArrow()
    counts = {s: np.zeros(0x110000, np.int64) for s in (0, *(i + 1 for i in IN_CONTEXT))}
    state, point, n = (sums.column(c).to_numpy() for c in ("state", "point", "n"))
    for s, own in counts.items():
        own[point[state == s]] = n[state == s]
    return Model(counts=counts)


def restore(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, text, damaged, restored: every text with its damaged spans inverted, and their numbers.

    Texts without damage come out unchanged, null as null, empty as empty. One
    row per input row; other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found, fixed = [0] * len(texts), [0] * len(texts)
            jobs, lines = [], []
            split: dict[int, list[str]] = {}
            for i, t in enumerate(texts):
                if t and not t.isascii():
                    points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                    hot = model.value.suspects(points)
                    if hot.any():
                        split[i] = t.split("\n")
                        at = 0
                        for k, line in enumerate(split[i]):
                            if hot[at : at + len(line)].any():
                                jobs.append((i, k))
                                lines.append(points[at : at + len(line)])
                            at += len(line) + 1
            for (i, k), states in zip(jobs, model.value.label(lines), strict=True):
                if states.any():
                    split[i][k], n, m = repaired(split[i][k], states, model.value)
                    found[i] += n
                    fixed[i] += m
            for i in split:
                if fixed[i]:
                    texts[i] = "\n".join(split[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.int32()), pa.array(fixed, pa.int32())], names=["key", "text", "damaged", "restored"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, text string, damaged int, restored int")
    return out.withColumnRenamed("key", key)

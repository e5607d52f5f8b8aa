"""Rebuilding conversations from message rows.

Messages are numbered inside their session without ever sorting a session in
one task. Every message is then linked to the one that it most likely answers.
Candidate parents are scored by time, mentions and shared words, at any
distance: the latest message before of each speaker (every other of that speaker
is further off in time), all messages that share a word, the message that reply_to
names, and those whose id or handle the text mentions. Links form trees; their roots are found inside blocks first, then over
blocks by pointer doubling. A conversation is judged by its trees.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import with_running
from sparkloom.tables import stored

#: Messages of a session meet word by word if no word is held by more than so many of them; else every two are compared.
TELLING = 8
#: Turns of a slice, every two of which are compared in one task; rows of it at a time; words that so many pairs share, so many at a time, are counted as a product of matrices.
SLICE = 2048
ROWS = 256
DENSE = 64
COLUMNS = 256
#: Unit of the weights of words: sums of up to 8,192 are exact.
GRAIN = 2.0**-40
#: Length of the blocks in which the links are first followed.
BLOCK = 64
#: A link scores by nearness in time (half after HALF_TIME_S), shared telling words, mention, change of speaker, and
#: from an assistant to a user message behind the latest answer; below MIN_SCORE it is none. What reply_to names is the parent.
HALF_TIME_S = 3600.0
WEIGHTS = {"time": 1.0, "overlap": 12.0, "mention": 4.0, "turn": 0.75, "open": 12.0}
MIN_SCORE = 0.05

#: Spellings of the four speakers, lower case.
SPEAKERS = {
    "user": ["user", "human", "customer", "client", "用户", "客户", "usr", "enduser", "end-user", "end user", "person", "nutzer", "benutzer", "kunde", "utilisateur", "usager", "usuario", "cliente", "人类", "顾客", "使用者", "me", "visitor", "requester", "asker", "访客", "我", "u"],
    "assistant": ["assistant", "ai", "bot", "model", "助手", "agent", "助理", "机器人", "assistent", "asistente", "chatbot", "gpt", "llm", "ai assistant", "智能助手", "人工智能", "模型", "copilot", "reply bot", "answerer", "客服", "a", "asst"],
    "system": ["system", "sys", "系统", "developer", "sistema", "système", "systeme", "instruction", "system prompt"],
    "tool": ["tool", "function", "工具", "函数", "plugin", "tool_result", "tool result", "tool_call", "tool call", "tool_response", "tool response", "function_call", "function call", "werkzeug", "outil", "herramienta", "observation", "ipython"],
}

USER, ASSISTANT = 0, 1  # places in SPEAKERS

#: White space and other characters that show nothing.
UNSEEN = r"[\p{Z}\p{C}\sᅟᅠ⠀ㅤﾠ︀-️͏]+"


def speaker(role: str | Column) -> Column:
    """user, assistant, system or tool; null for a role that is null, empty or has no meaning."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(role, r"^[\p{Z}\p{C}\s<\[|:*]+|[\p{Z}\p{C}\s>\]|:*]+$", ""))), r"[\s_-]+", " ")
    out = F.lit(None).cast("string")
    for name, spellings in SPEAKERS.items():
        out = F.when(plain.isin([s.replace("_", " ").replace("-", " ") for s in spellings]), name).otherwise(out)
    return out


def session_key(session_id: str | Column) -> Column:
    """Session ids without surrounding white space and case; null if nothing is left."""
    plain = F.lower(F.regexp_replace(session_id, r"^[\p{Z}\p{C}\s]+|[\p{Z}\p{C}\s]+$", ""))
    return F.when(plain != "", plain)


def records(messages: DataFrame) -> DataFrame:
    """One row per message_id (the copy taken in first, then by its text): session, message_id, speaker, created_at, content, reply_to, visible.

    Rows without a session belong to none and are left out. A message without an
    id can be neither told from its copies nor named, and is left out too.
    """
    copy = F.struct("session_id", "role", "content", "created_at", "metadata")
    order = F.struct(F.coalesce(F.col("ingested_at"), F.col("created_at")), F.coalesce("role", F.lit("")), F.coalesce("session_id", F.lit("")))
    one = messages.where("message_id is not null").groupBy("message_id").agg(F.min_by(copy, order).alias("m"))
    reply = F.get_json_object("m.metadata", "$.reply_to")
    plain = one.select(
        session_key("m.session_id").alias("session"), "message_id", speaker("m.role").alias("speaker"), F.col("m.created_at").alias("created_at"),
        F.col("m.content").alias("content"), F.when(F.trim(reply) != "", F.trim(reply)).alias("reply_to"),
        (F.length(F.regexp_replace("m.content", UNSEEN, "")) > 0).alias("visible"),
    )
    return plain.where("session is not null")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds turn_no, from 1 within the session by created_at, then message_id (messages without a time come first), and what came before.

    last holds, for each speaker (unknown included), time and id of the latest
    message before. prior is the
    speaker of the latest message before that is neither of system nor of tool:
    null for none, unknown for one of no known speaker.
    """
    order = ["created_at", "message_id"]
    speaker = F.coalesce("speaker", F.lit("unknown"))
    at = F.struct("created_at", "message_id", speaker.alias("speaker"))
    of = lambda test: F.when(test, at)
    kinds = {k: speaker == k for k in (*SPEAKERS, "unknown")} | {"talk": ~speaker.isin("system", "tool")}
    # a time that is null sorts first in structs as in rows
    out = with_running(rows, ["session"], order, {"before": F.lit(1)}, {k: of(test) for k, test in kinds.items()})
    last = F.array_compact(F.array(*SPEAKERS, "unknown"))
    return out.select(*rows.columns, (F.col("before") + 1).cast("int").alias("turn_no"), F.col("assistant.created_at").alias("answered_at"), F.col("assistant.message_id").alias("answered_id"), last.alias("last"), F.col("talk.speaker").alias("prior"))


def word_hashes(text: str) -> Column:
    """Distinct hashes of the words of a text; of scripts without spaces, of character pairs."""
    plain = F.lower(F.col(text))
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_.-]*[\p{L}\p{N}][\p{L}\p{N}_.-]*?(?=[^\p{L}\p{N}_.-]|[.-](?:\s|$)|$)|[\p{IsHan}]{2}"), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda w: F.hash(w)))


def handles(text: str) -> Column:
    """Hashes of what a text mentions: handles after an @, and ids of messages."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![\p{L}\p{N}._%+-])@[\p{L}\p{N}_-]{2,}|msg_[0-9a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda w: F.hash(w)))


def weighed(each: DataFrame) -> DataFrame:
    """session, word, n, first, last, weight: the words of (session, turn_no, word) that two messages of a session or more hold.

    A word counts 1 / (n - 1) if n messages of the session hold it, and less the
    more messages of all sessions do. Weights are multiples of GRAIN, so that sums
    don't depend on their order.
    """
    counted = stored(each.groupBy("session", "word").agg(F.count("*").alias("n"), F.min("turn_no").alias("first"), F.max("turn_no").alias("last")))
    sessions = counted.groupBy("word").agg(F.sum("n").alias("all"))
    weight = 1 / ((F.col("n") - 1) * F.log2(F.col("all")))
    return stored(counted.where("n > 1").join(sessions, "word").withColumn("weight", F.round(weight / GRAIN) * GRAIN).drop("all"))


def sharing(each: DataFrame, counted: DataFrame) -> DataFrame:
    """session, turn_no, to, shared: pairs of messages of a session that share words of (session, turn_no, word) that weighed() has counted; for words of few messages each."""
    two = counted.where("n = 2").select("session", F.col("last").alias("turn_no"), F.col("first").alias("to"), "weight")
    more = each.join(counted.where("n > 2").select("session", "word", "weight"), ["session", "word"])
    lists = more.groupBy("session", "word").agg(F.array_sort(F.collect_list("turn_no")).alias("turns"), F.max("weight").alias("weight"))
    pairs = F.flatten(F.transform("turns", lambda t, i: F.transform(F.slice("turns", F.lit(1), i), lambda e: F.struct(t.alias("turn_no"), e.alias("to")))))
    many = lists.select("session", "weight", F.explode(pairs).alias("p")).select("session", "p.turn_no", "p.to", "weight")
    return two.unionByName(many).groupBy("session", "turn_no", "to").agg(F.sum("weight").alias("shared"))


def score_of(own: dict[str, Column], parent: Column, shared: Column, named: Column) -> Column:
    """How likely ``parent`` (created_at, message_id, speaker, size) is what a message answers."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    gap = F.abs(F.coalesce(seconds(own["created_at"]) - seconds(parent["created_at"]), F.lit(HALF_TIME_S)))
    near = F.lit(HALF_TIME_S) / (gap + HALF_TIME_S)
    turn = F.coalesce((own["speaker"] != parent["speaker"]).cast("double"), F.lit(0.0))
    overlap = F.least(F.lit(0.5), shared / F.sqrt(F.greatest(own["size"] * parent["size"], F.lit(1)).cast("double")))
    behind = own["answered_id"].isNull() | (F.struct(parent["created_at"], parent["message_id"]) > F.struct(own["answered_at"], own["answered_id"]))
    unanswered = (own["speaker"] == "assistant") & (parent["speaker"] == "user") & behind
    return near * (WEIGHTS["time"] + WEIGHTS["turn"] * turn) + WEIGHTS["overlap"] * overlap + WEIGHTS["mention"] * named + WEIGHTS["open"] * F.coalesce(unanswered, F.lit(False)).cast("int")


class Slices:
    """Messages of slices in columns: whole record batches, of which groups of rows are compared."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        number = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(float)
        self.at, self.answered, self.size, self.floor = (number(c) for c in ("at", "answered", "size", "floor"))
        self.speaker = rows.column("speaker").to_numpy(zero_copy_only=False)
        self.ids, self.answered_ids = rows.column("message_id").to_pylist(), rows.column("answered_id").to_pylist()
        self.lists = {c: (rows.column(c).offsets.to_numpy(), rows.column(c).values.to_numpy()) for c in ("words", "weights", "names")}

    def key(self, at: float, message_id: str) -> tuple[float, str]:
        return (-np.inf if np.isnan(at) else at, message_id)

    def behind(self, own: np.ndarray, other: range) -> np.ndarray:
        """The place in ``other`` from which on messages come after the latest answer before each of ``own``."""
        keys = [self.key(self.at[i], self.ids[i]) for i in other]
        return np.array([0 if self.answered_ids[i] is None else bisect_right(keys, self.key(self.answered[i], self.answered_ids[i])) for i in own], int)

    def words_of(self, name: str, rows: np.ndarray):
        """The words of rows as flat arrays: place among the rows, word, weight (1 for names)."""
        ends, flat = self.lists[name]
        many = ends[rows + 1] - ends[rows]
        pick = np.repeat(ends[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(np.arange(len(rows)), many), flat[pick], self.lists["weights"][1][pick] if name == "words" else np.ones(len(pick))

    def best(self, own: range, other: range, same: bool):
        """For each of ``own`` with a candidate in ``other`` that can be its likeliest parent: its row, that of the candidate, and the score. ``same`` if both are one slice."""
        theirs = np.array(other)
        held = {name: Held(*self.words_of(name, theirs)[:2], len(theirs)) for name in ("words", "names")}
        for first in range(own.start, own.stop, ROWS):
            mine = np.arange(first, min(first + ROWS, own.stop))
            start, answers = np.full(len(mine), len(other)), self.speaker[mine] == ASSISTANT
            start[answers] = self.behind(mine[answers], other)
            if not same:
                row, word, weight = self.words_of("words", mine)
                most = np.bincount(row, weight * held["words"].has(word), minlength=len(mine))
                near = HALF_TIME_S / (np.maximum(self.at[mine] - self.at[theirs].max(), 0) / 1e6 + HALF_TIME_S)
                most = np.minimum(0.5, most / np.sqrt(np.maximum(self.size[mine] * self.size[theirs].min(), 1)))
                named = np.diff(self.lists["names"][0])[mine] > 0
                most = np.where(np.isnan(near), 1, near) * (WEIGHTS["time"] + WEIGHTS["turn"]) + WEIGHTS["overlap"] * most + WEIGHTS["mention"] * named + WEIGHTS["open"] * (start < len(other))
                can = ~(most * (1 + 1e-9) < self.floor[mine])
                mine, start = mine[can], start[can]
            if not len(mine):
                continue
            gap = np.abs(self.at[mine][:, None] / 1e6 - self.at[theirs] / 1e6)
            score = HALF_TIME_S / (np.where(np.isnan(gap), HALF_TIME_S, gap) + HALF_TIME_S)
            a, b = self.speaker[mine][:, None], self.speaker[theirs]
            score *= WEIGHTS["time"] + WEIGHTS["turn"] * ((a != b) & (a >= 0))
            score += WEIGHTS["overlap"] * np.minimum(0.5, held["words"].shared(*self.words_of("words", mine), len(mine)) / np.sqrt(np.maximum(np.outer(self.size[mine], self.size[theirs]), 1)))
            score += WEIGHTS["mention"] * (held["names"].shared(*self.words_of("names", mine), len(mine)) > 0)
            score += WEIGHTS["open"] * ((b == USER) & (np.arange(len(theirs)) >= start[:, None]))
            if same:
                score[theirs >= mine[:, None]] = -np.inf
            # the latest of equal ones
            place = len(theirs) - 1 - score[:, ::-1].argmax(axis=1)
            score = score[np.arange(len(mine)), place]
            found = score > -np.inf
            yield mine[found], theirs[place[found]], score[found]


class Held:
    """The words of a slice of n messages."""

    def __init__(self, row: np.ndarray, word: np.ndarray, n: int):
        self.n = n
        self.words, self.own = np.unique(word, return_inverse=True)
        self.row = row[np.argsort(self.own, kind="stable")]
        self.own = np.sort(self.own)
        self.many = np.bincount(self.own, minlength=len(self.words))
        self.start = np.cumsum(self.many) - self.many

    def has(self, word: np.ndarray) -> np.ndarray:
        return np.isin(word, self.words)

    def shared(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The weights that n other messages share with those of the slice."""
        known = self.has(word)
        row, weight, place = row[known], weight[known], np.searchsorted(self.words, word[known])
        if not len(row):
            return np.zeros((n, self.n))
        large = (np.bincount(place, minlength=len(self.words)) * self.many > DENSE)[place]
        r, p = row[~large], place[~large]
        cells = np.repeat(r * self.n, self.many[p]) + self.row[np.repeat(self.start[p] - np.cumsum(self.many[p]) + self.many[p], self.many[p]) + np.arange(self.many[p].sum())]
        out = np.bincount(cells, np.repeat(weight[~large], self.many[p]), minlength=n * self.n).reshape(n, self.n).astype(float)
        r, w, p = row[large], weight[large], place[large]
        every = np.unique(p)
        for i in range(0, len(every), COLUMNS):
            part = every[i : i + COLUMNS]
            of, to = np.isin(p, part), np.isin(self.own, part)
            a, b = np.zeros((n, len(part))), np.zeros((len(part), self.n))
            a[r[of], np.searchsorted(part, p[of])] = w[of]
            b[np.searchsorted(part, self.own[to]), self.row[to]] = 1
            out += a @ b
        return out


def compared(rows: DataFrame, slice_: int) -> DataFrame:
    """session, turn_no, best: for the messages of ``rows`` the likeliest parent of all that come before in the session.

    Every two slices of a session meet once, in one task, which compares all their
    messages, but for those whose likeliest parent so far (floor) scores more than
    any message of the slice can.
    """
    of = F.floor((F.col("turn_no") - 1) / slice_).cast("int")
    last = rows.groupBy("session").agg(F.max(of).alias("slices"))
    rows = rows.withColumn("own", of)
    earlier = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("a", F.col("own")).withColumn("side", F.lit(0))
    later = rows.join(last, "session").where("own < slices").withColumn("a", F.explode(F.sequence(F.col("own") + 1, F.col("slices")))).withColumn("b", F.col("own")).withColumn("side", F.lit(1)).drop("slices")
    keys = ["session", "a", "b"]
    meet = earlier.unionByName(later).drop("own").repartition(*keys).sortWithinPartitions(*keys, "side", "turn_no")

    def groups(batches):
        rest = None
        for batch in (b for b in batches if b.num_rows):
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = pa.compute.not_equal(whole["session"][1:], whole["session"][:-1]).to_numpy(zero_copy_only=False)
            for k in keys[1:]:
                new = new | (np.diff(whole[k].to_numpy()) != 0)
            ends = [0, *(np.flatnonzero(new) + 1).tolist()]
            if ends[-1]:
                yield whole.slice(0, ends[-1]), ends
            rest = whole.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield rest, [0, rest.num_rows]

    def best(batches):
        for whole, ends in groups(batches):
            # a slice of a list column keeps its offsets into the whole, which Slices needs
            slices, side, out = Slices(whole), whole["side"].to_numpy(), []
            for lo, hi in zip(ends, ends[1:], strict=False):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                same = whole["a"][lo].as_py() == whole["b"][lo].as_py()
                out += slices.best(range(lo, mid), range(lo, hi) if same else range(mid, hi), same)
            if out:
                own, to, score = (np.concatenate(x) for x in zip(*out, strict=True))
                own, to = pa.array(own), pa.array(to)
                yield pa.RecordBatch.from_arrays([whole["session"].take(own), whole["turn_no"].take(own), pa.array(score), whole["created_at"].take(to), whole["message_id"].take(to)], names=["session", "turn_no", "score", "created_at", "message_id"])

    found = meet.mapInArrow(best, f"session string, turn_no int, score double, created_at {rows.schema['created_at'].dataType.simpleString()}, message_id string")
    return found.select("session", "turn_no", F.struct("score", "created_at", "message_id").alias("best"))


OWN = ("created_at", "speaker", "size", "answered_at", "answered_id")


def linked(rows: DataFrame, telling: int = TELLING, slice_: int = SLICE) -> DataFrame:
    """session, turn_no, parent_turn, told: the turn of the message that each one most likely answers, null for roots; told if reply_to names it.

    ``rows`` is a stored numbered() table. All candidates are earlier. Without a
    shared word or a mention only the latest message of each speaker can be the
    likeliest parent, as all others of that speaker score less by time; these are
    in the row itself. In sessions none of whose words more than ``telling``
    messages hold, those that share something meet in sharing(); in all others
    every two messages are compared.
    """
    slim = stored(rows.select("session", "turn_no", "message_id", "speaker", "created_at", "reply_to", "answered_at", "answered_id", "last", word_hashes("content").alias("words"), handles("content").alias("names")))
    slim = slim.withColumn("size", F.size("words"))
    own = {k: F.col(k) for k in OWN}
    scored = F.transform("last", lambda c: F.struct(score_of(own, F.struct(c["created_at"].alias("created_at"), c["message_id"].alias("message_id"), c["speaker"].alias("speaker"), F.lit(1).alias("size")), F.lit(0), F.lit(0)).alias("score"), c["created_at"].alias("created_at"), c["message_id"].alias("message_id")))
    nearest = slim.select("session", "turn_no", F.array_max(scored).alias("best"))
    said = slim.select("session", "turn_no", F.explode("words").alias("word"))
    quoted = slim.select("session", "turn_no", F.explode("names").alias("word"))
    # who quotes an id means its message; a handle is shared by those who speak of it
    ids = slim.select("session", "turn_no", F.hash(F.lower("message_id")).alias("word")).join(quoted.select("session", "word").distinct(), ["session", "word"], "left_semi")
    quoted = quoted.unionByName(ids).distinct()
    said_n, quoted_n = weighed(said), weighed(quoted)
    whole = stored(said_n.unionByName(quoted_n).where(F.col("n") > telling).select("session").distinct())

    words = sharing(said, said_n.join(whole, "session", "left_anti"))
    names = sharing(quoted, quoted_n.join(whole, "session", "left_anti"))
    pairs = words.select("session", "turn_no", "to", "shared", F.lit(0).alias("named")).unionByName(names.select("session", "turn_no", "to", F.lit(0.0).alias("shared"), F.lit(1).alias("named")))
    pairs = pairs.groupBy("session", "turn_no", "to").agg(F.max("shared").alias("shared"), F.max("named").alias("named"))
    parents = slim.select("session", F.col("turn_no").alias("to"), F.struct("created_at", "message_id", F.coalesce("speaker", F.lit("unknown")).alias("speaker"), "size").alias("c"))
    met = pairs.join(slim.select("session", "turn_no", *OWN), ["session", "turn_no"]).join(parents, ["session", "to"])
    linking = met.select("session", "turn_no", F.struct(score_of(own, F.col("c"), F.col("shared"), F.col("named")).alias("score"), "c.created_at", "c.message_id").alias("best"))

    inside = lambda each, counted: each.join(counted.join(whole, "session", "left_semi").select("session", "word", "weight"), ["session", "word"])
    held = inside(said, said_n).select("session", "turn_no", "word", "weight", F.lit(False).alias("name")).unionByName(inside(quoted, quoted_n).select("session", "turn_no", "word", "weight", F.lit(True).alias("name")))
    lists = held.groupBy("session", "turn_no").agg(F.collect_list(F.when(~F.col("name"), F.struct("word", "weight"))).alias("w"), F.collect_list(F.when(F.col("name"), F.col("word"))).alias("names"))
    lists = lists.select("session", "turn_no", F.col("w.word").alias("words"), F.col("w.weight").alias("weights"), "names")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    code = F.coalesce(*[F.when(F.col("speaker") == s, i) for i, s in enumerate(SPEAKERS)], F.lit(-1)).alias("speaker")
    full = slim.join(whole, "session", "left_semi").withColumn("floor", F.array_max(scored)["score"]).select("session", "turn_no", "message_id", "created_at", code, micros("created_at").alias("at"), "size", micros("answered_at").alias("answered"), "answered_id", "floor")
    full = full.join(lists, ["session", "turn_no"], "left")
    full = full.select(*[c for c in full.columns if c not in lists.columns[2:]], *[F.coalesce(c, F.array().cast(full.schema[c].dataType)).alias(c) for c in lists.columns[2:]])

    best = nearest.unionByName(linking).unionByName(compared(stored(full), slice_)).groupBy("session", "turn_no").agg(F.max("best").alias("best")).where(F.col("best.score") >= MIN_SCORE)
    likely = best.select("session", "turn_no", F.col("best.message_id").alias("message_id"), F.lit(False).alias("told"))
    asked = slim.where("reply_to is not null").select("session", "turn_no", F.col("reply_to").alias("message_id"), F.lit(True).alias("told"))
    place = slim.select("session", "message_id", F.col("turn_no").alias("to"))
    found = likely.unionByName(asked).join(place, ["session", "message_id"]).where("to < turn_no")
    chosen = found.groupBy("session", "turn_no").agg(F.max_by("to", "told").alias("parent_turn"), F.max("told").alias("told"))
    return slim.select("session", "turn_no").join(chosen, ["session", "turn_no"], "left").select("session", "turn_no", "parent_turn", F.coalesce("told", F.lit(False)).alias("told"))


def rooted(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """session, turn_no, parent_turn, root_turn: the root of each message's link tree.

    Parents are earlier than children. Inside a block of turns a fold follows the
    links to the root or out of the block; what leaves the block is followed by
    pointer doubling, whose rounds grow with the logarithm of the number of blocks.
    """
    of = F.floor((F.col("turn_no") - 1) / block).cast("int")
    lists = links.withColumn("block", of).groupBy("session", "block").agg(F.array_sort(F.collect_list(F.struct("turn_no", "parent_turn"))).alias("links"))

    def step(acc: Column, x: Column) -> Column:
        first = F.element_at("links", 1)["turn_no"]
        inside = F.try_element_at(acc, x["parent_turn"] - first + 1)
        to = F.when(x["parent_turn"].isNull(), x["turn_no"]).when(x["parent_turn"] < first, x["parent_turn"]).otherwise(inside)
        return F.array_append(acc, to)

    ends = F.aggregate("links", F.array().cast("array<int>"), step)
    flat = lists.select("session", F.posexplode("links").alias("pos", "link"), ends.alias("ends"))
    flat = flat.select("session", "link.turn_no", "link.parent_turn", F.element_at("ends", F.col("pos") + 1).alias("to"))
    todo = stored(flat.withColumn("block", of))
    done = F.floor((F.col("to") - 1) / block).cast("int") == F.col("block")  # the end lies in the block: it is a root
    parts = [todo.where(done)]
    open_ = todo.where(~done)
    # where a turn leads: every turn is a place that others may lead to
    jumps = todo.select("session", F.col("turn_no").alias("to"), F.col("to").alias("next"), done.alias("ended"))
    while not open_.isEmpty():
        moved = stored(open_.join(jumps, ["session", "to"]).select("session", "turn_no", "parent_turn", F.col("next").alias("to"), "block", "ended"))
        parts.append(moved.where("ended").drop("ended"))
        open_ = moved.where("not ended").drop("ended")
        step_on = moved.select("session", F.col("turn_no").alias("at"), F.col("to").alias("next2"), F.col("ended").alias("ended2"))
        old = jumps.withColumnRenamed("to", "at").join(step_on, ["session", "at"], "left")
        jumps = stored(old.select("session", F.col("at").alias("to"), F.coalesce("next2", "next").alias("next"), F.coalesce("ended2", "ended").alias("ended")))
    names = ["session", "turn_no", "parent_turn", "to"]
    out = parts[0].select(names)
    for p in parts[1:]:
        out = out.unionByName(p.select(names))
    return out.withColumnRenamed("to", "root_turn")


def conversations(messages: DataFrame) -> DataFrame:
    """session, turn_no, message_id, speaker, content, created_at, parent_turn, root_turn, kept: every message in the order of its conversation.

    kept tells whether the session is one that is complete: it has a user and an
    assistant, every message a known speaker, a time and a visible character, no
    reply_to leads out of the session, and without system and tool messages it
    begins with a user, each of whose messages an assistant's follows directly
    and hangs in the same tree.
    """
    rows = stored(numbered(records(messages)))
    links = stored(linked(rows))
    trees = stored(rooted(links))
    return rows.drop("last", "answered_at", "answered_id", "prior").join(trees, ["session", "turn_no"]).join(sessions(rows, links, trees), "session")


def sessions(rows: DataFrame, links: DataFrame, trees: DataFrame) -> DataFrame:
    """session, kept. Trees are judged first, each by its own messages, then a session by its trees.

    A user message is answered if an assistant's message follows it directly and
    hangs in the same tree, or in the one that its reply_to names. What precedes
    a message is known from numbered(), so nothing is sorted again. A tree with
    a user message that is not answered is incomplete.
    """
    facts = rows.select("session", "turn_no", "message_id", "speaker", "prior", "reply_to", (F.col("speaker").isNotNull() & F.col("created_at").isNotNull() & F.coalesce("visible", F.lit(False))).alias("whole"), F.get(F.filter("last", lambda x: x["speaker"] == "user"), F.lit(0))["message_id"].alias("asked_id"))
    both = stored(facts.join(trees.select("session", "turn_no", "root_turn"), ["session", "turn_no"]).join(links.select("session", "turn_no", "told"), ["session", "turn_no"]))
    talk = F.col("speaker").isNull() | F.col("speaker").isin("user", "assistant")
    answer = talk & (F.col("prior") == "user") & (F.col("speaker") == "assistant")
    answers = both.where(answer).select("session", F.col("asked_id").alias("message_id"), F.col("root_turn").alias("answer_root"), F.col("told").alias("answer_told"))
    asked = both.where("speaker = 'user'").select("session", "message_id", "root_turn").join(answers, ["session", "message_id"], "left")
    asked = asked.groupBy("session", "root_turn").agg(F.max(F.coalesce((F.col("answer_root") != F.col("root_turn")) & ~F.col("answer_told"), F.lit(True))).alias("unanswered"))
    first = talk & F.col("prior").isNull()
    of_tree = both.groupBy("session", "root_turn").agg(
        F.max(F.coalesce(F.col("speaker") == "user", F.lit(False))).alias("has_user"),
        F.max(F.coalesce(F.col("speaker") == "assistant", F.lit(False))).alias("has_assistant"),
        F.min("whole").alias("whole"),
        F.max(first & ~F.coalesce(F.col("speaker") == "user", F.lit(False))).alias("bad_start"),
    )
    of_tree = of_tree.join(asked, ["session", "root_turn"], "left")
    ids = both.select("session", F.col("message_id").alias("reply_to")).withColumn("there", F.lit(True))
    replies = both.where("reply_to is not null").select("session", "reply_to").distinct().join(ids, ["session", "reply_to"], "left")
    lost = replies.where("there is null").select("session", F.lit(True).alias("lost_reply")).distinct()
    state = of_tree.groupBy("session").agg(*[F.max(c).alias(c) for c in ("has_user", "has_assistant", "bad_start")], F.min("whole").alias("whole"), F.max(F.coalesce("unanswered", F.lit(False))).alias("unanswered"))
    kept = F.col("has_user") & F.col("has_assistant") & F.col("whole") & ~F.col("bad_start") & ~F.col("unanswered") & F.col("lost_reply").isNull()
    return state.join(lost, "session", "left").select("session", kept.alias("kept"))

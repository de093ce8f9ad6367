"""Repair of conversations' structure by a forward Viterbi over four grammar states.

A repaired conversation's role initials are (s?(ua)+)?: nothing yet, after a
system turn, after a user, after an assistant.  A turn is kept, given another
role or deleted, and empty turns are inserted; each turn's layer begins with at
most two inserts, since a third would come back to a state that was there for
less.

Each state carries its least (cost, audit string).  Audit strings aren't copied
from turn to turn: a byte for each state and turn says where it came from, and
the four strings' order is carried as a rank.  That is the same, as long as none
of the four is the beginning of another, and inserts stand before their turn to
make it so: all strings have as many letters other than I as there were turns,
and end in one.  Ties between whole edits are therefore broken as by comparing
whole strings.

A conversation's rows are walked in order and never held: memory is four bytes
a turn, the four states, and four running hashes of the repaired text, one of
which is the result's.  Earlier copies of a turn are found by a window before
that (a sort that can spill).  All of it is one shuffle by conversation.  A
conversation's hash covers all of its repaired text in order, so one task walks
a conversation; its size costs time there, not memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import arrow_schema, batch, ready

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of each role leads.
GRAMMAR = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (START, ASSISTANT)
#: The role of an inserted turn, and of one that gets another role: what the state asks for.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = ("su", "ua", "au")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a layer's letters can be.
LOCAL = [i + x for i in ("", "I", "II") for x in "DKR"]
_CODE = {x: k for k, x in enumerate(LOCAL)}

#: Space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def _better(a, b):
    return a if b is None or (a is not None and a[:3] <= b[:3]) else b


def closed(states: list) -> list:
    """The states with up to two inserts: (cost, rank, letters, state it came from) or None."""
    now = [None if s is None else (s[0], s[1], "", k) for k, s in enumerate(states)]
    for _ in range(2):
        more = list(now)
        for k, own in enumerate(now):
            if own is not None:
                to = NEXT[k][0]
                more[to] = _better((own[0] + INSERT, own[1], own[2] + "I", own[3]), more[to])
        now = more
    return now


def layer(states: list, initial: str, keepable: bool, truncated: bool) -> list:
    """The states after one more turn."""
    after = [None] * 4
    for k, own in enumerate(closed(states)):
        if own is None:
            continue
        cost, rank, letters, came = own
        after[k] = _better((cost + DELETE, rank, letters + "D", came), after[k])
        if keepable:
            fee = TRUNCATED if truncated else 0
            to = GRAMMAR.get(initial, {}).get(k)
            if to is not None:
                after[to] = _better((cost + KEEP + fee, rank, letters + "K", came), after[to])
            to = NEXT[k][0]
            after[to] = _better((cost + REROLE + fee, rank, letters + "R", came), after[to])
    return after


def ranked(winners: list) -> list:
    """(cost, rank) of each state, the ranks by the whole audit strings."""
    order = {x: k for k, x in enumerate(sorted({w[1:3] for w in winners if w is not None}))}
    return [None if w is None else (w[0], order[w[1:3]]) for w in winners]


def _told(running, role: str, text: bytes):
    """The running hash with one more turn; None before the first."""
    new = hashlib.sha256() if running is None else running.copy()
    new.update(b"%s%s:" % (b"" if running is None else b"\n", role.encode()))
    new.update(text)
    return new


def path_roles(state: int, letters: str, role: str):
    """For letters taken in a state: the roles of the turns that they leave, and the state after them; None for a deleted turn."""
    roles = []
    for x in letters:
        if x == "D":
            roles.append(None)
        elif x == "K":
            roles.append(role)
            state = GRAMMAR[role[:1]][state]
        else:
            state, own = NEXT[state]
            roles.append(own)
    return roles, state


class Walk:
    """One conversation, turn by turn."""

    def __init__(self):
        self.states: list = [(0, 0), None, None, None]
        self.hashes: list = [None] * 4
        self.back = bytearray()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before = None
        self.turns: list = [None, None, 0]  # least, greatest, distinct

    def add(self, turn: int | None, role: str, text: bytes, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.before = role[:1]
        if turn is not None:
            least, greatest, n = self.turns
            self.turns = [turn if least is None else least, turn, n + (turn != greatest)]
        winners = layer(self.states, role[:1], fault in ("", "truncated"), fault == "truncated")
        hashes: list = [None] * 4
        for k, won in enumerate(winners):
            if won is None:
                self.back.append(255)
                continue
            came, letters = won[3], won[2]
            self.back.append(came * len(LOCAL) + _CODE[letters])
            hashes[k] = self.hashes[came]
            for x, own in zip(letters, path_roles(came, letters, role)[0]):
                if own is not None:
                    hashes[k] = _told(hashes[k], own, b"" if x == "I" else text)
        self.states, self.hashes = ranked(winners), hashes

    def result(self) -> tuple:
        ends = closed(self.states)
        state = min((k for k in FINAL if ends[k] is not None), key=lambda k: ends[k][:3])
        cost, _, tail, state = ends[state]
        running = self.hashes[state]
        for own in path_roles(state, tail, "")[0]:
            running = _told(running, own, b"")
        letters = [tail]
        for k in range(len(self.back) - 4, -1, -4):
            state, code = divmod(self.back[k + state], len(LOCAL))
            letters.append(LOCAL[code])
        least, greatest, n = self.turns
        gaps = 0 if least is None else greatest - least + 1 - n
        return gaps, *self.counts.values(), cost, "".join(reversed(letters)), (running or hashlib.sha256()).hexdigest()


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FIELDS = [*[(x, pa.int64()) for x in _LONGS], ("audit", pa.string()), ("repaired_sha256", pa.string())]


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """df's rows with damage by the crc32 of conversation and turn: columns conv_col, turn_col, role_col, text_col and gone.

    A dropped row stays as a row with gone, so that its conversation does.
    Nulls become one space in the key, role and text; nulls of conv_col and
    turn_col stay as they are.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    made = df.select(F.col(conv_col), F.col(turn_col), F.when(kind == 4, F.lit("user")).otherwise(role).alias(role_col), text.alias(text_col), (kind == 0).alias("gone"), copies)
    return made.drop("_copy")


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    """Rows by conversation and turn, with the first fault of each; columns _conv, _turn, _role, _text, _fault, _gone."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"), gone.alias("_gone"))
    trimmed = F.rtrim(F.col("_text"), F.lit(BLANKS))
    seen = Window.partitionBy("_conv", "_gone", "_role", F.sha2("_text", 256)).orderBy(F.col("_turn").asc_nulls_first())
    fault = F.when(trimmed == "", F.lit("blank")).when(F.row_number().over(seen) > 1, F.lit("duplicate")).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    rows = rows.repartition(tasks, "_conv").withColumn("_fault", fault)
    return rows.sortWithinPartitions(F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text")


def repair_conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None = None) -> DataFrame:
    """One row per conversation of df: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null turns first, rows of one turn by role and text.
    A null role or text is one space; the null conversation is one of its own.
    A role without a letter can't be kept, as the grammar has none for it.
    Rows that are marked in gone_col don't count, but their conversation does:
    without other rows it has zeros, an empty audit and the hash of nothing.  Of
    rows that repeat one another all but the first are duplicates.  An empty
    table gives an empty table; conv_col can't have the name of a result.
    """
    ready(df)
    schema = arrow_schema(df, conv_col, *_FIELDS)
    rows = _ordered(df, conv_col, turn_col, role_col, text_col, F.col(gone_col) if gone_col else F.lit(False))
    rows = rows.select("_conv", "_turn", "_role", F.col("_text").cast("binary"), "_fault", "_gone")

    def out(found: list):
        return batch(schema, [c for c, _ in found], *([w[k] for _, w in found] for k in range(len(_FIELDS))))

    def run(batches):
        walk, own = None, None
        for b in batches:
            found = []
            convs = b.column(0).to_pylist()
            for i, conv in enumerate(convs):
                if walk is None or conv != own:
                    if walk is not None:
                        found.append((own, walk.result()))
                    walk, own = Walk(), conv
                if not b.column(5)[i].as_py():
                    walk.add(*(b.column(k)[i].as_py() for k in range(1, 5)))
            yield out(found)
        if walk is not None:
            yield out([(own, walk.result())])

    return rows.mapInArrow(run, from_arrow_schema(schema))


def repaired_turns(df: DataFrame, report: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None = None) -> DataFrame:
    """The repaired conversations: conv_col, position, turn (null for inserted ones), role, text, action.

    report is what repair_conversations() returned for the same rows.  A
    conversation's audit goes before its rows in the sort and its letters are
    spent on them as they come.
    """
    ready(df)
    rows = _ordered(df, conv_col, turn_col, role_col, text_col, F.col(gone_col) if gone_col else F.lit(False)).filter("not _gone")
    audits = report.select(F.col(conv_col).alias("_conv"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.col("audit").alias("_text"), F.lit("").alias("_fault"), F.lit(True).alias("_gone"))
    both = audits.unionByName(rows).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_conv")
    both = both.sortWithinPartitions(F.col("_conv").asc_nulls_first(), F.col("_gone").desc(), F.col("_turn").asc_nulls_first(), "_role", "_text")
    schema = arrow_schema(df, conv_col, ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("action", pa.string()))

    def run(batches):
        letters, at, state, position = "", 0, START, 0
        for b in batches:
            made: list = []
            for i, (_, turn, role, text, _, is_audit) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if is_audit:
                    letters, at, state, position = text, 0, START, 0
                    continue
                end = min(k for k in (letters.find(x, at) for x in "DKR") if k >= 0) + 1
                if not letters[end:].strip("I"):
                    end = len(letters)  # inserts after the last row
                roles, after = path_roles(state, letters[at:end], role)
                for x, own in zip(letters[at:end], roles):
                    if own is not None:
                        made.append((i, position, *((None, own, "", "insert") if x == "I" else (turn, own, text, "keep" if x == "K" else "rerole"))))
                        position += 1
                at, state = end, after
            yield batch(schema, b.column(0).take(pa.array([m[0] for m in made], pa.int64())), *([m[k] for m in made] for k in range(1, 6)))

    return both.select("_conv", "_turn", "_role", "_text", "_fault", "_gone").mapInArrow(run, from_arrow_schema(schema))

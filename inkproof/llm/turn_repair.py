"""Repair of conversation structure by generalised LR parsing over the grammar of roles.

A conversation may hold a system message and must then alternate user and assistant, ending with the
assistant: S -> empty | T | s T, T -> u a | T u a over the roles' initials. The parser reads the rows in order
and holds all stacks that are still possible; stacks share their lower parts. At each row every stack
may shift the row as it is (Keep), shift it under another role (Rerole) or pass over it (Delete), and
between rows it may shift an empty message (Insert). Where two ways lead to the same stack, the smaller
(cost, audit) stays. The audit is the edits' initials.

Rows are dealt out in order of (conversation, turn), so that a task holds a run of conversations. One
that is cut by the border of two tasks is parsed in pieces, each for every kind of stack that may arrive
there, and the pieces are put together: no conversation is gathered in a task because of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkproof.llm.common import BLANK_CHARACTERS, stored

#: Costs of edits; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The LR automaton: shifts, the states in which T is complete with the symbols to pop, where T leads, the states that may end.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 6, (5, "u"): 6, (6, "a"): 7}
REDUCE = {3: 2, 7: 3}
GOTO = {0: 4, 1: 5}
FINAL = (0, 4, 5)
ROLES = {"u": "user", "a": "assistant"}
#: What may still follow depends on the top state only, and only on its kind: nothing yet, a system message, an open or a closed pair.
KIND = {0: 0, 1: 1, 2: 2, 6: 2, 4: 3, 5: 3}
#: Texts of one conversation that a task holds for the hash; of longer ones the hash is taken in a pass of its own.
HELD_CHARACTERS = 32 << 20
#: Equal rows of a conversation are dealt to so many groups before their first is found.
SALTS = 64

Stack = tuple  # (state, the stack below)
BOTTOM: Stack = (0, None)
#: A stack of each kind.
STACKS: tuple[Stack, ...] = (BOTTOM, (1, BOTTOM), (2, BOTTOM), (4, BOTTOM))


def shifted(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a shift and the reduction that may follow; None if the symbol can't stand here."""
    to = SHIFT.get((stack[0], symbol))
    if to is None:
        return None
    stack = (to, stack)
    if to in REDUCE:
        for _ in range(REDUCE[to]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


class Edits:
    """Edits so far, as a list that shares its beginning with others."""

    __slots__ = ("before", "letter", "length")

    def __init__(self, before: Edits | None, letter: str) -> None:
        self.before, self.letter = before, letter
        self.length = before.length + 1 if before else 0

    def text(self) -> str:
        letters, at = [], self
        while at.before is not None:
            letters.append(at.letter)
            at = at.before
        return "".join(reversed(letters))


def smaller(a: Edits, a_letter: str, b: Edits) -> bool:
    """Whether a followed by a_letter comes before b in code order; both begin with the same list."""
    x, y = [a_letter], []
    while a is not b:
        if a.length >= b.length:
            x.append(a.letter)
            a = a.before
        else:
            y.append(b.letter)
            b = b.before
    return x[::-1] < y[::-1]


class Frontier:
    """All stacks after the rows read so far, each with its least (cost, audit)."""

    def __init__(self, start: Stack) -> None:
        self.best: dict[Stack, tuple[int, Edits]] = {start: (0, Edits(None, ""))}
        self._insert()

    def _offer(self, stack: Stack | None, cost: int, edits: Edits, letter: str) -> bool:
        if stack is None:
            return False
        have = self.best.get(stack)
        if have and (have[0] < cost or have[0] == cost and not smaller(edits, letter, have[1])):
            return False
        self.best[stack] = cost, Edits(edits, letter)
        return True

    def _insert(self) -> None:
        waiting = list(self.best)
        while waiting:
            stack = waiting.pop()
            cost, edits = self.best[stack]
            for symbol in ROLES:
                to = shifted(stack, symbol)
                if self._offer(to, cost + INSERT, edits, "I"):
                    waiting.append(to)

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        before, self.best = self.best, {}
        more = TRUNCATED if truncated else 0
        for stack, (cost, edits) in before.items():
            self._offer(stack, cost + DELETE, edits, "D")
            if not must_go:
                self._offer(shifted(stack, initial), cost + more, edits, "K")
                for symbol in ROLES:
                    self._offer(shifted(stack, symbol), cost + REROLE + more, edits, "R")
        self._insert()

    def by_kind(self) -> dict[int, tuple[int, str]]:
        """Least (cost, audit) for each kind of stack."""
        out: dict[int, tuple[int, str]] = {}
        for stack, (cost, edits) in self.best.items():
            kind = KIND[stack[0]]
            if kind not in out or cost <= out[kind][0]:
                found = cost, edits.text()
                out[kind] = min(out.get(kind, found), found)
        return out


def whole(kinds: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(kinds[KIND[s]] for s in FINAL if KIND[s] in kinds)


class Messages:
    """The repaired messages, row by row."""

    def __init__(self) -> None:
        self.pairs = 0

    def _next(self) -> str:
        self.pairs += 1
        return ROLES["u" if self.pairs % 2 else "a"]

    def of(self, letter: str, role: str, text: str) -> tuple[str, str] | None:
        """The message that an edit leaves; role and text of its row, if it has one."""
        if letter == "D":
            return None
        if letter == "K":
            self.pairs += role[:1] in ROLES
            return role, text
        return self._next(), text if letter == "R" else ""


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of rows under an audit; rows are taken one at a time."""
    made = Messages()
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        message = made.of(letter, role, text)
        if message:
            yield message


class Digest:
    """SHA-256 of `role:text` lines."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True


def sha_of(audit: str, rows: list[tuple[str, str]]) -> str:
    digest = Digest()
    for role, text in edited(audit, iter(rows)):
        digest.add(role, text)
    return digest.sha.hexdigest()


class Piece:
    """The rows of one conversation that a task has."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.starts = [Frontier(s) for s in STACKS]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        self.rows: list[tuple[str, str]] | None = []
        self.characters = 0

    def read(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += broken(self.last_initial, initial)
        self.last_initial = initial
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        for f in self.starts:
            f.read(initial, blank or duplicate, truncated)
        if self.rows is not None:
            self.characters += len(text)
            self.rows.append((role, text))
            if self.characters > HELD_CHARACTERS:
                self.rows = None

    def row(self, part: int, inside: bool) -> dict:
        ways = []
        for start, f in enumerate(self.starts):
            ways += [{"entry": start, "exit": kind, "cost": c, "audit": a} for kind, (c, a) in f.by_kind().items()]
        cost, audit = whole({w["exit"]: (w["cost"], w["audit"]) for w in ways if w["entry"] == 0})
        done = None if self.rows is None else sha_of(audit, self.rows)
        keep = [] if inside else ways
        return {
            "conv_id": self.conv_id, "part": part, "inside": inside, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_initial": self.first_initial, "last_initial": self.last_initial, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "sha": done, "ways": keep}


def broken(one: str, other: str) -> bool:
    """Whether two neighbours' initials are not among the pairs that the grammar knows."""
    return one + other not in ("su", "ua", "au")


COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def piece_schema(key: str) -> str:
    return (f"conv_id {key}, part int, inside boolean, turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
            + COUNTS + ", ways array<struct<entry: int, exit: int, cost: long, audit: string>>")


def parse(key: pa.DataType):
    """Sorted rows of many conversations to one row for each: all but the first and last are whole for certain."""
    fields = [("conv_id", key), ("part", pa.int32()), ("inside", pa.bool_()), *[(c, pa.int64()) for c in ("turns", "first_turn", "last_turn")],
              ("first_initial", pa.string()), ("last_initial", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
              ("audit", pa.string()), ("sha", pa.string()), ("ways", WAYS)]
    schema = pa.schema(fields)

    def run(batches):
        part = TaskContext.get().partitionId()
        piece, first, out = None, True, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, *rest in zip(*columns, strict=True):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        out.append(piece.row(part, not first))
                        first = False
                    # the last conversation may go on in the next task: which one that is shows at the end only
                    piece = Piece(conv_id)
                piece.read(*rest)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if piece is not None:
            out.append(piece.row(part, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def put_together(table: pa.Table) -> pa.Table:
    """The pieces of one conversation, joined in order."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["part"])
    if len(pieces) > 1:
        reached = {0: (0, "")}
        for p in pieces:
            ways = [(w["exit"], (reached[w["entry"]][0] + w["cost"], reached[w["entry"]][1], w["audit"])) for w in p["ways"] if w["entry"] in reached]
            found: dict[int, tuple[int, str]] = {}
            for kind, (cost, before, audit) in ways:
                if kind not in found or cost <= found[kind][0]:
                    found[kind] = min(found.get(kind, (cost, before + audit)), (cost, before + audit))
            reached = found
        total = dict(pieces[0])
        total["cost"], total["audit"] = whole(reached)
        total["sha"] = None
        for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
            total[name] = sum(p[name] for p in pieces)
        for a, b in zip(pieces, pieces[1:]):
            total["illegal"] += broken(a["last_initial"], b["first_initial"])
            # nulls come first, so a piece without turns lies before all that have any
            total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
        total["first_turn"] = next((p["first_turn"] for p in pieces if p["first_turn"] is not None), None)
        total["last_turn"] = pieces[-1]["last_turn"]
        pieces = [total]
    pieces[0]["ways"] = []
    return pa.Table.from_pylist(pieces, table.schema)


def hashed(key: pa.DataType):
    """(conv_id, is_row, role, text), the audit before its rows, to (conv_id, sha), one row at a time."""

    def finish(digest, audit):
        made, at = audit
        for letter in at:  # inserts after the last row
            digest.add(*made.of(letter, "", ""))
        return digest.sha.hexdigest()

    def run(batches):
        ids, shas = [], []
        digest = audit = None
        for batch in batches:
            for conv_id, is_row, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not is_row:
                    if digest is not None:
                        shas.append(finish(digest, audit))
                    ids.append(conv_id)
                    digest, audit = Digest(), (Messages(), iter(text))
                    continue
                made, at = audit
                for letter in at:
                    message = made.of(letter, role, text)
                    if message:
                        digest.add(*message)
                    if letter != "I":
                        break
        if digest is not None:
            shas.append(finish(digest, audit))
        yield pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(shas, pa.string())], names=["conv_id", "sha"])

    return run


def spelt_out(key: pa.DataType):
    """The stream that `hashed` reads to (conv_id, position, role, text) of the repaired messages."""
    schema = pa.schema([("conv_id", key), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        of = audit = None
        position, out = 0, []

        def put(message):
            nonlocal position
            position += 1
            out.append({"conv_id": of, "position": position, "role": message[0], "text": message[1]})

        for batch in batches:
            for conv_id, is_row, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not is_row:
                    for letter in audit[1] if audit else ():
                        put(audit[0].of(letter, "", ""))
                    of, audit, position = conv_id, (Messages(), iter(text)), 0
                    continue
                for letter in audit[1]:
                    message = audit[0].of(letter, role, text)
                    if message:
                        put(message)
                    if letter != "I":
                        break
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        for letter in audit[1] if audit else ():
            put(audit[0].of(letter, "", ""))
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def arrow_type(key: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[key]


def task_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def after_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, is_row, role, text: the audit of each conversation of audits (cut, audit) and then its rows in order."""
    mine = rows.join(audits.select("cut"), F.col("conv_id").eqNullSafe(F.col("cut")), "left_semi")
    none = F.lit(None).cast("long")
    stream = mine.select("conv_id", F.lit(True).alias("is_row"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(
        audits.select(F.col("cut").alias("conv_id"), F.lit(False).alias("is_row"), none.alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")))
    stream = stream.repartition(task_count(rows), "conv_id")
    first = lambda c: F.col(c).asc_nulls_first()
    return stream.sortWithinPartitions(first("conv_id"), "is_row", first("turn"), "role", "text").select("conv_id", "is_row", "role", "text")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault: blank, duplicate (an earlier row has its role and text) or truncated."""
    trimmed = F.btrim("text", F.lit(BLANK_CHARACTERS))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    order = F.col("turn").asc_nulls_first()
    # the first of each salt's equal rows, then the first of those: many equal rows never meet in one task
    rows = rows.withColumn("salt", salt)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text", "salt").orderBy(order)))
    rows = rows.withColumn("salt", F.when(F.col("nth") == 1, -1).otherwise(F.col("salt")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "text", "salt").orderBy(order)))
    blank = F.length(trimmed) == 0
    duplicate = ~blank & ((F.col("nth") > 1) | (F.col("again") > 1))
    truncated = ~blank & ~duplicate & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    return rows.select("conv_id", "turn", "role", "text", blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and sha for every conversation of rows.

    rows: conv_id, turn (whole numbers), role, text without nulls in role and text. Rows are in order of turn, nulls first, equal turns by role
    and text. A null conv_id is a conversation of its own. gaps are the turns missing between the first
    and the last. An empty table gives none.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    key = dict(rows.dtypes)["conv_id"]
    arrow, tasks = arrow_type(key), task_count(rows)
    first = lambda c: F.col(c).asc_nulls_first()
    ordered = faults(rows).repartitionByRange(tasks, first("conv_id"), first("turn"), "role", F.left("text", F.lit(32)))
    ordered = ordered.sortWithinPartitions(first("conv_id"), first("turn"), "role", "text", "duplicate")
    pieces = stored(ordered.mapInArrow(parse(arrow), piece_schema(key)), "pieces")
    at_borders = pieces.filter("not inside").groupBy("conv_id").applyInArrow(put_together, piece_schema(key))
    parsed = stored(pieces.filter("inside").unionByName(at_borders), "parsed").drop("ways", "part", "inside")

    open_ = parsed.filter(F.col("sha").isNull()).select(F.col("conv_id").alias("cut"), "audit")
    if not open_.isEmpty():
        # SHA-256 goes through a conversation in order: its rows pass one task, one at a time
        late = after_audits(rows, open_).mapInArrow(hashed(arrow), f"conv_id {key}, sha string")
        late = late.select(F.col("conv_id").alias("cut"), F.col("sha").alias("late"))
        parsed = parsed.join(late, F.col("conv_id").eqNullSafe(F.col("cut")), "left").withColumn("sha", F.coalesce("sha", "late"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return parsed.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")


def repaired_messages(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role and text of the repaired conversations, from the rows and what `repair` says of them."""
    key = dict(rows.dtypes)["conv_id"]
    stream = after_audits(rows, verdicts.select(F.col("conv_id").alias("cut"), "audit"))
    return stream.mapInArrow(spelt_out(arrow_type(key)), f"conv_id {key}, position long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the check wants; nulls read as one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    lot = F.crc32(name.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of conversations (conv_id, turn, role, text), null too.

    Nulls read as one space, but a null turn comes first and counts for no gap. Conversations that the
    damage leaves without rows have zeros, an empty audit and the hash of nothing. Repeated rows are
    duplicates. Other columns are not looked at; an empty table gives none.
    """
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "found")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _edit(state: str, letter: str, cost: str, condition: str = "") -> str:
    made = f"CASE WHEN {state} IS NOT NULL{' AND ' + condition if condition else ''} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"
    return made


def _sql() -> str:
    keep = {s: f"NOT gone AND initial = '{s}'" for s in "sua"}
    to_user = [_edit(s, letter, cost, cond) for s in ("s0", "s1", "s3") for letter, cost, cond in (("K", "late", keep["u"]), ("R", "late + 3", "NOT gone"))]
    to_assistant = [_edit("s2", letter, cost, cond) for letter, cost, cond in (("K", "late", keep["a"]), ("R", "late + 3", "NOT gone"))]
    x = {
        "x0": _edit("s0", "D", "4"), "x1": _least(_edit("s1", "D", "4"), _edit("s0", "K", "late", keep["s"])),
        "x2": _least(_edit("s2", "D", "4"), *to_user), "x3": _least(_edit("s3", "D", "4"), *to_assistant)}
    return rf"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 20 AS lot
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM lots WHERE lot <> 0
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS no_end
  FROM damaged
), numbered AS (
  SELECT *, row_number() OVER w AS i, lag(initial) OVER w AS last_initial
  FROM judged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)
), f AS (
  SELECT *, blank OR seen AS gone, CASE WHEN no_end AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS late FROM numbered
), step AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1,
         {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3
  FROM f
  UNION ALL
  SELECT conv_id, i, x0, x1, y2, {_least('x3', _edit('y2', 'I', '3'))} FROM (
    SELECT *, {_least('x2', _edit('x0', 'I', '3'), _edit('x1', 'I', '3'), _edit('x3', 'I', '3'))} AS y2 FROM (
      SELECT f.conv_id, f.i, {', '.join(f'{v} AS {k}' for k, v in x.items())}
      FROM step JOIN f ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.i = step.i + 1))
), best AS (
  SELECT conv_id, {_least('s0', 's3')} AS b FROM step QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), letters AS (
  SELECT conv_id, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS pos FROM best
), places AS (
  SELECT conv_id, letter, pos, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), told AS (
  SELECT p.conv_id, p.pos, p.letter, p.place, f.role, CASE WHEN p.letter = 'I' THEN '' ELSE f.text END AS text,
         max((p.place = 1 AND p.letter = 'K' AND f.initial = 's')::INT) OVER (PARTITION BY p.conv_id) AS system
  FROM places p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.letter <> 'I'
  WHERE p.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole
  FROM told GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND seen) AS duplicate,
         count_if(late > 0) AS truncated, count_if(i > 1 AND last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


SQL = _sql()

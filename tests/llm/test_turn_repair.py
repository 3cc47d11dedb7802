"""Repair of role sequences: the parser against all edits, the operator against a plain walk over each conversation."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from inkproof.llm import turn_repair
from inkproof.llm.turn_repair import BOTTOM, Frontier, damage_and_repair, damaged, repair, repaired_messages, whole

ROWS = "conv_id long, turn long, role string, text string, salt string, nth string, again string, is_row string, cut string, audit string, part string, lot string, time string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], ROWS)


def parsed(rows):
    f = Frontier(BOTTOM)
    for r in rows:
        f.read(*r)
    return whole(f.by_kind())


def cheapest(rows):
    """Every sequence of edits, by depth; rows: (initial, must go, truncated)."""
    best = []

    def go(i, roles, cost, audit, inserted):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best[:] = [min([*best, (cost, audit)])]
        if inserted < 2:
            for s in "ua":
                go(i, roles + s, cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if not gone:
                go(i + 1, roles + (initial or "-"), cost + 3 * cut, audit + "K", 0)
                for s in "ua":
                    go(i + 1, roles + s, cost + 3 + 3 * cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_parser_finds_the_cheapest_edits():
    r = random.Random(1)
    for _ in range(250):
        rows = [(r.choice(["s", "u", "a", "a", "u", "x", " ", ""]), r.random() < 0.25, r.random() < 0.3) for _ in range(r.randrange(5))]
        assert parsed(rows) == cheapest(rows), rows


def walked(rows):
    """(conv_id, ...) for the damaged rows of all conversations, by lists."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = groups[conv]
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        own += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, read, counts = set(), [], collections.Counter()
        for turn, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            read.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(read, read[1:]))
        turns = {x[0] for x in own if x[0] is not None}
        cost, audit = parsed(read)
        lines, at, pairs = [], iter(own), 0
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(at)
            if letter == "D":
                continue
            if letter != "K":
                role = ("user", "assistant")[pairs % 2]
            pairs += role[:1] in ("u", "a")
            lines.append((role, "" if letter == "I" else text))
        yield conv, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), lines


def made():
    r = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(r.randrange(1, 9)):
            text = r.choice(["thanks.", "Yes!", "no end", " ", "", "a\nb?  ", f"word {r.randrange(5)}.", None])
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 2]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), text))
    for turn in range(3000):  # as long as all others together and more
        rows.append((500, turn, ("user", "assistant")[turn % 2] if r.random() < 0.95 else "system", f"turn {turn % 700 if r.random() < 0.1 else turn}" + ("." if r.random() < 0.9 else "")))
    rows += [(501, 5, "user", "again.")] * 400 + [(502, t, "user", "same?") for t in range(300)] + [(None, t, "assistant", f"n{t}!") for t in range(6)] + [(None, None, None, None)]
    rows += [(503, 0, "user", "y" * 300_000), (503, 1, "assistant", "z" * 300_000 + "!"), (504, -3, "system", "s."), (504, -1, "user", "q?"), (504, 4, "assistant", "a.")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [32 << 20, 100])
def test_like_a_walk(spark, monkeypatch, held):
    monkeypatch.setattr(turn_repair, "HELD_CHARACTERS", held)
    rows = made()
    want = {conv: (*rest, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()) for conv, rest, lines in walked(rows)}
    got = damage_and_repair(table(spark, rows).repartition(5)).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    assert any(v[6] == "" for v in want.values()) and sum(len(v[6]) for v in want.values()) > 3000


def test_repaired_messages(spark):
    rows = made()
    df = damaged(table(spark, rows))
    got = collections.defaultdict(list)
    for r in repaired_messages(df, repair(df)).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((r.role, r.text))
        assert r.position == len(got[r.conv_id])
    assert got == {conv: lines for conv, _, lines in walked(rows) if lines}


def test_nothing(spark):
    assert damage_and_repair(table(spark, []).limit(0)).count() == 0

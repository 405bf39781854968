"""Conversation repair against a search over all edits, and the ways for long conversations against the short one."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpuskiln.llm import repair as P

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows, most=60):
    """(cost, audit, lines) by uniform-cost search over audits: no states, only what was written so far."""
    seen_text, kinds = set(), []
    for role, text in rows:
        solid = BLANK.findall(text)
        kinds.append("blank" if not solid else "repeat" if (role, text) in seen_text else "cut" if solid[-1] not in ".!?" else "fine")
        seen_text.add((role, text))
    queue = [(0, "", 0, ())]
    while queue:
        cost, audit, i, lines = heapq.heappop(queue)
        initials = "".join(r[:1] or "?" for r, _ in lines)
        if i == len(rows) and GRAMMAR.match(initials):
            return cost, audit, lines, kinds
        if not re.match(r"(s?(ua)*u?)?\Z", initials) or cost > most:
            continue
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, lines))
            if kinds[i] in ("fine", "cut"):
                cut = 3 * (kinds[i] == "cut")
                heapq.heappush(queue, (cost + cut, audit + "K", i + 1, (*lines, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 3 + cut, audit + "R", i + 1, (*lines, (new, text))))
        if audit[-3:] != "III":
            for new in ("user", "assistant"):
                heapq.heappush(queue, (cost + 3, audit + "I", i, (*lines, (new, ""))))
    raise AssertionError


def plain(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, lines, kinds = cheapest([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv, gaps, kinds.count("blank"), kinds.count("repeat"), kinds.count("cut"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(n, seed, longest=7):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        for k in range(rnd.randrange(1, longest)):
            turn = rnd.choice([k, k, k, k + 3, None])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hello.", "Yes?", "cut off", "", " \n", "No! ", f"Said {conv} {k}.", None])
            out.append((conv if conv else None, turn, role, text))
    return out


def read(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def rows_of(data):
    convs = {c: [] for c, *_ in data}
    for c, turn, role, text in data:
        convs[c].append((turn, " " if role is None else role, " " if text is None else text))
    return convs


@pytest.mark.parametrize("limits", [(2000, 1 << 20), (0, 1 << 20)])
def test_equals_search_over_all_edits(spark, limits, monkeypatch):
    data = conversations(90, 1)
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "FAN", 2)  # three levels of scans
    frame = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, key string").repartition(4)
    got = read(P.repair(frame, most_rows=limits[0], most_bytes=limits[1]))
    assert got == sorted((plain(c, rows) for c, rows in rows_of(data).items()), key=repr)


def test_long_conversations_equal_short_ones(spark, monkeypatch):
    rnd = random.Random(4)
    data = [(1, k, rnd.choice(["user", "assistant"]), rnd.choice(["A.", "cut", f"B{k}.", f"C{k}", ""])) for k in range(900)] + conversations(20, 7)[5:]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    short = read(P.repair(frame))
    monkeypatch.setattr(P, "FAN", 3)
    assert read(P.repair(frame, most_rows=40)) == short
    assert read(P.repair(frame, "rows", most_rows=40)) == read(P.repair(frame, "rows"))


def test_repaired_rows_are_what_was_hashed(spark):
    frame = spark.createDataFrame(conversations(30, 9)[3:], "conv_id long, turn long, role string, text string")
    lines = {}
    for conv, place, role, text in sorted((tuple(r) for r in P.repair(frame, "rows").collect()), key=lambda r: (str(r[0]), r[1])):
        assert place == len(lines.setdefault(conv, []))
        lines[conv].append((role, text))
    for row in P.repair(frame).collect():
        mine = lines.get(row["conv_id"], [])
        assert GRAMMAR.match("".join(r[:1] for r, _ in mine))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mine).encode()).hexdigest() == row["repaired_sha256"]


def test_damage_leaves_every_conversation(spark):
    data = [(i, 0, "user", "Only one.") for i in range(60)] + [(None, None, None, None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in P.repair(P.damaged(frame)).collect()}
    assert len(out) == 61
    nothing = hashlib.sha256(b"").hexdigest()
    for i in range(60):
        kind = zlib.crc32(f"{i}:0".encode()) % 20
        want = {0: ("", 0), 1: ("D", 4), 2: ("D", 4), 3: ("KDI", 7)}.get(kind, ("KI", 3))
        assert (out[i]["audit"], out[i]["cost"]) == want, (i, kind)
        assert kind != 0 or out[i]["repaired_sha256"] == nothing


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.repair(P.damaged(frame)).count() == 0

"""Operator 13: conversation structure repaired at least cost, by layers of cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Rows may be
kept (K, free), given the role that comes next (R, 3), deleted (D, 4; what is blank
or a repeat must go), and empty rows of the role that comes next may be put in
(I, 3); a cut-off row that stays adds 3.  The grammar has four states, so a set of
states is four bits.  ``layers`` keeps, for each cost 0, 1, 2, ... and each row, the
set of states from which the rest can be brought to an accepted end at that cost or
less; a layer follows from the ones 0, 3, 4, ... below it by table look-ups.  The first
layer that holds the start state gives the cost, and walking the sets from the front,
taking the ASCII-least letter that a set allows, gives the least audit.

Conversations of at most ``ROWS`` rows and ``BYTES`` of text are repaired in one sorted
pass.  Longer ones are cut into blocks of ``BLOCK`` rows: each block gives the least
costs between its states, a scan over blocks carries the costs of all that follows back
to each block, blocks are then walked from all four states at once, and a second scan
tells which walk is the right one.  Scans work on groups of ``FAN`` blocks, level by level, so
no task holds a conversation.  Equal rows are one row with a count before that.
Only the SHA-256 of the repaired text is sequential by its nature: the rows of a long
conversation stream through one task, which holds one batch of them.

Order and ties: rows go by turn (nulls first), then role, then the text's first 64
characters, then its MD5.  Null role or text is one space; a role of no or of another
initial has no place in the grammar; a null id is a conversation of
its own; an id without rows left has zeros, an empty audit and the hash of nothing.  An
empty table gives an empty result; extra columns are ignored; repeated rows are faults.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import in_batches, load, numbered, settle
from corpuskiln.llm.resampling import crc32_sql

#: Up to here a conversation is repaired as one piece.
ROWS, BYTES = 2000, 16 << 20
BLOCK, FAN = 128, 4096
REROLE, INSERT, DELETE, CUT = 3, 3, 4, 3
FINE, BLANK, REPEAT, CUT_OFF = 0, 1, 2, 3
START, SYSTEM, USER, ANSWER = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ANSWER)
#: The state after the role that comes next.
NEXT = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
ROLE = {USER: "user", ANSWER: "assistant"}
#: What bringing each state to an accepted end costs when no row is left.
ENDS = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40


def kept(state: int, initial: str) -> int:
    """The state after a kept row, 0 where the grammar has none."""
    if initial == "s":
        return SYSTEM if state == START else 0
    if initial == "u":
        return USER if state != USER else 0
    return ANSWER if initial == "a" and state == USER else 0


def _before(after: Callable[[int], int]) -> list[int]:
    return [sum(q for q in STATES if after(q) & bits) for bits in range(16)]


#: Set of states -> states from which one step leads into it.
_STEP = _before(NEXT.__getitem__)
_KEEP = {c: _before(lambda q, c=c: kept(q, c)) for c in "sua"}
_NEVER = [0] * 16

Row = tuple[str, bool]  # a row that may stay: its role's initial, whether it is cut off


def layers(rows: list[Row], ends: tuple[int, ...] = ENDS, wanted: int = START) -> list[list[int]]:
    """Sets of states by cost and row, up to the first cost whose set at row 0 holds all ``wanted`` states."""
    n, found = len(rows), []
    none = [0] * (n + 1)
    steps = [(_KEEP.get(c, _NEVER), CUT if cut else 0) for c, cut in rows]
    while not found or found[-1][0] & wanted != wanted:
        c = len(found)
        row = none.copy()
        row[n] = sum(q for q, e in zip(STATES, ends) if e <= c)
        found.append(row)
        below = lambda k: found[c - k] if c >= k else none  # noqa: E731, B023
        by3, by4 = below(INSERT), below(DELETE)
        for i in range(n - 1, -1, -1):
            keep, cut = steps[i]
            row[i] = keep[below(cut)[i + 1]] | _STEP[below(REROLE + cut)[i + 1]] | by4[i + 1] | _STEP[by3[i]]
    return found


def walk(rows: list[Row], found: list[list[int]], state: int) -> tuple[list[str], int]:
    """The ASCII-least letters of each row at least cost (insertions before it first), and the state after them."""
    c = next(k for k, row in enumerate(found) if row[0] & state)
    holds = lambda k, i, q: k >= 0 and found[k][i] & q
    out, letters, i = [], "", 0
    while i < len(rows):
        initial, cut = rows[i]
        extra = CUT if cut else 0
        if holds(c - DELETE, i + 1, state):
            letter, c = "D", c - DELETE
        elif holds(c - INSERT, i, NEXT[state]):
            letters, c, state = letters + "I", c - INSERT, NEXT[state]
            continue
        elif holds(c - extra, i + 1, kept(state, initial)):
            letter, c, state = "K", c - extra, kept(state, initial)
        else:
            letter, c, state = "R", c - REROLE - extra, NEXT[state]
        out.append(letters + letter)
        letters, i = "", i + 1
    return out, state


class Digest:
    """Reads a conversation's rows with their edits in order and keeps what is reported of it."""

    def __init__(self) -> None:
        self.n = self.illegal = self.cost = self.turns = 0
        self.faults = [0] * 4
        self.first = self.last = None
        self.initial, self.state, self.audit = None, START, []
        self.sha, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        return role, text

    def _step(self, text: str) -> tuple[str, str]:
        self.cost, self.state = self.cost + INSERT, NEXT[self.state]
        return self._line(ROLE[self.state], text)

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int, edit: str) -> list[tuple[str, str]]:
        """The repaired rows that this one and its equals become."""
        if not copies:
            return []
        initial = role[:1]
        self.illegal += copies - 1 + (self.n > 0 and self.initial + initial not in ("su", "ua", "au"))
        self.n, self.initial = self.n + copies, initial
        if turn is not None:
            self.turns += turn != self.last or self.first is None
            self.first, self.last = turn if self.first is None else self.first, turn
        self.faults[fault] += 1 if fault != BLANK else copies
        self.faults[REPEAT] += 0 if fault == BLANK else copies - 1
        out = []
        for letter in edit:
            if letter == "I":
                out.append(self._step(""))
            elif letter == "R":
                out.append(self._step(text))
            elif letter == "K":
                self.state = kept(self.state, initial)
                out.append(self._line(role, text))
            else:
                self.cost += DELETE
        self.cost += CUT if fault == CUT_OFF and edit[-1] != "D" else 0
        self.cost += DELETE * (copies - 1)
        self.audit += [edit, "D" * (copies - 1)]
        return out

    def end(self) -> list[tuple[str, str]]:
        out = []
        while self.state not in (START, ANSWER):
            self.audit.append("I")
            out.append(self._step(""))
        return out

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edits(rows: list[tuple[str, int]]) -> list[str]:
    """The letters of each row (initial, fault) of a whole conversation."""
    stay = [(c, fault == CUT_OFF) for c, fault in rows if fault in (FINE, CUT_OFF)]
    letters = iter(walk(stay, layers(stay), START)[0])
    return [next(letters) if fault in (FINE, CUT_OFF) else "D" for _, fault in rows]


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.md5("text")]


def prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, key, turn, role, text, copies, fault): rows as they are read; ``copies`` is 0 for a row that only says that
    the conversation exists.  Repeats are not known here yet."""
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), *([F.col("copies").cast("long")] if "copies" in turns.columns else [F.lit(1).cast("long").alias("copies")]))
    fault = F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), CUT_OFF).otherwise(FINE)
    return rows.withColumn("fault", fault.cast("long"))


def _streamed(rows: DataFrame, into: str) -> DataFrame:
    """The reports of conversations (``into`` = "report") or their repaired rows ("rows"), from rows by (key, order).
    Where ``edit`` isn't a column, whole conversations of bounded size are repaired on the way."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_REPORT}" if into == "report" else f"conv_id {kind}, place long, role string, text string"
    names = ["conv_id", "key", "turn", "role", "text", "copies", "fault"] + (["edit"] if "edit" in rows.columns else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, types, held = [], None, []  # held: rows of a conversation that isn't planned yet
        digest, current = None, None

        def feed(row: tuple, edit: str) -> None:
            lines = digest.add(*row, edit)
            if into == "rows":
                emit(lines)

        def emit(lines: list[tuple[str, str]]) -> None:
            out.extend((current[1], digest.lines - len(lines) + i, *line) for i, line in enumerate(lines))

        def close() -> None:
            if digest is None:
                return
            seen, faults = set(), []
            for turn, role, text, copies, fault in held:
                me = (role, hashlib.md5(text.encode()).digest())
                faults.append(REPEAT if copies and fault != BLANK and me in seen else fault if copies else BLANK)
                if copies:
                    seen.add(me)
            planned = edits([(r[1][:1], f) for r, f in zip(held, faults)]) if held else []
            for row, fault, edit in zip(held, faults, planned):
                feed((*row[:4], fault), edit)
            held.clear()
            lines = digest.end()
            if into == "rows":
                emit(lines)
            else:
                out.append((current[1], *digest.row()))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [types, *([pa.int64()] * 6), pa.string(), pa.string()] if into == "report" else [types, pa.int64(), pa.string(), pa.string()]
            titles = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=titles)

        for batch in batches:
            types = batch.column(0).type
            for conv, key, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if current is None or current[0] != key:
                    close()
                    digest, current = Digest(), (key, conv)
                if len(row) == 5:
                    held.append(tuple(row))
                else:
                    feed(tuple(row[:5]), row[5])
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return in_batches(rows.select(*names), run, schema)


def _product(ms: list[list[int]]) -> list[int]:
    """Least costs from state to state (4 x 4) through several stretches."""
    out = [0 if i % 5 == 0 else _FAR for i in range(16)]
    for m in ms:
        out = [min(out[4 * a + k] + m[4 * k + b] for k in range(4)) for a in range(4) for b in range(4)]
    return [min(x, _FAR) for x in out]


def through(rows: list[Row]) -> list[int]:
    """Least costs from state to state through some rows."""
    out = []
    for end in range(4):
        after = [0 if k == end else _FAR for k in range(4)]
        for initial, cut in reversed(rows):
            extra = CUT if cut else 0
            cost = lambda q: after[STATES.index(q)] if q else _FAR  # noqa: E731, B023
            now = [min(DELETE + cost(q), extra + cost(kept(q, initial)), REROLE + extra + cost(NEXT[q])) for q in STATES]
            for _ in range(3):  # insertions before the row
                now = [min(x, INSERT + now[STATES.index(NEXT[q])]) for q, x in zip(STATES, now)]
            after = now
        out.append(after)
    return [min(out[b][a], _FAR) for a in range(4) for b in range(4)]


def scan(blocks: DataFrame, product: Callable, step: Callable, start: list[int], backwards: bool) -> DataFrame:
    """(key, block, state): what reaches each block of its conversation when the blocks' ``value`` act one after the
    other on ``start``.  Groups of ``FAN`` blocks act as one on a level above, as long as a conversation has more."""
    most = blocks.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    if most <= FAN:
        rows, by = blocks.withColumn("outer", F.array(*map(F.lit, start)).cast("array<long>")), ["key"]
    else:
        rows, by = blocks.withColumn("group", F.floor(F.col("block") / FAN).cast("long")), ["key", "group"]

        def up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            values = [list(v) for v in pdf.sort_values("block")["value"]]
            return pd.DataFrame({"key": [key[0]], "block": [key[1]], "value": [product(values)]})

        above = settle(rows.groupBy(*by).applyInPandas(up, "key string, block long, value array<long>"), "levels")
        outer = scan(above, product, step, start, backwards).select("key", F.col("block").alias("group"), F.col("state").alias("outer"))
        rows = rows.join(outer, ["key", "group"])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backwards, ignore_index=True)
        state, out = list(pdf["outer"].iloc[0]), []
        for value in pdf["value"]:
            out.append(state)
            state = step(list(value), state)
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "state": out})

    return settle(rows.groupBy(*by).applyInPandas(down, "key string, block long, state array<long>"), "scanned")


def _stay(pdf: pd.DataFrame) -> tuple[list[int], list[Row]]:
    pdf = pdf[pdf["fault"].isin((FINE, CUT_OFF))].sort_values("at")
    return pdf["at"].tolist(), [(c, f == CUT_OFF) for c, f in zip(pdf["initial"], pdf["fault"])]


def long_edits(rows: DataFrame) -> DataFrame:
    """(at, edit) of the rows that may stay in long conversations; rows are (key, at, initial, fault)."""
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))

    def costs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "block": [key[1]], "value": [through(_stay(pdf)[1])]})

    def walks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ats, stay = _stay(pdf)
        ends = list(pdf["state"].iloc[0])
        found = layers(stay, tuple(e - min(ends) for e in ends), sum(STATES))
        ways = [walk(stay, found, q) for q in STATES]
        return pd.DataFrame({"key": [key[0]], "block": [key[1]], "ats": [ats], "ways": [[w for w, _ in ways]], "value": [[STATES.index(q) for _, q in ways]]})

    value = settle(rows.groupBy("key", "block").applyInPandas(costs, "key string, block long, value array<long>"), "costs")
    after = scan(value, _product, lambda m, ends: [min(m[4 * a + b] + ends[b] for b in range(4)) for a in range(4)], list(ENDS), True)
    walked = settle(rows.join(after, ["key", "block"]).groupBy("key", "block").applyInPandas(walks, "key string, block long, ats array<long>, ways array<array<string>>, value array<long>"), "walks")
    chain = lambda ms: [_follow(ms, a) for a in range(4)]
    entry = scan(walked.select("key", "block", "value"), chain, lambda m, s: [m[s[0]]], [0], False)
    picked = walked.join(entry, ["key", "block"]).select(F.explode(F.arrays_zip("ats", F.element_at("ways", (F.col("state")[0] + 1).cast("int")).alias("edit"))).alias("x"))
    return picked.select(F.col("x.ats").alias("at"), F.col("x.edit").alias("edit"))


def _follow(maps: list[list[int]], at: int) -> int:
    for m in maps:
        at = m[at]
    return at


def repair(turns: DataFrame, into: str = "report", most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Per conversation its gaps, faults, cost, audit and hash ("report"), or the repaired rows with their places ("rows")."""
    rows = prepared(turns)
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = settle(size.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("key"), "long")
    any_long = not long.isEmpty()
    short = rows.join(long, "key", "left_anti") if any_long else rows
    sort = [F.col("key"), *order()]
    out = _streamed(short.repartition("key").sortWithinPartitions(*sort), into)
    if not any_long:
        return out
    equal = ["key", "conv_id", "turn", "role", "text", "fault"]
    once = rows.join(long, "key", "left_semi").groupBy(*equal).agg(F.sum("copies").alias("copies"))
    placed = settle(numbered(once.withColumn("name", F.md5("text")), [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("name")], "at"), "placed")
    first = placed.filter("copies > 0").groupBy("key", "role", "name").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("copies") == 0) | (F.col("fault") == BLANK), BLANK).when(F.col("first").isNull(), REPEAT).otherwise(F.col("fault"))
    known = placed.drop("name").join(first, "at", "left").withColumn("fault", fault.cast("long")).drop("first")
    known = settle(known, "known", after=(placed,))
    edit = long_edits(known.select("key", "at", F.substring("role", 1, 1).alias("initial"), "fault"))
    told = known.join(edit, "at", "left").withColumn("edit", F.coalesce("edit", F.when(F.col("copies") > 0, "D").otherwise("")))
    # equal blank rows all go, and are told apart from the copies of a row that stays by their fault
    return out.unionByName(_streamed(told.repartition("key").sortWithinPartitions("key", "at"), into))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults that their crc32 decides: gone, emptied, without marks, twice, or the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    gone = F.col("kind") == 0
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(load(spark, sf_dir, "conversations")))


def _moves_sql() -> str:
    """Every way from a state over one row: up to two insertions, then a letter; what it needs, what it leaves."""
    rows, ends = [], []
    for at, q in enumerate(STATES):
        pre, state = [], q
        for k in range(3):
            quote = "[" + ", ".join(f"'{x}:'" for x in pre) + "]::VARCHAR[]"
            head = f"{at}, '{'I' * k}', {quote}, {INSERT * k}"
            rows += [f"({head}, '{c}', 'K', NULL, 0, {CUT}, {STATES.index(kept(state, c))})" for c in "sua" if kept(state, c)]
            rows.append(f"({head}, NULL, 'R', '{ROLE[NEXT[state]]}', {REROLE}, {CUT}, {STATES.index(NEXT[state])})")
            rows.append(f"({head}, NULL, 'D', NULL, {DELETE}, 0, {STATES.index(state)})")
            if state in (START, ANSWER):
                ends.append(f"({at}, '{'I' * k}', {quote}, {INSERT * k})")
            state = NEXT[state]
            pre = [*pre, ROLE[state]]
    return f"moves(q, ins, pre, ins_cost, need, letter, new_role, cost, cut, q2) AS (VALUES {', '.join(rows)}), ends(q, ins, pre, ins_cost) AS (VALUES {', '.join(ends)})"


OP13_SQL = f"""
WITH RECURSIVE
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
kinds AS (SELECT id, {crc32_sql("id")} % 20 AS kind FROM (SELECT DISTINCT id FROM raw)),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw JOIN kinds USING (id), (VALUES (1), (2)) v(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
seq AS (
  SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i FROM dam),
nths AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM seq),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM nths),
{_moves_sql()},
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT p.conv_id, p.i + 1, m.q2, min({{'c': p.best.c + m.ins_cost + m.cost + CASE WHEN f.fault = 3 THEN m.cut ELSE 0 END, 'a': p.best.a || m.ins || m.letter,
         'l': list_concat(p.best.l, m.pre, CASE WHEN m.letter = 'D' THEN [] ELSE [coalesce(m.new_role, f.role) || ':' || f.text] END)}})
  FROM path p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN moves m ON m.q = p.q AND (m.need IS NULL OR m.need = f.c) AND (f.fault NOT IN (1, 2) OR m.letter = 'D')
  GROUP BY p.conv_id, p.i, m.q2),
done AS (
  SELECT p.conv_id, min({{'c': p.best.c + e.ins_cost, 'a': p.best.a || e.ins, 'l': list_concat(p.best.l, e.pre)}}) AS best
  FROM path p JOIN ends e USING (q) JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY 1) s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.i GROUP BY p.conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

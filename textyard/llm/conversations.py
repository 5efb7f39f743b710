"""Repair of conversation structure: cheapest edits to turns, by block tables over the rows of a conversation.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Its rows are symbols (role, fault); the cost of
repairing the rest from each state of that pattern is a vector of four numbers, of which only differences matter, and
few different ones exist. Tables hold what every vector becomes through every block of ``BLOCK`` symbols, so rows are
passed from the last to the first a block at a time; then each block is expanded backward, row by row, from the vector
behind it, and the edits are read off forward, the least letter first, which keeps ties exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textyard.llm.common import stored

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
# roles: s, u, a, other; states: nothing yet, after s, after u, after a
_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_WANTED = (2, 2, 3, 2)  # the state after an inserted or re-roled row
_NAME = {2: "user", 3: "assistant"}
_END = (0, 10, 5, 0)
GONE = 8  # the symbol of rows that must go; others are role + 4 if truncated
SYMBOLS = 9
OK, CUT, SEEN, BLANK = range(4)
OUT_ROWS = 20_000


def symbol(fault: int, role: int) -> int:
    return GONE if fault >= SEEN else role + 4 * fault


def options(after: tuple, sign: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost to the end, state behind the row) of a row in a state, without insertions."""
    out = [("D", DELETE + after[state], state)]
    if sign != GONE:
        role, extra = sign % 4, TRUNCATED * (sign // 4)
        if state in _KEPT[role]:
            out.append(("K", KEEP + extra + after[_KEPT[role][state]], _KEPT[role][state]))
        out.append(("R", REROLE + extra + after[_WANTED[state]], _WANTED[state]))
    return out


def before(after: tuple, sign: int) -> tuple:
    """Costs ahead of a row from the costs behind it; at most two insertions pay."""
    plain = [min(c for _, c, _ in options(after, sign, q)) for q in range(4)]
    one = [_WANTED[q] for q in range(4)]
    return tuple(min(plain[q], INSERT + plain[one[q]], 2 * INSERT + plain[one[one[q]]]) for q in range(4))


class Tables:
    """Every normalised cost vector, and what blocks of 1 and of ``BLOCK`` symbols make of it."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, number = block, [_END], {_END: 0}
        step, gain = [], []
        for vector in self.vectors:  # grows while it is read
            row, more = [], []
            for sign in range(SYMBOLS):
                raw = before(vector, sign)
                least = min(raw)
                new = tuple(c - least for c in raw)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append(number[new])
                more.append(least)
            step.append(row)
            gain.append(more)
        self.step, self.gain = np.array(step), np.array(gain)
        n = len(self.vectors)
        far, cost = np.arange(n)[:, None], np.zeros((n, 1), dtype=np.int64)
        for _ in range(block):  # one more symbol in front
            cost = (cost[:, :, None] + self.gain[far]).transpose(0, 2, 1).reshape(n, -1)
            far = self.step[far].transpose(0, 2, 1).reshape(n, -1)
        self.far, self.cost = far.tolist(), cost.tolist()
        self.one, self.one_cost = self.step.tolist(), self.gain.tolist()
        self.edits: dict[tuple[int, int, int], tuple[str, int, tuple]] = {}

    def edit(self, after: int, sign: int, state: int) -> tuple[str, int, tuple]:
        """Letters up to and with a row's own edit, the state behind it, and the roles written ('' keeps its own)."""
        key = (after, sign, state)
        if key not in self.edits:
            behind = self.vectors[after]
            ahead = before(behind, sign)
            letters, roles = "", []
            while True:
                found = [(e, q) for e, c, q in options(behind, sign, state) if c == ahead[state]]
                if found and found[0][0] == "D":
                    letters, state = letters + "D", found[0][1]
                    break
                if ahead[state] == INSERT + ahead[_WANTED[state]]:
                    state = _WANTED[state]
                    letters += "I"
                    roles.append(_NAME[state])
                    continue
                letters, state = letters + found[0][0], found[0][1]
                roles.append("" if found[0][0] == "K" else _NAME[state])
                break
            self.edits[key] = letters, state, tuple(roles)
        return self.edits[key]

    def repair(self, signs: bytes) -> tuple[int, Iterator[tuple[int, str, tuple]]]:
        """The least cost and, row by row, (row, letters, roles written); the last entry is behind all rows."""
        size, head = self.block, len(signs) % self.block
        vector, cost, ends = 0, 0, []
        for at in range(len(signs) - size, head - 1, -size):
            code = 0
            for s in signs[at : at + size]:
                code = code * SYMBOLS + s
            ends.append(vector)
            cost += self.cost[vector][code]
            vector = self.far[vector][code]
        ends.append(vector)
        for s in reversed(signs[:head]):
            cost += self.one_cost[vector][s]
            vector = self.one[vector][s]
        # normalised: what the start state costs above the least state
        return cost + self.vectors[vector][0], self._trace(signs, head, ends)

    def _trace(self, signs: bytes, head: int, ends: list[int]) -> Iterator[tuple[int, str, tuple]]:
        state, blocks = 0, [(0, head), *((at, at + self.block) for at in range(head, len(signs), self.block))]
        for begin, end in blocks:
            vector, after = ends.pop(), []
            for s in reversed(signs[begin:end]):
                after.append(vector)
                vector = self.one[vector][s]
            for at in range(begin, end):
                letters, state, roles = self.edit(after.pop(), signs[at], state)
                yield at, letters, roles
        letters, roles = "", []
        while state in (1, 2):
            state = _WANTED[state]
            letters += "I"
            roles.append(_NAME[state])
        yield len(signs), letters, tuple(roles)


@cache
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame) -> DataFrame:
    """conv (id as text), turn, role, text, copies of the rows that the damage leaves, and a key of role and text."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    given = rows.select(
        conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(F.concat_ws(":", conv, turn).cast("binary")) % 20).alias("_kind"),
    ).where("_kind <> 0")
    kind = F.col("_kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    hurt = given.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))
    return hurt.withColumn("key", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))))


def ordered(hurt: DataFrame) -> DataFrame:
    """One row per run of equal rows: conv, place (from 1), turn, role, key, n and code (fault and initial of the role).

    Rows of one turn stand by role, then by the MD5 of role and text, so equal rows are neighbours and pass the
    shuffles as one row with a count. Texts are left behind here.
    """
    tail = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    flaw = F.when(tail == "", BLANK).when(tail.isin(*STOPS), OK).otherwise(CUT)
    runs = hurt.groupBy("conv", "turn", "role", "key", flaw.alias("flaw")).agg(F.sum("copies").alias("n"))
    runs = stored(runs)
    again = runs.groupBy("conv", "key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    marked = runs.join(again.drop("times"), ["conv", "key"], "left")
    seen = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("flaw") == BLANK, BLANK).when(seen, SEEN).otherwise(F.col("flaw"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    place = F.row_number().over(W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "key")).cast("bigint")
    return marked.select("conv", "turn", "role", "key", "n", (fault * 4 + role).cast("int").alias("code"), place.alias("place"))


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by conversation and place -> a summary of each conversation (place 0) and the rows it ends up with."""
    out = _Rows()
    conv, state = None, None
    for batch in batches:
        for name, turn, n, code in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state is None or name != conv:
                if state is not None:
                    yield from state.finish(conv, out)
                conv, state = name, _Conversation()
            state.add(turn, n, code)
    if state is not None:
        yield from state.finish(conv, out)
    yield from out.flush()


class _Rows:
    """Output rows gathered to batches."""

    SCHEMA = pa.schema([
        ("conv", pa.string()), ("place", pa.int64()), ("part", pa.int32()), ("role_out", pa.string()), ("audit", pa.string()),
        ("cost", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()),
    ])
    SQL = "conv string, place bigint, part int, role_out string, audit string, cost bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"

    def __init__(self):
        self.rows: list[tuple] = []

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*self.rows), self.SCHEMA)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=self.SCHEMA)


class _Conversation:
    """Figures of one conversation and a byte per run of rows; longer runs are counted aside."""

    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self):
        self.codes, self.more = bytearray(), {}
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0] * 4

    def add(self, turn: int | None, n: int, code: int) -> None:
        if turn is not None:
            if turn != self.turn or not self.turns:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.codes and (self.codes[-1] % 4, code % 4) not in self.LEGAL:
            self.illegal += 1
        fault = code // 4
        self.illegal += n - 1
        self.faults[fault] += 1
        self.faults[max(fault, SEEN)] += n - 1
        if n > 1:
            self.more[len(self.codes)] = n - 1
        self.codes.append(code)

    def finish(self, conv: str, out: _Rows) -> Iterator[pa.RecordBatch]:
        signs = bytes(symbol(c // 4, c % 4) for c in self.codes)
        cost, edits = tables().repair(signs)
        audit = []
        for at, letters, roles in edits:
            audit.append(letters + "D" * self.more.get(at, 0))
            own = letters[-1:] in ("K", "R")
            for i, role in enumerate(roles):
                mine = own and i == len(roles) - 1
                out.rows.append((conv, at + 1, -1 if mine else i, role, *[None] * 7))
            if len(out.rows) >= OUT_ROWS:
                yield from out.flush()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost += DELETE * sum(self.more.values())
        out.rows.append((conv, 0, 0, None, "".join(audit), cost, gaps, self.faults[BLANK], self.faults[SEEN], self.faults[CUT], self.illegal))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, line) in order -> the SHA-256 of each conversation's lines, read as a stream."""
    conv, state, done = None, None, []
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is None or name != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        if len(done) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "sha"])
            done = []
    if state is not None:
        done.append((conv, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "sha"])


def _mended(hurt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of the conversations and (conv, place, part, line) of their repaired rows."""
    runs = stored(ordered(hurt))
    dealt = runs.select("conv", "turn", "n", "code", "place").repartition("conv").sortWithinPartitions("conv", "place")
    found = stored(dealt.mapInArrow(_mend, _Rows.SQL))
    written = found.where("place > 0").select("conv", "place", "part", "role_out")
    new = written.where("part >= 0").select("conv", "place", "part", F.concat("role_out", F.lit(":")).alias("line"))
    own = written.where("part < 0").join(runs.select("conv", "place", "turn", "role", "key"), ["conv", "place"])
    # one text per kept run: repeats meet in the partial aggregate of their task
    same = F.struct(F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn"), "key").alias("same")
    texts = hurt.select("conv", same, "text").dropDuplicates(["conv", "same"])
    lines = own.select("conv", "place", "role", "role_out", same).join(texts, ["conv", "same"])
    role = F.when(F.col("role_out") == "", F.col("role")).otherwise(F.col("role_out"))
    # a row's own line stands behind the lines inserted ahead of it
    own = lines.select("conv", "place", F.lit(2**30).alias("part"), F.concat(role, F.lit(":"), "text").alias("line"))
    return found.where("place = 0"), own.unionByName(new)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv (id as text), turn (from 0) and line (``role:text``) of the damaged and repaired conversations."""
    _, lines = _mended(damaged(rows))
    order = W.partitionBy("conv").orderBy("place", "part")
    return lines.select("conv", (F.row_number().over(order) - 1).cast("bigint").alias("turn"), "line")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles, texts and, in the damage's key, ids and turns count as one space; rows without a conv_id are one conversation
    with a null id. Rows of one turn stand by role, then by the MD5 of role and text. A role of no characters, or one that
    begins with none of s, u, a, fits nowhere. A conversation without rows has zeros, an empty audit and the hash of an
    empty string; an empty table gives an empty result. Columns besides the four are not read.

    A conversation is never gathered: equal rows travel as one with a count, texts stay out of the repair, which holds a
    byte a row (its audit has as many), and the hash, which the order of a conversation's lines makes sequential, reads
    them as a stream from a sort that can spill.
    """
    space = F.lit(" ")
    hurt = damaged(rows)
    every = rows.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), "conv_id").distinct()
    found, lines = _mended(hurt)
    dealt = lines.repartition("conv").sortWithinPartitions("conv", "place", "part").select("conv", "line")
    sums = dealt.mapInArrow(_digest, "conv string, sha string")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = every.join(found.select("conv", *figures, "audit"), "conv", "left").join(sums, "conv", "left")
    nothing = hashlib.sha256().hexdigest()
    return whole.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"),
    )


def repair_sql() -> str:
    """The same in DuckDB SQL, on ``conversations``: the costs by recursion over rows, the edits by another."""
    bits = "list_reduce(list_concat([xor(c, b) & 255], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda h: ascii(h)::BIGINT)), lambda c, b: xor(c >> 8, {bits})), 4294967295)"
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def plain(q: int) -> str:
        kept = [f"WHEN ini = '{'sua'[r]}' THEN w{_KEPT[r][q]} + 5 * cut" for r in range(3) if q in _KEPT[r]]
        keep = f"CASE {' '.join(kept)} ELSE 1000000000 END" if kept else "1000000000"
        return f"least(w{q} + 2, CASE WHEN gone THEN 1000000000 ELSE least({keep}, w{_WANTED[q]} + 1 + 5 * cut) END)"

    one = [_WANTED[q] for q in range(4)]
    closed = ", ".join(f"least(p{q}, 5 + p{one[q]}, 10 + p{one[one[q]]}) AS v{q}" for q in range(4))
    pick = lambda name, state: f"CASE {state} WHEN 0 THEN {name}0 WHEN 1 THEN {name}1 WHEN 2 THEN {name}2 ELSE {name}3 END"
    kept_to = "CASE WHEN ini = 's' AND q = 0 THEN 1 WHEN ini = 'u' AND q <> 2 THEN 2 WHEN ini = 'a' AND q = 2 THEN 3 ELSE -1 END"
    return f"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    c AS (SELECT *, ({crc}) % 20 AS kind FROM k),
    d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i,
             rtrim(text, {spaces}) AS body, substr(role, 1, 1) AS ini FROM d),
    s AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS dup FROM o),
    f AS (SELECT *, blank OR dup AS gone, CASE WHEN NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
             lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS pair, i > 1 AS later FROM s),
    n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated,
             count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
    dp AS (SELECT conv, n + 1 AS i, 0::BIGINT AS v0, 10::BIGINT AS v1, 5::BIGINT AS v2, 0::BIGINT AS v3 FROM n
           UNION ALL
           SELECT conv, i, {closed} FROM (
             SELECT conv, i, ini, {', '.join(f'{plain(q)} AS p{q}' for q in range(4))} FROM (
               SELECT f.conv, f.i, ini, gone, cut, v0 AS w0, v1 AS w1, v2 AS w2, v3 AS w3 FROM dp JOIN f ON f.conv = dp.conv AND f.i = dp.i - 1))),
    steps AS (SELECT a.conv, a.i, a.v0, a.v1, a.v2, a.v3, b.v0 AS w0, b.v1 AS w1, b.v2 AS w2, b.v3 AS w3, f.ini, f.gone, f.cut, f.role, f.text
              FROM dp a LEFT JOIN dp b ON b.conv = a.conv AND b.i = a.i + 1 LEFT JOIN f ON f.conv = a.conv AND f.i = a.i),
    walk AS (SELECT conv, 1::BIGINT AS i, 0 AS q, '' AS audit, NULL::VARCHAR AS said FROM n
             UNION ALL
             SELECT conv, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kq ELSE nq END, audit || e,
               CASE WHEN e = 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN new || ':' || text ELSE new || ':' END END
             FROM (SELECT *, CASE WHEN last THEN 'I' WHEN w + 2 = v THEN 'D' WHEN v = vn + 5 THEN 'I' WHEN NOT gone AND kq >= 0 AND v = wk + 5 * cut THEN 'K' ELSE 'R' END AS e,
                     CASE WHEN nq = 2 THEN 'user' ELSE 'assistant' END AS new FROM (
               SELECT *, {pick('v', 'nq')} AS vn, {pick('w', 'kq')} AS wk FROM (
                 SELECT steps.*, walk.q, walk.audit, walk.said, steps.ini IS NULL AS last, {pick('v', 'q')} AS v, {pick('w', 'q')} AS w,
                        CASE q WHEN 2 THEN 3 ELSE 2 END AS nq, {kept_to} AS kq
                 FROM walk JOIN steps ON steps.conv = walk.conv AND steps.i = walk.i)) WHERE NOT last OR v > 0)),
    done AS (SELECT w.conv, w.audit, w.said FROM walk w JOIN n ON n.conv = w.conv AND w.i = n.n + 1 WHERE w.q IN (0, 3)),
    start AS (SELECT conv, v0 AS cost FROM dp WHERE i = 1),
    ids AS (SELECT DISTINCT conv_id, conv FROM k)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM ids LEFT JOIN n USING (conv) LEFT JOIN start USING (conv) LEFT JOIN done USING (conv)
    """

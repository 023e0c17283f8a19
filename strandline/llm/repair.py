"""Conversation structure repair (operator 13): forward Viterbi over four grammar states, per grouped conversation.

A conversation is to read as an optional system turn and then one or more pairs of user and assistant, or as nothing.
The states are: nothing yet, after the system turn, after a user, after an assistant. Each state carries the cheapest
way to it as (cost, audit string of edits), ties to the ASCII-least string; a row keeps its role, gets another or goes,
and each row's layer is closed by insertions, of which two in a row reach every state there is. Of equal cost, no string
of one layer begins another, so that comparing beginnings compares whole audits.

Spark flags repeated rows (role and text seen earlier in the conversation) by grouped minima, deals conversations to
tasks and sorts them by turn. A task streams its rows through one decoder: what all surviving strings begin with is
final, goes into the digest of the repaired text and is forgotten, and a state that can no longer win is dropped, so a
task holds the rows since the survivors last agreed and no conversation as a whole, but for its audit string.

Defined results: a null turn, role or text stands for one space, and null turns come first; repeated turns of one number
are ordered by role and text. A null conv_id is one conversation, and comes out with a null id. A role counts by its
first letter; an empty role has none, and fits nowhere. A conversation all of whose rows were dropped has zeros, an
empty audit and the digest of an empty string. An empty table gives no rows. Very long texts and conversations are
handled in whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, counted

#: Damage by crc32('conv_id:turn') % 20. Fixed values.
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
STATES = "-sua"  # nothing yet, after system, after user, after assistant
#: What may follow a state, and what may be inserted or written there instead.
NEXT = {"-": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
#: A way whose cost exceeds the best by more can't win: two insertions and a deletion make up for any state.
MARGIN = 2 * COST[INSERT] + COST[DELETE]
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


class Decoder:
    """The forward pass of one conversation. ``emit`` takes each edit that has become final, in order."""

    def __init__(self, emit):
        self.emit = emit
        self.ways: dict[str, tuple[int, str]] = {"-": (0, "")}  # audits since the last common beginning
        self._close()

    def _close(self) -> None:
        for state in ("-", "s", "u", "a", "u"):  # insertions from states as they are reached
            if state in self.ways:
                cost, audit = self.ways[state]
                for role in NEXT[state]:
                    if role in ROLES:
                        self._offer(self.ways, role, cost + COST[INSERT], audit + INSERT)

    @staticmethod
    def _offer(ways: dict, state: str, cost: int, audit: str) -> None:
        if state not in ways or (cost, audit) < ways[state]:
            ways[state] = cost, audit

    def step(self, role: str, must_go: bool, truncated: bool) -> None:
        ways: dict[str, tuple[int, str]] = {}
        initial = role[:1]
        for state, (cost, audit) in self.ways.items():
            self._offer(ways, state, cost + COST[DELETE], audit + DELETE)
            if must_go:
                continue
            if initial and initial in NEXT[state]:
                self._offer(ways, initial, cost + COST[KEEP] + truncated, audit + KEEP)
            for new in NEXT[state]:
                if new in ROLES:
                    self._offer(ways, new, cost + COST[REROLE] + truncated, audit + REROLE)
        self.ways = ways
        self._close()
        least = min(cost for cost, _ in self.ways.values())
        self.ways = {s: w for s, w in self.ways.items() if w[0] <= least + MARGIN}
        self._settle()

    def _settle(self) -> None:
        common = os.path.commonprefix([audit for _, audit in self.ways.values()])
        if common:
            self.emit(common)
            self.ways = {s: (cost, audit[len(common) :]) for s, (cost, audit) in self.ways.items()}

    def finish(self) -> int:
        """The cost of the cheapest repair; its last edits are emitted."""
        cost, audit = min(self.ways[s] for s in ENDS if s in self.ways)
        self.emit(audit)
        return cost


class Conversation:
    """Counts, faults, edits and the digest of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.pending, self.audit, self.role = conv_id, [], [], None
        self.least = self.most = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.digest, self.empty, self.state, self.decoder = hashlib.sha256(), True, "-", None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        body = text.rstrip(BLANKS)
        blank, cut = not body, False
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif body[-1] not in ".!?":
            self.truncated += 1
            cut = True
        self.pending.append((role, text))
        self.decoder = self.decoder or Decoder(self._final)
        self.decoder.step(role, blank or repeated, cut)

    def _final(self, edits: str) -> None:
        """Edits in order, for the rows that wait: the role of an edit follows from the state before it."""
        self.audit.append(edits)
        at = 0
        for edit in edits:
            role, text = (None, "") if edit == INSERT else self.pending[at]
            at += edit != INSERT
            if edit == DELETE:
                continue
            if edit != KEEP:
                role = ROLES["a" if self.state == "u" else "u"]
            self.state = role[:1]
            self.digest.update(b"" if self.empty else b"\n")
            self.digest.update(f"{role}:{text}".encode())
            self.empty = False
        del self.pending[:at]

    def close(self) -> dict:
        cost = self.decoder.finish() if self.decoder else 0
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SCHEMA.split(", ")])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows after the damage; a dropped row stays, marked as not present."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.withColumn("role", F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("kind").isin(DROP, EMPTY), "").when(F.col("kind") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != DROP).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def mark_repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``repeated``: role and text occur in an earlier row of the conversation.

    Groups are narrow and pre-aggregated: of equal rows the first is a grouped minimum, and only groups of several rows
    meet their rows again, in joins of written tables.
    """
    rows = scratch.settle(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    narrow = rows.where("present").select("conv_id", "turn", "uid", F.xxhash64(F.lit(1), "role", "text").alias("d1"), F.xxhash64(F.lit(2), "text", "role").alias("d2"))
    # nulls first: a struct with a null field is the smaller one
    firsts = narrow.groupBy("conv_id", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("turn", "uid"))["uid"].alias("first")).where("n > 1").drop("n")
    firsts = scratch.settle(firsts.select(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first"), "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    later = scratch.settle(narrow.join(counted(firsts), same).where("uid <> first").select(F.col("uid").alias("later")), "later")
    return rows.join(counted(later), rows["uid"] == later["later"], "left").withColumn("repeated", F.col("later").isNotNull()).drop("later")


def repair_rows(rows: DataFrame) -> DataFrame:
    """The report of each conversation in ``rows`` (conv_id, turn, role, text, present, repeated, uid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv_id:
                    if now is not None:
                        done.append(now.close())
                    now = Conversation(r["conv_id"])
                if r["present"]:
                    now.add(r["turn"], r["role"], r["text"], r["repeated"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.close()], schema=_ARROW)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "uid"]
    lean = rows.select("conv_id", "turn", "role", "text", "uid", "present", "repeated")
    return lean.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, find faults and repair every conversation: one row for each conv_id."""
    scratch = Scratch(conversations.sparkSession, "repair")
    result = scratch.settle(repair_rows(mark_repeats(damage(conversations), scratch)), "report")
    scratch.keep(result)
    return result


# ------------------------------------------------------------------ SQL


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL; needs the table ``crc_table`` of ``CRC_TABLE``."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


#: One row: the 256 remainders of the reflected polynomial.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)))"


def _oracle() -> str:
    """Rows are numbered and stepped by recursion; a state is a struct (c: cost, a: audit, r: repaired text)."""
    far = 1_000_000_000

    def way(source: str, cost: str, edit: str, line: str | None) -> str:
        repaired = f"{source}.r" if line is None else f"CASE WHEN {source}.r IS NULL THEN {line} ELSE {source}.r || chr(10) || {line} END"
        return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{edit}', 'r': {repaired}}}"

    def closed(before: dict[str, str]) -> tuple[str, str]:
        """Two rounds of insertions, as nested selects: column lists of the first and of the second."""
        def layer(names: dict[str, str]) -> str:
            to_u = [way(names[x], "2", "I", "'user:'") for x in "-sa"]
            to_a = [way(names["u"], "2", "I", "'assistant:'")]
            return f"{names['-']} AS w0, {names['s']} AS w1, list_min([{', '.join([names['u'], *to_u])}]) AS w2, list_min([{', '.join([names['a'], *to_a])}]) AS w3"
        w = {"-": "w0", "s": "w1", "u": "w2", "a": "w3"}
        return layer(before), layer(w)

    never = f"{{'c': {far}, 'a': '', 'r': NULL::VARCHAR}}"
    s = {"-": "w0", "s": "w1", "u": "w2", "a": "w3"}
    gone = {k: way(v, "3", "D", None) for k, v in s.items()}
    keep = lambda x: way(x, "(CASE WHEN cut THEN 1 ELSE 0 END)", "K", "role || ':' || text")
    role = lambda x, r: way(x, "(CASE WHEN cut THEN 3 ELSE 2 END)", "R", f"'{r}:' || text")
    ok = lambda letter, ways: [f"CASE WHEN must OR left(role, 1) <> '{letter}' THEN {never} ELSE {x} END" for x in ways]
    may = lambda ways: [f"CASE WHEN must THEN {never} ELSE {x} END" for x in ways]
    new = {
        "-": gone["-"],
        "s": f"list_min([{', '.join([gone['s'], *ok('s', [keep(s['-'])])])}])",
        "u": f"list_min([{', '.join([gone['u'], *ok('u', [keep(s[x]) for x in '-sa']), *may([role(s[x], 'user') for x in '-sa'])])}])",
        "a": f"list_min([{', '.join([gone['a'], *ok('a', [keep(s['u'])]), *may([role(s['u'], 'assistant')])])}])",
    }
    first, second = closed({k: f"n{i}" for i, k in enumerate("-sua")})
    begin_first, begin_second = closed({"-": "{'c': 0, 'a': '', 'r': NULL::VARCHAR}", "s": never, "u": never, "a": never})
    steps = ", ".join(f"{new[k]} AS n{i}" for i, k in enumerate("-sua"))
    return f"""
WITH RECURSIVE {CRC_TABLE},
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT base.*, {crc32_sql('k')} % 20 AS kind FROM base, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0)
), seq AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
faults AS (
  SELECT *, blank OR twice AS must, NOT blank AND NOT twice AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice FROM seq)
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, w0, w1, w2, w3 FROM (SELECT conv_id, {begin_second} FROM (SELECT conv_id, {begin_first} FROM counts))
  UNION ALL
  SELECT conv_id, i, {second} FROM (SELECT conv_id, i, {first} FROM (
    SELECT f.conv_id, f.i, {steps} FROM walk JOIN faults f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1))
), best AS (SELECT walk.conv_id, list_min([w0, w3]) AS b FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.i = counts.n)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = _oracle()

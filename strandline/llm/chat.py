"""Preference formatting (operator 9): one shared prompt, two masked completions.

A pair names a chosen and a rejected conversation. Their longest common turn prefix (equal role and text, turn by turn,
in order) is rendered once as the prompt; what follows in either is its completion. A completion carries a mask: spans of
characters (start, end) on which a model is trained, which are the contents of assistant turns and their end marks, never
role headers or turns of others. All of it is DataFrame functions over one row a conversation.

Rendering is ``<|role|>\\ntext<|end|>\\n`` for each turn; the texts themselves are kept as they are.

Defined results: null roles and texts are empty; turns without conversation id are dropped, a null turn number comes
first; repeated turns of one number are ordered by role and text; of equal conversations everything is prompt and both
completions are empty; of a conversation that is a prefix of the other its completion is empty; a pair whose chosen or
rejected conversation is missing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def conversation_rows(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered turns, one row a conversation; a conversation is the unit that a task holds."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns of equal role and text."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(TAIL), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """Character spans of assistant contents and their end marks within the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, turn):
        body = acc["at"] + F.length(F.concat(F.lit(HEAD), turn["role"], F.lit(TAIL)))
        stop = body + F.length(turn["text"]) + len(END) - 1  # the end mark, without the line break after it
        span = F.struct(body.cast("int").alias("start"), stop.cast("int").alias("end"))
        return F.struct((stop + 1).cast("int").alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair (pair_id, chosen_id, rejected_id): prompt, completions and masks.

    Joins are by conversation id; a conversation that very many pairs share is split by Spark's skew join.
    """
    rows = conversation_rows(turns)
    left, right = (rows.select(F.col("conv_id").alias(f"{x}_id"), F.col("turns").alias(f"_{x}")) for x in ("chosen", "rejected"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(left, "chosen_id").join(right, "rejected_id")
    both = both.withColumn("n_prompt", common_turns(F.col("_chosen"), F.col("_rejected")))
    tail = {x: F.slice(f"_{x}", F.col("n_prompt") + 1, F.size(f"_{x}")) for x in ("chosen", "rejected")}
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prompt",
        render(F.slice("_chosen", F.lit(1), F.col("n_prompt"))).alias("prompt"),
        *(c for x in ("chosen", "rejected") for c in (render(tail[x]).alias(x), mask(tail[x]).alias(f"{x}_mask"))),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs (2k, 2k + 1) of conversation ids, the even one chosen: a stated pairing for tables that name none."""
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


def rival_turns(turns: DataFrame) -> DataFrame:
    """The turns of a rival of each conversation, under its id: the same conversation with the last turn replaced.

    The rival's last turn has the text of the last turn of the other conversation of its neighbour pair.
    """
    rows = conversation_rows(turns)
    last = rows.select(F.col("conv_id").alias("_other"), F.element_at("turns", -1).alias("_last"))
    other = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    rival = rows.withColumn("_other", other).join(last, "_other")
    kept = F.slice("turns", F.lit(1), F.size("turns") - 1)
    swapped = F.struct(F.element_at("turns", -1)["turn"].alias("turn"), F.element_at("turns", -1)["role"].alias("role"), F.col("_last")["text"].alias("text"))
    return rival.select("conv_id", F.explode(F.concat(kept, F.array(swapped))).alias("t")).select("conv_id", "t.*")


def preference_report(turns: DataFrame) -> DataFrame:
    """Digest columns of two families of pairs over all conversations: neighbours, and rivals that share all but the end.

    ``rival`` tells the families apart; a rival has the id of the conversation that it was made from.
    """
    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").where(F.col("conv_id").isNotNull())
    key = lambda c, rival: F.struct(F.lit(rival).alias("rival"), F.col(c).alias("id")).alias(c)
    named = lambda rows, rival: rows.select(key("conv_id", rival), "turn", "role", "text")
    own = slim.select("conv_id").distinct().select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    pairs = neighbour_pairs(slim).select("pair_id", key("chosen_id", False), key("rejected_id", False)).unionByName(own.select("pair_id", key("chosen_id", False), key("rejected_id", True)))
    out = format_preferences(named(slim, False).unionByName(named(rival_turns(slim), True)), pairs)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",").alias(c)
    ids = [F.col("rejected_id.rival").alias("rival"), "pair_id", F.col("chosen_id.id").alias("chosen_id"), F.col("rejected_id.id").alias("rejected_id")]
    return out.select(*ids, F.col("n_prompt").cast("long").alias("n_prompt"), digest("prompt"), digest("chosen"), spans("chosen_mask"), digest("rejected"), spans("rejected_mask"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
o AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS other FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT k.conv_id, k.role, CASE WHEN k.i = k.n THEN l.text ELSE k.text END AS text, k.i, k.n
  FROM k JOIN o USING (conv_id) JOIN k l ON l.conv_id = o.other AND l.i = l.n
), a AS (SELECT false AS rival, conv_id, role, text, i, n FROM k UNION ALL SELECT true, conv_id, role, text, i, n FROM r),
p AS (
  SELECT DISTINCT false AS rival, conv_id >> 1 AS pair_id, (conv_id >> 1) * 2 AS chosen_id, (conv_id >> 1) * 2 + 1 AS rejected_id FROM t
  UNION ALL SELECT DISTINCT true, conv_id, conv_id, conv_id FROM t
), q AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM a WHERE NOT a.rival AND a.conv_id = chosen_id) AND EXISTS (SELECT 1 FROM a WHERE a.rival = p.rival AND a.conv_id = rejected_id)),
c AS (
  SELECT q.rival, q.pair_id, q.chosen_id, q.rejected_id,
    least(max(x.n), max(y.n), coalesce(min(CASE WHEN NOT (x.role = y.role AND x.text = y.text) THEN x.i END) - 1, 1000000)) AS n_prompt
  FROM q JOIN a x ON NOT x.rival AND x.conv_id = q.chosen_id JOIN a y ON y.rival = q.rival AND y.conv_id = q.rejected_id AND y.i = x.i GROUP BY ALL
), s AS (SELECT a.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS out FROM a),
z AS (
  SELECT c.rival, c.pair_id, side, s.i, s.role, s.out, s.i <= c.n_prompt AS in_prompt,
    sum(length(s.out)) OVER (PARTITION BY c.rival, c.pair_id, side, s.i <= c.n_prompt ORDER BY s.i) - length(s.out) AS pos
  FROM c CROSS JOIN (VALUES ('chosen'), ('rejected')) v(side)
  JOIN s ON s.conv_id = CASE WHEN side = 'chosen' THEN c.chosen_id ELSE c.rejected_id END AND s.rival = (side = 'rejected' AND c.rival)
), g AS (
  SELECT rival, pair_id, side, coalesce(string_agg(out, '' ORDER BY i) FILTER (in_prompt), '') AS prompt, coalesce(string_agg(out, '' ORDER BY i) FILTER (NOT in_prompt), '') AS tail,
    coalesce(string_agg(CAST(CAST(pos + 5 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(out) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (NOT in_prompt AND role = 'assistant'), '') AS mask
  FROM z GROUP BY ALL
)
SELECT c.rival, c.pair_id, c.chosen_id, c.rejected_id, CAST(c.n_prompt AS BIGINT) AS n_prompt, sha256(x.prompt) AS prompt_sha256, sha256(x.tail) AS chosen_sha256, x.mask AS chosen_mask,
       sha256(y.tail) AS rejected_sha256, y.mask AS rejected_mask
FROM c JOIN g x ON x.rival = c.rival AND x.pair_id = c.pair_id AND x.side = 'chosen' JOIN g y ON y.rival = c.rival AND y.pair_id = c.pair_id AND y.side = 'rejected'
"""

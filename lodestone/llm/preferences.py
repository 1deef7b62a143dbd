"""Preference formatting: a pair's longest common turn prefix once as prompt, then masked completions.

A turn is rendered as ``<|role|>`` newline text ``<|end|>`` newline. A completion's mask is a list of
runs ``length:flag``, in characters, set apart by blanks: 1 for what an assistant turn says with its
end mark, 0 for the rest.

Defined cases: a null role or text counts as empty; turns of one number are ordered by role and
text; rows with a null conversation id belong to no pair and are left out; a conversation that is
missing is empty, so nothing is shared; equal conversations are all prompt, with empty completions;
repeated turns are turns like any other; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let

END = "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    runs = lambda t: F.concat(F.char_length(_head(t)).cast("string"), F.lit(":0 "), (F.char_length(t["text"]) + len(END)).cast("string"), F.when(t["role"] == TRAINED, ":1").otherwise(":0"))
    return F.array_join(F.transform(turns, runs), " ")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns two conversations share from the start."""
    shortest = F.least(F.size(chosen), F.size(rejected))
    unlike = F.filter(F.sequence(F.lit(0), shortest - 1), lambda i: ~F.get(chosen, i).eqNullSafe(F.get(rejected, i)))
    return F.when(shortest == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(unlike), shortest))


def formatted(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """id, common_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of pairs(id, chosen, rejected: arrays of structs role, text)."""
    sides = F.struct(F.col("chosen").alias("c"), F.col("rejected").alias("r"))
    rest = lambda turns, n: F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))
    made = let(
        sides,
        lambda s: let(
            common_turns(s["c"], s["r"]),
            lambda n: F.struct(
                n.cast("long").alias("common_turns"),
                _rendered(F.slice(s["c"], F.lit(1), n)).alias("prompt"),
                _rendered(rest(s["c"], n)).alias("chosen"),
                _mask(rest(s["c"], n)).alias("chosen_mask"),
                _rendered(rest(s["r"], n)).alias("rejected"),
                _mask(rest(s["r"], n)).alias("rejected_mask"),
            ),
        ),
    )
    return pairs.select(F.col(f"`{id_col}`"), made.alias("m")).select(id_col, "m.*")


def paired(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: of conversations 2n and 2n + 1 the former counts as chosen."""
    turns = conversations.where("conv_id is not null").select(
        F.expr("conv_id div 2 - if(conv_id % 2 < 0, 1, 0)").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))


def _last(turns: Column) -> Column:
    """The place (from 1) of the last trained turn, null without one."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1))), lambda i: F.get(turns, i - 1)["role"] == TRAINED)
    return F.array_max(places)


def against_neighbours(conversations: DataFrame) -> DataFrame:
    """pair_id (the conversation's id), chosen, rejected: of each conversation up to its last assistant turn, and with that turn
    replaced by the one of its neighbour (2n of 2n + 1 and the other way round). Where the neighbour has none, the turn is
    missing in rejected; a conversation without an assistant turn is its own pair and all prompt."""
    both = paired(conversations)
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(mine).alias("mine"), F.col(other).alias("other")) for k, mine, other in ((0, "chosen", "rejected"), (1, "rejected", "chosen"))))
    rows = both.select("pair_id", F.explode(sides).alias("s")).where(F.size("s.mine") > 0)
    rows = rows.select((F.col("pair_id") * 2 + F.col("s.side")).alias("pair_id"), F.col("s.mine").alias("mine"), F.col("s.other").alias("other")).withColumns({"at": _last(F.col("mine")), "from": _last(F.col("other"))})
    taken = F.when(F.col("from").isNotNull(), F.slice("other", F.coalesce("from", F.lit(1)), F.lit(1))).otherwise(F.slice("other", F.lit(1), F.lit(0)))
    before = F.slice("mine", F.lit(1), F.coalesce(F.col("at") - 1, F.lit(0)))
    return rows.select("pair_id", F.coalesce(F.slice("mine", F.lit(1), F.col("at")), F.col("mine")).alias("chosen"), F.when(F.col("at").isNull(), F.col("mine")).otherwise(F.concat(before, taken)).alias("rejected"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
finals AS (SELECT conv_id, count(*) AS size, max(k) FILTER (role = 'assistant') AS spot FROM turns GROUP BY conv_id),
answers AS (SELECT turns.conv_id, text FROM turns JOIN finals ON turns.conv_id = finals.conv_id AND k = spot),
pairs AS (
  SELECT finals.conv_id, coalesce(spot, size) AS stop, CASE WHEN spot IS NULL THEN size WHEN a.text = b.text THEN spot ELSE spot - 1 END AS n, CASE WHEN spot IS NOT NULL AND a.text IS DISTINCT FROM b.text THEN b.text END AS other
  FROM finals LEFT JOIN answers a ON a.conv_id = finals.conv_id LEFT JOIN answers b ON b.conv_id = xor(finals.conv_id, 1)),
made AS (
  SELECT conv_id, n, stop, other, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said,
         (length(role) + 5) || ':0 ' || (length(text) + 8) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mask
  FROM turns JOIN pairs USING (conv_id))
SELECT conv_id AS pair_id, n AS common_turns,
  coalesce(string_agg(said, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY k) FILTER (k > n AND k <= stop), '') AS chosen,
  coalesce(string_agg(mask, ' ' ORDER BY k) FILTER (k > n AND k <= stop), '') AS chosen_mask,
  coalesce('<|assistant|>' || chr(10) || other || '<|end|>' || chr(10), '') AS rejected,
  coalesce('14:0 ' || (length(other) + 8) || ':1', '') AS rejected_mask
FROM made GROUP BY conv_id, n, other
"""

"""Chat formatting of preference pairs, with DataFrame functions only.

A pair is a chosen and a rejected conversation.  The turns that both share from the start
are rendered once, as the prompt; what follows is each side's completion.  A completion
comes with its spans: character ranges, in order and without gaps, each with a flag that
says whether a loss is taken there (the text and end mark of assistant turns) or not (every
header, and turns of other roles).

Two turns are equal if role and text are; a null role or text is an empty one.  Turns go by
``turn``, then role, then text; repeated turns stay, as repeated turns.  A pair with one side
missing has an empty prompt and an empty completion for that side, and ``complete`` false.
A null conversation id is in no pair.  An empty table gives no rows.  Only the four columns
named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def _spans(turns: Column) -> Column:
    """A span for each header and each body.  Turns carry the place where they begin in their pair, in rendered characters."""
    base = F.element_at(turns, 1)["at"]

    def two(t: Column) -> Column:
        start, head = t["at"] - base, F.length(_head(t))
        return F.array(
            F.struct(start.alias("start"), head.cast("bigint").alias("length"), F.lit(False).alias("loss")),
            F.struct((start + head).alias("start"), F.length(_tail(t)).cast("bigint").alias("length"), (t["role"] == "assistant").alias("loss")),
        )

    return F.when(F.size(turns) > 0, F.flatten(F.transform(turns, two))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,loss:boolean>>"))


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns from the start are equal in both."""
    same = F.zip_with(a, b, lambda x, y: (x["role"].eqNullSafe(y["role"])) & (x["text"].eqNullSafe(y["text"])) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_preferences(turns: DataFrame, pair: Column, side: Column) -> DataFrame:
    """One row per pair.  ``side`` is true for turns of the chosen conversation.

    Conversations meet their partner in one shuffle, on the pair; a pair is as long as its
    two conversations, which its row has to hold in any case.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        side.alias("is_chosen"),
        F.col("conv_id").alias("conv"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).where(F.col("pair_id").isNotNull())
    size = F.length(F.lit(OPEN + "\n" + CLOSE)) + F.length("role") + F.length("text")
    before = Window.partitionBy("pair_id").orderBy("is_chosen", "turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.struct("turn", "role", "text", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("at")).alias("t")
    both = (
        rows.select("pair_id", "is_chosen", "conv", turn)
        .groupBy("pair_id")
        .agg(
            F.min(F.when(F.col("is_chosen"), F.col("conv"))).alias("chosen_id"),
            F.min(F.when(~F.col("is_chosen"), F.col("conv"))).alias("rejected_id"),
            F.array_sort(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("a"),
            F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("b"),
        )
        .withColumn("shared", shared_turns(F.col("a"), F.col("b")))
    )
    rest = lambda c: F.slice(F.col(c), F.col("shared") + 1, F.greatest(F.size(c), F.lit(1)))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        (F.col("chosen_id").isNotNull() & F.col("rejected_id").isNotNull()).alias("complete"),
        F.col("shared").cast("bigint").alias("prompt_turns"),
        _rendered(F.slice(F.col("a"), F.lit(1), F.col("shared"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"),
        _spans(rest("a")).alias("chosen_spans"),
        _rendered(rest("b")).alias("rejected"),
        _spans(rest("b")).alias("rejected_spans"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k+1 as chosen and rejected, spans as text so that any engine can compare them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_preferences(turns, F.floor(F.col("conv_id") / 2).cast("bigint"), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    loss = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["length"], s["loss"].cast("int"))), ",")
    return out.withColumns({"chosen_spans": loss("chosen_spans"), "rejected_spans": loss("rejected_spans")})


def op8_sql() -> str:
    head = f"length('{OPEN}' || role || chr(10))"
    tail = f"length(text || '{CLOSE.strip()}' || chr(10))"
    whole = f"'{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10)"
    return f"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, ((conv_id % 2) + 2) % 2 = 0 AS chosen, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), ends AS (
  SELECT pair_id, min(conv_id) FILTER (chosen) AS chosen_id, min(conv_id) FILTER (NOT chosen) AS rejected_id FROM n GROUP BY pair_id
), differ AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS i
  FROM (SELECT * FROM n WHERE chosen) a FULL JOIN (SELECT * FROM n WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE NOT coalesce(a.role = b.role AND a.text = b.text, FALSE) GROUP BY 1
), len AS (
  SELECT e.*, coalesce(d.i - 1, (SELECT max(n.i) FROM n WHERE n.pair_id = e.pair_id)) AS shared FROM ends e LEFT JOIN differ d USING (pair_id)
), r AS (
  SELECT n.*, shared, n.i <= shared AS common, {whole} AS whole, {head} AS h, {tail} AS b,
    sum({head} + {tail}) OVER (PARTITION BY pair_id, chosen, n.i <= shared ORDER BY n.i) - {head} - {tail} AS pos
  FROM n JOIN len USING (pair_id)
), g AS (
  SELECT pair_id,
    string_agg(whole, '' ORDER BY i) FILTER (common AND chosen) AS prompt,
    string_agg(whole, '' ORDER BY i) FILTER (NOT common AND chosen) AS chosen,
    string_agg(whole, '' ORDER BY i) FILTER (NOT common AND NOT chosen) AS rejected,
    string_agg(CAST(pos AS BIGINT) || ':' || h || ':0,' || CAST(pos + h AS BIGINT) || ':' || b || ':' || CAST(role = 'assistant' AS INTEGER), ',' ORDER BY i) FILTER (NOT common AND chosen) AS cs,
    string_agg(CAST(pos AS BIGINT) || ':' || h || ':0,' || CAST(pos + h AS BIGINT) || ':' || b || ':' || CAST(role = 'assistant' AS INTEGER), ',' ORDER BY i) FILTER (NOT common AND NOT chosen) AS rs
  FROM r GROUP BY pair_id
)
SELECT pair_id, chosen_id, rejected_id, chosen_id IS NOT NULL AND rejected_id IS NOT NULL AS complete, CAST(shared AS BIGINT) AS prompt_turns,
  coalesce(prompt, '') AS prompt, coalesce(g.chosen, '') AS chosen, coalesce(cs, '') AS chosen_spans, coalesce(rejected, '') AS rejected, coalesce(rs, '') AS rejected_spans
FROM len JOIN g USING (pair_id)"""

"""Operator 6: chat formatting from an event log. DataFrame functions only.

Events are folded into final messages, messages rendered under a template whose marks cannot occur in escaped texts,
and a loss mask given as spans of the formatted text. One shuffle, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MID, CLOSE = '<turn role="', '">', "</turn>\n"
#: Kinds of event: a whole message; a piece appended to it; a new whole text; a new start, whose pieces follow.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Text without <, > and double quotes, from which unescape() gives back the text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv, seq, message, role, text) of an event log (conv, message, seq, kind, role, text).

    Events are taken in the order of seq, then kind, then text. A message's text is that of its last message, edit or regenerate event, and the
    deltas after that; a log that starts with deltas starts empty. Its place is its first event's; its role the last
    that an event names. Null texts are empty, null kinds whole messages; an unknown kind is an error.
    """
    kind = F.coalesce("kind", F.lit("message"))
    kind = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kind)))
    e = events.select("conv", "message", F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    log = F.sort_array(F.collect_list("e"))
    m = e.groupBy("conv", "message").agg(log.alias("log"))
    heads = F.filter(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i + 1)), lambda i: i.isNotNull())
    live = F.when(F.size("log") == 1, F.col("log")).otherwise(F.slice("log", F.coalesce(F.array_max(heads), F.lit(1)), F.size("log")))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return m.select("conv", F.col("log")[0]["seq"].alias("seq"), "message", F.try_element_at(roles, F.lit(-1)).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: formatted (string), loss_mask (spans of code points, start and end, over the assistant's escaped texts) and n_turns.

    Turns stand in the order of seq, then message. Null roles are empty.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(MID))
    m = messages.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("out", F.concat("head", "body", F.lit(CLOSE)))
    before = W.partitionBy("conv").orderBy("seq", "message").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.length("out").cast("long")).over(before), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    turns = m.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "message", "out", span.alias("span")))).alias("t"))
    return turns.select("conv", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"), F.size("t").cast("long").alias("n_turns"))


def format_chats(events: DataFrame) -> DataFrame:
    """fold() and render() behind one shuffle. A conversation is one row of the output, so it has to fit a row; rows of a third of all events stay within one task for that reason alone."""
    return render(fold(events.select("conv", "message", "seq", "kind", "role", "text").repartition("conv")))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    blocks = F.split(formatted, CLOSE.replace("/", "\\/"))
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turn(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MID, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(b, F.length(role) + len(OPEN) + len(MID) + 1)).alias("text"))

    return F.transform(blocks, turn)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


#: Characters of a streamed piece at least; a text comes in three pieces at most.
PIECE = 8


def events_of(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log whose fold is a table with a row per turn; rows of the same turn stay apart, in the order of role and text.

    An assistant's message is a draft that is streamed in part, a regeneration, and the text streamed in pieces; another's is
    a first version without its last third, and an edit. Null texts stay null, in a single event. Other columns are not read.
    """
    nth = F.row_number().over(W.partitionBy("conv", "turn").orderBy("role", "text"))
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).repartition("conv").withColumn("nth", nth)
    size = F.greatest(F.lit(PIECE), F.ceil(F.length("text") / 3).cast("int"))
    piece = [F.substr("text", k * size + 1, size) for k in range(2)] + [F.substr("text", 2 * size + 1)]

    def event(step: int, kind: str, what: Column) -> Column:
        return F.struct(F.struct("turn", F.lit(step).alias("step")).alias("seq"), F.lit(kind).alias("kind"), what.cast("string").alias("text"), F.when(F.lit(step) == 0, F.col("role")).alias("role"))

    streamed = F.array(event(0, "delta", piece[1]), event(1, "delta", piece[0]), event(2, "regenerate", F.lit(None)), *(event(3 + k, "delta", p) for k, p in enumerate(piece)))
    edited = F.array(event(0, "message", F.concat(*piece[:2])), event(1, "edit", F.col("text")))
    log = F.when(F.col("text").isNull(), F.array(event(0, "message", F.col("text")))).when(F.col("role") == "assistant", streamed).otherwise(edited)
    return r.select("conv", F.struct("turn", "nth").alias("message"), F.inline(log))


#: What the query returns, by DuckDB alone.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
  length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) + 22 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

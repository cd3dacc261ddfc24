"""Chat formatting whose output is read back by a deterministic parser; DataFrame functions only.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "<s>" TEXT "</s>"                          a turn of the assistant, trained on
                  | "<s>[INST] " ROLE "\\n" TEXT " [/INST]"     any other turn

where TEXT and ROLE hold none of the control strings ``<s> </s> [INST] [/INST]``, ROLE no line
feed, and a backslash begins one of the escapes ``\\\\ \\l \\b \\n`` for ``\\ < [`` and line feed. A conversation
is rendered as it is and parsed; if the turns read back are not those of the source, its contents are
escaped and it is parsed again, and an output that still differed would be an error, not a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
ASSISTANT = "assistant"
_OPEN, _CLOSE, _ASK, _ASKED = "<s>", "</s>", "[INST] ", " [/INST]"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """Without ``<``, ``[`` or line feed, so no control string is left; undone by ``unescape``."""
    return _replace(_replace(_replace(_replace(text, "\\", "\\\\"), "<", "\\l"), "[", "\\b"), "\n", "\\n")


def unescape(text: Column) -> Column:
    """The escapes read from left to right: what stands between two-backslash escapes holds only the others."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda x: _replace(_replace(_replace(x, "\\l", "<"), "\\b", "["), "\\n", "\n"))
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(plain, "\\"))


def render(turns: Column) -> Column:
    """Turns, an array of (role, text), as one string."""

    def one(t: Column) -> Column:
        asked = F.concat(F.lit(_OPEN + _ASK), t["role"], F.lit("\n"), t["text"], F.lit(_ASKED))
        return F.when(t["role"] == ASSISTANT, F.concat(F.lit(_OPEN), t["text"], F.lit(_CLOSE))).otherwise(asked)

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation; a part that breaks the grammar becomes a null role and text."""

    def plain(x: Column) -> Column:
        found = F.instr(x, CONTROLS[0]) > 0
        for c in CONTROLS[1:]:
            found = found | (F.instr(x, c) > 0)
        return ~found

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(1 + len(_ASK)), F.length(part) - len(_ASK + _ASKED))
        cut = F.instr(body, "\n")
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + 1, F.length(body))
        said = F.substring(part, F.lit(1), F.length(part) - len(_CLOSE))
        is_asked = part.startswith(_ASK) & part.endswith(_ASKED) & (F.length(part) >= len(_ASK + _ASKED)) & (cut > 0) & plain(body)
        is_said = part.endswith(_CLOSE) & plain(said)
        return F.when(is_asked, F.struct(unescape(role).alias("role"), unescape(text).alias("text"))).when(is_said, F.struct(F.lit(ASSISTANT).alias("role"), unescape(said).alias("text")))

    parts = F.split(rendered, _OPEN, -1)
    turns = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(F.element_at(parts, 1) == "", turns)


def format_conversations(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, escaped, turns``: a row for each conversation, ``turns`` as read back from ``formatted``.

    Turns stand in the order of turn, role, text, nulls first; repeated turns all stay. Null roles and texts
    are empty; rows with a null id are one conversation. An empty table gives an empty result, and other
    columns are not looked at. A conversation's turns meet in one row because its output is
    one string; they are sorted there, and nothing but that string's own conversation is gathered. Such a
    string has the limit of any value of Spark, 2 GB.
    """
    turns = rows.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    source = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _order), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    first = source.withColumn("raw", render(F.col("source")))
    read = first.withColumn("turns", parse(F.col("raw"))).withColumn("escaped", ~F.col("turns").eqNullSafe(F.col("source")))
    safe = F.transform("source", lambda t: F.struct(F.when(t["role"] == ASSISTANT, t["role"]).otherwise(escape(t["role"])).alias("role"), escape(t["text"]).alias("text")))
    final = read.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("raw")))
    again = final.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("turns")))
    checked = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not survive its round trip")))
    return again.select("conv_id", "formatted", "escaped", checked.alias("turns"))


def _order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.isNull() & y.isNotNull() | (x < y), -1).when(x.isNotNull() & y.isNull() | (x > y), 1).otherwise(out)
    return out


def loss_mask(turns: Column, escaped: Column) -> Column:
    """``array<struct<turn, length>>``: of the part of ``formatted`` that holds this turn, so many code points are trained on."""
    sized = F.transform(turns, lambda t, i: F.struct(i.alias("turn"), F.when(t["role"] == ASSISTANT, F.when(escaped, F.length(escape(t["text"]))).otherwise(F.length(t["text"]))).alias("length")))
    return F.filter(sized, lambda t: t["length"].isNotNull())


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text of ``formatted`` under the mask, unescaped; each part is cut once, so the time is that of the length."""

    def read(x: Column) -> Column:
        return F.array_join(F.transform(x["mask"], lambda m: unescape(F.substring(F.get(x["parts"], m["turn"] + 1), F.lit(1), m["length"]))), "")

    held = F.array(F.struct(F.split(formatted, _OPEN, -1).alias("parts"), mask.alias("mask")))
    return F.get(F.transform(held, read), F.lit(0))


def loss_spans(turns: Column, escaped: Column) -> Column:
    """``array<struct<start, length>>``: the mask as places in ``formatted`` (code points from 0)."""
    shown = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.when(escaped & (t["role"] != ASSISTANT), F.length(escape(t["role"]))).otherwise(F.length(t["role"])).alias("r"), F.when(escaped, F.length(escape(t["text"]))).otherwise(F.length(t["text"])).alias("n")))

    def step(acc: Column, t: Column) -> Column:
        trained = t["role"] == ASSISTANT
        size = F.when(trained, t["n"] + len(_OPEN + _CLOSE)).otherwise(t["n"] + t["r"] + len(_OPEN + _ASK + _ASKED) + 1)
        span = F.array(F.struct((acc["at"] + len(_OPEN)).alias("start"), t["n"].alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(shown, begin, step, lambda acc: acc["spans"])


#: The conversation that the contract adds.
HARD = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """op7: digests of what is read back from the output, for all conversations and conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(HARD).alias("text"))
    done = format_conversations(rows.unionByName(hard))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.col("loss")
    return done.withColumn("loss", under_mask(F.col("formatted"), loss_mask(F.col("turns"), F.col("escaped")))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, bool_or(contains(x, '<s>') OR contains(x, '</s>') OR contains(x, '[INST]') OR contains(x, '[/INST]') OR contains(x, '\')
    OR contains(role, chr(10)) OR (role = 'assistant' AND starts_with(text, '[INST] '))) OVER (PARTITION BY conv_id) AS esc
  FROM (SELECT *, text || chr(0) || role AS x FROM rows)
), sized AS (
  SELECT *, CASE WHEN esc THEN length(text) + length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '[', ''), chr(10), '')) ELSE length(text) END AS n,
    CASE WHEN esc THEN length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), '')) ELSE length(role) END AS r
  FROM marked
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + r + 19 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<s>" ( "[INST] " text " [/INST]" | text | "[ROLE:" name "] " text ) "</s>"

The first form is a user's turn, the second an assistant's, the third any other role's; a name
with other signs than letters, digits, ``_`` and ``-`` is written ``hex:`` and its UTF-8 bytes.
A turn is rendered as it is, parsed again and compared; if the parser does not give it back, its
control strings are escaped. The same is asked of the whole conversation, all of whose turns are
escaped if it fails. Escaping puts a backslash after a control string's first sign, also where
backslashes stand there already, and the parser always takes one away, so it is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm.common import table

_ESCAPE = r"(<|\[)(\\*)(/?s>|/?INST\]|ROLE:)"
_UNESCAPE = r"(<|\[)\\(\\*)(/?s>|/?INST\]|ROLE:)"
_CLASH = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    name = F.when(role.rlike(r"^[A-Za-z0-9_-]+\z"), role).otherwise(F.concat(F.lit("hex:"), F.hex(role.cast("binary"))))
    inner = F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "assistant", text)
    return F.concat(F.lit("<s>"), inner.otherwise(F.concat(F.lit("[ROLE:"), name, F.lit("] "), text)), F.lit("</s>"))


def _read(part: Column) -> Column:
    """(role, text, skip): what a part between turn ends says, and the signs before its text."""
    body = F.substr(part, F.lit(4))
    name = F.regexp_extract(body, r"^\[ROLE:([A-Za-z0-9_:-]*)\] ", 1)
    user = body.startswith("[INST] ") & body.endswith(" [/INST]") & (F.length(body) >= 15)
    other = body.rlike(r"^\[ROLE:(?:hex:[0-9A-F]*|[A-Za-z0-9_-]+)\] ")
    role = F.when(user, "user").when(other, F.when(name.startswith("hex:"), F.unhex(F.substr(name, F.lit(5))).cast("string")).otherwise(name)).otherwise("assistant")
    skip = F.when(user, 7).when(other, F.length(name) + 8).otherwise(0)
    text = F.substr(body, skip + 1, F.length(body) - skip - F.when(user, 8).otherwise(0))
    return F.struct(role.alias("role"), unescape(text).alias("text"), text.alias("raw"), (skip + 3).alias("skip"))


def parse(formatted: Column) -> Column:
    """Array of (role, text, raw, skip) of a formatted conversation; raw is still escaped."""
    parts = F.filter(F.split(formatted, "</s>"), lambda p: p.startswith("<s>"))
    return F.transform(parts, _read)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _same(formatted: Column, turns: Column) -> Column:
    """Whether parsing gives the turns back, and nothing stands outside of them."""
    size = lambda n, t: n + t["skip"] + F.length(t["raw"]) + F.when(t["role"] == "user", 8).otherwise(0) + 4
    # parsed once: an array of one, for its lambda to use twice
    check = F.transform(F.array(parse(formatted)), lambda p: (_plain(p) == turns) & (F.length(formatted) == F.aggregate(p, F.lit(0), size)))
    return F.element_at(check, 1)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, and turns and loss spans as read back from it.

    Rows are taken by turn, ties by role and text; null turns come first, a null role or text
    counts as empty, null conv_ids are one conversation, repeated rows are turns like any other.
    An empty table gives no rows; other columns are ignored. One conversation is one output row,
    so its turns meet in one task; conversations don't meet each other. ``escaped`` says how many
    turns needed it, ``identical`` that the final text parses back to the source: if one
    did not, the query would fail.
    Loss spans (start from 0, length) are in code points of ``formatted`` and cover each
    assistant's text as escaped.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", _plain(F.col("t")).alias("turns"))
    one = lambda t: F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # a text without a first sign of a control string has none: only the whole conversation need be parsed
    fits = turns.withColumn("fits", F.transform("turns", lambda t: F.when(~t["text"].rlike(r"[<\[]"), True).otherwise(_same(render_turn(t["role"], t["text"]), one(t)))))
    mixed = F.zip_with("turns", "fits", lambda t, fit: render_turn(t["role"], F.when(fit, t["text"]).otherwise(escape(t["text"]))))
    tried = fits.withColumn("formatted", F.array_join(mixed, "")).withColumn("first", _same(F.col("formatted"), F.col("turns")))
    safe = F.array_join(F.transform("turns", lambda t: render_turn(t["role"], escape(t["text"]))), "")
    done = tried.withColumn("formatted", F.when(F.col("first"), F.col("formatted")).otherwise(safe))
    done = done.withColumn("escaped", F.when(F.col("first"), F.size(F.filter("fits", lambda x: ~x))).otherwise(F.size("turns")).cast("long"))
    unlike = F.raise_error(F.concat(F.lit("a formatted conversation does not parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")
    identical = F.when(F.col("first"), True).when(_same(F.col("formatted"), F.col("turns")), True).otherwise(unlike)
    read = done.select("conv_id", "formatted", "escaped", parse(F.col("formatted")).alias("parsed"), identical.alias("identical"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["skip"] + F.length(t["raw"]) + F.when(t["role"] == "user", 8).otherwise(0) + 4).alias("at"),
        F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["skip"]).alias("start"), F.length(t["raw"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.expr("named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>))")
    return read.select("conv_id", "formatted", "escaped", "identical", _plain(F.col("parsed")).alias("turns"), F.aggregate("parsed", start, step)["spans"].alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from what was read back and from the loss spans."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    made = formatted.select("conv_id", "turns", said.alias("said"), loss.alias("loss"), "formatted", "escaped", "identical")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CLASH).alias("text"))
    return digests(format_chats(given.unionByName(clash)))


_SQL_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\]|ROLE:)', '\1\\\2\3', 'g')"
#: The escaped turn count follows from the texts: DuckDB needs no parser for it.
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CLASH}' UNION ALL SELECT -7, 1, 'assistant', '{_CLASH}'),
marked AS (
  SELECT *, instr(text, '</s>') > 0 OR regexp_matches(text, '(<|\[)\\\\*\\(/?s>|/?INST\]|ROLE:)')
      OR (role = 'assistant' AND ((starts_with(text, '[INST] ') AND ends_with(text, ' [/INST]') AND length(text) >= 15) OR regexp_matches(text, '^\[ROLE:(hex:[0-9A-F]*|[A-Za-z0-9_-]+)\] '))) AS clash
  FROM rows),
shown AS (
  SELECT *, CASE WHEN clash THEN {_SQL_ESCAPE.format("text")} ELSE text END AS body FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(body) + 7 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 ELSE
         8 + CASE WHEN regexp_matches(role, '^[A-Za-z0-9_-]+\z') THEN length(role) ELSE 4 + length(hex(encode(role))) END END) AS BIGINT) AS formatted_chars,
       CAST(sum(CASE WHEN clash THEN 1 ELSE 0 END) AS BIGINT) AS escaped, true AS identical
FROM shown GROUP BY conv_id"""

"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log has events (conv_id, turn, copy, seq, kind, role, text). Kinds: `message`
and `edit` set a turn's text, `regenerate` sets it anew and takes back every
later turn written before it, `delta` appends to what was last set. `fold`
sorts by `seq` and reduces the log to final turns; `render` writes each
conversation with its loss mask; `read_back` takes both apart again.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. In texts a backslash becomes
two and `<|` becomes `<\\|`, so no control string can stand in one, and each
escape is undone exactly. In roles `%`, `<` and line feeds are percent-encoded.

Work is dealt by conversation *and* by a chunk of `CHUNK` turn numbers, so a
conversation with very many turns is folded and rendered by many tasks; only
its finished chunk strings meet, since a conversation is one string in the
output. Texts are exchanged twice: to their chunk, and as chunks to their
conversation. What regenerations take back is found on the narrow columns.

Defined results: null roles and texts are empty; a null conv_id is a
conversation; null turns come last, with turn 2^63 - 1; rows that share conv_id
and turn are turns each, ordered by role and text, and so in one task; a delta
without a message before it opens one; an empty log gives an empty result;
other columns are ignored (`log_chunk`, which `log_of` adds, is reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 256
LAST_TURN = (1 << 63) - 1


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _dealt(log: DataFrame) -> DataFrame:
    """The log by conversation and chunk of turns; what follows keeps to it."""
    return log.withColumn("log_chunk", F.floor(F.col("turn") / CHUNK)).repartition("conv_id", "log_chunk")


def log_of(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns: a message for each row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = _dealt(conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"), role.alias("role"), text.alias("text")))
    copy = F.row_number().over(Window.partitionBy("conv_id", "log_chunk", "turn").orderBy("role", "text")) - 1
    return rows.select("conv_id", "log_chunk", "turn", copy.cast("long").alias("copy"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def _taken_back(log: DataFrame) -> DataFrame:
    """The events (conv_id, seq, turn, copy) before a regeneration of an
    earlier turn. Narrow columns only, of conversations with regenerations."""
    again = log.where(F.col("kind") == "regenerate")
    some = again.select(F.col("conv_id").alias("c")).distinct()
    events = log.join(some, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "seq", "turn", "copy", "kind").withColumn("run", F.floor(F.col("seq") / CHUNK))
    # the least turn regenerated after each event: by runs of the sequence, then along the runs
    least = F.min(F.when(F.col("kind") == "regenerate", F.col("turn")))
    later = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("conv_id", "run").agg(least.alias("least")).select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.min("least").over(later).alias("carried"))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.desc("seq"), F.desc("turn"), F.desc("copy")).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("within", least.over(inside)).join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return marked.where(F.least("within", "carried") < F.col("turn")).select("conv_id", "seq", "turn", "copy").distinct()


def fold(log: DataFrame) -> DataFrame:
    """The final turns: conv_id, log_chunk, turn, copy, role, text."""
    log = log if "log_chunk" in log.columns else _dealt(log.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN))))
    gone = _taken_back(log).select(*[F.col(c).alias(f"gone_{c}") for c in ("conv_id", "seq", "turn", "copy")])
    live = log.join(gone, F.col("conv_id").eqNullSafe(F.col("gone_conv_id")) & (F.col("seq") == F.col("gone_seq")) & (F.col("turn") == F.col("gone_turn")) & (F.col("copy") == F.col("gone_copy")), "left_anti")

    sets = F.col("kind") != "delta"
    event = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    turns = live.groupBy("conv_id", "log_chunk", "turn", "copy").agg(
        F.max(F.when(sets, event)).alias("last"),
        F.max_by(F.when(F.col("role").isNotNull(), F.col("role")), F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.sort_array(F.collect_list(F.when(~sets, event))).alias("deltas"),
    )
    added = F.filter("deltas", lambda d: F.col("last").isNull() | (d["seq"] > F.col("last.seq")))
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform(added, lambda d: d["text"]), ""))
    return turns.select("conv_id", "log_chunk", "turn", "copy", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_turns, and loss_spans: where in `formatted` (code
    points from 0) the texts lie that are learnt from, escaped as they stand."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct("turn", "copy", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).alias("head"), F.length(body).alias("chars"), (F.col("role") == loss_role).alias("loss"))
    chunks = turns.groupBy("conv_id", "log_chunk").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    none = F.lit(None).cast("array<struct<start:int,chars:int>>")
    empty = F.coalesce(none, F.array().cast("array<struct<start:int,chars:int>>"))

    def step(s: Column, p: Column) -> Column:
        span = F.array(F.struct((s["at"] + p["head"]).alias("start"), p["chars"].alias("chars")))
        return F.struct((s["at"] + F.length(p["piece"])).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    folded = F.aggregate("p", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)
    chunks = chunks.select("conv_id", F.struct("log_chunk", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("text"), F.size("p").cast("long").alias("n"), folded["spans"].alias("spans")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))

    def join(s: Column, c: Column) -> Column:
        moved = F.transform(c["spans"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["chars"].alias("chars")))
        return F.struct((s["at"] + F.length(c["text"])).alias("at"), F.concat(s["spans"], moved).alias("spans"))

    spans = F.aggregate("c", F.struct(F.lit(0).alias("at"), empty.alias("spans")), join)["spans"]
    count = F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return whole.select("conv_id", F.array_join(F.transform("c", lambda c: c["text"]), "").alias("formatted"), count.alias("n_turns"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings say, parsed from them: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    role = lambda p: unescape_role(F.substring_index(p, "\n", 1))
    text = lambda p: unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1))
    said = F.array_join(F.transform(parts, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    read = formatted.select("conv_id", F.size(parts).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

"""Chat formatting: event logs folded into messages, messages rendered with a loss mask (native).

A log is a table of events, each with a conversation, a sequence number, a message id, a kind, a role
and a text. Kinds: `message`, `edit` and `regenerate` set the text of their message, `delta` appends
to it; a missing or unknown kind counts as `message`. An event without message id is a message by
itself. Edits and regenerations change one message and leave the others.

The fold is associative, so no conversation and no message is gathered whole: events of a message are
range partitioned by conversation, message and sequence, each task folds its run of a message to one
row, and the few runs of a message are folded again. Rendering cuts a conversation into pieces of
whole turns in the same way; the pieces in order are the formatted conversation. Where the cuts fall
depends on the partitions, what the pieces join to does not.

Defined results: null text is empty; null role is the empty role; null conversations form one
conversation; null sequence numbers come first; events at one sequence number are ordered by kind,
role and text; repeated rows without message id are repeated turns; an empty log has no pieces.
Columns beyond the six named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS_PER_PIECE = 128
_KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    r"""A text in which no `<|` occurs: one backslash more between `<` and `|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role without line break and without `<|`."""
    return F.replace(F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")),
                               F.lit("\n"), F.lit("&nl;")), F.lit("<|"), F.lit("&lt;|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&lt;"), F.lit("<")),
                               F.lit("&nl;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def _first_role(parts: Column) -> Column:
    return F.get(F.filter(F.transform(parts, lambda p: p["role"]), F.isnotnull), F.lit(0))


def _tail(parts: Column) -> Column:
    """Texts from the last part that sets the text on, joined."""
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p["sets"], i).otherwise(0)))
    return F.array_join(F.slice(F.transform(parts, lambda p: p["text"]), last + 1, F.size(parts)), "")


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq",
                message: str = "message_id", kind: str = "kind", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per message: conv_id, seq (of its first event), role, text, n_revisions."""
    named = F.coalesce(F.col(kind).cast("string"), F.lit("message"))
    rank = F.array_position(F.array(*map(F.lit, _KINDS)), named)
    rows = events.select(
        F.col(conv).alias("conv_id"), F.col(message).alias("message"), F.col(seq).alias("seq"),
        F.when(rank == 0, 1).otherwise(rank).alias("kind"), F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # An event without message id is whole as it stands and moves nowhere.
    alone = rows.where("message IS NULL").select(
        "conv_id", "seq", "role", "text", F.col("kind").isin(2, 3).cast("int").alias("n_revisions"))
    runs = (rows.where("message IS NOT NULL").repartitionByRange("conv_id", "message", "seq")
            .withColumn("run", F.spark_partition_id())
            .groupBy("conv_id", "message", "run")
            .agg(F.sort_array(F.collect_list(F.struct(
                "seq", "kind", "role", "text", (F.col("kind") < 4).alias("sets")))).alias("events"))
            .select("conv_id", "message", F.struct(
                F.col("events")[0]["seq"].alias("seq"), "run", _first_role(F.col("events")).alias("role"),
                _tail(F.col("events")).alias("text"),
                F.exists("events", lambda e: e["sets"]).alias("sets"),
                F.size(F.filter("events", lambda e: e["kind"].isin(2, 3))).alias("revisions"))
                .alias("part")))
    whole = runs.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id", F.col("parts")[0]["seq"].alias("seq"), _first_role(F.col("parts")).alias("role"),
        _tail(F.col("parts")).alias("text"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["revisions"]).alias("n_revisions")).unionByName(alone)


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",),
           turns_per_piece: int = TURNS_PER_PIECE) -> DataFrame:
    """Pieces of formatted conversations: conv_id, piece (their order), n_turns, formatted and
    loss_spans, the code-point ranges [start, end) of a piece that count for the loss."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = (messages.select("conv_id", "seq", role.alias("role"), "text", head.alias("head"),
                             escape(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
             .repartitionByRange("conv_id", "seq", "role", "text")
             .withColumn("run", F.spark_partition_id()))
    order = ["seq", "role", "text"]
    number = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(*order))
    turns = turns.select("*", F.floor((number - 1) / turns_per_piece).alias("part"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("conv_id", "run", "part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    first = F.col("at") + F.length("head")
    span = F.when(F.col("role").isin(*trained), F.struct(
        first.alias("start"), (first + F.length("body")).alias("end")))
    pieces = turns.groupBy("conv_id", "run", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn", span.alias("span")))).alias("turns"))
    return pieces.select(
        "conv_id", F.struct("run", "part").alias("piece"), F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), F.isnotnull).alias("loss_spans"))


def format_chat(events: DataFrame, **columns: str) -> DataFrame:
    """Fold, then render."""
    return render(fold_events(events, **columns))


def parse(pieces: DataFrame) -> DataFrame:
    """Pieces with what can be read back from them: `turns`, an array of (role, text) in order, and
    `loss_text`, all text under the mask."""
    after = F.expr(f"slice(split(formatted, '{START.replace('|', '[|]')}'), 2, n_turns)")
    turns = F.transform(after, lambda t: F.struct(
        unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1,
                          F.length(t) - F.instr(t, "\n") - len(END) - 1)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return pieces.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))

"""Chat formatting from event logs: native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Takes the control opener out of a text; unescape() gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """As escape(); a role is one line, so line feeds are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def fold_events(events: DataFrame, conv: str = "conv_id", message: str = "message_id", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv, message, seq of the first event, role, text) of an event log.

    Kinds: `message` and `edit` set a message's text, `delta` appends to it, `regenerate` sets it to the event's text and so
    starts it anew, `delete` removes the message until a later event sets it. Events act in order of (seq, kind, text); of
    rows that agree in all columns each acts. A null text is empty, a null or unknown kind does nothing, a null role leaves
    the last one. One group holds one message's events, so a conversation of any length spreads over tasks.
    """
    k = F.coalesce(F.col(kind), F.lit(""))
    row = F.struct(F.col(seq).alias("s"), k.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(role).alias("r"))
    log = F.sort_array(F.collect_list(row))
    sets = F.transform("_log", lambda x, i: F.when(x["k"].isin("message", "edit", "regenerate", "delete"), i))
    g = events.where(k.isin("message", "edit", "regenerate", "delete", "delta")).groupBy(F.col(conv).alias("_c"), F.col(message).alias("_m")).agg(log.alias("_log"))
    g = g.withColumn("_last", F.coalesce(F.array_max(sets), F.lit(0)))
    live = F.slice("_log", F.col("_last") + 1, F.size("_log"))
    roles = F.filter(F.transform("_log", lambda x: x["r"]), lambda r: r.isNotNull())
    g = g.where(F.col("_log")[F.col("_last")]["k"] != "delete")
    return g.select(
        F.col("_c").alias(conv), F.col("_m").alias(message), F.col("_log")[0]["s"].alias(seq),
        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise("").alias(role), F.array_join(F.transform(live, lambda x: x["t"]), "").alias(text),
    )


def render_messages(messages: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("seq", "message_id"), role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans (code points: 1-based start, length).

    A turn is `<|im_start|>role LF text <|im_end|> LF`, role and text escaped. Only texts of loss_roles are under the loss mask.
    Turns follow `order`, then role and text; repeated rows each give a turn. Null texts and roles are empty.
    """
    shown_role, shown = escape_role(F.coalesce(F.col(role), F.lit(""))), escape(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(START), shown_role, F.lit("\n"))
    turn = F.concat(head, shown, F.lit(f"{END}\n"))
    m = messages.select(
        F.col(conv).alias("_c"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.coalesce(F.col(role), F.lit("")).alias("_r"), turn.alias("_t"),
        F.length(turn).cast("long").alias("_n"), F.length(head).cast("long").alias("_h"), F.length(shown).cast("long").alias("_x"),
    )
    keys = [f"_o{i}" for i in range(len(order))]
    g = m.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct(*keys, "_r", "_t", "_n", "_h", "_x"))).alias("_turns"))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["_h"]).alias("start"), x["_x"].alias("length"))
        return F.struct((acc["at"] + x["_n"]).alias("at"), F.when(x["_r"].isin(*loss_roles), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return g.select(
        F.col("_c").alias(conv), F.array_join(F.transform("_turns", lambda x: x["_t"]), "").alias("formatted"),
        F.aggregate("_turns", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), parsed from the formatted string, and loss_text, all text under the mask, unescaped."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.length("formatted"), F.lit(1)))
    turns = F.transform(parts, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(_sub(p)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def _sub(part: Column) -> Column:
    """The text of one turn: what stands between the first line feed and the end mark."""
    first = F.instr(part, "\n")
    return F.substring(part, first + 1, F.length(part) - first - (len(END) + 1))


def format_chats(events: DataFrame, **names) -> DataFrame:
    """Event log to formatted conversations: fold_events(), then render_messages()."""
    conv, message, seq = names.get("conv", "conv_id"), names.get("message", "message_id"), names.get("seq", "seq")
    return render_messages(fold_events(events, **names), conv, (seq, message), names.get("role", "role"), names.get("text", "text"))

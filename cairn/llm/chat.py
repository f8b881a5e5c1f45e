"""Chat formatting: fold an event log into final messages, then render each conversation once.

Events are partitioned by conversation and ordered by sequence. `message`, `edit` and `regenerate` start a
message's text anew (a regenerate usually with an empty text), `delta` appends to it; so a message's
final text is the text of its last restart followed by the deltas after it. Everything runs in
DataFrame functions.

Template: `<|turn ROLE|>TEXT<|end|>` per message. In ROLE and TEXT the characters `~ < [ |` become
`~0 ~1 ~2 ~3`, so that no control string (`<|end|>`, `</s>`, `[INST]`) survives inside a text, and
the original can be read back exactly.

Defined cases: a null text is empty; a null role is the empty role; a null kind is `message`; an event
without message id is a message of its own; equal sequence numbers are ordered by kind (restarts
first), role and text; repeated rows are repeated turns; a null conversation id is a conversation of its own;
an empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
TURN = r"<\|turn ([^|]*)\|>([^<]*)<\|end\|>"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, message_id, role, text) -> messages(conv_id, position, role, text): one row
    per message; position is the sequence number of its first event, role the first one given."""
    e = events.select(
        F.col("conv_id"),
        F.col("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce(
            F.concat(F.lit("m"), F.col("message_id").cast("string")),
            F.concat(F.lit("e"), F.monotonically_increasing_id().cast("string")),
        ).alias("message"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = e.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("seq", (F.col("kind") == "delta").alias("adds"), "role", "text"))).alias("p")
    )
    restart = F.array_max(F.transform("p", lambda x, i: F.when(x["adds"], F.lit(1)).otherwise(i + 1)))
    return (
        parts.withColumn("at", restart)
        .withColumn("p2", F.slice("p", F.col("at"), F.size("p")))
        .select(
            "conv_id",
            F.col("p")[0]["seq"].alias("position"),
            F.coalesce(F.get(F.filter(F.transform("p", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform("p2", lambda x: x["text"]), "").alias("text"),
            "message",
        )
    )


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """messages(conv_id, position, role, text) -> one row per conversation: formatted string and loss_spans,
    the code-point ranges [start, end) of formatted that training learns from."""
    piece = F.concat(F.lit("<|turn "), escape(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit("<|end|>"))
    order = ["position", "role", "text", "message"]
    m = messages.withColumn("piece", piece).withColumn("n", F.length("piece").cast("long"))
    run = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("stop", F.sum("n").over(run)).withColumn(
        "span",
        F.when(
            F.col("role") == learn_role,
            F.struct(
                (F.col("stop") - F.length(F.lit("<|end|>")) - F.length(escape(F.col("text")))).alias("start"),
                (F.col("stop") - F.length(F.lit("<|end|>"))).alias("end"),
            ),
        ),
    )
    return (
        m.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("stop", "piece"))).alias("p"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
        .select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse formatted and loss_spans again: conv_id, roles, texts, loss_text."""
    f = F.col("formatted")
    return rendered.select(
        "conv_id",
        "formatted",
        F.transform(F.regexp_extract_all(f, F.lit(TURN), F.lit(1)), unescape).alias("roles"),
        F.transform(F.regexp_extract_all(f, F.lit(TURN), F.lit(2)), unescape).alias("texts"),
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
        ).alias("loss_text"),
    )


def format_conversations(events: DataFrame, learn_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), learn_role)

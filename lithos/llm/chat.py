"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
its reply is trainable. A turn is written `<s>role\\ntext</s>\\n`; control strings inside a text get
a backslash after their first character and backslashes are doubled, which `unescaped` undoes.

The turns of a conversation stand in order of (turn, role, text), null turns first. A null role or
text is empty, very long ones are like others, rows that repeat are turns that repeat, a null conv_id
is a conversation of its own. A conversation that doesn't end with a reply has one more row, without a
loss, that holds all of it, so the output always holds every turn. An empty table gives an empty
result. Other columns are ignored. A conversation is one value, so it has 2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text must not contain as it is: the template's marks and those of a common instruction format.
CONTROL = r"\\|<(?=/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
BEGIN, END = "<s>", "</s>\n"


def escaped(text: Column) -> Column:
    """No control string is left in it."""
    return F.regexp_replace(text, f"({CONTROL})", r"$1\\")


def unescaped(text: Column) -> Column:
    """Undoes `escaped`: a pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, …), formatted, loss_start, loss_end (code points of formatted; null
    in the row that only completes a conversation).

    The conversation is rendered once; an example is a prefix of it, cut while rows stream out,
    so that memory grows with a conversation's length and not with its square."""
    head = F.concat(F.lit(BEGIN), F.url_encode(F.col("role")), F.lit("\n"))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"head": head, "body": escaped(F.col("text"))})
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(0).alias("replied"))

    def step(s: Column, t: Column) -> Column:
        a = (s["at"] + F.length(t["head"])).cast("int")
        b = (a + F.length(t["body"])).cast("int")
        reply = t["role"] == "assistant"
        at = (b + len(END)).cast("int")
        return F.struct(
            at.alias("at"),
            F.when(reply, F.concat(s["spans"], F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(s["spans"]).alias("spans"),
            F.when(reply, at).otherwise(s["replied"]).alias("replied"),
        )

    whole = ordered.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("rendered"), F.aggregate("turns", state, step).alias("s"))
    rest = F.when(F.col("s.at") > F.col("s.replied"), F.array(F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    rows = whole.select("conv_id", "rendered", F.posexplode(F.concat("s.spans", rest)).alias("example", "span"))
    end = F.coalesce(F.col("span.b") + len(END), F.length("rendered"))
    return rows.select("conv_id", "example", F.col("rendered").substr(F.lit(1), end).alias("formatted"), F.col("span.a").alias("loss_start"), F.col("span.b").alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns (array of role and text), losses (array of the
    trainable texts), formatted_chars (of all its rows)."""
    loss = unescaped(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.slice(F.split("last", BEGIN), 2, 1 << 30)
    turn = lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
    )
    return per.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")

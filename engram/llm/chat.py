"""Chat formatting by quotation linking, with SQL functions only.

Lines that begin with ">" marks are quotes, as deep as they have marks. Adjacent lines of one
depth form a passage. Every quoted passage is normalised (lower case, single spaces) and
hashed, whole and by line; the hashes are joined to the earliest message of the conversation
that says the same by itself, whole, in one passage or in one line. The message replied to is
the one that the most quoted characters at the lowest depth lead to; it must precede. A
message without a resolved quote starts a thread; the others belong to the thread of the
message they reply to. Ordered by thread and turn, a conversation reads in reply order.

Originals are reduced to one row for each conversation and hash before the join, so a phrase
that a third of all messages share joins as one row.

Defined results: messages are identified by conv_id and turn; of repeated rows with one
identity the first by role and text stays; rows with a null conv_id or turn are returned
without links; null and empty texts have empty content; a quote that no earlier message of
the conversation says is dropped from the content like any other, and counted; of originals
that as many quoted characters lead to, the earliest is the parent; an empty table gives an
empty one; other columns are not looked at. A message may have any number of marks and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Marks of a quoted line, with the blanks before them. No repeated group, which Java would match by recursion.
MARKS = r"^[ \t>]*>"
#: White space of the class \s.
_BLANK = " \t\n\x0b\f\r"
#: Quoted lines of fewer characters do not count as evidence by themselves.
MIN_LINE = 12


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed_lines(text: Column) -> Column:
    """array<struct<d, t>>: depth and text of each line."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("d"),
            F.regexp_replace(line, MARKS, "").alias("t"),
        ),
    )


def own_text(lines: Column) -> Column:
    """The text without quoted lines."""
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["d"] == 0), lambda x: x["t"]), "\n")
    return F.btrim(F.regexp_replace(kept, r"\n{3,}", "\n\n"), F.lit(_BLANK))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, d, kind and text of each line ("line") and of each run of adjacent lines
    of one depth ("passage")."""
    lines = messages.select("conv_id", "turn", F.posexplode("lines").alias("n", "line")).select("conv_id", "turn", "n", F.col("line.d").alias("d"), F.col("line.t").alias("t"))
    # first and last line of each run, found inside the message's array: no window over rows is
    # needed, and each line is looked at a fixed number of times
    number = F.sequence(F.lit(0), F.size("lines") - 1)
    depth = lambda i: F.get("lines", i)["d"]
    firsts = F.filter(number, lambda i: (i == 0) | (depth(i) != depth(i - 1)))
    lasts = F.filter(number, lambda i: (i == F.size("lines") - 1) | (depth(i) != depth(i + 1)))
    folded = F.transform(
        F.arrays_zip(firsts.alias("a"), lasts.alias("z")),
        lambda r: F.struct(depth(r["a"]).alias("d"), F.array_join(F.transform(F.slice("lines", r["a"] + 1, r["z"] - r["a"] + 1), lambda x: x["t"]), "\n").alias("t")),
    )
    runs = messages.where(F.size("lines") > 1).select("conv_id", "turn", F.explode(folded).alias("p")).select("conv_id", "turn", F.col("p.d").alias("d"), F.lit("passage").alias("kind"), F.col("p.t").alias("t"))
    return lines.select("conv_id", "turn", "d", F.lit("line").alias("kind"), "t").unionByName(runs)


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("t", normal(F.col("t"))).where(F.col("t") != "").withColumn("h", F.sha2("t", 256))


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, n_quotes, parent_turn and thread_turn of each message."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = rows.where("conv_id is not null and turn is not null")
    one = named.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    messages = one.withColumn("lines", parsed_lines(F.col("text"))).withColumn("quoting", F.exists("lines", lambda x: x["d"] > 0))
    messages = materialize(spark, messages.drop("text"), "chat-messages")
    quoting = messages.where("quoting")
    # only conversations with a quote need originals
    wanted = _hashed(passages(quoting).where("d > 0")).where((F.col("kind") == "passage") | (F.length("t") >= MIN_LINE)).select("conv_id", "turn", "d", "t", "h").distinct()
    said = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    whole = said.select("conv_id", "turn", own_text(F.col("lines")).alias("t"))
    origin = _hashed(passages(said).where("d = 0").select("conv_id", "turn", "t").unionByName(whole)).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    hits = wanted.join(origin, ["conv_id", "h"]).where(F.col("origin") < F.col("turn"))
    votes = hits.groupBy("conv_id", "turn", "origin").agg(F.min("d").alias("d"), F.sum(F.length("t")).alias("chars"))
    best = votes.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("d", -F.col("chars"), "origin")).alias("parent_turn"))
    best = materialize(spark, best, "chat-parents")
    roots = thread_roots(best)
    counted = quoting.select("conv_id", "turn", F.size(F.filter("lines", lambda x: x["d"] > 0)).cast("long").alias("n_quotes"))
    linked = (
        messages.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("content"))
        .join(counted, ["conv_id", "turn"], "left")
        .join(best, ["conv_id", "turn"], "left")
        .join(roots, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "content", F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), "parent_turn", F.coalesce("root", "turn").alias("thread_turn"))
    )
    loose = rows.where("conv_id is null or turn is null").select(
        "conv_id", "turn", "role", own_text(parsed_lines(F.col("text"))).alias("content"), F.size(F.filter(parsed_lines(F.col("text")), lambda x: x["d"] > 0)).cast("long").alias("n_quotes"),
        F.lit(None).cast(conversations.schema["turn"].dataType).alias("parent_turn"), F.col("turn").alias("thread_turn"),
    )
    return linked.unionByName(loose)


def thread_roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root for every message with a parent, by pointer jumping: each round
    doubles the distance, so a chain of n replies takes log2(n) rounds."""
    spark = parents.sparkSession
    at = parents.select("conv_id", "turn", F.col("parent_turn").alias("root"))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(spark, moved, "chat-roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def format_chat(conversations: DataFrame) -> DataFrame:
    """link() with the message as chat markup; order by conv_id, thread_turn, turn to read."""
    return link(conversations).withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>")))

"""Quotation linking in conversations, with built-in functions only.

Lines that begin with > are quotes, nested as deep as there are such marks.  Each quoted line, normalised and hashed, is
joined to the first message of its conversation that says it itself and comes before.  Messages then hang on the messages
they quote, and lose their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.session import Scratch

MARKS = r"^[ \t]*(?:>[ \t]?)+"


def parsed(text: Column) -> Column:
    """Array of (level, body) of the lines; level 0 is the message's own."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARKS, "").alias("body")))


def passage_key(body: Column) -> Column:
    """A hash of the line without case, marks and extra space; null where nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.xxhash64(plain, F.length(plain)))


def own_text(lines: Column) -> Column:
    """The message without its quotes, and without the blank lines that they leave at its ends."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(own, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")


def linked(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text (own), quotes, linked, reply_to, root, depth, reply_path for every row of messages.

    ``reply_to`` is the turn quoted at the lowest level that links, the latest if there are several; messages that link
    with none begin a thread.  ``reply_path`` holds the turns from the thread's first message to this one: ordered by
    (conv_id, reply_path) a conversation reads with each reply behind what it answers.  A line said by several messages
    is the first one's.  Null texts are empty messages; rows with a null conv_id or turn link with nothing; rows that
    repeat a (conv_id, turn) are all returned, with the same links.  Other columns aren't read.  No rows: an empty result.

    Joins are on (conversation, hash) and (conversation, turn), one row for each on the side that is looked up, so a long
    conversation or a line that all repeat is no hot group.
    """
    rows = scratch.save(messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        parsed(F.col("text")).alias("lines")), "lines")
    keyed = rows.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.inline("lines")).select("conv_id", "turn", "level", passage_key(F.col("body")).alias("key"))
    keyed = keyed.where("key is not null")
    quoted = keyed.where("level > 0").distinct()
    said = keyed.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    links = quoted.join(said, ["conv_id", "key"]).where("source < turn")
    answers = links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("linked"), F.max(F.struct(-F.col("level"), "source")).alias("near")).select(
        "conv_id", "turn", "linked", F.col("near.source").alias("reply_to"))
    answers = scratch.save(answers, "answers")

    # paths by doubling: each round every path takes in the path of the message it begins with
    paths = scratch.save(answers.select(
        "conv_id", "turn", F.col("reply_to").alias("head"), F.array("reply_to", "turn").alias("path")), "paths-0")
    step = 0
    while True:
        ahead = paths.select("conv_id", F.col("turn").alias("head"), F.col("head").alias("further"), F.col("path").alias("before"))
        longer = paths.join(ahead, ["conv_id", "head"], "left")
        if longer.where("further is not null").isEmpty():
            break
        step += 1
        paths = scratch.save(longer.select(
            "conv_id", "turn", F.coalesce("further", "head").alias("head"),
            F.when(F.col("further").isNull(), F.col("path")).otherwise(
                F.concat(F.slice("before", F.lit(1), F.size("before") - 1), "path")).alias("path")), f"paths-{step}")

    out = rows.join(answers, ["conv_id", "turn"], "left").join(
        paths.select("conv_id", "turn", "path"), ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select(
        "conv_id", "turn", "role", own_text(F.col("lines")).alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "reply_to",
        F.element_at(path, 1).alias("root"), (F.size(path) - 1).cast("long").alias("depth"), path.alias("reply_path"))

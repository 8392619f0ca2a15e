"""Conversations rebuilt from quoted replies, by DataFrame functions alone.

Each message is parsed into lines with a quote level. Lines of level 0 are the
body. Consecutive quoted lines of one level, up to a blank one, are a passage,
which is normalised and hashed. An index of the paragraphs and lines of all
bodies, reduced to the earliest message for each hash, is joined to the
passages, so that no passage meets more than one original; a passage that is
no whole paragraph of a message is looked up line by line. What lies at the
lowest quote level votes, by its lines, for the message that is answered. A
message that quotes nothing known answers the one before it in its thread.

Threads are hints: with a thread, originals are looked for there first, then
everywhere; without one, everywhere. Only messages of lower order are
originals, so replies never form a circle. Threads whose first message answers
another thread belong to that one's conversation. `transcripts` joins the
bodies of a conversation in reply order, some hundreds of messages a row.

Defined results: null text has an empty body; a message that is only quotes
has an empty body; equal passages belong to the earliest message (then the
least id); rows with equal thread and order are put in order of id; a message
without an order is an original for none and comes first; an empty table gives
an empty result; columns other than thread, ord, id, role and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

MARK = r"^\s*>"
PREFIX = r"^(\s*>)+ ?"
#: Lines that introduce a quotation, dropped when a quoted line follows.
INTRO = r"(?i)(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
#: Orders of a thread that are numbered together; bounds a window in a hot thread.
BLOCK = 1024
#: Rounds of doubling for threads that answer threads: chains of 2 ** 40 threads.
ROUNDS = 40


def parsed(text: Column) -> Column:
    """array<struct<level, line, intro>> of a text's lines."""
    rows = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(
        rows,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, PREFIX, "").alias("line"),
        ),
    )


def body(lines: Column) -> Column:
    """The text of level 0, without introductions of quotations and without blank ends."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(F.regexp_like(x["line"], F.lit(INTRO)) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))),
    )
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    # Blank ends go only where quotes were cut off; a text without quotes stays as it is.
    return F.when(F.exists(lines, lambda x: x["level"] > 0), F.regexp_replace(text, r"^(\s*\n)+|(\n\s*)+$", "")).otherwise(text)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def passages(lines: Column) -> Column:
    """array<struct<level, rows>> of the quoted passages: runs of lines of one level between blank ones."""
    keys = F.transform(lines, lambda x: F.when(normal(x["line"]) != "", x["level"]).otherwise(0))

    def runs(key: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(key) - 1)
        changes = F.filter(places, lambda i: (i == 0) | (F.get(key, i) != F.get(key, i - 1)))
        cut = lambda at: F.transform(
            at,
            lambda i, k: F.struct(
                F.get(key, i).alias("level"),
                F.transform(F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(key)) - i), lambda x: x["line"]).alias("rows"),
            ),
        )
        return bound(changes, cut)

    return F.filter(bound(keys, runs), lambda r: r["level"] > 0)


def known_units(messages: DataFrame) -> DataFrame:
    """thread, ord, id, hash of every paragraph and line of the bodies."""
    paragraphs = F.split("body", r"\n\s*\n", -1)
    lines = F.split("body", "\n", -1)
    units = F.array_distinct(F.filter(F.transform(F.concat(paragraphs, lines), normal), lambda x: x != ""))
    return messages.select("thread", "ord", "id", F.explode(F.transform(units, lambda x: F.xxhash64(x))).alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """id, parent, parent_thread, n_quoted, n_linked (lines) of messages that quote.

    messages: thread, ord, id, body and runs (passages, or null without any).
    """
    own = known_units(messages.filter("ord is not null"))
    local = (
        own.filter("thread is not null")
        .groupBy("thread", "hash")
        .agg(F.min(F.struct("ord", "id")).alias("first"))
        .select(F.col("thread").alias("t"), F.col("hash").alias("h"), F.col("first").alias("local"))
    )
    world = own.groupBy("hash").agg(F.min(F.struct("ord", "id", "thread")).alias("world")).withColumnRenamed("hash", "g")
    quoted = messages.filter("runs is not null").select("thread", "ord", "id", F.posexplode("runs").alias("run", "x")).select("thread", "ord", "id", "run", "x.level", "x.rows")
    # A passage as a whole, and its lines if it has several.
    unit = lambda kind, n, text: F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.xxhash64(normal(text)).alias("hash"))
    whole = F.array(unit(2, F.size("rows"), F.array_join("rows", "\n")))
    parts = F.transform(F.filter("rows", lambda x: F.size("rows") > 1), lambda x: unit(1, F.lit(1), x))
    quoted = quoted.select("thread", "ord", "id", "run", "level", F.explode(F.concat(whole, parts)).alias("u")).select(
        "thread", "ord", "id", "run", "level", "u.kind", "u.n", "u.hash"
    )
    found = quoted.join(local, (F.col("thread") == F.col("t")) & (F.col("hash") == F.col("h")), "left").join(
        world, F.col("hash") == F.col("g"), "left"
    )
    known = (
        F.when(F.col("local.ord") < F.col("ord"), F.struct("local.ord", "local.id", F.col("thread").alias("thread")))
        .when(F.col("world.ord") < F.col("ord"), F.struct("world.ord", "world.id", F.col("world.thread").alias("thread")))
        .alias("of")
    )
    each = found.select("id", "run", "level", "kind", "n", known).groupBy("id", "run", "level", "kind", "of").agg(F.sum("n").alias("n"))
    # One row for each passage; its lines count only where the whole is unknown.
    whole_of, whole_n = (F.max(F.when(F.col("kind") == 2, F.col(c))) for c in ("of", "n"))
    line_votes = F.collect_list(F.when((F.col("kind") == 1) & F.col("of").isNotNull(), F.struct("of", "n")))
    runs = each.groupBy("id", "run", "level").agg(whole_of.alias("of"), whole_n.alias("n"), line_votes.alias("votes"))
    none = F.array(F.struct(F.col("of"), F.col("n")))
    runs = runs.select("id", "level", "n", F.when(F.col("of").isNotNull(), none).otherwise(F.col("votes")).alias("votes"))
    votes = runs.select("id", "level", F.explode("votes").alias("v")).groupBy("id", "level", "v.of").agg(F.sum("v.n").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct(-F.col("level"), F.col("n"), F.col("of"))).alias("best"), F.sum("n").alias("n_linked"))
    total = runs.groupBy("id").agg(F.sum("n").alias("n_quoted"))
    return total.join(best, "id", "left").select(
        "id", F.col("best.of.id").alias("parent"), F.col("best.of.thread").alias("parent_thread"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )


def roots(edges: DataFrame) -> DataFrame:
    """thread, root for edges (thread, up), by doubling; each thread has one edge at most."""
    state = materialise(edges.select("thread", F.col("up").alias("root")), "quote-roots")
    for _ in range(ROUNDS):
        above = state.select(F.col("thread").alias("a"), F.col("root").alias("b"))
        moved = state.join(above, F.col("root") == F.col("a"), "left")
        if moved.filter("b is not null").isEmpty():
            break
        state = materialise(moved.select("thread", F.coalesce("b", "root").alias("root")), "quote-roots")
    return state


def blocks_before(rows: DataFrame, key: str) -> DataFrame:
    """bt, bb, before, last: of each block of a key's order, the rows of earlier blocks and the last of them.

    Numbers within blocks of the order, then the blocks' running totals: a hot key is many small windows.
    """
    blocks = rows.groupBy(key, "block").agg(F.count("*").alias("size"), F.max(F.struct("ord", "id"))["id"].alias("end"))
    whole = Window.partitionBy(key).orderBy("block")
    return blocks.select(
        F.col(key).alias("bt"),
        F.col("block").alias("bb"),
        F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("end").over(whole).alias("last"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """conversation, thread, ord, id, role, position, parent, n_quoted, n_linked, body.

    messages: thread (bigint or null), ord (bigint), id (string, unique), text, and role if there is one.
    position numbers the messages of a conversation, which come after what they answer.
    """
    role = F.col("role").cast("string") if "role" in messages.columns else F.lit(None).cast("string")
    own = messages.select("thread", "ord", "id", role.alias("role"), parsed(F.col("text")).alias("lines"))
    runs = F.when(F.exists("lines", lambda x: x["level"] > 0), passages(F.col("lines")))
    # Written once, as bodies are read for two indexes and for the result.
    own = materialise(own.select("thread", "ord", "id", "role", body(F.col("lines")).alias("body"), runs.alias("runs")), "quote-lines")
    linked = links(own)
    rows = own.select("thread", "ord", "id", "role", "body").join(linked, "id", "left")
    rows = rows.withColumn("block", F.floor(F.coalesce("ord", F.lit(0)) / BLOCK))
    part = Window.partitionBy("thread", "block").orderBy("ord", "id")
    blocks = blocks_before(rows.filter("thread is not null"), "thread")
    hinted = rows.filter("thread is not null").select(
        "*", F.row_number().over(part).alias("nth"), F.lag("id").over(part).alias("prev")
    )
    hinted = hinted.join(blocks, (F.col("thread") == F.col("bt")) & (F.col("block") == F.col("bb"))).select(
        "thread", "block", "ord", "id", "role", "body", "n_quoted", "n_linked", "parent", "parent_thread",
        (F.col("before") + F.col("nth")).alias("place"), F.coalesce("prev", "last").alias("prev"),
    )
    loose = rows.filter("thread is null").select(
        "thread", "block", "ord", "id", "role", "body", "n_quoted", "n_linked", "parent", "parent_thread",
        F.lit(1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("prev"),
    )
    every = materialise(hinted.unionByName(loose), "quote-places")
    # A thread's first message, or a message without a thread, may answer another thread.
    node = F.coalesce(F.concat(F.lit("t"), F.col("thread")), F.concat(F.lit("m"), F.col("id")))
    above = F.coalesce(F.concat(F.lit("t"), F.col("parent_thread")), F.concat(F.lit("m"), F.col("parent")))
    edges = every.filter((F.col("place") == 1) & F.col("parent").isNotNull()).select(node.alias("thread"), above.alias("up"))
    tops = roots(edges.filter(F.col("thread") != F.col("up"))).select(F.col("thread").alias("node"), "root")
    found = every.join(tops, node == F.col("node"), "left").withColumn("conversation", F.coalesce("root", node))
    # Positions are given once the roots are known, in the same order, over all threads of a conversation.
    blocks = blocks_before(found, "conversation")
    part = Window.partitionBy("conversation", "block").orderBy("ord", "id")
    found = found.withColumn("nth", F.row_number().over(part))
    return found.join(blocks, (F.col("conversation") == F.col("bt")) & (F.col("block") == F.col("bb"))).select(
        "conversation", "thread", "ord", "id", "role", (F.col("before") + F.col("nth")).alias("position"),
        F.coalesce("parent", "prev").alias("parent"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "body",
    )


def transcripts(found: DataFrame, rows: int = 256) -> DataFrame:
    """conversation, part, first, last, text: the bodies in reply order, each after its role, `rows` messages to a part.

    found: the result of `conversations`. No row holds more than a part, however long a conversation is.
    """
    said = F.concat(F.coalesce(F.concat("role", F.lit(": ")), F.lit("")), "body")
    part = F.floor((F.col("position") - 1) / rows)
    each = found.filter("body <> ''").groupBy("conversation", part.alias("part")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.array_sort(F.collect_list(F.struct("position", said.alias("said")))).alias("all")
    )
    return each.select("conversation", "part", "first", "last", F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("text"))

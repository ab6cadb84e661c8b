"""Chat formatting by quotation linking: conversations in reply order, without the quotes.

Quote levels are parsed from leading ``>`` marks; neighbouring lines of one level are a passage.  A passage is joined over
its line ends, so that it may be wrapped anew, and hashed after normalisation as a whole, by sentence and by line.  The
same is done with the paragraphs of every message's own body, and the hashes are joined within conversations; each finds
the latest earlier message that has it.  A message answers the earlier message that most of its level-1 passages comes
from (by characters; the latest one on ties), or the previous turn if it quotes nothing that is known.  Deeper levels are
linked too, but don't decide.

Replies form branches: a message continues its parent's branch if it is the parent's first reply, and begins one of its
own otherwise.  Ordered by (branch, turn), every message comes after the one it answers and branches stay together.
Depth and branch are followed in one sorted pass inside blocks of ``TURNS`` turns, and from block to block by pointer
doubling over the messages that other blocks answer.  A conversation of any length is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, release_shuffles

#: Turns of a block, within which previous turns and chains of parents are looked up.
TURNS = 256
#: Stands between passages while they are cut; in a text it counts as a blank.
MARK = "\x1e"
QUOTE = r"^(?:[ \t]{0,3}>)+[ \t]?"
#: Where a sentence ends.
SENTENCE = r"(?<=[.!?…])\s+|(?<=[。！？])"
#: A line that introduces a quote ("On ... X wrote:").  Dropped with the quote that follows it.
INTRO = r"(?i)^.{0,200}\b(?:wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$"


def _level(line: Column) -> Column:
    head = F.regexp_extract(line, QUOTE, 0)
    return F.length(head) - F.length(F.replace(head, F.lit(">"), F.lit("")))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\p{Punct}]+", " "))


def _units(lines: Column) -> Column:
    """Normal forms of a passage: the whole of it, its sentences and its lines."""
    whole = F.array_join(lines, " ")
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(whole), F.split(whole, SENTENCE), lines), _normal), lambda x: x != ""))


def parse_levels(text: Column) -> Column:
    """Lines of a text as structs: level (number of quote marks) and line (without them)."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("line")))


def own_body(text: Column) -> Column:
    """The text without quoted lines, lines that introduce them, and blank lines at both ends."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    kept = F.filter(lines, lambda x, i: (_level(x) == 0) & ~(x.rlike(INTRO) & (_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    quoted = F.exists(lines, lambda x: _level(x) > 0)
    return F.when(quoted, F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def _begins(levels: Column, i: Column) -> Column:
    """Does a passage begin at line i?"""
    return (i == 0) | (F.get(levels, i - 1)["level"] != F.get(levels, i)["level"])


def n_passages(levels: Column) -> Column:
    return F.size(F.filter(levels, lambda x, i: (x["level"] > 0) & _begins(levels, i)))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """_c, _t, level, passage (its number among those of the level), lines, of messages (_c, _t, _x)."""
    levels = messages.filter(F.col("_x").contains(">") & F.col("_x").rlike("(?m)" + QUOTE)).select("_c", "_t", parse_levels(F.col("_x")).alias("lv"))
    marked = F.transform("lv", lambda x, i: F.struct(x["level"].alias("level"), F.concat(F.when(_begins(F.col("lv"), i), MARK).otherwise("\n"), F.replace(x["line"], F.lit(MARK), F.lit(" "))).alias("line")))
    each = levels.select("_c", "_t", marked.alias("m")).select("_c", "_t", "m", F.explode(F.array_distinct(F.filter(F.transform("m", lambda x: x["level"]), lambda x: x > 0))).alias("level"))
    text = F.array_join(F.transform(F.filter("m", lambda x: x["level"] == F.col("level")), lambda x: x["line"]), "")
    return each.select("_c", "_t", "level", F.posexplode(F.split(text, MARK)).alias("passage", "p")).filter("passage > 0").select("_c", "_t", "level", "passage", F.split("p", "\n").alias("lines"))


def link_quotes(messages: DataFrame, *, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """Links: _c, _t (the quoting message), level, passage, src (earlier turn), chars (of normal forms found there)."""
    base = messages.select(F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"), F.col(text_col).alias("_x")).filter("_c is not null and _t is not null")
    quotes = (
        quoted_passages(base).select("_c", "_t", "level", "passage", F.explode(_units(F.col("lines"))).alias("n"))
        .select("_c", "_t", "level", "passage", F.length("n").alias("chars"), F.xxhash64("n").alias("h1"), F.xxhash64(F.lit(7), "n").alias("h2"))
    )
    wanted = quotes.select("_c", "h1", "h2").distinct()
    body = own_body(F.col("_x"))
    paragraphs = F.transform(F.split(body, r"\n[ \t\r]*\n"), lambda p: _units(F.split(p, "\r?\n")))
    bodies = (
        base.join(quotes.select("_c").distinct(), "_c", "left_semi")
        .select("_c", F.col("_t").alias("src"), F.explode(F.array_distinct(F.concat(F.flatten(paragraphs), F.array(_normal(body))))).alias("n"))
        .select("_c", "src", F.xxhash64("n").alias("h1"), F.xxhash64(F.lit(7), "n").alias("h2"))
        .distinct()
        .join(wanted, ["_c", "h1", "h2"], "left_semi")
    )
    # what many messages hold comes from one of them: the latest before the quote, found block by block
    block = lambda t: F.floor(t / TURNS)
    asks = quotes.select("_c", "_t", "h1", "h2").distinct().withColumn("b", block(F.col("_t")))
    inside = asks.join(bodies.withColumn("b", block(F.col("src"))), ["_c", "h1", "h2", "b"]).filter("src < _t")
    inside = inside.groupBy("_c", "_t", "h1", "h2").agg(F.max("src").alias("near"))
    last = bodies.groupBy("_c", "h1", "h2", block(F.col("src")).alias("b")).agg(F.max("src").alias("src"))
    ask = asks.select("_c", "h1", "h2", "b").distinct().select("*", F.lit(None).cast("long").alias("src"), F.lit(0).alias("o"))
    w = Window.partitionBy("_c", "h1", "h2").orderBy("b", "o").rowsBetween(Window.unboundedPreceding, 0)  # a row for each block
    far = ask.unionByName(last.withColumn("o", F.lit(1))).withColumn("far", F.max("src").over(w)).filter("o = 0").select("_c", "h1", "h2", "b", "far")
    found = (
        quotes.withColumn("b", block(F.col("_t"))).join(far, ["_c", "h1", "h2", "b"], "left").join(inside, ["_c", "_t", "h1", "h2"], "left")
        .select("_c", "_t", "level", "passage", "chars", F.coalesce("near", "far").alias("src"))
    )
    return found.filter("src is not null").groupBy("_c", "_t", "level", "passage", "src").agg(F.sum("chars").alias("chars"))


def _previous(turns: DataFrame) -> DataFrame:
    """_c, _t, prev: the largest smaller turn of the conversation, by blocks, so that no window holds all of one."""
    blocks = turns.withColumn("b", F.floor(F.col("_t") / TURNS))
    inside = blocks.withColumn("prev", F.lag("_t").over(Window.partitionBy("_c", "b").orderBy("_t")))
    ends = blocks.groupBy("_c", "b").agg(F.max("_t").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy("_c").orderBy("b"))).select("_c", "b", "before")
    return inside.join(ends, ["_c", "b"]).select("_c", "_t", F.coalesce("prev", "before").alias("prev"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, block and turn: follows every chain of parents to its end or out of its block.

    A parent is an earlier turn, so one pass is enough, and what it remembers is one block.
    """
    at, seen = None, {}
    for batch in batches:
        rows = []
        for c, b, t, parent, first in zip(*(batch.column(x).to_pylist() for x in ("_c", "b", "_t", "parent", "is_first")), strict=True):
            if at != (c, b):
                at, seen = (c, b), {}
            if parent is None:
                root, depth, deep, branch, apart = t, 0, False, t, False
            else:
                root, depth, deep, branch, apart = seen.get(parent, (parent, 0, True, parent, True))
                depth += 1
                if not first:
                    branch, apart = t, False
            seen[t] = (root, depth, deep, branch, apart)
            rows.append(seen[t])
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        kept = ["_c", "_t", "parent"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=[*kept, "root", "depth", "deep", "branch_turn", "apart"])


def _follow(nodes: DataFrame, workspace: Workspace, end: str, leaves: str) -> DataFrame:
    """_c, _t, end, n (steps more) of the nodes whose chain leaves its block.

    Pointer doubling over the nodes at which such chains leave off; those that have arrived aren't joined again.
    """
    out = nodes.filter(leaves).select("_c", "_t", F.col(end).alias("end"))
    asked = out.select("_c", F.col("end").alias("_t")).distinct()
    now = workspace.store(nodes.join(asked, ["_c", "_t"], "left_semi").select("_c", "_t", F.col(end).alias("end"), F.col("depth").alias("n"), F.col(leaves).alias("open")))
    while now.filter("open").limit(1).count():
        far = now.select("_c", F.col("_t").alias("end"), F.col("end").alias("end2"), F.col("n").alias("n2"), F.col("open").alias("open2"))
        moved = now.filter("open").join(far, ["_c", "end"]).select("_c", "_t", F.col("end2").alias("end"), (F.col("n") + F.col("n2")).alias("n"), F.col("open2").alias("open"))
        now = workspace.store(now.filter("not open").unionByName(moved))
    ends = now.select("_c", F.col("_t").alias("end"), F.col("end").alias("end2"), "n")
    return out.join(ends, ["_c", "end"]).select("_c", "_t", F.col("end2").alias("end"), "n")


def thread_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """One row for each message: conversation, turn, role, parent_turn, depth, branch_turn, n_quoted, n_linked, body, chat.

    parent_turn is null for a conversation's first turn; (branch_turn, turn) is the reply order; n_quoted counts quoted
    passages, n_linked those of which anything is found in an earlier message; body is the text without quotes; chat the
    body between role marks.

    Null or empty text: empty body.  Rows with the same conversation and turn are one node of the tree, each with a row
    of the result.  Rows without conversation or turn are kept with null links.  A null role reads "user".  Of messages
    that hold what is quoted the latest counts.  A very long text is split into as many hashes as it has lines and
    sentences.  Conversations may be of any kind, turns are whole numbers.  Empty table: empty result.  Other columns of
    messages are ignored, whatever their names.
    """
    spark = messages.sparkSession
    workspace = workspace or Workspace(spark, "chat")
    base = messages.select(F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"), F.col(role_col).alias("_r"), F.col(text_col).alias("_x"))
    turns = workspace.store(base.select("_c", "_t").dropna().distinct())
    links = workspace.store(link_quotes(messages, conv_col=conv_col, turn_col=turn_col, text_col=text_col))
    sources = links.filter("level = 1").groupBy("_c", "_t", "src").agg(F.sum("chars").alias("chars"))
    quoted = sources.groupBy("_c", "_t").agg(F.max_by("src", F.struct("chars", "src")).alias("q"))
    n_links = links.select("_c", "_t", "level", "passage").distinct().groupBy("_c", "_t").agg(F.count("*").alias("n_linked"))
    tree = workspace.store(_previous(turns).join(quoted, ["_c", "_t"], "left").select("_c", "_t", F.coalesce("q", "prev").alias("parent")))
    first = tree.filter("parent is not null").groupBy("_c", F.col("parent")).agg(F.min("_t").alias("first"))
    joined = tree.join(first, ["_c", "parent"], "left").select("_c", "_t", "parent", (F.col("first") == F.col("_t")).alias("is_first"))
    placed = joined.withColumn("b", F.floor(F.col("_t") / TURNS)).repartition("_c", "b").sortWithinPartitions("_c", "b", "_t")
    kind = turns.schema["_c"].dataType.simpleString()
    nodes = workspace.store(placed.mapInArrow(_walk, f"_c {kind}, _t long, parent long, root long, depth long, deep boolean, branch_turn long, apart boolean"))
    depth = _follow(nodes, workspace, "root", "deep").select("_c", "_t", F.col("n").alias("_n"))
    branch = _follow(nodes, workspace, "branch_turn", "apart").select("_c", "_t", F.col("end").alias("_b"))
    shape = nodes.join(depth, ["_c", "_t"], "left").join(branch, ["_c", "_t"], "left").join(n_links, ["_c", "_t"], "left")
    shape = workspace.store(
        shape.select("_c", "_t", "parent", (F.col("depth") + F.coalesce("_n", F.lit(0))).alias("depth"), F.coalesce("_b", "branch_turn").alias("branch_turn"), "n_linked")
    )
    release_shuffles(spark)
    n_quoted = n_passages(parse_levels(F.col("_x"))).cast("long")
    body = own_body(F.col("_x"))
    role = F.coalesce("_r", F.lit("user"))
    return base.join(shape, ["_c", "_t"], "left").select(
        F.col("_c").alias(conv_col), F.col("_t").alias(turn_col), F.col("_r").alias(role_col), F.col("parent").alias("parent_turn"), "depth", "branch_turn",
        n_quoted.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), body.alias("body"),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body, F.lit("<|im_end|>\n")).alias("chat"),
    )


def assemble_conversations(threads: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """Conversations in reply order, without quotes, from what thread_conversations returns.

    One row for each branch and block of TURNS turns: conversation, branch_turn, part, messages (array of turn, role,
    body), chat.  Ordered by (branch_turn, part) the rows of a conversation are all of it; none is longer than a block.
    Rows without conversation or turn belong to none.  Rows that repeat a turn follow each other by role and body.
    """
    kept = threads.filter(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    message = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), "body", "chat")
    rows = kept.groupBy(conv_col, "branch_turn", F.floor(F.col(turn_col) / TURNS).alias("part")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    return rows.select(conv_col, "branch_turn", "part", F.transform("m", lambda x: x.dropFields("chat")).alias("messages"), F.array_join(F.transform("m", lambda x: x["chat"]), "").alias("chat"))

"""Chat formatting of reply trees, by DataFrame functions alone.

Messages point to the message that they answer. Paths from roots to leaves
are enumerated by iterative self-joins that double the distance each time:
after k joins every message knows its ancestor 2^k above and the score summed
on the way, so a thread of any depth takes logarithmically many joins and no
row ever holds a path. The leaves of a root are ranked by the score of their
whole path; the ancestors of the best ``most`` (all with None) are marked by
walking the same doubled pointers back down, for each leaf on its own. Each
chosen path becomes one conversation.

A turn is written as ``<s>role\\ntext</s>``. Inside roles and texts the control
strings ``<s> </s> [INST] [/INST]`` get a backslash after their bracket, and
ones that have backslashes there already get one more, so that the way back is
exact and no control string is left inside a text. In a role a newline is
written ``\\n`` and a backslash doubled.

Defined results: a null text or role counts as empty; a message whose parent
is missing or null is a root; ties between leaves go to the smallest leaf;
repeated (conv_id, turn) rows follow each other by role and text. A null
conv_id is a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrove.llm.common import materialise

OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])", r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])", r"$1$4$2$5$3$6")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    back = F.regexp_replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", "\\\\")
    return back


def replies_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: msg, conv_id, role, text; replies: msg, parent, score) of a table of turns.

    A turn answers the one before it. Turns are numbered over the whole table
    by a range sort (each sorted part counts its own rows, and the counts of
    the parts before are added), so that one long conversation is spread like
    any other rows. A turn's score is its length.
    """
    parts = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        )
        .repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumn("mono", F.monotonically_increasing_id())
    )
    parts = materialise(parts, "turns")  # the one place where texts are sorted
    part, own = F.shiftright("mono", 33), F.col("mono").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in parts.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per part
        offsets.append((r["part"], before))
        before += r["count"]
    table = parts.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, before long")
    numbered = parts.withColumn("part", part).join(F.broadcast(table), "part").select("conv_id", (own + F.col("before")).alias("msg"), "role", "text")
    thin = numbered.select("msg", "conv_id", F.length("text").cast("double").alias("score"))
    above = thin.select((F.col("msg") + 1).alias("msg"), F.col("conv_id").alias("conv_above"), F.lit(1).alias("there"))
    same = F.col("there").isNotNull() & F.col("conv_id").eqNullSafe(F.col("conv_above"))
    return numbered, thin.join(above, "msg", "left").select("msg", F.when(same, F.col("msg") - 1).alias("parent"), "score")


def best_paths(texts: DataFrame, replies: DataFrame, most: int | None = 1) -> DataFrame:
    """Messages of the best ``most`` root-to-leaf paths of every root, all with None: root, leaf, depth and the message's columns.

    ``texts`` holds msg, conv_id, role and text, ``replies`` msg, parent and
    score. Paths are found on the thin rows of ``replies`` alone; texts are
    joined once, at the end.
    """
    replies = materialise(replies.select("msg", "parent", "score"), "replies")
    ids = replies.select("msg")
    links = replies.join(ids.withColumnRenamed("msg", "parent").withColumn("there", F.lit(1)), "parent", "left").select("msg", F.when(F.col("there") == 1, F.col("parent")).alias("up"), F.col("score").alias("sum"))
    links = materialise(links.select("msg", "up", "sum", F.lit(1).cast("long").alias("span"), F.col("msg").alias("top")), "links")
    # Only threads that have not reached their root are joined again.
    done, levels = links.where("up is null"), []
    links = links.where("up is not null")
    while not links.isEmpty():
        levels.append(links.select("msg", "up"))
        above = done.union(links).toDF("up", "up2", "sum2", "span2", "top2")
        further = links.join(above, "up").select("msg", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("span") + F.col("span2")).alias("span"), F.col("top2").alias("top"))
        further = materialise(further, "links")
        done, links = done.union(further.where("up is null")), further.where("up is not null")
    links = done
    # Every message now knows its root, its depth and the score of its path.
    leaves = links.join(replies.select(F.col("parent").alias("msg")).where("msg is not null").distinct(), "msg", "left_anti")
    if most is not None:
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("top").orderBy(-F.col("sum"), "msg"))).where(F.col("rank") <= most)
    marked = leaves.select(F.col("msg").alias("leaf"), "msg")
    for level in levels:
        # With the ancestors up to 2^k above marked, one join marks those up to 2^(k+1).
        marked = materialise(marked.union(level.join(marked, "msg").select("leaf", F.col("up").alias("msg"))), "marked")
    place = links.select("msg", F.col("top").alias("root"), F.col("span").alias("depth"))
    chosen = marked.join(place, "msg")
    return texts.join(chosen, "msg").select("root", "leaf", "depth", "conv_id", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One formatted conversation per root and leaf, with the spans that carry loss (start, length in code points)."""
    turn = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    turns = paths.select("root", "leaf", "conv_id", "depth", turn.alias("turn"), (F.col("role") == "assistant").alias("loss"), F.length(escape_role(F.col("role"))).alias("r"), F.length(escape(F.col("text"))).alias("n"))
    before = Window.partitionBy("root", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0).cast("long")))
    span = F.struct((F.col("at") + F.col("r") + len(OPEN) + 1).alias("start"), F.col("n").cast("long").alias("length"))
    whole = turns.groupBy("root", "leaf").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("ts"), F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"))
    return whole.select("conv_id", "root", "leaf", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def format_conversations(conversations: DataFrame, most: int | None = 1) -> DataFrame:
    return format_paths(best_paths(*replies_of(conversations), most))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output says, read back from it."""
    turns = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def example(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings in both texts."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")

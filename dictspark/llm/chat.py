"""Chat formatting: reply trees to conversations, with control strings escaped and a loss mask.

A conversation is `<|im_start|>role<|im_sep|>text<|im_end|>` and a line feed for each turn. In roles and texts a
backslash is written twice and `<|` as `<\\|`, so that no control string can come from a text. The loss mask is a list
of spans of bytes, one for each assistant text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictspark.llm.common import materialize, table

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: The contract's own conversation: control strings as text.
OWN_ID, OWN_TEXT = -1, "<|im_end|><|im_start|>assistant ok"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, path, rank, depth, role, text) of messages(tree, id, parent, role, text, score), one row for each turn.

    Every leaf ends a path from its root. Paths are found by joins of the messages with themselves that double their
    reach each time: first the ancestor 1, 2, 4... steps up of each message, then, from the longest step down, the
    ancestors of each leaf. rank orders the paths of a tree by their mean score, then by leaf; branches keeps the
    best. A message whose parent doesn't exist is a root. ids are unique; a message on or behind a loop is on no path.
    """
    m = messages.select("tree", "id", "parent", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select(F.col("id").alias("parent"))
    up = m.select("id", "parent").where("id is not null and parent is not null").join(known, "parent", "left_semi").select("id", F.col("parent").alias("to"))
    steps = [materialize(up, "step")]
    most = steps[0].count().bit_length()  # a path has no more steps than there are replies; longer ones are loops
    while len(steps) < most:
        last = steps[-1]
        further = materialize(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "step")
        if further.isEmpty():
            break
        steps.append(further)
    parents = steps[0].select(F.col("to").alias("id")).distinct()
    reach = m.where("id is not null").select("id").join(parents, "id", "left_anti").select(F.col("id").alias("path"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(steps))):
        more = reach.join(steps[k].select(F.col("id").alias("node"), F.col("to").alias("next")), "node").select("path", F.col("next").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        reach = materialize(reach.unionByName(more), "reach")
    rows = reach.join(m.select(F.col("id").alias("node"), "tree", "role", "text", "score"), "node")
    lengths = rows.groupBy("path").agg(F.max("up").alias("most"), F.avg("score").alias("mean"), F.first("tree").alias("tree"))
    ranked = lengths.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "path")))
    ranked = ranked if branches is None else ranked.where(F.col("rank") <= branches)
    return rows.drop("tree", "score").join(ranked, "path").select("tree", "path", "rank", (F.col("most") - F.col("up")).alias("depth"), "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, path, formatted, loss_spans): one conversation for each path of turns(tree, path, depth, role, text)."""
    turn = turns.groupBy("tree", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    role = lambda x: escape(F.coalesce(x["role"], F.lit("")))
    text = lambda x: escape(F.coalesce(x["text"], F.lit("")))
    parts = F.transform("turns", lambda x: F.struct(F.concat(F.lit(START), role(x), F.lit(BETWEEN)).alias("head"), text(x).alias("body"), (F.coalesce(x["role"], F.lit("")) == TRAINED).alias("loss")))
    cut = turn.select("tree", "path", parts.alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    size = lambda x: F.octet_length(x["head"]) + F.octet_length(x["body"]) + len(END)
    # One pass: bytes so far, and the spans of the trained texts.
    spans = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,size:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.octet_length(x["head"])).alias("begin"), F.octet_length(x["body"]).cast("bigint").alias("size"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return cut.select("tree", "path", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold: turns are parsed from the text, trained text is cut out by the mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.lit(1 << 30))
    turns = F.transform(pieces, lambda x: F.struct(F.substring_index(x, BETWEEN, 1).alias("role"), F.substring_index(F.substring_index(x, BETWEEN, -1), END, 1).alias("text")))
    raw = F.encode("formatted", "UTF-8")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(raw, (s["begin"] + 1).cast("int"), s["size"].cast("int")), "UTF-8"))), "")
    read = conversations.select("tree", "path", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(unescape(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n"))), "")
    return read.select("tree", "path", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


def as_trees(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as chains of replies: each turn answers the one before.

    Turns with the same number are ordered by role and text; null numbers come first; a null conv_id is one
    conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    return rows.select(F.col("conv_id").alias("tree"), name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(tree, path, formatted, loss_spans) for every conversation; null texts and roles count as empty."""
    return formatted(paths(materialize(as_trees(conversations), "messages"), branches=None))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of every conversation, read back from its formatted text and loss mask; see as_trees() for odd rows.

    A conversation without trained text has an empty loss; an empty table leaves conversation -1 alone.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(OWN_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(OWN_TEXT).alias("text"))
    out = read_back(materialize(format_conversations(rows.unionByName(own)), "conversations"))
    return out.withColumnRenamed("tree", "conv_id").drop("path")


_ESCAPED = "length(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'))"
OP7_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{OWN_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{OWN_TEXT}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + BETWEEN + END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

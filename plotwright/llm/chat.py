"""Chat formatting: every participant's view of a dialogue. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Delimiters of the rendered turns.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns are put together in pieces of about PIECE bytes. A dialogue is one row; Spark has no cell of 2 GB, so only one of more than PART characters goes on in a further row.
PIECE, PART = 4 << 20, 1 << 26


def turns_of(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, speaker and content of every turn, each once; tie: what orders turns of one number and speaker."""
    speaker = F.when(F.coalesce(F.col(role), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role))
    content = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |")
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), speaker.alias("speaker"), content.alias("content"))
    return base.distinct().withColumn("tie", F.md5("content"))


def views_of(turns: DataFrame, conv: str, role: str, system_roles: tuple[str, ...]) -> DataFrame:
    """__conv and perspective: the participants of each conversation."""
    speaker = F.when(F.coalesce(F.col(role), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role))
    return turns.select(F.col(conv).alias("__conv"), speaker.alias("perspective")).where(~F.col("perspective").isin(*system_roles)).distinct()


def heading(speaker, own, system_roles: tuple[str, ...]):
    """The line before a turn. Names are percent-encoded, so different speakers have different ones."""
    name = F.url_encode(speaker)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # as RFC 3986 has it
        name = F.replace(name, F.lit(a), F.lit(b))
    kind = F.when(own, F.lit("assistant")).when(speaker.isin(*system_roles), F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), kind, F.lit("\n"))


def perspective_dialogues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered and loss_spans: the whole dialogue as each participant's model would be trained on it.

    A participant is a distinct role that isn't a system role; a null or empty role is the participant "unknown". The
    participant's own turns are assistant turns, the others' are user turns with a name, system turns stay system turns
    in every view. Turns stand by number (those without one last), then speaker, then the MD5 of their content.
    loss_spans holds start-end pairs in code points of `rendered`, end exclusive, comma-joined: the content of the
    participant's own turns with its closing delimiter. part is 0; a dialogue of more than PART characters goes on in
    part 1 and so on, each with spans of its own.

    A null text is empty; delimiters inside a text are defused; rows equal in all four columns are one turn; a null
    conv_id is a conversation; one with system turns alone has no view. Other columns are left out, so their names can't
    clash. An empty table gives an empty one.

    A conversation may hold a third of all rows: turns are dealt by range of conversation and place, so that a hot
    conversation fills many pieces of bounded size; a piece is rendered for every participant, and only rendered pieces
    meet, by conversation and participant.
    """
    base = turns_of(turns, conv, turn, role, text)
    size = turns.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 64)).first()[0] or 0
    order = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.col("speaker"), F.col("tie")]
    placed = base.repartitionByRange(1 + size // PIECE, *order).withColumn("piece", F.spark_partition_id())
    item = F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "tie", "content")
    pieces = placed.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(item)).alias("items"))
    seen = pieces.join(views_of(turns, conv, role, system_roles), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

    def segment(x):
        own = x["speaker"] == F.col("perspective")
        head = heading(x["speaker"], own, system_roles)
        body = F.concat(x["content"], F.lit(CLOSE))
        return F.struct(F.concat(head, body, F.lit("\n")).alias("text"), F.when(own, F.char_length(head)).alias("from"), (F.char_length(head) + F.char_length(body)).alias("to"))

    def mark(acc, x):
        span = F.when(x["from"].isNotNull(), F.array(F.struct((acc["at"] + x["from"]).alias("a"), (acc["at"] + x["to"]).alias("b")))).otherwise(none)
        return F.struct((acc["at"] + x["to"] + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    said = seen.select("conv_id", "perspective", "piece", F.transform("items", segment).alias("segments"))
    said = said.select("conv_id", "perspective", "piece", F.size("segments").alias("n"), F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("text"), F.aggregate("segments", start, mark).alias("m"))
    whole = Window.partitionBy("conv_id", "perspective").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("before", F.coalesce(F.sum("m.at").over(whole), F.lit(0))).withColumn("part", F.floor(F.col("before") / F.lit(PART)))
    piece = F.struct("piece", "n", "text", F.col("m.at").alias("size"), F.col("m.spans").alias("spans"))
    # The groups lie within the window's partitions, so nothing is shuffled again.
    parts = said.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def join(acc, x):
        moved = F.transform(x["spans"], lambda s: F.concat((s["a"] + acc["at"]).cast("string"), F.lit("-"), (s["b"] + acc["at"]).cast("string")))
        return F.struct((acc["at"] + x["size"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return parts.select(
        "conv_id", "perspective", "part", F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", begin, join, lambda acc: acc["spans"]), ",").alias("loss_spans"),
    )


def op8_perspective_rotation(spark, sf_dir):
    return perspective_dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
with base as (
  select distinct conv_id, turn::bigint as turn, case when coalesce(role, '') = '' then 'unknown' else role end as speaker,
         replace(coalesce(text, ''), '<|', '< |') as content from conversations),
views as (select distinct conv_id, speaker as perspective from base where speaker not in ('system')),
seg as (
  select b.conv_id, v.perspective, turn, speaker, content, speaker = perspective as own,
         '<|im_start|>' || case when speaker = perspective then 'assistant' when speaker in ('system') then 'system'
           else 'user name=' || url_encode(speaker) end || chr(10) as head
  from base b join views v on b.conv_id is not distinct from v.conv_id),
s as (select *, head || content || '<|im_end|>' || chr(10) as segment from seg),
w as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls last, speaker, md5(content)
            rows between unbounded preceding and 1 preceding), 0)::bigint as pos from s)
select conv_id, perspective, 0::bigint as part, count(*)::bigint as n_turns, string_agg(segment, '' order by turn nulls last, speaker, md5(content)) as rendered,
       coalesce(string_agg((pos + length(head))::varchar || '-' || (pos + length(segment) - 1)::varchar, ',' order by turn nulls last, speaker, md5(content)) filter (where own), '') as loss_spans
from w group by conv_id, perspective
"""

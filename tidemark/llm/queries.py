"""Queries of the training-data operators: one opN_<name> for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, binary, bpe, html, jaccard, language, packing, quality, quoting, toxicity
from tidemark.llm.common import materialise, table

HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.round_trip(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality.BASE, "base_failed", "kept"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select(
        "doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score"
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model).select(
        "doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(table(spark, sf_dir, "documents"))


def _messages(turns: DataFrame) -> DataFrame:
    """Turns as messages: thread, ord, id, role, text and copies.

    Equal rows are one message that counts its copies; the id holds a hash of
    role and text, so that different rows of one turn, or of none, stay apart.
    """
    own = turns.select(F.col("conv_id").cast("bigint").alias("thread"), F.col("turn").cast("bigint").alias("ord"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.groupBy("thread", "ord", "role", "text").agg(F.count("*").alias("copies"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ident = F.concat_ws(":", number("thread"), number("ord"), F.hex(F.xxhash64("role", "text")))
    return own.select("thread", "ord", ident.alias("id"), "role", "text", "copies")


def _conversations(turns: DataFrame) -> DataFrame:
    """A row for each turn: where it stands in its conversation, what it answers, and its text without quotes."""
    messages = materialise(_messages(turns), "messages")
    found = quoting.conversations(messages)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    out = found.join(messages.select("id", "copies"), "id").select(
        number("regexp_extract(conversation, '^t(-?[0-9]+)$', 1)").alias("conversation_id"),
        F.col("thread").alias("conv_id"),
        F.col("ord").alias("turn"),
        "role",
        "position",
        number("split_part(parent, ':', 1)").alias("parent_conv_id"),
        number("split_part(parent, ':', 2)").alias("parent_turn"),
        "n_quoted",
        "n_linked",
        "body",
        "copies",
    )
    # Copies of a row stand at its place.
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")


def _as_mails(turns: DataFrame) -> DataFrame:
    """Every turn as a mail that quotes the two turns before it, as a reply in a mail thread does."""
    quote = lambda c, mark: F.regexp_replace(c, "(?m)^", mark)
    said = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = [said.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("said").alias(f"said{k}")) for k in (1, 2)]
    for k in (1, 2):
        turns = turns.join(before[k - 1], (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}")), "left")
    # A blank quoted line would only part a passage; a text without a word has nothing to quote.
    text = F.concat_ws("\n", quote(F.col("said2"), "> > "), quote(F.col("said1"), "> "), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail threads whose quotes are linked and cut off again; turns as given hold no quotes."""
    return _conversations(_as_mails(table(spark, sf_dir, "conversations")))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over the turns as they are."""
    return _conversations(table(spark, sf_dir, "conversations"))


def chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotes, from the mails."""
    found = quoting.conversations(_messages(_as_mails(table(spark, sf_dir, "conversations"))))
    return quoting.transcripts(found).select(
        F.regexp_extract("conversation", "^t(-?[0-9]+)$", 1).alias("conversation"), "part", "first", "last", "text"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_features": op1_audio_features,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_text": op4_html_text,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_binary": op9_token_binary,
    "op10_chat_quotes": op10_chat_quotes,
    "chat_turns": chat_turns,
    "chat_transcripts": chat_transcripts,
}

_SPLIT = r"""
        l as (
            select conv_id, turn, role, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
            from said),
        p as (select *, regexp_matches(line, '^\s*>') as q, lower(trim(regexp_replace(regexp_replace(line, '^(\s*>)+ ?', ''), '\s+', ' ', 'g'))) as norm from l)"""

ORACLE_SQL: dict[str, str] = {
    # What was rendered as quotes is found again: bodies are the turns' own texts, and the turn before is answered.
    "op10_chat_quotes": """
        with t as (
            select *, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n from conversations)
        select t.conv_id as conversation_id, t.conv_id, t.turn::bigint as turn, t.role,
               row_number() over (partition by t.conv_id order by t.turn) as position,
               case when a.turn is not null or t.turn > min(t.turn) over (partition by t.conv_id) then t.conv_id end as parent_conv_id,
               coalesce(a.turn, lag(t.turn) over (partition by t.conv_id order by t.turn))::bigint as parent_turn,
               (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as n_quoted, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as n_linked, t.text as body
        from t left join t a on a.conv_id = t.conv_id and a.turn = t.turn - 1 left join t b on b.conv_id = t.conv_id and b.turn = t.turn - 2""",
    # Bodies by lines; quoted lines vote for the earliest earlier turn of the conversation that has them.
    "chat_turns": rf"""
        with said as (select * from conversations), {_SPLIT},
        b as (select conv_id, turn, any_value(role) as role, string_agg(line, chr(10) order by i) filter (not q) as body, count(*) filter (q and norm <> '') as n_quoted from p group by conv_id, turn),
        x as (select conv_id, norm, min(turn) as first from p where not q and norm <> '' group by all),
        v as (select p.conv_id, p.turn, x.first, count(*) as n from p join x using (conv_id, norm) where p.q and x.first < p.turn group by all),
        w as (select conv_id, turn, arg_max(first, (n, first)) as up, sum(n) as n_linked from v group by all)
        select b.conv_id as conversation_id, b.conv_id, b.turn::bigint as turn, b.role,
               row_number() over (partition by b.conv_id order by b.turn) as position,
               case when coalesce(w.up, lag(b.turn) over (partition by b.conv_id order by b.turn)) is not null then b.conv_id end as parent_conv_id,
               coalesce(w.up, lag(b.turn) over (partition by b.conv_id order by b.turn))::bigint as parent_turn,
               b.n_quoted, coalesce(w.n_linked, 0)::bigint as n_linked, coalesce(b.body, '') as body
        from b left join w using (conv_id, turn)""",
    "chat_transcripts": """
        with t as (select *, row_number() over (partition by conv_id order by turn) as position from conversations)
        select conv_id::varchar as conversation, (position - 1) // 256 as part, min(position) as first, max(position) as last,
               string_agg(role || ': ' || text, chr(10) || chr(10) order by position) as text
        from t where text <> '' group by conv_id, (position - 1) // 256""",
}

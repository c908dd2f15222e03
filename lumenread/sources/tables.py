"""The relations that queries are written over, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenread.functions.dialect import DUCK

LETTERS = r"\p{L}+"
SENTENCE_END = r"[.!?]+\s+"
#: Word positions that event payloads are folded to.
WORDS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fixation log: reader, order, word, duration, time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        "user_id", F.row_number().over(order).cast("long").alias("i"), (F.get_json_object("props", "$.k").cast("int") % WORDS).alias("w"),
        F.col("value").alias("d"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"), "event_type", "event_id")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case runs of letters of documents, in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(words).alias("pos0", "word")).select(
        "doc_id", "lang", (F.col("pos0") + 1).cast("long").alias("pos"), "word")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens with the words before and after each, from the text's own array of words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    # exploded out of an array of one, so that the words are found once; neighbours are read from the row's array, which isn't copied
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(words)).alias("words"))
    each = rows.select("doc_id", "lang", "words", F.posexplode("words").alias("pos0", "word"))
    return each.select("doc_id", "lang", (F.col("pos0") + 1).cast("long").alias("pos"), "word", F.get("words", F.col("pos0") - 1).alias("prev"), F.get("words", F.col("pos0") + 1).alias("next"))


def forward_fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixations with next_forward, the first later fixation on a later word."""
    from lumenread.operators.gaze import with_next_forward

    return with_next_forward(fixations(spark, sf_dir).select("user_id", "i", "w"), ["user_id"], "i", "w")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed non-empty parts of documents between sentence ends and line ends."""
    parts = F.split(F.regexp_replace("text", r"\n", ". "), SENTENCE_END)
    exploded = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(parts).alias("s0", "raw"))
    return exploded.select("doc_id", "lang", (F.col("s0") + 1).cast("long").alias("sid"), F.trim("raw").alias("sentence")).filter("sentence <> ''")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word")).distinct()


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one row a dimension."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x0")).select("vec_id", "label", "k", F.col("x0").cast("double").alias("x"))


#: Markup that isn't text, references, and what a sentence or a clause ends with.
UNREAD = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"&[a-zA-Z#0-9]+;")
TAG = r"^(/?[a-z][a-z0-9]*)"
MARKED = r"\p{L}+|[.,;:!?]"


def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pages: page_id, block, part, element (the tag that the text follows) and tokens (words and marks)."""
    text = F.col("html")
    for pattern in UNREAD:
        text = F.regexp_replace(text, pattern, " ")
    blocks = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(text, "<")).alias("block", "chunk"))
    element = F.regexp_extract(F.lower("chunk"), TAG, 1)
    inside = F.regexp_replace(F.regexp_replace("chunk", "^[/!a-zA-Z][^>]*>", ""), "([.!?])", "$1\n")
    # a column that is exploded out of an array of one is computed once a row; else it would be once more for each part and token that it is used with
    once = lambda x: F.explode(F.array(x))
    named = blocks.select("page_id", "block", once(F.struct(F.when(element == "", "text").otherwise(element).alias("element"), F.split(inside, "\n").alias("pieces"))).alias("b"))
    parts = named.select("page_id", "block", "b.element", F.posexplode("b.pieces").alias("part", "piece"))
    found = parts.select("page_id", "block", "part", "element", once(F.regexp_extract_all(F.lower("piece"), F.lit(MARKED), F.lit(0))).alias("tokens"))
    return found.filter(F.size("tokens") > 0)


def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages' sentences with their tags: a mark is its own tag, a word's is the element."""
    rows = marked_sentences(spark, sf_dir).select("page_id", "block", "part", "element", F.posexplode("tokens").alias("n0", "token"))
    return rows.select("page_id", "block", "part", (F.col("n0") + 1).cast("long").alias("nth"), F.when(F.col("token").rlike("^[.,;:!?]$"), F.col("token")).otherwise(F.col("element")).alias("tag"), "token", "element")


DERIVED = {"mark": marked_tokens, "fix": fixations, "nxt": forward_fixations, "tok": tokens, "seq": neighbours, "sent": sentences, "lex": lexicon, "dims": dimensions}

FIX_SQL = f"""select user_id, row_number() over (partition by user_id order by ts, event_id) as i,
        {DUCK.json_int("props", "k")} % {WORDS} as w, value as d, {DUCK.seconds("ts")} as t, event_type, event_id from events"""
TOK_SQL = f"""select doc_id, lang, unnest(generate_series(1, len(words))) as pos, unnest(words) as word from (
        select doc_id, lang, regexp_extract_all(lower(text), '{LETTERS}') as words from documents)"""

READ_SQL = "html"
for _pattern in UNREAD:
    READ_SQL = f"regexp_replace({READ_SQL}, '{_pattern}', ' ', 'g')"
MARK_SQL = f"""select page_id, block, part, unnest(generate_series(1, len(tokens))) as nth, unnest(list_transform(tokens, lambda x: case when x in ('.', ',', ';', ':', '!', '?') then x else element end)) as tag, unnest(tokens) as token, element from (
        select page_id, block, element, part, regexp_extract_all(lower(piece), '{MARKED}') as tokens from (
        select page_id, block, element, unnest(range(len(pieces))) as part, unnest(pieces) as piece from (
        select page_id, block, case when lower(chunk) similar to '/?[a-z][\\s\\S]*' then regexp_extract(lower(chunk), '{TAG}', 1) else 'text' end as element,
            string_split(regexp_replace(regexp_replace(chunk, '^[/!a-zA-Z][^>]*>', ''), '([.!?])', '\\1' || chr(10), 'g'), chr(10)) as pieces from (
        select page_id, unnest(range(len(chunks))) as block, unnest(chunks) as chunk from (select page_id, string_split({READ_SQL}, '<') as chunks from pages))))) where len(tokens) > 0"""

DERIVED_SQL = {
    "mark": MARK_SQL,
    "nxt": f"select a.user_id, a.i, a.w, min(b.i) as next_forward from ({FIX_SQL}) a left join ({FIX_SQL}) b on b.user_id = a.user_id and b.i > a.i and b.w > a.w group by a.user_id, a.i, a.w",
    "seq": f"select doc_id, lang, pos, word, lag(word) over (partition by doc_id order by pos) as prev, lead(word) over (partition by doc_id order by pos) as next from ({TOK_SQL})",
    "fix": FIX_SQL,
    "tok": TOK_SQL,
    "sent": f"""select doc_id, lang, sid, trim(raw) as sentence from (
        select doc_id, lang, unnest(generate_series(1, len(parts))) as sid, unnest(parts) as raw from (
        select doc_id, lang, regexp_split_to_array(regexp_replace(text, '\\n', '. ', 'g'), '{SENTENCE_END}') as parts from documents)) where trim(raw) <> ''""",
    "lex": f"select distinct unnest(regexp_extract_all(lower(text), '{LETTERS}')) as word from benchmark",
    "dims": "select vec_id, label, unnest(generate_series(0, len(embedding) - 1)) as k, cast(unnest(embedding) as double) as x from embeddings",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clients client_changes clicks sales sale_lines vendors items stamps").split()

"""Named queries over the test tables, and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import numeric as N
from ..functions import text as T
from ..operators import adapters, chat, clean, sampling, tokens, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(s: str | None) -> str:
    """A string as a DuckDB expression."""
    if s is None:
        return "CAST(NULL AS VARCHAR)"
    parts, run = [], ""
    for c in s:
        if " " <= c <= "~" and c != "'":
            run += c
        else:
            parts += [f"'{run}'"] * bool(run) + [f"chr({ord(c)})"]
            run = ""
    return " || ".join(parts + [f"'{run}'"] * (bool(run) or not parts))


def values(rows: list[tuple[str | None, ...]], *names: str) -> str:
    """Rows with a number as a DuckDB table expression."""
    body = ", ".join(f"({k}, {', '.join(map(literal, r))})" for k, r in enumerate(rows))
    return f"(SELECT * FROM (VALUES {body}) AS v(id, {', '.join(names)}))"


def frame(spark: SparkSession, rows: list[tuple[str | None, ...]], *names: str) -> DataFrame:
    schema = Y.StructType([Y.StructField("id", Y.LongType()), *(Y.StructField(n, Y.StringType()) for n in names)])
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema)


#: Texts that reach every reason and its borders.
EDGE: list[tuple[str | None, ...]] = [
    (x,)
    for x in (
        None, " \t", "　", "\x01\x85", "HTTPS://a.b/c", "www.x.y", "http://a.b http://c.d", " http://x.y ", "123 -- 456", "�� 1",
        "�" + "abcdefghijklmnopqrstuvwxyzbcdefghijklmnopqrstuvwxy"[:49], "�" + "abcdefghijklmnopqrstuvwxyzbcdefghijklmnopqrstuvwxy"[:48],
        "a" * 16 + "bcde", "a" * 17 + "bcd", "a" * 19, "ab" * 10, "abc" * 6 + "ab", ("abcdef" * 4)[:20], "aA" * 10,
        "a\r\nb\rc", "﻿ab", "a\x0bb", "ét́e", "x\u0085y ", "plain text", "中文文本，正常。", "ß" * 3 + "x" * 17, "it's\x1cfine\x1c",
    )
]

SPACES = " || ".join(f"chr({ord(c)})" for c in T.SPACES)
CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.SPACE_RANGES)
NORMAL = f"trim(regexp_replace(replace(nfc_normalize(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10))), chr(65279), ''), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]', '', 'g'), {SPACES})"


def cleaning_sql(source: str) -> str:
    """CTEs that end in `judged`: id, t, s and reason for a source of (id, raw)."""
    return f"""
WITH src AS ({source}), n AS (SELECT *, {NORMAL} AS t FROM src),
c AS (SELECT *, regexp_replace(t, '[{CLASS}]+', '', 'g') AS c, lower(left(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 4096)) AS s FROM n),
m AS (SELECT *, coalesce(list_max(list_transform(list_distinct(string_split(s, '')), lambda x: length(s) - length(replace(s, x, '')))), 0) AS top,
      len(list_filter(range(2, CAST(least(16, length(s) // 4) AS BIGINT) + 1), lambda p: substr(s, p + 1) = left(s, length(s) - p))) > 0 AS periodic FROM c),
judged AS (SELECT *, CASE WHEN t IS NULL OR c = '' THEN 'empty_or_invalid' WHEN regexp_full_match(t, '(?i:https?://|www\\.)[^{CLASS}]+') THEN 'link_only'
      WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'no_letters' WHEN length(c) - length(replace(c, chr(65533), '')) > 0.02 * length(c) THEN 'corrupted'
      WHEN length(s) >= 20 AND (top > CAST(0.8 AS DOUBLE) * length(s) OR periodic) THEN 'repetitive' END AS reason FROM m)
"""


REPORT = f"""
{cleaning_sql(f"SELECT doc_id AS id, text AS raw FROM documents UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT id, raw FROM {values(EDGE, 'raw')}")}
SELECT 'input_records' AS metric, count(*) AS value FROM judged UNION ALL SELECT 'accepted_records', count(*) FILTER (reason IS NULL) FROM judged
UNION ALL SELECT 'filtered_records', count(reason) FROM judged
UNION ALL SELECT r, count(*) FILTER (reason = r) FROM judged, (VALUES ('empty_or_invalid'), ('link_only'), ('no_letters'), ('corrupted'), ('repetitive')) AS x(r) GROUP BY r
"""


@query(REPORT)
def clean_documents_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("text"))
    raw = adapters.adapted(docs, "classification_text").alias("raw")
    every = docs.select(raw).unionByName(pages.select(F.col("text").alias("raw"))).unionByName(frame(spark, EDGE, "raw").select("raw"))
    return clean.report(clean.cleaned(every, F.col("raw")))


@query(f"{cleaning_sql(values(EDGE, 'raw'))} SELECT id, CASE WHEN reason IS NULL THEN t END AS text, reason FROM judged")
def clean_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaned(frame(spark, EDGE, "raw"), F.col("raw")).select("id", "text", "reason")


@query(f"SELECT id, {NORMAL} AS text FROM {values(EDGE, 'raw')}")
def normalize_text_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, EDGE, "raw").select("id", T.normalise(F.col("raw")).alias("text"))


@query(f"{cleaning_sql('SELECT doc_id AS id, text AS raw FROM documents')} SELECT id AS doc_id, length(s) AS sampled, CAST(top AS BIGINT) AS dominant, periodic FROM judged")
def repetition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sample(T.normalise(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.length("s").cast("long").alias("sampled"), T.dominant(F.col("s")).cast("long").alias("dominant"), T.periodic(F.col("s")).alias("periodic"))


def _strip(c: str) -> str:
    return f"nullif(trim({c}, {SPACES}), '')"


def _joined(*parts: str) -> str:
    return f"nullif(concat_ws(chr(10) || chr(10), {', '.join(parts)}), '')"


PAIRS = """p AS (SELECT conv_id, turn, text AS prompt, lead(text) OVER w AS answer, role, lead(role) OVER w AS next_role,
  arg_max(text, turn) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id) AS system FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, prompt, answer, system FROM p WHERE role = 'user' AND next_role = 'assistant')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.answer_pairs(table(spark, sf_dir, "conversations"))


@query(f"SELECT page_id, {_joined(_strip('regexp_extract(html, $$<title>([^<]*)</title>$$, 1)'), _strip('html'))} AS text FROM pages")
def adapter_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("content"))
    return pages.select("page_id", adapters.adapted(pages, "plain_text").alias("text"))


@query(f"SELECT doc_id, {_strip('text')} AS text FROM documents")
def adapter_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", adapters.adapted(docs, "classification_text").alias("text"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_joined(_strip('prompt'), _strip('system'), _strip('answer'))} AS text FROM q")
def adapter_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumnsRenamed({"prompt": "instruction", "system": "input", "answer": "output"})
    return rows.select("conv_id", "turn", adapters.adapted(rows, "instruction_input_output").alias("text"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_joined(_strip('prompt'), _strip('answer'))} AS text FROM q")
def adapter_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumnRenamed("prompt", "question")
    return rows.select("conv_id", "turn", adapters.adapted(rows, "question_answer").alias("text"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_joined(_strip('prompt'), _strip('system'), _strip('answer'))} AS text FROM q")
def adapter_qa_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumnsRenamed({"prompt": "question", "system": "reasoning"})
    return rows.select("conv_id", "turn", adapters.adapted(rows, "question_answer_optional_think").alias("text"))


@query(f"SELECT conv_id, nullif(string_agg({_strip('text')}, chr(10) || chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id")
def adapter_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("conversations"))
    rows = turns.withColumn("conversations", F.transform("conversations", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    return rows.select("conv_id", adapters.adapted(rows, "sharegpt_conversations").alias("text"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN {_strip("split_part(text, chr(10), 1)")} END AS title, {_strip('text')} AS body FROM conversations)
SELECT conv_id, nullif(concat_ws(chr(10) || chr(10), max(title), string_agg(body, chr(10) || chr(10) ORDER BY turn)), '') AS text FROM t GROUP BY conv_id"""
)
def adapter_tieba(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.col("t.text")
    rows = turns.select("conv_id", F.substring_index(F.get(texts, F.lit(0)), "\n", 1).alias("标题"), F.get(texts, F.lit(0)).alias("楼主内容"), F.slice(texts, 2, 1 << 30).alias("回复列表"))
    return rows.select("conv_id", adapters.adapted(rows, "tieba_thread").alias("text"))


@query(
    """SELECT source, count(*) AS records, sum(length(text)) AS chars FROM (SELECT 'benchmark' AS source, text FROM benchmark UNION ALL SELECT 'documents', text FROM documents UNION ALL SELECT 'pages', url FROM pages) GROUP BY source"""
)
def union_sources_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"documents": table(spark, sf_dir, "documents").select("text"), "benchmark": table(spark, sf_dir, "benchmark").select("text"), "pages": table(spark, sf_dir, "pages").select(F.col("url").alias("text"))}
    return sampling.union_sources(texts).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.char_length("text")).alias("chars"))


CATALOG = [("src0", "web", "true"), ("src1", "web", "false"), ("src2", "books", "true"), ("src3", None, "true")]
SETTINGS = [("src0", "news"), ("src1", None), ("src3", None)]


@query(
    f"""SELECT d.doc_id, s.source_id, coalesce(s.category, c.category, '<missing>') AS category FROM documents d
JOIN {values(SETTINGS, 'source_id', 'category')} s ON d.source = s.source_id JOIN {values(CATALOG, 'source_id', 'category', 'enabled')} c ON c.source_id = s.source_id WHERE c.enabled = 'true'"""
)
def source_catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sampling.merged_catalog(frame(spark, SETTINGS, "source_id", "category").drop("id"), frame(spark, CATALOG, "source_id", "category", "enabled").drop("id")).where("enabled = 'true'")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"))
    return docs.join(F.broadcast(merged), "source_id").select("doc_id", "source_id", F.coalesce("category", F.lit("<missing>")).alias("category"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...<truncated>' ELSE text END AS text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 2""")
def dataset_head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import head_samples

    return head_samples(table(spark, sf_dir, "documents").orderBy("doc_id"), 2, 100)


@query("""SELECT 'documents' AS split, count(*) AS n_rows, 5 AS n_columns FROM documents UNION ALL SELECT 'pages', count(*), 3 FROM pages""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(n, table(spark, sf_dir, n)) for n in ("documents", "pages")]
    one = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("split"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for n, df in parts]
    return one[0].unionByName(one[1])


COMPOSED = f"""v AS (SELECT doc_id, source, {_strip("split_part(text, chr(10), 1)")} AS a, {_strip('text')} AS b FROM documents),
composed AS (SELECT doc_id, source, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND starts_with(b, a) THEN b ELSE concat_ws(chr(10), a, b) END AS text FROM v)"""


@query(f"WITH {COMPOSED} SELECT doc_id, left(text, 2000) AS text FROM composed WHERE length(text) >= 32")
def compose_text_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = adapters.compose_text([F.substring_index("text", "\n", 1), F.col("text")])
    return docs.select("doc_id", text.alias("text")).where(F.char_length("text") >= 32).select("doc_id", F.left("text", F.lit(2000)).alias("text"))


BUDGET = """b AS (SELECT doc_id, source, lang, octet_length(encode(left(text, 5000))) AS bytes, md5('42:' || doc_id) || ':' || doc_id AS k FROM documents WHERE length(text) >= 32),
r AS (SELECT *, sum(bytes + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
chosen AS (SELECT * FROM r WHERE before IS NULL OR before - 1 < 500000)"""


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.byte_budget(table(spark, sf_dir, "documents"), "text", ["doc_id"], 500_000, 42, 32, 5000)


@query(f"WITH {BUDGET} SELECT doc_id, bytes FROM chosen")
def sample_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).select("doc_id", "bytes")


@query(f"WITH {BUDGET} SELECT coalesce(nullif(lang, ''), '<missing>') AS category, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM chosen GROUP BY 1")
def sample_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.coalesce(F.nullif("lang", F.lit("")), F.lit("<missing>"))
    return _budget(spark, sf_dir).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


@query(
    """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS ordinal, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, CAST(sum(n) OVER (ORDER BY ordinal) - n AS BIGINT) AS a, CAST(sum(n) OVER (ORDER BY ordinal) AS BIGINT) AS b FROM s)
SELECT doc_id AS index, source, doc_id - a AS local_index FROM (SELECT doc_id FROM documents) d JOIN r ON doc_id >= a AND doc_id < b"""
)
def global_index_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("ordinal", F.row_number().over(Window.orderBy("source")))
    return sampling.locate(docs.select(F.col("doc_id").alias("index")), sizes)


SPLIT = """n AS (SELECT count(*) AS n FROM documents), z AS (SELECT n, greatest(least(CAST(floor(n * 0.95 + 0.5) AS BIGINT), n - 1), 1) AS t FROM n),
s AS (SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id) || ':' || doc_id) <= n - t THEN 'val' ELSE 'train' END AS split FROM documents, z)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sampling.exact_split(docs, ["doc_id"], sampling.split_sizes(docs.count(), 0.95)[1])


@query(f"WITH {SPLIT} SELECT split, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS tokens FROM s GROUP BY split")
def train_val_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(F.char_length("text")).alias("tokens"))


@query(f"WITH {SPLIT} SELECT doc_id, split FROM s")
def train_val_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "split")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:block:' || doc_id // 100), md5('42:row:' || doc_id)) - 1 AS place FROM documents) SELECT doc_id, place, place // 64 AS batch FROM o""")
def block_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    keyed = sampling.block_shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)
    blocks = keyed.groupBy("block_key").agg(F.count(F.lit(1)).alias("n")).select("block_key", F.coalesce(F.sum("n").over(Window.orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("block_key").orderBy("row_key")) - 1
    return keyed.withColumn("nth", nth).join(blocks, "block_key").select("doc_id", (F.col("start") + F.col("nth")).cast("long").alias("place")).withColumn("batch", F.floor(F.col("place") / 64).cast("long"))


USER = f"""CASE WHEN {_strip('system')} IS NULL THEN {_strip('prompt')} ELSE {_strip('prompt')} || {literal(chat.INPUT_HEADING)} || {_strip('system')} END"""
RENDERED = f"""'<|im_start|>user' || chr(10) || {USER} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {_strip('answer')} || '<|im_end|>' || chr(10)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumnsRenamed({"prompt": "instruction", "system": "input", "answer": "output"})
    return rows.withColumn("messages", chat.instruction_messages(rows))


@query(f"WITH {PAIRS} SELECT conv_id, turn, 2 AS n_messages, {USER} AS user_text, {_strip('answer')} AS answer FROM q WHERE {_strip('prompt')} IS NOT NULL AND {_strip('answer')} IS NOT NULL")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return _messages(spark, sf_dir).where(m.isNotNull()).select("conv_id", "turn", F.size(m).alias("n_messages"), m[0]["content"].alias("user_text"), m[1]["content"].alias("answer"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {RENDERED} AS text FROM q")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", chat.render(F.col("messages")).alias("text"))


#: Every answer twice, the second time with other spacing; users' turns alone are invalid.
DOUBLED = f"""{PAIRS}, u AS (SELECT conv_id, turn, 0 AS copy, answer FROM q UNION ALL SELECT conv_id, turn, 1, '  ' || replace(answer, ' ', '  ') FROM q
UNION ALL SELECT conv_id, turn, 2, NULL FROM conversations WHERE role = 'user'),
k AS (SELECT *, trim(regexp_replace(answer, '[{CLASS}]+', ' ', 'g'), ' ') AS key FROM u),
marked AS (SELECT conv_id, turn, copy, CASE WHEN key IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY key ORDER BY copy, conv_id, turn) > 1 THEN 'duplicate' END AS skip_reason FROM k)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    again = rows.withColumn("answer", F.concat(F.lit("  "), F.replace("answer", F.lit(" "), F.lit("  ")))).withColumn("copy", F.lit(1))
    alone = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("system"), F.lit(2).alias("copy"))
    every = rows.withColumn("copy", F.lit(0)).unionByName(again).unionByName(alone).withColumnsRenamed({"prompt": "instruction", "system": "input", "answer": "output"})
    every = every.withColumn("messages", chat.instruction_messages(every))
    return chat.marked(every, "messages", ["copy", "conv_id", "turn"])


@query(f"WITH {DOUBLED} SELECT conv_id, turn, copy FROM marked WHERE skip_reason IS NULL")
def chat_dedup_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("skip_reason IS NULL").select("conv_id", "turn", "copy")


@query(f"WITH {DOUBLED} SELECT o.outcome, count(m.conv_id) AS n FROM (SELECT unnest(['kept', 'invalid', 'duplicate', 'too_long']) AS outcome) o LEFT JOIN marked m ON o.outcome = coalesce(m.skip_reason, 'kept') GROUP BY 1")
def chat_skip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.skip_stats(_marked(spark, sf_dir))


PREFERENCE = f"""{PAIRS}, r AS (SELECT *, lead(answer) OVER (ORDER BY conv_id, turn) AS rejected FROM q),
h AS (SELECT *, CASE WHEN lower(coalesce({_strip('system')}, '')) IN ('', 'none', 'null') THEN '' ELSE '<|im_start|>system' || chr(10) || {_strip('system')} || '<|im_end|>' || chr(10) END || '<|im_start|>user' || chr(10) || {_strip('prompt')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS head FROM r)"""


@query(f"WITH {PREFERENCE} SELECT conv_id, turn, head || {_strip('answer')} || '<|im_end|>' || chr(10) AS chosen, head || {_strip('rejected')} || '<|im_end|>' || chr(10) AS rejected FROM h WHERE {_strip('rejected')} IS NOT NULL AND {_strip('answer')} IS NOT NULL")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.with_following(_pairs(spark, sf_dir), "answer", ["conv_id", "turn"], "rejected", 100).withColumnRenamed("answer", "chosen")
    chosen, rejected = chat.preference_messages(rows)
    both = rows.select("conv_id", "turn", chosen.alias("chosen"), rejected.alias("rejected")).where("chosen IS NOT NULL AND rejected IS NOT NULL")
    return both.select("conv_id", "turn", chat.render(F.col("chosen")).alias("chosen"), chat.render(F.col("rejected")).alias("rejected"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for token ids that SQL has, too: the code points of whole texts; the mask takes the second half."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return docs.withColumn("mask", F.transform("ids", lambda x, k: F.when(k >= F.floor(F.size("ids") / 2), 1).otherwise(0)))


IDS = """i AS (SELECT doc_id, [unicode(c) for c in string_split(text, '') if c <> ''] AS ids FROM documents)"""


@query(f"WITH {IDS} SELECT doc_id, array_to_string([CASE WHEN k - 1 >= len(ids) // 2 THEN ids[k] ELSE -100 END for k in range(1, len(ids) + 1)], ',') AS labels, len(ids) AS attention FROM i")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir)
    return rows.select("doc_id", F.array_join(chat.labels(F.col("ids"), F.col("mask")).cast("array<string>"), ",").alias("labels"), F.size(F.array_repeat(F.lit(1), F.size("ids"))).cast("long").alias("attention"))


@query(f"WITH {IDS}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS width FROM i) SELECT doc_id, width, array_to_string(list_concat(ids, [0 for x in range(width - len(ids))]), ',') AS padded FROM w")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _ids(spark, sf_dir).withColumn("width", F.max(F.size("ids")).over(Window.partitionBy(F.floor(F.col("doc_id") / 8))).cast("long"))
    return rows.select("doc_id", "width", F.array_join(chat.padded(F.col("ids"), F.col("width"), 0).cast("array<string>"), ",").alias("padded"))


@query("""WITH b AS (SELECT doc_id, doc_id // 32 AS bucket, row_number() OVER (PARTITION BY doc_id // 32 ORDER BY n_chars, doc_id) - 1 AS r FROM documents) SELECT doc_id, bucket, bucket * 4 + r // 8 AS batch_id FROM b""")
def length_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.length_batches(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 8, 4).select("doc_id", "bucket", "batch_id")


@query(
    """WITH s AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents), w AS (SELECT t, unnest(range(0, (length(t) - 1) // 8192)) AS window_id FROM s)
SELECT window_id, array_to_string([unicode(c) for c in string_split(substr(t, 1 + window_id * 8192, 8192), '')], ',') AS x, array_to_string([unicode(c) for c in string_split(substr(t, 2 + window_id * 8192, 8192), '')], ',') AS y FROM w"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.token_windows(windows.placed(_ids(spark, sf_dir), "ids", "doc_id"), 4, 2048)
    return found.select("window_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("x", "y")))


@query(
    """WITH n AS (SELECT sum(length(text))::BIGINT AS n FROM documents), w AS (SELECT n, unnest(range(1000)) AS step FROM n), f AS (SELECT step, (n - 8193 - 5000) // 8192 + 1 AS first, (n - 8193) // 8192 + 1 AS per FROM w)
SELECT step, CASE WHEN step < first THEN 5000 + step * 8192 ELSE (step - first) % per * 8192 END::BIGINT AS start, CASE WHEN step < first THEN 5000 + step * 8192 ELSE (step - first) % per * 8192 END::BIGINT + 8192 AS next_position FROM f"""
)
def batch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand steps from the middle of a window, over the stream's end again and again."""
    n = table(spark, sf_dir, "documents").agg(F.sum(F.char_length("text"))).first()[0]
    return windows.batch_starts(spark, n, 4, 2048, 1000, 5000)


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('45:row:' || doc_id), doc_id::VARCHAR) - 1 AS position FROM documents),
b AS (SELECT doc_id, position // 32 AS bucket, row_number() OVER (PARTITION BY position // 32 ORDER BY n_chars, position) - 1 AS r FROM r) SELECT doc_id, bucket * 4 + r // 8 AS batch_id, md5('45:batch:' || (bucket * 4 + r // 8)) AS batch_order FROM b"""
)
def length_bucket_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of epoch 3 under seed 42."""
    return chat.epoch_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 4, 42, 3).select("doc_id", "batch_id", "batch_order")


@query()
def preference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of preference pairs as ids, labels and attention, of 256 tokens at most; a pair stays if both do."""
    both = tokens.masked_encoder(_trained(spark, sf_dir))
    rows = sampling.with_following(_pairs(spark, sf_dir), "answer", ["conv_id", "turn"], "rejected", 100).withColumnRenamed("answer", "chosen")
    sides = dict(zip(("c", "r"), chat.preference_messages(rows), strict=True))
    rows = rows.select("conv_id", "turn", *(m.alias(k) for k, m in sides.items())).where("c IS NOT NULL AND r IS NOT NULL")
    rows = rows.select("conv_id", "turn", *(both(chat.segments(F.col(k))).alias(k) for k in sides))
    return chat.surviving_pairs(rows, "c", "r", 256)


@query(f"WITH {IDS} SELECT doc_id, array_to_string(ids[1:len(ids) - 1], ',') AS x, array_to_string(ids[2:], ',') AS y FROM i")
def next_token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shifted(_ids(spark, sf_dir), "ids").select("doc_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("x", "y")))


@query()
def pretokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pretoken_counts(table(spark, sf_dir, "documents"), "text")


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) GROUP BY w""")
def letter_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _trained(spark: SparkSession, sf_dir: str) -> dict:
    return tokens.train(table(spark, sf_dir, "documents"), "text", vocab_size=600, min_frequency=10)


@query()
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = _trained(spark, sf_dir)["model"]["merges"]
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank long, left string, right string")


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _trained(spark, sf_dir)
    ids = tokens.with_end(tokens.encoder(spec)(F.col("text")), tokens.special_id(spec, "<|endoftext|>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids).alias("n_tokens"))


@query("SELECT count(*) AS records, 0 AS differing FROM documents")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _trained(spark, sf_dir)
    back = table(spark, sf_dir, "documents").select(T.compose(F.col("text")).alias("text"), tokens.encoder(spec)(F.col("text")).alias("ids")).withColumn("back", tokens.decoder(spec)(F.col("ids")))
    return back.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("back") != F.col("text")).cast("int").alias("differing"))


@query(
    """SELECT step, round(CASE WHEN step < 10 THEN 3e-4::DOUBLE * (step + 1) / 10 WHEN step >= 199 THEN 3e-5::DOUBLE ELSE 3e-5::DOUBLE + 0.5 * (1 + cos(pi() * (step - 10) / 189)) * (3e-4::DOUBLE - 3e-5::DOUBLE) END, 12) AS lr FROM (SELECT unnest(range(220)) AS step)"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(220).select(F.col("id").alias("step"), F.round(N.learning_rate(F.col("id"), 3e-4, 3e-5, 10, 200), 12).alias("lr"))


@query("""SELECT sum(length(text))::BIGINT AS tokens, ceil(sum(length(text)) / 131072)::BIGINT AS updates, round(ceil(sum(length(text)) / 131072) * 131072 / sum(length(text)), 9) AS passes FROM documents""")
def training_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(F.char_length("text"))
    updates = F.ceil(n / 131072)
    return table(spark, sf_dir, "documents").agg(n.alias("tokens"), updates.alias("updates"), F.round(updates * 131072 / n, 9).alias("passes"))


LOSSES = """l AS (SELECT doc_id, k, CASE WHEN (doc_id + k) % 5 = 0 THEN -100 WHEN k = 9 THEN 2 ELSE 7 END AS label, ((doc_id * 31 + k * 17) % 1000) / 250.0::DOUBLE AS loss FROM documents, (SELECT unnest(range(10)) AS k))"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    label = F.when((F.col("doc_id") + F.col("k")) % 5 == 0, -100).when(F.col("k") == 9, 2).otherwise(7)
    return rows.select("doc_id", "k", label.alias("label"), (((F.col("doc_id") * 31 + F.col("k") * 17) % 1000) / 250.0).alias("loss"))


@query(f"WITH {LOSSES}, w AS (SELECT *, CASE WHEN label = -100 THEN 0.0 WHEN label = 2 THEN 2.5 ELSE 1.0 END::DOUBLE AS w FROM l) SELECT round(sum(loss * w), 6) AS loss_sum, sum(w) AS weight, round(sum(loss * w) / sum(w), 9) AS mean_loss FROM w")
def weighted_token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, weight = N.weighted_loss(F.col("label"), F.col("loss"), 2, 2.5)
    return _losses(spark, sf_dir).agg(F.round(loss, 6).alias("loss_sum"), weight.alias("weight"), F.round(loss / weight, 9).alias("mean_loss"))


@query(f"WITH {LOSSES} SELECT doc_id, round(sum(CASE WHEN label <> -100 THEN -loss ELSE 0 END), 9) AS log_prob, round(sum(CASE WHEN label <> -100 THEN -loss ELSE 0 END) / greatest(count(*) FILTER (label <> -100), 1), 9) AS mean_log_prob FROM l GROUP BY doc_id")
def sequence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = -F.col("loss")
    return _losses(spark, sf_dir).groupBy("doc_id").agg(F.round(N.sequence_log_prob(F.col("label"), log), 9).alias("log_prob"), F.round(N.sequence_log_prob(F.col("label"), log, True), 9).alias("mean_log_prob"))


SIDES = """d AS (SELECT doc_id, -((doc_id * 7) % 100) / 10.0::DOUBLE AS pc, -((doc_id * 11) % 100) / 10.0::DOUBLE AS pr, -((doc_id * 13) % 100) / 10.0::DOUBLE AS rc, -((doc_id * 17) % 100) / 10.0::DOUBLE AS rr FROM documents),
m AS (SELECT *, 0.1 * ((pc - pr) - (rc - rr)) AS x, 0.1 * (pc - rc) AS chosen, 0.1 * (pr - rr) AS rejected FROM d)"""


@query(f"WITH {SIDES} SELECT round(avg(CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END), 9) AS loss, round(avg(CAST(round(chosen - rejected, 9) > 0 AS INT)), 9) AS accuracy, round(avg(chosen - rejected), 9) AS margin, round(avg(pc), 9) AS policy_chosen, round(avg(pr), 9) AS policy_rejected, round(avg(rc), 9) AS reference_chosen, round(avg(rr), 9) AS reference_rejected FROM m")
def dpo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: -((F.col("doc_id") * k) % 100) / 10.0
    d = table(spark, sf_dir, "documents").select(*(side(k).alias(n) for k, n in ((7, "pc"), (11, "pr"), (13, "rc"), (17, "rr"))))
    chosen, rejected = 0.1 * (F.col("pc") - F.col("rc")), 0.1 * (F.col("pr") - F.col("rr"))
    mean = lambda c: F.round(F.avg(c), 9)
    return d.agg(
        mean(N.dpo_loss(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), 0.1)).alias("loss"), mean((F.round(chosen - rejected, 9) > 0).cast("double")).alias("accuracy"), mean(chosen - rejected).alias("margin"),
        mean(F.col("pc")).alias("policy_chosen"), mean(F.col("pr")).alias("policy_rejected"), mean(F.col("rc")).alias("reference_chosen"), mean(F.col("rr")).alias("reference_rejected"),
    )


LOGITS = """e AS (SELECT vec_id, unnest(range(len(embedding))) AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings),
x AS (SELECT *, exp(logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY vec_id)) AS e FROM e), pr AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM x),
k AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.5 AS kept FROM pr)"""


def _top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return N.top_p(e, "vec_id", "token", "logit", 0.5, 0.8)


@query(f"WITH {LOGITS} SELECT vec_id, count(*) FILTER (kept) AS kept, round(sum(prob) FILTER (kept), 9) AS mass FROM k GROUP BY vec_id")
def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_p(spark, sf_dir).groupBy("vec_id").agg(F.count_if("kept").alias("kept"), F.round(F.sum(F.when(F.col("kept"), F.col("prob"))), 9).alias("mass"))


@query()
def multinomial_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.draws(_top_p(spark, sf_dir), "vec_id", "token", 42)


@query(
    """WITH d AS (SELECT user_id, event_id, value, sum(value) OVER w AS seen, value - lag(value) OVER w AS delta, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(seen, 6) AS tokens_seen, round(value / nullif(us / 1e6::DOUBLE, 0), 9) AS per_second FROM d"""
)
def throughput_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("us", us - F.lag(us).over(w)).withColumn("seen", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("event_id", F.round("seen", 6).alias("tokens_seen"), F.round(F.col("value") / F.nullif(F.col("us") / 1e6, F.lit(0.0)), 9).alias("per_second"))


RUNS = [("run_2", "ckpt_step_90.pt"), ("run_2", "ckpt_step_100.pt"), ("run_1", "ckpt_step_900.pt"), ("run_2", "notes.txt"), ("run_3", "last.pt")]


@query(f"WITH s AS (SELECT run, file, coalesce(TRY_CAST(nullif(regexp_extract(file, 'ckpt_step_(\\d+)\\.pt$', 1), '') AS BIGINT), -1) AS step FROM {values(RUNS, 'run', 'file')}), r AS (SELECT max(run) AS run FROM s WHERE step >= 0) SELECT s.run, max(step) AS step, arg_max(file, step) AS file FROM s JOIN r ON s.run = r.run GROUP BY s.run")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.coalesce(F.nullif(F.regexp_extract("file", r"ckpt_step_(\d+)\.pt\z", 1), F.lit("")).cast("long"), F.lit(-1).cast("long"))
    top = frame(spark, RUNS, "run", "file").withColumn("step", step).where("step >= 0").agg(F.max(F.struct("run", "step", "file")).alias("m"))
    return top.select("m.run", "m.step", "m.file")


ANSWERS = [("a<|im_end|>b",), (" x <|endoftext|> y <|im_end|>",), ("plain",), ("<|im_end|>",), (None,)]


@query(f"SELECT id, trim(split_part(split_part(raw, '<|im_end|>', 1), '<|endoftext|>', 1), {SPACES}) AS answer FROM {values(ANSWERS, 'raw')}")
def clean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, ANSWERS, "raw").select("id", chat.clean_answer(F.col("raw")).alias("answer"))


@query(f"WITH {LOSSES} SELECT round(avg(b), 9) AS mean_of_batches FROM (SELECT doc_id // 16 AS g, avg(loss) AS b FROM l WHERE label <> -100 GROUP BY 1)")
def mean_eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _losses(spark, sf_dir).where("label <> -100").groupBy(F.floor(F.col("doc_id") / 16).alias("g")).agg(F.avg("loss").alias("b"))
    return per.agg(F.round(F.avg("b"), 9).alias("mean_of_batches"))


@query()
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples as ids, labels and attention, cut to 512 tokens; those that don't fit are left out."""
    both = tokens.masked_encoder(_trained(spark, sf_dir))
    rows = _messages(spark, sf_dir).where("messages IS NOT NULL").withColumn("t", both(chat.segments(F.col("messages"))))
    rows = rows.withColumn("fit", chat.fitted(F.col("t.ids"), F.col("t.mask"), 512)).where("fit IS NOT NULL")
    ids, mask = F.slice("t.ids", F.lit(1), F.col("fit")), F.slice("t.mask", F.lit(1), F.col("fit"))
    return rows.select("conv_id", "turn", ids.alias("input_ids"), chat.labels(ids, mask).alias("labels"), F.array_repeat(F.lit(1), F.col("fit")).alias("attention_mask"))

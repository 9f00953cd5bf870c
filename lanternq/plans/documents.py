"""Queries over documents and conversations: text functions of the checks, applied to whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunker
from ..sources.tables import table

c = F.col


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def readability(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.round(T.reading_grade(c("text")), 4).alias("grade"))


def doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.size(T.tokenize(c("text"))).cast("long").alias("tokens"), T.word_count(c("text")).cast("long").alias("words"), T.approx_tokens(c("text")).cast("long").alias("approx"))


def hedge_rate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", T.hedge_count(c("text")).cast("long").alias("hedges"))


def fact_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.has_fact_anchor(c("text")).alias("anchor"), T.opens_clean(c("text")).alias("clean"), T.self_sufficient(c("text")).alias("sufficient"))


def answer_units(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that read as answers of their own."""
    lines = _docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_answer_unit(c("line"))).alias("units"))


def question_headings(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.coalesce(T.is_question(c("text")), F.lit(False)).alias("question"))


def injection_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.lower("text").rlike(f"(?iu){T.INSTRUCTIONS}")).alias("hits"))


def error_labels(spark: SparkSession, folder: str) -> DataFrame:
    lines = _docs(spark, folder).select("doc_id", F.split("text", "\n")[0].alias("label"))
    return lines.select("doc_id", T.normalize_label(c("label")).alias("label"), T.is_error_label(c("label")).alias("error"))


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of about 512 tokens over the lines of each document; a line of up to four words without a full stop counts as a heading."""
    level = "CASE WHEN size(split(x, ' ')) <= 4 AND x NOT LIKE '%.' THEN 2 ELSE 0 END"
    blocks = F.expr(f"transform(filter(transform(split(text, '\\n'), x -> trim(x)), x -> x <> ''), x -> named_struct('level', {level}, 'text', x))")
    got = chunker.chunks(_docs(spark, folder).select("doc_id", blocks.alias("blocks")))
    return got.select("doc_id", c("idx").cast("long").alias("idx"), F.size("blocks").cast("long").alias("blocks"), c("tokens").cast("long").alias("tokens"), F.size("headings").cast("long").alias("trail"))


def chunk_survival(spark: SparkSession, folder: str) -> DataFrame:
    blocks = F.expr("transform(filter(split(text, '\\n'), x -> trim(x) <> ''), x -> named_struct('level', 0, 'text', trim(x)))")
    return chunker.chunks(_docs(spark, folder).select("doc_id", blocks.alias("blocks"))).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("survives").alias("survive"))


def markdown_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of a markdown rendering of each page's navigation."""
    made = F.regexp_replace("html", r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>", "[$2]($1)")
    return table(spark, folder, "pages").select("page_id", F.posexplode(T.markdown_links(made)).alias("pos", "l")).select("page_id", c("pos").cast("long").alias("pos"), c("l.text").alias("text"), c("l.url").alias("url"))


QUERIES = {f.__name__: f for f in (readability, doc_tokens, hedge_rate, fact_anchor, answer_units, question_headings, injection_hits, error_labels, doc_chunks, chunk_survival, markdown_links)}


def _quoted(items: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


_W = r"regexp_extract_all({0}, '[^\x09-\x0D\x20]+')"
_STREAM = r"' ' || trim(regexp_replace(replace(lower({0}), '’', ''''), '[^\p{{L}}\p{{N}}''-]+', ' ', 'g')) || ' '"
_HEDGES = "list_sum([" + ", ".join(f"(length(s) - length(replace(s, ' {h} ', '')))::DOUBLE / {len(h) + 2}" for h in (x.replace("'", "''") for x in T.HEDGES)) + "])"
_CLEAN = rf"NOT list_contains([{_quoted(T.ANAPHORA)}], regexp_extract(replace(lower({{0}}), '’', ''''), '^[\p{{{{L}}}}\p{{{{N}}}}''-]+')) AND NOT regexp_matches(replace(lower({{0}}), '’', ''''), '^(?:{'|'.join(T.CONNECTORS)}) ')"
_FACT = r"(regexp_matches({0}, '[0-9]') OR regexp_matches({0}, '[^.!?:\s]\s+\p{{Lu}}'))"
_UPPER = r"regexp_matches({0}, '^[\p{{Lu}}\p{{N}}]')"
_FOLD = f"regexp_replace(translate({{0}}, '{T._MARKED}', '{T._PLAIN}'), '[̀-ͯ]', '', 'g')"
_LABEL = f"trim(regexp_replace(regexp_replace(lower({_FOLD.format('label')}), '[''‘’ʼ`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SYLLABLES = "list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(x), '[^aeiouy]e$') AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)))"
ORACLE_SQL = {
    "readability": f"WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w, greatest(len(regexp_extract_all(coalesce(text, ''), '[.!?]+')), 1) AS s FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN 0.39::DOUBLE * len(w) / s + 11.8::DOUBLE * {_SYLLABLES} / len(w) - 15.59::DOUBLE END, 4) AS grade FROM d",
    "doc_tokens": f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains([{_quoted(T.STOPWORDS_EN)}], x))) AS tokens, len({_W.format(chr(39).join(['coalesce(text, ', '', ')']))}) AS words, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS approx FROM documents",
    "hedge_rate": f"WITH s AS (SELECT conv_id, turn, {_STREAM.format('text')} AS s FROM conversations) SELECT conv_id, turn, {_HEDGES}::BIGINT AS hedges FROM s",
    "fact_anchor": f"SELECT doc_id, {_FACT.format('text')} AS anchor, {_CLEAN.format('text')} AS clean, {_UPPER.format('text')} AND {_CLEAN.format('text')} AS sufficient FROM documents",
    "answer_units": f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT *, {_STREAM.format('line')} AS s FROM l) SELECT doc_id, count(*) AS lines, count_if(len({_W.format('line')}) BETWEEN 8 AND 40 AND {_FACT.format('line')} AND {_UPPER.format('line')} AND {_CLEAN.format('line')} AND {_HEDGES} = 0) AS units FROM s GROUP BY 1",
    "question_headings": rf"SELECT conv_id, turn, coalesce(trim(text, ' ') LIKE '%?' OR regexp_matches(trim(text, ' '), '(?i)^(?:{T.QUESTION_OPENERS.replace(chr(39), chr(39) * 2)})(?:[^\p{{L}}\p{{N}}]|$)'), false) AS question FROM conversations",
    "injection_hits": rf"SELECT role, count(*) AS turns, count_if(regexp_matches(lower(text), '(?i){T.INSTRUCTIONS}')) AS hits FROM conversations GROUP BY 1",
    "error_labels": f"WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS label FROM documents), n AS (SELECT doc_id, {_LABEL} AS label FROM d) SELECT doc_id, label, label <> '' AND (list_contains([{_quoted(T.ERROR_LABELS)}], label) OR regexp_matches(label, '{'|'.join(T.ERROR_PHRASES)}') OR regexp_matches(label, '{T.ERROR_CODES}')) AS error FROM n",
    "markdown_links": r"""WITH m AS (SELECT page_id, regexp_replace(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g') AS t FROM pages), x AS (SELECT page_id, regexp_extract_all(t, '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 1) AS a, regexp_extract_all(t, '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2) AS b FROM m)
        SELECT page_id, i - 1 AS pos, a[i] AS text, b[i] AS url FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM x)""",
}

"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, html, jaccard, languages, merkle, mixing, neighbours, quality, tokens, urls, warc
from .batches import folder, store

WORDS = r"[^\x20\x09-\x0D]+"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Fewer tokens for texts of several languages; id 50256 is free and ends a document.
MANY_LANGUAGES, END = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens has each document in flat token files of the whole table?"""
    return tokens.document_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", MANY_LANGUAGES, public_tokenizers.PATTERN, END)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens has each document, and does decoding give its bytes back?"""
    return bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY, public_tokenizers.PATTERN)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 20 vectors are nearest to every twentieth one?"""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents repeat themselves too much?"""
    return quality.judge(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does each conversation look like as training text, and which part of it counts in the loss?"""
    rows = chat.with_control_strings(table(spark, sf_dir, "conversations"))
    made = chat.format_conversations(rows, "conv_id", "turn", "role", "text")
    return chat.digests(made).withColumnRenamed("conv", "conv_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are connected by sharing 85 % of their four-word shingles?"""
    return jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", n=4, pct=85)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What do archives written from the pages hold when they are read back?"""
    return warc.archived(table(spark, sf_dir, "pages"), folder(spark, "warc"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is the main text of each page?"""
    return html.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages may be crawled, by rule or by a classifier trained on pages whose document is labelled bad or toxic?"""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1).try_cast("bigint")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad)
    return urls.judge(pages, pages.withColumn("doc_id", number).join(labels, "doc_id").select("page_id", "bad"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often is each document taken for a mix of sources in the proportion 1 : 2 : 3?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    return mixing.mix(store(docs, "mix-sizes"), "source", "size", ["doc_id"], ["doc_id", "source"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each document, as found now, still lead to the root of the table's Merkle manifest?"""
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    now = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    made = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], now)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language is each document in, by machines that saw three quarters of the others?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = languages.remainder(F.col("doc_id"), 4) == 2
    model = languages.train(docs.where(~held_out).select("text", "lang"))
    return languages.predict(docs, "doc_id", "text", model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does each of five filters remove at each step of each order, and on average over all orders?"""
    counts = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "lang")
    return audit.audit(counts)


def _coverage_sql() -> str:
    """Per text and n-gram length: characters inside windows that occur twice or more."""
    one = """
        SELECT r, {n} AS n, sum(CASE WHEN hit THEN length(w) ELSE 0 END) AS chars, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS words FROM (
            SELECT r, w, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n} - 1 PRECEDING AND CURRENT ROW) AS hit FROM (
                SELECT r, i, w, i + {n} - 1 <= n_words AND count(*) OVER (PARTITION BY r, ws[i : i + {n} - 1]) > 1 AS twice FROM w)) GROUP BY r"""
    return " UNION ALL ".join(one.format(n=n) for n in (3, *(n for n, _ in quality.Limits().coverage)))


def _op4_sql() -> str:
    limits = quality.Limits()
    over = " OR ".join(f"(n = {n} AND chars > {most} * word_chars)" for n, most in limits.coverage)
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    l AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '{WORDS}') AS ws FROM d),
    w AS MATERIALIZED (SELECT r, ws, len(ws) AS n_words, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM l),
    size AS (SELECT r, sum(length(w)) AS word_chars FROM w GROUP BY r),
    covered AS MATERIALIZED ({_coverage_sql()}),
    worst AS (
        SELECT r, max(CASE WHEN n > 3 THEN chars / word_chars END) AS gram_coverage, bool_or({over}) AS over,
               max(CASE WHEN n = 3 THEN words END) AS repeat_words
        FROM covered JOIN size USING (r) GROUP BY r),
    line AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
    again AS (
        SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM (
            SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM line WHERE regexp_matches(line, '{WORDS}')) WHERE k > 1 GROUP BY r),
    m AS (
        SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(again.n, 0) AS n_dup_lines, coalesce(repeat_words, 0) AS n_repeat_words, coalesce(gram_coverage, 0) AS gram_coverage,
               coalesce(over, false) AS over, coalesce(again.chars / word_chars, 0) AS line_coverage
        FROM l LEFT JOIN size USING (r) LEFT JOIN worst USING (r) LEFT JOIN again USING (r)),
    b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words_pct} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
           n_repeat_words::bigint AS n_repeat_words, base_failed,
           NOT (base_failed OR over OR line_coverage > {limits.line_coverage} OR n_symbols > {limits.symbols} * n_words) AS kept,
           gram_coverage::double AS gram_coverage, line_coverage::double AS line_coverage
    FROM b"""


def _op5_sql() -> str:
    """The template as an expression of each turn; what is read back equals what went in."""
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\\\'), '#', '\\h'), '<', '\\l')"
    return rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::bigint AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
           sum(length('### : </turn>') + 1 + length(replace({esc('role')}, ':', '\c')) + length({esc('text')}))::bigint AS formatted_chars,
           false AS rewrites
    FROM c GROUP BY conv_id"""


OP6_SQL = rf"""
    WITH RECURSIVE d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws
        FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT r, g FROM (
            SELECT r, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g
            FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0))),
    size AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
    shared AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
    link AS MATERIALIZED (
        SELECT a, b FROM shared JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
    reach AS (SELECT r, r AS other FROM size UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.other),
    least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id
    FROM d LEFT JOIN size USING (r) LEFT JOIN least USING (r)"""

OP7_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
    q AS (
        SELECT page_id, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
               array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::bigint >> (15 - 5 * j)) & 31)::integer, 1)), '')), '') AS digest
        FROM p)
    SELECT page_id, payload_bytes::bigint AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM q"""

#: Unsigned CRC-32 of the text s, by the table of its 256 bytes.
_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({s}, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _op11_sql() -> str:
    """The trees level by level; each leaf's siblings found by place."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    tree = """
        SELECT g, 0 AS lvl, i, h, n FROM {leaves}
        UNION ALL
        SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {tree} WHERE n > 1 GROUP BY g, lvl, i // 2"""
    step = """
        SELECT l.{key}, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.i < l.i >> v.lvl THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY v.lvl) AS steps
        FROM {leaves} l JOIN (SELECT DISTINCT g, lvl FROM {tree} WHERE n > 1) v ON v.g = l.g
        LEFT JOIN {tree} s ON s.g = l.g AND s.lvl = v.lvl AND s.i = xor(l.i >> v.lvl, 1) GROUP BY l.{key}"""
    return f"""
    WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
    d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS h,
               CASE WHEN {_CRC.format(s="doc_id::varchar")} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS now FROM documents, crc),
    leaves AS MATERIALIZED (
        SELECT r, doc_id, g, h, now, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
    inner_tree AS ({tree.format(leaves='leaves', tree='inner_tree')}),
    subroots AS MATERIALIZED (
        SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
    outer_tree AS ({tree.format(leaves='subroots', tree='outer_tree')}),
    a AS ({step.format(key='r', leaves='leaves', tree='inner_tree')}),
    b AS ({step.format(key='name', leaves='subroots', tree='outer_tree')}),
    p AS (
        SELECT doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM outer_tree WHERE n = 1) AS root, now, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
        FROM leaves l JOIN subroots s ON s.name = l.g LEFT JOIN a USING (r) LEFT JOIN b ON b.name = l.g),
    f AS (
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256,
               list_reduce(list_prepend(now, steps), lambda x, y: sha256(CASE y[1] WHEN 'L' THEN y[2:] || x WHEN 'R' THEN x || y[2:] ELSE x END)) AS folded_root FROM p)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""


def _op13_sql() -> str:
    """Every order applied step by step to the counts of documents by what they fail."""
    fails = lambda x: f"contains(mask, {x})"
    return rf"""
    WITH RECURSIVE t AS MATERIALIZED (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
    known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS mask
        FROM t LEFT JOIN known ON known.doc_id = t.doc_id),
    m AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
    grown(o) AS (SELECT '' UNION ALL SELECT o || l FROM grown, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(o, l)),
    orders AS MATERIALIZED (SELECT o, k, o[k] AS own, o[1:k - 1] AS before FROM grown, range(1, 6) r(k) WHERE length(o) = 5),
    s AS MATERIALIZED (
        SELECT part, o, k, own,
               sum(CASE WHEN length(translate(mask, before || own, '')) = length(mask) THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN {fails('own')} AND length(translate(mask, before, '')) = length(mask) THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN {fails('own')} AND length(translate(mask, before, '')) < length(mask) THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN {fails('own')} AND length(translate(mask, before, '')) = length(mask) THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN {fails('own')} AND length(translate(mask, before, '')) = length(mask) THEN toxic ELSE 0 END) AS toxic_lost
        FROM m, orders GROUP BY part, o, k, own)
    SELECT part, o AS filter_order, k::integer AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
           good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
    FROM s"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_token_counts": (op1, None),
    "op2_byte_bpe": (op2, None),
    "op3_graph_neighbours": (op3, None),
    "op4_quality_rules": (op4, _op4_sql()),
    "op5_chat_format": (op5, _op5_sql()),
    "op6_jaccard_join": (op6, OP6_SQL),
    "op7_warc_archive": (op7, OP7_SQL),
    "op8_html_text": (op8, None),
    "op9_url_filter": (op9, None),
    "op10_source_mix": (op10, None),
    "op11_merkle_manifest": (op11, _op11_sql()),
    "op12_language_id": (op12, None),
    "op13_filter_audit": (op13, _op13_sql()),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

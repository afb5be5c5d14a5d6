"""Queries: classification, grouping, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import classify as C
from ..operators import similarity as S
from ..operators import vouchers as V
from ..session import materialize
from .base import Data, register

_ENTRY = (
    "batch_id:s voucher_no:l entry_seq:l date:s summary:s subject_code:s subject_name:s debit_amount:f "
    "credit_amount:f direction:s counterparty:s match_source:s rule_id:s original_amount:f"
)


def _classified(d: Data):
    """Classified rows, written once: grouping reads them three times."""
    return materialize(S.classify(d.view("txn"), d.rules()), "classified")


@register("compose_vouchers", _ENTRY, "SELECT * FROM entries", ("entries",))
def compose_vouchers(d: Data):
    return V.compose_vouchers(_classified(d), d.view("accounts"))


@register("rule_first_match", "txn_seq:l rule_id:s subject_code:s subject_name:s",
          "SELECT txn_seq, m_rule AS rule_id, m_code AS subject_code, m_name AS subject_name FROM matched", ("matched",))
def rule_first_match(d: Data):
    return C.apply_rules(d.view("txn"), d.rules()).select("txn_seq", "match.*")


@register("rule_first_match_joined", "txn_seq:l rule_id:s subject_code:s",
          "SELECT txn_seq, m_rule AS rule_id, m_code AS subject_code FROM matched", ("matched",))
def rule_first_match_joined(d: Data):
    return C.join_rules(d.view("txn"), d.rules()).select("txn_seq", "match.*")


# Five rules for each part: at sf0.01 ten thousand.
_MANY = """
SELECT p_partkey * 5 + i AS ord, concat('m', cast(p_partkey * 5 + i AS string)) AS rule_id,
       CASE WHEN (p_partkey + i) % 2 = 0 THEN 'income' ELSE 'expense' END AS direction, (p_partkey * 31 + i * 17) % 50 AS priority,
       CASE WHEN i = 0 THEN concat(p_name, ' ', cast(p_partkey AS string)) WHEN i = 1 THEN concat(substring(p_name, 3), ' ', cast(p_partkey AS string))
            WHEN i = 2 THEN cast(p_partkey * 7 + 3 AS string) WHEN i = 3 THEN concat('no ', p_name) ELSE concat(' ', cast(p_partkey AS string)) END AS word,
       CASE WHEN i = 4 THEN 'urgent' ELSE '' END AS without, concat('5', cast(p_partkey % 100 AS string)) AS code
FROM (SELECT p_partkey, p_name, {explode}({list}(0, 1, 2, 3, 4)) AS i FROM part) AS p
"""


@register("rule_first_match_many", "txn_seq:l rule_id:s subject_code:s",
          f"""WITH many AS ({_MANY.format(list='list_value', explode='unnest')}),
          texts AS (SELECT DISTINCT direction, description FROM txn),
          won AS (SELECT t.direction, t.description, min_by({{'rule_id': rule_id, 'code': code}}, (priority, ord)) AS w
            FROM texts t JOIN many m ON m.direction = t.direction AND contains(t.description, m.word)
            WHERE m.without = '' OR NOT contains(t.description, m.without) GROUP BY ALL)
          SELECT txn_seq, w.rule_id AS rule_id, w.code AS subject_code FROM txn LEFT JOIN won USING (direction, description)""", ("txn",))
def rule_first_match_many(d: Data):
    d.table("part").createOrReplaceTempView("part")
    rules = d.spark.sql(_MANY.format(list="array", explode="explode")).select(
        "ord", "rule_id", "direction", "priority", F.array("word").alias("keywords"), F.filter(F.array("without"), lambda w: w != "").alias("exclude"),
        F.array().cast("array<string>").alias("require"), F.lit("").alias("counterparty_pattern"), "code", F.lit("").alias("name"))
    return C.join_rules(d.view("txn"), rules).select("txn_seq", "match.*")


_CLEAN = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')"
_SIMILAR = f"""
q AS (SELECT DISTINCT direction, {_CLEAN.format('description')} AS ct FROM @queries),
hh AS (SELECT *, {_CLEAN.format('description')} AS ct FROM history),
hdoc AS (SELECT hid, direction, ct, code, name, confirmed,
         CASE WHEN length(ct) >= 2 THEN list_transform(range(1, length(ct)), lambda i: substring(ct, i, 2))
              WHEN length(ct) = 1 THEN [ct] ELSE [] END AS g FROM hh),
hg AS (SELECT hid, direction, gram, count(*) AS cnt FROM (SELECT hid, direction, unnest(g) AS gram FROM hdoc) GROUP BY ALL),
ht AS (SELECT hid, sum(cnt) AS total FROM hg GROUP BY hid),
n AS (SELECT direction, count(*) AS n FROM hh GROUP BY direction),
idf AS (SELECT direction, gram, count(*) AS df, any_value(n) AS n, ln(any_value(n) / count(*)) + 1 AS idf
        FROM hg JOIN n USING (direction) GROUP BY direction, gram),
hw AS (SELECT hid, direction, gram, cnt / total * idf AS w FROM hg JOIN ht USING (hid) JOIN idf USING (direction, gram)),
hn AS (SELECT hid, sqrt(sum(w*w)) AS norm FROM hw GROUP BY hid),
qg AS (SELECT direction, ct, gram, count(*) AS cnt FROM (
       SELECT direction, ct, unnest(CASE WHEN length(ct) >= 2 THEN list_transform(range(1, length(ct)), lambda i: substring(ct, i, 2))
              WHEN length(ct) = 1 THEN [ct] ELSE [] END) AS gram FROM q) GROUP BY ALL),
qt AS (SELECT direction, ct, sum(cnt) AS total FROM qg GROUP BY ALL),
qw AS (SELECT direction, ct, gram, cnt / total * idf AS w FROM qg JOIN qt USING (direction, ct) JOIN idf USING (direction, gram)),
qn AS (SELECT direction, ct, sqrt(sum(w*w)) AS norm FROM qw GROUP BY ALL),
dots AS (SELECT qw.direction, ct, hid, sum(qw.w * hw.w) AS dot FROM qw JOIN hw USING (direction, gram) GROUP BY ALL),
scored AS (SELECT d.direction, d.ct, d.hid, round(dot / (qn.norm * hn.norm), 12) AS score
           FROM dots d JOIN qn USING (direction, ct) JOIN hn USING (hid)),
best AS (SELECT * FROM (SELECT s.*, h.code, h.name, row_number() OVER (PARTITION BY s.direction, s.ct
           ORDER BY score DESC, h.confirmed DESC, h.hid) AS rn FROM scored s JOIN hh h USING (hid)
           WHERE score >= 0.75) WHERE rn = 1)
"""


def _similar(queries: str) -> str:
    return _SIMILAR.replace("@queries", queries)


@register("history_similarity", "direction:s ct:s hid:l code:s score:f",
          f"WITH {_similar('(SELECT * FROM matched WHERE m_code IS NULL)')} "
          "SELECT direction, ct, hid, code, round(score, 6) AS score FROM best", ("matched", "history"))
def history_similarity(d: Data):
    rest = C.apply_rules(d.view("txn"), d.rules()).where("match IS NULL")
    return S.similar_history(rest, S.index_history(d.view("history"))).withColumn("score", F.round("score", 6))


@register("top1_similarity", "direction:s ct:s hid:l",
          f"WITH {_similar('txn')} SELECT direction, ct, hid FROM best", ("txn", "history"))
def top1_similarity(d: Data):
    return S.top1_history(d.view("txn"), S.index_history(d.view("history")))


@register("history_incremental", "direction:s ct:s hid:l code:s score:f",
          f"WITH {_similar('(SELECT * FROM matched WHERE m_code IS NULL)')} "
          "SELECT direction, ct, hid, code, round(score, 6) AS score FROM best", ("matched", "history"))
def history_incremental(d: Data):
    """The index of one half of the history, extended with the other half."""
    rest = C.apply_rules(d.view("txn"), d.rules()).where("match IS NULL")
    index = S.extend_index(S.index_history(d.view("history").where("hid % 2 = 0")), d.view("history").where("hid % 2 = 1"))
    return S.top1_history(rest, index).withColumn("score", F.round("score", 6))


@register("classify_cascade", "txn_seq:l subject_code:s subject_name:s source:s rule_id:s",
          f"WITH {_similar('(SELECT * FROM matched WHERE m_code IS NULL)')} "
          f"""SELECT m.txn_seq, coalesce(m.m_code, b.code, '') AS subject_code, coalesce(m.m_name, b.name, '') AS subject_name,
          CASE WHEN m.m_code IS NOT NULL THEN 'rule' WHEN b.code IS NOT NULL THEN 'history' ELSE 'unmatched' END AS source,
          coalesce(m.m_rule, '') AS rule_id
          FROM matched m LEFT JOIN best b ON b.direction = m.direction AND b.ct = {_CLEAN.format('m.description')}""",
          ("matched", "history"))
def classify_cascade(d: Data):
    return S.classify(d.view("txn"), d.rules(), d.view("history"))


# Large payments first, then rules of a document, then the counterparty: three tiers of a user's own.
_OWN_RULES = {
    "expense": {"rules": [
        {"id": "own1", "priority": 2, "match": {"keywords": ["green", "blue"], "exclude_keywords": ["dark"]}, "subject_code": "610", "subject_name": "Cool"},
        {"id": "own2", "priority": 1, "match": {"keywords": ["blue"], "require_keywords": ["pale"]}, "subject_code": "611", "subject_name": "Pale"},
    ]},
    "income": {"rules": [{"id": "own3", "match": {"keywords": ["red"], "counterparty_pattern": "#"}, "subject_code": "612", "subject_name": "Red"}]},
}
_OWN_RULE = """CASE WHEN direction = 'expense' AND contains(description, 'blue') AND contains(description, 'pale') THEN 'own2'
 WHEN direction = 'expense' AND (contains(description, 'green') OR contains(description, 'blue')) AND NOT contains(description, 'dark') THEN 'own1'
 WHEN direction = 'income' AND contains(description, 'red') AND contains(counterparty, '#') THEN 'own3' END"""


@register("own_rules", "txn_seq:l rule_id:s subject_code:s",
          f"""SELECT txn_seq, rule_id, CASE rule_id WHEN 'own1' THEN '610' WHEN 'own2' THEN '611' WHEN 'own3' THEN '612' END AS subject_code
          FROM (SELECT txn_seq, {_OWN_RULE} AS rule_id FROM txn)""", ("txn",))
def own_rules(d: Data):
    return C.apply_rules(d.view("txn"), C.load_rules(d.spark, _OWN_RULES)).select("txn_seq", "match.rule_id", "match.subject_code")


@register("own_tiers", "txn_seq:l subject_code:s source:s rule_id:s",
          f"""SELECT txn_seq, CASE WHEN amount >= 250000 THEN '100' WHEN rule_id = 'own1' THEN '610' WHEN rule_id = 'own2' THEN '611' WHEN rule_id = 'own3' THEN '612'
          WHEN contains(counterparty, '7') THEN '107' ELSE '' END AS subject_code,
          CASE WHEN amount >= 250000 THEN 'large' WHEN rule_id IS NOT NULL THEN 'rule' WHEN contains(counterparty, '7') THEN 'party' ELSE 'unmatched' END AS source,
          CASE WHEN amount < 250000 AND rule_id IS NOT NULL THEN rule_id ELSE '' END AS rule_id FROM (SELECT *, {_OWN_RULE} AS rule_id FROM txn)""", ("txn",))
def own_tiers(d: Data):
    def taking(when, code: str, source: str) -> S.Tier:
        named = F.struct(F.lit(code).alias("subject_code"), F.lit("").alias("subject_name"), F.lit(source).alias("source"), F.lit("").alias("rule_id"))
        return lambda rows, out: rows.withColumn(out, F.when(when, named))

    tiers = [taking(F.col("amount") >= 250000, "100", "large"), S.rule_tier(C.load_rules(d.spark, _OWN_RULES)), taking(F.col("counterparty").contains("7"), "107", "party")]
    return S.classify(d.view("txn"), tiers=tiers)


@register("doc_freq", "direction:s gram:s df:l n:l idf:f",
          f"WITH {_similar('txn')} SELECT direction, gram, df, n, round(idf, 9) AS idf FROM idf",
          ("txn", "history"))
def doc_freq(d: Data):
    return S.document_frequency(d.view("history")).withColumn("idf", F.round("idf", 9))


@register("idf", "direction:s gram:s idf:f",
          f"WITH {_similar('txn')} SELECT direction, gram, round(idf, 9) AS idf FROM idf", ("txn", "history"))
def idf(d: Data):
    return S.document_frequency(d.view("history")).withColumn("idf", F.round("idf", 9))


@register("term_freq", "direction:s ct:s gram:s cnt:l total:l",
          f"WITH {_similar('txn')} SELECT direction, ct, gram, cnt, total FROM qg JOIN qt USING (direction, ct)",
          ("txn", "history"))
def term_freq(d: Data):
    from ..functions.text import matching_text

    asked = d.view("txn").select("direction", matching_text(F.col("description")).alias("ct")).distinct()
    return S.gram_counts(asked, ["direction"])


@register("tfidf", "direction:s ct:s gram:s w:f",
          f"WITH {_similar('txn')} SELECT direction, ct, gram, round(cnt / total * coalesce(idf, 0), 9) AS w "
          "FROM qg JOIN qt USING (direction, ct) LEFT JOIN idf USING (direction, gram)", ("txn", "history"))
def tfidf(d: Data):
    from ..functions.text import matching_text

    asked = d.view("txn").select("direction", matching_text(F.col("description")).alias("ct")).distinct()
    idf = S.document_frequency(d.view("history"))
    counts = S.gram_counts(asked, ["direction"]).join(idf, ["direction", "gram"], "left")
    return counts.withColumn("w", F.round(F.col("cnt") / F.col("total") * F.coalesce("idf", F.lit(0.0)), 9))


@register("enrich_aux", "txn_seq:l subject_code:s aux_category:s aux_category_name:s",
          """SELECT txn_seq, cast(txn_seq % 3000 as varchar) AS subject_code, coalesce(s.aux_category,'') AS aux_category,
          coalesce(s.aux_category_name,'') AS aux_category_name
          FROM txn LEFT JOIN subjects s ON s.code = cast(txn_seq % 3000 as varchar)""", ("txn", "subjects"))
def enrich_aux(d: Data):
    coded = d.view("txn").select("txn_seq", (F.col("txn_seq") % 3000).cast("string").alias("subject_code"))
    return C.with_aux(coded, d.view("subjects"))


@register("rule_lint", "ord:l rule_id:s finding:s",
          """SELECT ord, rule_id, finding FROM (
           SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS n FROM (
             SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('q', cast(p_partkey % 1500 as varchar)) END AS rule_id,
               p_partkey % 5 = 0 AS nokw, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE cast(p_partkey * 2 as varchar) END AS code FROM part))
           CROSS JOIN (VALUES ('missing id'),('duplicate id'),('no keywords'),('missing subject'),('unknown subject')) f(finding)
           WHERE (finding='missing id' AND rule_id='') OR (finding='duplicate id' AND rule_id<>'' AND n>1)
              OR (finding='no keywords' AND nokw) OR (finding='missing subject' AND code='')
              OR (finding='unknown subject' AND code<>'' AND code NOT IN (SELECT code FROM subjects))""", ("subjects",))
def rule_lint(d: Data):
    rules = d.table("part").select(
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("q"), (F.col("p_partkey") % 1500).cast("string"))).alias("rule_id"),
        F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("keywords"),
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise((F.col("p_partkey") * 2).cast("string")).alias("code"),
    )
    return C.lint_rules(rules, d.view("subjects"))


_OWN = "SELECT account_number, id, coalesce(bank_code,'') AS bank_code, coalesce(subject_code,'10002') AS subject_code"


@register("account_match", "account_number:s id:s bank_code:s subject_code:s subject_name:s",
          _OWN + ", coalesce(subject_name,'银行存款') AS subject_name FROM (SELECT DISTINCT account_number FROM txn) LEFT JOIN own_account USING (account_number)",
          ("txn", "own_account"))
def account_match(d: Data):
    numbers = d.view("txn").select("account_number").distinct()
    return _account_answer(A.match_accounts(numbers, d.view("accounts")))


@register("account_match_joined", "account_number:s id:s bank_code:s subject_code:s subject_name:s",
          _OWN + ", coalesce(subject_name,'银行存款') AS subject_name FROM (SELECT DISTINCT account_number FROM txn) LEFT JOIN own_account USING (account_number)",
          ("txn", "own_account"))
def account_match_joined(d: Data):
    numbers = d.view("txn").select("account_number").distinct()
    return _account_answer(A.join_accounts(numbers, d.view("accounts"), "account_number", "own"))


def _account_answer(matched):
    code, name = A.bank_subject(F.col("own"))
    return matched.select(
        "account_number", F.col("own.id").alias("id"), F.coalesce("own.bank_code", F.lit("")).alias("bank_code"),
        code.alias("subject_code"), name.alias("subject_name"),
    )


@register("voucher_group", "batch_id:s txn_seq:l counter_code:s voucher_size:l voucher_total:f",
          "SELECT batch_id, txn_seq, counter_code, voucher_size, cast(voucher_total as decimal(18,2)) AS voucher_total FROM member",
          ("member",))
def voucher_group(d: Data):
    return V.grouped(_classified(d))


@register("voucher_number", "batch_id:s txn_seq:l voucher_no:l",
          "SELECT batch_id, txn_seq, voucher_no FROM member", ("member",))
def voucher_number(d: Data):
    return V.grouped(_classified(d))


@register("entry_sequence", "batch_id:s voucher_no:l entry_seq:l direction:s",
          "SELECT batch_id, voucher_no, entry_seq, direction FROM entries", ("entries",))
def entry_sequence(d: Data):
    return V.compose_vouchers(_classified(d), d.view("accounts"))


@register("voucher_heads", "batch_id:s voucher_no:l date:s direction:s bank_subject_code:s counterpart_subject_code:s voucher_total:f",
          """SELECT batch_id, voucher_no, txn_date AS date, direction, coalesce(o.subject_code,'10002') AS bank_subject_code,
          counter_code AS counterpart_subject_code, cast(voucher_total as decimal(18,2)) AS voucher_total
          FROM member LEFT JOIN own_account o USING (account_number) WHERE pos = 1""", ("member", "own_account"))
def voucher_heads(d: Data):
    return V.voucher_heads(_classified(d), d.view("accounts"))


@register("first_of_group", "batch_id:s account_number:s direction:s first_date:s first_description:s",
          """SELECT batch_id, account_number, direction, min_by(txn_date, txn_seq) AS first_date,
          min_by(description, txn_seq) AS first_description FROM txn GROUP BY ALL""", ("txn",))
def first_of_group(d: Data):
    from ..operators.summaries import first_of_group as op

    return op(d.view("txn"), ["batch_id", "account_number", "direction"])


@register("preview_warnings", "batch_id:s voucher_no:l unmatched:l message:s",
          """SELECT batch_id, voucher_no, count(*) AS unmatched,
          concat('凭证#', cast(voucher_no as varchar), ': ', cast(count(*) as varchar), ' 条分录科目未匹配') AS message
          FROM entries WHERE match_source='unmatched' AND direction<>'bank' GROUP BY batch_id, voucher_no""", ("entries",))
def preview_warnings(d: Data):
    return V.preview_warnings(d.entries())


@register("unmatched_non_bank", "batch_id:s voucher_no:l entry_seq:l",
          "SELECT * FROM entries WHERE match_source='unmatched' AND direction<>'bank'", ("entries",))
def unmatched_non_bank(d: Data):
    return d.entries().where(V.unmatched_non_bank())


@register("voucher_header_rollup", "batch_id:s voucher_no:l is_entry:l entry_seq:l entry_count:l total_debit:f total_credit:f",
          """SELECT batch_id, voucher_no, 0 AS is_entry, 0 AS entry_seq, count(*) AS entry_count,
          cast(coalesce(sum(debit_amount),0) as decimal(18,2)) AS total_debit,
          cast(coalesce(sum(credit_amount),0) as decimal(18,2)) AS total_credit
          FROM entries GROUP BY batch_id, voucher_no
          UNION ALL SELECT batch_id, voucher_no, 1, entry_seq, NULL, debit_amount, credit_amount FROM entries""", ("entries",))
def voucher_header_rollup(d: Data):
    return V.header_rollup(d.entries())

"""Queries: scalar readers and source-row normalisers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BANK_CODES, BANK_NAMES
from ..functions import amounts as A
from ..functions import dates as D
from ..functions import text as T
from ..operators import normalize as N
from .base import Data, register

# --- SQL spellings of the readers --------------------------------------------------------


def _day(e: str, p: str) -> str:
    parts = ",'-',".join(f"lpad(regexp_extract({e},'{p}',{g}),{w},'0')" for g, w in ((1, 4), (2, 2), (3, 2)))
    return f"(CASE WHEN regexp_matches({e},'{p}') THEN cast(try_strptime(concat({parts}),'%Y-%m-%d') AS date) END)"


def _num(e: str) -> str:
    return rf"(CASE WHEN regexp_full_match({e},'[+-]?(\d+\.?\d*|\.\d+)') THEN try_cast({e} AS decimal(18,2)) END)"


PACKED, ISO = r"(\d{4})(\d{2})(\d{2})", r"(\d{4})-(\d{2})-(\d{2})"
CN = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"


def q_compact(e: str) -> str:
    return f"coalesce({_day(f'trim({e})', f'^{PACKED}$')}, {_day(f'trim({e})', f'^{ISO}$')})"


def q_compact_bad(e: str) -> str:
    return f"(regexp_matches(trim({e}),'^{PACKED}$|^{ISO}$') AND {q_compact(e)} IS NULL)"


def q_iso(e: str) -> str:
    return _day(f"trim({e})", f"^{ISO}$")


def q_cn(e: str) -> str:
    return f"coalesce({_day(e, r'(\d{4})[年-](\d{1,2})[月-](\d{1,2})')}, {_day(e, ISO)})"


def q_flex(e: str) -> str:
    return f"coalesce({_day(f'trim({e})', f'^{ISO}$')}, {_day(f'trim({e})', f'^{PACKED}$')}, {_day(f'trim({e})', CN)})"


def q_bare(e: str) -> str:
    return rf"regexp_replace(replace(replace(trim({e}),',',''),' ',''),'^\+','')"


def q_strict(e: str) -> str:
    return _num(q_bare(e))


def q_lenient(e: str) -> str:
    digits = rf"nullif(regexp_extract(replace(replace(replace(replace(replace({e},'￥',''),'元',''),',',''),'，',''),' ',''),'\d+\.?\d*'),'')"
    return f"coalesce({_num(digits)}, cast(0 as decimal(18,2)))"


def q_clean_text(e: str) -> str:
    return f"replace(replace(replace(replace(replace(trim({e}),',',''),' ',''),'￥',''),'CNY',''),'cny','')"


def q_clean(e: str) -> str:
    return _num(q_clean_text(e))


def q_cny(e: str) -> str:
    hit = rf"coalesce(nullif(regexp_extract({e},'(?i)CNY\s*([\d,]+\.?\d*)',1),''), nullif(regexp_extract({e},'([\d,]+\.\d{{2}})',1),''))"
    return _num(f"replace({hit},',','')")


# --- scalars -----------------------------------------------------------------------------


def _scalar(name: str, columns: str, sql: str, cols: Callable[[], dict[str, Column]]) -> None:
    @register(name, "row_no:l " + columns, f"SELECT row_no, {sql} FROM stmt_rows", ("stmt_rows",))
    def build(d: Data):
        return d.view("stmt_rows").select("row_no", *(v.alias(n) for n, v in cols().items()))


c = F.col
_scalar("date_compact", "day:s bad:b", f"{q_compact('d_compact')} AS day, coalesce({q_compact_bad('d_compact')}, false) AS bad",
        lambda: dict(day=D.date_compact(c("d_compact")), bad=D.date_compact_failed(c("d_compact"))))
_scalar("date_chinese", "day:s", f"{q_cn('d_cn')} AS day", lambda: dict(day=D.date_chinese(c("d_cn"))))
_scalar("date_iso", "day:s", f"{q_iso('d_iso')} AS day", lambda: dict(day=D.date_iso(c("d_iso"))))
_scalar("date_flexible", "day:s", f"{q_flex('d_flex')} AS day", lambda: dict(day=D.date_flexible(c("d_flex"))))
_scalar("timestamp_date", "day:s", f"{_day('d_ts', '^' + ISO)} AS day", lambda: dict(day=D.timestamp_date(c("d_ts"))))
_scalar("receipt_date", "day:s",
        f"CASE WHEN regexp_matches(d_receipt,'{CN}') THEN {_day('d_receipt', CN)} "
        f"WHEN regexp_matches(d_receipt,'{PACKED}') THEN {_day('d_receipt', PACKED)} ELSE {_day('d_receipt', ISO)} END AS day",
        lambda: dict(day=D.date_receipt(c("d_receipt"))))
_scalar("amount_strict", "amount:f", f"{q_strict('a_strict')} AS amount", lambda: dict(amount=A.amount_strict(c("a_strict"))))
_scalar("amount_lenient", "amount:f", f"{q_lenient('a_lenient')} AS amount", lambda: dict(amount=A.amount_lenient(c("a_lenient"))))
_scalar("amount_clean", "amount:f", f"{q_clean('a_clean')} AS amount", lambda: dict(amount=A.amount_clean(c("a_clean"))))
_scalar("amount_cny", "amount:f", f"{q_cny('a_cny')} AS amount", lambda: dict(amount=A.amount_cny(c("a_cny"))))
_scalar("normalize_key", "k:s", "concat(replace(replace(summary,' ',''),':',''),'key') AS k",
        lambda: dict(k=T.normalize_key(F.concat(c("summary"), F.lit("： key:")))))
_scalar("clean_text", "v:s", "concat(summary,'ab') AS v", lambda: dict(v=T.clean_text(F.concat(F.lit("  "), c("summary"), F.lit("\ta\r\nb \n")))))
_scalar("compact_ws", "v:s", "replace(summary,' ','') AS v", lambda: dict(v=T.compact_ws(F.concat(F.lit(" 　"), c("summary"), F.lit("\n")))))
_scalar("char_bigrams", "n:l grams:s",
        "length(replace(summary,' ','')) - 1 AS n, array_to_string(list_transform(range(1, length(replace(summary,' ',''))), "
        "lambda i: substring(replace(summary,' ',''), i, 2)), '|') AS grams",
        lambda: dict(n=F.size(T.char_bigrams(T.matching_text(c("summary")))),
        grams=F.array_join(T.char_bigrams(T.matching_text(c("summary"))), "|")))
_scalar("summary_hash", "h:s", "substring(sha256(summary),1,16) AS h", lambda: dict(h=T.summary_hash(c("summary"))))
_scalar("round2", "r:f", "floor(cast(amount as double) / 7 * 100 + 0.5) / 100 AS r", lambda: dict(r=A.round2(c("amount").cast("double") / 7)))
_scalar("join_nonempty", "v:s w:s",
        "coalesce(nullif(concat_ws(' | ', nullif(remark,''), nullif(in_text,'')),''),'none') AS v, "
        "concat_ws('; ', flag, CASE WHEN num <> flag THEN num END) AS w",
        lambda: dict(v=T.join_nonempty([c("remark"), c("in_text")], " | ", "none"),
        w=T.join_nonempty([c("flag"), c("num"), c("flag")], "; ", distinct=True)))
_scalar("split_first_colon", "k:s v:s",
        "CASE row_no % 3 WHEN 0 THEN summary WHEN 1 THEN 'key' ELSE NULL END AS k, "
        "CASE row_no % 3 WHEN 0 THEN concat(num,':x') WHEN 1 THEN num ELSE NULL END AS v",
        lambda: (lambda s: {"k": T.colon_key(s), "v": T.colon_value(s)})(
            F.when(c("row_no") % 3 == 0, F.concat("summary", F.lit("： "), "num", F.lit(":x")))
            .when(c("row_no") % 3 == 1, F.concat(F.lit(" key:"), "num")).otherwise(c("summary"))))
_scalar("is_account_like", "a:b b:b", "true AS a, false AS b",
        lambda: dict(a=T.is_account_like(F.concat("account_number", F.lit("**  "))), b=T.is_account_like(F.concat("account_number", "summary"))))
_scalar("is_masked", "m:b a:b", "row_no % 2 = 0 AS m, true AS a",
        lambda: dict(m=T.is_masked(F.when(c("row_no") % 2 == 0, F.concat("account_number", F.lit("**"))).otherwise(c("account_number"))),
        a=T.is_account_like(F.when(c("row_no") % 2 == 0, F.concat("account_number", F.lit("** "))).otherwise(c("account_number")))))
def _code() -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in ("ICBC", "CMB", "GFB", "X"))), (c("row_no") % 4 + 1).cast("int"))


_scalar("bank_code_name", "bank:s code:s",
        "CASE row_no % 4 WHEN 0 THEN '工商银行' WHEN 1 THEN '招商银行' WHEN 2 THEN '广发银行' ELSE 'X' END AS bank, "
        "CASE row_no % 4 WHEN 0 THEN 'ICBC' WHEN 1 THEN 'CMB' WHEN 2 THEN 'GFB' ELSE 'X' END AS code",
        lambda: dict(bank=T.lookup(_code(), BANK_NAMES, True), code=T.lookup(T.lookup(_code(), BANK_NAMES, True), BANK_CODES, True)))
_scalar("regex_fields", "receipt:s code:s account:s holder:s",
        "concat('1234-5678-9012-', lpad(cast(row_no % 10000 as varchar),4,'0')) AS receipt, "
        "concat('ABCDEFGHIJKLMNOPQRST', cast(row_no as varchar), '=') AS code, account_number AS account, "
        "concat('测试公司', cast(row_no % 9 as varchar)) AS holder",
        lambda: dict(receipt=N.receipt_number(F.concat(F.lit("号码："), F.lit("1234-5678-9012-"), F.lpad((c("row_no") % 10000).cast("string"), 4, "0"))),
        code=N.verify_code(F.concat(F.lit("验证码：ABCDEFGHIJKLMNOPQRST"), c("row_no").cast("string"), F.lit("= "))),
        account=N.holder_account(F.concat(F.lit("账号： "), c("account_number"), F.lit(" 户名：x"))),
        holder=N.holder_name(F.concat(F.lit("户名: 测试公司"), (c("row_no") % 9).cast("string"), F.lit("，其他")))))
_scalar("strip_affixes", "note:s kind:s inline:s",
        "summary AS note, CASE row_no % 3 WHEN 2 THEN remark ELSE summary END AS kind, num AS inline",
        lambda: dict(note=F.regexp_replace(F.concat(F.lit("备注："), c("summary")), "^备注：", ""),
        kind=N.business_type(
            F.when(c("row_no") % 3 == 0, F.concat(F.lit("业务（产品）种类"), "summary")).when(c("row_no") % 3 == 1, c("summary"))
            .otherwise(F.lit("业务（产品）种类")), c("remark")),
        inline=N.inline_value(F.concat(F.lit("金额：) "), c("num"), F.lit("。")), "金额")))


@register("json_stats", "file_id:s stats:s",
          """SELECT file_id, concat('{', string_agg(concat('"', flag, '":', cast(n as varchar)), ',' ORDER BY o), '}') AS stats
          FROM (SELECT file_id, flag, count(*) AS n, CASE flag WHEN '借' THEN 1 WHEN '其他' THEN 2 ELSE 3 END AS o
                FROM stmt_rows GROUP BY file_id, flag) GROUP BY file_id""", ("stmt_rows",))
def json_stats(d: Data):
    # One map entry per flag value, of which there are three.
    per = d.view("stmt_rows").groupBy("file_id", "flag").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("flag") == "借", 1).when(F.col("flag") == "其他", 2).otherwise(3)
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "flag", "n")))
    pairs = F.transform(listed, lambda e: F.struct(e["flag"], e["n"]))
    return per.groupBy("file_id").agg(F.to_json(F.map_from_entries(pairs)).alias("stats"))


@register("summary_hash_documents", "doc_id:l h:s", "SELECT doc_id, substring(sha256(text),1,16) AS h FROM documents")
def summary_hash_documents(d: Data):
    return d.table("documents").select("doc_id", T.summary_hash(F.col("text")).alias("h"))


@register("cosine", "direction:s a:s score:f",
          """WITH v AS (SELECT direction, reference_number AS a, account_number AS g, sum(cast(amount as double)) AS w
             FROM txn GROUP BY ALL), b AS (SELECT direction, account_number AS g, sum(cast(amount as double)) AS w FROM txn GROUP BY ALL)
          SELECT v.direction, v.a, round(sum(v.w*b.w) / (sqrt(sum(v.w*v.w)) * any_value(n.norm)), 9) AS score
          FROM v JOIN b USING (direction, g) JOIN (SELECT direction, sqrt(sum(w*w)) AS norm FROM b GROUP BY direction) n USING (direction)
          GROUP BY v.direction, v.a""", ("txn",))
def cosine(d: Data):
    from ..operators.similarity import cosine_similarity

    t = d.view("txn").withColumn("w", F.col("amount").cast("double"))
    left = t.groupBy("direction", F.col("reference_number").alias("a"), F.col("account_number").alias("gram")).agg(F.sum("w").alias("w"))
    right = t.groupBy("direction", F.col("account_number").alias("gram")).agg(F.sum("w").alias("w"))
    return cosine_similarity(left, right, ["direction"], ["a"]).withColumn("score", F.round("score", 9))


# --- normalisers -------------------------------------------------------------------------

_OUT = (
    "row_no:l status:s txn_date:s description:s amount:f direction:s counterparty:s reference_number:s notes:s "
    "account_number:s"
)


def _sql(status: str, day: str, description: str, amount: str, direction: str, counterparty: str, reference: str,
         notes: str, account: str, source: str = "stmt_rows") -> str:
    vals = {"txn_date": day, "description": description, "amount": amount, "direction": direction,
            "counterparty": counterparty, "reference_number": reference, "notes": notes, "account_number": account}
    picked = ", ".join(f"CASE WHEN status='ok' THEN {v} END AS {k}" for k, v in vals.items())
    return f"SELECT row_no, status, {picked} FROM (SELECT *, {status} AS status FROM {source}) AS s"


def _note_balance() -> str:
    return f"CASE WHEN {q_strict('balance_text')} <> 0 THEN concat('余额:', {q_bare('balance_text')}) END"


@register("norm_flagged_debit_credit", _OUT, _sql(
    f"CASE WHEN regexp_matches(trim(d_iso),'^{ISO}$') AND {q_iso('d_iso')} IS NULL THEN 'error' "
    f"WHEN {q_iso('d_iso')} IS NULL OR flag NOT IN ('借','贷') THEN 'skip' ELSE 'ok' END",
    q_iso("d_iso"), "coalesce(nullif(concat_ws(' | ', CASE WHEN row_no % 8 = 0 THEN NULL ELSE summary END, CASE WHEN remark <> '' THEN concat('附言:',remark) END),''),'银行交易')",
    f"coalesce(CASE flag WHEN '借' THEN {q_strict('out_text')} ELSE {q_strict('in_text')} END, 0)",
    "CASE flag WHEN '借' THEN 'expense' ELSE 'income' END", "counterparty", "reference_number", _note_balance(), "account_number"), ("stmt_rows",))
def norm_flagged_debit_credit(d: Data):
    rows = d.view("stmt_rows").select(
        "row_no", c("d_iso").alias("value_date"), "flag", c("out_text").alias("debit"), c("in_text").alias("credit"),
        F.when(c("row_no") % 8 == 0, "").otherwise(c("summary")).alias("summary"), "remark", "counterparty",
        c("reference_number").alias("ref_account"), c("account_number").alias("own_account"), c("balance_text").alias("balance"))
    return N.flagged_debit_credit(rows, ["row_no"])


@register("norm_two_amount_columns", _OUT, _sql(
    f"CASE WHEN regexp_matches(trim(d_flex),'{CN}') AND {q_flex('d_flex')} IS NULL THEN 'error' "
    f"WHEN {q_flex('d_flex')} IS NULL OR NOT (coalesce({q_clean('out_text')} > 0, false) OR coalesce({q_clean('in_text')} > 0, false)) THEN 'skip' ELSE 'ok' END",
    q_flex("d_flex"),
    f"CASE row_no % 5 WHEN 0 THEN CASE WHEN coalesce({q_clean('out_text')} > 0, false) THEN '支出交易' ELSE '收入交易' END WHEN 1 THEN 'kind' ELSE summary END",
    f"CASE WHEN coalesce({q_clean('out_text')} > 0, false) THEN {q_clean('out_text')} ELSE {q_clean('in_text')} END",
    f"CASE WHEN coalesce({q_clean('out_text')} > 0, false) THEN 'expense' ELSE 'income' END", "counterparty", "reference_number",
    f"""nullif(concat_ws('; ', CASE WHEN {q_clean('balance_text')} IS NOT NULL THEN concat('余额:', {q_clean_text('balance_text')}) END,
    CASE WHEN remark <> '' THEN concat('对方账号:', remark) END,
    CASE WHEN row_no % 2 = 0 THEN concat('业务参考号:', plain) END),'')""", "account_number"), ("stmt_rows",))
def norm_two_amount_columns(d: Data):
    m = c("row_no") % 5
    rows = d.view("stmt_rows").select(
        "row_no", F.when(c("row_no") % 2 == 0, c("d_flex")).otherwise("").alias("value_date"), c("d_flex").alias("trade_date"),
        c("out_text").alias("debit_amount"), c("in_text").alias("credit_amount"),
        F.when(m <= 1, "").otherwise(c("summary")).alias("summary"), F.when(m == 0, "").otherwise("kind").alias("transaction_type"),
        c("reference_number").alias("serial_no"), "counterparty", c("balance_text").alias("balance"),
        c("remark").alias("counterparty_account"),
        F.when(c("row_no") % 2 == 0, c("plain")).otherwise(c("reference_number")).alias("business_ref"),
        c("account_number").alias("account_no"), F.lit("").alias("account_name"))
    return N.two_amount_columns(rows, ["row_no"])


@register("norm_signed_amount", _OUT, _sql(
    f"CASE WHEN trim(a_strict) <> '' AND {q_compact_bad('d_compact')} THEN 'error' "
    f"WHEN trim(a_strict) = '' OR {q_compact('d_compact')} IS NULL OR {q_strict('a_strict')} IS NULL THEN 'skip' ELSE 'ok' END",
    q_compact("d_compact"), "concat_ws(' | ', flag, CASE WHEN remark <> '' THEN concat('票据号:', remark) END, summary)",
    f"abs({q_strict('a_strict')})", f"CASE WHEN {q_strict('a_strict')} > 0 THEN 'income' ELSE 'expense' END", "counterparty",
    "nullif(remark,'')", _note_balance(), "NULL"), ("stmt_rows",))
def norm_signed_amount(d: Data):
    rows = d.view("stmt_rows").select(
        "row_no", c("d_compact").alias("date"), c("flag").alias("business_type"), c("remark").alias("bill_no"),
        c("summary").alias("description"), c("a_strict").alias("amount"), c("balance_text").alias("balance"), "counterparty")
    return N.signed_amount(rows, ["row_no"])


_OUT0 = f"(CASE WHEN trim(out_text) = '' THEN 0 ELSE {q_strict('out_text')} END)"
_IN0 = f"(CASE WHEN trim(in_text) = '' THEN 0 ELSE {q_strict('in_text')} END)"


@register("norm_exclusive_out_in", _OUT, _sql(
    f"CASE WHEN {q_compact_bad('d_compact')} THEN 'error' WHEN {q_compact('d_compact')} IS NULL OR {_OUT0} IS NULL OR {_IN0} IS NULL "
    f"OR NOT ({_OUT0} > 0 OR {_IN0} > 0) THEN 'skip' ELSE 'ok' END",
    q_compact("d_compact"), "CASE WHEN remark <> '' THEN concat(CASE WHEN row_no % 7 = 0 THEN '银行交易' ELSE summary END,' | 票据号:',remark) "
    "ELSE CASE WHEN row_no % 7 = 0 THEN '银行交易' ELSE summary END END",
    f"CASE WHEN {_OUT0} > 0 THEN {_OUT0} ELSE {_IN0} END", f"CASE WHEN {_OUT0} > 0 THEN 'expense' ELSE 'income' END", "counterparty",
    "nullif(remark,'')", _note_balance(), "NULL"), ("stmt_rows",))
def norm_exclusive_out_in(d: Data):
    rows = d.view("stmt_rows").select(
        "row_no", c("d_compact").alias("date"), F.when(c("row_no") % 7 == 0, "交易类型").otherwise(c("summary")).alias("biz_type"),
        c("remark").alias("bill_no"), c("out_text").alias("expense"), c("in_text").alias("income"), "counterparty",
        c("balance_text").alias("balance"))
    return N.exclusive_out_in(rows, ["row_no"])


@register("norm_out_in_default_zero", _OUT, _sql(
    f"CASE WHEN row_no % 9 = 0 OR {_day('trim(d_iso)', ISO)} IS NULL THEN 'skip' ELSE 'ok' END",
    _day("trim(d_iso)", ISO), "CASE row_no % 4 WHEN 0 THEN '' WHEN 1 THEN flag ELSE summary END",
    f"CASE WHEN {q_lenient('in_text')} > 0 THEN {q_lenient('in_text')} ELSE {q_lenient('a_lenient')} END",
    f"CASE WHEN {q_lenient('in_text')} > 0 THEN 'income' ELSE 'expense' END", "counterparty",
    r"regexp_replace(concat(account_number, '**', reference_number, 'x'),'[^\d*]+$','')", "nullif(balance_text,'')", "NULL"), ("stmt_rows",))
def norm_out_in_default_zero(d: Data):
    m = c("row_no") % 4
    rows = d.view("stmt_rows").select(
        "row_no", F.when(c("row_no") % 9 == 0, 8).otherwise(12).alias("cells"), c("d_iso").alias("date"),
        c("a_lenient").alias("amount_out"), c("in_text").alias("amount_in"), "counterparty",
        F.when(m <= 1, "").otherwise(c("summary")).alias("purpose"), F.when(m == 0, "").otherwise(c("flag")).alias("type"),
        F.concat("account_number", F.lit("**|"), "reference_number", F.lit("x")).alias("ref"), c("balance_text").alias("balance"))
    return N.out_in_default_zero(rows, ["row_no"])


_RD = (f"(CASE WHEN regexp_matches(d_receipt,'{CN}') THEN {_day('d_receipt', CN)} WHEN regexp_matches(d_receipt,'{PACKED}') "
       f"THEN {_day('d_receipt', PACKED)} ELSE {_day('d_receipt', ISO)} END)")


@register("norm_receipt_by_type", _OUT, _sql(
    f"CASE WHEN {_RD} IS NULL OR {q_cny('a_cny')} IS NULL OR {q_cny('a_cny')} = 0 THEN 'error' ELSE 'ok' END",
    _RD, "CASE row_no % 5 WHEN 0 THEN '收费' WHEN 1 THEN 'kind' WHEN 2 THEN CASE WHEN flag='借' THEN '支出交易' ELSE '收入交易' END ELSE summary END",
    q_cny("a_cny"), "CASE WHEN flag='借' THEN 'expense' ELSE 'income' END",
    "CASE WHEN flag='借' THEN 'other' ELSE counterparty END", "reference_number",
    "concat_ws('; ', concat('流水:', plain), CASE WHEN row_no % 2 = 0 THEN concat('业务编号:', num, '#') END)",
    "CASE WHEN flag='借' THEN account_number END"), ("stmt_rows",))
def norm_receipt_by_type(d: Data):
    m = c("row_no") % 5
    rows = d.view("stmt_rows").select(
        "row_no", F.when(c("flag") == "借", "expense").otherwise("income").alias("receipt_type"), c("d_receipt").alias("trade_date"),
        c("a_cny").alias("amount_raw"), c("counterparty").alias("payer_name"), c("account_number").alias("payer_account"),
        F.lit("other").alias("payee_name"), F.lit("").alias("payee_account"),
        F.when(m == 0, "收费").when(m <= 2, "").otherwise(c("summary")).alias("summary"),
        F.when(m == 1, "kind").otherwise("").alias("business_type"), c("reference_number").alias("receipt_no"),
        c("plain").alias("transaction_id"), F.when(c("row_no") % 2 == 0, F.concat("num", F.lit("#"))).otherwise(c("plain")).alias("business_no"))
    return N.receipt_by_type(rows, ["row_no"])


_PARTIES = """(SELECT s.*, CASE row_no % 4 WHEN 0 THEN account_number WHEN 1 THEN '6222****1234' ELSE '99990001' END AS payer_account,
 CASE row_no % 3 WHEN 0 THEN '6222080000000014' WHEN 1 THEN '' ELSE '88880001' END AS payee_account,
 counterparty AS payer_name, CASE WHEN row_no % 5 = 0 THEN '' ELSE 'payee' END AS payee_name FROM stmt_rows s)"""
_HIT = "(SELECT count(*) FROM accounts a WHERE {0} <> '' AND NOT contains({0},'*') AND ((a.match_type='exact' AND a.pattern={0}) OR (a.match_type='suffix' AND ends_with({0},a.pattern))))"
_FLAGGED = f"(SELECT *, {_HIT.format('payer_account')} > 0 AS pays, {_HIT.format('payee_account')} > 0 AS gets FROM {_PARTIES} p)"
_SHOW = "CASE WHEN {n} = '' THEN NULL WHEN {a} <> '' AND NOT contains({a},'*') THEN concat({n},'（',{a},'）') ELSE {n} END"
_OTHER = (f"CASE WHEN pays THEN {_SHOW.format(n='payee_name', a='payee_account')} WHEN gets THEN {_SHOW.format(n='payer_name', a='payer_account')} "
          "ELSE coalesce(nullif(payee_name,''), nullif(payer_name,'')) END")


def _parties(d: Data):
    m = c("row_no")
    return d.view("stmt_rows").withColumns({
        "payer_account": F.when(m % 4 == 0, c("account_number")).when(m % 4 == 1, "6222****1234").otherwise("99990001"),
        "payee_account": F.when(m % 3 == 0, "6222080000000014").when(m % 3 == 1, "").otherwise("88880001"),
        "payer_name": c("counterparty"), "payee_name": F.when(m % 5 == 0, "").otherwise("payee"),
    })


@register("infer_direction", "row_no:l direction:s own_account:s other_party:s",
          f"""SELECT row_no, CASE WHEN pays THEN 'expense' WHEN gets THEN 'income' ELSE 'expense' END AS direction,
          CASE WHEN pays THEN payer_account WHEN gets THEN payee_account END AS own_account, {_OTHER} AS other_party FROM {_FLAGGED} f""",
          ("stmt_rows", "accounts"))
def infer_direction(d: Data):
    from ..operators.accounts import infer_direction as op

    return op(_parties(d), d.view("accounts"))


@register("norm_receipt_by_registry", _OUT, _sql(
    f"CASE WHEN coalesce({q_cn('d_cn')}, {_day('ts', '^' + ISO)}) IS NULL THEN 'error' ELSE 'ok' END",
    f"coalesce({q_cn('d_cn')}, {_day('ts', '^' + ISO)})",
    "coalesce(nullif(concat_ws(' | ', nullif(remark,''), CASE WHEN row_no % 2 = 0 AND plain <> remark THEN plain END),''),'银行回单')",
    q_lenient("a_lenient"), "CASE WHEN pays THEN 'expense' WHEN gets THEN 'income' ELSE 'expense' END", _OTHER, "reference_number",
    "summary", "CASE WHEN pays THEN payer_account WHEN gets THEN payee_account END",
    f"(SELECT *, CASE WHEN row_no % 6 = 0 THEN d_ts ELSE '' END AS ts FROM {_FLAGGED} f)"), ("stmt_rows", "accounts"))
def norm_receipt_by_registry(d: Data):
    rows = _parties(d).select(
        "row_no", c("d_cn").alias("accounting_date"), F.when(c("row_no") % 6 == 0, c("d_ts")).otherwise("").alias("timestamp"),
        c("a_lenient").alias("amount_text"), "payer_account", "payee_account", "payer_name", "payee_name",
        c("remark").alias("purpose"), F.when(c("row_no") % 2 == 0, c("plain")).otherwise("").alias("usage"),
        c("remark").alias("business_type"), c("reference_number").alias("ref_no"), F.concat(F.lit("备注："), "summary").alias("notes"))
    return N.receipt_by_registry(rows, d.view("accounts"), ["row_no"])


@register("norm_receipt_labels", _OUT, _sql(
    f"CASE WHEN coalesce({q_cn('d_cn')}, {_day('ts', '^' + ISO)}) IS NULL THEN 'skip' ELSE 'ok' END",
    f"coalesce({q_cn('d_cn')}, {_day('ts', '^' + ISO)})",
    "coalesce(nullif(concat_ws(' | ', CASE WHEN row_no % 5 = 0 THEN NULL ELSE summary END, nullif(remark,'')),''),'银行回单')",
    q_lenient("a_lenient"), "'expense'",
    "CASE WHEN row_no % 3 = 0 THEN counterparty WHEN row_no % 3 = 1 THEN NULL ELSE counterparty END", "reference_number",
    "concat_ws(' | ', CASE WHEN remark <> '' THEN concat('备注:', remark) END, concat('付款人:', counterparty), "
    "CASE WHEN row_no % 3 = 1 THEN concat('收款人:', account_number) END, concat('大写:', num))", "NULL",
    "(SELECT *, CASE WHEN row_no % 6 = 0 THEN d_ts ELSE '' END AS ts FROM stmt_rows)"), ("stmt_rows",))
def norm_receipt_labels(d: Data):
    m = c("row_no")
    rows = d.view("stmt_rows").select(
        "row_no", c("d_cn").alias("date"), F.when(m % 6 == 0, c("d_ts")).otherwise("").alias("timestamp"), c("a_lenient").alias("amount_text"),
        c("counterparty").alias("payer"), F.when(m % 3 == 0, c("counterparty")).when(m % 3 == 1, c("account_number")).otherwise("").alias("payee"),
        F.when(m % 5 == 0, "摘要").otherwise(F.concat(F.lit("业务种类"), "summary", F.lit("用途 ￥12.50元 | 1234567"))).alias("purpose"),
        c("remark").alias("usage"), F.concat(F.lit("交易流水号"), "reference_number", F.lit("备注")).alias("ref_no"),
        c("remark").alias("notes"), F.lit("").alias("postscript"), F.lit("").alias("receipt_no"), c("num").alias("amount_cn"))
    return N.receipt_labels(rows, ["row_no"])


_LINE = "CASE row_no % 5 WHEN 0 THEN concat(iso,'  ',summary,'  ',plain,' Acme Bank') WHEN 1 THEN concat(summary,' ',replace(iso,'-','/'),' -',plain) " \
        "WHEN 2 THEN concat(packed,' +',plain) WHEN 3 THEN concat(substring(iso,1,4),'-02-31 x ',plain) ELSE summary END"
_REST = "trim(CASE row_no % 5 WHEN 0 THEN concat(summary,'   Acme Bank') WHEN 1 THEN summary ELSE '' END)"


@register("extract_line_records", "row_no:l line_no:l status:s txn_date:s description:s amount:f direction:s counterparty:s",
          """SELECT row_no, line_no, status, CASE WHEN status='ok' THEN txn_date END AS txn_date,
          CASE WHEN status='ok' THEN CASE k WHEN 0 THEN summary WHEN 1 THEN array_to_string(w[1:len(w)-1],' ') ELSE '银行交易' END END AS description,
          CASE WHEN status='ok' THEN amount END AS amount,
          CASE WHEN status='ok' THEN CASE WHEN k = 1 THEN 'expense' ELSE 'income' END END AS direction,
          CASE WHEN status='ok' THEN CASE k WHEN 0 THEN 'Acme Bank' WHEN 1 THEN w[len(w)] END END AS counterparty
          FROM (SELECT *, row_no % 5 AS k, 0 AS line_no, string_split(summary,' ') AS w,
                CASE row_no % 5 WHEN 3 THEN 'error' WHEN 4 THEN 'skip' ELSE 'ok' END AS status FROM stmt_rows
                UNION ALL SELECT *, row_no % 5, 1, [], 'skip' FROM stmt_rows)""", ("stmt_rows",))
def extract_line_records(d: Data):
    text = d.view("stmt_rows").select("row_no", F.expr(f"concat({_LINE}, '\\nend of page')").alias("text"))
    return N.line_records(N.text_lines(text, "row_no"), ["row_no", "line_no"])


@register("document_lines", "doc_id:l lines:l records:l",
          r"""SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line,'\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8}')
          AND regexp_matches(line,'[+-]?\d+\.\d{2}')) AS records
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def document_lines(d: Data):
    rows = N.line_records(N.text_lines(d.table("documents"), "doc_id"), ["doc_id", "line_no"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") != "skip").alias("records"))


@register("extract_html_text", "page_id:l t:s",
          """SELECT page_id, replace(replace(replace(replace(replace(replace(array_to_string(regexp_extract_all(html,'<p[^>]*>([^<]+)</p>',1), chr(10)),
          '&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',chr(160)),'&amp;','&') AS t FROM pages""")
def extract_html_text(d: Data):
    return d.table("pages").select("page_id", N.html_text(F.col("html"), "p").alias("t"))


@register("txn_cast_defaults", "row_no:l txn_date:s description:s amount:f currency:s direction:s counterparty:s",
          f"""SELECT row_no, {q_iso('iso')} AS txn_date, CASE WHEN row_no % 3 = 0 THEN '' ELSE summary END AS description,
          coalesce({q_strict('a_strict')}, 0) AS amount, 'CNY' AS currency, CASE WHEN row_no % 2 = 0 THEN 'expense' ELSE direction END AS direction,
          counterparty FROM stmt_rows""", ("stmt_rows",))
def txn_cast_defaults(d: Data):
    m = c("row_no")
    raw = d.view("stmt_rows").select(
        "row_no", c("iso").alias("date"), F.when(m % 3 != 0, c("summary")).alias("description"), c("a_strict").alias("amount"),
        F.when(m % 2 != 0, c("direction")).alias("direction"), "counterparty")
    return N.cast_defaults(raw, ["row_no"])


@register("txn_to_plain", "referenceNumber:s accountNumber:s date:s amount:f direction:s",
          "SELECT reference_number AS referenceNumber, account_number AS accountNumber, txn_date AS date, amount, direction FROM txn", ("txn",))
def txn_to_plain(d: Data):
    return N.to_plain(d.view("txn").withColumns({"notes": F.lit(None).cast("string"), "account_name": F.lit(None).cast("string")}))

"""Queries: sheets, CSV files, positioned text, receipts, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CMB_BANDS, CMB_HEADER_KEYS, GFB_BANDS, GFB_HEADER_KEYS, GFB_LABELS
from ..operators import layout as L
from ..operators import normalize as N
from ..session import spread, work_path
from ..sources import cells as CE
from ..sources import csv_statement as CSV
from .base import Data, register
from .norm import ISO, _day

c = F.col


# --- sheets and CSV ----------------------------------------------------------------------

@register("scan_sheet_cells", "file_id:s row:l value_date:s debit_amount:s credit_amount:s summary:s counterparty:s trade_date:s",
          """SELECT file_id, 5 + rn AS row, CASE WHEN row_no % 3 = 0 THEN packed ELSE iso END AS value_date, CASE WHEN row_no % 2 = 0 THEN trim(out_text) END AS debit_amount,
          CASE WHEN row_no % 3 = 0 THEN num END AS credit_amount, summary, counterparty, NULL AS trade_date
          FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS rn FROM stmt_rows) WHERE row_no % 2 = 0 OR row_no % 3 = 0""", ("stmt_rows",))
def scan_sheet_cells(d: Data):
    return CE.scan_sheet_cells(d.stored("sheet_cells"))


@register("sheet_transactions", "file_id:s row:l status:s txn_date:s amount:f direction:s description:s",
          """SELECT file_id, 5 + rn AS row, CASE WHEN dr > 0 OR row_no % 3 = 0 THEN 'ok' ELSE 'skip' END AS status,
          CASE WHEN dr > 0 OR row_no % 3 = 0 THEN txn_date END AS txn_date, CASE WHEN dr > 0 OR row_no % 3 = 0 THEN amount END AS amount,
          CASE WHEN dr > 0 THEN 'expense' WHEN row_no % 3 = 0 THEN 'income' END AS direction, CASE WHEN dr > 0 OR row_no % 3 = 0 THEN summary END AS description
          FROM (SELECT *, CASE WHEN row_no % 2 = 0 AND out_text <> '' THEN amount ELSE 0 END AS dr, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS rn FROM stmt_rows)
          WHERE row_no % 2 = 0 OR row_no % 3 = 0""", ("stmt_rows",))
def sheet_transactions(d: Data):
    return N.two_amount_columns(CE.scan_sheet_cells(d.stored("sheet_cells")), ["file_id", "row"])


@register("sheet_metadata", "file_id:s field:s value:s",
          """SELECT file_id, field, CASE field WHEN 'account_no' THEN concat('6222', file_id) WHEN 'account_name' THEN concat('公司', file_id)
          WHEN 'opening_balance' THEN concat(cast(n as varchar), ',000.50') ELSE cast(n + 1 as varchar) END AS value
          FROM (SELECT file_id, count(*) AS n FROM stmt_rows GROUP BY file_id) CROSS JOIN (VALUES ('account_no'),('account_name'),('opening_balance'),('closing_balance')) f(field)""",
          ("stmt_rows",))
def sheet_metadata(d: Data):
    return CE.sheet_metadata(d.stored("sheet_cells"))


def _csv(d: Data) -> str:
    """Statement rows as GBK files, one directory per statement, with both marker rows."""
    rows = d.view("stmt_rows").select(
        "file_id", "row_no", c("row_no").cast("string").alias("voucher"), "account_number", "reference_number", F.lit("10:00").alias("t"), "iso",
        "flag", "out_text", "in_text", F.lit("").alias("bank"), F.concat(F.lit("贷款, "), "summary", F.lit("\t")).alias("s"), "remark",
        F.lit("用途").alias("u"), "counterparty", "balance_text")
    files = rows.select("file_id").distinct()
    blank = [F.lit(None).cast("string").alias(x) for x in rows.columns[3:]]
    marks = files.select("file_id", F.lit(-2).cast("bigint").alias("row_no"), F.lit("[HISTORYDETAIL]").alias("voucher"), *blank).unionByName(
        files.select("file_id", F.lit(-1).cast("bigint").alias("row_no"), F.lit("凭证号").alias("voucher"), *blank))
    path = work_path(d.spark, "csv")
    d.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    ordered = rows.unionByName(marks).repartition("file_id").sortWithinPartitions("file_id", "row_no").drop("row_no")
    ordered.write.option("encoding", "GBK").partitionBy("file_id").csv(path)
    return path


@register("scan_csv_statement", "file:s row_no:l voucher:s own_account:s value_date:s flag:s debit:s summary:s counterparty:s balance:s",
          """SELECT file_id AS file, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS row_no, cast(row_no as varchar) AS voucher, account_number AS own_account,
          iso AS value_date, flag, out_text AS debit, concat('贷款, ', summary) AS summary, counterparty, balance_text AS balance FROM stmt_rows""", ("stmt_rows",))
def scan_csv_statement(d: Data):
    rows = CSV.number_rows(CSV.scan_csv_statement(d.spark, _csv(d)))
    return rows.withColumn("file", F.regexp_extract("file_id", "file_id=([^/]+)/", 1))


@register("csv_edge_balances", "file:s opening_balance:f closing_balance:f",
          """SELECT file_id AS file, first(b ORDER BY row_no) AS opening_balance, last(b ORDER BY row_no) AS closing_balance
          FROM (SELECT *, cast(nullif(replace(balance_text,',',''),'') as decimal(18,2)) AS b FROM stmt_rows) GROUP BY file_id""", ("stmt_rows",))
def csv_edge_balances(d: Data):
    from ..functions.amounts import amount_strict

    scanned = CSV.scan_csv_statement(d.spark, _csv(d))
    out = CSV.edge_balances(scanned, amount_strict(c("balance")))
    return out.withColumn("file", F.regexp_extract("file_id", "file_id=([^/]+)/", 1))


# --- default configuration ---------------------------------------------------------------

# (text, direction, party, expected subject)
_CASES = (
    ("报销", "expense", "", "50602"), ("电信费", "expense", "", "5060216"), ("团险保费", "expense", "", "5060211"),
    ("支付保证金", "expense", "", "1022104"), ("收到退押金", "income", "", "1022104"), ("退回手续费", "income", "", "1022120"),
    ("小企业短期普通贷款利息收入", "income", "", "1022103"), ("支付物业管理费", "expense", "启胜物业", "5060203"),
    ("收到货款", "income", "", "10122"), ("未知交易类型", "expense", "", ""), ("收到退保证金", "expense", "", ""),
    ("社会保险费", "expense", "", "5060210"),
)
_CASE_SQL = ",".join(f"({i},'{way}','{code}')" for i, (_, way, _, code) in enumerate(_CASES))


@register("load_rules", "txn_seq:l direction:s subject_code:s",
          f"SELECT txn_seq, x.way AS direction, x.code AS subject_code FROM txn JOIN (VALUES {_CASE_SQL}) x(i, way, code) ON x.i = txn_seq % {len(_CASES)}", ("txn",))
def load_rules(d: Data):
    from ..operators.classify import load_rules as op
    from ..operators.similarity import classify

    pick = (c("txn_seq") % len(_CASES)).cast("int")
    at = lambda i: F.get(F.array(*(F.lit(x[i]) for x in _CASES)), pick)
    texts = d.view("txn").select("txn_seq", F.concat(at(0), F.lit(" "), c("txn_seq").cast("string")).alias("description"),
                                 at(1).alias("direction"), at(2).alias("counterparty"))
    return classify(texts, op(d.spark))


@register("load_accounts", "c_custkey:l subject_code:s",
          """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '1000201' WHEN 1 THEN '1000202' WHEN 2 THEN '1000203' WHEN 3 THEN '1000204' WHEN 4 THEN '1000205' ELSE '10002' END AS subject_code FROM customer""")
def load_accounts(d: Data):
    from ..operators.accounts import bank_subject, match_accounts
    from ..operators.accounts import load_accounts as op

    tail = F.get(F.array(*(F.lit(x) for x in ("4363", "0146", "0288", "0118", "7931", "9999"))), (c("c_custkey") % 6).cast("int"))
    numbers = d.table("customer").select("c_custkey", F.concat(c("c_custkey").cast("string"), tail).alias("account_number"))
    return match_accounts(numbers, op(d.spark)).select("c_custkey", bank_subject(c("own"))[0].alias("subject_code"))


# --- positioned text ---------------------------------------------------------------------

_CLUSTERED = """(SELECT *, sum(jump) OVER (PARTITION BY page_id ORDER BY y0, span_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (
 SELECT *, CASE WHEN lag(y0) OVER (PARTITION BY page_id ORDER BY y0, span_id) IS NULL OR y0 - lag(y0) OVER (PARTITION BY page_id ORDER BY y0, span_id) > {gap} THEN 1 ELSE 0 END AS jump FROM {src}))"""


@register("gap_cluster", "page_id:l span_id:l cluster:l", f"SELECT page_id, span_id, cluster FROM {_CLUSTERED.format(gap='2.0', src='spans')}", ("spans",))
def gap_cluster(d: Data):
    return L.gap_clusters(d.view("spans"), 2.0)


_BANDS = ",".join(f"({i},'{n}',{lo},{hi})" for i, (n, (lo, hi)) in enumerate(CMB_BANDS.items()))


@register("band_join", "page_id:l span_id:l band:s",
          f"""SELECT page_id, span_id, CASE WHEN hit OR dist < 40 THEN name END AS band FROM (
          SELECT *, row_number() OVER (PARTITION BY page_id, span_id ORDER BY hit DESC, CASE WHEN hit THEN i ELSE dist END, i) AS rn FROM (
          SELECT page_id, span_id, name, i, x0 BETWEEN lo AND hi AS hit, abs(cast(x0 as double) - (lo + hi) / 2) AS dist FROM spans CROSS JOIN (VALUES {_BANDS}) b(i, name, lo, hi))) WHERE rn = 1""",
          ("spans",))
def band_join(d: Data):
    return d.view("spans").withColumn("band", L.column_band(c("x0"), CMB_BANDS))


_REGION = f"""(SELECT page_id, coalesce(min(title) - 5, 105.0) AS table_start, max_by(CASE WHEN d AND a THEN bottom END, CASE WHEN d AND a THEN cluster END) AS data_end, max(bottom) AS all_end FROM (
 SELECT page_id, cluster, bool_or(regexp_matches(text,'\\d{{8}}')) AS d, bool_or(regexp_matches(text,'-?\\d[\\d,]*\\.\\d{{2}}')) AS a, max(y1) AS bottom,
 min(CASE WHEN contains(text,'交易日期') OR contains(text,'Date') OR contains(text,'日期') THEN y0 END) AS title FROM {_CLUSTERED.format(gap='2.5', src='page_spans')} GROUP BY page_id, cluster) GROUP BY page_id)"""
_END = "CASE WHEN data_end > table_start THEN data_end + 10 ELSE all_end END"
_TITLES = ["交易日期", "Date", "日期"]


@register("table_region", "page_id:l table_start:f table_end:f", f"SELECT page_id, table_start, {_END} AS table_end FROM {_REGION}", ("page_spans",))
def table_region(d: Data):
    return L.table_regions(d.stored("page_spans"), _TITLES)


@register("partition_spans", "page_id:l span_id:l part:s",
          f"""SELECT page_id, span_id, CASE WHEN y0 < table_start - 5 THEN 'header' WHEN y0 <= {_END} + 5 THEN 'table' ELSE 'footer' END AS part
          FROM page_spans JOIN {_REGION} USING (page_id)""", ("page_spans",))
def partition_spans(d: Data):
    return L.partition_spans(d.stored("page_spans"), _TITLES)


_REC = "page_id:l record:l date:s business_type:s description:s amount:s counterparty:s"
_RECSQL = """SELECT cast(floor(row_no / 50) as bigint) AS page_id, row_number() OVER (PARTITION BY cast(floor(row_no / 50) as bigint) ORDER BY row_no) AS record, packed AS date, flag AS business_type,
 CASE WHEN row_no % 3 = 0 THEN concat(summary, ' more ', cast(row_no % 7 as varchar)) ELSE summary END AS description,
 CASE WHEN row_no % 2 = 0 THEN concat('-', num) ELSE num END AS amount, counterparty FROM stmt_rows"""


def _table_rows(d: Data):
    return L.table_records(d.stored("page_spans"), _TITLES, CMB_BANDS, ["amount"])


@register("merge_continuations", _REC, _RECSQL, ("stmt_rows",))
def merge_continuations(d: Data):
    return _table_rows(d)


@register("table_statement", "page_id:l record:l status:s txn_date:s amount:f direction:s description:s counterparty:s",
          f"""SELECT page_id, record, 'ok' AS status, {_day('iso', '^' + ISO)} AS txn_date, amt AS amount, CASE WHEN row_no % 2 = 0 THEN 'expense' ELSE 'income' END AS direction,
          concat(business_type, ' | ', description) AS description, counterparty FROM (SELECT *, q.amount AS txt FROM ({_RECSQL.replace('FROM stmt_rows', ', row_no, iso, stmt_rows.amount AS amt FROM stmt_rows')}) q)""",
          ("stmt_rows",))
def table_statement(d: Data):
    rows = _table_rows(d)
    return N.signed_amount(rows, ["page_id", "record"])


@register("table_statement_gfb", "page_id:l record:l status:s txn_date:s amount:f direction:s description:s counterparty:s",
          f"""SELECT cast(floor(row_no / 50) as bigint) AS page_id, row_number() OVER (PARTITION BY cast(floor(row_no / 50) as bigint) ORDER BY row_no) AS record, 'ok' AS status,
          {_day('iso', '^' + ISO)} AS txn_date, amount, CASE WHEN row_no % 2 = 0 THEN 'expense' ELSE 'income' END AS direction,
          concat(CASE WHEN row_no % 5 = 0 OR remark = '' THEN '银行交易' ELSE remark END, CASE WHEN row_no % 3 = 0 THEN concat(' | 票据号:', reference_number) ELSE '' END) AS description,
          counterparty FROM stmt_rows""", ("stmt_rows",))
def table_statement_gfb(d: Data):
    rows = L.table_records(d.stored("two_way_spans"), ["交易日期", "交易类型"], GFB_BANDS, ["expense", "income"], require_all=True, labels=GFB_LABELS)
    return N.exclusive_out_in(rows, ["page_id", "record"])


@register("page_statement_summary", "page_id:l account_no:s account_name:s opening_balance:f closing_balance:f period_start:s period_end:s",
          """SELECT page_id, concat('6222', cast(page_id as varchar)) AS account_no, concat('公司', cast(page_id as varchar)) AS account_name,
          page_id * 1000 + 1.25 AS opening_balance, count(*) + 0.5 AS closing_balance, '2024-01-01' AS period_start, concat('2024-01-', cast(10 + page_id % 20 as varchar)) AS period_end
          FROM (SELECT cast(floor(row_no / 50) as bigint) AS page_id FROM stmt_rows) GROUP BY page_id""", ("stmt_rows",))
def page_statement_summary(d: Data):
    return L.page_statement(d.stored("headed_spans"), _TITLES, CMB_HEADER_KEYS, "期末余额", same_line=True)


_ASOF = """(SELECT * FROM (SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos, kind, span_id ROWS UNBOUNDED PRECEDING) AS owner FROM (
 SELECT page_id, span_id, cast(y0 as double) AS pos, 1 AS kind, NULL AS anchor FROM spans
 UNION ALL SELECT page_id, span_id, cast(y0 as double) - 5, 0, span_id FROM spans WHERE span_id % 50 = 11 AND page_id % 7 <> 0)) WHERE kind = 1)"""


@register("anchor_interval", "page_id:l span_id:l owner:l",
          f"SELECT page_id, span_id, coalesce(owner, 0) AS owner FROM {_ASOF} WHERE owner IS NOT NULL OR page_id NOT IN (SELECT page_id FROM spans WHERE span_id % 50 = 11 AND page_id % 7 <> 0)", ("spans",))
def anchor_interval(d: Data):
    return L.anchor_intervals(d.view("spans"), (c("span_id") % 50 == 11) & (c("page_id") % 7 != 0), 5.0, "owner")


@register("split_receipts", "page_id:l span_id:l receipt:l",
          f"SELECT page_id, span_id, coalesce(owner, 0) AS receipt FROM {_ASOF} WHERE owner IS NOT NULL OR page_id NOT IN (SELECT page_id FROM spans WHERE span_id % 50 = 11 AND page_id % 7 <> 0)", ("spans",))
def split_receipts(d: Data):
    titled = (c("span_id") % 50 == 11) & (c("page_id") % 7 != 0)
    spans = d.view("spans").withColumns({
        "text": F.when(titled, "招 行 出 账 回单").when(c("span_id") % 3 == 0, "入账回单").otherwise("x"),
        "size": F.when(titled, 14.0).otherwise(9.0)})
    return L.split_receipts(spans)


_NEARTEXT = "CASE WHEN span_id % 97 = 1 THEN CASE WHEN span_id % 2 = 0 THEN '期末余额 1,234.50 元' ELSE '期末余额' END WHEN span_id % 5 = 0 THEN 'abc' ELSE cast(amt as {0}) END"


@register("nearest_value", "page_id:l label:s value:s",
          f"""SELECT l.page_id, l.text AS label, coalesce(nullif(regexp_extract(l.text,'(\\d[\\d,]*\\.\\d{{2}})',1),''), n.text) AS value
          FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS first FROM @p WHERE contains(text,'期末余额')) WHERE first = 1) l
          LEFT JOIN (SELECT a.page_id, b.text, row_number() OVER (PARTITION BY a.page_id ORDER BY abs(b.i - a.i), b.i < a.i) AS rn
            FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS first FROM @p WHERE contains(text,'期末余额')) WHERE first = 1) a
            JOIN @p b ON a.page_id = b.page_id AND b.i <> a.i AND abs(b.i - a.i) <= 5 AND abs(a.y0 - b.y0) < 3 AND regexp_matches(b.text,'^-?\\d[\\d,]*\\.\\d{{2}}$')) n
          ON n.page_id = l.page_id AND n.rn = 1""".replace("@p", f"(SELECT *, {_NEARTEXT.format('varchar')} AS text, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, span_id) AS i FROM spans)"),
          ("spans",))
def nearest_value(d: Data):
    return L.nearest_values(d.view("spans").withColumn("text", F.expr(_NEARTEXT.format("string"))), "期末余额")


_BLOCK = "SELECT page_id, span_id, cast(x0 as double) AS x0, cast(x0 as double) + 15 AS x1, cast(y0 as double) + 4 AS cy, CASE WHEN span_id % 31 = 1 THEN '金额' WHEN span_id % 7 = 0 THEN '用途说明' WHEN span_id % 7 = 1 THEN 'x' ELSE cast(amt as {0}) END AS text FROM spans"


@register("right_neighbour", "page_id:l label_id:l value:s",
          f"""SELECT page_id, label_id, value FROM (SELECT a.page_id, a.span_id AS label_id, b.text AS value, row_number() OVER (PARTITION BY a.page_id, a.span_id ORDER BY b.x0 - a.x1, b.span_id) AS rn
          FROM ({_BLOCK.format('varchar')}) a JOIN ({_BLOCK.format('varchar')}) b ON a.page_id = b.page_id AND a.span_id <> b.span_id AND b.x0 - a.x1 > -10 AND b.x0 - a.x1 < 500 AND abs(a.cy - b.cy) <= 40
          WHERE a.text = '金额' AND regexp_matches(b.text,'^\\d+\\.\\d+$')) WHERE rn = 1""", ("spans",))
def right_neighbour(d: Data):
    blocks = d.sql(_BLOCK.format("string"), ("spans",))
    return L.right_neighbours(blocks, c("text") == "金额", r"\d[\d,]*\.?\d*")


_KV = """(SELECT *, text IN ('户名：','币 别:') AS open, sum(1) OVER (PARTITION BY page_id ORDER BY y0) AS i FROM (
 SELECT cast(floor(c_custkey / 60) as bigint) AS page_id, c_custkey AS span_id, c_custkey AS y0, CASE (c_custkey * 7 + cast(floor(c_custkey / 3) as bigint)) % 6 WHEN 0 THEN concat('账号：', c_name) WHEN 1 THEN '户名：' WHEN 2 THEN '币 别:'
 WHEN 3 THEN concat('plain ', c_name) WHEN 4 THEN concat('行所号: ', c_name) ELSE '其他：z' END AS text FROM customer) AS k)"""


@register("key_value_lookup", "page_id:l field:s value:s",
          f"""SELECT page_id, field, max_by(value, i) AS value FROM (SELECT *, CASE WHEN (i - 1 - closed) % 2 = 1 THEN CASE last WHEN '户名：' THEN 'account_name' ELSE 'currency' END
            WHEN starts_with(text,'账号：') THEN 'account_no' WHEN starts_with(text,'行所号') THEN 'bank_branch' END AS field,
            CASE WHEN (i - 1 - closed) % 2 = 1 THEN text ELSE trim(substring(text, CASE WHEN starts_with(text,'账号') THEN 4 ELSE 5 END)) END AS value FROM (
          SELECT *, coalesce(max(CASE WHEN NOT open THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
            lag(text) OVER (PARTITION BY page_id ORDER BY i) AS last FROM {_KV})) WHERE field IS NOT NULL GROUP BY page_id, field""")
def key_value_lookup(d: Data):
    spans = d.table("customer").select(
        F.floor(c("c_custkey") / 60).alias("page_id"), c("c_custkey").alias("span_id"), F.lit(10.0).alias("x0"), c("c_custkey").cast("double").alias("y0"),
        F.expr("CASE (c_custkey * 7 + cast(floor(c_custkey / 3) as bigint)) % 6 WHEN 0 THEN concat('账号：', c_name) WHEN 1 THEN '户名：' WHEN 2 THEN '币 别:' "
               "WHEN 3 THEN concat('plain ', c_name) WHEN 4 THEN concat('行所号: ', c_name) ELSE '其他：z' END").alias("text"))
    return L.key_values(spans, GFB_HEADER_KEYS)


@register("key_value_lookup_same_line", "page_id:l field:s value:s",
          """SELECT c_custkey AS page_id, f AS field, CASE f WHEN 'account_name' THEN c_name WHEN 'bank_branch' THEN concat('Branch ', cast(c_custkey as varchar))
          WHEN 'opening_balance' THEN cast(c_custkey as varchar) WHEN 'period' THEN '账号：' ELSE 'CNY' END AS value
          FROM customer, (SELECT unnest(['account_name','bank_branch','opening_balance','period','currency']) AS f)""")
def key_value_lookup_same_line(d: Data):
    rows = d.table("customer").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(9))))
    spans = rows.selectExpr(
        "c_custkey AS page_id", "j AS span_id", "CASE WHEN j IN (2, 5) THEN 200.0D ELSE 40.0D END AS x0",
        "element_at(array(10.0D, 11.0D, 20.0D, 30.0D, 32.0D, 40.0D, 50.0D, 60.0D, 70.0D), j) AS y0",
        "element_at(array('账号：', '账户名称：', c_name, '开户银行：', concat('上页余额：', c_custkey), concat('Branch ', c_custkey), '账单所属期间：', '账号：', '货币: CNY'), j) AS text")
    return L.key_values_same_line(spans, CMB_HEADER_KEYS)


_GRID = "SELECT DISTINCT page_id, r AS row, k AS col, cast(k * 50 as double) AS cx0, cast(r * 80 as double) AS cy0, cast(k * 50 + 50 as double) AS cx1, cast(r * 80 + 80 as double) AS cy1 FROM spans CROSS JOIN (SELECT {0} AS r) a CROSS JOIN (SELECT {1} AS k) b"
_GRID_DUCK = _GRID.format("unnest(range(1,8))", "unnest(range(1,9))")
_BOXES = "SELECT page_id, span_id, cast(x0 as double) AS x0, cast(y0 as double) AS y0, cast(x0 as double) + 30 AS x1, cast(y0 as double) + 6 AS y1 FROM spans"
_OVER = f"""(SELECT * FROM (SELECT b.page_id, b.span_id, row, col, row_number() OVER (PARTITION BY b.page_id, b.span_id ORDER BY greatest(0, least(x1,cx1)-greatest(x0,cx0)) * greatest(0, least(y1,cy1)-greatest(y0,cy0)) DESC, row, col) AS rn
 FROM ({_BOXES}) b JOIN ({_GRID_DUCK}) g ON b.page_id = g.page_id AND x0 < cx1 AND cx0 < x1 AND y0 < cy1 AND cy0 < y1) WHERE rn = 1)"""


def _grid(d: Data):
    pages = spread(d.view("spans").select("page_id").distinct(), "page_id")
    cells = pages.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(8))))
    r, k = c("row"), c("col")
    return cells.select("page_id", r.cast("bigint").alias("row"), k.cast("bigint").alias("col"), (k * 50).cast("double").alias("cx0"),
                        (r * 80).cast("double").alias("cy0"), (k * 50 + 50).cast("double").alias("cx1"), (r * 80 + 80).cast("double").alias("cy1"))


@register("cell_assign", "page_id:l span_id:l row:l col:l",
          f"""SELECT page_id, span_id, row, col FROM {_OVER} UNION ALL
          SELECT page_id, span_id, r AS row, arg_min(k, abs(k * 50 + 25 - x) * 1000 + k) AS col FROM (
            SELECT page_id, span_id, x, arg_min(r, abs(r * 80 + 40 - y) * 1000 + r) AS r FROM (SELECT page_id, span_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM ({_BOXES})
              WHERE (page_id, span_id) NOT IN (SELECT (page_id, span_id) FROM {_OVER})) CROSS JOIN (SELECT unnest(range(1,8)) AS r) GROUP BY ALL) CROSS JOIN (SELECT unnest(range(1,9)) AS k) GROUP BY page_id, span_id, r""", ("spans",))
def cell_assign(d: Data):
    return L.assign_cells(d.sql(_BOXES, ("spans",)), _grid(d))


@register("cell_assign_overlap", "page_id:l span_id:l row:l col:l", f"SELECT page_id, span_id, row, col FROM {_OVER}", ("spans",))
def cell_assign_overlap(d: Data):
    return L.assign_cells(d.sql(_BOXES, ("spans",)), _grid(d), nearest=False)


@register("ordered_text_concat", "page_id:l cluster:l text:s",
          f"SELECT page_id, cluster, string_agg(cast(span_id as varchar), '' ORDER BY x0, span_id) AS text FROM {_CLUSTERED.format(gap='2.0', src='spans')} GROUP BY page_id, cluster", ("spans",))
def ordered_text_concat(d: Data):
    rows = L.gap_clusters(d.view("spans"), 2.0).withColumn("text", c("span_id").cast("string"))
    return L.ordered_text(rows, ["page_id", "cluster"], ["x0", "span_id"])


_START = "CASE WHEN row_no % 3 <> 0 THEN b ELSE b + 1 END"
_GROWS = "(SELECT *, cast(floor(row_no / 25) as bigint) AS page_id, 14 * row_number() OVER (PARTITION BY cast(floor(row_no / 25) as bigint) ORDER BY row_no) AS b FROM stmt_rows)"


@register("title_group", "page_id:l row:l col:l receipt:l",
          f"SELECT g.page_id, g.row, g.col, {_START} AS receipt FROM grid_cells g JOIN {_GROWS} r USING (row_no)", ("grid_cells", "stmt_rows"))
def title_group(d: Data):
    return L.title_groups(d.stored("grid_cells"))


@register("fields_from_grid", "page_id:l receipt:l payer_name:s payee_name:s payer_account:s payee_account:s amount_text:s purpose:s usage:s business_type:s ref_no:s notes:s accounting_date:s amount_cn:s receipt_no:s",
          f"""SELECT page_id, {_START} AS receipt, counterparty AS payer_name, concat('收款', cast(row_no % 9 as varchar), '公司') AS payee_name, account_number AS payer_account,
          '6222****1' AS payee_account, concat('￥', num, '元') AS amount_text, summary AS purpose, remark AS usage, CASE WHEN row_no % 2 = 0 THEN '外部' ELSE '汇款' END AS business_type,
          plain AS ref_no, concat('备注：', flag) AS notes, iso AS accounting_date, '' AS amount_cn,
          CASE WHEN row_no % 2 = 0 THEN concat('1234-5678-0000-', lpad(cast(row_no % 10000 as varchar), 4, '0')) END AS receipt_no FROM {_GROWS}""", ("stmt_rows",))
def fields_from_grid(d: Data):
    return L.grid_fields(L.title_groups(d.stored("grid_cells")))


@register("grid_receipts", "page_id:l receipt:l status:s txn_date:s amount:f direction:s counterparty:s account_number:s notes:s",
          f"""SELECT page_id, {_START} AS receipt, 'ok' AS status, txn_date, amount, 'expense' AS direction,
          CASE WHEN o.account_number IS NOT NULL THEN concat('收款', cast(row_no % 9 as varchar), '公司') ELSE concat('收款', cast(row_no % 9 as varchar), '公司') END AS counterparty,
          o.account_number, flag AS notes FROM {_GROWS} r LEFT JOIN own_account o ON o.account_number = r.account_number""", ("stmt_rows", "own_account"))
def grid_receipts(d: Data):
    fields = L.grid_fields(L.title_groups(d.stored("grid_cells")))
    return N.receipt_by_registry(fields, d.view("accounts"), ["page_id", "receipt"])


_PTEXT = "CASE o_orderkey % 7 WHEN 0 THEN concat('甲',cast(o_orderkey as {0}),'有限公司') WHEN 1 THEN '工商银行某支行' WHEN 2 THEN '业务种类有限公司' WHEN 3 THEN 'x集团' ELSE o_orderpriority END"


@register("party_pick", "page_id:l payer:s payee:s",
          f"""SELECT page_id, coalesce(min_by(t, r) FILTER (WHERE cx < 300), '') AS payer, coalesce(min_by(t, r) FILTER (WHERE cx >= 300), '') AS payee FROM (
          SELECT *, row_number() OVER (PARTITION BY page_id, cx < 300 ORDER BY NOT regexp_matches(t,'有限公司|集团'), y0, span_id) AS r FROM (
          SELECT o_orderkey % 100 AS page_id, o_orderkey AS span_id, o_custkey % 600 AS cx, o_totalprice AS y0, {_PTEXT.format('varchar')} AS t FROM orders)
          WHERE regexp_matches(t,'有限公司|集团|银行|支行') AND NOT contains(t,'业务') AND length(t) >= 4) GROUP BY page_id""")
def party_pick(d: Data):
    blocks = d.table("orders").select((c("o_orderkey") % 100).alias("page_id"), c("o_orderkey").alias("span_id"), (c("o_custkey") % 600).alias("cx"),
                                      c("o_totalprice").alias("y0"), F.expr(_PTEXT.format("string")).alias("text"))
    return L.parties(blocks, 300)


@register("line_record_parse", "page_id:l record:l txn_date:s amount:f direction:s description:s counterparty:s",
          f"""SELECT page_id, b AS record, txn_date, amount, CASE WHEN row_no % 2 = 0 THEN 'expense' ELSE 'income' END AS direction,
          CASE WHEN row_no % 4 = 0 THEN '转账' ELSE concat_ws(' ', summary, counterparty, CASE WHEN row_no % 5 = 0 THEN 'tail' END) END AS description,
          CASE WHEN row_no % 4 = 0 THEN '转账' ELSE CASE WHEN row_no % 5 = 0 THEN concat(counterparty, ' tail') ELSE concat(summary, ' ', counterparty) END END AS counterparty
          FROM (SELECT *, cast(floor(row_no / 60) as bigint) AS page_id, 9 * row_number() OVER (PARTITION BY cast(floor(row_no / 60) as bigint) ORDER BY row_no) AS b FROM stmt_rows) WHERE row_no % 9 <> 0""", ("stmt_rows",))
def line_record_parse(d: Data):
    return L.column_statement(d.stored("statement_lines"))


# --- arriving files ----------------------------------------------------------------------

@register("ingest_stream", "txn_seq:l txn_date:s amount:f direction:s files:l failed:l",
          """SELECT o_orderkey AS txn_seq, cast(o_orderdate as date) AS txn_date, cast(o_totalprice as decimal(18,2)) AS amount,
          CASE WHEN o_orderstatus='F' THEN 'income' ELSE 'expense' END AS direction, 1 AS files, 1 AS failed FROM orders WHERE o_orderkey % 10 <> 3""")
def ingest_stream(d: Data):
    """Several files, one of them unreadable and one damaged in the middle, taken in several batches; a second run finds nothing new, a retry reads a whole copy."""
    from ..operators.normalize import flagged_debit_credit
    from ..streaming.ingest import SOURCE, failed_files, ingest, parquet_rows, record_unread, retry_failed

    out = work_path(d.spark, "stream")
    orders = d.table("orders")
    few = c("o_orderkey") <= 300
    orders.where(~few).repartition(6, "o_orderkey").write.parquet(f"{out}/landing/good")
    orders.where(few).repartition(1).write.option("parquet.block.size", 4096).parquet(f"{out}/repaired")
    _damaged_copy(d.spark, f"{out}/repaired", f"{out}/landing/damaged")
    d.spark.range(1, numPartitions=1).selectExpr("'no statement' AS value").write.text(f"{out}/landing/bad")
    income, amount = c("o_orderstatus") == "F", c("o_totalprice").cast("decimal(18,2)").cast("string")
    empty = F.lit("")

    def statement(rows):
        return rows.select(
            c("_metadata.file_name").alias("file_id"), c("o_orderkey").alias("txn_seq"),
            F.when(c("o_orderkey") % 10 == 3, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value_date"),
            F.when(income, "贷").otherwise("借").alias("flag"), F.when(~income, amount).alias("debit"), F.when(income, amount).alias("credit"),
            c("o_orderpriority").alias("summary"), *(empty.alias(x) for x in ("remark", "counterparty", "ref_account", "own_account", "balance")))

    def normalize(rows):
        return flagged_debit_credit(rows, ["file_id", "txn_seq"])

    stream = statement(d.spark.readStream.schema(orders.schema).options(**SOURCE).option("maxFilesPerTrigger", 3).parquet(f"{out}/landing/*"))
    for _ in range(2):
        ingest(stream, normalize, out, f"{out}/checkpoint", once=True, held=lambda: parquet_rows(d.spark, f"{out}/landing/*")).awaitTermination()
    arrived = d.spark.read.format("binaryFile").load(f"{out}/landing/*").select(F.element_at(F.split("path", "/"), -1).alias("file_id"))
    record_unread(d.spark, arrived, out)
    again = statement(d.spark.read.schema(orders.schema).options(**SOURCE).parquet(f"{out}/repaired"))
    retry_failed(d.spark, again, normalize, out, 1, held=lambda: parquet_rows(d.spark, f"{out}/repaired"))
    failed = failed_files(d.spark, out).agg(F.count(F.lit(1)).alias("failed"))
    files = d.spark.read.parquet(f"{out}/files").where("status = 'success'").groupBy("file_id").agg(F.count(F.lit(1)).alias("files"))
    found = d.spark.read.parquet(f"{out}/transactions").join(files, "file_id")
    return found.withColumn("failed", F.lit(failed.first()["failed"]))


def _damaged_copy(spark, source: str, target: str) -> None:
    """Copy a folder's one small Parquet file under its name, with its rows overwritten from the middle to the footer."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(source).getFileSystem(spark._jsc.hadoopConfiguration())
    name = next(x.getPath().getName() for x in fs.listStatus(place(source)) if x.getPath().getName().endswith(".parquet"))
    with_footer = fs.open(place(source, name))
    data = bytearray(with_footer.readAllBytes())
    with_footer.close()
    footer = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
    data[footer // 2 : footer] = b"\xff" * (footer - footer // 2)
    out = fs.create(place(target, name))
    out.write(data)
    out.close()

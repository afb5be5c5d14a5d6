"""Views derived from the given tables, one text for both engines.

``{list}`` opens an array literal, ``{explode}`` unnests, ``{seq}`` is an integer sequence.
"""

from __future__ import annotations

_DIALECT = {
    "spark": {"list": "array", "explode": "explode", "seq": "sequence", "lines": "split(text, '\\\\n')"},
    "duckdb": {"list": "list_value", "explode": "unnest", "seq": "generate_series", "lines": "string_split(text, chr(10))"},
}

# name -> (views it reads, text)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, reads: tuple[str, ...], text: str) -> None:
    _VIEWS[name] = (reads, text)


_view("txn", (), """
SELECT concat('B', cast(year(o_orderdate) as string)) AS batch_id, o_orderkey AS txn_seq,
       cast(o_orderdate as date) AS txn_date,
       concat(lower(substring(o_orderpriority,3)),' ',p_name,' ',cast(p_partkey as string)) AS description,
       cast(o_totalprice as decimal(18,2)) AS amount, 'CNY' AS currency,
       CASE WHEN o_orderstatus='F' THEN 'income' ELSE 'expense' END AS direction,
       c_name AS counterparty, concat('R',cast(o_orderkey % 7 as string)) AS reference_number,
       concat('622208',lpad(cast(o_custkey % 23 as string),10,'0')) AS account_number
FROM (SELECT o.*, o_orderkey % (SELECT count(*) FROM part) AS o_part FROM orders o) AS q
JOIN customer ON c_custkey=o_custkey JOIN part ON p_partkey = o_part
""")

_view("rules", (), """
SELECT * FROM (VALUES
 (1,'r1','expense',2,{list}('ring','plate'),{list}('hot'),{list}('low'),'mer#','501','Rings'),
 (2,'r2','expense',1,{list}('red'),{list}(''),{list}(''),'','502','Red'),
 (3,'r3','income',1,{list}('rod','ring'),{list}(''),{list}(''),'','600','Sales'),
 (4,'r4','expense',2,{list}('widget','plate'),{list}(''),{list}(''),'','503','Widgets'))
 AS t(ord,rule_id,direction,priority,kw,excl,req,cp,code,name)
""")

_view("accounts", (), """
SELECT cast(ord as bigint) AS ord, id, match_type, pattern, bank_code AS bank, bank_code, subject_code,
       concat('bank ', subject_code) AS subject_name
FROM (VALUES (1,'a1','suffix','4','CMB','1000203'),(2,'a2','exact','6222080000000014','ICBC','1000201'),
 (3,'a3','suffix','14','GFB','1000202'),(4,'a4','suffix','7','ICBC','1000205'))
 AS t(ord,id,match_type,pattern,bank_code,subject_code)
""")

_view("history", ("txn",), """
SELECT txn_seq AS hid, description, direction, concat('H',cast(txn_seq % 9 as string)) AS code,
       concat('history ',cast(txn_seq % 9 as string)) AS name, txn_date AS confirmed
FROM txn WHERE batch_id = (SELECT min(batch_id) FROM txn)
""")

_view("subjects", (), """
SELECT code, min(ord) AS ord, concat('n', code) AS name, max(category) AS category,
       CASE WHEN substring(code,1,1) IN ('1','5') THEN 'aux' ELSE '' END AS aux_category,
       CASE WHEN substring(code,1,1) IN ('1','5') THEN concat('Aux ', code) ELSE '' END AS aux_category_name,
       (length(code) <> 3) AS enabled, concat('FULL_', code) AS full_name
FROM (SELECT substring(key, 1, n) AS code, ord, category
      FROM (SELECT cast(p_partkey as string) AS key, p_partkey AS ord,
                   CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('C', cast(p_size % 4 as string)) END AS category,
                   {explode}({list}(1,2,3,4)) AS n FROM part) AS p
      WHERE n <= length(key)) AS x
GROUP BY code
""")

# The winning rule of each transaction, in plain SQL.
_view("matched", ("txn", "rules"), """
SELECT * FROM (
 SELECT t.*, r.code AS m_code, r.name AS m_name, r.rule_id AS m_rule,
        row_number() OVER (PARTITION BY t.txn_seq ORDER BY r.priority NULLS LAST, r.ord) AS m_rn
 FROM txn t LEFT JOIN (SELECT * FROM rules) r
   ON r.direction = t.direction
  AND len(list_filter(r.kw, lambda k: contains(t.description, k))) > 0
  AND len(list_filter(r.excl, lambda k: k <> '' AND contains(t.description, k))) = 0
  AND len(list_filter(r.req, lambda k: NOT contains(t.description, k))) = 0
  AND contains(t.counterparty, r.cp)) AS q
WHERE m_rn = 1
""")

_view("own_account", ("txn", "accounts"), """
SELECT * FROM (
 SELECT n.account_number, a.id, a.bank_code, a.subject_code, a.subject_name,
        row_number() OVER (PARTITION BY n.account_number ORDER BY CASE WHEN a.match_type='exact' THEN 0 ELSE 1 END, a.ord) AS rn
 FROM (SELECT DISTINCT account_number FROM txn) n JOIN accounts a
   ON (a.match_type='exact' AND a.pattern = n.account_number)
   OR (a.match_type='suffix' AND ends_with(n.account_number, a.pattern))) AS q
WHERE rn = 1
""")

# Voucher membership in plain SQL.
_view("member", ("matched",), """
SELECT q.*, dense_rank() OVER (PARTITION BY batch_id ORDER BY lead_seq) AS voucher_no FROM (
 SELECT m.*, coalesce(m_code, '__unmatched__') AS counter_code,
        min(txn_seq) OVER g AS lead_seq, count(*) OVER g AS voucher_size, sum(amount) OVER g AS voucher_total,
        row_number() OVER (PARTITION BY batch_id, account_number, coalesce(m_code, '__unmatched__'), direction,
                           CASE WHEN m_code IS NULL THEN concat('#', cast(txn_seq as string)) ELSE reference_number END
                           ORDER BY txn_seq) AS pos
 FROM matched m
 WINDOW g AS (PARTITION BY batch_id, account_number, coalesce(m_code, '__unmatched__'), direction,
              CASE WHEN m_code IS NULL THEN concat('#', cast(txn_seq as string)) ELSE reference_number END)) AS q
""")

_view("entries", ("member", "own_account"), """
SELECT batch_id, voucher_no, CASE WHEN direction='expense' THEN pos ELSE pos + 1 END AS entry_seq, txn_date AS date,
       description AS summary, counter_code AS subject_code, coalesce(m_name,'') AS subject_name,
       CASE WHEN direction='expense' THEN amount END AS debit_amount,
       CASE WHEN direction<>'expense' THEN amount END AS credit_amount,
       direction, counterparty, CASE WHEN m_code IS NULL THEN 'unmatched' ELSE 'rule' END AS match_source,
       coalesce(m_rule,'') AS rule_id, description AS original_summary, amount AS original_amount,
       false AS is_manual, '' AS aux_category, '' AS aux_category_name
FROM member
UNION ALL
SELECT batch_id, voucher_no, CASE WHEN direction='expense' THEN voucher_size + 1 ELSE 1 END, txn_date, description,
       coalesce(o.subject_code,'10002'), coalesce(o.subject_name,'银行存款'),
       CASE WHEN direction<>'expense' THEN cast(voucher_total as decimal(18,2)) END,
       CASE WHEN direction='expense' THEN cast(voucher_total as decimal(18,2)) END,
       'bank', '', 'auto', '', '', cast(0 as decimal(18,2)), false, '', ''
FROM member m LEFT JOIN own_account o USING (account_number) WHERE pos = 1
""")

_view("drafts", ("txn",), """
SELECT batch_id AS id, concat('draft ', batch_id) AS name, batch_id AS period, 'draft' AS status,
       min(txn_date) AS created_at, max(txn_date) AS updated_at
FROM txn GROUP BY batch_id
""")

# Text-typed statement rows: dates in several forms, amounts with marks, some of them broken.
_view("stmt_rows", ("txn",), """
SELECT concat('F', cast(cast(floor(txn_seq / 500) as bigint) as string)) AS file_id, txn_seq AS row_no, description AS summary, counterparty,
       account_number, reference_number, amount,
       ymd AS iso, replace(ymd,'-','') AS packed,
       CASE txn_seq % 5 WHEN 0 THEN replace(ymd,'-','') WHEN 1 THEN ymd WHEN 2 THEN concat(substring(ymd,1,4),'0231')
            WHEN 3 THEN 'n/a' ELSE concat(' ',replace(ymd,'-',''),' ') END AS d_compact,
       CASE txn_seq % 5 WHEN 0 THEN ymd WHEN 1 THEN concat(' ',ymd) WHEN 2 THEN concat(substring(ymd,1,4),'-02-31')
            WHEN 3 THEN '' ELSE replace(ymd,'-','/') END AS d_iso,
       CASE txn_seq % 4 WHEN 0 THEN concat(y,'年',m,'月',d,'日') WHEN 1 THEN concat('x',y,'-',m,'-',d,'z')
            WHEN 2 THEN concat(y,'年13月',d,'日') ELSE 'none' END AS d_cn,
       CASE txn_seq % 5 WHEN 0 THEN ymd WHEN 1 THEN replace(ymd,'-','') WHEN 2 THEN concat(y,' 年 ',m,' 月 ',d,' 日')
            WHEN 3 THEN concat('at ',y,'年',m,'月',d,'日') ELSE 'soon' END AS d_flex,
       concat(ymd,'-19.33.30.354123') AS d_ts,
       CASE txn_seq % 4 WHEN 0 THEN concat('on ',y,' 年 ',m,' 月 ',d,' 日') WHEN 1 THEN concat('no',replace(ymd,'-',''))
            WHEN 2 THEN ymd ELSE '' END AS d_receipt,
       CASE txn_seq % 6 WHEN 0 THEN concat('+',num) WHEN 1 THEN concat(' -',num,' ') WHEN 2 THEN num WHEN 3 THEN 'abc'
            WHEN 4 THEN '' ELSE plain END AS a_strict,
       CASE txn_seq % 5 WHEN 0 THEN concat('￥',num,'元') WHEN 1 THEN concat('-',plain) WHEN 2 THEN 'none'
            WHEN 3 THEN concat('约 ',num) ELSE '' END AS a_lenient,
       CASE txn_seq % 5 WHEN 0 THEN concat('CNY ',num) WHEN 1 THEN concat('￥',num) WHEN 2 THEN '  ' WHEN 3 THEN plain
            ELSE concat(num,' cny') END AS a_clean,
       CASE txn_seq % 4 WHEN 0 THEN concat('cny',num) WHEN 1 THEN concat('total ',num,' ok') WHEN 2 THEN 'free'
            ELSE concat('CNY ',plain) END AS a_cny,
       CASE txn_seq % 3 WHEN 0 THEN '借' WHEN 1 THEN '贷' ELSE '其他' END AS flag,
       CASE WHEN txn_seq % 4 = 0 THEN '' ELSE num END AS out_text,
       CASE WHEN txn_seq % 3 = 0 THEN num WHEN txn_seq % 3 = 1 THEN '0.00' ELSE '' END AS in_text,
       CASE WHEN txn_seq % 6 = 0 THEN '0.00' WHEN txn_seq % 6 = 1 THEN '' ELSE num END AS balance_text,
       CASE WHEN txn_seq % 4 = 1 THEN '' ELSE concat('memo ',cast(txn_seq % 11 as string)) END AS remark,
       num, plain, txn_date, direction, batch_id, txn_seq
FROM (SELECT t.*, cast(txn_date as string) AS ymd, cast(year(txn_date) as string) AS y,
             cast(month(txn_date) as string) AS m, cast(day(txn_date) as string) AS d,
             concat(CASE WHEN amount >= 1000 THEN concat(cast(cast(floor(amount/1000) as bigint) as string), ',',
                         lpad(cast(cast(floor(amount) as bigint) % 1000 as string),3,'0'))
                    ELSE cast(cast(floor(amount) as bigint) as string) END,
                    substring(cast(amount as string), length(cast(amount as string)) - 2, 3)) AS num,
             cast(amount as string) AS plain FROM txn t) AS x
""")

# Pages of positioned values, as many as the orders ask for; (l_orderkey, l_linenumber) is not unique.
_view("spans", (), """
SELECT cast(floor(l_orderkey / 50) as bigint) AS page_id, l_orderkey*10+l_linenumber AS span_id,
       cast(max(l_quantity)*11 as decimal(18,2)) AS x0,
       cast(max(l_extendedprice) as decimal(18,2)) % 800 AS y0,
       max(cast(l_extendedprice as decimal(18,2))) AS amt
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")


# A table statement: titles, a header, rows with continuation lines, a footer.
_view("page_spans", ("stmt_rows",), """
SELECT page_id, span_id, cast(x0 as double) AS x0, cast(y0 as double) AS y0, cast(x0 + 20 as double) AS x1,
       cast(y0 + 8 as double) AS y1, text, cast(9 as double) AS size
FROM (
 SELECT page_id, k*10+j AS span_id,
        CASE j WHEN 1 THEN 40 WHEN 2 THEN 70 WHEN 3 THEN 200 WHEN 4 THEN 330 WHEN 5 THEN 430 ELSE 205 END AS x0,
        y + CASE j WHEN 3 THEN 1 WHEN 6 THEN 5 ELSE 0 END AS y0,
        CASE j WHEN 1 THEN packed WHEN 2 THEN flag WHEN 3 THEN summary
               WHEN 4 THEN CASE WHEN k % 2 = 0 THEN concat('-', num) ELSE num END
               WHEN 5 THEN counterparty ELSE concat('more ', cast(k % 7 as string)) END AS text
 FROM (SELECT b.*, {explode}({list}(1,2,3,4,5,6)) AS j
       FROM (SELECT row_no AS k, cast(floor(row_no / 50) as bigint) AS page_id, packed, flag, summary, num, counterparty,
                    112 + 12 * row_number() OVER (PARTITION BY cast(floor(row_no / 50) as bigint) ORDER BY row_no) AS y FROM stmt_rows) AS b) AS r
 WHERE j < 6 OR k % 3 = 0
 UNION ALL
 SELECT page_id, j, CASE j WHEN 2 THEN 70 WHEN 4 THEN 90 WHEN 6 THEN 90 ELSE 40 END,
        CASE WHEN j <= 2 THEN 100 WHEN j <= 4 THEN 20 ELSE 147 + 12 * n + j END,
        CASE j WHEN 1 THEN '交易日期' WHEN 2 THEN '业务类型' WHEN 3 THEN '账号：' WHEN 4 THEN concat('6222', cast(page_id as string))
               WHEN 5 THEN '期末余额' ELSE concat(cast(n as string), '.50') END
 FROM (SELECT page_id, n, {explode}({list}(1,2,3,4,5,6)) AS j
       FROM (SELECT cast(floor(row_no / 50) as bigint) AS page_id, count(*) AS n FROM stmt_rows GROUP BY cast(floor(row_no / 50) as bigint)) AS a) AS p) AS u
""")

# A table statement with a column for each direction; every title stands alone and two share one span.
_view("two_way_spans", ("stmt_rows",), """
SELECT page_id, span_id, cast(x0 as double) AS x0, cast(y0 as double) AS y0, cast(x0 + 20 as double) AS x1,
       cast(y0 + 8 as double) AS y1, text, cast(9 as double) AS size
FROM (
 SELECT page_id, k*10+j AS span_id,
        CASE j WHEN 1 THEN 22 WHEN 2 THEN 68 WHEN 3 THEN 120 WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 190 ELSE 280 END WHEN 5 THEN 390 ELSE 525 END AS x0,
        y + CASE j WHEN 3 THEN 1 ELSE 0 END AS y0,
        CASE j WHEN 1 THEN packed WHEN 2 THEN CASE WHEN k % 5 = 0 THEN '' ELSE remark END WHEN 3 THEN CASE WHEN k % 3 = 0 THEN reference_number ELSE '' END
               WHEN 4 THEN num WHEN 5 THEN counterparty ELSE '7.00' END AS text
 FROM (SELECT b.*, {explode}({list}(1,2,3,4,5,6)) AS j
       FROM (SELECT row_no AS k, cast(floor(row_no / 50) as bigint) AS page_id, packed, remark, reference_number, num, counterparty,
                    112 + 12 * row_number() OVER (PARTITION BY cast(floor(row_no / 50) as bigint) ORDER BY row_no) AS y FROM stmt_rows) AS b) AS r
 UNION ALL
 SELECT page_id, j, CASE j WHEN 2 THEN 190 WHEN 3 THEN 525 ELSE 22 END, CASE j WHEN 1 THEN 96 WHEN 2 THEN 108 WHEN 3 THEN 108 ELSE 108 END,
        CASE j WHEN 1 THEN '交易日期 交易类型' WHEN 2 THEN '本期支出' WHEN 3 THEN '余额' ELSE '交易日期' END
 FROM (SELECT page_id, {explode}({list}(1,2,3,4)) AS j FROM (SELECT DISTINCT cast(floor(row_no / 50) as bigint) AS page_id FROM stmt_rows) AS a) AS p) AS u
""")

# Pages with what stands above and below the table: keys that share a line, a period, balances.
_view("headed_spans", ("page_spans", "stmt_rows"), """
SELECT * FROM page_spans
UNION ALL
SELECT page_id, 100 + j, CASE j WHEN 1 THEN 40.0 WHEN 2 THEN 200.0 WHEN 3 THEN 300.0 WHEN 4 THEN 40.0 WHEN 5 THEN 90.0 WHEN 6 THEN 40.0 ELSE 300.0 END,
       CASE j WHEN 1 THEN 40.0 WHEN 2 THEN 41.0 WHEN 3 THEN 41.5 WHEN 4 THEN 55.0 WHEN 5 THEN 56.0 WHEN 6 THEN 70.0 ELSE 71.0 END, 0.0, 50.0,
       CASE j WHEN 1 THEN '开户银行：' WHEN 2 THEN '账户名称：' WHEN 3 THEN concat('公司', cast(page_id as string)) WHEN 4 THEN '账单所属期间：'
              WHEN 5 THEN concat('2024-01-01  2024-01-', cast(10 + page_id % 20 as string)) WHEN 6 THEN '上页余额：' ELSE concat(cast(page_id as string), ',001.25') END, 9.0
FROM (SELECT page_id, {explode}({list}(1,2,3,4,5,6,7)) AS j FROM (SELECT DISTINCT cast(floor(row_no / 50) as bigint) AS page_id FROM stmt_rows) AS a) AS p
""")

# A sheet per file: four lines of metadata, a header at row 5, records from row 6.
_view("sheet_cells", ("stmt_rows",), """
SELECT file_id, cast(r as bigint) AS row, cast(c as bigint) AS col, value FROM (
 SELECT file_id, 5 + rn AS r, c,
        CASE c WHEN 1 THEN iso WHEN 2 THEN packed WHEN 3 THEN out_text WHEN 4 THEN num
               WHEN 5 THEN concat(' ', summary, ' ') WHEN 6 THEN counterparty ELSE 'ignored' END AS value
 FROM (SELECT b.*, {explode}({list}(1,2,3,4,5,6,7)) AS c
       FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS rn FROM stmt_rows) AS b) AS x
 WHERE (c <> 2 OR row_no % 3 = 0) AND (c <> 3 OR row_no % 2 = 0) AND (c <> 4 OR row_no % 3 = 0)
 UNION ALL
 SELECT file_id, CASE WHEN j <= 7 THEN 5 WHEN j <= 12 THEN 1 WHEN j <= 15 THEN 2 WHEN j <= 17 THEN 3 ELSE 4 END,
        CASE j WHEN 8 THEN 1 WHEN 9 THEN 3 WHEN 10 THEN 5 WHEN 11 THEN 6 WHEN 12 THEN 7 WHEN 13 THEN 1 WHEN 14 THEN 2
               WHEN 15 THEN 4 WHEN 16 THEN 1 WHEN 17 THEN 6 WHEN 18 THEN 1 WHEN 19 THEN 5 ELSE j END,
        CASE j WHEN 1 THEN '起息日' WHEN 2 THEN '起息日' WHEN 3 THEN ' 借方金额' WHEN 4 THEN '贷方金额' WHEN 5 THEN '摘要'
               WHEN 6 THEN '收(付)方名称' WHEN 7 THEN '备用' WHEN 8 THEN '账号' WHEN 9 THEN concat('6222', file_id)
               WHEN 10 THEN '账号名称：' WHEN 11 THEN '' WHEN 12 THEN concat('公司', file_id) WHEN 13 THEN '期初余额'
               WHEN 14 THEN 'x' WHEN 15 THEN concat(cast(n as string), ',000.50') WHEN 16 THEN '期末余额' WHEN 17 THEN '9'
               WHEN 18 THEN '对账单余额' ELSE cast(n + 1 as string) END
 FROM (SELECT file_id, n, {explode}({seq}(1, 19)) AS j
       FROM (SELECT file_id, count(*) AS n FROM stmt_rows GROUP BY file_id) AS a) AS f) AS u
""")

# A statement with one value per line; every record has nine lines.
_view("statement_lines", ("stmt_rows",), """
SELECT page_id, cast(line_no as bigint) AS line_no, line FROM (
 SELECT page_id, b + j AS line_no,
        CASE j WHEN 0 THEN iso WHEN 1 THEN 'CNY'
               WHEN 2 THEN CASE WHEN row_no % 9 = 0 THEN 'bad' WHEN row_no % 2 = 0 THEN concat(' -', num) ELSE num END
               WHEN 3 THEN '99.00' WHEN 4 THEN '转账' WHEN 5 THEN CASE WHEN row_no % 4 = 0 THEN '' ELSE summary END
               WHEN 6 THEN counterparty WHEN 7 THEN 'Balance' ELSE CASE WHEN row_no % 5 = 0 THEN 'tail' ELSE '' END END AS line
 FROM (SELECT x.*, {explode}({seq}(0, 8)) AS j FROM (SELECT *, cast(floor(row_no / 60) as bigint) AS page_id,
         9 * row_number() OVER (PARTITION BY cast(floor(row_no / 60) as bigint) ORDER BY row_no) AS b FROM stmt_rows) AS x) AS r
 UNION ALL
 SELECT page_id, j, CASE j WHEN 0 THEN '2024-01-01' WHEN 1 THEN 'Date' WHEN 2 THEN 'Currency' WHEN 3 THEN 'Transaction'
        WHEN 4 THEN 'Counter Party' ELSE '温馨提示' END
 FROM (SELECT page_id, {explode}({seq}(0, 5)) AS j FROM (SELECT DISTINCT cast(floor(row_no / 60) as bigint) AS page_id FROM stmt_rows) AS p) AS q) AS u
""")

# Grid cells of receipts: headings of one or two rows, some below the bank's name, then fixed places.
_view("grid_cells", ("stmt_rows",), """
SELECT page_id, cast(b + CASE j WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 3 WHEN 7 THEN 3
         WHEN 8 THEN 4 WHEN 9 THEN 4 WHEN 10 THEN 6 WHEN 11 THEN 6 WHEN 12 THEN 7 WHEN 13 THEN 7 WHEN 14 THEN 7 WHEN 15 THEN 8
         WHEN 16 THEN 9 WHEN 17 THEN 10 ELSE 12 END as bigint) AS row,
       cast(CASE j WHEN 1 THEN 2 WHEN 4 THEN 1 WHEN 6 THEN 6 WHEN 7 THEN 7 WHEN 9 THEN 6 WHEN 11 THEN 6 WHEN 13 THEN 5
         WHEN 14 THEN 6 WHEN 18 THEN 7 ELSE 3 END as bigint) AS col,
       CASE j WHEN 1 THEN '中国工商银行' WHEN 2 THEN '网上银行电子回单'
         WHEN 3 THEN concat('电子回单号码 1234-5678-0000-', lpad(cast(row_no % 10000 as string), 4, '0')) WHEN 4 THEN '户名'
         WHEN 5 THEN counterparty WHEN 6 THEN '公司' WHEN 7 THEN concat('收款', cast(row_no % 9 as string)) WHEN 8 THEN account_number
         WHEN 9 THEN '6222****1' WHEN 10 THEN concat('￥', num, '元') WHEN 11 THEN '柒分' WHEN 12 THEN summary
         WHEN 13 THEN CASE WHEN row_no % 2 = 0 THEN '业务（产品）种类' ELSE '业务（产品）种类汇款' END WHEN 14 THEN '外部'
         WHEN 15 THEN remark WHEN 16 THEN plain WHEN 17 THEN concat('备注：', flag) ELSE iso END AS text, row_no
FROM (SELECT x.*, {explode}({seq}(1, 18)) AS j FROM (SELECT *, cast(floor(row_no / 25) as bigint) AS page_id,
        14 * row_number() OVER (PARTITION BY cast(floor(row_no / 25) as bigint) ORDER BY row_no) AS b FROM stmt_rows) AS x) AS r
WHERE (j <> 1 OR row_no % 3 <> 0) AND (j <> 3 OR row_no % 2 = 0) AND (j <> 15 OR remark <> '')
""")


def chain(names: tuple[str, ...]) -> list[str]:
    """Texts of the named views and all they read."""
    return [_VIEWS[n][1] for n in order(names)]


def order(names: tuple[str, ...]) -> list[str]:
    """The named views and all they read, dependencies first."""
    seen: list[str] = []

    def visit(n: str) -> None:
        for dep in _VIEWS[n][0]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(text: str, names: tuple[str, ...], engine: str) -> str:
    """``text`` preceded by the views it needs, in the engine's spelling."""
    needed = order(names)
    body = text
    if needed:
        ctes = []
        for n in needed:
            sql = _VIEWS[n][1]
            for token, word in _DIALECT[engine].items():
                sql = sql.replace("{" + token + "}", word)
            # Computed once in the engine that would otherwise inline them again and again.
            ctes.append(f"{n} AS {'MATERIALIZED ' if engine == 'duckdb' else ''}({sql.strip()})")
        body = "WITH " + ",\n".join(ctes) + "\n" + text
    return body

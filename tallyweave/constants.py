"""Fixed values that results depend on."""

from __future__ import annotations

# ---- fixed values: bank names and codes -------------------------------------------------
BANK_NAMES = {"ICBC": "工商银行", "CMB": "招商银行", "GFB": "广发银行"}
BANK_CODES = {"工商银行": "ICBC", "招商银行": "CMB", "广发银行": "GFB"}
UNKNOWN_BANK = "未知银行"
UNKNOWN_CODE = "UNKNOWN"
STATEMENT = "流水"
RECEIPT = "回单"

# ---- fixed values: accounting defaults --------------------------------------------------
DEFAULT_BANK_SUBJECT = ("10002", "银行存款")
UNMATCHED_CODE = "__unmatched__"
SIMILARITY_THRESHOLD = 0.75
DEFAULT_PRIORITY = 999
DEFAULT_DESCRIPTION = "银行交易"
DEFAULT_RECEIPT_DESCRIPTION = "银行回单"
DIRECTION_DESCRIPTION = {"expense": "支出交易", "income": "收入交易"}

# ---- fixed values: document signatures, in order ----------------------------------------
DOCUMENT_SIGNATURES = [
    (("账务明细清单", "借方/贷方金额"), "CMB", STATEMENT, "all"),
    (("Date", "Currency", "Counter Party"), "CMB", STATEMENT, "all"),
    (("出账回单", "入账回单"), "CMB", RECEIPT, "any"),
    (("交易日期", "交易类型", "本期支出"), "GFB", STATEMENT, "all"),
]
TABLE_TITLES = ("账务明细清单", "Statement Of Account", "Statement of Account", "STATEMENT OF ACCOUNT")
RECEIPT_NUMBER_LABELS = ("回单号码", "回单编号")
# Extractors per bank, in the order they are tried.
EXTRACTORS = {
    "ICBC": ("grid_receipt", "grid_statement"),
    "CMB": ("text_receipt", "statement"),
    "GFB": ("table_statement",),
}

# ---- fixed values: CSV statement --------------------------------------------------------
CSV_STATEMENT_COLUMNS = (
    "凭证号", "本方账号", "对方账号", "交易时间", "起息日", "借/贷", "借方发生额", "贷方发生额",
    "对方行号", "摘要", "附言", "用途", "对方单位名称", "余额",
)
CSV_STATEMENT_MARKS = ("[HISTORYDETAIL]", "凭证号")

# ---- fixed values: sheet statement ------------------------------------------------------
SHEET_HEADER_MARKS = ("起息日", "借方金额", "贷方金额")
SHEET_HEADER_LAST_ROW = 49
SHEET_COLUMNS = {
    "起息日": "value_date",
    "交易日": "trade_date",
    "交易日期": "trade_date",
    "借方金额": "debit_amount",
    "贷方金额": "credit_amount",
    "余额": "balance",
    "摘要": "summary",
    "流水号": "serial_no",
    "收(付)方单位名称": "counterparty",
    "收(付)方名称": "counterparty",
    "收(付)方账号": "counterparty_account",
    "账号": "account_no",
    "账号名称": "account_name",
    "交易类型": "transaction_type",
    "业务参考号": "business_ref",
    "扩展摘要": "extended_summary",
}
SHEET_OPENING_LABELS = ("对账单期初余额", "期初余额", "上期余额")
SHEET_CLOSING_LABELS = ("对账单余额", "期末余额")
SHEET_NAME_LABELS = ("账号名称", "户名")
SHEET_ACCOUNT_LABEL = "账号"

# ---- fixed values: table statements, column bands (left, right) in order -----------------
CMB_BANDS = {
    "date": (33, 60),
    "business_type": (60, 130),
    "bill_no": (130, 160),
    "description": (160, 320),
    "amount": (320, 380),
    "balance": (380, 420),
    "counterparty": (420, 550),
}
CMB_HEADER_KEYS = {
    "账号": "account_no",
    "账户名称": "account_name",
    "货币": "currency",
    "开户银行": "bank_branch",
    "账单所属期间": "period",
    "上页余额": "opening_balance",
}
GFB_BANDS = {
    "date": (15, 63),
    "biz_type": (65, 113),
    "bill_no": (113, 178),
    "expense": (178, 270),
    "income": (270, 385),
    "counterparty": (385, 520),
    "balance": (520, 555),
}
GFB_HEADER_KEYS = {"行所号": "bank_branch", "币别": "currency", "账号": "account_no", "户名": "account_name"}
GFB_LABELS = (
    "交易日期", "交易类型", "票据号码", "本期支出", "本期收入", "交易对手信息", "余额",
    "Date", "Business Type", "Bill No.", "Description", "Debit/Credit Amount", "Balance", "Counterparty",
    "上期余额", "上页余额",
)
BAND_TOLERANCE = 20
COLUMN_STATEMENT_HEADER = (
    "Date", "Currency", "Transaction", "Amount", "Balance", "Transaction Type", "Counter Party", "CNY",
)

# ---- fixed values: receipts -------------------------------------------------------------
RECEIPT_TITLES = ("出账回单", "入账回单")
GRID_RECEIPT_TITLES = ("网上银行电子回单", "电子回单号码")
GRID_RECEIPT_BANK = "中国工商银行"
GRID_RECEIPT_BASE = "户名"
# (row below the base row, column) -> field; two cells are joined left to right.
GRID_RECEIPT_FIELDS = {
    "payer_name": ((0, 3),),
    "payee_name": ((0, 7), (0, 6)),
    "payer_account": ((1, 3),),
    "payee_account": ((1, 6),),
    "payer_bank": ((2, 3),),
    "payee_bank": ((2, 7), (2, 6)),
    "amount_text": ((3, 3),),
    "purpose": ((4, 3),),
    "usage": ((5, 3),),
    "ref_no": ((6, 3),),
    "timestamp": ((6, 7),),
    "notes": ((7, 3),),
    "accounting_date": ((9, 7),),
}
BUSINESS_TYPE_PREFIX = "业务（产品）种类"
NOTE_PREFIX = "备注："
PURPOSE_NOISE = (
    "业务（产品）种类", "业务(产品)种类", "业务种类", "跨行收报", "跨行发报", "对公收费", "网银互联", "利息入账",
    "用途", "交易流水号", "时间戳", "记账日期", "摘要", "产品名称", "费用名称", "应收金额", "实收金额",
    "业务委托日期", "业务类型", "普通汇兑", "普通贷记", "电子回单", "专用章", "专后章", "专居章",
)
REFERENCE_NOISE = ("时间戳", "交易流水号", "记账日期", "备注", "附言", "业务种类", "业务类型", "打印日期")
LABEL_WORDS = (
    "付款人", "收款人", "付款账号", "收款账号", "付款", "收款", "金额", "金额(大写)", "金额（大写）", "摘要", "用途",
    "交易流水号", "电子回单号码", "时间戳", "验证码", "记账日期", "打印日期", "记账网点", "记账柜员", "开户银行",
    "业务", "附言", "备注", "重要提示", "中国工商银行", "网上银行电子回单", "电子回单", "专", "人", "户", "名", "账", "号",
)
LABEL_PARTS = ("业务", "产品", "种类", "摘要", "用途", "金额", "验证码", "记账", "打印", "专用章", "回单")
COMPANY_PATTERN = "有限公司|股份有限公司|有限责任|集团"
BRANCH_PATTERN = "银行|支行|分行|分理处|营业室"
PARTY_NOISE_PATTERN = "业务|产品|种类|摘要|用途|记账|打印|验证码|回单号码|电子回单|重要提示|附言|备注"

# ---- fixed values: export layout, 25 columns --------------------------------------------
EXPORT_COLUMNS = (
    "日期", "凭证字", "凭证号", "附件数", "分录序号", "摘要", "科目代码", "科目名称", "借方金额", "贷方金额",
    "客户", "供应商", "职员", "项目", "部门", "存货", "自定义辅助核算类别", "自定义辅助核算编码",
    "自定义辅助核算类别1", "自定义辅助核算编码1", "数量", "单价", "原币金额", "币别", "汇率",
)
DETAIL_COLUMNS = ("日期", "描述", "金额", "币种", "方向", "对方户名", "流水号", "本方帐号", "本方户名")

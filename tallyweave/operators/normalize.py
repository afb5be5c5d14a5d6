"""Source rows to canonical transactions.

Every normaliser is one ``select`` over text columns: no shuffle, no Python.  Its output has
the input's id columns, ``status`` (ok / skip / error), ``reason`` and the canonical fields,
which are null unless the status is ok.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BUSINESS_TYPE_PREFIX, DEFAULT_DESCRIPTION, DEFAULT_RECEIPT_DESCRIPTION, DIRECTION_DESCRIPTION, GFB_LABELS,
    NOTE_PREFIX, PURPOSE_NOISE, REFERENCE_NOISE,
)
from ..functions import amounts as A
from ..functions import dates as D
from ..functions.text import (
    BLANK, blank_to_null, clean_text, first_match, is_account_like, join_nonempty, labelled, strip,
)
from .accounts import infer_direction

CANONICAL = (
    "txn_date", "description", "amount", "currency", "direction", "counterparty", "reference_number", "notes",
    "account_number", "account_name",
)


def _texts(df: DataFrame, ids: Sequence[str], names: str, *keep: str) -> DataFrame:
    """The named columns stripped, null as ''.  A projection of its own, so each is computed once."""
    return df.select(*ids, *keep, *(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in names.split()))


def _result(
    df: DataFrame, ids: Sequence[str], skip: Column, error: Column, fields: dict[str, Column], reason: str = "invalid date"
) -> DataFrame:
    """Assemble the three outcomes; an error outranks a skip."""
    status = F.when(F.coalesce(error, F.lit(False)), "error").when(F.coalesce(skip, F.lit(False)), "skip").otherwise("ok")
    none = F.lit(None).cast("string")
    filled = {c: fields.get(c, none) for c in CANONICAL}
    filled["currency"] = F.lit("CNY")
    base = df.withColumn("__status", status)
    ok = F.col("__status") == "ok"
    return base.select(
        *ids, F.col("__status").alias("status"), F.when(F.col("__status") == "error", F.lit(reason)).alias("reason"),
        *(F.when(ok, v).alias(c) for c, v in filled.items()),
    )


def _balance_note(balance: str = "balance", parsed: str = "__balance") -> Column:
    """Note with the balance as written, unless it is no number or zero."""
    return F.when(F.col(parsed) != 0, labelled("余额:", A.without_marks(F.col(balance))))


def flagged_debit_credit(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """value_date, flag, debit, credit, summary, remark, counterparty, ref_account, own_account, balance."""
    t = _texts(df, ids, "value_date flag debit credit summary remark counterparty ref_account own_account balance")
    t = t.withColumns({
        "__day": D.date_iso(F.col("value_date")), "__shaped": D.looks_iso(F.col("value_date")),
        "__balance": A.amount_strict(F.col("balance")),
        "__amount": A.amount_strict(F.when(F.col("flag") == "借", F.col("debit")).otherwise(F.col("credit"))),
    })
    flag = F.col("flag")
    return _result(
        t, ids,
        skip=F.col("__day").isNull() | ~flag.isin("借", "贷"),
        error=F.col("__shaped") & F.col("__day").isNull(),
        fields={
            "txn_date": F.col("__day"),
            "description": join_nonempty([F.col("summary"), labelled("附言:", F.col("remark"))], " | ", DEFAULT_DESCRIPTION),
            "amount": F.coalesce("__amount", F.lit(0).cast(A.MONEY)),
            "direction": F.when(flag == "借", "expense").otherwise("income"),
            "counterparty": blank_to_null(F.col("counterparty")),
            "reference_number": blank_to_null(F.col("ref_account")),
            "notes": _balance_note(),
            "account_number": blank_to_null(F.col("own_account")),
        },
    )


def two_amount_columns(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """value_date, trade_date, debit_amount, credit_amount, summary, transaction_type, serial_no, counterparty,
    balance, counterparty_account, business_ref, account_no, account_name."""
    t = _texts(
        df, ids, "value_date trade_date debit_amount credit_amount summary transaction_type serial_no counterparty "
        "balance counterparty_account business_ref account_no account_name",
    )
    t = t.withColumn("__date", F.when(F.col("value_date") != "", F.col("value_date")).otherwise(F.col("trade_date")))
    t = t.withColumns({
        "__day": D.date_flexible(F.col("__date")), "__shaped": D.looks_flexible(F.col("__date")),
        "__out": A.amount_clean(F.col("debit_amount")), "__in": A.amount_clean(F.col("credit_amount")),
        "__balance": A.amount_clean(F.col("balance")),
    })
    out, inn = F.coalesce(F.col("__out") > 0, F.lit(False)), F.coalesce(F.col("__in") > 0, F.lit(False))
    ref = F.col("business_ref")
    spare = F.when(out, DIRECTION_DESCRIPTION["expense"]).otherwise(DIRECTION_DESCRIPTION["income"])
    return _result(
        t, ids,
        skip=F.col("__day").isNull() | ~(out | inn),
        error=F.col("__shaped") & F.col("__day").isNull(),
        fields={
            "txn_date": F.col("__day"),
            "description": F.coalesce(blank_to_null(F.col("summary")), blank_to_null(F.col("transaction_type")), spare),
            "amount": F.when(out, F.col("__out")).otherwise(F.col("__in")),
            "direction": F.when(out, "expense").otherwise("income"),
            "counterparty": blank_to_null(F.col("counterparty")),
            "reference_number": blank_to_null(F.col("serial_no")),
            "notes": join_nonempty(
                [
                    F.when(F.col("__balance").isNotNull(), labelled("余额:", A.without_currency(F.col("balance")))),
                    labelled("对方账号:", F.col("counterparty_account")),
                    F.when(ref != F.col("serial_no"), labelled("业务参考号:", ref)),
                ],
                "; ",
            ),
            "account_number": blank_to_null(F.col("account_no")),
            "account_name": blank_to_null(F.col("account_name")),
        },
    )


def signed_amount(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """date, business_type, bill_no, description, amount, balance, counterparty."""
    t = _texts(df, ids, "date business_type bill_no description amount balance counterparty")
    t = t.withColumns({
        "__day": D.date_compact(F.col("date")), "__shaped": D.looks_compact(F.col("date")),
        "__amount": A.amount_strict(F.col("amount")), "__balance": A.amount_strict(F.col("balance")),
    })
    return _result(
        t, ids,
        skip=F.col("__day").isNull() | F.col("__amount").isNull(),
        error=(F.col("amount") != "") & F.col("__shaped") & F.col("__day").isNull(),
        fields={
            "txn_date": F.col("__day"),
            "description": join_nonempty(
                [F.col("business_type"), labelled("票据号:", F.col("bill_no")), F.col("description")], " | ", DEFAULT_DESCRIPTION
            ),
            "amount": F.abs("__amount"),
            "direction": F.when(F.col("__amount") > 0, "income").otherwise("expense"),
            "counterparty": blank_to_null(F.col("counterparty")),
            "reference_number": blank_to_null(F.col("bill_no")),
            "notes": _balance_note(),
        },
    )


def exclusive_out_in(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """date, biz_type, bill_no, expense, income, counterparty, balance; column titles count as empty."""
    names = "date biz_type bill_no expense income counterparty balance"
    t = _texts(df, ids, names)
    t = t.withColumns({c: F.when(F.col(c).isin(*GFB_LABELS), "").otherwise(F.col(c)) for c in names.split()})
    zero = F.lit(0).cast(A.MONEY)

    def given(c: str) -> Column:
        return F.when(F.col(c) == "", zero).otherwise(A.amount_strict(F.col(c)))

    t = t.withColumns({
        "__day": D.date_compact(F.col("date")), "__shaped": D.looks_compact(F.col("date")),
        "__out": given("expense"), "__in": given("income"), "__balance": A.amount_strict(F.col("balance")),
        "__kind": F.coalesce(blank_to_null(F.col("biz_type")), F.lit(DEFAULT_DESCRIPTION)),
    })
    out, inn, bill = F.col("__out"), F.col("__in"), F.col("bill_no")
    return _result(
        t, ids,
        skip=F.col("__day").isNull() | out.isNull() | inn.isNull() | ~((out > 0) | (inn > 0)),
        error=F.col("__shaped") & F.col("__day").isNull(),
        fields={
            "txn_date": F.col("__day"),
            "description": F.when(bill != "", F.concat("__kind", F.lit(" | 票据号:"), bill)).otherwise(F.col("__kind")),
            "amount": F.when(out > 0, out).otherwise(inn),
            "direction": F.when(out > 0, "expense").otherwise("income"),
            "counterparty": blank_to_null(F.col("counterparty")),
            "reference_number": blank_to_null(bill),
            "notes": _balance_note(),
        },
    )


def out_in_default_zero(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """cells (their number), date, amount_out, amount_in, counterparty, purpose, type, ref, balance."""
    t = _texts(df, ids, "date amount_out amount_in counterparty purpose type ref balance", "cells")
    t = t.withColumns({
        "__day": D.date_iso(first_match(F.col("date"), r"\d{4}-\d{2}-\d{2}")),
        "__out": A.amount_lenient(F.col("amount_out")), "__in": A.amount_lenient(F.col("amount_in")),
        "__ref": blank_to_null(F.replace(F.col("ref"), F.lit("|"), F.lit(""))),
    })
    got = F.col("__in") > 0
    return _result(
        t, ids,
        skip=(F.col("cells") < 10) | F.col("__day").isNull(),
        error=F.lit(False),
        fields={
            "txn_date": F.col("__day"),
            "description": F.coalesce(blank_to_null(F.col("purpose")), F.col("type")),
            "amount": F.when(got, F.col("__in")).otherwise(F.col("__out")),
            "direction": F.when(got, "income").otherwise("expense"),
            "counterparty": blank_to_null(F.col("counterparty")),
            "reference_number": F.regexp_replace("__ref", r"[^\d*]+$", ""),
            "notes": blank_to_null(F.col("balance")),
        },
    )


def receipt_by_type(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """receipt_type, trade_date, amount_raw, payer_*/payee_* name and account, summary, business_type,
    receipt_no, transaction_id, business_no."""
    t = _texts(
        df, ids, "trade_date amount_raw payer_name payer_account payee_name payee_account summary business_type "
        "receipt_no transaction_id business_no", "receipt_type",
    )
    t = t.withColumns({
        "__day": D.date_receipt(F.col("trade_date")), "__amount": A.amount_cny(F.col("amount_raw")),
        "__spend": F.coalesce(F.col("receipt_type"), F.lit("expense")) == "expense",
    })
    spend, amount = F.col("__spend"), F.col("__amount")
    summary, kind = F.col("summary"), F.col("business_type")
    txn_no, biz_no = F.col("transaction_id"), F.col("business_no")

    def side(field: str, own: bool) -> Column:
        first, second = ("payer", "payee") if own else ("payee", "payer")
        return blank_to_null(F.when(spend, F.col(f"{first}_{field}")).otherwise(F.col(f"{second}_{field}")))

    return _result(
        t, ids,
        skip=F.lit(False),
        error=F.col("__day").isNull() | amount.isNull() | (amount == 0),
        reason="no transaction in receipt",
        fields={
            "txn_date": F.col("__day"),
            "description": F.when((summary != "") & (summary != "收费"), summary).when(kind != "", kind)
            .when(summary != "", summary).when(spend, DIRECTION_DESCRIPTION["expense"])
            .otherwise(DIRECTION_DESCRIPTION["income"]),
            "amount": amount,
            "direction": F.when(spend, "expense").otherwise("income"),
            "counterparty": side("name", own=False),
            "reference_number": blank_to_null(F.col("receipt_no")),
            "notes": join_nonempty(
                [labelled("流水:", txn_no), F.when(biz_no != txn_no, labelled("业务编号:", biz_no))], "; "
            ),
            "account_number": side("account", own=True),
            "account_name": side("name", own=True),
        },
    )


def receipt_by_registry(df: DataFrame, accounts, ids: Sequence[str]) -> DataFrame:
    """accounting_date, timestamp, amount_text, payer_*/payee_* name and account, purpose, usage,
    business_type, ref_no, notes."""
    known = infer_direction(df, accounts)
    keep = ("direction", "other_party", "own_account")
    t = _texts(known, ids, "accounting_date timestamp amount_text purpose usage business_type ref_no notes", *keep)
    t = t.withColumn("__day", F.coalesce(D.date_chinese(F.col("accounting_date")), D.timestamp_date(F.col("timestamp"))))
    return _result(
        t, ids,
        skip=F.lit(False),
        error=F.col("__day").isNull(),
        reason="no date",
        fields={
            "txn_date": F.col("__day"),
            "description": join_nonempty(
                [F.col("purpose"), F.col("usage"), F.col("business_type")], " | ", DEFAULT_RECEIPT_DESCRIPTION, distinct=True
            ),
            "amount": A.amount_lenient(F.col("amount_text")),
            "direction": F.col("direction"),
            "counterparty": F.col("other_party"),
            "reference_number": blank_to_null(F.col("ref_no")),
            "notes": F.when(F.col("notes") != "", F.regexp_replace("notes", f"^{NOTE_PREFIX}", "")),
            "account_number": F.col("own_account"),
        },
    )


def _without(c: Column, words: Sequence[str]) -> Column:
    """Words removed one after the other, as a later word may appear once an earlier one is gone."""
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return strip(c)


def receipt_labels(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """date, timestamp, amount_text, payer, payee, purpose, usage, ref_no, notes, postscript, receipt_no, amount_cn."""
    t = _texts(
        df, ids, "date timestamp amount_text payer payee purpose usage ref_no notes postscript receipt_no amount_cn"
    )
    party = F.coalesce(blank_to_null(F.col("payee")), blank_to_null(F.col("payer")))
    leaked = rf"￥[\d,]+\.?\d*元?{BLANK}*"
    trailing = rf"{BLANK}*\|{BLANK}*\d{{5,}}$"
    bare = F.regexp_replace(_without(F.col("purpose"), PURPOSE_NOISE), leaked, "")
    t = t.withColumns({
        "__day": F.coalesce(D.date_chinese(F.col("date")), D.timestamp_date(F.col("timestamp"))),
        "__party": F.when(~is_account_like(party), party),
        "__purpose": strip(F.regexp_replace(strip(bare), trailing, "")),
    })
    return _result(
        t, ids,
        skip=F.col("__day").isNull(),
        error=F.lit(False),
        fields={
            "txn_date": F.col("__day"),
            "description": join_nonempty([F.col("__purpose"), F.col("usage")], " | ", DEFAULT_RECEIPT_DESCRIPTION),
            "amount": A.amount_lenient(F.col("amount_text")),
            "direction": F.lit("expense"),
            "counterparty": F.col("__party"),
            "reference_number": blank_to_null(_without(F.col("ref_no"), REFERENCE_NOISE)),
            "notes": join_nonempty(
                [
                    labelled("备注:", F.col("notes")), labelled("附言:", F.col("postscript")),
                    labelled("付款人:", F.col("payer")),
                    F.when(F.col("__party").isNull(), labelled("收款人:", F.col("payee"))),
                    labelled("回单号:", F.col("receipt_no")), labelled("大写:", F.col("amount_cn")),
                ],
                " | ",
            ),
        },
    )


def text_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line: (key, line_no, line)."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_records(lines: DataFrame, ids: Sequence[str], line: str = "line") -> DataFrame:
    """Free text, one record per line that holds a date and an amount; other lines are skipped."""
    t = F.col(line)
    dashed, slashed, packed = (first_match(t, p) for p in (r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{8}"))
    df = lines.withColumns({
        "__shown": F.coalesce(dashed, slashed, packed), "__money": first_match(t, r"[+-]?\d+\.\d{2}"),
    })
    shown, money = F.col("__shown"), F.col("__money")
    df = df.withColumns({
        "__day": D.date_compact(F.replace(shown, F.lit("/"), F.lit("-"))), "__value": A.amount_strict(money),
        "__rest": strip(F.replace(F.replace(t, shown, F.lit("")), money, F.lit(""))),
    })
    words = F.filter(F.split("__rest", f"{BLANK}+"), lambda w: w != "")
    df = df.withColumn("__words", F.coalesce(words, F.array().cast("array<string>")))
    day, value = F.col("__day"), F.col("__value")
    w, n = F.col("__words"), F.size("__words")
    capital = r"^\p{Lu}"
    pair = (n >= 3) & F.get(w, n - 2).rlike(capital) & F.get(w, n - 1).rlike(capital)
    taken = F.when(pair, 2).when(n >= 2, 1).otherwise(0)
    return _result(
        df, ids,
        skip=F.col("__shown").isNull() | F.col("__money").isNull(),
        error=F.col("__shown").isNotNull() & F.col("__money").isNotNull() & day.isNull(),
        fields={
            "txn_date": day,
            "description": F.coalesce(
                blank_to_null(F.when(n >= 2, F.array_join(F.slice(w, 1, F.greatest(n - taken, F.lit(0))), " ")).otherwise(F.col("__rest"))),
                F.lit(DEFAULT_DESCRIPTION),
            ),
            "amount": F.abs(value),
            "direction": F.when(value > 0, "income").otherwise("expense"),
            "counterparty": F.when(n >= 2, F.array_join(F.slice(w, F.greatest(n - taken + 1, F.lit(1)), taken), " ")),
        },
    )


def html_text(html: Column, tag: str = "span") -> Column:
    """Text of the tag's elements, entities decoded, one per line."""
    found = F.regexp_extract_all(html, F.lit(f"<{tag}[^>]*>([^<]+)</{tag}>"), 1)
    text = F.array_join(found, "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def cast_defaults(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Loosely typed text row to a typed transaction; missing values take their defaults."""
    def given(c: str, default: str | None = None) -> Column:
        col = F.col(c) if c in df.columns else F.lit(None).cast("string")
        return col if default is None else F.coalesce(col, F.lit(default))

    return df.select(
        *ids, D.date_iso(given("date")).alias("txn_date"), given("description", "").alias("description"),
        F.coalesce(A.amount_strict(given("amount")), F.lit(0).cast(A.MONEY)).alias("amount"),
        given("currency", "CNY").alias("currency"), given("direction", "expense").alias("direction"),
        *(given(c).alias(c) for c in ("counterparty", "reference_number", "notes", "account_number", "account_name")),
    )


def to_plain(df: DataFrame) -> DataFrame:
    """Typed transaction back to text date and floating amount under camel-case names."""
    return df.select(
        F.col("txn_date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"),
        "currency", "direction", "counterparty", F.col("reference_number").alias("referenceNumber"), "notes",
        F.col("account_number").alias("accountNumber"), F.col("account_name").alias("accountName"),
    )


def business_type(cell: Column, spill: Column) -> Column:
    """Value behind its label; the neighbouring cell when the label stands alone."""
    bare = F.replace(cell, F.lit(BUSINESS_TYPE_PREFIX), F.lit(""))
    return F.coalesce(blank_to_null(bare), spill)


def inline_value(text: Column, keyword: str) -> Column:
    """Text after the keyword without separators and closing punctuation; '' when absent."""
    at = F.instr(text, keyword)
    after = F.substring(text, at + F.lit(len(keyword)), F.length(text))
    after = strip(F.regexp_replace(after, r"^[：:)\s]+", ""))
    return F.when(at > 0, F.regexp_replace(after, "[，,。.]+$", "")).otherwise("")


def receipt_number(c: Column) -> Column:
    return first_match(c, r"\d{4}-\d{4}-\d{4}-\d{4}")


def verify_code(c: Column) -> Column:
    return F.when(c.contains("验证码"), first_match(c, r"[A-Za-z0-9+/=]{20,}"))


def holder_account(c: Column) -> Column:
    return first_match(c, r"账号[：:]\s*(\d{12,20})", 1)


def holder_name(c: Column) -> Column:
    return first_match(c, r"户名[：:]\s*([\x{4E00}-\x{9FFF}()（）\w]{3,30})", 1)


__all__ = [
    "CANONICAL", "business_type", "cast_defaults", "clean_text", "exclusive_out_in", "flagged_debit_credit",
    "holder_account", "holder_name", "html_text", "inline_value", "line_records", "out_in_default_zero",
    "receipt_by_registry", "receipt_by_type", "receipt_labels", "receipt_number", "signed_amount", "text_lines",
    "to_plain", "two_amount_columns", "verify_code",
]

"""Own-account table: matching, direction inference, validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_BANK_SUBJECT, RECEIPT, RECEIPT_NUMBER_LABELS, STATEMENT
from ..functions.text import blank_to_null, is_masked

#: Up to this many accounts are compiled into one expression; more are joined.
COMPILED_ACCOUNT_LIMIT = 400
ACCOUNT_SCHEMA = (
    "ord bigint, id string, match_type string, pattern string, bank string, bank_code string, "
    "subject_code string, subject_name string"
)


@dataclass(frozen=True)
class Account:
    ord: int
    id: str
    match_type: str
    pattern: str
    bank: str = ""
    bank_code: str = ""
    subject_code: str = ""
    subject_name: str = ""


def load_accounts(spark: SparkSession, source: dict | str | None = None) -> DataFrame:
    """Account document, JSON file or the defaults -> table; the first of equal ids stays."""
    if source is None:
        from .default_rules import DEFAULT_ACCOUNTS

        rows = [(i, *a) for i, a in enumerate(DEFAULT_ACCOUNTS)]
        return spark.createDataFrame(rows, ACCOUNT_SCHEMA)
    text = "string"
    if isinstance(source, dict):
        import json

        raw = spark.createDataFrame([(json.dumps(source, ensure_ascii=False),)], "doc string")
    else:
        raw = spark.read.text(source, wholetext=True).toDF("doc")
    shape = f"struct<accounts:array<struct<id:{text},matchType:{text},pattern:{text},bank:{text},bankCode:{text},subjectCode:{text},subjectName:{text}>>>"
    listed = raw.select(F.posexplode(F.from_json("doc", shape)["accounts"]).alias("ord", "a"))
    table = listed.select(
        F.col("ord").cast("bigint").alias("ord"), F.col("a.id").alias("id"),
        F.coalesce("a.matchType", F.lit("suffix")).alias("match_type"), F.col("a.pattern").alias("pattern"),
        F.col("a.bank").alias("bank"), F.col("a.bankCode").alias("bank_code"),
        F.col("a.subjectCode").alias("subject_code"), F.col("a.subjectName").alias("subject_name"),
    )
    return first_by_key(table, ["id"], "ord")


def first_by_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the lowest ordinal for each key (partially aggregated, no sort)."""
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), ordinal).alias("__r"))
    return packed.select("__r.*")


def accounts_if_few(accounts: DataFrame, limit: int = COMPILED_ACCOUNT_LIMIT) -> list[Account] | None:
    rows = accounts.select(*(f.split()[0] for f in ACCOUNT_SCHEMA.split(", "))).limit(limit + 1).collect()
    return None if len(rows) > limit else [Account(*r) for r in rows]


def account_column(accounts: Sequence[Account], account: Column) -> Column:
    """Struct of the matching account or null: exact beats suffix, then the lowest ordinal."""
    number = F.coalesce(account, F.lit(""))
    ordered = sorted(accounts, key=lambda a: (a.match_type != "exact", a.ord))
    choice = None
    for i, a in enumerate(ordered):
        if a.match_type == "exact":
            cond = number == a.pattern
        elif a.match_type == "suffix":
            cond = number.endswith(a.pattern)
        else:
            continue
        choice = F.when(cond, F.lit(i)) if choice is None else choice.when(cond, F.lit(i))
    fields = ("id", "bank_code", "subject_code", "subject_name")
    kind = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    if choice is None:
        return F.lit(None).cast(kind)
    table = F.array(*(F.struct(*(F.lit(getattr(a, f) or "").alias(f) for f in fields)) for a in ordered))
    return F.get(table, choice)


def join_accounts(numbers: DataFrame, accounts: DataFrame, account: str, out: str) -> DataFrame:
    """The same for account tables too large to compile.

    "Ends with the pattern" becomes an equality: every suffix of each distinct number is
    looked up.
    """
    number = F.col("__acct")
    asked = numbers.select(F.coalesce(account, F.lit("")).alias("__acct")).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length(number) + 1), lambda i: F.substring(number, i, F.length(number)))
    tails = asked.select("__acct", F.explode(F.array_distinct(cuts)).alias("__tail"))
    hit = tails.join(accounts, F.col("__tail") == F.col("pattern")).where(
        (F.col("match_type") == "suffix") | ((F.col("match_type") == "exact") & (F.col("pattern") == number))
    )
    won = hit.groupBy("__acct").agg(
        F.min_by(
            F.struct("id", "bank_code", "subject_code", "subject_name"),
            F.struct(F.col("match_type") != "exact", F.col("ord")),
        ).alias(out)
    )
    return (
        numbers.withColumn("__acct", F.coalesce(account, F.lit("")))
        .join(won, "__acct", "left").select(*numbers.columns, out)
    )


def match_accounts(
    df: DataFrame, accounts: DataFrame | Sequence[Account], account: str = "account_number", out: str = "own"
) -> DataFrame:
    """Attach the matching account struct (null when none)."""
    if isinstance(accounts, DataFrame):
        few = accounts_if_few(accounts)
        if few is None:
            return join_accounts(df, accounts, account, out)
        accounts = few
    return df.withColumn(out, account_column(accounts, F.col(account)))


def bank_subject(own: Column) -> tuple[Column, Column]:
    """Code and name of the bank subject, defaulted when no account matched."""
    code, name = DEFAULT_BANK_SUBJECT
    return (
        F.when(own.isNotNull(), own["subject_code"]).otherwise(F.lit(code)),
        F.when(own.isNotNull(), own["subject_name"]).otherwise(F.lit(name)),
    )


def infer_direction(receipts: DataFrame, accounts: DataFrame | Sequence[Account]) -> DataFrame:
    """Which side is ours: adds direction, own_account, other_party.

    Needs payer_account, payee_account, payer_name, payee_name.  A masked or empty account
    never matches; the other party shows its account when that is unmasked.
    """
    def usable(c: str) -> Column:
        col = F.col(c)
        return F.when(col.isNotNull() & (col != "") & ~is_masked(col), col).otherwise(F.lit("\u0000"))

    asked = receipts.withColumns({"__pay": usable("payer_account"), "__get": usable("payee_account")})
    both = match_accounts(match_accounts(asked, accounts, "__pay", "__p"), accounts, "__get", "__g")
    pays = F.col("__p").isNotNull() & (F.col("__pay") != "\u0000")
    gets = F.col("__g").isNotNull() & (F.col("__get") != "\u0000")

    def shown(name: str, acct: str) -> Column:
        n, a = blank_to_null(F.col(name)), F.col(acct)
        with_number = n.isNotNull() & a.isNotNull() & (a != "") & ~is_masked(a)
        return F.when(with_number, F.concat(n, F.lit("（"), a, F.lit("）"))).otherwise(n)

    return both.withColumns({
        "direction": F.when(pays, "expense").when(gets, "income").otherwise("expense"),
        "own_account": F.when(pays, F.col("payer_account")).when(gets, F.col("payee_account")),
        "other_party": F.when(pays, shown("payee_name", "payee_account"))
        .when(gets, shown("payer_name", "payer_account"))
        .otherwise(F.coalesce(blank_to_null(F.col("payee_name")), blank_to_null(F.col("payer_name")))),
    }).drop("__p", "__g", "__pay", "__get")


def detect_account_in_text(texts: DataFrame, accounts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First 12-19 digit run of each text that is a known account: (key, account, bank_code, doc_type)."""
    runs = texts.select(
        key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(\d{12,19})"), 1)).alias("pos", "account"),
        F.when(F.col(text).rlike("|".join(RECEIPT_NUMBER_LABELS)), RECEIPT).otherwise(STATEMENT).alias("doc_type"),
    )
    known = match_accounts(runs, accounts, "account", "own").where(F.col("own").isNotNull())
    won = known.groupBy(key).agg(F.min_by(F.struct("account", "own", "doc_type"), "pos").alias("w"))
    return won.select(
        key, F.col("w.account").alias("account"), F.col("w.own.bank_code").alias("bank_code"),
        F.col("w.doc_type").alias("doc_type"),
    )


def check_accounts(new: DataFrame, subjects: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Verdict per proposed account: reason is null when it may be saved.

    With ``existing`` the rows are updates and their id must be there.
    """
    known = subjects.select(F.col("code").alias("subject_code"), F.lit(True).alias("__known")).distinct()
    check_codes = not subjects.isEmpty()
    rows = new.join(known, "subject_code", "left")
    missing_id = F.lit(False)
    if existing is not None:
        rows = rows.join(existing.select("id", F.lit(True).alias("__old")).distinct(), "id", "left")
        missing_id = F.col("__old").isNull()
    reason = (
        F.when(missing_id, "no such id")
        .when(F.lit(existing is None) & (F.coalesce("bank_code", F.lit("")) == ""), "bank code required")
        .when(F.lit(check_codes and existing is None) & F.col("__known").isNull(), "unknown subject")
        .otherwise(F.lit(None).cast("string"))
    )
    return rows.select(*new.columns, reason.alias("reason"))

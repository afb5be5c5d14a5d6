"""Chart of accounts: load, hierarchy, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def load_subjects(rows: DataFrame) -> DataFrame:
    """Positional text rows (ord, c0..c6) -> subjects; the last row of a code wins."""
    def cell(i: int):
        return F.nullif(F.col(f"c{i}"), F.lit(""))

    clean = rows.where(F.coalesce(cell(0), F.lit("")) != "").select(
        strip(cell(0)).alias("code"), "ord",
        F.coalesce(strip(cell(1)), F.lit("")).alias("name"), F.coalesce(strip(cell(2)), F.lit("")).alias("category"),
        F.coalesce(strip(cell(3)), F.lit("借")).alias("direction"),
        F.coalesce(strip(cell(4)), F.lit("")).alias("aux_category"),
        F.coalesce(strip(cell(5)) == "是", F.lit(False)).alias("is_cash"),
        F.coalesce(strip(cell(6)) != "停用", F.lit(True)).alias("enabled"),
    )
    fields = [c for c in clean.columns if c != "code"]
    return clean.groupBy("code").agg(F.max_by(F.struct(*fields), "ord").alias("s")).select("code", "s.*")


def hierarchy(subjects: DataFrame) -> DataFrame:
    """(code, parent, full_name): ancestors are the existing codes that are prefixes of a code.

    Prefixes are listed and looked up by equality; the chain of one code is no longer than
    the code itself.
    """
    names = subjects.select(F.col("code").alias("__p"), F.col("name").alias("__pname"))
    prefixes = subjects.select(
        "code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("__p")
    )
    chain = prefixes.join(names, "__p").groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct(F.length("__p").alias("n"), F.col("__p").alias("p"), F.col("__pname").alias("name")))).alias("c")
    )
    above = F.filter("c", lambda e: e["n"] < F.length("code"))
    return chain.select(
        "code", F.try_element_at(above, F.lit(-1))["p"].alias("parent"),
        F.array_join(F.transform("c", lambda e: e["name"]), "_").alias("full_name"),
    )


def search_subjects(subjects: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    """Enabled subjects whose code, name or full name contains the text, ignoring case."""
    needle = text.lower()
    hit = F.lit(not needle)
    for c in ("code", "name", "full_name"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(needle)
    out = subjects.where(F.coalesce("enabled", F.lit(True)) & hit)
    return out.where(F.col("category") == category) if category else out

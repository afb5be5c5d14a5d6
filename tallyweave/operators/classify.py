"""Rule tier of the classification: first matching keyword rule wins."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_PRIORITY
from ..session import materialize, spread

#: Up to this many rules are compiled into one expression; more are joined.
COMPILED_RULE_LIMIT = 400
#: Longest piece by which a keyword is looked up.  Any number of two or more gives the same result.
PIECE = 8

RULE_SCHEMA = (
    "ord bigint, rule_id string, direction string, priority bigint, keywords array<string>, "
    "exclude array<string>, require array<string>, counterparty_pattern string, code string, name string"
)
MATCH_TYPE = "struct<subject_code:string,subject_name:string,source:string,rule_id:string>"


@dataclass(frozen=True)
class Rule:
    ord: int
    rule_id: str
    direction: str
    priority: int
    keywords: tuple[str, ...]
    exclude: tuple[str, ...] = field(default=())
    require: tuple[str, ...] = field(default=())
    counterparty_pattern: str = ""
    code: str = ""
    name: str = ""


def parse_rules(config: dict) -> list[Rule]:
    """Rule document -> rules; ``ord`` is the position in the document."""
    found: list[Rule] = []
    for direction in ("expense", "income"):
        for raw in (config.get(direction) or {}).get("rules") or []:
            cond = raw.get("match") or {}
            found.append(
                Rule(
                    ord=len(found),
                    rule_id=raw.get("id") or "",
                    direction=direction,
                    priority=raw.get("priority", DEFAULT_PRIORITY),
                    keywords=tuple(cond.get("keywords") or ()),
                    exclude=tuple(cond.get("exclude_keywords") or ()),
                    require=tuple(cond.get("require_keywords") or ()),
                    counterparty_pattern=cond.get("counterparty_pattern") or "",
                    code=raw.get("subject_code") or "",
                    name=raw.get("subject_name") or "",
                )
            )
    return found


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (r.ord, r.rule_id, r.direction, r.priority, list(r.keywords), list(r.exclude), list(r.require),
         r.counterparty_pattern, r.code, r.name)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_if_few(rules: DataFrame, limit: int = COMPILED_RULE_LIMIT) -> list[Rule] | None:
    """The rules as a list when there are at most ``limit``; the read stops just beyond it."""
    rows = plain_rules(rules).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return [
        Rule(r.ord, r.rule_id, r.direction, r.priority, tuple(r.keywords), tuple(r.exclude), tuple(r.require),
             r.counterparty_pattern, r.code, r.name)
        for r in rows
    ]


def plain_rules(rules: DataFrame) -> DataFrame:
    """Rules as both ways of matching read them: no null condition, text or priority."""
    words = {c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda w: w.isNotNull()) for c in ("keywords", "exclude", "require")}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("rule_id", "counterparty_pattern", "code", "name")}
    return rules.withColumns({**words, **texts, "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).cast("bigint")})


def _any_in(text: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def rule_column(
    rules: Sequence[Rule],
    summary: str | Column = "description",
    direction: str | Column = "direction",
    counterparty: str | Column = "counterparty",
) -> Column:
    """One expression that yields the winning rule's match struct, or null.

    No shuffle and no join: it is evaluated inside the scan stage.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    text, way, party = as_col(summary), as_col(direction), F.coalesce(as_col(counterparty), F.lit(""))
    ordered = sorted((r for r in rules if r.keywords), key=lambda r: (r.priority, r.ord))
    if not ordered:
        return F.lit(None).cast(MATCH_TYPE)
    choice = None
    for i, r in enumerate(ordered):
        cond = (way == r.direction) & _any_in(text, r.keywords)
        if r.exclude:
            cond = cond & ~_any_in(text, r.exclude)
        for w in r.require:
            cond = cond & text.contains(w)
        if r.counterparty_pattern:
            cond = cond & party.contains(r.counterparty_pattern)
        choice = F.when(cond, F.lit(i)) if choice is None else choice.when(cond, F.lit(i))
    results = F.array(
        *(
            F.struct(
                F.lit(r.code).alias("subject_code"), F.lit(r.name).alias("subject_name"),
                F.lit("rule").alias("source"), F.lit(r.rule_id).alias("rule_id"),
            )
            for r in ordered
        )
    )
    return F.get(results, choice)


def _tails(text: Column) -> Column:
    """What starts at each character of a text, up to ``PIECE`` characters; the last character alone starts nothing."""
    found = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(PIECE)))
    return F.when(F.length(text) >= 2, found).otherwise(F.array().cast("array<string>"))


def _grams(text: Column, size: int = 2) -> Column:
    """Pieces of ``size`` characters of a text; a shorter one is its own piece."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array(text))


def _anchors(words: DataFrame, pieces: DataFrame, size: int = 2) -> DataFrame:
    """(word, gram): for each word the one of its pieces that fewest rows of ``pieces`` hold; none where no row holds one of them."""
    grams = words.withColumn("gram", F.explode(F.array_distinct(_grams(F.col("word"), size))))
    frequency = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rated = grams.join(frequency, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    return rated.groupBy("word").agg(F.min(F.struct("texts", "gram")).alias("a")).where("a.texts > 0").select("word", F.col("a.gram").alias("gram"))


def _pieces(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tid, key): the pieces of each text that begin like an anchor and are as long; key names direction and piece."""
    # A few sizes for each pair of characters; stored, so that its size decides how it travels.
    heads = anchors.where(F.length("gram") >= 2).groupBy(F.substring("gram", 1, 2).alias("head")).agg(F.collect_set(F.length("gram")).alias("sizes"))
    heads = materialize(heads, "rule-heads")
    tails = texts.select("tid", "direction", F.explode(_tails(F.col("description"))).alias("tail"))
    sized = tails.join(heads, F.substring("tail", 1, 2) == F.col("head")).select("tid", "direction", "tail", F.explode("sizes").alias("size"))
    found = sized.where(F.length("tail") >= F.col("size")).select("tid", "direction", F.expr("substring(tail, 1, size)").alias("gram"))
    if not anchors.where(F.length("gram") < 2).isEmpty():
        letters = F.transform(F.sequence(F.lit(1), F.length("description")), lambda i: F.substring("description", i, F.lit(1)))
        single = F.when(F.length("description") >= 1, letters).otherwise(F.array().cast("array<string>"))
        found = found.unionByName(texts.select("tid", "direction", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), single))).alias("gram")))
    return found.select("tid", F.xxhash64("direction", "gram").alias("key"))


def join_rules(df: DataFrame, rules: DataFrame, out: str = "match") -> DataFrame:
    """The same result for rule sets too large to compile.

    An index of anchors stands for "contains a keyword": a keyword of up to ``PIECE`` characters is looked up as it is,
    a longer one by the piece of that length that fewest keywords hold, so few keywords share an anchor however many
    there are.  A text looks up those of its pieces that begin like an anchor, and only what is found is compared as a
    whole.  Each distinct text is looked up once.
    """
    rules = plain_rules(rules)
    conditions = ["exclude", "require", "counterparty_pattern"]
    payload = F.struct(
        F.col("code").alias("subject_code"), F.col("name").alias("subject_name"),
        F.lit("rule").alias("source"), F.col("rule_id"),
    )
    # Of rules with one keyword and the same conditions only the first can win.
    by_word = rules.select("*", F.explode(F.array_distinct("keywords")).alias("word")).groupBy(F.col("direction").alias("way"), "word", *conditions).agg(
        F.min_by(F.struct("priority", "ord", payload.alias("won")), F.struct("priority", "ord")).alias("rule"))
    words = spread(rules.select(F.explode("keywords").alias("word")), "word").distinct()
    held = words.select(F.explode(F.array_distinct(_grams(F.col("word"), PIECE))).alias("gram"))
    anchors = materialize(_anchors(words, held, PIECE), "rule-anchors")
    key = ["direction", "description"]
    keyed = df
    if not rules.where("counterparty_pattern <> ''").isEmpty():
        key, keyed = [*key, "__cp"], df.withColumn("__cp", F.coalesce("counterparty", F.lit("")))
    # Written once: candidates are rows of numbers and meet their text by it.
    texts = materialize(keyed.select(*key).distinct().withColumn("tid", F.monotonically_increasing_id()), "rule-texts")
    asked = by_word.join(anchors, "word").withColumn("key", F.xxhash64("way", "gram")).drop("gram")
    text, party = F.col("description"), F.col("__cp") if "__cp" in key else F.lit("")
    hits = _pieces(texts, anchors).join(asked, "key").drop("key").join(texts, "tid")
    ok = hits.where(
        (F.col("direction") == F.col("way"))
        & text.contains(F.col("word"))
        & ~F.exists("exclude", lambda w: text.contains(w))
        & F.forall("require", lambda w: text.contains(w))
        & party.contains(F.col("counterparty_pattern"))
    )
    best = ok.groupBy("tid").agg(F.min_by("rule.won", F.struct("rule.priority", "rule.ord")).alias(out))
    won = texts.join(best, "tid").drop("tid")
    return keyed.join(won, key, "left").select(*df.columns, out)


def apply_rules(df: DataFrame, rules: Sequence[Rule] | DataFrame, out: str = "match") -> DataFrame:
    """Attach the winning rule (null when none): compiled for small rule sets, joined beyond."""
    if isinstance(rules, DataFrame):
        few = rules_if_few(rules)
        if few is None:
            return join_rules(df, rules, out)
        rules = few
    elif len(rules) > COMPILED_RULE_LIMIT:
        return join_rules(df, rules_frame(df.sparkSession, rules), out)
    return df.withColumn(out, rule_column(rules))


def with_aux(df: DataFrame, subjects: DataFrame, code: str = "subject_code") -> DataFrame:
    """Auxiliary category of the subject, '' when the code is unknown."""
    dim = subjects.groupBy(F.col("code").alias(code)).agg(
        F.max(F.struct("aux_category", "aux_category_name")).alias("__dim")  # one row for a code, however often it is listed
    ).select(code, F.col("__dim.aux_category").alias("__aux"), F.col("__dim.aux_category_name").alias("__auxn"))
    empty = F.lit("")
    kept = [c for c in df.columns if c not in ("aux_category", "aux_category_name")]

    def filled(name: str, found: str) -> Column:
        found_col = F.coalesce(F.col(found), empty)
        if name not in df.columns:
            return found_col.alias(name)
        return F.coalesce(F.nullif(F.col(name), empty), found_col).alias(name)

    return df.join(dim, code, "left").select(
        *kept, filled("aux_category", "__aux"), filled("aux_category_name", "__auxn")
    )


def lint_rules(rules: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Findings per rule: (ord, rule_id, finding).  A null or empty subject table skips that check."""
    named = rules.withColumn("__id", F.coalesce("rule_id", F.lit("")))
    has_code = F.coalesce("code", F.lit("")) != ""
    first = named.where("__id <> ''").groupBy("__id").agg(F.min("ord").alias("__first"))
    flagged = named.join(first, "__id", "left").select(
        "ord", F.col("__id").alias("rule_id"), "code",
        F.filter(
            F.array(
                F.when(F.col("__id") == "", F.lit("missing id")),
                F.when(F.col("ord") > F.col("__first"), F.lit("duplicate id")),
                F.when(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, F.lit("no keywords")),
                F.when(~has_code, F.lit("missing subject")),
            ),
            lambda x: x.isNotNull(),
        ).alias("found"),
    )
    findings = flagged.select("ord", "rule_id", F.explode("found").alias("finding"))
    if subjects is None or subjects.isEmpty():
        return findings
    unknown = (
        named.where(has_code)
        .join(subjects.select("code").distinct(), "code", "left_anti")
        .select("ord", F.col("__id").alias("rule_id"), F.lit("unknown subject").alias("finding"))
    )
    return findings.unionByName(unknown)


def load_rules(spark: SparkSession, source: dict | str | None = None) -> list[Rule]:
    """Rules from a document, a JSON file, or the defaults; an unreadable file gives no rules."""
    if source is None:
        from .default_rules import DEFAULT_RULES

        return parse_rules(DEFAULT_RULES)
    if isinstance(source, dict):
        return parse_rules(source)
    try:
        text = spark.read.text(source, wholetext=True).first()
        return parse_rules(json.loads(text[0])) if text else []
    except Exception as problem:  # a missing or broken file must not stop the run
        import logging

        logging.getLogger("tallyweave").warning("rule file not loaded: %s", problem)
        return []

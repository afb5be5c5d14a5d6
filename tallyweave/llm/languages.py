"""Language identification by hierarchical discrimination with linear support vector machines.

A text is first given to a family of languages, by one machine for each family against the rest, and then to one of the
family's languages, by one machine for each pair of them.  Families are closely related languages, which need features
of their own to be told apart; languages of other families don't disturb that.  All machines see hashed byte n-grams
of the whole text.  Training takes a bounded sample of each language and runs one machine to a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import Batches, only, store
from .words import mix

#: Families of languages by ISO 639-1 code; any other value is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["ar", "he", "mt"],
    "malayic": ["id", "ms"],
}
#: Features, and the n-grams that are hashed onto them.
FEATURES = 1 << 12
ORDERS = (1, 2, 3, 4)
#: Documents of each language that train the machines of pairs, and of all languages together those of families
#: (FLOOR of each at least): the documented bound of what a classifier is fitted on.
PER_LANGUAGE, FOR_FAMILIES, FLOOR = 1000, 4000, 50
#: Passes over a sample, and the weight of an error.
PASSES, COST = 12, 1.0
#: Bytes looked at together; bounds the arrays of a long text.
SPAN = 1 << 20
#: What a text without letters, or without anything learned, is called.
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of a lower-cased text; all zero for an empty one.

    Bytes of ASCII that are no letters count as one space, so digits and layout have no say.
    """
    raw = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    counts = np.zeros(FEATURES)
    reach = max(ORDERS) - 1
    for lo in range(0, len(raw), SPAN):
        piece = raw[lo : lo + SPAN + reach].astype(np.uint64)  # a window belongs to the span where it starts
        key = np.zeros(len(piece), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            key = key[: len(piece) - n + 1] * np.uint64(257) + piece[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                counts += np.bincount((mix(key[:SPAN]) & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
    root = np.sqrt(counts)
    norm = np.sqrt(counts.sum())
    return root / norm if norm else root


def machine(rows: np.ndarray, signs: np.ndarray, cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights and, last, the offset of a linear support vector machine with squared hinge loss.

    Dual coordinate descent; the order of each pass is fixed.  An error weighs more in the smaller class.
    """
    x = np.hstack([rows, np.ones((len(rows), 1), dtype=rows.dtype)])
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    diagonal = share / cost  # 1 / (2 C) of the row, with C = cost / (2 share)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x).astype(np.float64)
    order = np.random.default_rng(1)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            gradient = signs[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / (square[i] + diagonal[i]), 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * signs[i] * x[i]
                alpha[i] = new
    return w


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, rank, text): so many distinct texts of each language at most, by a hash of the text."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = rows.select("lang", "h").distinct()
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A share of the hashes first, somewhat above what is wanted, so that ranking sees few rows of a language.
    share = F.least(F.lit(1.0), (1.2 * per_language + 200) / F.col("n"))
    small = distinct.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    # A few rows of known size, so that the texts need not be shuffled to find theirs.
    chosen = store(small.select("lang", "h", rank.alias("rank")).where(F.col("rank") <= per_language), "language-chosen")
    return rows.join(chosen, ["lang", "h"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))


def _profiles(batches: Batches) -> Batches:
    for batch in batches:
        cells = [profile(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(cells, pa.binary())], names=["lang", "rank", "cells"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, for_families: int = FOR_FAMILIES) -> Model:
    """Fit all machines on (text, lang) of ``docs``; rows with a null in either, or without a letter, teach nothing."""
    taught = store(sample(docs, per_language).mapInArrow(_profiles, "lang string, rank int, cells binary"), "language-sample")
    languages = sorted(r.lang for r in taught.select("lang").distinct().collect())  # one row for each language
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family(lang), []).append(lang)
    names = list(families)
    if len(languages) < 2:
        return Model(families, {}, {})
    pairs = [(a, b) for members in families.values() for a, b in combinations(members, 2)]
    few = max(FLOOR, for_families // len(languages))
    # (machine, lang, sign) and the rows that machine takes of the language.
    tasks = [(f"f {name}", lang, 1 if family(lang) == name else -1, few) for name in names for lang in languages] if len(names) > 1 else []
    tasks += [(f"p {a} {b}", lang, sign, per_language) for a, b in pairs for lang, sign in ((a, 1), (b, -1))]
    plan = docs.sparkSession.createDataFrame(tasks, "machine string, lang string, sign int, most int")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "rank"])
        x = np.frombuffer(b"".join(rows["cells"]), dtype=np.float32).reshape(len(rows), -1)
        return pd.DataFrame({"machine": [key[0]], "weights": [machine(x, rows["sign"].to_numpy().astype(float)).astype(np.float32).tobytes()]})

    fitted = taught.join(plan, "lang").where("rank <= most").groupBy("machine").applyInPandas(fit, "machine string, weights binary")
    weights = {r.machine: np.frombuffer(r.weights, dtype=np.float32) for r in fitted.collect()}  # one row for each machine
    by_family = {name: weights[f"f {name}"] for name in names} if len(names) > 1 else {}
    return Model(families, by_family, {(a, b): weights[f"p {a} {b}"] for a, b in pairs})


class Model:
    """Fitted machines: one for each family against the rest, one for each pair of languages of a family."""

    def __init__(self, families: dict[str, list[str]], by_family: dict[str, np.ndarray], by_pair: dict[tuple[str, str], np.ndarray]):
        self.families, self.by_family, self.by_pair = families, by_family, by_pair

    def decide(self, rows: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each profile: the family's share of all families' margins, times the language's mean share of its pairs."""
        if not self.families or not len(rows):
            return [(UNKNOWN, 0.0)] * len(rows)
        x = np.hstack([rows, np.ones((len(rows), 1), dtype=rows.dtype)])
        names = list(self.families)
        sure = np.ones((len(rows), 1))
        if self.by_family:
            sure = _share(x @ np.stack([self.by_family[n] for n in names]).T)
            sure = sure / sure.sum(axis=1, keepdims=True)
        best = sure.argmax(axis=1)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(rows)
        for f, name in enumerate(names):
            members, at = self.families[name], np.flatnonzero(best == f)
            if not len(at):
                continue
            votes = np.full((len(at), len(members)), 1.0 if len(members) == 1 else 0.0)
            for i, j in combinations(range(len(members)), 2):
                first = _share(x[at] @ self.by_pair[members[i], members[j]])
                votes[:, i] += first / (len(members) - 1)
                votes[:, j] += (1 - first) / (len(members) - 1)
            for k, row in enumerate(at):
                out[row] = (members[int(votes[k].argmax())], float(min(1.0, sure[row, f] * votes[k].max())))
        return out


def _share(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2.0 * margin, -40, 40)))


def predict(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row.

    Texts that are null or hold no letter are ``und`` with score 0, and so is every text if nothing was learned.  Equal
    texts get equal answers; repeated rows stay.  Ties go to the first family, then the first language by code.  An empty
    table gives no row.  The whole text counts, however long.  Columns of other names have no influence.
    """
    rows = only(df, id=id_col, text=text_col).withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, lettered = batch.column("text"), batch.column("lettered").to_pylist()
            langs, scores = [], []
            for lo in range(0, batch.num_rows, 64):
                some = [t if ok else "" for t, ok in zip(texts.slice(lo, 64).to_pylist(), lettered[lo : lo + 64], strict=True)]
                found = model.decide(np.array([profile(t) for t in some], dtype=np.float32))
                found = [f if ok else (UNKNOWN, 0.0) for f, ok in zip(found, lettered[lo : lo + 64], strict=True)]
                langs += [f[0] for f in found]
                scores += [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def remainder(id_: Column, parts: int) -> Column:
    """CRC-32 of an id's text modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(parts))

"""History tier of the classification: nearest learned text by TF-IDF cosine.

Exact, and without comparing every pair.

* Equal texts score equally, so each distinct cleaned text is weighed once (document counts keep their multiplicity).
* Grams are put in one global order, rare first.  If cosine(q, h) >= t then the rarest gram they share lies in the
  *prefix* of both, where a prefix ends as soon as the rest of the vector has norm < t.  So the index is a list of
  learned texts for each gram of their prefixes, with the list's length and largest remaining norm, and a query visits
  the lists of its own prefix only.
* Lists are cut into blocks, and queries meet blocks through one shuffle; no pair is ever a row.  Queries travel as their
  text: learned texts bring the weights of all grams that can be shared.  In a block the norms left at the shared gram
  tell which texts a query can reach; where these are many, the next gram that a pair shares names far fewer.  One product
  of matrices in single precision bounds those pairs.  Only pairs whose bound reaches the best score so far are scored in
  full, in double precision.
* ``top1_history`` lets that best score rise from list to list: the rarest list first, then the few that can beat it.

Common grams carry little weight and rank last, so they rarely enter a prefix.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SIMILARITY_THRESHOLD
from ..functions.text import char_bigrams, matching_text
from ..session import materialize, spread

_SLACK = 1e-9
#: Learned texts of a block, queries that meet a block in one task, and grams of a block that its bounds know exactly.
#: Any numbers give the same result.
BLOCK, ASKED, DENSE = 131072, 131072, 1024
#: Numbers in a block's matrix: longer blocks know fewer grams exactly.
CELLS = 2**25
#: Queries and learned texts whose bounds are computed together, queries that are unpacked together, and pairs that are scored together.
CHUNK, WIDE, UNPACKED, SCORED = 128, 8192, 16384, 65536
#: A query that can reach more texts than this meets them by the next gram they share, if that spares this many pairs for each gram.
SPLIT, WORTH = 1024, 8192


def gram_counts(docs: DataFrame, keys: list[str], text: str = "ct", keep: tuple[str, ...] = ()) -> DataFrame:
    """Term frequency: one row per (keys, text, gram) with ``cnt`` and the text's ``total``.

    ``keep`` names columns that depend on the text only and travel along.
    """
    grams = spread(docs.select(*keys, text, *keep), *keys, text).select("*", F.explode(char_bigrams(F.col(text))).alias("gram"))
    total = F.greatest(F.length(text) - 1, F.lit(1))
    return grams.groupBy(*keys, text, "gram").agg(
        F.count(F.lit(1)).alias("cnt"), *(F.first(c).alias(c) for c in keep)
    ).withColumn("total", total)


def distinct_history(history: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cleaned text: its multiplicity and the most recently confirmed record."""
    latest = F.struct(F.col("confirmed"), -F.col("hid"))
    return (
        history.withColumn("ct", matching_text(F.col("description")))
        .groupBy(*keys, "ct")
        .agg(
            F.count(F.lit(1)).alias("mult"),
            F.max_by(F.struct("hid", "code", "name", "confirmed"), latest).alias("rec"),
        )
    )


def inverse_frequency(history: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram) -> df, idf = ln(N/df) + 1; N counts empty texts too.

    ``counts`` carries the multiplicity of its texts.
    """
    n = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy(*keys, "gram").agg(F.sum("mult").alias("df"))
    # One row of N per key value (two directions): the size check of the session decides how it travels.
    return df.join(n, keys).select(*keys, "gram", "df", "n", (F.log(F.col("n") / F.col("df")) + 1.0).alias("idf"))


def document_frequency(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["direction"]
    counts = gram_counts(distinct_history(history, keys), keys, keep=("mult",))
    return inverse_frequency(history, counts, keys)


def cosine_similarity(a: DataFrame, b: DataFrame, keys: list[str], left: list[str]) -> DataFrame:
    """Cosine of each ``left`` vector of ``a`` with the one vector of ``b`` per key.

    Long form: (keys, left, gram, w) and (keys, gram, w).  A zero norm gives 0.
    """
    other = b.select(*keys, "gram", F.col("w").alias("__v"))
    norms = b.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__nb"))
    w, v = F.col("w"), F.coalesce("__v", F.lit(0.0))
    sums = a.join(other, [*keys, "gram"], "left").groupBy(*keys, *left).agg(
        F.sum(w * v).alias("__dot"), F.sqrt(F.sum(w * w)).alias("__na")
    )
    size = F.col("__na") * F.col("__nb")
    return sums.join(norms, keys, "left").select(
        *keys, *left, F.when(F.coalesce(size, F.lit(0.0)) == 0, 0.0).otherwise(F.col("__dot") / size).alias("score")
    )


@dataclass(frozen=True)
class HistoryIndex:
    """Learned history prepared for lookups, written once.

    ``bags`` holds each distinct text's gram counts, ``grams`` the frequencies, ``texts`` what the weighted vectors are made
    from and their prefixes, and ``lists`` the length and largest remaining norm of each gram's list.  Build it once, ``extend_index`` it with what is
    learned later, and use it for any number of query sets; ``save_index`` keeps it for other sessions.
    """

    bags: DataFrame
    grams: DataFrame
    texts: DataFrame
    lists: DataFrame
    keys: tuple[str, ...]
    threshold: float


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct bigrams each cleaned text has, their numbers (rising) and their share of all its grams, text after text.

    A gram has at most two characters, so their code points name it.  A null text has none.
    """
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    goes_on = np.ones(len(points), dtype=bool)
    goes_on[np.cumsum(length)[length > 0] - 1] = False
    gram = (points << 21) | np.where(goes_on, np.roll(points, -1), 0)
    some = goes_on | (length == 1)[row]
    known, place = np.unique(gram[some], return_inverse=True)
    found, count = np.unique(row[some] * max(len(known), 1) + place, return_counts=True)
    owner = found // max(len(known), 1)
    total = np.bincount(owner, count, len(length))
    return np.bincount(owner, minlength=len(length)), known[found % max(len(known), 1)], count / total[owner]


def _lists(size: np.ndarray, *values: pa.Array) -> list[pa.Array]:
    """``values`` as lists of ``size`` entries."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _bagged(texts: DataFrame) -> DataFrame:
    """Add ``ids`` and ``tf``: the distinct grams of ``ct`` and their share of all its grams.  A null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ids, tf = _cut(batch.column("ct"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_lists(size, pa.array(ids, pa.int64()), pa.array(tf, pa.float64()))], names=[*batch.schema.names, "ids", "tf"])

    return texts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", ids array<bigint>, tf array<double>")


def _weighted(bags: DataFrame, grams: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(number, norm, ids, left, idf) for ``bags`` (number, keys, ids, tf).

    ``ids`` and ``left`` are the prefix of the unit vector, rare grams first, with the norm left from each entry on; ``norm``
    is what its weights were divided by, and ``idf`` belongs to all its grams in the order of their numbers.  Grams the
    history never saw drop out, and so do texts without others.
    """
    entries = bags.select("number", *keys, F.explode(F.arrays_zip("ids", "tf")).alias("e")).select("number", *keys, F.col("e.ids").alias("id"), F.col("e.tf").alias("tf"))
    weighed = entries.join(grams.select(*keys, "id", "df", "idf"), [*keys, "id"]).groupBy("number").agg(
        F.collect_list(F.struct("df", "id", (F.col("tf") * F.col("idf")).alias("w"), "idf")).alias("vec"))  # as long as the text has distinct grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            ends, entry = vec.offsets.to_numpy().astype(np.int64), vec.values
            lo = int(ends[0])
            df, id_, w, idf = (entry.field(k).to_numpy()[lo : ends[-1]] for k in range(4))
            size, starts = np.diff(ends), ends[:-1] - lo
            row = np.repeat(np.arange(len(size)), size)
            named = np.lexsort((id_, row))
            order = np.lexsort((id_, df, row))
            w = w[order]
            norm = np.sqrt(np.add.reduceat(w * w, starts))
            w = w / norm[row]
            # Sums from each entry to its text's end, text by text, so that long batches lose no digits.
            left = np.concatenate([np.sqrt(np.cumsum(x[::-1])[::-1]) for x in np.split(w * w, starts[1:])])
            first = left >= threshold - _SLACK  # ``left`` falls along the vector
            prefix = _lists(np.bincount(row[first], minlength=len(size)), pa.array(id_[order][first]), pa.array(left[first]))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(norm), *prefix, *_lists(size, pa.array(idf[named]))], names=["number", "norm", "ids", "left", "idf"])

    return weighed.mapInArrow(run, "number bigint, norm double, ids array<bigint>, left array<double>, idf array<double>")


def _bags(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ct, mult, rec, ids, tf) of each distinct text."""
    return _bagged(distinct_history(history, keys))


def _counted(bags: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, id, df) and (keys, n) counted from texts and their multiplicity."""
    df = bags.select(*keys, "mult", F.explode("ids").alias("id")).groupBy(*keys, "id").agg(F.sum("mult").alias("df"))
    return df, bags.groupBy(*keys).agg(F.sum("mult").alias("n"))


def _indexed(bags: DataFrame, df: DataFrame, n: DataFrame, keys: list[str], threshold: float) -> HistoryIndex:
    # One row of n for each key value: the size check of the session decides how it travels.
    grams = df.join(n, keys).select(*keys, "id", "df", "n", (F.log(F.col("n") / F.col("df")) + 1.0).alias("idf"))
    grams = materialize(grams, "grams")
    # Written once, so the numbers stay.
    numbered = materialize(bags.select(*keys, "ct", "mult", "rec", "ids", "tf", F.monotonically_increasing_id().alias("number")), "bags")
    vectors = _weighted(numbered, grams, keys, threshold).withColumnRenamed("number", "tid")
    texts = materialize(numbered.select(*keys, "ct", "rec", F.col("number").alias("tid")).hint("merge").join(vectors, "tid"), "history")
    lists = _postings(texts, keys, F.lit(threshold)).groupBy("slot").agg(F.count(F.lit(1)).alias("learned"), F.max("at_left").alias("reach"))
    return HistoryIndex(numbered, grams, texts, materialize(lists, "lists"), tuple(keys), threshold)


def index_history(
    history: DataFrame, threshold: float = SIMILARITY_THRESHOLD, keys: list[str] | None = None
) -> HistoryIndex:
    """history (keys, hid, description, code, name, confirmed).  Rows with a null key match nothing."""
    keys = keys or ["direction"]
    bags = materialize(_bags(history, keys), "counted")
    return _indexed(bags, *_counted(bags, keys), keys, threshold)


def extend_index(index: HistoryIndex, learned: DataFrame) -> HistoryIndex:
    """The index with ``learned`` rows added, as if the history had held them from the start.

    Only the new rows are cleaned, cut into grams and counted; frequencies are added up.  Known texts are weighed again
    from their stored counts, since every weight hangs on the frequencies.
    """
    keys = list(index.keys)
    fresh = materialize(_bags(learned, keys), "counted")
    latest = F.struct(F.col("rec.confirmed"), -F.col("rec.hid"))
    both = index.bags.drop("number").unionByName(fresh).groupBy(*keys, "ct").agg(
        F.sum("mult").alias("mult"), F.max_by("rec", latest).alias("rec"), F.first("ids").alias("ids"), F.first("tf").alias("tf"))
    df, n = _counted(fresh, keys)
    df = index.grams.select(*keys, "id", "df").unionByName(df).groupBy(*keys, "id").agg(F.sum("df").alias("df"))
    n = index.bags.groupBy(*keys).agg(F.sum("mult").alias("n")).unionByName(n).groupBy(*keys).agg(F.sum("n").alias("n"))
    return _indexed(both, df, n, keys, index.threshold)


_PARTS = ("bags", "grams", "texts", "lists")


def save_index(index: HistoryIndex, path: str) -> None:
    """Write the index below ``path``, for ``load_index``."""
    for part in _PARTS:
        getattr(index, part).write.mode("overwrite").parquet(os.path.join(path, part))
    spark = index.bags.sparkSession
    spark.createDataFrame([(list(index.keys), index.threshold)], "keys array<string>, threshold double").coalesce(1).write.mode("overwrite").json(os.path.join(path, "about"))


def load_index(spark: SparkSession, path: str) -> HistoryIndex:
    about = spark.read.schema("keys array<string>, threshold double").json(os.path.join(path, "about")).first()
    return HistoryIndex(*(spark.read.parquet(os.path.join(path, part)) for part in _PARTS), tuple(about["keys"]), about["threshold"])


def _postings(vectors: DataFrame, keys: list[str], bound: Column) -> DataFrame:
    """One row for each entry of a prefix: ``slot`` names the list, ``place`` the entry and ``at_left`` the norm left."""
    size = F.size(F.filter("left", lambda x: x >= bound - _SLACK))  # ``left`` falls along the vector
    entry = F.posexplode(F.slice("ids", 1, size)).alias("place", "__id")
    named = [F.col(k).cast("string") for k in keys]
    known = vectors.dropna(subset=keys)
    return known.select("*", entry).withColumn("slot", F.concat_ws("\u0001", *named, F.col("__id").cast("string"))).withColumn(
        "at_left", F.get("left", F.col("place"))).drop("__id")


def _spots(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the entries of rows that begin at ``start``, row after row."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _sums(size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of each row's values up to each of them; row by row, so that many rows lose no digits."""
    out, start = values.copy(), np.cumsum(size) - size
    for k in range(1, size.max(initial=0)):
        at = start[size > k] + k
        out[at] += out[at - 1]
    return out


class _Block:
    """Learned texts of one block of a list as a matrix of their heaviest grams; the last column is the norm of the rest.

    So one product of matrices bounds all pairs of a block from above, and gives their cosine itself, to the digits of a
    single, where the block has no more than ``DENSE`` grams.  Texts come in order of preference among equal scores.

    ``shared`` is the gram of the list and ``idf`` that of all entries; with them a long block is cut again, by the next gram
    a pair shares.  ``low`` is the least bound of any query.
    """

    def __init__(self, tid: np.ndarray, left: np.ndarray, size: np.ndarray, ids: np.ndarray, w: np.ndarray,
                 idf: np.ndarray | None = None, shared: int | None = None, low: float = 0.0):
        order = np.argsort(-left, kind="stable")  # those that a query can reach come first
        spot = _spots((np.cumsum(size) - size)[order], size[order])
        self.rank, self.tid, self.left, self.size, self.w = order, tid[order], left[order], size[order], w[spot]
        self.start = np.cumsum(self.size) - self.size
        self.vocabulary, self.loc = np.unique(ids[spot], return_inverse=True)
        self.width = min(len(self.vocabulary), DENSE, max(CELLS // len(tid), 1))
        heavy = np.argsort(-np.bincount(self.loc, self.w**2), kind="stable")[: self.width]
        self.column = np.full(len(self.vocabulary), self.width)
        self.column[heavy] = np.arange(self.width)
        self.matrix = self._matrix(self.size, self.loc, self.w)
        self.shared, self.low, self.cells = shared, low, None
        if idf is not None:
            self.idf = np.zeros(len(self.vocabulary))
            self.idf[self.loc] = idf[spot]
            self.turn = np.empty(len(self.vocabulary), dtype=np.int64)  # rare grams first, as in the prefixes
            self.turn[np.lexsort((self.vocabulary, -self.idf))] = np.arange(len(self.vocabulary))

    def weights(self, size: np.ndarray, ids: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The weights of queries' grams; what the block never saw has none."""
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == ids, tf * self.idf[at] / np.repeat(norm, size), 0.0)

    def _matrix(self, size: np.ndarray, loc: np.ndarray, w: np.ndarray) -> np.ndarray:
        row, column = np.repeat(np.arange(len(size)), size), self.column[loc]
        out = np.zeros((len(size), self.width + 1), dtype=np.float32)
        known = column < self.width
        out[row[known], column[known]] = w[known]
        out[:, self.width] = np.sqrt(np.bincount(row[~known], w[~known] ** 2, len(size)))
        return out

    def _next(self, size: np.ndarray, loc: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, gram, norm): each gram after the shared one, with the norm of that one and of all from the gram on.

        If two texts share no gram between, their cosine is not above the product of these norms.  The gram one beyond the
        vocabulary stands for sharing nothing more.
        """
        row, turn, at = np.repeat(np.arange(len(size)), size), self.turn[loc], self.turn[np.searchsorted(self.vocabulary, self.shared)]
        own = np.bincount(row[turn == at], w[turn == at], len(size))
        by = np.lexsort((-turn, row))
        by = by[turn[by] > at]
        norm = np.sqrt(own[row[by]] ** 2 + _sums(np.bincount(row[by], minlength=len(size)), w[by] ** 2))
        last = np.full(len(size), len(self.vocabulary))
        return np.concatenate((row[by], np.arange(len(size)))), np.concatenate((loc[by], last)), np.concatenate((norm, own))

    def _meetings(self, left: np.ndarray, bound: np.ndarray, size: np.ndarray, loc: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(queries, how many texts each of them can reach, those texts in order or None for the block's own order)."""
        able = np.searchsorted(-self.left, -(bound - _SLACK) / left, side="right")
        many = np.flatnonzero(able > SPLIT) if self.shared is not None else np.zeros(0, np.int64)
        if able[many].sum() <= WORTH * len(self.vocabulary):
            many = many[:0]
        few = able > 0
        few[many] = False
        yield np.flatnonzero(few), able[few], None
        if not len(many):
            return
        if self.cells is None:
            text, gram, norm = self._next(self.size, self.loc, self.w)
            some = np.flatnonzero(norm >= self.low - _SLACK)
            some = some[np.lexsort((-norm[some], gram[some]))]
            self.cells = text[some], norm[some], np.searchsorted(gram[some], np.arange(len(self.vocabulary) + 2))
        texts, norms, edges = self.cells
        spot = _spots((np.cumsum(size) - size)[many], size[many])
        query, gram, norm = self._next(size[many], loc[spot], w[spot])
        query = many[query]
        some = np.flatnonzero(norm >= bound[query] - _SLACK)
        some = some[np.argsort(gram[some], kind="stable")]
        for each in np.split(some, np.flatnonzero(np.diff(gram[some])) + 1):
            if len(each):
                here = slice(*edges[gram[each[0]] : gram[each[0]] + 2])
                reach = np.searchsorted(-norms[here], -(bound[query[each]] - _SLACK) / norm[each], side="right")
                yield query[each][reach > 0], reach[reach > 0], texts[here]

    def _score(self, start: np.ndarray, size: np.ndarray, loc: np.ndarray, w: np.ndarray, q: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Cosine of the pairs (q, h) in double precision, some pairs at a time."""
        out, wide = [np.zeros(0)], len(self.vocabulary)
        for i in range(0, len(q), SCORED):
            asked, met = q[i : i + SCORED], h[i : i + SCORED]
            some, place = np.unique(asked, return_inverse=True)
            at = _spots(start[some], size[some])
            key = np.repeat(np.arange(len(some)) * wide, size[some]) + loc[at]  # rises: grams of a text are put in order before
            mine = _spots(self.start[met], self.size[met])
            want = np.repeat(place * wide, self.size[met]) + self.loc[mine]
            found = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            first = np.cumsum(self.size[met]) - self.size[met]
            both = np.where(key[found] == want, w[at][found], 0.0) * self.w[mine]
            out.append(np.add.reduceat(both, first))
        return np.concatenate(out)

    def best(self, left: np.ndarray, bound: np.ndarray, size: np.ndarray, ids: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, text or -1, score, pairs scored) as arrays: for each query the best text that reaches its bound."""
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == ids
        owner = np.repeat(np.arange(len(size)), size)[known]
        order = np.lexsort((at[known], owner))
        loc, w = at[known][order], w[known][order]
        size = np.bincount(owner, minlength=len(size))
        start = np.cumsum(size) - size
        asked, low, pairs = self._matrix(size, loc, w), bound.copy(), []
        # Sums in single precision err by less than one unit for each gram.
        slack = _SLACK + 2.0**-23 * (8 + size.max(initial=0))

        def score(q: np.ndarray, h: np.ndarray) -> None:
            found = self._score(start, size, loc, w, q, h)
            np.maximum.at(low, q, np.round(found, 12))
            pairs.append((q, h, found))

        for some, reach, texts in self._meetings(left, bound, size, loc, w):
            by = np.argsort(-reach, kind="stable")
            some, reach = some[by], reach[by]
            for j in range(0, reach.max(initial=0), WIDE):
                part = self.matrix[j : j + WIDE] if texts is None else self.matrix[texts[j : min(j + WIDE, reach[0])]]
                for i in range(0, np.searchsorted(-reach, -j), CHUNK):
                    q = some[i : i + CHUNK][reach[i : i + CHUNK] > j]
                    most = asked[q] @ part[: reach[i] - j].T
                    # The most promising text of each query first; it raises the bound of the others.
                    lead = most.argmax(axis=1)
                    likely = np.flatnonzero(most[np.arange(len(q)), lead] >= low[q] - slack)
                    if not len(likely):
                        continue
                    q, lead, most = q[likely], lead[likely], most[likely]
                    place = lambda h: h + j if texts is None else texts[h + j]  # noqa: E731, B023
                    score(q, place(lead))
                    most[np.arange(len(q)), lead] = -1.0
                    row, h = np.nonzero(most >= (low[q] - slack).astype(np.float32)[:, None])
                    score(q[row], place(h))
        if not pairs:
            return
        q, h, found = (np.concatenate(x) for x in zip(*pairs, strict=True))
        near = np.round(found, 12)
        by = np.lexsort((self.rank[h], -near, q))  # of equal scores the preferred one
        one = by[np.flatnonzero(np.concatenate(([True], q[by][1:] != q[by][:-1])))]
        hit = near[one] >= bound[q[one]]
        yield q[one], np.where(hit, self.tid[h[one]], -1), np.where(hit, found[one], 0.0), np.bincount(q, minlength=len(size))[q[one]]


_HITS = "qid bigint, tid bigint, score double, scored bigint"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (slot, block, part), learned texts first: the best hit of each query in each block."""
    key, parts, block = None, [], None
    for batch in batches:
        col = {c: batch.column(c) for c in batch.schema.names}
        asked, number = col["asked"].to_numpy(zero_copy_only=False), col["number"].to_numpy()
        left, bound, norm = (col[c].to_numpy() for c in ("at_left", "bound", "norm"))
        count, ids, tf = _cut(col["ct"])
        ends = np.concatenate(([0], np.cumsum(count)))
        given, idf = col["idf"].offsets.to_numpy().astype(np.int64), col["idf"].values.to_numpy()  # of learned texts
        new = asked[1:] != asked[:-1]
        for c in ("slot", "block", "part"):
            new |= pc.not_equal(col[c][1:], col[c][:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1), len(number)]
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            name = tuple(col[c][int(lo)].as_py() for c in ("slot", "block", "part"))
            if name != key:
                key, parts, block = name, [], None
            if not asked[lo]:
                size, weight, some = count[lo:hi], idf[given[lo] : given[hi]].copy(), slice(ends[lo], ends[hi])
                parts.append((number[lo:hi].copy(), left[lo:hi].copy(), size, ids[some], tf[some] * weight / np.repeat(norm[lo:hi], size), weight))
                low = float(bound[lo])
                continue
            if block is None and parts:
                block, parts = _Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), int(key[0].rsplit("\u0001", 1)[-1]), low), []
            if block is not None:
                for at in range(lo, hi, UNPACKED):
                    to = min(at + UNPACKED, hi)
                    some = slice(ends[at], ends[to])
                    mine = count[at:to], ids[some]
                    hits += [(number[at + q], *hit) for q, *hit in block.best(left[at:to], bound[at:to], *mine, block.weights(*mine, tf[some], norm[at:to]))]
        qid, tid, score, scored = (np.concatenate(x) for x in zip(*hits, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(tid, mask=tid < 0), pa.array(score), pa.array(scored)], names=["qid", "tid", "score", "scored"])


def _visited(probes: DataFrame, index: HistoryIndex) -> DataFrame:
    """Hits of ``probes`` (slot, qid, place, at_left, bound, norm, ct) in their lists.

    A long list is cut into blocks that its queries all visit; many queries of one list are dealt over parts, each of
    which gets the block again.  So a gram that very many texts share neither waits in one task nor fills it.
    """
    keys = list(index.keys)
    wanted = probes.groupBy("slot").agg(F.count(F.lit(1)).alias("queries"), F.max(F.col("at_left") / F.col("bound")).alias("strength")).join(index.lists, "slot")
    # A few numbers for each gram that is asked for; stored, so that its size decides how it travels.
    wanted = wanted.where(F.col("strength") * F.col("reach") >= 1 - _SLACK).select(
        "slot", "reach", "strength", F.ceil(F.col("learned") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("queries") / ASKED).cast("int").alias("parts"))
    wanted = materialize(wanted, "wanted")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    entry = ["at_left", "bound", "norm", "ct"]
    asked = probes.join(wanted, "slot").where(F.col("at_left") * F.col("reach") >= F.col("bound") - _SLACK).select(
        "slot", every("blocks").alias("block"), own("qid", "parts").alias("part"), F.lit(True).alias("asked"), F.col("qid").alias("number"), *entry,
        # Empty and not null: for each row sent, Arrow's writer goes over all null lists that came right before it.
        F.array().cast("array<double>").alias("idf"), F.lit(None).cast(index.texts.schema["rec"].dataType).alias("rec"))
    learned = _postings(index.texts, keys, F.lit(index.threshold)).join(wanted, "slot").where(F.col("at_left") * F.col("strength") >= 1 - _SLACK).select(
        "slot", own("tid", "blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("asked"), F.col("tid").alias("number"),
        "at_left", F.lit(index.threshold).alias("bound"), "norm", "ct", "idf", F.struct("rec.confirmed", "rec.hid").alias("rec"))
    asked = asked.withColumn("rec", F.struct("rec.confirmed", "rec.hid"))
    rows = asked.unionByName(learned).repartition("slot", "block", "part").sortWithinPartitions(
        "slot", "block", "part", "asked", F.col("rec.confirmed").desc_nulls_last(), "rec.hid")
    return rows.select("slot", "block", "part", "asked", "number", *entry, "idf").mapInArrow(_meet, _HITS)


def _asked(queries: DataFrame, index: HistoryIndex) -> DataFrame:
    """Distinct cleaned query texts as numbered vectors, written once."""
    keys = list(index.keys)
    texts = queries.select(*keys, matching_text(F.col("description")).alias("ct")).distinct()
    bags = materialize(_bagged(texts).withColumn("number", F.monotonically_increasing_id()), "asked-texts")
    vectors = _weighted(bags, index.grams, keys, index.threshold).drop("idf").withColumnRenamed("number", "qid")
    return materialize(bags.select(*keys, "ct", F.col("number").alias("qid")).hint("merge").join(vectors, "qid"), "asked")


def _answers(asked: DataFrame, hits: DataFrame, index: HistoryIndex) -> DataFrame:
    keys = list(index.keys)
    # Texts are many, however small some columns of their files are: none goes through the driver.
    found = hits.where("tid IS NOT NULL").join(index.texts.select("tid", "rec").hint("merge"), "tid")
    order = F.struct(F.round("score", 12), F.col("rec.confirmed"), -F.col("rec.hid"))
    best = found.groupBy("qid").agg(F.max_by(F.struct("rec", "score"), order).alias("b"))
    return asked.select("qid", *keys, "ct").hint("merge").join(best, "qid").select(
        *keys, "ct", F.col("b.rec.hid").alias("hid"), F.col("b.rec.code").alias("code"),
        F.col("b.rec.name").alias("name"), F.col("b.score").alias("score"),
    )


def _single_pass(asked: DataFrame, index: HistoryIndex) -> DataFrame:
    bound = F.lit(index.threshold)
    return _visited(_postings(asked, list(index.keys), bound).withColumn("bound", bound), index)


def _rising(asked: DataFrame, index: HistoryIndex) -> DataFrame:
    """The rarest list of each query first; then those others that can hold a better text than was found there."""
    keys, low = list(index.keys), F.lit(index.threshold)
    first = _postings(asked, keys, low).where("place = 0").withColumn("bound", low)
    seeds = materialize(_visited(first, index), "seeds")
    raised = asked.join(seeds.where("tid IS NOT NULL").groupBy("qid").agg(F.round(F.max("score"), 12).alias("bound")), "qid", "left")
    raised = raised.withColumn("bound", F.greatest(F.coalesce("bound", low), low))
    rest = _postings(raised, keys, F.col("bound")).where("place > 0")
    return seeds.unionByName(_visited(rest, index))


def similar_history(queries: DataFrame, index: HistoryIndex) -> DataFrame:
    """Best history record for each distinct cleaned query text, if it reaches the threshold.

    queries (keys, description).  Returns (keys, ct, hid, code, name, score).  Ties go to the
    most recently confirmed record, then the lowest id.  One pass over all lists of a query's prefix.
    """
    asked = _asked(queries, index)
    return _answers(asked, _single_pass(asked, index), index)


def top1_history(queries: DataFrame, index: HistoryIndex) -> DataFrame:
    """As ``similar_history``, in two passes: fewer lists and fewer pairs, one more shuffle of the queries."""
    asked = _asked(queries, index)
    return _answers(asked, _rising(asked, index), index)


def scored_pairs(queries: DataFrame, index: HistoryIndex, rising: bool) -> int:
    """How many pairs the search scores in full."""
    asked = _asked(queries, index)
    return (_rising if rising else _single_pass)(asked, index).agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]


#: Adds a match struct column, null where it has no answer.
Tier = Callable[[DataFrame, str], DataFrame]


def rule_tier(rules) -> Tier:
    """The first matching rule."""
    from .classify import apply_rules

    return lambda rows, out: apply_rules(rows, rules, out)


def history_tier(history: DataFrame | HistoryIndex, threshold: float = SIMILARITY_THRESHOLD) -> Tier:
    """The nearest learned text that reaches the threshold."""
    def tier(rows: DataFrame, out: str) -> DataFrame:
        index = history if isinstance(history, HistoryIndex) else index_history(history, threshold)
        found = top1_history(rows, index).select(
            "direction", "ct",
            F.struct(
                F.col("code").alias("subject_code"), F.coalesce("name", F.lit("")).alias("subject_name"),
                F.lit("history").alias("source"), F.lit("").alias("rule_id"),
            ).alias(out),
        )
        return rows.withColumn("ct", matching_text(F.col("description"))).join(found, ["direction", "ct"], "left").drop("ct")

    return tier


def classify(
    txns: DataFrame,
    rules=None,
    history: DataFrame | HistoryIndex | None = None,
    subjects: DataFrame | None = None,
    threshold: float = SIMILARITY_THRESHOLD,
    out: str = "match",
    tiers: Sequence[Tier] | None = None,
) -> DataFrame:
    """Rule, then history, then unmatched.  A tier is asked for the rows that no earlier one took.

    ``tiers`` are other tiers than these, in order.  Taken and open rows go different ways, so a tier's expressions run
    once for each; a tier that is costly stores what it finds, as the history tier does with the distinct open texts.
    """
    from .classify import with_aux

    if tiers is None:
        tiers = [rule_tier(rules), *([history_tier(history, threshold)] if history is not None else [])]
    nothing = F.struct(
        F.lit("").alias("subject_code"), F.lit("").alias("subject_name"),
        F.lit("unmatched").alias("source"), F.lit("").alias("rule_id"),
    )
    open_, parts = txns, []
    for i, tier in enumerate(tiers):
        asked = tier(open_, out)
        if i < len(tiers) - 1:
            parts.append(asked.where(F.col(out).isNotNull()))
            open_ = asked.where(F.col(out).isNull()).drop(out)
        else:
            parts.append(asked.withColumn(out, F.coalesce(F.col(out), nothing)))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    flat = done.select(*txns.columns, f"{out}.*")
    if subjects is None:
        return flat.withColumns({"aux_category": F.lit(""), "aux_category_name": F.lit("")})
    return with_aux(flat, subjects)

"""Language identification by rank-order profiles.

A profile is the ``size`` most frequent character n-grams (one to three) of a language, words padded with a space on both
sides. A document's own most frequent n-grams are compared to each profile by out-of-place distance: the difference of
ranks, or ``size`` for an n-gram that the profile lacks. The language of least distance wins; ties go to the name that
sorts first. The score is one minus the distance as a share of the largest possible one.

Profiles are learnt from at most ``max_docs`` documents a language, those of the smallest hashes, each of at most
``max_chars`` characters; documents are read whole when they are classified. Characters are lower-cased; all but letters
end a word.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learnt. Rows with a
null language teach nothing. Repeated rows are classified alike. Other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, small_batches, texts

ORDERS = (1, 2, 3)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of the words of a text, with repeats; empty without a letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not points.any():
        return np.empty(0, dtype=np.uint64)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    inside = (points > 0) | np.append(points[1:] > 0, False) | np.append(False, points[:-1] > 0)
    points = points[inside]
    # two paddings in a row end one word and begin the next; n-grams lie on one side of that
    pad = points == 0
    out = [points[~pad]]
    two = (points[:-1] << np.uint64(21)) | points[1:]
    out.append(two[~(pad[:-1] & pad[1:])] | np.uint64(1 << 62))
    if len(points) > 2:
        three = (two[:-1] << np.uint64(21)) | points[2:]
        out.append(three[~pad[1:-1]] | np.uint64(1 << 63))
    return np.concatenate(out)


def most_frequent(codes: np.ndarray, size: int) -> np.ndarray:
    """The codes that occur most often, ties in code order."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(first, len(codes)))
    if len(first) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = np.flatnonzero(counts >= least)
        first, counts = first[some], counts[some]
    return codes[first[np.argsort(-counts, kind="stable")[:size]]]


class Profiles:
    def __init__(self, by_language: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(by_language), size
        self.codes = np.unique(np.concatenate([by_language[n] for n in self.names])) if self.names else np.empty(0, np.uint64)
        self.rank = np.full((len(self.codes), len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, by_language[name]), k] = np.arange(len(by_language[name]))

    def predict(self, text: str) -> tuple[str, float]:
        codes = grams(text) if self.names else np.empty(0)
        if not len(codes):
            return UNKNOWN, 0.0
        top = most_frequent(codes, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = np.where((self.codes[at] == top)[:, None], self.rank[at], -1)
        off = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.names[best], float(1 - off[best] / (self.size * len(top)))


def fit_texts(texts: list[str], names: list[str], size: int = 400) -> Profiles:
    codes: dict[str, dict[int, int]] = {}
    for text, name in zip(texts, names, strict=True):
        some, counts = np.unique(grams(text), return_counts=True)
        own = codes.setdefault(name, {})
        for c, n in zip(some.tolist(), counts.tolist(), strict=True):
            own[c] = own.get(c, 0) + n
    ranked = {n: sorted(c, key=lambda x: (-c[x], x))[:size] for n, c in codes.items() if c}
    return Profiles({n: np.array(x, dtype=np.uint64) for n, x in ranked.items()}, size)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 300,
    max_chars: int = 20_000,
    max_languages: int = 1000,
    size: int = 400,
) -> Profiles:
    """Learn from a bounded sample; the caller has taken out documents that must not be learnt from.

    Of more than ``max_languages`` languages the most frequent are learnt. A cut-off on hashes, from the number of
    distinct texts of each language that may be learnt from, leaves about twice ``max_docs`` documents a language before
    any text is moved. A language without texts of at most ``max_chars`` learns from the beginnings of its long ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frame = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    frame = frame.where("lang is not null and text is not null")
    h, short = F.xxhash64("text", "lang"), F.length("text") <= max_chars
    counts = frame.groupBy("lang").agg(
        F.count("*").alias("count"), F.approx_count_distinct(F.when(short, h)).alias("n_short"), F.approx_count_distinct(h).alias("n")
    )
    counts = counts.orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    share = [(r["lang"], 2.0 * max_docs / (r["n_short"] or r["n"]), r["n_short"] > 0) for r in counts]
    share = spark.createDataFrame(share, "lang string, share double, has_short boolean")
    near = frame.withColumn("h", h).join(F.broadcast(share), "lang").where(short | ~F.col("has_short"))
    near = near.withColumn("text", F.substring("text", 1, max_chars))
    near = near.where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share")).dropDuplicates(["h", "lang"])
    first = Window.partitionBy("lang").orderBy("h")
    kept = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max_docs)
    got = kept.select("text", "lang").toArrow()
    return fit_texts(got["text"].to_pylist(), got["lang"].to_pylist(), size)


def classify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(it):
        for batch in batches(it):
            found = [profiles.predict(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

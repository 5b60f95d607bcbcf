"""Toxicity scores: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, and each run of ASCII characters that are neither letters nor digits becomes one space, so marks
between words don't hide where a word begins. Features are hashed n-grams of the characters of the whole text, valued
log2(1 + count). Each is multiplied by the log ratio of its smoothed document counts in toxic and clean training texts;
logistic regression is fitted on top (full-batch Adam with an L2 penalty). The classifier is fitted on the driver from at
most ``max_rows`` labelled texts of at most ``max_chars`` characters each and ``max_total`` together, those of the smallest
hashes, so the sample is bounded and the same every time. Scoring covers whole texts of any length, long ones in blocks.

Null and empty texts have no features and get the intercept's score. Repeated rows are scored alike. Without labels of
both kinds every score is 0. Labels that are null are ignored; an id labelled twice counts as toxic if any label says so;
an id that occurs with several texts teaches the one of the smallest hash. Ties of hashes go to the smaller id. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, keep_rows, lowest_hashes, raw_texts, small_batches, spread, stored, two

BITS = 20
ORDERS = (3, 4, 5)
BLOCK = 1 << 18
_PLAIN = np.array([c if chr(c).isalnum() else 32 for c in range(128)], dtype=np.uint32)


def plain(text: bytes) -> np.ndarray:
    """Code points of the lower-cased text with one space for each run of other ASCII characters, and one at both ends."""
    low = f" {text.decode('utf-8', 'replace').lower()} "
    c = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where(c < 128, _PLAIN[np.minimum(c, 127)], c)
    return c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]


def _hashed(c: np.ndarray, first: int) -> np.ndarray:
    """Buckets of the n-grams that begin in the block at ``first``."""
    part, out = c[first : first + BLOCK + max(ORDERS) - 1], []
    h = np.zeros(len(part), dtype=np.uint32)
    for n in range(1, min(max(ORDERS), len(part)) + 1):
        h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
        if n in ORDERS:
            x = h[:BLOCK]
            out.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hash buckets of the n-grams of a text, and log2(1 + count) of each."""
    b = plain(text)
    if len(b) <= BLOCK:
        found, n = np.unique(_hashed(b, 0), return_counts=True)
    else:
        counts = np.zeros(1 << BITS, np.int64)
        for first in range(0, len(b), BLOCK):
            counts += np.bincount(_hashed(b, first), minlength=1 << BITS)
        found = np.flatnonzero(counts)
        n = counts[found]
    return found.astype(np.int32), np.log2(1 + n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        if not np.isfinite(self.bias):
            return 0.0
        found, value = features(text)
        z = float((self.weights[found] * value).sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit_texts(texts: list[bytes], labels: list[int], l2: float = 1e-4, steps: int = 120, min_docs: int = 3, errors: float = 3.0) -> Model:
    y = np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS, np.float32), -np.inf)
    pos, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for text, toxic in zip(texts, labels, strict=True):
        found = features(text)[0]
        every[found] += 1
        pos[found] += toxic
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((every - pos + 1) / (len(y) - y.sum() + 2))
    # a ratio within the noise of its counts says nothing: shrink it by a multiple of its standard error
    error = np.sqrt(1 / (pos + 1) + 1 / (every - pos + 1))
    ratio = np.where(every >= min_docs, np.sign(ratio) * np.maximum(0, np.abs(ratio) - errors * error), 0.0)
    used = np.flatnonzero(ratio)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # only features that matter are held, so the second pass makes them again instead of keeping all
    columns, values = [], []
    for text in texts:
        found, value = features(text)
        here = place[found] >= 0
        columns.append(place[found[here]])
        values.append((value[here] * ratio[found[here]]).astype(np.float32))
    owner = np.repeat(np.arange(len(y), dtype=np.int32), [len(row) for row in columns])
    # blocks of whole rows keep the working arrays of a step small
    cuts = np.cumsum([0, *map(len, columns)])[::500].tolist()
    column, value = np.concatenate(columns), np.concatenate(values)
    cuts = [*cuts, len(column)] if cuts[-1] < len(column) else cuts
    blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    del columns, values
    w, b = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z, g = np.full(len(y), b), l2 * w
        for s in blocks:
            z += np.bincount(owner[s], weights=w[column[s]] * value[s], minlength=len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        for s in blocks:
            g += np.bincount(column[s], weights=r[owner[s]] * value[s], minlength=len(used))
        gb = r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(b))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 10_000,
    max_chars: int = 30_000,
    max_total: int = 48 << 20,
) -> Model:
    """Fit on a bounded sample of the labelled texts; the caller has taken out rows that must not be learnt from."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    marked = marked.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    frame = two(docs, id_col, text_col).where(F.length("text") <= max_chars)
    # only labels of texts that are there take places of the sample; ids and sizes first, texts of the chosen rows after
    light = frame.select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).alias("of"))
    there = light.join(marked, F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("of").alias("of"))
    there = stored(there.select("doc_id", "y", "of.h", "of.size"), "labelled")
    chosen = lowest_hashes(there, F.col("doc_id"), max_rows)
    total = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = chosen.withColumn("total", F.sum("size").over(total)).where(F.col("total") <= max_total)
    chosen = F.broadcast(stored(chosen.select(F.col("doc_id").alias("id"), "y", "h"), "sample"))  # at most max_rows rows
    rows = frame.join(chosen, (frame["doc_id"] == chosen["id"]) & (F.xxhash64("text") == chosen["h"])).select("doc_id", "text", "y")
    got = rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toArrow()
    return fit_texts(got["text"].cast(pa.binary()).to_pylist(), [int(x > 0) for x in got["y"].to_pylist()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    small_batches(docs.sparkSession)
    frame = two(docs, id_col, text_col)

    def run(it):
        for batch in batches(it):
            s = [model.score(t) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return spread(frame).mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of a score below the threshold, with all their columns."""
    return keep_rows(docs, text_col, lambda texts: [model.score(t) < threshold for t in texts])

"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``size`` consecutive item words is a set of word shingles. All of them must occur in a document that
holds the window, so a necessary prefix of the set, ordered by rarity in the corpus, is its one rarest shingle. Documents
are probed for prefix shingles alone; the offset of the shingle in its window and the document's length bound where a
window may lie; what is left is compared word by word over the item-sized window.

Rarity is the number of documents with a shingle, counted over all documents in a first pass (partial counts per
partition, so the shuffle carries at most one row per shingle and partition). Items are taken in blocks of about
``block_bytes`` of text. A block's index is arrays over its words (a window is a place in them, its prefix one code), some
50 bytes a word, so what is broadcast has a fixed bound however large the benchmark grows; each further block is another
pass that carries the spans found so far. Only a single item larger than a block makes a larger one.

Null or empty texts have no words and no hits. Items without words are ignored; items of equal text all count.
Items of null id have windows and hits like others and are only absent from the list of items. Repeated
documents each keep their row. Other columns are not read. Empty tables give empty or hit-free results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, keep_rows, raw_texts, small_batches, stored, two

SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPAN = "array<struct<start:long,end:long>>"
OUT = f"doc_id {{id}}, text string, n_words long, n_hit long, items array<string>, spans {SPAN}"


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, ASCII digits and non-ASCII characters."""
    return text.translate(SEPARATORS).split()


class Windows:
    """Distinct windows of a block of items as places in one array of word ids, and which rarest shingles to probe for."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int, shingle: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            owners.setdefault(text, set()).update(() if item is None else (item,))
        self.vocab: dict[bytes, int] = {}
        self.size, self.names = size, [sorted(x) for x in owners.values()]
        flat, starts, lengths, owner = [], [], [], []
        at = 0
        for k, text in enumerate(owners):
            ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)), np.int32)
            n = max(1, len(ids) - size + 1) if len(ids) else 0
            flat += [ids, np.zeros(size, np.int32)]
            starts.append(np.arange(at, at + n, dtype=np.int64))
            lengths.append(np.full(n, min(size, len(ids)), dtype=np.int64))
            owner.append(np.full(n, k, dtype=np.int64))
            at += len(ids) + size
        self.flat = np.concatenate([*flat, np.zeros(size, np.int32)])
        start, length, owner = (np.concatenate([np.empty(0, np.int64), *x]) for x in (starts, lengths, owner))
        # equal windows become one, with all the items that hold it
        cells = np.where(np.arange(size) < length[:, None], self.flat[start[:, None] + np.arange(size)], 0)
        _, first, same = np.unique(np.ascontiguousarray(cells).view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        pairs = np.unique(np.stack((same.ravel(), owner), axis=1), axis=0)
        self.owner, self.owner_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.step = np.minimum(shingle, self.length)  # words of a window's shingles
        self.shingles = np.unique(self.step).tolist()
        self.codes = np.unique(np.concatenate([np.empty(0, np.uint64), *[c for _, _, c in self._codes()]]))

    def _codes(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Windows that have a shingle at an offset, the offset, and the shingles' codes."""
        for s in self.shingles:
            for offset in range(self.size - s + 1):
                some = np.flatnonzero((self.step == s) & (offset + s <= self.length))
                if len(some):
                    yield some, offset, shingle_codes(self.flat, s, self.start[some] + offset)

    def items(self, window: int) -> list[str]:
        return [i for k in self.owner[self.owner_at[window] : self.owner_at[window + 1]] for i in self.names[k]]

    def prefix(self, counts: np.ndarray) -> None:
        """Keep the rarest shingle of each window; windows with a shingle that no document has are dropped."""
        rarest = np.full(len(self.start), np.iinfo(np.int64).max)
        code, offsets = np.zeros(len(rarest), np.uint64), np.zeros(len(rarest), np.int64)
        for some, offset, codes in self._codes():
            n = counts[np.searchsorted(self.codes, codes)]
            less = n < rarest[some]
            rarest[some[less]], code[some[less]], offsets[some[less]] = n[less], codes[less], offset
        window = np.flatnonzero(rarest > 0)
        window = window[np.argsort(code[window], kind="stable")]
        self.codes, starts = np.unique(code[window], return_index=True)
        self.starts, self.window, self.offset = np.append(starts, len(window)), window, offsets[window]

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all documents with a 0 after each, and where each document starts."""
        get, flat = self.vocab.get, []
        starts = np.zeros(len(docs) + 1, dtype=np.int64)
        for k, ws in enumerate(docs):
            flat += [get(w, 0) for w in ws]
            flat.append(0)
            starts[k + 1] = len(flat)
        return np.array(flat, dtype=np.int64), starts

    def probe(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of shingles that are in ``codes``, and which they are."""
        known = ids > 0
        for s in self.shingles:
            n = len(ids) - s + 1
            if n <= 0 or not len(self.codes):
                continue
            ok = known[:n].copy()
            for k in range(1, s):
                ok &= known[k : n + k]
            pos = np.flatnonzero(ok)
            codes = shingle_codes(ids, s, pos)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[at] == codes
            yield pos[hit], at[hit]

    def occurrences(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where windows begin, and which: candidates from prefix shingles, bounded by position and length, verified."""
        size = self.size
        padded = np.append(ids, np.zeros(size, np.int64))
        for pos, at in self.probe(ids):
            n = self.starts[at + 1] - self.starts[at]
            row = np.repeat(self.starts[at] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            window, start = self.window[row], np.repeat(pos, n) - self.offset[row]
            doc = np.searchsorted(starts, np.repeat(pos, n), side="right") - 1
            fits = (start >= starts[doc]) & (start + self.length[window] <= starts[doc + 1] - 1)
            window, start = window[fits], start[fits]
            for word in range(size):  # word by word, so that most candidates are out after one or two
                same = (word >= self.length[window]) | (padded[start + word] == self.flat[self.start[window] + word])
                start, window = start[same], window[same]
            yield start, window


def shingle_codes(ids: np.ndarray, s: int, pos: np.ndarray | None = None) -> np.ndarray:
    """64-bit codes of the ``s`` words from each position; equal codes are verified word by word later."""
    pos = np.arange(len(ids) - s + 1) if pos is None else pos
    code = np.full(len(pos), s, dtype=np.uint64)
    for k in range(s):
        code = (code ^ ids[pos + k].astype(np.uint64)) * MULTIPLIER
        code ^= code >> np.uint64(29)
    return code


def _count(windows: Windows) -> Callable:
    def run(it):
        total = np.zeros(len(windows.codes), dtype=np.int64)
        for batch in batches(it):
            ids, starts = windows.ids([words(t) for t in raw_texts(batch)])
            for pos, at in windows.probe(ids):
                doc = np.searchsorted(starts, pos, side="right") - 1
                pairs = np.unique(doc * len(total) + at)
                total += np.bincount(pairs % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "docs"])

    return run


def _match(windows: Windows, doc_type: pa.DataType) -> Callable:
    def run(it):
        for batch in batches(it):
            docs = [words(t) for t in raw_texts(batch)]
            ids, starts = windows.ids(docs)
            begin, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, window in windows.occurrences(ids, starts):
                begin.append(start)
                which.append(window)
            begin, which = np.concatenate(begin), np.concatenate(which)
            items: list[set[str]] = [set(x or ()) for x in batch.column("items").to_pylist()]
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + windows.length[which], -1)
            for k, x in enumerate(batch.column("spans").to_pylist()):
                for span in x or ():
                    edge[starts[k] + span["start"]] += 1
                    edge[starts[k] + span["end"]] -= 1
            hit = np.cumsum(edge[:-1]) > 0
            n_hit = np.diff(np.append(0, np.cumsum(hit))[starts])
            spans: list[list[dict]] = [[] for _ in docs]
            turn = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True):
                k = int(np.searchsorted(starts, a, side="right") - 1)
                spans[k].append({"start": int(a - starts[k]), "end": int(b - starts[k])})
            for a, w in zip(begin, which, strict=True):
                items[int(np.searchsorted(starts, a, side="right") - 1)].update(windows.items(w))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(doc_type),
                    batch.column("text"),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "text", "n_words", "n_hit", "items", "spans"],
            )

    return run


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    shingle: int = 5,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of items with a window in the document), spans (word positions)."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    frame = two(docs, id_col, text_col)
    id_type, arrow_id = frame.schema["doc_id"].dataType.simpleString(), to_arrow_type(frame.schema["doc_id"].dataType)
    frame = frame.withColumns({"items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast(SPAN)})
    blocks = item_blocks(items, item_col, item_text_col, block_bytes)
    for k, block in enumerate(blocks):
        windows = ready(frame, block, size, shingle)
        out = frame.mapInArrow(_match(windows, arrow_id), OUT.format(id=id_type))
        if k + 1 < len(blocks):
            out = stored(out, "decontamination")
            frame = out.select("doc_id", "text", "items", "spans")
    return out.drop("text")


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """Items as blocks of about ``block_bytes`` of text."""
    wanted = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = wanted.where("text is not null").distinct()
    n = -(-(wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes) or 1
    return [wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [wanted]


def ready(docs: DataFrame, block: DataFrame, size: int, shingle: int) -> Windows:
    """The block's windows, with the rarity of their shingles counted over all documents."""
    windows = Windows([(r.item, r.text.encode()) for r in block.collect()], size, shingle)
    seen = docs.select("text").mapInArrow(_count(windows), "shingle long, docs long")
    counts = np.zeros(len(windows.codes), dtype=np.int64)
    for r in seen.groupBy("shingle").agg(F.sum("docs").alias("docs")).collect():  # one row per shingle of the block
        counts[r.shingle] = r.docs
    windows.prefix(counts)
    return windows


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    shingle: int = 5,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """Rows that hold no window of any item, with all their columns."""
    every = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        windows = ready(every, block, size, shingle)
        docs = keep_rows(docs, text_col, lambda texts, w=windows: _free_of(w, texts))
    return docs


def _free_of(windows: Windows, texts: list[bytes]) -> list[bool]:
    ids, starts = windows.ids([words(t) for t in texts])
    free = np.ones(len(texts), dtype=bool)
    for start, _ in windows.occurrences(ids, starts):
        free[np.searchsorted(starts, start, side="right") - 1] = False
    return free.tolist()

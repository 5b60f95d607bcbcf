"""Token ids in grammar-compressed shards (Re-Pair).

Documents are dealt by ranges of their id and encoded in ascending id order; each document's ids end with an end id. A
shard of about ``shard_ids`` ids is compressed by itself: in each round the frequent pairs of neighbouring ids become
nonterminals, overlapping occurrences are resolved from the left, and no pair crosses a document's end. A shard stores its
rules, the expansion length of every symbol, the compressed sequence, and where each document starts in it, so that one
document can be decoded without the rest. Shards are rows of a Parquet table in the shared folder, which Spark's commit
protocol protects against lost executors.

Encoding uses the tokenizers library. Byte-level merges never cross the splits of the tokenizer's own pattern, so each
distinct split is encoded once and kept (up to a bound); texts that hold a special token's characters are encoded whole.

Null and empty texts have the end id only. Repeated rows are all stored; ids that tie are ordered by text. Null ids come
first. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import batches, fresh, small_batches, texts, two

SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

BYTE_CHARS = {  # the byte-level alphabet: printable bytes stand for themselves, the others are moved up from 256
    b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)
}
BYTE_CHARS |= {b: 256 + k for k, b in enumerate(b for b, c in BYTE_CHARS.items() if c is None)}

SPACE = chr(BYTE_CHARS[32])
TOKEN_ID = attrgetter("id")


class _Splits(dict):
    """Ids of splits; a split that is not yet known goes through the tokenizer's model."""

    def __init__(self, lib: Tokenizer):
        self.model = lib.model

    def ids(self, split: str) -> bytes:
        if split.isascii() and split.isprintable():
            mapped = split.replace(" ", SPACE)
        else:
            mapped = split.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", map(TOKEN_ID, self.model.tokenize(mapped))).tobytes()

    def __missing__(self, split: str) -> bytes:
        ids = self[split] = self.ids(split)
        return ids


class _Chunks(dict):
    """Ids of what follows a single space, that space included."""

    def __init__(self, splits: _Splits):
        self.splits, self.tokenize = splits, splits.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            mapped = SPACE + (chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(BYTE_CHARS))
            ids = array("I", map(TOKEN_ID, self.tokenize(mapped))).tobytes()
        elif (core := chunk.rstrip(MARKS)).isalpha():  # the marks are one split
            ids = self[core] + self.splits[chunk[len(core) :]]
        elif (cut := chunk.find("\n")) > 0 and not chunk[cut - 1].isspace() and not chunk[cut + 1 : cut + 2].isspace() and cut + 1 < len(chunk):
            # one line break between two words is a split of its own, and what follows it has no space before it
            rest = chunk[cut + 1 :]
            ids = self[chunk[:cut]] + self.splits["\n"]
            ids += self.splits[rest] if rest.isalpha() else b"".join(map(self.splits.__getitem__, SPLIT.findall(rest)))
        else:
            ids = b"".join(map(self.splits.__getitem__, SPLIT.findall(" " + chunk)))
        self[chunk] = ids
        return ids


class SplitEncoder:
    """Byte-level encoder that remembers the ids of splits and of what lies between single spaces, about ``keep`` of each.

    The tokenizer's pattern joins a single space to what follows it, so a text without neighbouring spaces may be cut
    before each space first; other texts are cut by the pattern.
    """

    def __init__(self, tokenizer_file: str, keep: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one Spark task, one core
        self.lib = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.splits = _Splits(self.lib)
        self.chunks = _Chunks(self.splits)
        self.keep = keep
        for text in (SAMPLE, SAMPLE.replace("<", " "), " " + SAMPLE.upper()):
            if np.frombuffer(self.one(text), "<u4").tolist() != self.lib.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{tokenizer_file}: splits or merges in another way than this encoder")

    def one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return b"".join(map(self.splits.__getitem__, SPLIT.findall(text)))
        head, *rest = text.split(" ")
        return b"".join([*map(self.splits.__getitem__, SPLIT.findall(head)), *map(self.chunks.__getitem__, rest)])

    def encode(self, lines: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in lines:
            out.append(self.one(text))
            if len(self.chunks) > self.keep:
                self.chunks.clear()
            if len(self.splits) > self.keep:
                self.splits.clear()
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> SplitEncoder:
    return SplitEncoder(tokenizer_file)


def compress(seq: np.ndarray, ends: np.ndarray, first_rule: int, least: int = 16):
    """Rules (pairs of symbols), the compressed sequence, and where its documents end.

    Rounds go on until no pair of neighbours occurs ``least`` times, at which a rule no longer pays for itself; symbols may
    have any 32-bit value. ``ends`` are positions one past each document's last id.
    """
    last = np.zeros(len(seq), dtype=bool)
    last[ends - 1] = True
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    total = first_rule
    # where a frequent pair may begin: a pair can only become frequent beside a symbol that is new
    open_ = np.ones(len(seq), dtype=bool)
    while True:
        at = np.flatnonzero(open_ & ~last)
        # symbols of 16 bits need half the memory to sort; pairs and rules are the same either way
        bits = np.uint32(16) if total <= 1 << 16 else np.uint64(32)
        pair = (seq[at].astype(bits.dtype) << bits) | seq[at + 1].astype(bits.dtype)
        # hashed counts bound a pair's count from above; only pairs in full enough buckets are counted exactly
        bucket = _pair_hash(pair)
        full = np.flatnonzero((np.bincount(bucket, minlength=1 << 18) >= least)[bucket])
        at, bucket, some = at[full], bucket[full], pair[full]
        ordered = np.sort(some)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, int)
        counts = np.diff(edge)
        chosen = ordered[edge[:-1]][counts >= least]
        if not len(chosen):
            break
        counts = counts[counts >= least]
        open_[:] = False
        open_[at] = True
        # a slot a bucket: of the chosen pairs in one bucket, the most frequent goes first and the others wait a round
        order = np.argsort(counts, kind="stable")
        slot = np.full(1 << 18, -1, dtype=np.int32)
        slot[_pair_hash(chosen)[order]] = order
        where = slot[bucket]
        hit = (where >= 0) & (chosen[where] == some)
        at, where = at[hit], where[hit]
        # of occurrences that overlap in a row, every other one from the left is replaced
        start = np.ones(len(at), dtype=bool)
        start[1:] = at[1:] != at[:-1] + 1
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, where = at[take], where[take]
        # a pair that lost nearly all its places to neighbours waits for the next round, but some pair always goes
        n = np.bincount(where, minlength=len(chosen))
        goes = n >= min(4, n.max())
        at, where = at[goes[where]], where[goes[where]]
        rules.append(np.stack((chosen[goes] >> bits, chosen[goes] & ((bits.dtype.type(1) << bits) - bits.dtype.type(1))), axis=1).astype(np.int64))
        seq[at] = total + (np.cumsum(goes) - 1)[where]
        total += int(goes.sum())
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last, open_ = seq[keep], last[keep], open_[keep]
        at -= np.arange(len(at))
        open_[at] = True
        open_[at[at > 0] - 1] = True
    both = np.concatenate([np.empty((0, 2), np.int64), *rules])
    return both, seq.astype(np.int64), np.flatnonzero(last) + 1


def _pair_hash(pair: np.ndarray) -> np.ndarray:
    """18 bits of each pair of symbols."""
    if pair.dtype == np.uint32:
        return ((pair * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)


class Grammar:
    """Expansions of all symbols of a shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_rule: int):
        self.first, self.lengths = first_rule, lengths
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        self.flat = np.zeros(self.at[-1], dtype=np.uint32)
        # rules of one depth expand together; a rule only uses symbols before it
        depth = np.zeros(len(rules), dtype=np.int64)
        inner = rules - first_rule
        for k in range(len(rules)):
            a, b = inner[k]
            depth[k] = 1 + max(depth[a] if a >= 0 else 0, depth[b] if b >= 0 else 0)
        for d in range(1, depth.max(initial=0) + 1):
            some = np.flatnonzero(depth == d)
            sides = rules[some].ravel()
            self.flat[_spread(self.at[some], lengths[some])] = self.expand(sides)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of a sequence of symbols."""
        rule = np.flatnonzero(seq >= self.first)
        if not len(rule):
            return seq.astype(np.uint32)
        inner = seq[rule] - self.first
        n = np.ones(len(seq), dtype=np.int64)
        n[rule] = self.lengths[inner]
        out = np.repeat(seq.astype(np.uint32), n)
        begin = np.cumsum(n)[rule] - n[rule]
        out[_spread(begin, n[rule])] = self.flat[_spread(self.at[inner], n[rule])]
        return out


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[k], start[k]+1, ... of n[k] each, one after the other."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    lengths = np.ones(len(rules), dtype=np.int64)
    inner = (rules - first_rule).tolist()
    out = lengths.tolist()
    for k, (a, b) in enumerate(inner):
        out[k] = (out[a] if a >= 0 else 1) + (out[b] if b >= 0 else 1)
    return np.array(out, dtype=np.int64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest: a width byte, then the values."""
    most = values.max(initial=0)
    width = 2 if most < 1 << 16 else 3 if most < 1 << 24 else 4
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    cells = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(cells), 4), dtype=np.uint8)
    out[:, : blob[0]] = cells
    return out.view("<u4").ravel().astype(np.int64)


SAMPLE = "The  quick,brown fox’s 12%;\n ÀÉß don't we'll e-mail@x.org \t\r\n  日本語 😀 \u00a0x ² ½ _a__b <|endoftext|> y"

SHARD = "first_rule int, rules binary, lengths binary, symbols binary, starts array<long>, part int, seq int, before long, n_ids long"


def write_shards(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    shard_ids: int = 1 << 20,
    path: str | None = None,
) -> str:
    """Encode, compress and write the shards; returns the table's path."""
    spark = docs.sparkSession
    small_batches(spark)
    frame = two(docs, id_col, text_col)
    kind, arrow = frame.schema["doc_id"].dataType.simpleString(), to_arrow_type(frame.schema["doc_id"].dataType)
    path = path or fresh(spark, "token-shards")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        first_rule = max(own.lib.get_vocab_size(), end_id + 1)
        held: list[bytes] = []
        keys: list = []
        size, seq, before = 0, 0, 0
        tail = np.array([end_id], dtype="<u4").tobytes()

        def shard():
            ends = np.cumsum([len(x) // 4 for x in held])
            rules, symbols, cut = compress(np.frombuffer(b"".join(held), "<u4"), ends, first_rule)
            row = {
                "doc_ids": [keys],
                "first_rule": [first_rule],
                "rules": [pack(rules.ravel())],
                "lengths": [pack(expansion_lengths(rules, first_rule))],
                "symbols": [pack(symbols)],
                "starts": [np.concatenate(([0], cut)).tolist()],
                "part": [part],
                "seq": [seq],
                "before": [before],
                "n_ids": [size],
            }
            types = [pa.list_(arrow), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches(it):
            for key, ids in zip(batch.column("doc_id").to_pylist(), own.encode(texts(batch)), strict=True):
                held.append(ids + tail)
                keys.append(key)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield shard()
                    seq, before, size, held, keys = seq + 1, before + size, 0, [], []
        if held:
            yield shard()

    ordered = frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, f"doc_ids array<{kind}>, {SHARD}").write.option("compression", "zstd").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, decoded from the shards."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType
    # ids of whole parts before each part: one row per part, whose number the writer's partitioning bounds
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sizes):
        base[r.part], total = total, total + r.n
    arrow = to_arrow_type(kind)

    def run(it):
        for batch in batches(it):
            for k in range(batch.num_rows):  # shards are large: one at a time becomes Python objects
                row = batch.slice(k, 1).to_pylist()[0]
                grammar, symbols = _open(row)
                ids = grammar.expand(symbols).astype("<u4")
                reach = np.concatenate(([0], np.cumsum(_lengths(grammar, symbols))))
                cut = reach[np.array(row["starts"])]
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                start = base[row["part"]] + row["before"] + cut[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], arrow), pa.array(start), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def _lengths(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    n = np.ones(len(symbols), dtype=np.int64)
    rule = np.flatnonzero(symbols >= grammar.first)
    n[rule] = grammar.lengths[symbols[rule] - grammar.first]
    return n


def _open(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = unpack(row["rules"]).reshape(-1, 2)
    return Grammar(rules, unpack(row["lengths"]), row["first_rule"]), unpack(row["symbols"])


def decode_document(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard row; only its own symbols are expanded."""
    grammar, symbols = _open(row)
    a, b = row["starts"][k : k + 2]
    return grammar.expand(symbols[a:b])

"""SimHash near-duplicate components, searched with pivot distance tables.

1. Each document gets a 64-bit fingerprint of its word shingles (Arrow batches, no shuffle).
2. Documents of equal fingerprint form a class; from here on only distinct fingerprints move.
3. A table holds each fingerprint's Hamming distances to many reference fingerprints (pivots). By the triangle
   inequality two fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate. Fingerprints meet
   where they can be that close (two of four 16-bit blocks agree); in each meeting they are ordered by their first
   coordinate, pairs whose coordinates differ by more than ``radius`` anywhere are discarded, and the survivors are
   verified by exact Hamming distance.
4. A meeting yields only a spanning forest of its links, never all pairs. Meetings over ``tile`` members are dealt out as
   pairs of tiles, so that no task holds an unbounded group.
5. Components come from alternating large-star and small-star steps over links between classes, each step written to the
   shared folder.

Texts without words (null, empty, white space) have fingerprint zero and link like any other. Repeated rows keep their
rows. Null ids never name a component; a component of null ids only has a null id. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, raw_texts, small_batches, spread, stored, two


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 values of the shingles of lower-cased words, repeats included; fewer words are one shingle."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, dtype="<u8")
    n, line, digest = max(1, len(ws) - shingle + 1), b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    begins, ends = [0, *ends[: n - 1].tolist()], (ends[min(shingle, len(ws)) - 1 :] - 1).tolist()
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(begins, ends, strict=True)), "<u8", n)


def majority(h: np.ndarray) -> int:
    """The value of which a bit is set if it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, text_hash: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), and h (hash of the raw text) if asked for."""
    small_batches(docs.sparkSession)
    frame = two(docs, id_col, text_col)
    more = ["h"] if text_hash else []
    if text_hash:
        frame = frame.withColumn("h", F.xxhash64("text"))

    def run(it):
        for batch in batches(it):
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(batch)], dtype=np.uint64).view(np.int64)
            cols = [batch.column("doc_id"), pa.array(fp), *[batch.column(c) for c in more]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", *more])

    schema = ", ".join([f"doc_id {frame.schema['doc_id'].dataType.simpleString()}", "fp long", *[f"{c} long" for c in more]])
    return spread(frame).mapInArrow(run, schema)


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def meetings(radius: int, blocks: int = 4) -> list[int]:
    """Masks of bits of which one must agree entirely if at most ``radius`` of 64 bits differ."""
    width = 64 // blocks
    block = [((1 << width) - 1) << (width * k) for k in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _search(radius: int, n_pivots: int):
    refs = pivots(n_pivots)

    def links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning links (child, parent) inside each group."""
        dist = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
        order = np.lexsort((dist[:, 0], group))
        group, fp, dist = group[order], fp[order], dist[order]
        parent = np.arange(len(fp))

        def root(x: np.ndarray) -> np.ndarray:
            while True:
                y = parent[x]
                if (y == x).all():
                    return x
                parent[x] = parent[y]
                x = y

        live, step = np.arange(len(fp)), 0
        while len(live):
            step += 1
            live = live[live + step < len(fp)]
            other = live + step
            near = (group[other] == group[live]) & (dist[other, 0] - dist[live, 0] <= radius)
            live, other = live[near], other[near]
            ok = (np.abs(dist[other] - dist[live]).max(axis=1, initial=0) <= radius) if len(live) else near[:0]
            a, b = live[ok], other[ok]
            same = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[same], b[same]
            while len(a):
                ra, rb = root(a), root(b)
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        top = root(np.arange(len(fp)))
        child = np.flatnonzero(top != np.arange(len(fp)))
        return fp[child], fp[top[child]]

    def run(it):
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches(it):
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "part", "tile")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                key, fp = np.concatenate((held[0], key)), np.concatenate((held[1], fp))
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cut = new[-1] if len(new) else 0
            held = (key[cut:], fp[cut:])
            if cut:
                yield from emit(key[:cut], fp[:cut])
        if held is not None:
            yield from emit(*held)

    def emit(key, fp):
        group = np.cumsum(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        size = np.bincount(group)[group]
        a, b = links(group[size > 1], fp[size > 1])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(classes: DataFrame, radius: int = 2, n_pivots: int = 16, tile: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component of pairs within ``radius`` bits."""
    masks = meetings(radius)
    keyed = classes.select("fp").select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks])).alias(
            "mask", "part"
        ),
    )
    crowded = keyed.groupBy("mask", "part").count().where(F.col("count") > tile)
    crowded = crowded.select("mask", "part", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(crowded, ["mask", "part"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("own", own).select(
        "mask",
        "part",
        "fp",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("tiles") - 1),
                lambda t: F.least(t, F.col("own")) * F.col("tiles") + F.greatest(t, F.col("own")),
            )
        ).alias("tile"),
    )
    ordered = dealt.repartition("mask", "part", "tile").sortWithinPartitions("mask", "part", "tile")
    return ordered.mapInArrow(_search(radius, n_pivots), "a long, b long")


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node, root: the smallest node of each linked component (nodes without links are absent).

    Alternating large-star and small-star; links only shrink towards stars, so the loop ends after a logarithmic number
    of rounds. Sums and partial minima shuffle; no neighbourhood is gathered in one task.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what
    )
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), what)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), what)
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    spread = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.bit_xor(spread), F.sum(F.shiftright(spread, 20))).first())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3
) -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links reach), n_class (documents of the same fingerprint)."""
    return _members(docs, id_col, text_col, radius, shingle).select("doc_id", "fp", "component_id", "n_class")


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, text_hash: bool = False) -> DataFrame:
    """The columns of near_duplicates, root (the same in a component only), and h (hash of the raw text) if asked for."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle, text_hash), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_class")), "classes")
    roots = components(links(classes, radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", "n_class", F.coalesce("root", "fp").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select(F.col("fp").alias("fp_"), "root", "component_id", "n_class")
    return marked.join(named, marked["fp"] == named["fp_"]).drop("fp_")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each component, the one of the smallest id, with all its columns.

    Rows that repeat an id and a text count as one document, of which one row stays; an id may occur with different
    texts. Rows without an id can't be told apart and stay.
    """
    found = _members(docs, id_col, text_col, radius, shingle, text_hash=True).select("doc_id", "h", "root")
    return keep_one(docs, stored(found, "members"), id_col, text_col)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component (doc_id, h, root of ``found``), the one of the smallest id and then text hash.

    Rows are told apart by id and text, so an id that occurs with different texts loses only the texts that go. Rows
    without an id stay.
    """
    known = found.where("doc_id is not null")
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    # only components of more than one row can lose any; written first, so that the planner knows its size: texts are
    # shuffled only if the rows that go are too many to broadcast
    gone = known.join(first, "root").where("doc_id <> first.doc_id or h <> first.h")
    gone = stored(gone.select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h")).distinct(), "surplus")
    key, h = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    kept = docs.join(gone, (docs[id_col] == gone["gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["gone_h"]), "left_anti")
    if known.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return kept
    # an id may be the first of several components: their texts differ
    named = kept.where(key.isNotNull()).withColumn("_h", h).dropDuplicates([id_col, "_h"]).drop("_h")
    return named.unionByName(kept.where(key.isNull()))

"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Patterns (leftmost, not overlapping per kind, in code points): ``assign`` is a named value of six or more characters,
``access`` an access-key id of 20 or more, ``hex`` a run of 24 or more lower-case hex digits. On top, every run of key
characters of ``min_length`` or more is read by two second-order Markov chains, one of random strings and one of ordinary
identifiers; a run whose mean log-likelihood ratio and total both pass their thresholds, and which touches no pattern
span, is a span of kind ``random``.

Both chains are trained from labelled samples: random strings (pattern matches of the corpus sample and generated strings
over usual key alphabets) against ordinary identifiers (other words of the corpus sample). The corpus sample is bounded
by ``max_docs`` documents of the smallest hashes; scanning covers whole texts.

Null and empty texts have no spans. Repeated rows keep their rows, and an empty table gives none (without documents the
chains know generated strings and a few shapes of names only). Of spans that begin together the kind listed first comes
first; a run exactly at a threshold is a span. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lowest_hashes, small_batches, texts, two

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
STEMS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEY_CHARS = (string.ascii_letters + string.digits + "+/=_-").encode()
CLASS = np.zeros(256, dtype=np.int64)
CLASS[list(KEY_CHARS)] = np.arange(1, len(KEY_CHARS) + 1)
STATES = len(KEY_CHARS) + 1
SPAN = "array<struct<kind:string,start:long,end:long>>"


def one_byte(text: str) -> bytes:
    """One byte per code point; code points that no pattern can hold become ``?``."""
    return text.encode("ascii") if text.isascii() else text.encode("latin-1", "replace")


def key_runs(line: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of key characters of at least that length."""
    if len(line) < least:
        return []
    stop = np.flatnonzero(CLASS[np.frombuffer(line, np.uint8)] == 0)
    edge = np.concatenate(([-1], stop, [len(line)]))
    long = np.flatnonzero(np.diff(edge) > least)
    return [(int(edge[k]) + 1, int(edge[k + 1])) for k in long]


def patterns(line: bytes, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Pattern spans; ``runs`` are the key runs of 16 or more (at least those), in which access keys and hex runs must lie."""
    found: list[tuple[str, int, int]] = []
    low, starts = line.lower(), []
    for stem in STEMS:
        at = low.find(stem)
        while at >= 0:
            starts.append(at)
            at = low.find(stem, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := ASSIGN.match(line, at)):
            end = m.end()
            if m.end(2) - m.start(2) >= 6:
                found.append(("assign", m.start(), m.end()))
    for a, b in runs:
        if b - a >= 20:
            found += [("access", m.start(), m.end()) for m in ACCESS.finditer(line, a, b) if m.end() - m.start() >= 20]
        if b - a >= 24:
            found += [("hex", m.start(), m.end()) for m in HEX.finditer(line, a, b) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class MarkovRatio:
    """Log-likelihood ratio of two second-order chains, per character transition."""

    def __init__(self, random_strings: Iterable[bytes], identifiers: Iterable[bytes], smoothing: float = 0.3):
        self.ratio = (self.chain(random_strings, smoothing) - self.chain(identifiers, smoothing)).astype(np.float32)

    @staticmethod
    def codes(line: bytes) -> np.ndarray:
        c = np.concatenate(([0, 0], CLASS[np.frombuffer(line, np.uint8)]))
        return (c[:-2] * STATES + c[1:-1]) * STATES + c[2:]

    @classmethod
    def chain(cls, samples: Iterable[bytes], smoothing: float) -> np.ndarray:
        """Smoothed log probabilities; each order backs off to the one below."""
        parts = [cls.codes(s) for s in samples if s]
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        n3 = np.bincount(flat, minlength=STATES**3).reshape(STATES, STATES, STATES).astype(float)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + STATES)
        p2 = (n2 + 4 * p1) / (n2.sum(1, keepdims=True) + 4)
        p3 = (n3 + 10 * smoothing * p2[None]) / (n3.sum(2, keepdims=True) + 10 * smoothing)
        return np.log(p3).ravel()

    def __call__(self, line: bytes) -> tuple[float, float]:
        """Total and mean of the ratio; above zero the string is likelier random."""
        r = self.ratio[self.codes(line)]
        return float(r.sum()), float(r.mean())


def generated(n: int = 4000, seed: int = 7) -> list[bytes]:
    """Labelled random strings over the alphabets that keys use."""
    rng, lower, upper, digits = random.Random(seed), string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = ("0123456789abcdef", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/")
    alphabets += (lower + upper + digits + "_-", "0123456789ABCDEF")
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 48))).encode() for k in range(n)]


def fit_texts(lines: Iterable[str]) -> MarkovRatio:
    rand, plain = generated(), [b"camelCaseIdentifier", b"snake_case_identifier", b"kebab-case-identifier", b"==========", b"-----"]
    for text in lines:
        line, at = one_byte(text), 0
        taken = patterns(line, key_runs(line, 16))
        for kind, a, b in taken:
            rand.append(line[a:b] if kind != "assign" else ASSIGN.match(line, a).group(2))
        for a, b in key_runs(line, 4):
            while at < len(taken) and taken[at][2] <= a:
                at += 1
            if not any(s[1] < b and a < s[2] for s in taken[max(0, at - 1) : at + 3]):
                plain.append(line[a:b])
    return MarkovRatio(rand, plain)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000, max_chars: int = 30_000) -> MarkovRatio:
    """Train on at most ``max_docs`` documents of at most ``max_chars`` characters, those of the smallest hashes."""
    frame = two(docs, id_col, text_col)
    short = frame.where(F.length("text") <= max_chars)
    rows = lowest_hashes(short, F.struct("doc_id", "text"), max_docs)
    return fit_texts(x or "" for x in rows.select("text").toArrow()["text"].to_pylist())


def spans_of(text: str, model: MarkovRatio, min_length: int, least_mean: float, least_total: float) -> list[tuple[str, int, int]]:
    line = one_byte(text)
    runs = key_runs(line, min(16, min_length))
    found = patterns(line, runs)
    more = []
    for a, b in runs:
        if b - a < min_length or any(s[1] < b and a < s[2] for s in found):
            continue
        total, mean = model(line[a:b])
        if mean >= least_mean and total >= least_total:
            more.append(("random", a, b))
    return sorted(found + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else found


def scan(
    docs: DataFrame,
    model: MarkovRatio,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 16,
    least_mean: float = 0.6,
    least_total: float = 16.0,
) -> DataFrame:
    """doc_id, spans (kind, start, end in code points) and redacted, the text with each span replaced by its kind."""
    small_batches(docs.sparkSession)
    frame = two(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it):
        for batch in batches(it):
            spans, clean = [], []
            for text in texts(batch):
                found = spans_of(text, model, min_length, least_mean, least_total)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                clean.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, kind), pa.array(clean, pa.string())],
                names=["doc_id", "spans", "redacted"],
            )

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, spans {SPAN}, redacted string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans are replaced once, under the first one's kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(
    docs: DataFrame,
    model: MarkovRatio,
    text_col: str = "text",
    length_col: str = "n_chars",
    min_length: int = 16,
    least_mean: float = 0.6,
    least_total: float = 16.0,
) -> DataFrame:
    """All rows and columns, with secrets in the text replaced by their kind and the length column (if any) renewed.

    Null texts stay null.
    """
    small_batches(docs.sparkSession)
    at, sized = docs.columns.index(text_col), length_col in docs.columns

    def run(it):
        for batch in batches(it):
            clean, changed = batch.column(at).to_pylist(), False
            lengths = batch.column(length_col).to_pylist() if sized else []
            for k, text in enumerate(clean):
                found = spans_of(text, model, min_length, least_mean, least_total) if text else []
                if found:
                    clean[k], changed = redact(text, found), True
                    if sized:
                        lengths[k] = len(clean[k])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
                if sized:
                    n = batch.schema.get_field_index(length_col)
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)

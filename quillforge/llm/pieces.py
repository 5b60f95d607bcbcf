"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text becomes words that begin with the space mark. Distinct words of an Arrow batch are grouped by length, and words of
one length advance together: at each end position, substring hashes of every length probe the sorted piece keys, each
candidate is scored, and vectorised maxima store the best piece as the backpointer.

The model's pieces come from byte-pair merges, so the score of a candidate is its rank among segmentations that merging
can reach: a piece may follow its predecessor only if merging the two alone would leave them as they are (pairs are
checked once and kept). Exactly one path of such pairs exists for a word, and it is the library's own segmentation.
Characters without a piece become byte pieces. Runs of several space marks, whose pieces share one score, are cut
from the left, the longest piece first, as the merge order does.

Long words (texts without spaces) are first cut between neighbours that no piece holds side by side, as no merge crosses
there. What is still longer than ``WINDOW`` is read in overlapping windows, which advance together like other words; two
windows join behind a piece that both found, so every neighbouring pair of the whole path has been checked and the path
is the only one. Windows that agree nowhere (runs of one character) are merged plainly, with a heap.

A model whose ids differ from the library's on a fixed text of awkward cases is refused.

Null and empty texts have no ids. Repeated rows are encoded alike. Decoding gives the text back, except that the space
mark itself, if a text holds it, comes back as a space.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import batches, gathered, small_batches, spread, texts, two

MARK = "▁"
LETTERS, STOPS = "a-zA-ZÀ-ÖØ-öø-ÿ", ",.!?;:|%#*$&"
BASE = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it loses nothing
LONG, WINDOW, MARGIN, KEPT = 32, 512, 64, 64
SAMPLE = "The  quick,brown fox’s 12%;\n ÀÉß Über façade 日本語 ﬁ ｱ ² \t don't e-mail@x.org </s> <0x41> 😀 xyzzy\u00a0_a▁b"


class SortedKeys:
    """Sorted 64-bit keys that whole arrays probe at once: the leading bits name a short stretch of the sorted keys."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        assert len(np.unique(keys)) == len(keys), "keys collide"
        edges = np.arange(1, (1 << self.BITS) + 1, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.first = np.zeros((1 << self.BITS) + 1, dtype=np.int32)
        self.first[1:-1] = np.searchsorted(self.keys, edges[:-1])
        self.first[-1] = len(keys)
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, probes: np.ndarray) -> np.ndarray:
        """The value of each probe, or -1."""
        flat = probes.ravel()
        bucket = (flat >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(flat), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], flat[live]
        for _ in range(self.most):
            hit = self.keys[at] == wanted
            out[live[hit]] = self.values[at[hit]]
            more = ~hit & (at + 1 < end)
            live, at, end, wanted = live[more], at[more] + 1, end[more], wanted[more]
        return out.reshape(probes.shape)


class PieceCodec:
    """Encoder and decoder of one SentencePiece model; words already encoded are kept up to ``keep`` of up to ``KEPT`` characters."""

    def __init__(self, model_file: str, keep: int = 1 << 17):
        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.score = np.array([lib.get_score(i) for i in range(n)])
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)}
        self.normal = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.id_bytes}
        self.runs = sorted((len(p) for p in self.normal if set(p) == {MARK}), reverse=True)
        self.longest = max(map(len, self.normal), default=1)
        self.unknown = n  # stands for any character without a piece while words are cut
        self.whole = {i for p, i in self.normal.items() if self.merge(p) == [p]}
        keys = np.array([self.hash(self.pieces[i]) for i in self.whole], dtype=np.uint64) * SPREAD
        self.found = SortedKeys(keys, np.array(list(self.whole), dtype=np.int64))
        self._ranks()
        # no merge crosses a neighbourhood that no piece holds, so words may end there
        ends = "" if any(re.search(f"[{LETTERS}][{STOPS}]", p) for p in self.normal) else f"{MARK}*[{LETTERS}]+(?=[{STOPS}])|"
        line = "" if any("\n" in p for p in self.normal) else "\n"
        self.word = re.compile(f"{ends}{MARK}*[^{MARK}{line}]+|{MARK}+" + (line and f"|{line}"))
        pairs = {p[k] + p[k + 1] for p in self.normal for k in range(len(p) - 1)}
        self.pair_codes = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in pairs], dtype=np.int64))
        self.plain = np.ones(n, dtype=bool)  # ids that decode to their piece
        self.plain[[*self.special, *self.id_bytes]] = False
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.keep = keep
        for text in (SAMPLE, SAMPLE * 20, "x" * 5000):
            if np.frombuffer(self.encode([text])[0], "<u4").tolist() != lib.encode(text):
                raise ValueError(f"{model_file}: merges or normalises in another way than this codec")

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def merge(self, text: str) -> list[str]:
        """Plain merging of one short string: the best-scored neighbours first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(
                ((-self.score[i], k) for k in range(len(parts) - 1) if (i := self.normal.get(parts[k] + parts[k + 1], -1)) >= 0),
                default=None,
            )
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _ranks(self) -> None:
        """Merge ranks of pieces (single characters first), their last merges, and which neighbours merge to what."""
        order = sorted(self.whole, key=lambda i: (len(self.pieces[i]) > 1, -self.score[i], i))
        self.rank = np.full(self.unknown + 1, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        rank_of = {self.pieces[i]: k for k, i in enumerate(order)}
        joined: dict[int, int] = {}
        self.width = len(order) + 1
        for piece, k in rank_of.items():
            options = []
            for cut in range(1, len(piece)):
                a, b = rank_of.get(piece[:cut]), rank_of.get(piece[cut:])
                if a is not None and b is not None:
                    joined[a * self.width + b] = k
                    options.append((max(a, b), a, b))
            for _, a, b in sorted(options):
                if self.merge_last(piece, order[a], order[b]):
                    self.left[k], self.right[k] = a, b
                    break
        self.joined = SortedKeys(np.array(list(joined), dtype=np.uint64) * SPREAD, np.array(list(joined.values()), dtype=np.int64))

    def merge_last(self, piece: str, a: int, b: int) -> bool:
        """Whether the last merge that makes the piece joins exactly these two."""
        parts = list(piece)
        while len(parts) > 2:
            _, k = min(
                (-self.score[i], k) for k in range(len(parts) - 1) if (i := self.normal.get(parts[k] + parts[k + 1], -1)) >= 0
            )
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts == [self.pieces[a], self.pieces[b]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces as they are, for each pair.

        All pairs are undone together, one merge at a time and the latest merge first: a pair fails as soon as the parts
        that touch would have been merged before the merge that was undone last.
        """
        ok = np.ones(len(left), dtype=bool)
        live = np.flatnonzero((left != self.unknown) & (right != self.unknown))
        a, b = self.rank[left[live]], self.rank[right[live]]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            key = a * self.width + b
            merged = self.joined(key.astype(np.uint64) * SPREAD)
            fails = (merged >= 0) & (merged < limit)
            ok[live[fails]] = False
            more, below = self.right[a], self.left[b]
            can_a, can_b = more != a, below != b
            undo_a = can_a & ((a > b) | ~can_b)
            limit = np.where(undo_a, a, b + 1)
            go = ~fails & (can_a | can_b)
            a, b = np.where(undo_a, more, a)[go], np.where(undo_a, b, below)[go]
            live, limit = live[go], limit[go]
        return ok

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, and where each ends (0 on the left of shorter ones); one position of all words at once."""
        n, size = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((n, size + 1), dtype=np.uint64)
        power = BASE ** np.arange(size + 1, dtype=np.uint64)
        for k in range(size):
            prefix[:, k + 1] = prefix[:, k] * BASE + chars[:, k] + np.uint64(1)
        last = np.full((n, size + 1), -1, dtype=np.int64)
        last[:, 0] = self.unknown  # any piece may begin a word
        step = np.zeros((n, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, self.longest) + 1)
            h = prefix[:, end, None] - prefix[:, end - lengths] * power[lengths]
            token = self.found(h * SPREAD)
            token[:, 0] = np.where(token[:, 0] < 0, self.unknown, token[:, 0])
            row, col = np.nonzero((token >= 0) & (last[:, end - lengths] != -1))
            t, before = token[row, col], last[row, end - lengths[col]]
            fine = self.compatible(before, t)
            score = np.zeros(token.shape, dtype=np.int64)
            score[row[fine], col[fine]] = lengths[col[fine]]
            best = score.argmax(axis=1)
            found = score[np.arange(n), best] > 0
            last[found, end] = token[np.arange(n), best][found]
            step[found, end] = lengths[best][found]
        # all words go back together, one piece a step
        rows, at = np.arange(n), np.full(n, size)
        tokens, ends = [], []
        while (at > 0).any():
            back = step[rows, at]
            if (back[at > 0] <= 0).any():
                raise ValueError("a word without a segmentation")
            tokens.append(np.where(at > 0, last[rows, at], 0))
            ends.append(at.copy())
            at = np.where(at > 0, at - back, 0)
        return np.stack(tokens[::-1], axis=1).astype("<u4"), np.stack(ends[::-1], axis=1)

    def pieces_of(self, words: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Each word of one length, its pieces, and where each ends."""
        some = max(16, min(4096, (1 << 17) // len(words[0])))
        for k in range(0, len(words), some):
            tokens, ends = self.viterbi(words[k : k + some])
            for word, ts, es in zip(words[k : k + some], tokens.tolist(), ends.tolist(), strict=True):
                first = sum(e == 0 for e in es)
                yield word, ts[first:], es[first:]

    def keep_all(self, words: list[str]) -> None:
        """Learn words of one length that are not long."""
        for k in range(0, len(words), 4096):
            group = words[k : k + 4096]
            tokens, ends = self.viterbi(group)
            odd = (tokens == self.unknown).any(axis=1)
            raw, width = tokens.tobytes(), 4 * tokens.shape[1]
            begin = 4 * (ends == 0).sum(axis=1)
            for word, a, b in zip(group, (begin + np.arange(len(group)) * width).tolist(), range(width, width * len(group) + 1, width), strict=True):
                self.words[word] = raw[a:b]
            for row in np.flatnonzero(odd).tolist():
                first = int(begin[row]) // 4
                ids = self._ids(group[row], tokens[row, first:].tolist(), ends[row, first:].tolist())
                self.words[group[row]] = array("I", ids).tobytes()

    def split(self, word: str) -> list[str]:
        """Parts of a long word that no merge joins."""
        if len(word) <= LONG:
            return [word]
        points = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        code = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        cuts = [0, *(np.flatnonzero(self.pair_codes[at] != code) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def segment(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of words without several space marks in a row."""
        parts = {w: self.split(w) for w in words}
        groups: dict[int, set[str]] = {}
        windows = {p: self._windows(p) for ps in parts.values() for p in ps if len(p) > WINDOW + 2 * MARGIN}
        for ps in parts.values():
            for p in ps:
                for piece in [w for _, w in windows[p]] if p in windows else [p]:
                    groups.setdefault(len(piece), set()).add(piece)
        cut = {w: (tokens, ends) for group in groups.values() for w, tokens, ends in self.pieces_of(sorted(group))}
        ids = {p: self._ids(p, *cut[p]) for ps in parts.values() for p in ps if p not in windows}
        for p, found in windows.items():
            ids[p] = self._ids(p, *self._joined(p, found, cut))
        return {w: ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]] for w, ps in parts.items()}

    def _ids(self, word: str, tokens: list[int], ends: list[int]) -> list[int]:
        """Ids of the pieces; characters without a piece become bytes."""
        if self.unknown not in tokens:
            return tokens
        return [i for t, e in zip(tokens, ends, strict=True) for i in ([t] if t != self.unknown else [self.byte_ids[b] for b in word[e - 1].encode()])]

    @staticmethod
    def _windows(word: str) -> list[tuple[int, str]]:
        """Windows of one length that overlap by twice the margin; the last one begins earlier instead of being shorter."""
        size = WINDOW + 2 * MARGIN
        return [(at, word[at : at + size]) for at in sorted({*range(0, len(word) - size, WINDOW), len(word) - size})]

    def _joined(self, word: str, windows: list[tuple[int, str]], cut) -> tuple[list[int], list[int]]:
        """Pieces and their ends of a whole word from those of its windows."""
        tokens, ends = list(cut[windows[0][1]][0]), list(cut[windows[0][1]][1])
        for at, text in windows[1:]:
            new, stops = cut[text]
            here = {(e + at, t): k for k, (t, e) in enumerate(zip(new, stops, strict=True))}
            # a piece of both, away from where the windows end
            k = len(ends) - 1
            while k >= 0 and ends[k] > at + MARGIN and (ends[k], tokens[k]) not in here:
                k -= 1
            if k < 0 or ends[k] <= at + MARGIN:
                return self._merged(word)
            go = here[ends[k], tokens[k]] + 1
            tokens, ends = tokens[: k + 1] + new[go:], ends[: k + 1] + [e + at for e in stops[go:]]
        return tokens, ends

    def _merged(self, word: str) -> tuple[list[int], list[int]]:
        """Plain merging with a heap of neighbours."""
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b < n and (i := self.normal.get(word[a : end[b]], -1)) >= 0:
                heap.append((-self.score[i], a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if dead[a] or end[a] != mid or mid >= n or dead[mid] or end[mid] != stop:
                continue
            dead[mid], end[a], after[a] = 1, stop, after[mid]
            if after[a] < n:
                before[after[a]] = a
            for k in (before[a], a):
                size = len(heap)
                if k >= 0:
                    offer(k)
                    if len(heap) > size:
                        heapq.heappush(heap, heap.pop())
        starts = [k for k in range(n) if not dead[k]]
        return [self.normal.get(word[k : end[k]], self.unknown) for k in starts], [end[k] for k in starts]

    def _spaces(self, count: int) -> list[int]:
        ids = []
        while count:
            run = next(r for r in self.runs if r <= count)
            ids.append(self.normal[MARK * run])
            count -= run
        return ids

    def learn(self, new: set[str]) -> None:
        """Keep the little-endian 32-bit ids of each word."""
        groups: dict[int, list[str]] = {}
        other = []
        for w in new:
            if len(w) <= LONG and not w.startswith(MARK * 2):
                groups.setdefault(len(w), []).append(w)
            else:
                other.append(w)
        for group in groups.values():
            self.keep_all(group)
        plain = {w: w if not w.startswith(MARK * 2) else w.lstrip(MARK) and MARK + w.lstrip(MARK) for w in other}
        cut, one = self.segment({p for p in plain.values() if p}), self.normal.get(MARK)
        for w, p in plain.items():
            ids = cut[p] if p else self._spaces(len(w))
            if p and p != w:
                extra = len(w) - len(p)
                ids = self._spaces(extra + 1) + ids[1:] if ids[0] == one else self._spaces(extra) + ids
            self.words[w] = array("I", ids).tobytes()

    def cut(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, lines: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are cut twice, first for the words not seen before and then for lookups, so that only distinct words are
        held together.
        """
        new: set[str] = set()
        for t in lines:
            new.update(set(self.cut(t)).difference(self.words))
        again = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        new -= again
        self.learn(new)
        out = [b"".join(map(self.words.__getitem__, self.cut(t))) for t in lines]
        for w in new:
            if len(w) > KEPT:
                del self.words[w]
        if len(self.words) > self.keep:  # words that are not met again go with the next change
            self.older, self.words = self.words, {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        if self.plain[ids].all():
            return "".join(map(self.pieces.__getitem__, ids.tolist())).replace(MARK, " ")[1:]
        parts, held = [], bytearray()
        for i in ids.tolist():
            if i in self.id_bytes:
                held.append(self.id_bytes[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.special:
                parts.append(self.pieces[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")[1:]


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces, exact (whether decoding gives the text back, space marks read as spaces)."""
    small_batches(docs.sparkSession)
    frame = two(docs, id_col, text_col)

    def run(it):
        own = codec(model_file)
        for batch in gathered(it, rows=4000, size=8 << 20):
            lines = texts(batch)
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(lines)]
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            same = [own.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, lines, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(np.diff(at)), pa.array(same)],
                names=["doc_id", "ids", "n_pieces", "exact"],
            )

    return spread(frame).mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces int, exact boolean")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of id lists; null lists give an empty text."""
    small_batches(encoded.sparkSession)
    frame = encoded.selectExpr(f"`{id_col}` as doc_id", f"cast(`{ids_col}` as array<int>) as ids")

    def run(it):
        own = codec(model_file)
        for batch in batches(it):
            text = [own.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, text string")

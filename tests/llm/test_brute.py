"""Operators without SQL against plain versions of what they compute, and the awkward cases of every operator."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import AWKWARD, PAGE, SYLLABLES, frame, prose, rows

from quillforge.llm import contamination, language, licenses, media, neardup, overlap, pages, pieces, queries, secrets, tokens, toxicity

SF = "/root/testdata/sf0.001"


# --- toxicity: the linear score, n-gram by n-gram


def brute_score(text, model):
    low = "".join(c if not c.isascii() or c.isalnum() else " " for c in f" {(text or '').lower()} ")
    low = re.sub(" +", " ", low)
    counts = Counter()
    for n in toxicity.ORDERS:
        for k in range(len(low) - n + 1):
            h = 0
            for j, c in enumerate(low[k : k + n], 1):
                h = ((h ^ ord(c)) * 0x01000193 + j) % 2**32
            counts[((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32 >> (32 - toxicity.BITS)] += 1
    z = model.bias + sum(float(model.weights[b]) * math.log2(1 + n) for b, n in counts.items())
    return 1 / (1 + math.exp(-max(-50, min(50, z))))


def test_toxicity_query_against_plain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op5_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_score(texts[r.doc_id], model)
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_sample_comes_from_the_documents(spark):
    """Labels of ids that are not there take no place of the sample, and repeated ids give one model whatever their order."""
    rng = random.Random(2)
    texts = [prose(rng, 40) + (" vilegrub snarkoid" if k % 3 == 0 else "") for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, prose(rng, 40)), (3, prose(rng, 40))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(5000)], "doc_id long, toxic int")
    one = toxicity.fit(docs, labels, max_rows=200)
    two = toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(5), labels, max_rows=200)
    assert np.isfinite(one.bias) and one.bias == two.bias and (one.weights == two.weights).all()
    assert not np.isfinite(toxicity.fit(docs, labels, max_total=10).bias)


# --- language: out-of-place distance


def brute_grams(text):
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if all(c.isalpha() for c in word):
            padded = f" {word} "
            found.update(word)
            found.update(padded[k : k + 2] for k in range(len(padded) - 1))
            found.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return found


def gram_order(g):
    code = 0
    for c in g:
        code = (code << 21) | (0 if c == " " else ord(c))
    return code | {1: 0, 2: 1 << 62, 3: 1 << 63}[len(g)]


def brute_rank(counts, size):
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], gram_order(g)))[:size])}


def test_language_against_plain_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    train = [(r.text, r.lang) for r in docs.where("doc_id % 3 = 0").collect()]
    model = language.fit_texts([t for t, _ in train], [n for _, n in train], 60)
    by_lang = defaultdict(Counter)
    for t, n in train:
        by_lang[n].update(brute_grams(t))
    profiles = {n: brute_rank(c, 60) for n, c in by_lang.items()}
    assert model.names == sorted(profiles)
    for r in docs.where("doc_id % 3 = 1").limit(40).collect():
        own = brute_rank(brute_grams(r.text), 60)
        if not own:
            continue
        off = {n: sum(abs(p[g] - k) if g in p else 60 for g, k in own.items()) for n, p in profiles.items()}
        best = min(sorted(off), key=off.get)
        name, score = model.predict(r.text)
        assert (name, round(score, 9)) == (best, round(1 - off[best] / (60 * len(own)), 9))


# --- pages: the declared article, read with another parser


class Article(HTMLParser):
    BLOCK = {"p", "div", "h1", "h2", "h3", "ul", "li", "article", "nav", "footer", "header", "aside", "form", "table", "tr", "td", "section"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.inside, self.skip, self.stack = [], [], False, 0, []

    def flush(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        if tag == "article":
            self.inside = True
        if tag == "br":
            self.now.append(" ")
        if tag == "div":
            bad = "ad" in (dict(attrs).get("class") or "")
            self.stack.append(bad)
            self.skip += bad

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        if tag == "article":
            self.inside = False
        if tag == "div" and self.stack:
            self.skip -= self.stack.pop()

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now.append(data)


def brute_article(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n".join(parser.lines)


def test_pages_query_against_another_parser(spark):
    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op7_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(source)
    same = [r for r in got if r.text == brute_article(source[r.page_id])]
    assert len(same) == len(got)
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_second for r in got) > 0 < sum(r.n_first for r in got)


def test_second_pass_against_a_plain_one():
    rng = random.Random(4)
    for _ in range(3000):
        labels = [rng.choice([True, False, None, None]) for _ in range(rng.randint(0, 9))]
        heads = [rng.random() < 0.2 for _ in labels]
        want = []
        for k, label in enumerate(labels):
            before = [(k - j, labels[j]) for j in range(k - 1, -1, -1) if labels[j] is not None][:1]
            after = [(j - k, labels[j]) for j in range(k + 1, len(labels)) if labels[j] is not None][:1]
            near = before + after
            if label is not None:
                want.append(label)
            elif len(near) < 2:
                want.append(near[0][1] if near else True)
            elif heads[k]:
                want.append(after[0][1])
            else:
                least = min(d for d, _ in near)
                want.append(any(x for d, x in near if d == least))
        assert pages.second_pass(labels, heads) == want


def test_pages_of_awkward_layouts():
    text = "the quick story of a man and his dog is told in the village by the sea and it was not the last one that they had"
    art = f"<h1>Title</h1><p>{text}</p><p>Short</p><p>{text}</p>"
    want = f"Title\n{text}\nShort\n{text}"
    assert pages.main_text(f'<div id="content" class="page no-sidebar"><article>{art}</article></div>') == want
    assert pages.main_text(f'<form id="aspnet"><main>{art}</main><div class="sidebar"><p>{text}</p></div></form>') == want
    assert pages.main_text(f'<div class="layout-sidebar-right">{art}</div><div class="sidebar"><p>{text}</p></div>') == want
    assert pages.main_text(f"<article>{art}</article><div id=comments><article><p>{text}</p></article></div>") == want
    code = "xyzzy plugh " * 20
    assert pages.main_text(f"<article><p>{text}</p><pre>{code}</pre></article><div>{code}</div>") == f"{text}\n{code.strip()}"
    links = "<a href=x>one two three four five six seven</a> " * 5
    assert pages.main_text(f"<p>{text}</p><p>{links}</p>") == text
    import time

    began = time.time()
    pages.main_text("<div>" * 100_000 + "</p>" * 100_000)
    assert time.time() - began < 20
    assert pages.main_text(PAGE) == pages.main_text(html.unescape(html.escape(PAGE)))


# --- licences: cosines and ancestors


def brute_cosine(line, templates):
    docs = [(n, licenses.terms(t)) for n, ts in templates.items() for t in ts]
    df = Counter(t for _, c in docs for t in c)
    weight = lambda t: math.log(1 + len(docs) / df[t]) if t in df else math.log(1 + len(docs))
    vector = lambda c: {t: n * weight(t) for t, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mine = vector(licenses.terms(line))
    best = (None, 0.0)
    for name, c in docs:
        v = vector(c)
        cosine = sum(x * v[t] for t, x in mine.items() if t in v) / ((length(mine) * length(v)) or 1)
        if cosine > 0 and (round(cosine, 9), [-ord(x) for x in name]) > (round(best[1], 9), [-ord(x) for x in best[0] or "~"]):
            best = (name, cosine)
    return best


def test_licence_cosines_against_plain_ones():
    rng = random.Random(3)
    own = licenses.Templates()
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    words = " ".join(lines).split() + SYLLABLES
    for line in lines + [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(150)]:
        name, cosine = own.best(line)
        want, value = brute_cosine(line, licenses.TEMPLATES)
        assert abs(cosine - value) < 1e-9 and (name == want or abs(cosine) < 1e-12)


def test_licence_inheritance_against_plain_ancestors(spark):
    rng = random.Random(7)
    files = []
    for k in range(120):
        depth = rng.randint(0, 4)
        path = "/".join([*(rng.choice("ab") for _ in range(depth)), f"f{k}"])
        own = rng.random()
        files.append((k, path, rng.choice(["MIT", "Apache-2.0", "GPL-3.0"]) if own < 0.2 else None, round(rng.random(), 3), "file" if own < 0.15 else "header" if own < 0.2 else "none"))
    got = licenses.inherit(spark.createDataFrame(files, "doc_id long, path string, license string, similarity double, evidence string"))
    of_dir = {}
    for _, path, name, cosine, evidence in files:
        if evidence == "file":
            folder = path.rpartition("/")[0]
            if folder not in of_dir or (cosine, [-ord(x) for x in name]) > (of_dir[folder][0], [-ord(x) for x in of_dir[folder][1]]):
                of_dir[folder] = (cosine, name)
    want = {}
    for k, path, name, _, evidence in files:
        if evidence != "none":
            want[k] = (name, evidence)
            continue
        parts = path.split("/")[:-1]
        up = next((of_dir["/".join(parts[:n])] for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in of_dir), None)
        want[k] = (up[1], "inherited") if up else (None, "none")
    assert {r.doc_id: (r.license, r.evidence) for r in got.collect()} == want


def test_licence_query_against_its_parts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_licenses(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        text = docs[k].text or ""
        if r.evidence == "header":
            lines = [x for x in re.split(r"\n|(?<=[.!?])\s+", text) if licenses.SPEAKS.search(x)]
            assert lines and r.similarity >= 0.6
        elif r.evidence == "none":
            assert r.license is None


# --- media: features and digests


def test_media_query_against_plain_digests(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_media(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id]
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        grid = [payload[64 * k : 64 * k + 64] for k in range(len(payload) // 64)]
        edge = [int(k * len(grid) / 8) for k in range(9)]
        cells = []
        for a, b in zip(edge, edge[1:], strict=False):
            for x in range(8):
                part = [v for row in grid[a:b] for v in row[8 * x : 8 * x + 8]]
                cells.append(sum(part) / max(1, b - a))
        bits = "".join("1" if v > sum(cells) / 64 else "0" for v in cells)
        assert r.feature == f"{int(bits, 2):016x}"


def test_media_of_long_keys_and_packed_partitions(spark):
    long = "k" * 70_000
    docs = spark.createDataFrame([(long, "a"), ("short", "b" * 200), (None, None)], "doc_id string, text string")
    manifest = media.write_archives(docs)
    got = {r.key: (r.n_bytes, media.from_png(bytes(r.media)).tobytes()[: r.n_bytes]) for r in media.read_archives(spark, manifest).collect()}
    assert got == {long: (1, b"a"), "short": (200, b"b" * 200), None: (0, b"")}
    many = media.write_archives(frame(spark, [f"text {k}" for k in range(60)]), archive_bytes=300)
    reader = media.ArchiveReader({"path": many, "rangebytes": 4000})
    parts = reader.partitions()
    n = spark.read.parquet(many).count()
    assert n > len(parts) > 1 and sum(len(p.ranges) for p in parts) >= n
    assert len(media.ArchiveReader({"path": many, "rangebytes": 10, "maxpartitions": 3}).partitions()) <= 4


def test_opening_an_archive_is_tried_again(tmp_path):
    from pyarrow import fs

    where, path = fs.LocalFileSystem(), str(tmp_path / "a.zip")
    out = media.ArchiveWriter(where, path)
    out.add(b"1:k", b"x")
    out.close()

    class Flaky:
        lost = 2

        def open_input_file(self, p):
            Flaky.lost -= 1
            if Flaky.lost >= 0:
                raise OSError("lost")
            return where.open_input_file(p)

    assert len(media.open_archive(Flaky(), path, 4, 0)[1]) == 1
    with pytest.raises(OSError):
        media.open_archive(where, str(tmp_path / "none.zip"), 2, 0)


# --- secrets: the spans that the chains add


def test_random_spans_against_plain_ratios(spark):
    rng = random.Random(9)
    model = secrets.fit_texts([prose(rng, 500)])
    alphabet = "".join(chr(c) for c in secrets.KEY_CHARS)
    code = {c: k + 1 for k, c in enumerate(alphabet)}
    texts = [prose(rng, 5) + " " + "".join(rng.choices(alphabet, k=rng.randint(4, 40))) + rng.choice([" ", ".", "é"]) + prose(rng, 3) for _ in range(200)]
    for least in (8, 16, 20):
        got = rows(secrets.scan(frame(spark, texts), model, min_length=least), "doc_id", "spans")
        for (_, spans), text in zip(got, texts, strict=True):
            want = []
            base = [(s.start, s.end) for s in spans if s.kind != "random"]
            for m in re.finditer(f"[{re.escape(alphabet)}]+", text):
                if len(m.group()) < least or any(a < m.end() and m.start() < b for a, b in base):
                    continue
                last, total = (0, 0), 0.0
                for c in m.group():
                    total += float(model.ratio[(last[0] * secrets.STATES + last[1]) * secrets.STATES + code[c]])
                    last = (last[1], code[c])
                if total / len(m.group()) >= 0.6 and total >= 16.0:
                    want.append((m.start(), m.end()))
            assert [(s.start, s.end) for s in spans if s.kind == "random"] == want


# --- token shards: any vocabulary


@pytest.mark.parametrize("first", [300, 65_535, 65_536, 128_000, 4_000_000_000])
def test_grammars_compress_with_any_vocabulary(first):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, min(first, 2**31), 6) for _ in range(50)]
    seq = np.concatenate([words[k] for k in rng.integers(0, 50, 4000)]).astype(np.uint32)
    ends = np.array([len(seq) // 3, len(seq)])
    rules, symbols, cut = tokens.compress(seq, ends, first)
    grammar = tokens.Grammar(tokens.unpack(tokens.pack(rules.ravel())).reshape(-1, 2), tokens.expansion_lengths(rules, first), first)
    assert len(rules) > 50 and len(symbols) < len(seq) / 3
    assert (grammar.expand(tokens.unpack(tokens.pack(symbols))) == seq).all()
    pairs = Counter(p for a, b in zip([0, *cut], cut, strict=False) for p in zip(symbols[a:b][:-1].tolist(), symbols[a:b][1:].tolist(), strict=True) if p[0] != p[1])
    assert max(pairs.values()) < 16  # the grammar is closed


def test_a_tokenizer_that_splits_otherwise_is_refused(monkeypatch):
    monkeypatch.setattr(tokens.SplitEncoder, "one", lambda self, text: b"")
    with pytest.raises(ValueError):
        tokens.SplitEncoder(queries.tokenizer_file("byte_bpe_50k.json"))


# --- decontamination: large blocks


def test_windows_of_a_large_benchmark_stay_small():
    import pickle

    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(30_000)]
    items = [(str(k % 1500), " ".join(rng.choices(vocab, k=150)).encode()) for k in range(2000)]
    items += items[:200] + [("loop", b"a b " * 100_000)]
    w = contamination.Windows(items, 10, 5)
    assert len(w.start) == sum(141 for _ in range(2000)) + 2
    w.prefix(np.ones(len(w.codes), np.int64))
    assert len(pickle.dumps(w)) < 100 * sum(len(t) for _, t in items) // 6


# --- session and awkward cases of all operators


def test_the_session_keeps_its_settings(spark):
    file = queries.tokenizer_file("byte_bpe_50k.json")
    path = tokens.write_shards(frame(spark, AWKWARD), file)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tokens.read_shards(spark, path).count() == len(AWKWARD)
    neardup.near_duplicates(frame(spark, AWKWARD)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before == "1000"


LONG = "a long tale " + prose(random.Random(1), 15_000) + " a tale of words that go on a long tale of words"


def each_operator(spark, docs):
    """Rows of every operator's result on a frame of documents."""
    bench = spark.createDataFrame([(1, "a tale of words that go on a long tale of words")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_texts([b"good words here", b"bad words here"] * 5, [0, 1] * 5)
    profiles = language.fit_texts(["a tale of words", "ein wort und mehr"], ["en", "de"])
    chains = secrets.fit_texts(["plain words"])
    files = docs.withColumn("path_", F.concat(F.lit("a/"), F.col("doc_id")))
    web = docs.withColumnsRenamed({"text": "html_"}).withColumn("url_", F.lit("u"))
    bpe, sp = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
    assert isinstance(toxicity.fit(docs, labels), toxicity.Model) and language.fit(docs) is not None and secrets.fit(docs) is not None
    return {
        "windows": contamination.find_windows(docs, bench),
        "clean": contamination.keep_clean(docs, bench),
        "shards": tokens.read_shards(spark, tokens.write_shards(docs, bpe)),
        "secrets": secrets.scan(docs, chains),
        "redacted": secrets.redact_documents(docs, chains),
        "media": media.describe(media.read_archives(spark, media.write_archives(docs))),
        "scores": toxicity.score(docs, model),
        "languages": language.classify(docs, profiles),
        "pages": pages.extract(web, "doc_id", "url_", "html_"),
        "pieces": pieces.encode(docs, sp),
        "licences": licenses.scan(files, "path_"),
        "neardup": neardup.near_duplicates(docs),
        "similar": overlap.similar(docs),
    }


@pytest.mark.parametrize("kind", ["empty", "nulls", "long and repeated"])
def test_awkward_cases_of_every_operator(spark, kind):
    texts = {"empty": [], "nulls": [None, "", None], "long and repeated": [LONG, LONG, LONG + " x", "short", None, "x " * 60_000]}[kind]
    docs = frame(spark, texts, doc="clash", text_="clash", label="clash", lang_pred="clash", h="clash", cls="clash", root="clash")
    n = len(texts)
    for name, out in each_operator(spark, docs).items():
        got = out.collect()
        if name == "clean":
            assert len(got) == sum(t is None or not t.startswith("a long") for t in texts) and out.columns == docs.columns
        else:
            assert len(got) == n, name
        if name == "redacted":
            assert out.columns == docs.columns and sorted((r.text or "") for r in got) == sorted(t or "" for t in texts)
        if name in ("neardup", "similar") and kind == "long and repeated":
            key = "component_id" if name == "neardup" else "root"
            groups = defaultdict(set)
            for r in got:
                groups[r[key]].add(r.doc_id)
            assert {0, 1, 2} in groups.values()

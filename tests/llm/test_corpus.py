"""Corpus operators against brute force, exact round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillforge.llm import contamination, language, licenses, media, neardup, overlap, pages, pieces, queries, secrets, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an ber ci do en fu ga he in jo ka lo mi no or pa qu re so ti".split()


def prose(rng, n, vocab=None):
    return " ".join(rng.choice(vocab) if vocab else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


AWKWARD = [None, "", "   \n\t", "a", "a", "ß Ünï 日本 😀", "x" * 50_000, "the the the the the the the the the the the the", "\x00\x1f|", "é" * 300]


def frame(spark, texts, **extra):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # columns of names that the operators use themselves
    return df.withColumns({c: F.lit("clash") for c in ("spans", "items", "fp", "score", "part", "mask", "ids", "path", "key", "start", *extra)})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is not None, r[0]))


# --- decontamination


def brute_windows(text, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    ws, hit, found = pattern.findall(low(text)), set(), set()
    for item, t in items:
        iw = pattern.findall(low(t))
        for i in range(max(1, len(iw) - size + 1) if iw else 0):
            w = iw[i : i + size]
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "Dé", "e5"]
    items = [(k, prose(rng, rng.choice([0, 1, 2, 4, 9, 10, 11, 14]), vocab)) for k in range(25)] + [(90, None), (91, "A B A B A B A B A B A B"), (92, "a b a b a b a b a b a b")]
    texts = [prose(rng, rng.randint(0, 60), vocab) for _ in range(40)] + ["x " + items[-1][1].upper() + " y", *AWKWARD]
    texts += [f"{prose(rng, 5)}, {items[k][1]}. {prose(rng, 3)}" for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    want = [(k, *brute_windows(t, items)) for k, t in enumerate(texts)]
    for block in (8 << 20, 200):
        got = contamination.find_windows(docs, bench, block_bytes=block)
        assert rows(got, "doc_id", "n_words", "n_hit", "items") == want
        clean = contamination.keep_clean(docs, bench, block_bytes=block)
        assert {r.doc_id for r in clean.collect()} == {k for k, _, n, _ in want if not n}
    assert clean.columns == docs.columns
    for span in got.where("n_hit > 0").collect():
        assert sum(s.end - s.start for s in span.spans) == span.n_hit


def test_items_without_an_id(spark):
    rng = random.Random(3)
    passage, named = prose(rng, 14), prose(rng, 12)
    docs = frame(spark, [prose(rng, 30), prose(rng, 5) + " " + passage + " " + prose(rng, 5), named + " " + passage])
    items = spark.createDataFrame([(None, passage), (9, named), (None, named)], "item_id long, text string")
    got = rows(contamination.find_windows(docs, items), "doc_id", "n_hit", "items")
    assert got == [(0, 0, []), (1, 14, []), (2, 26, ["9"])]
    assert [r.doc_id for r in contamination.keep_clean(docs, items).collect()] == [0]


def test_windows_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination.find_windows(frame(spark, AWKWARD), empty).collect()} == {0}
    assert contamination.find_windows(frame(spark, []), empty).count() == 0


# --- SimHash


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    label = dict(zip(ids, ids, strict=True))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(ids[a]), root(ids[b])))
                label[y] = x
    return {i: root(i) for i in ids}


def test_neardup_against_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(30)]
    texts = base + base[:9] + [t + " end" for t in base] + [t.upper() for t in base[:4]] + AWKWARD
    docs = frame(spark, texts)
    got = rows(neardup.near_duplicates(docs), "doc_id", "fp", "component_id")
    fps = [brute_fingerprint(t) for t in texts]
    assert [f % 2**64 for _, f, _ in got] == fps
    want = brute_components(range(len(texts)), fps)
    assert [c for _, _, c in got] == [want[k] for k in range(len(texts))]
    kept = neardup.keep_first(docs.union(docs.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_of_crowded_fingerprints(spark, tile):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(120)} | {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = neardup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)
    assert all(((a ^ b) % 2**64).bit_count() <= 64 for a, b in edges.collect())
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    want = brute_components(signed, fps)
    same = lambda of: {frozenset(x for x in signed if of(x) == g) for g in {of(x) for x in signed}}
    assert same(lambda x: got.get(x, x)) == same(lambda x: want[x])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (7, 3)], "a long, b long")
    assert {r.root for r in neardup.components(edges).collect()} == {0}
    assert neardup.components(edges.limit(0)).count() == 0


def brute_overlap(texts, similarity=0.8):
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    return label


@pytest.mark.parametrize("tile", [8, 1024])
def test_overlap_against_brute_force(spark, tile):
    rng = random.Random(6)
    texts = list(AWKWARD)
    line = prose(rng, 12)  # a line that many texts share
    for n in (3, 8, 20, 60, 150, 400):
        for _ in range(6):
            ws = prose(rng, n).split()
            texts.append(" ".join(ws))
            for edits in (1, 2, n // 40 + 1, n // 25 + 1):
                other = list(ws)
                for k in rng.sample(range(n), min(edits, n)):
                    other[k] = "edited" + str(rng.random())
                texts.append(" ".join(other))
            texts.append(line + "\n" + " ".join(ws[: n // 2]))
    ws = prose(rng, 80).split()
    texts += [" ".join([*ws[:k], f"x{k}", *ws[k + 1 :]]) for k in range(40)]  # one large group of near copies
    want = brute_overlap(texts)
    got = {r.doc_id: r.root for r in overlap.similar(frame(spark, texts), tile=tile, lags=2).collect()}
    assert len({(got[k], want[k]) for k in got}) == len(set(got.values())) == len(set(want))


def test_fingerprints_decide_pairs_within_their_radius(monkeypatch):
    rng = random.Random(16)
    texts = []
    for _ in range(40):
        ws = prose(rng, 60).split()
        texts += [" ".join(ws), " ".join([*ws[:55], "edited", *ws[56:]]), " ".join([*ws[:20], "edited", *ws[21:]])]
    every = [neardup.shingle_hashes(t.encode(), 5) for t in texts]
    sets, fps = [np.unique(h) for h in every], [neardup.majority(h) for h in every]
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
    cols = {
        "cls": np.array(order), "n": np.array([len(sets[k]) for k in order]), "pos": np.zeros(len(order), np.int64),
        "fp": np.array([fps[k] for k in order], np.uint64), "parity": np.array([overlap._parity(sets[k]) for k in order]).view(np.uint64),
    }
    got = lambda radius: {p for a, b in overlap._near(np.ones(len(order)), cols, 0.8, None, radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b)) - 1e-9}
    assert len(want) >= 80 and all(want <= got(radius) for radius in (-1, 0, 8, 16, 64))  # no link is lost at any radius
    near = {(a, b) for a, b in want if (fps[a] ^ fps[b]).bit_count() <= 8}
    none = np.empty(0, np.int64)
    with monkeypatch.context() as m:
        m.setattr(overlap, "_fingerprint_pairs", lambda *_: (none, none))
        assert near and want & got(8) == want - near  # nothing else finds them
    with monkeypatch.context() as m:
        m.setattr(overlap, "_distant_pairs", lambda *_: (none, none))
        assert near != want and want & got(8) == near


@pytest.mark.parametrize("radius", [-1, 6])
def test_overlap_of_any_radius(spark, radius):
    rng, texts = random.Random(17), list(AWKWARD)
    for _ in range(8):
        ws = prose(rng, 60).split()
        texts += [" ".join(ws), " ".join([*ws[:55], "edited", *ws[56:]]), " ".join([*ws[:20], "edited", *ws[21:]])]
    want = brute_overlap(texts)
    got = {r.doc_id: r.root for r in overlap.similar(frame(spark, texts), radius=radius).collect()}
    assert len({(got[k], want[k]) for k in got}) == len(set(got.values())) == len(set(want))


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(7)
    ws = prose(rng, 120).split()
    docs = frame(spark, [" ".join(ws), " ".join([*ws[:60], "edited", *ws[61:]]), prose(rng, 120)])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("module", [neardup, overlap])
def test_ids_with_different_texts(spark, module):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows_ = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, c), (8, d), (None, a), (None, a)]
    kept = module.keep_first(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3))
    want = [(1, a), (5, b), (7, c), (7, d), (None, a), (None, a)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


def test_overlap_of_an_empty_table(spark):
    assert overlap.keep_first(frame(spark, [])).count() == 0


def test_neardup_of_an_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "q r s t u")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in neardup.near_duplicates(nulls).collect()) == ["4", "None", "None"]


# --- token shards


def test_token_shards_round_trip(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(60)] + AWKWARD + ["say <|endoftext|> now", "it's  we'll\r\n ok ½²"]
    file = queries.tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    docs = frame(spark, texts).union(frame(spark, texts[:2]))
    path = tokens.write_shards(docs, file, shard_ids=3000)
    got = sorted(tuple(r) for r in tokens.read_shards(spark, path).collect())
    start, want = 0, []
    for k, t in sorted([*enumerate(texts), *enumerate(texts[:2])], key=lambda x: x[0]):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    shards = spark.read.parquet(path).collect()
    assert len(shards) > 3 and any(len(s.rules) > 1 for s in shards)
    for s in shards[:3]:
        for k, key in enumerate(s.doc_ids):
            ids = tokens.decode_document(s.asDict(), k)
            assert ids.tolist() == [*lib.encode(texts[key] or "", add_special_tokens=False).ids, 0]
    assert tokens.read_shards(spark, tokens.write_shards(frame(spark, []), file)).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for n, v in ((1, 3), (5000, 2), (20_000, 5), (4000, 4000), (3000, 1)):
        seq = rng.integers(0, v, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n + 1, 7), n))
        rules, symbols, cut = tokens.compress(seq, ends, 10_000, least=4)
        grammar = tokens.Grammar(rules, tokens.expansion_lengths(rules, 10_000), 10_000)
        assert grammar.expand(symbols).tolist() == seq.tolist()
        assert [len(grammar.expand(symbols[:c])) for c in cut] == ends.tolist()


# --- secrets


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "  ", "é", "😀", "ſecret", "toKen", "abcdef", "AKIA"]
    bits += ["ABCD0123EFGH4567", "0123456789abcdef", "deadbeef", "x", "/", ".", "\n", "hello", "AKIAAKIA"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(600)] + AWKWARD
    model = secrets.fit_texts([prose(rng, 300)])
    got = rows(secrets.scan(frame(spark, texts), model), "doc_id", "spans")
    for (_, spans), text in zip(got, texts, strict=True):
        assert [tuple(s) for s in spans if s.kind != "random"] == brute_base(text or "")
        base = [s for s in spans if s.kind != "random"]
        assert not any(s.start < b.end and b.start < s.end for s in spans if s.kind == "random" for b in base)


def test_markov_models_on_held_out_strings(spark):
    rng = random.Random(11)
    plain = [w for w in prose(rng, 4000).split() if len(w) > 4]
    model = secrets.fit_texts([" ".join(plain[:2000])])
    fresh = secrets.generated(500, seed=99)
    found = sum(bool(secrets.spans_of(f"see {s.decode()} there", model, 16, 0.6, 16.0)) for s in fresh)
    words = ["".join(rng.choices(SYLLABLES, k=9)) for _ in range(500)]
    assert found > 450 and sum(bool(secrets.spans_of(f"see {w} there", model, 16, 0.6, 16.0)) for w in words) < 10
    docs = spark.createDataFrame([(1, "key é q8Zr2LwP0xTn5VbYk3Jd end", 0), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in secrets.redact_documents(docs, model).collect()}
    assert out[1].text == "key é [random] end" and out[1].n_chars == 18 and out[2].text is None and out[3].text == "plain"
    assert secrets.fit(docs.limit(0)) is not None and secrets.scan(docs.limit(0), model).count() == 0


# --- media


def test_media_round_trip(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(40)] + AWKWARD
    docs = frame(spark, texts).union(frame(spark, texts[:1]))
    manifest = media.write_archives(docs, archive_bytes=3000)
    assert spark.read.parquet(manifest).count() > 3
    got = media.describe(media.read_archives(spark, manifest, rangebytes=700, batchbytes=500)).collect()
    assert len(got) == len(texts) + 1
    by_text = {}
    for r in got:
        data = (texts[int(r.key)] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(data, tuple(r[3:])) == tuple(r[3:])
    assert media.read_archives(spark, media.write_archives(frame(spark, []))).count() == 0


def test_members_are_retried_alone(tmp_path):
    from pyarrow import fs

    where, path = fs.LocalFileSystem(), str(tmp_path / "a.zip")
    out = media.ArchiveWriter(where, path)
    for k in range(3):
        out.add(f"{k}:k{k}".encode(), bytes([k]) * 100)
    out.close()

    class Flaky:
        opened = 0

        def open_input_file(self, p):
            Flaky.opened += 1
            return where.open_input_file(p)

    class Broken:
        def seek(self, at):
            raise OSError("lost")

    members = media.read_directory(where.open_input_file(path))
    data, _ = media.read_member(Flaky(), path, Broken(), members[1], tries=3, wait=0)
    assert data == b"\x01" * 100 and Flaky.opened == 1
    with pytest.raises(OSError):
        media.read_member(Flaky(), path, where.open_input_file(path), (b"x", members[1][1], 100, 7), tries=2, wait=0)


# --- classifiers


def test_toxicity_features(monkeypatch):
    """Blocks give what the whole text gives, and what a plain count of n-grams gives; marks and case don't matter."""
    text = ("Ça VA, idiot!! x" * 300).encode()
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    parts = toxicity.features(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    b = "".join(map(chr, toxicity.plain(text)))
    assert b.startswith(" ça va idiot x") and b.endswith(" ")
    grams = [b[k : k + n] for n in toxicity.ORDERS for k in range(len(b) - n + 1)]
    assert (2 ** parts[1] - 1).sum().round() == len(grams) and len(parts[0]) <= len(set(grams))
    assert (toxicity.features(b"an IDIOT!")[0] == toxicity.features(b"An -- idiot")[0]).all()
    assert len(toxicity.features(b"")[0]) == 0 == len(toxicity.features(b"?")[0])


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        ws = prose(rng, rng.randint(20, 200)).split()
        for _ in range(3 if bad else 0):
            ws[rng.randrange(len(ws))] = rng.choice(["vilegrub", "snarkoid"])
        texts.append(" ".join(ws))
        labels.append((k, int(bad)))
    docs = frame(spark, texts + AWKWARD)
    train = spark.createDataFrame([(k, y) for k, y in labels if k < 400] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, train)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((got[k] >= 0.3) == bool(y) for k, y in labels if k >= 400)
    assert right >= 195 and len(got) == len(texts) + len(AWKWARD) and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.3 for s in got.values())
    none = toxicity.fit(docs, train.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    got = language.classify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id")
    wrong = got.where("lang <> lang_pred").count()
    assert wrong <= 0.03 * got.count()
    odd = rows(language.classify(frame(spark, [None, "", "12 !", "日本"]), model), "doc_id", "lang_pred", "score")
    assert [r[1] for r in odd[:3]] == ["und"] * 3 and odd[0][2] == 0.0 and odd[3][1] in model.names
    assert {r.lang_pred for r in language.classify(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_every_language_gets_a_profile(spark):
    rng = random.Random(11)
    vocab = {f"l{k}": [prose(rng, 1) for _ in range(30)] for k in range(8)}
    copied = [(prose(rng, 20, v), name) for name, v in vocab.items()]
    docs = spark.createDataFrame(copied, "text string, lang string").crossJoin(spark.range(3000)).drop("id")
    long = [(prose(rng, 6000, vocab["l0"]), "long") for _ in range(3)]
    assert all(len(t) > 20_000 for t, _ in long)
    got = language.fit(docs.union(spark.createDataFrame(long, "text string, lang string")))
    assert got.names == sorted([*vocab, "long"])


def test_language_profiles_rank_by_count():
    assert language.most_frequent(np.array([5, 5, 9, 9, 9, 1], dtype=np.uint64), 2).tolist() == [9, 5]
    assert len(language.grams("ab c")) == 3 + 5 + 3


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav class="x"><ul><li><a href="/a">one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>A &amp; B</h1><p><b>First  line<br>goes on<p>Second &quot;x&quot;&nbsp;y</p><div class="ad">Buy</div><form><p>Mail</p></form>
<p>Read <a href="/z">this and that and these and those</a></p><p title="a>b">Third.</p>
<div id="comments"><p>reader says the of and to a in is it that for on with as was by be this are at</p></div></article>
<aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_pages_of_an_article():
    assert pages.main_text(PAGE) == 'A & B\nFirst line goes on\nSecond "x" y\nThird.'


def test_pages_without_a_declared_article(spark):
    text = "the quick story of a man and his dog is told in the village by the sea and it was not the last one that they had"
    page = f"<div>Home</div><div><a href=x>One</a> <a href=y>Two</a></div><p>Short lead</p><p>{text}</p><p>Ending</p><p>{text}</p><div><a href=q>More</a></div>"
    assert pages.main_text(page) == f"Short lead\n{text}\nEnding\n{text}"
    got = spark.createDataFrame([(1, "u", page), (2, None, None), (2, "v", ""), (3, "w", "<p><script>x")], "page_id long, url string, html string")
    out = rows(pages.extract(got.withColumn("text", F.lit(1))), "page_id", "n_chars")
    assert out == [(1, 2 * len(text) + len("Short lead") + len("Ending") + 3), (2, 0), (2, 0), (3, 0)]


def test_second_pass_takes_the_nearest_neighbour():
    assert pages.second_pass([True, None, None, False], [False] * 4) == [True, True, False, False]
    assert pages.second_pass([None, True, None, True, None], [False] * 5) == [True] * 5
    assert pages.second_pass([None, None], [False] * 2) == [True, True]


# --- pieces


def test_pieces_equal_the_library(spark):
    file = queries.tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(8)
    bits = list(" abcthe  .\n\t日本ｶ😀éß0123,;²%") + [" the", " in", "ing", "   ", "\x00", "</s>", "<0x41>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(1500)] + [prose(rng, 60) for _ in range(40)] + AWKWARD
    texts += [" " * k + "a" for k in range(40)]
    out = pieces.encode(frame(spark, texts), file)
    got = rows(out, "doc_id", "ids", "exact")
    assert [ids for _, ids, _ in got] == [lib.encode(t or "") for t in texts]
    assert all(e for _, _, e in got)
    back = rows(pieces.decode(out, file), "doc_id", "text")
    assert [t for _, t in back] == [t or "" for t in texts]


def test_pieces_of_texts_without_spaces():
    """Cut points, joined windows, and the heap for what windows can't join, on up to a megabyte."""
    file = queries.tokenizer_file("piece_bpe_32k.model")
    own, lib, rng = pieces.PieceCodec(file), sentencepiece.SentencePieceProcessor(model_file=file), random.Random(5)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50_000))
    for text in (letters, han, "x" * 40_000, "=" * 3001, "ab" * 9000, "theaaab" * 4001, "é😀" * 3000, "word" * 200 + " " + "y" * 700):
        ids = np.frombuffer(own.encode([text])[0], "<u4")
        assert ids.tolist() == lib.encode(text) and own.decode(ids.astype(np.int64)) == text
    assert not any(len(w) > pieces.KEPT for w in own.words)
    for word in ("x" * 700, letters[:900], "theaaab" * 100):
        assert own._ids(word, *own._merged(word)) == own.segment({word})[word]


def test_a_model_that_merges_otherwise_is_refused(monkeypatch):
    monkeypatch.setattr(pieces.PieceCodec, "encode", lambda self, lines: [b"" for _ in lines])
    with pytest.raises(ValueError):
        pieces.PieceCodec(queries.tokenizer_file("piece_bpe_32k.model"))


def test_pair_check_equals_merging():
    own = pieces.codec(queries.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(1)
    pool = [i for p, i in own.normal.items() if i in own.whole and pieces.MARK * 2 not in p]
    pairs = [(rng.choice(pool), rng.choice(pool)) for _ in range(3000)]
    for p in rng.sample([p for p in own.normal if len(p) > 3 and p.count(pieces.MARK) < 2], 500):
        cut = rng.randrange(1, len(p))
        if p[:cut] in own.normal and p[cut:] in own.normal:
            pairs.append((own.normal[p[:cut]], own.normal[p[cut:]]))
    a, b = np.array(pairs).T
    want = [own.merge(own.pieces[x] + own.pieces[y]) == [own.pieces[x], own.pieces[y]] for x, y in pairs]
    assert own.compatible(a, b).tolist() == want


# --- licenses


def test_licenses_and_inheritance(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    files = [
        (1, "a/LICENSE", mit, None),
        (2, "a/b/c/x.py", "print(1)", None),
        (3, "a/b/LICENSE", licenses.TEMPLATES["Apache-2.0"][1], None),
        (4, "a/y.py", "# Licensed under CC BY-NC 4.0.\n" + "code " * 300, None),
        (5, "z/q.py", None, None),
        (6, "top.py", "", None),
        (7, None, "x", None),
        (2, "a/b/c/x.py", "print(1)", None),
        (8, "a/d/w.py", "the licence of a poet is a long and winding tale " * 9, None),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, license string")
    got = rows(licenses.scan(df), "doc_id", "license", "evidence", "license_dir")
    assert got == [
        (1, "MIT", "file", "a"),
        (2, "Apache-2.0", "inherited", "a/b"),
        (2, "Apache-2.0", "inherited", "a/b"),
        (3, "Apache-2.0", "file", "a/b"),
        (4, "CC-BY-NC-4.0", "header", None),
        (5, None, "none", None),
        (6, None, "none", None),
        (7, None, "none", None),
        (8, "MIT", "inherited", "a"),
    ]
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_licences_and_identifiers(spark):
    apache = licenses.whole_texts()["Apache-2.0"][0]
    files = [
        (1, "a/LICENSE", apache),
        (2, "a/b/x.py", "print(1)"),
        (3, "n/NOTICE", " ".join([licenses.TEMPLATES["Apache-2.0"][1]] * 700)),
        (4, "n/x.py", ""),
        (5, "m/LICENSE", "Copyright (c) 2020 Some Body\n\n" + licenses.whole_texts()["MIT"][0]),
        (6, "s/a.c", "// SPDX-License-Identifier: MIT\n" + "int x; " * 200),
        (7, "s/b.c", "/* SPDX-License-Identifier: Apache-2.0 */\n" + "int x; " * 200),
        (8, "s/c.c", "# SPDX-License-Identifier: GPL-2.0-or-later\n" + "int x; " * 200),
        (9, "s/d.c", "# SPDX-License-Identifier: Own-Name\n" + "int x; " * 200),
    ]
    got = rows(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")), "doc_id", "license", "evidence")
    assert got == [
        (1, "Apache-2.0", "file"),
        (2, "Apache-2.0", "inherited"),
        (3, "Apache-2.0", "file"),
        (4, "Apache-2.0", "inherited"),
        (5, "MIT", "file"),
        (6, "MIT", "header"),
        (7, "Apache-2.0", "header"),
        (8, "GPL-2.0", "header"),
        (9, None, "none"),
    ]


# --- queries and pipeline


def test_windows_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op1_decontamination"]).df()
    got = queries.op1_decontamination(spark, sf).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), want.sort_values("doc_id", ignore_index=True), check_dtype=False)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        frames[name] = now
        if name != "pieces":
            assert now.columns == docs.columns
    ids = {name: {r.doc_id for r in f.select("doc_id").collect()} for name, f in frames.items()}
    start = {r.doc_id for r in docs.select("doc_id").collect()}
    scored = queries.op5_toxicity(spark, sf).where("predicted = 0").collect()
    assert ids["toxicity"] == {r.doc_id for r in scored} <= start
    texts = {r.doc_id: r.text for r in frames["toxicity"].collect()}
    label = dict(zip(sorted(texts), brute_overlap([texts[k] for k in sorted(texts)]), strict=True))  # five words, 0.8 or more
    assert ids["near-duplicates"] == {min(k for k in label if label[k] == x) for x in set(label.values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {k for k in ids["near-duplicates"] if not brute_windows(texts[k], items)[1]}
    assert ids["secrets"] == ids["decontamination"] == ids["pieces"]
    for r in frames["secrets"].collect():
        assert not brute_base(r.text) or "[" in r.text
    got = {r.doc_id: (r.ids, r.exact) for r in corpus_pipeline.run(spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {r.doc_id: r.ids for r in frames["pieces"].collect()} and all(e for _, e in got.values())

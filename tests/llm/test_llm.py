import functools
import hashlib
import re
import zlib

import numpy as np
import pytest

SAMPLE = [(5, "The quick brown fox's naïve 2½ plans, don't stop!\n\nNext  line"), (3, ""), (9, None), (7, "x" * 3000), (1, "héé日本 ٣ Σας İ " * 40), (12, "a b c d e f g"), (12, "a b c d e f g"), (-4, " lead")]

BIG = (1 << 60) + 1  # beyond what a double holds


@functools.cache
def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text, end):
    return np.array(library(name).encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoder_equals_the_library(name):
    from quadrille.llm.tokens import CachedEncoder, vocabulary_path

    enc = CachedEncoder(vocabulary_path(name), cap=20)
    import random

    rnd = random.Random(1)
    bits = ["The", " ", "  ", "\n", " \n", "don't", "'s", "é", "É", "日本", "\t", "\x1c", "\0", "Σας", "İ", "...", ", ", "12", "½", "a", "ﬁ", "\u0301", "<|endoftext|>", "\xa0", "　", " x", "'ll", "_", "\r\n", "\x85", "😀", "Ġ", "ǅ", "'re", "'S", "x" * 300]
    mixed = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    mixed += [t for t in ("".join(rnd.choice([b for b in bits if max(b) < "Ā"]) for _ in range(12)) for _ in range(1500))]
    texts = mixed + [t or "" for _, t in SAMPLE] + ["a\x1cb c", "<|endoftext|> hi", "x'll'd' 's", "tab\t\tend ", "ﬁ ẞ Ǆ ½²³", "a   b\n c"]
    for step in (500_000, 300):
        for text, raw in zip(texts, enc.encode(texts, step)):
            assert (np.frombuffer(raw, "<u2") == ids_of(name, text, 0)[:-1]).all(), text


def test_wavelet_matrix_queries():
    from quadrille.llm.wavelet import WaveletMatrix

    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 5000):
        ids = rng.integers(0, 300, n).astype(np.uint16)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes())
        assert (m.tokens() == ids).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (m.access(at) == ids[at]).all()
        for token in (0, 7, 299, 65000):
            where = np.flatnonzero(ids == token)
            assert m.count(token) == len(where)
            assert m.rank(token, n // 2) == (where < n // 2).sum()
            assert [m.select(token, k) for k in range(min(3, len(where)))] == where[:3].tolist()
            assert m.select(token, len(where)) == -1


def test_op1_round_trip(docs_of):
    from quadrille.llm.wavelet import count_tokens, find_token, read_digests, write_shards

    sample = SAMPLE + [(None, "no id"), (BIG, "big"), (BIG + 1, "bigger"), (BIG + 1, "bigger")]
    rows = sorted(((-(1 << 62) if d is None else d, ids_of("word_bpe_49k.json", t, 2)) for d, t in sample), key=lambda x: x[0])
    files = write_shards(docs_of(sample), shard_tokens=100)
    got = sorted((-(1 << 62) if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["n_end"]) for r in read_digests(files).collect())
    want, at = [], 0
    for d, ids in rows:
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes()), int((ids == 2).sum())))
        at += len(ids)
    assert got == want
    every = np.concatenate([ids for _, ids in rows])
    tokens = [2, int(every[0]), 49000]
    assert {r["token"]: r["n"] for r in count_tokens(files, tokens).collect()} == {t: int((every == t).sum()) for t in tokens}
    found = sorted(r["position"] for r in find_token(files, tokens[1]).collect())
    assert found == np.flatnonzero(every == tokens[1]).tolist()
    assert read_digests(write_shards(docs_of([]))).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block", [512, 3])
def test_op2_equals_brute_force(docs_of, block):
    from quadrille.llm.minhash import near_duplicates

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = rng.choice(words, 90).tolist()
        for _ in range(12):
            t = list(base)
            for k in rng.integers(0, 90, rng.integers(0, 5)):
                t[k] = str(rng.choice(words))
            rows.append((len(rows) * 3 + g, " ".join(t)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(5)] + [(2000, ""), (2001, None), (2002, "two words"), (2003, "Two  WORDS"), (2004, " \t ")]
    got = {r["doc_id"]: r for r in near_duplicates(docs_of(rows), block=block).collect()}
    want = brute_components(rows)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_op2_repeated_and_large_ids(docs_of):
    from quadrille.llm.minhash import near_duplicates

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a + " more"
    for rows in ([(1, a), (1, b), (2, near)], [(1, b), (1, a), (2, near)], [(2, near), (1, b), (1, a)]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["first"]) for r in near_duplicates(docs_of(rows)).collect())
        assert got == [(1, 56, 1, True, True), (1, 56, 1, True, True), (2, 57, 1, False, False)]
    rows = [(None, a), (None, a), (BIG, a), (BIG + 1, near), (BIG + 2, b)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {(None, None, True), (BIG, BIG, True), (BIG + 1, BIG, False), (BIG + 2, BIG + 2, True)}


def test_op2_compares_leaders_first(docs_of):
    """A band's members that its leader links go no further; those that it doesn't link are compared with all others."""
    from quadrille.llm.minhash import near_duplicates

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(3)]
    for i in range(40):
        t = list(base)
        for k in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, 100))] = f"x{i}-{k}"
        rows.append((100 + i, " ".join(t)))
    for chain in range(10):  # each like the one before it, ever less like the first
        t = base[: 100 - 3 * chain] + [f"y{k}" for k in range(3 * chain)]
        rows.append((500 + chain, " ".join(t)))
    want = brute_components(rows)
    for block in (512, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_of(rows), block=block).collect()}
        assert got == want


def test_op2_edges(docs_of):
    from quadrille.llm.minhash import near_duplicates

    assert near_duplicates(docs_of([])).count() == 0
    (row,) = near_duplicates(docs_of([(None, "a b c d e f")])).collect()
    assert row["component_id"] is None and row["kept"]


def test_op2_components_of_small_and_large_graphs(spark, monkeypatch):
    """One task joins a small graph, rounds a large one and end as soon as there are stars only: alike, in few tables."""
    from quadrille.llm import common, minhash

    written = []
    write = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name, *a: written.append(name) or write(df, name, *a))
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    graphs = {"random": [tuple(x) for x in rng.integers(0, 400, (300, 2)).tolist()] + chain + [(7, 7), (2000, 2000)], "star": [(5, i) for i in range(6, 60)], "none": []}
    for name, pairs in graphs.items():
        parent = {x: x for p in pairs if p[0] != p[1] for x in p}

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for u, v in pairs:
            if u != v:
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        want = sorted((b"%06d" % x, b"%06d" % root(x)) for x in parent)
        edges = spark.createDataFrame([(b"%06d" % u, b"%06d" % v) for u, v in pairs], "u binary, v binary").repartition(3)
        for small, most in ((1000, 1), (-1, 1 if name != "random" else 19)):
            written.clear()
            got = sorted((bytes(r["node"]), bytes(r["root"])) for r in minhash.components(edges, "t", small).collect())
            assert got == want and len(written) <= most, (name, small, written)


def test_op3_scan_equals_one_pass_and_decodes(docs_of):
    from quadrille.llm.pieces import MODEL, Pieces, decode, encode, product, states
    from quadrille.llm.tokens import vocabulary_path

    m = Pieces(vocabulary_path(MODEL))
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = " " + "".join(rng.choice(["a", "b", " ", "   ", "th", "the", "ing", "é", "\n", "😀", "inter", "national"], rng.integers(1, 60)))
        size = int(rng.choice([1, 3, 7, 20, 50]))
        parts = [(text[k : k + size + m.longest - 1], min(size, len(text) - k)) for k in range(0, len(text), size)]
        matrices = np.stack([m.transfer(p, n) for p, n in parts])
        ends = states(np.stack([product(matrices[k : k + 3]) for k in range(0, len(matrices), 3)]))
        at = np.concatenate([states(matrices[k : k + 3], ends[k // 3], ends[k // 3 + 1])[:-1] for k in range(0, len(matrices), 3)] + [[0]])
        ids = b"".join(m.trace(p, n, at[k], at[k + 1]) for k, (p, n) in enumerate(parts))
        score = sum(matrices[k, at[k], at[k + 1]] for k in range(len(parts)))
        assert score == pytest.approx(m.best(text, 0, len(text), len(text))[0]) == pytest.approx(m.whole(text)[1])
        assert m.decode(np.frombuffer(ids, "<u2")).decode() == text[1:]
    rows = [(i, t) for i, (_, t) in enumerate(SAMPLE)] + [(50, "long words here, " * 300)]
    found = encode(docs_of(rows), chunk=100, with_ids=True)
    assert all(r["round_trip"] for r in found.collect())
    assert {r["doc_id"]: r["text"] for r in decode(found).collect()} == {d: t or "" for d, t in rows}


def test_op3_scan_over_tasks_equals_one_pass(docs_of, tmp_path):
    """The public pieces as a model whose scores add up, in chunks whose matrices meet block by block."""
    from sentencepiece import sentencepiece_model_pb2

    from quadrille.llm.pieces import MODEL, Pieces, encode
    from quadrille.llm.tokens import vocabulary_path

    proto = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary_path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    m = Pieces(path)
    rows = [(1, "international things are there " * 30), (2, "short"), (3, None), (4, "x" * 400), (BIG, "no spaces" * 50), (None, "日本 naïve" * 40)]
    got = {r["doc_id"]: r for r in encode(docs_of(rows), path=path, chunk=40, with_ids=True, block=3).collect()}
    for d, t in rows:
        text = " " + (t or "")
        score, ids = m.best(text, 0, len(text), len(text))
        own = np.frombuffer(got[d]["ids"], "<u2")
        assert got[d]["score"] == pytest.approx(score) and got[d]["round_trip"]
        assert m.decode(own).decode() == (t or "") and got[d]["n_tokens"] == len(own)


def test_op3_equals_the_library(docs_of):
    import sentencepiece

    from quadrille.llm.pieces import MODEL, encode
    from quadrille.llm.tokens import vocabulary_path

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))
    rng = np.random.default_rng(12)
    bits = ["a", "b", " ", "   ", "th", "the", "ing", "é", "\n", "😀", "inter", "national", "日本", "\u2581", "\t", "İ", "１", "2,000", "<s>", "</s>", "<unk>", "<0x41>", "\0"]
    rows = [(i, t) for i, (_, t) in enumerate(SAMPLE)] + [(50, "long words here, " * 300), (None, "no id"), (BIG, "big"), (BIG + 1, "x" * 300)]
    rows += [(100 + i, "".join(rng.choice(bits, rng.integers(1, 90)))) for i in range(300)]
    for chunk in (100, 7):
        got = {r["doc_id"]: r for r in encode(docs_of(rows), chunk=chunk, with_ids=True).collect()}
        for d, t in rows:
            want = np.array(m.encode(t or ""), dtype="<u2")
            assert np.frombuffer(got[d]["ids"], "<u2").tolist() == want.tolist(), t
            assert (got[d]["n_tokens"], got[d]["ids_crc32"]) == (len(want), zlib.crc32(want.astype("<u4")))
            assert got[d]["round_trip"] == ("\u2581" not in (t or "")), t
    assert max(r["n_chunks"] for r in got.values()) > 100


def test_op4_recall_and_edges(spark):
    from quadrille.llm.ann import nearest

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[500:900] = x[0] + 1e-3 * rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (5400, [1.0] * 3)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    assert sorted(got) == list(range(0, 1500, 100))
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        hit += len({v for v, _ in got[q].values()} & set(best.tolist()))
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in got[q].values())
    assert hit >= 0.9 * 10 * len(got)
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op4_repeated_ids_and_lengths(spark):
    from quadrille.llm.ann import nearest

    rows = [(0, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [3.0, 5.0]), (7, [6.0, 9.0]), (100, [0.0, 0.0, 2.0]), (8, [0.0, 0.0, 1.0]), (0, [9.0, 9.0]), (BIG, [0.0, 2.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, BIG, 1.0), (0, 3, 7, 5.0), (0, 4, 7, 10.0), (100, 1, 8, 1.0)]


def test_op5_short_and_long_clips_pass_the_same_filter(spark):
    from quadrille.llm import media

    x = (8000 * np.sin(np.arange(400) * 0.9)).astype(np.int16)  # above half the target rate
    for n in (20, 31, 400):
        low = media.resample(x[:n], 8000, 2000)
        assert len(low) == -(-n // 4) and np.abs(low[2:-2]).max(initial=0) < 2500
    adpcm = bytearray(media.wav(bytes(64), media.IMA_ADPCM))
    adpcm[32:34] = (64).to_bytes(2, "little")  # bytes of a block
    rows = [(BIG, media.wav(bytes(range(256)))), (None, None), (1, bytes(adpcm))]
    got = {r["doc_id"]: r["pcm"] for r in media.pcm_column(spark.createDataFrame(rows, "doc_id long, media binary"), 4000).collect()}
    assert got[None] is None and bytes(got[BIG]) == media.to_pcm(rows[0][1], 4000).tobytes()


def test_op5_stores_whole_sound_at_16_khz(spark, tmp_path, docs_of):
    from quadrille.llm import media
    from quadrille.llm.queries import op5_telephony_audio

    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 64, 1001):  # any samples, not only those of a doubled rate
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        assert media.unpack(media.pack(x)) == x.astype("<i2").tobytes()
    sound = media.to_pcm(media.wav(rng.integers(0, 256, 640).astype(np.uint8).tobytes()))
    assert len(sound) == 1280 and not any(media.pack(sound)[1280:])
    rows = [(i, t) for i, (_, t) in enumerate(SAMPLE)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["feature"].split(";")[2] for r in op5_telephony_audio(spark, str(tmp_path)).collect()}
    stored = {r["doc_id"]: bytes(r["pcm"]) for r in media.store_text(docs_of(rows)).collect()}
    for d, t in rows:
        p = (t or "").encode()
        want = media.to_pcm(media.wav(p + b"\0" * (max(64, -(-len(p) // 64) * 64) - len(p))), 16000).astype("<i2").tobytes()
        assert stored[d] == want and got[d] == f"pcm:{len(want) // 2},{zlib.crc32(want)}"


def test_op5_laws_and_round_trip(docs_of):
    from quadrille.llm import media

    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0) and (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    rng = np.random.default_rng(6)
    raw = rng.integers(0, 256, 64 * 5).astype(np.uint8)
    fast = media.decode_adpcm(raw)
    for b in range(5):
        block = raw[b * 64 : b * 64 + 64].tolist()
        now, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        want = [now]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
                index = max(0, min(88, index + int(media.MOVES[code & 7])))
                want.append(now)
        assert fast[b].tolist() == want
    rows = [(i, t) for i, (_, t) in enumerate(SAMPLE)]
    got = {r["doc_id"]: r for r in media.features(media.store_text(docs_of(rows))).collect()}
    for d, t in rows:
        p = (t or "").encode()
        padded = p + b"\0" * (max(64, -(-len(p) // 64) * 64) - len(p))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.wav(padded)), hashlib.sha256(media.wav(padded)).hexdigest())
    assert got[5]["feature"] == got[6]["feature"]
    assert media.features(media.store_text(docs_of([]))).count() == 0
    assert len(media.to_pcm(media.wav(b"\x80" * 800), 16000)) == 1600


def test_op6_rules_and_words(spark):
    from quadrille.llm.urls import Segmenter, judge

    assert Segmenter({"spam": 9, "farm": 9, "cheap": 5, "pills": 5}).split("cheappillsfarm") == ["cheap", "pills", "farm"]
    rows = [(1, "http://A.example.NET/en/1?x"), (2, "https://example.net/fr"), (3, "x.example.com/de/"), (4, None), (5, "http://www.example.com/de/9#a"), (6, "http://b.org/fr/1"), (7, "http://notexample.com/de/"), (8, "http://cheappills.shop/buy"), (9, "http://meadow.shop/walk"), (BIG, "http://meadow.shop/walk"), (None, "http://meadow.shop/walk")]
    rows += [(100 + i, f"http://cheap-pills{i}.net/buy/{i}") for i in range(20)] + [(200 + i, f"http://meadow-{i}.org/fr/walk/{i}") for i in range(40)]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4, 5, 6, 7)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/fr", "net/"), ("", "", None), ("", "", None), ("www.example.com", "/de/9", "example.com/de/"), ("b.org", "/fr/1", "org/fr/"), ("notexample.com", "/de/", None)]
    assert [got[i]["verdict"] for i in (1, 2, 4, 5, 6, 8, 9, BIG, None)] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_op6_splits_names_that_pages_show(spark):
    from quadrille.llm.urls import judge, label_words

    names = ["cheappills", "freecasinoslots", "casinogarden", "bestcasinobonus", "adultgarden"]
    bad = "cheap pills free casino slots bonus adult".split()
    rows = [(i, f"http://u{i}.{names[i % 5]}.shop/a") for i in range(50)]
    rows += [(100 + i, f"http://{w}{i}-{w}.shop/a") for i in range(60) for w in ("garden", "best", "meadow")] + [(900, "http://meadow.shop/a")]
    rows += [(1000 + 10 * i + k, f"http://{w}-{i}.shop/a") for i in range(30) for k, w in enumerate(bad)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(d, d >= 1000) for d, _ in rows if 100 <= d < 900 or d >= 1000], "page_id long, block boolean").distinct()
    hosts = pages.selectExpr("substring(url, 8, length(url) - 9) host").distinct()
    assert {r["w"] for r in label_words(hosts).collect()} == {"garden", "best", "meadow", "shop", *bad}
    got = {r["page_id"]: r["verdict"] for r in judge(pages, labels=labels).collect()}
    assert [got[i] for i in (0, 1, 3, 900, 100)] == ["block", "block", "block", "allow", "allow"]


def test_op6_weighs_every_word(spark):
    from quadrille.llm.urls import judge

    rows = [(i, f"http://u{i}-{'casino' if i % 2 else 'meadow'}.shop/{'zz' if i % 2 else 'yy'}top/{i}x") for i in range(60)] + [(100, "http://plain.shop/zztop/q"), (101, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(d, d % 2 == 1) for d, _ in rows if d < 100], "page_id long, block boolean")
    whole = {r["page_id"]: (r["verdict"], r["score"]) for r in judge(pages, labels=labels).collect()}
    for head in (0, 3):  # what the workers hold changes nothing
        got = {r["page_id"]: (r["verdict"], r["score"]) for r in judge(pages, labels=labels, head=head).collect()}
        assert got == {d: (v, pytest.approx(x)) for d, (v, x) in whole.items()}
    tokens = {}
    for d, url in rows:
        host, path = url[7:].split("/", 1) if url else ("", "")
        for side, text in (("h:", host), ("p:", path)):
            for w in re.findall("[^\\W_]+", text):
                n = tokens.setdefault(side + w, {True: 0, False: 0})
                if d < 100:
                    n[d % 2 == 1] += 1
    total = {k: sum(n[k] for n in tokens.values()) + len(tokens) + 1 for k in (True, False)}
    want = np.log(31 / 31) + sum(np.log((tokens[t][True] + 1) / total[True]) - np.log((tokens[t][False] + 1) / total[False]) for t in ("h:plain", "h:shop", "p:zztop", "p:q"))
    assert whole[100][1] == pytest.approx(want) and whole[100][0] == "block"


def test_op7_versions(spark, docs_of, tmp_path):
    from quadrille.llm.compaction import ShardStore

    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, fan_in=2)
    rows = [(i, f"text {i}" * 50) for i in range(60)] + [(None, None), (7, None)]
    for part in range(3):
        store.append(docs_of(rows[part * 20 : part * 20 + 22] if part == 2 else rows[part * 20 : part * 20 + 20]))
    before = store.version()
    assert before == 3 and len(store.manifest()["shards"]) == 9
    assert store.compact() > before and len(store.manifest()["shards"]) < 3
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in store.read().collect()) == sorted((d or -1, t or "") for d, t in rows)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(before, store.manifest()["schema"], [])
    empty = ShardStore(spark, f"file://{tmp_path}/empty")
    empty.append(docs_of([]))
    assert empty.read().count() == 0


def test_op8_equals_python(docs_of):
    from quadrille.llm.pii import digest, redact

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = np.random.default_rng(8)
    bits = ["a@b.cc", "_d@e.ff", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0000", "+", " ", "é😀", "7", "x", "-", "(", "\n", "12345678901234567890"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(1, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "1 " * 1500 + "4111 1111 1111 1111 x")]
    got = {r["doc_id"]: r for r in digest(docs_of(rows)).collect()}
    for d, t in rows:
        spans = []
        for rank, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                    spans.append((m.start(), rank, kind, m.end()))
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, text, r["spans"])
        assert [r[f"n_{k}"] for k in patterns] == [sum(s[2] == k for s in spans) for k in patterns]
    (row,) = digest(docs_of([(1, "IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33, call 555-123-4567")])).collect()
    assert row["spans"] == "iban:5:32,national_phone:70:82"
    clean = {r["doc_id"]: r["text"] for r in redact(docs_of([(1, "to a@b.cc now"), (2, None), (3, "plain")])).collect()}
    assert clean == {1: "to [EMAIL] now", 2: None, 3: "plain"}


def test_op8_one_label_serves_a_list(docs_of):
    from quadrille.llm.pii import digest, redact

    many = "SSN " + ", ".join(f"123-45-{6000 + i}" for i in range(9))
    rows = [(1, "SSN 123-45-6789, 234-56-7891"), (2, "call 555-123-4567 or 555-123-4568"), (3, many), (4, "555-123-4567, 555-123-4568 (mobile)"), (5, "no label 555-123-4567, 555-123-4568"), (6, "call " + "-" * 40 + " 555-123-4567")]
    got = {r["doc_id"]: r["spans"] for r in digest(docs_of(rows)).collect()}
    assert got[1] == "ssn:4:15,ssn:17:28" and got[2] == "national_phone:5:17,national_phone:21:33" and got[4] == "national_phone:0:12,national_phone:14:26"
    assert got[3] == ",".join(f"ssn:{4 + 13 * i}:{15 + 13 * i}" for i in range(9)) and got[5] == got[6] == ""
    assert {r["doc_id"]: r["text"] for r in redact(docs_of(rows)).collect()}[2] == "call [NATIONAL_PHONE] or [NATIONAL_PHONE]"


def test_op8_keeps_columns_of_any_name(spark, docs_of):
    from quadrille.llm.pii import redact

    rows = [(1, "to a@b.cc now", "mine", 5, "z", "r"), (None, None, None, None, None, None), (1, "", "m", 6, "z", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, spans int, _null string, `row` string")
    got = {tuple(r) for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns and got == {(1, "to [EMAIL] now", "mine", 5, "z", "r"), rows[1], rows[2]}
    assert redact(docs.limit(0)).count() == 0


def check_pieces(rows, got, name="byte_bpe_50k.json"):
    by, windows = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == {d for d, _ in rows}
    for d, t in rows:
        ids, at = ids_of(name, t, 0), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    return windows


def test_op9_packs_without_loss(docs_of):
    from quadrille.llm.packing import best_fill, pack

    assert sum(k * n for k, n in best_fill({5: 3, 7: 2}, 22).items()) == 22
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 1500)))) for i in range(60)] + [(100, None), (101, ""), (102, "x y " * 3000), (None, "no id"), (BIG, "big"), (BIG + 1, "bigger")]
    windows = check_pieces(rows, pack(docs_of(rows)).collect())
    assert check_pieces(rows, pack(docs_of(rows), small=0).collect()) and pack(docs_of([(1, "same")] * 5)).count() >= 5
    assert sum(sum(n for _, n in w) < 1024 for w in windows.values()) <= 10
    assert pack(docs_of([])).count() == 0


LANGS = {"aa": "ka lo mi ne pu ra si to vu wa".split(), "bb": "zhe trask blor grunt vlix dwar skeb plon".split()}


def language_rows():
    rng = np.random.default_rng(10)
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(LANGS[lang], 3)) for _ in range(60)), lang))
    return rows


def test_op10_accuracy_and_edges(docs_of):
    from quadrille.llm.langid import fit, language_id

    rows = language_rows() + [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (903, "kalomi nepura", None)]
    got = {r["doc_id"]: r for r in language_id(docs_of(rows)).collect()}
    for d, t, lang in language_rows():
        assert got[d]["lang_pred"] == lang and not got[d]["rejected"] and 0 <= got[d]["score"] <= 1
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert language_id(docs_of([])).count() == 0
    m = fit({"aa": ["abab abba", "bab"], "bb": ["cdcd", "dc dc"]})
    loss, size = m.losses(["abab cd"])
    split, _ = m.losses(["abab cd"], step=2)
    assert loss == pytest.approx(split) and size[0] == 7
    for k in range(1, 4):  # probabilities of what was seen after any context stay below one
        assert (m.grams[k].rows <= 1e-6).all()


def test_op10_learns_languages_of_long_texts_alone(docs_of):
    from quadrille.llm.langid import language_id

    rng = np.random.default_rng(3)
    make = lambda lang, n: " ".join("".join(rng.choice(LANGS[lang], 3)) for _ in range(n))
    rows = [(i, make("aa", 4500), "aa") for i in range(20)] + [(100 + i, make("bb", 40), "bb") for i in range(20)]
    assert min(len(t) for _, t, lang in rows if lang == "aa") > 20_000
    rows += [(BIG, make("aa", 30), None), (None, make("bb", 30), None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(docs_of(rows)).collect()}
    assert got == {d: lang or ("aa" if d == BIG else "bb") for d, _, lang in rows}


def test_op10_equals_kneser_ney_by_hand():
    """Interpolated Kneser-Ney of the text's own n-grams, counted and discounted one by one."""
    from collections import Counter

    from quadrille.llm.langid import ORDER, fit

    texts = ["abab", "abba", "baab"]
    model = fit({"xx": texts})
    pad = ["   " + t for t in texts]
    grams = [Counter(t[i - k : i + 1] for t in pad for i in range(3, len(t))) for k in range(ORDER)]
    for k in range(ORDER - 1):  # kinds of characters before an n-gram; its own count is one where nothing is before it
        kinds = Counter(g[1:] for g in grams[k + 1])
        grams[k] = Counter({g: kinds.get(g, 1) for g in grams[k]})

    def discount(k):
        one, two = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        return min(max(one / (one + 2 * two) if one + two else 0.5, 0.1), 0.9)

    def p(gram):
        k = len(gram) - 1
        lower = 1e-6 if k == 0 else p(gram[1:])
        own = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        total = sum(own.values())
        return max(grams[k][gram] - discount(k), 0) / total + discount(k) * len(own) / total * lower

    for text in ("ab", "abba", "bbab", "aaaa"):
        loss, size = model.losses([text])
        full = "   " + text
        want = -sum(np.log(p(full[i - 3 : i + 1])) for i in range(3, len(full)))
        assert loss[0, 0] == pytest.approx(want, rel=1e-4), text


def test_pipeline_keeps_one_of_repeated_rows(spark, docs_of):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (3, b), (None, a), (None, a), (4, None), (5, "")]
    got = corpus_pipeline.deduplicated(spark, docs_of(rows), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(1, a), (1, b), (-1, a), (-1, a), (4, ""), (5, "")])
    for stage in (corpus_pipeline.identified, corpus_pipeline.deduplicated, corpus_pipeline.redacted, corpus_pipeline.packed):
        assert stage(spark, docs_of([]), "").count() == 0


def test_pipeline_keeps_clean_documents(spark, docs_of, tmp_path):
    import corpus_pipeline

    rows = language_rows()
    base = rows[0][1]
    rows += [(500, base, "aa"), (501, "Mail " + rows[1][1] + " to joe@mail.example.com", "bb"), (502, "9834 2342 !!", None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = sorted({r["doc_id"] for r in got})
    assert 500 not in kept and 502 not in kept and set(range(160)) - {1} <= set(kept)
    want = [(d, t) for d, t, _ in rows if d in kept]
    check_pieces([(d, re.sub(r"\S+@\S+", "[EMAIL]", t)) for d, t in want], got)

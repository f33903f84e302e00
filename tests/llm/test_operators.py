"""Each pipeline operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colinear.llm import audio, bpe, langid, linededup, mixing, neardup, sharding, topk, urlfilter, warc
from colinear.llm.components import components
from colinear.session import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


# URL filter


def brute_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_filter(spark):
    r = random.Random(5)
    labels = ["com", "net", "org", "example", "www", "a", "b-c", "EXAMPLE"]
    rules = [*urlfilter.RULES, ("block", "a.com", "/x"), ("allow", "www.a.com", "/"), ("block", "b-c.net", ""), ("allow", "org", "/en/q")]
    urls = [None, "", "nothing", "http://", "https:///en/", "HTTP://WWW.EXAMPLE.COM/en/1?x#y", "http://example.com", "http://example.com?a=/en/", "x://y://z/", "http://example.com.:80/en/"]
    urls += ["http://" + ".".join(r.choice(labels) for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/en/", "/en/q/1", "/x", "/es/2", "/fr/#t", "?q"]) for _ in range(400)]
    urls += ["https://hot.example.com/en/7"] * 200
    rows = spark.createDataFrame([(i % 300 if i % 50 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(map(str, (tuple(x) for x in urlfilter.judge(rows, rules).collect())))
    want = sorted(str((i % 300 if i % 50 else None, *brute_verdict(u, rules))) for i, u in enumerate(urls))
    assert got == want
    assert urlfilter.judge(rows.limit(0), rules).count() == 0
    assert urlfilter.judge(rows, []).where("rule is not null").count() == 0


# Mixing


def test_mixing_meets_targets_and_reruns(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))), None, r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(1500)]
    rows += [(7, "same text", None, "a")] * 5 + [(None, None, None, "a"), (9999, "", None, "e")]
    df = docs_of(spark, rows)
    got = [tuple(x) for x in mixing.decide(df).collect()]
    again = [tuple(x) for x in mixing.decide(df.repartition(7)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sum(x[3] for x in got) == len(rows)
    sizes, targets, taken = {}, {}, {}
    for _, s, size, n, source_size, target, copies in got:
        assert 0 <= copies <= 2
        sizes[s] = sizes.get(s, 0) + size * n
        targets[s], taken[s] = target, taken.get(s, 0) + size * n * copies
        assert source_size == sum(len((t or "").split()) for _, t, _, x in rows if x == s)
    total = sum(sizes.values())
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    aimed, open_, left = {}, set(weight), 1.5 * total
    while True:  # the law, by hand
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            aimed[s] = 2.0 * sizes[s]
            left -= aimed[s]
            open_.discard(s)
    aimed |= {s: level * weight[s] for s in open_}
    for s in weight:
        assert targets[s] == pytest.approx(aimed[s])
        assert abs(taken[s] - aimed[s]) <= 30


def test_flight_keeps_totals():
    r = np.random.default_rng(3)
    pi, size = r.random(500), r.integers(1, 1000, 500).astype(float)
    out = mixing.flight(pi, size, 1)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    assert ((mixing.flight(np.full(9, 0.5), np.full(9, 4.0), 2) % 1 > 0).sum()) <= 2
    shares = np.mean([mixing.flight(np.full(6, 0.3), np.arange(1.0, 7), k) for k in range(3000)], axis=0)
    assert np.abs(shares - 0.3).max() < 0.05  # inclusion probabilities hold


def test_mix_rows_and_empty(spark):
    df = docs_of(spark, [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "c", None, None), (None, None, None, "t")]).withColumn("size", F.lit("x")).withColumn("copies", F.lit(3))
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = {(x["id"], x["source"], x["size"]): x["copies"] * x["rows"] for x in mixing.decide(df).collect()}
    got = {}
    for x in out.collect():
        key = (x["doc_id"], x["source"], len((x["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0


# Audio


def test_audio_round_trip_and_equal_values(spark):
    texts = [None, "", "a", "ä" * 95, "x" * 192, "y" * 193, "the and ing " * 4000, "a"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {x["doc_id"]: x for x in audio.media_digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        x = rows[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert x["tail_crc32"] == zlib.crc32(payload[-16:])
        wav = audio.write_wav(payload)
        assert (x["media_bytes"], x["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert rows[2]["feature"] == rows[7]["feature"] and rows[0]["feature"] == rows[1]["feature"]
    # the feature by hand, from the stored tensors that the operator itself returns
    media = spark.createDataFrame([(i, bytearray(audio.write_wav(audio.payload_of(t or "")[1]))) for i, t in enumerate(texts)], "doc_id long, media binary")
    for x in audio.audio_features(media, "doc_id", "media").collect():
        tensors, spans = audio.read_tensors(x["tensors"])
        assert tensors.shape[1:] == (audio.PATCH, audio.MELS) and len(spans) == len(tensors) == -(-x["n_frames"] // audio.PATCH)
        assert all(a < b for a, b in spans) and all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))
        active = [(y["start_s"], y["end_s"]) for y in x["segments"]]
        digest = zlib.crc32(np.array(spans + active, np.float64).tobytes(), zlib.crc32(np.round(tensors, 2).tobytes()))
        says = dict(y.split("=") for y in rows[x["doc_id"]]["feature"].split(";"))
        assert (int(says["frames"]), int(says["tensors"]), int(says["segments"]), says["crc32"]) == (x["n_frames"], len(tensors), len(active), f"{digest:08x}")
    # the last samples count too
    near = audio.features(audio.write_wav(b"a" * 383 + b"\xff"))[0]
    assert np.abs(near - audio.features(audio.write_wav(b"a" * 384))[0]).max() > 0.1
    assert audio.media_digests(df.limit(0)).count() == 0


def test_audio_resampling_and_segments(spark):
    n = np.arange(8000)
    tone = np.sin(2 * np.pi * 440 * n / 8000).astype(np.float32)
    y = audio.resample(tone, 8000, 6000)
    assert len(y) == 6000 and np.abs(y - np.sin(2 * np.pi * 440 * np.arange(6000) / 6000))[60:-60].max() < 0.01
    loud = np.concatenate([np.zeros(8000), tone, np.zeros(8000)])
    media = audio.write_wav((loud * 100 + 128).astype(np.uint8).tobytes())
    mel, found = audio.features(media)
    assert len(found) == 1
    a, b = (audio.seconds(x, audio.TO_RATE) for x in found[0])
    assert abs(a - 1) < 0.05 and abs(b - 2) < 0.05
    # by hand: one frame of the log-mel
    window, bank = audio.filterbank(audio.TO_RATE)
    x = audio.resample((np.frombuffer(audio.read_wav(media)[1], np.uint8).astype(np.float32) - 128) / 128, 8000, 6000)
    k = 130
    frame = np.pad(x[k * audio.HOP : k * audio.HOP + audio.FRAME] * window, (0, audio.FFT - audio.FRAME))
    spectrum = np.array([np.sum(frame * np.exp(-2j * np.pi * f * np.arange(audio.FFT) / audio.FFT)) for f in range(audio.FFT // 2 + 1)])
    assert np.allclose(np.log(np.abs(spectrum) ** 2 @ bank + 1e-10), mel[k], atol=1e-2)
    table = pa.ipc.open_stream(audio.tensor_stream(mel, audio.TO_RATE)).read_all()
    assert table.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS]
    back = table.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[: len(mel)]
    assert np.array_equal(back, mel)
    row = audio.audio_features(spark.createDataFrame([(1, bytearray(media)), (2, None)], "id long, media binary"), "id", "media").orderBy("id").collect()
    assert row[0]["n_frames"] == len(mel) and row[1]["tensors"] is None


# WARC


def test_warc_round_trip(spark):
    big, other = "<p>äx</p>" * 200, "q" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/ c", big), (3, None, big), (4, "u", None), (6, "u", ""), (None, "u", other), (8, "u", other), (9, "u", "small"), (10, "u", "small"), (11, "u\r\nWARC-Type: x", other[:-1]), (12, "u", other[:-1]), (8, "u", other)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    folder = scratch(spark, "warc")
    files, known = warc.archive(df, folder)
    got = warc.read_back(files, known, folder).collect()
    assert len(got) == len(rows)
    assert sorted((x["payload_bytes"], x["payload_digest"]) for x in got) == sorted((len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for _, _, h in rows)
    kinds = {}
    for x in got:
        kinds.setdefault(x["payload_digest"], []).append((x["record_type"], x["id"], x["refers_to"]))
    of = lambda h: sorted(map(str, kinds[hashlib.sha1(h.encode()).hexdigest()]))
    assert of(big) == sorted(map(str, [("response", 5, None), ("revisit", 1, 5), ("revisit", 3, 5)]))
    assert of(other) == sorted(map(str, [("response", 8, None), ("revisit", 8, 8), ("revisit", None, 8)]))
    assert all(x[0] == "response" for h in ("small", other[:-1], "") for x in kinds[hashlib.sha1(h.encode()).hexdigest()])
    # every member stands alone where the sidecar says
    system, base = warc.open_fs(folder)
    told = 0
    for x in files.collect():
        raw = system.open_input_file(f"{base}/{x['file']}").read()
        for line in system.open_input_file(f"{base}/{x['file']}.cdx").read().decode().splitlines():
            record, offset, length = line.split()
            member = zlib.decompress(raw[int(offset) : int(offset) + int(length)], 31)
            assert member.startswith(b"WARC/1.1\r\n") and f"<{record}>".encode() in member
            told += 1
        assert x["records"] <= told
    assert told == len(rows)
    empty = scratch(spark, "warc")
    assert warc.read_back(*warc.archive(df.limit(0), empty), empty).count() == 0


# Language


def test_language(spark):
    r = random.Random(2)
    words = {"en": ["the", "and", "house", "river", "with"], "de": ["der", "und", "Straße", "über", "nicht"], "fr": ["le", "été", "avec", "où", "maison"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k, "s") for i, k in enumerate(r.choice(list(words)) for _ in range(300))]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !? 45", "de", "s"), (903, rows[0][1] * 2000, None, None), (None, "the and", "en", "s")]
    df = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    model = langid.train(df)
    got = {x["doc_id"]: x for x in langid.predict(df.select("doc_id", "text", "score"), model).collect()}
    held = [i for i, *_ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == rows[0][2]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.train(df.limit(0)) is None


def test_language_presence_of_long_texts(monkeypatch):
    """Worked off in pieces, a text has the n-grams that it has as a whole."""
    r = random.Random(14)
    for _ in range(60):
        text = "".join(r.choice("abcÄ1 .\n漢😀𐐀") for _ in range(r.randint(0, 60)))
        monkeypatch.setattr(langid, "CHARS", 1 << 20)
        whole = langid.presence(text)
        for n in (1, 2, 3, 7, 30):
            monkeypatch.setattr(langid, "CHARS", n)
            part = langid.presence(text)
            assert (whole is None and part is None) or whole.tolist() == part.tolist()


def test_language_kernel_matches_brute_force():
    texts = ["the house and the river", "der Fluss und das Haus", "the mouse", "das Boot über dem Fluss", "a", "zz top"]
    rows = [langid.presence(t) for t in texts]
    grams = lambda t: {(" " + t.lower() + " ")[i : i + n] for n in range(1, 5) for i in range(len(t) + 3 - n)}
    for a in range(len(texts)):
        for b in range(len(texts)):
            mine = len(np.intersect1d(rows[a], rows[b])) / np.sqrt(len(rows[a]) * len(rows[b]))
            ga, gb = grams(texts[a]), grams(texts[b])
            assert abs(mine - len(ga & gb) / np.sqrt(len(ga) * len(gb))) < 0.05
    # scores by the folded matrix equal scores against the landmarks
    labels = ["en", "de", "en", "de", "en", "de"]
    model = langid.fit(rows, labels, landmarks=4, ridge=0.5)
    unit = np.zeros((6, langid.WIDTH))
    for i, x in enumerate(rows):
        unit[i, x] = 1 / np.sqrt(len(x))
    marks = unit[[1, 3, 0, 2]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    root = vectors / np.sqrt(values)
    phi = unit @ marks.T @ root
    y = np.where(np.array(labels)[:, None] == np.array(["de", "en"])[None, :], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + 0.5 * np.eye(4), phi.T @ y)
    assert np.allclose(phi @ beta, model.score(rows), atol=1e-3)


# BPE


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    ref, mine = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Tokenizer(bpe.default_path())
    r = random.Random(4)
    texts = ["", " ", "a<|endoftext|>b", "<|endoftext|>", "  double  spaces \n\n x", "it's WE'LL 'd", "\n x", "x \n", "é à 漢字 😀 ²½Ⅷ", "a\u00a0b\u3000c", "=" * 500, "ab" * 300, "\x00\x1c\x85"]
    for alphabet in ("ab", "aaab", "the and ing", " \n\t", "xyzXYZ019 .,'", "äöüéñß漢字😀 ", "====----  "):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(150)]
    texts += [ref.decode([r.randrange(50256) for _ in range(3)]) for _ in range(500)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        ids = mine.encode(t)
        assert ids == want, t
        assert mine.decode(ids) == ref.decode(want, skip_special_tokens=False)
    # side by side, with the words of one text remembered for the next
    every = mine.digest(texts)
    for t, n, shown, back in zip(texts, *every, strict=True):
        want = ref.encode(t, add_special_tokens=False).ids
        assert (n, shown) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert back == hashlib.sha256(ref.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_long_words_and_small_memory(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    for name, value in (("GROUP", 300), ("SEGMENT", 100), ("KNOWN", 50), ("LONG", 40), ("PLACES", 64)):
        monkeypatch.setattr(bpe, name, value)
    mine, r = bpe.Tokenizer(bpe.default_path()), random.Random(12)
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("aab", "etaoinshrdlu", "é漢😀a", "=-", "ab cd\n", " \n", "a b<|endoftext|>") for n in (39, 41, 1000, 20_000)]
    texts += ["x" * 99 + "  y" * 80, "a " * 500 + " ", " " * 300 + "b", "<|endoftext|>" * 40]
    for t, n, shown, _ in zip(texts, *mine.digest(texts), strict=True):
        want = ref.encode(t, add_special_tokens=False).ids
        assert (n, shown) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()), t[:50]


def test_bpe_reads_a_very_long_word_once():
    """The library merges pair by pair; the automaton reads place by place, so time grows with the length only."""
    import time

    mine, r, took = bpe.Tokenizer(bpe.default_path()), random.Random(13), []
    for n in (100_000, 800_000):
        word = "".join(r.choice("etaoinshrdlu") for _ in range(n))
        began = time.perf_counter()
        ids = mine.encode(word)
        took.append(time.perf_counter() - began)
        assert mine.decode(ids) == word
    assert took[1] < 16 * took[0] + 5


def test_bpe_leaves_out_arcs_that_merges_never_reach():
    """A token whose parts would have merged otherwise before is never emitted."""
    labels = [b"a", b"b", b"c", b"ab", b"bc", b"abc", *[bytes([x]) for x in range(256) if x not in b"abc"]]
    machine = bpe.Automaton(labels, [(0, 1, 3), (1, 2, 4), (0, 4, 5)])  # a bc is never left once ab is merged
    flat, upto = machine.read(np.frombuffer(b"abcbcab", np.uint8), np.array([0, 3, 5, 7], np.int32))
    assert [flat[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [[3, 2], [4], [3]]


def test_bpe_rows(spark):
    df = docs_of(spark, [(1, "hello world", None, None), (1, "hello world", None, None), (None, None, None, None), (3, "", None, None), (4, "long text " * 5000, None, None)]).withColumn("ids", F.lit("clash"))
    got = bpe.digests(df, bpe.default_path()).collect()
    assert sorted(x["n_tokens"] for x in got)[:2] == [0, 0] and len(got) == 5
    assert all(x["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for x, t in zip(sorted(got, key=lambda x: (x["doc_id"] or 9, x["n_tokens"])), ["hello world", "hello world", "", "long text " * 5000, None], strict=True))
    both = bpe.decode(bpe.encode(df, bpe.default_path()), bpe.default_path()).collect()
    assert all(x["decoded"] == (x["text"] or "") for x in both)
    assert bpe.digests(df.limit(0), bpe.default_path()).count() == 0


# Near duplicates


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, k) for k in range(150, 200)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def brute_classes(rows):
    sets = [neardup.shingles(neardup.word_hashes(t or "")) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j] or (len(sets[i][0]) and neardup.similarity(sets[i], sets[j]) >= 0.8)
            if same:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(70)]  # a passage that many documents share
    rows = []
    for i in range(60):
        base = [word() for _ in range(r.randint(30, 120))]
        if i % 2:
            base = common + base[:30]
        rows.append((10 * i, " ".join(base)))
        for k in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append((10 * i + 1 + k, " ".join(copy).upper() if k else ", ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "!!!"), (5003, "one two"), (5004, "One two."), (5005, "x " * 30000), (5006, "x " * 30001), (None, "one two"), (5003, "one two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {}
    found = neardup.classes(df).collect()
    assert len(found) == len(rows)
    for x in found:
        got.setdefault(str(x["head"]), []).append(x["id"])
    assert sorted(sorted(map(str, g)) for g in got.values()) == brute_classes(rows)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(got)
    assert neardup.classes(df.limit(0)).count() == 0


def test_near_duplicates_find_a_base_with_many_copies(spark):
    """1000 copies at 0.82 to one base, below 0.8 to each other: one class."""
    r = random.Random(31)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(1000):
        words = list(base)
        for at in r.sample(range(8, 292, 5), 6):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    sets = [neardup.shingles(neardup.word_hashes(t)) for t in [" ".join(base), *texts[:40]]]
    assert all(0.81 < neardup.similarity(sets[0], s) < 0.83 for s in sets[1:])
    assert sum(neardup.similarity(a, b) >= 0.8 for a in sets[1:] for b in sets[1:] if a is not b) == 0
    df = docs_of(spark, [(k, t, "en", "s") for k, t in enumerate([*texts[:500], " ".join(base), *texts[500:]])])
    assert neardup.classes(df).select("head").distinct().count() == 1


def test_near_duplicates_follow_drift(spark):
    """Versions that change a little at a time, in two families with a common half: each family is one class, whatever the centres."""
    r = random.Random(32)
    common = [f"c{r.randrange(10**6)}" for _ in range(200)]
    rows, sets = [], []
    for family in range(2):
        words = [*common, *(f"f{family}x{r.randrange(10**6)}" for _ in range(60))]
        for version in range(40):
            at = r.randrange(len(words))
            words[at] = f"v{family}x{version}"
            rows.append((len(rows), " ".join(words), "en", "s"))
            sets.append(neardup.shingles(neardup.word_hashes(rows[-1][1])))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    found = {x["id"]: x["head"]["id"] for x in neardup.classes(docs_of(spark, rows)).collect()}
    assert [found[i] for i in range(len(rows))] == root


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(5)
    for overlap in (0.3, 0.6, 0.9):
        agree, exact = [], 0.0
        for _ in range(30):
            ids = r.integers(1, 2**62, 300).astype(np.uint64)
            n = int(300 * overlap)
            a = (np.unique(ids[:200]), r.integers(1, 5, 200))
            b = (np.unique(ids[200 - n * 2 // 3 : 400 - n * 2 // 3][:200]), None)
            b = (b[0], r.integers(1, 5, len(b[0])))
            agree.append((neardup.signature(*a) == neardup.signature(*b)).mean() - neardup.similarity(a, b))
            exact += neardup.similarity(a, b)
        assert abs(np.mean(agree)) < 0.02


# Sharding


def test_sharding(spark):
    r = random.Random(9)
    rows = [(i, "t" * r.randint(0, 400), None, r.choice(["a", "a", "b", None])) for i in range(3000)] + [(None, None, None, None), (5, "same", None, "a"), (5, "same", None, "a")]
    df = docs_of(spark, rows).withColumn("slot", F.lit("clash"))
    got = sharding.shard(df, 24).collect()
    assert len(got) == len(rows)
    assert sorted((x["size"], x["text_crc32"]) for x in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    total = sum(x["size"] for x in got) / 24
    assert set(by) == set(range(24)) and all(abs(sum(x["size"] for x in v) - total) < 0.05 * total + 408 for v in by.values())
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    assert sorted(map(str, sharding.shard(df.repartition(5), 24).collect())) == sorted(map(str, got))
    assert sharding.shard(df.limit(0), 24).count() == 0
    few = sharding.shard(df.limit(3), None, target_bytes=100000).collect()
    assert {x["shard"] for x in few} == {0}


def test_sharding_parts_rows_that_repeat_everything(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 100)
    df = docs_of(spark, [(7, "same text", None, "a")] * 2400 + [(k, "x" * 9, None, "b") for k in range(600)])
    got = sharding.shard(df, 24).collect()
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    assert len(got) == 3000 and set(by) == set(range(24))
    assert all(abs(len(v) - 125) < 12 and sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())


# Substring dedup


def brute_dedup(rows, kind="sentence", least=linededup.LEAST_WORDS):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        if t is None:
            out[i] = None
            continue
        ends, lost = list(linededup.units(t, kind)), set()
        plain = [linededup.normal(t[a:b]) for a, b, _ in ends]
        for k in range(len(plain)):
            j, n = k + 1, len(plain[k].split())
            while n < least and j < len(plain):
                j, n = j + 1, n + len(plain[j].split())
            if not plain[k] or n < least:
                continue
            whole = tuple(x for x in plain[k:j] if x)
            if whole in seen:
                lost |= set(range(k, j))
            seen.add(whole)
        out[i] = "".join(t[a:z] for k, (a, _, z) in enumerate(ends) if k not in lost)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcd") for _ in range(4))
    lines = [" ".join(word() for _ in range(r.randint(1, 14))) + r.choice([".", "", "!"]) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.4 else " ".join(word() for _ in range(12)) for _ in range(r.randint(0, 8)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (None, lines[0] + "\n" + lines[1]), (503, (lines[3] + " ") * 3000)]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "p") for i, t in rows], "doc_id long, text string, removed string, _th string, TH string, places string")
    for kind, least in (("line", 8), ("paragraph", 1), ("sentence", linededup.LEAST_WORDS)):
        found = linededup.remove(df, unit=kind, least_words=least)
        assert found.columns == ["doc_id", "text", "_th", "TH", "places", "removed"]
        got = found.collect()
        want = brute_dedup(rows, kind, least)
        assert {x["doc_id"]: x["text"] for x in got} == want
        assert {x["TH"] for x in got} == {"z"}
    assert sum(len(t or "") for t in want.values()) < 0.9 * sum(len(t or "") for _, t in rows)
    original = dict(rows)
    for x in got:
        if x["text"] is not None:
            t, at, kept = original[x["doc_id"]], 0, []
            for s in x["removed"]:
                kept.append(t[at : s["start"]])
                at = s["end"]
            assert "".join([*kept, t[at:]]) == x["text"]
    twice = linededup.remove(docs_of(spark, [(1, "a b c d e f g h i " * 2, None, None), (1, "a b c d e f g h i " * 2, None, None)])).collect()
    assert [x["text"] for x in twice] == ["a b c d e f g h i " * 2] * 2
    assert linededup.remove(df.limit(0)).count() == 0


def test_line_dedup_removes_planted_passages(spark):
    r = random.Random(11)
    sentence = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(3, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    rows = [(i, " ".join(sentence() for _ in range(5)) + " " + (passage + " " if i % 3 == 0 else "") + " ".join(sentence() for _ in range(5))) for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i, t in rows[1:]:
        if i % 3:
            assert got[i] == t
        else:
            assert len(got[i]) <= len(t) - 0.8 * len(passage)


# Top k


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(12)
    vectors = [(i, [float(x) for x in r.normal(size=6)]) for i in range(700)]
    vectors += [(700 + i, vectors[3][1]) for i in range(40)] + [(800, None), (801, [1.0, None]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (804, []), (None, [1.0] * 6), (805, [3.0]), (3, vectors[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    rows = topk.quantised(df)
    old = topk.SHARD_ROWS, topk.LEAF_ROWS
    topk.SHARD_ROWS, topk.LEAF_ROWS = 100, 8
    try:
        got = sorted(tuple(x) for x in topk.top_k(rows, rows.where("vec_id % 50 = 0"), 10).collect())
    finally:
        topk.SHARD_ROWS, topk.LEAF_ROWS = old
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0
    few = topk.top_k(rows.where("vec_id < 3"), rows.where("vec_id < 1"), 10).collect()
    assert len(few) == 2


def test_exact_products_beyond_doubles():
    a = np.array([[2**40, 3]], np.int64)
    assert topk.exact_products(a, a)[0, 0] == 2**63 - 1
    b = np.array([[2**28 + 1, 5]], np.int64)
    assert topk.exact_products(b, b)[0, 0] == (2**28 + 1) ** 2 + 25


def test_topk_shards_grow_and_blocks_share_a_home(spark, monkeypatch):
    assert topk.shard_rows(10_000, 64, 100) == topk.SHARD_ROWS
    assert topk.shard_rows(4_000_000, 64, 100) == 40_000
    assert topk.shard_rows(10**9, 64, 1000) * 64 * 8 == topk.SHARD_BYTES
    assert topk.shard_rows(10**9, 10**9, 1000) == topk.shard_rows(1, 0, 1) - topk.SHARD_ROWS + 1 == 1
    r = np.random.default_rng(21)
    m = r.integers(-9, 10, size=(300, 5))
    m[200:] = m[:100]  # ties across shards
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vector array<long>")
    monkeypatch.setattr(topk, "SHARD_BYTES", 5 * 8 * 25)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    got = {}
    for q, k, i, s in topk.top_k(rows, rows.where("vec_id % 10 = 0"), 6).collect():
        got.setdefault(q, {})[k] = (i, s)
    products = m @ m.T
    assert got == {q: {k + 1: x for k, x in enumerate(sorted(((i, int(products[q, i])) for i in range(300) if i != q), key=lambda x: (-x[1], x[0]))[:6])} for q in range(0, 300, 10)}

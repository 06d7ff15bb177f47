import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import components, labelled, mpeg, op2_media, op3_surrogates, op4_toxicity, op5_quality, op6_order_minhash, op7_jaccard_join, op10_spans
from loomstone.llm.scratch import table

SF = "/root/testdata/sf0.01"


def sets_of(texts):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_audio_round_trip():
    for n in (1, 2, 3, 4, 5, 9, 40):
        p = hashlib.shake_128(bytes([n])).digest(192 * n)
        d = mpeg.write(p, n)
        a = mpeg.parse(d)
        assert mpeg.payload(d, a.offsets) == p and a.failed == 0 and a.checked == len(a.offsets) == a.vbr["frames"] and a.resyncs == a.skipped == 0
        assert a.tags["TSIZ"] == str(n) and a.samples == 1152 * len(a.offsets) and a.seek(a.samples - 1) == a.offsets[-1] and a.seek(a.samples) is None
        junk = d[: a.offsets[0]] + b"\xff\xfbjunk\xff\x00" + d[a.offsets[0] :] + b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
        b = mpeg.parse(junk)
        assert len(b.offsets) == len(a.offsets) and b.resyncs >= 1 and b.tags["title"] == "title"
        broken = bytearray(d)
        broken[a.offsets[-1] + 10] ^= 1
        assert mpeg.parse(bytes(broken)).failed == 1
        with pytest.raises(ValueError, match="no intact frame"):
            mpeg.payload(bytes(broken), a.offsets)
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 40).samples == 0


def plain_frames(data):
    """Where frames stand, by a scan that knows MPEG-1 Layer III at 48 kHz only."""
    rates = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at, found = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]), []
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] & 0xFE == 0xFA and data[at + 2] & 0x0C == 0x04
        found.append(at)
        at += 3 * rates[(data[at + 2] >> 4) - 1]
    return found[1:]  # the first is the table's


def test_media_columns(odd_docs, no_docs):
    media = op2_media.store_texts(odd_docs)
    rows = op2_media.features(media).collect()
    want = []
    for d in odd_docs.collect():
        t = (d.text or "").encode()
        p = t + b" " * (-len(t) % 192 or (0 if t else 192))
        want.append((d.doc_id or -1, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    held = {r.media_sha256: r for r in rows}
    for m in media.collect():
        r = held[hashlib.sha256(m.media).hexdigest()]
        assert r.media_bytes == len(m.media) and r.offsets == m.offsets == plain_frames(m.media) and r.duration_s == m.duration_s == len(m.offsets) * 1152 / 48000
        assert f"samples {1152 * len(m.offsets)}; frames {len(m.offsets)} of {len(m.offsets)};" in r.feature and f"last frame at {m.offsets[-1]}" in r.feature and m.crc_failed == 0
    info = op2_media.describe(media.select("doc_id", "media").union(no_docs.select("doc_id", F.lit(None).cast("binary")))).collect()
    assert all(r.crc_failed == 0 and r.frames == r.vbr_frames and r.duration_s > 0 for r in info)
    assert op2_media.features(op2_media.store_texts(no_docs)).count() == 0


def test_seek_tables():
    """A VBRI table's places are the sums of its stretches."""
    frame = bytes([0xFF, 0xFB, 0x94, 0xC0]).ljust(36, b"\0") + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 4, 10, 20, 30))
    frame = frame.ljust(384, b"\0")
    a = mpeg.parse(frame + bytes([0xFF, 0xFB, 0x94, 0xC0]).ljust(384, b"\0") * 2)
    assert a.vbr == {"kind": "VBRI", "bytes": 5000, "frames": 9, "frames_per_entry": 4, "toc": [0, 20, 60]} and len(a.offsets) == 2


def test_permutations():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(op3_surrogates.permuted(i, size, b"k", "x") for i in range(size)) == list(range(size))
    made = {op3_surrogates.surrogate("card", f"411111111111{i:04d}", b"k") for i in range(300)}
    assert len(made) == 300
    assert all((op3_surrogates.luhn(m[:-1]) == int(m[-1])) for m in [op3_surrogates.surrogate("card", "4111111111111111", b"k")])
    assert op3_surrogates.surrogate("ip", "10.1.2.3", b"k").startswith("10.")
    assert op3_surrogates.script(op3_surrogates.surrogate("name", "Mr|Иван Петров", b"k")) == "cyrillic"


def test_surrogates(spark, odd_docs, no_docs):
    out = {r.doc_id: r for r in op3_surrogates.anonymised(odd_docs, b"key").collect()}
    before = {r.doc_id: r for r in odd_docs.collect()}
    assert set(out) == set(before) and list(out[9].asDict()) == list(before[9].asDict())
    assert out[1].text == before[1].text and out[3].text is None and out[4].text == ""
    mail = re.search(r"\S+@\S+", out[9].text)[0]
    assert mail != "a.b@mail7.example.com" and mail in out[10].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[9].text) and "555-7713" not in out[9].text and "4111 1111" not in out[9].text
    assert out[9].n_chars == len(out[9].text)
    assert op3_surrogates.anonymised(no_docs, b"key").count() == 0
    people = spark.createDataFrame([(i, f"Mr Adam{chr(97 + i % 26)}{chr(97 + i // 26)} Bell met Mrs Clara Dodd{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(500)], "doc_id long, text string")
    found = op3_surrogates.mentions(people)
    made = op3_surrogates.resolved(found, b"key").collect()
    assert len(made) == 1000 == len({(r.kind, r.made) for r in made}) and not {r.made for r in made} & {r.entity.split("|")[1] for r in made}


def brute_field(emission, transitions, start):
    """Marginals of one chain by going through all labellings."""
    import itertools

    n, total, one = len(emission), 0.0, np.zeros(len(emission))
    for ys in itertools.product((0, 1), repeat=n):
        s = start * ys[0] + sum(e * y for e, y in zip(emission, ys)) + sum(transitions[a, b] for a, b in zip(ys, ys[1:]))
        total += np.exp(s)
        one += np.exp(s) * np.array(ys)
    return one / total


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_forward_backward(segment):
    """Marginals, expected transitions and first states of whole chains, however they are cut into segments."""
    r = np.random.default_rng(1)
    lengths, t = np.array([1, 5, 3, 7, 2, 8]), r.normal(size=(2, 2))
    emission, first = r.normal(size=lengths.sum()), np.cumsum(lengths) - lengths
    p, pairs, starts = op4_toxicity.forward_backward(emission, first, lengths, t, 0.3, segment)
    whole = op4_toxicity.forward_backward(emission, first, lengths, t, 0.3)
    for a, n in zip(first, lengths):
        assert p[a : a + n] == pytest.approx(brute_field(emission[a : a + n], t, 0.3))
    assert pairs == pytest.approx(whole[1]) and starts == pytest.approx(whole[2]) and pairs.sum() == pytest.approx((lengths - 1).sum())
    long = r.normal(size=5000) * 3
    assert op4_toxicity.forward_backward(long, np.array([0]), np.array([5000]), t, 0.3, segment)[0] == pytest.approx(op4_toxicity.forward_backward(long, np.array([0]), np.array([5000]), t, 0.3, 5000)[0])


def test_toxic_sentences_of_any_length(spark):
    """A sentence far longer than a segment is one chain: what stands before a token reaches it over any distance."""
    ending, documents = np.zeros(300, bool), np.array([300])
    assert [x.tolist() for x in op4_toxicity.chains(ending, documents)] == [[0], [300]]
    field = op4_toxicity.Field({}, np.array([[8.0, -8.0], [-8.0, 8.0]]), 0.0)
    emission = np.zeros(300)
    emission[0] = 6.0
    assert field.marginals(emission, np.array([0]), np.array([300]))[-1] > 0.9


def held_out_accuracy(scored, labels, label, threshold):
    both = scored.join(labels.select("doc_id", label), "doc_id").where(labelled.held_out())
    hit = both.select(((F.col("score") >= threshold).cast("int") == F.col(label)).cast("double").alias("h"))
    return hit.agg(F.avg("h")).first()[0]


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = op4_toxicity.fit(docs, labels)
    assert held_out_accuracy(op4_toxicity.score(docs, model), labels, "toxic", 0.5) > 0.93
    rows = op4_toxicity.score(odd_docs, model, True).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    bad = spark.createDataFrame([(1, "you are a worthless idiot, a moron and trash. fine words here")], "doc_id long, text string")
    r = op4_toxicity.score(bad, model, True).first()
    assert r.score > 0.5 and "idiot" in {bad.first().text[s.start : s.end].strip(",") for s in r.spans}
    kept = op4_toxicity.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == 13
    assert op4_toxicity.score(no_docs, model).count() == 0


def test_quality(spark, odd_docs, no_docs):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    net = op5_quality.fit(docs, labels)
    assert held_out_accuracy(op5_quality.score(docs, net), labels, "quality", 0.3) > 0.9
    rows = op5_quality.score(odd_docs, net).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert op5_quality.score(no_docs, net).count() == 0


def test_chunks_cover_everything():
    for n in (0, 1, 512, 513, 960, 961, 5000):
        data = bytes(1 + i % 250 for i in range(n))
        cut = op5_quality.chunks(data)
        assert op5_quality._covered(n, len(cut)).sum() == max(n, 1)
        back = b"".join(bytes(c[: op5_quality.HOP]) if i + 1 < len(cut) else bytes(c) for i, c in enumerate(cut))
        assert back[:n] == data and not any(back[n:])
    text = b"abc " * 300
    whole, parts = op5_quality.Network(4, 4), [text[:700], text, b""]
    a = op5_quality.document_features(whole, parts, whole.pairs(), most=2)
    b = op5_quality.document_features(whole, parts, whole.pairs())
    assert a == pytest.approx(b)


def test_untrained_labels(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert 0 <= op4_toxicity.score(some, op4_toxicity.fit(some, none)).first().score <= 1
    assert 0 <= op5_quality.score(some, op5_quality.fit(some, none)).first().score <= 1


def spark_hash(*values):
    """xxhash64 as Spark has it: strings in UTF-8, integers as (bytes, value), each hashed with the hash before as seed."""
    import xxhash

    h = 42
    for x in values:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x[1].to_bytes(x[0], "little"), h)
    return h


def plain_fingerprint(text):
    """An independent Order MinHash: symbols by a loop, occurrences by a counter, bins by sorting."""
    symbols, run = [], ""
    cuts = {chr(c) for c in range(0x21, 0x100) if c % 6 == 1} | set("αοао")
    for c in [*(text or ""), " "]:
        alone = any(a <= c <= b for a, b in ("\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u3400\u4dbf", "\u4e00\u9fff", "\uf900\ufaff"))
        if c in " \t\n\x0b\f\r\u00a0\u3000" or alone:
            while run:
                end = len(run) if len(run) <= 8 else next((i + 1 for i in range(2, min(16, len(run))) if run[i] in cuts), min(16, len(run)))
                symbols.append(run[:end])
                run = run[end:]
        if alone:
            symbols.append(c)
        elif c not in " \t\n\x0b\f\r\u00a0\u3000":
            run += c
    grams = [symbols[i : i + 3] for i in range(len(symbols) - 2)] if len(symbols) >= 3 else [["\0".join(symbols)]] if symbols else []
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for at, gram in enumerate(grams):
        g = spark_hash(*gram) % (1 << 37)
        h = spark_hash((8, g), (4, seen[g])) % (1 << 37)
        seen[g] += 1
        bins[h >> 32].append((h, at))
    least = {b: sorted(sorted(own)[:2], key=lambda x: x[1]) for b, own in bins.items()}
    return "".join(f"{spark_hash(*((8, h) for h, _ in least[b])) % 65536:04x}" if b in least else "----" for b in range(32))


def test_order_minhash_is_plain_order_minhash(spark, odd_docs):
    r = np.random.default_rng(3)
    texts = ["", None, " ", "one", "one two", "a b c", "repeat " * 30, "中文字漢語の文" * 9, "x" * 1000, "a\tb\u00a0c\nd"]
    texts += [" ".join(f"w{int(x)}" for x in r.integers(0, 40, int(n))) for n in r.integers(3, 200, 30)]
    texts += ["".join(map(chr, r.integers(low, high, int(n)))) for low, high in ((33, 127), (97, 123), (0x3B1, 0x3CA), (0x430, 0x450)) for n in (7, 8, 9, 16, 17, 40, 300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, x.text) for i, x in enumerate(odd_docs.collect()) if x.doc_id != 8]
    got = {x.doc_id: x.fingerprint for x in op6_order_minhash.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows}


def test_order_minhash_has_no_border(spark):
    """Likeness doesn't fall where a text passes some length; columns may have any name."""
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(words)[:n] for n in range(20, 700, 7)]
    rows = spark.createDataFrame([(i, t, t + " xy", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, more string, __s int, ___out int")
    both = op6_order_minhash.with_fingerprint(op6_order_minhash.with_fingerprint(rows), "more", "other")
    assert both.columns == ["doc_id", "text", "more", "__s", "___out", "fingerprint", "other"]
    found = both.select("doc_id", "__s", op6_order_minhash.likeness(F.col("fingerprint"), F.col("other")).alias("x")).collect()
    assert all(r["__s"] == 1 for r in found) and all(r.x >= (0.35 if r.doc_id < 8 else 0.6) for r in found)


def test_order_minhash_of_unbroken_runs(spark):
    """One character in front of, in or gone from 2,000 without white space changes few bins; another text changes all."""
    r = np.random.default_rng(8)
    rows = []
    for kind, letters in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуф")):
        one, other = ("".join(letters[i] for i in r.integers(0, len(letters), 2000)) for _ in range(2))
        rows += [(kind, name, one, t) for name, t in (("front", "x" + one), ("middle", one[:999] + "Q" + one[999:]), ("gone", one[1:]), ("other", other))]
    both = op6_order_minhash.with_fingerprint(op6_order_minhash.with_fingerprint(spark.createDataFrame(rows, "kind int, name string, text string, more string")), "more", "b")
    for x in both.select("kind", "name", op6_order_minhash.likeness(F.col("fingerprint"), F.col("b")).alias("x")).collect():
        assert x.x < 0.2 if x.name == "other" else x.x > 0.8, (x.kind, x.name, x.x)


def test_order_minhash(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(300)]
    turned = words[150:] + words[:150]
    mixed = sorted(words, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    small = words[:140] + ["new"] + words[141:]
    texts = [(i, " ".join(w)) for i, w in enumerate((words, words, small, turned, mixed))]
    f = {r.doc_id: r.fingerprint for r in op6_order_minhash.with_fingerprint(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    like = lambda a, b: spark.range(1).select(op6_order_minhash.likeness(F.lit(f[a]), F.lit(f[b])).alias("x")).first().x
    assert f[0] == f[1] and like(0, 1) == 1.0 and like(0, 2) > 0.8 > like(0, 3) > like(0, 4)
    rows = op6_order_minhash.edited_and_next(odd_docs).collect()
    assert len(rows) == 13
    unique = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in op6_order_minhash.edited_and_next(unique).collect()}
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        assert rows[k].edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest() and rows[k].n_chars == len(t)
    assert rows[4].near_edited == 1.0 and rows[1].near_next == 1.0
    assert op6_order_minhash.edited_and_next(no_docs).count() == 0


def brute_components(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in zip(ids, sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[ids.index(j)]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    return {i: find(i) for i in ids}


def test_jaccard_join(spark, odd_docs, no_docs):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids, sets = [r.doc_id for r in rows], sets_of([r.text for r in rows])
    want = brute_components(ids, sets)
    got = op7_jaccard_join.join(table(spark, SF, "documents")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), want[i]) for i, s in zip(ids, sets)}
    odd = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op7_jaccard_join.join(odd_docs).collect()), key=str)
    assert odd.count((2, 15, 1)) == 2 and (3, 0, 3) in odd and (None, 1, None) in odd and len(odd) == 13
    assert op7_jaccard_join.join(no_docs).count() == 0


def brute_links(sets):
    return [sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if j != i and b) if a else 0 for i, a in enumerate(sets)]


def near_copies(r, n, words, edits, tag, pool=1):
    """Copies of up to ``pool`` editions of one text with a few words changed and a cut end; later editions inherit changes."""
    base = [f"{tag}{i}" for i in range(words)]
    editions, out = [base], []
    for i in range(n):
        w = list(editions[int(r.integers(0, len(editions)))])
        for at in r.choice(words, int(r.integers(0, edits + 1)), replace=False):
            w[at] = f"{tag}x{i}_{at}"
        cut = words - int(r.integers(0, words // 9))
        if len(editions) < pool:
            editions.append(w)
        out.append(" ".join(w[:cut]))
    return out


def test_jaccard_join_counts_links(spark, monkeypatch):
    """Links and components around the threshold with small tiles, samples, shares and blocks, editions that make subgroups, exact copies and empty texts."""
    r = np.random.default_rng(5)
    texts = near_copies(r, 45, 104, 5, "a") + near_copies(r, 40, 60, 3, "c", pool=4) + [" ".join(f"q{int(x)}" for x in r.integers(0, 30, 40)) for _ in range(8)]
    texts += [*texts[::5], "", " ", None, "x y"]
    for name, value in (("LARGE", 2), ("LARGE_DELTA", 2), ("SAMPLE", 3), ("SHARE", 2), ("BLOCK", 4), ("LEVELS", 2)):
        monkeypatch.setattr(op7_jaccard_join, name, value)
    sets, ids = sets_of(texts), list(range(len(texts)))
    got = {x.doc_id: (x.component_id, x.n_links) for x in op7_jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    component, links = brute_components(ids, sets), brute_links(sets)
    assert got == {i: (component[i], links[i]) for i in ids} and max(links) > 10


def test_near_copies_are_a_pair_once(spark):
    """Near copies share keys of most buckets; they are a pair in the tile of their common least or greatest key alone."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:-1]))], "doc_id long, text string")
    keys = op7_jaccard_join.class_keys(docs, np.zeros(1 << op7_jaccard_join.SKETCH_BITS, np.uint8), frozenset(), 16).where("bucket IS NOT NULL").select("bucket", "blob")
    assert keys.select("bucket").distinct().count() > 10
    assert op7_jaccard_join.tiles(keys, 16, op7_jaccard_join._ONE, op7_jaccard_join.LARGE).count() == 1


def test_workers_let_go_of_vocabularies(spark):
    """A task that doesn't use vocabularies drops those that a worker has kept, and batches of texts are short."""
    from loomstone.llm import scratch, tokens

    path = tokens.default_vocabulary()
    docs = spark.createDataFrame([(0, "some words")], "doc_id long, text string").coalesce(1)

    def held(use):
        def run(batches):
            for b in batches:
                if use:
                    tokens.library_encoder(path).encode(b["text"])
                yield {"n": [tokens.library_encoder.cache_info().currsize]}

        return scratch.map_batches(docs, run, "n int", keep=use).first().n

    assert held(True) == 1 and held(False) == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= scratch.ARROW_ROWS


def test_jaccard_bounds():
    """Linked sizes lie in one size band or two neighbouring ones; bitmaps never rule a link out; spanning links hold together what all links do."""
    low = op7_jaccard_join.bands(3000)
    band = np.searchsorted(low, np.arange(3001), side="right")
    assert all(band[m] - band[n] <= 1 for n in range(1, 2400) for m in (n, 5 * n // 4))
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 2**63, int(r.integers(1, 900))).astype(np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], b[: len(b) // 20]]))
        wide, thin = (op7_jaccard_join.parity(x, w) for x, w in ((a, 8192), (b, 1024)))
        fold = op7_jaccard_join.folded(wide.tobytes(), 1024)
        assert (fold == op7_jaccard_join.parity(a, 1024).view("<u8")).all()
        assert np.bitwise_count(fold ^ thin.view("<u8")).sum() <= len(np.setxor1d(a, b))
        ok = r.random((12, 9)) < 0.15
        x, y = op7_jaccard_join.spanning(ok)
        assert ok[x, y].all() and len(x) <= 20
        together = lambda pairs: brute_components_of(21, [(i, 12 + j) for i, j in pairs])
        assert together(zip(x.tolist(), y.tolist(), strict=True)) == together(np.argwhere(ok).tolist())


def brute_components_of(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_order_minhash_symbols_are_told_by_any_character(spark):
    m = op6_order_minhash
    run = rf"[^\s\u00a0\u3000{m._UNSPACED}]"
    plain = rf"[{m._UNSPACED}]|{run}{{1,{m.RUN}}}+(?!{run})|{run}{{2,{m.LONGEST - 1}}}?[{m.CUTS}]|{run}{{1,{m.LONGEST}}}"
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x11000)]]
    texts = ["".join(f"{c}ab{c * 9}" for c in letters[a : a + 500]) for a in range(0, len(letters), 500)]
    texts += ["".join(rng.choice(" \n\t\u00a0\u3000\u85abcdefgh%+xyz\u4e00\u0e01\u03b1\u0430") for _ in range(400)) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    symbols = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    assert m._RUN.startswith("[!-~[") and df.where(symbols(plain) != symbols(m.SYMBOL)).count() == 0


def test_jaccard_join_deals_shared_keys_alone(spark):
    words = [f"w{i}" for i in range(9000)]
    texts = [" ".join(words[100 * i : 100 * i + 100]) for i in range(80)] + [" ".join([*words[:99], "other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    weights = np.zeros(1 << op7_jaccard_join.SKETCH_BITS, np.uint8)
    packed = op7_jaccard_join.class_keys(docs, weights, frozenset(), 16)
    blobs = [op7_jaccard_join.undealt(r.blob, np.dtype(op7_jaccard_join._ONE)) for r in packed.where("bucket IS NOT NULL").collect()]
    assert len({k for records, _ in blobs for k in records["k"].tolist()}) == 2 and packed.where("k IS NOT NULL").count() == 81
    assert op7_jaccard_join.tiles(packed.where("bucket IS NOT NULL").select("bucket", "blob"), 16, op7_jaccard_join._ONE, op7_jaccard_join.LARGE).distinct().count() == 1


def test_rows_are_picked_by_their_marks(spark):
    df = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("t"))
    df = df.withColumn("mark", op7_jaccard_join.mark("doc_id", "t"))
    some = df.where("doc_id IS NULL OR doc_id % 50 = 0")
    taken = op7_jaccard_join.seats(some.select("mark"))
    picked = {r.doc_id for r in op7_jaccard_join.seated(df, taken).collect()}
    assert picked >= {r.doc_id for r in some.collect()} and len(picked) < 200
    assert {r.doc_id for r in op7_jaccard_join.seated(df, taken, False).collect()} == {r.doc_id for r in df.collect()} - picked
    assert not op7_jaccard_join.seats(some.where("false").select("mark")).any()


def test_jaccard_join_keeps_texts_of_one_id_apart(spark):
    """Several texts without an id and several of one id: each links by its own set, and the pipeline keeps one row of each component."""
    import corpus_pipeline

    r = np.random.default_rng(6)
    bases = [[f"t{b}w{i}" for i in range(80)] for b in range(6)]
    near = lambda w: " ".join(w[:78])
    rows = [(None, " ".join(w)) for w in bases[:4]] + [(7, near(bases[0])), (8, near(bases[1])), (None, near(bases[2])), (9, " ".join(bases[4])), (9, " ".join(bases[5])), (10, near(bases[4])), (11, near(bases[5]))]
    rows += [(12, " ".join(r.permutation(bases[0])))] * 2 + [(None, None), (None, ""), (13, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.n_links) for r in op7_jaccard_join.join(df).collect())
    want = [(None, 7, 1), (7, 7, 1), (None, 8, 1), (8, 8, 1), (None, None, 1), (None, None, 1), (None, None, 0), (9, 9, 1), (9, 9, 1), (10, 9, 1), (11, 9, 1), (12, 12, 1), (12, 12, 1), (None, None, 0), (None, None, 0), (13, 13, 0)]
    assert got == collections.Counter(want)
    kept = collections.Counter((r.doc_id, (r.text or "")[:2]) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert kept == collections.Counter([(7, "t0"), (8, "t1"), (None, "t2"), (None, "t3"), (9, "t4"), (9, "t5"), (12, "t0"), (None, ""), (None, ""), (13, " ")])
    clashing = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8, 9), (1, "a b c", 5, 6, 7, 8, 9), ((1 << 63) - 1, "d e f", 1, 2, 3, 4, 5)], "doc_id long, text string, t int, words int, copies int, own_id int, component int")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, clashing, SF).collect())) == [(1, "a b c", 5, 6, 7, 8, 9), ((1 << 63) - 1, "d e f", 1, 2, 3, 4, 5)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.c for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components.components(links.where("false")).count() == 0


def plain_words(text):
    """(start, end) of each word, by a loop over characters."""
    out, at = [], None
    for i, c in enumerate([*text, " "]):
        alone = any(x <= c <= y for x, y in ("\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u3400\u4dbf", "\u4e00\u9fff", "\uf900\ufaff"))
        if at is not None and (c.isspace() or alone):
            out.append((at, i))
            at = None
        if alone:
            out.append((i, i + 1))
        elif at is None and not c.isspace():
            at = i
    return out


def plain_units(text):
    """(first word, past the last, start, end) of each sentence unit, by cutting behind stops, commas and line ends."""
    words, cuts = plain_words(text), [0]
    for (_, b), (c, _) in zip(words, words[1:]):
        gap = text[b:c]
        if gap and ("\n" in gap or text[:b].rstrip("'\")]")[-1:] in tuple(".!?,")):
            cuts.append(c)
    cuts.append(len(text))
    firsts = [next((i for i, (x, _) in enumerate(words) if x >= c), len(words)) for c in cuts]
    return words, [(f, l) for f, l in zip(firsts, firsts[1:]) if l > f]


def plain_repeats(texts, run, least):
    """Words that are covered by a run of units that stood before, by comparing the words themselves."""
    seen, cover = set(), {}
    for k in sorted(texts):
        words, cut = plain_units(texts[k])
        said, mine = [texts[k][a:b] for a, b in words], set()
        spans = []
        for i in range(len(cut)):
            j = next((j for j in range(i + run - 1, len(cut)) if cut[j][1] - cut[i][0] >= least), None)
            if j is not None:
                spans.append((cut[i][0], cut[j][1]))
        if spans and spans[-1][1] < len(words):
            spans.append((spans[-1][0], len(words)))
        for x, y in spans:
            if tuple(said[x:y]) in seen:
                mine.update(range(x, y))
            seen.add(tuple(said[x:y]))
        cover[k] = mine
    return cover


def test_sentence_spans(spark, odd_docs, no_docs):
    """Every repeated run of units goes; what else goes lies in runs of LONG words that stood before; what stays is untouched."""
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").where("doc_id < 400 OR n_chars > 4000").limit(500).collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    gone = collections.defaultdict(set)
    for r in op10_spans.removed(docs).collect():
        gone[r.doc_id].update(range(r.start, r.end))
    out = {r.doc_id: r.text for r in op10_spans.dedup(docs).collect()}
    assert out == {k: "".join(c for i, c in enumerate(t) if i not in gone[k]) for k, t in texts.items()}
    units, seen = plain_repeats(texts, op10_spans.RUN, op10_spans.WORDS), set()
    assert any(units.values())
    for k in sorted(texts):
        words = plain_words(texts[k])
        said, n = [texts[k][a:b] for a, b in words], op10_spans.LONG
        old = set()
        for i in range(len(words) - n + 1):
            gram = tuple(said[i : i + n])
            if gram in seen:
                old.update(range(i, i + n))
            seen.add(gram)
        cut = {i for i, (a, _) in enumerate(words) if a in gone[k]}
        assert units[k] <= cut <= units[k] | old
    odd = op10_spans.dedup(odd_docs)
    rows = odd.collect()
    assert odd.columns == odd_docs.columns and len(rows) == 13
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.text)
    assert by[1][0] and by[3] == [None] and by[4] == [""] and len(set(by[2])) == 1
    assert op10_spans.dedup(no_docs).count() == 0


def test_rewriting_keeps_rows_apart(spark):
    """Null and equal ids with different texts, a doc_id of 2^63 - 1, columns called like the keys, spans longer than 65,535 characters."""
    long = " ".join(f"{'y' * 3000}{i}." for i in range(40))
    said = "one two three, four five six, seven eight nine, ten eleven twelve, thirteen fourteen fifteen, sixteen seventeen eighteen, nineteen twenty more, twenty two three, four five six, seven eight nine, and then a few. "
    top = (1 << 63) - 1
    rows = [(1, said + "own", 7, 8, 9, 1), (None, said + "mine", 1, 2, 3, 2), (None, "other words", 4, 5, 6, 3), (top, "x " + said, 0, 0, 0, 4), (top, "nothing here", 0, 0, 0, 5), (2, long, 0, 0, 0, 6), (3, long, 0, 0, 0, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int, u int, edits int, c0 int")
    got = {r.c0: tuple(r) for r in op10_spans.dedup(df).collect()}
    assert got[1] == rows[0] and got[3] == rows[2] and got[5] == rows[4] and got[6] == rows[5]
    assert got[2][1] == "mine" and got[2][2:] == rows[1][2:] and got[4][0] == top and got[4][1].startswith("x ") and len(got[4][1]) < 20 and got[7][1] == ""
    people = spark.createDataFrame([(None, "Mr Adam Bell", 1), (None, "Mrs Clara Dodd", 2), (top, "Mr Adam Bell", 3)], "doc_id long, text string, made int")
    out = {r.made: r.text for r in op3_surrogates.anonymised(people, b"k").collect()}
    assert out[1] == out[3] != out[2] and out[1].startswith("Mr ") and out[2].startswith("Mrs ")


def test_spans_in_long_sentences(spark):
    """A passage of over 50 words of one or two sentences, set into the middle of others, holds a span that both texts have; so do unpunctuated, repeated and unspaced ones."""
    r = np.random.default_rng(8)
    word = lambda x: f"{x}{int(r.integers(0, 10**9))}"
    made = lambda x, n: [word(x) for _ in range(n)]
    rows, passages = [], []
    for _ in range(60):
        p = made("p", 51)
        if len(passages) % 2:
            p[int(r.integers(5, 45))] += "."
        passages.append(" ".join(p))
    passages.append(" ".join(["again"] * 60))
    passages.append("".join(chr(0x4E00 + int(x)) for x in r.integers(0, 5000, 60)))
    for i, p in enumerate(passages):
        for k in (i, 1000 + i):
            rows.append((k, " ".join(made("a", int(r.integers(0, 30))) + [p] + made("z", int(r.integers(0, 30))))))
    out = {x.doc_id: x.text for x in op10_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, p in enumerate(passages):
        assert len(texts[1000 + i]) - len(out[1000 + i]) > len(p) / 2
        own = texts[1000 + i].split(p)
        assert out[1000 + i].startswith(own[0]) and out[1000 + i].endswith(own[1])


def test_surrogates_of_many_short_entities(spark):
    """More one-word names than one list of forms holds, every one-letter address, every host of a small network, short numbers."""
    names = [f"Mr {a}{b}{c}{d}" for a in "BCDFGHJKLM" for b in "aeiouy" for c in "bcdfghjklmnpqrstvwxz" for d in "abcdefghijklmnopq"][:20_000]
    mails = [f"{chr(97 + i)}@example.com" for i in range(26)]
    hosts = [f"192.168.{i}.{j}" for i in range(256) for j in range(256)][:40_000]
    phones = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(10_000)]
    df = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate((names, mails, hosts, phones))], "doc_id long, text string").repartition(4)
    found = op3_surrogates.mentions(df)
    made = op3_surrogates.resolved(found, b"key").collect()
    own = {(r.kind, r.entity.split("|")[-1]) for r in made}
    kinds = collections.Counter(r.kind for r in made)
    assert kinds == {"name": 20_000, "email": 26, "ip": 40_000, "phone": 10_000}
    assert len({(r.kind, r.made) for r in made}) == len(made) and not {(r.kind, r.made) for r in made} & own
    patterns = op3_surrogates._patterns()
    for r in made[::50]:
        if r.kind in ("email", "ip", "phone"):
            assert op3_surrogates.find(r.made, patterns) == [(0, len(r.made), r.kind)]
    assert op3_surrogates.dressed("phone", "+1 0123 45", "+19876543") == "+1 9876 543"


def test_surrogates_keep_form(spark):
    """Planted entities of each kind, found where they stand and nowhere else, and replaced by what has the same form, by plain rules."""
    r = np.random.default_rng(9)
    digits = lambda n: "".join(str(int(x)) for x in r.integers(0, 10, n))
    letters = lambda n, s="abcdefghijklmnopqrstuvwxyz": "".join(s[int(x)] for x in r.integers(0, len(s), n))
    make = {
        "email": lambda: f"{letters(4).title()}.{letters(5).title()}@Mail{digits(2)}.Example.com",
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "ip": lambda: f"10.{int(r.integers(0, 256))}.{int(r.integers(0, 256))}.{int(r.integers(0, 256))}",
        "secret": lambda: letters(int(r.integers(32, 200)), "0123456789abcdef"),
        "key": lambda: "sk_live_" + letters(24, "abcDEF0123456789") + "7",
        "card": lambda: " ".join(digits(4) for _ in range(4)),
        "name": lambda: "Mr Adam Bell" + letters(3),
    }
    words, rows, planted = "plain words stand here and there without any number".split(), [], []
    for i in range(160):
        kind = list(make)[i % len(make)]
        before, entity = " ".join(r.permutation(words)), make[kind]()
        rows.append((i, f"{before} {entity} then {' '.join(r.permutation(words))}"))
        start = len(before) + 1 + (3 if kind == "name" else 0)
        planted.append((i, start, len(before) + 1 + len(entity), kind))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = op3_surrogates.replacements(df, b"k").collect()
    assert sorted((x.doc_id, x.start, x.end, x.kind) for x in found) == planted
    text = dict(rows)
    for x in found:
        was = text[x.doc_id][x.start : x.end]
        form = lambda s: re.sub(r"[a-f]", "a", re.sub(r"[0-9a-f]", "h", s)) if x.kind == "secret" else re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", s)))  # noqa: B023, E731
        assert x.put != was
        if x.kind not in ("name", "ip"):
            assert form(x.put) == form(was)
        if x.kind == "ip":
            assert x.put.startswith("10.") and all(0 <= int(p) < 256 for p in x.put.split("."))
        if x.kind == "key":
            assert x.put.startswith("sk_live_")
        if x.kind == "card":
            luhn = lambda s: sum(sum(divmod(int(c) * (2 - i % 2), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(s)) % 10 == 0
            assert luhn(x.put.replace(" ", "")) == luhn(was.replace(" ", ""))


def test_ids_with_both_labels_and_null_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 40)] + [(None, "no id"), (3, "a text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(2, 1), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    held = {x.doc_id for x in docs.select("doc_id", labelled.held_out().alias("h")).where("h").collect()}
    assert held == {i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5 == 0}
    texts, y = labelled.sample(docs.repartition(3), labels.repartition(3), "toxic", 100, 1000)
    want = {("a text of the same id" if i == 3 else f"text {i}"): float(i % 2 or i in (2, 4)) for i in range(1, 40) if i not in held}
    assert dict(zip(texts, y.tolist(), strict=True)) == want


def test_tables_of_many_steps_and_stray_free_frames():
    import time

    count = 60_000
    steps = bytes(b for i in range(count) for b in (i % 7).to_bytes(2, "big"))
    frame = bytes([0xFF, 0xFB, 0x94, 0xC4]) + bytes(32) + b"VBRI" + bytes([0, 1, 0, 0, 0, 0]) + bytes(8) + count.to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + steps
    began = time.time()
    toc = mpeg._table(frame, 0, mpeg.header(frame[:4]))["toc"]
    assert len(toc) == count and toc[0] == 0 and toc[8] == sum(i % 7 for i in range(8))
    stray = bytes([0xFF, 0xFB, 0x00, 0xC4]) + b"\x55" * 200
    mpeg.parse(stray * 20_000)
    assert time.time() - began < 20


def test_pairs_carry_narrow_bitmaps_first(spark):
    """Classes have bitmaps of two widths, and pairs that the narrow ones rule out don't reach the wide ones; what stays is what the wide ones alone let through."""
    r = random.Random(6)
    texts = []
    for n in (30, 90, 700):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{r.randrange(10**6)}" for _ in range(n))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signs = op7_jaccard_join.class_keys(docs, np.zeros(1 << op7_jaccard_join.SKETCH_BITS, np.uint8), frozenset(), 16).where("k IS NOT NULL")
    assert sorted((len(x.rough), len(x.bits)) for x in signs.collect()) == [(32, 128)] * 6 + [(128, 1024)] * 3
    pairs = signs.selectExpr("k AS a").crossJoin(signs.selectExpr("k AS b")).where("a < b")
    rough = op7_jaccard_join._near(pairs, signs.selectExpr("k", "n", "rough AS bits"))
    plain = sorted(op7_jaccard_join._near(pairs, signs.select("k", "n", "bits")).collect())
    assert sorted(op7_jaccard_join.near(pairs, signs).collect()) == plain and len(plain) == 3 and rough.count() < pairs.count() / 2

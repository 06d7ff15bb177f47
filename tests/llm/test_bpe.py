import collections
import hashlib
import json
import random
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomstone.llm import bpe, op1_bpe, op8_idfiles, op9_packing, simple8b, tokens

PATH = tokens.default_vocabulary()
PARTS = ["a", "in", "the", "é", "ß", "Σ", "İ", "ﬁ", "é", "́", "한", "ᄀ", "ᅡ", "1", "٣", "²", "'s", "'", "!", "…", "😀", "\x1c", "\x85", " ", "​", " ", "\n", "<|endoftext|>", "<|", "|>", "z", "q", "ing", "中", "\x00", "ǆ", ".", ",", "THE"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids_of(lib, text):
    return np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_machine_equals_library(lib):
    v, r = bpe.vocabulary(PATH), random.Random(5)
    assert v.lookahead and v.lookahead < 2000
    for n in range(600):
        text = "".join(r.choices(r.choices(PARTS, k=r.randint(1, 7)), k=r.choice([1, 4, 20, 120])))
        want = ids_of(lib, text)
        assert v.encode(text) == want
        cut = sorted(r.randrange(len(text) + 1) for _ in range(3))
        assert b"".join(bpe.encode_pieces(v, [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])])) == want
        d = bpe.Decoder(v)
        assert d.feed(want[:8]) + d.feed(want[8:]) + d.end() == lib.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)
        assert tokens.library_encoder(PATH).encode([text, None])[0] == want


def test_long_word_in_a_window(lib):
    r = random.Random(2)
    word = "".join(r.choices("abcdeinthgorxq", k=20_000))
    v = bpe.vocabulary(PATH)
    machine, held = bpe.Window(v), 0
    for i in range(0, 5000, 100):
        machine.feed(word[i : i + 100])
        held = max(held, len(machine.rest))
    assert held <= 4 * v.lookahead
    assert v.encode(word) == ids_of(lib, word)
    assert b"".join(bpe.encode_pieces(v, [word[i : i + 777] for i in range(0, len(word), 777)])) == ids_of(lib, word)


def test_memory_is_constant(lib):
    """Whatever the text, what the encoder keeps between pieces is bounded by its parameters, and most ids leave before the end."""
    v, r = bpe.vocabulary(PATH), random.Random(7)
    bound = bpe.HOLD + op1_bpe.PIECE + 4 * v.lookahead + 64
    texts = {
        "prose": " ".join("".join(r.choices("aeinthrsou", k=r.randint(1, 9))) for _ in range(400_000)),
        "one word": "".join(r.choices("abcdeinthgorxq", k=200_000)),
        "signs": "".join(r.choices("!?*#$%&|()", k=100_000)),
        "no spaces": "".join(r.choices("中文字漢語の한국어é", k=100_000)),
    }
    for text in texts.values():
        machine, held, early, late = bpe.Encoder(v), 0, 0, 0
        for i in range(0, len(text), op1_bpe.PIECE):
            early += len(machine.feed(text[i : i + op1_bpe.PIECE]))
            held = max(held, machine.held())
        late = len(machine.end())
        assert held <= bound and late < 4 * bound < early + late
    assert b"".join(op1_bpe._streams(v, texts["no spaces"])) == ids_of(lib, texts["no spaces"])


def test_walk_equals_merges():
    v, r = bpe.vocabulary(PATH), random.Random(3)
    for _ in range(400):
        text = "".join(r.choices("aeinthrsou", k=r.randint(1, 14)))
        assert v.walk(text) == v.merged(text)


def test_bytes_come_back():
    v = bpe.vocabulary(PATH)
    d = bpe.Decoder(v, surface=False)
    ids = v.encode("héllo wörld 😀")
    out = "".join(d.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + d.end()
    assert out == "héllo wörld 😀 "


def test_columns(spark, lib, odd_docs, no_docs):
    want = sorted((r.doc_id or -1, ids_of(lib, r.text)) for r in odd_docs.collect())
    rows = op1_bpe.digests(odd_docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in rows) == sorted((k, len(i) // 4, hashlib.sha256(" ".join(map(str, np.frombuffer(i, "<u4"))).encode()).hexdigest()) for k, i in want)
    back = op1_bpe.decode(op1_bpe.encode(odd_docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((k, lib.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False)) for k, i in want)
    assert op1_bpe.digests(no_docs, PATH).count() == 0


def test_simple8b():
    r = np.random.default_rng(0)
    for k in range(120):
        n, bits = int(r.choice([0, 1, 59, 60, 61, 4095, 4096, 4097, 9000])), int(r.choice([1, 2, 5, 13, 16, 31, 60, 61, 64]))
        x = (r.integers(0, 2**63, n, dtype=np.uint64) * 2 + r.integers(0, 2, n, dtype=np.uint64)) >> np.uint64(64 - bits)
        words, offsets = simple8b.encode(x)
        assert (simple8b.decode(words, offsets, n) == x).all()
        for i, o in enumerate(offsets):
            end = offsets[i + 1] if i + 1 < len(offsets) else len(words)
            m = min(simple8b.BLOCK, n - i * simple8b.BLOCK)
            assert (simple8b.decode(words[o:end], np.zeros(1, np.uint32), m) == x[i * simple8b.BLOCK :][:m]).all()


def test_id_files(spark, lib, odd_docs, no_docs, tmp_path):
    op8_idfiles.write_ids(odd_docs, str(tmp_path / "a"), PATH, segment_ids=50)
    rows = sorted(op8_idfiles.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    for r, d in zip(rows, docs):
        data = ids_of(lib, d.text) + (2).to_bytes(4, "little")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(data) // 4, zlib.crc32(data)) and np.array(r.ids, "<u4").tobytes() == data
        at += r.n_tokens
    op8_idfiles.write_ids(no_docs, str(tmp_path / "b"), PATH)
    assert op8_idfiles.read_ids(spark, str(tmp_path / "b")).count() == 0


def check_packing(rows, docs, lib, limit):
    """Each id of each document lies in exactly one piece, pieces carry their ids' checksum, sequences have no gaps. Documents of one id are told apart by their ids."""
    sequences, pieces = {}, collections.defaultdict(list)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    want = collections.defaultdict(list)
    for d in docs:
        ids = ids_of(lib, d.text) + (1).to_bytes(4, "little")
        n = len(ids) // 4
        want[d.doc_id] += [(n, at, min(limit, n - at), zlib.crc32(ids[4 * at : 4 * min(n, at + limit)])) for at in range(0, n, limit)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_packing(spark, lib, odd_docs, no_docs):
    rows = op9_packing.pack(odd_docs, PATH, limit=64).collect()
    n = check_packing(rows, odd_docs.collect(), lib, 64)
    assert n <= sum(r.length for r in rows) / 64 + 2
    assert op9_packing.pack(no_docs, PATH).count() == 0


def test_histogram_patterns():
    r = random.Random(1)
    for _ in range(50):
        h = {r.randint(1, 100): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        patterns = op9_packing.pack_histogram(h, 100)
        seen = {}
        for p, c in patterns:
            assert sum(p) <= 100 and list(p) == sorted(p, reverse=True)
            for x in p:
                seen[x] = seen.get(x, 0) + c
        assert seen == h
        for length, rows in op9_packing.slots(patterns).items():
            assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all() and length in h


def test_ids_do_not_depend_on_what_was_read_before(lib):
    """Runs of signs and capital sigmas, in a fresh encoder and after texts that leave bare signs in its memo; whole tables in two orders."""
    before = ["word) more words? and 5% x% *a and", "well.? then) (a *** b. ) , ? ! % $ # & | ( *", "ΟΔΟΣ ς σ ΟΔΟΣ."]
    texts = ["1.) First item of the list", "see page 4.) and more", "wait.? Then", "costs 5.% more", "ΟΔΟΣ, ΚΑΙ", "Η ΟΔΟΣ.", "ΛΟΓΟΣ!", "a .*** b", "x.'s it's don't. 'twas,'", "(.) ., a", "ΑΣ ΑΣ) ΑΣΑ.", "İ. ǅ, ﬁ."]
    for t in texts:
        assert tokens.LibraryEncoder(PATH).encode([t])[0] == ids_of(lib, t), t
    encoder = tokens.LibraryEncoder(PATH, size=2000)
    encoder.encode(before)
    assert encoder.encode(texts + before) == [ids_of(lib, t) for t in texts + before]
    docs = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    want = dict(zip(docs, (ids_of(lib, t) for t in docs), strict=True))
    for order in (docs, docs[::-1]):
        assert [want[t] for t in order] == [i for k in range(0, len(order), 300) for i in encoder.encode(order[k : k + 300])]


def test_known_parts_are_looked_up_together(lib):
    """A batch of known words costs far less than one Python call for each; memos are cut to what was used, and ids stay the library's."""
    r = random.Random(4)
    words = ["".join(r.choices("aeinthrsou", k=7)) for _ in range(20_000)]
    encoder = tokens.LibraryEncoder(PATH)
    texts = [" ".join(words[a : a + 100]) + " " + " ".join(w + "!?" for w in words[a : a + 20]) for a in range(0, len(words), 100)]
    first = encoder.encode(texts)
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    again = encoder.encode(texts)
    sys.setprofile(None)
    assert again == first and calls["c_call"] + calls["call"] < len(words) / 2
    small = tokens.LibraryEncoder(PATH, size=300)
    for a in range(0, 60, 3):
        assert small.encode(texts[a : a + 3] + texts[:1]) == [ids_of(lib, t) for t in texts[a : a + 3] + texts[:1]]
        assert len(small.words.row) <= 800 and len(small.words.flat) <= 8 * 800 and len(small.chunks.row) <= 500


def test_another_pattern_goes_to_the_library(tmp_path, lib):
    spec = json.loads(lib.to_str())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[^\s\p{L}]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    other, encoder = Tokenizer.from_file(str(path)), tokens.LibraryEncoder(str(path))
    assert not encoder.parts
    for t in ("it's 55 a.b, c", "ab 12. x"):
        assert encoder.encode([t])[0] == ids_of(other, t)

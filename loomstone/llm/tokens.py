"""Token ids of whole texts by the tokenizers library, memoised by word."""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import _ODD, SPACE
from .scratch import kept


def default_vocabulary() -> str:
    """The word-end vocabulary file of the public tokenizers package; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SPLIT = regex.compile(f"[{SPACE}]")

#: Signs that may stand behind a word; the pre-tokeniser keeps a run of signs together and apart from letters.
SIGNS = ".,;:!?*#$%&|()"

#: The normaliser and the pattern that parting relies on, as vocabulary files state them.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _lower(text: str) -> str:
    """Lower case, each code point by itself: a capital sigma at a word's end as well becomes the plain small one."""
    return text.replace("Σ", "σ").lower()


def strings(x: pa.Array) -> list[str]:
    """What ``to_pylist`` gives, without an Arrow scalar for each string: some ten times faster."""
    return x.to_numpy(zero_copy_only=False).tolist()


def _mask(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _pick(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one behind another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((first - ends + length).astype(kind), length) + np.arange(total, dtype=kind)]


class PartMemo:
    """Ids of parts: a row number for each part, and arrays of where its ids lie, so that those of a whole batch are put together at once.

    Beyond ``size`` parts only those stay that were looked up since the last cut, so a batch adds to a bounded store.
    """

    def __init__(self, size: int):
        self.size, self.row = size, {}
        self.first, self.length, self.used, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, "<u4")

    def find(self, parts: list[str]) -> np.ndarray:
        """The row of each part, -1 for one that isn't here."""
        at = np.fromiter(map(self.row.get, parts, repeat(-1)), np.int64, len(parts))
        self.used[at[at >= 0]] = True
        return at

    def add(self, parts: list[str], length: np.ndarray, flat: np.ndarray) -> None:
        """Distinct parts that aren't here yet, with their ids one behind another."""
        self.row.update(zip(parts, range(len(self.length), len(self.length) + len(parts)), strict=True))
        self.first = np.concatenate([self.first, np.cumsum(length) - length + len(self.flat)])
        self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.ones(len(length), bool)])

    def cut(self) -> None:
        if len(self.row) > self.size:
            kept = self.used
            self.flat, self.length = _pick(self.flat, self.first[kept], self.length[kept]), self.length[kept]
            self.row = {p: i for i, p in enumerate(compress(self.row, kept.tolist()))}
            self.first, self.used = np.cumsum(self.length) - self.length, np.zeros(len(self.length), bool)


class LibraryEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for each whole text.

    The pre-tokeniser's pattern never joins characters across white space, nor letters or digits with
    signs, but keeps a run of signs together.  So a text's ids are those of its white-space chunks, and
    where every stop and comma stands alone between letters, digits or spaces, those of its lower-case
    words, stops and commas.  How a text is parted depends on the text alone: the memo of words holds
    letters, digits and single stops and commas only, so a remembered sign never makes a text look like
    prose.  Texts that hold a special token's string aren't parted, nor is any text if the vocabulary has
    another normaliser or pattern.  Parts that aren't remembered go to the library in one call for a batch
    of texts.  Memos of about ``size`` parts bound the memory.
    """

    def __init__(self, path: str, size: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.words, self.chunks, self.signs = PartMemo(size), PartMemo(size // 3), PartMemo(size // 3)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        #: Which ids end a word, where the vocabulary says: many words can then be encoded as one text and told apart.
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)
            for token, i in self.lib.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
        #: The same model without normaliser and pattern, for lower-case ASCII words, to which neither does anything.
        self.bare = None
        if self.ends is not None:
            bare = Tokenizer(self.lib.model)
            bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            letters = "the quick brown fox jumps over thelazydogs sphinxofblackquartz a bc"
            if bare.encode(letters, add_special_tokens=False).ids == self.lib.encode(letters, add_special_tokens=False).ids:
                self.bare = bare
        self.parts = self._known()

    def _known(self) -> bool:
        """Whether the vocabulary has the normaliser and the pattern that parting relies on."""
        spec = json.loads(self.lib.to_str())
        normalizers = (spec["normalizer"] or {}).get("normalizers") or [spec["normalizer"]]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        replace = next((n for n in normalizers if n and n["type"] == "Replace"), {})
        return [n and n["type"] for n in normalizers] == NORMALIZERS and (replace["pattern"], replace["content"]) == ({"Regex": r"\s+"}, " ") and bool(splits[0]) and splits[0].get("pattern") == {"Regex": PATTERN}

    def _library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, memo: PartMemo, parts: pa.Array) -> None:
        """Adds distinct parts that aren't remembered; each kind of them goes to the library in its own way."""
        length, flat, held = np.zeros(len(parts), np.int64), [np.zeros(0, "<u4")], 0
        first, left = length.copy(), np.ones(len(parts), bool)

        def took(rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
            nonlocal held
            first[rows], length[rows], left[rows] = np.cumsum(sizes) - sizes + held, sizes, False
            flat.append(ids)
            held += len(ids)

        if self.ends is not None and len(parts):
            letters = _mask(pc.ascii_is_alpha(parts))
            if self.bare:
                for found in self._joined(self.bare, parts, np.flatnonzero(letters & _mask(pc.ascii_is_lower(parts)))):
                    took(*found)
            other = np.flatnonzero(~_mask(pc.string_is_ascii(parts)))
            letters[other] = [p.isalpha() and _lower(p).isalpha() for p in strings(parts.take(pa.array(other)))]
            for found in self._joined(self.lib, parts, np.flatnonzero(letters & left)):
                took(*found)
        rest = np.flatnonzero(left)
        for at in range(0, len(rest), 4096):
            rows = rest[at : at + 4096]
            ids = [e.ids for e in self.lib.encode_batch_fast(strings(parts.take(pa.array(rows))), add_special_tokens=False)]
            took(rows, np.array([len(i) for i in ids], np.int64), np.array([x for i in ids for x in i], "<u4"))
        memo.add(strings(parts), length, _pick(np.concatenate(flat), first, length))

    def _joined(self, lib, parts: pa.Array, rows: np.ndarray):
        """Encodes many words as one text and tells them apart by the ids that end a word: (rows, sizes, ids) of those texts that can be told apart so."""
        words = strings(parts.take(pa.array(rows)))
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.array(lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):  # else some word isn't one piece; they all go the plain way
                yield rows[at : at + 256], np.diff(cuts, prepend=0), ids

    def _prose(self, text: str) -> str | None:
        """A text with stops and commas set apart, in lower case; None if it holds something that could stand in the way."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return None
        low = _lower(text)
        if ".," in low or ".." in low or ",," in low or ",." in low or not (low.isascii() or unicodedata.is_normalized("NFC", low)):
            return None
        return low.replace(".", " . ").replace(",", " , ")

    def _shapes(self, chunks: pa.Array) -> np.ndarray:
        """Remembers chunks that are a word and then signs, by way of the word and the signs; which of them did so."""
        words = pc.utf8_rtrim(chunks, characters=SIGNS)
        cut = _mask(pc.not_equal(words, chunks))
        split = cut & _mask(pc.ascii_is_alpha(words))
        low = strings(pc.ascii_lower(words))
        for i in np.flatnonzero(cut & ~_mask(pc.string_is_ascii(words))).tolist():
            word, small = words[i].as_py(), _lower(words[i].as_py())
            split[i] = word.isalpha() and small.isalpha() and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", small)
            low[i] = small
        rows = pa.array(np.flatnonzero(split))
        own, low = strings(chunks.take(rows)), list(compress(low, split.tolist()))
        signs = [c[n:] for c, n in zip(own, pc.utf8_length(words.take(rows)).to_numpy().tolist(), strict=True)]
        at = [self._rows(memo, parts) for memo, parts in ((self.words, low), (self.signs, signs))]
        first = np.stack([self.words.first[at[0]], self.signs.first[at[1]] + len(self.words.flat)], 1)
        length = np.stack([self.words.length[at[0]], self.signs.length[at[1]]], 1)
        flat = np.concatenate([self.words.flat, self.signs.flat])
        self.chunks.add(own, length.sum(1), _pick(flat, first.ravel(), length.ravel()))
        return split

    def _rows(self, memo: PartMemo, parts: list[str]) -> np.ndarray:
        """The rows of words or signs in their memo, after those that are new have been added."""
        at = memo.find(parts)
        if (at < 0).any():
            self._learn(memo, pa.array(dict.fromkeys(compress(parts, (at < 0).tolist())), pa.large_string()))
            at = memo.find(parts)
        return at

    def _batch(self, texts: list[str], prose: bool) -> list[bytes | None]:
        """Ids of texts that are parted at ASCII white space; None where a part can't stand by itself.

        Equal parts of the batch are found first, so only distinct ones are looked up.
        """
        rows = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = rows.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary
        memo = self.words if prose else self.chunks
        at = memo.find(strings(parts))
        unknown = np.flatnonzero(at < 0)
        fresh = parts.take(pa.array(unknown))
        bad = np.zeros(len(fresh), bool)
        if prose:
            odd = np.flatnonzero(~_mask(pc.ascii_is_alnum(fresh)))
            bad[odd] = [not (p.isalnum() or p in ".,") for p in strings(fresh.take(pa.array(odd)))]
        else:
            odd = np.flatnonzero(~_mask(pc.string_is_ascii(fresh)))
            bad[odd] = [bool(_SPLIT.search(p)) for p in strings(fresh.take(pa.array(odd)))]
        wrong, unknown, fresh = unknown[bad], unknown[~bad], fresh.filter(pa.array(~bad))
        if not prose and len(fresh):
            self._learn(memo, fresh.filter(pa.array(~self._shapes(fresh))))
        elif len(fresh):
            self._learn(memo, fresh)
        at[unknown] = memo.find(strings(fresh))
        first, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = np.flatnonzero(at >= 0)
        first[known], length[known] = memo.first[at[known]], memo.length[at[known]]
        sizes = length[codes]
        ends = np.cumsum(sizes)
        out = _pick(memo.flat, first[codes], sizes)
        cuts = np.concatenate([[0], ends])[rows.offsets.to_numpy()]
        data = memoryview(out.tobytes())
        found: list[bytes | None] = [bytes(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if len(wrong):
            hit = np.searchsorted(rows.offsets.to_numpy(), np.flatnonzero(np.isin(codes, wrong)), side="right") - 1
            for k in np.unique(hit).tolist():
                found[k] = None
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out: list = [b""] * len(texts)
        prose: list[tuple[int, str]] = []
        other: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.parts or _ODD.search(text):
                whole.append(i)
            elif (low := self._prose(text)) is not None:
                prose.append((i, low))
            else:
                other.append(i)
        for (i, _), ids in zip(prose, self._batch([low for _, low in prose], True), strict=True):
            if ids is None:
                other.append(i)
            else:
                out[i] = ids
        if self.special:
            whole += [i for i in other if self.special.search(texts[i])]
            other = [i for i in other if not self.special.search(texts[i])]
        for i, ids in zip(other, self._batch([texts[i] for i in other], False), strict=True):
            if ids is None:
                whole.append(i)
            else:
                out[i] = ids
        for i in whole:
            out[i] = self._library(texts[i])
        for memo in (self.words, self.chunks, self.signs):
            memo.cut()
        return out


@kept
def library_encoder(path: str) -> LibraryEncoder:
    """One for each path and process."""
    return LibraryEncoder(path)

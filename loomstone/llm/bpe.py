"""Byte-pair encoding and decoding as bounded-lookahead streaming transducers.

A merge list has a *sufficient lookahead* L: the merges that cross a position depend on at most the L
symbols after it.  Tokens that end L symbols before the end of what has been read are therefore final
and leave the machine at once; the machine never holds more than a window of symbols, however long a
word is.  ``sufficient_lookahead`` computes L from the merges.  Every word passes through this machine
(``Window``), every text through ``Encoder`` in pieces; a memo of frequent short words stands in front.

Words are strings over 512 symbols: a byte, or a byte that ends a word (``chr(byte + 256)``).  So each
entry of the vocabulary is one string, and all work is on plain ``str`` slices.

Inside a window the machine walks left to right with the longest entry first and steps back where two
neighbours could not stand beside each other in a merged word; that gives the merge result without
replaying the merges.  Pair decisions are memoised.  White-space chunks and words are memoised in two
generations, so memory stays bounded and frequent words stay.

Edge cases: null or empty text gives no ids; special-token strings inside a text become their ids, as
the tokenizers library does; white space is that of the vocabulary's normaliser.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

#: Code points that the normaliser's white-space class holds.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[{SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the normaliser doesn't
_LETTERS = regex.compile(r"\p{L}*")
_MARKS = regex.compile(r"[^\s\p{L}\p{N}]*")
#: Longest chunk that is handled in one go, in characters.
HOLD = 2048


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a position that can decide about merges before it.

    Two texts that agree up to a position can differ before it only through a chain of merges with
    rising rank: the first joins ``u`` (before the frontier) to what follows, which moves the frontier
    to the start of ``u``; the next must take, as its right part, something that starts with ``u``.
    The longest such chain, weighted with the lengths of the left parts, bounds the shift.  Merges are
    visited from the last to the first; ``reach`` has, for each prefix of a right part, the longest
    chain that goes on from there.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in reversed(merges):
        best = len(left) + reach.get(left, 0)
        most = max(most, best)
        for end in range(1, len(right) + 1):
            if reach.get(right[:end], 0) < best:
                reach[right[:end]] = best
    return most + max((len(a) + len(b) for a, b in merges), default=0)


class Memo(dict):
    """A dict that computes what is missing and keeps two generations of at most ``size`` entries."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """A word-end byte-pair vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str, memo: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.stand_in = byte_chars()
        self.surface = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ids = {self.symbols(s): i for s, i in model["vocab"].items()}
        self.strings = {i: s for s, i in self.ids.items()}
        self.merges = [(self.symbols(a), self.symbols(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.rank = {m: r for r, m in enumerate(self.merges)}
        self.longest = max(map(len, self.ids))
        made = {s for s in self.ids if len(s) == 1}
        proper = True
        for a, b in self.merges:
            proper &= a in made and b in made and a + b not in made
            made.add(a + b)
        #: None where the list isn't one whose parts come before their whole, each made in one way: then whole words are merged.
        self.lookahead = sufficient_lookahead(self.merges) if proper else None
        self.prefixes = self._prefixes()
        self.pairs = Memo(self._stands, 400_000)
        self.words = Memo(self._word, memo)
        self.chunks = Memo(self._chunk, memo)

    def symbols(self, surface: str) -> str:
        """A vocabulary string in the 512 symbols."""
        ends = bool(self.suffix) and surface.endswith(self.suffix)
        body = [self.stand_in[c] for c in (surface[: -len(self.suffix)] if ends else surface)]
        return "".join(map(chr, body[:-1] + [body[-1] + 256] if ends else body))

    def _prefixes(self) -> dict[str, str | None]:
        """For each entry, the longest entry that is a proper prefix of it."""
        found: dict[str, str | None] = {}
        for s in self.ids:
            end = len(s) - 1
            while end and s[:end] not in self.ids:
                end -= 1
            found[s] = s[:end] or None
        return found

    def merged(self, text: str) -> list[str]:
        """The entries of a symbol string by replaying merges; the definition, used for pairs and for lists that aren't proper."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def walk(self, text: str) -> list[str]:
        """The entries of a symbol string, longest first with steps back."""
        ids, pairs, prefixes, longest = self.ids, self.pairs, self.prefixes, self.longest
        out: list[str] = []
        dead: set[int] = set()
        at, n = 0, len(text)

        def start(at: int) -> str:
            end = min(n, at + longest)
            while (token := text[at:end]) not in ids:
                end -= 1
                if end == at:
                    raise ValueError("a symbol has no entry")
            return token

        token: str | None = start(0) if n else None
        while at < n:
            end = at + len(token)
            if (end not in dead if dead else True) and (not out or pairs[out[-1], token]):
                out.append(token)
                at = end
                if at < n:
                    token = start(at)
                continue
            token = prefixes[token]
            while token is None:
                dead.add(at)
                last = out.pop()
                at -= len(last)
                token = prefixes[last]
        return out

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256 if self.suffix else data[-1])
        if text in self.ids:
            return array("I", [self.ids[text]]).tobytes()
        machine = Window(self)
        return machine.feed(text) + machine.end()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and len(chunk) < 64:
            return self.words[chunk]
        found = self.pattern.findall(chunk)
        return b"".join([self.words[w] if len(w) < 64 else self._word(w) for w in found])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if self.special_split and "<|" in text and len(parts := self.special_split.split(text)) > 1:
            return b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return self._chunks(_normal(text))

    def _chunks(self, text: str) -> bytes:
        chunks = [c for c in _SPLIT.split(text) if c] if _ODD.search(text) else text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks)) if len(text) < HOLD or max(map(len, chunks), default=0) < HOLD else b"".join([self.chunks[c] if len(c) < HOLD else self._chunk(c) for c in chunks])
        except KeyError as missing:
            raise ValueError(f"no entry for {missing}") from None


def _normal(text: str) -> str:
    """Normal form C and lower case, each code point by itself."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Window:
    """The transducer over one word: takes symbols, gives ids as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.rest = vocabulary, ""
        self.limit = 4 * vocabulary.lookahead if vocabulary.lookahead is not None else None

    def feed(self, symbols: str) -> bytes:
        out = []
        while self.limit is not None and len(self.rest) + len(symbols) > self.limit:
            take = self.limit - len(self.rest) + 1
            self.rest, symbols = self.rest + symbols[:take], symbols[take:]
            kept = len(self.rest) - self.v.lookahead
            end = 0
            for token in self.v.walk(self.rest):
                if end + len(token) > kept:
                    break
                end += len(token)
                out.append(self.v.ids[token])
            self.rest = self.rest[end:]
        self.rest += symbols
        return array("I", out).tobytes()

    def end(self) -> bytes:
        tokens = self.v.walk(self.rest) if self.limit is not None else self.v.merged(self.rest)
        self.rest = ""
        return array("I", [self.v.ids[t] for t in tokens]).tobytes()


def _cut(text: str) -> int:
    """The last place where a text without white space can be cut before normalisation: before a starter that nothing composes with."""
    at = len(text) - 1
    while at > 0:
        c = text[at]
        if c.isascii() or (unicodedata.category(c)[0] != "M" and not "ᅠ" <= c <= "ᇿ"):
            break
        at -= 1
    if (mark := text.rfind("<|", max(0, at - 20), at + 1)) > 0 and ">" not in text[mark:at]:
        at = mark
    return max(at, 0)


class Encoder:
    """Encodes a text that comes in pieces of any length; holds a bounded tail."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.rest, self.tail = vocabulary, "", ""
        self.run: tuple[Window, regex.Pattern, str] | None = None  # inside a long word: its machine, its class, its last character

    def feed(self, text: str) -> bytes:
        self.rest += text
        cut = max(self.rest.rfind(" "), self.rest.rfind("\n"))
        out = b""
        if cut > 0:
            block, self.rest = self.rest[:cut], self.rest[cut:]
            out = self._long(block, True) if self.run or self.tail else self.v.encode(block)
        while len(self.rest) > HOLD and (cut := _cut(self.rest)) > 0:
            block, self.rest = self.rest[:cut], self.rest[cut:]
            out += self._long(block, False)
            if len(self.rest) <= HOLD:
                break
        return out

    def end(self) -> bytes:
        block, self.rest = self.rest, ""
        return self._long(block, True) if self.run or self.tail else self.v.encode(block)

    def held(self) -> int:
        """Characters and symbols that are kept for what comes."""
        return len(self.rest) + len(self.tail) + (len(self.run[0].rest) + 1 if self.run else 0)

    def _long(self, block: str, final: bool) -> bytes:
        """A stretch that may end inside a word. What ends it is kept as text, or as a machine's window if it is long."""
        out: list[bytes] = []
        parts = self.v.special_split.split(block) if self.v.special_split else [block]
        for k, part in enumerate(parts):
            if part in self.v.special:
                out.append(array("I", [self.v.special[part]]).tobytes())
            else:
                out.append(self._part(_normal(part), final or k + 1 < len(parts)))
        return b"".join(out)

    def _part(self, text: str, final: bool) -> bytes:
        out: list[bytes] = []
        if self.run:
            machine, kind, last = self.run
            grown = kind.match(text)[0]
            if grown:
                out.append(machine.feed(last[:0] + (last + grown)[:-1].encode().decode("latin-1")))
                last = grown[-1]
            text = text[len(grown) :]
            self.run = (machine, kind, last)
            if text or final:
                data = last.encode()
                out.append(machine.feed(data[:-1].decode("latin-1") + chr(data[-1] + 256)) + machine.end())
                self.run = None
        text, self.tail = self.tail + text, ""
        if final:
            out.append(self.v._chunks(text))
            return b"".join(out)
        last = None
        for last in self.v.pattern.finditer(text):
            pass
        if last is None or last.end() < len(text):
            out.append(self.v._chunks(text))
        else:
            out.append(self.v._chunks(text[: last.start()]))
            word = last[0]
            if len(word) > 64 and self.v.lookahead is not None:
                machine = Window(self.v)
                out.append(machine.feed(word[:-1].encode().decode("latin-1")))
                self.run = (machine, _LETTERS if word[-1].isalpha() else _MARKS, word[-1])
            else:
                self.tail = word
        return b"".join(out)


class Decoder:
    """Turns ids into text piece by piece.

    ``surface`` joins vocabulary strings with one space, which is what the tokenizers library does for a
    file without a decoder.  Otherwise ids become bytes, a word end becomes a space, and an incremental
    UTF-8 machine holds the bytes of an unfinished character.
    """

    def __init__(self, vocabulary: Vocabulary, surface: bool = True):
        import codecs

        self.surface, self.first = surface, True
        self.table = surfaces(vocabulary) if surface else raw_bytes(vocabulary)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        if not ids:
            return ""
        data = (b" " if self.surface else b"").join(map(self.table.__getitem__, array("I", ids)))
        if self.surface:
            data, self.first = data if self.first else b" " + data, False
        return self.machine.decode(data)

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(4)
def surfaces(vocabulary: Vocabulary) -> list[bytes]:
    """Vocabulary strings in UTF-8, by id."""
    return [vocabulary.surface.get(i, "").encode() for i in range(max(vocabulary.surface) + 1)]


@lru_cache(4)
def raw_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes that each id stands for."""
    table = [b""] * (max(vocabulary.surface) + 1)
    for i, s in vocabulary.surface.items():
        symbols = vocabulary.strings.get(i)
        table[i] = s.encode() if symbols is None else bytes(ord(c) % 256 for c in symbols) + b" " * (ord(symbols[-1]) > 255)
    return table


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each path and process, so workers keep their memo from task to task."""
    return Vocabulary(path)


def encode_pieces(v: Vocabulary, pieces: Iterable[str]) -> Iterator[bytes]:
    """Ids of a text that comes in pieces, as they become final."""
    machine = Encoder(v)
    for piece in pieces:
        if out := machine.feed(piece):
            yield out
    if out := machine.end():
        yield out

"""PII surrogates: keyed, type-consistent replacements that keep entities apart and mentions together.

Detection finds e-mail addresses, telephone numbers, payment cards (with or without a valid check digit), IPv4
addresses, national ids (SSN), IBANs, hexadecimal secrets, API keys with a well-known prefix and person names
behind a title.  Names without a title aren't detected.  An entity is its kind and canonical form, so all mentions
of one entity, in any document, get the same surrogate.

Letters and digits are replaced by a keyed permutation of strings of the same length and alphabet, a
Feistel network in blocks; separators, case, country codes and check digits keep their form.  Names are
drawn by keyed hash from lists of the same script and gender.  Each entity's surrogate is then checked
against all others: it must be no other entity's surrogate and no entity that occurs in the corpus.
Losers try again with the next tweak, until none is left.  From tweak ``WIDER`` on what is drawn from grows with each
tweak: names get more parts, e-mail addresses a longer local part, telephone numbers more digits, and private IPv4
addresses any private network, so that any number of entities finds surrogates.  Kinds of a fixed length have as
many surrogates as there are strings of their form; it is an error if a corpus uses them up.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rewrite import keyed, rewrite
from .scratch import map_batches, stored, table

#: The tweak from which on spaces grow; rounds without a resolved entity after which a space is taken to be used up.
WIDER, IDLE = 3, 16

#: Titles with the gender they name, and given and family names by script and gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Госпожа": "f",
    "Dr": "", "Prof": "",
}
GIVEN = {
    ("latin", "m"): "Adam Ben Carl David Erik Felix Georg Hugo Ivan Jakob Karl Liam Max Noah Oscar Paul Ralf Simon Tom Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Hanna Ida Julia Karla Lena Maria Nora Olga Paula Rita Sara Tina Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
}
FAMILY = {
    ("latin", ""): "Abel Baker Conrad Dale Egan Foster Grant Hale Irving Jensen Keller Lang Moore Nolan Olsen Parker Quinn Reed Stone Turner Ulrich Vogel Weber York".split(),
    ("cyrillic", "m"): "Алексеев Белов Волков Громов Данилов Ершов Жуков Зайцев Ильин Козлов Лебедев Морозов Новиков Орлов Попов Рыбаков".split(),
    ("cyrillic", "f"): "Алексеева Белова Волкова Громова Данилова Ершова Жукова Зайцева Ильина Козлова Лебедева Морозова Новикова Орлова Попова Рыбакова".split(),
}

#: Networks that addresses stay in; all others form one class.
IP_CLASSES = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/3")

_NAME = r"\p{Lu}[\p{L}'’-]+"
_KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,18}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])\d{4}(?:([ -]?)\d{4}\1\d{4}\1\d{4}|[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
}


def _patterns():
    import regex

    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    name = rf"(?<!\w)(?:{titles})\.? (?P<person>{_NAME}(?: {_NAME}){{0,2}})"
    return {k: regex.compile(v) for k, v in _KINDS.items()} | {"name": regex.compile(name)}, regex.compile(r"[0-9@]"), regex.compile(rf"(?<!\w)(?:{titles})\b")


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "iban", "ssn"):
        return re.sub(r"[^0-9A-Za-z]", "", text)
    if kind == "phone":
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "secret":
        return text.lower()
    return " ".join(text.split())


def find(text: str | None, patterns=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, in order and apart; where two overlap, the earlier kind of the list above stands. None for null and empty texts."""
    if not text:
        return []
    kinds, hint, title = patterns or _patterns()
    found: list[tuple[int, int, str]] = []
    for kind, pattern in kinds.items():
        if kind == "name":
            if not title.search(text):
                continue
            hits = [m.span("person") for m in pattern.finditer(text)]
        elif not hint.search(text) and kind not in ("secret", "key"):
            continue
        else:
            hits = [m.span() for m in pattern.finditer(text)]
        found += [(a, b, kind) for a, b in hits if not any(a < y and x < b for x, y, _ in found)]
    return sorted(found)


# --- keyed permutations -------------------------------------------------------------------------------


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size): a Feistel network over two near-square halves, walked until it stays inside."""
    if size < 2:
        return value
    width = max(2, int(size**0.5))
    while width * width < size:
        width += 1
    while True:
        left, right = divmod(value, width)
        for r in range(8):
            left, right = right, (left + _prf(key, label, size, r, right)) % width
        value = left * width + right
        if value < size:
            return value


_ALPHABETS = {"d": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef"}


def run_permuted(text: str, alphabet: str, key: bytes, label: str) -> str:
    """A permutation of strings of one alphabet and length, in blocks of at most twelve characters chained left to right."""
    letters, out, before = _ALPHABETS[alphabet], [], ""
    for at in range(0, len(text), 12):
        block = text[at : at + 12]
        value = 0
        for c in block:
            value = value * len(letters) + letters.index(c)
        value = permuted(value, len(letters) ** len(block), key, f"{label}/{alphabet}/{at}/{before}")
        made = ""
        for _ in block:
            value, digit = divmod(value, len(letters))
            made = letters[digit] + made
        out.append(made)
        # A digest of all blocks so far keys the next one.
        before = hashlib.sha256((before + made).encode()).hexdigest() if len(text) > at + 12 else ""
    return "".join(out)


def _runs(text: str, key: bytes, label: str) -> str:
    """Each run of letters of one case and each run of digits permuted, all else kept."""
    kind = lambda c: "d" if c.isdigit() else "A" if c.isupper() else "a"
    return re.sub(r"[a-z]+|[A-Z]+|[0-9]+", lambda m: run_permuted(m[0], kind(m[0][0]), key, label), text)


def luhn(digits: str) -> int:
    """The check digit that completes a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def script(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def gender(name: str, title: str = "") -> str:
    """m or f: that of the title, else of the given name's list, else by its last letter."""
    if TITLES.get(title.rstrip(".")):
        return TITLES[title.rstrip(".")]
    first = name.split()[0]
    for (_, g), names in GIVEN.items():
        if first in names:
            return g
    return "f" if first[-1] in "aаяeé" else "m"


def surrogate(kind: str, value: str, key: bytes, tweak: int = 0) -> str:
    """The surrogate of a canonical value. For one kind, tweak and key, other than for names, different values have different surrogates."""
    label = f"{kind}/{tweak}"
    if kind == "email":
        local, domain = value.split("@", 1)
        labels = domain.split(".")
        made = _runs(local, key, label + "/local")
        if tweak >= WIDER:  # at most 64 characters, as in mentions
            more = "".join(_ALPHABETS["a"][_prf(key, label, "more", i, value) % 26] for i in range(2 * (tweak - WIDER + 1)))
            made = made[: 64 - len(more)] + more
        return made + "@" + ".".join(_runs(x, key, label + "/domain") if i < len(labels) - 1 and x != "example" else x for i, x in enumerate(labels))
    if kind == "phone":
        # The country code stays: one digit behind a plus sign where that is 1 or 7, else two.
        code = (2 if value[1:2] in ("1", "7") else 3) if value.startswith("+") else 0
        more = "".join(str(_prf(key, label, "more", i, value) % 10) for i in range(tweak - WIDER + 1))
        return value[:code] + run_permuted(value[code:], "d", key, label) + more
    if kind == "card":
        if luhn(value[:-1]) == int(value[-1]):
            body = run_permuted(value[:-1], "d", key, label)
            return body + str(luhn(body))
        while True:  # a number that fails the check keeps failing it
            value = run_permuted(value, "d", key, label)
            if luhn(value[:-1]) != int(value[-1]):
                return value
    if kind == "ip":
        address = ipaddress.IPv4Address(value)
        for net in map(ipaddress.IPv4Network, IP_CLASSES):
            if address in net and address.is_private and net.num_addresses < 1 << 24 and tweak >= WIDER:  # a small network may be used up
                wide = ipaddress.IPv4Network("10.0.0.0/8")
                return str(wide[_prf(key, label, value) % wide.num_addresses])
            if address in net:  # the network stays, the host is permuted
                return str(net[permuted(int(address) - int(net[0]), net.num_addresses, key, f"{label}/{net}")])
        number = int(address)
        while True:
            number = permuted(number, 1 << 32, key, label)
            made = ipaddress.IPv4Address(number)
            if not any(made in ipaddress.IPv4Network(n) for n in IP_CLASSES):
                return str(made)
    if kind == "iban":
        body = value[4:]
        made = "".join(x.upper() if x.isalpha() else x for x in _runs(body.lower(), key, label))
        number = int("".join(str(int(c, 36)) for c in made + value[:2] + "00"))
        return value[:2] + f"{98 - number % 97:02d}" + made
    if kind == "secret":
        return run_permuted(value, "h", key, label)
    if kind == "key":
        head = re.match(r"[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-|AKIA|AIza", value)[0]
        return head + _runs(value[len(head) :], key, label)
    if kind == "ssn":
        return run_permuted(value, "d", key, label)
    title, _, name = value.partition("|")
    return _person(name, gender(name, title), key, label, tweak)


def _person(name: str, g: str, key: bytes, label: str, tweak: int) -> str:
    """A name of as many words, of the same script and gender; the first tweak adds an initial, and each further one a part of the family name, to what it draws from."""
    s, words = script(name), name.split()
    given, family = GIVEN[s, g], FAMILY.get((s, g)) or FAMILY[s, ""]
    pick = lambda names, part: names[_prf(key, label, part, name, g) % len(names)]
    made = [pick(given, "given")] + [pick(family, f"family{i}") for i in range(1, len(words))] if len(words) > 1 else [pick(family, "family")]
    if tweak:
        letters = "ABCDEFGHIKLMNOPRSTUVWZ" if s == "latin" else "АБВГДЕЖЗИКЛМНОПРСТУФ"
        made[-1] += "".join("-" + pick(family, f"more{i}" if i else "more") for i in range(tweak - 1))
        made.insert(1 if len(made) > 1 else 0, pick(letters, "initial") + ".")
    return " ".join(made)


def dressed(kind: str, mention: str, made: str) -> str:
    """A surrogate in the form of one mention: its separators and its case."""
    if kind in ("card", "iban", "ssn", "phone"):
        rest = iter(made[1:] if kind == "phone" and made.startswith("+") else made)
        return "".join(next(rest) if c.isalnum() else c for c in mention) + "".join(rest)
    if kind == "secret" and mention.isupper():
        return made.upper()
    if kind == "email" and mention != mention.lower():
        if mention.isupper():
            return made.upper()
        (local, domain), (own, place) = mention.split("@", 1), made.split("@", 1)
        return _cased(local, own) + "@" + _cased(domain, place)
    return made


def _cased(like: str, text: str) -> str:
    """A text with capitals where ``like`` has them."""
    return "".join(c.upper() if i < len(like) and like[i].isupper() else c for i, c in enumerate(text))


# --- the corpus ----------------------------------------------------------------------------------------


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, t, u, start, end, kind, entity, mention): every entity in every text. A name's entity has its gender before it, so that a name shared by a man and a woman is two."""

    def run(batches):
        patterns = _patterns()
        names = ("doc_id", "t", "u", "start", "end", "kind", "entity", "mention")
        for b in batches:
            out = {n: [] for n in names}
            for doc_id, t, u, text in zip(b["doc_id"], b["t"], b["u"], b["text"], strict=True):
                for a, e, kind in find(text, patterns):
                    entity = canonical(kind, text[a:e])
                    if kind == "name":
                        title = text[max(0, a - 40) : a].rstrip().rsplit(None, 1)[-1].lstrip("([\"'")
                        g = gender(entity, title)
                        entity = f"{'Mr' if g == 'm' else 'Ms'}|{entity}"
                    for n, x in zip(names, (doc_id, t, u, a, e, kind, entity, text[a:e]), strict=True):
                        out[n].append(x)
            yield out

    return map_batches(keyed(docs).where(F.length("text") > 0), run, "doc_id long, t long, u long, start long, end long, kind string, entity string, mention string")


def _drawn(entities: DataFrame, key: bytes, tweak: int) -> DataFrame:
    """(kind, entity, made, turn): each entity's surrogate and its place in the keyed order. The key is in no column and no expression."""

    def run(batches):
        for b in batches:
            both = list(zip(b["kind"], b["entity"], strict=True))
            yield b | {"made": [surrogate(k, e, key, tweak) for k, e in both], "turn": [f"{_prf(key, 'turn', k, e):064x}" for k, e in both]}

    return map_batches(entities.select("kind", "entity"), run, "kind string, entity string, made string, turn string")


def resolved(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, made): one surrogate for each entity, no two alike and none that is itself an entity of the corpus.

    Each round draws for the entities that are left; of equal draws the first in keyed order wins.  Mentions are
    folded to entities before they are shuffled.  Rounds end when no entity is left; a space of fixed length that a
    corpus uses up is an error, not a collision.  No mentions give no rows.
    """
    entities = stored(found.select("kind", "entity").distinct(), "entities")
    # A name's own form has no gender before it.
    taken = entities.select("kind", F.element_at(F.split("entity", r"\|"), -1).alias("made")).distinct()
    done, left, count, idle, tweak = None, entities, entities.count(), 0, 0
    while count:
        drawn = stored(_drawn(left, key, tweak), "drawn")
        free = drawn.join(taken, ["kind", "made"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        # A fold before the shuffle: one winner for each surrogate.
        won = stored(free.groupBy("kind", "made").agg(F.min_by("entity", "turn").alias("entity")).select("kind", "entity", "made"), "won")
        done = won if done is None else done.union(won)
        left = stored(left.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"), "left")
        before, count, tweak = count, left.count(), tweak + 1
        idle = idle + 1 if count == before else 0
        if idle >= IDLE:
            kinds = [r["kind"] for r in left.select("kind").distinct().collect()]  # at most one for each kind
            raise ValueError(f"the corpus uses up all surrogates of {', '.join(sorted(kinds))}")
    return done if done is not None else entities.select("kind", "entity", F.lit("").alias("made"))


def replacements(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, t, u, start, end, kind, put) of every mention, repeated rows included.

    Mentions and surrogates meet by entity in a sort-merge join, of which Spark splits the partition of an entity that
    has very many mentions.
    """
    found = stored(mentions(docs), "mentions")
    made = resolved(found, key).hint("merge")
    names = ("doc_id", "t", "u", "start", "end", "kind")

    def run(batches):
        for b in batches:
            yield {n: b[n] for n in names} | {"put": [dressed(k, m, s) for k, m, s in zip(b["kind"], b["mention"], b["made"], strict=True)]}

    joined = found.join(made, ["kind", "entity"]).select(*names, "mention", "made")
    return map_batches(joined, run, "doc_id long, t long, u long, start long, end long, kind string, put string")


def anonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced and ``n_chars`` set anew; all rows and other columns stay, whatever their names. Null and empty texts stay as they are, repeated rows are edited alike, an empty table stays empty."""
    return rewrite(docs, replacements(docs, key).select("doc_id", "t", "u", "start", "end", "put"))


#: The query's key; a deployment passes its own.
QUERY_KEY = b"loomstone surrogate key"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each replaced mention: doc_id, start and end in characters, kind and surrogate. Null and empty texts have none; a row that is repeated whole has its mentions again."""
    made = replacements(table(spark, sf_dir, "documents"), QUERY_KEY)
    return made.select("doc_id", "start", "end", "kind", F.col("put").alias("surrogate"))

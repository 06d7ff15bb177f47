"""The divergence audit, the conversation repair and the n-gram model against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomstone.llm import op11_divergence, op12_conversations, op13_kneser_ney

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least):
    """(lang, source, part, item, value, rank) from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for at, _, terms in found if at == lang for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= least)
        sources = sorted({r[1] for r in rows if r[0] == lang})
        count = {s: Counter(t for at, of, terms in found if (at, of) == (lang, s) for t in terms if docs[t] >= least) for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])  # noqa: B023, E731
        for s in sources:
            pair = sorted((-sum(f(s, o, t) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(s, None, t), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pair, 1)}
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(term[:10], 1)}
    return out


def test_divergence_audit(spark, odd_docs, no_docs):
    r = random.Random(4)
    words = ["The", "the", "É", "éa", "x1y", "中文", "z", " ", "a-b", "Q", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "d", "e", None, "ü"]), r.choice([None, ""]) if r.random() < 0.1 else " ".join(r.choices(words, k=r.randint(1, 30)))) for _ in range(200)] + [("xx", "only", "one two"), ("yy", "p", "rare"), ("yy", "q", None)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "lang string, source string, text string, n string").repartition(5)
    for least, block, slab, chunk in ((3, 2, 1, 4), (10, 16, 8, 1 << 14)):
        got = op11_divergence.audit(docs, least, block, slab, chunk).collect()
        assert {tuple(x) for x in got} == plain_audit(rows, least) and len(got) == len({tuple(x) for x in got})
    odd = [(x.lang, x.source, x.text) for x in odd_docs.collect()]
    assert {tuple(x) for x in op11_divergence.audit(odd_docs, 2).collect()} == plain_audit(odd, 2)
    assert op11_divergence.audit(no_docs).count() == 0


def test_rates_are_exact():
    r = random.Random(9)
    for _ in range(2000):
        total = r.randint(1, 9 * 10**15)
        count = r.randint(0, total)
        assert int(op11_divergence.rates(op11_divergence.np.int64(count), op11_divergence.np.int64(total))) == 1 + 10**9 * count // total


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, text) of (turn, role, text) by trying strings of edits in order of cost."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip("\t\n\x0b\x0c\r ")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    ways = {"": (0, "", ())}  # by role initials so far: cheapest string and what it says

    def insert(ways):
        for _ in range(3):
            for done, (cost, audit, said) in list(ways.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    new = (cost + 2, audit + "I", (*said, f"{name}:"))
                    if len(done) <= 2 * len(rows) + 2 and new[:2] < ways.get(done + x, (1 << 60, ""))[:2]:
                        ways[done + x] = new
        return {d: w for d, w in ways.items() if re.fullmatch("(s?(ua)*u?)?", d)}

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for done, (cost, audit, said) in insert(ways).items():
            options = [(done, cost + 3, audit + "D", said)]
            if fault not in ("b", "d"):
                late = fault == "t"
                options += [(done + role[:1], cost + late, audit + "K", (*said, f"{role}:{text}"))] * bool(role) + [(done + n[0], cost + 2 + late, audit + "R", (*said, f"{n}:{text}")) for n in ("user", "assistant")]
            for d, *way in options:
                if re.fullmatch("(s?(ua)*u?)?", d) and tuple(way[:2]) < new.get(d, (1 << 60, ""))[:2]:
                    new[d] = tuple(way)
        ways = new
    cost, audit, said = min((w for d, w in insert(ways).items() if re.fullmatch("(s?(ua)+)?", d)), key=lambda w: w[:2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(said))


def conversations(seed, n, longest):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for i in range(r.randint(1, longest)):
            turn = r.choice([None, i, i, i, i, i + 1])
            out.append((None if c == 3 else c, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice([f"Turn {r.randint(0, 4)}.", "No end", "  ", "", None, "End.\u0085", "Yes!\t "])))
    return out


@pytest.mark.parametrize(("segment", "batch", "parts"), [(128, 4096, 4), (2, 7, 5), (3, 3, 2)])
def test_repair_equals_trying_all(spark, segment, batch, parts):
    rows = conversations(segment, 60, 7)
    frame = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, cost int").repartition(parts)
    got = {x.conv_id: x for x in op12_conversations.repaired(op12_conversations.as_they_are(frame), segment, batch).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, x in got.items():
        *want, said = plain_repair([(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv])
        assert [x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit] == want, conv
        assert x.repaired_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_damage_and_a_long_conversation(spark):
    rows = conversations(1, 40, 6) + [(99, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 50}.") for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    hurt = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        hurt[c] += [] if fate == 0 else [(t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] * (2 if fate == 3 else 1)
    got = {x.conv_id: x for x in op12_conversations.repaired(op12_conversations.damaged(frame).persist(), 32, 64).collect()}
    assert set(got) == set(hurt)
    for conv, x in got.items():
        if conv == 99:
            assert len(x.audit.replace("I", "")) == len(hurt[99]) and x.duplicate > 500
            continue
        *want, said = plain_repair(hurt[conv])
        assert [x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit] == want, conv
        assert x.repaired_sha256 == hashlib.sha256(said.encode()).hexdigest()
    gone = spark.createDataFrame([(1, t, "user", "Hi.") for t in range(400) if zlib.crc32(f"1:{t}".encode()) % 20 == 0], frame.schema)
    assert [tuple(x) for x in op12_conversations.repaired(op12_conversations.damaged(gone).persist()).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op12_conversations.repaired(op12_conversations.damaged(frame.where("false")).persist()).count() == 0


def plain_model(texts, order):
    """A function from words and an n-gram's history to its probability, from dicts of tuples."""
    counts = [None] * (order + 1)
    for k in range(order, 0, -1):
        seen = Counter()
        for words in texts:
            line = ["<s>", *words, "</s>"]
            for j in range(1, len(line)):
                gram = tuple(line[max(0, j - k + 1) : j + 1])
                if len(gram) == k and (k == order or gram[0] == "<s>"):
                    seen[gram] += 1
        if k < order:
            for gram in counts[k + 1]:
                seen[gram[1:]] += 1
        counts[k] = seen
    vocabulary = {w for words in texts for w in [*words, "</s>"]}
    discounts = [None]
    for k in range(1, order + 1):
        t = Counter(counts[k].values())
        discounts.append(op13_kneser_ney.discounts(t[1], t[2], t[3], t[4]))
    after = defaultdict(list)
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            after[gram[:-1]].append(c)

    def probability(gram):
        if not gram:
            return 1 / (len(vocabulary) + 1)
        shorter = probability(gram[1:])
        follow, by = after.get(gram[:-1]), (0, *discounts[len(gram)])
        if not follow:
            return shorter
        c = counts[len(gram)][gram]
        return (max(c - by[min(c, 3)], 0) + sum(by[min(f, 3)] for f in follow) * shorter) / sum(follow)

    return probability


def test_scores_equal_a_plain_model(spark, odd_docs, no_docs):
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choices(words[: r.choice([3, 10, 30])], k=r.randint(0, 25)))) for i in range(120)] + [(500, None), (501, ""), (502, "Never SEEN w1 w2"), (None, "w1 W2 w3"), (7, "w1 w1"), (7, "w1 w1")]
    rows += [(x.doc_id, x.text) for x in odd_docs.collect()]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double").repartition(4)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learnt = [split(t) for i, t in rows if not out(i)]
    counts = Counter(w for words in learnt for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    for order in (1, 2, 3):
        model = op13_kneser_ney.fit(docs.where(~op13_kneser_ney.held_out()), order, share=200)
        probability = plain_model(learnt, order)
        want = []
        for i, t in rows:
            line = ["<s>", *split(t), "</s>"]
            score = sum(math.log10(probability(tuple(line[max(0, j - order + 1) : j + 1]) if order > 1 else (line[j],))) for j in range(1, len(line)))
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*line[1:-1], None])
            want.append((i is None, i or 0, out(i), len(line) - 1, sum(counts[w] > 0 for w in [*line[1:-1], None]), n, round(base, 6), round(score, 6)))
        got = [(x.doc_id is None, x.doc_id or 0, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in op13_kneser_ney.scores(docs, model).collect()]
        assert sorted(got) == sorted(want)
    empty = op13_kneser_ney.fit(no_docs)
    assert op13_kneser_ney.scores(no_docs, empty).count() == 0
    assert all(x.score < 0 and x.n_known == 0 for x in op13_kneser_ney.scores(docs.where("doc_id = 502"), empty).collect()) or empty.words == 0


def test_held_out_texts_are_likelier_than_by_words(spark):
    x = op13_kneser_ney.op13_kneser_ney(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert x.s > x.b * 0.95

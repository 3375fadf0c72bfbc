import random

import pytest

from roadloom.llm import leaks
from roadloom.llm.leaks import NEEDED, SPAN, STRETCH, holds_stretch, leaked_items, plain_words

RNG = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "dat", "vik") for c in ("a", "o", "is", "um")]
COMMON = ["the", "of", "and", "to", "with", "a"]


def sentence(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.35 else RNG.choice(WORDS) for _ in range(n)]


PASSAGES = {i: sentence(70) for i in range(6)}


def brute(words, passage):
    """Longest common subsequence of every stretch with every span, by plain tables."""
    for s in range(len(passage) - STRETCH + 1):
        stretch = passage[s : s + STRETCH]
        for a in range(len(words)):
            table = [0] * (STRETCH + 1)
            for w in words[a : a + SPAN]:
                new = [0]
                for j, x in enumerate(stretch):
                    new.append(max(table[j + 1], new[-1], table[j] + 1 if x == w else 0))
                table = new
            if table[-1] >= NEEDED:
                return True
    return False


def changed(words, n):
    words = list(words)
    for i in RNG.sample(range(len(words)), n):
        words[i] = RNG.choice(["zzz", "strange", *COMMON])
    return words


DOCS = {}
for k in range(40):
    item = k % 6
    a = RNG.randrange(0, 45)
    part = PASSAGES[item][a : a + RNG.choice([12, 17, 20, 20, 24, 40])]
    part = changed(part, RNG.choice([0, 1, 2, 3, 4]) if len(part) > 15 else 0)
    if k % 5 == 0:
        at = len(part) // 2
        part = part[:at] + ["for", "this", "price", "quite", "odd"] + part[at:]
    DOCS[1000 + k] = sentence(15) + part + sentence(15)


def test_the_exact_check_is_brute_force():
    for words in DOCS.values():
        places = {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
        for passage in PASSAGES.values():
            assert holds_stretch(words, places, passage) == brute(words, passage)


@pytest.mark.parametrize("shard", [5_000, 4])
def test_operator_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD_ITEMS", shard)
    docs = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in DOCS.items()] + [(5, None, "x", 1), (6, "", "x", 1), (None, "x", "x", 1)], "doc_id bigint, text string, passage string, item_id int")
    docs = docs.unionByName(docs.limit(3))
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in PASSAGES.items()] + [(77, "too short"), (78, None), (None, "x")], "item_id bigint, passage string")
    got = sorted(map(tuple, leaked_items(docs, items).collect()))
    assert got == sorted((i, d) for d, w in DOCS.items() for i, p in PASSAGES.items() if brute(w, p)) and len(got) > 10


def test_long_text_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK_ROWS", 500)
    long = sentence(20_000) + PASSAGES[3] + sentence(20_000)
    docs = spark.createDataFrame([(1, " ".join(long))], "doc_id bigint, text string")
    items = spark.createDataFrame([(3, " ".join(PASSAGES[3]))], "item_id bigint, passage string")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(3, 1)]
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_plain_words():
    assert plain_words("Thé <b>swаllоwеd</b>  edge; of​ a po­t&amp; neighbours’ ＦＥＮＣＥ ﬁne straße") == ["the", "swallowed", "edge", "of", "a", "pot", "neighbours", "fence", "fine", "strasse"]

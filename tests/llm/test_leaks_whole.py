import random

import numpy as np

from roadloom.llm import leaks
from roadloom.llm.leaks import STRETCH, ItemIndex, holds_stretch, leaked_items

PASSAGE = [f"word{i}" for i in range(40)]
OTHER = ["the", "und"] + [f"other{i}" for i in range(40)]


def broken(words, every):
    """A common word of another passage after every so many words."""
    return [x for i, w in enumerate(words, 1) for x in ((w, "the") if i % every == 0 else (w,))]


def test_copies_with_common_words_put_in_are_found(spark):
    docs = {1: broken(PASSAGE[5:25], 3), 2: broken(PASSAGE[5:25], 2), 3: broken(PASSAGE[5:21], 3), 4: []}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string")
    alone = spark.createDataFrame([(7, " ".join(PASSAGE))], "item_id bigint, passage string")
    both = alone.union(spark.createDataFrame([(8, " ".join(OTHER))], alone.schema))
    assert sorted(map(tuple, leaked_items(rows, alone).collect())) == sorted(map(tuple, leaked_items(rows, both).collect())) == [(7, 1), (7, 2)]


def random_cases(seed, passages=8, docs=300):
    """Passages and documents with stretches of them: words left out, and words put in of which most are passage words too."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    listed = [[rng.choice(words) for _ in range(rng.choice([10, 20, 45]))] for _ in range(passages)]
    texts = []
    for _ in range(docs):
        p = rng.choice(listed)
        a = rng.randrange(0, max(1, len(p) - STRETCH + 1))
        part = [w for w in p[a : a + STRETCH] if rng.random() > 0.08]
        texts.append([x for w in part for x in ([w, rng.choice(words + ["new"])] if rng.random() < 0.5 else [w])])
    return listed, texts


def places(doc):
    return {w: [k for k, x in enumerate(doc) if x == w] for w in doc}


def test_anchors_and_weights_miss_no_pair():
    for seed in range(4):
        passages, docs = random_cases(seed)
        index = ItemIndex(tuple((i, " ".join(p)) for i, p in enumerate(passages)))
        numbers = [index.numbers(d) for d in docs]
        near = index.candidates(numbers)
        held = {(d, i) for d, doc in enumerate(docs) for i, p in enumerate(passages) if holds_stretch(doc, places(doc), p)}
        assert held <= set(near) and len(held) > 30 and not any(len(passages[i]) < STRETCH for _, i in near)
        assert all(index.alike(numbers[d], i) for d, i in held)


def test_words_of_the_vocabulary_put_in_and_replaced():
    """A word of another passage after every second, third or fourth word, and up to three words replaced by such."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "to"] * 20
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(40)]
    index = ItemIndex(tuple((i, " ".join(p)) for i, p in enumerate(passages)))
    docs, held = [], set()
    for i, p in enumerate(passages):
        for every in (2, 3, 4):
            for replaced in range(4):
                a = rng.randrange(0, 41)
                part = list(p[a : a + STRETCH])
                for at in rng.sample(range(STRETCH), replaced):
                    part[at] = rng.choice(["the", "of", "and", rng.choice(words)])
                doc = [x for k, w in enumerate(part, 1) for x in ((w, rng.choice(["the", "of", "and", "to"])) if k % every == 0 else (w,))]
                if holds_stretch(doc, places(doc), p):
                    held.add((len(docs), i))
                docs.append(doc)
    numbers = [index.numbers(d) for d in docs]
    near = {(d, i) for d, i in index.candidates(numbers) if index.alike(numbers[d], i)}
    assert len(held) > 400 and held <= near and len(near) < 2 * len(docs)


def test_chunks_change_nothing(monkeypatch):
    passages, docs = random_cases(11)
    index = ItemIndex(tuple((i, " ".join(p)) for i, p in enumerate(passages)))
    numbers = [index.numbers(d) for d in docs]
    whole = index.candidates(numbers)
    monkeypatch.setattr(leaks, "CHUNK_ROWS", 50)
    assert index.candidates(numbers) == whole


def test_repeated_words_and_empty_lists():
    ha = ["ha"] * 25
    index = ItemIndex(((1, " ".join(ha)), (2, "short")))
    docs = [index.numbers(d) for d in (["ha"] * 17, ["ha"] * 16, ["ho"], [])]
    assert [d for d, i in index.candidates(docs) if index.alike(docs[d], i)] == [0]
    assert ItemIndex(()).candidates([np.empty(0, np.int64)]) == []

import os

import pytest

from roadloom.llm.mixing import TOKENIZER, Mix, mix_sources, quotas, schedule, token_blocks, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id bigint, text string, source string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_quotas():
    assert quotas({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}, 600) == {"a": 200.0, "b": 400.0}
    assert quotas({"a": 100}, {"a": (0.5, 1), "none": (0.5, 9)}, 80) == {"a": 80.0, "none": 0.0}
    assert quotas({}, {"a": (1.0, 1)}, 10) == {"a": 0.0}
    assert quotas({"a": 5, "b": 5}, {"a": (0.5, 1), "b": (0.5, 1)}, 100) == {"a": 5.0, "b": 5.0}


def test_every_stretch_of_the_schedule_has_the_shares(spark):
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = schedule(spark, shares, 120_000).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(120_000))
    for a in range(0, 120_000, 10_000):
        part = [r["source"] for r in rows[a : a + 1000]]
        assert all(abs(part.count(s) / 1000 - w) < 0.01 for s, w in shares.items())
    for s in shares:
        assert [r["rank"] for r in rows if r["source"] == s] == list(range(sum(r["source"] == s for r in rows)))


def test_blocks_cut_running_sums(spark):
    counted = spark.createDataFrame([(i, "hot" if i % 3 else "b", i % 7 + 1) for i in range(600)], "doc_id bigint, source string, tokens bigint")
    rows = token_blocks(counted, 40, 120_000, 1).collect()
    assert len(rows) == 600
    for s in ("hot", "b"):
        sums = {}
        for r in rows:
            if r["source"] == s:
                sums[r["block"]] = sums.get(r["block"], 0) + r["tokens"]
        assert sorted(sums) == list(range(max(sums) + 1)) and all(33 < v < 47 for k, v in sums.items() if k < max(sums))


def test_mix(spark):
    docs = [(i, "some words of a text " * (i % 5 + 1), s, 0) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 20 + [None] * 5 + ["untargeted"] * 5)]
    docs += [(99_999, None, "big", 0), (99_998, "", "mid", 0), docs[0]]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 4), (None, 0.1, 1)], TARGETS)
    chosen, report = mix_sources(spark.createDataFrame(docs, DOCS), targets, block_tokens=64)
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "mid", "small"}
    limits = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r["uses"] <= limits[r["source"]] for r in rows)
    by = {r["source"]: r for r in report.collect()}
    assert by["none"]["actual_tokens"] == 0 and by["none"]["available_tokens"] == 0 and by["small"]["quota_tokens"] == 3 * by["small"]["available_tokens"]
    for s in limits:
        assert by[s]["actual_tokens"] == sum(r["tokens"] * r["uses"] for r in rows if r["source"] == s)
        assert abs(by[s]["actual_tokens"] - by[s]["quota_tokens"]) < 0.05 * by[s]["quota_tokens"] + 130
    assert abs(sum(r["actual_share"] for r in by.values()) - 1) < 1e-9


def test_empty_and_special_texts(spark):
    none = spark.createDataFrame([], DOCS)
    chosen, report = mix_sources(none, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert chosen.count() == 0 and [r["actual_share"] for r in report.collect()] == [0.0]
    docs = spark.createDataFrame([(1, "<|endoftext|>", "a", 0), (2, None, "a", 0), (3, "x " * 200_000, "a", 0)], DOCS)
    assert mix_sources(docs, spark.createDataFrame([], TARGETS))[0].count() == 0
    counts = {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()}
    assert counts[1] > 1 and counts[2] == 0 and counts[3] >= 200_000


def test_the_schedule_holds_the_chosen_documents_in_full_blocks_and_even_shares(spark):
    docs = [(i, "word " * (i % 40 + 5), s, 0) for i, s in enumerate(["big"] * 1500 + ["mid"] * 700 + ["small"] * 60)] + [(99_999, "long " * 5_000, "mid", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3)], TARGETS)
    mix = Mix(spark.createDataFrame(docs, DOCS), targets, budget=40_000, block_tokens=64)
    rows, chosen = mix.schedule.collect(), {r["doc_id"]: r for r in mix.chosen.collect()}
    used, slots, tokens = {}, {}, {}
    for r in rows:
        used.setdefault((r["doc_id"], r["round"]), []).append((r["first_token"], r["tokens"]))
        slots.setdefault(r["slot"], set()).add(r["source"])
        tokens[r["slot"]] = tokens.get(r["slot"], 0) + r["tokens"]
    assert {d: sum(x == d for x, _ in used) for d in chosen} == {d: r["uses"] for d, r in chosen.items()}
    for (d, _), parts in used.items():  # the pieces of a use are the document, once
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == chosen[d]["tokens"]
    assert all(len(s) == 1 for s in slots.values()) and sum(n != 64 for n in tokens.values()) <= 3 and max(tokens.values()) == 64
    order = sorted(slots)
    for cut in (len(order) // 10, len(order) // 2, len(order)):
        part = [next(iter(slots[s])) for s in order[:cut]]
        assert all(abs(part.count(s) / cut - w) < 0.02 + 2 / cut for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    longest = max(r["tokens"] for r in chosen.values() if r["doc_id"] != 99_999)
    assert all(abs(r["actual_tokens"] - r["quota_tokens"]) <= (2_500 if r["source"] == "mid" else longest) for r in mix.report.collect())


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, "some words", f"s{i % 700:03}", 0) for i in range(1400)], DOCS)
    targets = spark.createDataFrame([(f"s{i:03}", 1 / 700, 1) for i in range(700)], TARGETS)
    mix = Mix(docs, targets, block_tokens=4)
    assert mix.chosen.count() == 1400 and mix.schedule.agg({"tokens": "sum"}).first()[0] == mix.report.agg({"actual_tokens": "sum"}).first()[0]

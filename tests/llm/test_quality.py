import math
from itertools import product

import pytest

from roadloom.llm.quality import BINS, FIRST_WEIGHTS, LineModel, document_kind, document_lines, model, not_prose, quality_statistics
from roadloom.llm.quality_examples import EXAMPLES

PROSE = "The hinge feels solid and moves without any fuss. I would buy it again."
CASES = [
    ("prose", PROSE), ("prose", PROSE.upper()), ("prose", "works fine no complaints from me so far"), ("prose", "Very pleased"), ("prose", "Worth 38 euros"), ("prose", "I  would  buy  it again."),
    ("prose", f"<p>{PROSE}<br/>{PROSE}</p>"), ("prose", f"{PROSE}\n- easy to clean\n- fits the shelf"), ("prose", "El tÃ©cnico ajustÃ³ el borde y apuntÃ³ la fecha."), ("prose", f"{PROSE} 😀"), ("prose", "Bad zip. Sent it back!"),
    ("list", "- soft grip\n- wide base\n- heavy lid\n- loud fan"), ("list", "1. quiet\n2. light\n3. long hose\n4. no manual"), ("list", "a) Nice box\nb) Quiet\nc) Light\nd) Fair price"),
    ("list", "quiet\nlong hose\ngood colour\nslow reply\nwide base\nspare screws"), ("list", "Pros\n+ quiet\n+ light\nCons\n- loud fan\n- no manual"), ("list", f"What I think of it.\n{'- soft grip' + chr(10)}" * 1 + "- light\n" * 12),
    ("table", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"), ("table", "size\tprice\nL\t5.0\nM\t6.0"), ("table", "item;price;size\ntent;5.00;L\nlamp;7.50;M"), ("table", "price,score,code\n58.18,10/10,K1\n153.66,8/10,K2"),
    ("table", "1/10           K53559         25.01\n3/10           K49195         77.58"), ("table", "item | size\ntent | L\ndesk lamp | M"),
    ("junk", "😀🎉🔥👍"), ("junk", "684 1727714 329"), ("junk", "^&^?$~=?*^=~"), ("junk", "ok ok ok ok ok ok ok"), ("junk", "ok\nok\nok\nok\nok\nok"), ("junk", "hahahahaha"), ("junk", "aaaaaaaaaaaa"), ("junk", "-"), ("junk", "bad bad,bad bad,bad bad"),
    ("junk", "http://a.invalid/x1 http://b.invalid/y2"), ("junk", '<div><span class="r">&nbsp;</span>{{body}}</div>'), ("junk", "lfhshlsjsad dkdd dkfsg jkjj"), ("junk", "r0yMxuWTpbVJpXVIG5JWFoHInz5OGBNCUqqw2180YdfN8DTOeRMN"), ("junk", "Ã¿‚‚¿ÂÂÃâ¤¢¢�ÃÃ»"),
    (None, ""), (None, " \n\t "), (None, None),
]


@pytest.mark.parametrize(("kind", "text"), CASES)
def test_kinds(kind, text):
    assert document_kind(text or "")[0] == kind


def test_labels_are_the_most_likely_path():
    small = LineModel({k: EXAMPLES[k] for k in ("prose", "list", "table", "echo")}, FIRST_WEIGHTS)
    lines = [document_lines(x)[1][0] for x in (PROSE, "- soft grip\n- wide", "a;b;c\n1;2;3", "ok ok ok ok ok ok", "Nice box")]
    for found in product(lines, repeat=4):
        emitted = [small.emission(f) for f in found]

        def score(path):
            return small.first[path[0]] + sum(e[s] for s, e in zip(path, emitted)) + sum(small.stay if a == b else small.move for a, b in zip(path, path[1:]))

        assert math.isclose(score(small.path(list(found))), max(map(score, product(range(4), repeat=4))))


def test_probabilities_and_bins():
    m = model()
    assert all(math.isclose(sum(map(math.exp, statistic)), 1) for state in m.log for statistic in state)
    assert math.isclose(sum(map(math.exp, m.first)), 1) and math.isclose(math.exp(m.stay) + (len(m.names) - 1) * math.exp(m.move), 1)
    for _, text in CASES:
        for found in document_lines(text or "")[1]:
            assert len(found) == len(BINS) and all(0 <= v < n for v, n in zip(found, BINS))
    assert all(document_kind(t)[0] == m.labels[i] for i, n in enumerate(m.names) for t in EXAMPLES[n])


def test_neighbours_matter():
    """The same short line is a title by itself and an entry among entries."""
    assert document_kind("wide base")[0] == "prose"
    lines = ["quiet", "wide base", "long hose", "good colour", "no manual"]
    assert document_kind("\n".join(lines))[0] == "list"


def test_table(spark):
    rows = [(i, t, "x", 1) for i, (_, t) in enumerate(CASES)] + [(0, PROSE, "x", 1), (1000, PROSE * 3000, "x", 1), (None, "- ", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, word_count int")
    out = quality_statistics(df)
    assert out.count() == len(rows)
    one = out.where("doc_id = 1000").first()
    assert one["word_count"] == 14 * 3000 - 2999 or one["word_count"] == 14 * 3000
    blank = out.where(f"doc_id = {len(CASES) - 1}").first()
    assert blank["word_count"] == 0 and blank["kind"] is None and blank["mean_word_length"] is None
    got = {r["doc_id"]: r["kind"] for r in not_prose(df).where("doc_id is not null").collect()}
    assert got == {i: k for i, (k, _) in enumerate(CASES) if k not in ("prose", None)}
    assert not_prose(df.limit(0)).count() == 0

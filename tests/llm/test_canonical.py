import random

import pytest

from roadloom.llm import canonical
from roadloom.llm.canonical import BKTree, Matcher, levenshtein, map_names, plain_form, slips

ROADS = ["Ashwhagate Drive North", "Ashwhagate Drive South", "State Highway 43", "Motorway M61", "Route 18", "Elmogate-Wexkouham Expressway", "Upper Ulfecombe Drive", "Zensuley Lane"]


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_and_tree():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    for a, b in zip(words, reversed(words)):
        assert levenshtein(a, b) == plain_levenshtein(a, b)
    tree = BKTree(sorted(set(words)))
    for w in words[:60]:
        assert sorted(tree.within(w, 2)) == sorted((x, plain_levenshtein(w, x)) for x in set(words) if plain_levenshtein(w, x) <= 2)
    assert slips("abcd", "abdc") == 1 and slips("abcd", "bacdx") == 2 and BKTree([]).within("a", 3) == []


@pytest.mark.parametrize(
    ("typed", "road"),
    [
        ("ASHWHAGATE DR NTH", 0), ("South Ashwhagate Drive", 1), ("N Ashwhagate Drv", 0), ("The Ashwhāgate.Drive.South ", 1), ("Ahswhagate Drive North - Lane 1", 0),
        ("St. H'way 43", 2), ("SH43", 2), ("S.H.43", 2), ("State Hwy 44", None), ("M-way M61", 3), ("M61 Motorway", 3), ("Mwy_M61 ramp", 3), ("Rte-18", 4), ("Rt18;", 4), ("Route 19", None),
        ("Elmogate Wexkouham Xway [resurvey]", 5), ("ElmogateW-exkouham Expressway", 5), ("Upr Ulfec0mbe Dr pt 2", 6), ("Zensuley La B", 7), ("Ashwhagate Drive South nrothbound", 1), ("Zensuley Lane setcion 4 northhbound", 7), ("Zensuley Lane tp 2", 7), ("Route 18 rmap", 4), ("Zensuley Lane Laen 1", 7), ("Zensuley Road", None), ("??", None), ("", None), ("as above", None),
    ],
)
def test_names(typed, road):
    best = Matcher(list(enumerate(ROADS))).best(plain_form(typed))
    assert (best and best[1]) == road


def test_shards_merge_like_one_tree(spark, monkeypatch):
    typed = ["Zensuley Lane", "Zensuly Lane", "Route 18", "nothing like it", None, "", "NA", "Zensuley Lane", "x" * 5000]
    rows = spark.createDataFrame([(f, t, 1) for f in ("a", "b") for t in typed], "source_file string, name string, id int")
    reference = spark.createDataFrame([*enumerate(ROADS), (None, "x"), (99, None), (50, "zensuley lane")], "road_ref_id int, canonical string")
    one = sorted(map(tuple, map_names(rows, reference, ["source_file"], "name", "road_ref_id", "canonical").collect()))
    assert one == sorted((f, t, i) for f in "ab" for t, i in (("Zensuley Lane", 7), ("Zensuly Lane", 7), ("Route 18", 4), ("nothing like it", -1), ("x" * 5000, -1)))
    monkeypatch.setattr(canonical, "SHARD_ENTRIES", 5)
    assert one == sorted(map(tuple, map_names(rows, reference, ["source_file"], "name", "road_ref_id", "canonical").collect()))


def test_empty(spark):
    rows = spark.createDataFrame([("a", "b")], "source_file string, name string")
    reference = spark.createDataFrame([], "i int, n string")
    assert [tuple(r) for r in map_names(rows, reference, ["source_file"], "name", "i", "n").collect()] == [("a", "b", -1)]
    assert map_names(rows.limit(0), reference, ["source_file"], "name", "i", "n").count() == 0

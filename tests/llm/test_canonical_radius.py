import pytest

from roadloom.llm.canonical import Matcher, levenshtein, slips

ROADS = ["elmogate wexkouham expressway", "zensuley lane"]


@pytest.mark.parametrize(("typed", "distance"), [("lemogate wexkuoham expresway", 5), ("lemogate wexkuoham exrpessway", 6)])
def test_exchanges_are_single_slips(typed, distance):
    key, entry = typed.replace(" ", ""), ROADS[0].replace(" ", "")
    assert slips(key, entry) == 3 and levenshtein(key, entry) == distance
    assert Matcher(list(enumerate(ROADS))).best(typed) == (3, 0)


def test_short_forms_keep_their_limit():
    assert Matcher([(7, "abcdef")]).best("bacdef") == (1, 7) and Matcher([(7, "abcdef")]).best("badcef") is None

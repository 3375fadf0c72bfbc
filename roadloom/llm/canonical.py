"""Mapping freely typed names to the entries of a reference list.

Names and entries are brought to a plain form first (case, accents, abbreviations, position of compass words, digits typed
for letters, additions that are no part of a name). Then a BK-tree over the entries' forms, under the Levenshtein metric,
returns every entry within the radius of a typed form, pruned by the triangle inequality. A typed form is taken to mean
the entry with the fewest typing slips (an exchange of two neighbours is one), if these are few for its length and the
numbers in both are the same.

The tree is broadcast, one shard of the list at a time: a list longer than ``SHARD_ENTRIES`` is cut into shards by hash,
each distinct form passes through every shard, and the shards' winners are merged by an aggregation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.common import bounded_shard, filled, lookup_join
from roadloom.session import cut_lineage, map_batches

#: Entries in one broadcast tree at most.
SHARD_ENTRIES = 50_000

#: Short forms of the words in road names.
SHORT_FORMS = {
    "street": ("st", "str", "strt"), "road": ("rd",), "avenue": ("av", "ave", "avn"), "terrace": ("tce", "terr", "ter"), "drive": ("dr", "drv"),
    "highway": ("hwy", "hway", "hgwy"), "crescent": ("cr", "cres", "crs", "crescnt"), "parade": ("pde", "prde", "pd"), "lane": ("la", "ln"),
    "expressway": ("expwy", "xway", "exwy", "expy", "exp"), "motorway": ("mwy", "mway", "mtwy"), "route": ("rt", "rte"), "upper": ("upr", "upp"),
    "lower": ("lwr", "lr"), "old": ("olde",), "north": ("n", "nth", "nrth"), "south": ("s", "sth"), "east": ("e",), "west": ("w", "wst"),
}
_COMPASS = ("north", "south", "east", "west")
_LOOKALIKE_DIGITS = str.maketrans("013456789", "oleasbtbg")
_NUMBERED = re.compile(r"(rt|rte|route|sh|hwy|hway|highway|m|mwy|mway|motorway)(\d+)")


@dataclass(frozen=True)
class NameWords:
    """What is known of the words of a kind of names; the search itself knows none.

    ``short_forms``: short forms of words; ``added``: what is put behind a name, ``added_before_numbers``: the same with a
    number after it. Additions are typed as freely as names. ``numbered``: words that belong to the number behind them.
    """

    short_forms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    added: tuple[str, ...] = ()
    added_before_numbers: tuple[str, ...] = ()
    numbered: tuple[str, ...] = ()

    @cached_property
    def long(self) -> dict[str, str]:
        return {short: word for word, shorts in self.short_forms.items() for short in shorts}

    @cached_property
    def before_numbers(self) -> frozenset[str]:
        return frozenset(x for word in self.numbered for x in (word, *self.short_forms.get(word, ())))


#: The words of road names, the default of every function here.
ROAD_WORDS = NameWords(
    SHORT_FORMS,
    ("ramp", "northbound", "southbound", "eastbound", "westbound", "resurvey"),
    ("section", "sec", "part", "pt", "lane"),
    ("highway", "motorway", "route", "road", "m", "sh"),
)


def plain_form(name: str, known: NameWords = ROAD_WORDS) -> str:
    """The comparable form of a typed name or entry: words and numbers, one blank apart; empty where nothing is left."""
    s = unicodedata.normalize("NFKD", name.casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = s.replace("'", "").replace("’", "")
    s = re.sub(r"\bm[\s_-]way\b", "mway", s.replace("_", " "))
    s = re.sub(r"[^a-z0-9]+", " ", s).strip()
    s = re.sub(r"\bs h\b", "sh", s)
    words: list[str] = []
    for word in s.split():
        hit = _NUMBERED.fullmatch(word)
        if hit and hit[1] != "m":
            words += [hit[1], hit[2]]
        elif not hit and re.search(r"\d", word) and len(re.findall(r"[a-z]", word)) >= 2:
            words.append(word.translate(_LOOKALIKE_DIGITS))
        else:
            words.append(word)
    while words and words[0] == "the":
        words.pop(0)
    words = _without_additions(words, known)
    if len(words) > 2 and words[-1] in ("a", "b", "c", "d"):
        words = _without_additions(words[:-1], known)
    out: list[str] = []
    for i, word in enumerate(words):
        if word == "sh":
            out += ["state", "highway"]
        elif word == "st" and i + 1 < len(words) and known.long.get(words[i + 1], words[i + 1]) == "highway":
            out.append("state")
        else:
            out.append(known.long.get(word, word))
    if len(out) > 2 and out[0] in _COMPASS:
        out = [*out[1:], out[0]]
    out = _number_last(out)
    return " ".join(out)


def _is_nearly(word: str, known: tuple[str, ...]) -> bool:
    return any(word == k or len(k) >= 2 and abs(len(word) - len(k)) <= 1 and slips(word, k) <= 1 for k in known)


def _without_additions(words: list[str], known: NameWords) -> list[str]:
    """Cut off additions at the end, mistyped ones too, as long as two words of a name are left before them."""
    while len(words) >= 3:
        last = words[-1]
        if _is_nearly(last, known.added):
            words = words[:-1]
        elif last.isdigit() and (words[-2] in known.added_before_numbers or len(words) >= 4 and words[-2] not in known.before_numbers and _is_nearly(words[-2], known.added_before_numbers)):
            words = words[:-2]
        else:
            break
    return words


def _number_last(words: list[str]) -> list[str]:
    """``m61 motorway`` and ``m 61`` as ``motorway m61``."""
    if "motorway" in words or (len(words) <= 2 and words and re.fullmatch(r"m\d*", words[0])):
        rest = "".join(w for w in words if w != "motorway")
        if re.fullmatch(r"m?\d+", rest):
            return ["motorway", "m" + rest.lstrip("m")]
    return words


def levenshtein(a: str, b: str) -> int:
    """Edit distance by Myers' bit vectors: one step of whole-number arithmetic per character of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def slips(a: str, b: str) -> int:
    """Typing slips between two forms: single characters added, lost or replaced, and exchanges of two neighbours."""
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i, *[0] * len(b)]
        for j, cb in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


class BKTree:
    """Burkhard-Keller tree: children of a node by their distance from it."""

    def __init__(self, words: list[str]):
        self.root: tuple[str, dict] | None = None
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = levenshtein(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, radius: int) -> list[tuple[str, int]]:
        """Every entry at most ``radius`` away."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = levenshtein(word, entry)
            if d <= radius:
                found.append((entry, d))
            todo += [child for edge, child in children.items() if abs(edge - d) <= radius]
        return found


def slips_allowed(length: int) -> int:
    return 3 if length >= 15 else 2 if length >= 9 else 1


def radius(length: int) -> int:
    """Radius of the tree search that misses no form within the slips allowed: an exchange of neighbours is at Levenshtein distance 2."""
    return 2 * slips_allowed(length)


class Matcher:
    """One shard of the reference list: the best entry for a typed form."""

    def __init__(self, entries: list[tuple[int, str]], known: NameWords = ROAD_WORDS):
        self.ids: dict[str, int] = {}
        for ref_id, name in entries:
            key = plain_form(name, known).replace(" ", "")
            if key:
                self.ids[key] = min(ref_id, self.ids.get(key, ref_id))
        self.tree = BKTree(sorted(self.ids))

    def best(self, form: str) -> tuple[int, int] | None:
        """(slips, id) of the entry meant by a form; ties go to the smallest id."""
        key = form.replace(" ", "")
        if key in self.ids:
            return 0, self.ids[key]
        number = re.findall(r"\d+", form)
        hits = [e for e, _ in self.tree.within(key, radius(len(key))) if re.findall(r"\d+", e) == number]
        ranked = sorted((slips(key, e), self.ids[e]) for e in hits)
        return ranked[0] if ranked and ranked[0][0] <= slips_allowed(len(key)) else None


def match_names(names: DataFrame, reference: DataFrame, name_col: str, id_col: str, entry_col: str, known: NameWords = ROAD_WORDS) -> DataFrame:
    """(``name_col``, ``id_col``, slips): every distinct name with the id of the entry it means, or -1 and null.

    Null tokens are no names. Empty tables give an empty result, an empty list only -1. Entries with a null id or name are
    left out; of entries with the same plain form the smallest id holds.
    """
    spark = names.sparkSession
    # Names are short but each is a search: they are spread by number, as by bytes they would end in a few tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    typed = names.select(name_col).where(filled(F.col(name_col)).isNotNull()).distinct().repartition(tasks, name_col)
    entries = reference.select(F.col(id_col).cast("int").alias("id"), F.col(entry_col).alias("name")).where("id is not null and name is not null").distinct()
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    schema = f"`{name_col}` string, found_id int, slips int"
    passes = []
    for shard in range(shards):
        matcher = Matcher(bounded_shard(entries, ["id", "name"], shard, shards, 2 * SHARD_ENTRIES), known)

        def run(batches: Iterator[pd.DataFrame], matcher: Matcher = matcher) -> Iterator[pd.DataFrame]:
            for batch in batches:
                best = [matcher.best(plain_form(n, known)) for n in batch[name_col]]
                yield pd.DataFrame({
                    name_col: batch[name_col],
                    "found_id": pd.array([b[1] if b else None for b in best], "Int32"),
                    "slips": pd.array([b[0] if b else None for b in best], "Int32"),
                })

        # Matched once, however often the result is read; the driver holds one shard at a time.
        passes.append(cut_lineage(map_batches(typed, run, schema)))
    won = reduce(DataFrame.unionByName, passes)
    if shards > 1:
        rank = F.struct(F.coalesce("slips", F.lit(99)), "found_id")
        won = won.groupBy(name_col).agg(F.min_by("found_id", rank).alias("found_id"), F.min("slips").alias("slips"))
    return won.select(name_col, F.coalesce("found_id", F.lit(-1)).alias(id_col), "slips")


def map_names(rows: DataFrame, reference: DataFrame, keys: list[str], name_col: str, id_col: str, entry_col: str, known: NameWords = ROAD_WORDS) -> DataFrame:
    """(``keys``, ``name_col``, ``id_col``): the distinct names of every key with the entry meant; -1 where there is none."""
    pairs = rows.select(*keys, name_col).where(filled(F.col(name_col)).isNotNull()).distinct()
    meant = match_names(pairs, reference, name_col, id_col, entry_col, known).select(name_col, id_col)
    return lookup_join(pairs, meant, [name_col]).select(*keys, name_col, id_col)

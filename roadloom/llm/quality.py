"""Per-document text statistics, and what tells natural prose from lists, tables and junk.

Every non-blank line is reduced to its statistics, each in a few bins (``line_statistics``): shares of letters, vowels,
garbled characters and tokens with digits, number of words and share of common ones, cells, list mark, final punctuation,
links and markup, repetition, keys of one row, number of lines. A hidden Markov model labels the lines of a document
together (Viterbi): as kinds of text come in runs, a line takes its neighbours into account. A document is what most of its
characters are labelled.

The model has several states for a label (sentences and titles are prose; signs, figures, echoes and so on are junk). What a
state emits is fitted to the labelled lines of ``quality_examples``: every statistic by itself, by its counts and ``SMOOTHING``.
No statistic decides alone, and nothing is fitted to a table, so the model is the same for input of every size.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.quality_examples import EXAMPLES
from roadloom.session import map_batches

STATES = ("prose", "list", "table", "junk")
#: The label of each state of the model; all others are junk.
LABELS = {"prose": "prose", "title": "prose", "list": "list", "bare": "list", "table": "table"}
#: Weights of the states of a first line, probability of staying in a state, and what is added to every count.
FIRST_WEIGHTS = {"prose": 60, "title": 20, "list": 2, "bare": 2, "table": 2}
STAY, SMOOTHING = 0.9, 0.05

#: The most common words of the languages of the corpus.
COMMON_WORDS = frozenset(
    "the a an and of to it is in for i my we on with was but not at that this one as so no be have has had are or if you he she they from by "
    "der die das und ich ist nicht ein eine einen es mit auf den dem zu für hat nach im von sich auch wie war sind wir er sie aus bei als nur "
    "el la los las de que y en un una es por con se lo para su mi me al del como más sin muy ya le no o está fue "
    "le les et est je pas des du en pour il elle dans on ne ce qui au sur avec mon ma nous vous plus très bien sont été par".split()
)

_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;|&#\d+;|\{\{[^{}]*\}\}|\b(?:undefined)+\b|\[object Object\]", re.I)
_MARK = re.compile(r"^\s*(?:[-*+•–—·▪◦‣>✓✔]|\(?\d{1,3}[.):]|\(?[A-Za-z][.)]|\[[ xX]?\])\s+(?=\S)")
_RULE_ROW = re.compile(r"^[\s|:+=-]{3,}$")
_TERMINAL = re.compile(r"[.!?…:]['\"”’)»\]]*$")
_EMOJI_END = re.compile(r"[\u2600-\U0010ffff\s]+$")
_REPEATED = re.compile(r"^(.{1,4}?)\1{3,}.{0,3}$", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_GARBLED = frozenset("ÃÂâÐïÑ�¢¬¤½¼¾»«¿‚„€™œžŸ¦§¨©ª­®¯°±²³´µ¶·¸¹º")
_VOWELS = frozenset("aeiouy")
_TOP_ROW, _MIDDLE_ROW, _BOTTOM_ROW = frozenset("qwertyuiop"), frozenset("asdfghjkl"), frozenset("zxcvbnm")
_KEYS = _TOP_ROW | _MIDDLE_ROW | _BOTTOM_ROW


class _Classes(dict):
    """The class of every character, worked out when it is first met: blank, garbled, digit, vowel, consonant, other letter, sign."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))[:1]
        if c.isspace():
            kind = " "
        elif c in _GARBLED:
            kind = "g"
        elif c.isdigit():
            kind = "d"
        elif "a" <= base <= "z":
            kind = "v" if base in _VOWELS else "c"
        else:
            kind = "l" if c.isalpha() else "s"
        self[code] = kind
        return kind


_CLASSES = _Classes()


def _cells(line: str) -> tuple[str, int] | None:
    """(separator, number of cells) where a line reads as a row of cells."""
    body = line.strip()
    if body.count("|") >= 1 and (body.count("|") >= 2 or re.search(r"\S\s*\|\s*\S", body)):
        return "|", len(body.strip("|").split("|"))
    if "\t" in body:
        return "\t", len(re.split(r"\t+", body))
    if ";" in body and re.search(r";(?=\S)", body) and "; " not in body:
        return ";", body.count(";") + 1
    if "," in body and re.search(r",(?=\S)", body) and ", " not in body and not re.fullmatch(r"[\d.,\s]+", body):
        return ",", body.count(",") + 1
    if "  " not in body and body.isascii():
        return None
    wide = re.split(r"\s{2,}", body)
    if len(wide) >= 2 and not _TERMINAL.search(body):
        words = _WORD.findall(body.lower())
        if sum(w in COMMON_WORDS for w in words) < 0.2 * max(1, len(words)):
            return "  ", len(wide)
    return None


_PLAINLY = str.maketrans(",;|/", "    ", ".!?:\"'()")


def _repeats(text: str) -> bool:
    """One word (or two) over and over."""
    tokens = text.lower().translate(_PLAINLY).split()
    if len(tokens) < 5:
        return False
    counts = Counter(tokens)
    if max(counts.values()) < 0.5 * len(tokens):
        return False
    top = sorted((n for t, n in counts.items() if t.isalpha()), reverse=True)[:2]
    return bool(top) and (top[0] >= 0.6 * len(tokens) or len(tokens) >= 6 and sum(top) == len(tokens))


def _bin(value: float, *edges: float) -> int:
    """How many of the edges a value reaches."""
    return bisect_right(edges, value)


_ANY = 1e-9
#: Number of bins of each statistic, in the order of ``line_statistics``.
BINS = (4, 4, 4, 4, 5, 4, 4, 3, 2, 3, 2, 3, 3)


def line_statistics(line: str, neighbours: list[tuple[str, int] | None], cells: tuple[str, int] | None, repeated: bool, lines: int) -> tuple[int, ...]:
    """The binned statistics of one line of a document of ``lines`` lines; ``cells`` is its own reading as cells,
    ``neighbours`` those of the lines beside it, ``repeated`` whether the whole document is one word over and over."""
    solid_length = len("".join(line.split())) or 1
    linked = sum(map(len, _URL.findall(line))) if "://" in line or "www." in line.lower() else 0
    mark = _MARK.match(line)
    body = line[mark.end() :] if mark else line
    marked = 0
    if "<" in line or "&" in line or "{{" in line or "undefined" in line or "[object" in line:
        marked = solid_length - len("".join(_MARKUP.sub(" ", line).split()))
        body = _MARKUP.sub(" ", html.unescape(body) if marked < 0.6 * solid_length else body)
    classes = body.translate(_CLASSES)
    tokens = classes.split()
    solid = sum(map(len, tokens)) or 1
    vowels = classes.count("v")
    latin = vowels + classes.count("c")
    letters = latin + classes.count("l")
    words = _WORD.findall(body.lower())
    common = sum(map(COMMON_WORDS.__contains__, words))
    coded = sum("d" in t for t in tokens) if "d" in classes else 0
    if _RULE_ROW.match(line) and any(n and n[0] == "|" for n in neighbours):
        row = 3
    elif cells:
        alike = any(n and n[0] == cells[0] and abs(n[1] - cells[1]) <= 1 for n in neighbours)
        running = len(words) >= 4 * cells[1] or len(words) > 6 and _TERMINAL.search(line) and not alike
        row = 0 if running else 2 if cells[1] >= 3 or alike else 1
    else:
        row = 0
    plain = "".join(body.split()).lower()
    one_row = False
    if latin >= 6 and len(tokens) >= 2:
        used = set(plain)
        rows = (_MIDDLE_ROW, _BOTTOM_ROW, _TOP_ROW) if latin >= 20 else (_MIDDLE_ROW, _BOTTOM_ROW)
        one_row = any(not used & (_KEYS - row) for row in rows) and not any(c.isalpha() for c in used - _KEYS)
    lengths = [n for n in map(len, tokens) if n > 28]
    long_tokens = sum(lengths) >= 0.6 * solid
    markup = _bin(marked / solid_length, _ANY, 0.6)
    return (
        _bin(letters / solid, 0.25, 0.5, 0.75),
        0 if latin < 3 else 1 if not vowels else 2 if latin >= 8 and vowels < 0.2 * latin else 3,
        _bin(classes.count("g") / solid, _ANY, 0.1, 0.35),
        (3 if coded and classes.count("d") >= 2 else 0) if len(tokens) == 1 else _bin(coded / len(tokens), _ANY, 0.4, 0.8) if tokens else 0,
        _bin(len(words), 1, 2, 5, 9),
        3 if not words else _bin(common / len(words), _ANY, 0.2),
        row,
        0 if not mark else 2 if len(body.split()) <= 6 and not re.search(r"[.!?]$", body.strip()) else 1,
        int(bool(_TERMINAL.search(_EMOJI_END.sub("", line).strip()))),
        max(_bin(linked / solid_length, _ANY, 0.6), markup if len(words) < 6 else min(1, markup)),
        int(repeated or (lines > 1 or body != line) and _repeats(body) or len(plain) >= 6 and bool(_REPEATED.match(plain))),
        2 if long_tokens else int(one_row),
        _bin(lines, 2, 4),
    )


def document_lines(text: str) -> tuple[list[str], list[tuple[int, ...]]]:
    """The non-blank lines of a text and their statistics."""
    lines = [x for x in _LINES.split(text) if x.strip()]
    if not lines:
        return [], []
    repeated = _repeats(text)
    cells = [_cells(x) for x in lines]
    beside = lambda i: [*cells[max(0, i - 1) : i], *cells[i + 1 : i + 2]]
    return lines, [line_statistics(x, beside(i), cells[i], repeated, len(lines)) for i, x in enumerate(lines)]


class LineModel:
    """The hidden Markov model: log probabilities of first states, of moves and of statistics."""

    def __init__(self, examples: dict[str, tuple[str, ...]], first: dict[str, float], stay: float = STAY, smoothing: float = SMOOTHING):
        self.names = list(examples)
        self.labels = [LABELS.get(n, "junk") for n in self.names]
        total = sum(first.get(n, 1) for n in self.names)
        self.first = [math.log(first.get(n, 1) / total) for n in self.names]
        self.stay, self.move = math.log(stay), math.log((1 - stay) / (len(self.names) - 1))
        counts = [[[smoothing] * n for n in BINS] for _ in self.names]
        for state, texts in zip(counts, examples.values()):
            for text in texts:
                for found in document_lines(text)[1]:
                    for statistic, value in zip(state, found):
                        statistic[value] += 1
        self.log = [[[math.log(x / sum(statistic)) for x in statistic] for statistic in state] for state in counts]
        self.emission = lru_cache(maxsize=100_000)(self._emission)

    def _emission(self, found: tuple[int, ...]) -> list[float]:
        """Log probability of the statistics of a line in every state. Lines differ in few ways, so most are looked up."""
        return [sum(statistic[v] for statistic, v in zip(state, found)) for state in self.log]

    def path(self, statistics: list[tuple[int, ...]]) -> list[int]:
        """The most likely states of successive lines (Viterbi). From any state the best other one to come from is the best of all."""
        if not statistics:
            return []
        score = [a + b for a, b in zip(self.first, self.emission(statistics[0]))]
        back: list[list[int]] = []
        for found in statistics[1:]:
            best = max(range(len(score)), key=score.__getitem__)
            came = [s if score[s] + self.stay >= score[best] + self.move else best for s in range(len(score))]
            score = [score[c] + (self.stay if c == s else self.move) + e for s, (c, e) in enumerate(zip(came, self.emission(found)))]
            back.append(came)
        state = max(range(len(score)), key=score.__getitem__)
        out = [state]
        for came in reversed(back):
            state = came[state]
            out.append(state)
        return out[::-1]

    def shares(self, text: str) -> dict[str, float]:
        """Share of each label by characters; none for a blank text."""
        lines, statistics = document_lines(text)
        weights: Counter[str] = Counter()
        for state, line in zip(self.path(statistics), lines):
            weights[self.labels[state]] += len("".join(line.split()))
        total = sum(weights.values())
        return {s: weights[s] / total for s in STATES} if total else {}


@lru_cache(maxsize=1)
def model() -> LineModel:
    """Fitted once in each Python worker, in some milliseconds."""
    return LineModel(EXAMPLES, FIRST_WEIGHTS)


def kind_of(shares: dict[str, float]) -> str | None:
    if not shares:
        return None
    return "prose" if shares["prose"] >= 0.5 else max(STATES[1:], key=lambda s: shares[s])


def document_kind(text: str) -> tuple[str | None, dict[str, float]]:
    """(kind, share of each label by characters) of a text; none for a blank one."""
    shares = model().shares(text)
    return kind_of(shares), shares


FIGURES = ("word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "line_count", "terminal_line_share", "common_word_share")


def text_figures(text: Column) -> list[Column]:
    """The ``FIGURES`` of a text, as built-in expressions over the whole of it; null and blank texts have zero words and lines, and null shares."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0))
    solid = F.regexp_replace(t, r"\s+", "")
    length = F.length(solid)
    lines = F.filter(F.split(t, r"\r\n|[\n\r]", -1), lambda x: F.trim(x) != "")
    closed = F.filter(lines, lambda x: F.regexp_replace(x, r"\s+$", "").rlike(r"""[.!?…:]['"”’)»\]]*$"""))
    usual = F.filter(words, lambda w: F.lower(w).isin(*sorted(COMMON_WORDS)))
    share = lambda part, whole: F.when(whole > 0, part / whole)
    n = F.size(words)
    figures = (
        n, share(F.length(F.array_join(words, "")), n), share(length - F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")), length),
        share(F.length(F.regexp_replace(solid, r"\P{Nd}", "")), length), F.size(lines), share(F.size(closed), F.size(lines)), share(F.size(usual), n),
    )
    return [f.alias(name) for f, name in zip(figures, FIGURES)]


def quality_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: ``id_col``, its text's ``FIGURES``, the shares of the labels and the kind, over the whole text.

    Null and blank texts have zero words and lines, null shares and no kind. Repeated rows are kept, each with its own
    result; empty tables give empty ones; further columns are not read. A very long text is one row of work in one task.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    shares = [f"{s}_share" for s in STATES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model().shares(t) if isinstance(t, str) else {} for t in batch["t"]]
            out = batch[["d", *FIGURES]].rename(columns={"d": id_col})
            for s, name in zip(STATES, shares):
                out[name] = pd.array([f.get(s) for f in found], "Float64")
            out["kind"] = [kind_of(f) for f in found]
            yield out

    chosen = documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), *text_figures(F.col(text_col)))
    types = dict(chosen.dtypes)
    schema = ", ".join([f"`{id_col}` {kind}", *[f"{c} {types[c]}" for c in FIGURES], *[f"{c} double" for c in shares], "kind string"])
    return map_batches(chosen, run, schema)


def not_prose(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, kind) of the documents that are mainly a list, a table or junk. Only the ids of these leave Python."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = pd.Series([kind_of(model().shares(t)) if isinstance(t, str) else None for t in batch["t"]], index=batch.index, dtype=object)
            kept = kinds.notna() & (kinds != "prose")
            yield pd.DataFrame({id_col: batch["d"][kept], "kind": kinds[kept]})

    return map_batches(documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")), run, f"`{id_col}` {kind}, kind string")

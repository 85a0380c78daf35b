"""Toxicity: Levenshtein automata intersected with a lexicon trie find terms and their misspellings in whole texts.

The lexicon is a trie of folded terms, in any script. A term matches a whole word, or, as a stem (`achlich*`), any word
that begins with it; in scripts without spaces a word begins at every character. `Automaton` determinises, state by
state as texts ask for them, the product of the trie with the Levenshtein automata of its terms: a state is the set of
(trie node, edits used) pairs that the letters so far can reach. All words of a batch walk through its table together,
and a word leaves as soon as no pair is left. The table holds CELLS cells; when it is full it starts anew.

Hits are weighted by their log-odds and by their context: the words around a hit tell whether it is quoted or reported
(CITED) rather than said. A logistic regression turns the document's weighted hits, their rate and its length into a
score. Lexicon, weights and regression are learned from a sample: for each class the first SAMPLE ids in the order of a
hash, of which texts above TEXT_BYTES are left out, and those beyond SAMPLE_BYTES in all. An id that several rows have
counts once, with the least of their texts. The intercept is moved from the sample's share of toxic documents to that
among all labelled ones, so a document that says nothing scores about the labels' rate.

Null texts and texts without a letter have no hits and still get a score, that of a text without words. Rows that repeat
are scored alike. Without labels of both classes a fixed regression scores hits of the general lexicon.
"""

from __future__ import annotations

import math
import pickle
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import column, encoded, folding, held_in_worker, held_out, prepare, shingle_sets, spread
from loomgraph.llm.neardup import band_keys, minima

#: Bounds of the sample: labelled documents of each class, bytes of one text, bytes of a class's texts.
SAMPLE, TEXT_BYTES, SAMPLE_BYTES = 2500, 1 << 20, 16 << 20
#: What makes a term: letters (in scripts without spaces), letters of a stem that is not a whole word, documents that
#: hold it, ratio of its rates, standard errors.
SHORTEST, SHORTEST_DENSE, STEM, LEAST_DOCS, LEAST_RATIO, LEAST_Z = 3, 2, 64, 5, 4.0, 6.0
#: Letters from which a term may be misspelled by one and by two edits.
ONE_EDIT, TWO_EDITS = 5, 9
#: A cited hit counts so much. Words to both sides that are searched for signs of it.
CITED, CONTEXT = 0.35, 8
PREDICT = 0.3

#: General English insults that the lexicon holds whatever the labels say.
GENERAL = ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "loser", "disgusting", "imbecile", "bastard", "asshole", "bitch", "cretin")
#: Verbs of reporting, and marks that open or close a quotation.
REPORTING = ("said", "says", "wrote", "called", "quoted", "quote", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")
QUOTES = "\"“”„«»‹›"

_APART, _OTHER, _FIRST = 0, 1, 2
#: Digits that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: First and last code points of scripts without spaces between words.
DENSE = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Characters of a word in such a script; cells of an automaton's table.
REACH, CELLS = 8, 1 << 22
_PLANE = 1 << 16


def _letter(point: int) -> int:
    """What a code point is folded to: a lower-cased letter or digit, or 0 if it separates words."""
    c = chr(point)
    if 0xD800 <= point < 0xE000 or not (c.isalnum() or unicodedata.category(c) == "Mn"):
        return _APART
    low = LEET.get(c, c.lower())
    return ord(low) if len(low) == 1 else point


_TABLE: list[np.ndarray] = []


def _mapped(points: np.ndarray, table: np.ndarray, beyond) -> np.ndarray:
    """points through the basic plane's table; the others, which are few, by a function."""
    out = table[np.minimum(points, _PLANE - 1)]
    high = points >= _PLANE
    if high.any():
        kinds, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([beyond(int(k)) for k in kinds], out.dtype)[at]
    return out


def folded(text: str) -> np.ndarray:
    """A text's characters as folded code points, 0 where words are apart."""
    if not _TABLE:
        _TABLE.append(np.array([_letter(i) for i in range(_PLANE)], np.uint32))
    return _mapped(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE[0], _letter)


def fold(text: str) -> str:
    """The folded text, its words apart by spaces."""
    points = folded(text)
    return np.where(points == _APART, 32, points).astype("<u4").tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    exact: float
    fuzzy: float

    @property
    def edits(self) -> int:
        return 0 if self.fuzzy <= 0 or len(self.text) < ONE_EDIT else 1 if len(self.text) < TWO_EDITS else 2


class Automaton:
    """The lexicon's automaton over its letters; `found[state]` is 2 * term + (1 if misspelled), or -1, at a word's end."""

    def __init__(self, terms: Sequence[Term], cells: int = CELLS):
        self.terms = terms
        self.letters = {c: _FIRST + i for i, c in enumerate(sorted({c for t in terms for c in t.text}))}
        self.width = _FIRST + len(self.letters)
        self.most_states = max(64, cells // self.width)
        self._plane = np.full(_PLANE, _OTHER, np.int32)
        self._plane[_APART] = _APART
        for c, k in self.letters.items():
            if ord(c) < _PLANE:
                self._plane[ord(c)] = k
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[set[int]] = [set()]
        for k, t in enumerate(terms):
            at = 0
            self.reach[0].add(t.edits)
            for c in t.text:
                c = self.letters[c]
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append([])
                    self.reach.append(set())
                at = self.trie[at][c]
                self.reach[at].add(t.edits)
            self.ends[at].append(k)
        self.most = [max(r, default=0) for r in self.reach]
        self._clear()

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Folded code points as columns of the table."""
        return _mapped(points, self._plane, lambda k: self.letters.get(chr(k), _OTHER))

    def _clear(self) -> None:
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []
        self.table = np.full((64, self.width), -2, np.int32)
        self.found = np.full(64, -1, np.int64)
        self._state([])  # 0: no pair is left
        self.table[0] = 0
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, pairs: dict[int, int]) -> list[tuple[int, int]]:
        """With skipped term letters; of a node only the fewest edits stay. A node of -1 - k is the stem k, which is through."""
        todo, best = list(pairs.items()), {}
        while todo:
            n, e = todo.pop()
            if n >= 0 and e > self.most[n] or best.get(n, 99) <= e:
                continue
            best[n] = e
            if n >= 0:
                for k in self.ends[n]:
                    if self.terms[k].stem and e <= self.terms[k].edits:
                        todo.append((-1 - k, e))
                todo += [(m, e + 1) for m in self.trie[n].values()]
        return sorted(best.items())

    def _state(self, pairs: list[tuple[int, int]]) -> int:
        key = np.array([4 * n + e for n, e in pairs], np.int32).tobytes()
        if key not in self.states:
            at = self.states[key] = len(self.sets)
            self.sets.append(key)
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -2)])
                self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
            hits = [(e, -w, 2 * k + (e > 0)) for n, e in pairs for k in ([-1 - n] if n < 0 else self.ends[n]) if e <= self.terms[k].edits for w in [self.terms[k].exact if e == 0 else self.terms[k].fuzzy]]
            if hits:
                self.found[at] = min(hits)[2]
        return self.states[key]

    def _step(self, state: int, c: int) -> int:
        out: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            out[n] = min(e, out.get(n, 99))

        for code in np.frombuffer(self.sets[state], np.int32).tolist():
            n, e = code >> 2, code & 3
            if n < 0:
                reach(n, e)
                continue
            for d, m in self.trie[n].items():
                reach(m, e + (d != c))
            reach(n, e + 1)
        return self._state(self._closed(out))

    def walk(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word, what the automaton finds at its end."""
        out = np.full(len(starts), -1, np.int64)
        todo = [np.arange(len(starts))] if len(starts) else []
        while todo:
            some, fresh = todo.pop(), len(self.sets) == 2
            left = self._walk(classes, starts, ends, some, out)
            if len(left):  # the table is full: these begin again with an empty one, and if they fill it alone, in halves
                self._clear()
                todo += np.array_split(left, 2) if fresh else [left]
        return out

    def _walk(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, live: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Walks the words `live`; those that are not through when the table is full. A word alone always gets through."""
        bound = self.most_states if len(live) > 1 else 1 << 62
        state, j = np.full(len(live), self.start, np.int64), 0
        at, lengths = starts[live].astype(np.int64), (ends - starts)[live]
        while len(live):
            c = classes[at + j]
            after = self.table[state, c]
            if (missing := after == -2).any():
                for code in np.unique(state[missing] * self.width + c[missing]):
                    if len(self.sets) >= bound:
                        return live
                    s, k = divmod(int(code), self.width)
                    target = self._step(s, k)
                    self.table[s, k] = target
                after = self.table[state, c]
            j += 1
            over = lengths == j
            if over.any():
                out[live[over]] = self.found[after[over]]
            stay = ~over & (after != 0)
            live, at, lengths, state = live[stay], at[stay], lengths[stay], after[stay].astype(np.int64)
        return live


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs of letters; in scripts without spaces, REACH characters from each on."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = points > _APART
    dense = np.zeros(len(points), bool)
    if len(points) and points.max() >= DENSE[0][0]:
        for low, high in DENSE:
            dense |= (points >= low) & (points <= high)
    if not dense.any():
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inside[1:-1][dense] = 2
    change = np.flatnonzero(np.diff(inside) != 0)
    low, high = change[:-1], change[1:]  # runs of one kind
    kind = inside[low + 1]
    own = np.flatnonzero(dense)
    starts = np.concatenate([low[kind == 1], own])
    ends = np.concatenate([high[kind == 1], np.minimum(own + REACH, high[np.searchsorted(low, own, side="right") - 1])])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def cited(text: str, start: int, end: int, left: int, right: int) -> bool:
    """Whether the hit text[start:end] stands in quotation marks or after a verb of reporting, within its context."""
    before, after = text[left:start], text[end:right]
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        return True
    return any(w.strip(".,:;!?()") in REPORTING for w in before.lower().split())


#: Characters that are folded and walked together.
_PIECE = 1 << 18


def _pieces(texts: Sequence[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text number, piece) of about _PIECE characters; a longer text is cut between words."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            piece = text[at : at + _PIECE]
            if at + len(piece) < len(text) and len(gaps := np.flatnonzero(folded(piece) == _APART)) and gaps[-1]:
                piece = piece[: gaps[-1]]
            group.append((i, piece))
            size += len(piece)
            at += len(piece)
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def hits(texts: Sequence[str | None], automaton: Automaton) -> tuple[list[list[tuple[int, bool]]], np.ndarray]:
    """For each whole text (2 * term + misspelled, cited) of each hit, and its number of words."""
    found: list[list[tuple[int, bool]]] = [[] for _ in texts]
    n = np.zeros(len(texts), np.int64)
    for group in _pieces(texts):
        joined = "\n".join(piece for _, piece in group)
        points = folded(joined)
        starts, ends = words_of(points)
        got = automaton.walk(automaton.classes(points), starts, ends)
        borders = np.cumsum([0] + [len(piece) + 1 for _, piece in group])
        first = np.searchsorted(starts, borders)
        np.add.at(n, [i for i, _ in group], np.diff(first))
        for w in np.flatnonzero(got >= 0):
            k = int(np.searchsorted(borders, starts[w], side="right")) - 1
            low, high = max(first[k], w - CONTEXT), min(first[k + 1] - 1, w + CONTEXT)
            left, right = max(borders[k], starts[low] - 2), min(borders[k + 1] - 1, ends[high] + 2)
            found[group[k][0]].append((int(got[w]), cited(joined, starts[w], ends[w], left, right)))
    return found, n


@dataclass
class Model:
    terms: list[Term]
    coefficients: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(texts: Sequence[str | None], terms: Sequence[Term], automaton: Automaton) -> np.ndarray:
    """Per text: weighted hits on a logarithmic scale, their rate, hits by length, hits, whether any, words."""
    out = []
    for found, n in zip(*hits(texts, automaton)):
        weight = sum((terms[k // 2].fuzzy if k % 2 else terms[k // 2].exact) * (CITED if c else 1.0) for k, c in found)
        said = sum(CITED if c else 1.0 for _, c in found)
        out.append((math.log1p(weight), math.log1p(100 * weight / max(n, 20)), said / math.sqrt(1 + n / 1000), math.log1p(said), float(said > 0), math.log1p(n)))
    return np.array(out).reshape(-1, 6)


def _words(text: str) -> Counter[str]:
    points, plain = folded(text), fold(text)
    return Counter(plain[a:b] for a, b in zip(*(x.tolist() for x in words_of(points))))


def _shortest(word: str) -> int:
    return SHORTEST_DENSE if any(low <= ord(word[0]) <= high for low, high in DENSE) else SHORTEST


def _prefixes(word: str) -> Iterator[str]:
    """What a word can say for a term: its beginnings of up to STEM letters, and itself."""
    for k in range(_shortest(word), min(len(word), STEM) + 1):
        yield word[:k]
    if len(word) > STEM:
        yield word


def _common(vocabulary: Sequence[str], docs: Sequence[np.ndarray]) -> dict[str, int]:
    """Prefixes that LEAST_DOCS documents (arrays of places in the vocabulary) hold; letter by letter, so that few are counted at a time."""
    found: dict[str, int] = {}
    alive = np.array([len(w) >= _shortest(w) for w in vocabulary], bool)
    for k in range(1, STEM + 2):
        prefixes: dict[str, int] = {}
        of = np.full(len(vocabulary), -1, np.int32)
        for i in np.flatnonzero(alive).tolist():
            w = vocabulary[i]
            if len(w) >= k:
                of[i] = prefixes.setdefault(w if k > STEM else w[:k], len(prefixes))
        if not prefixes:
            break
        held = np.zeros(len(prefixes), np.int64)
        for own in docs:
            here = of[own]
            held[np.unique(here[here >= 0])] += 1
        found |= {p: int(held[j]) for p, j in prefixes.items() if held[j] >= LEAST_DOCS and len(p) >= _shortest(p)}
        alive &= (of >= 0) & (held[of] >= LEAST_DOCS)
    return found


def _apart(texts: Sequence[str]) -> list[int]:
    """Of texts that look like copies of each other (a band of three minima in common, of sixteen) the first."""
    fold_, apart = folding()
    home: dict[int, int] = {}
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for at in range(0, len(texts), 64):
        keys = band_keys(minima(shingle_sets(encoded(texts[at : at + 64]), 5, fold_, apart), 48), 16, 3)
        for i, own in enumerate(keys.tolist(), at):
            for a in {top(home.setdefault(k, i)) for k in own}:
                b = top(i)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if root[i] == i or not texts[i]]


def _lexicon(texts: Sequence[str], toxic: np.ndarray) -> list[tuple[str, bool, float]]:
    """(folded term, whether a stem, weight): prefixes whose rate among toxic documents' words is far above that among others'.

    Copies of a document count once: whatever words a toxic one has would be terms otherwise.
    """
    vocabulary: dict[str, int] = {}
    told: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    places: list[np.ndarray] = []
    for i in _apart(texts):
        words = _words(texts[i])
        own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
        told[toxic[i]].append(np.stack([own, np.fromiter(words.values(), np.int32, len(words))]))
        if toxic[i]:
            places.append(own)
    counts = []
    for own in told:
        at, n = np.concatenate(own, 1) if own else np.zeros((2, 0), np.int32)
        counts.append(np.bincount(at, n, len(vocabulary)))
    total = [1 + c.sum() for c in counts]
    docs = _common(list(vocabulary), places)
    times, whole = (Counter(), Counter()), Counter()
    for w, i in vocabulary.items():
        for p in _prefixes(w):
            if p in docs:
                for y in (0, 1):
                    times[y][p] += counts[y][i]
                if p == w:
                    whole[p] += counts[1][i]
    longer: dict[str, int] = {}
    for p, n in docs.items():
        longer[p[:-1]] = max(longer.get(p[:-1], 0), n)
    chosen: list[tuple[float, str]] = []
    for p, n in docs.items():
        a, b = times[1][p], times[0][p]
        ratio = (a / total[1]) / ((b + 0.5) / total[0])
        z = math.log(max(ratio, 1e-9)) * math.sqrt(n)
        # A prefix that one letter almost always follows is not yet the term.
        if ratio >= LEAST_RATIO and z >= LEAST_Z and longer.get(p, 0) < 0.9 * n:
            chosen.append((z, p))
    terms, out = {p for _, p in chosen}, []
    for _, p in sorted(chosen, reverse=True):
        if any(p[:k] in terms for k in range(1, len(p))):
            continue
        weight = math.log((times[1][p] / total[1]) / ((times[0][p] + 0.5) / total[0]))
        out.append((p, bool(whole[p] < 0.9 * times[1][p]), float(min(weight, 6.0))))
    return out


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a small ridge."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    b, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.5] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b, centre, scale


def fit(texts: Sequence[str | None], toxic: Sequence[int], rate: float | None = None) -> Model:
    """A model from labelled texts, of which `rate` are toxic among all that are labelled (None: as in the sample).

    Without labels of both classes, the general lexicon with fixed coefficients.
    """
    y = np.array([int(bool(t)) for t in toxic], int)
    both = 0 < y.sum() < len(y)
    learned = _lexicon([t or "" for t in texts], y) if both else []
    known = {t for t, _, _ in learned}
    every = [*learned, *[(t, False, 3.0) for t in GENERAL if t not in known]]
    # How much a misspelling says is learned per term too: common words near a term would drown it otherwise.
    trial = [Term(t, stem, w, 1.0) for t, stem, w in every]
    near, sizes = np.zeros((len(trial), 2)), [1, 1]
    for found, n, k in zip(*hits(texts, Automaton(trial)), y):
        sizes[k] += int(n)
        for code, _ in found:
            if code % 2:
                near[code // 2, k] += 1
    terms = []
    for i, (t, stem, w) in enumerate(every):
        ratio = (near[i, 1] + 1.0) / sizes[1] / ((near[i, 0] + 1.0 / math.exp(0.7 * w) * sizes[0] / sizes[1]) / sizes[0])
        terms.append(Term(t, stem, w, math.log(ratio) if ratio >= LEAST_RATIO else 0.0))
    if not both:
        return Model(terms, np.array([-3.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]), np.zeros(6), np.ones(6))
    b, centre, scale = _regression(features(texts, terms, Automaton(terms)), y)
    if rate is not None:
        share = y.mean()
        b[0] += math.log(rate / (1 - rate)) - math.log(share / (1 - share))
    return Model(terms, b, centre, scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = SAMPLE, text_bytes: int = TEXT_BYTES, class_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, float | None]:
    """([y, at, text] of the sample, share of toxic ids among all labelled ones); held-out rows are never in it."""
    usable = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull() & ~held_out(column(id_col))).groupBy(column(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = dict(usable.groupBy("y").count().collect())
    usable = usable.withColumn("at", spread(F.col("id"), F.lit(3)))
    few = [usable.where(F.col("y") == y).orderBy("at", "id").limit(each) for y in (0, 1)]
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    # At most 2 * SAMPLE ids, whatever the labels table holds.
    rows = rows.join(F.broadcast(few[0].union(few[1])), "id").groupBy("y", "at", "id").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("y").orderBy("at", "id"))
    sample = rows.withColumn("bytes", so_far).where(F.col("bytes") <= class_bytes).select("y", "at", "text")
    return sample, counts[1] / (counts[0] + counts[1]) if counts.get(0) and counts.get(1) else None


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    """The model of the sample, fitted by one task, so that the driver gets no texts but the model alone."""
    prepare(docs.sparkSession)
    sample, rate = labelled_sample(docs, labels, **columns)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((y, at, t is not None, t or "") for b in batches for y, at, t in zip(b["y"], b["at"], b["text"]))
        yield pd.DataFrame({"model": [pickle.dumps(fit([t if some else None for _, _, some, t in rows], [y for y, *_ in rows], rate))]})

    got = sample.coalesce(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], [])


def scorer(model: Model):
    """A column function from texts to scores."""
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = held_in_worker(key, lambda: Automaton(model.terms))
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            yield pd.Series(model.score(features(texts, model.terms, automaton)), dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id_col, held_out, score, predicted]: one row per row of docs."""
    prepare(docs.sparkSession)
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    scored = docs.select(column(id_col).alias("__id"), score(column(text_col).cast("string")).alias("score"))
    return scored.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    prepare(docs.sparkSession)
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.where(score(column(text_col).cast("string")) < PREDICT)

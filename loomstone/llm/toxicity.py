"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context windows that tell quotation from abuse.

The lexicon (terms, and stems that carry many endings) is learned from labelled documents. The automata of all terms and the trie are
one lazily determinised automaton: a state is the set of (trie node, edits so far) that a word's letters allow, so most words are
refused after a few letters and misspellings within a term's edits are found without any pairwise comparison.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import crc_mod, labelled_sample, map_text

PER_CLASS, MAX_CHARS = 1500, 20_000  # bounds of the training sample
MIN_TERM, STEM, WINDOW, MEMO = 4, 9, 6, 400_000
EDGE = re.compile(r"^\W+|\W+$")
QUOTES = "\"“”„‟«»‹›"
# Words that report speech, and words that address a reader, in the four languages.
REPORTING = set("said says say wrote writes called calls quote quoted quotes term word words dit écrit cité mot sagte schrieb zitat wort dijo escribió cita palabra".split())
ADDRESS = set("you your you're youre u ur tu toi vous du dich ihr tú usted eres".split())


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def edits_for_stem(stem: str) -> int:
    return 0 if len(stem) < 5 else 1


class Lexicon:
    """Terms with their edits and stems (any ending, edits before it), as a trie; match() gives (term, distance) or None."""

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]
        self.limit: list[int] = [0]
        self.stem_limit: list[int] = [0]
        for word, stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            k, at = edits_for_stem(word) if stem else edits_for(word), 0
            self.most[0] = max(self.most[0], k)
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    for column, value in ((self.child, {}), (self.term, None), (self.stem, None), (self.most, 0), (self.limit, 0), (self.stem_limit, 0)):
                        column.append(value)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            if stem:
                self.stem[at], self.stem_limit[at] = word, k
            else:
                self.term[at], self.limit[at] = word, k
        self._reset()

    def _reset(self):
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0, -1)}))

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
        return self.states[items]

    def _closed(self, items) -> frozenset:
        """With left-out letters of the term. Items: (node, edits, node whose letter is due after a swap or -1)."""
        todo, seen = list(items), set(items)
        while todo:
            node, e, due = todo.pop()
            if due < 0 and e < self.most[node]:
                for x in self.child[node].values():
                    item = (x, e + 1, -1)
                    if e + 1 <= self.most[x] and item not in seen:
                        seen.add(item)
                        todo.append(item)
        return frozenset(seen)

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, due in self.sets[state]:
            if due >= 0:  # the first letter of a swapped pair is due now
                if self.child[node].get(c) is not None and c in self.child[node] and self.child[self.child[node][c]].get(chr(due)) is not None:
                    out.add((self.child[self.child[node][c]][chr(due)], e, -1))
                continue
            kids = self.child[node]
            if c in kids:
                out.add((kids[c], e, -1))
            if e < self.most[node]:
                out.add((node, e + 1, -1))
                for x in kids.values():
                    if e + 1 <= self.most[x]:
                        out.add((x, e + 1, -1))
                        if c in self.child[x]:
                            out.add((node, e + 1, ord(c)))
        if len(self.sets) > 200_000:
            items = self._closed(out)
            self._reset()
            return self._state(items)
        to = self._state(self._closed(out))
        self.moves[state][c] = to
        return to

    def match(self, word: str):
        """The nearest term, else the nearest stem that the word begins with; a term within its edits goes before a stem but for an exact stem."""
        state, stem = self.start, None
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            items = self.sets[state]
            if not items:
                break
            for node, e, due in items:
                if self.stem[node] is not None and due < 0 and e <= self.stem_limit[node]:
                    found = (e, self.stem[node] + "*")
                    stem = found if stem is None or found < stem else stem
        else:
            best = min(((e, self.term[n]) for n, e, due in self.sets[state] if due < 0 and self.term[n] is not None and e <= self.limit[n]), default=None)
            if best is not None and (stem is None or best[0] <= stem[0]):
                return best[1], best[0]
        return (stem[1], stem[0]) if stem else None


def words_of(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    return word if word.isalpha() else EDGE.sub("", word)


def learn_lexicon(rows: list[tuple[str, int]], purity: float = 0.97, enriched: float = 0.9, chance: float = 0.01, few: int = 4) -> tuple[list[str], list[str]]:
    """Terms and stems whose documents are toxic: (nearly) no clean ones, and more toxic ones than chance gives. Copies count once.

    Of many words some are in toxic texts only, by accident. A word that has nothing to do with toxicity is in toxic texts alone k times
    with the k-th power of their share; a term or stem needs so many toxic texts that fewer than `chance` of all that are tried would
    pass so. A term of only `few` toxic texts passes if it begins with what passes that count and is `enriched` in toxic texts: forms of
    one word stand for each other.
    """
    rows = list(dict.fromkeys(rows))
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        return [], []
    counts = {0: Counter(), 1: Counter()}
    starts = {0: Counter(), 1: Counter()}
    endings: dict[str, set[str]] = {}
    for text, y in rows:
        seen = {c for c in map(core, set(words_of(text))) if len(c) >= MIN_TERM and c.isalpha()}
        counts[y].update(seen)
        starts[y].update({w[:k] for w in seen for k in range(MIN_TERM, min(STEM, len(w)))})
        if y:
            for w in seen:
                for k in range(MIN_TERM, min(STEM, len(w))):
                    endings.setdefault(w[:k], set()).add(w[k : k + 3])
    rate = lambda w, c: c[1][w] / n[1] / (c[1][w] / n[1] + (c[0][w] + 0.02) / n[0])
    least = lambda c: max(few, math.ceil(math.log(chance / (len(c[0]) + len(c[1]))) / math.log(n[1] / (n[0] + n[1]))))
    whole: dict[str, int] = {}  # toxic texts of the most frequent word that begins so
    for w, k in counts[1].items():
        for at in range(MIN_TERM, min(STEM, len(w))):
            whole[w[:at]] = max(whole.get(w[:at], 0), k)
    many = least(starts)
    families = {w for w, k in starts[1].items() if k >= many and rate(w, starts) >= enriched and len(endings[w]) >= 4 and whole[w] <= 0.5 * k}
    stems: list[str] = []
    for w in sorted((w for w in families if rate(w, starts) >= purity), key=lambda w: (len(w), w)):
        if any(w.startswith(s) for s in stems):
            continue
        while more := [x for x in sorted(families) if len(x) == len(w) + 1 and x.startswith(w) and starts[1][x] >= 0.9 * starts[1][w]]:
            w = more[0]  # as long as it keeps nearly all of its texts
        stems.append(w)
    many = least(counts)
    alike = lambda w: any(w[:k] in families for k in range(MIN_TERM, min(STEM, len(w))))
    fits = (w for w, k in counts[1].items() if k >= few and rate(w, counts) >= purity and (k >= many or alike(w)))
    return sorted(w for w in fits if not any(w.startswith(s) for s in stems)), sorted(set(stems))


class ToxicityModel:
    def __init__(self, rows: list[tuple[str, int]]):
        terms, stems = learn_lexicon(rows)
        self.terms, self.stems = terms, stems
        self.weight: dict[tuple[str, int], float] = {}
        self._ready()
        tally: dict[tuple[str, int], list[float]] = {}
        n = Counter(y for _, y in rows)
        for text, y in rows:
            hits = self.hits(text)
            plain = {h for _, h in hits if h[1] == 0}
            for h in plain or {h for _, h in hits}:  # misspellings are judged by documents without a plain term
                tally.setdefault(h, [0.0, 0.0])[y] += 1 / max(1, n[y])
        unit = 1 / max(1, n[1])
        family: dict[tuple[str, int], list[float]] = {}  # what looks like a misspelling is judged with terms that begin alike
        for (term, e), (clean, toxic) in tally.items():
            both = family.setdefault((term[:3], e > 0), [0.0, 0.0])
            both[0] += clean
            both[1] += toxic
        for term in [*terms, *(x + "*" for x in stems)]:
            for e in range((edits_for_stem(term[:-1]) if term[-1] == "*" else edits_for(term)) + 1):
                clean, toxic = tally.get((term, e), (0.0, 0.0))
                if e:
                    more = family.get((term[:3], True), (0.0, 0.0))
                    clean, toxic = clean + more[0], toxic + more[1]
                self.weight[term, e] = (toxic + 2 * unit * self.prior(term, e)) / (toxic + clean + 2 * unit)

    @staticmethod
    def prior(term: str, e: int) -> float:
        """Of a match that training texts say nothing about: a misspelling of a short word is a sign only where it addresses somebody."""
        return 0.95 if e == 0 else 0.75 if len(term) > 4 else 0.6

    def _ready(self):
        self.lexicon = Lexicon(self.terms, self.stems)
        self.memo: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "weight": self.weight}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def found(self, word: str):
        if len(self.memo) >= MEMO:
            self.memo.clear()
        c = core(word)
        hit = self.lexicon.match(c) if len(c) >= MIN_TERM - 1 else None
        self.memo[word] = hit
        return hit

    def hits(self, text: str) -> list[tuple[int, tuple[str, int]]]:
        """(place, (term, distance)) of every matching word."""
        words = words_of(text)
        memo, miss = self.memo, object()
        marked = {}
        for w in set(words):
            h = memo.get(w, miss)
            if h is miss:
                h = self.found(w)
            if h is not None:
                marked[w] = h
        return [(i, marked[w]) for i, w in enumerate(words) if w in marked] if marked else []

    def score(self, text: str) -> tuple[float, int]:
        """Noisy-or of the matches that are toxic more often than clean; one in quotation marks or reported counts less, one that
        addresses somebody more."""
        hits = self.hits(text)
        if not hits:
            return 0.02, 0
        words, rest = words_of(text), 0.98
        for i, h in hits:
            p = self.weight.get(h, self.prior(*h))
            if p < 0.5:
                continue  # clean more often than toxic
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            opened = any(w[0] in QUOTES for w in [*before, words[i]]) and not any(w[-1] in QUOTES for w in before)
            closed = any(w[-1] in QUOTES or w.rstrip(".,;:!?")[-1:] in QUOTES for w in [words[i], *after])
            if opened and closed:
                p *= 0.35 if not REPORTING.isdisjoint(before) else 0.5
            elif not ADDRESS.isdisjoint(before[-3:]):
                p = math.sqrt(p)
            rest *= 1 - min(p, 0.995)
        return 1 - rest, len(hits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learns from labels.toxic of documents outside the held-out fold (crc32 of the id mod 3 = 1)."""
    return ToxicityModel(labelled_sample(docs, labels, "toxic", crc_mod("id", 3) != 1, per_class, max_chars))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, score and n_hits. Null text: as empty (score 0.02). Repeated rows each give a row. Names of the new columns must not
    be among the kept ones. One Arrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts):
        got = [shared.value.score(t) for t in texts]
        return [[s for s, _ in got], [n for _, n in got]]

    return map_text(docs, text_col, fn, [("score", "double"), ("n_hits", "bigint")], list(keep))

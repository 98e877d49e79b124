"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

Every prefix of a byte string has one BPE encoding, and that encoding is the encoding of a shorter prefix plus one last token.
last[i] is therefore the only vocabulary token t that ends at i and is compatible with last[i - len(t)]; count[i] is
count[i - len(t)] + 1. One pass stores the exact token count at every prefix, so budgets and truncation need no re-encoding.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

# The split pattern of this family of vocabularies, with Unicode's own white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO = 800_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts(dict):
    """Token count of each piece; forgets everything once it holds MEMO pieces."""

    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece):
        if len(self) >= MEMO:
            self.clear()
        n = self.counter.table(piece.encode("utf-8", "surrogatepass"))[-1]
        if len(piece) <= 64:
            self[piece] = n
        return n


class PrefixCounter:
    """Counts for one vocabulary file (tokenizers' JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        special = [a["content"] for a in spec["added_tokens"]]
        vocab = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.vocab = vocab
        ends: dict[bytes, set[int]] = {}
        for t in vocab:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.ends = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.specials = special
        self.memo = _Counts(self)

    def merged(self, s: bytes) -> list[bytes]:
        """Plain BPE merging, for single tokens and pairs only."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            best, at = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether token may follow `before` in an encoding (None: begin one)."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        ok = self.pairs[before, token] = self.merged((before or b"") + token) == [x for x in (before, token) if x]
        return ok

    def table(self, s: bytes) -> list[int]:
        """Token count of s[:i] for every i, s being one piece of the split."""
        vocab, pairs, ends, short = self.vocab, self.pairs, self.ends, (2, 1)
        count, last = [0], [None]
        for i in range(1, len(s) + 1):
            for size in ends.get(s[i - 3 : i], short) if i > 2 else short:
                if size <= i:
                    t = s[i - size : i]
                    if t in vocab:
                        ok = pairs.get((last[i - size], t))
                        if ok or ok is None and self.fits(last[i - size], t):
                            break
            count.append(count[i - size] + 1)
            last.append(t)
        return count

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self.special.split(text) if self.special and any(x in text for x in self.specials) else [text]

    def count(self, text: str) -> int:
        get = self.memo.__getitem__
        return sum(1 if k % 2 else sum(map(get, self.split(s))) for k, s in enumerate(self.segments(text)))

    def prefixes(self, text: str, stop: int | None = None) -> np.ndarray:
        """Token count of text[:i] for i = 0 .. len(text). stop: ends once whole pieces hold more tokens than that."""
        out, base = [0], 0
        tail = ""  # ordinary text since the last place at which a split is settled
        for k, segment in enumerate(self.segments(text)):
            if k % 2:
                before = tail
                for j in range(1, len(segment)):
                    again = before + segment[:j]
                    out.append(base - self.plain(before) + self.plain(again))
                base += 1
                out.append(base)
                tail = ""
                continue
            run, run_base = "", base  # white space in progress: a prefix that ends in it holds it as one piece
            pieces = self.split(segment)
            for n, piece in enumerate(pieces):
                blank = piece.isspace()
                lead = piece if blank else piece[:1] if piece[:1] == " " else ""
                if lead:
                    if not run:
                        run_base = base
                    counts = self.table((run + lead).encode("utf-8", "surrogatepass"))
                    at = len(run.encode("utf-8", "surrogatepass"))
                    for c in lead:
                        at += len(c.encode("utf-8", "surrogatepass"))
                        out.append(run_base + counts[at])
                if not blank:
                    if piece[0] == "'":
                        out += [base + self.plain(piece[:j]) for j in range(1, len(piece) + 1)]
                    else:
                        counts, at = self.table(piece.encode("utf-8", "surrogatepass")), len(lead)
                        for c in piece[len(lead) :]:
                            at += len(c.encode("utf-8", "surrogatepass"))
                            out.append(base + counts[at])
                base += self.memo[piece]
                run = run + piece if blank else ""
                if stop is not None and base > stop and not blank and n + 1 < len(pieces):
                    return np.asarray(out, np.int64)
            last = len(pieces)
            while last and (last == len(pieces) or pieces[last].isspace()):
                last -= 1
            tail = "".join(pieces[last:]) if pieces else ""
        return np.asarray(out, np.int64)

    def plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.split(text)))

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of text, and the code points of its longest prefix with at most budget tokens; one split serves both."""
        if self.special and any(x in text for x in self.specials):
            n = self.count(text)
            return n, len(text) if n <= budget else int(np.flatnonzero(self.prefixes(text, stop=budget + 8) <= budget)[-1])
        pieces = self.split(text)
        ends = list(accumulate(map(self.memo.__getitem__, pieces)))
        if not ends or ends[-1] <= budget:
            return (ends[-1] if ends else 0), len(text)
        k = bisect_right(ends, budget)  # the first piece that ends beyond the budget
        while k and (pieces[k].isspace() or pieces[k - 1].isspace()):
            k -= 1
        base, start, more = (ends[k - 1] if k else 0), sum(map(len, pieces[:k])), 3
        while True:  # the prefixes around the cut; a few pieces are enough unless white space follows
            near = self.prefixes("".join(pieces[k : k + more]), stop=budget + 8 - base)
            if k + more >= len(pieces) or not pieces[k + more - 1].isspace() and ends[k + more - 1] > budget + 1:
                return ends[-1], start + int(np.flatnonzero(near + base <= budget)[-1])
            more *= 2


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per Python worker; a worker serves many tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars (longest prefix within limit, in code points).

    vocabulary: path of the file, which every executor can open (it ships with the installed Python package). Null text: empty,
    0 tokens. Repeated rows each give a row; ids may be null; other columns are not read. No shuffle: one Arrow pass.
    """

    def fn(texts, c):
        found = [c.count_and_fit(t, limit) for t in texts]
        return [[len(t.encode()) for t in texts], [n for n, _ in found], [n > limit for n, _ in found], [k for _, k in found]]

    return map_text(docs, text_col, fn, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean"), ("fit_chars", "bigint")], [id_col], lambda: counter(vocabulary))


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts array<bigint>: the exact token count of text[:i] at position i, i = 0 .. length."""
    return map_text(docs, text_col, lambda texts, c: [[c.prefixes(t).tolist() for t in texts]], [("counts", "array<bigint>")], [id_col], lambda: counter(vocabulary))


def truncate_to(counts: str, budget: int):
    """Code points that fit a token budget, from a column of prefix_table: no text is read again."""
    return F.expr(f"int(array_max(filter(sequence(0, size({counts}) - 1), i -> {counts}[i] <= {int(budget)})))")

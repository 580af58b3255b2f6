"""Secret scans: fixed base patterns, and formats learned by grammar inference.

Credentials that the base patterns find are the labelled examples. For each kind a prefix tree of their character
classes is read depth by depth, and its statistically compatible states are merged (by Hoeffding's bound on what comes next, and on the
lengths that remain): first states of one depth, then states of different depths, which makes loops. This leaves a probabilistic
automaton of the kind's formats. Every other token of a text is scored by how much likelier an automaton makes
it than the letters of all texts do; what passes is added, base spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

# Base patterns, fixed values.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
KINDS = ["assign", "access", "hex"]
#: Tokens that are scored: whole ones of the characters of credentials, as long as the shortest labelled ones; full stops may stand within.
CANDIDATE = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-](?!\w)")
#: Different labelled credentials of a kind that its automaton is inferred from, at most, taken by the least hash, and their length at most.
FIT_STRINGS, FIT_LENGTH = 4000, 128
#: Confidence of the merge test, and symbols ahead that it looks at.
ALPHA, AHEAD = 0.01, 4
#: Weight of a kind's overall frequencies in each state's.
PRIOR = 2.0
#: A token is a credential if an automaton makes it so much likelier than the letters of all texts (natural logarithm): a million times.
BAR = math.log(1e6)

# Character classes of a format, fixed values.
GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "-_", "+/=.")
SYMBOLS = len(GROUPS)
#: The end of a string, as a symbol.
END = SYMBOLS
CLASSES = np.full(256, END, np.int8)
#: Numbers of the characters that credentials have; 0 for all others.
LETTERS = np.zeros(256, np.int16)
for _k, _chars in enumerate(GROUPS):
    for _c in _chars:
        CLASSES[ord(_c)] = _k
        LETTERS[ord(_c)] = LETTERS.max() + 1
SIZES = np.array([len(g) for g in GROUPS])
WIDE = int(LETTERS.max()) + 1


def symbols(token: str) -> np.ndarray:
    return CLASSES[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def credential(text: str, start: int, end: int, kind: int) -> str:
    """What of a base span is the credential itself."""
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the tokens that no base span touches. taken: base spans by start."""
    k, reach = 0, -1
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            yield a, b, m[0]


class Automaton:
    """A probabilistic automaton of strings of symbols: counts[q] of the symbols that follow state q, the end among them, and where they lead."""

    def __init__(self, words: list[np.ndarray]) -> None:
        self.counts: list[np.ndarray] = []
        self.next: list[dict[int, int]] = []
        self.by_depth(words)
        self.layered = len(self.counts)
        self.across_depths()
        usual = np.sum(self.counts, axis=0) + 0.5
        self.usual = usual / usual.sum()
        self.states = len({self.find(q) for q in range(len(self.counts))})
        self.log = {q: np.log((self.counts[q] + PRIOR * self.usual) / (self.counts[q].sum() + PRIOR)) for q in range(len(self.counts)) if self.find(q) == q}

    @staticmethod
    def differ(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
        """If frequencies a of n and b of m differ by more than Hoeffding's bound allows."""
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return bool((np.abs(a / n - b / m) > bound).any())

    def by_depth(self, words: list[np.ndarray]) -> None:
        """The prefix tree, a depth at a time. A state is known by the strings that reach it: those whose next symbols and remaining lengths agree are one."""
        longest = max(map(len, words))
        every = np.full((len(words), longest + AHEAD + 1), END, np.int8)
        for k, w in enumerate(words):
            every[k, : len(w)] = w
        lengths = np.array([len(w) for w in words])

        def ahead(rows: np.ndarray, depth: int) -> np.ndarray:
            parts = [np.bincount(every[rows, depth + k], minlength=SYMBOLS + 1) for k in range(AHEAD)]
            # How many end within each number of symbols from here.
            left = np.cumsum(np.bincount(lengths[rows] - depth, minlength=longest + 1))
            return np.concatenate([*parts, left])

        layer = {0: np.arange(len(words))}
        self.counts.append(np.bincount(every[:, 0], minlength=SYMBOLS + 1))
        self.next.append({})
        for depth in range(longest):
            groups = []
            for q, rows in layer.items():
                for s in range(SYMBOLS):
                    own = rows[every[rows, depth] == s]
                    if len(own):
                        groups.append((q, s, own, ahead(own, depth + 1)))
            made: list[list] = []
            for q, s, own, seen in sorted(groups, key=lambda g: -len(g[2])):
                for state in made:
                    if not self.differ(seen, len(own), state[2], len(state[1])):
                        state[1], state[2] = np.concatenate([state[1], own]), state[2] + seen
                        break
                else:
                    state = [len(self.counts), own, seen]
                    made.append(state)
                    self.counts.append(None)
                    self.next.append({})
                self.next[q][s] = state[0]
            layer = {}
            for at, rows, _ in made:
                layer[at] = rows
                self.counts[at] = np.bincount(every[rows, depth + 1], minlength=SYMBOLS + 1)
        self.up = list(range(len(self.counts)))

    def find(self, q: int) -> int:
        while self.up[q] != q:
            self.up[q] = self.up[self.up[q]]
            q = self.up[q]
        return q

    def compatible(self, a: int, b: int) -> bool:
        """If two states and all that they lead to by the same symbols agree; every pair of states is looked at once."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self.find(q) for q in todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self.differ(self.counts[a], self.counts[a].sum(), self.counts[b], self.counts[b].sum()):
                return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            a, b = (self.find(q) for q in todo.pop())
            if a == b:
                continue
            self.up[b] = a
            self.counts[a] = self.counts[a] + self.counts[b]
            for s, y in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], y))
                else:
                    self.next[a][s] = y

    def across_depths(self) -> None:
        """States that stay, in order of depth; each later one is folded into the first that it is compatible with, or stays too."""
        stay = [0]
        for q in range(1, len(self.counts)):
            if self.find(q) != q:
                continue
            into = next((r for r in stay if self.find(r) == r and self.compatible(r, q)), None)
            if into is None:
                stay.append(q)
            else:
                self.fold(into, q)

    def log_likelihood(self, word: np.ndarray) -> float:
        """Of the symbols and the end. Where no state leads on, the kind's overall frequencies hold."""
        at: int | None = 0
        total, usual = 0.0, np.log(self.usual)
        for s in [*word.tolist(), END]:
            if at is None:
                total += usual[s]
                continue
            total += self.log[at][s]
            after = self.next[at].get(s)
            at = None if after is None else self.find(after)
        return float(total)


class Formats:
    """Automata of the kinds and the bigram model of all texts' letters."""

    def __init__(self, labelled: dict[str, list[str]], background: np.ndarray) -> None:
        b = background + 0.5
        self.background = np.log(b / b.sum(1, keepdims=True))
        self.automata = {kind: Automaton([symbols(x) for x in strings]) for kind, strings in sorted(labelled.items()) if strings}
        self.known: dict[str, bool] = {}

    def gain(self, token: str) -> float:
        """How much likelier the best automaton makes the token than the letters of all texts do; a class's characters are alike."""
        raw = np.frombuffer(token.encode("ascii"), np.uint8)
        w, k = CLASSES[raw], np.concatenate([[0], LETTERS[raw], [0]])
        within = np.log(SIZES[w]).sum()
        best = max((auto.log_likelihood(w) for auto in self.automata.values()), default=-math.inf)
        return float(best - within - self.background[k[:-1], k[1:]].sum())

    def is_credential(self, token: str) -> bool:
        found = self.known.get(token)
        if found is None:
            found = self.gain(token) >= BAR
            if len(self.known) > 500_000:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found


def letter_pairs(text: str) -> np.ndarray:
    """Counts of neighbouring letters of credentials; 0 stands for all other bytes, and for the ends."""
    k = LETTERS[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
    return np.bincount(k[:-1] * WIDE + k[1:], minlength=WIDE * WIDE)


def fit(docs: DataFrame, fit_strings: int = FIT_STRINGS) -> Formats:
    """Formats from the labelled credentials of all documents, up to FIT_LENGTH characters long (fit_strings different ones of a kind at most),
    and the letters of all texts. A kind without labelled credentials has no automaton; one string makes one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, found = np.zeros(WIDE * WIDE, np.int64), set()
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str) and text:
                    total += letter_pairs(text)
                    found |= {(k, c) for a, b, k in base_spans(text) if len(c := credential(text, a, b, k)) <= FIT_LENGTH}
            if len(found) > 10_000:
                yield pd.DataFrame([(k, c, None, None) for k, c in found], columns=["kind", "secret", "cell", "n"])
                found = set()
        cells = np.flatnonzero(total)
        yield pd.DataFrame([(k, c, None, None) for k, c in found] + [(None, None, int(x), int(total[x])) for x in cells], columns=["kind", "secret", "cell", "n"]).astype({"kind": "Int32", "cell": "Int32", "n": "Int64"})

    rows = materialize(docs.select("text").mapInPandas(read, "kind int, secret string, cell int, n long"))
    labelled, each = {}, rows.where("secret IS NOT NULL").select("kind", "secret").distinct()
    for k, name in enumerate(KINDS):
        labelled[name] = [r["secret"] for r in each.where(F.col("kind") == k).orderBy(F.xxhash64("secret"), "secret").limit(fit_strings).collect()]
    cells = rows.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a row for each pair of letters at most
    background = np.zeros(WIDE * WIDE)
    background[cells["cell"].to_numpy(np.int64)] = cells["n"]
    discard(rows)
    return Formats(labelled, background.reshape(WIDE, WIDE))


def find_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned for every row of docs.

    spans: kind:start:end of all spans, in code points, by start and then kind (`learned` after the base kinds), joined by commas. formats: those
    fitted on docs, if none are given. Null texts are empty and have none. Repeated rows, and rows with null doc_ids, have
    the spans of their texts; an empty table gives no rows.
    """
    formats = formats or fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                kinds = Counter(k for _, _, k in base)
                first = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base)
                learned = [(a, b, 3) for a, b, token in candidates(text, base) if formats.is_credential(token)]
                every = ",".join(f"{[*KINDS, 'learned'][k]}:{a}:{b}" for a, b, k in sorted(base + learned, key=lambda x: (x[0], x[2]))) if learned else first
                rows.append((doc, kinds[0], kinds[1], kinds[2], hashlib.sha256(first.encode()).hexdigest(), every, len(learned)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")

"""Secrets by fixed patterns and by inferred grammars of credential formats.

Labelled credentials are those that the fixed patterns find in the corpus itself (EXAMPLES of each
kind, those of least hash) and ones generated by rule from public formats. For each kind and format
a prefix tree of them is folded into a probabilistic automaton: states whose frequencies of next
symbols and of ending agree within Hoeffding's bound merge, recursively, nearest the root first.

Every run of credential characters is scored for all its parts that begin and end at a border (an
end of the run, or a character that is neither letter nor digit): how much likelier the best
automaton makes the part than a letter-pair model of everything else in the corpus does. The part
with the largest log ratio, or the longest that comes near it, is a span if the ratio is large enough
in all and for each character, with one or two short words that a - or _ joins to its beginning; what
is left and right of it is scored again. A part without a letter is none.
Spans of the fixed patterns stay, with the score of
their value; what they leave of a run is scored too. The letter pairs are counted in all documents,
and every text is scanned whole, however long.

A null text is empty; an empty one has no spans. Offsets are code points, ends exclusive. Of parts
of a length that tie the likeliest, then the first, is taken. Repeated rows give repeated results,
empty tables an empty one. Only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed

# The base patterns, least lengths and the candidates' characters.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_RUN = 12, 18, 16
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KINDS = ("assign", "access", "hex", "format")
#: One or two short words that are joined to what follows.
PREFIX = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,8}[_-]){1,2}\Z")

UPPER, LOWER, DIGIT = CHARACTERS[:26], CHARACTERS[26:52], CHARACTERS[52:62]
ALNUM = UPPER + LOWER + DIGIT
#: Format → parts: a literal, (characters, number of them), or (characters, least, most number).
FORMATS: dict[str, list] = {
    "access_key": ["AKIA", (UPPER + "234567", 16)],
    "hex_digest": [("0123456789abcdef", 40)],
    "github": ["ghp_", (ALNUM, 36)],
    "gitlab": ["glpat-", (ALNUM + "_-", 20)],
    "slack": ["xoxb-", (DIGIT, 12), "-", (DIGIT, 12), "-", (ALNUM, 24)],
    "google": ["AIza", (ALNUM + "_-", 35)],
    "stripe": ["sk_live_", (ALNUM, 24)],
    "npm": ["npm_", (ALNUM, 36)],
    "sendgrid": ["SG.", (ALNUM + "_-", 22), ".", (ALNUM + "_-", 43)],
    "jwt": ["eyJ", (ALNUM, 33), ".eyJ", (ALNUM, 60), ".", (ALNUM + "_-", 43)],
    "base64": [(ALNUM + "+/", 40)],
    "prefixed": [(LOWER, 2, 6), ("_-", 1), (ALNUM, 20, 48)],
    "prefixed_twice": [(LOWER, 2, 4), ("_-", 1), (LOWER, 3, 5), ("_-", 1), (ALNUM, 20, 48)],
}
#: Labelled credentials of each kind and format; the test's bound; least log ratio of a span for each character, and in all.
EXAMPLES, ALPHA, THRESHOLD, LEAST_RATIO = 120, 0.05, 0.6, 16.0
#: How far a part may fall behind before it's given up, and by how much a longer part may be less likely than the best.
BEHIND, SLACK = 10.0, 4.5
#: What it takes a part to hold one of these, which mostly stand between a credential and something else.
BETWEEN, CROSSING = "/.=", 5.0
#: The share of single characters in what is usual.
MIXED = 0.4


def labelled_credentials(n: int = EXAMPLES, seed: int = 11) -> dict[str, list[str]]:
    """n credentials of each format, generated by rule."""
    dice = random.Random(seed)
    one = lambda parts: "".join(p if isinstance(p, str) else "".join(dice.choices(p[0], k=dice.randint(p[1], p[-1]))) for p in parts)
    return {kind: [one(parts) for _ in range(n)] for kind, parts in FORMATS.items()}


class Automaton:
    """A probabilistic automaton folded from a prefix tree."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.through, self.ends = [0], [0]
        for word in words:
            at = 0
            for c in word:
                self.through[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.through.append(0)
                    self.ends.append(0)
                at = self.next[at][c]
            self.through[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.through[a], self.through[b]
            if not n1 or not n2:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
            # Symbols of a class together: what many rare symbols add up to.
            for cls in (UPPER, LOWER, DIGIT):
                f1, f2 = (sum(n for c, n in self.count[s].items() if c in cls) for s in (a, b))
                if self._differ(f1, n1, f2, n2):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.through[a] += self.through[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _fold(self) -> None:
        kept = [0]
        while True:
            inside = set(kept)
            edges = [(s, c, t) for s in kept for c, t in sorted(self.next[s].items()) if t not in inside]
            if not edges:
                break
            s, c, t = max(edges, key=lambda e: self.through[e[2]])
            for k in kept:
                if self._compatible(k, t):
                    self.next[s][c] = k
                    self._merge(k, t)
                    break
            else:
                kept.append(t)
        place = {s: i for i, s in enumerate(kept)}
        miss = 0.02
        self.table: list[tuple[dict[str, tuple[float, int]], float]] = []
        for s in kept:
            total = self.through[s] + miss * len(CHARACTERS)
            self.table.append(({c: (math.log((self.count[s][c] + miss) / total), place[t]) for c, t in self.next[s].items()}, math.log(miss / total)))


def automata(found: dict[str, list[str]] | None = None) -> dict[str, Automaton]:
    """An automaton for each format, and for each kind of credentials found in the corpus."""
    known = {**labelled_credentials(), **{f"found_{k}": v for k, v in sorted((found or {}).items()) if v}}
    return {kind: Automaton(words) for kind, words in known.items()}


_CODE = np.full(128, len(CHARACTERS), np.int64)
_CODE[[ord(c) for c in CHARACTERS]] = np.arange(len(CHARACTERS))


def codes(text: str) -> np.ndarray:
    """The place in CHARACTERS of each character, their number for any other."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
    return _CODE[points]


def runs(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more credential characters."""
    edges = np.flatnonzero(np.diff(codes(text) < len(CHARACTERS), prepend=False, append=False))
    long = np.flatnonzero(edges[1::2] - edges[::2] >= LEAST_RUN)
    return list(zip(edges[::2][long].tolist(), edges[1::2][long].tolist()))


def base_spans(text: str, in_runs: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns."""
    out, lower = [], text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for lo, hi in in_runs:
        run = text[lo:hi]
        out += [("access", lo + m.start(), lo + m.end(), lo + m.start()) for m in ACCESS.finditer(run) if m.end() - m.start() >= LEAST_ACCESS]
        out += [("hex", lo + m.start(), lo + m.end(), lo + m.start()) for m in HEX.finditer(run)]
    return out


def learn(documents: DataFrame) -> tuple[dict[str, list[str]], dict[str, dict[str, float]]]:
    """Credentials of the fixed patterns by kind (EXAMPLES of each), and the log probability of a
    character after another (^ at a run's start) outside of them, counted in all documents."""
    size = len(CHARACTERS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            kinds, values = [], []
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                at = codes(text)
                for kind, lo, hi, value in base_spans(text, runs(text)):
                    at[lo:hi] = size - 1
                    kinds.append(kind)
                    values.append(text[value:hi])
                pairs += np.bincount(np.concatenate(([size - 1], at[:-1])) * size + at, minlength=size * size)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.nulls(len(kinds), pa.int64())], ["kind", "value", "n"])
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(seen), pa.string()), pa.array([str(s) for s in seen], pa.string()), pa.array(pairs[seen])], ["kind", "value", "n"])

    rows = checkpointed(documents.select("text").mapInArrow(count, "kind string, value string, n long"))
    found = {}
    for kind in KINDS[:3]:
        chosen = rows.filter(F.col("kind") == kind).select("value").distinct().orderBy(F.xxhash64("value", F.lit(23)), "value").limit(EXAMPLES)
        found[kind] = sorted(r["value"] for r in chosen.collect())
    counts = np.zeros(size * size)
    for r in rows.filter("kind = 'pair'").groupBy("value").agg(F.sum("n").alias("n")).collect():  # at most 69 x 69
        counts[int(r["value"])] = r["n"]
    counts = counts.reshape(size, size)[:, : size - 1]
    return found, usual_logs(counts)


def usual_logs(counts: np.ndarray) -> dict[str, dict[str, float]]:
    """Log probabilities from the counts of (character, next character): the pairs', mixed with those of
    single characters, of which digits and punctuation have a share that no corpus takes from them (a
    path or an address isn't a credential, even where the corpus has few)."""
    single = counts.sum(axis=0) + 1.0
    share = np.array([0.008 if c in DIGIT else 0.03 if c in "+/_.=-" else 0.002 for c in CHARACTERS])
    single = (1 - share.sum()) * single / single.sum() + share
    pairs = (counts + 2 * single) / (counts.sum(axis=1, keepdims=True) + 2)
    logs = np.log((1 - MIXED) * pairs + MIXED * single)
    return {a: dict(zip(CHARACTERS, map(float, logs[i]))) for i, a in enumerate([*CHARACTERS, "^"])}


class Scanner:
    def __init__(self, formats: dict[str, Automaton], pairs: dict[str, dict[str, float]], threshold: float = THRESHOLD):
        self.formats, self.pairs, self.threshold = list(formats.values()), pairs, threshold

    def best_part(self, run: str, before: str = "^") -> tuple[int, int, float]:
        """Start, end and log ratio of the run's best part that may be a span, or of a longer one that
        is nearly as likely; (0, 0, 0) without one."""
        n = len(run)
        border = [True, *(not (a.isalnum() and b.isalnum()) for a, b in zip(run, run[1:])), True]
        usual = [self.pairs[a][b] + CROSSING * (b in BETWEEN) for a, b in zip(before + run, run)]
        found, best = [], 0.0
        for start in range(n - LEAST_RUN + 1):
            if not border[start] or run[start] in "/.=-_":
                continue
            for automaton in self.formats:
                state, ratio, peak = 0, 0.0, 0.0
                for i in range(start, n):
                    steps, miss = automaton.table[state]
                    if (step := steps.get(run[i])) is None:
                        ratio += miss - usual[i]
                    else:
                        ratio += step[0] - usual[i]
                        state = step[1]
                    peak = max(peak, ratio)
                    if ratio < peak - BEHIND:
                        break
                    length = i + 1 - start
                    if border[i + 1] and length >= LEAST_RUN and ratio >= max(LEAST_RATIO, self.threshold * length, best - SLACK) and run[i] not in ".=-/_" and any(c.isalpha() for c in run[start : i + 1]):
                        found.append((length, ratio, -start))
                        best = max(best, ratio)
        if not found:
            return 0, 0, 0.0
        length, ratio, back = max(f for f in found if f[1] >= best - SLACK)
        start, end = -back, length - back
        if joined := PREFIX.search(run, 0, start):
            start = joined.start()
        return start, end, ratio

    def parts(self, text: str, lo: int, hi: int) -> Iterator[tuple[str, int, int, float]]:
        """The format spans of text[lo:hi], a run or what is left of one."""
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= LEAST_RUN:
                before = text[lo - 1] if lo and text[lo - 1] in self.pairs else "^"
                a, b, ratio = self.best_part(text[lo:hi], before)
                if b:
                    yield "format", lo + a, lo + b, ratio / (b - a)
                    todo += [(lo, lo + a), (lo + b, hi)]

    def likelihood(self, word: str) -> float:
        """How much likelier, as a log for each character, the best automaton makes a whole word."""
        usual, best = sum(self.pairs[a][b] for a, b in zip("^" + word, word)), -math.inf
        for automaton in self.formats:
            state, total = 0, 0.0
            for c in word:
                steps, miss = automaton.table[state]
                step = steps.get(c)
                total, state = (total + miss, state) if step is None else (total + step[0], step[1])
            best = max(best, total)
        return (best - usual) / len(word)

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, score) of the base patterns and of the likely parts of what they leave."""
        if not text:
            return []
        in_runs = runs(text)
        base = base_spans(text, in_runs)
        out = [(kind, a, b, self.likelihood(text[value:b])) for kind, a, b, value in base]
        taken = sorted((a, b) for _, a, b, _ in base)
        for lo, hi in in_runs:
            at = lo
            for a, b in taken:
                if a < hi and lo < b:
                    out += self.parts(text, at, max(at, a))
                    at = max(at, b)
            out += self.parts(text, at, max(at, hi))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def fitted(documents: DataFrame) -> Scanner:
    found, pairs = learn(documents)
    return Scanner(automata(found), pairs)


def scan_documents(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score) in order of start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in scanner.spans(text or "")] for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact_column(text: Column, scanner: Scanner) -> Column:
    """The text with each span, overlapping ones together, replaced by [SECRET]."""
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = scanner.spans(text) if text else []
            if spans:
                parts, at = [], 0
                for _, a, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], "[SECRET]"]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype="object")

    return redact(text)

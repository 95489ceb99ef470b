"""SentencePiece BPE by a prefix table.

The encoding of a text under merges of fixed priority has one property that makes it linear: a
sequence of tokens is the encoding if, and only if, each neighbouring pair is the encoding of its
own two texts. So each prefix of a text has one possible last token: of the tokens an automaton
finds to end there, the one that agrees with the last token of the prefix before it. The table of
these is filled from left to right and the ids are recovered from its end backwards.

Whether a pair agrees is read off the merge histories: the boundary symbols of the two tokens
grow in order of their merges' ranks, and a merge across the boundary that outranks the next one
on either side separates them differently.

A space is written `▁`. No piece has one behind another character, so each space starts a part
that no merge reaches out of; parts repeat and a bounded cache keeps their ids. Runs of spaces
merge at one shared score, left first, after everything else; that order isn't a rank per merge,
so runs take the plain merge loop (kept by length).

A null text is an empty one, which has no ids; very long ones are encoded whole. Repeated rows give
repeated results, an empty table an empty one. Only doc_id and text are read, whatever other columns
are named.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts and pairs kept in a Python worker; beyond it the cache starts anew.
CACHE = 200_000
UNKNOWN = -1


class PieceTable:
    """The vocabulary of one model, its merge histories and the automaton of its pieces."""

    def __init__(self, pieces: list[str], scores: list[float], is_byte: list[bool], is_plain: list[bool]):
        import ahocorasick

        self.pieces, self.byte_ids = pieces, [i for i, b in enumerate(is_byte) if b]
        self.byte_of = {i: int(pieces[i][3:5], 16) for i in self.byte_ids}
        plain = [i for i, ok in enumerate(is_plain) if ok]
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: scores[i] for i in plain}
        order = sorted({s for p, s in self.score.items() if len(p) > 1}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.rank = {p: place[s] for p, s in self.score.items() if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside; parts can't be told apart at spaces")
        self.chars = {p for p in self.ids if len(p) == 1}
        self.breaks_lines = not any("\n" in p for p in self.rank)
        self.automaton, self.spines = ahocorasick.Automaton(), {}
        for p, i in self.ids.items():
            history = self._history(p) if p.strip(SPACE) or len(p) == 1 else None
            if history is not None:
                self.spines[i] = history
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.agree: dict[int, bool] = {}
        self.length = [len(p) for p in pieces]
        self.runs: dict[int, list[int]] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The plain merge loop: the parts that stay and the merges in order. Best score first,
        leftmost among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))

        for i in range(len(parts) - 1):
            offer(i)
        done = []
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = after[a] if parts[a] == x else len(parts)
            if b >= len(parts) or parts[b] != y:
                continue
            done.append((x, y))
            parts[a], parts[b], after[a] = x + y, None, after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in parts if p is not None], done

    def _history(self, piece: str):
        """Boundary symbols of a piece that its own merges make: (symbol, rank of the merge that
        takes it up), from the character upwards, at its right and at its left end. None if its own
        text doesn't encode to it, as then no text does."""
        if len(piece) == 1:
            return [(piece, None)], [(piece, None)]
        left, merges = self.merged(piece)
        if len(left) > 1:
            return None
        tree = {x + y: (x, y) for x, y in merges}
        if any(self.rank.get(k, -1) >= self.rank[x + y] for x, y in merges for k in (x, y)):
            raise ValueError(f"the merges of {piece!r} don't follow their ranks")
        ends = []
        for side in (1, 0):
            at, spine = piece, [(piece, None)]
            while at in tree:
                spine.append((tree[at][side], self.rank[at]))
                at = tree[at][side]
            ends.append(spine[::-1])
        return ends[0], ends[1]

    def pair(self, a: int, b: int) -> bool:
        """Whether the text of tokens a, b encodes to a, b."""
        if len(self.agree) >= 2 * CACHE:
            self.agree.clear()
        known = self.agree[a << 32 | b] = self._pair(self.spines[a][0], self.spines[b][1])
        return known

    def _pair(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = self.rank.get(x + y)
            # Of equal ranks the leftmost merges first: left's own before the crossing one, that before right's.
            if across is not None and (next_x is None or across < next_x) and (next_y is None or across <= next_y):
                return False
            if next_x is None and next_y is None:
                return True
            if next_y is None or next_x is not None and next_x <= next_y:
                i += 1
            else:
                j += 1

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text that holds a space at its start at most."""
        last, length, known = [0] * len(word), self.length, self.agree.get
        if not self.chars.issuperset(word):
            last = [0 if c in self.chars else UNKNOWN for c in word]
        for end, token in self.automaton.iter(word):
            if not last[end]:
                start = end - length[token]
                if start < 0:
                    last[end] = token
                elif before := last[start]:
                    agrees = before == UNKNOWN or known(before << 32 | token)
                    if self.pair(before, token) if agrees is None else agrees:
                        last[end] = token
        out, at = [], len(word) - 1
        while at >= 0:
            token = last[at]
            if token == UNKNOWN:
                out.extend([self.byte_ids[b] for b in reversed(word[at].encode())])
                at -= 1
            else:
                out.append(token)
                at -= length[token]
        out.reverse()
        return out

    def run_ids(self, n: int) -> list[int]:
        """Ids of n spaces."""
        if n not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = [self.ids[p] for p in self.merged(SPACE * n)[0]]
        return self.runs[n]

    def part_ids(self, part: str) -> list[int]:
        """Ids of spaces and what follows them up to the next space."""
        word = part.lstrip(SPACE)
        spaces = len(part) - len(word)
        if not word:
            return self.run_ids(spaces)
        first, *lines = word.split("\n") if self.breaks_lines else [word]
        ids = self.word_ids(SPACE * (spaces > 0) + first)  # none where a line break comes first
        if spaces > 1:
            alone = ids[0] == self.ids[SPACE]
            ids = self.run_ids(spaces - 1 + alone) + ids[alone:]
        for line in lines:
            ids.append(self.ids["\n"] if "\n" in self.ids else self.byte_ids[10])
            ids.extend(self.word_ids(line))
        return ids

    def surface(self, ids: list[int]) -> str:
        """The pieces' text, bytes put together; a byte that isn't part of a character is U+FFFD."""
        if not any(i in self.byte_of for i in ids):
            return "".join([self.pieces[i] for i in ids])
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding puts in front goes, the others are spaces again."""
        return self.surface(ids).removeprefix(SPACE).replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        return [i for p in parts_of(text) for i in self.part_ids(SPACE + p)]


RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


def parts_of(text: str) -> list[str]:
    """The text cut at spaces, without the one space before each part; a part keeps further ones."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 not in text:
        return text.split(SPACE)[1:]
    return [part[1:] for part in RUN.findall(text)]


class Parts(dict):
    """Part → (number of ids, ids joined by commas, text of the pieces), the last used ones kept:
    when as many as CACHE are new, those used since the last time are the old ones."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table, self.old, self.lines = table, {}, {}

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), ",".join(map(str, ids)), self.table.surface(ids)

    def __missing__(self, part: str) -> tuple[int, str, str]:
        if (out := self.old.get(part)) is None:
            if "\n" in part and part[0] not in SPACE + "\n" and self.table.breaks_lines:
                return self._lines(part)
            out = self.entry(self.table.part_ids(SPACE + part))
        if len(part) <= 64:
            self[part] = out
        return out

    def _lines(self, part: str) -> tuple[int, str, str]:
        """A word and words of the next lines, each looked up for itself."""
        first, *more = part.split("\n")
        found = [self[first]]
        for line in more:
            if (out := self.lines.get(line)) is None:
                out = self.entry(self.table.part_ids("\n" + line))
                if len(line) <= 64:
                    self.lines[line] = out
            found.append(out)
        return sum([f[0] for f in found]), ",".join([f[1] for f in found]), "".join([f[2] for f in found])

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        if len(self.lines) > CACHE:
            self.lines.clear()


_loaded: dict[str, Parts] = {}


def load(model: bytes) -> Parts:
    """The table of a model file's bytes, made once in a Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in ids]
        _loaded[key] = Parts(PieceTable([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], [m.is_byte(i) for i in ids], [not s for s in special]))
    return _loaded[key]


def encode_documents(documents: DataFrame, model: bytes, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (joined by commas), decoded, for each row of documents (doc_id, text).

    With `digests`, ids and decoded are the SHA-256 of those strings, made where the strings are.
    `model` is the model file's content, which goes to the tasks with the function (0.5 MB)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = load(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                n_tokens, ids, decoded = [], [], []
                for text in rows["text"].to_pylist():
                    cache.trim()
                    found = [cache[p] for p in parts_of(text or "")]
                    n_tokens.append(sum([f[0] for f in found]))
                    ids.append(",".join([f[1] for f in found]))
                    decoded.append("".join([f[2] for f in found]).removeprefix(SPACE).replace(SPACE, " "))
                if digests:
                    ids, decoded = ([hashlib.sha256(x.encode()).hexdigest() for x in xs] for xs in (ids, decoded))
                columns = [rows["doc_id"], pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded string")

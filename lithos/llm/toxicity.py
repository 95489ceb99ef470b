"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause's tokens one after another, each what the one before it has written:
the first marks insults and threats that stand within reach of a negation, the second those under
reported speech, the third drops verbs of harm without an intent before them, the last keeps the
clause's strongest head and whether it has a target. Their composition reads a clause in one pass.
The arcs it takes have weights, log odds, and the sum of a clause's weights gives the probability
that the clause is toxic; a text's score joins those of its clauses (one is enough), so that a
matched clause counts and not a word.

The lexicon starts from the seed words below, of four languages, and learns stems (beginnings of
words) that labelled toxic texts have and labelled clean ones lack, and softeners: words that stand
before insults or threats in clean texts only, which are read as negations, in whatever language.
The arcs' weights are fitted to the labels by the largest posterior probability, around priors. All
are fitted to a bounded sample (SAMPLE labelled rows, those of least hash, copies and near copies
counted once); everything else covers every row and whole texts, however long.

A null text is empty. An empty text, like one without a match, gets the base score. Labels that are
null are left out, of several labels of a document the largest counts; without labels the seeds and
priors hold. Rows that repeat are scored alike. Empty tables give an empty result. Only doc_id, text
and toxic are read, whatever other columns are named.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed

#: Labelled rows the fit uses, and stems it may learn.
SAMPLE, STEMS = 6000, 2000
#: Words that a negation reaches.
REACH = 3
#: Texts in which a softener stands before a head: so many clean ones, such a share of them, and so many
#: standard deviations beyond what texts with a head would give by chance.
SOFT, SOFT_SHARE, SOFT_BEYOND = 5, 0.85, 4.0

# The grammar's seed words, in English, German, Spanish and French.
INSULTS = (
    "idiot moron imbecile stupid dumb loser pathetic worthless disgusting trash scum clown fool jerk filth vermin coward garbage "
    "trottel dummkopf depp blödmann abschaum versager widerlich erbärmlich arschloch "
    "idiota estúpido estúpida imbécil basura escoria payaso asqueroso asquerosa patético patética "
    "idiote imbécile crétin ordure racaille minable abruti pathétique"
)
THREATS = "kill hurt destroy beat smash crush burn punish stab strangle töten umbringen verprügeln vernichten matar destruir golpear quemar tuer détruire frapper brûler"
TARGETS = "you your you're yourself yours he she they them him her u everyone these those du dich dir ihr euch tú te ti usted ustedes vosotros tu toi vous eux"
NEGATIONS = "not no never isn't aren't wasn't don't didn't nobody without hardly nicht kein keine keiner nie niemand nunca jamás nadie tampoco pas jamais aucun aucune personne"
REPORTS = "said says say wrote writes claimed claims quoted quote called calls according reported reports alleged told sagte sagt schrieb behauptete nannte dijo dice escribió afirmó llamó dit écrit affirmé appelé"
INTENTS = "will gonna going should must want wanna shall werde werden wirst muss voy vamos debe vais veux dois"

#: Arcs with a weight, and their priors: of heads, and of what is added to a head.
PRIORS = {"insult": 1.1, "stem": 1.1, "threat": 0.4, "target": 0.8, "negated": -3.0, "reported": -2.2}
#: How firmly the priors are held: the inverse of a variance.
FIRM = 1.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;\n]+")
_KINDS = {"I": "insult", "L": "stem", "V": "threat"}


class Transducer:
    """A start, and a step from a state and a symbol to the next state and the symbol written. What the
    last one of a composition says of a clause is its state."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def compose(*parts: Transducer) -> Transducer:
    """Each part reads what the one before it writes; arcs once made are kept, so reading is a table look-up."""
    table: dict = {}

    def step(state, symbol):
        key = state, symbol
        if (arc := table.get(key)) is None:
            to, written = [], symbol
            for part, at in zip(parts, state, strict=True):
                next_, written = part.step(at, written)
                to.append(next_)
            arc = table[key] = tuple(to), written
        return arc

    return Transducer(tuple(p.start for p in parts), step)


def negation() -> Transducer:
    """Heads within reach of a negation are marked."""
    def step(left, x):
        if x == "N":
            return REACH, x
        return max(0, left - 1), f"{x}-" if left and x in _KINDS else x

    return Transducer(0, step)


def report() -> Transducer:
    """Heads after a word of reported speech are marked."""
    return Transducer(False, lambda said, x: (said or x == "R", f"{x}r" if said and x[0] in _KINDS else x))


def intent() -> Transducer:
    """A verb of harm is a threat if an intent stands before it."""
    return Transducer(False, lambda meant, x: (meant or x == "W", "x" if x[0] == "V" and not meant else x))


def head() -> Transducer:
    """The state: the head with the fewest marks, the first of such, and whether there's a target."""
    def step(state, x):
        kept, target = state
        if x == "T":
            return (kept, True), x
        if x[0] in _KINDS and (not kept or len(x) < len(kept)):
            kept = x
        return (kept, target), x

    return Transducer(("", False), step)


def grammar(negations: bool = True, reports: bool = True) -> Transducer:
    """The composition; without the marks of negation or reported speech for comparison."""
    plain = Transducer(None, lambda s, x: (s, x))
    return compose(negation() if negations else plain, report() if reports else plain, intent(), head())


def pattern(last: tuple) -> str:
    """The arcs with a weight that a clause took: insult+target-negated, say."""
    kept, target = last[-1]
    if not kept:
        return ""
    return _KINDS[kept[0]] + "+target" * target + "-negated" * ("-" in kept) + "-reported" * ("r" in kept)


def arcs(name: str) -> list[str]:
    return re.split(r"[+-]", name)


@dataclass
class Model:
    """stems and softeners: learned; weights: of arcs; base: the score of a text without a pattern."""

    stems: list[str] = field(default_factory=list)
    softeners: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    base: float = 0.02

    def clause(self, name: str) -> float:
        """The probability that a clause of a pattern is toxic."""
        return 1 / (1 + math.exp(-sum(self.weights[a] for a in arcs(name))))


class Reader:
    """Finds the patterns of a text's clauses."""

    def __init__(self, stems: Iterable[str] = (), softeners: Iterable[str] = (), machine: Transducer | None = None):
        import ahocorasick

        stems = sorted(stems)
        self.machine = machine or grammar()
        self.words = {w: c for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("W", INTENTS), ("V", THREATS), ("I", INSULTS)) for w in ws.split()}
        self.words |= {w: "N" for w in softeners if w not in self.words}
        self.stems = frozenset(stems)
        self.lengths = sorted({len(s) for s in stems})
        self.triggers = ahocorasick.Automaton()
        for w in {*INSULTS.split(), *THREATS.split(), *stems}:
            self.triggers.add_word(w, w)
        self.triggers.make_automaton()

    def symbol(self, word: str) -> str:
        known = self.words.get(word)
        if known is None:
            known = "L" if any(word[:n] in self.stems for n in self.lengths) else "x"
            if len(self.words) < 60_000:
                self.words[word] = known
        return known

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The words of each clause that may hold a head."""
        text = text.lower()
        if next(self.triggers.iter(text), None) is not None:
            for clause in CLAUSE.split(text):
                if next(self.triggers.iter(clause), None) is not None:
                    yield WORD.findall(clause)

    def read(self, words: list[str]) -> str:
        state = self.machine.start
        for word in words:
            state, _ = self.machine.step(state, self.symbol(word))
        return pattern(state)

    def patterns(self, text: str) -> list[str]:
        return [name for words in self.clauses(text) if (name := self.read(words))]

    def before_heads(self, text: str) -> set[str]:
        """The words without a class of their own within reach before a head, and "" if there's a head at all."""
        out = set()
        for words in self.clauses(text):
            symbols = [self.symbol(w) for w in words]
            for i, x in enumerate(symbols):
                if x in _KINDS:
                    out.add("")
                    out.update(w for w, c in zip(words[max(0, i - REACH) : i], symbols[max(0, i - REACH) : i], strict=True) if c == "x")
        return out


def score_of(patterns: list[str], model: Model) -> float:
    clean = 1 - model.base
    for p in patterns:
        clean *= 1 - model.clause(p)
    return 1 - clean


def held_out(doc_id: Column) -> Column:
    """Rows the labels of which are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fitted(seen: list[tuple[tuple[str, ...], int, int]], base: float) -> dict[str, float]:
    """Weights of the arcs from (patterns of a text, number of toxic texts, of all texts): the largest
    posterior probability, by ascent along the gradient."""
    names, kinds = list(PRIORS), sorted({p for patterns, _, _ in seen for p in patterns})
    start = np.array([PRIORS[n] for n in names])
    if not kinds:
        return dict(PRIORS)
    takes = np.array([[arcs(k).count(n) for n in names] for k in kinds], float)
    counts = np.array([[min(Counter(p)[k], 8) for k in kinds] for p, _, _ in seen], float)
    bad, all_ = (np.array([s[i] for s in seen], float) for i in (1, 2))

    def posterior(weights: np.ndarray) -> float:
        clean = math.log(1 - base) - counts @ np.logaddexp(0, takes @ weights)  # log of the score's complement
        toxic = np.log(np.maximum(-np.expm1(clean), 1e-12))
        return float(bad @ toxic + (all_ - bad) @ clean - FIRM / 2 * ((weights - start) ** 2).sum())

    weights, step, best = start.copy(), 0.5, posterior(start)
    for _ in range(400):
        slope = np.array([(posterior(weights + e) - posterior(weights - e)) / 2e-4 for e in np.eye(len(names)) * 1e-4])
        if (size := float(np.linalg.norm(slope))) < 1e-3:
            break
        while step > 1e-6 and (found := posterior(weights + step * slope / size)) <= best:
            step /= 2
        if step <= 1e-6:
            break
        weights, best, step = weights + step * slope / size, found, step * 2
    # What softens may cost nothing, but never adds.
    return {n: float(min(w, 0.0) if PRIORS[n] < 0 else w) for n, w in zip(names, weights, strict=True)}


def training_rows(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic, words (distinct) of at most `sample` labelled rows that aren't held out, near copies once."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    named = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, 5))))
    rows = rows.withColumn("words", words).withColumn("sketch", F.array_min(shingle))
    return checkpointed(rows.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).withColumn("words", F.array_distinct(words)))


def learned_stems(rows: DataFrame, toxic: int) -> list[str]:
    starts = F.array_distinct(F.flatten(F.transform(F.filter("words", lambda w: F.length(w) >= 4), lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(10))), lambda k: F.substring(w, F.lit(1), k)))))
    counts = rows.select("toxic", F.explode(starts).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    least = max(4, round(0.01 * toxic))
    found = counts.filter((F.col("bad") >= least) & (F.col("all") - F.col("bad") <= 0.02 * F.col("bad"))).orderBy(F.desc("bad"), "stem").limit(STEMS).collect()
    return reduced({r["stem"]: r["bad"] for r in found})


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns stems, softeners and weights from at most `sample` labelled rows that aren't held out."""
    rows = training_rows(documents, labels, sample)
    total = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    stems = learned_stems(rows, int(total["toxic"] or 0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch in batches:
            before = [sorted(reader.before_heads(text)) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(before, pa.list_(pa.string())), batch["toxic"]], ["before", "toxic"])

    before = rows.select("text", "toxic").mapInArrow(read, "before array<string>, toxic int")
    words = before.select(F.explode("before").alias("word"), "toxic").groupBy("word").agg(F.count("*").alias("all"), F.sum(1 - F.col("toxic")).alias("clean"))
    all_heads = words.filter("word = ''").first()
    usual = min(0.99, max(0.01, all_heads["clean"] / all_heads["all"])) if all_heads else 0.5
    n, clean = F.col("all"), F.col("clean")
    enough = (clean >= SOFT) & (clean >= SOFT_SHARE * n) & (clean - usual * n >= SOFT_BEYOND * F.sqrt(n * usual * (1 - usual)))
    soft = words.filter((F.col("word") != "") & enough).orderBy(F.desc("clean"), "word").limit(STEMS).collect()
    softeners = sorted(r["word"] for r in soft)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems, softeners)
        for batch in batches:
            found = [sorted(reader.patterns(text)) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch["toxic"]], ["patterns", "toxic"])

    matched = rows.select("text", "toxic").mapInArrow(match, "patterns array<string>, toxic int")
    seen = matched.groupBy("patterns").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).collect()  # at most a row for each of the sample
    return model_of(stems, softeners, [(tuple(r["patterns"]), int(r["bad"]), int(r["all"])) for r in seen])


def model_of(stems: list[str], softeners: list[str], seen: list[tuple[tuple[str, ...], int, int]]) -> Model:
    bad, all_ = (sum(s[i] for s in seen if not s[0]) for i in (1, 2))
    base = min(0.25, (bad + 0.5) / (all_ + 25)) if seen else Model.base
    return Model(stems, softeners, fitted([s for s in seen if s[0]], base), base)


def reduced(stems: dict[str, int]) -> list[str]:
    """Without stems that a longer one with nearly the same support replaces, and then without those
    that a shorter one covers."""
    longer: dict[str, int] = {}
    for s, n in stems.items():
        for k in range(4, len(s)):
            longer[s[:k]] = max(longer.get(s[:k], 0), n)
    kept = {s for s, n in stems.items() if longer.get(s, 0) < 0.95 * n}
    return sorted(s for s in kept if not any(s[:k] in kept for k in range(4, len(s))))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_clauses (how many matched), for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.stems, model.softeners)
        for batch in batches:
            found = [reader.patterns(text or "") for text in batch["text"].to_pylist()]
            columns = [batch["doc_id"], pa.array([score_of(f, model) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_clauses"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, n_clauses long")


def score_column(text: Column, model: Model) -> Column:
    """The score as a column of the frame it is used in."""
    readers: list[Reader] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not readers:
            readers.append(Reader(model.stems, model.softeners))
        return pd.Series([score_of(readers[0].patterns(t or ""), model) for t in texts], dtype="float64")

    return score(text)

"""Toxicity: a learned lexicon, found in any near spelling and weighed by its context.

The lexicon holds words and word stems that mark toxic rows of a labelled sample. It is kept as a
trie; a Levenshtein automaton runs over it, both at once, as one automaton whose states are built
when first met. Most words leave it after a few letters. A hit is plain or quoted, by the window of
words around it; numbers of hits of each kind are the features of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fields, lean

#: Labelled rows that a model is fitted on at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 12_000
#: Least share of toxic rows among the rows with a word, least number of toxic rows with it, and the
#: number of words that may be toxic by chance alone: it raises the least number of rows, by the share
#: of toxic rows and the number of words that are tried.
PURITY, SUPPORT, CHANCE = 0.8, 4, 0.01
#: A stem must reach so many times the rows of any entry that it covers.
STEM_GAIN = 1.3
#: What a misspelled entry counts for, next to an exact one.
NEAR_WEIGHT = 0.5
#: Lengths of stems; letters from which one and two misspelled letters are allowed.
STEMS = (4, 5, 6)
ONE_EDIT, TWO_EDITS = 5, 8
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 8
#: Words, states and letters of a state that a worker remembers at most.
CACHE_WORDS, CACHE_STATES = 200_000, 20_000

#: Words that report speech, and pairs of quotation marks.
REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes word words term phrase "
    "dijo dice escribió llamó palabra cita sagte sagt schrieb nannte wort zitat dit écrit appelé mot citation".split()
)
OPENING, CLOSING = "\"“„«‹", "\"”“»›"

WORD = re.compile(r"\w+")
FEATURES = ("plain", "quoted", "kinds", "density")


class LexiconAutomaton:
    """Trie of a lexicon times Levenshtein automaton, made deterministic as it is used."""

    def __init__(self, words: list[str], stems: list[str], ordinary: list[str] = ()):
        self.ordinary = frozenset(ordinary)
        self.child: list[dict[str, int]] = [{}]
        self.edits, self.word_edits, self.stem = [0], [-1], [False]
        for entry in words:
            k = 0 if len(entry) < ONE_EDIT else 1 if len(entry) < TWO_EDITS else 2
            path = self.path(entry)
            self.word_edits[path[-1]] = k
            for node in path:
                self.edits[node] = max(self.edits[node], k)
        for entry in stems:
            self.stem[self.path(entry)[-1]] = True
        self.reset()

    def path(self, entry: str) -> list[int]:
        nodes = [0]
        for c in entry:
            if c not in self.child[nodes[-1]]:
                self.child[nodes[-1]][c] = len(self.child)
                self.child.append({})
                self.edits.append(0)
                self.word_edits.append(-1)
                self.stem.append(False)
            nodes.append(self.child[nodes[-1]][c])
        return nodes

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.dead = self.state({})
        self.start = self.state({0: 0})
        self.words: dict[str, int] = {}

    def state(self, least: dict[int, int]) -> int:
        """Number of the state in which each trie node can be reached with so many edits at least."""
        todo = list(least)
        while todo:  # letters of the lexicon that the word leaves out
            node = todo.pop()
            e = least[node] + 1
            for below in self.child[node].values():
                if e <= self.edits[below] and e < least.get(below, 9):
                    least[below] = e
                    todo.append(below)
        key = tuple(sorted(least.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [e for node, e in key if e <= self.word_edits[node]]
            stem = any(self.stem[node] and e == 0 for node, e in key)
            self.accept.append(3 if stem else 0 if not ends else 1 if min(ends) == 0 else 2)
        return self.states[key]

    def step(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, below in self.child[node].items():
                cost = e + (c != letter)
                if cost <= (self.edits[below] if cost else 9) and cost < least.get(below, 9):
                    least[below] = cost
            if e + 1 <= self.edits[node] and e + 1 < least.get(node, 9):
                least[node] = e + 1
        self.next[state][letter] = out = self.state(least)
        return out

    def match(self, word: str) -> int:
        """0: no entry is near; 1: an entry, or a stem, exactly; 2: a misspelled entry."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= CACHE_WORDS or len(self.sets) >= CACHE_STATES:
                self.reset()
            state, known = self.start, 0
            for letter in word:
                to = self.next[state].get(letter)
                state = self.step(state, letter) if to is None else to
                if state == self.dead or self.accept[state] == 3:
                    break
            known = (0, 1, 2, 1)[self.accept[state]]
            if known == 2 and word in self.ordinary:
                known = 0
            self.words[word] = known
        return known


def is_quoted(text: str, start: int, end: int, words: list[re.Match], at: int) -> bool:
    """Whether a hit stands in quotation marks within its window, or close behind a reporting word."""
    first, last = words[max(0, at - WINDOW)], words[min(len(words) - 1, at + WINDOW)]
    before, after = text[first.start() : start], text[end : last.end()]
    opened = max(before.rfind(c) for c in OPENING)
    marks = opened >= 0 and not any(c in before[opened + 1 :] for c in CLOSING) and any(c in after for c in CLOSING)
    return marks or any(w.group() in REPORTING for w in words[max(0, at - 3) : at])


def measure(text: str | None, lexicon: LexiconAutomaton) -> tuple[float, ...]:
    """FEATURES of a whole text."""
    lower = (text or "").lower()
    tokens = WORD.findall(lower)
    known, match = lexicon.words, lexicon.match
    hits = {w for w in set(tokens) if (k if (k := known.get(w)) is not None else match(w))}
    if not hits:
        return (0.0,) * len(FEATURES)
    found = list(WORD.finditer(lower))
    plain = quoted = 0.0
    for at, m in enumerate(found):
        if m.group() in hits:
            weight = NEAR_WEIGHT if match(m.group()) == 2 else 1.0
            if is_quoted(lower, m.start(), m.end(), found, at):
                quoted += weight
            else:
                plain += weight
    kinds = sum(NEAR_WEIGHT if match(w) == 2 else 1.0 for w in hits)
    return (math.log1p(plain), math.log1p(quoted), math.log1p(kinds), 10 * plain / (len(found) + 20))


@dataclass(frozen=True)
class Model:
    """A lexicon and the weights of FEATURES."""

    words: tuple[str, ...]
    stems: tuple[str, ...]
    ordinary: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def useful_stems(words: dict[str, int], stems: dict[str, int]) -> list[str]:
    """Stems, by rows that have them, that reach clearly more rows than the words and longer stems they cover."""
    kept: dict[str, int] = {}
    for stem in sorted(stems, key=lambda s: (-len(s), s)):
        if len(stem) >= min(STEMS) and stems[stem] >= STEM_GAIN * max([n for w, n in {**words, **kept}.items() if w.startswith(stem)], default=0):
            kept[stem] = stems[stem]
    return sorted(k for k in kept if not any(k != o and k.startswith(o) for o in kept))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def measured(docs: DataFrame, words, stems, ordinary, keep: list[str]) -> DataFrame:
    """``keep`` and FEATURES of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = LexiconAutomaton(words, stems, ordinary)
        for batch in batches:
            values = [measure(t, lexicon) for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*values, strict=True)) if values else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(c, pa.float64()) for c in columns], [*keep, *FEATURES])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(lean(run), fields(rows, keep, [(f, T.DoubleType()) for f in FEATURES]))


def lookalikes(docs: DataFrame, words, stems) -> DataFrame:
    """(word, n): words of the texts that the automaton takes for misspelled entries, and the rows with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = LexiconAutomaton(words, stems)
        for batch in batches:
            seen = [w for t in batch.column(0).to_pylist() for w in set(WORD.findall((t or "").lower())) if lexicon.match(w) == 2]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["word"])

    return docs.select("text").mapInArrow(lean(run), "word string").groupBy("word").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels`` (doc_id, toxic) fitted on a bounded sample of rows that are not held out.

    One half of the sample gives the lexicon, the other the weights, so that words that are toxic by
    chance get no weight. Rows with a null id or label are left out; several labels of one id count
    as their highest. With labels of one kind only, or an empty table, every text gets the share of
    toxic rows. Null and empty texts hold no words; other columns are ignored.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.xxhash64(F.lit("sample"), "doc_id")
    size = named.count()
    sample = named.where(F.pmod(place, F.lit(max(1, -(-size // sample_rows)))) == 0).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    # the sample is bounded, so it may be broadcast: texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = checkpointed(rows.withColumn("body", F.xxhash64("text")).dropDuplicates(["body", "toxic"]).drop("body"))

    per_row = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))
    stems = F.flatten(F.transform(per_row, lambda w: F.array(*(F.concat(F.substring(w, 1, n), F.lit("*")) for n in STEMS))))
    marks = F.array_distinct(F.concat(per_row, stems))
    first = rows.where(F.col("half") == 0)
    totals = first.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic = totals["toxic"] or 0
    counted = first.select("toxic", F.explode(marks).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    counted = checkpointed(counted.where(F.col("hits") >= SUPPORT))
    found = {}
    if 0 < toxic < totals["n"]:
        support = max(SUPPORT, math.ceil(math.log(CHANCE / max(1, counted.count())) / math.log(toxic / totals["n"])))
        best = counted.where((F.col("hits") >= support) & (F.col("hits") >= PURITY * F.col("n")))
        found = {r["mark"]: r["hits"] for r in best.collect()}  # bounded by the words of the sample
    kept_stems = useful_stems({m: n for m, n in found.items() if not m.endswith("*")}, {m[:-1]: n for m, n in found.items() if m.endswith("*")})
    words = [m for m in sorted(found) if not m.endswith("*") and not m.startswith(tuple(kept_stems or ["*"]))]
    clean = lookalikes(first.where(F.col("toxic") == 0), words, kept_stems)
    ordinary = sorted(r["word"] for r in clean.collect()) if words else []  # bounded by the words of the sample
    second = measured(rows.where(F.col("half") == 1), words, kept_stems, ordinary, ["toxic"])
    seen = second.groupBy().agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    share = seen["share"] or 0.0
    if not found or share in (0.0, 1.0):
        share = min(max(toxic / totals["n"] if totals["n"] else 0.0, 1e-6), 1 - 1e-6)
        return Model((), (), (), (0.0,) * len(FEATURES), math.log(share / (1 - share)))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    no_less = Matrices.dense(1, len(FEATURES), [0.0] * len(FEATURES))  # no hit speaks for a text

    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(second).select("x", F.col("toxic").cast("double").alias("y"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=2e-3, maxIter=40, lowerBoundsOnCoefficients=no_less).fit(table)
    return Model(tuple(words), tuple(kept_stems), tuple(ordinary), tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, FEATURES, score and predicted of every row of ``docs`` (doc_id, text).

    Only the text is read for the score. Null and empty texts have no hits; repeated rows each get
    their own score; an empty table gives no rows; other columns are ignored.
    """
    rows = measured(docs, model.words, model.stems, model.ordinary, ["doc_id"])
    return rows.select("*", chance(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def chance(model: Model) -> Column:
    """The model's probability, from columns FEATURES."""
    total = F.lit(model.bias)
    for name, weight in zip(FEATURES, model.weights, strict=True):
        total = total + F.col(name) * F.lit(weight)
    return 1 / (1 + F.exp(-total))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with the columns of ``docs``.

    Null and empty texts are judged as texts without hits; repeated rows each stay or go alike; an empty
    table gives no rows.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_tw_row")
    scored = measured(docs.select(row, "text"), model.words, model.stems, model.ordinary, ["_tw_row"])
    return scored.where(chance(model) < 0.5).select(*(F.col(f"_tw_row.`{c}`").alias(c) for c in names))

"""Toxicity: misspelled lexicon terms found by Levenshtein automata, scored in context.

The lexicon is learned from a bounded sample of labelled documents: words, and
stems (beginnings that many different words share), which are far more frequent
in documents with label 1.  It is held as a trie.  The words of a text are
looked up all at once: for every word a bit-parallel nondeterministic
Levenshtein automaton is run while the trie is walked, and a branch is left as
soon as no word's automaton has a live state, so that only the intersection is
visited.  Whole terms match within an edit distance that grows with their
length (one edit from 4 letters, two from 9; learned models allow them at the
first letter too); stems match exactly at the beginning of a word.  A leading
@ $ * is no part of a word, so that a term spelled so lacks its first letter.
Words of clean documents that happen to lie near a term are learned as exceptions.

Each hit is weighed by its context: a term between quotation marks, or within a
few words of a verb of reporting, is a quotation and counts less.  A logistic
model over the weighed hits, fitted around fixed expectations, gives the score.

Cases: a null or empty text has no hits and gets the score of that; without
labelled documents of both kinds there is no lexicon and every score is 0;
repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .workspace import stored

#: Labelled documents from which the lexicon and the model are learned at most, and terms of a lexicon.
SAMPLE, TERMS = 12_000, 500
STEM_LENGTHS = (4, 5, 6, 7)
#: How much more frequent a term must be in documents with label 1, and how improbable that must be by chance (nats).
RATIO, SURPRISE = 20.0, 18.0
REMEMBERED = 300_000
#: Words that are looked up at a time.
WORDS = 20_000
QUOTED_WEIGHT = 0.3
#: Verbs of reporting and quotation marks.
REPORTING = frozenset("said says say wrote writes quoted quote called calls termed labelled insult slur word term dit écrit cité mot appelé dijo escribió citó palabra llamó sagte schrieb zitiert wort nannte".split())
OPENING, CLOSING = "\"“„«‘'", "\"”“»’'"

_TOKENS = re.compile(r"\w+(?:[@$*]+\w+)*")


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    term: int = -1
    stem: int = -1
    budget: int = 0
    shortest: int = 1 << 30
    longest: int = 0


def budget(term: str) -> int:
    """The edit distance within which a whole term matches."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms and stems as a trie; :meth:`find` intersects it with the automata of many words."""

    def __init__(self, terms: list[str], stems: list[str], anywhere: bool = False):
        self.terms, self.stems, self.anywhere = terms, stems, anywhere
        self.root = _Node()
        for i, term in enumerate(terms):
            self._insert(term, budget(term)).term = i
        for i, stem in enumerate(stems):
            self._insert(stem, 0, stem=True).stem = i
        self.width = min(max([len(t) for t in [*terms, *stems]], default=0) + 3, 62)

    def _insert(self, term: str, edits: int, stem: bool = False) -> _Node:
        path, node = [self.root], self.root
        for c in term:
            node = node.children.setdefault(c, _Node())
            path.append(node)
        for p in path:
            p.budget = max(p.budget, edits)
            p.shortest = min(p.shortest, len(term) - edits)
            p.longest = max(p.longest, 1 << 30 if stem else len(term) + edits)
        return node

    def find(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """For each word that matches: its nearest term ("stem*" for a stem) and the distance."""
        if not words or not self.width:
            return {}
        codes = np.array(words, dtype=f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        sizes = (codes != 0).sum(axis=1)
        powers = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        last = np.uint64(1) << sizes.astype(np.uint64)
        valid = (last << np.uint64(1)) - np.uint64(1)
        where: dict[str, np.ndarray] = {}
        one = np.uint64(1)
        best: dict[int, tuple[int, str]] = {}

        def keep(rows: np.ndarray, term: str, distance: int) -> None:
            for r in rows.tolist():
                if r not in best or (distance, term) < best[r]:
                    best[r] = (distance, term)

        everyone = np.arange(len(words))
        # Unless edits may be anywhere, none is before the first letter: states with errors are empty at the root, and its letters must match.
        start = [(2 << e) - 1 if self.anywhere else int(e == 0) for e in range(self.root.budget + 1)]
        todo = [(self.root, everyone, [np.full(len(words), x, np.uint64) & valid for x in start])]
        while todo:
            node, rows, at = todo.pop()
            for c, child in node.children.items():
                own = np.flatnonzero((sizes[rows] >= child.shortest) & (sizes[rows] <= child.longest))
                if not len(own):
                    continue
                if c not in where:
                    where[c] = ((codes == ord(c)) * powers).sum(axis=1, dtype=np.uint64)
                sub, hits = rows[own], where[c][rows[own]]
                new: list[np.ndarray] = []
                for e in range(child.budget + 1):
                    s = (at[e][own] & hits) << one
                    if e and (self.anywhere or node is not self.root):
                        before = at[e - 1][own]
                        s |= before | before << one | new[e - 1] << one
                    elif e:
                        s |= new[e - 1] << one
                    new.append(s & valid[sub])
                live = np.bitwise_or.reduce(new) != 0
                if not live.any():
                    continue
                sub, new = sub[live], [s[live] for s in new]
                if child.stem >= 0:
                    keep(sub[new[0] != 0], self.stems[child.stem] + "*", 0)
                if child.term >= 0:
                    term = self.terms[child.term]
                    for e in range(min(budget(term), child.budget) + 1):
                        keep(sub[new[e] & last[sub] != 0], term, e)
                todo.append((child, sub, new))
        return {words[r]: (term, distance) for r, (distance, term) in best.items()}


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    #: What a misspelled term counts, compared with an exact one.
    misspelled: float = 0.0
    weights: np.ndarray | None = None
    #: Whether the first letter may be misspelled too.
    anywhere: bool = False


def words(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


class Finder:
    """Weighed hits of texts.  Remembers which words match and which do not."""

    def __init__(self, model: Model):
        self.lexicon, self.exceptions = Lexicon(model.terms, model.stems, model.anywhere), model.exceptions
        self.misspelled = model.misspelled
        self.plain: set[str] = set()
        self.matching: dict[str, tuple[str, int]] = {}

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.plain and t not in self.matching]
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        found = {w: m for i in range(0, len(new), WORDS) for w, m in self.lexicon.find(new[i : i + WORDS]).items() if m[1] == 0 or w not in self.exceptions}
        self.matching |= found
        self.plain.update(w for w in new if w not in found)

    def hits(self, text: str) -> list[tuple[str, str, int, bool]]:
        """word, term, distance and whether it is quoted, for each hit of a text whose words are learned."""
        lower = text.lower()
        spans = [m for m in _TOKENS.finditer(lower)]
        out = []
        for i, m in enumerate(spans):
            match = self.matching.get(m[0])
            if match is None:
                continue
            before, after = lower[max(0, m.start() - 60) : m.start()], lower[m.end() : m.end() + 60]
            quoted = _inside_quotes(before, after) or any(s[0] in REPORTING for s in spans[max(0, i - 4) : i])
            out.append((m[0], *match, quoted))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        split = [set(words(t)) for t in texts]
        self.learn(set().union(*split))
        out = np.zeros((len(texts), 4))
        for i, (tokens, text) in enumerate(zip(split, texts, strict=True)):
            if tokens.isdisjoint(self.matching):
                continue
            for _, term, distance, quoted in self.hits(text):
                kind = int(term[-1] == "*")
                weight = (QUOTED_WEIGHT if quoted else 1.0) * (self.misspelled if distance else 1.0)
                out[i, kind] += weight
                out[i, kind + 2] = max(out[i, kind + 2], weight)
        out[:, :2] = np.minimum(out[:, :2], 4)
        return out


def _inside_quotes(before: str, after: str) -> bool:
    """Whether a quotation opens shortly before and closes shortly after, with no end of sentence between."""
    left, right = re.split(r"[.!?\n]\s", before)[-1], re.split(r"[.!?\n]\s", after)[0]
    opened = re.search(r"(?:^|[\s(])[" + re.escape(OPENING) + r"][^" + re.escape(CLOSING) + r"]*$", left)
    return bool(opened) and any(c in right for c in CLOSING)


#: Expected weights (intercept; capped counts of terms and stems; the strongest hit of each) and how far data may move them.
EXPECTED = np.array([-3.0, 0.5, 0.5, 4.0, 4.0])
SPREAD = np.array([4.0, 1.0, 1.0, 2.0, 2.0])
#: What a misspelled term counts at best.
MISSPELLED = 0.8


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (intercept first) with the largest posterior, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, prior = EXPECTED.copy(), 1 / SPREAD**2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + prior * (w - EXPECTED)
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(prior)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Sketches by which near copies in the sample are found.
SKETCHES = 4
_SPREAD = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def _sketches(tokens: list[str]) -> list[int]:
    """The least of several hashes of five words in sequence: near copies mostly share each."""
    runs = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + 5])) for i in range(max(1, len(tokens) - 4))]
    mixed = np.array(runs, np.uint64)[:, None] * _SPREAD[None, :]
    return ((mixed ^ mixed >> np.uint64(29)).min(axis=0) >> np.uint64(1)).tolist()


def _keys(df: DataFrame) -> DataFrame:
    """How many documents of each label hold each word ("w:...") and begin a word with each stem ("s:...")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                tokens = {t for t in words(text) if len(t) >= 3}
                counts[label].update("w:" + t for t in tokens)
                counts[label].update({"s:" + t[:n] for t in tokens for n in STEM_LENGTHS if len(t) > n})
        keys = sorted(counts[0].keys() | counts[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[k][x] for x in part], pa.int64()) for k in (0, 1))], names=["k", "clean", "toxic"])

    return df.select("text", "label").mapInArrow(run, "k string, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _one_of_near_copies(held: DataFrame) -> DataFrame:
    """The sample with one row for each label and sketch, for one sketch after another."""

    names = [f"s{k}" for k in range(SKETCHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_sketches(words(t)) for t in batch.column("text").to_pylist()]
            columns = [pa.array([s[k] for s in sketches], pa.int64()) for k in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), *columns], names=["text", "label", *names])

    out = held.select("text", "label").mapInArrow(run, "text string, label int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        rest = [c for c in out.columns if c not in ("label", n)]
        out = out.groupBy("label", n).agg(F.min(F.struct(*rest)).alias("row")).select("label", "row.*")
    return out.select("label", "text")


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Nats by which so large a part of occurrences in documents with label 1 exceeds chance."""
    n, q = toxic + clean, toxic / (toxic + clean)
    if q <= share:
        return 0.0
    return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if clean else 0.0))


def learn(sample: DataFrame, n_clean: int, n_toxic: int) -> Model:
    """Lexicon, exceptions and weights from (text, label) rows; ``n_clean`` and ``n_toxic`` are the labels' totals, for the prior."""
    held = stored(sample, "toxicity-sample")
    sizes = dict(held.groupBy("label").count().collect())
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model()
    single = stored(_one_of_near_copies(held), "toxicity-single")
    kinds = dict(single.groupBy("label").count().collect())
    share = kinds[1] / (kinds[0] + kinds[1])
    often = (F.col("toxic") / kinds[1]) / ((F.col("clean") + 0.5) / kinds[0])
    rows = _keys(single).where((F.col("toxic") >= 4) & (often >= RATIO)).orderBy(F.desc("toxic"), "k").limit(20 * TERMS).collect()
    found = {r["k"]: (r["toxic"], r["clean"]) for r in rows}
    sure = {k: c for k, c in found.items() if _surprise(*c, share) >= SURPRISE}
    stems: list[str] = []
    for stem in sorted((k[2:] for k in sure if k[:2] == "s:"), key=lambda t: (len(t), t)):
        if any(stem.startswith(s) or s.startswith(stem) for s in stems):
            continue
        extensions = [found[k][0] for k in found if k[:2] == "w:" and k[2:].startswith(stem)]
        # A beginning that one word accounts for is that word, not a stem.
        if max(extensions, default=0) <= sure["s:" + stem][0] / 2:
            # Of the longer beginnings, the longest that loses next to nothing is the more exact one.
            longer = [k[2:] for k in sure if k.startswith("s:" + stem) and sure[k][0] >= 0.95 * sure["s:" + stem][0]]
            stems.append(max(longer, key=len))
    terms = [k[2:] for k in sure if k[:2] == "w:" and not any(k[2:].startswith(s) for s in stems)]
    stems, terms = stems[:TERMS], terms[:TERMS]

    near = Model(terms, stems, anywhere=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(near)
        for batch in batches:
            for piece in slices(batch, "text"):
                for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist(), strict=True):
                    tokens = set(words(text))
                    finder.learn(tokens)
                    hit = [t for t in tokens if finder.matching.get(t, ("", 0))[1]]
                    half = xxhash.xxh64_intdigest(text) & 1
                    if hit:
                        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string()), pa.array([label] * len(hit), pa.int32()), pa.array([1 / len(hit)] * len(hit)), pa.array([half] * len(hit), pa.int32())], names=["w", "label", "part", "half"])

    def misspelt(rows: DataFrame) -> DataFrame:
        return rows.select("text", "label").mapInArrow(run, "w string, label int, part double, half int")

    # How far misspellings tell the labels apart where the exceptions come from other documents: those of one half, held against the other.
    halves = stored(misspelt(single), "toxicity-misspelt")
    known = halves.where("label = 0 and half = 0").select("w").distinct()
    docs = dict(halves.where("half = 1").join(known, "w", "left_anti").groupBy("label").agg(F.sum("part")).collect())
    wrong = misspelt(held).where("label = 0").groupBy("w").count().orderBy(F.desc("count"), "w").limit(20 * TERMS).collect()
    right, all_ = docs.get(1, 0.0) + 1, docs.get(0, 0.0) + docs.get(1, 0.0) + 1
    model = Model(terms, stems, frozenset(r[0] for r in wrong), MISSPELLED * right / all_, anywhere=True)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            for piece in slices(batch, "text"):
                x = finder.features(piece.column("text").to_pylist())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 4, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("label"), rows], names=["label", "x"])

    pairs = sorted((tuple(r["x"]), r["label"]) for r in held.select("label", "text").mapInArrow(measure, "label int, x array<double>").limit(2 * SAMPLE).collect())
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    weight = np.where(y == 1, n_toxic / toxic, n_clean / clean)
    model.weights = fit_logistic(x, y, weight * len(y) / weight.sum())
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score, between 0 and 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*keep)
    names = [f"__{i}" for i in range(len(kept.columns))]
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(keep, names, strict=True)]
    # A text that is kept anyway is not sent twice.
    own = names[keep.index(text)] if all(isinstance(c, str) for c in keep) and text in keep else "__text"
    rows = df.select(*columns, *([F.col(text).cast("string").alias("__text")] if own == "__text" else []))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "__text") + ", __score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Finder(model)
        for batch in batches:
            for piece in slices(batch, own):
                if model.weights is None:
                    scores = np.zeros(piece.num_rows)
                else:
                    x = finder.features(["" if t is None else t for t in piece.column(own).to_pylist()])
                    scores = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [pa.array(scores)], names=[*names, "__score"])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, kept.columns, strict=True)], F.col("__score").alias("score"))

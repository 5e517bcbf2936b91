"""Toxicity: a lexicon matched with misspellings, and the context of each match.

Terms that mark toxic documents are learned from labelled rows and put in a trie. A Levenshtein automaton runs over
the trie for every word: its states are sets of (trie node, edits so far), made deterministic as they are met. Each
match gets a context window: one that stands within quotation marks counts as quoted, not as abuse. Words an edit
or two away from a term that clean labelled texts use are words of their own, not misspellings. A logistic model over
matches, of which a misspelled one counts less, and quoted matches gives the score. Learning and scoring cut words by
one rule: letters, marks and digits, with symbols between them. Where a whole word is no term, its runs of letters are
tried.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm._common import least_hashed, stored

#: Labelled rows that a model is fitted on at most (those of smallest hash); terms of a lexicon at most; toxic texts that
#: a term needs; terms that may be expected by chance alone; the least share of toxic ones among the texts that have a
#: term; lengths from which one edit and two are allowed; what a misspelled match counts, and its term's weight.
SAMPLE, TERMS, SUPPORT, CHANCE, PURITY, EDIT_LENGTH, EDITS_LENGTH, MISSPELLED = 20_000, 1024, 3, 10, 0.9, 5, 9, (0.5, 0.75)
#: Characters to each side of a match that are searched for quotation marks; words that a worker remembers.
WINDOW, REMEMBER = 60, 300_000
#: Opening quotation marks and the marks that close them.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}

#: Symbols that stand for letters within words.
SYMBOLS = r"@$*#!|+&€"

FEATURES = ("hits", "quoted", "share", "weight")


@cache
def _rules(ascii_only: bool) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a word and of its runs of letters; those of ASCII texts do the same faster."""
    marks = "" if ascii_only else "\u200c\u200d" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
    inner = rf"[\w{marks}]+"
    return re.compile(rf"{inner}(?:[{SYMBOLS}]+{inner})*"), re.compile(rf"(?:[^\W\d_]|[{marks}])+" if marks else r"[^\W\d_]+")


def _parts(word: str) -> list[str]:
    """The word, and its runs of letters if they aren't all of it; none for a word without letters."""
    if word.isalpha():
        return [word]
    runs = _rules(False)[1].findall(word)
    return [word, *(r for r in runs if r != word)] if runs else []


def _edits(term: str) -> int:
    return int(len(term) >= EDIT_LENGTH) + int(len(term) >= EDITS_LENGTH)


class Automaton:
    """Finds the best term within the allowed edits of a word: (term number, edits) or None."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int | None] = [None]
        self.reach: list[int] = [0]  # most edits that any term below allows
        for n, term in enumerate(terms):
            node, edits = 0, _edits(term)
            self.reach[0] = max(self.reach[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.term[node] = n
        self.edits = [_edits(t) for t in terms]
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.finals: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        """The number of a set of (node, edits), closed under leaving out a character of a term."""
        todo, closed = list(items), set(items)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and (child, e + 1) not in closed:
                    closed.add((child, e + 1))
                    todo.append((child, e + 1))
        key = frozenset(closed)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= self.edits[self.term[n]]]
            self.finals.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            for d, child in self.children[node].items():
                if d == c:
                    out.add((child, e))
                elif e < self.reach[child]:
                    out.add((child, e + 1))
            if e < self.reach[node]:
                out.add((node, e + 1))
        self.moves[state][c] = found = self._state(out) if out else -1
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > 50_000:
            self._clear()
        state = self.start
        for c in word:
            following = self.moves[state].get(c)
            state = self._move(state, c) if following is None else following
            if state < 0:
                return None
        return self.finals[state]


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens in the window before and closes in the window after, on the same line."""
    before = text[max(0, start - WINDOW) : start].rpartition("\n")[2]
    after = text[end : end + WINDOW].partition("\n")[0]
    for opened, closed in QUOTES.items():
        at = before.rfind(opened)
        if at >= 0 and closed in after and (before.count(opened) % 2 == 1 if opened == closed else closed not in before[at + 1 :]):
            return True
    return False


@dataclass
class Model:
    terms: list[str]
    weights: list[float]  # log odds of the terms
    own_words: frozenset[str] = frozenset()  # one or two edits from a term, but used by clean texts
    coefficients: list[float] = field(default_factory=list)  # of FEATURES, then the constant


def featurizer(model: Model):
    """A function from texts to rows of FEATURES."""
    automaton, known = Automaton(model.terms), {}
    weights = model.weights

    def matches(w: str) -> list[tuple[int, int]]:
        """Terms in a word: its runs of letters if one of them is a term as it stands, else the word, else the runs."""
        parts = _parts(w)
        found = [(p, hit) for p in parts if (hit := automaton.match(p)) and not (hit[1] and p in model.own_words)]
        runs = [hit for p, hit in found if p != w]
        whole = [hit for p, hit in found if p == w]
        return whole if whole and not (whole[0][1] and any(e == 0 for _, e in runs)) else runs

    def features(text: str) -> list[float]:
        nonlocal known
        lower = text.lower()
        word = _rules(lower.isascii())[0]
        found = word.findall(lower)
        hits = {}
        for w in set(found):
            hit = known.get(w)
            if hit is None:
                if len(known) >= REMEMBER:
                    known = {}
                hit = known[w] = matches(w)
            if hit:
                hits[w] = hit
        if not hits:
            return [0.0] * len(FEATURES)
        hit_mass = quoted = 0
        best = 0.0
        for m in word.finditer(lower):
            hit = hits.get(m.group())
            if hit is None:
                continue
            if is_quoted(lower, m.start(), m.end()):
                quoted += len(hit)
                continue
            for term, edits in hit:
                hit_mass += MISSPELLED[0] if edits else 1
                best = max(best, weights[term] * (MISSPELLED[1] if edits else 1))
        return [math.log1p(hit_mass), math.log1p(quoted), hit_mass / sum(not w.isdigit() for w in found), best]

    return features


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, limit: int) -> DataFrame:
    """text and label of a bounded number of labelled documents: the ids of smallest hash are broadcast."""
    ids = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    ids = least_hashed(ids.groupBy("id").agg(F.max("label").alias("label")), limit)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "id")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Lexicon and coefficients from at most `limit` labelled rows. Copies of a text count once. Without toxic or
    without other rows the lexicon is empty and the constant is the prior."""
    sample = stored(_labelled(docs, labels, doc_id, text, label, limit).dropDuplicates(["text", "label"]), "sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    seen = sample.select("label", "text").mapInPandas(_vocabulary, "label int, word string")
    counts = stored(seen.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")), "words")
    # A bound of the probability that as many of n texts are toxic by chance (Chernoff), for all words together.
    tried, base, part = counts.where(F.col("n") >= SUPPORT).count(), toxic / max(1, toxic + clean), F.col("toxic") / F.col("n")
    missing = lambda q, p: F.when(q > 0, q * F.log(q / F.lit(max(p, 1e-12)))).otherwise(0.0)
    surprise = F.col("n") * (missing(part, base) + missing(1 - part, 1 - base))
    likely = (part > base) & (surprise >= math.log(max(1.0, tried / CHANCE)))
    good = counts.where((F.col("toxic") >= SUPPORT) & likely & (F.col("toxic") >= PURITY * F.col("n")) & (F.length("word") > 2))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (clean + 1))
    top = good.select("word", odds.alias("odds")).orderBy(F.desc("odds"), "word").limit(TERMS).collect()
    model = Model([r["word"] for r in top], [r["odds"] for r in top])
    # Neighbours of at most TERMS terms.
    near = counts.where(F.col("toxic") < F.col("n")).select("word").mapInPandas(_near(model.terms), "word string").collect()
    model.own_words = frozenset(r["word"] for r in near)
    rows = sample.select("label", "text").mapInPandas(_featured(model), ", ".join(f"{f} double" for f in FEATURES) + ", label int").toPandas()  # at most `limit` rows
    model.coefficients = _logistic(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float))
    return model


def _vocabulary(batches):
    """label, word: the words of each text, once, and their runs of letters."""
    for batch in batches:
        rows = [(label, w) for label, t in zip(batch["label"], batch["text"]) for w in {p for x in set(_rules(False)[0].findall(t.lower())) for p in _parts(x)}]
        yield pd.DataFrame(rows, columns=["label", "word"])


def _featured(model: Model):
    def run(batches):
        features = featurizer(model)
        for batch in batches:
            yield pd.DataFrame([features(t) for t in batch["text"]], columns=FEATURES, dtype=float).assign(label=batch["label"].to_numpy())

    return run


def _near(terms: list[str]):
    def run(batches):
        automaton = Automaton(terms)
        for batch in batches:
            found = map(automaton.match, batch["word"])
            yield batch[[hit is not None and hit[1] > 0 for hit in found]]

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method on the penalised log likelihood; rows in a fixed order give the same sums."""
    order = np.lexsort((*x.T, y))
    x, y = np.hstack([x, np.ones((len(x), 1))])[order], y[order]
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return w.tolist()


def _scored(model: Model):
    def run(batches):
        features, w = featurizer(model), np.array(model.coefficients)
        for batch in batches:
            x = np.array([features(t) for t in batch["_rl_text"]], dtype=float).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield batch.drop(columns=["_rl_text"]).assign(score=score)

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row; null and empty texts have no matches. Repeated rows and null ids count."""
    narrow = docs.select(F.col(doc_id).cast("string").alias(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_rl_text"))
    return narrow.mapInPandas(_scored(model), f"`{doc_id}` string, score double").withColumn(doc_id, F.col(doc_id).cast("long"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The documents whose score is below `most`, with all their columns."""

    def run(batches):
        import pyarrow as pa

        features, w = featurizer(model), np.array(model.coefficients)
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(text).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) < most))

    return docs.mapInArrow(run, docs.schema)

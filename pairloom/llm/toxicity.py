"""Toxicity by fuzzy lexicon matching and context windows.

The lexicon is a trie; a Levenshtein automaton (how many edits are allowed
depends on a term's length) is intersected with it into one deterministic automaton, built
state by state as words need it, so a word costs a few table look-ups until
it dies or is accepted.  Tokens with digits or signs inside are also read with
these folded to letters (``1d10t``).

The lexicon has a fixed part, listed below, and a part learned from labelled documents:
words for which the lower confidence bound of the share of toxic documents among those that hold
them is at least one half.

Each match is weighed by the window of words around it.  Quotation marks,
verbs of reporting and negations speak for quotation; second-person pronouns,
intensifiers and exclamation marks for abuse.  A document's features (exact,
fuzzy and abusive weight, share quoted, density) are combined by a logistic
model, fitted to a bounded sample with a Gaussian prior around fixed weights, so that it
also works where few labels or none exist.

Rules: null and empty texts have no match and score what a text without a
match scores; held-out and unlabelled rows teach nothing; repeated rows are scored alike and teach as often as they occur;
where a word is as near to several terms, the fewest edits count once; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of abuse.
TERMS = (
    "arsehole asshole bastard bitch bullshit cretin crybaby cunt degenerate dickhead disgusting dumbass dumb "
    "fool freak fuck fucking garbage halfwit idiot idiotic imbecile jackass jerk kike kys liar loser lowlife "
    "moron moronic motherfucker nazi nitwit parasite pathetic pervert pig prick psycho retard retarded scum scumbag "
    "shit shithead slut stupid subhuman trash twat ugly useless vermin wanker whore worthless clown "
    "idiota imbecil estupido estupida imbécile connard salope ordure crétin arschloch dummkopf abschaum trottel hurensohn"
).split()
#: Words that mark quotation or reporting.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quoting reads word term insult insults reported reportedly alleged allegedly dit disait écrit dijo dice escribió sagte schrieb nannte zitat".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't pas jamais nunca nicht kein keine nie".split())
#: Words that mark an attack.
ADDRESS = frozenset("you your you're youre yourself u ur ya du dein deine dich tu ton ta toi vous votre tú usted eres vosotros".split())
INTENSIFIERS = frozenset("such so very absolute absolutely complete completely total totally utter utterly real really damn".split())
#: Opening and closing quotation marks.
_QUOTES = ('""', "“”", "„“", "«»", "‘’")
_LEET = str.maketrans("013457@$!", "oieastasi")
_TOKEN = re.compile(r"[^\W_]+(?:[@$!1][^\W_]+)*")
_WORD = re.compile(r"[^\W\d_]+")
WINDOW = 6
#: Prior weights: bias, exact, fuzzy, abusive, quoted share, density.
PRIOR = np.array([-3.0, 3.0, 1.0, 1.0, -1.0, 0.2])
_OTHER = ""


class FuzzyLexicon:
    """The intersection of a lexicon trie and Levenshtein automata, determinised lazily."""

    def __init__(self, terms: dict[str, int], max_states: int = 100_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.ends = [0], [-1]
        for term, k in sorted(terms.items()):
            node = 0
            self.budget[0] = max(self.budget[0], k)
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append(-1)
                node = nxt
                self.budget[node] = max(self.budget[node], k)
            self.ends[node] = k
        self.alphabet = {c for kids in self.children for c in kids}
        self.restart()

    def restart(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []  # -1 dead or not accepted, else the fewest edits
        self.state(self.closed({(0, 0)}))

    def closed(self, positions: set) -> frozenset:
        """With the letters of terms skipped, and without positions that allow no more than another."""
        best: dict[int, int] = {}
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            if e <= self.budget[node] and e < best.get(node, 99):
                best[node] = e
                todo.extend((kid, e + 1) for kid in self.children[node].values())
        return frozenset(best.items())

    def state(self, positions: frozenset) -> int:
        if (found := self.ids.get(positions)) is None:
            found = self.ids[positions] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
            done = [e for node, e in positions if self.ends[node] >= e]
            self.accepts.append(min(done) if done else -1)
        return found

    def step(self, at: int, c: str) -> int:
        out = set()
        for node, e in self.sets[at]:
            for letter, kid in self.children[node].items():
                out.add((kid, e if letter == c else e + 1))
            out.add((node, e + 1))
        positions = self.closed(out)
        nxt = self.moves[at][c] = self.state(positions) if positions else -1
        return nxt

    def edits(self, word: str) -> int:
        """Edits to the nearest term within its allowance, or -1."""
        if len(self.sets) > self.max_states:
            self.restart()
        at = 0
        for c in word:
            c = c if c in self.alphabet else _OTHER
            nxt = self.moves[at].get(c)
            at = self.step(at, c) if nxt is None else nxt
            if at < 0:
                return -1
        return self.accepts[at]


def allowance(term: str, learned: bool = False) -> int:
    """Edits allowed: none in short terms, one from five letters (seven, if learned), two from nine (never, if learned)."""
    return (1 if len(term) >= 7 else 0) if learned else 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Features of texts; remembers words up to ``room``."""

    def __init__(self, learned: list[str], room: int = 300_000):
        terms = {t: allowance(t, True) for t in learned} | {t: allowance(t) for t in TERMS}
        self.lexicon, self.room = FuzzyLexicon(terms), room
        self.known: dict[str, int] = {}

    def edits(self, token: str) -> int:
        best = self.lexicon.edits(token)
        if best and not token.isalpha():
            folded = self.lexicon.edits(token.translate(_LEET))
            best = max(1, folded) if folded >= 0 and (best < 0 or folded < best) else best
        return best

    def _learn(self, token: str) -> int:
        e = self.known[token] = self.edits(token)
        return e

    def matches(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, lower-cased token, edits) of every match."""
        if len(self.known) > self.room:
            self.known.clear()
        lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        get, learn = self.known.get, self._learn
        hits = {t for t in set(_TOKEN.findall(lower)) if (learn(t) if (e := get(t)) is None else e) >= 0}
        return [(m.start(), m.end(), m[0], self.known[m[0]]) for m in _TOKEN.finditer(lower) if m[0] in hits] if hits else []

    def features(self, text: str | None) -> tuple[float, ...]:
        if not text:
            return (0.0,) * 5
        found = self.matches(text)
        if not found:
            return (0.0,) * 5
        exact = fuzzy = abusive = quoted = 0.0
        for start, end, _, edits in found:
            weight = 1.0 if edits == 0 else 0.5 / edits
            exact += weight * (edits == 0)
            fuzzy += weight * (edits > 0)
            q, a = window_scores(text, start, end)
            quoted += q
            abusive += weight * (1 + a) * (1 - q)
        return float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(abusive)), quoted / len(found), min(5.0, 1000 * len(found) / (len(text) + 50))


def window_scores(text: str, start: int, end: int) -> tuple[float, float]:
    """How far the words around a match speak for quotation and for abuse, each 0 to 1."""
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    near = [w.lower() for w in before.split()[-WINDOW:]] + [w.lower() for w in after.split()[:WINDOW]]
    bare = {w.strip(".,;:!?()'" + "".join(_QUOTES)) for w in near}
    opened = any(b in after[:30] and (before.count(a) % 2 if a == b else before.rfind(a) > before.rfind(b)) for a, b in _QUOTES)
    q = min(1.0, 0.6 * opened + 0.4 * bool(bare & REPORTING) + 0.2 * bool(bare & NEGATIONS))
    a = min(1.0, 0.5 * bool(bare & ADDRESS) + 0.25 * bool(bare & INTENSIFIERS) + 0.25 * ("!" in after[:20]))
    return q, a


def learned_terms(labelled: DataFrame, z: float = 2.6, least_share: float = 0.5) -> list[str]:
    """Words that mark toxic documents among rows (text, label), of which there are no more than a bounded sample has."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n: dict[str, list[int]] = {}
            for text, y in zip(f.text, f.label, strict=True):
                for w in set(_WORD.findall(text.lower())):
                    if 3 <= len(w) <= 40:
                        n.setdefault(w, [0, 0])[y] += 1
            yield pd.DataFrame([(w, *c) for w, c in n.items()], columns=["word", "clean", "toxic"])

    per = labelled.mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, p = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    got = per.where(F.col("toxic") >= 3).withColumn("low", low).where(F.col("low") >= least_share).orderBy("word")
    return [r.word for r in got.select("word").collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 2.0, steps: int = 30) -> np.ndarray:
    """Newton's method for the most likely weights under a Gaussian prior around ``prior``."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> tuple[list[str], np.ndarray]:
    """Learned terms and weights, from at most ``max_rows`` rows of ``labels`` (doc_id, label)."""
    chosen = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # at most max_rows ids
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
    terms = learned_terms(sample)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(terms)
        for f in frames:
            out = pd.DataFrame([m.features(t) for t in f.text], columns=list("abcde"))
            yield out.assign(label=f.label.to_numpy())

    got = sample.mapInPandas(measure, "a double, b double, c double, d double, e double, label int").toPandas()  # at most max_rows rows of six numbers
    return terms, fit_logistic(got[list("abcde")].to_numpy(dtype=float).reshape(-1, 5), got.label.to_numpy(dtype=float))


def predict_toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """A double column for ``docs``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, w = shared.value
        m = Matcher(terms)
        for texts in batches:
            x = np.array([m.features(t) for t in texts]).reshape(-1, 5)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return predict(F.col(text))

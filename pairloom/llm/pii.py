"""Personal data: rule spans, and further spans chosen by boosted trees among high-recall candidates.

Base spans follow fixed patterns with checks (digit counts, Luhn, octets).
Generators then propose overlapping candidates of the same kinds in looser
formats: obfuscated addresses, telephone numbers without a country
code, cards and addresses in other separators.  Boosted trees score each
candidate from its format and context; the threshold of each kind is the least at
which held-out examples keep the wanted precision, and what passes it and does not
overlap a span already taken is added, best score first.

No text carries labels, so examples come from the base spans of all
documents: a candidate that lies on a base span of its kind is positive, and so
are variants of base spans rewritten into the looser formats in their own
context (``a@b.c`` as ``a [at] b [dot] c``, a telephone number without its country code);
candidates that a rule's check refused, and other runs of digits, are negative.
The trees grow in Spark jobs that add up gradients over all examples, and every held-out example counts in the thresholds.

Rules: a null text is empty and has no span; positions count code points; candidates of equal score are taken in order of their
place; repeated rows are treated alike and teach once; an empty table gives no rows, and teaches that no span is to be added.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.boosting import BoostedTrees
from pairloom.llm.common import free, given_back, small_batches, stored
from pairloom.operators.boosting import BoostedScorer, fit_boosted

#: The kinds in their order, and the base pattern of each.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser formats, by kind.
LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|＠|@)\s?[\w-]{1,64}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[\w-]{1,24}){1,4}", re.I),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)[0-9]{1,3}){3,4}(?![\w.])", re.I),
    "card": re.compile(r"(?<![\w.])[0-9]{4}(?:[./_\x20-]{0,2}[0-9]{2,6}){2,4}(?![\w])"),
    "phone": re.compile(r"(?<![\w.+])(?:00[0-9]{1,3}[\x20.-]?)?\(?0?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?!\w)"),
}
#: Words that announce a kind.
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel adresse".split()),
    "ip": frozenset("ip host server address addr login".split()),
    "card": frozenset("card visa mastercard amex credit debit cvv carte tarjeta karte pan".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax teléfono téléphone telefon handy".split()),
}
_DIGIT = re.compile("[0-9]")
#: Parts of the base patterns by which they are searched in one pass: a local name read backwards, a host, numbers joined by single dots.
_LOCAL, _HOST, _DOTTED = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+)*")
FEATURES = 16
_NAMES = [f"f{i}" for i in range(FEATURES)]
#: Thresholds are multiples of one in so many.
STEPS = 10_000
#: Held-out examples without which nothing of a kind is added.
LEAST_TESTED = 20
#: Texts that Python is handed at a time.
BATCH = 1000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x[-4:] if not x[:-4].strip("0") else "999" for x in s.split(".")))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """The base e-mails, each sought from its at sign: a long run without one is never read twice."""
    done = last = 0
    at = text.find("@")
    while at >= 0:
        local = len(_LOCAL.match(text[max(done, last) : at][::-1])[0])
        if local and (host := _HOST.match(text, at + 1)):
            done = host.end()
            yield at - local, done
        last, at = at + 1, text.find("@", at + 1)


def ip_spans(text: str) -> Iterator[tuple[int, int]]:
    """The base addresses before their check: of numbers joined by dots every four, from the left."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            ends = [m.start() - 1, *(i for i in range(m.start(), m.end()) if text[i] == "."), m.end()]
            for i in range(0, len(ends) - 4, 4):
                yield ends[i] + 1, ends[i + 4]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in email_spans(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in ip_spans(text) if valid("ip", text[a:b])]
        for k in (2, 3):
            if k == 3 and "+" not in text:
                continue
            kind = KINDS[k]
            out += [(m.start(), k, m.end()) for m in BASE[kind].finditer(text) if valid(kind, m[0])]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every loose match."""
    out = []
    if "@" in text or "＠" in text or "at]" in text.lower() or "at)" in text.lower() or "at}" in text.lower():
        out += [(m.start(), 0, m.end()) for m in LOOSE["email"].finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), k, m.end()) for k in (1, 2, 3) for m in LOOSE[KINDS[k]].finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of the span and context around it."""
    s = text[start:end]
    d = _digits(s)
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    near = {w.strip(".,;:!?()").lower() for w in (before + " " + after).split()}
    groups = re.findall("[0-9]+", s)
    return [
        float(kind),
        float(len(s)),
        float(len(d)),
        len(d) / max(1, len(s)),
        float(len(groups)),
        float(max((len(g) for g in groups), default=0)),
        float(len({c for c in s if not c.isalnum()})),
        float(s.count(".")),
        float(s[:1] in "(+0"),
        float("(" in s and ")" in s),
        float(luhn(d)) if d else 0.0,
        float(all(int(g[-6:]) <= 255 for g in groups)) if groups else 0.0,
        float(before[-1:].isalnum() or before[-1:] in ("+", ".", "-", "/")),
        float(after[:1].isalnum() or after[:1] in ("%", "/", "-")),
        float(bool(near & CUES[KINDS[kind]])),
        float(any(c in s.lower() for c in ("@", "＠", "at]", "at)", "at}"))),
    ]


def _variants(text: str, start: int, kind: int, end: int) -> tuple[str, int, int, int] | None:
    """A base span in a looser format, in the same context: (text, start, kind, end)."""
    s = text[start:end]
    new = s.replace("@", " [at] ").replace(".", " [dot] ") if kind == 0 else s.replace(".", "[.]") if kind == 1 else re.sub(r"[\x20-]?([0-9]{4})(?=[0-9])", r"\1.", s) if kind == 2 else re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", s)
    if new == s or not LOOSE[KINDS[kind]].fullmatch(new):
        return None
    lo, hi = max(0, start - 60), end + 60
    return text[lo:start] + new + text[end:hi], start - lo, kind, start - lo + len(new)


def _marked(text: str, spans: list[tuple[int, int, int]]) -> bytearray:
    """A byte for each character, 1 where a span lies."""
    out = bytearray(len(text) if spans else 0)
    for s, _, e in spans:
        out[s:e] = b"\1" * (e - s)
    return out


def examples(text: str) -> list[list[float]]:
    """Features and label (last) of all examples that a text gives."""
    base = base_spans(text)
    taken = set(base)
    marked = [_marked(text, [b for b in base if b[1] == k]) for k in range(len(KINDS))]
    out = []
    for s, k, e in candidates(text):
        on = marked[k].find(1, s, e) >= 0
        other = any(m.find(1, s, e) >= 0 for j, m in enumerate(marked) if j != k)
        if (s, k, e) in taken or not on:
            out.append([*features(text, s, k, e), float(on and not other)])
    for s, k, e in base:
        out.append([*features(text, s, k, e), 1.0])
        if made := _variants(text, s, k, e):
            out.append([*features(*made), 1.0])
    return out


class SpanModel:
    """Boosted trees over candidates, the threshold of each kind, and how many examples made the trees and the thresholds."""

    def __init__(self, precision: float = 0.95):
        self.precision = precision
        self.trees: BoostedTrees | BoostedScorer = BoostedTrees()
        self.least = [2.0] * len(KINDS)
        self.taught = self.tested = 0

    def learn(self, rows: DataFrame) -> SpanModel:
        """From a table (f0, ..., y, test) of any size: trees from the rows that ``test`` does not mark, thresholds from those it does."""
        counts = {(int(r.f0), bool(r.test)): int(r.n) for r in rows.groupBy("f0", "test").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a kind
        self.taught, self.tested = (sum(n for (_, t), n in counts.items() if t == which) for which in (False, True))
        if all(counts.get((k, True), 0) < LEAST_TESTED for k in range(len(KINDS))):
            return self
        self.trees = fit_boosted(rows.where("test = 0"), {"spans": _NAMES}, rounds=40, depth=3, rate=0.2, bins=32, positive_weight=1.0, label="y", grain=24)

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield _stepped(f.f0.to_numpy(), self.predict(f[_NAMES].to_numpy()), f.y.to_numpy())

        met = rows.where("test = 1").mapInPandas(count, "kind int, step int, n long, hits long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        return self._thresholds(met.toPandas())  # at most STEPS + 1 rows a kind

    def fit(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> SpanModel:
        """As ``learn``, from a few rows on the driver."""
        self.taught, self.tested = int((~test).sum()), int(test.sum())
        self.trees.fit(x[~test], y[~test])
        return self._thresholds(_stepped(x[test][:, 0], self.predict(x[test]), y[test])) if test.any() else self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if isinstance(self.trees, BoostedTrees):
            return self.trees.predict(x)
        return 1 / (1 + np.exp(-self.trees.margins(self.trees.bins(x), ["spans"])[:, 0]))

    def _thresholds(self, met: pd.DataFrame) -> SpanModel:
        """From counts by kind and step of the score: of each kind the least step that is reached with the wanted precision.

        Within a step, as within a tie, hits come first: a candidate that scores as a rewritten span does counts as a miss only for want of a label.
        """
        for k in range(len(KINDS)):
            of = met[met.kind == k].sort_values("step", ascending=False)
            n, hits = of.n.cumsum(), of.hits.cumsum()
            reached = (of.hits > 0) & (hits >= self.precision * (n - of.n + of.hits)) | (hits >= self.precision * n)
            ok = of.step[reached & (of.step >= STEPS // 2)]
            self.least[k] = float(ok.iloc[-1]) / STEPS if of.n.sum() >= LEAST_TESTED and len(ok) else 2.0
        return self

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and added spans."""
        base = base_spans(text)
        found = candidates(text) if min(self.least) <= 1 else []
        marked = _marked(text, base) if found else b""
        found = [c for c in found if marked.find(1, c[0], c[2]) < 0]
        if not found:
            return base, []
        p = self.predict(np.array([features(text, *c) for c in found]))
        added: list[tuple[int, int, int]] = []
        marked = bytearray(len(text))
        for i in np.argsort(-p, kind="stable"):
            c = found[i]
            if p[i] >= self.least[c[1]] and marked.find(1, c[0], c[2]) < 0:
                added.append(c)
                marked[c[0] : c[2]] = b"\1" * (c[2] - c[0])
        return base, sorted(added)


def _stepped(kind: np.ndarray, score: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """(kind, step, n, hits): how many examples, and positive ones, have their score in a step."""
    f = pd.DataFrame({"kind": kind.astype(np.int32), "step": np.floor(score * STEPS).astype(np.int32), "n": np.ones(len(y), dtype=np.int64), "hits": y.astype(np.int64)})
    return f.groupby(["kind", "step"], as_index=False).sum()


def train_spans(docs: DataFrame, max_examples: int | None = None, precision: float = 0.95, text: str = "text") -> SpanModel:
    """From all documents with a digit or an at sign, each text once.

    A quarter of the texts, with all that they give, sets the thresholds.  Whole texts are not shuffled: their examples meet by
    128 bits of a hash of the text.  With ``max_examples`` (not used by any query) at most so many are taken, a kind with fewer than its share leaving the
    rest to the others, and fitted on the driver.
    """
    columns = [*_NAMES, "y", "test"]

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in given_back(frames):
            rows = []
            for t in f.text.unique():
                if found := examples(t):
                    a, b = _place_hash(t, -1), _place_hash(t, -2)
                    rows += [(a, b, i, *e, float(a % 4 == 3)) for i, e in enumerate(found)]
            yield pd.DataFrame(rows, columns=["a", "b", "i", *columns]).astype({"a": "int64", "b": "int64", "i": "int32"} | dict.fromkeys(columns, "float64"))

    some = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("text").rlike("[0-9@]"))
    given = some.mapInPandas(collect, "a long, b long, i int, " + ", ".join(f"{c} double" for c in columns))
    once = given.groupBy("a", "b", "i").agg(*(F.first(c).alias(c) for c in columns))
    with small_batches(docs.sparkSession, BATCH):
        rows = stored(once.select(*columns, F.xxhash64("a", "b", "i").alias("h")))
    if max_examples is None:
        model = SpanModel(precision).learn(rows)
    else:
        got = _bounded(rows, max_examples).select(*columns).orderBy(*columns).toPandas().to_numpy(dtype=float).reshape(-1, FEATURES + 2)
        model = SpanModel(precision).fit(got[:, :-2], got[:, -2], got[:, -1] == 1)
    free(rows)
    return model


def _place_hash(text: str, i: int) -> int:
    """Of the i-th example of a text: its place in a random order."""
    return int.from_bytes(hashlib.blake2b(f"{i}|{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, of each kind (``f0``) those of the lowest ``h``."""
    counts = {r.f0: r.n for r in rows.groupBy("f0").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
    if sum(counts.values()) <= most:
        return rows
    share, left, out = {}, most, None
    for i, k in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        share[k] = min(counts[k], left // (len(counts) - i))
        left -= share[k]
    for k, n in share.items():
        part = rows.where(F.col("f0") == k).orderBy(*(c for c in ["h", *rows.columns] if c != "f0")).limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> Column:
    """A struct column: counts of base spans by kind, base and all spans as ``kind:start:end`` lists, and their digest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in given_back(batches):
            rows = []
            for t in texts:
                base, added = m.spans(t or "")
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(len(KINDS))), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            yield pd.DataFrame(rows, columns=names)

    return find(F.col(text))


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> Column:
    """The text with every span replaced by its kind in brackets, overlapping spans by the first; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in given_back(batches):
            yield pd.Series([t if t is None else redacted(t, sum(m.spans(t), [])) for t in texts], dtype=object)

    return clean(F.col(text))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])

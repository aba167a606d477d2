"""Toxicity by noisy-channel deobfuscation.

Every token is a lattice: each character may stand for itself, for the letters that it imitates
(leetspeak, look-alikes of other alphabets), or, if it separates, repeats or can't be seen, for nothing. Single characters that
white space draws apart are one token. The Viterbi path under a character trigram model, counted over all documents,
is the restored token: the channel prices what is disguised, the token as a whole and each character, the model what is written, digits and foreign letters included, so
that numbers, digests and other alphabets are read as themselves. A token with one path needs no search.

The restored text is scored by a model of words and their beginnings. Their log-odds are lower confidence bounds over labelled texts;
a beginning counts only what its commonest continuation does not explain, and a few rounds of reestimation leave each toxic text to the words that
explain it. The strongest words of a text are calibrated into a probability on evidence from texts that the model has not seen (``PARTS`` parts,
each judged by the model of the others).

The fit takes at most ``positives`` and ``negatives`` labelled texts, and ``most_bytes`` bytes of each class; class shares come from all labels, and the
character counts from all documents.

A blank inside a word whose parts have several letters ("stu pid") is read as it stands, and so is a token without any Latin letter.

Cases: null and empty texts have no words and the score of such texts; with no labels of one class every score is the
smoothed share of the other; repeated rows get equal scores; of equally likely readings the one found first stays, characters as they stand before imitations; columns beside doc_id and text are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import Memory, small_batches, texts
from ripplet.llm.fitting import MOST_BYTES, Logistic, labelled_sample, remainder

#: Bounds of the labelled sample: the defaults of ``fit``.
POSITIVE, NEGATIVE = 1500, 3000
THRESHOLD = 0.7
FOLDS = 3
#: Letters that a sign imitates, with the cost of the disguise.
IMITATES = {
    "0": {"o": 1.0, "u": 2.5}, "1": {"i": 1.0, "l": 1.2}, "2": {"z": 1.5}, "3": {"e": 1.0}, "4": {"a": 1.0}, "5": {"s": 1.0}, "6": {"g": 1.5}, "7": {"t": 1.0},
    "8": {"b": 1.0}, "9": {"g": 1.2}, "@": {"a": 1.0}, "$": {"s": 1.0}, "!": {"i": 1.0, "l": 1.5}, "|": {"l": 1.0, "i": 1.0}, "+": {"t": 1.0},
    "(": {"c": 1.5}, "*": {v: 1.6 for v in "aeiou"}, "#": {"h": 2.0}, "€": {"e": 1.0}, "£": {"l": 1.5},
}
#: Letters of other alphabets by the Latin letter that they look like.
LOOKALIKES = {
    "a": "аα", "b": "вβ", "c": "сς", "d": "ԁ", "e": "еεє", "g": "ɡ", "h": "нһ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "пη", "o": "оοσօ", "p": "рρ",
    "q": "ԛ", "r": "гᴦ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
IMITATES |= {seen: {latin: 1.0} for latin, all_ in LOOKALIKES.items() for seen in all_}
#: What may stand between the letters of a word.
SEPARATES = " .-_*'~/,·•:"
#: Costs: of a token that is disguised at all; of a separator, a blank between letters drawn apart, the second letter of a run of three or more (a doubled letter is spelling),
#: each further letter of such a run, a repeated sign that stands for nothing.
DISGUISED, DROP, CLOSE, SINGLE, RUN, SIGN_AGAIN = 3.0, 0.7, 0.3, 2.5, 0.3, 0.4
#: Cost of a blank that is one, between letters drawn apart.
BLANK = 1.5
#: Cost of a digit or sign that is one, in a token that is disguised elsewhere.
KEPT = 2.0
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Positions between which the texts of all paths are set down: bounds what a step copies, and changes no reading.
_PART = 64
#: Tokens that a worker remembers, none longer than ``_KNOWN_CHARS``.
_KNOWN, _KNOWN_CHARS = 200_000, 64

# ---- character classes: 0 for what ends a word, 26 letters with accents folded, digits and signs, other letters
DIGIT, FOREIGN, A = 27, 28, 29


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point up to 65,536; those above are one, and end a word."""
    out = np.zeros(65_537, dtype=np.int32)
    for k in range(65_536):
        c = chr(k)
        if c.isalpha():
            plain = unicodedata.normalize("NFD", c)[0].lower()
            out[k] = ord(plain) - 96 if "a" <= plain <= "z" else FOREIGN
        elif c.isdigit() or c in "@$#€£+*|":
            out[k] = DIGIT
    out[ord("ß")], out[ord("ø")] = 19, 15
    return out


def _class(c: str) -> int:
    return int(_classes()[min(ord(c), 65_536)])


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _classes()[np.minimum(points, 65_536)]


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all triples of character classes over every whole text; each task sends its sums only."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, dtype=np.int64)

        def add(held: list[str]) -> None:
            joined = codes("  ".join(["", *held, ""]))
            for at in range(0, len(joined) - 2, 1 << 20):
                own = joined[at : at + (1 << 20) + 2]
                total[:] += np.bincount((own[:-2] * A + own[1:-1]) * A + own[2:], minlength=A**3)

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["triple", "n"])

    found = texts(docs).select("text").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    out = np.zeros(A**3, dtype=np.float64)
    for r in found.collect():  # 29^3 rows at most
        out[r.triple] = r.n
    return out


_SIGNS = re.escape("".join(IMITATES) + _UNSEEN)
#: A token in which this is found has several paths, if it has a letter.
_MANY = re.compile(rf"[{_SIGNS}\u0300-\u036f]|([^\W\d_])\1\1|([\W\d_])\2|[^\W\d_][{re.escape(SEPARATES)}][^\W\d_]", re.S)
_LATIN = re.compile(r"[a-z\u00df-\u024f]")
#: Three or more single characters with single blanks between.
_APART = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")


@lru_cache(maxsize=10_000)
def options(seen: str, nth: int, run: bool) -> list[tuple[str, float, int]]:
    """What a character may stand for, its cost and its class; the empty string drops it. ``nth``: how often it stands right before itself (0, 1, or 2 for more); ``run``: whether in a row of three or more."""
    if seen in _UNSEEN or unicodedata.combining(seen):
        return [("", 0.0, -1)]
    if seen.isspace():
        return [(" ", BLANK, 0), ("", CLOSE, -1)]
    out = [(seen, KEPT if _class(seen) == DIGIT else 0.0), *IMITATES.get(seen, {}).items()]
    if seen in SEPARATES:
        out.append(("", DROP))
    elif nth and (run or not seen.isalpha() or seen in IMITATES):
        out.append(("", SIGN_AGAIN if not seen.isalpha() and seen not in IMITATES else RUN if nth > 1 else SINGLE))
    return [(c, more, _class(c) if c else -1) for c, more in out]


class Restorer:
    """Viterbi decoding of tokens under the character model."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(A, A, A)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + A)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(p3)
        self._prepare()

    def _prepare(self) -> None:
        self.known = Memory(self.decode, _KNOWN, _KNOWN_CHARS)
        self._costs = self.cost.tolist()

    def __getstate__(self) -> dict:
        return {"cost": self.cost}

    def __setstate__(self, state: dict) -> None:
        self.cost = state["cost"]
        self._prepare()

    def decode(self, token: str) -> str:
        """The likeliest reading. Paths hold the text of the last ``_PART`` characters at most, and from which path of the part before they come, so a token of any length takes linear time."""
        if not token.isascii():
            token = unicodedata.normalize("NFKC", token).lower()
        if not (_MANY.search(token) or _APART.search(token)) or not _LATIN.search(token):
            return token  # one path
        costs = self._costs
        bound = self._plain_cost(token) - DISGUISED  # what a reading must cost less than; costs only grow along a path
        paths: dict[tuple[int, int], tuple[float, str, tuple[int, int]]] = {(0, 0): (0.0, "", (0, 0))}
        parts: list[dict[tuple[int, int], tuple[str, tuple[int, int]]]] = []  # text of each path in a part, and its path before
        at = 0
        for m in re.finditer(r"(.)\1*", token, re.S):
            size = m.end() - m.start()
            for nth in range(size):
                if at and at % _PART == 0:
                    parts.append({key: (text, come) for key, (_, text, come) in paths.items()})
                    paths = {key: (cost, "", key) for key, (cost, _, _) in paths.items()}
                at += 1
                grown: dict[tuple[int, int], tuple[float, str, tuple[int, int]]] = {}
                choices = options(m[1], min(nth, 2), size > 2)
                for (a, b), (cost, text, come) in paths.items():
                    own = costs[a][b]
                    for c, more, k in choices:
                        if k < 0:
                            key, found = (a, b), (cost + more, text, come)
                        else:
                            key, found = (b, k), (cost + more + own[k], text + c, come)
                        if found[0] < bound and (key not in grown or found[0] < grown[key][0]):
                            grown[key] = found
                if not grown:
                    return token
                paths = grown
        least, best, come = min(((cost + costs[a][b][0], text, come) for (a, b), (cost, text, come) in paths.items()), key=lambda x: x[0])
        if least >= bound:
            return token
        read = [best]
        for part in reversed(parts):
            text, come = part[come]
            read.append(text)
        return "".join(reversed(read))

    def _plain_cost(self, token: str) -> float:
        """Of a token that is read as it stands; letters drawn apart, and what can't be seen, are no reading."""
        a = b = 0
        total = 0.0
        for c in token:
            if c in _UNSEEN or c.isspace():
                return math.inf
            k = options(c, 0, False)[0][2]
            if k >= 0:
                total += self._costs[a][b][k]
                a, b = b, k
        return total + self._costs[a][b][0]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text, in lowercase: those of white space, and the ones drawn apart as one each."""
        out, at, text = [], 0, text.lower()
        for m in _APART.finditer(text):
            out += text[at : m.start()].split()
            out.append(m[0])
            at = m.end()
        return out + text[at:].split()

    def restore(self, text: str) -> str:
        """The restored text: lowercase, its tokens read, one blank between."""
        return " ".join(map(self.known.__getitem__, self.tokens(text)))


# ---- model of the restored text
_WORD = re.compile(r"[^\W\d_]+")
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
#: A feature needs so many toxic texts.
LEAST = 3
#: Standard errors that are taken off log-odds.
ERRORS = 1.5
ROUNDS, SLACK = 2, 1.0
PARTS, STRONGEST = 4, 4
RIDGE = 1e-4


def words(restored: str) -> list[str]:
    return _WORD.findall(restored.translate(_ACCENTS))


def features(word: str) -> list[str]:
    """The word, as ``word$``, and its beginnings of 4 to 8 letters."""
    return [f"{word}$", *(word[:n] for n in range(4, 9) if len(word) > n)] if len(word) >= 4 else []


Text = list[tuple[str, ...]]  # of each distinct word, the features that enough toxic texts have


def told(texts_: dict[int, list[list[str]]]) -> dict[int, list[Text]]:
    """Texts of words as texts of features; words without one that enough toxic texts have are left out."""
    seen = Counter(f for t in texts_[1] for f in {f for w in t for f in features(w)})
    known: dict[str, tuple[str, ...]] = {}
    for t in chain(texts_[0], texts_[1]):
        for w in t:
            if w not in known:
                known[w] = tuple(f for f in features(w) if seen[f] >= LEAST)
    return {y: [[x for w in t if (x := known[w])] for t in texts_[y]] for y in texts_}


class Odds:
    """Log-odds of features: how much surer a text is toxic if a word has one."""

    def __init__(self, toxic: list[Text], clean: list[Text]) -> None:
        seen = Counter(f for t in toxic for f in {f for word in t for f in word})
        others = Counter(f for t in clean for f in {f for word in t for f in word})
        counts = {f: float(n) for f, n in seen.items() if n >= LEAST}
        for _ in range(ROUNDS):
            self.values = self._bounds(counts, others, len(toxic), len(clean))
            counts = self._explained(toxic)
        self.values = self._bounds(counts, others, len(toxic), len(clean))
        self.heads = {f[:4] for f in self.values}

    @staticmethod
    def _bounds(counts: dict[str, float], others: Counter, toxic: int, clean: int) -> dict[str, float]:
        follows: dict[str, float] = {}  # of a beginning, the count of its commonest continuation
        for f, n in counts.items():
            for shorter in (f[:-1], f[:-2]) if f.endswith("$") else (f[:-1],):
                follows[shorter] = max(follows.get(shorter, 0.0), n)
        out = {}
        for f, n in counts.items():
            own = n - follows.get(f, 0.0) if 2 * follows.get(f, 0.0) > n else n
            if own >= LEAST:
                a, b = own + 0.5, others[f] + 0.5
                bound = math.log(a / (toxic + 1)) - math.log(b / (clean + 1)) - ERRORS * math.sqrt(1 / a + 1 / b)
                if bound > 0:
                    out[f] = bound
        return out

    def _explained(self, toxic: list[Text]) -> dict[str, float]:
        """In how many texts a feature is of a word that explains the text, counted by how near the word comes to the strongest one."""
        out: dict[str, float] = {}
        for t in toxic:
            strength = [max((self.values[f] for f in word if f in self.values), default=0.0) for word in t]
            most, own = max(strength, default=0.0), {}
            for word, x in zip(t, strength, strict=True):
                if x > 0:
                    part = math.exp(min(0.0, x - most + SLACK))
                    own.update((f, max(part, own.get(f, 0.0))) for f in word)
            for f, part in own.items():
                out[f] = out.get(f, 0.0) + part
        return out

    def strongest(self, word: Iterable[str]) -> tuple[float, str] | None:
        """Of the features of a word."""
        return max(((self.values[f], f) for f in word if f in self.values), default=None)

    def hit(self, word: str) -> tuple[float, str] | None:
        """The strongest feature of a word; every feature begins with its first four letters."""
        return self.strongest(features(word)) if word[:4] in self.heads else None


def evidence(hits: Iterable[tuple[float, str]], size: int) -> list[float]:
    """Of a text, by the features that its words hit, each once, and the number of its distinct tokens."""
    top = sorted((x for x, _ in set(hits)), reverse=True)
    return [*(top + [0.0] * STRONGEST)[:STRONGEST], sum(top[: 3 * STRONGEST]), math.log1p(sum(x > ERRORS for x in top)), sum(top) / (1 + math.log1p(size)), math.log1p(size)]


class Classifier:
    def __init__(self, samples: dict[int, list[str]], counts: dict[int, int], characters: np.ndarray) -> None:
        self.share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        self.restorer = Restorer(characters)
        self.calibrate = None
        texts_ = {y: [sorted(set(self.restorer.tokens(t))) for t in dict.fromkeys(samples[y])] for y in (0, 1)}
        if min(map(len, texts_.values())) < 2:
            return
        sizes = {y: [len(t) for t in texts_[y]] for y in (0, 1)}
        reads = Memory(lambda x: words(self.restorer.decode(x)), _KNOWN, _KNOWN_CHARS)
        found = told({y: [sorted({w for x in t for w in reads[x]}) for t in texts_[y]] for y in (0, 1)})
        read = {y: list(zip(sizes[y], found[y], strict=True)) for y in (0, 1)}
        parts = min(PARTS, *map(len, read.values()))
        x, y = [], []
        for k in range(parts):
            odds = Odds(*([t for i, (_, t) in enumerate(read[c]) if i % parts != k] for c in (1, 0)))
            for c in (0, 1):
                unseen = [r for i, r in enumerate(read[c]) if i % parts == k]
                x += [evidence(filter(None, map(odds.strongest, t)), size) for size, t in unseen]
                y += [c] * len(unseen)
        y = np.array(y)
        weights = np.where(y == 1, self.share / (y == 1).mean(), (1 - self.share) / (y == 0).mean())
        self.calibrate = Logistic(np.array(x), y, weights, RIDGE)
        self.odds = Odds(*([t for _, t in read[c]] for c in (1, 0)))
        self._prepare()

    def _prepare(self) -> None:
        self.hits = Memory(self._hits, _KNOWN, _KNOWN_CHARS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "hits"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._prepare()

    def _hits(self, token: str) -> tuple[tuple[float, str], ...]:
        """The strongest feature of each word of a token's reading."""
        return tuple(filter(None, map(self.odds.hit, words(self.restorer.decode(token)))))

    def scores(self, data: list[str]) -> np.ndarray:
        if self.calibrate is None or not data:
            return np.full(len(data), self.share)
        rows = []
        for text in data:
            own = set(self.restorer.tokens(text))
            rows.append(evidence([h for x in own for h in self.hits[x]], len(own)))
        return self.calibrate(np.array(rows))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE, negatives: int = NEGATIVE, most_bytes: int = MOST_BYTES) -> Classifier:
    samples, counts = labelled_sample(docs, labels, "toxic", remainder(FOLDS) != 1, {0: negatives, 1: positives}, most_bytes)
    return Classifier(samples, counts, character_counts(docs))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null doc_id is never learnt from: held out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = texts(docs).withColumn("held_out", F.coalesce(remainder(FOLDS) == 1, F.lit(True)))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

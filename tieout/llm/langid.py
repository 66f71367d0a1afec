"""Language of a text from a linear-chain conditional random field over its words.

Features of a word are the word, its prefixes and suffixes, its byte trigrams and the learned
lexicons it is in; with learned transitions between neighbouring words they give, by
forward-backward, each word's probability of each language. So words of code-switched text are
labelled one by one, and the text's language is the one with the most probability mass.

The weights are fitted with numpy on a bounded sample: SAMPLE rows of each language, taken by the
lowest hash of the id, a stretch of SAMPLE_CHARS characters from a hashed place of each. Training
sequences switch language at random, which is what teaches the transitions. Predictions read whole
texts, in stretches of STRETCH words that see CONTEXT words on both sides; a neighbour's influence
falls by a constant factor with each word and is below rounding there.

Defined results: `und` with score 0 for null or empty texts, texts without letters, and when there
was no language to learn; of equally likely languages the first by name; rows without an id or
language do not train; repeated rows give repeated rows; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_texts, read, sampled

TOKEN = re.compile(r"[^\W\d_]+")
SAMPLE, SAMPLE_CHARS, LEXICON = 400, 3000, 500
ROWS = 1 << 16
STEPS, BATCH, LENGTH, RATE = 700, 48, 32, 0.2
STRETCH, CONTEXT, AT_ONCE, REMEMBERED = 2000, 100, 400_000, 200_000


def words_of(text: str) -> list[str]:
    """Lower-case runs that hold a letter."""
    return [w for w in TOKEN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str) -> list[int]:
    from zlib import crc32

    raw = word.encode()
    marked = b"^" + raw + b"$"
    parts = [b"w" + raw, b"p" + raw[:1], b"p" + raw[:2], b"p" + raw[:3], b"s" + raw[-1:], b"s" + raw[-2:],
             b"s" + raw[-3:], b"s" + raw[-4:], *[marked[i:i + 3] for i in range(len(marked) - 2)]]
    return [crc32(p) % ROWS for p in parts]


class Field:
    """Weights of hashed features (ROWS, then one row for each lexicon), transitions and starts."""

    def __init__(self, names: list[str], lexicons: list[set[str]]):
        kinds = len(names)
        self.names, self.lexicons = names, lexicons
        self.weights = np.zeros((ROWS + kinds, kinds))
        self.moves, self.starts = np.zeros((kinds, kinds)), np.zeros(kinds)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All feature rows of the words one after the other, and how many each has."""
        each = [features(w) + [ROWS + k for k, known in enumerate(self.lexicons) if w in known] for w in words]
        sizes = np.fromiter(map(len, each), "i8", len(each))
        return np.fromiter((x for one in each for x in one), "i8", sizes.sum()), sizes

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, sizes = self.rows(words)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)

    def marginals(self, potentials: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over many sequences at once.

        `potentials` holds all words' exponentiated emissions; sequences begin at `starts` and are
        ordered by falling size, so that step t works on the first sequences only.
        """
        moves, kinds = np.exp(self.moves), len(self.names)
        forward, backward = np.empty_like(potentials), np.empty_like(potentials)
        alive = [int(n) for n in np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")]
        state = None
        for t, n in enumerate(alive):
            at = starts[:n] + t
            state = (np.exp(self.starts) if state is None else state[:n] @ moves) * potentials[at]
            state /= state.sum(1, keepdims=True)
            forward[at] = state
        ends, back = starts + sizes - 1, None
        for t, n in enumerate(alive):
            at = ends[:n] - t
            # the first sequences are the long ones: all that live at step t also lived at t - 1
            back = np.full((n, kinds), 1 / kinds) if back is None else (back[:n] * potentials[at + 1]) @ moves.T
            back /= back.sum(1, keepdims=True)
            backward[at] = back
        both = forward * backward
        return both / both.sum(1, keepdims=True)


def train(samples: dict[str, list[str]], seed: int = 11) -> Field | None:
    """Fit on texts by language; None without any usable text."""
    said = {name: [w for w in (words_of(t) for t in texts) if w] for name, texts in sorted(samples.items())}
    said = {name: texts for name, texts in said.items() if texts}
    if not said:
        return None
    rng, names = np.random.default_rng(seed), list(said)
    counts = [Counter(w for words in said[name] for w in words) for name in names]
    field = Field(names, [{w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]} for c in counts])
    index = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    flat, sizes = field.rows(list(index))
    begins = np.cumsum(sizes) - sizes
    pools = [[np.array([index[w] for w in words]) for words in said[name]] for name in names]
    moments = [np.full_like(x, 1e-3) for x in (field.weights, field.moves, field.starts)]
    kinds = len(names)
    if kinds == 1:
        return field
    for _ in range(STEPS):
        words, truth = np.zeros((BATCH, LENGTH), "i8"), np.zeros((BATCH, LENGTH), "i8")
        for row in range(BATCH):
            at = 0
            while at < LENGTH:
                kind = rng.integers(kinds)
                text = pools[kind][rng.integers(len(pools[kind]))]
                run = min(int(rng.geometric(1 / 12)), LENGTH - at)
                first = rng.integers(max(len(text) - run, 0) + 1)
                some = text[first:first + run]
                words[row, at:at + len(some)], truth[row, at:at + len(some)] = some, kind
                at += len(some)
        distinct, inverse = np.unique(words, return_inverse=True)
        inverse = inverse.reshape(BATCH, LENGTH)
        n = sizes[distinct]
        spots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[distinct], n)
        rows = flat[spots]
        emitted = np.add.reduceat(field.weights[rows], np.cumsum(n) - n, axis=0)
        potentials = np.exp(np.clip(emitted, -30, 30))[inverse]
        p = field.marginals(potentials.reshape(-1, kinds), np.arange(BATCH) * LENGTH, np.full(BATCH, LENGTH))
        p = p.reshape(BATCH, LENGTH, kinds)
        goal = np.eye(kinds)[truth]
        slope = np.zeros((len(distinct), kinds))
        np.add.at(slope, inverse.ravel(), (p - goal).reshape(-1, kinds))
        g = [np.zeros_like(field.weights), _pairs(field, potentials, p) - _counted(truth, kinds), (p - goal)[:, 0].sum(0)]
        np.add.at(g[0], rows, np.repeat(slope, n, axis=0))
        for x, m, step in zip((field.weights, field.moves, field.starts), moments, g, strict=True):
            step = step / BATCH
            m += step * step
            x -= RATE * step / np.sqrt(m)
    return field


def _pairs(field: Field, potentials: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected transitions, from the marginals of neighbours given the potentials."""
    moves, batch, length = np.exp(field.moves), len(potentials), potentials.shape[1]
    ahead = np.empty_like(potentials)
    state = np.exp(field.starts) * potentials[:, 0]
    for t in range(length):
        state = state if t == 0 else (state @ moves) * potentials[:, t]
        state /= state.sum(1, keepdims=True)
        ahead[:, t] = state
    total, back = np.zeros_like(moves), np.ones((batch, potentials.shape[2]))
    for t in range(length - 1, 0, -1):
        after = potentials[:, t] * back
        joint = ahead[:, t - 1][:, :, None] * moves * after[:, None, :]
        total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = after @ moves.T
        back /= back.sum(1, keepdims=True)
    return total


def _counted(truth: np.ndarray, kinds: int) -> np.ndarray:
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    return seen


class Labeller:
    """Word probabilities and text languages for one task; remembers the words it has seen."""

    def __init__(self, field: Field):
        self.field, self.index, self.used = field, {}, 0
        self.bank = np.zeros((1024, len(field.names)))

    def _ids(self, words: list[str]) -> np.ndarray:
        try:
            return np.array([self.index[w] for w in words], "i4")
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in self.index]
            while self.used + len(new) > len(self.bank):
                self.bank = np.concatenate([self.bank, np.zeros_like(self.bank)])
            emitted = self.field.emissions(new)
            self.bank[self.used:self.used + len(new)] = np.exp(np.clip(emitted - emitted.max(1, keepdims=True), -30, 0))
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            return np.array([self.index[w] for w in words], "i4")

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and that language's probability."""
        words = words_of(text)
        if not words:
            return []
        ids = self._ids(words)  # may grow the bank
        p = self.field.marginals(self.bank[ids], np.array([0]), np.array([len(words)]))
        return [(w, self.field.names[k], float(x)) for w, k, x in zip(words, p.argmax(1), p.max(1), strict=True)]

    def languages(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.index, self.used = {}, 0
        kinds = len(self.field.names)
        mass, stretches = np.zeros((len(texts), kinds)), []
        for row, text in enumerate(texts):
            ids = self._ids(words_of(text))
            for at in range(0, len(ids), STRETCH):
                first, last = max(at - CONTEXT, 0), min(at + STRETCH + CONTEXT, len(ids))
                stretches.append((row, ids[first:last], at - first, min(at + STRETCH, len(ids)) - first))
        stretches.sort(key=lambda s: -len(s[1]))
        at = 0
        while at < len(stretches):
            end, size = at, 0
            while end < len(stretches) and (end == at or size + len(stretches[end][1]) <= AT_ONCE):
                size += len(stretches[end][1])
                end += 1
            some = stretches[at:end]
            sizes = np.array([len(s[1]) for s in some])
            starts = np.cumsum(sizes) - sizes
            p = self.field.marginals(self.bank[np.concatenate([s[1] for s in some])], starts, sizes)
            edges = [x for s, (_, _, a, b) in zip(starts, some, strict=True) for x in (s + a, s + b)]
            sums = np.add.reduceat(np.concatenate([p, np.zeros((1, kinds))]), edges, axis=0)[::2]
            np.add.at(mass, [s[0] for s in some], sums)
            at = end
        total = mass.sum(1)
        best = mass.argmax(1)
        share = np.where(total > 0, mass.max(1) / np.maximum(total, 1e-300), 0.0)
        return [self.field.names[k] if t > 0 else "und" for k, t in zip(best, total, strict=True)], np.minimum(share, 1.0)


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> Field | None:
    """Train on a bounded sample of the rows outside the held-out fold.

    The sample is chosen without its texts; a stretch of each is then read by its ids, at most
    SAMPLE for each language.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & (fold("doc_id", folds) != held))
    chosen = sampled(usable.select("lang", "doc_id").distinct(), "lang", "doc_id", SAMPLE)
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = (usable.select("lang", "doc_id", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("part"))
            .join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("part").alias("part"))
            .select("lang", "part").collect())
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row.lang, []).append(row.part)
    return train({k: sorted(v) for k, v in samples.items()})


def predict(docs: DataFrame, keys: list[str], text: str, field: Field | None) -> DataFrame:
    """(keys, lang_pred, score) of every whole text."""
    def start() -> Callable:
        labeller = Labeller(field) if field else None

        def work(texts: list[str]) -> list:
            if labeller is None:
                return [["und"] * len(texts), np.zeros(len(texts))]
            return list(labeller.languages(texts))
        return work
    return map_texts(docs, keys, text, "lang_pred string, score double", start)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, ["doc_id"], "text", fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

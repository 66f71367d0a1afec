"""Toxicity by a convolutional classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows over the root of their number: the word itself and its character
4-grams, so inflected forms share rows. Filters of widths 1 to 3 slide over the words, each filter keeps its
largest response in the text (max pooling), and one linear layer gives the logit. Training begins with
STEPS batches of plain numpy on a bounded sample; then replicas in Spark tasks learn from every labelled row
and their arrays are averaged. Scoring runs over whole texts in Arrow batches.
In each training step a share DROPPED of the words is blanked, so that no filter leans on one word of a text.
One word maps to one row of filter responses, so a task works out each distinct word once.

Thresholds are calibrated by language: words carry learned language weights, the language of a
text is guessed from its own words, and the logit is shifted so that score 0.3 is that language's
best threshold on held-back sample rows: the best F1 where ENOUGH of them are toxic; else the best F1 over all
languages, or what only CLEAN of the language's clean rows exceed, if that is less.

Bounds (parameters), of the first STEPS batches only: SAMPLE rows of each label, taken by the lowest hash of the id, with texts of
at most SAMPLE_CHARS characters. Weights, language counts and thresholds come from all labelled rows and their whole
texts, which train in pieces of PIECE words; whole texts are scored.

Defined results: null and empty texts, and texts without words, get the score of no evidence;
without labelled rows of both kinds every text scores 0; rows without a label or id do not train, rows without a
language train but calibrate no language; an id with both labels trains as both, a repeated id once
by its first text; repeated rows give repeated rows; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_texts, read, sampled, store

WORD = re.compile(r"[^\W\d_]+")
SAMPLE, SAMPLE_CHARS = 2500, 8000
ROWS, WIDTH, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
STEPS, BATCH, RATE, DROPPED = 900, 32, 0.1, 0.3
THRESHOLD, ENOUGH, CLEAN = 0.3, 20, 0.02
# How often the replicas, one for each task that reads the labelled rows, are averaged while these go by once.
PASSES = 2
# Labels up to so many travel to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 2_000_000
# Values of one averaged block, words of one training piece, and steps a logit is counted in.
BLOCK, PIECE, RESOLUTION = 1 << 14, 20_000, 1000
# As WORD, for Spark.
WORDS_IN = r"\p{L}"
# Words whose responses a task remembers, and words worked on at once.
REMEMBERED, AT_ONCE = 200_000, 200_000


def word_rows(word: str) -> list[int]:
    """Hashed rows of a word: itself and its 4-grams with word ends."""
    from zlib import crc32

    marked = f"<{word}>"
    grams = [marked[i:i + 4] for i in range(len(marked) - 3)] if len(word) > 2 else []
    return [crc32(part.encode()) % ROWS for part in [f"={word}", *grams]]


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words, a bounded number of characters at a time."""
    start, size = 0, 8 * AT_ONCE
    while start < len(text):
        end = start + size
        while end < len(text) and (text[end].isalpha()):
            end += 1
        yield WORD.findall(text[start:end].lower())
        start = end


class Model:
    """Learned arrays and the forward pass."""

    def __init__(self, table, filters, bias, weights, intercept, languages, shifts):
        self.table, self.filters, self.bias = table, filters, bias
        self.weights, self.intercept = weights, intercept
        self.languages, self.shifts = languages, shifts  # log weights of hashed words, one shift for each language

    def responses(self, words: list[str]) -> np.ndarray:
        """For each word every filter's response at each of its places, then the language weights."""
        rows = [word_rows(w) for w in words]
        sizes = np.fromiter(map(len, rows), "i8", len(rows))
        flat = np.fromiter((x for one in rows for x in one), "i8", sizes.sum())
        starts = np.cumsum(sizes) - sizes
        embedded = np.add.reduceat(self.table[flat], starts, axis=0) / np.sqrt(sizes[:, None]).astype("f4")
        return np.concatenate([*(embedded @ f[o] for f in self.filters for o in range(len(f))),
                               self.languages[flat[starts]]], 1)

    def score_all(self, texts: list[str], memory: dict) -> np.ndarray:
        """Probabilities of all texts; `memory` holds word responses between calls."""
        own = sum(len(f) for f in self.filters) * FILTERS
        kinds, tail = self.languages.shape[1], max(WIDTHS) - 1
        pooled = np.full((len(texts), len(self.filters) * FILTERS), -np.inf, "f4")
        tongues = np.zeros((len(texts), kinds))
        spans, ids, size = [], [], 0

        def flush() -> None:
            nonlocal spans, ids, size
            if not spans:
                return
            flat = np.concatenate(ids)
            bank = memory["bank"]
            ends = [x for _, s, n in spans for x in (s, s + n - tail)]  # windows start at real words only
            for at in range(len(self.filters)):
                first = sum(len(f) for f in self.filters[:at]) * FILTERS
                total = None
                for offset in range(len(self.filters[at])):
                    part = bank[:, first + offset * FILTERS:first + (offset + 1) * FILTERS][flat]
                    if offset:
                        total[:-offset] += part[offset:]
                    else:
                        total = part
                best = np.maximum.reduceat(total, ends, axis=0)[::2]
                rows = [row for row, _, _ in spans]
                np.maximum.at(pooled, (rows, slice(at * FILTERS, (at + 1) * FILTERS)), best)
            sums = np.add.reduceat(bank[:, own:][flat], ends, axis=0)[::2]
            np.add.at(tongues, [row for row, _, _ in spans], sums)
            spans, ids, size = [], [], 0

        index = memory.setdefault("index", {})
        if "bank" not in memory:
            memory["bank"] = np.zeros((1024, own + kinds), "f4")  # row 0 is the padding
        for row, text in enumerate(texts):
            before = np.zeros(0, "i8")
            for words in words_of(text):
                if not words:
                    continue
                if len(index) > REMEMBERED:
                    flush()
                    index.clear()
                    # the words just before stay, as the next window reaches back to them
                    memory["bank"] = np.concatenate(
                        [memory["bank"][:1], memory["bank"][before], np.zeros((1024, own + kinds), "f4")])
                    before = np.arange(1, len(before) + 1)
                    memory["used"] = len(before)
                try:
                    found = [index[w] for w in words]
                except KeyError:
                    new = [w for w in dict.fromkeys(words) if w not in index]
                    used = memory.get("used", 0)
                    while used + len(new) >= len(memory["bank"]):
                        memory["bank"] = np.concatenate([memory["bank"], np.zeros_like(memory["bank"])])
                    memory["bank"][used + 1:used + 1 + len(new)] = self.responses(new)
                    index.update(zip(new, range(used + 1, used + 1 + len(new)), strict=True))
                    memory["used"] = used + len(new)
                    found = [index[w] for w in words]
                found = np.concatenate([before, np.array(found), np.zeros(tail, "i8")])
                spans.append((row, size, len(found)))
                ids.append(found)
                size += len(found)
                before = found[-2 * tail:-tail]
                if size >= AT_ONCE:
                    flush()
        flush()
        evidence = np.maximum(np.where(np.isfinite(pooled), pooled, -np.inf) + self.bias, 0)
        logits = evidence @ self.weights + self.intercept + self.shifts[tongues.argmax(1)]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


class Words:
    """Numbers for the distinct words of some texts, and the hashed rows of each; word 0 is the padding, without rows."""

    def __init__(self, texts: list[list[str]]):
        places: dict[str, int] = {}
        self.docs = [np.array([*(places.setdefault(w, len(places) + 1) for w in words), *[0] * (max(WIDTHS) - 1)]) for words in texts]
        self.parts = [word_rows(w) for w in places]
        self.flat = np.array([r for rows in self.parts for r in rows], "i8")
        self.lengths = np.array([1, *map(len, self.parts)])
        self.begins = np.concatenate([[0, 0], np.cumsum(self.lengths[1:])])

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of the given real words one after the other, how many each has, and where they end."""
        sizes = self.lengths[words]
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.begins[words], sizes)
        return self.flat[spots], sizes, ends


class Learner:
    """The arrays that training moves, with their sums of squared gradients."""

    def __init__(self, rng: np.random.Generator):
        self.table = rng.normal(0, 0.05, (ROWS, WIDTH)).astype("f4")  # small: words never seen say little
        self.filters = [rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype("f4") for w in WIDTHS]
        self.bias, self.weights = np.zeros(len(WIDTHS) * FILTERS, "f4"), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype("f4")
        self.intercept, self.table_moment = np.zeros(1, "f4"), np.zeros(ROWS, "f4")
        self.moments = [np.full_like(x, 1e-6) for x in [*self.filters, self.bias, self.weights, self.intercept]]

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.table_moment, *self.filters, self.bias, self.weights, self.intercept, *self.moments]

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for x in self.arrays():
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size

    def _embed(self, words: Words, some: np.ndarray) -> np.ndarray:
        """As `Model.responses` embeds words; the padding is zero."""
        out = np.zeros((len(some), WIDTH), "f4")
        real = np.flatnonzero(some)
        if len(real):
            rows, sizes, ends = words.rows(some[real])
            out[real] = np.add.reduceat(self.table[rows], ends - sizes, axis=0) / np.sqrt(sizes[:, None])
        return out

    def step(self, words: Words, chosen: np.ndarray, truth: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> None:
        """One batch: the texts `chosen`, with the label and the weight of each text."""
        docs, filters, tail = words.docs, self.filters, max(WIDTHS) - 1
        joined = np.concatenate([docs[i] for i in chosen])
        joined = np.where(rng.random(len(joined)) < DROPPED, 0, joined)
        distinct, inverse = np.unique(joined, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in chosen])])
        embedded = self._embed(words, distinct)
        pooled, tops = [], []
        for f in filters:
            total = (embedded @ f[0])[inverse]
            for offset in range(1, len(f)):
                total[:-offset] += (embedded @ f[offset])[inverse][offset:]
            top = np.stack([total[i:j - tail].argmax(0) + i for i, j in zip(starts, starts[1:], strict=False)])
            tops.append(top)
            pooled.append(np.take_along_axis(total, top, 0))
        raw = np.concatenate(pooled, 1) + self.bias
        held = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(held @ self.weights + self.intercept, -30, 30)))
        error = (p - truth[chosen]) * balance[chosen] / len(chosen)
        upper = np.where(raw > 0, error[:, None] * self.weights, 0).astype("f4")
        steps = [np.zeros_like(f) for f in filters] + [upper.sum(0), held.T @ error, np.array([error.sum()])]
        hit, slope = [], []
        for k, f in enumerate(filters):
            g = upper[:, k * FILTERS:(k + 1) * FILTERS]
            for offset in range(len(f)):
                spot = np.minimum(tops[k] + offset, len(joined) - 1)
                seen = embedded[inverse[spot]]
                steps[k][offset] = np.einsum("bf,bfd->df", g, seen)
                hit.append(inverse[spot].ravel())
                slope.append((g[:, :, None] * f[offset].T[None]).reshape(-1, WIDTH))
        for x, m, g in zip([*filters, self.bias, self.weights, self.intercept], self.moments, steps, strict=True):
            m += g * g
            x -= RATE * g / np.sqrt(m)
        hit, slope = np.concatenate(hit), np.concatenate(slope)
        word, place = np.unique(hit, return_inverse=True)
        sums = np.zeros((len(word), WIDTH))
        np.add.at(sums, place, slope)
        real = (distinct[word] > 0) & sums.any(1)
        word, sums = distinct[word[real]], sums[real] / np.sqrt(words.lengths[distinct[word[real]], None])
        if len(word):
            rows, sizes, _ = words.rows(word)
            each = np.repeat(sums, sizes, axis=0)
            np.add.at(self.table_moment, rows, (each * each).mean(1))
            np.add.at(self.table, rows, -2 * RATE * each / np.sqrt(self.table_moment[rows] + 1e-8)[:, None])

    def model(self, names: list[str], counts: np.ndarray) -> Model:
        """Uncalibrated; `counts` are occurrences of hashed words by language."""
        languages = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * ROWS))
        languages -= languages.mean(1, keepdims=True)
        return Model(self.table, self.filters, self.bias, self.weights, float(self.intercept[0]), languages.astype("f4"),
                     np.zeros(max(len(names), 1)))


def _warm(learner: Learner, words: Words, truth: np.ndarray, fitted: np.ndarray, rng: np.random.Generator) -> None:
    """STEPS batches over the rows `fitted`."""
    share = np.array([len(fitted) / (2 * max((truth[fitted] == v).sum(), 1)) for v in (0, 1)])
    balance, done = share[truth], 0
    while done < STEPS and len(fitted):
        rng.shuffle(fitted)
        for at in range(0, len(fitted), BATCH):
            done += 1
            learner.step(words, fitted[at:at + BATCH], truth, balance, rng)


def _calibrate(model: Model, names: list[str], spoken: np.ndarray, logits: np.ndarray, goal: np.ndarray, n: np.ndarray) -> None:
    """Shift each language's logits so that its best cut is the threshold; `n` counts equal rows."""
    common = _best_cut(logits, goal, n)
    target = np.log(THRESHOLD / (1 - THRESHOLD))
    for k, name in enumerate(names):
        mine = spoken == name
        clean, often = logits[mine & (goal == 0)], n[mine & (goal == 0)]
        if n[mine & (goal == 1)].sum() >= ENOUGH:
            cut = _best_cut(logits[mine], goal[mine], n[mine])
        else:
            cut = min(common, _quantile(clean, often, 1 - CLEAN)) if often.sum() >= 2 * ENOUGH else common
        model.shifts[k] = target - cut
    if not names:
        model.shifts[0] = target - common


def train(texts: list[str], labels: list[int], tongues: list[str | None], seed: int = 7) -> Model | None:
    """Fit on the given rows: a fifth is held back to calibrate. None if a label is missing."""
    rng, truth = np.random.default_rng(seed), np.array(labels, int)
    kept = [i for i, t in enumerate(texts) if WORD.search(t)]
    texts, truth, tongues = [texts[i] for i in kept], truth[kept], [tongues[i] for i in kept]
    if len(set(truth.tolist())) < 2:
        return None
    words = Words([[w for part in words_of(t) for w in part] for t in texts])
    learner = Learner(rng)
    order = rng.permutation(len(texts))
    back = set(order[: len(order) // 5].tolist()) if len(order) >= 50 else set()
    _warm(learner, words, truth, np.array([i for i in order if i not in back]), rng)
    names = sorted({t for t in tongues if t})
    counts = np.zeros((ROWS, max(len(names), 1)))
    for i in order:
        if tongues[i] and i not in back:
            np.add.at(counts[:, names.index(tongues[i])], [words.parts[w - 1][0] for w in words.docs[i] if w], 1)
    model = learner.model(names, counts)
    chosen = sorted(back) or list(range(len(texts)))
    logits = _logits(model.score_all([texts[i] for i in chosen], {}))
    _calibrate(model, names, np.array([tongues[i] or "" for i in chosen]), logits, truth[chosen], np.ones(len(chosen), "i8"))
    return model


def _logits(scores: np.ndarray) -> np.ndarray:
    scores = np.clip(scores, 1e-9, 1 - 1e-9)
    return np.log(scores / (1 - scores))


def _quantile(values: np.ndarray, n: np.ndarray, share: float) -> float:
    """As `np.quantile` of the values, each counted `n` times."""
    ranked = np.argsort(values)
    ends, at = np.cumsum(n[ranked]), share * (n.sum() - 1)
    low, high = (values[ranked][np.searchsorted(ends, place, "right")] for place in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def _best_cut(logits: np.ndarray, truth: np.ndarray, n: np.ndarray) -> float:
    """The logit with the best F1 of values that count `n` times; of equal ones the middle."""
    if not truth.any():
        return 0.0
    values, place = np.unique(logits, return_inverse=True)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    every, toxic = np.bincount(place, n), np.bincount(place, n * truth)
    found, said = toxic[::-1].cumsum()[::-1], every[::-1].cumsum()[::-1]
    f1 = 2 * found / (said + toxic.sum())
    return float(np.median(cuts[f1 >= f1.max() - 1e-12]))


def _pass(rows: DataFrame, start: np.ndarray, share: np.ndarray) -> DataFrame:
    """(block, values): the arrays after every row was learned from once, the mean of replicas that begin alike."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        learner, used = Learner(rng), 0
        learner.unpack(start)
        for batch in batches:
            cut, truth, weight = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for part in words_of(text) for w in part]
                pieces = [words[i:i + PIECE] for i in range(0, len(words), PIECE)]  # a very long text is several
                cut += pieces
                truth += [toxic] * len(pieces)
                weight += [share[toxic] / len(pieces)] * len(pieces)
            if not cut:
                continue
            order = rng.permutation(len(cut))
            words, truth, weight = Words([cut[i] for i in order]), np.array(truth)[order], np.array(weight)[order]
            ends = np.cumsum([len(d) for d in words.docs])
            at = 0
            while at < len(cut):  # up to BATCH texts of AT_ONCE words in all, one at least
                room = np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")
                to = min(max(int(room), at + 1), at + BATCH)
                learner.step(words, np.arange(at, to), truth, weight, rng)
                at = to
            used += len(cut)
        if used:
            values = learner.packed()
            for at in range(0, len(values), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([values[at:at + BLOCK].tobytes()]), pa.array([used])],
                                                 names=["block", "values", "n"])

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        total = sum(np.frombuffer(v.as_py(), "f4") * float(k) for v, k in zip(table.column("values"), n, strict=True))
        return pa.table({"block": table.column("block")[:1], "values": pa.array([(total / n.sum()).astype("f4").tobytes()])})

    return rows.select("text", "toxic").mapInArrow(learn, "block bigint, values binary, n bigint").groupBy("block").applyInArrow(
        mean, "block bigint, values binary")


def _spoken(rows: DataFrame) -> DataFrame:
    """(lang, place, n): occurrences of hashed words in each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(ROWS, "i8"))
                for words in words_of(text):
                    if len(known) > REMEMBERED:
                        known.clear()
                    places = [known[w] if w in known else known.setdefault(w, word_rows(w)[0]) for w in words]
                    own += np.bincount(np.array(places, "i8"), minlength=ROWS)
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])],
                                             names=["lang", "place", "n"])

    made = rows.where("lang <> ''").select("text", "lang").mapInArrow(count, "lang string, place bigint, n bigint")
    return made.groupBy("lang", "place").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model | None:
    """Train on all labelled rows outside the held-out fold, whatever their length.

    A bounded sample gives the arrays to begin with. From there replicas side by side learn from every row once, in
    PASSES parts of the rows, and are averaged after each part. A fifth of the rows is held back from all of this: its
    logits, counted in steps of 1/RESOLUTION, give the thresholds.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = known.hint("broadcast" if known.count() <= BROADCAST_ROWS else "merge")
    rows = (docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
            .where(F.col("text").isNotNull()).join(known, "doc_id").groupBy("doc_id", "toxic")
            .agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "toxic", "row.*"))
    rows = store(rows.where(F.col("text").rlike(WORDS_IN)), "labelled")
    found = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None
    spot = F.pmod(F.xxhash64("doc_id", F.lit("h3")), F.lit(5))
    few = sum(found.values()) < 50
    fitted, back = (rows, rows) if few else (rows.where(spot > 0), rows.where(spot == 0))
    chosen = sampled(fitted.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "toxic"), "toxic", "doc_id", SAMPLE)
    first = fitted.join(F.broadcast(chosen), ["doc_id", "toxic"]).select("doc_id", "toxic", "text").collect()
    first = sorted(first, key=lambda r: (r.doc_id, r.toxic))
    rng = np.random.default_rng(7)
    learner = Learner(rng)
    _warm(learner, Words([[w for part in words_of(r.text) for w in part] for r in first]), np.array([r.toxic for r in first], int),
          np.arange(len(first)), rng)
    counted = {r.toxic: r.n for r in fitted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = np.array([sum(counted.values()) / (2 * max(counted.get(v, 0), 1)) for v in (0, 1)])
    turn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(PASSES))
    for k in range(PASSES):
        blocks = _pass(fitted.where(turn == k), learner.packed(), share).collect()
        if blocks:
            learner.unpack(np.concatenate([np.frombuffer(r["values"], "f4") for r in sorted(blocks, key=lambda r: r.block)]))
    counts_of = _spoken(fitted).collect()
    names = sorted({r.lang for r in rows.where("lang <> ''").select("lang").distinct().collect()})
    counts = np.zeros((ROWS, max(len(names), 1)))
    for r in counts_of:
        counts[r.place, names.index(r.lang)] = r.n
    model = learner.model(names, counts)
    said = score(back, ["toxic", "lang"], "text", model)
    odds = F.least(F.greatest("score", F.lit(1e-9)), F.lit(1 - 1e-9))
    steps = (said.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", F.round(F.ln(odds / (1 - odds)) * RESOLUTION).cast("int").alias("at"))
             .agg(F.count("*").alias("n")).collect())
    _calibrate(model, names, np.array([r.lang for r in steps]), np.array([r["at"] / RESOLUTION for r in steps]),
               np.array([r.toxic for r in steps]), np.array([r.n for r in steps]))
    return model


def score(docs: DataFrame, keys: list[str], text: str, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, score, predicted) of every whole text."""
    def start() -> Callable:
        memory: dict = {}

        def work(texts: list[str]) -> list:
            p = model.score_all(texts, memory) if model else np.zeros(len(texts))
            return [p.astype("f8"), (p >= threshold).astype("i4")]
        return work
    return map_texts(docs, keys, text, "score double, predicted int", start)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")

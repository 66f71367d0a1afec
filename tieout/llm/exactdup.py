"""Removal of byte strings that an earlier document has too, by suffix arrays over shared stretches.

Every 50-byte window has an anchor: the 24-byte string in it with the smallest hash. Windows in a
row with one anchor form a run, and equal windows always have equal anchors, so runs can be dealt
by their anchor and no match is torn. This takes three rounds over chunks of documents (`chunks`):
 1. a chunk asks which of its anchors occur in another document; most don't, and end here;
 2. the runs on shared anchors go to the anchor's bucket, equal ones of a chunk once, with their
    first document. A bucket trims them to the windows whose hash recurs under their anchor, strings
    the runs that still differ together, builds suffix arrays (`suffixarray`), and reads off the first
    document of every window: suffixes that agree in 50 bytes stand together. Strings that get too long are cut
    finer, by anchors of 44 and then 50 bytes. Runs on anchors that round 1 met more than FREQUENT times are cut by
    anchors of 50 bytes before they are sent, so that a phrase which a third of the documents hold, each with
    text of its own around it, spreads over all buckets: 50 bytes are a window, which is one run however often it occurs;
 3. the chunk gets these documents back and marks the bytes of windows with an earlier one.
Runs are compared by 64-bit hashes of all their bytes before a suffix array sees them.

Defined results: a null or empty text has no bytes; matches never cross documents; rows with the
same id do not remove from each other; rows without an id come last; repeated rows give repeated
rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chunks import bucket_of, buckets_for, deal, mixed, squeezed, text_bytes, unsqueezed
from .common import read
from .suffixarray import suffix_arrays

WINDOW = 50
ANCHORS = (24, 44, 50)
# Bytes of text in a chunk, and for each bucket that compares runs.
CHUNK, STRETCHES = 2 << 20, 2 << 20
# Runs on one anchor, over all chunks, from which it is cut finer.
FREQUENT = 5000
# Bytes hashed at once, bytes of one string of runs, and bytes of strings worked on together.
PIECE, STRING, TOGETHER = 1 << 20, 1 << 15, 1 << 20
LAST = np.iinfo("i8").max
_POWER = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_POWER, n, 1 << 64))


_BYTE = mixed(np.arange(1, 257, dtype="u8"))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes, by doubling."""
    parts, width, have = [], 1, _BYTE[data]
    offset, total = 0, None
    while True:
        if size & width:
            cut = have[offset:]
            total = cut if total is None else total[:len(cut)] * _power(width) + cut
            offset += width
        width *= 2
        if width > size:
            return mixed(total[:max(len(data) - size + 1, 0)])
        half = width // 2
        have = have[:len(have) - half] * _power(half) + have[half:]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    have, span = values, 1
    while 2 * span <= width:
        have = np.minimum(have[:len(have) - span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


def _content(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of whole runs from the hashes of their 24-byte strings, which overlap to cover them."""
    step, out = ANCHORS[0], sizes.astype("u8")
    for spot in (starts, starts + step, starts + sizes - 2 * step, starts + sizes - step):
        out = mixed(out * np.uint64(_POWER) + grams[spot])
    return out


def contents(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of runs that lie one after the other, a bounded number of bytes at a time."""
    ends, out, at = np.cumsum(sizes), [np.zeros(0, "u8")], 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        stop = max(int(np.searchsorted(ends, begin + PIECE, "right")), at + 1)
        grams = gram_hashes(data[begin:ends[stop - 1]], ANCHORS[0])
        out.append(_content(grams, ends[at:stop] - sizes[at:stop] - begin, sizes[at:stop]))
        at = stop
    return np.concatenate(out)


class Runs:
    """Runs of windows with one anchor: first window, number of windows, key, hash of all bytes, owner."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, anchor: int, hashed: bool = True):
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for first in range(0, max(len(data) - WINDOW + 1, 0), PIECE):
            for kept, part in zip(found, self._piece(data, ends, first, anchor, hashed), strict=True):
                kept.append(part)
        kinds = ("i8", "i8", "u8", "u8", "i8")
        self.start, self.windows, self.key, self.content, self.owner = (
            np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds, strict=True))

    def _piece(self, data, ends, first, anchor, hashed) -> tuple:
        part = data[first:first + PIECE + WINDOW - 1]
        grams = gram_hashes(part, anchor)
        width = WINDOW - anchor + 1
        # the upper bits order, the lower ones say where: of equal ones the first
        where = np.arange(len(grams), dtype="u8")
        least = sliding_least(grams & np.uint64(0xFFFFFFFFFF000000) | where, width)
        at = (least & np.uint64(0xFFFFFF)).astype("i8")
        place, last = first + np.arange(len(at)), first + len(at)
        low, high = np.searchsorted(ends, [first, last - 1], "right")
        many = np.diff(np.concatenate([[first], np.minimum(ends[low:high + 1], last)]))
        inside = np.flatnonzero(place <= np.repeat(ends[low:high + 1] - WINDOW, many))  # no window leaves its text
        place, at, owner = place[inside], at[inside], np.repeat(np.arange(low, high + 1), many)[inside]
        if not len(place):
            return tuple(np.zeros(0, k) for k in ("i8", "i8", "u8", "u8", "i8"))
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)]))
        windows = np.diff(np.concatenate([head, [len(place)]]))
        start, size = place[head], windows + WINDOW - 1
        if anchor != ANCHORS[0]:
            grams = gram_hashes(part, ANCHORS[0])
        content = _content(grams, start - first, size) if hashed else size[:0].view("u8")
        # anchors are least hashes, which crowd at the low end: mixed again, keys spread over all buckets
        key = mixed((gram_hashes(part, anchor) if anchor != ANCHORS[0] else grams)[at[head]])
        return start, windows, key, content, owner[head]


def _in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows arrive in any order; every round must cut the same runs from them."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, where each ends, and their ids."""
    texts = table.column("text").combine_chunks()
    texts = (pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts).fill_null("")
    raw = [t.as_buffer() for t in texts.cast(pa.large_binary())]
    data = np.concatenate([np.frombuffer(b, "u1") for b in raw] or [np.zeros(0, "u1")])
    ids = table.column("doc_id").fill_null(LAST).to_numpy()
    return data, np.cumsum([b.size for b in raw], dtype="i8"), ids


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, "i8")


def _anchors(table: pa.Table, buckets: int) -> pa.Table:
    """Round 1: a chunk's distinct anchors, how many runs each has, and whether two of its documents have it."""
    data, ends, ids = _texts(_in_order(table))
    runs = Runs(data, ends, ANCHORS[0], hashed=False)
    order = np.argsort(runs.key)
    keys, owners = runs.key[order], ids[runs.owner[order]]
    head = _firsts(keys)
    if len(head):
        several = np.minimum.reduceat(owners, head) != np.maximum.reduceat(owners, head)
    else:
        several = np.zeros(0, bool)
    many = np.diff(np.concatenate([head, [len(keys)]]))
    keys = keys[head]
    which, cuts = _owners(keys, buckets)
    return pa.table({"chunk": pa.array(np.full(len(which), table.column("chunk")[0].as_py(), "i4")), "bucket": which,
                     "keys": pa.array([squeezed(keys[a:b], rising=True) for a, b in cuts], pa.binary()),
                     "several": pa.array([squeezed(several[a:b]) for a, b in cuts], pa.binary()),
                     "runs": pa.array([squeezed(many[a:b]) for a, b in cuts], pa.binary())})


def _owners(keys: np.ndarray, buckets: int) -> tuple[pa.Array, list[tuple[int, int]]]:
    """The buckets of rising keys, and each one's stretch of them."""
    which, first = np.unique(bucket_of(keys, buckets), return_index=True)
    return pa.array(which.astype("i4")), list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)) if len(which) else []


def _all(table: pa.Table, name: str, rising: bool = False) -> list[np.ndarray]:
    return [unsqueezed(x, rising) for x in table.column(name).to_pylist()]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, "u8")


def _split(values: np.ndarray, sizes: list[int]) -> pa.Array:
    """Squeezed stretches of the given sizes."""
    return pa.array([squeezed(part) for part in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())


def _shared(table: pa.Table) -> pa.Table:
    """Round 1, bucket: 1 for anchors that two documents have (two chunks never hold the same row), 2 if also frequent."""
    keys, several = _all(table, "keys", rising=True), _joined(_all(table, "several")).astype(bool)
    _, place, times = np.unique(_joined(keys), return_inverse=True, return_counts=True)
    both = np.zeros(len(times), bool)
    both[place[several]] = True
    runs = np.bincount(place, weights=_joined(_all(table, "runs")), minlength=len(times))
    said = (both | (times > 1)).astype("u1") * np.where(runs > FREQUENT, 2, 1)
    return pa.table({"chunk": table.column("chunk").combine_chunks(), "bucket": table.column("bucket").combine_chunks(),
                     "shared": _split(said[place], [len(k) for k in keys])})


class Asked:
    """A chunk's runs on shared anchors, and their different contents in the order in which they are sent."""

    def __init__(self, docs: pa.Table, answers: pa.Table):
        self.data, self.ends, self.ids = _texts(docs)
        runs = Runs(self.data, self.ends, ANCHORS[0])
        keys = np.unique(runs.key)
        shared = _joined(_all(answers.sort_by("bucket"), "shared"))
        said = shared[np.searchsorted(keys, runs.key)] if len(keys) else np.zeros(0, "u8")
        parts = [[x[said == 1] for x in (runs.start, runs.windows, runs.owner, runs.key, runs.content)]]
        if (said == 2).any():
            start, sizes = runs.start[said == 2], runs.windows[said == 2] + WINDOW - 1
            ends = np.cumsum(sizes)
            cut = Runs(_gather(self.data, start, sizes), ends, ANCHORS[-1])
            parts.append([start[cut.owner] + cut.start - (ends - sizes)[cut.owner], cut.windows,
                          runs.owner[said == 2][cut.owner], cut.key, cut.content])
        self.start, self.windows, self.owner, key, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        held = np.lexsort((self.owner, content, key))
        self.start, self.windows, self.owner, key, content = (
            x[held] for x in (self.start, self.windows, self.owner, key, content))
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]) if len(held) else np.zeros(0, bool)
        self.heads, self.kind = np.flatnonzero(head), np.cumsum(head) - 1
        self.key, self.content = key[self.heads], content[self.heads]
        self.first = np.minimum.reduceat(self.ids[self.owner], self.heads) if len(held) else np.zeros(0, "i8")


def _stretches(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Round 2: the different runs of a chunk on shared anchors, with their bytes and first documents."""
    names = ["chunk", "bucket", "keys", "firsts", "sizes", "bytes"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    asked = Asked(_in_order(docs), answers)
    which, cuts = _owners(asked.key, buckets)
    start, sizes = asked.start[asked.heads], asked.windows[asked.heads] + WINDOW - 1
    columns = [[squeezed(asked.key[a:b], rising=True), squeezed(asked.first[a:b]), squeezed(sizes[a:b]),
                _gather(asked.data, start[a:b], sizes[a:b]).tobytes()] for a, b in cuts]
    return pa.table([pa.array(np.full(len(which), docs.column("chunk")[0].as_py(), "i4")), which,
                     *[pa.array([row[k] for row in columns], pa.binary()) for k in range(4)]], names=names)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[starts[i]:starts[i] + sizes[i]] for all i, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]


def first_documents(data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The first document of every window of different runs: data holds the runs one after the other.

    `keys` are the runs' anchors and `firsts` their first documents. Runs are trimmed to the windows whose hash
    recurs under their anchor; the others have no equal. Trimmed runs are often the same, and compared once.
    """
    windows = sizes - WINDOW + 1
    out = np.repeat(firsts, windows)
    if not len(sizes):
        return out
    starts, spots = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(owner)) - spots[owner]
    mark = np.empty(len(owner), "u8")
    for first in range(0, len(data), PIECE):
        grams = gram_hashes(data[first:first + PIECE + WINDOW - 1], WINDOW)
        low, high = np.searchsorted(starts[owner] + offset, [first, first + PIECE])
        spot = (starts[owner[low:high]] + offset[low:high]) - first
        mark[low:high] = mixed(grams[spot] + mixed(keys[owner[low:high]]))
    order = np.argsort(mark)
    same = mark[order][1:] == mark[order][:-1]
    again = np.zeros(len(mark), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    low = np.minimum.reduceat(np.where(again, offset, LAST), spots)
    high = np.maximum.reduceat(np.where(again, offset, -1), spots)
    live = np.flatnonzero(high >= 0)
    if not len(live):
        return out
    cut_starts, cut_windows = starts[live] + low[live], high[live] - low[live] + 1
    cut_sizes = cut_windows + WINDOW - 1
    content = contents(_gather(data, cut_starts, cut_sizes), cut_sizes)
    sort = np.lexsort((firsts[live], content, keys[live]))
    new = np.concatenate([[True], (keys[live][sort][1:] != keys[live][sort][:-1]) | (content[sort][1:] != content[sort][:-1])])
    heads, kind = sort[new], np.empty(len(sort), "i8")
    kind[sort] = np.cumsum(new) - 1
    found = _by_suffixes(_gather(data, cut_starts[heads], cut_sizes[heads]), cut_sizes[heads], keys[live][heads], firsts[live][heads])
    source = (np.cumsum(cut_windows[heads]) - cut_windows[heads])[kind]
    step = np.arange(cut_windows.sum()) - np.repeat(np.cumsum(cut_windows) - cut_windows, cut_windows)
    goal = np.repeat(spots[live] + low[live], cut_windows) + step
    out[goal] = np.minimum(out[goal], found[np.repeat(source, cut_windows) + step])
    return out


def _by_suffixes(data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, firsts: np.ndarray, level: int = 0) -> np.ndarray:
    """As `first_documents`, by suffix arrays over the different runs of each anchor."""
    windows = sizes - WINDOW + 1
    out = np.repeat(firsts, windows)
    starts, spots = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    order = np.argsort(keys, kind="stable")
    head = _firsts(keys[order])
    count = np.diff(np.concatenate([head, [len(order)]]))
    many = np.flatnonzero(count > 1)  # a run that is alone on its anchor has met all its equals
    if not len(many):
        return out
    total = np.add.reduceat(sizes[order] + 1, head)
    fine = total[many] > STRING if level + 1 < len(ANCHORS) else np.zeros(len(many), bool)
    groups = many[~fine]
    groups = groups[np.argsort(total[groups], kind="stable")]  # strings of like length work together
    at = 0
    while at < len(groups):
        size, end = 0, at
        while end < len(groups) and (end == at or size + total[groups[end]] <= TOGETHER):
            size += total[groups[end]]
            end += 1
        some = groups[at:end]
        runs = order[np.repeat(head[some] - np.cumsum(count[some]) + count[some], count[some])
                     + np.arange(count[some].sum())]
        _match(data, starts[runs], sizes[runs], firsts[runs], count[some], spots[runs], out)
        at = end
    for group in many[fine]:
        runs = order[head[group]:head[group] + count[group]]
        part = _gather(data, starts[runs], sizes[runs])
        cut = Runs(part, np.cumsum(sizes[runs]), ANCHORS[level + 1])
        doc = firsts[runs][cut.owner]
        sort = np.lexsort((doc, cut.content, cut.key))
        new = np.concatenate([[True], (cut.key[sort][1:] != cut.key[sort][:-1])
                              | (cut.content[sort][1:] != cut.content[sort][:-1])])
        heads, kind = sort[new], np.empty(len(sort), "i8")
        kind[sort] = np.cumsum(new) - 1
        inner_sizes = cut.windows[heads] + WINDOW - 1
        inner = _by_suffixes(_gather(part, cut.start[heads], inner_sizes), inner_sizes, cut.key[heads], doc[heads], level + 1)
        inner_spots = np.cumsum(cut.windows[heads]) - cut.windows[heads]
        run_starts = np.cumsum(sizes[runs]) - sizes[runs]
        goal = spots[runs][cut.owner] + cut.start - run_starts[cut.owner]
        goal = np.repeat(goal - np.cumsum(cut.windows) + cut.windows, cut.windows) + np.arange(cut.windows.sum())
        source = inner_spots[kind]
        source = np.repeat(source - np.cumsum(cut.windows) + cut.windows, cut.windows) + np.arange(cut.windows.sum())
        out[goal] = np.minimum(out[goal], inner[source])
    return out


def _match(data, starts, sizes, firsts, counts, spots, out) -> None:
    """Build one string for each group of runs, its suffix array, and lower `out` to the least of equal windows."""
    lengths = sizes + 1
    ends = np.cumsum(lengths)
    text = np.ones(ends[-1], "u2")  # 1 parts the runs of a string
    body = np.ones(ends[-1], bool)
    body[ends - 1] = False
    text[body] = _gather(data, starts, sizes).astype("u2") + 2
    last = np.cumsum(counts) - 1
    text[ends[last] - 1] = 0
    string_ends = ends[last]
    string_starts = np.concatenate([[0], string_ends[:-1]])
    order = suffix_arrays(text, string_starts, string_ends - string_starts)
    run = np.repeat(np.arange(len(sizes)), lengths)
    within = np.arange(len(text)) - (ends - lengths)[run]
    order = order[within[order] + WINDOW <= sizes[run[order]]]  # suffixes that are whole windows
    same = np.zeros(len(order), bool)
    string = np.repeat(np.arange(len(counts)), counts)[run[order]]
    for a in range(0, max(len(order) - 1, 0), 65536):
        b = min(a + 65536, len(order) - 1)
        x, y = order[a:b], order[a + 1:b + 1]
        close = np.flatnonzero((string[a:b] == string[a + 1:b + 1]) & (text[x] == text[y]) & (text[x + 49] == text[y + 49]))
        step = np.arange(WINDOW)
        same[a + 1 + close] = (text[x[close][:, None] + step] == text[y[close][:, None] + step]).all(1)
    if not len(order):
        return
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(firsts[run[order]], head)
    place = spots[run[order]] + within[order]
    out[place] = np.repeat(least, np.diff(np.concatenate([head, [len(order)]])))


def _resolved(table: pa.Table) -> pa.Table:
    """Round 2, bucket: for each run that was sent, the documents that first had its windows, as steps."""
    keys = _all(table, "keys", rising=True)
    counts = [len(k) for k in keys]
    keys = _joined(keys)
    firsts, sizes = (_joined(_all(table, name)).view("i8") for name in ("firsts", "sizes"))
    data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), "u1")
    content = contents(data, sizes)
    sort = np.lexsort((firsts, content, keys))
    new = np.concatenate([[True], (keys[sort][1:] != keys[sort][:-1]) | (content[sort][1:] != content[sort][:-1])])
    heads, kind = sort[new], np.empty(len(sort), "i8")
    kind[sort] = np.cumsum(new) - 1
    starts = np.cumsum(sizes) - sizes
    found = first_documents(_gather(data, starts[heads], sizes[heads]), sizes[heads], keys[heads], firsts[heads])
    windows = sizes[heads] - WINDOW + 1
    ends = np.cumsum(windows)
    edge = np.concatenate([[True], found[1:] != found[:-1]])
    edge[ends[:-1]] = True
    at = np.flatnonzero(edge)
    run = np.searchsorted(ends, at, "right")
    offset, doc = at - (ends - windows)[run], found[at]
    each = np.bincount(run, minlength=len(heads))
    spots = np.cumsum(each) - each
    many = each[kind]
    back = np.repeat(spots[kind] - np.cumsum(many) + many, many) + np.arange(many.sum())
    rows = np.cumsum(counts)
    steps = np.add.reduceat(many, rows - counts)
    return pa.table({"chunk": table.column("chunk").combine_chunks(), "bucket": table.column("bucket").combine_chunks(),
                     "steps": _split(many, counts), "offsets": _split(offset[back], steps), "docs": _split(doc[back], steps)})


def _removed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Round 3: mark every byte of a window that an earlier document has."""
    kind = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
            ("kept_text", pa.string())]
    if not docs.num_rows:
        return pa.table([docs.column("doc_id"), docs.column("row"), *[pa.array([], t) for _, t in kind]],
                        names=["doc_id", "row", *[n for n, _ in kind]])
    docs = _in_order(docs)
    asked = Asked(docs, answers.filter(answers.column("round").to_numpy() == 1) if answers.num_rows else answers)
    later = (answers.filter(answers.column("round").to_numpy() == 2) if answers.num_rows else answers).sort_by("bucket")
    steps, offsets, first = (_joined(_all(later, name)).view("i8") for name in ("steps", "offsets", "docs"))
    depth = np.zeros(len(asked.data) + WINDOW + 1, "i4")
    if len(asked.start):
        spots = np.cumsum(steps) - steps
        many = steps[asked.kind]
        run = np.repeat(np.arange(len(asked.start)), many)
        at = np.repeat(spots[asked.kind] - np.cumsum(many) + many, many) + np.arange(many.sum())
        begin = offsets[at]
        end = np.concatenate([begin[1:], [0]])
        closing = np.concatenate([run[1:] != run[:-1], [True]])
        end[closing] = asked.windows
        hit = first[at] < asked.ids[asked.owner[run]]
        np.add.at(depth, asked.start[run[hit]] + begin[hit], 1)
        np.add.at(depth, asked.start[run[hit]] + end[hit] + WINDOW - 1, -1)
    gone = np.cumsum(depth)[:len(asked.data)] > 0
    out: list[list] = [[] for _ in kind]
    known = docs.column("text").is_valid().to_numpy()
    for begin, end, text in zip(np.concatenate([[0], asked.ends[:-1]]), asked.ends, known, strict=True):
        mask = gone[begin:end]
        left = asked.data[begin:end][~mask].tobytes()
        spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and mask[0])
        for column, value in zip(out, (end - begin, int(mask.sum()), spans, hashlib.sha256(left).hexdigest(),
                                       left.decode(errors="ignore") if text else None), strict=True):
            column.append(value)
    return pa.table([docs.column("doc_id").combine_chunks(), docs.column("row").combine_chunks(),
                     *[pa.array(x, t) for x, (_, t) in zip(out, kind, strict=True)]],
                    names=["doc_id", "row", *[n for n, _ in kind]])


def remove_repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row.

    `row` holds the other columns. `kept_text` lacks the halves of characters that a cut went through;
    it is null where the text was.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.struct(
        *[c for c in docs.columns if c != text]).alias("row"))
    total = text_bytes(source, "text")
    by_chunk = deal(source, ["doc_id", "text"], total, CHUNK).groupBy("chunk")
    buckets, coarse = buckets_for(total / 14), max(8, total // STRETCHES)
    asked = by_chunk.applyInArrow(lambda t: _anchors(t, buckets),
                                  "chunk int, bucket int, keys binary, several binary, runs binary")
    shared = asked.groupBy("bucket").applyInArrow(_shared, "chunk int, bucket int, shared binary")
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(
        lambda d, a: _stretches(d, a, coarse),
        "chunk int, bucket int, keys binary, firsts binary, sizes binary, bytes binary")
    found = sent.groupBy("bucket").applyInArrow(
        _resolved, "chunk int, bucket int, steps binary, offsets binary, docs binary")
    answers = shared.withColumn("round", F.lit(1)).unionByName(found.withColumn("round", F.lit(2)), allowMissingColumns=True)
    made = StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    done = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        _removed, StructType([source.schema["doc_id"], source.schema["row"], *made.fields]))
    return done.withColumnRenamed("doc_id", key)


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

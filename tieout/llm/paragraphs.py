"""Removal of repeated passages by MinHash banding over paragraphs.

A line is cut into paragraphs after sentences chosen by a hash of their own words (every second
one on average), so that a passage is mostly cut alike wherever it was pasted. Paragraphs of at least
MIN_WORDS words get a MinHash of their five-word shingles; bands are as many as `bands_for` says
for the wanted recall at the similarity threshold. Paragraphs that share a band meet in a bucket,
exact Jaccard similarity verifies them there, components of the verified links are the classes,
and every occurrence but a class's first (by document, then place) is a removal.

A passage that is pasted inside a paragraph, or cut otherwise, is found word by word: RUN words in a
row that an earlier row has, or an earlier place of the same text, are removed too, as spans beside
the removed paragraphs. The least five-word shingle of each RUN words is its anchor; only windows on
anchors that occur twice are hashed, and neighbours on one anchor are one row, a stretch. Equal stretches are compared
once: the windows of their first place find the first place of each window, runs of such places are segments, and
every stretch is held against its segments.

Texts are read once for paragraphs, bands and anchors, and those with a shared anchor once more.

Equal paragraphs are one entry from the start. A bucket larger than BLOCK entries is worked in
pairs of blocks, each a task of its own, which hand out a spanning forest instead of pairs.

Defined results: null and empty texts have no paragraphs; rows equal in id and text are judged as
one and answered alike; rows without an id come first; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..operators.components import components
from .chunks import bucket_of, buckets_for, flat, mixed, packed, text_bytes
from .common import read as read_table
from .common import store
from .simhash import forest

SENTENCE = re.compile(r"[^\n.!?]*+(?:[.!?]++[\"')\]]*+|\n|\Z)")
WORD = re.compile(r"\w+")
SHINGLE, MIN_WORDS, SIMILARITY, RECALL = 5, 8, 0.8, 0.999
ROWS_PER_BAND = 3
BLOCK = 2000
# Members of a key up to which keys are compared together.
TOGETHER = 32
# Words in a row that are a passage wherever they lie.
RUN = 50
# Words of paragraphs whose band keys are worked out together.
WORDS_AT_ONCE = 1_000_000
# Stretches on one anchor from which their windows are compared one by one.
FREQUENT = 20_000
# Bytes of text per compared window, only to choose the number of buckets.
STRETCH_BYTES = 16
# Bytes of text per paragraph, only to choose the number of buckets.
PARAGRAPH_BYTES = 100


def bands_for(similarity: float, recall: float, rows: int = ROWS_PER_BAND) -> int:
    """Fewest bands of `rows` values that catch a pair of this similarity with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def words_of(text: str) -> list[str]:
    """Lower-case words; a letter whose lower case has several characters stays in its word."""
    low = _lowered(text)
    return [w.lower() for w in WORD.findall(text)] if low is None else WORD.findall(low)


def _lowered(text: str) -> str | None:
    """The text in lower case if that keeps every character's place and doesn't depend on its neighbours."""
    return None if not text.isascii() and ("\u0130" in text or "\u03a3" in text) else text.lower()


def paragraphs(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every paragraph; together they cover the text."""
    from zlib import crc32

    low = _lowered(text)
    every = words_of(text) if low is None else WORD.findall(low)
    out, start, words, at = [], 0, [], 0
    ends = [match.end() for match in SENTENCE.finditer(text)]
    # a sentence never ends inside a word
    for end, upto in zip(ends, np.searchsorted(_bounds(text)[0], ends).tolist(), strict=True):
        own, at = every[at:upto], upto
        words += own
        if end and text[end - 1] == "\n" and end > start or (own and crc32(" ".join(own).encode()) % 2 == 0):
            out.append((start, end, words))
            start, words = end, []
    if start < len(text):
        out.append((start, len(text), words))
    return out


def shingles(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hashes of the five-word shingles of one paragraph, repeats included."""
    return _shingled(_hashes(words, known), np.array([len(words)]))[0]


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    try:
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def _shingled(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many paragraphs of at least five words, and where each one's begin."""
    total = hashes[:len(hashes) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - SHINGLE + 1 + k]
    total = mixed(total)
    ends = np.cumsum(sizes)
    inside = np.ones(len(hashes), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    return total[inside[:len(total)]], starts


def unit_hash(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words).encode())


def _seeds(bands: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 62, bands * ROWS_PER_BAND).astype("u8") * np.uint64(2) + np.uint64(1)


def _band_keys(hashes: list[np.ndarray], bands: int) -> np.ndarray:
    """The band keys of paragraphs: a row for each paragraph."""
    shingled, starts = _shingled(np.concatenate(hashes), np.array([len(h) for h in hashes]))
    keys = np.zeros((bands, len(hashes)), "u8")
    for k, seed in enumerate(_seeds(bands)):
        least = np.minimum.reduceat(shingled * seed, starts)
        keys[k // ROWS_PER_BAND] = keys[k // ROWS_PER_BAND] * np.uint64(0x9E3779B97F4A7C15) + least
    return mixed(keys + np.arange(1, bands + 1, dtype="u8")[:, None]).T


def _sent(batches: Iterator[pa.RecordBatch], bands: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Paragraphs with their band keys to (bucket, keys, members), packed by bucket.

    The upper half of a key chooses the bucket and the lower half tells keys in it apart; where two keys fall together, paragraphs
    meet that share no band and the exact check keeps them apart.
    """
    for batch in batches:
        for members, keys in zip(*(batch.column(c) for c in (0, 1)), strict=True):
            keys, owners = np.asarray(keys.values).view("u8"), np.repeat(np.asarray(members.values), bands)
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            which, first = np.unique(bucket_of(keys, buckets), return_index=True)
            ends = np.concatenate([first[1:], [len(keys)]])
            yield pa.RecordBatch.from_arrays([pa.array(which.astype("i4")), packed(keys.astype("u4").view("i4"), ends), packed(owners, ends)],
                                             names=["bucket", "keys", "members"])


def _least(found: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        found, span = np.minimum(found[:-span], found[span:]), 2 * span
    rest = width - span
    return np.minimum(found[:len(found) - rest], found[rest:])


def _anchors(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, several) of texts of at least RUN words: each anchor once, and whether its shingle recurs in the text."""
    found, starts = _shingled(hashes, sizes)
    count = sizes - RUN + 1
    spot = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
    least, owner = _least(found, RUN - SHINGLE + 1)[spot], np.repeat(np.arange(len(sizes)), count)
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    least, owner = least[fresh], owner[fresh]
    order = np.lexsort((least, owner))
    least, owner = least[order], owner[order]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    least, owner = least[fresh], owner[fresh]
    salt = mixed(np.arange(len(sizes), dtype="u8"))
    every, times = np.unique(mixed(found + np.repeat(salt, sizes - SHINGLE + 1)), return_counts=True)
    return owner, least, times[np.searchsorted(every, mixed(least + salt[owner]))] > 1


def _bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each match of WORD starts and ends."""
    if text.isascii():
        held = _WORDLIKE[np.frombuffer(text.encode(), "u1")]
    else:
        points, at = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
        held = np.array([WORD.match(chr(p)) is not None for p in points.tolist()], bool)[at]
    edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
    return edges[::2], edges[1::2]


def _edges_of(text: str) -> tuple[int, int]:
    """Where the first word starts and the last one ends."""
    end = len(text)
    while end and not WORD.match(text[end - 1]):
        end -= 1
    return WORD.search(text).start(), end


_WORDLIKE = np.array([WORD.match(chr(p)) is not None for p in range(128)])
UNITS = "array<struct<place: int, start: bigint, length: bigint, unit: bigint>>"


def read_texts(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """What one reading of the texts gives, stored: rows of texts, and rows of `members`.

    (key, version, units, anchors, several, low, high) of each text: its paragraphs that are long enough to be judged,
    and if it has RUN words its anchors and the edges of its words; `version` is a hash of the text, which tells rows with the
    same id apart. (members, keys): the distinct paragraphs of a batch, and as many band keys for each as there are bands.
    """
    bands = bands_for(similarity, recall)
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema.fields[:2]] + StructType.fromDDL(
        f"units {UNITS}, anchors array<bigint>, several array<boolean>, low bigint, high bigint, "
        "members array<bigint>, keys array<bigint>").fields)
    kinds = to_arrow_schema(schema)

    def filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, units, edges, fresh = [], [], [], {}
            for one in batch.column(2).to_pylist():
                found = paragraphs(one or "")
                own = _hashes([w for _, _, words in found for w in words], known)
                at, mine = 0, []
                for place, (start, end, words) in enumerate(found):
                    if len(words) >= MIN_WORDS:
                        mine.append((place, start, end - start, unit_hash(words)))
                        fresh.setdefault(mine[-1][3], own[at:at + len(words)])
                    at += len(words)
                units.append(mine)
                hashes.append(own)
                edges.append(_edges_of(one) if len(own) >= RUN else (None, None))
            flat_units = [u for mine in units for u in mine]
            place, start, length, unit = zip(*flat_units, strict=True) if flat_units else [()] * 4
            unit = np.array(unit, "u8").view("i8")
            struct = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                                 pa.array(unit, pa.int64())], ["place", "start", "length", "unit"])
            sizes = np.array([len(h) for h in hashes])
            long = np.flatnonzero(sizes >= RUN)
            counts = np.zeros(len(sizes), "i8")
            anchors, several = np.zeros(0, "u8"), np.zeros(0, bool)
            if len(long):
                owner, anchors, several = _anchors(np.concatenate([hashes[k] for k in long]), sizes[long])
                counts[long] = np.bincount(owner, minlength=len(long))
            yield filled({
                "key": batch.column(0), "version": batch.column(1), "units": packed(struct, np.cumsum([len(m) for m in units])),
                "anchors": packed(anchors.view("i8"), np.cumsum(counts)), "several": packed(several, np.cumsum(counts)),
                "low": pa.array([e[0] for e in edges], pa.int64()), "high": pa.array([e[1] for e in edges], pa.int64())})
            names, words = list(fresh), list(fresh.values())
            while names:
                size, take = 0, 0
                while take < len(names) and size < WORDS_AT_ONCE:
                    size += len(words[take])
                    take += 1
                keys, own = _band_keys(words[:take], bands).ravel().view("i8"), np.array(names[:take], "u8").view("i8")
                yield filled({"members": packed(own, np.array([take])), "keys": packed(keys, np.array([len(keys)]))})
                names, words = names[take:], words[take:]

    return store(source.mapInArrow(read, schema), "read", "zstd")


def _met(table: pa.Table) -> pa.Table:
    """The distinct members of every band key that at least two paragraphs share."""
    keys, _ = flat(table.column("keys"))
    keys = (table.column("bucket")[0].as_py() << 32) + keys.view("u4").astype("i8")
    units, _ = flat(table.column("members"))
    order = np.lexsort((units, keys))
    keys, units = keys[order], units[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (units[1:] != units[:-1])])
    keys, units = keys[fresh], units[fresh]
    same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    held = same[1:] | same[:-1]
    return pa.table({"key": keys[held], "unit": units[held]})


def _verified(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the pairs in one bucket (or pair of blocks) that are similar enough."""
    units = table.column("unit").to_numpy()
    values, sizes = flat(table.column("shingles"))
    distinct, ids = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(units)), sizes)
    order = np.argsort(ids, kind="stable")
    holders, edges = owner[order], np.searchsorted(ids[order], np.arange(len(distinct) + 1))
    ends, a, b = np.cumsum(sizes), [], []
    for x in range(len(units)):
        mine = ids[ends[x] - sizes[x]:ends[x]]
        common = np.bincount(np.concatenate([holders[edges[i]:edges[i + 1]] for i in mine]), minlength=len(units))
        close = np.flatnonzero(common >= similarity * (sizes[x] + sizes - common) - 1e-9)
        close = close[close < x]
        a.append(units[close])
        b.append(np.full(len(close), units[x]))
        if sum(map(len, a[-64:])) > 100_000:  # thin the links out as they come
            a, b = ([part] for part in forest(np.concatenate(a), np.concatenate(b)))
    a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, "i8"),) * 2
    return pa.table({"a": a, "b": b})


def _links(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the similar pairs of many keys (or pairs of blocks), rows (key, i, j, unit, shingles).

    Members of small ones are compared together on flat arrays, large ones one after the other.
    """
    table = table.combine_chunks().sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    names = [table.column(c).to_numpy() for c in ("key", "i", "j")]
    begin = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in names], axis=0)]))
    count = np.diff(np.concatenate([begin, [table.num_rows]]))
    made = [_verified(table.slice(b, n), similarity) for b, n in zip(begin[count > TOGETHER], count[count > TOGETHER], strict=True)]
    rows = np.flatnonzero(np.repeat(count <= TOGETHER, count))
    if len(rows):
        few = table.take(pa.array(rows))
        units, owner = few.column("unit").to_numpy(), np.repeat(np.arange(len(begin)), count)[rows]
        values, sizes = flat(few.column("shingles"))
        member = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((values, owner[member]))
        values, member = values[order], member[order]
        pairs = [np.zeros(0, "i8")]
        for k in range(1, TOGETHER):
            same = np.flatnonzero((values[k:] == values[:-k]) & (owner[member[k:]] == owner[member[:-k]]))
            if not len(same):
                break
            pairs.append(member[same] * len(rows) + member[same + k])
        pairs, common = np.unique(np.concatenate(pairs), return_counts=True)
        x, y = pairs // len(rows), pairs % len(rows)
        close = common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9
        made.append(pa.table({"a": units[x[close]], "b": units[y[close]]}))
    made = pa.concat_tables(made)
    a, b = forest(made.column("a").to_numpy(), made.column("b").to_numpy())
    return pa.table({"a": a, "b": b})


def similar_units(docs: DataFrame, read: DataFrame, places: DataFrame, key: str, text: str, similarity: float,
                  recall: float) -> DataFrame:
    """Edges (a, b) between different paragraphs with exact Jaccard similarity of at least `similarity`."""
    bands = bands_for(similarity, recall)
    buckets = buckets_for(bands * text_bytes(docs, text) / PARAGRAPH_BYTES)
    sent = read.where("members is not null").select("members", "keys").mapInArrow(
        lambda it: _sent(it, bands, buckets), "bucket int, keys array<int>, members array<bigint>")
    members = store(sent.groupBy("bucket").applyInArrow(_met, "key bigint, unit bigint"), "members")
    # one near copy shares most bands with the other: keep one key for each set of members
    sets = members.groupBy("key").agg(F.bit_xor(F.xxhash64("unit")).alias("mark"), F.count("*").alias("n"))
    sets = sets.groupBy("mark", "n").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    met = members.join(sets, "key").select("key", "unit", own.alias("own"), F.explode(F.sequence(
        F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # the shingles of the paragraphs that met, read from each one's first occurrence
    wanted = members.select("unit").distinct().join(places, "unit").groupBy(
        F.col("first")[key].alias("at"), F.col("first.version").alias("version")).agg(
        F.collect_list("first.place").alias("wanted"))
    source = docs.select(F.col(key).alias("at"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    held = source.join(wanted, source["at"].eqNullSafe(wanted["at"]) & (source["version"] == wanted["version"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            units, sets = [], []
            for body, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = paragraphs(body)
                for place in places:
                    units.append(np.uint64(unit_hash(found[place][2])).astype("i8"))
                    sets.append(np.unique(shingles(found[place][2], known)).view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["unit", "shingles"])

    shingled = held.select("text", "wanted").mapInArrow(cut, "unit bigint, shingles array<bigint>")
    shingled = shingled.dropDuplicates(["unit"])
    # many keys to a task: most have two or three paragraphs
    dealt = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(8, math.ceil(members.count() / BLOCK)))).alias("bucket")
    return met.join(shingled, "unit").select(dealt, "key", "i", "j", "unit", "shingles").groupBy("bucket").applyInArrow(
        lambda t: _links(t, similarity), "a bigint, b bigint").distinct()


def removals(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, recall: float = RECALL,
             read: DataFrame | None = None) -> DataFrame:
    """Every occurrence of a passage but its first: (key, version, place, start, length, class_unit, first_key),
    the last being the row that keeps the passage."""
    read = read or read_texts(docs, key, text, similarity, recall)
    found = read.where("members is null").select(F.col("key").alias(key), "version", F.inline("units"))
    places = found.groupBy("unit").agg(F.min(F.struct(key, "version", "place")).alias("first"), F.count("*").alias("n"))
    linked = components(similar_units(docs, read, places, key, text, similarity, recall))
    rooted = places.join(linked, places["unit"] == linked["node"], "left").select(
        "unit", "first", "n", F.coalesce("component", "unit").alias("class_unit"))
    classes = rooted.groupBy("class_unit").agg(F.min("first").alias("kept"), F.sum("n").alias("copies")).where("copies > 1")
    again = rooted.select("unit", "class_unit").join(classes.select("class_unit", "kept"), "class_unit")
    return (found.join(again, "unit").where(~F.struct(key, "version", "place").eqNullSafe(F.col("kept")))
            .select(key, "version", "place", "start", "length", "class_unit", F.col("kept")[key].alias(f"first_{key}"))
            .distinct())


def _window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` words in a row, from the words' hashes, by doubling."""
    def power(length: int) -> np.uint64:
        return np.uint64(pow(0x9E3779B97F4A7C15, length, 1 << 64))

    parts, length = {1: hashes}, 1
    while 2 * length <= size:
        parts[2 * length] = parts[length][:-length] * power(length) + parts[length][length:]
        length *= 2
    count, at, total = len(hashes) - size + 1, 0, np.zeros(len(hashes) - size + 1, "u8")
    for length in sorted(parts, reverse=True):
        if size & length:
            total = total * power(length) + parts[length][at:at + count]
            at += length
    return mixed(total)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, version, anchor, content, at, hashes, starts, ends) of neighbouring windows of RUN words on one wanted anchor.

    A stretch has fewer windows than RUN words, so its first and last window hold all its words.
    """
    known: dict[str, int] = {}
    width = RUN - SHINGLE + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2).to_pylist()
        words = [_hashes(words_of(text), known) for text in texts]
        sizes = np.array([len(own) for own in words])
        own, first = np.concatenate(words), np.cumsum(sizes) - sizes
        found, starts = _shingled(own, sizes)
        # the windows of all texts after each other: their text, their place in it, and the least shingle of each
        count = sizes - RUN + 1
        row = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        least = _least(found, width)[starts[row] + place]
        # windows on one anchor beside each other; an anchor that one text wants is wanted of every text that has it
        fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
        wanted = np.unique(np.asarray(batch.column(3).flatten()).view("u8"))
        beside = np.cumsum(fresh) - 1
        spot = np.flatnonzero(np.isin(least[fresh], wanted)[beside])
        if not len(spot):
            continue
        begin = np.flatnonzero(np.concatenate([[True], beside[spot][1:] != beside[spot][:-1]]))
        inside = np.arange(len(spot)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(spot)]])))
        begin = np.flatnonzero(inside % width == 0)
        count = np.diff(np.concatenate([begin, [len(spot)]]))
        word = first[row[spot]] + place[spot]
        windows = _window_hashes(own, RUN)[word]
        bounds = [_bounds(text) for text in texts]
        low, high = (np.concatenate([b[k] for b in bounds]).astype("i4") for k in (0, 1))
        head, stops = spot[begin], np.cumsum(count)
        content = mixed(mixed(windows[begin] + mixed(windows[stops - 1])) + count.astype("u8"))
        owner = pa.array(row[head])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(least[head].view("i8")), pa.array(content.view("i8")),
             pa.array(place[head].astype("i8")), packed(windows.view("i8"), stops), packed(low[word], stops), packed(high[word + RUN - 1], stops)],
            names=["key", "version", "anchor", "content", "at", "hashes", "starts", "ends"])


def _segments(table: pa.Table) -> pa.Table:
    """A bucket's stretches (content, key, version, at, j, hashes) to segments: (content, j, last, hash, first, of, gap).

    All windows with one hash are in one bucket. A segment's windows follow each other at their first place too, where a stretch
    would begin at `gap`.
    """
    table = table.combine_chunks().sort_by([("key", "ascending"), ("version", "ascending"), ("at", "ascending")])
    keys = table.column("key")
    order = np.concatenate([np.flatnonzero(keys.is_null().to_numpy()), np.flatnonzero(keys.is_valid().to_numpy())])  # no key comes first
    table = table.take(pa.array(order))
    hashes, sizes = flat(table.column("hashes"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = table.column("j").to_numpy().astype("i8")
    j = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[row]
    at, version = table.column("at").to_numpy(), table.column("version").to_numpy()
    # equal keys and versions are one text, whose windows come in order of their places
    codes = table.column("key").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (version[1:] != version[:-1])])
    text = np.cumsum(fresh) - 1
    rank = np.lexsort(((at[row] + j), text[row], hashes))
    head = np.concatenate([[True], hashes[rank][1:] != hashes[rank][:-1]])
    lead = np.empty(len(row), "i8")
    lead[rank] = rank[np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))]
    gap = (at[row] + j)[lead] - j
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (text[row[lead]][1:] != text[row[lead]][:-1]) | (gap[1:] != gap[:-1])])
    head = np.flatnonzero(cut)
    last = np.concatenate([head[1:], [len(row)]]) - 1
    source = pa.array(row[lead[head]])
    return pa.table({
        "content": table.column("content").take(pa.array(row[head])), "j": pa.array(j[head].astype("i4")), "last": pa.array(j[last].astype("i4")),
        "hash": pa.array(hashes[head]), "first": table.column("key").take(source), "of": table.column("version").take(source),
        "gap": pa.array(gap[head])})


def _pieces(spans: list[dict]) -> list[dict]:
    """Repeated windows joined into spans, less the paragraphs that are removed anyway."""
    gone = sorted((s["start"], s["end"]) for s in spans if not s["run"])
    joined: list[list] = []
    for s in sorted((s for s in spans if s["run"]), key=lambda s: (s["start"], s["end"])):
        if joined and s["start"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s["end"])
        else:
            joined.append([s["start"], s["end"], s["hash"], s["first"]])
    out, i = [], 0
    for start, end, mark, first in joined:
        while i < len(gone) and gone[i][1] <= start:
            i += 1
        k = i
        while start < end:
            cut = gone[k] if k < len(gone) and gone[k][0] < end else (end, end)
            if start < cut[0]:
                out.append({"start": start, "length": cut[0] - start, "hash": mark, "first": first})
            start, k = max(start, cut[1]), k + 1
    return out


def repeated_runs(docs: DataFrame, key: str, text: str, read: DataFrame | None = None) -> DataFrame:
    """(key, version, start, end, hash, first) of every RUN words in a row that an earlier place has word for word.

    Earlier is an earlier row, or an earlier place of the same text that doesn't overlap; `first` is the key of the
    row that has them first and `hash` names them. A text that another row has too is one span of all its words.
    """
    read = read or read_texts(docs, key, text)
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[key]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    # every text once, with its first row
    texts = store(read.where("members is null").groupBy("version").agg(
        F.min(F.struct("key")).alias("owner"), F.any_value("anchors").alias("anchors"), F.any_value("several").alias("several"),
        F.min("low").alias("low"), F.min("high").alias("high")), "texts", "zstd")
    found = texts.select("version", F.inline(F.arrays_zip("anchors", "several")).alias("anchor", "several"))
    shared = found.groupBy("anchor").agg(F.min("version").alias("a"), F.max("version").alias("b"), F.bool_or("several").alias("several"))
    shared = shared.where("a <> b or several").select("anchor")
    wanted = found.join(shared, "anchor").groupBy("version").agg(F.collect_list("anchor").alias("wanted"))
    wanted = wanted.join(texts.select("version", "owner"), "version").select(
        F.col("version").alias("v"), F.col("owner.key").alias("k"), "wanted")
    held = rows.join(wanted, rows["key"].eqNullSafe(wanted["k"]) & (rows["version"] == wanted["v"]))
    stretches = store(held.select("key", "version", "text", "wanted").mapInArrow(
        _stretches, f"key {kind}, version bigint, anchor bigint, content bigint, at bigint, hashes array<bigint>, "
        "starts array<int>, ends array<int>"),
        "stretches", "zstd")
    # the first place of equal stretches finds the first place of each of their windows, in the bucket of their anchor; windows of
    # anchors with very many stretches go to buckets of their own
    counts = stretches.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("anchor", F.lit(True).alias("hot"))
    buckets = F.lit(buckets_for(text_bytes(docs, text) / STRETCH_BYTES))
    firsts = stretches.groupBy("anchor", "content").agg(F.min(F.struct("key", "version", "at", "hashes")).alias("rep"))
    # at most one anchor for FREQUENT stretches: few at every size
    told = firsts.join(F.broadcast(counts), "anchor", "left").select("anchor", "content", "rep.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    names = ["content", "key", "version", "at"]
    calm = told.where("not hot").select(F.pmod(F.xxhash64("anchor"), buckets).alias("bucket"), *names, F.lit(0).alias("j"), "hashes")
    single = told.where("hot").select(*names, F.posexplode("hashes").alias("j", "hash"))
    single = single.select(F.pmod(F.xxhash64("hash"), buckets).alias("bucket"), *names, "j", F.array("hash").alias("hashes"))
    segments = calm.unionByName(single).groupBy("bucket").applyInArrow(
        _segments, f"content bigint, j int, last int, hash bigint, first {kind}, of bigint, gap bigint")
    own = F.col("key").eqNullSafe(F.col("first")) & (F.col("version") == F.col("of"))
    again = stretches.join(segments, "content").where(~own | (F.col("at") - F.col("gap") >= RUN)).select(
        "key", "version", F.get("starts", "j").cast("bigint").alias("start"), F.get("ends", "last").cast("bigint").alias("end"), "hash", "first")
    # other rows with the same text
    copies = rows.select("key", "version").distinct().join(texts.where("low is not null").select("version", "owner", "low", "high"), "version").where(
        ~F.col("key").eqNullSafe(F.col("owner.key"))).select(
        "key", "version", F.col("low").alias("start"), F.col("high").alias("end"), F.col("version").alias("hash"), F.col("owner.key").alias("first"))
    return again.unionByName(copies)


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The `removals`, and what is left of `repeated_runs` beside them: rows of the same columns without a place."""
    read = read_texts(docs, key, text)
    taken = store(removals(docs, key, text, read=read), "removals")
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[key]
    runs = repeated_runs(docs, key, text, read).select("key", "version", F.struct(
        F.lit(True).alias("run"), "start", "end", "hash", "first").alias("span"))
    lines = taken.select(F.col(key).alias("key"), "version", F.struct(
        F.lit(False).alias("run"), "start", (F.col("start") + F.col("length")).alias("end"), F.col("class_unit").alias("hash"),
        F.col(f"first_{key}").alias("first")).alias("span"))
    spans = runs.unionByName(lines).groupBy("key", "version").agg(F.collect_list("span").alias("spans")).where(
        F.exists("spans", lambda s: s["run"]))
    piece = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("hash", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pieces(s) for s in batch.column(2).to_pylist()]
            owner = pa.array([i for i, ps in enumerate(found) for _ in ps], pa.int64())
            flat_pieces = pa.array([[{k: p[k] for k in ("start", "length", "hash")} for ps in found for p in ps]], piece).flatten()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *flat_pieces.flatten(),
                 pa.array([p["first"] for ps in found for p in ps], batch.schema.field(0).type)],
                names=["key", "version", "start", "length", "hash", "first"])

    rest = spans.mapInArrow(cut, f"key {kind}, version bigint, start bigint, length bigint, hash bigint, first {kind}")
    return taken.unionByName(rest.select(
        F.col("key").alias(key), "version", F.lit(None).cast("int").alias("place"), "start", "length",
        F.col("hash").alias("class_unit"), F.col("first").alias(f"first_{key}")))


def deduplicated(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_removed, removed_chars, spans) of every row; spans are (start, length, class), by place."""
    taken = passages(docs, key, text).groupBy(F.col(key).alias("at"), "version").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", F.col("class_unit").alias("class")))).alias("spans"),
        F.sum("length").alias("chars"))
    rows = docs.select(F.col(key), F.xxhash64(text).alias("own"))
    joined = rows.join(taken, rows[key].eqNullSafe(taken["at"]) & (rows["own"] == taken["version"]), "left")
    return joined.select(key, F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_removed"),
                         F.coalesce("chars", F.lit(0)).cast("bigint").alias("removed_chars"),
                         F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint,class:bigint>>"))
                         .alias("spans"))


def kept_text(text: Column, spans: Column) -> Column:
    """The text without its removed spans."""
    cuts = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"),
                                     F.lit(0).cast("bigint").alias("class"))), spans)
    ends = F.transform(cuts, lambda s: s["start"] + s["length"])
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    return F.concat_ws("", F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage to remove: where it is, its class and the document that keeps it."""
    found = passages(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "place", "start", "length", F.col("class_unit").alias("class_id"), "first_doc_id")

"""SimHash, repeated bytes, repeated passages, vectors, and what they share, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import odd_rows, prose, table
from tieout.llm import exactdup, paragraphs, simhash, vectors
from tieout.llm.chunks import squeezed, unsqueezed
from tieout.llm.suffixarray import suffix_arrays
from tieout.operators.components import components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_hubs_and_random_edges(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1001 + i) for i in range(400)]
    some = [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)]
    edges = chain + hub + some + [(7, 7)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: sets.find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@given(st.lists(st.integers(-2**63, 2**63 - 1), max_size=50))
def test_byte_planes_round_trip(values):
    array = np.array(values, "i8")
    assert unsqueezed(squeezed(array)).view("i8").tolist() == values
    rising = np.sort(array.view("u8"))
    assert unsqueezed(squeezed(rising, rising=True), rising=True).tolist() == rising.tolist()


# --- SimHash

def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _near_copies():
    rng = random.Random(8)
    rows = []
    for group in range(12):
        words = prose(group + 50, 400).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = _near_copies() + odd_rows()
    got = simhash.near_duplicates(table(spark, rows), "doc_id", "text").collect()
    prints = [_fingerprint(t) for _, t in rows]
    sets, linked = Sets(), 0
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
                linked += prints[i] != prints[j]
    assert linked > 5
    least = defaultdict(lambda: None)
    for i, (key, _) in enumerate(rows):
        root = sets.find(i)
        if key is not None and (least[root] is None or key < least[root]):
            least[root] = key
    want = Counter((key, prints[i], least[sets.find(i)]) for i, (key, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(table(spark, []), "doc_id", "text").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5)), min_size=1, max_size=12),
       st.sampled_from([64, 2_000_000]))
def test_meeting_variants_join_exactly_the_close(seeds, held):
    prints = sorted({base ^ f for base, bits in seeds for f in (0, sum(1 << b for b in set(bits)))})
    _, flips = simhash._ball()
    array = np.array(prints, "u8")
    sent = sorted((int(simhash._folded(array[i:i + 1])[0]) ^ step, p) for i, p in enumerate(prints) for step in flips)
    a, b = simhash._met(np.array([s[0] for s in sent], "i4"), np.array([s[1] for s in sent], "u8"), flips, held)
    got, want = Sets(), Sets()
    for x, y in zip(a.view("u8").tolist(), b.view("u8").tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        got.join(x, y)
    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= 4:
                want.join(x, y)
    assert [got.find(p) for p in prints] == [want.find(p) for p in prints]


def test_one_row_of_each_group_stays(spark):
    rows = [(3, prose(1, 90)), (1, prose(1, 90)), (1, prose(1, 90)), (None, prose(1, 90)), (5, None), (6, ""), (None, prose(2, 90))]
    got = simhash.one_of_each(table(spark, rows), "doc_id", "text")
    assert got.columns == table(spark, []).columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 5, None])


# --- repeated bytes

@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 1 for x in b)), min_size=1, max_size=5))
def test_suffix_arrays_equal_sorting(strings):
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), "u1")
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    got = suffix_arrays(data, starts, sizes)
    for s, n in zip(starts, sizes, strict=True):
        assert got[s:s + n].tolist() == sorted(range(s, s + n), key=lambda i: bytes(data[i:s + n]))


def _brute_bytes(rows):
    first, out = {}, Counter()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, text in order:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p:p + 50], float("inf") if key is None else key)
    for key, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < (float("inf") if key is None else key):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("string", "frequent"), [(200, 5000), (1 << 15, 3)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, string, frequent):
    monkeypatch.setattr(exactdup, "STRING", string)
    monkeypatch.setattr(exactdup, "FREQUENT", frequent)
    monkeypatch.setattr(exactdup, "PIECE", 5000)
    monkeypatch.setattr(exactdup, "CHUNK", 40_000)
    rng = random.Random(6)
    passage = [prose(70 + k, 25) for k in range(4)]
    rows = odd_rows() + _near_copies()[:12]
    for k in range(60):
        words = prose(k + 200, 40).split()
        at = rng.randrange(40)
        rows.append((k + 500, " ".join([*words[:at], passage[k % 4], *words[at:]])))
    rows.append((900, "ab" * 200))
    rows.append((901, "b" + "ab" * 100 + "é" * 60))
    got = exactdup.remove_repeats(table(spark, rows), "doc_id", "text").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _brute_bytes(rows)
    assert all((r.kept_text is None) == (r.n_bytes == 0 and r.doc_id in (1, None)) for r in got)
    assert exactdup.remove_repeats(table(spark, []), "doc_id", "text").count() == 0


# --- repeated passages

def _brute_passages(rows):
    seen, units, occurrences = {}, {}, []
    for key, text in sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for place, (start, end, words) in enumerate(paragraphs.paragraphs(text)):
            if len(words) >= paragraphs.MIN_WORDS:
                occurrences.append((key, place, start, end - start, units.setdefault(" ".join(words), len(units))))
    sets = [{tuple(u.split()[i:i + 5]) for i in range(len(u.split()) - 4)} for u in units]
    joined = Sets()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                joined.join(i, j)
    out = set()
    for key, place, start, length, unit in occurrences:
        if joined.find(unit) in seen:
            out.add((key, place, start, length, seen[joined.find(unit)]))
        else:
            seen[joined.find(unit)] = key
    return out


def test_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    shared = [prose(300 + k, 70) for k in range(5)]
    rows = [(k, t) for k, t in odd_rows() if t is None or len(t) < 60_000]
    for k in range(50):
        passage = shared[k % 5].split()
        if k % 3:
            passage[rng.randrange(len(passage))] = "edited"
        words = prose(k + 400, 50).split()
        rows.append((k + 100, " ".join(words[:20]) + "\n" + " ".join(passage) + "\n" + " ".join(words[20:])))
    want = _brute_passages(rows)
    for block in (2000, 3):
        monkeypatch.setattr(paragraphs, "BLOCK", block)
        got = paragraphs.removals(table(spark, rows), "doc_id", "text").collect()
        assert {(r.doc_id, r.place, r.start, r.length, r.first_doc_id) for r in got} == want
    whole = paragraphs.deduplicated(table(spark, rows), "doc_id", "text")
    assert whole.count() == len(rows)
    assert paragraphs.removals(table(spark, []), "doc_id", "text").count() == 0


def _brute_runs(rows):
    """The characters of 50 words in a row that an earlier row, or place of the row, has."""
    first, out = {}, defaultdict(set)
    for key, text in sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        for at in range(len(found) - 49):
            window = tuple(w for w, _, _ in found[at:at + 50])
            owner, place = first.setdefault(window, (key, at))
            if owner != key or at >= place + 50:
                out[key] |= set(range(found[at][1], found[at + 49][2]))
    return out


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_passages_inside_lines_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(paragraphs, "FREQUENT", frequent)
    rng = random.Random(17)
    shared = [prose(2300 + k, 70).replace(".", "") for k in range(5)]
    rows = [(k, t) for k, t in odd_rows() if t is None or len(t) < 20_000] + [(60, "same " * 130)]
    for k in range(40):
        words, passage = prose(k + 2400, 60).replace(".", "").split(), shared[k % 5].split()
        if k % 4 == 3:
            passage.insert(rng.randrange(len(passage)), "edited")
        if k % 4 == 2:
            passage = "\n".join([" ".join(passage[:30]), " ".join(passage[30:])]).split(" ")
        at = rng.randrange(60)
        rows.append((k + 100, " ".join([*words[:at], *passage, *words[at:]])))
    rows += [(200, prose(2500, 80) + " " + shared[0] + " so. " + shared[0]), (201, rows[-1][1])]
    want, lines = _brute_runs(rows), paragraphs.removals(table(spark, rows), "doc_id", "text").collect()
    for r in lines:
        want[r.doc_id] |= set(range(r.start, r.start + r.length))
    found = paragraphs.passages(table(spark, rows), "doc_id", "text").collect()
    assert {tuple(r) for r in lines} == {tuple(r) for r in found if r.place is not None}
    got, total = defaultdict(set), Counter()
    for r in found:
        got[r.doc_id] |= set(range(r.start, r.start + r.length))
        total[r.doc_id] += r.length
    assert {k: v for k, v in want.items() if v} == got
    assert all(total[k] == len(v) for k, v in got.items())  # no character twice
    assert sum(r.place is None and r.doc_id is not None and 100 <= r.doc_id < 140 for r in found) > 15
    assert paragraphs.passages(table(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("together", [32, 3, 1])
def test_small_keys_are_compared_together(monkeypatch, together):
    """Keys of one to nine members in one bucket; members of different keys are never compared."""
    monkeypatch.setattr(paragraphs, "TOGETHER", together)
    rng, rows, want = random.Random(31), [], Sets()
    for key in range(60):
        base, own = rng.sample(range(400), 20), []
        for _ in range(rng.randrange(1, 10)):
            own.append(sorted(set(base[:rng.choice((20, 19, 12))] + rng.sample(range(400), rng.randrange(3)))))
        for k, x in enumerate(own):
            rows.append((key // 2, 0, key % 2, key * 10 + k, x))
            for j in range(k):
                if len(set(x) & set(own[j])) >= 0.8 * len(set(x) | set(own[j])) - 1e-9:
                    want.join(key * 10 + k, key * 10 + j)
    rng.shuffle(rows)
    table = pa.table({n: pa.array([r[i] for r in rows], pa.list_(pa.int64()) if n == "shingles" else pa.int64())
                      for i, n in enumerate(("key", "i", "j", "unit", "shingles"))})
    got = Sets()
    for r in paragraphs._links(table, 0.8).to_pylist():
        got.join(r["a"], r["b"])
    same = {(a, b) for *_, a, _ in rows for *_, b, _ in rows if want.find(a) == want.find(b)}
    assert same == {(a, b) for *_, a, _ in rows for *_, b, _ in rows if got.find(a) == got.find(b)} and len(same) > 1.5 * len(rows)


def test_band_keys_are_sent_by_their_lower_half():
    keys = np.array([[5 << 32 | 7, (1 << 63) + 9], [5 << 32 | 7, 5 << 32 | 8]], "u8")
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2]], pa.list_(pa.int64())), pa.array([keys.ravel().view("i8")], pa.list_(pa.int64()))],
                                       names=["members", "keys"])
    sent = pa.Table.from_batches(paragraphs._sent(iter([batch]), 2, 8))
    assert sent.schema.field("keys").type == pa.list_(pa.int32())
    held = [paragraphs._met(sent.slice(k, 1)).to_pylist() for k in range(sent.num_rows)]
    assert sorted((r["key"], r["unit"]) for part in held for r in part) == [(7, 1), (7, 2)]


def test_words_and_paragraphs_of_letters_that_depend_on_their_neighbours():
    rng = random.Random(8)
    signs = "aB1_ .\n!?\"')]éÉßİΣσςΟ'ÀЖ中\u0301\u200b\u2019\U0001d400"
    texts = ["", "\n", "\n\n", "a.", "ΟΔΟΣ. ΣΑΣ\u2019Σ", *("".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(2000))]
    for text in texts:
        assert paragraphs.words_of(text) == [w.lower() for w in re.findall(r"\w+", text)]
        assert [m.span() for m in re.finditer(r"\w+", text)] == list(zip(*(b.tolist() for b in paragraphs._bounds(text)), strict=True))
        found = paragraphs.paragraphs(text)
        assert [s for s, _, _ in found] == [0, *(e for _, e, _ in found)][:len(found)]
        assert [w for *_, own in found for w in own] == paragraphs.words_of(text) and (not text or found[-1][1] == len(text))


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.99), (0.8, 0.999), (0.6, 0.9)):
        bands = paragraphs.bands_for(similarity, recall)
        assert 1 - (1 - similarity ** 3) ** bands >= recall > 1 - (1 - similarity ** 3) ** (bands - 1)


def test_kept_text_lacks_the_spans(spark):
    spans = "array<struct<start:bigint,length:bigint,class:bigint>>"
    rows = spark.createDataFrame([("abcdéfgh", [(1, 2, 0), (4, 1, 0)]), ("abc", []), ("", [])], f"text string, spans {spans}")
    assert [r[0] for r in rows.select(paragraphs.kept_text(F.col("text"), F.col("spans"))).collect()] == ["adfgh", "abc", ""]


# --- vectors

def _vectors():
    rng = np.random.default_rng(9)
    rows = []
    for base in rng.normal(size=(150, 32)):
        rows += [base + rng.normal(size=32) * s for s in rng.uniform(0, 0.4, rng.integers(1, 5))]
    dense = rng.normal(size=32)
    rows += [dense + rng.normal(size=32) * 0.05 for _ in range(300)]
    return [(k, [float(x) for x in v.astype("f4")]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "HELD", 500)
    rows = _vectors()
    rows += [(5000 + k, rows[k][1]) for k in range(0, 60, 7)] + [(3, rows[3][1])]  # copies, and a repeated row
    odd = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [1.0] * 31 + [None]), (9004, [float("nan")] * 32),
           (9005, [float("inf")] * 32), (9006, rows[0][1][:16]), (None, rows[0][1])]
    frame = spark.createDataFrame([(k, v, k, 1, "x") for k, v in rows + odd],
                                  "vec_id bigint, embedding array<float>, rep bigint, n int, cell string")
    got = vectors.near_duplicates(frame, "vec_id", "embedding").collect()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    sets = Sets()
    for i, j in zip(*np.nonzero(close), strict=True):
        sets.join(rows[i][0], rows[j][0])
    want = Counter((rows[i][0], int(close[i].sum()) - 1, sets.find(rows[i][0])) for i in range(len(rows)))
    want.update((k, 0, k) for k, _ in odd)
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    same = sum((want & found).values())
    assert len(got) == len(rows) + len(odd) and same >= 0.98 * len(got)
    assert all(r.n_links == 0 for r in got if r.vec_id is None or r.vec_id >= 9000)
    links = sum(r.n_links for r in got)
    assert 0.99 * (close.sum() - len(rows)) <= links <= close.sum() - len(rows)
    assert vectors.near_duplicates(frame.limit(0), "vec_id", "embedding").count() == 0


def test_calibration_follows_the_threshold():
    half, count = vectors.calibrated(0.95)
    assert 0 < half < 1 and 15 < count < vectors.PROJECTIONS
    sizes = [vectors.tables_for(n, 0.95) for n in (10, 10**4, 10**6, 10**9)]
    assert sizes == sorted(sizes)

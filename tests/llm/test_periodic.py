"""Runs of repeated words."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tests.llm.cases import odd_rows, prose, table
from tieout.llm import periodic


def _brute(words, min_length=6, times=4):
    """Maximal stretches of each period, smallest period only."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, times * q) and not any(
                    all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found[i, length, q] = True
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3), (10, 2)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(5)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], list("aab" * 30 + "aac" * 9 + "abab" * 20)]
    for kinds in (1, 2, 3, 5):
        for _ in range(60):
            one = rng.choices("abcde"[:kinds], k=rng.randint(0, 40))
            for _ in range(rng.randint(0, 3)):
                a = rng.randint(0, len(one))
                one[a:a] = rng.choices("abcde"[:kinds + 1], k=rng.randint(1, 6)) * rng.randint(1, 9)
            texts.append(one)
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    texts.append(list(fib[-1]))
    assert periodic.runs_of(texts, *limits) == [_brute(t, *limits) for t in texts]


def test_many_places_of_one_class(monkeypatch):
    monkeypatch.setattr(periodic, "FEW", 1)
    rng = random.Random(9)
    texts = [sum(([*"xyzuvw"] * rng.randint(1, 5) + [str(rng.randint(0, 2))] for _ in range(30)), []) for _ in range(4)]
    assert periodic.runs_of(texts) == [_brute(t) for t in texts]


def _plant(key, words):
    h = crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def _row(key, text):
    words = _plant(key, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = _brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(k, t if t is None or len(t) < 3000 else t[:3000]) for k, t in odd_rows()]
    rows += [(k, prose(k, 20 + k % 90, kinds=12)) for k in range(100, 260)] + [(600 + k, "ha " * (40 + k) + "\x1f x") for k in range(20)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(_row(k, t) for k, t in rows)
    assert sum(n for r, n in got.items() if r[1]) > 20
    assert periodic.find_runs(table(spark, []), "doc_id", "text").count() == 0


def test_long_texts_of_one_word():
    assert periodic.runs_of([["a"] * 60_000, ["a", "b", "c"] * 20_000]) == [[(0, 60_000, 1)], [(0, 60_000, 3)]]

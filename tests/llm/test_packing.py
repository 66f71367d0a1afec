"""Sequences of a fixed length from documents."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.cases import odd_rows, prose, table
from tieout.llm import packing
from tieout.llm.bpe import Codec

FILE = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _hold(counts, capacity):
    """Every remainder lies wholly in pieces, and every sequence is full without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for length, first, ranks, start, size, sequence, offset in packing.placements(counts, capacity):
        for k in range(ranks):
            pieces[length, first + k].append((start, size))
            sequences[sequence + k].append((offset, size))
    assert set(pieces) == {(length, k) for length, n in counts.items() for k in range(n)}
    for (length, _), parts in pieces.items():
        ends = [0]
        for start, size in sorted(parts):
            assert start == ends[-1] and size > 0
            ends.append(start + size)
        assert ends[-1] == length
    assert set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end == capacity or end & (end - 1) == 0 and end < capacity
    return sequences


@pytest.mark.parametrize("seed", range(8))
def test_histograms_are_packed_without_padding(seed):
    rng = random.Random(seed)
    capacity = (64, 100, 2048)[seed % 3]
    counts = {rng.randint(1, capacity - 1): rng.randint(0, 40) for _ in range(rng.randint(0, 60))}
    sequences = _hold(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    assert len(sequences) == total // capacity + bin(total % capacity).count("1")


def test_longest_go_to_the_shortest_packs():
    """Without a need to cut, lengths pair up as in the worked case: 6 and 5 open packs, 5 goes beside 5, 2 twice beside 6."""
    assert packing.placements({6: 1, 5: 2, 2: 2}, 10) == [
        (6, 0, 1, 0, 6, 0, 0), (5, 0, 1, 0, 5, 1, 0), (5, 1, 1, 0, 5, 1, 5), (2, 0, 1, 0, 2, 0, 6), (2, 1, 1, 0, 2, 0, 8)]
    assert packing.placements({}, 10) == []


def test_ids_are_those_of_the_library(library):
    codec = Codec(packing.byte_ranks(FILE), public_tokenizers.PATTERN)
    rng = random.Random(4)
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u180e", "a", "'s", "'", "9", "é", "漢", "\u0558", "\u208f", "🙂",
             "<|endoftext|>", ".", "\U00010940"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["x" * 30_000, " " * 5000, prose(3, 500)]
    # every character of the first two planes, beside letters, digits, signs, spaces and itself
    texts += ["".join(f"a{c}a 1{c}1 !{c}! {c} {c}{c}the" for c in map(chr, range(at, at + 4096)))
              for at in range(0, 0x20000, 4096) if not 0xD000 <= at < 0xE000]
    for text in texts:
        assert codec.encode(text).tolist() == library(text)


@pytest.mark.parametrize("rows_sent", [100_000, 0])
def test_query_holds_every_id_once(spark, tmp_path, monkeypatch, library, rows_sent):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", rows_sent)
    rows = odd_rows() + [(100 + k, prose(k, 10 + 37 * k)) for k in range(60)]
    table(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op11_packed_sequences(spark, str(tmp_path)).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([size for _, size in sorted(parts)])
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < 2048
    total = sum(r.length for r in got)
    assert len(sequences) == total // 2048 + bin(total % 2048).count("1") and max(sequences) == len(sequences) - 1
    want = defaultdict(Counter)
    for key, text in rows:
        want[key][tuple([*library(text or ""), 1])] += 1
    for key, texts in want.items():
        mine = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == key)
        for ids, copies in texts.items():  # each piece is some stretch of one of the id's texts
            raw = np.array(ids, "<u4").tobytes()
            own = {p: n for p, n in mine.items() if p[3] == len(ids) and zlib.crc32(raw[4 * p[0]:4 * (p[0] + p[1])]) == p[2]}
            assert sum(p[1] * n for p, n in own.items()) >= copies * len(ids)
        assert sum(p[1] * n for p, n in mine.items()) == sum(len(ids) * n for ids, n in texts.items())
    assert packing.pack(table(spark, []), "doc_id", "text", FILE).count() == 0

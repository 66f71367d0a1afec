"""Decontamination and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import odd_rows, prose, table
from tieout.llm import decontaminate, nearcopies, simhash, toxicity


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _shingles(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def _brute(rows, items):
    out = {}
    for key, text in rows:
        words = _tokens(text)
        for item, body in items:
            own = _tokens(body)
            if not own or not words:
                continue
            target, best = _shingles(own), 0.0
            for start in range(max(1, len(words) - len(own) + 1)):
                window = _shingles(words[start:start + len(own)])
                best = max(best, sum((window & target).values()) / sum((window | target).values()))
            if best >= 0.8:
                out[key, item] = round(best, 9)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    items = [(k, prose(600 + k, rng.randint(6, 60))) for k in range(25)] + [(90, None), (91, ""), (92, "two words"), (None, prose(599, 30))]
    rows = [(k, t) for k, t in odd_rows() if not t or len(t) < 20_000] + [(200, "Two, WORDS"), (201, items[3][1]), (None, items[4][1])]
    for k in range(40):
        body = prose(k + 700, 60).split()
        passage = (items[k % 25][1] if k % 4 else prose(599, 30)).upper().split()
        if len(passage) > 50:
            passage[rng.randrange(len(passage))] = "edited"
        rows.append((k + 300, " ".join([*body[:20], *passage, *body[20:]])))
    bench = spark.createDataFrame([(k, t, 1, 2) for k, t in items], "item_id bigint, text string, size int, start int")
    got = decontaminate.matches(table(spark, rows), "doc_id", "text", bench, "item_id", "text").collect()
    want = _brute(rows, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert len(want) > 35
    assert decontaminate.matches(table(spark, []), "doc_id", "text", bench, "item_id", "text").count() == 0
    assert decontaminate.matches(table(spark, rows), "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


def test_best_window_may_start_between_alignments(spark):
    rng = random.Random(31)
    item = [f"w{i}" for i in range(100)]
    items = [(1, " ".join(item)), (2, prose(1700, 40, 12)), (3, "one two three four five six seven")]
    outside = [f"x{i}" for i in range(80)]
    rows = [(1, " ".join([*outside, "a", "b", "c", *item[3:50], *outside[:6], *item[50:97], "d", "e", "f", *outside]))]
    for k in range(2, 40):
        copy = (items[k % 2][1]).split()
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(copy))
            copy[at:at + rng.randint(0, 1)] = [f"y{i}" for i in range(rng.randint(0, 4))]
        rows.append((k, " ".join([*outside[:rng.randint(0, 30)], *copy, *outside[:rng.randint(0, 5)]])))
    rows += [(50, "one two three four five six"), (51, items[1][1] + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.matches(table(spark, rows), "doc_id", "text", bench, "item_id", "text").collect()
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got}
    assert found[1, 1] == round(86 / 106, 9)
    assert found == _brute(rows, items)
    assert len(found) > 7


def _word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("held", [500_000, 400])
def test_near_copies_of_the_stage_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(nearcopies, "HELD", held)
    rng = random.Random(21)
    rows = [r for r in odd_rows() if not r[1] or len(r[1]) < 20_000] + [(50, "a b c"), (51, "A  b\nc"), (52, "a b d")]
    for group in range(10):
        words = prose(group + 1500, 300).split()
        for k in range(0, 16, 2):
            copy = list(words)
            for at in rng.sample(range(300), k):  # similarity 1 down to about 0.6 between two
                copy[at] = f"changed{k}"
            rows.append((group * 100 + 1000 + k, " ".join(copy)))
    sets = [_word_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    close = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                close += x != y
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        order = (key is None, key or 0)
        least[root(i)] = min(least.get(root(i), order), order)
    got = nearcopies.one_of_each(table(spark, rows), "doc_id", "text")
    assert got.columns == table(spark, []).columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(None if none else key for none, key in least.values())
    assert close > 30
    assert nearcopies.one_of_each(table(spark, []), "doc_id", "text").count() == 0


def test_stage_drops_verified_near_copies_only(spark):
    words = prose(1600, 200).split()
    near, far = list(words), list(words)
    near[50] = near[100] = near[150] = "changed"  # similarity (196 - 15) / (196 + 15) = 0.858
    for at in range(10, 190, 20):
        far[at] = "changed"  # 9 changes: (196 - 45) / (196 + 45) = 0.627
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = table(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3}


def test_stage_links_by_simhash_groups(spark, monkeypatch):
    """Without any band, fingerprints within 4 bits bring candidates together, and the exact check follows."""
    whole = nearcopies.signatures
    monkeypatch.setattr(nearcopies, "signatures", lambda *a: whole(*a).withColumn("bands", F.array().cast("array<bigint>")))
    words = prose(1700, 2000, 3000).split()
    near = [*words[:-1], "changed"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, prose(1701, 300)), (4, None), (5, " ")]
    assert sum(simhash.fingerprint(t) != simhash.fingerprint(rows[0][1]) for _, t in rows[:2]) <= 1
    kept = nearcopies.one_of_each(table(spark, rows), "doc_id", "text")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4}


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 150)
    rng = random.Random(3)
    rows = [(k, prose(k + 900, 120)) for k in range(120)]
    toxic = {k for k in range(120) if k % 5 == 0}
    rows = [(k, " ".join("scumbag" if k in toxic and i % 30 == 7 else w for i, w in enumerate(t.split()))) for k, t in rows]
    item = prose(5000, 40)
    rows += [(200, prose(901, 120)), (201, prose(5001, 60) + " " + item + " " + prose(5002, 60)), (202, None), (203, ""), (None, "x y")]
    passage = prose(5003, 60)
    rows += [(210, prose(5004, 50) + " " + passage + " " + prose(5005, 50)), (211, prose(5006, 70) + " " + passage)]
    frame = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), [k]) for k, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint, row array<bigint>")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), toxic, passage


def test_stages_take_effect_and_keep_the_rest(spark, folder):
    sf_dir, toxic, passage = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, defaultdict(set)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), f"test-{name}")
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.schema == before.schema
        seen[name] = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(seen["toxicity"] & toxic) >= 0.9 * len(toxic) and len(seen["toxicity"] - toxic) <= 2
    assert 200 in seen["simhash"] | seen["toxicity"] and seen["simhash"] <= {200, 203}
    assert not seen["suffix_array"] and seen["decontamination"] == {201} and not seen["bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert passage in texts[210] and passage not in texts[211] and texts[202] is None
    assert docs.columns[:len(columns)] == columns
    assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_equals_its_stages_on_empty_tables(spark, folder, tmp_path):
    sf_dir = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0

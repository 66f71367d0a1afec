"""The run against a plain sequential walk, with hot keys, copies and odd amounts."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_scalars import step
from tieout import model
from tieout.model import Books
from tieout.operators import claims, invoices, linking, scoring
from tieout.plans.reconcile import reconcile

DAY = dt.date(2024, 3, 4)


def make(spark, inv, pay, stl, bank, parts=3):
    settlement = model.SETTLEMENT.replace("ord bigint", "payment_ids array<string>, ord bigint")
    frames = [spark.createDataFrame(rows, schema).repartition(parts) for rows, schema in
              ((inv, model.INVOICE), (pay, model.PAYMENT), (stl, settlement), (bank, model.BANK_LINE))]
    return Books.from_records(*frames)


def random_books(seed, n=40):
    """Small books in which one reference, one invoice and one amount are very common."""
    r = random.Random(seed)
    inv, pay, stl, bank = [], [], [], []
    for i in range(n):
        ref = r.choice([f"R{i}", f"R{i}", "HOT", None, ""])
        amount = r.choice([10_000 + i * 997, 50_000, 0, -100 if i % 9 == 0 else 70_000 + i])
        inv.append((f"I{i}", f"N{i}", "c", amount, DAY + dt.timedelta(days=r.randint(0, 9)), ref, len(inv)))
    for i in range(n):
        status = r.choice(["captured"] * 4 + ["refunded", "disputed", "failed"])
        source = inv[r.randrange(n)]
        gross = max(1, source[3] + r.choice([0, 0, 150, -200])) if r.random() < .9 else 0
        pay.append((f"P{i}", None, r.choice([f"R{i}", f"R{i}", "HOT", None, "R0"]), gross, 10, 2, gross - 12, status,
                    dt.datetime.combine(DAY + dt.timedelta(days=r.randint(0, 12)), dt.time(9)), "upi", None, len(pay)))
    by_id = {p[0]: p for p in pay}
    for i in range(n // 3):
        ids = [f"P{r.randrange(n)}" for _ in range(r.randint(0, 3))]
        if r.random() < .1:
            ids.append("P_unknown")
        known = [by_id[p] for p in ids if p in by_id]
        total = sum(p[3] for p in known) - sum(p[3] for p in known if p[7] in ("refunded", "disputed"))
        payout = total - 12 * len(known) + (7 if r.random() < .15 else 0)
        utr = r.choice([f"UTR{100000000 + i}", f"UTR{100000000 + i}", "UTR900000000", None])
        stl.append((f"S{i}", utr, payout, 10 * len(known), 2 * len(known), 0, DAY, ids, len(stl)))
        for _ in range(r.choice([1, 1, 1, 2, 0])):
            bank.append((f"B{len(bank)}", DAY + dt.timedelta(days=r.choice([0, 2, 30])),
                         f"neft utr no: {(utr or 'UTR1')[3:]} x", payout, 0, 0, len(bank)))
    if r.random() < .5:  # a later copy of an id replaces the first
        inv.append(inv[3][:3] + (inv[3][3] + 500,) + inv[3][4:6] + (len(inv),))
    return inv, pay, stl, bank


def walk(inv, pay, stl, bank):
    """One settlement after the other."""
    invoices_by_id, payments = {i[0]: i for i in inv}, {p[0]: p for p in pay}
    refs = defaultdict(list)
    for i in inv:
        if i[5]:
            refs[i[5]].append(i[0])
    lines = {b[0]: b for b in bank}

    def invoice_of(p):
        hits = refs.get(p[2], []) if p[2] else []
        if hits:
            return hits[0] if len(hits) == 1 else None
        fits = []
        for i in invoices_by_id.values():
            band = (p[3] == 0) if i[3] == 0 else abs(i[3] - p[3]) * 10000 // i[3] <= 300
            if band and step(i[4], -5) <= p[8].date() <= step(i[4], 5):
                fits.append(i[0])
        return fits[0] if len(fits) == 1 else None

    groups, status, taken = {}, {}, set()
    for s in stl:
        own = [b for b in lines.values() if s[1] and len(s[1]) >= 12 and b[2].split(": ")[1].split(" ")[0] == s[1][3:]
               and b[3] == s[2]]
        if len(own) != 1:
            status[s[0]] = "ambiguous" if own else "unmatched"
            continue
        if abs((own[0][1] - s[6]).days) > 5:
            status[s[0]] = "late"
            continue
        status[s[0]] = "linked"
        if any(p not in payments for p in s[7]):
            continue
        members = [payments[p] for p in s[7]]
        found = {invoice_of(p) for p in members} - {None}
        total = sum(p[3] for p in members) - sum(p[3] for p in members if p[7] in ("refunded", "disputed"))
        keys = {("i", x) for x in found} | {("p", p) for p in s[7]} | {("b", own[0][0])}
        if s[2] != total - s[3] - s[4] + s[5] or keys & taken:
            continue
        taken |= keys
        groups[s[0]] = (own[0][0], frozenset(found), frozenset(s[7]))
    return groups, status


@pytest.mark.parametrize("seed", range(4))
def test_run_equals_sequential_walk(spark, seed):
    data = random_books(seed)
    books = make(spark, *data, parts=1 + seed)
    run = reconcile(books)
    held = defaultdict(lambda: defaultdict(set))
    for m in run.members.collect():
        held[m.group_id][m.kind].add(m.id)
    ours = {g.id: (g.bank_line_id, frozenset(held[g.id]["invoice"]), frozenset(held[g.id]["payment"]))
            for g in run.groups.collect()}
    groups, status = walk(*data)
    assert ours == groups
    assert {o.settlement_id: o.link_status for o in run.outcomes.collect()} == status
    for row in scoring.accounting(books, run.members, run.exceptions).collect():
        assert row.unaccounted == 0 and row.in_both == 0
        assert row.matched_amount + row.open_amount == row.total_amount


def greedy(proposals):
    taken, rejected = set(), set()
    for prop, keys in sorted(proposals.items()):
        if keys & taken:
            rejected.add(prop)
        else:
            taken |= keys
    return rejected


def test_claims_equal_greedy(spark):
    r = random.Random(5)
    proposals = {p: {f"k{r.randint(0, 60)}" for _ in range(r.randint(1, 3))} for p in range(60)}
    proposals.update({100 + i: {f"c{i}", f"c{i + 1}"} for i in range(6)})  # a chain, worst for rounds
    proposals.update({200 + i: {"hot", f"h{i}"} for i in range(40)})
    rows = spark.createDataFrame([(p, "payment", k) for p, ks in proposals.items() for k in ks], "prop long, kind string, id string")
    valid = spark.createDataFrame([(p,) for p in proposals], "prop long")
    found = {x.prop for x in claims.rejected_proposals(rows, valid).collect()}
    assert found == greedy(proposals)
    held = {"hot", "c3", "k7"}
    found = {x.prop for x in claims.rejected_proposals(rows, valid, spark.createDataFrame(
        [("payment", k) for k in held] + [("invoice", "k8")], "kind string, id string")).collect()}
    lost = {p for p, keys in proposals.items() if keys & held}
    assert found == lost | greedy({p: keys for p, keys in proposals.items() if p not in lost})


def test_long_chain_of_claims_settles(spark):
    """Every proposal shares a record with the next: each second one loses."""
    rows = spark.range(100_000).select(F.col("id").alias("prop"), F.lit("payment").alias("kind"), F.explode(
        F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).alias("id"))
    lost = claims.rejected_proposals(rows, rows.select("prop").distinct())
    assert lost.agg(F.count("*"), F.sum("prop"), F.min(F.col("prop") % 2)).first() == (50_000, 2_500_000_000, 1)


def test_band_candidates_equal_brute_force(spark):
    r = random.Random(3)
    inv = [(DAY + dt.timedelta(days=r.choice([0, 0, 0, r.randint(0, 20)])),
            r.choice([100_000, r.randint(1, 300), r.randint(90_000, 110_000), 2**40 + r.randint(0, 2**35), 0, -7]), i)
           for i in range(300)]
    probes = [(DAY + dt.timedelta(days=r.randint(-3, 25)), r.choice([100_000, 0, -5, r.randint(1, 300), 2**40, r.randint(90_000, 110_000)]))
              for _ in range(120)]
    frame = spark.createDataFrame(inv, "issued_at date, amount long, ord long").repartition(5)
    found = invoices.band_candidates(spark.createDataFrame(probes, "captured_on date, gross long"), frame).collect()
    ours = {(f.captured_on, f.gross): (f.band_hits, f.band_ord if f.band_hits == 1 else None) for f in found if f.band_hits}
    expected = {}
    for day, gross in set(probes):
        fits = [i[2] for i in inv if step(i[0], -5) <= day <= step(i[0], 5)
                and ((gross == 0) if i[1] == 0 else abs(i[1] - gross) * 10000 // i[1] <= 300)]
        if fits:
            expected[(day, gross)] = (len(fits), fits[0] if len(fits) == 1 else None)
    assert ours == expected


def test_repartitioning_changes_nothing(spark):
    data = random_books(11)
    hashes = {scoring.output_hash(run.groups, run.members).first().output_hash
              for run in (reconcile(make(spark, *data, parts=p)) for p in (1, 6))}
    assert len(hashes) == 1


def test_link_plan_has_no_nested_loop(spark):
    books = make(spark, *random_books(1))
    plan = linking.link_settlements(books)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Figures over many runs, and hashes of results."""

import hashlib
import random
from statistics import median

import pytest

from tieout.model import AnswerKey, Books
from tieout.operators import scoring
from tieout.operators.constraints import Disjoint, Listed, Unique, breaches
from tieout.vocab import UNMATCHABLE


def test_medians_of_a_label_that_holds_nearly_all_rows(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.5, 2.0, rng.random()])) for _ in range(901)] + [("hot", None)] * 20
    rows += [("even", 4.0), ("even", 1.0), ("one", 7.0), ("none", None), (None, 3.0), (None, 5.0)]
    got = {r.label: r.median for r in scoring.exact_medians(spark.createDataFrame(rows, "label string, value double"), "label", "value").collect()}
    assert got == {"hot": median(v for k, v in rows if k == "hot" and v is not None), "even": 2.5, "one": 7.0, None: 4.0}
    assert scoring.exact_medians(spark.createDataFrame([], "label string, value double"), "label", "value").count() == 0


def _tree(leaves):
    nodes = [(x, x) for x in leaves]
    for digits in (4, 2, 0):
        held = {}
        for spot, node in nodes:
            held.setdefault(spot[:digits], []).append(spot + node)
        nodes = [(spot, hashlib.sha256("".join(sorted(own)).encode()).hexdigest()) for spot, own in held.items()]
    return nodes[0][1]


@pytest.mark.parametrize("change", ["none", "order", "one", "twice", "swap"])
def test_hashes_tell_multisets_apart(spark, change):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)]
    other = {"none": leaves, "order": leaves[::-1], "one": leaves[1:], "twice": [*leaves, leaves[0]],
             # two leaves whose leading digits add up to those of two others
             "swap": [hashlib.sha256(b"x").hexdigest()[:60] + "0002", leaves[0][:60] + "ffff", *leaves[2:]]}[change]
    a, b = ({r.g: r.hash for r in scoring.multiset_hash(spark.createDataFrame([("g", x) for x in rows], "g string, leaf string"), ["g"], "leaf").collect()}
            for rows in (leaves, other))
    assert a == {"g": _tree(leaves)} and b == {"g": _tree(other)}
    assert (a == b) == (change in ("none", "order"))


def test_rules_over_several_tables_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (2, 'q"'), (2, 'q"'), (2, 'q"')], "u int, n string")
    b = spark.createDataFrame([(5, "ledger"), (6, "letter"), (6, None), (None, "bank")], "seed int, role string")
    rules = [Unique("names", "a", ("u", "n")), Unique("users", "a", ("u",)), Disjoint("apart", ("a", "u"), ("c", "seed")),
             Disjoint("seeds", ("b", "seed"), ("c", "seed")), Listed("role", "b", "role", ("ledger", "bank"))]
    c = spark.createDataFrame([(6,), (9,), (None,)], "seed int")
    got = {(r.rule, r.key): r.rows for r in breaches({"a": a, "b": b, "c": c}, rules).collect()}
    assert got == {("names", '["1","x"]'): 2, ("names", '["2","q\\""]'): 3, ("users", '["1"]'): 4, ("users", '["2"]'): 3,
                   ("seeds", '["6"]'): 3, ("role", '["letter"]'): 1, ("role", "[null]"): 1}
    assert breaches({"a": a.limit(0), "b": b.limit(0), "c": c}, rules).count() == 0
    with pytest.raises(ValueError, match="no rule"):
        breaches({"other": a}, rules)


def test_class_recall_looks_a_record_up_once(spark):
    """Repeated members, groups and key rows; a record in an exact and in another group; records of no group."""
    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)
    member = "group_id string, kind string, id string"
    members = rows(member, ("g1", "invoice", "i1"), ("g1", "invoice", "i1"), ("g1", "payment", "p1"), ("g1", "bank_line", "b1"),
                   ("g2", "invoice", "i1"), ("g2", "invoice", "i2"), ("g2", "bank_line", "b2"), (None, "invoice", "i4"))
    groups = rows("id string", ("g1",), ("g1",), ("g2",))
    key = AnswerKey(rows("settlement_id string, bank_line_id string", ("g1", "b1"), ("g2", "b2")),
                    rows(member, ("g1", "invoice", "i1"), ("g1", "payment", "p1"), ("g2", "invoice", "i2")),
                    rows("kind string, id string, group_id string, difficulty string", ("invoice", "i1", "g1", "clean"),
                         ("invoice", "i1", "g1", "clean"), ("invoice", "i2", "g2", "clean"), ("invoice", "i3", UNMATCHABLE, "none"),
                         ("invoice", "i4", UNMATCHABLE, "none"), ("bank_line", "b2", "g2", "line"), ("payment", "p1", "g1", "clean")))
    found = scoring.class_recall(groups, members, key)
    assert {r["class"]: (r["count"], r["recall"]) for r in found.collect()} == {
        "clean": (3, 2 / 3), "none": (2, 0.5), "line": (1, 1.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 4  # three of them tell which groups are exact


def test_metrics_count_each_table_where_it_lies(spark):
    """Repeated and null ids, open payments filed twice, no key; each figure's rows end in a count of their own."""
    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)
    ids = [rows("id string", *[(f"{kind}{k}",) for k in range(n)]) for kind, n in (("i", 3), ("p", 5), ("s", 2), ("m", 9), ("b", 4))]
    groups = rows("id string, status string, payout bigint", ("g1", "auto", 70), ("g2", "assisted", None), ("g2", "auto", 5), (None, "auto", 1))
    members = rows("group_id string, kind string, id string", ("g1", "payment", "p0"), ("g1", "payment", "p0"), ("g2", "payment", "p1"),
                   ("g2", "payment", None), ("g1", "invoice", "i0"), (None, "payment", "p2"), ("g9", "payment", "p3"))
    exceptions = rows("kind string, record_id string, amount_at_risk bigint", ("payment", "p2", 4), ("payment", "p2", 6), ("payment", None, None),
                      ("invoice", "p3", 1), (None, "p4", 2))
    key = AnswerKey(rows("settlement_id string, bank_line_id string", ("g1", "b1"), ("g3", "b2")),
                    rows("group_id string, kind string, id string", ("g1", "payment", "p0"), ("g1", "invoice", "i0")), groups)
    found = scoring.run_metrics(Books(*ids), groups, members, exceptions, key)
    want = {"auto_rate": 0.6, "assist_rate": 0.4, "open_rate": 0.4, "precision": 0.25, "recall": 0.5, "false_matches": 3, "records": 14,
            "open_exceptions": 5, "amount_at_risk": 13, "payments_total": 5, "payments_auto": 3, "payments_assisted": 2, "amount_cleared": 76}
    assert found.first().asDict() == want
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)
    # every part is one row: no record goes through the union
    assert all(plan.children().apply(k).maxRows().contains(1) for k in range(plan.children().size()))
    empty = scoring.run_metrics(Books(*[x.limit(0) for x in ids]), groups.limit(0), members.limit(0), exceptions.limit(0))
    assert [empty.first()[c] for c in ("auto_rate", "precision", "false_matches", "records", "amount_at_risk")] == [0.0, None, None, 0, 0]

"""The books and one run of them as DuckDB common table expressions."""

import re

BOOKS = """
o AS MATERIALIZED (
  SELECT o_orderkey AS k, CAST(floor(o_orderkey / 12) AS BIGINT) AS b, o_custkey,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         DATE '2024-01-08' + CAST(o_orderkey % 500 AS INTEGER) AS issued_at
  FROM orders),
inv AS MATERIALIZED (
  SELECT 'INV' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, 'INV/2024-25/' || lpad(CAST(k AS VARCHAR), 9, '0') AS number,
         c_name AS customer, amount, issued_at,
         CASE WHEN k % 40 = 7 THEN NULL WHEN k % 97 = 3 THEN 'INV' || lpad(CAST(k - 1 AS VARCHAR), 9, '0')
              ELSE 'INV' || lpad(CAST(k AS VARCHAR), 9, '0') END AS ref, k AS ord, b
  FROM o LEFT JOIN customer ON o_custkey = c_custkey),
pay0 AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
         CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 200 WHEN 2 THEN 150 ELSE 190 END AS bps
  FROM o WHERE k % 50 <> 11),
pay1 AS (SELECT *, (amount * bps + 5000) // 10000 AS fee FROM pay0),
pay2 AS (SELECT *, (fee * 1800 + 5000) // 10000 AS tax FROM pay1),
pay AS MATERIALIZED (
  SELECT CASE c WHEN 0 THEN 'pay_' ELSE 'payd_' END || lpad(CAST(k AS VARCHAR), 9, '0') AS id,
         CASE WHEN k % 40 IN (7, 13) THEN NULL
              WHEN k % 241 = 9 AND k >= 12 THEN 'INV' || lpad(CAST(k - 12 AS VARCHAR), 9, '0')
              ELSE 'INV' || lpad(CAST(k AS VARCHAR), 9, '0') END AS invoice_ref,
         amount AS gross, fee, tax, amount - fee - tax AS net,
         CASE WHEN k % 37 = 5 THEN 'refunded' WHEN k % 41 = 6 THEN 'disputed' WHEN k % 53 = 8 THEN 'failed'
              ELSE 'captured' END AS status,
         issued_at + CAST(k % 3 AS INTEGER) AS captured_on, method,
         CASE WHEN c = 0 AND k % 29 <> 4 THEN 'STL' || lpad(CAST(b AS VARCHAR), 6, '0') END AS settlement_id,
         k * 2 + c AS ord, k, b
  FROM pay2, (VALUES (0), (1)) AS copies(c) WHERE c = 0 OR k % 31 = 2),
stl0 AS (
  SELECT settlement_id AS id, b, sum(gross) AS gross, sum(fee) AS fees, sum(tax) AS tax,
         sum(CASE WHEN status IN ('refunded', 'disputed') THEN gross ELSE 0 END) AS reversed,
         max(captured_on) + 2 AS settled_at
  FROM pay WHERE settlement_id IS NOT NULL GROUP BY ALL),
stl AS MATERIALIZED (
  SELECT id, b, CASE WHEN b % 47 <> 0 THEN 'UTR' || lpad(CAST(100000000000 + b * 7919 AS VARCHAR), 12, '0') END AS utr,
         CAST(gross - fees - tax - reversed + CASE WHEN b % 5 = 0 THEN -250 ELSE 0 END
              + CASE WHEN b % 23 = 9 THEN 100 ELSE 0 END AS BIGINT) AS payout,
         CAST(gross AS BIGINT) AS gross, CAST(reversed AS BIGINT) AS reversed,
         CAST(fees AS BIGINT) AS fees, CAST(tax AS BIGINT) AS tax,
         CAST(CASE WHEN b % 5 = 0 THEN -250 ELSE 0 END AS BIGINT) AS adjustments, settled_at
  FROM stl0),
bank AS MATERIALIZED (
  SELECT p || lpad(CAST(b AS VARCHAR), 6, '0') AS id,
         settled_at + CAST(CASE WHEN b % 13 = 4 THEN 45 ELSE b % 3 END AS INTEGER) AS value_date,
         CASE WHEN p = 'BNKX' THEN 'MISC CREDIT NOT IDENTIFIED REF ' || b
              WHEN b % 17 = 5 OR utr IS NULL THEN 'BY TRANSFER FROM RAZORPAY SOFTWARE PVT LTD BATCH ' || b
              WHEN b % 4 = 0 THEN 'NEFT CR-HDFC00012-RAZORPAY SOFTWARE PVT LTD-UTR ' || utr[4:] || '-RAZORPAY SETTLEMENT'
              WHEN b % 4 = 1 THEN 'BY TRANSFER-IMPS*ICIC*UTR' || utr[4:] || '*RAZORPAY SOFTWARE PVT LTD'
              WHEN b % 4 = 2 THEN 'RTGS/SBIN00450/UTR NO ' || utr[4:] || '/RAZORPAY PAYOUT ' || b
              ELSE '  neft  CR   utr:  ' || utr[4:] || '   RAZORPAY  ' END AS narration,
         CASE WHEN p = 'BNKX' THEN 250000 + b ELSE payout - CASE WHEN b % 59 = 20 THEN 150000 ELSE 0 END END AS credit,
         b, b * 3 + CASE p WHEN 'BNK' THEN 0 WHEN 'BNKD' THEN 1 ELSE 2 END AS ord
  FROM stl, (VALUES ('BNK'), ('BNKD'), ('BNKX')) AS kinds(p)
  WHERE b % 19 <> 3 AND (p = 'BNK' OR (p = 'BNKD' AND b % 43 = 10) OR (p = 'BNKX' AND b % 25 = 6)))"""

# Bank lines per settlement through the reference quoted in the narration.
LINKS = """
tok AS (
  SELECT DISTINCT id, unnest(regexp_extract_all(upper(trim(regexp_replace(narration, '\\s+', ' ', 'g'))),
         '\\bUTR\\s*(?:NO\\.?|NUMBER|#)?\\s*[:\\-]?\\s*([A-Z0-9]{9,23})\\b', 1)) AS utr
  FROM bank),
hits AS (
  SELECT s.id AS settlement_id, count(*) AS n, min(bank.id) AS line, min(bank.value_date) AS value_date
  FROM stl s JOIN tok ON s.utr[4:] = tok.utr JOIN bank ON bank.id = tok.id AND bank.credit = s.payout GROUP BY 1),
links AS MATERIALIZED (
  SELECT s.id AS settlement_id, s.b, s.payout,
         CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous'
              WHEN abs(date_diff('day', s.settled_at, value_date)) > 5 THEN 'late' ELSE 'linked' END AS link_status,
         CASE WHEN n = 1 THEN line END AS bank_line_id, coalesce(n, 0) AS candidates
  FROM stl s LEFT JOIN hits ON s.id = hits.settlement_id)"""

HOLIDAYS = ("(DATE '2024-01-26', DATE '2024-03-25', DATE '2024-04-11', DATE '2024-08-15', DATE '2024-10-02', "
            "DATE '2024-11-01', DATE '2024-12-25', DATE '2025-01-26', DATE '2025-03-14', DATE '2025-08-15', "
            "DATE '2025-10-02', DATE '2025-12-25')")

CALENDAR = f"""
working AS MATERIALIZED (
  SELECT day, row_number() OVER (ORDER BY day) AS n
  FROM (SELECT CAST(unnest(generate_series(DATE '2023-10-01', DATE '2026-06-01', INTERVAL 1 DAY)) AS DATE) AS day)
  WHERE isodow(day) <= 5 AND day NOT IN {HOLIDAYS}),
issue_days AS (SELECT DISTINCT issued_at FROM o),
placed AS (
  SELECT issued_at, (SELECT count(*) FROM working WHERE day <= issued_at) AS upto,
         (SELECT count(*) FROM working WHERE day < issued_at) AS below FROM issue_days),
windows AS MATERIALIZED (
  SELECT issued_at, lo.day AS lower, hi.day AS upper FROM placed
  JOIN working hi ON hi.n = upto + 5 JOIN working lo ON lo.n = below - 4)"""

RESOLVED = """
refs AS (SELECT ref, count(*) AS n, min(id) AS iid FROM inv WHERE ref IS NOT NULL GROUP BY ref),
dated AS MATERIALIZED (SELECT inv.id, inv.ord, inv.amount, lower, upper FROM inv JOIN windows USING (issued_at)),
settled AS MATERIALIZED (
  SELECT p.*, r.n AS ref_hits, r.iid FROM pay p LEFT JOIN refs r ON p.invoice_ref = r.ref
  WHERE settlement_id IS NOT NULL),
band AS (
  SELECT s.id, count(*) AS n, min(d.id) AS iid FROM settled s JOIN dated d
    ON s.captured_on BETWEEN d.lower AND d.upper AND abs(d.amount - s.gross) * 10000 // d.amount <= 300
  WHERE s.ref_hits IS NULL GROUP BY s.id),
resolved AS MATERIALIZED (
  SELECT s.id AS payment_id, s.settlement_id, s.b, s.gross, s.status, s.invoice_ref, s.ord,
         CASE WHEN ref_hits = 1 THEN s.iid WHEN ref_hits IS NULL AND band.n = 1 THEN band.iid END AS invoice_id,
         CASE WHEN ref_hits = 1 THEN 'ref' WHEN ref_hits > 1 THEN 'ref_ambiguous' WHEN band.n = 1 THEN 'band_unique'
              WHEN band.n > 1 THEN 'band_several' ELSE 'none' END AS resolved_by
  FROM settled s LEFT JOIN band ON s.id = band.id)"""

# The claims are walked one contested settlement after the other, in input order.
RUN = """
algebra AS MATERIALIZED (
  SELECT id AS settlement_id, b, payout - (gross - fees - tax - reversed + adjustments) AS residual FROM stl),
valid AS (SELECT l.* FROM links l JOIN algebra a USING (settlement_id) WHERE link_status = 'linked' AND residual = 0),
claims AS MATERIALIZED (
  SELECT b AS prop, 'payment:' || payment_id AS key FROM resolved JOIN valid USING (settlement_id, b)
  UNION SELECT b, 'invoice:' || invoice_id FROM resolved JOIN valid USING (settlement_id, b)
        WHERE invoice_id IS NOT NULL
  UNION SELECT b, 'bank_line:' || bank_line_id FROM valid),
contested AS (
  SELECT prop, list(key) AS keys, row_number() OVER (ORDER BY prop) AS rn FROM claims
  WHERE key IN (SELECT key FROM claims GROUP BY key HAVING count(*) > 1) GROUP BY prop),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS prop, CAST([] AS VARCHAR[]) AS taken, true AS ok
  UNION ALL
  SELECT c.rn, c.prop, CASE WHEN list_has_any(w.taken, c.keys) THEN w.taken ELSE list_concat(w.taken, c.keys) END,
         NOT list_has_any(w.taken, c.keys)
  FROM walk w JOIN contested c ON c.rn = w.rn + 1),
accepted AS MATERIALIZED (SELECT * FROM valid WHERE b NOT IN (SELECT prop FROM walk WHERE NOT ok)),
kept AS MATERIALIZED (SELECT r.* FROM resolved r JOIN accepted USING (settlement_id, b)),
members AS MATERIALIZED (
  SELECT DISTINCT settlement_id AS group_id, 'payment' AS kind, payment_id AS id FROM kept
  UNION SELECT settlement_id, 'invoice', invoice_id FROM kept WHERE invoice_id IS NOT NULL
  UNION SELECT settlement_id, 'settlement', settlement_id FROM accepted
  UNION SELECT settlement_id, 'bank_line', bank_line_id FROM accepted),
groups AS MATERIALIZED (
  SELECT a.settlement_id AS id, a.settlement_id, a.b, a.bank_line_id, 'auto' AS status, a.payout,
         CASE WHEN n > 0 THEN 'P3' ELSE 'P2' END AS pass_id, CASE WHEN n > 0 THEN 0.95 ELSE 0.99 END AS confidence
  FROM accepted a LEFT JOIN (SELECT group_id, count(*) AS n FROM members WHERE kind = 'invoice' GROUP BY 1) i
    ON a.settlement_id = i.group_id)"""


def _codes() -> str:
    from tieout.vocab import EXCEPTION_CODES

    rows = ", ".join("('%s', '%s', %d, '%s')" % tuple(str(v).replace("'", "''") if isinstance(v, str) else v
                                                      for v in row) for row in EXCEPTION_CODES)
    return f"codes AS (SELECT * FROM (VALUES {rows}) AS c(code, label, severity, action))"


EXCEPTIONS = _codes() + """,
filed AS (
  SELECT 'settlement' AS kind, l.settlement_id AS record_id, l.payout AS amount_at_risk, l.b AS ord,
         CASE link_status WHEN 'ambiguous' THEN 'AMBIGUOUS_MULTI_CANDIDATE' WHEN 'late' THEN 'DATE_OUTSIDE_WINDOW'
              WHEN 'linked' THEN 'AMT_MISMATCH_UNEXPLAINED' ELSE 'MISSING_IN_BANK' END AS code,
         CASE link_status WHEN 'ambiguous' THEN 1 WHEN 'late' THEN 2 WHEN 'linked' THEN 4 ELSE 3 END AS stage,
         CASE link_status WHEN 'linked' THEN 'P1,P2,P3' ELSE 'P1' END AS attempted
  FROM links l ANTI JOIN accepted USING (settlement_id)
  UNION ALL
  SELECT 'invoice', id, amount, ord, 'MISSING_IN_BANK', 5, 'P3' FROM inv
  WHERE id NOT IN (SELECT id FROM members WHERE kind = 'invoice')
  UNION ALL
  SELECT 'payment', id, gross, ord,
         CASE WHEN invoice_ref IS NOT NULL AND (gross, invoice_ref) IN
                   (SELECT (gross, invoice_ref) FROM kept WHERE invoice_ref IS NOT NULL) THEN 'DUPLICATE_CANDIDATE'
              WHEN status = 'refunded' THEN 'REFUND_UNLINKED' WHEN status = 'disputed' THEN 'CHARGEBACK_UNLINKED'
              ELSE 'MISSING_IN_LEDGER' END, 6, 'P2'
  FROM pay WHERE id NOT IN (SELECT id FROM members WHERE kind = 'payment')
  UNION ALL
  SELECT 'bank_line', id, credit, ord, 'UNIDENTIFIED_CREDIT', 7, 'P1' FROM bank
  WHERE id NOT IN (SELECT id FROM members WHERE kind = 'bank_line')),
exc AS MATERIALIZED (
  SELECT 'EXC-' || kind || '-' || record_id AS id, f.code, severity, amount_at_risk, kind, record_id, attempted,
         action AS suggested_action, stage, ord, label
  FROM filed f JOIN codes USING (code))"""

TRUTH = """
key_groups AS (
  SELECT s.id AS settlement_id, bank.id AS bank_line_id FROM stl s
  LEFT JOIN bank ON bank.b = s.b AND bank.id LIKE 'BNK0%'),
key_members AS (
  SELECT settlement_id AS group_id, 'payment' AS kind, id FROM pay WHERE settlement_id IS NOT NULL
  UNION ALL SELECT settlement_id, 'invoice', 'INV' || lpad(CAST(k AS VARCHAR), 9, '0') FROM pay
  WHERE settlement_id IS NOT NULL),
key_records AS MATERIALIZED (
  SELECT 'invoice' AS kind, id,
         CASE WHEN ord % 50 = 11 OR ord % 29 = 4 THEN 'unmatchable' ELSE 'STL' || lpad(CAST(b AS VARCHAR), 6, '0') END AS group_id,
         CASE WHEN ord % 50 = 11 OR ord % 29 = 4 THEN 'unmatchable' WHEN ord % 37 = 5 THEN 'refund_in_batch'
              WHEN ord % 41 = 6 THEN 'chargeback' WHEN b % 13 = 4 THEN 'date_outside_window'
              WHEN b % 17 = 5 THEN 'narration_missing_utr' ELSE 'clean' END AS difficulty FROM inv
  UNION ALL
  SELECT 'payment', id, coalesce(settlement_id, 'unmatchable'),
         CASE WHEN id LIKE 'payd%' THEN 'duplicate_payment' WHEN settlement_id IS NULL THEN 'unmatchable' ELSE 'clean' END FROM pay
  UNION ALL
  SELECT 'bank_line', id, CASE WHEN id LIKE 'BNKX%' THEN 'unmatchable' ELSE 'STL' || lpad(CAST(b AS VARCHAR), 6, '0') END,
         CASE WHEN id LIKE 'BNKX%' THEN 'unrelated_credit' ELSE 'clean' END FROM bank)"""

EXACT = """
exact AS MATERIALIZED (
  SELECT id AS group_id FROM groups g
  WHERE NOT EXISTS (SELECT 1 FROM members m ANTI JOIN key_members t USING (group_id, kind, id)
                    WHERE m.group_id = g.id AND m.kind IN ('invoice', 'payment'))
    AND NOT EXISTS (SELECT 1 FROM key_members t ANTI JOIN members m USING (group_id, kind, id) WHERE t.group_id = g.id))"""

PARTS = {"books": BOOKS, "links": LINKS, "calendar": CALENDAR, "resolved": RESOLVED, "run": RUN,
         "exceptions": EXCEPTIONS, "key": TRUTH, "truth": TRUTH + "," + EXACT}


# What a run derives; a second copy of its parts carries these names with a suffix.
RUN_NAMES = ("bank", "tok", "hits", "links", "refs", "dated", "settled", "band", "resolved", "algebra", "valid", "claims",
             "contested", "walk", "accepted", "kept", "members", "groups")


def _renamed(part: str, suffix: str) -> str:
    return re.sub(rf"\b({'|'.join(RUN_NAMES)})\b(?!\()", rf"\1{suffix}", part)


def two_batches(select: str, late: str) -> str:
    """All books first without the bank lines that satisfy `late`, then those lines.

    The first run's groups stand. The second looks everything up in everything, but proposals that
    ask for a record of a standing group are out before the walk.
    """
    first = f"bank_a AS MATERIALIZED (SELECT * FROM bank WHERE NOT ({late}))," + ",".join(
        _renamed(part, "_a") for part in (LINKS, RESOLVED, RUN))
    held = """
owned AS MATERIALIZED (SELECT DISTINCT kind || ':' || id AS key FROM members_a),
late_links AS (SELECT * FROM links WHERE 'settlement:' || settlement_id NOT IN (SELECT key FROM owned)),"""
    second = RUN.replace("FROM links l JOIN algebra", "FROM late_links l JOIN algebra").replace(
        "claims AS MATERIALIZED (", "wanted AS MATERIALIZED (").replace(
        "contested AS (", "claims AS MATERIALIZED (SELECT * FROM wanted WHERE prop NOT IN (SELECT prop FROM wanted "
        "WHERE key IN (SELECT key FROM owned))),\ncontested AS (").replace(
        "SELECT * FROM valid WHERE b NOT IN (", "SELECT * FROM valid WHERE b IN (SELECT prop FROM claims) AND b NOT IN (")
    return f"WITH RECURSIVE {BOOKS},{CALENDAR},{first},{LINKS},{RESOLVED},{held}{second}\n{select}"


def over(select: str, *parts: str, extra: str = "") -> str:
    """A query over some of the parts."""
    chosen = ",".join(PARTS[p] for p in parts)
    return f"WITH RECURSIVE {chosen}{',' + extra if extra else ''}\n{select}"


def over_books(select: str, extra: str = "") -> str:
    return over(select, "books", extra=extra)


def over_run(select: str, extra: str = "") -> str:
    return over(select, "books", "links", "calendar", "resolved", "run", "exceptions", extra=extra)


def over_truth(select: str, extra: str = "") -> str:
    return over(select, "books", "links", "calendar", "resolved", "run", "exceptions", "truth", extra=extra)

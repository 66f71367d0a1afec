"""One DuckDB statement per query, with the same columns."""

from __future__ import annotations

import re

from oracle.books_sql import EXACT, EXCEPTIONS, TRUTH, over, over_books, over_run, over_truth, two_batches
from tieout.functions.narration import NOISE_WORDS


def _tree(leaves: str) -> str:
    """(g, node) from (g, node): sha256 over the sorted nodes that share four digits, then two, then none."""
    nodes = f"SELECT g, node AS spot, node FROM ({leaves})"
    for digits in (4, 2, 0):
        nodes = (f"SELECT g, spot, sha256(string_agg(node, '' ORDER BY node)) AS node FROM (SELECT g, left(spot, {digits}) AS spot, "
                 f"spot || node AS node FROM ({nodes})) GROUP BY ALL")
    return nodes


def grouped(paise: str) -> str:
    """Rupees in Indian grouping; DuckDB's patterns have no look-ahead."""
    digits = f"lpad(CAST(abs({paise}) AS VARCHAR), CAST(greatest(3, length(CAST(abs({paise}) AS VARCHAR))) AS INTEGER), '0')"
    whole = f"left({digits}, length({digits}) - 2)"
    head = f"CASE WHEN length({whole}) > 3 THEN left({whole}, length({whole}) - 3) ELSE '' END"
    pairs = f"reverse(regexp_replace(reverse({head}), '(..)', '\\1,', 'g'))"
    return (f"(CASE WHEN {paise} < 0 THEN '-' ELSE '' END || CASE WHEN length({whole}) > 3 THEN "
            f"ltrim({pairs}, ',') || ',' || right({whole}, 3) ELSE {whole} END || '.' || right({digits}, 2))")


METRICS = """
scored AS (
  SELECT (SELECT count(*) FROM inv) + (SELECT count(*) FROM pay) + (SELECT count(*) FROM stl) + (SELECT count(*) FROM bank) AS records,
         (SELECT count(*) FROM pay) AS payments_total,
         (SELECT count(DISTINCT id) FROM members WHERE kind = 'payment') AS payments_auto,
         (SELECT count(DISTINCT record_id) FROM exc WHERE kind = 'payment') AS payments_open,
         (SELECT count(*) FROM exc) AS open_exceptions, (SELECT CAST(sum(amount_at_risk) AS BIGINT) FROM exc) AS amount_at_risk,
         (SELECT CAST(sum(payout) AS BIGINT) FROM groups) AS amount_cleared)"""

# Outside proposals, judged one after the other.
TRIAGE = """
open_lines AS MATERIALIZED (SELECT * FROM bank WHERE id NOT IN (SELECT id FROM members WHERE kind = 'bank_line')),
open_sets AS MATERIALIZED (SELECT s.* FROM stl s ANTI JOIN accepted a ON s.id = a.settlement_id),
firsts AS (SELECT credit AS payout, min(id) AS line, arg_min(narration, id) AS narration FROM open_lines GROUP BY 1),
wished AS (
  SELECT s.id AS settlement_id, s.b, s.payout, 1 AS proposal_ord, f.line AS bank_line_id, 0.9 AS confidence,
         CASE WHEN s.b % 2 = 0 THEN [f.narration[1:12], 'NOT IN TEXT ' || s.b] ELSE [f.narration[1:12]] END AS spans
  FROM open_sets s JOIN firsts f USING (payout)
  UNION ALL
  SELECT id, b, payout, 2, 'BNK' || lpad(CAST(b AS VARCHAR), 6, '0'), 0.5, [] FROM open_sets WHERE b % 7 = 0),
asked AS MATERIALIZED (
  SELECT w.*, row_number() OVER (ORDER BY settlement_id, proposal_ord) AS prop,
         (SELECT string_agg(narration, chr(10) ORDER BY id) FROM open_lines l WHERE l.credit = w.payout) AS shown,
         EXISTS (SELECT 1 FROM open_lines l WHERE l.id = w.bank_line_id AND l.credit = w.payout) AS offered
  FROM wished w WHERE payout IN (SELECT credit FROM open_lines)),
grounded AS MATERIALIZED (
  SELECT *, list_filter(spans, lambda s: NOT contains(shown, s)) AS missing FROM asked),
tried AS MATERIALIZED (
  SELECT g.*, a.residual FROM grounded g JOIN algebra a USING (settlement_id) WHERE offered AND len(missing) = 0),
asked_for AS MATERIALIZED (
  SELECT prop, 1 AS rank, ord AS pos, 'invoice' AS kind, invoice_id AS id FROM tried JOIN resolved USING (settlement_id)
  WHERE invoice_id IS NOT NULL
  UNION ALL SELECT prop, 2, ord, 'payment', payment_id FROM tried JOIN resolved USING (settlement_id)
  UNION ALL SELECT prop, 3, 0, 'settlement', settlement_id FROM tried
  UNION ALL SELECT prop, 4, 0, 'bank_line', bank_line_id FROM tried),
steps AS MATERIALIZED (
  SELECT t.prop, row_number() OVER (ORDER BY t.prop) AS rn, list(DISTINCT a.kind || ':' || a.id) AS keys,
         any_value(residual) = 0 AND NOT bool_or((a.kind, a.id) IN (SELECT (kind, id) FROM members)) AS able
  FROM tried t JOIN asked_for a USING (prop) GROUP BY t.prop),
turns AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS prop, CAST([] AS VARCHAR[]) AS taken, false AS won
  UNION ALL
  SELECT s.rn, s.prop, CASE WHEN s.able AND NOT list_has_any(t.taken, s.keys) THEN list_concat(t.taken, s.keys) ELSE t.taken END,
         s.able AND NOT list_has_any(t.taken, s.keys)
  FROM turns t JOIN steps s ON s.rn = t.rn + 1),
winners AS MATERIALIZED (SELECT prop FROM turns WHERE won),
owners AS MATERIALIZED (
  SELECT kind, id, -1 AS owner FROM members
  UNION ALL SELECT DISTINCT kind, id, prop FROM asked_for WHERE prop IN (SELECT prop FROM winners)),
held AS (
  SELECT a.prop, arg_min(a.kind || ' ' || a.id, (rank, pos)) AS what
  FROM asked_for a JOIN owners o ON a.kind = o.kind AND a.id = o.id AND o.owner < a.prop GROUP BY a.prop),
verdicts AS MATERIALIZED (
  SELECT g.*, g.prop IN (SELECT prop FROM winners) AS accepted,
         CASE WHEN NOT offered THEN 'proposed bank_line_id was not an offered candidate'
              WHEN len(missing) > 0 THEN 'ungrounded evidence span: ''' || missing[1] || ''''
              WHEN g.prop IN (SELECT prop FROM winners) THEN NULL
              WHEN h.what IS NOT NULL THEN h.what || ' already claimed by another group'
              ELSE 'batch algebra does not tie out: residual ' || a.residual || ' paise' END AS failed_check
  FROM grounded g LEFT JOIN held h USING (prop) JOIN algebra a USING (settlement_id)),
closed AS MATERIALIZED (
  SELECT DISTINCT kind, id FROM asked_for WHERE prop IN (SELECT prop FROM winners)),
final_exc AS MATERIALIZED (
  SELECT id, code, amount_at_risk, CAST(NULL AS VARCHAR) AS failed_check, kind, record_id FROM exc
  WHERE (kind, record_id) NOT IN (SELECT (kind, id) FROM closed)
  UNION ALL
  SELECT 'EXC-settlement-' || settlement_id, 'LLM_PROPOSAL_FAILED_VERIFY', payout, failed_check, 'settlement', settlement_id
  FROM verdicts WHERE NOT accepted)"""


def over_triage(select: str, *parts: str, extra: str = "") -> str:
    return over_run(select, TRIAGE + (("," + extra) if extra else ""))


def _capped(columns: str, table: str, order: str, where: str = "true", limit: int = 20) -> str:
    return (f"SELECT {columns}, (SELECT count(*) FROM {table} WHERE {where}) AS total, "
            f"(SELECT count(*) FROM {table} WHERE {where}) > {limit} AS truncated "
            f"FROM {table} WHERE {where} ORDER BY {order} LIMIT {limit}")


MATCHING = {
    "settlement_links": over("SELECT settlement_id, link_status, bank_line_id, candidates FROM links", "books", "links"),
    "batch_totals": over_books(
        "SELECT id AS settlement_id, gross, reversed, payout, payout - (gross - fees - tax - reversed + adjustments) AS residual FROM stl"),
    "accounting_identity": over_books(
        "SELECT count(*) AS settlements, count(*) FILTER (r <> 0) AS unbalanced, CAST(sum(abs(r)) AS BIGINT) AS residual_total "
        "FROM (SELECT payout - (gross - fees - tax - reversed + adjustments) AS r FROM stl)"),
    "payment_invoice_links": over(
        "SELECT settlement_id, payment_id, invoice_id, resolved_by FROM resolved JOIN links USING (settlement_id) WHERE link_status = 'linked'",
        "books", "links", "calendar", "resolved"),
    "fee_band_candidates": over(
        "SELECT p.captured_on, p.gross, count(*) AS band_hits, CASE WHEN count(*) = 1 THEN min(d.ord) END AS invoice_ord "
        "FROM (SELECT DISTINCT captured_on, gross FROM pay WHERE invoice_ref IS NULL) p JOIN dated d "
        "ON p.captured_on BETWEEN d.lower AND d.upper AND abs(d.amount - p.gross) * 10000 // d.amount <= 300 GROUP BY ALL",
        "books", "calendar", "resolved"),
    "fee_band_flags": over_books(
        "SELECT payment_id, amount, g AS gross, abs(amount - g) * 10000 // amount <= 300 AS fits FROM "
        "(SELECT id AS payment_id, invoice_ref, gross + ord % 700 * gross % 100000 AS g FROM pay) p JOIN inv ON inv.id = p.invoice_ref"),
    "matched_groups": over_run(
        "SELECT g.id, bank_line_id, status, pass_id, confidence, 0 AS residual, "
        "(SELECT count(*) FROM members m WHERE m.group_id = g.id AND kind = 'invoice') AS invoices, "
        "(SELECT count(*) FROM members m WHERE m.group_id = g.id AND kind = 'payment') AS payments, "
        "'utr=' || s.utr || '=' || g.id || ',credit=' || g.payout || '=' || bank_line_id AS evidence "
        "FROM groups g JOIN stl s ON g.id = s.id"),
    "group_members": over_run("SELECT group_id, kind, id FROM members"),
    "open_exceptions": over_run(
        "SELECT id, code, severity, amount_at_risk, kind, record_id, attempted, suggested_action FROM exc"),
    "exception_summary": over_run(
        "SELECT code, count(*) AS count, CAST(sum(amount_at_risk) AS BIGINT) AS amount_at_risk, "
        "array_to_string(list(id ORDER BY stage, ord, id)[1:3], ',') AS example_ids, "
        "(SELECT count(*) FROM exc) AS total_exceptions, (SELECT CAST(sum(amount_at_risk) AS BIGINT) FROM exc) AS total_amount_at_risk "
        "FROM exc GROUP BY code"),
    "largest_exceptions": over_run(_capped("id, code, amount_at_risk", "exc", "amount_at_risk DESC, stage, ord, id")),
    "exceptions_of_code": over_run(_capped("id, amount_at_risk", "exc", "amount_at_risk DESC, stage, ord, id",
                                           "code = 'DUPLICATE_CANDIDATE'")),
    "report_positions": over_run(
        "SELECT row_number() OVER (ORDER BY severity DESC, amount_at_risk DESC, stage, ord) AS position, id, severity, amount_at_risk FROM exc"),
    "matched_by_status": over_run(_capped("id, bank_line_id", "groups", "b", "pass_id = 'P3'")),
    "record_lookup": over_run(
        "SELECT w.kind, w.id, CASE WHEN m.id IS NOT NULL THEN 'matched_group' WHEN e.id IS NOT NULL THEN 'exception' "
        "ELSE 'not_found' END AS found_in, m.group_id, CASE WHEN m.id IS NULL THEN e.id END AS exception_id, "
        "CASE WHEN m.id IS NULL THEN e.code END AS code FROM wanted w "
        "LEFT JOIN members m ON m.kind = w.kind AND m.id = w.id LEFT JOIN exc e ON e.kind = w.kind AND e.record_id = w.id",
        "wanted AS (SELECT 'payment' AS kind, id FROM pay UNION ALL SELECT 'payment', 'ghost_' || id FROM pay "
        "UNION ALL SELECT 'invoice', id FROM inv)"),
    "record_search": over_run(
        "SELECT * FROM (" + _capped("id", "hit_groups", "id") + ") CROSS JOIN (SELECT 'matched_group' AS found_in) UNION ALL "
        "SELECT id, total, truncated, found_in FROM (" + _capped("id, stage, ord", "hit_exc", "stage, ord, id")
        + ") CROSS JOIN (SELECT 'exception' AS found_in)",
        "hit_groups AS (SELECT DISTINCT group_id AS id FROM members WHERE contains(lower(id), '0012') "
        "UNION SELECT g.id FROM groups g JOIN stl s ON g.id = s.id WHERE contains(lower(s.utr), '0012') OR contains(CAST(g.payout AS VARCHAR), '0012')), "
        "hit_exc AS (SELECT * FROM exc WHERE contains(lower(id), '0012') OR contains(lower(record_id), '0012') "
        "OR contains(lower(code), '0012') OR contains(lower(suggested_action), '0012'))"),
    "exception_codes": over_run(
        "SELECT code, label, severity, (SELECT count(*) FROM exc e WHERE e.code = c.code) AS n FROM codes c"),
    "repeated_ids": over_books("SELECT 'bank_line' AS kind, id, 2 AS copies FROM bank WHERE id LIKE 'BNKD%'"),
    "running_balance": over_books(
        "SELECT id, value_date, credit, CAST(sum(credit) OVER (ORDER BY value_date, id) AS BIGINT) AS balance FROM bank"),
    "subset_sums": over_books(
        "SELECT settlement_id, target, CASE WHEN count(*) FILTER (ok) = 1 THEN any_value(picked) FILTER (ok) END AS subset, "
        "count(*) FILTER (ok) AS solutions, (SELECT greatest(count(*) - 8, 0) FROM pay WHERE pay.settlement_id = c.settlement_id) AS left_out "
        "FROM (SELECT settlement_id, target, "
        "list_sum([g FOR g, i IN gs IF (m >> (i - 1)) & 1 = 1]) = target AS ok, "
        "array_to_string([p FOR p, i IN ids IF (m >> (i - 1)) & 1 = 1], ',') AS picked "
        "FROM offered, generate_series(1, 255) AS s(m) WHERE m < (1 << len(ids))) AS c GROUP BY settlement_id, target",
        "few AS (SELECT settlement_id, id, gross, row_number() OVER (PARTITION BY settlement_id ORDER BY ord) AS rn FROM pay "
        "WHERE settlement_id IS NOT NULL QUALIFY rn <= 8), "
        "offered AS (SELECT settlement_id, list(id ORDER BY rn) AS ids, list(gross ORDER BY rn) AS gs, "
        "CAST(sum(gross) FILTER (rn IN (2, 3, 5)) AS BIGINT) AS target FROM few GROUP BY 1)"),
}

SCORING = {
    "run_metrics": over_truth(
        f"SELECT round(payments_auto / CAST(payments_total AS DOUBLE), 6) AS auto_rate, 0.0 AS assist_rate, "
        "round(payments_open / CAST(payments_total AS DOUBLE), 6) AS open_rate, "
        "round((SELECT count(*) FROM exact) / CAST((SELECT count(*) FROM groups) AS DOUBLE), 6) AS precision, "
        "round((SELECT count(*) FROM exact) / CAST((SELECT count(*) FROM key_groups) AS DOUBLE), 6) AS recall, "
        "(SELECT count(*) FROM groups) - (SELECT count(*) FROM exact) AS false_matches, records, open_exceptions, amount_at_risk, "
        "payments_total, payments_auto, 0 AS payments_assisted, amount_cleared FROM scored", METRICS),
    "class_recall": over_truth(
        "SELECT difficulty AS class, count(*) AS count, round(avg(CASE WHEN CASE WHEN group_id = 'unmatchable' THEN (kind, id) NOT IN "
        "(SELECT (kind, id) FROM members) WHEN kind = 'invoice' THEN id IN (SELECT id FROM members SEMI JOIN exact USING (group_id) WHERE kind = 'invoice') "
        "ELSE id IN (SELECT id FROM members WHERE kind = 'bank_line') END THEN 1.0 ELSE 0.0 END), 6) AS recall, "
        "upper(difficulty[1]) || replace(replace(difficulty, '_', ' '), ' utr', ' UTR')[2:] AS label "
        "FROM key_records WHERE kind IN ('invoice', 'bank_line') GROUP BY difficulty"),
    "class_counts": over_truth(
        "SELECT difficulty AS class, count(*) AS count FROM key_records "
        "WHERE kind = 'invoice' OR (kind = 'bank_line' AND difficulty = 'unrelated_credit') GROUP BY 1"),
    "chain_counts": over_run(
        "SELECT kind, count(DISTINCT id) AS tied FROM members GROUP BY kind UNION ALL SELECT 'group', count(*) FROM groups"),
    "accounting_check": over_run(
        "SELECT r.kind, count(*) AS records, count(m.id) AS matched, count(e.record_id) AS excepted, "
        "count(*) FILTER (m.id IS NULL AND e.record_id IS NULL) AS unaccounted, count(*) FILTER (m.id IS NOT NULL AND e.record_id IS NOT NULL) AS in_both, "
        "CAST(coalesce(sum(amount) FILTER (m.id IS NOT NULL), 0) AS BIGINT) AS matched_amount, "
        "CAST(coalesce(sum(amount) FILTER (e.record_id IS NOT NULL), 0) AS BIGINT) AS open_amount, CAST(sum(amount) AS BIGINT) AS total_amount "
        "FROM recs r LEFT JOIN (SELECT DISTINCT kind, id FROM members) m ON r.kind = m.kind AND r.id = m.id "
        "LEFT JOIN (SELECT DISTINCT kind, record_id FROM exc) e ON r.kind = e.kind AND r.id = e.record_id GROUP BY r.kind",
        "recs AS (SELECT 'invoice' AS kind, id, amount FROM inv UNION ALL SELECT 'payment', id, gross FROM pay "
        "UNION ALL SELECT 'settlement', id, payout FROM stl UNION ALL SELECT 'bank_line', id, credit FROM bank)"),
    "run_impact": over_run(
        "SELECT payments_auto AS cleared_without_a_human, payments_total, open_exceptions AS still_needs_a_human, amount_cleared, "
        "amount_at_risk, payments_auto * 90 AS seconds_saved, (payments_auto * 90 // 3600) || 'h' || CASE WHEN payments_auto * 90 // 60 % 60 = 0 "
        "THEN '' ELSE ' ' || lpad(CAST(payments_auto * 90 // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS time_saved FROM scored", METRICS),
    "output_hash": over_run(
        "SELECT (SELECT count(*) FROM groups) AS groups, node AS output_hash FROM (" + _tree(
            "SELECT 0 AS g, sha256(concat_ws('|', g.id, coalesce(m.node, ''), settlement_id, bank_line_id, status, pass_id, "
            "printf('%.4f', CAST(confidence AS DOUBLE)), '0')) AS node FROM groups g LEFT JOIN ("
            + _tree("SELECT group_id AS g, sha256(kind || ':' || id) AS node FROM members WHERE kind IN ('invoice', 'payment')")
            + ") m ON g.id = m.g") + ")"),
    "sweep_summary": over_books(
        "SELECT *, CAST(row_number() OVER (ORDER BY label = 'all', label) AS INT) AS position FROM ("
        "SELECT label, count(*) AS runs, CAST(sum(k % 977) AS BIGINT) AS records, "
        "round(avg(k % 100 / 100.0) FILTER (k % 4 <> 1), 4) AS precision, round(avg(k % 64 / 64.0) FILTER (k % 4 <> 1), 4) AS recall, "
        "CAST(sum(k % 3) FILTER (k % 4 <> 1) AS BIGINT) AS false_matches_total, max(k % 3) FILTER (k % 4 <> 1) AS false_matches_worst, "
        "round(avg(k % 256 / 256.0), 4) AS auto_rate, round(avg(k % 83), 1) AS open_exceptions_mean, "
        "round(median(amount / 100.0), 1) AS throughput_rps_median FROM (SELECT *, unnest(['label ' || k % 10, 'all']) AS label FROM o) GROUP BY 1)"),
}

_DAYS = ("days AS (SELECT CAST(unnest(generate_series((SELECT min(settled_at) FROM stl), (SELECT min(settled_at) FROM stl) + 13, INTERVAL 1 DAY)) "
         "AS DATE) AS date), cash AS (SELECT date, CAST(coalesce(sum(payout) FILTER (a), 0) AS BIGINT) AS recognised, "
         "CAST(coalesce(sum(payout) FILTER (NOT a), 0) AS BIGINT) AS blocked FROM days LEFT JOIN "
         "(SELECT settled_at, payout, id IN (SELECT settlement_id FROM groups) AS a FROM stl) s ON s.settled_at = days.date GROUP BY 1)")
_DECIDED = ("tails AS (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS tail FROM exc), "
            "decided AS (SELECT id, CASE WHEN tail % 6 = 0 THEN 'rejected' ELSE 'approved' END AS decision FROM tails WHERE tail % 3 = 0)")

REPORTING = {
    "cash_forecast": over_run("SELECT * FROM cash", _DAYS),
    "forecast_report": over_run(
        f"SELECT date, CASE WHEN recognised < 0 THEN '-' ELSE '' END || 'INR ' || {grouped('abs(recognised)')} AS recognised, "
        f"CASE WHEN blocked < 0 THEN '-' ELSE '' END || 'INR ' || {grouped('abs(blocked)')} AS blocked "
        "FROM cash WHERE recognised <> 0 OR blocked <> 0", _DAYS),
    "unrecognised_cash": over_run(
        "SELECT CAST(sum(amount_at_risk) AS BIGINT) AS unrecognised_cash FROM exc WHERE code = 'UNIDENTIFIED_CREDIT'"),
    "decision_overlay": over_run(
        "SELECT e.id, coalesce(decision, 'open') AS decision, 'note ' || decision AS note FROM exc e LEFT JOIN decided USING (id)", _DECIDED),
    "latest_decisions": over_run(
        "SELECT id AS exception_id, decision, (SELECT count(*) FROM decided) AS total, (SELECT count(*) FROM decided) > 20 AS truncated "
        "FROM decided ORDER BY id LIMIT 20", _DECIDED),
    "triage_offers": over_triage(
        "SELECT amount, side, id, (SELECT count(*) FROM open_lines l WHERE l.credit = amount) AS lines FROM "
        "(SELECT payout AS amount, 'settlement' AS side, id FROM open_sets UNION ALL SELECT credit, 'bank_line', id FROM open_lines) "
        "WHERE amount IN (SELECT credit FROM open_lines) AND amount IN (SELECT payout FROM open_sets)"),
    "triage_verdicts": over_triage(
        "SELECT settlement_id, proposal_ord, bank_line_id, accepted, failed_check FROM verdicts"),
    "triaged_groups": over_triage(
        "SELECT id, bank_line_id, status, pass_id, CAST(confidence AS DOUBLE) AS confidence FROM groups UNION ALL "
        "SELECT settlement_id, bank_line_id, 'assisted', 'LLM', CAST(confidence AS DOUBLE) FROM verdicts WHERE accepted"),
    "triaged_exceptions": over_triage("SELECT id, code, amount_at_risk, failed_check FROM final_exc"),
    "explained_exceptions": over_run(
        "SELECT id, code, CASE WHEN code = 'REFUND_UNLINKED' THEN NULL WHEN length(t) <= 240 THEN t ELSE t[1:239] || '…' END AS explanation, "
        "CASE WHEN code = 'REFUND_UNLINKED' OR code LIKE 'M%' THEN suggested_action ELSE 'Check ' || code END AS suggested_action "
        "FROM (SELECT *, repeat(label || '. ', 9) AS t FROM exc)"),
    "exceptions_export": over_run(
        "SELECT id AS exception_id, code, severity, amount_at_risk AS amount_at_risk_paise, kind || ':' || record_id AS records, suggested_action FROM exc"),
    "json_round_trip": over_run(
        "SELECT 'payments' AS part, count(*) AS n, CAST(sum(gross) AS BIGINT) AS amount FROM pay UNION ALL "
        "SELECT 'exceptions', count(*), CAST(sum(amount_at_risk) AS BIGINT) FROM exc"),
}

SCALARS = {
    "parsed_amounts": over_books(
        "SELECT k, CASE k % 11 WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 2 THEN -amount WHEN 3 THEN -amount WHEN 5 THEN -amount ELSE amount END AS paise, "
        f"CASE k % 11 WHEN 9 THEN 'unrecognised amount shape: ''' || {grouped('amount')} || 'x''' WHEN 10 THEN 'empty amount' END AS error FROM o"),
    "rendered_amounts": over_books(
        f"SELECT k, {grouped('p')} AS plain, CASE WHEN p < 0 THEN '-' ELSE '' END || 'INR ' || {grouped('abs(p)')} AS report "
        "FROM (SELECT k, CASE k % 3 WHEN 0 THEN -amount WHEN 1 THEN amount % 1000 ELSE amount * 1000 + k END AS p FROM o)"),
    "parsed_dates": over_books(
        "SELECT k, CASE WHEN k % 14 >= 10 THEN NULL WHEN k % 14 = 7 THEN issued_at + 1 ELSE issued_at END AS day, "
        "CASE k % 14 WHEN 10 THEN 'invalid calendar date: ''31/02/2024''' WHEN 11 THEN 'unrecognised month: ''12-Foo-24''' "
        "WHEN 12 THEN 'unrecognised date shape: ''' || issued_at || '?''' WHEN 13 THEN 'empty date' END AS error FROM o"),
    "serial_dates": over_books(
        "SELECT k, DATE '1899-12-30' + CAST(45299 + k % 500 AS INTEGER) AS day, strftime(issued_at, '%d %b %Y') || ', 05:30 am IST' AS shown FROM o"),
    "business_days": over(
        "SELECT issued_at, upto > below AS open, (SELECT day FROM working WHERE n = below - 4) AS d_m5, "
        "(SELECT day FROM working WHERE n = below) AS d_m1, issued_at AS d_p0, (SELECT day FROM working WHERE n = upto + 1) AS d_p1, "
        "(SELECT day FROM working WHERE n = upto + 5) AS d_p5, (SELECT day FROM working WHERE n = upto + 8) AS d_p8 FROM placed", "books", "calendar"),
    "narration_references": over(
        "SELECT bank.id, coalesce(t.utr, '') AS utrs, '' AS rrns, nullif(upper(regexp_extract(narration, '(?i)\\b(NEFT|IMPS|UPI|RTGS)\\b', 1)), '') AS rail "
        "FROM bank LEFT JOIN tok t ON t.id = bank.id", "books", "links"),
    "narration_payers": over_books(
        "SELECT id, nullif(array_to_string(list_filter(list_transform(found, lambda t: "
        "regexp_replace(regexp_replace(t, '[A-Za-z.&][0-9]+$', ''), '^[0-9]+[A-Za-z][.&]*', '')), "
        "lambda w: w <> '' AND upper(w) NOT IN " + str(NOISE_WORDS) + ")[1:3], ' '), '') AS payer "
        "FROM (SELECT id, regexp_extract_all(narration, '[0-9]*[A-Za-z][A-Za-z.&]*[0-9]*') AS found FROM bank)"),
    "gateway_references": over_books(
        "SELECT id, lpad(CAST(ord + 400000000000 AS VARCHAR), 12, '0') AS rrns, id AS pay_ids, 'order_' || lpad(CAST(ord AS VARCHAR), 8, '0') AS order_ids, "
        "coalesce(invoice_ref, '') AS invoice_tokens, CASE WHEN method = 'upi' THEN 'UPI' WHEN ord % 3 = 0 THEN 'IMPS' WHEN ord % 3 = 1 THEN 'UPI' END AS rail FROM pay"
    ).replace("id AS pay_ids", "CASE WHEN id LIKE 'payd%' THEN '' ELSE id END AS pay_ids"),
    "canonical_references": over_books(
        "SELECT id, utr[4:] || CASE WHEN b % 3 = 2 THEN 'X' ELSE '' END AS reference FROM stl"),
    "payment_economics": over_books(
        "SELECT method, count(*) AS payments, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(fee) AS BIGINT) AS fee, "
        "CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(net) AS BIGINT) AS net FROM pay GROUP BY 1"),
    "display_figures": over_books(
        "SELECT k, CASE WHEN k * 7 < 60 THEN k * 7 || 's' WHEN k * 7 // 60 < 60 THEN (k * 7 // 60) || ' min' ELSE (k * 7 // 3600) || 'h' || "
        "CASE WHEN k * 7 // 60 % 60 = 0 THEN '' ELSE ' ' || lpad(CAST(k * 7 // 60 % 60 AS VARCHAR), 2, '0') || 'm' END END AS duration, "
        "(k * 137 // 60000) || ':' || lpad(CAST(k * 137 % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || (k * 137 % 1000 // 100) AS elapsed, "
        "CASE WHEN k % 3000 < 1000 THEN (k % 3000) || 'ms' ELSE (k % 3000 + 50) // 1000 || '.' || ((k % 3000 + 50) // 100 % 10) || 's' END AS stage, "
        "(k % 1000 // 10) || '.' || (k % 10) || '%' AS percent, "
        "CASE WHEN k % 4 = 0 THEN '-' ELSE '0.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS optional FROM o"),
    "request_digests": (
        "SELECT sha256(role || ':triage-v1:' || text) AS request_key, count(*) AS askers, greatest(1, length(any_value(text)) // 4) AS tokens "
        "FROM conversations GROUP BY 1"),
}

FILES = {
    "ledger_files": over_books(
        "SELECT id, id AS number, 'Naïve & Co, ' || ord AS customer, amount, issued_at, coalesce(ref, id) AS ref FROM inv"),
    "gateway_files": over_books(
        "SELECT id, invoice_ref, gross, fee, tax, net, status, captured_on, method, settlement_id FROM pay"),
    "settlement_files": over_books(
        "SELECT id, utr, payout, fees, tax, adjustments, settled_at, 'p' || b || ',q' || b AS payment_ids FROM stl"),
    "bank_files": over_books(
        "SELECT CASE WHEN ord % 10 = 0 THEN 'BNK' || lpad(CAST(row_number() OVER (PARTITION BY ord // 120 ORDER BY ord) "
        "+ CASE WHEN ord // 120 % 5 = 2 THEN 1 ELSE 0 END AS VARCHAR), 6, '0') ELSE id END AS id, value_date, "
        "trim(regexp_replace(narration, '\\s+', ' ', 'g')) AS narration, credit, 0 AS debit, 0 AS balance FROM bank"),
    "file_repairs": over_books(
        "SELECT 'ledger/' || lpad(CAST(f AS VARCHAR), 9, '0') || '.csv' AS path, CASE WHEN f % 2 = 0 THEN 'cp1252' ELSE 'utf-8' END AS encoding, "
        "CASE f % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN 'tab' ELSE '|' END AS delimiter, CASE WHEN f % 3 = 1 THEN 2 ELSE 0 END AS header_row, "
        "CASE WHEN f % 3 = 1 THEN 1 ELSE 0 END AS preamble_rows, 0 AS blank_rows, CASE WHEN f % 2 = 0 THEN 1 ELSE 0 END AS summary_rows, "
        "0 AS truncated_rows, n + CASE WHEN f % 5 = 2 THEN 1 ELSE 0 END AS data_rows, "
        "'Invoice No,Customer Name,Amount Due,Invoice Date,Reference,Notes' AS headers "
        "FROM (SELECT ord // 120 AS f, count(*) AS n FROM inv GROUP BY 1)"),
    "file_health": over_books(
        "SELECT 'bank/' || lpad(CAST(f AS VARCHAR), 9, '0') || '.csv' AS path, n + bad AS total_rows, n AS valid_rows, bad AS error_count, "
        "s AS synthesised_ids FROM (SELECT ord // 120 AS f, count(*) AS n, count(*) FILTER (ord % 10 = 0) AS s, "
        "CASE WHEN f % 5 = 2 THEN 1 ELSE 0 END AS bad FROM bank GROUP BY 1)"),
    "row_errors": over_books(
        "SELECT DISTINCT 'gateway/' || lpad(CAST(ord // 120 AS VARCHAR), 9, '0') || '.csv' AS path, 1 AS row_number, "
        "'missing required field(s): captured_at' AS reason FROM pay WHERE ord // 120 % 5 = 2"),
    "error_reasons": over_books(
        "SELECT 'missing required field(s): issued_at' AS reason, count(DISTINCT ord // 120) AS rows, 1 AS first_row FROM inv WHERE ord // 120 % 5 = 2"),
    "file_kinds": over_books(
        "SELECT 'f' || k AS path, CASE WHEN k % 12 = 5 THEN 'empty' ELSE ['xlsx', 'image', 'image', 'image', 'pdf', 'csv'][k % 6 + 1] END AS kind FROM o"),
    "file_previews": over_books(
        "SELECT path, n AS row_number, 'Settlement ID,UTR Number,Gross Amount,Net Payout,Fees,GST,Adjustment,Settlement Date,Payment IDs' AS headers, v AS first_value "
        "FROM (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY place) AS n FROM ("
        "SELECT 'settlement/' || lpad(CAST(b // 120 AS VARCHAR), 9, '0') || '.csv' AS path, id AS v, b AS place FROM stl "
        "UNION SELECT 'settlement/' || lpad(CAST(b // 120 AS VARCHAR), 9, '0') || '.csv', 'BAD', -1 FROM stl WHERE b // 120 % 5 = 2)) WHERE n <= 5"),
    "statement_lines": over_books(
        f"SELECT id, strftime(value_date, '%d/%m/%Y') AS date, trim(regexp_replace(narration, '\\s+', ' ', 'g')) AS narration, "
        f"{grouped('credit')} AS amount, 'CR' AS sign FROM bank"),
    "text_round_trip": over_books("SELECT id, number, customer, amount, issued_at, coalesce(ref, id) AS ref FROM inv"),
    "header_mapping": over_books(
        "SELECT role, sha256(array_to_string(list_transform(list_append(string_split(h, ';'), 'Extra ' || e), lambda x: lower(x)), chr(31))) AS signature, "
        "m || CASE role WHEN 'ledger' THEN ',number' ELSE ',-' END AS fields "
        "FROM (SELECT DISTINCT o_custkey AS e FROM o), (VALUES "
        "('ledger', 'Invoice No;Customer Name;Amount Due;Invoice Date;Reference;Notes', 'id,customer,amount,issued_at,ref,-'), "
        "('gateway', 'Payment ID;Invoice Ref;Gross Amount;Gateway Fee;GST on Fee;Status;Created At;Method;Settlement ID', "
        "'id,invoice_ref,gross,fee,tax,status,captured_at,method,settlement_id'), "
        "('settlement', 'Settlement ID;UTR Number;Gross Amount;Net Payout;Fees;GST;Adjustment;Settlement Date;Payment IDs', "
        "'id,utr,-,payout,fees,tax,adjustments,settled_at,payment_ids'), "
        "('bank', 'Txn ID;Value Date;Narration;Deposit;Withdrawal;Balance', 'id,value_date,narration,credit,debit,balance')) AS r(role, h, m)"),
}

_CATALOG = """
runs AS (
  SELECT 'RUN' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, o_custkey AS user_id,
         CASE WHEN k % 5 <> 0 THEN 'DS' || lpad(CAST(k // 8 AS VARCHAR), 8, '0') END AS dataset_id,
         ['queued', 'matching', 'complete', 'failed', 'complete'][k % 5 + 1] AS state,
         CASE WHEN k % 3 <> 0 THEN 'key-' || (k // 2) END AS idempotency_key, k * 7919 % 100003 AS created_at FROM o),
datasets AS (
  SELECT 'DS' || lpad(CAST(k // 8 AS VARCHAR), 8, '0') AS id, o_custkey AS user_id, 'books ' || (k // 16) AS name,
         k // 8 % 3 = 0 AS has_truth, k // 8 AS n FROM o WHERE k % 8 = 0),
files AS (
  SELECT 'DS' || lpad(CAST(k // 8 AS VARCHAR), 8, '0') AS dataset_id, ['ledger', 'gateway', 'settlement', 'bank'][k % 8 + 1] AS role,
         k % 97 + 1 AS row_count, CASE WHEN k % 13 = 3 THEN 0 ELSE k % 97 END AS valid_count, k FROM o WHERE k % 8 < 4 AND k % 11 <> 5),
readiness AS (
  SELECT d.*, (SELECT count(DISTINCT role) FROM files f WHERE f.dataset_id = d.id AND valid_count > 0) AS roles_ready FROM datasets d)"""
_READY = "CASE WHEN roles_ready = 4 THEN 'ready' ELSE 'draft' END AS status"


def _over_catalog(select: str) -> str:
    return over_books(select, _CATALOG)


# Windows against the limits in force when they began.
_LIMITS = """
WITH calls AS (SELECT event_type AS model, 'key-' || user_id % 3 AS key, user_id, CAST(floor(value) AS BIGINT) AS tokens, ts FROM events),
limits AS (
  SELECT model, 1 AS rpm, 20 + length(model) - 4 * n AS rpd, 100 + 200 * n AS tpm, CASE n WHEN 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-12' END AS valid_from
  FROM (SELECT DISTINCT model FROM calls), (VALUES (0), (1)) AS v(n) WHERE model <> 'signup' OR n = 1),
pool AS (SELECT key, CASE key WHEN 'key-2' THEN TIMESTAMP '2024-01-20' ELSE CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) END AS active_from FROM calls GROUP BY key),
minutes AS (SELECT date_trunc('minute', ts) AS w, model, key, count(*) AS n, sum(tokens) AS t FROM calls GROUP BY ALL),
days AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS w, model, key, count(*) AS n FROM calls GROUP BY ALL),
users AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS w, user_id, count(*) AS n FROM calls GROUP BY ALL),
used AS (
  SELECT 'rpm' AS scope, model, key, NULL AS user_id, w, n AS used, (SELECT arg_max(rpm, valid_from) FROM limits l WHERE l.model = m.model AND valid_from <= w) AS ceiling FROM minutes m
  UNION ALL SELECT 'tpm', model, key, NULL, w, t, (SELECT arg_max(tpm, valid_from) FROM limits l WHERE l.model = m.model AND valid_from <= w) FROM minutes m
  UNION ALL SELECT 'rpd', model, key, NULL, w, n, (SELECT arg_max(rpd, valid_from) FROM limits l WHERE l.model = d.model AND valid_from <= w) FROM days d
  UNION ALL SELECT 'user_day', NULL, NULL, user_id, w, n, 25 * greatest(1, (SELECT count(*) FROM pool WHERE active_from <= w)) FROM users)
SELECT scope, model, key, CAST(user_id AS BIGINT) AS user_id, strftime(w, '%Y-%m-%d %H:%M') AS window_start, CAST(used AS BIGINT) AS used,
       CAST(ceiling AS BIGINT) AS ceiling, CAST(greatest(used - ceiling, 0 * ceiling) AS BIGINT) AS over FROM used"""

_TRACE = """WITH trace AS (
  SELECT 'run-' || user_id AS run_id, CASE WHEN event_type = 'error' AND value < 90 THEN 'explaining' ELSE
         CASE event_type WHEN 'signup' THEN 'normalising' WHEN 'view' THEN 'matching' WHEN 'click' THEN 'triaging'
              WHEN 'purchase' THEN 'scoring' ELSE 'failed' END END AS state, ts AS seen_at, event_id FROM events),
standing AS (
  SELECT run_id, coalesce(arg_min(state, seen_at) FILTER (state IN ('complete', 'failed')), arg_max(state, (seen_at, event_id))) AS state,
         min(seen_at) AS created_at, max(seen_at) AS updated_at FROM trace GROUP BY 1)
"""

CATALOG = {
    "dataset_readiness": _over_catalog(f"SELECT id, roles_ready, {_READY} FROM readiness"),
    "ready_datasets": _over_catalog("SELECT id, name FROM readiness WHERE roles_ready = 4"),
    "runs_per_dataset": _over_catalog(
        "SELECT d.id AS dataset_id, (SELECT count(*) FROM runs r WHERE r.dataset_id = d.id) AS runs FROM datasets d"),
    "repeated_request_keys": _over_catalog(
        "SELECT user_id, idempotency_key, count(*) AS copies FROM runs WHERE idempotency_key IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT user_id, name, count(*) FROM datasets WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1"),
    "idempotent_runs": _over_catalog(
        "SELECT id, user_id % 7 AS user_id, idempotency_key FROM runs QUALIFY idempotency_key IS NULL OR "
        "row_number() OVER (PARTITION BY user_id % 7, idempotency_key ORDER BY created_at, id) = 1"),
    "replaced_files": _over_catalog(
        "SELECT dataset_id, role, CASE WHEN up THEN row_count + n * 1000 ELSE row_count END AS row_count, "
        "CASE WHEN up THEN row_count + n ELSE valid_count END AS valid_count FROM "
        "(SELECT *, k % 6 = 0 OR k % 9 = 1 AS up, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS n FROM files)"),
    "deleted_datasets": _over_catalog(
        "SELECT id AS dataset_id, (SELECT count(*) FROM files f WHERE f.dataset_id = d.id) AS files, "
        "(SELECT count(*) FROM runs r WHERE r.dataset_id = d.id) AS runs FROM datasets d WHERE n % 4 = 1"),
    "surviving_runs": _over_catalog(
        "SELECT id, dataset_id FROM runs WHERE dataset_id IS NULL OR dataset_id NOT IN (SELECT id FROM datasets WHERE n % 4 = 1)"),
    "removed_files": _over_catalog(
        f"SELECT id, roles_ready, {_READY} FROM (SELECT d.id, (SELECT count(DISTINCT role) FROM files f WHERE f.dataset_id = d.id "
        "AND valid_count > 0 AND NOT (role = 'bank' AND row_count % 2 = 0)) AS roles_ready FROM datasets d)"),
    "newest_runs": _over_catalog(
        "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, id, state FROM runs QUALIFY position <= 3"),
    "user_runs": _over_catalog(
        "SELECT id, state, dataset_id FROM runs WHERE user_id = 5 ORDER BY created_at DESC, id DESC LIMIT 50"),
    "run_datasets": _over_catalog(
        "SELECT r.id AS run_id, r.dataset_id, d.name, coalesce(d.has_truth, r.dataset_id IS NULL) AS has_truth_file, f.role, f.row_count, f.valid_count "
        "FROM runs r LEFT JOIN datasets d ON r.dataset_id = d.id LEFT JOIN files f ON f.dataset_id = r.dataset_id"),
    "record_page": over_books(
        "SELECT id, amount, (SELECT count(*) FROM inv) AS total FROM inv ORDER BY ord LIMIT 200 OFFSET 400"),
    "run_states": _TRACE + "SELECT run_id, state FROM standing",
    "orphan_sweep": _TRACE + "SELECT run_id, CASE WHEN state = 'complete' THEN state ELSE 'failed' END AS state, "
                             "state NOT IN ('complete', 'failed') AS swept FROM standing",
    "stage_durations": _TRACE + """, seen AS (SELECT run_id, state, min(seen_at) AS seen_at FROM trace GROUP BY ALL),
staged AS (
  SELECT *, list_position(['queued', 'normalising', 'matching', 'triaging', 'explaining', 'scoring', 'failed'], state) AS s FROM (
  SELECT * FROM seen UNION ALL SELECT run_id, 'queued', min(seen_at) FROM trace GROUP BY run_id HAVING bool_or(state = 'normalising')))
SELECT run_id, state, epoch_us(lead(seen_at) OVER (PARTITION BY run_id ORDER BY s)) // 1000 - epoch_us(seen_at) // 1000 AS millis FROM staged QUALIFY state <> 'failed'""",
    "usage_against_limits": _LIMITS,
    "streamed_usage_against_limits": _LIMITS,
    "large_files": over_books("SELECT id, 'Naïve & Co, \"' || ord || '\" second line' AS customer, CAST(amount AS VARCHAR) AS amount, "
                              "strftime(issued_at, '%Y-%m-%d') AS issued_at, coalesce(ref, '') AS ref FROM inv"),
    "constraint_breaches": _over_catalog(
        "SELECT 'dataset name of a user' AS rule, to_json([CAST(user_id % 7 AS VARCHAR), name])::VARCHAR AS key, count(*) AS rows FROM datasets GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT 'role of a dataset', to_json([dataset_id, CASE WHEN k % 101 = 3 THEN 'invoice' ELSE role END])::VARCHAR, count(*) FROM files GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT 'known role', '[\"invoice\"]', count(*) FROM files WHERE k % 101 = 3 HAVING count(*) > 0 "
        "UNION ALL SELECT 'exception of a run', to_json(['r' || b % 3, 'EXC-settlement-' || id])::VARCHAR, 2 FROM stl WHERE b % 31 = 4 "
        "UNION ALL SELECT 'request key of a user', to_json([CAST(user_id % 7 AS VARCHAR), idempotency_key])::VARCHAR, count(*) FROM runs "
        "WHERE idempotency_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT DISTINCT 'held-out seeds', to_json([CAST(b AS VARCHAR)])::VARCHAR, 2 FROM o WHERE b % 50 = 1 AND b % 70 = 1"),
    "run_durations": _TRACE + "SELECT run_id, epoch_us(updated_at) // 1000 - epoch_us(created_at) // 1000 AS millis FROM standing",
    "usage_totals": "SELECT 'run-' || user_id AS run_id, count(*) AS requests, CAST(sum(floor(value)) AS BIGINT) AS tokens, "
                    "bool_or(value > 150) AS degraded FROM events GROUP BY 1",
    "streamed_states": _TRACE + "SELECT DISTINCT run_id, state FROM trace",
    "streamed_run_states": _TRACE + """, alive AS (
  SELECT * FROM trace t WHERE seen_at <= coalesce((SELECT min(seen_at) FROM trace f WHERE f.run_id = t.run_id AND f.state = 'failed'), TIMESTAMP '9999-01-01')),
moves AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seen_at, event_id) AS was FROM alive)
SELECT run_id, arg_max(state, (seen_at, event_id)) AS state, count(*) FILTER (was IS DISTINCT FROM state) AS transitions FROM moves GROUP BY 1""",
    "streamed_usage": "SELECT event_type AS model, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, greatest(count(*) - 50, 0) AS over "
                      "FROM events GROUP BY ALL",
    "incremental_groups": two_batches(
        "SELECT id, bank_line_id, CAST(0 AS BIGINT) AS batch FROM groups_a UNION ALL "
        "SELECT id, bank_line_id, CAST(1 AS BIGINT) FROM groups", "CAST(floor(ord / 3) AS BIGINT) % 2 = 1"),
    "incremental_exceptions": two_batches(
        ", all_members AS (SELECT * FROM members_a UNION ALL SELECT * FROM members), all_kept AS (SELECT * FROM kept_a UNION ALL "
        "SELECT * FROM kept), all_accepted AS (SELECT settlement_id FROM accepted_a UNION ALL SELECT settlement_id FROM accepted), "
        + re.sub(r"\b(members|kept|accepted)\b", r"all_\1", EXCEPTIONS)
        + " SELECT id, code, severity, amount_at_risk, kind, record_id, attempted, suggested_action FROM exc",
        "CAST(floor(ord / 3) AS BIGINT) % 2 = 1"),
    "usage_by_minute": "SELECT event_type AS model, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS calls, greatest(count(*) - 1, 0) AS over "
                       "FROM events GROUP BY ALL",
    "usage_by_user_day": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, greatest(count(*) - 3, 0) AS over FROM events GROUP BY ALL",
}


def _draw(kind: str) -> str:
    return f"CAST(('0x' || substr(md5('7:{kind}:' || id), 1, 8)) AS BIGINT) < {int(0.05 * 2 ** 32)}"


_CLEAN = """
hard AS (SELECT kind, id FROM key_records WHERE difficulty <> 'clean'),
dirty AS (
  SELECT group_id FROM key_members SEMI JOIN hard USING (kind, id)
  UNION SELECT settlement_id FROM key_groups WHERE bank_line_id IN (SELECT id FROM hard WHERE kind = 'bank_line')),
clean AS MATERIALIZED (SELECT settlement_id AS group_id FROM key_groups WHERE settlement_id NOT IN (SELECT group_id FROM dirty)),
fine_pay AS MATERIALIZED (SELECT pay.* FROM pay SEMI JOIN clean ON settlement_id = group_id),
fine_line AS MATERIALIZED (
  SELECT bank.* FROM bank JOIN key_records r ON r.kind = 'bank_line' AND r.id = bank.id SEMI JOIN clean USING (group_id))"""


def _over_faults(select: str) -> str:
    return over(select, "books", "key", extra=_CLEAN)


_HALF = "'pay_' || substr(md5('7:half:' || id || {0}), 1, 14)"

FAULTS = {
    "fault_duplicate_payment": _over_faults(
        "SELECT id, invoice_ref, gross, settlement_id FROM pay UNION ALL SELECT 'pay_' || substr(md5('7:copy:' || id), 1, 14), invoice_ref, gross, NULL "
        f"FROM fine_pay WHERE {_draw('duplicate_payment')}"),
    "fault_shift_date": _over_faults(
        f"SELECT id, CASE WHEN id IN (SELECT id FROM fine_line WHERE {_draw('shift_date')}) THEN value_date + 45 ELSE value_date END AS value_date FROM bank"),
    "fault_alter_amount": _over_faults(
        f"SELECT id, CASE WHEN id IN (SELECT id FROM fine_pay WHERE {_draw('alter_amount')}) THEN greatest(0, gross - 150000) ELSE gross END AS gross, fee FROM pay"),
    "fault_delete_bank_line": _over_faults(
        f"SELECT settlement_id, CASE WHEN bank_line_id NOT IN (SELECT id FROM fine_line WHERE {_draw('delete_bank_line')}) THEN bank_line_id END AS bank_line_id FROM key_groups"),
    "fault_inject_credit": _over_faults(
        "SELECT b.id, value_date, narration, credit, difficulty FROM bank b JOIN key_records r ON r.kind = 'bank_line' AND r.id = b.id UNION ALL "
        "SELECT 'BNKX' || substr(md5('7:stray:' || id), 1, 6) || '-' || ord, (SELECT max(value_date) FROM bank) + CAST(1 + d % 4 AS INTEGER), "
        "'MISC CREDIT ' || upper(substr(md5('7:text:' || id), 1, 8)), 2500 + d % 37900 * 25, 'unrelated_credit' "
        f"FROM (SELECT *, CAST(('0x' || substr(md5('7:credit:' || id), 1, 8)) AS BIGINT) AS d FROM bank WHERE {_draw('inject_unrelated_credit')})"),
    "fault_scramble_narration": over(
        "SELECT bank.id, CASE WHEN bank.id IN (SELECT id FROM fine_line WHERE " + _draw("scramble_narration") + ") AND tok.utr IS NOT NULL "
        "THEN replace(narration, tok.utr, 'REF*UNREADABLE*') || ' /CHQ RTN ADV/ **' ELSE narration END AS narration FROM bank LEFT JOIN tok USING (id)",
        "books", "links", "key", extra=_CLEAN),
    "fault_split_payment": _over_faults(
        "SELECT CASE h WHEN 0 THEN id WHEN 1 THEN " + _HALF.format("'1'") + " ELSE " + _HALF.format("'2'") + " END AS id, "
        + ", ".join(f"CASE h WHEN 0 THEN {c} WHEN 1 THEN {c} * 6 // 10 ELSE {c} - {c} * 6 // 10 END AS {c}" for c in ("gross", "fee", "tax")) +
        ", CASE h WHEN 0 THEN net WHEN 1 THEN gross * 6 // 10 - fee * 6 // 10 - tax * 6 // 10 "
        "ELSE gross - gross * 6 // 10 - (fee - fee * 6 // 10) - (tax - tax * 6 // 10) END AS net, "
        "CASE WHEN h < 2 THEN settlement_id END AS settlement_id, group_id, CASE WHEN h = 0 THEN difficulty ELSE 'partial_split' END AS difficulty FROM "
        "(SELECT pay.*, r.group_id, r.difficulty, unnest(CASE WHEN pay.id IN (SELECT id FROM fine_pay WHERE " + _draw("split_payment")
        + ") THEN [1, 2] ELSE [0] END) AS h FROM pay JOIN key_records r ON r.kind = 'payment' AND r.id = pay.id)"),
}

_ANSWERS = """
stated AS (
  SELECT k, list_distinct([CASE WHEN k % 7 = 3 THEN round(amount / 80.0, 2) ELSE round(amount / 100.0, 2) END, k % 1000 / 10.0,
         CAST(CASE WHEN k % 5 = 2 THEN b + 77777 ELSE b END AS DOUBLE)]) AS numbers,
         [round(amount / 100.0, 2), k % 1000 / 1000.0, CAST(b AS DOUBLE)] AS known FROM o),
pairs AS (
  SELECT k, n, list_bool_or([abs(n - v) < 0.05 OR (v <> 0 AND abs(n - v) / abs(v) < 0.01) FOR v IN
         list_concat(known, list_concat([round(x * 100, 6) FOR x IN known], [round(x / 100, 6) FOR x IN known]))]) AS ok
  FROM (SELECT k, known, unnest(numbers) AS n FROM stated))"""

AUDITS = {
    "answer_grounding": over_books(
        "SELECT k AS answer_id, count(*) AS numbers, count(*) FILTER (NOT ok) AS unexplained, bool_and(ok) AS grounded FROM pairs GROUP BY 1", _ANSWERS),
    "answer_citations": over_books(
        "SELECT k AS answer_id, kind, id, row_number() OVER (PARTITION BY k ORDER BY place) AS position, 2 AS total FROM ("
        "SELECT k, 'invoice' AS kind, 'INV' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, 1 AS place FROM o UNION ALL SELECT k, 'run', 'open', 2 FROM o)"),
}


COMPARISON = {
    "run_comparison": over_triage(
        "SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta_b_minus_a FROM (SELECT f.metric, f.a, f.b FROM (SELECT unnest(["
        + ", ".join(f"{{'metric': '{name}', 'a': CAST({a} AS DOUBLE), 'b': CAST({b} AS DOUBLE)}}" for name, a, b in (
            ("auto_rate", "auto / total", "auto / total"), ("assist_rate", "0", "assisted / total"),
            ("open_rate", "open_a / total", "open_b / total"), ("precision", "exact_a / groups_a", "exact_b / groups_b"),
            ("recall", "exact_a / truth", "exact_b / truth"), ("false_matches", "groups_a - exact_a", "groups_b - exact_b"),
            ("records", "records", "records"), ("open_exceptions", "filed_a", "filed_b"), ("amount_at_risk", "risk_a", "risk_b"),
            ("throughput_rps", "records * 1000 / millis_a", "records * 1000 / millis_b"), ("llm_requests", "calls_a", "calls_b"),
            ("llm_tokens", "tokens_a", "tokens_b")))
        + "]) AS f FROM counted))",
        extra=TRUTH + "," + EXACT + """,
both_groups AS (SELECT id FROM groups UNION ALL SELECT settlement_id FROM tried WHERE prop IN (SELECT prop FROM winners)),
both_members AS MATERIALIZED (
  SELECT group_id, kind, id FROM members
  UNION SELECT t.settlement_id, a.kind, a.id FROM asked_for a JOIN tried t USING (prop) WHERE prop IN (SELECT prop FROM winners)),
both_exact AS (
  SELECT id FROM both_groups g
  WHERE NOT EXISTS (SELECT 1 FROM both_members m ANTI JOIN key_members t USING (group_id, kind, id)
                    WHERE m.group_id = g.id AND m.kind IN ('invoice', 'payment'))
    AND NOT EXISTS (SELECT 1 FROM key_members t ANTI JOIN both_members m USING (group_id, kind, id) WHERE t.group_id = g.id)),
spent AS (SELECT user_id, count(*) AS calls, sum(floor(value)) AS tokens FROM events GROUP BY 1),
lasted AS (""" + _TRACE + """SELECT run_id, epoch_us(updated_at) // 1000 - epoch_us(created_at) // 1000 AS millis FROM standing),
counted AS (
  SELECT (SELECT count(*) FROM inv) + (SELECT count(*) FROM pay) + (SELECT count(*) FROM stl) + (SELECT count(*) FROM bank) AS records,
    (SELECT count(*) FROM pay) AS total, (SELECT count(DISTINCT id) FROM members WHERE kind = 'payment') AS auto,
    (SELECT count(DISTINCT id) FROM asked_for WHERE kind = 'payment' AND prop IN (SELECT prop FROM winners)) AS assisted,
    (SELECT count(DISTINCT record_id) FROM exc WHERE kind = 'payment') AS open_a,
    (SELECT count(DISTINCT record_id) FROM final_exc WHERE kind = 'payment') AS open_b,
    (SELECT count(*) FROM exact) AS exact_a, (SELECT count(*) FROM both_exact) AS exact_b,
    (SELECT count(*) FROM groups) AS groups_a, (SELECT count(*) FROM both_groups) AS groups_b,
    (SELECT count(*) FROM key_groups) AS truth, (SELECT count(*) FROM exc) AS filed_a, (SELECT count(*) FROM final_exc) AS filed_b,
    (SELECT sum(amount_at_risk) FROM exc) AS risk_a, (SELECT sum(amount_at_risk) FROM final_exc) AS risk_b,
    (SELECT calls FROM spent WHERE user_id = 1) AS calls_a, (SELECT calls FROM spent WHERE user_id = 2) AS calls_b,
    (SELECT tokens FROM spent WHERE user_id = 1) AS tokens_a, (SELECT tokens FROM spent WHERE user_id = 2) AS tokens_b,
    (SELECT millis FROM lasted WHERE run_id = 'run-1') AS millis_a, (SELECT millis FROM lasted WHERE run_id = 'run-2') AS millis_b)"""),
}


def statements() -> dict[str, str]:
    found = {**MATCHING, **SCORING, **REPORTING, **SCALARS, **FILES, **CATALOG, **FAULTS, **AUDITS, **COMPARISON}
    # what a stream leaves behind equals the table's own figures
    return {**found, "streamed_stage_durations": found["stage_durations"],
            "books_round_trip": f"SELECT part, h.* FROM ({found['output_hash']}) h, (VALUES ('books'), ('json')) AS p(part)"}

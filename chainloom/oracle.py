"""DuckDB SQL of each query of queries.py, over the same tables."""

from __future__ import annotations

CENTS = "CAST(round({} * 100) AS BIGINT)"
PRICE, TOTAL, VALUE = CENTS.format("l_extendedprice"), CENTS.format("o_totalprice"), CENTS.format("value")

#: t: transactions; n: with the spender of their outputs; o: outputs; h: history.
LEDGER = f"""
t AS (
  SELECT *, row_number() OVER (ORDER BY height, o_orderdate, o_orderkey) - 1 AS tx_ord
  FROM (SELECT *, datediff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 AS height FROM orders)),
n AS (SELECT *, lead(tx_ord) OVER (PARTITION BY o_custkey ORDER BY tx_ord) AS spender FROM t),
o AS (
  SELECT row_number() OVER (ORDER BY tx_ord, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS out_ord,
         tx_ord, height, spender, l_partkey AS lock, {PRICE} AS value
  FROM lineitem JOIN n ON l_orderkey = o_orderkey),
h AS (SELECT o.*, t.height AS spend_height FROM o LEFT JOIN t ON o.spender = t.tx_ord),
blocks AS (SELECT height, count(*) AS n_tx, min(tx_ord) AS first_tx FROM t GROUP BY height)"""

AMOUNTS = f"""
a AS (
  SELECT c_mktsegment AS segment, {TOTAL} AS amount FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'ALL', {TOTAL} FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (
  SELECT segment, amount, row_number() OVER (PARTITION BY segment ORDER BY amount) AS rn, count(*) OVER (PARTITION BY segment) AS count,
         sum(amount) OVER (PARTITION BY segment) AS total FROM a)"""


def over(sql: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + sql


MONTHLY = f"""
days AS (SELECT datediff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 AS height, {TOTAL} AS v FROM orders),
m AS (
  SELECT least((w + 1) * 30, 2430) AS height, (SELECT count(*) FROM days WHERE (days.height - 1) // 30 <= w)::BIGINT AS hits,
         (SELECT coalesce(sum(v), 0) FROM days WHERE (days.height - 1) // 30 <= w)::BIGINT AS sats
  FROM range(81) t(w)),
d AS (
  SELECT coalesce(lag(height) OVER (ORDER BY height), 0)::BIGINT AS from_height, height AS to_height, hits - coalesce(lag(hits) OVER (ORDER BY height), 0) AS all_hits,
         sats - coalesce(lag(sats) OVER (ORDER BY height), 0) AS all_sats FROM m)"""

EVENTS = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS ts FROM events)"


def asof(left: str, kind: str, stale: int, out: str) -> str:
    return f"""(SELECT v FROM (SELECT ts, min({VALUE}) AS v FROM e WHERE event_type = '{kind}' GROUP BY ts) p WHERE p.ts <= {left}.time AND {left}.time - p.ts <= {stale} ORDER BY ts DESC LIMIT 1) AS {out}"""


HEADERS = "hd AS (SELECT event_id AS height, ts AS time FROM e WHERE event_type NOT IN ('purchase', 'view'))"

FLAGS = """
f AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'keys' ELSE 'scripts20' END AS category, user_id AS digest, event_id AS height,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END AS byte FROM events)"""


def reduced() -> str:
    return "rev AS (SELECT category, digest, CASE WHEN category = 'keys' THEN bit_or(byte) ELSE max(byte) END AS byte, min(height) AS first_height FROM f GROUP BY category, digest)"


LOCKS = f"""
locks AS (
  SELECT l_partkey AS lock, sum({PRICE}) AS sats, CASE l_partkey % 4 WHEN 0 THEN 'p2pkh' WHEN 1 THEN 'p2sh' WHEN 2 THEN 'p2wpkh' ELSE 'p2wsh' END AS type FROM lineitem GROUP BY l_partkey),
opens AS (
  SELECT type, l_partkey AS lock, min(height) AS height
  FROM lineitem JOIN t ON l_orderkey = o_orderkey, (VALUES ('p2pkh'), ('p2wpkh'), ('p2sh')) v(type)
  WHERE l_returnflag = 'R' AND l_partkey % 3 <> 0 GROUP BY type, l_partkey),
b AS (SELECT locks.*, opens.height AS burn_height FROM locks LEFT JOIN opens USING (type, lock))"""

HEX24 = "lpad(printf('%X', {}), 24, '0')"
POINTS = f"""
p AS (SELECT lower({HEX24.format("round(value)::BIGINT")}) AS point, event_id AS height, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END + 4 AS flags FROM events)"""
WITNESS = f"""
w AS (
  SELECT lower({HEX24.format("floor(value / 3)::BIGINT")}) AS point, CASE WHEN user_id % 40 = 0 THEN user_id ELSE 1 END AS rest,
         CASE WHEN user_id % 7 <> 0 THEN user_id % 4 END AS key, length(event_type) AS s, event_id AS height
  FROM events)"""

FLOW = """
outv AS (SELECT tx_ord, sum(value) AS v FROM o GROUP BY tx_ord),
inv AS (SELECT spender AS tx_ord, sum(value) AS v FROM o WHERE spender IS NOT NULL GROUP BY spender),
flow AS (
  SELECT t.tx_ord, t.height, coalesce(inv.v, 0)::BIGINT AS value_in, coalesce(outv.v, 0)::BIGINT AS value_out,
         CASE WHEN inv.v IS NULL THEN 0 ELSE inv.v - coalesce(outv.v, 0) END::BIGINT AS fee
  FROM t LEFT JOIN inv USING (tx_ord) LEFT JOIN outv USING (tx_ord))"""

MINE = "mine AS (SELECT i - 1 AS pos, i AS lock FROM range(1, {}) v(i))"


def capped(cap: int, late: bool = False, source: str = "h") -> str:
    """first: the first spenders of each lock."""
    return f"""
fs AS (SELECT lock, spender, min(out_ord) AS first_out, max(out_ord) AS last_out FROM {source} WHERE spender IS NOT NULL GROUP BY lock, spender),
rk AS (SELECT *, row_number() OVER (PARTITION BY lock ORDER BY first_out) AS k, count(*) OVER (PARTITION BY lock) AS c, max(last_out) OVER (PARTITION BY lock) AS l FROM fs),
cs AS (SELECT *, c > {cap} OR {'c >= ' + str(cap) + ' AND l > max(CASE WHEN k = ' + str(cap) + ' THEN first_out END) OVER (PARTITION BY lock)' if late else 'false'} AS truncated FROM rk)"""


BRIDGE = f"""
hop AS (
  SELECT m.pos, x.lock AS bridge, min(t.height) AS height
  FROM cs JOIN mine m USING (lock) JOIN h x ON x.spender = cs.spender JOIN t ON t.tx_ord = cs.spender
  WHERE cs.k <= 50 AND x.lock <> m.lock AND x.lock NOT IN (SELECT lock FROM mine) GROUP BY m.pos, x.lock),
beside AS (SELECT cs.lock AS bridge, x.lock FROM cs JOIN h x ON x.spender = cs.spender WHERE cs.k <= 50 AND x.lock <> cs.lock AND cs.lock IN (SELECT bridge FROM hop)),
fan AS (SELECT bridge, count(*) AS fanout FROM beside GROUP BY bridge)"""

HEIGHT = "datediff('day', DATE '1995-01-01', o_orderdate::DATE) + 1"

ORACLE: dict[str, str] = {
    "order_stats_by_segment": over(
        """SELECT segment, max(count) AS count, max(total)::BIGINT AS total, (max(total) // max(count))::BIGINT AS mean, quantile_disc(amount, 0.5) AS median,
        quantile_disc(amount, 0.9) AS p90, quantile_disc(amount, 0.99) AS p99, max(amount) AS max,
        round(sum((2 * rn - count - 1)::HUGEINT * amount)::DOUBLE / (max(count)::DOUBLE * max(total)::DOUBLE), 9) AS gini FROM r GROUP BY segment""",
        AMOUNTS,
    ),
    "lorenz_points": over(
        """SELECT segment, p AS share, k, sum(amount)::BIGINT AS low_total, any_value(total)::BIGINT AS total FROM (
          SELECT r.*, p, least(greatest(round_even(p * count, 0)::BIGINT, 1), count) AS k FROM r, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p)) WHERE rn <= k GROUP BY segment, p, k""",
        AMOUNTS,
    ),
    "value_bands": over(
        """SELECT s.segment, b::INT AS band, lo AS band_from, count(amount) AS n, coalesce(sum(amount), 0)::BIGINT AS band_total
        FROM (SELECT DISTINCT segment FROM a) s CROSS JOIN (VALUES (0, 0::BIGINT, 1000000::BIGINT), (1, 1000000, 5000000), (2, 5000000, 10000000), (3, 10000000, 20000000), (4, 20000000, 1000000000000), (5, 1000000000000, 9000000000000000)) v(b, lo, hi)
        LEFT JOIN a ON a.segment = s.segment AND amount >= lo AND amount < hi GROUP BY s.segment, b, lo""",
        AMOUNTS,
    ),
    "top_n_share": over(
        "SELECT segment, k, least(k, any_value(count)) AS n, sum(amount)::BIGINT AS top_total, any_value(total)::BIGINT AS total FROM r, (SELECT unnest([1, 10, 100, 1000000000])::BIGINT AS k) WHERE rn > count - k GROUP BY segment, k", AMOUNTS
    ),
    "top_fraction_share": over(
        """SELECT segment, f AS fraction, k AS n, sum(amount)::BIGINT AS top_total, any_value(total)::BIGINT AS total FROM (
          SELECT r.*, f, greatest(1, ceil(f * count::DOUBLE))::BIGINT AS k FROM r, (SELECT unnest([0.001::DOUBLE, 0.01, 0.1, 0.5]) AS f)) WHERE rn > count - k GROUP BY segment, f, k""",
        AMOUNTS,
    ),
    "tail_share": over("SELECT segment, c AS cut, count(*) FILTER (amount >= c) AS tail_n, coalesce(sum(amount) FILTER (amount >= c), 0)::BIGINT AS tail_total FROM a, (SELECT unnest([1, 5000000, 15000000, 1000000000000])::BIGINT AS c) GROUP BY segment, c", AMOUNTS),
    "curve_deltas": over("SELECT * FROM d", MONTHLY),
    "interval_concentration": over(
        """SELECT count, total, gini_num, k, (SELECT sum(all_sats) FROM (SELECT all_sats, row_number() OVER (ORDER BY all_sats DESC) AS i FROM d) x WHERE i <= k)::BIGINT AS top_total
        FROM (SELECT count(*) AS count, sum(all_sats)::BIGINT AS total, sum((2 * rn - c - 1) * all_sats)::DECIMAL(38,0) AS gini_num
              FROM (SELECT all_sats, row_number() OVER (ORDER BY all_sats) AS rn, count(*) OVER () AS c FROM d)), (VALUES (5::BIGINT), (20)) v(k)""",
        MONTHLY,
    ),
    "reuse_curve_grid": f"""
        SELECT least((w + 1) * 100, 2450) AS height, {", ".join(f"count(*) FILTER (o_orderstatus = '{s}')::BIGINT AS {s}_hits, coalesce(sum({TOTAL}) FILTER (o_orderstatus = '{s}'), 0)::BIGINT AS {s}_sats" for s in "FOP")}
        FROM range(25) t(w) LEFT JOIN (SELECT *, {HEIGHT} AS height FROM orders) ON (height - 1) // 100 <= w GROUP BY w""",
    "revelation_windows": over(
        """SELECT least((w + 1) * 50, 2430) AS height, count(*) FILTER (k = 0) AS keys, count(*) FILTER (k = 1) AS scripts20, count(*) FILTER (k = 2) AS scripts32, count(k) AS total
        FROM range(49) v(w) LEFT JOIN (SELECT min(height) AS h, p_size % 3 AS k FROM o JOIN part ON lock = p_partkey GROUP BY lock, p_size) x ON (h - 1) // 50 = w GROUP BY w""",
        LEDGER,
    ),
    "last_line_wins": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {PRICE} AS cents FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
    "median_time_past": over(
        """SELECT height, time, list_sort(l)[len(l) // 2 + 1] AS median_time FROM (
          SELECT height, time, list(time) OVER (ORDER BY height ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l FROM (
            SELECT row_number() OVER (ORDER BY event_id)::INT AS height, ts + (event_id * 7919) % 4001 AS time FROM e WHERE event_type <> 'purchase'))""",
        EVENTS,
    ),
    "asof_price": over(f"SELECT height, time, {asof('hd', 'purchase', 3600, 'price')} FROM hd", EVENTS, HEADERS),
    "asof_price_ordered": over(
        f"""SELECT height, time, coalesce(a, b) AS price, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS series
        FROM (SELECT height, time, {asof('hd', 'purchase', 900, 'a')}, {asof('hd', 'view', 3600, 'b')} FROM hd)""",
        EVENTS,
        HEADERS,
    ),
    "daily_carry_forward": over(
        """, x AS (SELECT ts // 86400 AS day, CASE WHEN event_type = 'purchase' AND value > 20 THEN round(value, 2)::DECIMAL(20,6) END AS p, 'u' || user_id AS s FROM e),
        g AS (SELECT day, count(*) AS blocks, round((sum(p) / count(p))::DOUBLE, 6) AS mean, min(p)::DOUBLE AS lo, max(p)::DOUBLE AS hi, string_agg(DISTINCT s, '+' ORDER BY s) FILTER (p IS NOT NULL) AS names FROM x GROUP BY day),
        c AS (SELECT unnest(range((SELECT min(day) FROM g), (SELECT max(day) FROM g) + 1)) AS day),
        y AS (SELECT day, blocks, mean, lo, hi, names, last_value(CASE WHEN mean IS NOT NULL THEN day END IGNORE NULLS) OVER w AS held, last_value(mean IGNORE NULLS) OVER w AS carried FROM c LEFT JOIN g USING (day) WINDOW w AS (ORDER BY day))
        SELECT strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS date, coalesce(blocks, 0) AS blocks, carried AS price,
               CASE WHEN mean IS NOT NULL THEN 'measured' WHEN held IS NOT NULL THEN 'carried' ELSE 'none' END AS kind, day - held AS gap_days, lo AS price_min, hi AS price_max, coalesce(names, '') AS series FROM y""".lstrip(),
        EVENTS,
    ).replace("events)\n,", "events),", 1),
    "rewritten_past": over("SELECT count(*) AS changed_heights FROM blocks WHERE height < 2000 AND height % 97 = 0", LEDGER),
    "date_window": over("SELECT * FROM (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, count(*) AS n FROM e GROUP BY 1) WHERE date BETWEEN '2024-01-05' AND '2024-01-12'", EVENTS),
    "offsets_to_lengths": over("SELECT height, first_tx AS off, n_tx AS length FROM blocks", LEDGER),
    "order_violations": """
        SELECT count(*) FILTER (p < lp OR p = lp AND s <= ls) AS violations FROM (
          SELECT p, s, lag(p) OVER w AS lp, lag(s) OVER w AS ls FROM (SELECT l_orderkey * 8 + l_linenumber AS line, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY line))""",
    "ordinals": over("SELECT tx_ord, height, o_orderkey AS orderkey, sum(c) OVER (ORDER BY tx_ord)::BIGINT - c AS first_out, c AS n_out FROM (SELECT t.*, coalesce(c, 0) AS c FROM t LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)", LEDGER),
    "output_ordinals": over("SELECT out_ord, tx_ord, height, out_ord - min(out_ord) OVER (PARTITION BY tx_ord) AS vout, value, lock FROM o", LEDGER),
    "height_of_ordinal": over("SELECT tx_ord, height FROM t WHERE tx_ord % 3 = 0 AND tx_ord < 12000", LEDGER),
    "outputs_of_tx": over("SELECT tx_ord, vout, value, lock FROM (SELECT *, out_ord - min(out_ord) OVER (PARTITION BY tx_ord) AS vout FROM o) WHERE tx_ord BETWEEN 100 AND 140", LEDGER),
    "output_range": over("SELECT out_ord, lock, value FROM o WHERE out_ord >= 1000 AND out_ord < 1500", LEDGER),
    "whole_group": over("SELECT lock, out_ord, height, value, spender AS spender_tx FROM o WHERE lock = 7", LEDGER),
    "txid_index": over(
        """, x AS (SELECT o_custkey AS txid, tx_ord, c, sum(c) OVER (ORDER BY tx_ord)::BIGINT - c AS first_out FROM (SELECT t.*, coalesce(c, 0) AS c FROM t LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))
        SELECT txid, max_by(first_out, (first_out, c)) AS first_out, max_by(c, (first_out, c)) AS n_out, count(*) AS copies FROM x GROUP BY txid""",
        LEDGER,
    ).replace(")\n,", "),", 1),
    "resolve_inputs": over(
        """, x AS (SELECT o_custkey, max(first_out) AS first_out FROM (SELECT o_custkey, tx_ord, min(out_ord) AS first_out FROM o JOIN t USING (tx_ord) GROUP BY 1, 2) GROUP BY 1)
        SELECT first_out AS out_ord, tx_ord AS spender_tx FROM t LEFT JOIN x USING (o_custkey)""",
        LEDGER,
    ).replace(")\n,", "),", 1),
    "output_spenders": over("SELECT out_ord, spender AS spender_tx, spender::VARCHAR AS spenders FROM o", LEDGER),
    "history_rows": over("SELECT lock, out_ord, spender AS spender_tx, value FROM o", LEDGER),
    "history_events": over(
        """SELECT lock, height, out_ord, kind, value, sum(value) OVER (PARTITION BY lock ORDER BY height, out_ord, kind ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM (
          SELECT lock, height, out_ord, 'RECV' AS kind, value FROM h UNION ALL SELECT lock, spend_height, out_ord, 'SPEND', -value FROM h WHERE spender IS NOT NULL)""",
        LEDGER,
    ),
    "lock_balance": over("SELECT lock, count(*) FILTER (spender IS NULL) AS unspent_n, coalesce(sum(value) FILTER (spender IS NULL), 0)::BIGINT AS unspent FROM o GROUP BY lock", LEDGER),
    "balance_at_height": over("SELECT lock, sum(value)::BIGINT AS received, coalesce(sum(value) FILTER (spend_height <= 1200), 0)::BIGINT AS spent, (sum(value) - coalesce(sum(value) FILTER (spend_height <= 1200), 0))::BIGINT AS unspent FROM h WHERE height <= 1200 GROUP BY lock", LEDGER),
    "lock_summary": over(
        """SELECT lock, count(*) AS outputs, sum(value)::BIGINT AS received, count(spender) AS spent_n, coalesce(sum(value) FILTER (spender IS NOT NULL), 0)::BIGINT AS spent,
        coalesce(sum(value) FILTER (spender IS NULL), 0)::BIGINT AS unspent, min(height) AS first_height, greatest(max(height), max(spend_height)) AS last_height, min(spender) AS first_spender FROM h GROUP BY lock""",
        LEDGER,
    ),
    "history_totals": over("SELECT count(DISTINCT lock) AS locks, count(*)::BIGINT AS outputs, count(spender)::BIGINT AS spent_rows, sum(value) FILTER (spender IS NOT NULL)::BIGINT AS spent_value FROM o", LEDGER),
    "first_spend": over("SELECT lock, min(spender) AS spender_tx FROM o WHERE spender IS NOT NULL GROUP BY lock", LEDGER),
    "first_spend_window": over("SELECT lock, spender_tx, t.height FROM (SELECT lock, min(spender) AS spender_tx FROM o WHERE spender IS NOT NULL GROUP BY lock) JOIN t ON spender_tx = tx_ord WHERE t.height BETWEEN 500 AND 700", LEDGER),
    "fees_net_flow": over("SELECT tx_ord, value_in, value_out, fee FROM flow", LEDGER, FLOW),
    "fees_by_joins": over("SELECT tx_ord, value_in, value_out, fee FROM flow", LEDGER, FLOW),
    "supply_identity": over(
        f"""SELECT height // 210 AS bucket, count(*) AS blocks, sum(fees)::BIGINT AS fees, sum(coinbase)::BIGINT AS coinbase, sum(subsidy)::BIGINT AS subsidy, sum(greatest(subsidy + fees - coinbase, 0))::BIGINT AS unclaimed,
        count(*) FILTER (coinbase < subsidy + fees) AS short, count(*) FILTER (coinbase > subsidy + fees) AS violations
        FROM (SELECT height, max({TOTAL}) * 200 AS coinbase, 5000000000 >> (height // 210000) AS subsidy FROM t GROUP BY height) JOIN (SELECT height, sum(greatest(fee, 0))::BIGINT AS fees FROM flow GROUP BY height) USING (height) GROUP BY 1""",
        LEDGER,
        FLOW,
    ),
    "fiat_fees": over(
        f"""SELECT round(sum(fees::DECIMAL(18,0) * price / 100000000), 2)::DOUBLE AS fiat, count(price) AS priced, coalesce(sum(fees) FILTER (price IS NULL), 0)::BIGINT AS unpriced_fees
        FROM (SELECT height, sum(greatest(fee, 0))::BIGINT AS fees FROM flow GROUP BY height) LEFT JOIN (SELECT height, max({TOTAL})::DECIMAL(18,2) / 100 AS price FROM t WHERE height % 7 <> 0 GROUP BY height) USING (height)""",
        LEDGER,
        FLOW,
    ),
    "block_stats": over(
        """SELECT height, n_tx, coalesce(n_inputs, 0)::BIGINT AS n_inputs, coalesce(n_outputs, 0)::BIGINT AS n_outputs, coalesce(value_created, 0)::BIGINT AS value_created FROM blocks
        LEFT JOIN (SELECT height, count(*) AS n_outputs, sum(value) AS value_created FROM o GROUP BY height) USING (height)
        LEFT JOIN (SELECT spend_height AS height, count(*) AS n_inputs FROM h WHERE spender IS NOT NULL GROUP BY 1) USING (height)""",
        LEDGER,
    ),
    "block_stats_summary": over(
        f"""SELECT height // 365 AS bucket, min(height) AS from_height, count(*) AS blocks, sum(n)::BIGINT AS n_tx, sum(n)::BIGINT AS n_outputs, sum(v)::BIGINT AS value_created,
        max_by(height, (n, -height)) AS busiest, max_by(height, (v, -height)) AS richest FROM (SELECT height, count(*) AS n, sum({TOTAL}) AS v FROM t GROUP BY height) GROUP BY 1""",
        LEDGER,
    ),
    "slot_count": over("SELECT count(*) AS slots, count(spender) AS spent, count(*) FILTER (spender IS NULL) AS unspent FROM o", LEDGER),
    "utxo_census": over("SELECT p_type AS type, (height // 500) * 500 AS height_from, count(*) AS entries, sum(value)::BIGINT AS satoshis FROM o JOIN part ON lock = p_partkey WHERE spender IS NULL GROUP BY 1, 2", LEDGER),
    "utxo_census_pivot": over(
        f"""SELECT p_type AS type, {", ".join(f"coalesce(sum(value) FILTER (least(height // 500, 4) = {i}), 0)::BIGINT AS e{i + 1}" for i in range(5))}, sum(value)::BIGINT AS total
        FROM o JOIN part ON lock = p_partkey GROUP BY p_type""",
        LEDGER,
    ),
    "census_totals": f"SELECT coalesce(l_returnflag, 'ALL') AS type, count(*) AS entries, sum({PRICE})::BIGINT AS satoshis FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "cospends": over("SELECT a.out_ord, a.spender AS spender_tx, b.out_ord AS other_out, b.lock AS other_lock, b.value AS other_value FROM o a JOIN o b ON a.spender = b.spender AND a.out_ord <> b.out_ord WHERE a.lock = 3", LEDGER),
    "co_inputs_capped": over(
        """SELECT m.lock, coalesce(s, 0) AS spenders, coalesce(i, 0) AS other_inputs, coalesce(d, 0) AS other_locks, coalesce(t, false) AS truncated FROM mine m
        LEFT JOIN (SELECT lock, count(*) AS s, bool_or(truncated) AS t FROM cs WHERE k <= 12 GROUP BY lock) USING (lock)
        LEFT JOIN (SELECT cs.lock, count(*) AS i, count(DISTINCT x.lock) AS d FROM cs JOIN h x ON x.spender = cs.spender WHERE k <= 12 AND x.lock <> cs.lock GROUP BY cs.lock) USING (lock)""",
        LEDGER,
        MINE.format(9),
        capped(12, True),
    ),
    "common_input_pairs": over(
        """SELECT least(m.pos, b.pos) AS pos_a, greatest(m.pos, b.pos) AS pos_b, min_by(t.height, (t.height, t.tx_ord)) AS height, min_by(t.tx_ord, (t.height, t.tx_ord)) AS tx_ord
        FROM cs JOIN mine m USING (lock) JOIN h x ON x.spender = cs.spender JOIN mine b ON b.lock = x.lock JOIN t ON t.tx_ord = cs.spender WHERE k <= 20 AND b.pos <> m.pos GROUP BY 1, 2""",
        LEDGER,
        MINE.format(60),
        capped(20),
    ),
    "common_input_bridge": over(
        """SELECT least(hop.pos, m.pos) AS pos_a, greatest(hop.pos, m.pos) AS pos_b, min_by(bridge, (hop.height, bridge, fanout)) AS bridge, min(hop.height) AS height, min_by(fanout, (hop.height, bridge, fanout)) AS fanout
        FROM hop JOIN fan USING (bridge) JOIN beside USING (bridge) JOIN mine m ON m.lock = beside.lock WHERE fanout <= 120 AND m.pos <> hop.pos GROUP BY 1, 2""",
        LEDGER,
        MINE.format(9),
        capped(50),
        BRIDGE,
    ),
    "bridge_hubs": over("SELECT (SELECT count(DISTINCT bridge) FROM hop) AS bridges, (SELECT count(*) FROM fan WHERE fanout > 120) AS not_expanded", LEDGER, MINE.format(9), capped(50), BRIDGE),
    "payment_arcs": over("SELECT DISTINCT a.pos AS from_pos, b.pos AS to_pos, y.tx_ord FROM h x JOIN mine a USING (lock) JOIN o y ON y.tx_ord = x.spender JOIN mine b ON b.lock = y.lock WHERE a.pos <> b.pos", LEDGER, MINE.format(200)),
    "same_key": "SELECT a.p_partkey AS pos_a, b.p_partkey AS pos_b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND a.p_partkey % 2 <> b.p_partkey % 2",
    "separations": """
        WITH br AS (
          SELECT least(x.n_name, y.n_name) AS a, greatest(x.n_name, y.n_name) AS b, CASE WHEN s_suppkey % 4 = 0 THEN 'same_key' ELSE 'common_input' END AS kind, s_suppkey AS seen
          FROM supplier JOIN nation x ON s_nationkey = x.n_nationkey JOIN nation y ON y.n_nationkey = s_suppkey % 25 WHERE x.n_name <> y.n_name),
        best AS (SELECT a, b, min_by(kind, (kind <> 'same_key', seen)) AS kind, min_by(seen, (kind <> 'same_key', seen)) AS seen FROM br GROUP BY a, b)
        SELECT x.n_name AS group_a, y.n_name AS group_b, kind IS NULL AS held, kind AS broken_by, seen AS at_height
        FROM nation x JOIN nation y ON x.n_name < y.n_name LEFT JOIN best ON a = x.n_name AND b = y.n_name""",
    "lock_totals": f"""
        SELECT ['p2pkh', 'p2sh', 'p2wpkh', 'p2wsh', 'p2tr'][p_size % 5 + 1] AS type, l_partkey AS lock, sum({PRICE})::BIGINT AS sats, count(*) AS coins
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size % 5 <> 4 GROUP BY 1, 2""",
    "burn_semi": over("SELECT type, lock, sats::BIGINT AS sats, burn_height FROM b WHERE burn_height IS NOT NULL", LEDGER, LOCKS),
    "burn_anti": over("SELECT type, lock, sats::BIGINT AS sats FROM b WHERE burn_height IS NULL", LEDGER, LOCKS),
    "perimeter_table": over("SELECT coalesce(type, 'ALL') AS type, count(*) AS locks, sum(sats)::BIGINT AS sats, count(burn_height) AS hits, coalesce(sum(sats) FILTER (burn_height IS NOT NULL), 0)::BIGINT AS hit_sats FROM b GROUP BY ROLLUP (type)", LEDGER, LOCKS),
    "face_fanout": over("SELECT type, count(*) AS n, sum(height)::BIGINT AS heights FROM opens GROUP BY type", LEDGER, LOCKS),
    "bitmap_bytes": over("SELECT type, i // 8 AS byte_no, sum(CASE WHEN burn_height IS NULL THEN 0 ELSE 1 << (i % 8)::INT END)::INT AS byte FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY lock) - 1 AS i FROM b) GROUP BY 1, 2", LEDGER, LOCKS),
    "revelation_reduce": over("SELECT * FROM rev", FLAGS, reduced()),
    "perimeter_filter": over("SELECT * FROM rev WHERE category <> 'keys' OR byte & 3 <> 0", FLAGS, reduced()),
    "exposure_status": over(
        """SELECT a.*, CASE WHEN kind = 'p2tr' THEN 'exposed_by_construction' WHEN first_height IS NOT NULL THEN 'exposed_by_reuse' ELSE 'protected' END AS status, first_height
        FROM (SELECT CASE WHEN i % 3 = 0 THEN 'keys' ELSE 'scripts20' END AS category, i AS digest, CASE WHEN i % 11 = 0 THEN 'p2tr' ELSE 'p2pkh' END AS kind FROM range(160) v(i)) a LEFT JOIN rev USING (category, digest)""",
        FLAGS,
        reduced(),
    ),
    "nonce_groups": over(
        """SELECT point, count(*) AS count, bit_or(flags) AS flags, min(height) AS first_height, max(height) AS last_height,
        array_to_string(list_sort(list(height))[1:8], ', ') AS heights, CASE bit_or(flags) & 3 WHEN 1 THEN 'ecdsa' WHEN 2 THEN 'schnorr' ELSE 'ecdsa+schnorr' END AS schemes, bit_or(flags) & 3 = 3 AS mixed
        FROM p GROUP BY point HAVING count(*) >= 3""",
        POINTS,
    ),
    "nonce_tallies": over(
        """SELECT sum(c)::BIGINT AS records, sum(a)::BIGINT AS ecdsa, sum(b)::BIGINT AS schnorr, count(*) AS points, count(*) FILTER (c > 1) AS repeated_points, coalesce(sum(c - 1) FILTER (c > 1), 0)::BIGINT AS repeat_sightings
        FROM (SELECT point, count(*) AS c, count(*) FILTER (flags & 1 <> 0) AS a, count(*) FILTER (flags & 2 <> 0) AS b FROM p GROUP BY point)""",
        POINTS,
    ),
    "nonce_faults": over("SELECT count(*) FILTER (height % 100 = 0) AS bad_flags, count(*) FILTER (height < 1 OR height > (SELECT count(*) // 2 FROM events)) AS bad_heights, 0::BIGINT AS bad_widths FROM p", POINTS),
    "resolution_cases": over(
        """, k AS (SELECT point, key, count(DISTINCT s) AS ss, count(*) AS c, min(rest) AS lo, max(rest) AS hi FROM w GROUP BY point, key),
        g AS (SELECT point, min(lo) <> max(hi) AS several, bool_and(lo = 0 AND hi = 0) AS zero, count(*) FILTER (key IS NOT NULL AND ss >= 2) AS e, count(key) AS keys, coalesce(sum(c) FILTER (key IS NULL), 0) AS opaque, sum(c)::BIGINT AS rows FROM k GROUP BY point),
        q AS (SELECT *, CASE WHEN zero AND point = repeat('0', 24) THEN 'not-a-signature' WHEN several THEN 'prefix-collision' WHEN e > 0 THEN 'exposed' WHEN keys > 1 THEN 'distinct-keys' WHEN keys = 1 AND opaque = 0 THEN 'one-signature' ELSE 'undetermined' END AS resolution FROM g)
        SELECT point, resolution, CASE WHEN resolution = 'exposed' THEN e ELSE 0 END AS exposed, rows FROM q""",
        WITNESS,
    ).replace("= 0)\n,", "= 0),", 1),
    "witness_reduce": over(
        """SELECT point || lower(lpad(printf('%X', rest), 40, '0')) AS r, lower(lpad(printf('%X', key), 40, '0')) AS key, lower(lpad(printf('%X', s), 64, '0')) AS s, c AS count, height, CASE WHEN key IS NULL THEN 2 ELSE 0 END AS flags FROM (
          SELECT *, count(*) OVER (PARTITION BY point, rest, key) AS c, row_number() OVER (PARTITION BY point, rest, key ORDER BY height, s) AS k FROM (SELECT point, rest, key, s, min(height) AS height FROM w GROUP BY ALL)) WHERE k <= 2""",
        WITNESS,
    ),
    "own_repeats": """
        SELECT lower(lpad(printf('%X', floor(value / 5)::BIGINT), 64, '0')) AS r, count(*) AS count,
               CASE WHEN count(DISTINCT event_id % 2) = 1 AND count(DISTINCT event_id % 3) = 1 THEN 'identical' WHEN count(DISTINCT event_id % 2) = 1 THEN 'negated' WHEN bool_and(event_type <> 'view') THEN 'key-follows' ELSE 'unclear' END AS verdict
        FROM events WHERE user_id IN (9, 12) GROUP BY 1 HAVING count(*) > 1""",
    "two_road_diff": "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b",
    "ledger_identities": over(
        """SELECT 'history_rows' AS check_name, count(*) AS left_side, count(*) AS right_side FROM o
        UNION ALL SELECT 'spent_rows', count(spender), count(spender) FROM o
        UNION ALL SELECT 'spent_value', sum(value) FILTER (spender IS NOT NULL)::BIGINT, (SELECT sum(value_in) FROM flow)::BIGINT FROM o
        UNION ALL SELECT 'created_value', (SELECT sum(value_out) FROM flow)::BIGINT, sum(value)::BIGINT FROM o""",
        LEDGER,
        FLOW,
    ),
    "interval_gaps": over(
        """, x AS (SELECT DISTINCT (height // 10) * 10 + 1 AS a, (height // 10) * 10 + CASE (height // 10) % 30 WHEN 4 THEN 8 WHEN 9 THEN 12 ELSE 10 END AS b FROM blocks WHERE height % 50 <> 7),
        y AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM x)
        SELECT a AS from_height, b AS to_height, CASE WHEN e + 1 < a THEN 'gap' ELSE 'overlap' END AS kind FROM y WHERE e + 1 < a OR e >= a""",
        LEDGER,
    ).replace("height)\n,", "height),", 1),
    "bag_union": "SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1",
    "points_missing": "SELECT DISTINCT l_partkey AS point FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)",
    "append_equals_rebuild": "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b",
    "rewind_cut": over("SELECT lock, count(*) FILTER (spend_height IS NULL OR spend_height > 900) AS unspent_n, coalesce(sum(value) FILTER (spend_height IS NULL OR spend_height > 900), 0)::BIGINT AS unspent FROM h WHERE height <= 900 GROUP BY lock", LEDGER),
    "chain_breaks": over("SELECT height FROM (SELECT height, lag(height) OVER (ORDER BY height) AS l FROM blocks) WHERE l + 1 <> height", LEDGER),
    "interval_digests": over(
        "SELECT ((height - 1) // 365) * 365 + 1 AS from_height, ((height - 1) // 365 + 1) * 365 AS to_height, count(*) AS n, sha256(string_agg(tx_ord || '|' || o_orderkey, chr(10) ORDER BY height, tx_ord)) AS digest FROM t GROUP BY 1, 2", LEDGER
    ),
    "digests": """
        SELECT p_partkey, sha256(p_name) AS sha256, d AS sha256d, list_aggregate(list_reverse(regexp_extract_all(d, '..')), 'string_agg', '') AS display
        FROM (SELECT p_partkey, p_name, sha256(unhex(sha256(p_name))) AS d FROM part)""",
    "chain_scalars": f"""
        SELECT o_orderkey, least(h // 210000, 4)::INT AS epoch, h // 50000 * 50000 AS band, CASE WHEN h // 210000 < 64 THEN 5000000000 >> (h // 210000) ELSE 0 END AS subsidy,
               ({TOTAL}::DECIMAL(18,0) / 100000000)::DECIMAL(20,8)::VARCHAR AS coins, amount, micro FROM (
          SELECT *, o_orderkey * 997 AS h, round_even(({TOTAL}::DOUBLE / 7)::DECIMAL(20,3) * 1000000, 0)::BIGINT AS micro,
                 CASE WHEN o_orderkey = 0 THEN 0 WHEN (o_orderkey - 1) % 10 < 9 THEN ((o_orderkey - 1) // 90 * 10 + (o_orderkey - 1) // 10 % 9 + 1) * (10 ** ((o_orderkey - 1) % 10))::BIGINT ELSE ((o_orderkey - 1) // 10 + 1) * 1000000000 END AS amount FROM orders)""",
    "header_round_trip": """
        SELECT o_orderkey, 2::BIGINT AS version, floor(epoch(o_orderdate))::BIGINT AS time, 486604799::BIGINT AS bits, o_orderkey AS nonce, m AS merkle_root,
               list_aggregate(list_reverse(regexp_extract_all(sha256(unhex(sha256(unhex('02000000' || sha256(o_custkey::VARCHAR) || m || le(floor(epoch(o_orderdate))::BIGINT) || le(486604799) || le(o_orderkey))))), '..')), 'string_agg', '') AS block_id
        FROM (SELECT *, sha256(o_orderkey::VARCHAR) AS m FROM orders)""",
    "address_codec": """
        SELECT * FROM (VALUES
          (0::BIGINT, '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa', 'p2pkh', '62e907b15cbf27d5425399ebf6f0fb50ebb88f18', '76a91462e907b15cbf27d5425399ebf6f0fb50ebb88f1888ac', false),
          (1, 'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4', 'p2wpkh', '751e76e8199196d454941c45d1b3a323f1433bd6', '0014751e76e8199196d454941c45d1b3a323f1433bd6', false),
          (2, 'BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4', 'p2wpkh', '751e76e8199196d454941c45d1b3a323f1433bd6', '0014751e76e8199196d454941c45d1b3a323f1433bd6', false),
          (3, '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb', NULL, NULL, NULL, true)) v(pos, address, kind, digest, script, refused)
        UNION ALL SELECT p_partkey + 100, p_name, NULL, NULL, NULL, true FROM part""",
    "pubkey_shapes": "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 = 2 ELSE p_partkey % 4 IN (0, 1) END AS is_key, count(*) AS n FROM part GROUP BY 1",
    "sighash_codes": """
        SELECT CASE WHEN b IS NULL THEN 0 WHEN b IN (1, 2, 3) THEN b WHEN b IN (129, 130, 131) THEN b - 125 ELSE 7 END::INT * 4 AS bits, count(*) AS n,
               CASE WHEN b IS NULL THEN 0 WHEN b IN (1, 2, 3) THEN b WHEN b IN (129, 130, 131) THEN b - 125 ELSE 7 END::INT AS code
        FROM (SELECT CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 3 = 0 THEN 128 + event_id % 5 ELSE event_id % 5 END AS b FROM events) GROUP BY 1, 3""",
    "flag_stories": over(
        """SELECT category, digest, array_to_string(list_filter([CASE WHEN byte & 1 <> 0 THEN 'in a scriptSig' END, CASE WHEN byte & 2 <> 0 THEN 'in a witness' END, CASE WHEN byte & 4 <> 0 THEN 'inside a redeem script' END,
        CASE WHEN byte & 8 <> 0 THEN 'inside a witness script' END, CASE WHEN byte & 16 <> 0 THEN 'uncompressed' END], lambda x: x IS NOT NULL), '; ') AS story FROM rev""",
        FLAGS,
        reduced(),
    ),
    "height_samples": over(
        """, x AS (SELECT o_custkey, h, row_number() OVER (PARTITION BY o_custkey ORDER BY h) AS k FROM (SELECT o_custkey, height // 200 AS h FROM t)),
        y AS (SELECT o_custkey, h, count(*) AS c FROM x WHERE k <= 8 GROUP BY 1, 2)
        SELECT o_custkey, string_agg(CASE WHEN c > 1 THEN h || ' x' || c ELSE h::VARCHAR END, ', ' ORDER BY h) AS sample FROM y GROUP BY 1""",
        LEDGER,
    ).replace("height)\n,", "height),", 1),
    "tumbling_windows_demo": over(f"SELECT ts // 3600 * 3600 AS hour, event_type, count(*) AS n, sum({VALUE})::BIGINT AS cents FROM e GROUP BY 1, 2", EVENTS),
    "session_windows_demo": """
        SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (
          SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
}


def _le(value: str) -> str:
    """Four little-endian bytes of a number, as hex."""
    text = f"lpad(printf('%x', {value}), 8, '0')"
    return f"({text}[7:8] || {text}[5:6] || {text}[3:4] || {text}[1:2])"


for _value in ("floor(epoch(o_orderdate))::BIGINT", "486604799", "o_orderkey"):
    ORACLE["header_round_trip"] = ORACLE["header_round_trip"].replace(f"le({_value})", _le(_value))

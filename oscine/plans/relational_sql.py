"""The SQL twins of the relational queries."""

from oscine.plans.base import DAILY_SQL

_POINTS = "pts AS (SELECT p_partkey, p_brand, p_retailprice * 37 % 100 AS x, (p_partkey * 7919 % 1000) / 10.0::DOUBLE AS y FROM part)"
SQL = {
    "sha_manifest": "SELECT doc_id, sha256(text) AS sha, left(sha256(text), 12) AS short FROM documents",
    "manifest_diff": """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), a AS (SELECT * FROM h WHERE doc_id % 10 <> 3),
        b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN reverse(sha) ELSE sha END AS sha FROM h WHERE doc_id % 10 <> 7)
        SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.sha IS DISTINCT FROM b.sha""",
    "pack_verify": """SELECT CASE WHEN doc_id % 40 = 2 THEN 'missing' WHEN doc_id % 50 = 1 THEN 'tampered' ELSE 'ok' END AS verdict, count(*) AS n FROM documents GROUP BY 1""",
    "leakage": "SELECT user_id FROM events WHERE event_id % 3 <> 0 INTERSECT SELECT user_id FROM events WHERE event_id % 3 = 0",
    "split_by_recording": "SELECT CASE WHEN md5('3:' || user_id) < '4' THEN 'test' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "split_membership": "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "required_anti": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "allowlist": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)",
    "completeness": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
        SELECT o_custkey, 'left' AS side FROM a WHERE o_custkey NOT IN (FROM b) UNION ALL SELECT o_custkey, 'right' FROM b WHERE o_custkey NOT IN (FROM a)""",
    "log_join": """SELECT printf('S%d_T%02d_%s_high.rhd', c_custkey % 4, c_custkey, lower(c_mktsegment)) AS filename, count(*) AS trials, round(sum(o_totalprice), 2) AS total
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""",
    "budget_join": """WITH m AS (SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1)
        SELECT c_nationkey, n, balance, coalesce(n_name, '') AS n_name FROM m LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0""",
    "prioritized_lookup": """WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
        s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        m AS (SELECT c_custkey, s_suppkey, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_nationkey = c_nationkey THEN 1 ELSE 2 END AS priority FROM c LEFT JOIN s ON c.n_regionkey = s.n_regionkey)
        SELECT c_custkey, s_suppkey, priority FROM m QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority NULLS LAST, s_suppkey) = 1""",
    "via_in_pad": f"""WITH {_POINTS} SELECT a.p_brand, a.p_partkey, b.p_partkey AS other FROM pts a JOIN pts b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3""",
    "spatial_clearance": f"""WITH {_POINTS}, t(net, ax, ay, bx, b_y) AS (VALUES ('Brand#1', 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 90.0::DOUBLE), ('Brand#2', 10, 80, 90, 5), ('Brand#3', 50, 0, 50, 100)),
        u AS (SELECT *, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) AS s FROM pts JOIN t ON net <> p_brand),
        d AS (SELECT p_partkey, sqrt((x - ax - s * (bx - ax)) ** 2 + (y - ay - s * (b_y - ay)) ** 2) AS d FROM u)
        SELECT p_partkey, count(*) AS tracks, round(min(d), 6) AS clearance FROM d WHERE d < 1.5 GROUP BY 1""",
    "route_length": f"""WITH {_POINTS}, l AS (SELECT p_brand, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS leg FROM pts WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
        SELECT p_brand, round(sum(leg), 4) AS length, count(leg) AS legs FROM l GROUP BY 1""",
    "reachability": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 6) % 25 FROM nation WHERE n_nationkey % 4 = 0),
        r AS (SELECT 3 AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 26)
        SELECT CAST(node AS BIGINT) AS node, min(hops) AS hops FROM r GROUP BY 1""",
    "coordinate_snap": f"WITH {_POINTS} SELECT CAST(round_even(x / 0.25, 0) AS BIGINT) AS i, CAST(round_even(y / 0.25, 0) AS BIGINT) AS j, count(*) AS n FROM pts GROUP BY 1, 2 HAVING count(*) > 1",
    "report_blocks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
        b AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(t, '^[A-Z][a-z]+.*[.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS block FROM l)
        SELECT doc_id, block, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM b GROUP BY 1, 2""",
    "report_totals": """SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS links FROM pages""",
    "role_classify": """SELECT CASE WHEN regexp_matches(p_name, '^(small|tiny)') THEN 'minor' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastener' WHEN p_type IN ('ECONOMY', 'PROMO') THEN lower(p_type) ELSE p_type END AS role, count(*) AS n FROM part GROUP BY 1""",
    "json_walk": """WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_type, CASE WHEN k IS NULL THEN 'other' WHEN k < 30 THEN 'low' WHEN k < 70 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM k GROUP BY 1, 2""",
    "net_tokens": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '([a-z]+)', 1), lambda w: w <> 'ring'))), ',') AS tokens FROM part",
    "drc_histogram": """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT o_orderstatus, o_orderpriority, n, n > max(n) OVER (PARTITION BY o_orderstatus) - 20 AS over FROM c""",
    "contract_rules": """WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS discount, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned, max(l_quantity) AS largest FROM lineitem GROUP BY 1)
        SELECT l_suppkey, 'few_lines' AS rule, 'WARN' AS level FROM s WHERE n < 580 UNION ALL SELECT l_suppkey, 'discount', 'FAIL' FROM s WHERE discount > 0.0512
        UNION ALL SELECT l_suppkey, 'returned', 'FAIL' FROM s WHERE returned > 0.35 UNION ALL SELECT l_suppkey, 'largest', 'WARN' FROM s WHERE largest < 50""",
    "bringup_rules": """SELECT o_orderkey, 'blank' AS rule, 'FAIL' AS level FROM orders WHERE trim(o_orderpriority) = '' UNION ALL SELECT o_orderkey, 'enum', 'FAIL' FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
        UNION ALL SELECT o_orderkey, 'bounds', 'FAIL' FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 499000 UNION ALL SELECT o_orderkey, 'late', 'WARN' FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01'""",
    "lot_consistency": """WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags, count(*) AS lines FROM lineitem GROUP BY 1)
        SELECT flags, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines FROM c WHERE flags > 1 GROUP BY 1""",
    "data_sufficiency": """WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS channels, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
        SELECT CASE WHEN n >= 70 AND channels >= 5 AND days >= 25 THEN 'report' WHEN n >= 55 AND days >= 20 THEN 'demo' ELSE 'none' END AS tier, count(*) AS users FROM u GROUP BY 1""",
    "trial_order": """WITH t AS (SELECT s_nationkey AS session, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('5:' || s_suppkey), s_suppkey) AS INTEGER) AS trial FROM supplier)
        SELECT session, s_suppkey, trial, trial = 1 AS break, printf('S%d_T%02d', session, trial) AS filename FROM t""",
    "label_encode": "SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END AS code, count(*) AS n FROM customer GROUP BY 1",
    "calibrated_probs": """WITH e AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) * 5 AS x FROM embeddings),
        p AS (SELECT vec_id, i, exp((x - max(x) OVER w) / 1.5) / sum(exp(x / 1.5)) OVER w * exp(max(x) OVER w / 1.5) AS p FROM e WINDOW w AS (PARTITION BY vec_id))
        SELECT vec_id, min_by(i, (-p, i)) AS label, round(max(p), 5) AS confidence FROM p GROUP BY 1""",
    "status_bits": """WITH r AS (SELECT CAST(event_id % 256 AS INTEGER) AS b FROM events)
        SELECT b >> 7 & 1 = 1 AS drop_since_last, b >> 6 & 1 = 1 AS fifo_half_full, b >> 5 & 1 = 1 AS fifo_near_full, b >> 4 & 1 = 1 AS spi_crc_err, b >> 3 & 1 = 1 AS spi_timeout, b >> 2 & 1 = 1 AS overflow_sticky, b & 27 = 0 AS reserved_clean, count(*) AS n FROM r GROUP BY ALL""",
    "frame_crc": """WITH RECURSIVE b AS (SELECT c_custkey, [ascii(substr(c_name, i, 1)) FOR i IN range(1, length(c_name) + 1)] AS bytes FROM customer),
        s AS (SELECT c_custkey, bytes, 0 AS i, 65535 AS crc FROM b UNION ALL
          SELECT c_custkey, bytes, i + 1, CASE WHEN x >= 32768 THEN xor((x * 2) & 65535, 4129) ELSE (x * 2) & 65535 END
          FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(bytes[i // 8 + 1] AS INTEGER) * 256) ELSE crc END AS x FROM s WHERE i < 8 * len(bytes)))
        SELECT c_custkey, CAST(crc AS INTEGER) AS crc FROM s WHERE i = 8 * len(bytes)""",
    "nt_xent_pairs": """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label AS other, i, avg(x) AS c FROM e GROUP BY 1, 2),
        d AS (SELECT vec_id, label, other, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cos FROM e JOIN c USING (i) GROUP BY 1, 2, 3)
        SELECT label, other, count(*) AS n, round(avg(cos), 5) + 0.0 AS cos FROM d GROUP BY 1, 2""",
    "recovery_ratio": f"""WITH {DAILY_SQL}, p AS (SELECT channel, avg(rms) FILTER (day BETWEEN 0 AND 9) AS b, avg(rms) FILTER (day BETWEEN 10 AND 19) AS p, avg(rms) FILTER (day BETWEEN 20 AND 29) AS r FROM daily GROUP BY 1)
        SELECT channel, round(p / b, 6) AS noise_ratio, round(r / b, 6) AS recovery_ratio FROM p""",
}

"""The engine's own queries over the driver's tables, each with its SQL.

Keys begin with the row of SURVEY §2 that they show. A query is text in the
graph language, or a function of the session and the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .model import SHIFT, PropertyGraph
from .sources.tables import star_schema

FLAGSHIP = """MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region)
RETURN r.name AS region, count(*) AS customers, round(avg(c.acctbal) * 100) / 100 AS avg_bal ORDER BY region"""

_NEXT = "nx AS (SELECT * FROM (SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"
_SUP = "sup AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"

_WORDS = ("license", "email", "free", "mit")
_SEPARATORS = r"""[\s\p{Z}!"#$%&''()*+,\-./:;<=>?@\[\\\]\^`{|}~]+"""


def _bm25(words: tuple[str, ...]) -> str:
    """Okapi BM25 over documents.text, at most 10,000 hits."""
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0), m AS (SELECT count(*) AS docs, avg(n) AS mean FROM d),
f AS (SELECT doc_id, n, q, len(list_filter(w, lambda x: x = q)) AS tf FROM d, (SELECT unnest([{terms}]) AS q)),
i AS (SELECT q, count(*) AS df FROM f WHERE tf > 0 GROUP BY q)
SELECT doc_id AS d, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) * 10000) AS s
FROM f JOIN i USING (q), m WHERE tf > 0 GROUP BY 1 ORDER BY s DESC, d LIMIT 10000"""


#: key -> (query, SQL or None)
TEXTS: dict[str, tuple[str, str | None]] = {
    # scans
    "s1_all_nodes": ("MATCH (n) RETURN count(*) AS nodes", "SELECT ((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM conversations))::BIGINT AS nodes"),
    "s2_label_scan": ("MATCH (n:Nation) RETURN n.name AS name, n.nationkey AS nationkey", "SELECT n_name AS name, n_nationkey::BIGINT AS nationkey FROM nation"),
    "s3_eq_seek": ("MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN c.custkey AS k, c.name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "s4_range_seek": ("MATCH (p:Part) WHERE p.size >= 10 AND p.size < 20 RETURN p.partkey AS k, p.size AS size", "SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_size >= 10 AND p_size < 20"),
    "s7_inline_residual": ("MATCH (n:Nation) MATCH (c:Customer {custkey: n.nationkey}) RETURN n.name AS nation, c.name AS customer", "SELECT n_name AS nation, c_name AS customer FROM nation JOIN customer ON c_custkey = n_nationkey"),
    "s8_rel_residual": ("MATCH (o:Order)-[x:CONTAINS {quantity: 10}]->(p:Part) RETURN o.orderkey AS o, p.partkey AS p, x.price AS price", "SELECT l_orderkey AS o, l_partkey AS p, l_extendedprice AS price FROM lineitem WHERE l_quantity = 10"),
    # patterns
    "j1_one_hop": (FLAGSHIP, "SELECT r_name AS region, count(*)::BIGINT AS customers, round(avg(c_acctbal) * 100) / 100 AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "j2_undirected": ("MATCH (n:Nation)--(x) RETURN n.name AS name, count(*) AS c", "SELECT n_name AS name, (1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS c FROM nation"),
    "j3_type_alternation": ("MATCH (c:Customer)-[r:PLACED|IN_NATION]->(x) RETURN type(r) AS t, count(*) AS c", "SELECT 'PLACED' AS t, count(*)::BIGINT AS c FROM orders UNION ALL SELECT 'IN_NATION', count(*)::BIGINT FROM customer"),
    "j3_type_negation": ("MATCH (c:Customer)-[r:!PLACED]->(x) RETURN type(r) AS t, count(*) AS c", "SELECT 'IN_NATION' AS t, count(*)::BIGINT AS c FROM customer"),
    "j4_label_boolean": ("MATCH (x:(Customer|Supplier)&!Part) RETURN labels(x)[0] AS label, count(*) AS c, min(x.acctbal) AS low", "SELECT 'Customer' AS label, count(*)::BIGINT AS c, min(c_acctbal) AS low FROM customer UNION ALL SELECT 'Supplier', count(*)::BIGINT, min(s_acctbal) FROM supplier"),
    "j5_chain_unique": ("MATCH (a:Part)<-[:CONTAINS]-(o)-[:CONTAINS]->(b:Part) RETURN a.brand AS brand, count(*) AS c", "SELECT p_brand AS brand, count(*)::BIGINT AS c FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <> y.l_linenumber JOIN part ON p_partkey = x.l_partkey GROUP BY 1"),
    "j6_comma_cross": ("MATCH (r:Region), (n:Nation) RETURN r.name AS region, count(n) AS c", "SELECT r_name AS region, count(*)::BIGINT AS c FROM region, nation GROUP BY 1"),
    "j6_comma_shared": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*)::BIGINT AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "j7_cycle": ("MATCH (c:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(:Part)-[:SUPPLIED_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c) RETURN n.name AS nation, count(*) AS c", f"WITH {_SUP} SELECT n_name AS nation, count(*)::BIGINT AS c FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN sup ON p = l_partkey JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey AND n_nationkey = c_nationkey GROUP BY 1"),
    "j8_second_match": ("MATCH (c:Customer)-[:PLACED]->(o:Order) MATCH (o)-[:CONTAINS]->(p:Part) RETURN c.mktsegment AS seg, count(*) AS lines, sum(p.size) AS size", "SELECT c_mktsegment AS seg, count(*)::BIGINT AS lines, sum(p_size)::BIGINT AS size FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "j9_optional": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.custkey AS k, count(o) AS big, max(o.totalprice) AS most", "SELECT c_custkey AS k, count(o_orderkey)::BIGINT AS big, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1"),
    "j10_varlen": ("MATCH (e:Event)-[:NEXT*1..3]->(x:Event) RETURN e.kind AS kind, count(*) AS c, sum(x.eventid) AS total", f"WITH {_NEXT}, w AS (SELECT a, b FROM nx UNION ALL SELECT x.a, y.b FROM nx x JOIN nx y ON x.b = y.a UNION ALL SELECT x.a, z.b FROM nx x JOIN nx y ON x.b = y.a JOIN nx z ON y.b = z.a) SELECT event_type AS kind, count(*)::BIGINT AS c, sum(b)::BIGINT AS total FROM w JOIN events ON event_id = a GROUP BY 1"),
    "j10_varlen_zero": ("MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN n.name AS name, labels(x)[0] AS label", "SELECT n_name AS name, unnest(['Nation', 'Region']) AS label FROM nation"),
    "j10_varlen_rels": ("MATCH (c:Customer)-[rs:IN_NATION|IN_REGION*2..2]->(r:Region) RETURN c.custkey AS k, size(rs) AS hops, type(last(rs)) AS t, r.name AS region", "SELECT c_custkey AS k, 2::BIGINT AS hops, 'IN_REGION' AS t, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "j10_reach_distinct": ("MATCH (p:Part)-[:SUPPLIED_BY|IN_NATION|IN_REGION*1..3]->(x:Region) WITH DISTINCT p, x RETURN x.name AS region, count(*) AS parts", f"WITH {_SUP} SELECT r_name AS region, count(DISTINCT p)::BIGINT AS parts FROM sup JOIN supplier ON s = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "j11_acyclic": ("MATCH ACYCLIC (a:Nation)-[:IN_REGION*2..2]-(b:Nation) RETURN a.name AS name, count(*) AS c", "SELECT x.n_name AS name, count(*)::BIGINT AS c FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey GROUP BY 1"),
    "j11_walk": ("MATCH WALK (a:Nation)-[:IN_REGION*2..2]-(b:Nation) RETURN a.name AS name, count(*) AS c", "SELECT x.n_name AS name, count(*)::BIGINT AS c FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey GROUP BY 1"),
    "j11_simple": ("MATCH SIMPLE (a:Nation)-[:IN_REGION*2..2]-(b:Nation) RETURN a.name AS name, count(*) AS c", "SELECT x.n_name AS name, count(*)::BIGINT AS c FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey GROUP BY 1"),
    "j12_quantified": ("MATCH (e:Event) ((x)-[:NEXT]->(y)){1,3} (z:Event) RETURN e.kind AS kind, count(*) AS c", f"WITH {_NEXT}, w AS (SELECT a, b FROM nx UNION ALL SELECT x.a, y.b FROM nx x JOIN nx y ON x.b = y.a UNION ALL SELECT x.a, z.b FROM nx x JOIN nx y ON x.b = y.a JOIN nx z ON y.b = z.a) SELECT event_type AS kind, count(*)::BIGINT AS c FROM w JOIN events ON event_id = a GROUP BY 1"),
    "j13_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.custkey AS k, length(p) AS hops, [x IN nodes(p) | x.name][1] AS nation, size(relationships(p)) AS rels", "SELECT c_custkey AS k, 2::BIGINT AS hops, n_name AS nation, 2::BIGINT AS rels FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "j14_any_shortest": ("MATCH p = ANY SHORTEST (r:Region)-[:IN_NATION|IN_REGION*1..2]-(c:Customer) RETURN r.name AS region, count(*) AS c, min(length(p)) AS hops", "SELECT r_name AS region, count(*)::BIGINT AS c, 2::BIGINT AS hops FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "j15_all_shortest": ("MATCH ALL SHORTEST (n:Nation)-[rs:IN_NATION|SUPPLIED_BY*1..2]-(p:Part) RETURN n.name AS nation, count(*) AS paths, sum(size(rs)) AS hops", f"WITH {_SUP} SELECT n_name AS nation, count(*)::BIGINT AS paths, (2 * count(*))::BIGINT AS hops FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN sup ON s = s_suppkey GROUP BY 1"),
    "j16_shortest_k": ("MATCH p = SHORTEST 2 (n:Nation)-[:IN_NATION|SUPPLIED_BY*1..2]-(q:Part) RETURN n.name AS nation, count(*) AS paths", f"WITH {_SUP}, g AS (SELECT n_name, p, least(count(*), 2) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN sup ON s = s_suppkey GROUP BY 1, 2) SELECT n_name AS nation, sum(c)::BIGINT AS paths FROM g GROUP BY 1"),
    "j18_shortest_value": ("MATCH (r:Region), (n:Nation) RETURN n.name AS nation, r.name AS region, length(shortestPath((n)-[:IN_REGION*..3]->(r))) AS hops", "SELECT n_name AS nation, r_name AS region, CASE WHEN n_regionkey = r_regionkey THEN 1 END::BIGINT AS hops FROM nation, region"),
    "j19_semi": ("MATCH (p:Part) WHERE (p)<-[:CONTAINS]-(:Order) RETURN p.brand AS brand, count(*) AS c", "SELECT p_brand AS brand, count(*)::BIGINT AS c FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) GROUP BY 1"),
    "j20_anti": ("MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS {quantity: 1}]-() RETURN p.brand AS brand, count(*) AS c", "SELECT p_brand AS brand, count(*)::BIGINT AS c FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 1) GROUP BY 1"),
    "j21_exists": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 50 } RETURN c.mktsegment AS seg, count(*) AS c", "SELECT c_mktsegment AS seg, count(*)::BIGINT AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50) GROUP BY 1"),
    "j21_exists_value": ("MATCH (c:Customer) RETURN c.custkey AS k, EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.status = 'F' } AS has_f, (c)-[:PLACED]->() OR c.acctbal < 0 AS either", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR c_acctbal < 0 AS either FROM customer"),
    "j22_pattern_comprehension": ("MATCH (c:Customer) RETURN c.custkey AS k, size([(c)-[:PLACED]->(o) WHERE o.status = 'O' | o.orderkey]) AS open, reduce(s = 0, x IN [(c)-[:PLACED]->(o) | o.orderkey] | s + x) AS total", "SELECT c_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open, coalesce(sum(o_orderkey), 0)::BIGINT AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "j24_call_subquery": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.name AS top, c.acctbal AS bal ORDER BY bal DESC, top LIMIT 2 } RETURN n.name AS nation, top, bal", "SELECT n_name AS nation, c_name AS top, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_name) <= 2"),
    "j24_call_aggregate": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9900 RETURN count(*) AS rich, collect(c.custkey) AS ks } RETURN n.name AS nation, rich, size(ks) AS n", "SELECT n_name AS nation, count(c_custkey)::BIGINT AS rich, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY 1"),
    "j25_theta": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a.nationkey < b.nationkey RETURN r.name AS region, count(*) AS c", "SELECT r_name AS region, count(*)::BIGINT AS c FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey JOIN region ON r_regionkey = x.n_regionkey GROUP BY 1"),
    "j_khop_count": ("MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s) RETURN count(*) AS c", f"WITH {_SUP} SELECT count(*)::BIGINT AS c FROM lineitem JOIN sup ON p = l_partkey"),
    # clauses
    "p2_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS seg", "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "p3_where_3vl": ("MATCH (o:Order) WHERE NOT (o.status = 'F' OR null) RETURN count(*) AS none", "SELECT count(*)::BIGINT AS none FROM orders WHERE NOT (o_orderstatus = 'F' OR NULL)"),
    "p5_topk": ("MATCH (c:Customer) RETURN c.custkey AS k, c.acctbal AS bal ORDER BY bal DESC, k SKIP 2 LIMIT 10", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer ORDER BY bal DESC, k LIMIT 10 OFFSET 2"),
    "p8_unwind": ("UNWIND range(1, 5) AS x UNWIND [x, null, x * 10] AS y RETURN x, y", "SELECT x, unnest([x, NULL, x * 10]) AS y FROM (SELECT unnest(range(1, 6)) AS x)"),
    "p8_unwind_scalar": ("UNWIND 5 AS x UNWIND [] AS y RETURN x, y UNION ALL UNWIND 7 AS x RETURN x, 'a' AS y", "SELECT 7::BIGINT AS x, 'a' AS y"),
    "p9_for": ("FOR x IN [3, 1, 2] RETURN x, x ^ 2 AS sq", "SELECT x::BIGINT AS x, pow(x, 2)::DOUBLE AS sq FROM (SELECT unnest([3, 1, 2]) AS x)"),
    "p10_group_expr": ("MATCH (o:Order) RETURN o.status AS st, o.orderdate.year AS y, count(*) + 1 AS c, round(sum(o.totalprice) / count(*)) AS mean", "SELECT o_orderstatus AS st, year(o_orderdate)::BIGINT AS y, (count(*) + 1)::BIGINT AS c, round(sum(o_totalprice) / count(*)) AS mean FROM orders GROUP BY 1, 2"),
    "p11_having": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, count(*) AS c, avg(c.acctbal) AS bal WHERE c > 5 RETURN n.name AS nation, c, round(bal * 100) / 100 AS bal", "SELECT n_name AS nation, count(*)::BIGINT AS c, round(avg(c_acctbal) * 100) / 100 AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 5"),
    "p14_dialect": ("CYPHER 5 MATCH (n:Region) /* all */ RETURN count(n) AS c; ", "SELECT count(*)::BIGINT AS c FROM region"),
    "a_aggregates": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, count(*) AS a1, count(DISTINCT c.acctbal) AS a2, sum(c.custkey) AS a3, round(avg(c.acctbal) * 100) / 100 AS a4, min(c.acctbal) AS a5, max(c.name) AS a5b, round(stDev(c.acctbal) * 1000) / 1000 AS a7, round(stDevP(c.acctbal) * 1000) / 1000 AS a8, round(percentileCont(c.acctbal, 0.4) * 1000) / 1000 AS a9, percentileDisc(c.acctbal, 0.4) AS a10, list.sort(collect(c.custkey))[0] AS a6, size(collect(DISTINCT c.acctbal)) AS a6d", "SELECT c_mktsegment AS seg, count(*)::BIGINT AS a1, count(DISTINCT c_acctbal)::BIGINT AS a2, sum(c_custkey)::BIGINT AS a3, round(avg(c_acctbal) * 100) / 100 AS a4, min(c_acctbal) AS a5, max(c_name) AS a5b, round(stddev_samp(c_acctbal) * 1000) / 1000 AS a7, round(stddev_pop(c_acctbal) * 1000) / 1000 AS a8, round(quantile_cont(c_acctbal, 0.4) * 1000) / 1000 AS a9, quantile_disc(c_acctbal, 0.4) AS a10, min(c_custkey)::BIGINT AS a6, count(DISTINCT c_acctbal)::BIGINT AS a6d FROM customer GROUP BY 1"),
    "a_empty": ("MATCH (c:Customer) WHERE c.custkey < 0 RETURN count(*) AS c, sum(c.custkey) AS s, avg(c.acctbal) AS a, size(collect(c)) AS n, stDev(c.acctbal) AS sd, min(c.name) AS m, percentileCont(c.acctbal, 0.5) AS p", "SELECT 0::BIGINT AS c, 0::BIGINT AS s, NULL::DOUBLE AS a, 0::BIGINT AS n, 0.0::DOUBLE AS sd, NULL::VARCHAR AS m, NULL::DOUBLE AS p"),
    "u1_union_all": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.nationkey AS k UNION ALL MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey::BIGINT FROM supplier"),
    "u2_union": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.nationkey AS k UNION MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "u3_union_in_call": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.name AS x UNION WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN s.name AS x } RETURN n.name AS nation, count(x) AS c", "SELECT n_name AS nation, count(DISTINCT x)::BIGINT AS c FROM nation JOIN (SELECT c_nationkey AS k, c_name AS x FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier) ON k = n_nationkey GROUP BY 1"),
    # expressions
    "e_operators": ("MATCH (p:Part) RETURN p.partkey AS k, p.size / 3 AS d, p.size % 7 AS m, p.size / 0.0 AS inf, p.retailprice * 2 - 1 AS f, -p.size AS neg, p.size > 5 XOR p.brand = 'Brand#11' AS x, p.name STARTS WITH 'a' OR p.name ENDS WITH 'e' AS se, p.brand CONTAINS '#1' AS ct, p.brand =~ 'Brand#[12].' AS rx, p.size IN [1, 2, 3] AS in3, 'n' + p.size AS txt, p.nothing IS NULL AS nil, 1 < 'a' AS cmp, 1 = 'a' AS eq", "SELECT p_partkey AS k, (p_size // 3)::BIGINT AS d, (p_size % 7)::BIGINT AS m, 'inf'::DOUBLE AS inf, p_retailprice * 2 - 1 AS f, (-p_size)::BIGINT AS neg, (p_size > 5) <> (p_brand = 'Brand#11') AS x, starts_with(p_name, 'a') OR ends_with(p_name, 'e') AS se, contains(p_brand, '#1') AS ct, regexp_full_match(p_brand, 'Brand#[12].') AS rx, p_size IN (1, 2, 3) AS in3, 'n' || p_size AS txt, true AS nil, NULL::BOOLEAN AS cmp, false AS eq FROM part"),
    "e_case": ("MATCH (o:Order) RETURN o.orderkey AS k, CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o.totalprice > 300000 THEN 'big' WHEN o.totalprice > 100000 THEN 'mid' END AS b", "SELECT o_orderkey AS k, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::BIGINT AS a, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM orders"),
    "e_lists": ("MATCH (p:Part) WITH p, range(0, p.size) AS xs RETURN p.partkey AS k, xs[-1] AS last, size(xs[1..3]) AS n, any(x IN xs WHERE x > 40) AS an, all(x IN xs WHERE x < 60) AS al, none(x IN xs WHERE x = 7) AS no, single(x IN xs WHERE x = 7) AS si, reduce(s = 0, x IN [y IN xs WHERE y % 2 = 0 | y * y] | s + x) AS sq, 2 IN xs AS has", "SELECT p_partkey AS k, p_size::BIGINT AS last, least(p_size, 2)::BIGINT AS n, p_size > 40 AS an, true AS al, p_size < 7 AS no, p_size >= 7 AS si, coalesce(list_sum([y * y for y in range(0, p_size + 1) if y % 2 = 0]), 0)::BIGINT AS sq, p_size >= 2 AS has FROM part"),
    "e_maps": ("MATCH (n:Nation) WITH n{.name, .nationkey, twice: n.nationkey * 2} AS m, {a: 1, b: n.name} AS q RETURN m.name AS name, m.twice AS twice, q.a AS a, q['b'] AS b, size(keys(m)) AS ks", "SELECT n_name AS name, (n_nationkey * 2)::BIGINT AS twice, 1::BIGINT AS a, n_name AS b, 3::BIGINT AS ks FROM nation"),
    "e_cast": ("MATCH (p:Part) RETURN p.partkey AS k, CAST(p.size AS STRING) AS s, CAST(p.retailprice AS INTEGER) AS i, CAST('x' AS FLOAT) AS f", "SELECT p_partkey AS k, p_size::VARCHAR AS s, trunc(p_retailprice)::BIGINT AS i, NULL::DOUBLE AS f FROM part"),
    "f_string": ("MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.name) AS up, reverse(p.brand) AS rev, left(p.name, 3) AS l, right(p.name, 3) AS r, substring(p.name, 1, 4) AS sub, replace(p.brand, '#', '-') AS rep, size(split(p.brand, '#')) AS parts, string.join(['a', p.brand], '+') AS j, string.replaceRegex(p.brand, '[0-9]+', '$0') AS rr, string.matchRegex(p.brand, 'd#(.)')[0][1] AS mr, trim('\t x ') AS t, size(p.name) AS n", r"""SELECT p_partkey AS k, upper(p_name) AS up, reverse(p_brand) AS rev, left(p_name, 3) AS l, right(p_name, 3) AS r, substr(p_name, 2, 4) AS sub, replace(p_brand, '#', '-') AS rep, len(string_split(p_brand, '#'))::BIGINT AS parts, 'a+' || p_brand AS j, regexp_replace(p_brand, '[0-9]+', '$0') AS rr, regexp_extract(p_brand, 'd#(.)', 1) AS mr, 'x' AS t, length(p_name)::BIGINT AS n FROM part"""),
    "f_numeric": ("MATCH (s:Supplier) WITH s, s.acctbal AS b RETURN s.suppkey AS k, abs(b) AS a, ceil(b) AS c, floor(b) AS f, round(sqrt(abs(b)) * 1000) AS sq, round(b) AS r, round(log(abs(b) + 1) * 1000) AS l, log(0.0) AS ninf, sign(b) AS sg, round(sin(b) * 1000) AS si, round(pow(b, 2)) AS p, round(atan2(b, 2) * 1000) AS at, round(degrees(pi()) * 10) AS d, round(haversin(b) * 1000) AS h", "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(sqrt(abs(s_acctbal)) * 1000) AS sq, round(s_acctbal) AS r, round(ln(abs(s_acctbal) + 1) * 1000) AS l, '-inf'::DOUBLE AS ninf, CASE WHEN s_acctbal < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, round(sin(s_acctbal) * 1000) AS si, round(pow(s_acctbal, 2)) AS p, round(atan2(s_acctbal, 2) * 1000) AS at, 1800.0::DOUBLE AS d, round((1 - cos(s_acctbal)) / 2 * 1000) AS h FROM supplier"),
    "f_list": ("MATCH (p:Part) WITH p, [p.size, 3, p.size, 1] AS xs RETURN p.partkey AS k, head(xs) AS h, last(xs) AS l, size(tail(xs)) AS t, size(list.dedup(xs)) AS d, list.sort(xs)[0] AS s, list.remove(xs, 1)[1] AS rm, list.insert(xs, 1, 9)[1] AS ins, size(list.insertListElements(xs, [7, 3], 0, false)) AS il, size(range(5, 1)) AS none, range(5, 1, -2)[2] AS one, toStringList(xs)[0] AS ts", "SELECT p_partkey AS k, p_size::BIGINT AS h, 1::BIGINT AS l, 3::BIGINT AS t, len(list_distinct([p_size, 3, 1]))::BIGINT AS d, 1::BIGINT AS s, p_size::BIGINT AS rm, 9::BIGINT AS ins, (CASE WHEN p_size = 7 THEN 4 ELSE 5 END)::BIGINT AS il, 0::BIGINT AS none, 1::BIGINT AS one, p_size::VARCHAR AS ts FROM part"),
    "f_convert": ("MATCH (p:Part) RETURN p.partkey AS k, toString(1.0) AS a, toString(p.size) AS b, toInteger('42 ') AS c, toInteger('3.9') AS d, toInteger(3.9) AS e, toFloat('1e2') AS f, toBoolean('yes') AS g, toBoolean(' TRUE') AS h, coalesce(p.nothing, p.size) AS i, typeOf(p.size) AS j, 'x' + 2.0 AS l", "SELECT p_partkey AS k, '1' AS a, p_size::VARCHAR AS b, 42::BIGINT AS c, NULL::BIGINT AS d, 3::BIGINT AS e, 100.0::DOUBLE AS f, NULL::BOOLEAN AS g, true AS h, p_size::BIGINT AS i, 'Integer' AS j, 'x2' AS l FROM part"),
    "f_entity": ("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN c.custkey AS k, type(r) AS t, labels(n)[0] AS l, id(startNode(r)) = id(c) AS s, id(endNode(r)) = id(n) AS e, hasLabels(c, ['Customer']) AS hl, c:Nation AS hn, outdegree(c) AS od, indegree(n, 'IN_NATION') AS ind", "SELECT c_custkey AS k, 'IN_NATION' AS t, 'Nation' AS l, true AS s, true AS e, true AS hl, false AS hn, (1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey))::BIGINT AS od, ((SELECT count(*) FROM customer x WHERE x.c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS ind FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "f_temporal": ("MATCH (o:Order) WITH o, o.orderdate AS d RETURN o.orderkey AS k, d.year AS y, d.month AS m, d.day AS dd, d.dayOfWeek AS dow, d.weekDay AS wd, d.ordinalDay AS od, d.quarter AS q, d.week AS w, toString(date(d) + duration('P1M')) AS nx, toString(date('2023-01-31') + duration('P1M')) AS roll, duration('P1DT2H').hours AS h, toString(duration('PT0S')) AS z, localtime('10:20').minute AS mi", "SELECT o_orderkey AS k, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS dd, dayofweek(o_orderdate)::BIGINT AS dow, isodow(o_orderdate)::BIGINT AS wd, dayofyear(o_orderdate)::BIGINT AS od, quarter(o_orderdate)::BIGINT AS q, weekofyear(o_orderdate)::BIGINT AS w, strftime((date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INT))::DATE, '%Y-%m-%d') AS nx, '2023-03-03' AS roll, 2.0::DOUBLE AS h, 'P' AS z, 20::BIGINT AS mi FROM orders"),
    "f_spatial": ("MATCH (n:Nation) RETURN n.nationkey AS k, round(distance(point({latitude: n.nationkey, longitude: 10}), point({latitude: 0, longitude: 20}))) AS d, point({latitude: 1.5, longitude: 2}).latitude AS la", "SELECT n_nationkey::BIGINT AS k, round(2 * 6378140.0 * asin(sqrt(pow(sin((radians(0) - radians(n_nationkey)) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(0)) * pow(sin(radians(10) / 2), 2)))) AS d, 1.5::DOUBLE AS la FROM nation"),
    "f_vector": ("MATCH (v:Vec), (q:Vec) WHERE q.vecid = 0 RETURN v.vecid AS k, round(vec.cosineSimilarity(v.embedding, q.embedding) * 10000) AS c, round(vec.euclideanDistance(v.embedding, q.embedding) * 10000) AS e", "SELECT v.vec_id AS k, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 10000) AS c, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 10000) AS e FROM embeddings v, embeddings q WHERE q.vec_id = 0"),
    # procedures
    "c1_knn_cosine": ("MATCH (q:Vec) WHERE q.label = 3 CALL db.idx.vector.queryNodes('Vec', 'embedding', 3, q.embedding) YIELD node, score RETURN q.vecid AS q, count(node) AS n, round(max(score) * 10000) AS worst", "WITH d AS (SELECT q.vec_id AS q, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, v.vec_id AS v FROM embeddings q, embeddings v WHERE q.label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, v) AS r FROM d) SELECT q, count(*)::BIGINT AS n, round(max(s) * 10000) AS worst FROM r WHERE r <= 3 GROUP BY 1"),
    "c5_fulltext": (f"CALL db.idx.fulltext.queryNodes('Document', '{' | '.join(_WORDS)}') YIELD node, score RETURN node.docid AS d, round(score * 10000) AS s", _bm25(_WORDS)),
    "c10_bfs": ("MATCH (p:Part) WHERE p.partkey <= 60 CALL algo.BFS(p, 3, null) YIELD nodes, edges RETURN p.partkey AS k, size(nodes) AS n, size(edges) AS e, size([x IN nodes WHERE x:Region]) AS regions", """WITH s AS (SELECT DISTINCT l_partkey AS p, s_suppkey, n_nationkey, n_regionkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_partkey <= 60)
SELECT p AS k, (count(DISTINCT s_suppkey) + count(DISTINCT n_nationkey) + count(DISTINCT n_regionkey))::BIGINT AS n, (count(DISTINCT s_suppkey) + count(DISTINCT n_nationkey) + count(DISTINCT n_regionkey))::BIGINT AS e, count(DISTINCT n_regionkey)::BIGINT AS regions FROM s GROUP BY p"""),
    "c11_wcc": ("CALL algo.WCC({nodeLabels: ['Message'], relationshipTypes: ['REPLY']}) YIELD node, componentId WITH componentId AS c, count(*) AS size, min(node.conv) AS lo, max(node.conv) AS hi RETURN lo, hi, size", "SELECT conv_id AS lo, conv_id AS hi, count(*)::BIGINT AS size FROM conversations GROUP BY 1"),
    "c11_wcc_events": ("CALL algo.WCC({nodeLabels: ['User', 'Event'], relationshipTypes: ['DID', 'NEXT']}) YIELD node, componentId WITH componentId AS c, count(*) AS size, min(node.userid) AS u, count(node.userid) AS users RETURN u, users, size", "SELECT user_id AS u, 1::BIGINT AS users, (count(*) + 1)::BIGINT AS size FROM events GROUP BY 1"),
    "c12_pagerank": ("CALL algo.pageRank(null, 'IN_NATION') YIELD node, score WITH node, score WHERE node:Nation RETURN node.nationkey AS nation, round(score * 100000000) AS s", """WITH n AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM conversations) AS n, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS e),
d AS (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS d FROM nation)
SELECT n_nationkey AS nation, round((1 + 0.85::DOUBLE * d) / (n + 0.85::DOUBLE * e) * 100000000) AS s FROM d, n"""),
    "c13_harmonic": ("CALL algo.HarmonicCentrality({nodeLabels: ['Supplier', 'Nation', 'Region']}) YIELD node, score, reachable RETURN labels(node)[0] AS label, score, reachable, count(*) AS c", "SELECT 'Supplier' AS label, 1.5::DOUBLE AS score, 2::BIGINT AS reachable, count(*)::BIGINT AS c FROM supplier UNION ALL SELECT 'Nation', 1.0, 1, count(*)::BIGINT FROM nation UNION ALL SELECT 'Region', 0.0, 0, count(*)::BIGINT FROM region"),
    "c14_betweenness": ("CALL algo.betweenness({nodeLabels: ['Part', 'Supplier', 'Nation']}) YIELD node, score WITH node, score WHERE node:Supplier RETURN node.suppkey AS k, round(score * 10000) AS score", f"WITH {_SUP}, n AS (SELECT p, s, count(*) OVER (PARTITION BY p, s_nationkey) AS c FROM sup JOIN supplier ON s_suppkey = s) SELECT s_suppkey AS k, round(coalesce(sum(1.0::DOUBLE / c), 0) * 10000) AS score FROM supplier LEFT JOIN n ON s = s_suppkey GROUP BY 1"),
    "c15_label_propagation": ("CALL algo.labelPropagation({nodeLabels: ['Nation', 'Region'], maxIterations: 4}) YIELD node, communityId RETURN node.name AS name, communityId AS community", "SELECT n_name AS name, (281474976710656 + min(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS community FROM nation UNION ALL SELECT r_name, r_regionkey::BIGINT FROM region"),
    "f_string_trim": ("MATCH (p:Part) RETURN p.partkey AS k, toLower(p.name) AS a, lower(p.brand) AS b, upper(p.name) AS c, ltrim('  x ') AS d, rtrim('  x ') AS e, isEmpty(p.name) AS f, isEmpty('') AS g, isEmpty([]) AS h", "SELECT p_partkey AS k, lower(p_name) AS a, lower(p_brand) AS b, upper(p_name) AS c, 'x ' AS d, '  x' AS e, p_name = '' AS f, true AS g, true AS h FROM part"),
    "f_trigonometry": ("MATCH (s:Supplier) WITH s, s.acctbal / 10000.0 AS b RETURN s.suppkey AS k, round(log10(abs(b) + 1) * 10000) AS a, round(cot(b + 2) * 1000) AS b, round(acos(b) * 10000) AS c, round(asin(b) * 10000) AS d, round(atan(b) * 10000) AS f, round(tan(b) * 10000) AS g, round(exp(b) * 10000) AS h, round(radians(b) * 1000000) AS i, round(e() * 100000) AS j, round(cos(b) * 10000) AS l", "WITH s AS (SELECT s_suppkey AS k, s_acctbal / 10000.0::DOUBLE AS b FROM supplier) SELECT k, round(log10(abs(b) + 1) * 10000) AS a, round(cot(b + 2) * 1000) AS b, round(acos(b) * 10000) AS c, round(asin(b) * 10000) AS d, round(atan(b) * 10000) AS f, round(tan(b) * 10000) AS g, round(exp(b) * 10000) AS h, round(radians(b) * 1000000) AS i, 271828.0::DOUBLE AS j, round(cos(b) * 10000) AS l FROM s"),
    "f_convert_lists": ("MATCH (p:Part) RETURN p.partkey AS k, toIntegerList([toString(p.size), 'x'])[0] AS a, toFloatList(['1.5', 'y'])[0] AS b, toBooleanList(['true', 'no'])[0] AS c, toIntegerOrNull('z') AS d, toIntegerOrNull(toString(p.size)) AS e, toFloatOrNull('2.5') AS f, toBooleanOrNull('maybe') AS g, toStringOrNull(p.size) AS h, toIntegerList(['x'])[0] AS i", "SELECT p_partkey AS k, p_size::BIGINT AS a, 1.5::DOUBLE AS b, true AS c, NULL::BIGINT AS d, p_size::BIGINT AS e, 2.5::DOUBLE AS f, NULL::BOOLEAN AS g, p_size::VARCHAR AS h, NULL::BIGINT AS i FROM part"),
    "f_random": ("MATCH (s:Supplier) WITH rand() AS r, randomUUID() AS u, timestamp() AS t RETURN count(*) AS n, min(r) >= 0.0 AS lo, max(r) < 1.0 AS hi, min(size(u)) AS us, count(DISTINCT u) AS un, min(t) > 1600000000000 AS ts", "SELECT count(*)::BIGINT AS n, true AS lo, true AS hi, 36::BIGINT AS us, count(*)::BIGINT AS un, true AS ts FROM supplier"),
    "f_properties": ("MATCH (n:Nation) WITH properties(n) AS p RETURN p.nationkey AS k, p.name AS name", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation"),
    "f_vecf32": ("MATCH (v:Vec) RETURN v.vecid AS k, round(vec.cosineDistance(v.embedding, vecf32([x IN range(1, 64) | x % 7])) * 10000) AS c, round(similarity(v.embedding, v.embedding) * 10000) AS s", "SELECT vec_id AS k, round((1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda x: (x % 7)::DOUBLE))) * 10000) AS c, 10000.0::DOUBLE AS s FROM embeddings"),
    "f_temporal_types": ("MATCH (o:Order) WITH o, date(o.orderdate) AS d RETURN o.orderkey AS k, toString(date({year: d.year, month: d.month, day: 1})) AS first, toString(localtime('10:20:30')) AS t, localdatetime('2020-01-02T03:04:05').second AS sec, duration('P1Y2M').months AS m", "SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate::DATE), '%Y-%m-%d') AS first, '10:20:30' AS t, 5::BIGINT AS sec, 2.0::DOUBLE AS m FROM orders"),
    "c18_indexes": ("CALL db.indexes() YIELD label, type WITH type, count(*) AS n RETURN type, n", "SELECT * FROM (VALUES ('range', 10::BIGINT), ('vector', 1), ('fulltext', 2)) AS t(type, n)"),
    "c19_property_keys": ("CALL db.propertyKeys() YIELD propertyKey AS k WHERE k IN ['acctbal', 'conv', 'quantity', 'nothing'] RETURN k", "SELECT unnest(['acctbal', 'conv', 'quantity']) AS k"),
    "c19_visualization": ("CALL db.schema.visualization() YIELD source, type, target RETURN source, type, target", "SELECT * FROM (VALUES ('Nation', 'IN_REGION', 'Region'), ('Customer', 'IN_NATION', 'Nation'), ('Supplier', 'IN_NATION', 'Nation'), ('Customer', 'PLACED', 'Order'), ('Order', 'CONTAINS', 'Part'), ('Part', 'SUPPLIED_BY', 'Supplier'), ('User', 'DID', 'Event'), ('Event', 'NEXT', 'Event'), ('Message', 'REPLY', 'Message')) AS t(source, type, target)"),
    "p13_show": ("SHOW DATABASES", "SELECT 'default' AS name, 'online' AS status"),
    "j23_outer_variable": ("MATCH (n:Nation) WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE EXISTS { MATCH (s)<-[:SUPPLIED_BY]-(p:Part) WHERE p.size > n.nationkey } RETURN n.nationkey AS k, count(s) AS c", f"WITH {_SUP} SELECT s_nationkey::BIGINT AS k, count(*)::BIGINT AS c FROM supplier WHERE EXISTS (SELECT 1 FROM sup JOIN part ON p_partkey = p WHERE s = s_suppkey AND p_size > s_nationkey) GROUP BY 1"),
    "c17_stats": ("CALL db.meta.stats() YIELD nodeCount, relCount, labels RETURN labels.Customer AS customers, labels.Order AS orders, labels.Nation AS nations", "SELECT (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM nation)::BIGINT AS nations"),
    "c19_labels": ("CALL db.labels() YIELD label RETURN label ORDER BY label", "SELECT unnest(['Customer', 'Document', 'Event', 'Message', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User', 'Vec']) AS label"),
    "c19_types": ("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS t", "SELECT unnest(['CONTAINS', 'DID', 'IN_NATION', 'IN_REGION', 'NEXT', 'PLACED', 'REPLY', 'SUPPLIED_BY']) AS t"),
}


_NEIGHBOURS = "MATCH (q:Vec) WHERE q.vecid < 20 CALL db.idx.vector.queryNodes('Vec', 'embedding', 4, q.embedding) YIELD node, score RETURN q.vecid AS q, node.vecid AS v, round(score * 10000) AS s"


def _neighbours(distance: str, rows: str = "SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings") -> str:
    return f"WITH x AS ({rows}), d AS (SELECT q.k AS q, v.k AS v, {distance} AS s FROM x q, x v WHERE q.k < 20), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, v) AS r FROM d) SELECT q, v, round(s * 10000) AS s FROM r WHERE r <= 4"


_WRITTEN = """SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id <> 3 AND vec_id NOT BETWEEN 10 AND 19
UNION ALL SELECT vec_id - 10, list_transform(embedding::DOUBLE[], lambda x: -x) FROM embeddings WHERE vec_id BETWEEN 20 AND 29
UNION ALL SELECT -vec_id, list_reverse(embedding::DOUBLE[]) FROM embeddings WHERE vec_id BETWEEN 20 AND 29"""

_GRAPHS: dict[tuple[str, str], PropertyGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over a folder's tables, mapped once an application: reading
    their schemas costs more than a small query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = star_schema(spark, sf_dir)
    return _GRAPHS[key]


def _text(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, graph(spark, sf_dir)).run(query)


def s5_id_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations 1 and 3 by the ids that the graph gives them, and an id of nothing."""
    g = graph(spark, sf_dir)
    first = g.node_tables(lambda labels: "Nation" in labels)[0] << SHIFT
    return Engine(spark, g).run(f"MATCH (n:Nation) WHERE id(n) IN [{first + 1}, {first + 3}, -4] RETURN n.name AS name")


def w1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of all suppliers' keys, twice as many as there are, then a read."""
    e = Engine(spark, graph(spark, sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("explode(array(s_suppkey, -1 - s_suppkey)) AS k", "'S' || s_suppkey AS tag")
    e.write("UNWIND $rows AS r MERGE (s:Supplier {suppkey: r.k}) ON CREATE SET s.name = 'new' SET s.tag = r.tag", {"rows": rows})
    return e.run("MATCH (s:Supplier) RETURN s.suppkey AS k, s.name AS name, s.tag AS tag, s.acctbal AS bal")


def w6_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, graph(spark, sf_dir))
    e.write("MATCH (n:Nation {nationkey: 0}) DETACH DELETE n")
    return e.run("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(x) RETURN n.nationkey AS k, count(x) AS c")


def w8_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship from every customer to the nation after its own."""
    e = Engine(spark, graph(spark, sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c", "CAST((c_nationkey + 1) % 25 AS BIGINT) AS n")
    e.write("UNWIND $rows AS r MERGE (c:Customer {custkey: r.c})-[x:IN_NATION]->(n:Nation {nationkey: r.n}) SET x.second = true", {"rows": rows})
    return e.run("MATCH (c:Customer)-[x:IN_NATION]->(n:Nation) RETURN n.nationkey AS k, count(*) AS c, count(x.second) AS second")


def s9_dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions as a dump of statements, read back."""
    from .sources.dump import read_dump, write_dump
    from .storage import shared_root
    from .sources.tables import EdgeMap, NodeMap, from_tables

    g = graph(spark, sf_dir)
    t = lambda n: lambda: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    small = from_tables(
        spark,
        [NodeMap(("Region",), t("region"), "r_regionkey", {"regionkey": "r_regionkey", "name": "r_name"}, "regionkey"), NodeMap(("Nation",), t("nation"), "n_nationkey", {"nationkey": "n_nationkey", "name": "n_name"}, "nationkey"), NodeMap(("Supplier",), t("supplier"), "s_suppkey", {"suppkey": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal"}, "suppkey")],
        [EdgeMap("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey"), EdgeMap("IN_NATION", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey", {"since": "2000 + s_suppkey"})],
        g.indexes[:2] + tuple(x for x in g.indexes if x.label == "Supplier"),
    )
    folder = f"{shared_root(spark)}/lodegraph-dump-{uuid.uuid4().hex}"
    write_dump(small, folder)
    back = read_dump(spark, f"{folder}/*")
    return Engine(spark, back).run("MATCH (s:Supplier)-[x:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.suppkey AS k, s.name AS name, s.acctbal AS bal, n.name AS nation, r.name AS region, x.since AS since")


def _metric(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    """The neighbours of some vectors under another metric than the index has."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        g = g.with_version(indexes=tuple(replace(x, metric=metric) if x.kind == "vector" else x for x in g.indexes))
        return Engine(spark, g).run(_NEIGHBOURS)

    return query


def c4_knn_after_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search sees vectors that a write changed, made and took away."""
    e = Engine(spark, graph(spark, sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id BETWEEN 20 AND 29").selectExpr("explode(array(struct(vec_id - 10 AS k, transform(embedding, x -> -x) AS v), struct(-vec_id AS k, reverse(embedding) AS v))) AS r").select("r.k", "r.v")
    e.write("UNWIND $rows AS r MERGE (x:Vec {vecid: r.k}) SET x.embedding = vecf32(r.v)", {"rows": rows})
    e.write("MATCH (x:Vec {vecid: 3}) DETACH DELETE x")
    return e.run(_NEIGHBOURS)


def w3_to_w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation, replacement, patches, second labels and removal, one after the other."""
    e = Engine(spark, graph(spark, sf_dir))
    e.write("CREATE (r:Region {regionkey: 101, name: 'one'})")
    e.write("INSERT (r:Region {regionkey: 102, name: 'two'})")
    e.write("MERGE (r:Region {regionkey: 103}) ON CREATE SET r.name = 'three' ON MATCH SET r.name = 'old'")
    e.write("MERGE (r:Region {regionkey: 103}) ON CREATE SET r.name = 'new' ON MATCH SET r.name = 'four'")
    e.write("MATCH (r:Region {regionkey: 101}) SET r += {more: 5}")
    e.write("MATCH (r:Region {regionkey: 102}) SET r = {regionkey: 102, more: 6}")
    e.write("MERGE (r:Region {regionkey: 101})-[x:IN_REGION]->(s:Region {regionkey: 103}) SET x.since = 1")
    e.write("CALL consolidate()")
    e.write("MATCH (r:Region {regionkey: 0}) DETACH DELETE r")
    return e.run("MATCH (r:Region) OPTIONAL MATCH (r)-[x:IN_REGION]->(s:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN r.regionkey AS k, r.name AS name, r.more AS more, x.since AS since, s.regionkey AS beyond, count(n) AS nations")


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "s5_id_seek": (s5_id_seek, "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3)"),
    "c2_knn_l2": (_metric("euclidean"), _neighbours("list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))")),
    "c2_knn_dot": (_metric("dot"), _neighbours("-list_inner_product(q.e, v.e)")),
    "c4_knn_after_write": (c4_knn_after_write, _neighbours("1 - list_cosine_similarity(q.e, v.e)", _WRITTEN)),
    "w3_to_w14": (w3_to_w14, "SELECT r_regionkey::BIGINT AS k, r_name AS name, NULL::BIGINT AS more, NULL::BIGINT AS since, NULL::BIGINT AS beyond, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS nations FROM region WHERE r_regionkey <> 0 UNION ALL SELECT * FROM (VALUES (101, 'one', 5, 1, 103, 0), (102, NULL, 6, NULL, NULL, 0), (103, 'four', NULL, NULL, NULL, 0)) AS t(k, name, more, since, beyond, nations)"),
    "w1_merge": (w1_merge, "SELECT s_suppkey AS k, s_name AS name, 'S' || s_suppkey AS tag, s_acctbal AS bal FROM supplier UNION ALL SELECT -1 - s_suppkey, 'new', 'S' || s_suppkey, NULL FROM supplier"),
    "w6_detach_delete": (w6_detach_delete, "SELECT n_nationkey::BIGINT AS k, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS c FROM nation WHERE n_nationkey <> 0"),
    "w8_edges": (w8_edges, "SELECT n_nationkey::BIGINT AS k, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE (c_nationkey + 1) % 25 = n_nationkey))::BIGINT AS c, (SELECT count(*) FROM customer WHERE (c_nationkey + 1) % 25 = n_nationkey)::BIGINT AS second FROM nation"),
    "s9_dump_round_trip": (s9_dump_round_trip, "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, n_name AS nation, r_name AS region, (2000 + s_suppkey)::BIGINT AS since FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _text(q) for k, (q, _) in TEXTS.items()} | {k: f for k, (f, _) in FUNCTIONS.items()}
ORACLES: dict[str, str] = {k: sql for k, (_, sql) in (TEXTS | FUNCTIONS).items() if sql is not None}

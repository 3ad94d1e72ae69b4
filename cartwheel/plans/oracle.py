"""DuckDB SQL for each registered query, over the raw driver tables.

Each statement starts from the same mart views as ``sources.mart`` (written
here in SQL) and then states the query's definition literally, per customer
where the reference works per customer, so it is an independent check of the
batch rewrites in the Spark code.
"""

from __future__ import annotations

from ..operators import features, tune

MART_VIEWS = {
    "all_products": """
        SELECT CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS VARCHAR) AS style_id,
               CAST(p_partkey % 4 AS INTEGER) AS ref_id,
               p_name AS style_name, p_name AS prod_desc, p_brand AS sub_category,
               p_type AS high_category, CAST(p_size AS DOUBLE) AS pile_weight,
               concat(CAST(1995 + p_partkey % 7 AS VARCHAR), '-01-01') AS intro_date,
               CASE WHEN p_partkey % 29 = 0 THEN 'D' ELSE 'A' END AS status
        FROM part""",
    "products": """
        SELECT * FROM all_products WHERE style_name <> '"' AND status <> 'D'""",
    "all_invoices": """
        SELECT o_custkey AS customer_id,
               CAST(CAST(floor(l_partkey / 4.0) AS BIGINT) AS VARCHAR) AS style_id,
               CAST(l_partkey % 4 AS INTEGER) AS ref_id,
               CAST(o_orderdate AS DATE) AS invoice_date,
               l_quantity AS quantity,
               l_extendedprice / l_quantity AS unit_price,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS spend
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "invoices": """
        SELECT * FROM all_invoices WHERE spend > 0""",
    "first_orders": """
        SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order FROM orders GROUP BY o_custkey""",
    "all_customers": """
        SELECT c_custkey AS customer_id, c_name AS name,
               CASE WHEN c_acctbal < 0 THEN 'D' WHEN c_custkey % 10 = 0 THEN 'Z' ELSE 'A' END AS status,
               CAST(c_nationkey AS VARCHAR) AS zip,
               CAST(c_custkey % 3 AS INTEGER) AS common_customer,
               c_mktsegment AS channel,
               CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'NEG'
                    WHEN c_acctbal < 5000 THEN 'LOW' ELSE 'HIGH' END AS credit_type,
               CAST(c_custkey % 2 AS VARCHAR) AS online_flag,
               CASE WHEN c_custkey % 50 = 0 OR first_order IS NULL THEN '#N/A'
                    ELSE concat(CAST(month(first_order) AS VARCHAR), '/', CAST(day(first_order) AS VARCHAR),
                                '/', CAST(year(first_order) AS VARCHAR)) END AS active_date
        FROM customer LEFT JOIN first_orders ON c_custkey = o_custkey""",
    "customers": """
        SELECT * FROM all_customers WHERE status <> 'D'""",
    "mixes": """
        SELECT CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS VARCHAR) AS style_id,
               CAST(p_partkey % 4 AS INTEGER) AS ref_id,
               concat('MIX_', CAST(p_size % 5 AS VARCHAR)) AS mix
        FROM part WHERE p_partkey % 10 <> 0
        UNION ALL
        SELECT CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS VARCHAR),
               CAST(p_partkey % 4 AS INTEGER),
               concat('MIX_', CAST(5 + p_partkey % 7 AS VARCHAR))
        FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 0""",
    # the oracle keeps the parsed numbers: parse(format(x)) = x
    "households": """
        SELECT CAST(c_nationkey AS VARCHAR) AS geo_id,
               CAST(1000 * count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS DOUBLE) AS simple_life,
               CAST(1000 * count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) AS family_life,
               CAST(1000 * count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS DOUBLE) AS elite,
               CAST(1000 * count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS DOUBLE) AS active_adult_elite,
               CAST(1000 * count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS DOUBLE) AS renters
        FROM customer GROUP BY c_nationkey""",
}


def with_views(final: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the mart views and ``extra`` CTEs, then ``final``."""
    ctes, stored = list(MART_VIEWS.items()) + list(extra), " MATERIALIZED"
    # a name may end in MATERIALIZED
    body = ",\n".join(f"{name.removesuffix(stored)} AS{stored if name.endswith(stored) else ''} ({sql.strip()})" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{final.strip()}"


ORACLE: dict[str, str] = {}


def oracle(name: str, final: str, *extra: tuple[str, str]) -> None:
    ORACLE[name] = with_views(final, list(extra))


# --- market basket --------------------------------------------------------

_F = ("f", "SELECT DISTINCT customer_id AS c, style_id AS style, ref_id AS ref FROM invoices")
_N = ("n", "SELECT style, ref, count(*) AS tot FROM f GROUP BY style, ref")
_K = ("k", """SELECT x.style AS s1, x.ref AS r1, y.style AS s2, y.ref AS r2, count(*) AS cnt
              FROM f x JOIN f y ON x.c = y.c GROUP BY 1, 2, 3, 4""")
# literal definition: co-count among customers other than the target
_CAND = ("cand", """SELECT b.c, k.s1, k.r1, k.s2, k.r2,
                           k.cnt - CASE WHEN own.c IS NOT NULL THEN 1 ELSE 0 END AS adj
                    FROM f b JOIN k ON k.s1 = b.style AND k.r1 = b.ref
                    LEFT JOIN f own ON own.c = b.c AND own.style = k.s2 AND own.ref = k.r2""")
_MBA = ("mba", """SELECT cand.c AS customer_id, s2 AS style_id, r2 AS ref_id,
                         round(sum(CAST(adj AS DOUBLE) / tot) / count(*), 9) AS score
                  FROM cand JOIN n ON n.style = s1 AND n.ref = r1
                  WHERE adj > 0 GROUP BY 1, 2, 3""")

oracle("basket_support",
       "SELECT style AS style_id, ref AS ref_id, tot AS support FROM n", _F, _N)

oracle("basket_pairs",
       """SELECT s1 AS style_1, r1 AS ref_1, s2 AS style_2, r2 AS ref_2, cnt AS co_count,
                 tot AS support
          FROM k JOIN n ON n.style = k.s1 AND n.ref = k.r1""", _F, _N, _K)

oracle("mba_scores", "SELECT * FROM mba", _F, _N, _K, _CAND, _MBA)

oracle("mba_top10",
       """SELECT customer_id, CAST(rank AS INTEGER) AS rank, style_id, score FROM (
            SELECT customer_id, style_id, score,
                   row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, style_id) AS rank
            FROM (SELECT customer_id, style_id, max(score) AS score FROM mba
                  WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = mba.customer_id
                                    AND i.style_id = mba.style_id)
                  GROUP BY customer_id, style_id))
          WHERE rank <= 10""", _F, _N, _K, _CAND, _MBA)


oracle("best_customers_mba",
       """SELECT customer_id, CAST(rank AS INTEGER) AS rank, style_id, score FROM (
            SELECT customer_id, style_id, score,
                   row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, style_id) AS rank
            FROM (SELECT customer_id, style_id, max(score) AS score FROM mba
                  WHERE customer_id IN (SELECT customer_id FROM invoices GROUP BY customer_id
                                        ORDER BY sum(spend) DESC, customer_id LIMIT 100)
                    AND NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = mba.customer_id
                                    AND i.style_id = mba.style_id)
                  GROUP BY customer_id, style_id))
          WHERE rank <= 10""", _F, _N, _K, _CAND, _MBA)


# --- sources ------------------------------------------------------------------

oracle("invoice_lines",
       """SELECT customer_id, style_id, ref_id, invoice_date, quantity, unit_price,
                 CAST(spend AS DOUBLE) AS spend FROM invoices""")

oracle("active_customers", "SELECT * FROM customers")

oracle("live_products", "SELECT * FROM products")

oracle("warehouse_customers", "SELECT * FROM all_customers WHERE status IN ('A', 'Z')")

oracle("margin_lines", """
    SELECT customer_id, style_id, ref_id, invoice_date, invoice_month, division_id, company_id,
           quantity, unit_price, CAST(spend AS DOUBLE) AS spend,
           round((net_amount - cost) / net_amount, 9) AS margin_pct
    FROM (SELECT o_custkey AS customer_id,
                 CAST(CAST(floor(l_partkey / 4.0) AS BIGINT) AS VARCHAR) AS style_id,
                 CAST(l_partkey % 4 AS INTEGER) AS ref_id,
                 CAST(o_orderdate AS DATE) AS invoice_date,
                 strftime(o_orderdate, '%Y%m') AS invoice_month,
                 lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS division_id,
                 l_suppkey AS company_id, l_quantity AS quantity,
                 l_extendedprice / l_quantity AS unit_price,
                 CAST(l_extendedprice AS DECIMAL(18,2)) AS spend,
                 l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) AS net_amount,
                 l_extendedprice * CAST(0.7 AS DOUBLE) AS cost,
                 l_returnflag, l_linestatus
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
    WHERE invoice_month > '199512' AND net_amount <> 0 AND l_returnflag <> 'R' AND spend > 0
      AND division_id IN ('02', '06', '32', '34', '58', '60', '63', '93', '94', '96')
      AND l_linestatus = 'O'""")

oracle("product_star_join", """
    SELECT p.style_id, p.ref_id, p.style_name, p.prod_desc, p.sub_category, p.high_category,
           s_name AS company, n_name AS nation, r_name AS region
    FROM products p
    JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) i
      ON CAST(p.style_id AS BIGINT) * 4 + p.ref_id = i.l_partkey
    JOIN supplier ON i.l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")

oracle("parse_amounts_and_years", """
    SELECT c.customer_id,
           TRY_CAST(replace(c.zip, ',', '') AS DOUBLE) AS zip_number,
           CASE WHEN c.active_date = '#N/A' THEN CAST(1946 AS DOUBLE)
                ELSE TRY_CAST(split_part(c.active_date, '/', 3) AS DOUBLE) END AS active_year,
           coalesce(c.credit_type, '') AS credit_text,
           y.latest_style_year
    FROM customers c LEFT JOIN (
        SELECT i.customer_id, max(TRY_CAST(split_part(p.intro_date, '-', 1) AS DOUBLE)) AS latest_style_year
        FROM invoices i JOIN products p ON i.style_id = p.style_id AND i.ref_id = p.ref_id
        GROUP BY i.customer_id) y ON y.customer_id = c.customer_id""")

# --- tags and post-filters ------------------------------------------------------

_REBUY = ("rebuy", """SELECT customer_id, style_id, CAST(sum(spend) AS DOUBLE) AS score
                      FROM invoices GROUP BY customer_id, style_id""")
_CUTOFF = "CAST(DATE '2001-08-01' - INTERVAL 24 MONTH AS DATE)"

oracle("product_tags", """
    SELECT style_id, array_to_string(list_sort(list_distinct(list(mix))), ',') AS tags,
           count(DISTINCT mix) AS n_tags
    FROM mixes GROUP BY style_id""")

oracle("tag_exclusion", """
    SELECT * FROM rebuy r WHERE NOT EXISTS (
        SELECT 1 FROM mixes m WHERE m.style_id = r.style_id AND m.mix IN ('MIX_2', 'MIX_7'))""", _REBUY)

oracle("recency_exclusion", f"""
    SELECT * FROM rebuy r WHERE NOT EXISTS (
        SELECT 1 FROM invoices i WHERE i.customer_id = r.customer_id AND i.style_id = r.style_id
          AND i.invoice_date >= {_CUTOFF})""", _REBUY)

oracle("recency_any_old", f"""
    SELECT * FROM rebuy r
    WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = r.customer_id AND i.style_id = r.style_id)
       OR EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = r.customer_id AND i.style_id = r.style_id
                    AND i.invoice_date < {_CUTOFF})""", _REBUY)

# --- history and spend -------------------------------------------------------------

_ITEM_TAGS = ("item_tags", """SELECT style_id, ref_id,
                                     array_to_string(list_sort(list_distinct(list(mix))), ',') AS tags
                              FROM mixes GROUP BY style_id, ref_id""")

oracle("customer_top_purchases", """
    SELECT rk.customer_id, CAST(rk.rank AS INTEGER) AS rank, rk.style_id, rk.ref_id,
           CAST(rk.spend AS DOUBLE) AS spend, p.style_name, p.prod_desc, p.sub_category, p.high_category,
           coalesce(t.tags, '') AS tags
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                 ORDER BY spend DESC, concat(style_id, ',', CAST(ref_id AS VARCHAR))) AS rank
          FROM (SELECT customer_id, style_id, ref_id, sum(spend) AS spend FROM invoices GROUP BY 1, 2, 3)) rk
    LEFT JOIN products p ON p.style_id = rk.style_id AND p.ref_id = rk.ref_id
    LEFT JOIN item_tags t ON t.style_id = rk.style_id AND t.ref_id = rk.ref_id
    WHERE rk.rank <= 20""", _ITEM_TAGS)

oracle("customer_spend_stats", """
    SELECT customer_id, CAST(sum(spend) AS DOUBLE) AS total_spend, count(*) AS lines,
           round(CAST(sum(spend) AS DOUBLE) / count(*), 9) AS avg_spend
    FROM invoices GROUP BY customer_id""")

_LP = ("lp", """SELECT i.customer_id, p.* FROM invoices i
                JOIN products p ON i.style_id = p.style_id AND i.ref_id = p.ref_id""")

oracle("avg_style_year", """
    SELECT customer_id, round(avg(pile_weight), 9) AS avg_pile_weight,
           round(sum(pile_weight), 9) AS total_pile_weight,
           round(avg(TRY_CAST(split_part(intro_date, '-', 1) AS DOUBLE)), 9) AS avg_style_year
    FROM lp GROUP BY customer_id""", _LP)

# --- categories and features --------------------------------------------------------


def _dictionary(source: str, column: str) -> str:
    return f"""SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS slot
               FROM (SELECT DISTINCT coalesce({column}, '') AS value FROM {source})"""


def _shares(source: str, column: str) -> str:
    return f"""SELECT customer_id, value, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY customer_id) AS share
               FROM (SELECT customer_id, coalesce({column}, '') AS value, count(*) AS n
                     FROM {source} GROUP BY 1, 2)"""


_LM = ("lm", """SELECT i.customer_id, m.mix FROM invoices i
                JOIN mixes m ON i.style_id = m.style_id AND i.ref_id = m.ref_id""")
_PRODUCT_CATEGORY = {"PROD_DESC": "prod_desc", "CHO_SUB_CAT": "sub_category", "CPT_HDS_OTH": "high_category"}
_CUSTOMER_CATEGORY = {"channel": "channel", "CREDIT_TYPE": "credit_type", "SHWONL_FLAG": "online_flag"}

oracle("category_dictionary", " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, value, slot FROM ({_dictionary('products', col)})"
    for name, col in _PRODUCT_CATEGORY.items()))

for _key, _col in (("category_share_desc", "prod_desc"), ("category_share_sub", "sub_category"),
                   ("category_share_high", "high_category")):
    oracle(_key, f"SELECT customer_id, value, round(share, 9) AS share FROM ({_shares('lp', _col)})", _LP)

oracle("tag_share", f"SELECT customer_id, value, round(share, 9) AS share FROM ({_shares('lm', 'mix')})", _LM)

oracle("customer_one_hot", " UNION ALL ".join(
    f"""SELECT c.customer_id, '{name}' AS feature, d.value, d.slot
        FROM customers c JOIN ({_dictionary('customers', col)}) d ON coalesce(c.{col}, '') = d.value"""
    for name, col in _CUSTOMER_CATEGORY.items()))

_HOUSE = ("house", """SELECT c.customer_id, TRY_CAST(replace(c.zip, ',', '') AS DOUBLE) AS zip_number,
                             h.simple_life, h.family_life, h.elite, h.active_adult_elite, h.renters,
                             c.common_customer, c.active_date, c.channel, c.credit_type, c.online_flag
                      FROM customers c JOIN households h ON c.zip = h.geo_id""")

oracle("household_features", """
    SELECT customer_id, zip_number, simple_life, family_life, elite, active_adult_elite, renters FROM house""",
       _HOUSE)

_SCALAR_FEATURES = {
    "Elite": "elite", "zip": "zip_number", "Renters": "renters",
    "COMMON_CUSTOMER": "CAST(common_customer AS DOUBLE)", "StyleYear": "asy",
    "Simple Life": "simple_life", "Family Life": "family_life", "Active Adult Elite": "active_adult_elite",
    "PILE_WEIGHT": "apw", "AverageExpenditure": "aspend", "TotalExpenditure": "tspend",
    "ACTIVE_DATE": "CASE WHEN active_date = '#N/A' THEN CAST(1946 AS DOUBLE) "
                   "ELSE TRY_CAST(split_part(active_date, '/', 3) AS DOUBLE) END",
}
_SHARE_SOURCES = {"PROD_DESC": ("lp", "prod_desc", "products"), "CHO_SUB_CAT": ("lp", "sub_category", "products"),
                  "CPT_HDS_OTH": ("lp", "high_category", "products"), "Mix": ("lm", "mix", "mixes")}


def _feature_ctes() -> list[tuple[str, str]]:
    ctes = [_LP, _LM, _HOUSE,
            ("styles", """SELECT customer_id, avg(pile_weight) AS apw,
                                 avg(TRY_CAST(split_part(intro_date, '-', 1) AS DOUBLE)) AS asy
                          FROM lp GROUP BY customer_id"""),
            ("spend_s", """SELECT customer_id, CAST(sum(spend) AS DOUBLE) AS tspend,
                                  CAST(sum(spend) AS DOUBLE) / count(*) AS aspend
                           FROM invoices GROUP BY customer_id""")]
    for name, (src, col, dict_src) in _SHARE_SOURCES.items():
        t = name.lower()
        ctes.append((f"sh_{t}", _shares(src, col)))
        ctes.append((f"dict_{t}", _dictionary(dict_src, col)))
    for name, col in _CUSTOMER_CATEGORY.items():
        ctes.append((f"dict_{name.lower()}", _dictionary("customers", col)))
    having = " AND ".join(f"customer_id IN (SELECT customer_id FROM sh_{n.lower()})" for n in _SHARE_SOURCES)
    ctes.append(("complete", f"""SELECT * FROM house JOIN styles USING (customer_id)
                                 JOIN spend_s USING (customer_id) WHERE {having}"""))
    parts = [f"SELECT customer_id, '{name}' AS feature, 0 AS slot, {expr} AS value FROM complete"
             for name, expr in _SCALAR_FEATURES.items()]
    for name in _SHARE_SOURCES:
        t = name.lower()
        parts.append(f"""SELECT c.customer_id, '{name}' AS feature, d.slot, coalesce(s.share, 0) AS value
                         FROM complete c CROSS JOIN dict_{t} d
                         LEFT JOIN sh_{t} s ON s.customer_id = c.customer_id AND s.value = d.value""")
    for name, col in _CUSTOMER_CATEGORY.items():
        parts.append(f"""SELECT c.customer_id, '{name}' AS feature, d.slot,
                                CASE WHEN coalesce(c.{col}, '') = d.value THEN CAST(1 AS DOUBLE)
                                     ELSE CAST(0 AS DOUBLE) END AS value
                         FROM complete c CROSS JOIN dict_{name.lower()} d""")
    ctes.append(("flong", " UNION ALL ".join(parts)))
    ctes.append(("fstats", """SELECT feature, slot, avg(value) AS m, stddev_pop(value) AS s
                              FROM flong GROUP BY feature, slot"""))
    return ctes


oracle("feature_zscore", """
    SELECT customer_id, feature, CAST(slot AS INTEGER) AS slot,
           round(CASE WHEN s <= 0 THEN value - m ELSE (value - m) / s END, 6) AS z
    FROM flong JOIN fstats USING (feature, slot)""", *_feature_ctes())


# --- purchase graph ---------------------------------------------------------------

_EDGES = ("e", """SELECT i.customer_id, i.style_id, i.ref_id, i.spend FROM invoices i
                  WHERE i.customer_id IN (SELECT customer_id FROM customers)
                    AND EXISTS (SELECT 1 FROM products p WHERE p.style_id = i.style_id AND p.ref_id = i.ref_id)""")
_W = ("w", "SELECT customer_id, style_id, ref_id, sum(spend) AS w FROM e GROUP BY 1, 2, 3")
_NORM = ("nrm", "SELECT customer_id, sum(w * w) AS n2 FROM w GROUP BY 1")
_NORM_LINE = ("nrm", "SELECT customer_id, sum(spend * spend) AS n2 FROM e GROUP BY 1")
_DOTS = ("dots", """SELECT a.customer_id, c.customer_id AS neighbour_id, sum(a.w * c.w) AS dot
                    FROM w a JOIN w c ON a.style_id = c.style_id AND a.ref_id = c.ref_id GROUP BY 1, 2""")
_COS = ("cos", """SELECT d.customer_id, d.neighbour_id, CAST(d.dot AS DOUBLE) AS dot,
                         CAST(d.dot AS DOUBLE) / (sqrt(CAST(na.n2 AS DOUBLE)) * sqrt(CAST(nc.n2 AS DOUBLE))) AS cosine
                  FROM dots d JOIN nrm na ON na.customer_id = d.customer_id
                  JOIN nrm nc ON nc.customer_id = d.neighbour_id""")
_SP = ("sp", "SELECT customer_id, style_id, sum(spend) AS s FROM e GROUP BY 1, 2")
_GRAPH = ("graph", """SELECT c.customer_id, sp.style_id, round(sum(c.cosine * CAST(sp.s AS DOUBLE)), 2) AS score
                      FROM cos c JOIN sp ON sp.customer_id = c.neighbour_id
                      WHERE c.customer_id <> c.neighbour_id GROUP BY 1, 2""")

oracle("purchase_graph", """
    SELECT v.id, v.name, v.kind, coalesce(d.degree, 0) AS degree,
           coalesce(CAST(d.weight AS DOUBLE), CAST(0 AS DOUBLE)) AS weight
    FROM (SELECT 'c:' || CAST(customer_id AS VARCHAR) AS id, name, 'customer' AS kind FROM customers
          UNION ALL
          SELECT 'p:' || style_id || ',' || CAST(ref_id AS VARCHAR), style_name, 'product' FROM products) v
    LEFT JOIN (SELECT 'c:' || CAST(customer_id AS VARCHAR) AS id, count(*) AS degree, sum(spend) AS weight
               FROM e GROUP BY customer_id
               UNION ALL
               SELECT 'p:' || style_id || ',' || CAST(ref_id AS VARCHAR), count(*), sum(spend)
               FROM e GROUP BY style_id, ref_id) d ON d.id = v.id""", _EDGES)

oracle("customer_cosine", "SELECT customer_id, neighbour_id, dot, round(cosine, 9) AS cosine FROM cos",
       _EDGES, _W, _NORM, _DOTS, _COS)

oracle("nearest_customers",
       """SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id
                                                    ORDER BY round(cosine, 9) DESC, neighbour_id) AS INTEGER) AS rank,
                 neighbour_id, round(cosine, 9) AS cosine
          FROM cos WHERE customer_id <> neighbour_id QUALIFY rank <= 10""",
       _EDGES, _W, _NORM, _DOTS, _COS)

oracle("similar_customers",
       """SELECT customer_id, neighbour_id, round(cosine, 9) AS cosine
          FROM cos WHERE customer_id <> neighbour_id AND round(cosine, 9) >= 0.25""",
       _EDGES, _W, _NORM, _DOTS, _COS)

oracle("graph_recs", "SELECT * FROM graph", _EDGES, _W, _NORM, _DOTS, _COS, _SP, _GRAPH)

oracle("graph_recs_line_norm", "SELECT * FROM graph", _EDGES, _W, _NORM_LINE, _DOTS, _COS, _SP, _GRAPH)

# --- segments over the stored centre table ------------------------------------------

_SEGMENT_CTES = _feature_ctes() + [
    ("zv", """SELECT customer_id,
                     CASE feature WHEN 'StyleYear' THEN 0 WHEN 'AverageExpenditure' THEN 1 ELSE 2 + slot END AS j,
                     CASE WHEN s <= 0 THEN value - m ELSE (value - m) / s END AS z
              FROM flong JOIN fstats USING (feature, slot)
              WHERE feature IN ('StyleYear', 'AverageExpenditure', 'CPT_HDS_OTH')"""),
    ("cen", """SELECT CAST(vec_id AS INTEGER) AS segment, j.j,
                      CAST(embedding[j.j + 1] AS DOUBLE) * CAST(10 AS DOUBLE) AS c
               FROM embeddings CROSS JOIN (SELECT DISTINCT j FROM zv) j"""),
    ("dist", """SELECT z.customer_id, c.segment, sum((z.z - c.c) * (z.z - c.c)) AS d
                FROM zv z JOIN cen c ON c.j = z.j GROUP BY 1, 2"""),
    ("ranked", """SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d, segment) AS rk FROM dist"""),
    ("nearest", "SELECT customer_id, segment AS nearest, d FROM ranked WHERE rk = 1"),
    ("pop", """SELECT CAST(e.vec_id AS INTEGER) AS segment, count(n.customer_id) AS population
               FROM embeddings e LEFT JOIN nearest n ON n.nearest = e.vec_id GROUP BY 1"""),
    ("eff", """SELECT r.customer_id, min(r.rk) AS rk FROM ranked r JOIN pop p ON p.segment = r.segment
               WHERE p.population > 5 GROUP BY 1"""),
    ("assign", """SELECT n.customer_id, n.nearest, r.segment, CAST(e.rk - 1 AS INTEGER) AS fallback_rank
                  FROM eff e JOIN ranked r ON r.customer_id = e.customer_id AND r.rk = e.rk
                  JOIN nearest n ON n.customer_id = e.customer_id"""),
    ("own", "SELECT customer_id, style_id, sum(spend) AS s FROM invoices GROUP BY 1, 2"),
    # literal definition: the spend of the other members of the customer's segment
    ("segrecs", """SELECT a.customer_id, o.style_id, CAST(sum(o.s) AS DOUBLE) AS score
                   FROM assign a JOIN nearest m ON m.nearest = a.segment AND m.customer_id <> a.customer_id
                   JOIN own o ON o.customer_id = m.customer_id GROUP BY 1, 2"""),
]

oracle("nearest_segment", "SELECT customer_id, nearest, round(d, 6) AS distance FROM nearest", *_SEGMENT_CTES)
oracle("segment_population", "SELECT * FROM pop", *_SEGMENT_CTES)
oracle("segment_fallback", "SELECT * FROM assign", *_SEGMENT_CTES)
oracle("segment_recs", "SELECT * FROM segrecs", *_SEGMENT_CTES)

_FILTERED = ("filtered", f"""
    SELECT * FROM segrecs r
    WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = r.customer_id AND i.style_id = r.style_id
                        AND i.invoice_date >= {_CUTOFF})
      AND NOT EXISTS (SELECT 1 FROM mixes m WHERE m.style_id = r.style_id AND m.mix IN ('MIX_2', 'MIX_7'))""")
_ATTR = ("attr", """SELECT style_id, style_name, prod_desc, sub_category, high_category FROM (
                        SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY ref_id) AS rn FROM products)
                    WHERE rn = 1""")
_STYLE_TAGS = ("stags", """SELECT style_id, array_to_string(list_sort(list_distinct(list(mix))), ',') AS tags
                           FROM mixes GROUP BY style_id""")

oracle("suggestion_report", """
    SELECT t.customer_id, c.name AS customer_name, CAST(t.rk AS INTEGER) AS rank, t.style_id, a.style_name, a.prod_desc,
           a.sub_category, a.high_category, coalesce(g.tags, '') AS tags, t.score,
           printf('$%.2f', t.score) AS score_text
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, style_id) AS rk
          FROM (SELECT customer_id, style_id, max(score) AS score FROM filtered
                WHERE style_id IN (SELECT style_id FROM attr) GROUP BY 1, 2)) t
    JOIN attr a ON a.style_id = t.style_id
    LEFT JOIN stags g ON g.style_id = t.style_id
    LEFT JOIN customers c ON c.customer_id = t.customer_id
    WHERE t.rk <= 20""", *_SEGMENT_CTES, _FILTERED, _ATTR, _STYLE_TAGS)

oracle("export_recommendations", """
    SELECT CAST(customer_id AS BIGINT) AS CustomerID, style_id AS SellingStyleNo, score AS Score
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, style_id) AS rk
          FROM (SELECT customer_id, style_id, max(score) AS score FROM filtered GROUP BY 1, 2))
    WHERE rk <= 20""", *_SEGMENT_CTES, _FILTERED)

# --- ratings and given factors -----------------------------------------------------------

_RATINGS = ("r", "SELECT customer_id, style_id, CAST(sum(spend) AS DOUBLE) AS rating FROM invoices GROUP BY 1, 2")

oracle("rating_table", "SELECT * FROM r", _RATINGS)

oracle("factor_scores", """
    SELECT r.customer_id, r.style_id,
           round(list_sum(list_transform(range(32),
                 lambda k: CAST(u.embedding[k + 1] AS DOUBLE) * CAST(v.embedding[33 + k] AS DOUBLE))), 9) AS score
    FROM (SELECT customer_id, style_id, customer_id % (SELECT count(*) FROM embeddings) AS uk FROM r) r
    JOIN embeddings u ON u.vec_id = r.uk
    JOIN (SELECT style_id, (dense_rank() OVER (ORDER BY style_id) - 1) % (SELECT count(*) FROM embeddings) AS slot
          FROM (SELECT DISTINCT style_id FROM r)) idx ON idx.style_id = r.style_id
    JOIN embeddings v ON v.vec_id = idx.slot""", _RATINGS)

# --- relevance score ------------------------------------------------------------------------


def _relevance_ctes(suggestions: str) -> list[tuple[str, str]]:
    return [
        ("s1", f"""SELECT customer_id, style_id, max(score) AS score FROM {suggestions} s
                   WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = s.customer_id
                                     AND i.style_id = s.style_id)
                   GROUP BY 1, 2"""),
        ("top", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                                         ORDER BY score DESC, style_id) AS rk FROM s1) WHERE rk <= 10"""),
        _ATTR,
        ("bought", """SELECT DISTINCT i.customer_id, p.prod_desc, p.sub_category, p.high_category
                      FROM invoices i JOIN products p ON p.style_id = i.style_id"""),
        ("scored", """SELECT t.customer_id, t.style_id,
                 CASE WHEN EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = t.customer_id
                                   AND b.prod_desc = a.prod_desc) THEN CAST(1 AS DOUBLE)
                      WHEN EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = t.customer_id
                                   AND b.sub_category = a.sub_category) THEN CAST(0.75 AS DOUBLE)
                      WHEN EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = t.customer_id
                                   AND b.high_category = a.high_category) THEN CAST(0.5 AS DOUBLE)
                      ELSE CAST(0 AS DOUBLE) END AS earn
                 FROM top t LEFT JOIN attr a ON a.style_id = t.style_id"""),
        ("per_customer", """SELECT customer_id, count(*) AS n_suggestions, sum(earn) AS earned,
                                   sum(earn) * 100 / count(*) AS relevance
                            FROM scored GROUP BY customer_id"""),
    ]


_MBA_CTES = [_F, _N, _K, _CAND, _MBA]
_GRAPH_CTES = [_EDGES, _W, _NORM, _DOTS, _COS, _SP, _GRAPH]

oracle("relevance_by_customer", """
    SELECT customer_id, n_suggestions, earned, round(relevance, 9) AS relevance FROM per_customer""",
       *_MBA_CTES, *_relevance_ctes("mba"))

oracle("relevance_mba", "SELECT count(*) AS customers, round(avg(relevance), 9) AS relevance FROM per_customer",
       *_MBA_CTES, *_relevance_ctes("mba"))

oracle("relevance_graph", "SELECT count(*) AS customers, round(avg(relevance), 9) AS relevance FROM per_customer",
       *_GRAPH_CTES, *_relevance_ctes("graph"))


# --- K-means: the start and the steps of every model, stated in SQL ----------------------

def _draw(seed: int, what: str, id_: str) -> str:
    """The first 8 hex digits of md5(seed:what:id) as a number."""
    return f"('0x' || substr(md5('{seed}:{what}:' || CAST({id_} AS VARCHAR)), 1, 8))::BIGINT"


def _apart(one: str, other: str) -> str:
    return f"round(list_distance({one}, {other}) ^ 2, 9)"


def _kmeans_ctes(models: list[tuple[int, list[str], int]], seed: int) -> list[tuple[str, str]]:
    """``cen(m, step, segment, v)`` for models (k, features, steps): candidates by two rounds of
    draws, k of them by weight and distance, then Lloyd steps. ``mv`` has the vectors."""
    spec = ", ".join(f"({m}, {k}, {steps})" for m, (k, _, steps) in enumerate(models))
    parts = ", ".join(f"({m}, '{name}', {i})" for m, (_, names, _) in enumerate(models) for i, name in enumerate(names))
    near = "(SELECT v.m, v.customer_id, min({apart}) AS d FROM mv v JOIN {t} c ON c.m = v.m GROUP BY 1, 2)"
    ctes = [
        ("spec", f"SELECT * FROM (VALUES {spec}) s(m, k, steps)"),
        ("zall", """SELECT customer_id, feature, slot, CASE WHEN s <= 0 THEN value - m ELSE (value - m) / s END AS z
                    FROM flong JOIN fstats USING (feature, slot)"""),
        ("mv", f"""SELECT p.m, z.customer_id, list(z.z ORDER BY p.place, z.slot) AS v
                   FROM zall z JOIN (VALUES {parts}) p(m, feature, place) ON p.feature = z.feature GROUP BY 1, 2"""),
        ("cand0", f"""SELECT m, customer_id, v FROM (
                        SELECT *, row_number() OVER (PARTITION BY m ORDER BY {_draw(seed, 'first', 'customer_id')}, customer_id) AS place
                        FROM mv) WHERE place = 1"""),
    ]
    for r in (1, 2):
        t = f"cand{r - 1}"
        ctes += [(f"near{r}", near.format(apart=_apart("v.v", "c.v"), t=t).strip("()")),
                 (f"cand{r}", f"""SELECT * FROM {t} UNION ALL
                     SELECT v.m, v.customer_id, v.v FROM mv v JOIN near{r} n ON n.m = v.m AND n.customer_id = v.customer_id
                     JOIN (SELECT m, sum(d) AS cost FROM near{r} GROUP BY m) t ON t.m = v.m JOIN spec s ON s.m = v.m
                     WHERE {_draw(seed, f'round{r}', 'v.customer_id')} / 4294967296e0 * t.cost < 2 * s.k * n.d""")]
    ctes += [
        ("weights", f"""SELECT m, id, count(*) AS w FROM (
                          SELECT v.m, v.customer_id, (min({{'d': {_apart('v.v', 'c.v')}, 'id': c.customer_id}})).id AS id
                          FROM mv v JOIN cand2 c ON c.m = v.m GROUP BY 1, 2) GROUP BY 1, 2"""),
        ("state(m, step, id, v, w, near, chosen)", f"""
            SELECT c.m, 1, c.customer_id, c.v, coalesce(w.w, 0), CAST('inf' AS DOUBLE),
                   row_number() OVER (PARTITION BY c.m ORDER BY coalesce(w.w, 0) DESC, c.customer_id) = 1
            FROM cand2 c LEFT JOIN weights w ON w.m = c.m AND w.id = c.customer_id
            UNION ALL
            SELECT m, step, id, v, w, near, w * near > 0 AND row_number() OVER (PARTITION BY m ORDER BY round(w * near, 9) DESC, id) = 1
            FROM (SELECT c.m, c.step + 1 AS step, c.id, c.v, c.w, least(c.near, {_apart('c.v', 'p.v')}) AS near
                  FROM state c JOIN state p ON p.m = c.m AND p.chosen JOIN spec s ON s.m = c.m WHERE c.step < s.k) q"""),
        ("cen(m, step, segment, v)", f"""
            SELECT m, 0, step - 1, v FROM state WHERE chosen
            UNION ALL
            SELECT c.m, c.step + 1, c.segment, coalesce(n.v, c.v)
            FROM cen c JOIN spec s ON s.m = c.m AND c.step < s.steps
            LEFT JOIN (SELECT m, segment, list(x ORDER BY slot) AS v FROM (
                         SELECT a.m, a.segment, slot, avg(x) AS x FROM (
                           SELECT a.m, a.near.s AS segment, unnest(a.v) AS x, generate_subscripts(a.v, 1) AS slot FROM (
                             SELECT v.m, v.customer_id, any_value(v.v) AS v, min({{'d': {_apart('v.v', 'c.v')}, 's': c.segment}}) AS near
                             FROM mv v JOIN cen c ON c.m = v.m JOIN spec s ON s.m = c.m AND c.step < s.steps GROUP BY 1, 2) a) a
                         GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.m = c.m AND n.segment = c.segment"""),
    ]
    return ctes


def _kmeans_run_ctes(sets: list[dict], seed: int) -> list[tuple[str, str]]:
    """``runs(run_id, params, m, step)``, ``near`` and ``assign`` of every run, and ``top``: the
    best unowned styles of the assigned segment. A style the customer does not own earns
    the whole spend of the segment, as none of it is its own."""
    keys: dict[tuple, int] = {}
    steps: dict[tuple, int] = {}
    rows = []
    for i, p in enumerate(sets):
        key = (p["k"], tuple(p.get("names", features.DEFAULT_FEATURES)))
        m = keys.setdefault(key, len(keys))
        steps[key] = max(steps.get(key, 0), p["max_iter"])
        rows.append(f"({i}, '{tune.params_text(p)}', {m}, {p['max_iter']})")
    models = [(k, list(names), steps[k, names]) for k, names in keys]
    return _feature_ctes() + _kmeans_ctes(models, seed) + [
        ("runs", f"SELECT * FROM (VALUES {', '.join(rows)}) r(run_id, params, m, step)"),
        ("apart", f"""SELECT r.run_id, v.customer_id, c.segment, {_apart('v.v', 'c.v')} AS d
                      FROM runs r JOIN mv v ON v.m = r.m JOIN cen c ON c.m = r.m AND c.step = r.step"""),
        ("near", """SELECT run_id, customer_id, (min({'d': d, 's': segment})).s AS nearest, min(d) AS d FROM apart GROUP BY 1, 2"""),
        ("good", "SELECT run_id, nearest AS segment FROM near GROUP BY 1, 2 HAVING count(*) > 5"),
        ("assign", """SELECT run_id, customer_id, (min({'d': d, 's': segment})).s AS segment
                      FROM apart JOIN good USING (run_id, segment) GROUP BY 1, 2"""),
        ("own", "SELECT customer_id, style_id, sum(spend) AS s FROM invoices GROUP BY 1, 2"),
        ("totals", """SELECT n.run_id, n.nearest AS segment, o.style_id, CAST(sum(o.s) AS DOUBLE) AS score
                      FROM near n JOIN own o ON o.customer_id = n.customer_id GROUP BY 1, 2, 3"""),
        ("best", """SELECT run_id, customer_id, style_id, score, rk FROM (
                      SELECT a.run_id, a.customer_id, t.style_id, t.score, row_number() OVER (
                        PARTITION BY a.run_id, a.customer_id ORDER BY t.score DESC, t.style_id) AS rk
                      FROM assign a JOIN totals t ON t.run_id = a.run_id AND t.segment = a.segment
                      WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.customer_id = a.customer_id AND o.style_id = t.style_id))
                    WHERE rk <= 20"""),
    ]


def _run_relevance_ctes(best: str) -> list[tuple[str, str]]:
    """``relevance(run_id, customers, relevance)`` of the ten best suggestions of every run."""
    def bought(column: str) -> str:
        return f"""(SELECT DISTINCT i.customer_id, p.{column} FROM invoices i JOIN products p ON p.style_id = i.style_id)"""
    return [
        _ATTR,
        ("earned", f"""SELECT b.run_id, b.customer_id, CAST(sum(CASE WHEN d.customer_id IS NOT NULL THEN 1e0
                         WHEN s.customer_id IS NOT NULL THEN 0.75e0 WHEN h.customer_id IS NOT NULL THEN 0.5e0 ELSE 0e0 END) AS DOUBLE)
                         * 100 / count(*) AS relevance
                       FROM {best} b LEFT JOIN attr a ON a.style_id = b.style_id
                       LEFT JOIN {bought('prod_desc')} d ON d.customer_id = b.customer_id AND d.prod_desc = a.prod_desc
                       LEFT JOIN {bought('sub_category')} s ON s.customer_id = b.customer_id AND s.sub_category = a.sub_category
                       LEFT JOIN {bought('high_category')} h ON h.customer_id = b.customer_id AND h.high_category = a.high_category
                       WHERE b.rk <= 10 GROUP BY 1, 2"""),
        ("relevance", "SELECT run_id, count(*) AS customers, round(avg(relevance), 9) AS relevance FROM earned GROUP BY run_id"),
    ]


_SWEEP = """SELECT r.run_id, r.params, coalesce(v.customers, 0) AS customers, v.relevance
            FROM runs r LEFT JOIN relevance v USING (run_id)"""
SEED = 42

for _name, _sets in (("relevance_kmc", tune.DEFAULT_KMEANS_SETS), ("sweep_kmeans", tune.KMEANS_SETS),
                     ("sweep_features", tune.FEATURE_SETS)):
    oracle(_name, _SWEEP, *_kmeans_run_ctes(_sets, SEED), *_run_relevance_ctes("best"))

oracle("kmeans_recs", "SELECT customer_id, CAST(rk AS INTEGER) AS rank, style_id, score FROM best",
       *_kmeans_run_ctes([dict(k=100, max_iter=7)], SEED))

oracle("kmeans_centres", """
    SELECT CAST(step AS INTEGER) AS step, CAST(segment AS INTEGER) AS segment, CAST(slot - 1 AS INTEGER) AS slot, round(x, 6) AS value
    FROM (SELECT step, segment, unnest(v) AS x, generate_subscripts(v, 1) AS slot FROM cen)""",
       *_feature_ctes(), *_kmeans_ctes([(10, features.DEFAULT_FEATURES, 3)], SEED))


# --- ALS of two factors: every 2 x 2 system solved in closed form ------------------------

def _als_ctes(run: int, p: dict, seed: int) -> list[tuple[str, str]]:
    """``u{run}`` (customer_id, a, b) and ``i{run}`` (style_id, a, b) after the last iteration."""
    def half(name: str, key: str, other: str, ys: str) -> list[tuple[str, str]]:
        w = f"{p.get('alpha', 1.0)}e0 * abs(r.rating)" if p["implicit"] else "1e0"
        b = f"(1e0 + {w})" if p["implicit"] else "r.rating"
        g = f"(SELECT sum({{0}}) FROM {ys})" if p["implicit"] else "0e0"
        return [(f"{name}_sums MATERIALIZED", f"""
                    SELECT r.{key}, sum({w} * y.a * y.a) + {g.format('a * a')} + {p['reg']}e0 * count(*) AS aa,
                           sum({w} * y.a * y.b) + {g.format('a * b')} AS ab,
                           sum({w} * y.b * y.b) + {g.format('b * b')} + {p['reg']}e0 * count(*) AS bb,
                           sum({b} * y.a) AS ra, sum({b} * y.b) AS rb
                    FROM r JOIN {ys} y ON y.{other} = r.{other} GROUP BY r.{key}"""),
                (f"{name} MATERIALIZED", f"""
                    SELECT {key}, (bb * ra - ab * rb) / (aa * bb - ab * ab) AS a, (aa * rb - ab * ra) / (aa * bb - ab * ab) AS b
                    FROM {name}_sums""")]

    def coin(j: int) -> str:
        return f"(('0x' || substr(md5('{seed}:als:' || customer_id::VARCHAR || ':{j}'), 1, 8))::BIGINT / 4294967296e0 - 0.5e0)"

    ctes = [(f"u{run}_0 MATERIALIZED", f"""SELECT customer_id, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b
                 FROM (SELECT DISTINCT customer_id, {coin(0)} AS a, {coin(1)} AS b FROM r)""")]
    for t in range(1, p["max_iter"] + 1):
        ctes += half(f"i{run}_{t}", "style_id", "customer_id", f"u{run}_{t - 1}")
        ctes += half(f"u{run}_{t}", "customer_id", "style_id", f"i{run}_{t}")
    return [*ctes, (f"u{run}", f"SELECT * FROM u{run}_{p['max_iter']}"), (f"i{run}", f"SELECT * FROM i{run}_{p['max_iter']}")]


_SMALL_ALS = [_RATINGS, *_als_ctes(0, tune.SMALL_CF_SETS[0], SEED), *_als_ctes(1, tune.SMALL_CF_SETS[1], SEED)]


def _als_best(digits: tuple[int, int]) -> tuple[str, str]:
    """``best(run_id, customer_id, style_id, score, rk)``: unowned styles by the product of factors."""
    every = " UNION ALL ".join(
        f"SELECT {run} AS run_id, u.customer_id, i.style_id, round(u.a * i.a + u.b * i.b, {digits[run]}) AS score FROM u{run} u CROSS JOIN i{run} i"
        for run in (0, 1))
    return ("best", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, customer_id ORDER BY score DESC, style_id) AS rk
                        FROM ({every}) e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.customer_id = e.customer_id AND r.style_id = e.style_id))
                        WHERE rk <= 10""")


oracle("als_factors", " UNION ALL ".join(
    f"SELECT {run} AS run_id, '{side}' AS side, CAST({key} AS VARCHAR) AS key, round(a, {d}) AS f1, round(b, {d}) AS f2 FROM {t}{run}"
    for run in (0, 1) for side, key, t, d in (("customer", "customer_id", "u", 6), ("style", "style_id", "i", 6 if run else 2))), *_SMALL_ALS)

oracle("als_recs_small", "SELECT run_id, customer_id, CAST(rk AS INTEGER) AS rank, style_id, score FROM best", *_SMALL_ALS, _als_best((2, 6)))

oracle("relevance_cf_small", _SWEEP, *_SMALL_ALS, _als_best((6, 6)), *_run_relevance_ctes("best"),
       ("runs", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{tune.params_text(p)}')" for i, p in enumerate(tune.SMALL_CF_SETS))
        + ") r(run_id, params)"))

oracle("model_roundtrip", f"""
    SELECT 'segment' AS kind, customer_id, CAST(near.s AS VARCHAR) AS key, round(near.d, 6) AS value FROM (
      SELECT v.customer_id, min({{'d': {_apart('v.v', 'c.v')}, 's': c.segment}}) AS near
      FROM mv v JOIN cen c ON c.m = v.m AND c.step = 5 GROUP BY 1)
    UNION ALL
    SELECT 'rating', r.customer_id, r.style_id, round(u.a * i.a + u.b * i.b, 2)
    FROM r JOIN u0 u ON u.customer_id = r.customer_id JOIN i0 i ON i.style_id = r.style_id""",
       *_feature_ctes(), *_kmeans_ctes([(10, features.DEFAULT_FEATURES, 5)], SEED), *_SMALL_ALS)

# --- reference-layout CSV round trip: same definitions as the direct queries ----------

ORACLE["csv_spend_stats"] = ORACLE["customer_spend_stats"]
ORACLE["csv_household_features"] = ORACLE["household_features"]
ORACLE["csv_product_tags"] = ORACLE["product_tags"]

"""DuckDB twins of the registered queries, to be compared without regard to row order.

``VIEWS`` builds the same price tables as ``tagwise.testbed``, with ``offers`` cut to one market; in ``ALL_VIEWS`` it holds
all markets, and what is derived from it keeps them apart.
"""

_DAY = (
    "CAST(DATE '2023-12-01' + CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 42)"
    " AS INTEGER) AS DATE)"
)

VIEWS = f"""
WITH lines AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
all_offers AS (
  SELECT {_DAY} AS date, CAST(floor(l_partkey / 30) AS INTEGER) AS article,
    concat('shop_', right(CAST(l_suppkey AS VARCHAR), 1)) AS shop,
    CASE WHEN s_nationkey < 9 THEN 'de' WHEN s_nationkey < 17 THEN 'fr' ELSE 'uk' END AS country,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL
      ELSE floor(l_extendedprice / 1000) * 10 + CAST(9.5 AS DOUBLE) END AS price,
    CASE WHEN l_returnflag = 'R' THEN NULL
      ELSE floor(l_extendedprice / 1000) * 10 + CAST(9.5 AS DOUBLE) + round(l_tax * 100) END AS price_delivery
  FROM lines),
offers AS (SELECT date, article, shop, price, price_delivery, CAST(year(date) AS INTEGER) AS year
  FROM all_offers WHERE country = 'de'),
articles AS (
  SELECT CAST(floor(p_partkey / 30) AS INTEGER) AS article, arg_min(p_name, p_partkey) AS p_name,
    arg_min(p_type, p_partkey) AS p_type, arg_min(p_brand, p_partkey) AS p_brand,
    arg_min(p_size, p_partkey) AS p_size, max(p_retailprice) AS retail
  FROM part GROUP BY 1),
list_prices AS (
  SELECT article, CAST(y.year AS INTEGER) AS year, p_name AS product,
    CASE WHEN y.year = 2024 THEN retail * CAST(1.05 AS DOUBLE) ELSE retail END AS price,
    p_type AS subcategory, p_brand AS family
  FROM articles, (VALUES (2023), (2024)) y(year)
  WHERE y.year = 2023 OR p_size > 4),
supply_prices AS (SELECT article, year, product, price * CAST(0.3 AS DOUBLE) AS price FROM list_prices),
platform_prices AS (SELECT article, retail * CAST(0.4 AS DOUBLE) AS amz_price FROM articles),
catalog_rows AS (
  SELECT {_DAY} AS date, CAST(floor(l_partkey / 30) AS INTEGER) AS article,
    ['de', 'be', 'cz', 'fr', 'it', 'sk', 'ro', 'es', 'pl', 'hu', 'dk', 'se', 'uk']
      [CAST(floor(s_nationkey / 2) AS INTEGER) + 1] AS country,
    l_extendedprice / 100 AS euro, round(l_discount * 100) AS discount, CAST(l_quantity AS INTEGER) AS stock
  FROM lines),
catalog_offers AS (
  SELECT date, article, country,
    euro * CAST(CASE country WHEN 'cz' THEN 25 WHEN 'ro' THEN 5 WHEN 'pl' THEN 4.5 WHEN 'hu' THEN 400
      WHEN 'dk' THEN 7 WHEN 'se' THEN 11 ELSE 1 END AS DOUBLE) AS price,
    discount, stock, CAST(year(date) AS INTEGER) AS year
  FROM catalog_rows),
market_offers AS (SELECT date, article, country, price, year FROM catalog_offers
  WHERE country IN ('de', 'uk', 'fr', 'it', 'se', 'es', 'pl')),
-- Fixed values: VAT and exchange rates by country, as in tagwise.model.
vat AS (SELECT country, CAST(vat AS DOUBLE) AS vat FROM (VALUES ('de', .19), ('be', .21), ('cz', .21), ('fr', .2),
  ('it', .22), ('sk', .23), ('ro', .19), ('es', .21), ('pl', .23), ('hu', .27), ('dk', .25), ('se', .25)) t(country, vat)),
market_vat AS (SELECT country, CAST(vat AS DOUBLE) AS vat FROM (VALUES ('de', .19), ('uk', .2), ('fr', .2), ('it', .22),
  ('se', .25), ('es', .21), ('pl', .23)) t(country, vat)),
fx AS (SELECT country, CAST(rate AS DOUBLE) AS rate FROM (VALUES ('cz', 25.2), ('ro', 4.98), ('pl', 4.26), ('hu', 410.0),
  ('dk', 7.5), ('se', 10.7)) t(country, rate)),
market_fx AS (SELECT country, CAST(rate AS DOUBLE) AS rate FROM (VALUES ('uk', .855), ('se', 11.6), ('pl', 4.29))
  t(country, rate)),
d AS (SELECT max(date) AS d FROM offers),
ad AS (SELECT max(date) AS d FROM all_offers),
cd AS (SELECT max(date) AS d FROM catalog_offers),
md AS (SELECT max(date) AS d FROM market_offers),
enriched AS (
  SELECT o.*, l.product, l.price AS list_price, 1 - o.price / nullif(l.price, 0) AS disc1,
    1 - o.price_delivery / nullif(l.price, 0) AS disc2
  FROM offers o LEFT JOIN list_prices l USING (article, year)),
ranked AS (
  SELECT *, CASE WHEN price IS NOT NULL
    THEN rank() OVER (PARTITION BY date, article ORDER BY price NULLS LAST) END AS rank
  FROM enriched),
marked AS (
  SELECT *, CASE date WHEN d THEN 'd0' WHEN d - 1 THEN 'd1' WHEN d - 7 THEN 'd7' WHEN d - 30 THEN 'd30' END AS label
  FROM enriched, d WHERE date IN (d, d - 1, d - 7, d - 30)),
changes AS (
  SELECT shop, product, min(price) FILTER (label = 'd30') - min(price) FILTER (label = 'd0') AS diff_30d,
    min(price) FILTER (label = 'd7') - min(price) FILTER (label = 'd0') AS diff_7d,
    min(price) FILTER (label = 'd1') - min(price) FILTER (label = 'd0') AS diff_1d,
    min(price) FILTER (label = 'd0') AS d0
  FROM marked GROUP BY shop, product),
catalog_eur AS (
  SELECT c.*, v.vat, CASE WHEN rate IS NULL THEN price ELSE round_even(price / rate * 100, 0) / 100 END AS price_eur
  FROM catalog_offers c LEFT JOIN fx USING (country) LEFT JOIN vat v USING (country)),
catalog_net AS (SELECT *, round_even(price_eur / (1 + vat) * 100, 0) / 100 AS price_net FROM catalog_eur),
catalog_one AS (
  SELECT * FROM catalog_net
  QUALIFY row_number() OVER (PARTITION BY article, country, date ORDER BY price, discount, stock) = 1),
market_net AS (
  SELECT *, round_even(price_eur / (1 + vat) * 100, 0) / 100 AS price_net FROM (
    SELECT m.*, v.vat, CASE WHEN rate IS NULL THEN price ELSE round_even(price / rate * 100, 0) / 100 END AS price_eur
    FROM market_offers m LEFT JOIN market_fx USING (country) LEFT JOIN market_vat v USING (country))),
comparison AS (
  SELECT article, country, date, s.product, stock, discount, price_eur, price_net, s.price AS ancor,
    round_even((1 - s.price / nullif(price_net, 0)) * 10000, 0) / 10000 AS margin,
    round_even(price_eur * (1 - discount / 100) * 100, 0) / 100 AS price_disc,
    round_even(price_net * (1 - discount / 100) * 100, 0) / 100 AS price_net_disc,
    round_even((1 - s.price / nullif(round_even(price_eur * (1 - discount / 100) * 100, 0) / 100, 0)) * 10000, 0) / 10000
      AS margin_disc
  FROM catalog_one c LEFT JOIN supply_prices s USING (article, year), cd
  WHERE date IN (d, d - 1, d - 7, d - 30)),
market_comparison AS (
  SELECT DISTINCT article, country, date, l.product, l.price AS list_price, price_eur, price_net, p.amz_price AS amazon,
    round_even((1 - p.amz_price / nullif(price_net, 0)) * 10000, 0) / 10000 AS margin
  FROM market_net LEFT JOIN list_prices l USING (article, year) LEFT JOIN platform_prices p USING (article), md
  WHERE date IN (d, d - 1, d - 7, d - 30)),
low_catalog AS (
  SELECT *, round_even((1 - ancor / nullif(price_eur / (1 + vat), 0)) * 10000, 0) / 10000 AS margin
  FROM (SELECT c.*, s.product, s.price AS ancor
    FROM catalog_one c LEFT JOIN supply_prices s USING (article, year), cd WHERE date = d)),
low_market AS (
  SELECT *, round_even((1 - amazon / nullif(price_eur / (1 + vat), 0)) * 10000, 0) / 10000 AS margin
  FROM (SELECT m.*, l.product, p.amz_price AS amazon
    FROM market_net m LEFT JOIN list_prices l USING (article, year) LEFT JOIN platform_prices p USING (article), md
    WHERE date = d)),
-- One price per shop among the ranks up to depth + 1, for depths 1 to 4.
near AS (
  SELECT depth, article, shop, product, min(price) AS price, min(rank) AS rank
  FROM ranked, d, (VALUES (1), (2), (3), (4)) t(depth) WHERE date = d AND rank <= depth + 1
  GROUP BY depth, article, shop, product),
gaps AS (
  SELECT b.depth, b.shop AS base_shop, b.article, b.product, b.price AS base_price, r.shop, r.price,
    r.price - b.price AS diff, max(r.price - b.price) OVER (PARTITION BY b.depth, b.shop, b.article) AS largest
  FROM near b JOIN near r ON b.depth = r.depth AND b.article = r.article AND b.shop <> r.shop
  WHERE b.rank = 1)
"""


# What differs in VIEWS where the offers hold all markets.
_BY_MARKET = {
    "SELECT date, article, shop, price, price_delivery, CAST(year(date) AS INTEGER) AS year\n"
    "  FROM all_offers WHERE country = 'de'": "SELECT *, CAST(year(date) AS INTEGER) AS year FROM all_offers",
    "PARTITION BY date, article ORDER BY price": "PARTITION BY country, date, article ORDER BY price",
    "SELECT shop, product, min(price)": "SELECT country, shop, product, min(price)",
    "FROM marked GROUP BY shop, product": "FROM marked GROUP BY country, shop, product",
    "SELECT depth, article, shop, product": "SELECT depth, country, article, shop, product",
    "GROUP BY depth, article, shop, product": "GROUP BY depth, country, article, shop, product",
    "SELECT b.depth, b.shop AS base_shop": "SELECT b.depth, b.country, b.shop AS base_shop",
    "PARTITION BY b.depth, b.shop, b.article": "PARTITION BY b.depth, b.country, b.shop, b.article",
    "ON b.depth = r.depth AND b.article": "ON b.depth = r.depth AND b.country = r.country AND b.article",
}
ALL_VIEWS = VIEWS
for _one, _all in _BY_MARKET.items():
    assert ALL_VIEWS.count(_one) == 1, _one
    ALL_VIEWS = ALL_VIEWS.replace(_one, _all)


def _top_discounts(disc: str, measure: str, listed: str = "") -> str:
    return f"""
SELECT country, article, date, shop, price, price_delivery, list_price, {disc} AS disc,
  {measure} - min({measure}) OVER (PARTITION BY country, article) AS surplus,
  CASE WHEN {disc} IS NOT NULL THEN format('{{:.1f}}%', round_even({disc} * 100 * 10, 0) / 10) END AS disc_label,
  format('{{:.1f}}', round_even({measure} * 10, 0) / 10) AS price_label
FROM (SELECT * FROM enriched, d WHERE date = d {listed}
  QUALIFY row_number() OVER (PARTITION BY country, article ORDER BY {disc} DESC NULLS FIRST, shop, price NULLS FIRST,
    price_delivery NULLS FIRST) <= 12)"""


def _leaders(measure: str, depth_rows: str) -> str:
    return f"""
SELECT shop, count(*) AS count FROM (
  SELECT shop FROM offers, d WHERE date >= d - 10 {depth_rows}
  QUALIFY row_number() OVER (PARTITION BY date, article ORDER BY {measure} NULLS FIRST, shop) <= 3)
GROUP BY shop ORDER BY count DESC, shop LIMIT 5"""


def _percent_comma(share: str) -> str:
    return f"replace(format('{{:.1f}}', round_even(coalesce({share} * 100, 0) * 10, 0) / 10), '.', ',') || '%'"


def _percent(share: str) -> str:
    return f"CASE WHEN {share} IS NOT NULL THEN format('{{:.1f}}%', round_even({share} * 100 * 10, 0) / 10) END"


def _matrix(days: tuple[str, str, str, str], measure: str) -> str:
    d0, d1, d7, d30 = days
    return f"""
SELECT country, article, shop, d30, d7, d1, d0 FROM (
  SELECT country, article, shop, min({measure}) FILTER (date = {d0}) AS d0, min({measure}) FILTER (date = {d1}) AS d1,
    min({measure}) FILTER (date = {d7}) AS d7, min({measure}) FILTER (date = {d30}) AS d30
  FROM enriched, d WHERE date IN ({d0}, {d1}, {d7}, {d30}) GROUP BY country, article, shop)
QUALIFY row_number() OVER (PARTITION BY country, article ORDER BY d0 NULLS LAST, d1 NULLS LAST, d7 NULLS LAST, d30 NULLS LAST, shop)
  <= 10"""


_CHANGE_COUNTS = """
SELECT shop, count(*) FILTER (diff_1d > 0) AS n_drops_1d, count(*) FILTER (diff_1d < 0) AS n_rises_1d,
  count(*) FILTER (diff_7d > 0) AS n_drops_7d, count(*) FILTER (diff_7d < 0) AS n_rises_7d,
  count(*) FILTER (diff_30d > 0) AS n_drops_30d, count(*) FILTER (diff_30d < 0) AS n_rises_30d
FROM changes GROUP BY shop"""

_DUEL = "shop IN ('shop_1', 'shop_7')"


def _histogram(owner: str, only: str) -> str:
    return f"""
SELECT {owner}, bin, count(*) AS count, any_value(lo + (bin - 1) * ((hi - lo) / 10)) AS bin_lo,
  any_value(lo + bin * ((hi - lo) / 10)) AS bin_hi
FROM (SELECT {owner}, lo, hi, CAST(least(floor((disc1 - lo) / (hi - lo) * 10) + 1, 10) AS INTEGER) AS bin
  FROM enriched, d, (SELECT min(disc1) AS lo, max(disc1) AS hi FROM enriched, d WHERE date = d {only})
  WHERE date = d AND disc1 IS NOT NULL {only})
GROUP BY {owner}, bin"""


_SHOPS = [f"shop_{i}" for i in range(10)]
_RIVALS = [s for s in _SHOPS if s != "shop_1"]
_LED = (
    "near WHERE depth = 4 AND article IN (SELECT article FROM near WHERE depth = 4 AND shop = 'shop_1' AND rank = 1)"
)

_BODIES = {
    "market_slice": "SELECT * FROM offers",
    "daily_min": """
SELECT country, article, date, price AS min_price, shop AS min_price_shop FROM all_offers
QUALIFY row_number() OVER (PARTITION BY country, article, date ORDER BY price NULLS FIRST, shop) = 1""",
    "daily_min_priced": """
SELECT country, article, date, min(price_delivery) AS min_price, min(shop) AS min_price_shop FROM (
  SELECT * FROM offers WHERE price_delivery IS NOT NULL
  QUALIFY price_delivery = min(price_delivery) OVER (PARTITION BY country, article, date))
GROUP BY country, article, date""",
    "daily_mean": """
SELECT country, article, date, round_even(avg(price_delivery) * 10, 0) / 10 AS mean_price
FROM all_offers GROUP BY country, article, date""",
    "assortment": """
SELECT DISTINCT o.country, o.article, l.product FROM offers o LEFT JOIN list_prices l USING (article)""",
    "assortment_one_name": """
SELECT c.article, min(s.product) AS product FROM catalog_offers c LEFT JOIN supply_prices s USING (article)
GROUP BY c.article""",
    "resolve_product": """
SELECT o.country, o.article, min(l.product) AS product FROM offers o LEFT JOIN list_prices l USING (article)
GROUP BY o.country, o.article""",
    "resolve_article": """
SELECT o.country, l.product, min(o.article) AS article FROM offers o JOIN list_prices l USING (article)
GROUP BY o.country, l.product""",
    "shop_directory": "SELECT DISTINCT country, shop FROM all_offers ORDER BY country, shop",
    "country_directory": "SELECT DISTINCT country FROM catalog_offers ORDER BY country",
    "default_shops": """
SELECT country, article, CAST(row_number() OVER (PARTITION BY country, article ORDER BY pref, shop) AS INTEGER) AS position,
  shop
FROM (SELECT DISTINCT country, article, shop, coalesce(pref, 9) AS pref FROM all_offers LEFT JOIN
  (VALUES ('shop_7', 1), ('shop_3', 2), ('shop_1', 3)) p(shop, pref) USING (shop))
QUALIFY pref < 9 AND row_number() OVER (PARTITION BY country, article ORDER BY pref, shop) <= 2
  OR row_number() OVER (PARTITION BY country, article ORDER BY pref, shop) = 1""",
    "shop_series": """
SELECT country, article, date, shop, price_delivery AS value FROM offers WHERE shop IN ('shop_1', 'shop_7')""",
    "price_development": """
SELECT o.country, o.article, date, o.shop AS series, price AS value, o.shop FROM offers o JOIN (
  SELECT country, article, shop FROM (SELECT DISTINCT country, article, shop, coalesce(pref, 9) AS pref FROM offers LEFT JOIN
    (VALUES ('shop_7', 1), ('shop_3', 2), ('shop_1', 3)) p(shop, pref) USING (shop))
  QUALIFY pref < 9 AND row_number() OVER (PARTITION BY country, article ORDER BY pref, shop) <= 2
    OR row_number() OVER (PARTITION BY country, article ORDER BY pref, shop) = 1) c
  ON o.country = c.country AND o.article = c.article AND o.shop = c.shop
UNION ALL
SELECT * FROM (SELECT country, article, date, 'min', price, shop FROM offers
  QUALIFY row_number() OVER (PARTITION BY country, article, date ORDER BY price NULLS FIRST, shop) = 1)
UNION ALL
SELECT country, article, date, 'mean', round_even(avg(price) * 10, 0) / 10, NULL FROM offers
GROUP BY country, article, date""",
    "recent_offers": "SELECT offers.* FROM offers, d WHERE date >= d - 10",
    "snapshots": "SELECT date, country, article, shop, price, price_delivery, year, label FROM marked",
    "list_price_join": """
SELECT o.*, l.product, l.subcategory, l.family, l.price AS list_price FROM all_offers o
LEFT JOIN list_prices l ON o.article = l.article AND year(o.date) = l.year""",
    "supply_price_join": """
SELECT c.*, s.product, s.price AS ancor FROM catalog_offers c LEFT JOIN supply_prices s USING (article, year)""",
    "platform_price_join": """
SELECT m.*, p.amz_price AS amazon FROM market_offers m LEFT JOIN platform_prices p USING (article)""",
    "vat_join": "SELECT c.*, v.vat FROM catalog_offers c LEFT JOIN vat v USING (country)",
    "discounts": """
SELECT country, article, date, shop, price, price_delivery, list_price, disc1, disc2 FROM enriched""",
    "fx_to_eur": "SELECT article, country, date, price, price_eur FROM catalog_eur",
    "net_price": "SELECT article, country, date, price_eur, price_net FROM market_net",
    "margin": """
SELECT article, country, date, price_net, s.price AS ancor,
  round_even((1 - s.price / nullif(price_net, 0)) * 10000, 0) / 10000 AS margin
FROM catalog_net LEFT JOIN supply_prices s USING (article, year)""",
    "margin_unrounded_net": """
SELECT article, country, date, price_eur, p.amz_price AS amazon,
  round_even((1 - p.amz_price / nullif(price_eur / (1 + vat), 0)) * 10000, 0) / 10000 AS margin
FROM market_net LEFT JOIN platform_prices p USING (article)""",
    "discounted_margin": """
SELECT *, round_even((1 - ancor / nullif(price_disc, 0)) * 10000, 0) / 10000 AS margin_disc FROM (
  SELECT article, country, date, discount, s.price AS ancor,
    round_even(price_eur * (1 - discount / 100) * 100, 0) / 100 AS price_disc,
    round_even(price_net * (1 - discount / 100) * 100, 0) / 100 AS price_net_disc
  FROM catalog_net LEFT JOIN supply_prices s USING (article, year))""",
    "margin_band": """
SELECT article, country, date, margin,
  CASE WHEN margin * 100 < 45 THEN 'low' WHEN margin * 100 > 70 THEN 'high' ELSE 'mid' END AS band FROM comparison""",
    "country_index": """
SELECT article, country, CAST(row_number() OVER (PARTITION BY article ORDER BY country) - 1 AS INTEGER) AS country_id
FROM comparison, cd WHERE date = d""",
    "display_columns": f"""
SELECT country, CAST(article AS VARCHAR) AS article, replace(CAST(price AS VARCHAR), '.', ',') AS price_text,
  {_percent_comma("disc1")} AS disc_comma, {_percent("disc2")} AS disc_point,
  strftime(date, '%d.%m.%Y') AS date_text, strftime(date, '%d %b') AS day_text
FROM enriched""",
    "leaders_price": _leaders("price", ""),
    "leaders_priced": _leaders("price_delivery", "AND price_delivery IS NOT NULL"),
    "leaders_delivery": """
SELECT country, shop, count(*) AS count FROM (
  SELECT country, shop FROM all_offers, ad WHERE date >= d - 10
  QUALIFY row_number() OVER (PARTITION BY country, date, article ORDER BY price_delivery NULLS FIRST, shop) <= 3)
GROUP BY country, shop
QUALIFY row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, shop) <= 5""",
    "leader_text": f"SELECT string_agg(shop, ', ' ORDER BY count DESC, shop) AS shops FROM ({_leaders('price', '')})",
    "date_range": "SELECT min(date) AS first_date, max(date) AS last_date FROM catalog_offers",
    "freshness": """
SELECT max(date) AS last_date, count(DISTINCT shop) FILTER (country = 'de')
  + max(CASE WHEN country = 'de' AND shop IS NULL THEN 1 ELSE 0 END) AS n_shops
FROM all_offers""",
    "price_rank": """
SELECT country, date, article, shop, price_delivery, CASE WHEN price_delivery IS NOT NULL
  THEN rank() OVER (PARTITION BY country, date, article ORDER BY price_delivery NULLS LAST) END AS rank
FROM all_offers""",
    "rank_counts": """
SELECT shop, rank, count(*) AS count FROM ranked, d WHERE date = d AND rank IS NOT NULL GROUP BY shop, rank
QUALIFY row_number() OVER (PARTITION BY shop ORDER BY rank) <= 4""",
    "rank_list": """
SELECT shop, article, product, price, disc1 FROM ranked, d WHERE date = d AND rank = 2""",
    "price_change_matrix": "SELECT * FROM changes",
    "price_change_matrix_by_article": """
SELECT country, shop, article, d30 - d0 AS diff_30d, d7 - d0 AS diff_7d, d1 - d0 AS diff_1d, d0 FROM (
  SELECT country, shop, article, min(price_delivery) FILTER (date = d) AS d0, min(price_delivery) FILTER (date = d - 1) AS d1,
    min(price_delivery) FILTER (date = d - 7) AS d7, min(price_delivery) FILTER (date = d - 30) AS d30
  FROM all_offers, ad WHERE date IN (d, d - 1, d - 7, d - 30) GROUP BY country, shop, article)""",
    "price_change_counts": _CHANGE_COUNTS,
    "price_change_counts_strict": f"""
SELECT c.shop, {", ".join(f"CASE WHEN n = 4 THEN {c} ELSE 0 END AS {c}" for c in (
        "n_drops_1d", "n_rises_1d", "n_drops_7d", "n_rises_7d", "n_drops_30d", "n_rises_30d"))}
FROM ({_CHANGE_COUNTS}) c JOIN (SELECT shop, count(DISTINCT label) AS n FROM marked GROUP BY shop) USING (shop)""",
    "discount_histogram": _histogram("shop", ""),
    "top_discounts": _top_discounts("disc1", "price"),
    "top_discounts_listed": _top_discounts("disc2", "price_delivery", "AND disc2 IS NOT NULL"),
    "surplus": f"SELECT country, article, shop, price_delivery, surplus FROM ({_top_discounts('disc2', 'price_delivery')})",
    "price_matrix": _matrix(("d", "d - 1", "d - 7", "d - 30"), "price"),
    "price_matrix_dates": _matrix(
        ("DATE '2024-01-20'", "DATE '2024-01-15'", "DATE '2023-12-31'", "DATE '2023-12-24'"), "price_delivery"
    ),
    "competitor_matrix": f"""
SELECT article, product, {", ".join(f"min(price) FILTER (shop = '{s}') AS {s}" for s in _SHOPS)}
FROM {_LED} GROUP BY article, product""",
    "unpivot_competitors": f"""
SELECT r.article, r.product, b.price AS base_price, r.shop, r.price FROM (SELECT * FROM {_LED} AND shop <> 'shop_1') r
JOIN near b ON b.depth = 4 AND b.shop = 'shop_1' AND b.article = r.article""",
    "first_per_key": "SELECT article, country, date, price, discount, stock, year FROM catalog_one",
    "min_price_gaps": """
SELECT base_shop, article, product, base_price, shop, price, diff FROM gaps WHERE depth = 1 AND largest >= 10""",
    "min_price_gaps_shop": """
SELECT base_shop, article, product, base_price, shop, price, diff FROM gaps
WHERE depth = 3 AND base_shop = 'shop_1' AND diff >= 50""",
    "country_comparison": "SELECT * FROM comparison",
    "marketplace_comparison": "SELECT * FROM market_comparison",
    "latest_margins": f"""
SELECT c.*, margin * 100 AS margin_pct, {_percent("margin")} AS margin_label,
  CASE WHEN margin * 100 < 45 THEN 'low' WHEN margin * 100 > 70 THEN 'high' ELSE 'mid' END AS band,
  CAST(row_number() OVER (PARTITION BY article ORDER BY country) - 1 AS INTEGER) AS country_id,
  format('{{:.0f}}% || {{:.1f}} €', discount, round_even(price_disc * 10, 0) / 10) AS discount_label,
  format('{{:.1f}}', round_even(price_eur * 10, 0) / 10) AS price_label
FROM comparison c, cd WHERE date = d""",
    "latest_margins_market": f"""
SELECT c.*, margin * 100 AS margin_pct, {_percent("margin")} AS margin_label,
  CASE WHEN margin * 100 < 15 THEN 'low' WHEN margin * 100 > 30 THEN 'high' ELSE 'mid' END AS band,
  format('{{:.1f}}', round_even(price_eur * 10, 0) / 10) AS price_label
FROM market_comparison c, md WHERE date = d""",
    "stock_series": "SELECT article, date, stock FROM catalog_offers, cd WHERE date >= d - 30 AND country = 'de'",
    "country_series": """
SELECT article, country, date, price_eur FROM catalog_eur, cd
WHERE date >= d - 30 AND country IN ('cz', 'de', 'es', 'sk')""",
    "low_margin_catalog": f"""
SELECT country, CAST(article AS VARCHAR) AS article, price, discount, stock, product, {_percent("margin")} AS margin_pct_text
FROM low_catalog l WHERE margin < 0.4""",
    "low_margin_market": f"""
SELECT country, CAST(article AS VARCHAR) AS article, price, product, amazon,
  format('{{:.1f}}', round_even(price_eur * 10, 0) / 10) AS price_eur, {_percent("margin")} AS margin_pct_text
FROM low_market l WHERE margin < 0.2""",
    "low_margin_counts": """
SELECT country, any_value(date) AS date, CAST(40 AS DOUBLE) AS max_margin, count(*) FILTER (margin < 0.4) AS n_products
FROM low_catalog GROUP BY country""",
    "low_margin_counts_market": """
SELECT country, any_value(date) AS date, CAST(20 AS DOUBLE) AS max_margin, count(*) FILTER (margin < 0.2) AS n_products
FROM low_market GROUP BY country""",
    "rank_counts_all": """
SELECT country, shop, rank, count(*) AS count FROM ranked, d WHERE date = d AND rank IS NOT NULL
GROUP BY country, shop, rank QUALIFY row_number() OVER (PARTITION BY country, shop ORDER BY rank) <= 4""",
    "rank_list_all": "SELECT country, shop, article, product, price, disc1 FROM ranked, d WHERE date = d AND rank = 2",
    "min_price_gaps_all": """
SELECT country, base_shop, article, product, base_price, shop, price, diff FROM gaps WHERE depth = 1 AND largest >= 10""",
    "price_change_counts_all": _CHANGE_COUNTS.replace("SELECT shop", "SELECT country, shop").replace("BY shop", "BY country, shop"),
    "discount_histogram_all": _histogram("country, shop", ""),
    "shop_report_ranks": f"""
SELECT shop, rank, count(*) AS count FROM ranked, d WHERE date = d AND rank IS NOT NULL AND {_DUEL} GROUP BY shop, rank
QUALIFY row_number() OVER (PARTITION BY shop ORDER BY rank) <= 4""",
    "shop_report_lists": f"""
SELECT shop, rank, CAST(article AS VARCHAR) AS article, product, replace(CAST(price AS VARCHAR), '.', ',') AS price,
  {_percent_comma("disc1")} AS disc1
FROM ranked, d WHERE date = d AND rank <= 2 AND {_DUEL}""",
    "shop_report_histogram": _histogram("shop", f"AND {_DUEL}"),
    "shop_report_changes": _CHANGE_COUNTS.replace("FROM changes", f"FROM changes WHERE {_DUEL}"),
    "shop_report": f"""
SELECT shop, rank, CAST(article AS VARCHAR) AS article, product, replace(CAST(price AS VARCHAR), '.', ',') AS price,
  {_percent_comma("disc1")} AS disc1
FROM ranked, d WHERE date = d AND rank <= 2""",
    "encrypted_ingest": "SELECT * FROM all_offers",
}


_ALL_MARKETS = {
    "assortment", "resolve_product", "resolve_article", "snapshots", "shop_series", "price_development", "daily_min_priced",
    "discounts", "display_columns", "top_discounts", "top_discounts_listed", "surplus", "price_matrix", "price_matrix_dates",
    "rank_counts_all", "rank_list_all", "min_price_gaps_all", "price_change_counts_all", "discount_histogram_all",
}


def oracle_sql() -> dict[str, str]:
    return {name: (ALL_VIEWS if name in _ALL_MARKETS else VIEWS) + body.strip() for name, body in _BODIES.items()}

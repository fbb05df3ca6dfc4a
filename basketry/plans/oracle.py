"""DuckDB SQL for the queries of queries.py.

The SQL is written from the definitions, with self-joins instead of levels, lists or buckets.
"""

from __future__ import annotations

BRANDS = "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
TYPES = "SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
WORDS = r"SELECT DISTINCT doc_id AS tid, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS item FROM documents"
SUPPLIERS = "SELECT l_suppkey AS user_id, p_brand AS item_id, avg(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
CUSTOMERS = "SELECT o_custkey AS user_id, p_brand AS item_id, avg(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
EVENTS = "SELECT user_id, event_type AS item_id, avg(value) AS score FROM events GROUP BY 1, 2"
MARK = "(user_id + ascii(substr(item_id, -1, 1))) % 5"


def itemsets(baskets: str, minsup: float, max_k: int) -> str:
    """CTEs o, n, f1..fk, found(k, itemset, support)."""
    least = f"(SELECT greatest(1, round(count(DISTINCT tid) * {minsup})) FROM o)"
    parts = [f"WITH o AS ({baskets})", f"f1 AS (SELECT item AS i1, count(*) AS support FROM o GROUP BY 1 HAVING count(*) >= {least})", "g AS (SELECT o.* FROM o JOIN f1 ON i1 = item)"]
    for k in range(2, max_k + 1):
        names = ", ".join(f"x{j}.item AS i{j}" for j in range(1, k + 1))
        joins = " ".join(f"JOIN g x{j} ON x{j}.tid = x1.tid AND x{j}.item > x{j - 1}.item" for j in range(2, k + 1))
        parts.append(f"f{k} AS (SELECT {names}, count(*) AS support FROM g x1 {joins} GROUP BY {', '.join(map(str, range(1, k + 1)))} HAVING count(*) >= {least})")
    found = " UNION ALL ".join(f"SELECT {k} AS k, {' || chr(44) || '.join(f'i{j}' for j in range(1, k + 1))} AS itemset, support FROM f{k}" for k in range(1, max_k + 1))
    return ", ".join(parts) + f", found AS ({found})"


def mined(baskets: str, minsup: float, max_k: int) -> str:
    return itemsets(baskets, minsup, max_k) + " SELECT CAST(k AS INTEGER) AS k, itemset, support FROM found"


def ruled(baskets: str, minsup: float, max_k: int, minconf: float) -> str:
    splits = []
    for k in range(2, max_k + 1):
        for mask in range(1, 2**k - 1):
            side = lambda bit: " || chr(44) || ".join(f"i{j + 1}" for j in range(k) if (mask >> j & 1) == bit)
            splits.append(f"SELECT {side(1)} AS antecedent, {side(0)} AS consequent, support FROM f{k}")
    return itemsets(baskets, minsup, max_k) + f", s AS ({' UNION ALL '.join(splits)}) SELECT antecedent, consequent, s.support, round(s.support / found.support, 6) AS confidence FROM s JOIN found ON itemset = antecedent WHERE s.support / found.support >= {minconf}"


def _split(ratings: str) -> str:
    return f"WITH r AS ({ratings}), train AS (SELECT * FROM r WHERE {MARK} <> 0), test AS (SELECT * FROM r WHERE {MARK} = 0)"


def _pearson(rows: str) -> str:
    return f"""SELECT a, b, CASE WHEN den < 1e-9 THEN 1.0 ELSE num / den END AS sim FROM (
  SELECT a, b, sxy - sx * sy / n AS num, sqrt(greatest(0, sxx - sx * sx / n) * greatest(0, syy - sy * sy / n)) AS den FROM (
    SELECT x.user_id AS a, y.user_id AS b, count(*) AS n, sum(x.score) AS sx, sum(y.score) AS sy, sum(x.score * x.score) AS sxx, sum(y.score * y.score) AS syy, sum(x.score * y.score) AS sxy
    FROM {rows} x JOIN {rows} y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1, 2))"""


def _adjusted(rows: str) -> str:
    return f"""SELECT a, b, CASE WHEN den < 1e-9 THEN 1.0 ELSE num / den END AS sim FROM (
  SELECT x.item_id AS a, y.item_id AS b, sum(x.c * y.c) AS num, sqrt(sum(x.c * x.c)) * sqrt(sum(y.c * y.c)) AS den
  FROM (SELECT *, score - avg(score) OVER (PARTITION BY user_id) AS c FROM {rows}) x
  JOIN (SELECT *, score - avg(score) OVER (PARTITION BY user_id) AS c FROM {rows}) y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2)"""


BOTH = "SELECT a AS thing, b AS other, sim FROM s UNION ALL SELECT b, a, sim FROM s"


def _user_based(threshold: float, name: str = "ub") -> str:
    """CTE of predictions from s (pairs) and train."""
    return f"""{name} AS (SELECT thing AS user_id, item_id, round(sum(sim * score) / sum(sim), 6) AS raw
  FROM ({BOTH}) JOIN train ON train.user_id = other WHERE sim > {threshold}
    AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = thing AND t.item_id = train.item_id) GROUP BY 1, 2)"""


def _neighbours(threshold: float, name: str = "nb", sims: str = "si") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT thing AS item_id, other AS other_id, sim, row_number() OVER (PARTITION BY thing ORDER BY round(sim, 9) DESC, other) AS rnk
  FROM (SELECT a AS thing, b AS other, sim FROM {sims} UNION ALL SELECT b, a, sim FROM {sims}))
  WHERE sim > {threshold} AND rnk <= (SELECT least(count(DISTINCT item_id) - 1, floor(count(DISTINCT item_id) * (1 - {threshold}) + 1e-9)) FROM train))"""


def _item_based(name: str = "ib", neighbours: str = "nb") -> str:
    return f"""{name} AS (SELECT user_id, other_id AS item_id, round(sum(sim * score) / sum(sim), 6) AS raw
  FROM train JOIN {neighbours} USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = train.user_id AND t.item_id = other_id) GROUP BY 1, 2)"""


def _errors(predicted: str, value: str = "round(p.raw)") -> str:
    return f"""SELECT round(avg(abs(coalesce({value}, 0) - test.score)), 6) AS mae, round(sqrt(avg((coalesce({value}, 0) - test.score) ** 2)), 6) AS rmse, count(*) AS n
FROM test LEFT JOIN {predicted} p USING (user_id, item_id) WHERE test.user_id IN (SELECT user_id FROM train)"""


SETS = "SELECT l_orderkey AS tid, list_sort(list(DISTINCT l_partkey % 7)) AS a, list_sort(list(DISTINCT l_suppkey % 7)) AS b FROM lineitem GROUP BY 1"
TEXT = "array_to_string({0}, ',')"

_STEPS = "SELECT range / 100 AS t FROM range(31)"
_PAIRS = "SELECT user_id, item_id FROM test WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = test.user_id AND t.item_id = test.item_id)"
_GRID = f"""{_split(SUPPLIERS)}, s AS ({_pearson('train')}), si AS ({_adjusted('train')}), st AS ({_STEPS}), pr AS ({_PAIRS}), k AS (SELECT count(DISTINCT item_id) AS items FROM train),
u AS (SELECT pr.user_id, pr.item_id, t, round(sum(sim * score) / sum(sim), 6) AS raw FROM pr JOIN ({BOTH}) ON thing = pr.user_id JOIN train ON train.user_id = other AND train.item_id = pr.item_id JOIN st ON sim > t GROUP BY 1, 2, 3),
n AS (SELECT thing, other, sim, row_number() OVER (PARTITION BY thing ORDER BY round(sim, 9) DESC, other) AS rnk FROM (SELECT a AS thing, b AS other, sim FROM si UNION ALL SELECT b, a, sim FROM si)),
i AS (SELECT pr.user_id, pr.item_id, t, round(sum(sim * score) / sum(sim), 6) AS raw FROM pr JOIN train ON train.user_id = pr.user_id JOIN n ON n.thing = train.item_id AND n.other = pr.item_id JOIN st ON sim > t CROSS JOIN k WHERE rnk <= least(items - 1, floor(items * (1 - t) + 1e-9)) GROUP BY 1, 2, 3),
v AS (SELECT user_id, item_id, score, a.t AS user_threshold, b.t AS item_threshold, u.raw AS ur, i.raw AS ir FROM test CROSS JOIN st a CROSS JOIN st b JOIN u USING (user_id, item_id) JOIN i USING (user_id, item_id) WHERE u.t = a.t AND i.t = b.t AND user_id IN (SELECT user_id FROM train)),
w AS (SELECT user_threshold, item_threshold, alpha, sum(abs(ur * (1 - alpha) + ir * alpha - score) - abs(score)) AS gain FROM v CROSS JOIN (SELECT (50 + range) / 100 AS alpha FROM range(31)) GROUP BY 1, 2, 3)
SELECT a.t AS user_threshold, b.t AS item_threshold, g.alpha, round((known.whole + coalesce(gain, 0)) / known.n, 6) AS mae
FROM st a CROSS JOIN st b CROSS JOIN (SELECT (50 + range) / 100 AS alpha FROM range(31)) g CROSS JOIN (SELECT sum(abs(score)) AS whole, count(*) AS n FROM test WHERE user_id IN (SELECT user_id FROM train)) known
LEFT JOIN w ON w.user_threshold = a.t AND w.item_threshold = b.t AND w.alpha = g.alpha"""

_HYBRID = f"{_split(SUPPLIERS)}, s AS ({_pearson('train')}), si AS ({_adjusted('train')}), {_user_based(0.2)}, {_neighbours(0.02)}, {_item_based()}, hy AS (SELECT user_id, item_id, round(ub.raw * 0.4 + ib.raw * 0.6, 6) AS raw FROM ub JOIN ib USING (user_id, item_id))"
def _ruled(minsup: float, max_k: int, minconf: float) -> str:
    """CTEs r, train, test, those of itemsets(), and ru(user_id, item_id, raw) from rules with sides of any size."""
    splits = []
    for k in range(2, max_k + 1):
        for mask in range(1, 2**k - 1):
            side = lambda bit: "[" + ", ".join(f"i{j + 1}" for j in range(k) if (mask >> j & 1) == bit) + "]"
            splits.append(f"SELECT {side(1)} AS a, {side(0)} AS c, support FROM f{k}")
    mining = itemsets("SELECT DISTINCT user_id AS tid, item_id AS item FROM train", minsup, max_k).removeprefix("WITH ")
    return f"""{_split(SUPPLIERS)}, {mining}, s AS ({' UNION ALL '.join(splits)}),
q AS (SELECT row_number() OVER () AS rule, a, c, s.support / found.support AS conf FROM s JOIN found ON itemset = array_to_string(a, ',') WHERE s.support / found.support >= {minconf}),
h AS (SELECT user_id, rule, sum(score) AS scores, count(*) AS n FROM (SELECT rule, len(a) AS needed, unnest(a) AS item_id FROM q) JOIN train USING (item_id) GROUP BY user_id, rule, needed HAVING count(*) = needed),
ru AS (SELECT user_id, item_id, round(sum(conf * scores) / sum(conf * n), 6) AS raw FROM h JOIN (SELECT rule, conf, unnest(c) AS item_id FROM q) USING (rule) GROUP BY 1, 2)"""


_RULED = _ruled(0.3, 3, 0.8)

TEN = "SELECT tid, unnest(string_split(b, ' ')) AS item FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(["a b", "a c d e", "b c d f", "a b c d", "a b c f", "b c d f", "a b c d e", "a c e", "b c d", "c f"])) + ") v(tid, b)"
RATED = "SELECT user_id, item_id, first(score ORDER BY ts, score) AS score, min(ts) AS ts FROM (SELECT l_suppkey AS user_id, l_partkey % {n} AS item_id, l_quantity::DOUBLE AS score, l_orderkey * 8 + l_linenumber AS ts FROM lineitem) GROUP BY 1, 2"
#: Each item's least basket is its key_info.
_BY_ITEM = "SELECT item, count(*) AS df, CAST(min(tid) AS VARCHAR) AS key_info FROM (SELECT DISTINCT tid, item FROM ({})) GROUP BY 1"

ORACLE_SQL: dict[str, str] = {
    "source_baskets_brand": BRANDS,
    "source_baskets_of_ratings": f"SELECT DISTINCT user_id AS tid, item_id AS item FROM ({EVENTS})",
    "source_document_words": r"WITH w AS (SELECT doc_id AS tid, regexp_extract_all(text, '\p{L}{4,}') AS l, string_split_regex(text, '\p{L}{4,}') AS g FROM documents), e AS (SELECT tid, unnest(l) AS item, unnest(range(len(l))) AS k, unnest(g[1:len(l)]) AS gap FROM w), p AS (SELECT tid, lower(item) AS item, strlen(item) AS length, sum(strlen(gap) + strlen(item)) OVER (PARTITION BY tid ORDER BY k) - strlen(item) AS pos FROM e) SELECT tid, item, count(*) AS cnt, min(pos)::BIGINT AS first_position, max(pos)::BIGINT AS last_position, min(length) AS length FROM p GROUP BY 1, 2",
    "item_dictionary": f"SELECT row_number() OVER (ORDER BY item) - 1 AS item_id, item FROM (SELECT DISTINCT item FROM ({BRANDS}))",
    "item_frequency_order": f"SELECT item, count(*) AS support, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM ({BRANDS}) GROUP BY 1",
    "count_items_distinct": f"SELECT item, count(*) AS support FROM ({BRANDS}) GROUP BY 1",
    "count_items_occurrence": "SELECT p_brand AS item, count(*) AS support FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "count_multiplicity": "SELECT l_orderkey AS tid, p_type AS item, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "counter_pairs": "SELECT least(i, j) AS i, greatest(i, j) AS j, count(*) AS n FROM (SELECT l_partkey % 40 AS i, l_suppkey % 40 AS j FROM lineitem) WHERE i <> j GROUP BY 1, 2",
    "counter_triples": "SELECT array_to_string(list_sort([x, y, z]), ',') AS key, count(*) AS n FROM (SELECT l_partkey % 12 AS x, l_suppkey % 12 AS y, l_orderkey % 12 AS z FROM lineitem) WHERE x <> y AND y <> z AND x <> z GROUP BY 1",
    "dhp_pair_buckets": f"WITH o AS ({BRANDS}), i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS id FROM (SELECT DISTINCT item FROM o)), x AS (SELECT tid, id FROM o JOIN i USING (item)) SELECT (x.id * 31 + y.id) % 97 AS bucket, count(*) AS n FROM x JOIN x y ON x.tid = y.tid AND x.id < y.id GROUP BY 1",
    "set_operations": f"SELECT tid, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS union_set, array_to_string(list_sort(CASE WHEN len(a) >= len(b) THEN list_filter(a, lambda x: NOT list_contains(b, x)) ELSE list_filter(b, lambda x: NOT list_contains(a, x)) END), ',') AS difference, len(a) > 0 AND len(b) > 0 AND list_has_all(a, b) AS b_in_a FROM ({SETS})",
    "set_prefix_join": f"SELECT tid, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS joined FROM ({SETS}) WHERE len(a) = len(b) AND len(list_distinct(list_concat(a, b))) = len(a) + 1 AND (len(a) = 1 OR a[1:len(a) - 1] = b[1:len(b) - 1])",
    "set_search": f"SELECT tid, len(list_filter(a, lambda x: x < 3)) AS position, list_contains(a, 3) AS found FROM ({SETS})",
    "parse_basket_text": "SELECT p_partkey, 0::BIGINT AS pos, p_brand AS item FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part UNION ALL SELECT p_partkey, 2, 'x' FROM part",
    "identifier_hash": "WITH RECURSIVE h AS (SELECT n_name, 0 AS k, 0::BIGINT AS v FROM nation UNION ALL SELECT n_name, k + 1, (v * 37 + ascii(substr(n_name, k + 1, 1))) % 4294967296 FROM h WHERE k < length(n_name)) SELECT n_name, v % 1000 AS slot FROM h WHERE k = length(n_name)",
    **{name: mined(BRANDS, 0.003, 3) for name in ("apriori_brand", "dhp_brand", "fp_growth_brand", "vertical_brand")},
    **{name: mined(TYPES, 0.1, 3) for name in ("apriori_type", "vertical_type_small_chunks")},
    "apriori_words": mined(WORDS, 0.05, 2),
    "candidates_of_pairs": itemsets(BRANDS, 0.0155, 2) + " SELECT x.i1 || ',' || x.i2 || ',' || y.i2 AS itemset FROM f2 x JOIN f2 y ON x.i1 = y.i1 AND x.i2 < y.i2 JOIN f2 z ON z.i1 = x.i2 AND z.i2 = y.i2",
    "compare_miners": "SELECT miner, 0::BIGINT AS differences FROM (VALUES ('dhp'), ('fp_growth'), ('vertical')) v(miner)",
    "rules_brand": ruled(BRANDS, 0.003, 3, 0.02),
    "rules_type": ruled(TYPES, 0.1, 3, 0.2),
    "rules_words": ruled(WORDS, 0.05, 2, 0.4),
    "index_document_frequency": f"SELECT item, count(*) AS df FROM ({BRANDS}) GROUP BY 1",
    "index_find_records": f"SELECT tid AS record_id FROM ({BRANDS}) WHERE item = 'Brand#11'",
    "index_postings": f"SELECT item, tid AS record_id, row_number() OVER (PARTITION BY item ORDER BY tid DESC) AS place FROM ({BRANDS})",
    "index_intersection": f"SELECT tid AS record_id FROM ({BRANDS}) WHERE item = 'Brand#11' INTERSECT SELECT tid FROM ({BRANDS}) WHERE item = 'Brand#12'",
    "index_single_key": f"SELECT tid AS record_id FROM ({BRANDS}) WHERE item = 'Brand#13'",
    "index_missing_key": f"SELECT tid AS record_id FROM ({BRANDS}) WHERE false",
    "index_change_key_info": f"SELECT item, CASE WHEN item = 'Brand#12' THEN '2#new' ELSE '1#' || item END AS key_info FROM ({BRANDS}) GROUP BY 1",
    "index_size": f"SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, max(df) AS longest FROM (SELECT item, count(*) AS df FROM ({BRANDS}) GROUP BY 1)",
    "co_rated_counts": f"{_split(EVENTS)} SELECT x.user_id AS a, y.user_id AS b, count(*) AS n FROM train x JOIN train y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1, 2",
    "similarity_euclidean": f"WITH r AS ({EVENTS}) SELECT x.user_id AS a, y.user_id AS b, round(1 / (1 + sqrt(sum((x.score - y.score) * (x.score - y.score)))), 6) AS sim FROM r x JOIN r y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1, 2",
    "similarity_pearson": f"WITH r AS ({SUPPLIERS}) SELECT a, b, round(sim, 6) AS sim FROM ({_pearson('r')})",
    "similarity_adjusted_cosine": f"WITH r AS ({CUSTOMERS}) SELECT a, b, round(sim, 6) AS sim FROM ({_adjusted('r')})",
    "top_matches": f"WITH r AS ({SUPPLIERS}), s AS ({_pearson('r')}) SELECT other, round(sim, 6) AS sim FROM ({BOTH}) WHERE thing = 1 ORDER BY round(sim, 9) DESC, other LIMIT 5",
    "recommend_user_based": f"{_split(SUPPLIERS)}, s AS ({_pearson('train')}), {_user_based(0.2)} SELECT user_id, item_id, raw, round(raw) AS score FROM ub",
    "recommend_user_based_one": f"{_split(SUPPLIERS)}, s AS ({_pearson('train')}), {_user_based(0.0)} SELECT user_id, item_id, raw, round(raw) AS score FROM ub WHERE user_id = 2 ORDER BY raw DESC, item_id LIMIT 3",
    "item_neighbours": f"{_split(CUSTOMERS)}, si AS ({_adjusted('train')}), {_neighbours(0.01)} SELECT item_id, other_id, round(sim, 6) AS sim, rnk FROM nb",
    "recommend_item_based": f"{_split(CUSTOMERS)}, si AS ({_adjusted('train')}), {_neighbours(0.01)}, {_item_based()} SELECT user_id, item_id, raw, round(raw) AS score FROM ib",
    "recommend_item_based_top": f"{_split(CUSTOMERS)}, si AS ({_adjusted('train')}), {_neighbours(0.01)}, {_item_based()} SELECT user_id, item_id, raw, round(raw) AS score FROM ib QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, item_id) <= 2",
    "recommend_mean_centred": f"{_split(SUPPLIERS)}, s AS ({_pearson('train')}), m AS (SELECT user_id, avg(score) AS mean FROM train GROUP BY 1), p AS (SELECT thing AS user_id, item_id, sum(sim * (score - mean)) / sum(abs(sim)) AS above FROM ({BOTH}) JOIN train ON train.user_id = other JOIN m ON m.user_id = other WHERE abs(sim) > 0.2 AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = thing AND t.item_id = train.item_id) GROUP BY 1, 2) SELECT user_id, item_id, round(mean + above, 6) AS raw, round(round(mean + above, 6)) AS score FROM p JOIN m USING (user_id)",
    "recommend_hybrid": f"{_HYBRID} SELECT * FROM hy",
    "recommend_rule_based": f"{_RULED} SELECT * FROM ru",
    "evaluate_hybrid": f"{_HYBRID} {_errors('hy', 'p.raw')}",
    "evaluate_rule_based": f"{_RULED} {_errors('ru', 'p.raw')}",
    "index_word_frequency": "SELECT item, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS item FROM documents) GROUP BY 1",
    "recommend_item_based_one": f"{_split(CUSTOMERS)}, si AS ({_adjusted('train')}), {_neighbours(0.01)}, {_item_based()} SELECT user_id, item_id, raw, round(raw) AS score FROM ib WHERE user_id = 1",
    "evaluate_user_based": f"{_split(SUPPLIERS)}, s AS ({_pearson('train')}), {_user_based(0.2)} {_errors('ub')}",
    "evaluate_item_based": f"{_split(CUSTOMERS)}, si AS ({_adjusted('train')}), {_neighbours(0.01)}, {_item_based()} {_errors('ib')}",
    "grid_search": _GRID,
    "grid_search_best": f"SELECT * FROM ({_GRID}) ORDER BY mae, user_threshold, item_threshold, alpha LIMIT 1",
    "recommend_repeated_ratings": f"WITH train AS (SELECT user_id, item_id, score FROM ({RATED.format(n=30)}) WHERE (user_id + item_id) % 3 > 0), s AS ({_pearson('train')}), {_user_based(0.1)} SELECT user_id, item_id, raw, round(raw) AS score FROM ub",
    "rules_of_repeated_ratings": "WITH t AS (SELECT user_id, item_id, first(score ORDER BY ts, score) AS score FROM (SELECT l_orderkey % 50 AS user_id, l_partkey % 10 AS item_id, l_quantity::DOUBLE AS score, l_orderkey * 8 + l_linenumber AS ts FROM lineitem) WHERE (user_id + item_id) % 4 > 0 GROUP BY 1, 2), q AS (SELECT * FROM (VALUES ([1, 2], 3, 0.9), ([4], 3, 0.8), ([5, 6], 7, 0.85)) v(a, c, conf)), h AS (SELECT user_id, c, conf, sum(score) AS scores, count(*) AS n FROM t JOIN q ON list_contains(a, item_id) GROUP BY user_id, a, c, conf HAVING count(*) = len(a)) SELECT user_id, c::BIGINT AS item_id, round(sum(conf * scores) / sum(conf * n), 6)::DOUBLE AS raw FROM h GROUP BY 1, 2",
    "source_xml_baskets": "SELECT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
    "index_of_xml": _BY_ITEM.format(BRANDS),
    "source_text_files": "SELECT n_name || ' \u56fd\u5bb6\u4fe1\u606f ' || lower(n_name) || chr(10) AS text FROM nation",
    "source_text_file_numbers": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS tid, n_name AS text FROM (SELECT n_nationkey, regexp_replace(n_name, '\\s', '', 'g') AS n_name FROM nation)",
    "source_ratings_files": RATED.format(n=50),
    "index_of_ratings": _BY_ITEM.format(f"SELECT user_id AS tid, item_id AS item FROM ({RATED.format(n=50)})"),
    "source_memory_baskets": f"SELECT tid::BIGINT AS tid, item FROM ({TEN})",
    "index_of_memory": f"SELECT item, CAST(min(tid) OVER (PARTITION BY item) AS VARCHAR) AS key_info, tid::BIGINT AS record_id FROM ({TEN})",
    "apriori_memory_baskets": mined(TEN, 0.3, 3),
    "source_tagged_words": "SELECT p_partkey AS tid, p_brand AS item FROM part WHERE p_partkey % 10 IN (1, 2, 3, 4, 5, 6) AND p_partkey % 3 > 0",
    "source_config": "SELECT * FROM (VALUES ('ROOT_DIR', '/data'), ('INPUT_DIR', '/data/in'), ('EMPTY', '')) v(key, value)",
    "sink_round_trip": f"SELECT item, count(*) AS support FROM ({BRANDS}) GROUP BY 1",
    "parameters_rejected": "SELECT * FROM (VALUES ('max_k 0', true), ('minsup 0', true), ('minconf -1', true), ('rounding up', true), ('top_n -1', true), ('sound', false), ('sound cf', false)) v(parameters, refused)",
    "itemset_support": f"SELECT 2::INTEGER AS k, 'b,c' AS itemset, count(*) AS support FROM ({TEN}) x JOIN ({TEN}) y ON x.tid = y.tid WHERE x.item = 'b' AND y.item = 'c'",
    "itemsets_pushed": f"WITH lo AS ({mined(f'SELECT * FROM ({BRANDS}) WHERE tid < 1000', 0.02, 2)}), al AS ({mined(BRANDS, 0.02, 2)}) SELECT * FROM lo UNION ALL SELECT * FROM al WHERE itemset NOT IN (SELECT itemset FROM lo)",
    "apriori_type_floor": mined(TYPES, 0.10007, 2).replace("round(count(DISTINCT tid)", "floor(count(DISTINCT tid)"),
    "compare_thresholds": f"WITH lo AS ({mined(TEN, 0.3, 3)}), hi AS ({mined(TEN, 0.5, 3)}) SELECT k, itemset, unnest(['missing', 'redundant']) AS problem FROM lo WHERE itemset NOT IN (SELECT itemset FROM hi)",
    "index_bucketed_lookup": f"SELECT tid AS record_id FROM ({BRANDS}) WHERE item = 'Brand#11' INTERSECT SELECT tid FROM ({BRANDS}) WHERE item = 'Brand#12'",
    "index_local_catalogs": f"SELECT item, count(*) AS df FROM ({BRANDS}) GROUP BY 1",
    "stream_supports": f"SELECT item, count(*) AS support FROM ({BRANDS}) GROUP BY 1",
}

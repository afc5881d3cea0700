"""Queries: entity resolution and dictionary matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as M
from ..functions import text as T
from ..operators import geo as GEO
from ..operators import phrases as P
from ..operators import resolution as E
from ..operators import search as S
from .proxies import Views
from .registry import query

_TOK = "list_distinct(string_split(p_name, ' '))"
_JAC = "len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
_PAIRS = f"SELECT a.p_brand, a.p_size, a.p_partkey AS a, b.p_partkey AS b, {_JAC} AS likeness FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"
_P = f"WITH p AS (SELECT *, {_TOK} AS t FROM part)"


def parts(v: Views):
    return v.part.select("p_partkey", "p_brand", "p_size", T.tokens(F.col("p_name"), []).alias("t"))


@query("jn08_dictionary", r"""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'exact' ELSE 'normalized' END AS method FROM supplier WHERE s_suppkey % 5 <> 0""")
def jn08(v: Views):
    """Match by name as it is, then by its key."""
    names = v.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("The "), F.upper("s_name"), F.lit(" Ltd."))).alias("name"))
    known = v.supplier.filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("known"), M.bank_key(F.col("s_name")).alias("key"))
    found = names.withColumn("key", M.bank_key(F.col("name"))).join(known, "key")
    return found.select("s_suppkey", F.when(F.col("name") == F.col("known"), "exact").otherwise("normalized").alias("method"))


_TOKENS = "list_filter(string_split(regexp_replace(replace(lower(coalesce(text, '')), '&', ' & '), '[^a-z0-9&]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("jn08_phrases", f"""WITH t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), g AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, w FROM t),
d AS (SELECT DISTINCT w[1:2 + (id % 3)::INT] AS phrase FROM t WHERE id % 4 = 0 AND len(w) > 0), f AS (SELECT id, i, w[i:i + n - 1] AS phrase FROM g, (SELECT DISTINCT len(phrase) AS n FROM d) WHERE i + n - 1 <= len(w))
SELECT id, phrase_text AS name, count(*) AS n FROM (SELECT f.id, array_to_string(d.phrase, ' ') AS phrase_text FROM f JOIN d USING (phrase)) GROUP BY ALL""")  # fmt: skip
def jn08_phrases(v: Views):
    """How often the first words of every fourth document stand in each document: a dictionary that grows with the texts."""
    words = P.words_of(F.col("text"))
    names = v.documents.filter("doc_id % 4 = 0").select(F.array_join(F.slice(words, F.lit(1), (2 + F.col("doc_id") % 3).cast("int")), " ").alias("phrase")).filter("phrase <> ''").distinct()
    found = P.find_phrases(v.documents.select(F.col("doc_id").alias("id"), "text"), P.phrase_table(names.withColumn("name", F.col("phrase"))), 4)
    return found.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("jn09_resolve_or_create", "SELECT k, min(o_orderkey) AS first FROM (SELECT o_orderkey, o_custkey % 50 AS k FROM orders) WHERE k NOT IN (SELECT s_suppkey % 50 FROM supplier WHERE s_suppkey < 30) GROUP BY k")
def jn09(v: Views):
    """Keys that no dimension row has; the first row of a key makes it."""
    rows = v.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("k"))
    known = v.supplier.filter("s_suppkey < 30").select((F.col("s_suppkey") % 50).alias("k"))
    return rows.join(known, "k", "left_anti").groupBy("k").agg(F.min("o_orderkey").alias("first"))


@query("jn12_same_price", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON floor(a.o_totalprice) = floor(b.o_totalprice) AND a.o_orderkey < b.o_orderkey AND a.o_custkey <> b.o_custkey")
def jn12(v: Views):
    rows = v.orders.select(F.floor("o_totalprice").alias("price"), "o_orderkey", "o_custkey")
    a, b = rows.toDF("price", "a", "ca"), rows.toDF("price", "b", "cb")
    return a.join(b, "price").filter("a < b AND ca <> cb").select("a", "b")


_POINTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 50 = 0 THEN 10 + (c_custkey * 37 % 300) / 100.0 ELSE 8 + (c_custkey * 37 % 2900) / 100.0 END AS lat, CASE WHEN c_custkey % 100 = 50 THEN 179.9 WHEN c_custkey % 50 = 0 THEN -179.95 ELSE 68 + (c_custkey * 53 % 2900) / 100.0 END AS lng FROM"
_KM = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query("jn14_within_distance", f"WITH p AS ({_POINTS} customer) SELECT a.id AS a, b.id AS b, round({_KM}, 3) AS km FROM p a JOIN p b ON a.id < b.id WHERE {_KM} < 65")
def jn14(v: Views):
    """Customers within 65 km; their coordinates come from their keys, some on both sides of the date line."""
    points = v.spark.sql(f"{_POINTS} {{customer}}", customer=v.customer)
    return GEO.within_distance(points, 65, digits=3).select("a", "b", "km")


@query("sj02_digit_tokens", "SELECT s_suppkey, list_filter(string_split(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: regexp_matches(x, '[0-9]')) AS t FROM supplier")
def sj02(v: Views):
    return v.supplier.select("s_suppkey", T.with_digit(T.tokens(F.col("s_name"), [])).alias("t"))


@query("er06_title_groups", "SELECT p_name, min(p_partkey) AS keeper, count(*) - 1 AS hidden FROM part GROUP BY p_name HAVING count(*) > 1")
def er06(v: Views):
    return v.part.groupBy("p_name").agg(F.min("p_partkey").alias("keeper"), (F.count(F.lit(1)) - 1).alias("hidden")).filter("hidden > 0")


@query("er07_candidates", f"{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM p) SELECT a, b FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_JAC} DESC, b.p_partkey DESC) AS r FROM p a JOIN n b ON a.p_brand = b.p_brand AND b.k <= 20 AND a.p_partkey <> b.p_partkey WHERE {_JAC} >= 0.3) WHERE r <= 3")
def er07(v: Views):
    """Of the 20 newest of a block, the three most alike."""
    p = parts(v)
    newest = p.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_partkey")))).filter("k <= 20")
    b = newest.select("p_brand", F.col("p_partkey").alias("b"), F.col("t").alias("tb"))
    hits = p.join(b, "p_brand").filter("p_partkey <> b").withColumn("likeness", T.jaccard(F.col("t"), F.col("tb"))).filter("likeness >= 0.3")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("likeness"), F.desc("b")))).filter("r <= 3")
    return ranked.select(F.col("p_partkey").alias("a"), "b")


@query("er14_spellings", "SELECT key, spelling, n FROM (SELECT key, spelling, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling) AS r FROM (SELECT regexp_replace(lower(s), '[^a-z]', '', 'g') AS key, s AS spelling, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS s FROM part) GROUP BY 1, 2)) WHERE r = 1")
def er14(v: Views):
    return E.unify_spellings(v.part.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("s")), "s")


# -- pairs of listings -------------------------------------------------------------------------------------------

_WORDS = "list_sort(list_distinct(list_filter(string_split(p_name, ' ') || ['s' || p_size % 4], lambda x: x <> '')))"
_SETS = f"p AS (SELECT *, {_WORDS} AS t FROM part), s AS (SELECT p_brand, t, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY ALL)"
_LIKE = "len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))"


def named(v: Views):
    """Parts with the words of their names and one of their size, so that sets are equal, alike or not."""
    words = T.tokens(F.concat_ws(" ", "p_name", F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string"))), [])
    return v.part.select("p_partkey", "p_brand", words.alias("t"))


@query("jn10_block_pairs", f"""WITH {_SETS} SELECT x.p_brand, x.first AS a, y.first AS b, {_LIKE} AS likeness, (x.n * y.n)::BIGINT AS pairs FROM s x JOIN s y ON x.p_brand = y.p_brand AND x.first < y.first WHERE {_LIKE} >= 0.5
UNION ALL SELECT p_brand, first, first, 1.0, (n * (n - 1) // 2)::BIGINT FROM s WHERE n > 1""")  # fmt: skip
def jn10(v: Views):
    return E.pairs_in_blocks(named(v), ["p_brand"], "p_partkey", "t", 0.5)


@query("sj01_jaccard", "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS likeness, len(a) = len(b) AS same FROM p")
def sj01(v: Views):
    a, b = T.tokens(F.col("p_name"), []), T.tokens(F.concat_ws(" ", "p_name", "p_type"), [])
    return v.part.select("p_partkey", T.jaccard(a, b).alias("likeness"), T.same_set(a, b).alias("same"))


@query("jn11_first_match", f"""WITH p AS (SELECT *, {_WORDS} AS t FROM part), k AS (SELECT p_brand, t, min(p_partkey) AS known FROM p WHERE p_partkey % 2 = 0 GROUP BY ALL),
i AS (SELECT DISTINCT p_brand, t FROM p WHERE p_partkey % 2 = 1),
m AS (SELECT x.p_brand, x.t, min(y.known) AS known FROM i x JOIN k y ON x.p_brand = y.p_brand WHERE {_LIKE} >= 0.8 GROUP BY ALL)
SELECT p.p_partkey AS incoming, coalesce(o.p_partkey, m.known) AS known FROM p LEFT JOIN part o ON p.p_partkey % 6 = 1 AND o.p_partkey = p.p_partkey - 1 AND o.p_brand = p.p_brand LEFT JOIN m ON m.p_brand = p.p_brand AND m.t = p.t WHERE p.p_partkey % 2 = 1 AND coalesce(o.p_partkey, m.known) IS NOT NULL""")  # fmt: skip
def jn11(v: Views):
    """The known listing of the same bank that has the incoming one's own id, else the first that is alike; by distinct token sets."""
    p = named(v).withColumn("words", F.array_sort("t"))
    known, incoming = p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1")
    sets = E.token_sets(p.withColumn("place", F.col("p_partkey") % 2 * (1 << 40) + F.col("p_partkey")), ["p_brand"], "place", "t")
    first_known = known.groupBy("p_brand", "words").agg(F.min("p_partkey").alias("known"))
    near = E.alike_sets(sets, ["p_brand"], 0.8)
    both = near.select("p_brand", "a", "b").unionByName(near.select("p_brand", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sets.select("p_brand", F.col("first").alias("a"), F.col("first").alias("b")))
    of = sets.select("p_brand", "first", "words")
    found = both.join(of.withColumnsRenamed({"first": "b", "words": "known_words"}), ["p_brand", "b"]).join(first_known.withColumnRenamed("words", "known_words"), ["p_brand", "known_words"])
    found = found.groupBy("p_brand", F.col("a").alias("first")).agg(F.min("known").alias("known")).join(of, ["p_brand", "first"]).select("p_brand", "words", "known")
    own = known.select("p_brand", F.col("p_partkey").alias("own"))
    out = incoming.withColumn("own", F.when(F.col("p_partkey") % 6 == 1, F.col("p_partkey") - 1)).join(own.withColumn("hit", F.col("own")), ["p_brand", "own"], "left")
    return out.join(found, ["p_brand", "words"], "left").select(F.col("p_partkey").alias("incoming"), F.coalesce("hit", "known").alias("known")).filter("known IS NOT NULL")


@query("ag22_duplicate_groups", f"""WITH p AS (SELECT *, {_WORDS} AS t FROM part) SELECT p_brand, p_size, n, oldest, round(likeness, 9) AS likeness FROM (SELECT x.p_brand, x.p_size, avg({_LIKE}) AS likeness FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey GROUP BY ALL) JOIN (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS oldest FROM p GROUP BY ALL) USING (p_brand, p_size)""")
def ag22(v: Views):
    rows = named(v).join(v.part.select("p_partkey", "p_size"), "p_partkey")
    return E.duplicate_groups(rows, ["p_brand", "p_size"], "p_partkey", "t").withColumn("likeness", F.round("likeness", 9))


@query("er05_greedy")
def er05(v: Views):
    rows = named(v).join(v.part.select("p_partkey", "p_size"), "p_partkey").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), F.col("t").alias("tokens"))
    return E.greedy_survivors(rows, ["p_brand"], least=0.6)


#: Addresses and titles of pairs of listings; each pair of orders' keys has one of each side.
SIDES = ["Plot 12 Sector 5 Vashi Navi Mumbai 400703", "plot no 12, sector 5, vashi, navi mumbai - 400703", "Plot 12 Sector 5 Vashi Navi Mumbai 400705", "Plot 13 Sector 5 Vashi Navi Mumbai", "Mumbai", "Shop 4 Main Bazaar Hadapsar Pune", "Survey 4 Green Hills Lonavala Khandala", "Green Hills Main Bazaar Lonavala Khandala Pune Road East", None]
TITLES = ["Flat 12 Green Park Tower B", "Green Park Tower B Flat 12 for sale", "House", "Row House Unit Seven", "Shop 13 Green Park Tower B"]


def _side(texts: list, by: str) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(texts))
    return f"CASE {by} % {len(texts)} {cases} END"


_A, _B = _side(SIDES, "o_orderkey"), _side(SIDES, "CAST(floor(o_orderkey / 9) AS BIGINT)")
_TA, _TB = _side(TITLES, "CAST(floor(o_orderkey / 81) AS BIGINT)"), _side(TITLES, "CAST(floor(o_orderkey / 405) AS BIGINT)")
_IDA, _IDB = "CASE o_orderkey % 4 WHEN 0 THEN 'src:h:1' WHEN 1 THEN '7' END", "CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 3 WHEN 0 THEN 'src:h:1' WHEN 1 THEN '7' ELSE 'src:h:2' END"
_PIN_SQL = r"nullif(regexp_extract({0}, '(?:^|[^0-9])([1-9][0-9]{{5}})(?:[^0-9]|$)', 1), '')"


def _sql_tokens(c: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({stop}, w)))"


_FACTS = f"""WITH o AS (SELECT o_orderkey, {_A} AS a, {_B} AS b, {_TA} AS ta, {_TB} AS tb, {_IDA} AS ia, {_IDB} AS ib FROM orders),
f AS (SELECT *, {_PIN_SQL.format('a')} AS pa, {_PIN_SQL.format('b')} AS pb, {_sql_tokens("regexp_replace(a, '[1-9][0-9]{5}', ' ')", E.ADDRESS_STOP)} AS wa, {_sql_tokens("regexp_replace(b, '[1-9][0-9]{5}', ' ')", E.ADDRESS_STOP)} AS wb, {_sql_tokens('ta', E.TITLE_STOP)} AS na, {_sql_tokens('tb', E.TITLE_STOP)} AS nb FROM o),
g AS (SELECT *, list_sort(list_filter(wa, lambda w: regexp_matches(w, '[0-9]'))) AS da, list_sort(list_filter(wb, lambda w: regexp_matches(w, '[0-9]'))) AS db, CASE WHEN len(wa) * len(wb) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) END AS j,
  list_sort(list_filter(na, lambda w: regexp_matches(w, '[0-9]'))) AS ea, list_sort(list_filter(nb, lambda w: regexp_matches(w, '[0-9]'))) AS eb, CASE WHEN len(na) * len(nb) = 0 THEN 0 ELSE len(list_intersect(na, nb)) / (len(na) + len(nb) - len(list_intersect(na, nb))) END AS k FROM f),
r AS (SELECT *, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL AND pa <> pb THEN 'conflict' WHEN NOT (len(wa) >= 4 AND (len(da) > 0 OR len(wa) >= 6) AND len(wb) >= 4 AND (len(db) > 0 OR len(wb) >= 6)) THEN 'unknown' WHEN len(da) > 0 AND len(db) > 0 AND da <> db THEN 'conflict' WHEN j >= 0.8 AND da = db THEN 'match' WHEN j < 0.3 THEN 'different' ELSE 'unknown' END AS relation FROM g)"""


def _facts(v: Views):
    rows = v.orders.selectExpr("o_orderkey", f"{_A} AS a", f"{_B} AS b", f"{_TA} AS ta", f"{_TB} AS tb", f"{_IDA} AS ia", f"{_IDB} AS ib")
    return rows.select("o_orderkey", "ia", "ib", E.facts(F.col("ta"), F.col("a")).alias("a"), E.facts(F.col("tb"), F.col("b")).alias("b"))


@query("er01_address_relation", f"{_FACTS} SELECT o_orderkey, relation FROM r")
def er01(v: Views):
    return _facts(v).select("o_orderkey", E.address_relation(F.col("a"), F.col("b")).alias("relation"))


@query("er02_decide_same", f"""{_FACTS}, d AS (SELECT o_orderkey, CASE WHEN ia = ib AND ia LIKE 'src:%' THEN 'same_source_id' WHEN relation = 'conflict' THEN NULL WHEN relation = 'match' THEN 'same_address'
  WHEN relation <> 'different' AND len(na) >= 4 AND len(nb) >= 4 AND len(ea) > 0 AND len(eb) > 0 AND ea = eb AND k >= 0.8 THEN 'distinctive_title' END AS rule FROM r) SELECT o_orderkey, rule IS NOT NULL AS match, rule FROM d""")  # fmt: skip
def er02(v: Views):
    return _facts(v).select("o_orderkey", E.decide_same(F.col("a"), F.col("ia"), F.col("b"), F.col("ib")).alias("d")).select("o_orderkey", "d.*")


@query("er03_exact_title", f"{_FACTS} SELECT o_orderkey, len(na) >= 3 AND len(nb) >= 3 AND relation NOT IN ('conflict', 'different') AS allowed FROM r")
def er03(v: Views):
    return _facts(v).select("o_orderkey", E.exact_title_merge_allowed(F.col("a"), F.col("b")).alias("allowed"))

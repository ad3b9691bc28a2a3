"""Registered queries of the reconciliation operators, over the given tables, and the SQL they are held against.

Inputs that the tables lack are derived by SQL that reads the same in Spark and DuckDB; the operators are the
library's, the oracles are written apart from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N
from ..operators import controls as C
from ..operators import graph as G
from ..operators import learning as L
from ..operators import matching as M
from ..operators import metrics as X
from ..operators.reports import ReportStore
from ..sources.runs import RunStore
from ..sources.fixtures import INVOICES, PAYMENTS, invoices, payments
from ..streaming import jobs as S
from .storage import cut, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAMES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Input rows by SQL over the given tables, passed as arguments."""
    used = [n for n in NAMES if re.search(rf"\b(FROM|JOIN) {n}\b", text)]
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(NAMES)})\b", r"\1 {\2}", text), **{n: tab(spark, sf_dir, n) for n in used})


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return invoices(spark, sf_dir), payments(spark, sf_dir)


def settlements(payments: DataFrame) -> DataFrame:
    """A settlement a day after each payment: the third record type."""
    return payments.withColumn("record_id", F.concat(F.lit("S"), F.substring("record_id", 2, 20))).withColumn("record_type", F.lit("settlement")).withColumn("record_date", F.date_add("record_date", 1))


CTE = f"WITH invoices AS ({INVOICES}), payments AS ({PAYMENTS})"

# --- scalar functions -------------------------------------------------------------------------------------------

RAW = """SELECT o_orderkey AS id, concat(' ', o_orderpriority, ' Total#', cast(o_orderkey % 7 AS varchar(9)), '! ') AS header,
 CASE o_orderkey % 6 WHEN 0 THEN concat('($1,', lpad(cast(o_orderkey % 1000 AS varchar(9)), 3, '0'), '.50)') WHEN 1 THEN concat('€', cast(o_orderkey AS varchar(20))) WHEN 2 THEN ''
  WHEN 3 THEN concat('x', cast(o_orderkey AS varchar(20))) WHEN 4 THEN concat(cast(o_orderkey AS varchar(20)), '.125') ELSE concat('-', cast(o_orderkey AS varchar(20))) END AS money,
 CASE o_orderkey % 5 WHEN 0 THEN concat('2026-', cast(1 + o_orderkey % 12 AS varchar(2)), '-', cast(1 + o_orderkey % 28 AS varchar(2))) WHEN 1 THEN concat(cast(1 + o_orderkey % 12 AS varchar(2)), '/', cast(1 + o_orderkey % 28 AS varchar(2)), '/2026')
  WHEN 2 THEN concat('2026/', cast(1 + o_orderkey % 12 AS varchar(2)), '/', cast(1 + o_orderkey % 28 AS varchar(2))) WHEN 3 THEN 'soon' ELSE concat(cast(13 + o_orderkey % 12 AS varchar(2)), '/', cast(1 + o_orderkey % 12 AS varchar(2)), '/2026') END AS day,
 CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE cast(o_orderkey AS varchar(20)) END AS total, CASE WHEN o_orderkey % 2 = 0 THEN 'v' END AS value,
 CASE o_orderkey % 8 WHEN 0 THEN '1.5M' WHEN 1 THEN '($ 1,234.56)' WHEN 2 THEN '1.234,56' WHEN 3 THEN '12,34' WHEN 4 THEN '1,000,000' WHEN 5 THEN 'n/a' WHEN 6 THEN concat(cast(o_orderkey AS varchar(20)), 'K') ELSE '1,5' END AS fin
FROM orders"""


@query(f"SELECT id, trim(regexp_replace(lower(trim(header)), '[^a-z0-9]+', '_', 'g'), '_') AS header FROM ({RAW})")
def norm_header(spark, d):
    return sql(spark, d, RAW).select("id", N.norm_header(F.col("header")).alias("header"))


@query(f"""SELECT id, TRY_CAST(nullif(CASE WHEN starts_with(m, '(') AND ends_with(m, ')') THEN '-' || trim(m, '()') ELSE m END, '') AS DECIMAL(20,4)) AS amount
FROM (SELECT id, trim(regexp_replace(trim(money), '[,$€£]', '', 'g')) AS m FROM ({RAW}))""")
def parse_amount(spark, d):
    return sql(spark, d, RAW).select("id", N.parse_amount(F.col("money")).alias("amount"))


@query(f"SELECT id, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%Y/%m/%d')) AS DATE) AS day FROM ({RAW})")
def parse_date(spark, d):
    return sql(spark, d, RAW).select("id", N.parse_date(F.col("day")).alias("day"))


@query(f"SELECT id, coalesce(nullif(total, ''), nullif(value, '')) AS picked FROM ({RAW})")
def alias_coalesce(spark, d):
    raw = sql(spark, d, RAW)
    return raw.select("id", N.alias_value(raw, ["amount", "total", "value"]).alias("picked"))


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(20,4)) AS amount FROM orders""")
def signed_amount(spark, d):
    rows = sql(spark, d, "SELECT o_orderkey AS id, o_orderkey % 3 AS s, CAST(o_totalprice AS DECIMAL(20,4)) AS m FROM orders")
    at = lambda k: F.when(F.col("s") == k, F.col("m"))
    return rows.select("id", N.signed_amount(at(0), at(1), at(2)).alias("amount"))


@query(f"""SELECT id, CAST(CASE id % 8 WHEN 0 THEN 1500000 WHEN 1 THEN -1234.56 WHEN 2 THEN 1234.56 WHEN 3 THEN 1234 WHEN 6 THEN id * 1000 WHEN 7 THEN 1.5 END AS DECIMAL(30,4)) AS amount FROM ({RAW})""")
def fin_value(spark, d):
    return sql(spark, d, RAW).select("id", N.fin_value(F.col("fin")).alias("amount"))


LINES = "SELECT event_id, user_id AS doc_id, event_id AS line_no, concat(' ', upper(event_type), ' ') AS line FROM events"


@query(f"""SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2 AS repeated FROM ({LINES})""")
def repeated_header(spark, d):
    return N.repeated_header(sql(spark, d, LINES)).select("doc_id", "line_no", "repeated")


@query("SELECT p_partkey AS id, regexp_matches(lower(concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Internet' WHEN 1 THEN ' SUM' ELSE '' END)), 'total|sum|net|balance') AS is_total FROM part")
def total_rows(spark, d):
    rows = sql(spark, d, "SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Internet' WHEN 1 THEN ' SUM' ELSE '' END) AS line FROM part")
    return rows.select("id", N.is_total(F.col("line")).alias("is_total"))


@query("""SELECT a.p_partkey AS id, round(CAST(1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS DOUBLE), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def text_similarity(spark, d):
    rows = sql(spark, d, "SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
    return rows.select("id", F.round(N.text_similarity(F.upper("x"), F.col("y")), 6).alias("similarity"))


@query(f"""{CTE}, r AS (SELECT * FROM invoices UNION ALL SELECT * FROM payments)
SELECT record_id, currency, CAST(CASE WHEN amount <= 0 THEN 0 ELSE greatest(1, floor(log10(CAST(amount AS DOUBLE))) * 100) END AS INTEGER) AS amount_bucket, record_date AS date_bucket, lower(trim(party)) AS party_key,
 substr(lower(trim(coalesce(reference, external_id))), 1, 3) AS reference_prefix FROM r""")
def blocking_keys(spark, d):
    i, p = both(spark, d)
    return G.blocking_keys(i.unionByName(p))


@query(f"{CTE} SELECT record_id, coalesce(reference, external_id) AS reference, party FROM payments")
def observable(spark, d):
    return G.entity_nodes(payments(spark, d)).select(F.col("node_id").alias("record_id"), "reference", "party")


JLINES = """SELECT l_orderkey AS journal_id, concat('A', cast(l_linenumber AS varchar(9))) AS account_code, CAST(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE 0 END AS DECIMAL(20,4)) AS debit,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0 END AS DECIMAL(20,4)) AS credit, CASE WHEN l_suppkey % 50 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM lineitem"""


@query(f"SELECT journal_id, CAST(sum(debit) AS DECIMAL(30,4)) AS debit, CAST(sum(credit) AS DECIMAL(30,4)) AS credit, CAST(sum(debit) - sum(credit) AS DECIMAL(30,4)) AS variance, sum(debit) = sum(credit) AS balanced FROM ({JLINES}) GROUP BY 1")
def conservation(spark, d):
    return X.conservation(sql(spark, d, JLINES), "journal_id")


PRESENT = "SELECT user_id AS doc_id, event_type FROM events WHERE user_id % 3 <> 0 OR event_type <> 'error'"


@query(f"""WITH p AS (SELECT doc_id, list_distinct(list(event_type)) AS present FROM ({PRESENT}) GROUP BY 1)
SELECT doc_id, array_to_string(list_sort(list_filter(present, lambda x: NOT list_contains(['click', 'error', 'refund'], x))), ',') AS undeclared,
 array_to_string(list_sort(list_filter(['click', 'error', 'refund'], lambda x: NOT list_contains(present, x))), ',') AS unresolved FROM p""")
def extraction_check(spark, d):
    rows = sql(spark, d, PRESENT).groupBy("doc_id").agg(F.collect_set("event_type").alias("present"))
    return C.extraction_check(rows.withColumn("declared", F.array(*map(F.lit, ("click", "error", "refund")))))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS row_index FROM lineitem)
SELECT l_orderkey AS doc_id, (1 + l_orderkey % 3) * 1000 + row_index + 1 AS row_number, 2 AS n_fields, 0.9 AS parser_confidence FROM r WHERE row_index > 1""")
def cells_to_rows(spark, d):
    """All lines of an order are the rows of its table; lines of one number are rows of their own."""
    lines = tab(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]))
    cells = lines.withColumn("row_index", place).select(F.col("l_orderkey").alias("doc_id"), (1 + F.col("l_orderkey") % 3).alias("page"), F.lit(0).alias("table_index"), "row_index", F.posexplode(F.array(F.concat(F.lit("Q "), "l_quantity"), F.concat(F.lit("S "), "l_linenumber", F.lit(" "), "row_index"))).alias("column_index", "text"), F.lit(0.9).alias("confidence"))
    return N.cells_to_rows(cells).select("doc_id", "row_number", F.size("fields").alias("n_fields"), F.col("parser_confidence").cast("double").alias("parser_confidence"))


@query("""SELECT doc_id, CASE WHEN w = 0 OR n_chars = 0 THEN 0.0 WHEN w >= 3 AND n_chars >= 20 THEN 0.85 ELSE round((least(w / 20.0, 1.0) + least(n_chars / 200.0, 1.0)) / 2, 2) END AS confidence
FROM (SELECT doc_id, n_chars, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents)""")
def page_confidence(spark, d):
    words = F.size(F.array_remove(F.split("text", " "), ""))
    return tab(spark, d, "documents").select("doc_id", N.page_confidence(words, F.col("n_chars")).cast("double").alias("confidence"))


FEED = """SELECT cast(event_id AS varchar(20)) AS transaction_id, concat('acc-', cast(user_id AS varchar(20))) AS account_id, substr(cast(ts AS varchar(30)), 1, 10) AS date, CASE WHEN event_id % 2 = 0 THEN substr(cast(ts AS varchar(30)), 1, 10) END AS authorized_date, cast(CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS DECIMAL(20,4)) AS amount, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'eur' END AS iso_currency_code,
 CASE WHEN event_id % 5 = 0 THEN concat('p', cast(event_id AS varchar(20))) END AS pending_transaction_id, CASE WHEN event_id % 4 = 0 THEN 'shop' END AS merchant_name, event_type AS name FROM events WHERE value IS NOT NULL"""


@query(f"""SELECT transaction_id AS external_id, amount, upper(coalesce(iso_currency_code, 'USD')) AS currency, CASE WHEN amount >= 0 THEN 'debit' ELSE 'credit' END AS transaction_type,
 coalesce(pending_transaction_id, transaction_id) AS bank_reference, coalesce(merchant_name, name, '') AS description, account_id, CAST(date AS DATE) AS record_date, CAST(authorized_date AS DATE) AS value_date FROM ({FEED})""")
def norm_bank_feed(spark, d):
    return N.norm_bank_feed(sql(spark, d, FEED))


BALANCE = """SELECT cast(o_orderkey AS varchar(20)) AS id, cast(o_orderkey * 7 AS bigint) AS net, cast(-(o_orderkey % 100) AS bigint) AS fee, CASE WHEN o_orderkey % 4 = 0 THEN 'jpy' ELSE 'usd' END AS currency,
 cast(1700000000 + o_orderkey * 1000 AS bigint) AS created, CASE WHEN o_orderkey % 2 = 0 THEN cast(1700086400 + o_orderkey * 1000 AS bigint) END AS available_on FROM orders"""


@query(f"""SELECT id AS settlement_reference, CAST(net / (CASE WHEN currency = 'jpy' THEN 1 ELSE 100 END) AS DECIMAL(20,4)) AS amount, CAST(abs(fee) / (CASE WHEN currency = 'jpy' THEN 1 ELSE 100 END) AS DECIMAL(20,4)) AS fee_amount,
 upper(currency) AS currency, CAST(make_timestamp(coalesce(available_on, created) * 1000000) AS DATE) AS settled_date FROM ({BALANCE})""")
def norm_processor(spark, d):
    return N.norm_processor(sql(spark, d, BALANCE))


CHARGES = """SELECT cast(o_orderkey AS varchar(20)) AS id, cast(o_orderkey * 7 AS bigint) AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'jpy' WHEN 1 THEN NULL ELSE 'usd' END AS currency, cast(1700000000 + o_orderkey * 1000 AS bigint) AS created,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('c', cast(o_custkey AS varchar(20))) END AS customer, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS description FROM orders"""


@query(f"""SELECT id AS external_id, id AS payment_reference, CAST(amount / (CASE WHEN currency = 'jpy' THEN 1 ELSE 100 END) AS DECIMAL(20,4)) AS amount, upper(coalesce(currency, 'usd')) AS currency, CAST(make_timestamp(created * 1000000) AS DATE) AS record_date,
 coalesce(nullif(description, ''), 'payment') AS description, customer AS payer_id, CASE WHEN id % 2 = 0 THEN 'card' ELSE 'processor' END AS payment_method FROM (SELECT * REPLACE (CAST(id AS BIGINT) AS id) FROM ({CHARGES})) """.replace("SELECT id AS external_id, id AS payment_reference", "SELECT CAST(id AS VARCHAR) AS external_id, CAST(id AS VARCHAR) AS payment_reference"))
def norm_payment(spark, d):
    rows = sql(spark, d, CHARGES).withColumn("payment_method_types", F.when(F.col("id").cast("long") % 2 == 0, F.array(F.lit("card"), F.lit("transfer"))))
    return N.norm_payment(rows)


@query("SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedupe(spark, d):
    return C.content_dedupe(tab(spark, d, "documents"))


@query("""SELECT 'invoice' AS record_type, 'X-' || o_orderkey AS external_id, CAST(o_totalprice AS DECIMAL(20,4)) AS amount, 'USD' AS currency, CAST(o_orderdate AS DATE) AS record_date,
 'INV-' || o_orderkey AS reference, 'cust-' || o_custkey AS party, CAST(0 AS DECIMAL(20,4)) AS fee_amount, CAST(NULL AS VARCHAR) AS error FROM orders""")
def norm_records(spark, d):
    raw = sql(spark, d, """SELECT concat('X-', cast(o_orderkey AS varchar(20))) AS `External ID`, concat('$', cast(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30))) AS `Total`, cast(CAST(o_orderdate AS DATE) AS varchar(10)) AS `Invoice Date`,
      concat('INV-', cast(o_orderkey AS varchar(20))) AS `Invoice Number`, concat('cust-', cast(o_custkey AS varchar(20))) AS `Vendor ID` FROM orders""")
    return N.normalize_records(raw, "invoice", "orders").drop("provenance", "description")


# --- joins ------------------------------------------------------------------------------------------------------

PAIR = "SELECT DISTINCT s.record_id AS source_id, t.record_id AS target_id"
REF = "nullif(lower(trim(s.reference)), '') = nullif(lower(trim(t.reference)), '')"
FEE = "abs(CASE WHEN s.fee_amount <> 0 THEN s.fee_amount ELSE t.fee_amount END)"


@query(f"{CTE} {PAIR} FROM invoices s JOIN payments t ON s.currency = t.currency AND {REF}")
def match_reference(spark, d):
    return M.match_reference(*both(spark, d))


@query(f"{CTE} {PAIR} FROM invoices s JOIN payments t ON s.currency = t.currency AND s.external_id = t.external_id AND s.external_id <> ''")
def match_external_id(spark, d):
    return M.match_external_id(*both(spark, d))


@query(f"{CTE} {PAIR} FROM invoices s JOIN payments t ON s.currency = t.currency AND s.amount = t.amount AND s.record_date = t.record_date")
def match_amount_date(spark, d):
    return M.match_amount(*both(spark, d), 0, 0).drop("days")


@query(f"{CTE} {PAIR}, CAST(abs(s.record_date - t.record_date) AS INTEGER) AS days FROM invoices s JOIN payments t ON s.currency = t.currency AND s.amount = t.amount AND abs(s.record_date - t.record_date) BETWEEN 1 AND 3")
def match_timing(spark, d):
    return M.match_amount(*both(spark, d), 1, 3)


@query(f"{CTE} {PAIR} FROM invoices s JOIN payments t ON s.currency = t.currency AND {FEE} <> 0 AND (s.amount = t.amount + {FEE} OR s.amount = t.amount - {FEE})")
def match_fee(spark, d):
    return M.match_fee(*both(spark, d))


@query(f"{CTE} {PAIR} FROM invoices s JOIN payments t ON s.currency <> t.currency AND {REF} UNION {PAIR} FROM invoices s JOIN payments t ON s.currency <> t.currency AND s.external_id = t.external_id AND s.external_id <> ''")
def currency_mismatch(spark, d):
    return M.currency_mismatch(*both(spark, d))


CASCADE = f"""CASE WHEN s.currency <> t.currency THEN 'currency_mismatch' WHEN {REF} THEN 'reference' WHEN s.external_id = t.external_id AND s.external_id <> '' THEN 'external_id'
 WHEN s.amount = t.amount AND s.record_date = t.record_date THEN 'amount_date' WHEN s.amount = t.amount AND abs(s.record_date - t.record_date) <= 3 THEN 'timing'
 WHEN {FEE} <> 0 AND abs(s.amount - t.amount) = {FEE} THEN 'fee' END"""
RULED = f"""{CTE}, c AS (SELECT s.record_id AS a, t.record_id AS b FROM invoices s JOIN payments t ON s.party = t.party),
c2 AS (SELECT s.record_id AS source_id, t.record_id AS target_id, {CASCADE} AS rule FROM c JOIN invoices s ON s.record_id = c.a JOIN payments t ON t.record_id = c.b),
rules AS (SELECT *, CASE rule WHEN 'currency_mismatch' THEN 'EXCEPTION' WHEN 'fee' THEN 'EXCEPTION' WHEN NULL THEN NULL ELSE 'MATCHED' END AS status,
 CAST(CASE rule WHEN 'reference' THEN 1.00 WHEN 'external_id' THEN 1.00 WHEN 'amount_date' THEN 0.95 WHEN 'timing' THEN 0.90 WHEN 'fee' THEN 0.90 ELSE 0 END AS DECIMAL(4,2)) AS confidence FROM c2)"""


@query(f"{RULED} SELECT source_id, target_id, coalesce(rule, 'none') AS rule, CASE WHEN rule IS NULL THEN 'UNMATCHED' ELSE status END AS status, confidence FROM rules")
def match_pair(spark, d):
    i, p = both(spark, d)
    pairs = i.select(*[F.col(c).alias(f"s_{c}") for c in i.columns]).join(p.select(*[F.col(c).alias(f"t_{c}") for c in p.columns]), F.col("s_party") == F.col("t_party"))
    return M.match_pair(pairs)


# Pairs that a rule joins, whatever the party; a currency mismatch needs a shared key.
JOINED = f"""{CTE}, keys AS (
 SELECT s.record_id AS a, t.record_id AS b FROM invoices s JOIN payments t ON {REF} UNION SELECT s.record_id, t.record_id FROM invoices s JOIN payments t ON s.external_id = t.external_id AND s.external_id <> ''
 UNION SELECT s.record_id, t.record_id FROM invoices s JOIN payments t ON s.currency = t.currency AND s.amount = t.amount AND abs(s.record_date - t.record_date) <= 3
 UNION SELECT s.record_id, t.record_id FROM invoices s JOIN payments t ON s.currency = t.currency AND {FEE} <> 0 AND (s.amount = t.amount + {FEE} OR s.amount = t.amount - {FEE})),
rules AS (SELECT s.record_id AS source_id, t.record_id AS target_id, {CASCADE} AS rule FROM keys JOIN invoices s ON s.record_id = keys.a JOIN payments t ON t.record_id = keys.b),
scored AS (SELECT *, CASE WHEN rule IN ('currency_mismatch', 'fee') THEN 'EXCEPTION' ELSE 'MATCHED' END AS status,
 CAST(CASE rule WHEN 'reference' THEN 1.00 WHEN 'external_id' THEN 1.00 WHEN 'amount_date' THEN 0.95 WHEN 'timing' THEN 0.90 WHEN 'fee' THEN 0.90 ELSE 0 END AS DECIMAL(4,2)) AS confidence FROM rules),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id DESC) = 1),
assigned AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY source_id) = 1)"""


@query(f"{JOINED} SELECT source_id, target_id, rule, status, confidence FROM assigned")
def assign_one_to_one(spark, d):
    return M.assign_one_to_one(M.rule_pairs(*both(spark, d))).drop("reasons")


@query(f"""{JOINED} SELECT record_id, 'source' AS side FROM invoices WHERE record_id NOT IN (SELECT source_id FROM assigned)
UNION ALL SELECT record_id, 'target' FROM payments WHERE record_id NOT IN (SELECT target_id FROM assigned)""")
def unmatched(spark, d):
    i, p = both(spark, d)
    pairs = M.assign_one_to_one(M.rule_pairs(i, p))
    left = M.unmatched(i, pairs.select("source_id")).select(F.col("source_ids")[0].alias("record_id"), F.lit("source").alias("side"))
    return left.union(M.unmatched(p, pairs.select("target_id"), False).select(F.col("target_ids")[0], F.lit("target")))


def _alloc_ctes(name: str, anchors: str, parts: str, block: str, largest: int) -> str:
    """Anchors by id within a block take their first free group, by a recursion over them; a block waits for no other."""
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in block.split(", "))
    of = lambda x: ", ".join(f"{x}.{c}" for c in block.split(", "))
    a, p, two, g, r = (f"{name}_{x}" for x in ("a", "p", "two", "g", "r"))
    groups = [f"SELECT a.record_id AS anchor_id, {of('a')}, [t.i, t.j] AS m FROM {a} a JOIN {two} t ON {on('a', 't')} AND a.amount = t.total"]
    if largest > 2:
        groups.append(f"SELECT a.record_id, {of('a')}, [t.i, t.j, z.record_id] FROM {a} a JOIN {p} z ON {on('a', 'z')} JOIN {two} t ON {on('a', 't')} AND t.total = a.amount - z.amount WHERE z.record_id > t.j")
    if largest > 3:
        groups.append(f"SELECT a.record_id, {of('a')}, [x.i, x.j, y.i, y.j] FROM {a} a JOIN {two} x ON {on('a', 'x')} JOIN {two} y ON {on('a', 'y')} AND y.total = a.amount - x.total WHERE y.i > x.j")
    return f"""{a} AS MATERIALIZED (SELECT * FROM {anchors}), {p} AS MATERIALIZED (SELECT * FROM {parts}),
{two} AS MATERIALIZED (SELECT {of('x')}, x.record_id AS i, y.record_id AS j, x.amount + y.amount AS total FROM {p} x JOIN {p} y ON {on('x', 'y')} AND x.record_id < y.record_id),
{g} AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY {block} ORDER BY anchor_id) AS n, row_number() OVER (PARTITION BY anchor_id ORDER BY len(m), m) AS place FROM ({" UNION ALL ".join(groups)})),
{r} AS (SELECT DISTINCT {block}, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS anchor_id, CAST([] AS VARCHAR[]) AS m, CAST([] AS VARCHAR[]) AS used FROM {g}
 UNION ALL SELECT {block}, n, anchor_id, coalesce(pick, []), list_concat(used, coalesce(pick, [])) FROM (SELECT {of('r')}, g.n, g.anchor_id, any_value(r.used) AS used, arg_min(g.m, g.place) FILTER (WHERE NOT list_has_any(g.m, r.used)) AS pick
  FROM {r} r JOIN {g} g ON {on('g', 'r')} AND g.n = r.n + 1 GROUP BY ALL) s),
{name} AS MATERIALIZED (SELECT anchor_id, m FROM {r} WHERE len(m) > 0)"""


def _alloc_sql(anchors: str, parts: str, block: str, largest: int, before: str = CTE) -> str:
    return f"""{before.replace('WITH', 'WITH RECURSIVE', 1)}, {_alloc_ctes('got', anchors, parts, block, largest)}
SELECT anchor_id, array_to_string(m, ',') AS members, CAST(0.88 AS DECIMAL(4,2)) AS confidence FROM got"""


def _reconcile_sql(sources: str | None = None, targets: str | None = None, stage: str = "") -> str:
    """All result rows: pairs, groups of targets, groups of sources, and what is left. The tables are named `invoices` and `payments`."""
    before = JOINED if sources is None else JOINED.replace(CTE, f"{CTE.replace('invoices AS', 'i0 AS').replace('payments AS', 'p0 AS')}, invoices AS MATERIALIZED ({sources}), payments AS MATERIALIZED ({targets})")
    tag = f", '{stage}' AS stage" if stage else ""
    none = "UNMATCHED', CAST(0 AS DECIMAL(4,2)), 'NO_MATCH'"
    return f"""{before.replace('WITH', 'WITH RECURSIVE', 1)}, s1 AS MATERIALIZED (SELECT * FROM invoices WHERE record_id NOT IN (SELECT source_id FROM assigned)), t1 AS MATERIALIZED (SELECT * FROM payments WHERE record_id NOT IN (SELECT target_id FROM assigned)),
{_alloc_ctes('split', 's1', 't1', 'currency, party', 4)},
s2 AS MATERIALIZED (SELECT * FROM s1 WHERE record_id NOT IN (SELECT anchor_id FROM split)), t2 AS MATERIALIZED (SELECT * FROM t1 WHERE record_id NOT IN (SELECT unnest(m) FROM split)),
{_alloc_ctes('merged', 't2', 's2', 'currency, party', 4)}
SELECT *{tag} FROM (SELECT source_id AS source_ids, target_id AS target_ids, status, confidence, CASE rule WHEN 'currency_mismatch' THEN 'CURRENCY_MISMATCH' WHEN 'reference' THEN 'EXACT_REFERENCE,CURRENCY_MATCH' WHEN 'external_id' THEN 'EXACT_ID,CURRENCY_MATCH' WHEN 'amount_date' THEN 'EXACT_AMOUNT,CURRENCY_MATCH'
  WHEN 'timing' THEN 'EXACT_AMOUNT,AMOUNT_DATE_WINDOW,KNOWN_TIMING,CURRENCY_MATCH' ELSE 'KNOWN_FEE,CURRENCY_MATCH' END AS reasons FROM assigned
 UNION ALL SELECT anchor_id, array_to_string(m, ','), 'MATCHED', CAST(0.88 AS DECIMAL(4,2)), 'EXACT_AMOUNT' FROM split UNION ALL SELECT array_to_string(m, ','), anchor_id, 'MATCHED', CAST(0.88 AS DECIMAL(4,2)), 'EXACT_AMOUNT' FROM merged
 UNION ALL SELECT record_id, '', '{none} FROM s2 WHERE record_id NOT IN (SELECT unnest(m) FROM merged) UNION ALL SELECT '', record_id, '{none} FROM t2 WHERE record_id NOT IN (SELECT anchor_id FROM merged))"""


@query(_alloc_sql("invoices", "payments", "currency, party", 4))
def alloc_one_to_many(spark, d):
    """Within a party, so that chance groups stay few."""
    i, p = both(spark, d)
    return M.allocate(i, p, ("currency", "party")).select("anchor_id", F.array_join("members", ",").alias("members"), "confidence")


#: One payment for two invoices of a party each: every odd one and the one after it.
JOINT = """SELECT concat('J', record_id) AS record_id, currency, party, CAST(amount + after AS DECIMAL(20,4)) AS amount FROM (SELECT record_id, currency, party, amount,
 lead(amount) OVER (PARTITION BY currency, party ORDER BY record_id) AS after, row_number() OVER (PARTITION BY currency, party ORDER BY record_id) AS n FROM invoices) x WHERE after IS NOT NULL AND n % 2 = 1"""


@query(_alloc_sql(f"({JOINT})", "invoices", "currency, party", 4))
def alloc_many_to_one(spark, d):
    i, _ = both(spark, d)
    joint = spark.sql(JOINT.replace("FROM invoices", "FROM {invoices}"), invoices=i)
    return M.allocate(joint, i, ("currency", "party")).select("anchor_id", F.array_join("members", ",").alias("members"), "confidence")


@query(_alloc_sql("invoices WHERE record_id NOT IN (SELECT source_id FROM assigned)", "payments WHERE record_id NOT IN (SELECT target_id FROM assigned)", "currency", 2, JOINED))
def alloc_by_currency(spark, d):
    """What one-to-one leaves, across parties: groups of two of one currency."""
    i, p = both(spark, d)
    pairs = cut(M.assign_one_to_one(M.rule_pairs(i, p)), "assigned")
    left = lambda df, c: df.join(pairs.select(F.col(c).alias("record_id")), "record_id", "left_anti")
    got = M.allocate(left(i, "source_id"), left(p, "target_id"), largest=2)
    return got.select("anchor_id", F.array_join("members", ",").alias("members"), "confidence")


def _told(results: DataFrame) -> DataFrame:
    """Result rows with their lists as text."""
    return results.withColumns({c: F.array_join(c, ",") for c in ("source_ids", "target_ids", "reasons")})


@query(_reconcile_sql())
def reconcile(spark, d):
    """Groups within a party: across parties the groups that chance alone gives grow with the cube of what is left."""
    return _told(M.reconcile(*both(spark, d), block=("currency", "party")))


def _later(rows: str, prefix: str, kind: str, days: int, own: bool = False) -> str:
    """The rows as another type some days later; with `own` their external id is the id that they were made of."""
    return f"SELECT concat('{prefix}', record_id) AS record_id, '{kind}' AS record_type, {'record_id' if own else 'external_id'} AS external_id, amount, currency, CAST(record_date + {days} AS DATE) AS record_date, reference, party, fee_amount FROM {rows}"


def _later_rows(rows: DataFrame, prefix: str, kind: str, days: int, own: bool = False) -> DataFrame:
    rows = rows.withColumn("external_id", F.col("record_id")) if own else rows
    return rows.withColumns({"record_id": F.concat(F.lit(prefix), "record_id"), "record_type": F.lit(kind), "record_date": F.date_add("record_date", days)})


_STAGE = lambda s, t, name: f"({_reconcile_sql(s, t, name)})"


@query(_reconcile_sql(_later("p0", "B", "bank_transaction", 1, True), _later("p0", "L", "ledger_entry", 3, True), "bank_to_ledger"))
def reconcile_bank(spark, d):
    """Bank transactions a day after the payments, ledger entries two days later."""
    p = payments(spark, d)
    return _told(M.reconcile_template("bank", _later_rows(p, "B", "bank_transaction", 1, True), _later_rows(p, "L", "ledger_entry", 3, True), block=("currency", "party")))


@query(f"""SELECT * FROM {_STAGE("SELECT * FROM i0", _later("p0", "C", "payment", 0, True), "invoice_to_receipt")} UNION ALL SELECT * FROM {_STAGE(_later("p0", "C", "payment", 0, True), _later("p0", "R", "ledger_entry", 1, True), "receipt_to_ar")}""")
def reconcile_customer(spark, d):
    """Invoices, receipts and the entries of a day later."""
    i, p = both(spark, d)
    return _told(M.reconcile_template("customer", i, _later_rows(p, "C", "payment", 0, True), _later_rows(p, "R", "ledger_entry", 1, True), block=("currency", "party")))


@query(f"""SELECT * FROM {_STAGE(_later("i0", "O", "purchase_order", -2), "SELECT * FROM i0", "purchase_order_to_invoice")} UNION ALL SELECT * FROM {_STAGE("SELECT * FROM i0", _later("i0", "A", "ledger_entry", 5), "invoice_to_ap")}
UNION ALL SELECT * FROM {_STAGE(_later("i0", "A", "ledger_entry", 5), "SELECT * FROM p0", "ap_to_payment")}""")
def reconcile_vendor(spark, d):
    """Orders two days before the invoices, payables five days after them, payments."""
    i, p = both(spark, d)
    return _told(M.reconcile_template("vendor", _later_rows(i, "O", "purchase_order", -2), i, _later_rows(i, "A", "ledger_entry", 5), p, block=("currency", "party")))


@query(f"{JOINED} SELECT 'RECONCILIATION_DECISION' AS event_type, 'reconciliation' AS entity_type, source_id AS entity_id, status FROM assigned")
def decision_audit(spark, d):
    pairs = M.assign_one_to_one(M.rule_pairs(*both(spark, d)))
    return M.decision_audit(pairs.select(F.array("source_id").alias("source_ids"), F.array("target_id").alias("target_ids"), "status", "reasons")).drop("reason")


@query(f"{JOINED} SELECT source_id, target_id, status FROM assigned WHERE status = 'EXCEPTION'")
def exception_queue(spark, d):
    return M.exception_queue(M.assign_one_to_one(M.rule_pairs(*both(spark, d)))).select("source_id", "target_id", "status")


@query(f"{JOINED} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'MATCHED') AS matched, count(*) FILTER (WHERE status <> 'MATCHED') AS exception_count, CAST(floor(100 * count(*) FILTER (WHERE status = 'MATCHED') / count(*)) AS BIGINT) AS reconciliation_rate FROM assigned")
def dashboard(spark, d):
    return C.dashboard(M.assign_one_to_one(M.rule_pairs(*both(spark, d))))


@query(f"{JOINED} SELECT status, rule, count(*) AS n, CAST(sum(s.amount) AS DECIMAL(30,4)) AS amount FROM assigned JOIN invoices s ON s.record_id = source_id GROUP BY 1, 2")
def ops_report(spark, d):
    i, p = both(spark, d)
    pairs = M.assign_one_to_one(M.rule_pairs(i, p))
    return pairs.join(i.select(F.col("record_id").alias("source_id"), "amount"), "source_id").groupBy("status", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(30,4)").alias("amount"))


# --- graph ------------------------------------------------------------------------------------------------------

_NODES = "SELECT *, CASE record_type WHEN 'invoice' THEN 0 WHEN 'payment' THEN 1 ELSE 3 END AS stage, CASE WHEN amount <= 0 THEN 0 ELSE greatest(1, floor(log10(CAST(amount AS DOUBLE))) * 100) END AS bucket, coalesce(reference, external_id) AS r, CAST(floor((record_date - DATE '1970-01-01') / 4) AS BIGINT) AS cell"
_SCORE = "CAST(CASE WHEN a.amount = b.amount AND a.record_date = b.record_date THEN 0.95 WHEN a.amount = b.amount THEN 0.90 WHEN abs(a.amount - b.amount) <= 10 THEN 0.80 ELSE 0.50 END AS DECIMAL(4,2))"


def _edges_sql(records: str, across: bool = False) -> str:
    """Pairs by a join on currency and date cells of four days."""
    return f"""{CTE}, n AS MATERIALIZED ({_NODES} FROM ({records})), nb AS MATERIALIZED (SELECT *, unnest([cell - 1, cell, cell + 1]) AS near FROM n),
edges AS MATERIALIZED (SELECT a.record_id AS source_id, b.record_id AS target_id, a.record_type AS source_type, b.record_type AS target_type, a.currency, {_SCORE} AS score, a.amount AS s_amount, b.amount AS t_amount
 FROM n a JOIN nb b ON a.currency = b.currency AND a.cell = b.near AND abs(a.record_date - b.record_date) <= 3 AND abs(a.bucket - b.bucket) <= 200 AND (a.stage < b.stage OR a.stage = b.stage AND a.record_id < b.record_id){" AND a.record_type <> b.record_type" if across else ""})"""


TWO = "SELECT * FROM invoices UNION ALL SELECT * FROM payments"
EDGES, ACROSS = _edges_sql(TWO), _edges_sql(TWO, True)


def _records(spark, d):
    i, p = both(spark, d)
    return i.unionByName(p)


@query(f"{EDGES} SELECT source_id, target_id, source_type, target_type, currency, score FROM edges")
def candidate_edges(spark, d):
    return G.candidate_edges(_records(spark, d))


@query(f"{ACROSS} SELECT source_id, target_id, source_type, target_type, currency, score, source_id || ':' || target_id AS candidate_id FROM edges")
def candidate_batch(spark, d):
    return G.candidate_batch(*both(spark, d))


@query(f"{CTE} SELECT record_id AS node_id, record_type AS node_type, stage, amount, currency, record_date AS node_date, r AS reference, party, CAST(coalesce(fee_amount, 0) AS DECIMAL(20,4)) AS fee FROM ({_NODES} FROM ({TWO}))")
def entity_nodes(spark, d):
    return G.entity_nodes(_records(spark, d))


@query(f"{ACROSS} SELECT source_id || ':' || target_id AS candidate_id, count(*) OVER (PARTITION BY source_id) + count(*) OVER (PARTITION BY target_id) - 2 AS rivals FROM edges")
def rival_counts(spark, d):
    return C.candidates_with_rivalry(*both(spark, d)).select("candidate_id", "rivals")


#: The best rival on either record by the largest and the next largest score of each record.
_MASK = """c AS MATERIALIZED (SELECT *, source_id || ':' || target_id AS candidate_id FROM edges),
k AS MATERIALIZED (SELECT *, max(score) OVER s AS sm, max(score) OVER t AS tm, count(*) OVER (PARTITION BY source_id, score) AS sn, count(*) OVER (PARTITION BY target_id, score) AS tn, count(*) OVER s + count(*) OVER t - 2 AS rivals FROM c WINDOW s AS (PARTITION BY source_id), t AS (PARTITION BY target_id)),
s2 AS MATERIALIZED (SELECT source_id, max(score) AS s2 FROM k WHERE score < sm GROUP BY 1), t2 AS MATERIALIZED (SELECT target_id, max(score) AS t2 FROM k WHERE score < tm GROUP BY 1),
m AS (SELECT k.*, CASE WHEN score < sm OR sn > 1 THEN sm ELSE s2 END AS rs, CASE WHEN score < tm OR tn > 1 THEN tm ELSE t2 END AS rt FROM k LEFT JOIN s2 USING (source_id) LEFT JOIN t2 USING (target_id)),
r AS MATERIALIZED (SELECT *, score >= 0.50 AND (rs IS NULL OR score - rs >= 0.05) AND (rt IS NULL OR score - rt >= 0.05) AS review FROM m)"""


@query(f"{ACROSS}, {_MASK} SELECT candidate_id, source_id, target_id, score, review FROM r")
def review_mask(spark, d):
    return C.batch_review_mask(*both(spark, d))


#: The metadata of a ranker that passed its gate.
RANKER = {"review_threshold": "0.50", "review_gate_passed": True, "review_policy": "separated", "relationships": ["invoice->payment"]}


@query(f"""{ACROSS}, c0 AS MATERIALIZED (SELECT e.*, s.party = t.party AS one_party FROM edges e JOIN invoices s ON s.record_id = source_id JOIN payments t ON t.record_id = target_id), {_MASK.replace("FROM edges)", "FROM c0 WHERE one_party)")},
w AS MATERIALIZED (SELECT source_id, target_id, s_amount, t_amount FROM edges),
f AS MATERIALIZED (SELECT x.source_id, unnest([x.target_id, y.target_id]) AS target_id FROM w x JOIN w y ON y.source_id = x.source_id AND y.target_id > x.target_id AND x.t_amount + y.t_amount = x.s_amount
 UNION SELECT x.source_id, unnest([x.target_id, y.target_id, z.target_id]) FROM w x JOIN w y ON y.source_id = x.source_id AND y.target_id > x.target_id JOIN w z ON z.source_id = x.source_id AND z.target_id > y.target_id AND x.t_amount + y.t_amount + z.t_amount = x.s_amount
 UNION SELECT unnest([x.source_id, y.source_id]), x.target_id FROM w x JOIN w y ON y.target_id = x.target_id AND y.source_id > x.source_id AND x.s_amount + y.s_amount = x.t_amount
 UNION SELECT unnest([x.source_id, y.source_id, z.source_id]), x.target_id FROM w x JOIN w y ON y.target_id = x.target_id AND y.source_id > x.source_id JOIN w z ON z.target_id = x.target_id AND z.source_id > y.source_id AND x.s_amount + y.s_amount + z.s_amount = x.t_amount),
o AS (SELECT c0.*, count(*) OVER (PARTITION BY source_id) + count(*) OVER (PARTITION BY target_id) - 2 AS rivals FROM c0)
SELECT o.source_id || ':' || o.target_id AS candidate_id, o.rivals, CASE WHEN f.source_id IS NOT NULL THEN 'UNSUPPORTED_ALLOCATION' WHEN o.s_amount <> o.t_amount THEN 'UNSUPPORTED_PARTIAL_PAYMENT' WHEN o.rivals = 0 THEN 'INSUFFICIENT_CANDIDATE_SET'
 WHEN NOT o.one_party THEN 'PARTY_CONFLICT' WHEN r.review THEN 'PENDING_REVIEW' ELSE 'AMBIGUOUS_RECORD_MATCH' END AS outcome FROM o LEFT JOIN f ON f.source_id = o.source_id AND f.target_id = o.target_id LEFT JOIN r ON r.source_id = o.source_id AND r.target_id = o.target_id
UNION ALL SELECT record_type || ':' || record_id, 0, 'NO_CANDIDATES' FROM n WHERE record_id NOT IN (SELECT source_id FROM edges UNION ALL SELECT target_id FROM edges)""")
def review_suggestions(spark, d):
    """Every reason; the ranker's scores are those of the edges."""
    i, p = both(spark, d)
    return C.review_outcomes(G.candidate_batch(i, p), i.unionByName(p), RANKER)


# The scan as rounds: options that come first on all of their records are taken together, until a round takes none.
_ROUNDS = """used(record_id, place) USING KEY (record_id) AS (SELECT '', CAST(0 AS BIGINT) UNION (WITH live AS (SELECT * FROM uses WHERE place NOT IN (SELECT u.place FROM uses u JOIN recurring.used t ON t.record_id = u.record_id)),
 firsts AS (SELECT record_id, place, min(place) OVER (PARTITION BY record_id) = place AS first FROM live) SELECT record_id, place FROM firsts QUALIFY bool_and(first) OVER (PARTITION BY place)))"""


@query(f"""{EDGES.replace("WITH", "WITH RECURSIVE", 1)}, options AS MATERIALIZED (SELECT source_id, target_id, score, row_number() OVER (ORDER BY source_id, score DESC, target_id) AS place FROM edges),
uses AS MATERIALIZED (SELECT place, source_id AS record_id FROM options UNION ALL SELECT place, target_id FROM options), {_ROUNDS}
SELECT source_id, target_id, score AS confidence FROM options WHERE place IN (SELECT place FROM used)""")
def graph_pairs(spark, d):
    return G.graph_pairs(G.candidate_edges(_records(spark, d)))


@query(f"""{EDGES.replace("WITH", "WITH RECURSIVE", 1)}, own AS MATERIALIZED (SELECT e.source_id, e.target_id FROM edges e JOIN n a ON a.record_id = e.source_id JOIN n b ON b.record_id = e.target_id WHERE a.party = b.party),
ends AS (SELECT source_id AS anchor, target_id AS other, 0 AS way, 1 AS turn FROM own UNION ALL SELECT target_id, source_id, 1, -1 FROM own),
parts AS MATERIALIZED (SELECT anchor, way, o.record_type AS kind, other AS id, o.amount, turn * abs(o.fee_amount) AS fee FROM ends JOIN n o ON o.record_id = other),
two AS MATERIALIZED (SELECT x.anchor, x.way, x.kind, [x.id, y.id] AS m, y.id AS last, x.amount + y.amount AS amount, x.fee + y.fee AS fee FROM parts x JOIN parts y ON y.anchor = x.anchor AND y.way = x.way AND y.kind = x.kind AND y.id > x.id),
three AS MATERIALIZED (SELECT x.anchor, x.way, x.kind, list_append(m, y.id) AS m, y.id AS last, x.amount + y.amount AS amount, x.fee + y.fee AS fee FROM two x JOIN parts y ON y.anchor = x.anchor AND y.way = x.way AND y.kind = x.kind AND y.id > x.last),
four AS (SELECT x.anchor, x.way, x.kind, list_append(m, y.id) AS m, y.id AS last, x.amount + y.amount AS amount, x.fee + y.fee AS fee FROM three x JOIN parts y ON y.anchor = x.anchor AND y.way = x.way AND y.kind = x.kind AND y.id > x.last),
sums AS (SELECT g.*, a.stage, a.amount AS goal, (CASE g.way WHEN 0 THEN 1 ELSE -1 END) * abs(a.fee_amount) AS own_fee FROM (SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four) g JOIN n a ON a.record_id = g.anchor),
options AS MATERIALIZED (SELECT anchor, m, confidence, row_number() OVER (ORDER BY way, stage, anchor, len(m), m, confidence DESC, kind) AS place
 FROM (SELECT *, CAST(CASE WHEN amount = goal THEN 0.88 WHEN amount + fee = goal - own_fee THEN 0.82 END AS DECIMAL(4,2)) AS confidence FROM sums) WHERE confidence IS NOT NULL),
uses AS MATERIALIZED (SELECT place, unnest(list_prepend(anchor, m)) AS record_id FROM options), {_ROUNDS}
SELECT anchor AS anchor_id, m AS members, confidence FROM options WHERE place IN (SELECT place FROM used)""")
def graph_allocations(spark, d):
    records = _records(spark, d)
    # Edges within one party keep the groups of an anchor bounded.
    edges = cut(G.candidate_edges(records, one_party=True), "edges")
    return G.graph_allocations(records, edges)


THREE = f"{TWO} UNION ALL SELECT concat('S', substr(record_id, 2, 20)), 'settlement', external_id, amount, currency, record_date + 1, reference, party, fee_amount FROM payments"


@query(f"""{_edges_sql(THREE, True)}, e AS MATERIALIZED (SELECT source_id, target_id, CAST(score AS DOUBLE) AS score FROM edges)
SELECT source_id || '>' || target_id AS path, 2 AS n_nodes, round(score, 6) AS confidence FROM e UNION ALL
SELECT x.source_id || '>' || x.target_id || '>' || y.target_id, 3, round(x.score * y.score, 6) FROM e x JOIN e y ON y.source_id = x.target_id AND x.score * y.score >= 0.5 - 1e-12""")
def lineage_paths(spark, d):
    """Three record types, so that paths have hops."""
    i, p = both(spark, d)
    records = i.unionByName(p).unionByName(settlements(p))
    # An edge of amounts that are far apart scores 0.50, which no second edge may lower.
    return G.lineage_paths(G.candidate_edges(records, only_across=True), inner=G.candidate_edges(records, only_across=True, close=True))


@query()
def reconcile_graph(spark, d):
    i, p = both(spark, d)
    return G.reconcile_graph(i.unionByName(p))


# --- metrics ----------------------------------------------------------------------------------------------------

SCORED = """SELECT case_id, suite, run, label, hard_negative, auto_resolved, amount, latency_ms, llm_tokens, CASE WHEN run = 'baseline' THEN 'matched' WHEN case_id % 37 = 0 THEN NULL WHEN case_id % 41 = 0 THEN 'split' ELSE label END AS predicted_label FROM (
 SELECT o_orderkey AS case_id, o_orderpriority AS suite, CASE o_orderkey % 10 WHEN 5 THEN 'split' WHEN 6 THEN 'missing' WHEN 8 THEN 'currency' ELSE 'matched' END AS label, o_orderkey % 10 = 8 AS hard_negative, o_orderkey % 3 <> 0 AS auto_resolved,
 CAST(o_totalprice AS DECIMAL(20,4)) AS amount, o_orderkey % 17 AS latency_ms, o_orderkey % 50 AS llm_tokens FROM orders) c CROSS JOIN (SELECT 'system' AS run UNION ALL SELECT 'baseline' AS run) r"""
_RIGHT = "coalesce(label = predicted_label, false)"
_COUNTS = f"count(*) FILTER (WHERE {_RIGHT}) AS tp, count(*) FILTER (WHERE NOT {_RIGHT} AND predicted_label IS NOT NULL) AS fp, count(*) FILTER (WHERE NOT {_RIGHT}) AS fn"
_PRF = "tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"


def scored(spark, d):
    return sql(spark, d, SCORED)


@query(f"SELECT run, {_PRF} FROM (SELECT run, {_COUNTS} FROM ({SCORED}) GROUP BY 1)")
def label_match(spark, d):
    return X.label_match(scored(spark, d), ["run"])


@query(f"SELECT suite, run, {_PRF} FROM (SELECT suite, run, {_COUNTS} FROM ({SCORED}) GROUP BY 1, 2)")
def score_settlement(spark, d):
    return X.label_match(scored(spark, d), ["suite", "run"])


DETECT = "SELECT doc_id, quality = 1 AS actual, toxic = 0 AS predicted FROM labels"


@query(f"""SELECT tn, {_PRF}, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM (SELECT count(*) FILTER (WHERE actual AND predicted) AS tp, count(*) FILTER (WHERE NOT actual AND predicted) AS fp,
 count(*) FILTER (WHERE actual AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT actual AND NOT predicted) AS tn FROM ({DETECT}))""")
def binary_detection(spark, d):
    return X.binary_detection(sql(spark, d, DETECT), [])


@query("SELECT scenario, count(*) AS n FROM (SELECT CASE o_orderkey % 10 WHEN 5 THEN 'split' WHEN 6 THEN 'missing' WHEN 8 THEN 'currency' ELSE 'matched' END AS scenario FROM orders) GROUP BY 1")
def scenario_mix(spark, d):
    return scored(spark, d).where("run = 'system'").groupBy(F.col("label").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS e, list_distinct(list(l_linestatus || CASE WHEN l_quantity > 25 THEN '' ELSE 'x' END)) AS p FROM lineitem GROUP BY 1),
i AS (SELECT *, len(list_intersect(e, p)) AS b FROM s) SELECT l_orderkey % 10 AS k, round(avg(b / len(p)), 6) AS precision, round(avg(b / len(e)), 6) AS recall FROM i GROUP BY 1""")
def set_pr(spark, d):
    rows = tab(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("expected"), F.collect_set(F.concat("l_linestatus", F.when(F.col("l_quantity") > 25, "").otherwise("x"))).alias("predicted"))
    return X.set_pr(rows.withColumn("k", F.col("l_orderkey") % 10), ["k"])


@query(f"""SELECT run, round(count(*) FILTER (WHERE hard_negative AND auto_resolved AND NOT coalesce(label = predicted_label, true)) / count(*) FILTER (WHERE hard_negative), 6) AS hard_negative_fpr,
 round(count(*) FILTER (WHERE auto_resolved) / count(*), 6) AS automation_rate, CAST(sum(CASE WHEN auto_resolved AND label <> predicted_label THEN amount ELSE 0 END) AS DECIMAL(30,4)) AS fp_exposure,
 CAST(sum(CASE WHEN NOT auto_resolved AND label <> predicted_label THEN amount ELSE 0 END) AS DECIMAL(30,4)) AS fn_exposure, CAST(sum(CASE WHEN label = predicted_label THEN amount ELSE 0 END) AS DECIMAL(30,4)) AS amount_correct FROM ({SCORED}) GROUP BY 1""")
def risk_metrics(spark, d):
    return X.risk_metrics(scored(spark, d), ["run"])


@query(f"SELECT run, CAST(sum(latency_ms) AS BIGINT) AS latency_total, round(avg(latency_ms), 6) AS latency_mean, CAST(sum(llm_tokens) AS BIGINT) AS tokens_total, round(avg(llm_tokens), 6) AS tokens_mean FROM ({SCORED}) GROUP BY 1")
def cost_metrics(spark, d):
    return X.cost_metrics(scored(spark, d), ["run"])


@query(f"""WITH m AS (SELECT suite, run, {_PRF} FROM (SELECT suite, run, {_COUNTS} FROM ({SCORED}) GROUP BY 1, 2)), u AS (UNPIVOT (SELECT suite, run, precision, recall, f1 FROM m) ON precision, recall, f1 INTO NAME metric VALUE v)
SELECT s.suite, s.metric, s.v AS system_value, b.v AS baseline_value, round(s.v - b.v, 6) AS delta FROM u s JOIN u b ON s.suite = b.suite AND s.metric = b.metric AND s.run = 'system' AND b.run = 'baseline'""")
def suite_deltas(spark, d):
    return X.suite_deltas(X.label_match(scored(spark, d), ["suite", "run"]), ["suite"], ["precision", "recall", "f1"])


@query("SELECT o_orderkey AS case_id, 'missing prediction' AS problem FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT -o_orderkey, 'unknown case' FROM orders WHERE o_orderkey % 13 = 1")
def coverage_check(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    return X.coverage_check(o.where("case_id % 13 <> 1 or case_id % 13 = 1"), o.where("case_id % 13 <> 0").union(o.where("case_id % 13 = 1").select(-F.col("case_id"))))


PROB = "SELECT l.doc_id, CAST(l.quality AS INTEGER) AS label, CAST((l.doc_id * 7919 % 1000) / 1000.0 AS DOUBLE) AS probability, CAST(d.n_chars AS DECIMAL(20,4)) AS amount FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query(f"""WITH b AS (SELECT probability, count(*) AS n, sum(1 - label) AS fp, sum(CASE WHEN label = 0 THEN amount ELSE 0 END) AS lost FROM ({PROB}) GROUP BY 1),
c AS (SELECT probability, sum(n) OVER w AS n, sum(fp) OVER w AS fp, sum(lost) OVER w AS lost FROM b WINDOW w AS (ORDER BY probability DESC))
SELECT min(probability) AS coverage_threshold, max(probability) AS precision_threshold FROM c WHERE fp / n <= 0.2 AND lost <= 100000""")
def threshold_select(spark, d):
    return X.threshold_select(sql(spark, d, PROB), 0.2, 100000)


@query(f"""SELECT round(avg(pow(p - label, 2)), 6) AS brier, round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS log_loss FROM (SELECT label, least(greatest(probability, 1e-6), 1 - 1e-6) AS p FROM ({PROB}))""")
def calibration_quality(spark, d):
    return X.calibration_quality(sql(spark, d, PROB))


@query(f"""SELECT *, auto_fp = 0 AND round(review_fp / review_selected, 6) <= 0.2 AND review_exposure <= 100000 AS passed FROM (SELECT count(*) FILTER (WHERE probability >= 0.95) AS auto_selected, count(*) FILTER (WHERE probability >= 0.95 AND label = 0) AS auto_fp,
 count(*) FILTER (WHERE probability >= 0.6) AS review_selected, count(*) FILTER (WHERE probability >= 0.6 AND label = 0) AS review_fp, CAST(coalesce(sum(amount) FILTER (WHERE probability >= 0.6 AND label = 0), 0) AS DECIMAL(30,4)) AS review_exposure FROM ({PROB}))""")
def generalization_gate(spark, d):
    return X.generalization_gate(sql(spark, d, PROB), 0.95, 0.6, 0.2, 100000)


@query(f"""WITH p AS ({PROB}), b AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM p GROUP BY 1),
u AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM b), a AS (SELECT round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM u),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND probability >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND probability >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND probability < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND probability < 0.5) AS tn FROM p)
SELECT tn, {_PRF}, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, auc FROM c, a""")
def model_metrics(spark, d):
    return X.model_metrics(sql(spark, d, PROB))


@query(f"SELECT suite, run, {_PRF} FROM (SELECT suite, run, count(*) FILTER (WHERE auto_resolved AND NOT hard_negative) AS tp, count(*) FILTER (WHERE auto_resolved AND hard_negative) AS fp, count(*) FILTER (WHERE NOT auto_resolved AND NOT hard_negative) AS fn FROM ({SCORED}) GROUP BY 1, 2)")
def classification_metrics(spark, d):
    auto, hard = F.col("auto_resolved"), F.col("hard_negative")
    counts = scored(spark, d).groupBy("suite", "run").agg(F.count_if(auto & ~hard).alias("tp"), F.count_if(auto & hard).alias("fp"), F.count_if(~auto & ~hard).alias("fn"))
    return X.classification_metrics(counts, ["suite", "run"])


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS r, list_distinct(list(CASE WHEN l_quantity > 25 THEN 'N' ELSE l_linestatus END)) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(r, s)), ',') AS shared, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(s, x))), ',') AS missing,
 array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(r, x))), ',') AS extra, array_to_string(list_sort(list_distinct(list_concat(r, s))), ',') AS every FROM s""")
def evidence_gaps(spark, d):
    rows = tab(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("required"), F.collect_set(F.when(F.col("l_quantity") > 25, "N").otherwise(F.col("l_linestatus"))).alias("supplied"))
    return X.evidence_gaps(rows, "l_orderkey")


RCA = """SELECT k, suite, run, label, CASE WHEN run = 'baseline' THEN 'matched' WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'split' ELSE label END AS predicted_label,
 CASE WHEN k % 4 = 0 THEN k % 3 = 0 END AS detected_exception, k % 3 <> 0 AS auto_resolved, CASE WHEN k % 5 = 0 THEN CAST(0 AS DECIMAL(20,4)) ELSE price END AS amount, price,
 CASE WHEN label IN ('split', 'missing') THEN concat(' cause-', cast(k % 4 AS varchar(9)), ' ') ELSE ' ' END AS expected_root_cause, CASE WHEN k % 7 = 0 THEN 'other' WHEN run = 'system' THEN concat('cause-', cast(k % 4 AS varchar(9))) END AS root_cause,
 CASE WHEN label = 'split' THEN 'allocate' END AS expected_resolution, CASE WHEN k % 3 = 1 OR run = 'system' THEN 'allocate' ELSE 'escalate' END AS resolution FROM (
 SELECT o_orderkey AS k, o_orderpriority AS suite, CASE o_orderkey % 10 WHEN 5 THEN 'split' WHEN 6 THEN 'missing' WHEN 8 THEN 'hard_negative' WHEN 7 THEN 'Legitimate' ELSE 'matched' END AS label, CAST(o_totalprice AS DECIMAL(20,4)) AS price FROM orders) c CROSS JOIN (SELECT 'system' AS run UNION ALL SELECT 'baseline' AS run) r"""


@query(f"""WITH r AS (SELECT *, label IN ('split', 'missing') AS actual, label IN ('hard_negative', 'Legitimate') AS hard, coalesce(label = predicted_label, false) AS ok, coalesce(detected_exception, predicted_label IN ('split', 'missing'), false) AS det,
  CASE WHEN amount > 0 THEN amount ELSE price END AS money, nullif(trim(expected_root_cause), '') AS er, CASE WHEN k % 5 = k % 7 THEN 1 ELSE 2 END AS ne FROM ({RCA})),
x AS (SELECT *, CASE WHEN hard THEN CASE WHEN det THEN 'fp' END WHEN actual AND NOT det THEN 'fn' WHEN auto_resolved AND NOT ok THEN 'fp' END AS exposure FROM r),
g AS (SELECT suite, run, count(*) AS cases, round(count(*) FILTER (WHERE er = root_cause) / count(er), 6) AS root_cause_accuracy, round(count(*) FILTER (WHERE expected_resolution = resolution) / count(expected_resolution), 6) AS resolution_accuracy,
  round(count(*) FILTER (WHERE hard AND det) / count(*) FILTER (WHERE hard), 6) AS hard_negative_fpr, round(count(*) FILTER (WHERE auto_resolved) / count(*), 6) AS automation_rate,
  CAST(coalesce(sum(money) FILTER (WHERE exposure = 'fp'), 0) AS DECIMAL(30,4)) AS fp_exposure, CAST(coalesce(sum(money) FILTER (WHERE exposure = 'fn'), 0) AS DECIMAL(30,4)) AS fn_exposure, CAST(coalesce(sum(money) FILTER (WHERE ok AND det = actual), 0) AS DECIMAL(30,4)) AS amount_correct,
  count(*) FILTER (WHERE actual AND det) AS tp, count(*) FILTER (WHERE NOT actual AND det) AS fp, count(*) FILTER (WHERE actual AND NOT det) AS fn, count(*) FILTER (WHERE NOT actual AND NOT det) AS tn,
  CASE run WHEN 'system' THEN 1.0 ELSE 0.0 END AS evidence_precision, round(avg(CASE run WHEN 'system' THEN 1.0 / ne ELSE 0.0 END), 6) AS evidence_recall FROM x GROUP BY 1, 2)
SELECT suite, run, cases, root_cause_accuracy, resolution_accuracy, hard_negative_fpr, automation_rate, fp_exposure, fn_exposure, amount_correct, evidence_precision, evidence_recall, tn, {_PRF}, round((tp + tn) / cases, 6) AS accuracy FROM g""")
def score_rca(spark, d):
    e = lambda n: F.concat(F.lit("e"), F.col("k") % n)
    rows = sql(spark, d, RCA).withColumn("amounts", F.array(-F.col("price"), (F.col("price") / 2).cast("decimal(20,4)")))
    rows = rows.withColumn("expected_evidence", F.array(e(5), e(7))).withColumn("evidence_ids", F.when(F.col("run") == "system", F.array(e(5))).otherwise(F.array().cast("array<string>")))
    return X.score_rca(rows, ["suite", "run"])


BOOKS = """SELECT o_orderkey AS k, o_orderpriority AS suite, CAST(o_totalprice AS DECIMAL(20,4)) AS m, o_orderkey % 10 AS s FROM orders"""


@query(f"""SELECT suite, round(avg(CASE WHEN s = 0 THEN CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.0 END WHEN k % 4 = 0 THEN 0.0 WHEN s = 1 THEN 0.5 ELSE 1.0 END), 6) AS journal_score, round(avg(CASE WHEN s = 2 THEN 0.5 ELSE 1.0 END), 6) AS field_score,
 round(count(*) FILTER (WHERE k % 4 <> 0 AND s <> 1) / count(*), 6) AS balanced_rate, round(avg(CASE WHEN s = 3 THEN 0.5 WHEN s = 4 THEN 0.0 ELSE 1.0 END), 6) AS contradiction_precision, round(avg(CASE WHEN s = 4 THEN 0.0 ELSE 1.0 END), 6) AS contradiction_recall FROM ({BOOKS}) GROUP BY 1""")
def score_accounting(spark, d):
    zero = F.lit(0).cast("decimal(20,4)")
    line = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), debit.cast("decimal(20,4)").alias("debit"), credit.cast("decimal(20,4)").alias("credit"))
    m, s = F.col("m"), F.col("s")
    right = F.array(line("cash", m, zero), line("sales", zero, m))
    rows = sql(spark, d, BOOKS).select(
        "suite", F.when(s == 0, F.slice(right, 1, 0)).otherwise(right).alias("expected_lines"), F.when(F.col("k") % 4 == 0, F.slice(right, 1, 0)).when(s == 1, F.array(line("cash", m, zero), line("sales", zero, m + 1))).otherwise(right).alias("predicted_lines"),
        F.create_map(F.lit("vendor"), F.lit("v"), F.lit("total"), m.cast("string")).alias("expected_fields"), F.create_map(F.lit("vendor"), F.lit("v"), F.lit("total"), F.when(s == 2, "0").otherwise(m.cast("string"))).alias("predicted_fields"),
        F.when(s.isin(3, 4), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("expected"), F.when(s == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("predicted"),
    )
    return X.score_accounting(rows, ["suite"])


@query(f"SELECT run, suite, precision, recall, f1 FROM (SELECT suite, run, {_PRF} FROM (SELECT suite, run, {_COUNTS} FROM ({SCORED}) GROUP BY 1, 2))")
def bench_report(spark, d):
    """The suite metrics as JSON lines in the shared folder, read back."""
    path = fresh_path(spark, "report")
    X.label_match(scored(spark, d), ["suite", "run"]).select("run", "suite", "precision", "recall", "f1").write.json(path)
    return spark.read.schema("run string, suite string, precision double, recall double, f1 double").json(path)


_REPORT = f"""WITH m AS (SELECT suite, run, count(*) AS cases, {_COUNTS} FROM ({SCORED}) GROUP BY 1, 2), p AS (SELECT suite, run, cases, {_PRF} FROM m),
u AS (SELECT suite, run, unnest(['cases', 'precision', 'recall', 'f1']) AS metric, unnest([CAST(cases AS DOUBLE), precision, recall, f1]) AS value FROM p),
c AS (SELECT * FROM u UNION ALL SELECT s.suite, 'delta', s.metric, round(s.value - b.value, 6) FROM u s JOIN u b ON b.suite = s.suite AND b.metric = s.metric AND s.run = 'system' AND b.run = 'baseline' WHERE s.metric <> 'cases')"""


def _reported(spark, d, part, schema):
    """Two versions of the report, of which the second one counts, and a third that is not committed."""
    store = ReportStore(spark, fresh_path(spark, "report"))
    rows = scored(spark, d)
    metrics = X.label_match(rows, ["suite", "run"]).join(rows.groupBy("suite", "run").agg(F.count(F.lit(1)).alias("cases")), ["suite", "run"])
    predictions = rows.select("run", "case_id", "predicted_label", "auto_resolved", "amount")
    store.write(1, metrics.limit(3), predictions.limit(0))
    store.write(2, metrics, predictions)
    predictions.limit(0).write.json(f"{store.folder}/{part}/version=3")
    return store.read(part, schema)


@query(f"{_REPORT} SELECT * FROM c")
def report_comparison(spark, d):
    return _reported(spark, d, "comparison", "suite string, run string, metric string, value double")


@query(f"""{_REPORT}, n AS (SELECT *, CASE run WHEN 'system' THEN '### System' WHEN 'baseline' THEN '### Baseline' ELSE '### Delta (system - baseline)' END AS head FROM c WHERE value IS NOT NULL)
SELECT '# Evaluation benchmark report' AS line UNION ALL SELECT unnest(['', 'Baseline: `baseline`', 'System: `system`', '']) UNION ALL SELECT unnest(['## ' || suite, '']) FROM (SELECT DISTINCT suite FROM n)
UNION ALL SELECT unnest([head, '']) FROM (SELECT DISTINCT suite, head FROM n) UNION ALL SELECT '- **' || metric || ':** `' || CASE WHEN metric = 'cases' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '`' FROM n""")
def report_markdown(spark, d):
    return _reported(spark, d, "markdown", "value string").select(F.col("value").alias("line"))


@query(f"SELECT run, case_id, predicted_label, auto_resolved, amount FROM ({SCORED})")
def report_predictions(spark, d):
    return _reported(spark, d, "predictions", "run string, case_id long, predicted_label string, auto_resolved boolean, amount decimal(20,4)")


# --- controls ---------------------------------------------------------------------------------------------------

ACTIONS = """SELECT o_orderkey AS action_id, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 5000 ELSE o_totalprice / 20 END AS DECIMAL(20,4)) AS amount, o_orderkey % 2 = 0 AS exact_match, o_orderkey % 3 = 0 AS known_variance, o_orderkey % 5 <> 0 AS evidence_complete, o_orderkey % 7 = 0 AS unresolved,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey % 100) / 100.0 AS DOUBLE) END AS root_cause_confidence, o_orderkey % 9 = 0 AS lacking FROM orders"""


@query(f"""SELECT action_id, CASE WHEN lacking THEN 'invoice' ELSE '' END AS missing, CASE WHEN lacking OR unresolved OR coalesce(root_cause_confidence < 0.8, false) OR amount > 5000 THEN 'HUMAN_REVIEW' WHEN exact_match AND amount < 5000 THEN 'AUTO_APPROVE' WHEN known_variance AND evidence_complete AND amount < 5000 THEN 'AUTO_APPROVE' ELSE 'HUMAN_REVIEW' END AS decision,
 CASE WHEN lacking THEN 'MISSING_EVIDENCE' WHEN unresolved THEN 'UNRESOLVED_EXCEPTION' WHEN root_cause_confidence < 0.8 THEN 'LOW_CONFIDENCE' WHEN amount > 5000 THEN 'HIGH_AMOUNT' WHEN exact_match AND amount < 5000 THEN 'EXACT_LOW_AMOUNT' WHEN known_variance AND evidence_complete AND amount < 5000 THEN 'KNOWN_VARIANCE' ELSE 'NO_AUTOMATION_RULE' END AS rule FROM ({ACTIONS})""")
def policy_decision(spark, d):
    rows = sql(spark, d, ACTIONS).withColumn("required_evidence", F.array(F.lit("invoice"), F.lit("receipt"))).withColumn("supplied_evidence", F.when(F.col("lacking"), F.array(F.lit("receipt"))).otherwise(F.array(F.lit("receipt"), F.lit("invoice"))))
    return C.policy_decision(rows)


@query(f"""WITH s AS (SELECT journal_id, sum(debit) AS d, sum(credit) AS c, count(DISTINCT currency) AS k FROM ({JLINES}) GROUP BY 1)
SELECT o_orderkey AS journal_id, array_to_string(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'POLICY_DISALLOWS_ACTION' END, CASE WHEN o_custkey % 6 = 1 THEN 'DUPLICATE_ACTION' END, CASE WHEN year(o_orderdate) = 1997 THEN 'CLOSED_PERIOD' END, CASE WHEN o_orderkey % 15 = 1 THEN 'INVALID_SOURCE_RECORDS' END,
 CASE WHEN o_orderkey % 21 = 2 THEN 'ALREADY_RECONCILED' END, CASE WHEN s.journal_id IS NULL THEN 'EMPTY_JOURNAL' END, CASE WHEN k > 1 THEN 'INVALID_CURRENCY' END, CASE WHEN d <> c THEN 'UNBALANCED_JOURNAL' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders LEFT JOIN s ON s.journal_id = o_orderkey""")
def journal_validation(spark, d):
    j = sql(spark, d, """SELECT o_orderkey AS journal_id, o_custkey AS idempotency_key, year(o_orderdate) AS period, o_orderkey % 15 <> 1 AS source_records_valid, o_orderkey % 21 = 2 AS already_reconciled, false AS llm_generated,
      CASE WHEN o_orderkey % 10 = 0 THEN 'NONE' ELSE 'POST' END AS policy FROM orders""")
    closed = spark.range(1).select(F.lit(1997).alias("period"))
    done = tab(spark, d, "orders").where("o_custkey % 6 = 1").select(F.col("o_custkey").alias("idempotency_key"))
    return C.journal_validation(j, sql(spark, d, JLINES), closed, done).drop("valid")


@query(f"SELECT j AS journal_id, coalesce(sum(debit) = sum(credit), false) AS balanced FROM (SELECT unnest([o_orderkey, -1 - o_orderkey]) AS j FROM orders) LEFT JOIN ({JLINES}) l ON l.journal_id = j GROUP BY 1")
def journal_balance(spark, d):
    """All lines of all journals; journals below 0 have no lines."""
    journals = tab(spark, d, "orders").select(F.explode(F.array("o_orderkey", -1 - F.col("o_orderkey"))).alias("journal_id"))
    return C.journal_balance(journals, sql(spark, d, JLINES))


DECISIONS = "SELECT event_id AS decision_id, user_id AS review_id, ts AS decided_at, CASE event_type WHEN 'error' THEN 'ESCALATE' WHEN 'purchase' THEN 'AUTO_APPROVE' ELSE 'REJECT' END AS decision, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'ann' END AS actor, 'ok' AS reason FROM events"


@query(f"SELECT review_id, decision_id, decision FROM ({DECISIONS}) WHERE actor <> '' QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY decided_at, decision_id) = 1")
def review_state(spark, d):
    return C.review_state(sql(spark, d, DECISIONS)).select("review_id", "decision_id", "decision")


@query(f"SELECT c_custkey AS review_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT review_id FROM ({DECISIONS}) WHERE actor <> '')")
def pending_reviews(spark, d):
    reviews = sql(spark, d, "SELECT c_custkey AS review_id, CASE WHEN c_custkey % 2 = 0 THEN 'HUMAN_REVIEW' ELSE 'AUTO_APPROVE' END AS action FROM customer")
    return C.pending_reviews(reviews, sql(spark, d, DECISIONS)).select("review_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_feed(spark, d):
    """The newest 500 events: the limit is the feed's."""
    return C.newest(tab(spark, d, "events"), ["ts", "event_id"], 500).select("event_id", "event_type")


@query("SELECT user_id AS run_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1")
def run_list(spark, d):
    return tab(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


TRACE = "SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'model' WHEN 'error' THEN 'tool' ELSE event_type END AS event_type, CAST(event_id % 100 AS BIGINT) AS tokens, value AS duration_ms FROM events"


@query(f"SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'model') AS model_calls, count(*) FILTER (WHERE event_type = 'tool') AS tool_calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(duration_ms), 4) AS duration_ms FROM ({TRACE}) GROUP BY 1")
def trace_summary(spark, d):
    return C.trace_summary(sql(spark, d, TRACE))


@query(f"{CTE} SELECT record_id FROM payments WHERE contains(lower(concat_ws(' ', external_id, reference, party)), 'cust-1') ORDER BY 1 LIMIT 30")
def record_search(spark, d):
    """The first 30 hits: the limit is the search's."""
    return C.record_search(payments(spark, d), "CUST-1", ["external_id", "reference", "party"]).select("record_id")


@query(f"""{CTE}, e AS (SELECT record_id, external_id AS k FROM invoices WHERE external_id IS NOT NULL UNION SELECT record_id, external_id FROM payments WHERE external_id IS NOT NULL UNION SELECT record_id, lower(trim(reference)) FROM invoices WHERE reference IS NOT NULL UNION SELECT record_id, lower(trim(reference)) FROM payments WHERE reference IS NOT NULL)
SELECT DISTINCT a.record_id, b.record_id AS related_id FROM e a JOIN e b ON a.k = b.k AND a.record_id <> b.record_id""")
def related_records(spark, d):
    i, p = both(spark, d)
    return C.related_records(i.unionByName(p), [F.col("external_id"), F.lower(F.trim("reference"))])


@query(f"""{CTE} SELECT 'payment' AS record_type, record_id, amount FROM payments UNION ALL SELECT 'invoice', record_id, amount FROM invoices""")
def typed_lookup(spark, d):
    """Every record by its typed getter; as another type it is not found."""
    records = _records(spark, d)
    found = [C.records_of(records, kind).select("record_type", "record_id", "amount") for kind in ("payment", "invoice", "settlement")]
    return X.union_all(found)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(source, '')), 'src1') ORDER BY doc_id LIMIT 30")
def document_search(spark, d):
    """The first 30 hits: the limit is the search's."""
    return C.document_search(tab(spark, d, "documents"), " SRC1 ", ["source"]).select("doc_id", "source")


@query("SELECT doc_id, page FROM (SELECT doc_id, CAST(1 + n_chars // 3000 AS BIGINT) AS page_count, unnest([1, 2, 5]) AS page FROM documents) WHERE page <= page_count")
def document_pages(spark, d):
    """Pages that are asked for and that the document has."""
    docs = tab(spark, d, "documents").withColumn("page_count", F.expr("1 + n_chars div 3000"))
    asked = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("page"))
    return C.document_page(docs, asked).select("doc_id", "page")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_investigations(spark, d):
    """The newest 100: the limit is the list's."""
    return C.newest(tab(spark, d, "events").where("event_type = 'error'"), ["ts", "event_id"], 100).select("event_id", "user_id")


@query("SELECT user_id * 10 + event_id % 10 AS doc_id, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_errors, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'FAILED' ELSE 'PARSED' END AS status FROM events GROUP BY 1")
def doc_status(spark, d):
    return C.document_status(sql(spark, d, "SELECT user_id * 10 + event_id % 10 AS doc_id, CASE WHEN event_type = 'error' THEN 'bad' END AS error FROM events"))


@query("SELECT user_id * 10 + event_id % 10 AS doc_id, count(*) AS n_rows, 'CONFIRMED' AS status FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') = 0")
def confirmed_docs(spark, d):
    return C.confirmed(C.document_status(sql(spark, d, "SELECT user_id * 10 + event_id % 10 AS doc_id, CASE WHEN event_type = 'error' THEN 'bad' END AS error FROM events"))).drop("n_errors")


# --- learning ---------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    i, p = map(L.with_text, both(spark, d))
    s, t = i.select(*[F.col(c).alias(f"s_{c}") for c in i.columns]), p.select(*[F.col(c).alias(f"t_{c}") for c in p.columns])
    return L.features(s.join(t, F.col("s_party") == F.col("t_party"))).withColumn("score", F.lit(0.5)).withColumn("label", (F.substring("s_record_id", 2, 9) == F.substring("t_record_id", 2, 9)).cast("double"))


@query(f"""{CTE} SELECT s.record_id AS s_record_id, t.record_id AS t_record_id, least(CAST(abs(s.amount - t.amount) AS DOUBLE), 1e15) AS amount_delta, round(CAST(abs(s.amount - t.amount) AS DOUBLE) / CAST(greatest(abs(s.amount), abs(t.amount), 0.01) AS DOUBLE), 6) AS amount_relative,
 CAST(least(abs(s.record_date - t.record_date), 3650) AS DOUBLE) AS days, CAST(s.currency = t.currency AS DOUBLE) AS currency_match, 1.0 AS party_match, 0.0 AS party_missing, CAST(t.reference IS NULL AS DOUBLE) AS text_missing, CAST(0.5 AS DOUBLE) AS score,
 CASE WHEN t.reference IS NULL THEN 0.0 ELSE round(CAST(1 - levenshtein(lower(trim(s.reference)), lower(trim(t.reference))) / greatest(length(trim(s.reference)), length(trim(t.reference))) AS DOUBLE), 6) END AS text_similarity FROM invoices s JOIN payments t ON s.party = t.party""")
def features(spark, d):
    return _pairs(spark, d).select("s_record_id", "t_record_id", *L.FEATURES)


CANDIDATES = f"""{CTE} SELECT concat(s.record_id, ':', t.record_id) AS candidate_id, s.record_id AS source_id, t.record_id AS target_id, s.amount AS s_amount, t.amount AS t_amount, s.currency AS s_currency, t.currency AS t_currency,
 round(CAST(1 - abs(s.amount - t.amount) / greatest(s.amount, t.amount) AS DOUBLE), 4) AS score FROM invoices s JOIN payments t ON s.party = t.party"""


def _candidates(spark, d):
    wide = _pairs(spark, d).drop("score")
    both_sides = [F.col(f"{a}_{c}").alias(f"{b}_{n}") for a, b in (("s", "source"), ("t", "target")) for c, n in (("record_id", "id"), ("record_type", "type"), ("currency", "currency"), ("party", "party"))]
    score = F.round(1 - F.abs(F.col("s_amount") - F.col("t_amount")) / F.greatest("s_amount", "t_amount"), 4).cast("double")
    return wide.select(F.concat("s_record_id", F.lit(":"), "t_record_id").alias("candidate_id"), *both_sides, "s_amount", "t_amount", score.alias("score"))


@query(f"""WITH c AS ({CANDIDATES}), g AS (SELECT x.source_id, unnest([x.target_id, y.target_id]) AS target_id FROM c x JOIN c y ON y.source_id = x.source_id AND y.target_id > x.target_id AND x.t_amount + y.t_amount = x.s_amount
 UNION SELECT x.source_id, unnest([x.target_id, y.target_id, z.target_id]) FROM c x JOIN c y ON y.source_id = x.source_id AND y.target_id > x.target_id JOIN c z ON z.source_id = x.source_id AND z.target_id > y.target_id AND x.t_amount + y.t_amount + z.t_amount = x.s_amount
 UNION SELECT unnest([x.source_id, y.source_id]), x.target_id FROM c x JOIN c y ON y.target_id = x.target_id AND y.source_id > x.source_id AND x.s_amount + y.s_amount = x.t_amount
 UNION SELECT unnest([x.source_id, y.source_id, z.source_id]), x.target_id FROM c x JOIN c y ON y.target_id = x.target_id AND y.source_id > x.source_id JOIN c z ON z.target_id = x.target_id AND z.source_id > y.source_id AND x.s_amount + y.s_amount + z.s_amount = x.t_amount)
SELECT candidate_id, g.source_id IS NOT NULL AS in_allocation FROM c LEFT JOIN g ON g.source_id = c.source_id AND g.target_id = c.target_id""")
def allocation_flags(spark, d):
    return M.allocation_flags(_candidates(spark, d))


@query(f"""WITH c AS MATERIALIZED (SELECT *, CAST(score AS DECIMAL(10,6)) AS x FROM ({CANDIDATES})),
k AS MATERIALIZED (SELECT candidate_id, source_id, target_id, x, max(x) OVER (PARTITION BY source_id) AS sm, max(x) OVER (PARTITION BY target_id) AS tm, count(*) OVER (PARTITION BY source_id, x) AS sn, count(*) OVER (PARTITION BY target_id, x) AS tn FROM c WHERE s_currency = t_currency),
s2 AS MATERIALIZED (SELECT source_id, max(x) AS s2 FROM k WHERE x < sm GROUP BY 1), t2 AS MATERIALIZED (SELECT target_id, max(x) AS t2 FROM k WHERE x < tm GROUP BY 1),
e AS MATERIALIZED (SELECT candidate_id, CASE WHEN x < sm OR sn > 1 THEN sm ELSE s2 END AS rs, CASE WHEN x < tm OR tn > 1 THEN tm ELSE t2 END AS rt FROM k LEFT JOIN s2 USING (source_id) LEFT JOIN t2 USING (target_id)),
m AS (SELECT c.*, s_currency = t_currency AS one, x >= 0.5 AND (rs IS NULL OR x - rs >= 0.05) AND (rt IS NULL OR x - rt >= 0.05) AS review FROM c LEFT JOIN e USING (candidate_id))
SELECT candidate_id, score, CASE WHEN one AND review THEN 'REVIEW' ELSE 'UNRESOLVED' END AS suggestion, false AS automatic_action_eligible,
 CASE WHEN NOT one THEN 'CURRENCY_MISMATCH' WHEN review THEN 'REVIEW_ONLY_MODEL' WHEN x >= 0.5 THEN 'AMBIGUOUS_RECORD_MATCH' ELSE 'BELOW_REVIEW_THRESHOLD' END AS reason FROM m""")
def rank_candidates(spark, d):
    metadata = {"review_threshold": "0.50", "review_gate_passed": True, "review_policy": "separated", "relationships": ["invoice->payment"]}
    return C.rank_candidates(_candidates(spark, d), metadata)


EXAMPLES = "SELECT o_orderkey AS example_id, o_custkey AS entity, cast(o_totalprice * 100 AS bigint) AS seed, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey / 100 ELSE -o_orderkey END AS scenario FROM orders"


def _examples(spark, d):
    """A cast of a double to an integer rounds in DuckDB and truncates in Spark, so the seed is rounded first."""
    return sql(spark, d, EXAMPLES.replace("o_totalprice * 100", "rint(o_totalprice * 100)"))


@query(f"""WITH RECURSIVE x AS MATERIALIZED ({EXAMPLES}), ends AS MATERIALIZED (SELECT example_id, unnest(['entity=' || entity, 'seed=' || seed, 'scenario=' || scenario]) AS k FROM x),
least_of(example_id, g) USING KEY (example_id) AS (SELECT example_id, example_id FROM x UNION (WITH by_key AS (SELECT k, min(g) AS g FROM ends JOIN recurring.least_of USING (example_id) GROUP BY 1),
 near AS (SELECT example_id, min(by_key.g) AS g FROM ends JOIN by_key USING (k) GROUP BY 1) SELECT near.example_id, near.g FROM near JOIN recurring.least_of r ON r.example_id = near.example_id WHERE near.g < r.g))
SELECT example_id, g AS "group" FROM least_of""")
def leakage_groups(spark, d):
    return L.leakage_groups(_examples(spark, d), ["entity", "seed", "scenario"])


@query("""WITH g AS (SELECT o_orderkey AS example_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS "group" FROM orders), s AS (SELECT "group", count(*) AS n FROM g GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY sha256('7:' || "group"), "group") - n AS upto, greatest(1, round_even(0.2 * sum(n) OVER (), 0)) AS goal FROM s), f AS (SELECT min(upto + n) AS filled FROM c WHERE upto + n >= goal)
SELECT "group", example_id, CASE WHEN upto < goal THEN 'validation' WHEN upto - filled < goal THEN 'test' ELSE 'train' END AS split FROM g JOIN c USING ("group"), f""")
def grouped_split(spark, d):
    groups = cut(L.leakage_groups(_examples(spark, d), ["entity"]), "groups")
    return groups.join(L.grouped_split(groups).drop("n"), "group")


def _folds(spark, d):
    """What is trained on, and nothing else."""
    return cut(_pairs(spark, d).select(*L.FEATURES, "label", F.pmod(F.xxhash64("s_party"), F.lit(3)).alias("fold")), "examples")


TRAINED = list(L.FEATURES)


@query()
def train_baselines(spark, d):
    """Both models, fitted on one part of the parties, by their validation metrics; the best comes first."""
    rows = _folds(spark, d)
    out = []
    for name, model in L.train_baselines(rows.where("fold = 0"), TRAINED).items():
        held = L.probabilities(model, rows.where("fold = 1"))
        out.append(X.model_metrics(held.select(F.col("label").cast("int").alias("label"), F.round("probability", 4).alias("probability"))).withColumn("model", F.lit(name)))
    best = Window.orderBy(F.desc("f1"), F.desc("auc"), "model")  # a row for each model
    return X.union_all(out).withColumn("place", F.row_number().over(best))


@query()
def calibrate(spark, d):
    """Brier score and log loss of the logistic model before and after calibration, on parties that neither fit saw."""
    rows = _folds(spark, d)
    model = L.train_baselines(rows.where("fold = 0"), TRAINED, only=("logistic",))["logistic"]
    part = lambda k: L.probabilities(model, rows.where(F.col("fold") == k)).select("label", "probability")
    done = L.calibrate(part(2), part(1))
    return X.union_all([X.calibration_quality(done.select("label", F.col(c).alias("probability"))).withColumn("scores", F.lit(c)) for c in ("probability", "calibrated")])


@query()
def train_pipeline(spark, d):
    """Train on one part of the parties, calibrate on another, score the rest; metrics of both models."""
    rows = _folds(spark, d)
    out = []
    for name, model in L.train_baselines(rows.where("fold = 0"), TRAINED).items():
        held = L.probabilities(model, rows.where("fold = 1")).select("label", "probability")
        test = L.probabilities(model, rows.where("fold = 2")).select("label", "probability")
        calibrated = L.calibrate(test, held).select(F.col("label").cast("int").alias("label"), F.round("calibrated", 4).alias("probability"))
        out.append(X.model_metrics(calibrated).withColumn("model", F.lit(name)))
    return X.union_all(out)


# --- sources, streams -------------------------------------------------------------------------------------------


@query("SELECT 'INV-' || o_orderkey AS reference, CASE WHEN o_orderkey % 6 IN (2, 3) THEN NULL ELSE 1 END AS has_amount, o_orderkey % 6 IN (2, 3) AS bad FROM orders")
def csv_intake(spark, d):
    """Write the orders as CSV text, read it back as strings, and keep good and bad rows apart by their error."""
    path = fresh_path(spark, "intake")
    raw = sql(spark, d, RAW).select(F.concat(F.lit("INV-"), F.col("id")).alias("Invoice Number"), F.col("money").alias("Amount"), F.lit("2026-01-05").alias("Date"))
    raw.write.option("header", True).csv(path)
    read = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = N.normalize_records(read, "invoice", "orders.csv")
    return rows.select("reference", F.when(F.col("amount").isNotNull(), 1).alias("has_amount"), F.col("error").isNotNull().alias("bad"))


@query("SELECT o_orderkey AS case_id, CAST(o_totalprice AS DECIMAL(20,4)) AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'money must not be a JSON float' END AS error FROM orders")
def jsonl_predictions(spark, d):
    """Write predictions as JSON lines and read them strictly: money must be a string or an integer in the text."""
    path = fresh_path(spark, "predictions")
    line = F.concat(F.lit('{"case_id": '), F.col("k"), F.lit(', "amount": '), F.when(F.col("k") % 5 == 0, F.concat(F.col("m"), F.lit(""))).otherwise(F.concat(F.lit('"'), F.col("m"), F.lit('"'))), F.lit("}"))
    sql(spark, d, "SELECT o_orderkey AS k, cast(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders").select(line.alias("value")).write.text(path)
    text = spark.read.text(path)
    row = F.from_json("value", "case_id BIGINT, amount STRING")
    is_float = F.regexp_like("value", F.lit(r'"amount":\s*-?[0-9]+\.'))
    return text.select(row["case_id"].alias("case_id"), row["amount"].cast("decimal(20,4)").alias("amount"), F.when(is_float, "money must not be a JSON float").alias("error"))


STORED = "SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 10 = 6 THEN 'UNMATCHED' WHEN o_orderkey % 10 = 8 THEN 'EXCEPTION' ELSE 'MATCHED' END AS status FROM orders"


@query(f"SELECT CAST(result_id % 3 AS INTEGER) AS run_id, result_id, status, status <> 'MATCHED' AS queued FROM ({STORED})")
def run_store(spark, d):
    """Three runs, the last of them stored twice, read back with their exceptions."""
    store = RunStore(spark, fresh_path(spark, "runs"))
    results = sql(spark, d, STORED)
    for run in (0, 1, 2, 2):
        store.save(run, results.where(F.col("result_id") % 3 == run))
    queue = store.exceptions().select("run_id", "result_id", F.lit(True).alias("queued"))
    rows = store.results().join(queue, ["run_id", "result_id"], "left")
    return rows.select(F.col("run_id").cast("int").alias("run_id"), "result_id", "status", F.coalesce("queued", F.lit(False)).alias("queued"))


@query(f"SELECT CAST(result_id % 3 AS INTEGER) AS run_id, count(*) AS results, count(*) FILTER (WHERE status <> 'MATCHED') AS exceptions FROM ({STORED}) GROUP BY 1")
def run_counts(spark, d):
    """The completion rows of the runs, one a run."""
    store = RunStore(spark, fresh_path(spark, "runs"))
    for run in (0, 1, 2, 2):
        store.save(run, sql(spark, d, STORED).where(F.col("result_id") % 3 == run))
    return store.runs().select(F.col("run_id").cast("int").alias("run_id"), "results", "exceptions")


def _events(spark, d):
    return S.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Each event is delivered twice, the second time some minutes later."""
    late = F.explode(F.array(F.lit(0), F.lit(300)))
    twice = _events(spark, d).withColumn("late", late).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("late")))
    return S.run_to_table(S.stream_dedupe(twice, ["event_id"]).select("event_id", "event_type"), "stream-dedupe")


@query("SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents")
def stream_intake(spark, d):
    docs = S.read_stream(spark, d, "documents").withColumn("arrived", F.lit("2026-01-01").cast("timestamp"))
    return S.run_to_table(S.stream_intake(docs), "stream-intake").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(round(value) AS BIGINT) AS v, ts FROM events WHERE value IS NOT NULL)
SELECT a.event_id AS source_id, b.event_id AS target_id FROM e a JOIN e b ON a.event_type = 'purchase' AND b.event_type = 'error' AND a.v = b.v AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000""")
def stream_timing_match(spark, d):
    e = _events(spark, d).where("value is not null").select(F.col("event_id").alias("id"), "event_type", F.lit("USD").alias("currency"), F.round("value").cast("long").alias("amount"), "ts")
    return S.run_to_table(S.stream_timing_match(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), 1), "stream-match")


_STREAMED = """e AS (SELECT event_id, event_type, CAST(round(value) AS BIGINT) AS v, ts FROM events WHERE value IS NOT NULL), a AS (SELECT * FROM e WHERE event_type = 'purchase'), b AS (SELECT * FROM e WHERE event_type = 'error'),
m AS (SELECT a.event_id AS source_id, b.event_id AS target_id FROM a JOIN b ON a.v = b.v AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000),
w AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 10 DAY AS mark)"""


@query(f"""WITH {_STREAMED} SELECT * FROM m UNION ALL SELECT event_id, NULL FROM a, w WHERE event_id NOT IN (SELECT source_id FROM m) AND ts + INTERVAL 1 DAY < mark""")
def stream_unmatched(spark, d):
    """Purchases with the errors of the same value within a day, and without one once the watermark has passed."""
    e = _events(spark, d).where("value is not null").select(F.col("event_id").alias("id"), "event_type", F.lit("USD").alias("currency"), F.round("value").cast("long").alias("amount"), "ts")
    return S.run_to_table(S.stream_timing_match(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), 1, how="left_outer"), "stream-unmatched")


@query(f"""WITH {_STREAMED} SELECT * FROM m UNION ALL SELECT event_id, NULL FROM a, w WHERE event_id NOT IN (SELECT source_id FROM m) AND ts + INTERVAL 1 DAY < mark
UNION ALL SELECT NULL, event_id FROM b, w WHERE event_id NOT IN (SELECT target_id FROM m) AND ts + INTERVAL 1 DAY < mark""")
def stream_both_unmatched(spark, d):
    """The same with the unmatched rows of both sides."""
    e = _events(spark, d).where("value is not null").select(F.col("event_id").alias("id"), "event_type", F.lit("USD").alias("currency"), F.round("value").cast("long").alias("amount"), "ts")
    return S.run_to_table(S.stream_timing_match(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), 1, how="full_outer"), "stream-both-unmatched")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_exception_counts(spark, d):
    return S.windowed_counts(tab(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


from . import case_queries, file_queries  # noqa: E402, F401  (they register their queries here)

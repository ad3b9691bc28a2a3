"""Registered queries of the scans: files that Spark writes from the given tables, read back, and the SQL for their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import controls as C
from ..sources import files as R
from ..sources.feed import latest_changes, page_feed, write_pages
from ..streaming.intake import Intake, file_stream
from ..streaming.jobs import run_to_table
from .queries import QUERIES, RAW, SQL, query, sql, tab
from .storage import fresh_path

AMOUNT = "TRY_CAST(nullif(CASE WHEN starts_with(m, '(') AND ends_with(m, ')') THEN '-' || trim(m, '()') ELSE m END, '') AS DECIMAL(20,4))"
DAY = "CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%Y/%m/%d')) AS DATE)"
FILES = f"""SELECT CAST(id % 8 AS INT) AS part, 1 + row_number() OVER (PARTITION BY id % 8 ORDER BY id) AS row_number, id, concat('INV-', id) AS reference, money, day,
 trim(regexp_replace(trim(money), '[,$€£]', '', 'g')) AS m FROM ({RAW})"""


def _csv_folder(spark, d, path=None, parts=range(8)):
    """CSV files with a byte order mark, in the order of the ids; one note in three is of two quoted lines."""
    path = path or fresh_path(spark, "csv")
    note = F.when(F.col("id") % 3 == 0, F.concat(F.lit('the "first" line,\nthe '), "id", F.lit("th"))).otherwise("one line")
    # A file is one task's, which puts the keys into order, not the rows made of them.
    keys = tab(spark, d, "orders").withColumn("part", (F.col("o_orderkey") % 8).cast("int")).where(F.col("part").isin(*parts))
    keys = keys.repartition(8, "part").sortWithinPartitions("part", "o_orderkey")
    raw = spark.sql(RAW.replace("FROM orders", ", part FROM {orders}"), orders=keys)
    raw.select(F.concat(F.lit("INV-"), "id").alias("\ufeffInvoice Number"), F.col("money").alias("Amount"), F.col("day").alias("Date"), note.alias("Memo"), "part").write.option("header", True).option("escape", '"').partitionBy("part").csv(path)
    return path


def _csv(spark, d):
    return R.read_csv_rows(spark, _csv_folder(spark, d))


NOTE = "CASE WHEN id % 3 = 0 THEN concat('the \"first\" line,', chr(10), 'the ', id, 'th') ELSE 'one line' END"


@query(f"""SELECT part, row_number, reference, {NOTE} AS description, {AMOUNT} AS amount, {DAY} AS record_date,
 nullif(concat_ws('; ', CASE WHEN {AMOUNT} IS NULL THEN 'amount is missing or not a number' END, CASE WHEN {DAY} IS NULL THEN 'date is missing or not a date' END), '') AS error FROM ({FILES})""")
def csv_rows(spark, d):
    """Every row of the files by its number, typed, with its error; line breaks within quotes are part of their field."""
    rows = N.normalize_records(_csv(spark, d).drop("file"), "invoice", "orders.csv", keep=("part", "row_number"))
    return rows.select("part", "row_number", "reference", "description", "amount", "record_date", "error")


@query(f"""SELECT part, row_number, reference, {AMOUNT} AS amount, {DAY} AS record_date, nullif(concat_ws('; ', CASE WHEN {AMOUNT} IS NULL THEN 'amount is missing or not a number' END, CASE WHEN {DAY} IS NULL THEN 'date is missing or not a date' END), '') AS error,
 CASE part WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS batch FROM ({FILES})""")
def file_intake(spark, d):
    """Files that come in three runs of one stream, the last of them with a file of a content that was there; batches by the time of arrival."""
    inbox, table = fresh_path(spark, "inbox"), fresh_path(spark, "intake")
    intake = Intake(spark, table, "invoice", "orders.csv")
    for arrival, parts in enumerate(([0, 1], [2, 3, 4, 5, 6], [7, 0])):
        _csv_folder(spark, d, f"{inbox}/arrival={arrival}", parts)
        intake.run(file_stream(spark, inbox))
    rows = intake.rows()
    return rows.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "row_number", "reference", "amount", "record_date", "error", F.col("batch").cast("int").alias("batch"))


@query(f"""SELECT part, row_number, CASE WHEN row_number <= 101 THEN reference END AS reference, CASE WHEN row_number > 101 THEN 'row limit exceeded' END AS error FROM ({FILES}) WHERE row_number <= 102""")
def csv_row_cap(spark, d):
    """The cap of 100 rows a file is the feature."""
    rows = _csv(spark, d)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")
    return R.cap_rows(rows.drop("part"), 100).select(part.alias("part"), "row_number", F.col("Invoice Number").alias("reference"), "error")


@query(f"SELECT part, row_number, reference, nullif(money, '') AS amount FROM ({FILES}) WHERE row_number <= 26")
def csv_preview(spark, d):
    """The first 25 raw rows of each file: the limit is the preview's."""
    return R.read_preview(spark, _csv_folder(spark, d)).select("part", "row_number", F.col("Invoice Number").alias("reference"), F.nullif("Amount", F.lit("")).alias("amount"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 10 AS INT) AS s, CAST(o_totalprice AS DECIMAL(20,2)) AS m FROM orders),
r AS (SELECT *, unnest(CASE WHEN s = 3 THEN [0, 1] ELSE [0] END) AS n FROM o)
SELECT CASE WHEN s NOT IN (1, 2) THEN CAST(k AS VARCHAR) END AS case_id, CAST(CASE WHEN s IN (0, 1, 2, 6) THEN NULL WHEN s = 5 THEN k ELSE m END AS DECIMAL(20,4)) AS amount, CASE WHEN s NOT IN (1, 2, 7) THEN CASE WHEN s = 4 THEN -k ELSE k END END AS tokens,
 CASE WHEN s = 0 THEN 'amount must be a string or an integer' WHEN s = 1 THEN 'blank line' WHEN s = 2 THEN 'row must be an object' WHEN s = 4 THEN 'tokens must be an integer of at least 0' WHEN s = 6 THEN 'amount is not a number' WHEN s = 7 THEN 'tokens must be an integer of at least 0' WHEN n = 1 THEN 'duplicate case_id' END AS error FROM r""")
def strict_predictions(spark, d):
    """Predictions as JSON lines with the faults that the last digit of the key picks, read strictly."""
    rows = sql(spark, d, "SELECT o_orderkey AS k, CAST(o_orderkey % 10 AS INT) AS s, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders")
    s, k = F.col("s"), F.col("k").cast("string")
    quoted = F.concat(F.lit('"'), "m", F.lit('"'))
    amount = F.when(s == 0, F.concat(k, F.lit(".5"))).when(s == 5, k).when(s == 6, F.lit('"x"')).otherwise(quoted)
    tokens = F.when(s == 4, F.concat(F.lit("-"), k)).when(s == 7, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    line = F.when(s == 1, " ").when(s == 2, "[1]").otherwise(F.concat(F.lit('{"case_id":"'), k, F.lit('","amount":'), amount, F.lit(',"tokens":'), tokens, F.lit("}")))
    path = fresh_path(spark, "strict")
    # A folder by value gets no file from a task without rows; else the first task writes an empty one, which is a fault.
    rows.select(F.explode(F.when(s == 3, F.array(line, line)).otherwise(F.array(line))).alias("value"), F.lit(0).alias("pack")).write.partitionBy("pack").text(path)
    return R.read_predictions(spark, path).select("case_id", "amount", "tokens", "error")


FED = "SELECT event_id, CAST((event_id - event_id % 100) / 100 AS BIGINT) AS cursor FROM events"


@query(f"""WITH r AS (SELECT event_id AS id, event_id * 2 AS amount, cursor, 0 AS kind FROM ({FED}) UNION ALL SELECT event_id - 100, event_id, cursor, 1 FROM ({FED}) WHERE event_id % 3 = 0)
SELECT id, amount, cursor FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY cursor DESC, kind DESC) = 1""")
def page_merge(spark, d):
    """Pages of a hundred events; each third event also changes the one a page before."""
    row = lambda i, a: F.struct(i.alias("id"), a.alias("amount"))
    e = F.col("event_id")
    pages = sql(spark, d, FED).groupBy("cursor").agg(F.collect_list(row(e, e * 2)).alias("added"), F.collect_list(F.when(e % 3 == 0, row(e - 100, e))).alias("modified"))
    return R.merge_pages(pages, ["amount"])


@query(f"""WITH r AS (SELECT event_id AS id, event_id * 2 AS amount, cursor, event_id * 2 AS position FROM ({FED}) UNION ALL SELECT event_id - 100, event_id, cursor, event_id * 2 + 1 FROM ({FED}) WHERE event_id % 3 = 0)
SELECT id, amount, cursor FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY cursor DESC, position DESC) = 1""")
def feed_resume(spark, d):
    """The same pages as files of a feed: the even ones and page 1 come first, so the feed waits at page 3 and goes on when the rest has come."""
    e = F.col("event_id")
    added = F.struct((e * 2).alias("position"), F.struct(e.alias("id"), (e * 2).alias("amount")).alias("r"))
    changed = F.struct((e * 2 + 1).alias("position"), F.struct((e - 100).alias("id"), e.alias("amount")).alias("r"))
    lines = sql(spark, d, FED).select("cursor", F.explode(F.when(e % 3 == 0, F.array(added, changed)).otherwise(F.array(added))).alias("c"))
    lines = lines.select("cursor", "c.position", F.to_json("c.r").alias("change"))
    early, pages, out = (F.col("cursor") % 2 == 0) | (F.col("cursor") == 1), fresh_path(spark, "feed-pages"), fresh_path(spark, "feed")
    for part in (early, ~early):
        write_pages(lines.where(part), pages)
        changes = run_to_table(page_feed(spark, pages), "feed", out)
    return latest_changes(changes, "id long, amount long")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS token FROM documents),
o AS (SELECT doc_id, avg((length(token) * 13 + doc_id) % 101) / 100 AS c FROM t WHERE trim(token) <> '' AND length(token) > 1 GROUP BY 1),
p AS (SELECT DISTINCT doc_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence FROM documents)
SELECT doc_id, round(c, 6) AS ocr_confidence, CASE WHEN confidence < 0.8 AND coalesce(c > confidence, false) THEN 'ocr' ELSE 'text' END AS source FROM p LEFT JOIN o USING (doc_id)""")
def ocr_choice(spark, d):
    """One page a document; its words are the recognised tokens, those of one letter unsure."""
    docs = tab(spark, d, "documents")
    pages = docs.select("doc_id", F.lit(1).alias("page"), ((F.col("doc_id") % 10).cast("double") / 10).alias("confidence")).distinct()
    tokens = docs.select("doc_id", F.lit(1).alias("page"), F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("token"))
    tokens = tokens.withColumn("conf", F.when(F.length("token") <= 1, -1).otherwise((F.length("token") * 13 + F.col("doc_id")) % 101))
    return R.choose_page_text(pages, tokens).select("doc_id", F.round("ocr_confidence", 6).alias("ocr_confidence"), "source")


RANKS = "SELECT o_orderkey AS candidate_id, o_orderkey % 13 = 0 AS auto_eligible FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0"


@query(f"""WITH c AS (SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderkey % 7 <> 0), r AS (SELECT candidate_id, count(*) AS n, bool_or(auto_eligible) AS auto FROM ({RANKS}) GROUP BY 1)
SELECT coalesce(c.candidate_id, r.candidate_id) AS candidate_id, CASE WHEN c.candidate_id IS NULL THEN 'rank without candidate' WHEN r.candidate_id IS NULL THEN 'candidate without rank' WHEN n > 1 THEN 'candidate ranked twice' ELSE 'rank is auto-eligible' END AS problem
FROM c FULL JOIN r ON c.candidate_id = r.candidate_id WHERE c.candidate_id IS NULL OR r.candidate_id IS NULL OR n > 1 OR auto""")
def ranker_coverage(spark, d):
    return C.ranker_coverage(sql(spark, d, "SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderkey % 7 <> 0"), sql(spark, d, RANKS))


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE user_id = 7")
def entity_history(spark, d):
    """All of one entity's events: the entity is the query's argument."""
    return C.entity_history(tab(spark, d, "events"), "user_id", 7, ["ts", "event_id"]).select("event_id", "event_type", F.col("place").cast("long").alias("place"))


MAPPED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'own' END AS amount, o_orderstatus AS betrag, o_orderpriority AS firma FROM orders"


@query(f"SELECT id, coalesce(nullif(amount, ''), betrag) AS amount, firma AS vendor_id FROM ({MAPPED})")
def column_mapping(spark, d):
    return N.map_columns(sql(spark, d, MAPPED), {"amount": "betrag", "vendor_id": "firma"}).select("id", "amount", "vendor_id")


@query(f"SELECT concat('INV-', id) AS reference, 'orders.csv' AS source_name, nullif(money, '') AS raw_amount, day AS raw_date, CAST(2 AS BIGINT) AS n_steps FROM ({RAW})")
def provenance(spark, d):
    """Each typed row keeps the fields it came from and what was done to them."""
    rows = N.normalize_records(_csv(spark, d).drop("file"), "invoice", "orders.csv", keep=("part", "row_number"))
    p = F.col("provenance")
    field = lambda n: F.nullif(p["original_fields"][n], F.lit(""))
    return rows.select("reference", p["source_name"].alias("source_name"), field("amount").alias("raw_amount"), field("date").alias("raw_date"), F.size(p["transformation_history"]).cast("long").alias("n_steps"))


_TYPES = {
    "invoice": ("concat('INV-', k) AS `Invoice Number`, concat('$', m) AS `Total`, day AS `Date`, CASE WHEN k % 3 = 0 THEN '' ELSE concat('v', k) END AS `Vendor`, CASE k % 4 WHEN 0 THEN 'x' WHEN 1 THEN '1.5' END AS `Tax`",
        "concat('INV-', k) AS invoice_number, CASE WHEN k % 3 <> 0 THEN concat('v', k) END AS vendor_id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0 END AS tax_amount", "CASE WHEN k % 4 = 0 THEN 'tax_amount is not a number' END", "concat('INV-', k)", "CASE WHEN k % 3 <> 0 THEN concat('v', k) END", "NULL", "m"),
    "payment": ("concat('p', k) AS `Transaction ID`, m AS `Value`, day AS `Transaction Date`, CASE WHEN k % 2 = 0 THEN concat('PAY-', k) END AS `Payment ID`", "CASE WHEN k % 2 = 0 THEN concat('PAY-', k) END AS payment_reference", "NULL", "CASE WHEN k % 2 = 0 THEN concat('PAY-', k) ELSE concat('p', k) END", "NULL", "concat('p', k)", "m"),
    "settlement": ("concat('s', k) AS `ID`, m AS `Amount`, day AS `Date`, CASE WHEN k % 2 = 0 THEN '2.50' END AS `Fee`, CASE WHEN k % 5 = 0 THEN 'soon' ELSE day END AS `Settled Date`", "concat('s', k) AS settlement_reference, CASE WHEN k % 2 = 0 THEN 2.5 ELSE 0 END AS fee_amount, CASE WHEN k % 5 <> 0 THEN CAST(day AS DATE) END AS settled_date",
        "CASE WHEN k % 5 = 0 THEN 'settled_date is not a date' END", "concat('s', k)", "NULL", "concat('s', k)", "m"),
    "bank": ("m AS `Amount`, day AS `Date`, CASE WHEN k % 2 = 0 THEN concat('acc', k) END AS `Account`, concat('b', k) AS `Bank ID`", "CASE WHEN k % 2 = 0 THEN concat('acc', k) ELSE 'unknown' END AS account_id, 'unknown' AS transaction_type, concat('b', k) AS bank_reference", "NULL", "concat('b', k)", "CASE WHEN k % 2 = 0 THEN concat('acc', k) ELSE 'unknown' END", "NULL", "m"),
    "ledger": ("CASE WHEN k % 2 = 0 THEN m END AS `Debit`, CASE WHEN k % 2 = 1 THEN m END AS `Credit`, day AS `Posting Date`, concat('J', k) AS `Journal`", "concat('J', k) AS journal_id, 'unknown' AS account_code, CASE WHEN k % 2 = 0 THEN CAST(m AS DECIMAL(20,4)) ELSE 0 END AS debit, CASE WHEN k % 2 = 1 THEN CAST(m AS DECIMAL(20,4)) ELSE 0 END AS credit, CAST(day AS DATE) AS posting_date",
        "NULL", "NULL", "NULL", "NULL", "CASE WHEN k % 2 = 0 THEN CAST(m AS DECIMAL(20,4)) ELSE -CAST(m AS DECIMAL(20,4)) END"),
}
_TYPED_ROWS = "SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m, CAST(CAST(o_orderdate AS DATE) AS varchar(10)) AS day FROM orders"
_FULL = {"bank": "bank_transaction", "ledger": "ledger_entry"}


def _typed(spark, d, name):
    return N.normalize_typed(sql(spark, d, _TYPED_ROWS).selectExpr("k", *_split(_TYPES[name][0])), name, keep=("k",))


def _split(columns):
    """The columns of a select list, at commas outside of parentheses."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


def _typed_sql(name):
    _, own, error, _, _, external, amount = _TYPES[name]
    names = [n for n in N.TYPED[_FULL.get(name, name)] if f"AS {n}" not in own]
    blank = "".join(f", CAST(NULL AS {'DATE' if n.endswith('date') else 'VARCHAR'}) AS {n}" for n in names)
    own = own.replace("CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0 END AS tax_amount", "CAST(CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0 END AS DECIMAL(20,4)) AS tax_amount").replace("CASE WHEN k % 2 = 0 THEN 2.5 ELSE 0 END AS fee_amount", "CAST(CASE WHEN k % 2 = 0 THEN 2.5 ELSE 0 END AS DECIMAL(20,4)) AS fee_amount")
    return f"SELECT '{_FULL.get(name, name)}' AS record_type, CAST({amount} AS DECIMAL(20,4)) AS amount, CAST({external} AS VARCHAR) AS external_id, 'USD' AS currency, CAST(day AS DATE) AS record_date, CAST(NULL AS VARCHAR) AS description, {own}{blank}, k, CAST({error} AS VARCHAR) AS error FROM ({_TYPED_ROWS})"


def _register(name):
    @query(_typed_sql(name))
    def typed(spark, d):
        return _typed(spark, d, name)

    QUERIES[f"typed_{name}"], SQL[f"typed_{name}"] = QUERIES.pop("typed"), SQL.pop("typed")


for _name in _TYPES:
    _register(_name)


@query(" UNION ALL ".join(f"SELECT '{_FULL.get(n, n)}' AS record_type, CAST({amount} AS DECIMAL(20,4)) AS amount, 'USD' AS currency, CAST(day AS DATE) AS record_date, CAST({reference} AS VARCHAR) AS reference, CAST({party} AS VARCHAR) AS party FROM ({_TYPED_ROWS})" for n, (_, _, _, reference, party, _, amount) in _TYPES.items()))
def observable_types(spark, d):
    """What a ranker sees of the rows of all five types."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_typed(spark, d, n) for n in _TYPES])
    return N.observable(every).drop("external_id", "description")


@query("SELECT part, sha256(string_agg(line, '') ) AS sha256, sum(length(line)) AS bytes FROM (SELECT o_orderkey % 8 AS part, concat(o_orderkey, ';', o_orderstatus, chr(10)) AS line FROM orders ORDER BY o_orderkey) GROUP BY 1".replace("string_agg(line, '') ", "string_agg(line, '' ORDER BY k)").replace("SELECT o_orderkey % 8 AS part,", "SELECT CAST(o_orderkey % 8 AS INTEGER) AS part, o_orderkey AS k,").replace("sum(length(line))", "CAST(sum(length(line)) AS BIGINT)"))
def file_checksums(spark, d):
    """The digests and sizes of eight files."""
    path = fresh_path(spark, "digests")
    rows = sql(spark, d, "SELECT o_orderkey AS k, CAST(o_orderkey % 8 AS INT) AS part, concat(cast(o_orderkey AS varchar(20)), ';', o_orderstatus) AS value FROM orders")
    rows.repartition(8, "part").sortWithinPartitions("part", "k").drop("k").write.partitionBy("part").text(path)
    return R.file_digests(spark, path).select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "sha256", "bytes")

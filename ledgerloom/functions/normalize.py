"""Column expressions and operators that bring raw fields to the record contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONEY = "decimal(20,4)"
#: Date patterns in the order in which they are tried (ambiguous slashes are US first).
DATE_PATTERNS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d")
#: Currencies without minor units.
ZERO_DECIMAL = ("JPY", "KRW")
#: Words that mark a total's row.
TOTAL_WORDS = "total|sum|net|balance"


def norm_header(name: Column) -> Column:
    """Trimmed, lower-cased, other characters to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_amount(text: Column, kind: str = MONEY) -> Column:
    """Money without `, $ € £`; parentheses are negative; blank and bad are null."""
    bare = F.trim(F.regexp_replace(F.trim(text), "[,$€£]", ""))
    inner = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), F.trim(F.regexp_replace(bare, "[()]", "")))).otherwise(bare)
    return F.nullif(inner, F.lit("")).try_cast(kind)


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(text), p) for p in DATE_PATTERNS])


def alias_value(df: DataFrame, names: list[str]) -> Column:
    """First non-blank among the columns of these names that exist."""
    have = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Fill gaps from mapped columns (target -> given name); columns that exist win."""
    for target, given in mapping.items():
        value = F.nullif(F.col(given), F.lit(""))
        df = df.withColumn(target, F.coalesce(F.nullif(F.col(target), F.lit("")), value) if target in df.columns else value)
    return df


def signed_amount(amount: Column, debit: Column, credit: Column) -> Column:
    return F.coalesce(amount, debit, -credit)


def fin_value(text: Column) -> Column:
    """Financial text: parentheses, currency signs, k / m / b, US and EU separators; what does not parse is null.

    With both separators the last one is the decimal point. A single comma followed by two digits or more groups
    thousands; several commas without a point are null.
    """
    bare = F.regexp_replace(F.trim(text), r"[\s$€£¥₹]", "")
    negative = bare.startswith("(") & bare.endswith(")")
    bare = F.lower(F.regexp_replace(bare, "[()]", ""))
    scale = F.when(bare.endswith("k"), 1000).when(bare.endswith("m"), 1000000).when(bare.endswith("b"), 1000000000).otherwise(1)
    digits = F.regexp_replace(bare, "[kmb]$", "")
    commas, dots = F.length(digits) - F.length(F.regexp_replace(digits, ",", "")), F.length(digits) - F.length(F.regexp_replace(digits, r"\.", ""))
    after = F.length(digits) - F.length(F.substring_index(digits, ",", 1)) - 1
    european = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    plain = (
        F.when((commas > 0) & (dots > 0) & european, F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", "."))
        .when((commas > 0) & (dots > 0), F.regexp_replace(digits, ",", ""))
        .when((commas == 1) & (after >= 2), F.regexp_replace(digits, ",", ""))
        .when(commas == 1, F.regexp_replace(digits, ",", "."))
        .when(commas > 1, F.lit(None))
        .otherwise(digits)
    )
    value = plain.try_cast("decimal(24,4)") * scale
    return F.when(negative, -value).otherwise(value).cast("decimal(30,4)")


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, case-folded with single spaces; 0 where a side is empty."""
    return clean_similarity(clean_text(a), clean_text(b))


def clean_text(c: Column) -> Column:
    """Case-folded with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def clean_similarity(x: Column, y: Column) -> Column:
    """`text_similarity` of texts that are clean already."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def repeated_header(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) with `repeated`: not blank, and at least two earlier lines of the document equal."""
    key = F.lower(F.trim("line"))
    earlier = Window.partitionBy("doc_id", key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("repeated", (key != "") & (F.count(F.lit(1)).over(earlier) >= 2))


def is_total(line: Column) -> Column:
    return F.lower(line).rlike(TOTAL_WORDS)


def normalize_records(raw: DataFrame, record_type: str, source_name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """String rows of one file to the record contract: normalised headers, aliases, defaults, provenance, `error`.

    The columns of `keep`, such as a row number, are no fields of the row and come back as they are.
    """
    df = raw.toDF(*[h for h in (_slug(c) for c in raw.columns)])
    amount = signed_amount(parse_amount(alias_value(df, ["amount", "total", "value"])), parse_amount(alias_value(df, ["debit"])), parse_amount(alias_value(df, ["credit"])))
    when = parse_date(alias_value(df, ["date", "record_date", "invoice_date", "payment_date", "posting_date"]))
    error = F.concat_ws("; ", F.when(amount.isNull(), "amount is missing or not a number"), F.when(when.isNull(), "date is missing or not a date"))
    names = {"invoice": ["invoice_number"], "payment": ["payment_reference"], "settlement": ["settlement_reference"], "bank_transaction": ["bank_reference"], "ledger_entry": ["journal_id"]}
    if record_type not in names:
        raise ValueError(f"unsupported record type: {record_type}")
    fields = F.create_map(*[x for c in df.columns if c not in keep for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    provenance = F.struct(F.lit(source_name).alias("source_name"), fields.alias("original_fields"), F.array(F.lit("header normalised"), F.lit("types parsed")).alias("transformation_history"))
    return df.select(
        F.lit(record_type).alias("record_type"), alias_value(df, ["external_id", "id"]).alias("external_id"), amount.alias("amount"),
        F.upper(F.coalesce(alias_value(df, ["currency"]), F.lit("USD"))).alias("currency"), when.alias("record_date"),
        alias_value(df, [*names[record_type], "reference"]).alias("reference"), F.coalesce(alias_value(df, ["vendor_id", "payer_id", "payee_id", "account_id"]), F.lit("unknown")).alias("party"),
        F.coalesce(parse_amount(alias_value(df, ["fee_amount", "fee"])), F.lit(0)).cast(MONEY).alias("fee_amount"), alias_value(df, ["description", "memo"]).alias("description"),
        provenance.alias("provenance"), *keep, F.nullif(error, F.lit("")).alias("error"),
    )


#: Names that a record type may have, and the fields of each type: kind, aliases, and what a blank one is.
TYPE_NAMES = {"bank": "bank_transaction", "ledger": "ledger_entry"}
TYPED = {
    "invoice": {"invoice_number": ("text", ["invoice_number", "invoice", "id"], ""), "vendor_id": ("text", ["vendor_id", "vendor", "supplier_id"], None), "due_date": ("date", ["due_date"], None), "tax_amount": ("money", ["tax_amount", "tax"], "0")},
    "payment": {"payment_reference": ("text", ["payment_reference", "payment_id"], None)},
    "settlement": {"settlement_reference": ("text", ["settlement_reference", "settlement_id", "id"], ""), "processor": ("text", ["processor"], None), "fee_amount": ("money", ["fee_amount", "fee"], "0"), "settled_date": ("date", ["settled_date"], None)},
    "bank_transaction": {"account_id": ("text", ["account_id", "account"], "unknown"), "transaction_type": ("text", ["transaction_type", "type"], "unknown"), "bank_reference": ("text", ["bank_reference", "bank_id"], None), "value_date": ("date", ["value_date"], None)},
    "ledger_entry": {"journal_id": ("text", ["journal_id", "journal"], "unknown"), "account_code": ("text", ["account_code", "account"], "unknown"), "debit": ("money", ["debit"], "0"), "credit": ("money", ["credit"], "0"), "posting_date": ("date", ["posting_date"], None)},
}
#: Where the reference and the party of a record stand, the first that is not blank.
REFERENCE_FIELDS = ("invoice_number", "payment_reference", "settlement_reference", "bank_reference", "external_id")
PARTY_FIELDS = ("vendor_id", "payer_id", "payee_id", "account_id")


def normalize_typed(raw: DataFrame, record_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """String rows of one type to its own fields beside the common ones, with an `error` that names what does not parse.

    A blank field is the type's default; only one that is filled and does not parse is an error.
    """
    kind = TYPE_NAMES.get(record_type.strip().lower(), record_type.strip().lower())
    if kind not in TYPED:
        raise ValueError(f"unsupported record type: {record_type}")
    df = raw.toDF(*[_slug(c) if c not in keep else c for c in raw.columns])
    value = lambda names: alias_value(df, names)
    common = {
        "external_id": ("text", ["external_id", "id", "transaction_id", "reference"], None), "currency": ("text", ["currency", "currency_code"], "USD"), "record_date": ("date", ["record_date", "transaction_date", "date", "posting_date"], None),
        "description": ("text", ["description", "memo", "narrative"], None),
    }
    parse = {"text": lambda c: c, "date": parse_date, "money": parse_amount}
    cast = {"text": "string", "date": "date", "money": MONEY}
    amount = signed_amount(parse_amount(value(["amount", "total", "value"])), parse_amount(value(["debit"])), parse_amount(value(["credit"])))
    out, faults = {"amount": amount}, [F.when(amount.isNull(), "amount is missing or not a number")]
    for name, (how, names, blank) in (common | TYPED[kind]).items():
        text = value(names)
        out[name] = F.coalesce(parse[how](text), F.when(text.isNull(), F.lit(blank)).cast(cast[how])).cast(cast[how])
        if how != "text":
            needed = name == "record_date"
            bad = out[name].isNull() if needed else text.isNotNull() & parse[how](text).isNull()
            faults.append(F.when(bad, f"{name} is {'missing or ' if needed else ''}not a {'date' if how == 'date' else 'number'}"))
    out["currency"] = F.upper(out["currency"])
    return df.select(F.lit(kind).alias("record_type"), *[c.alias(n) for n, c in out.items()], *keep, F.nullif(F.concat_ws("; ", *faults), F.lit("")).alias("error"))


def observable(records: DataFrame) -> DataFrame:
    """What a ranker may see of typed rows: external_id, record_type, amount, currency, record_date, reference, party, description."""
    first = lambda names: alias_value(records, list(names))
    return records.select("external_id", "record_type", "amount", F.upper("currency").alias("currency"), "record_date", first(REFERENCE_FIELDS).alias("reference"), first(PARTY_FIELDS).alias("party"), "description")


def _slug(name: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Extracted cells to rows: the first row of each table names the columns.

    row_number is page * 1000 + row + 1; a row's fields are a map from header text to cell text.
    """
    table = ["doc_id", "page", "table_index"]
    first = F.min("row_index").over(Window.partitionBy(*table))
    marked = cells.withColumn("first", first)
    head = marked.where("row_index = first").select(*table, "column_index", norm_header(F.col("text")).alias("header"))
    body = marked.where("row_index > first").join(head, [*table, "column_index"])
    rows = body.groupBy(*table, "row_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "text")))).alias("fields"), F.min("confidence").alias("parser_confidence"))
    return rows.select("doc_id", (F.col("page") * 1000 + F.col("row_index") + 1).alias("row_number"), "fields", "parser_confidence")


def page_confidence(n_words: Column, n_chars: Column) -> Column:
    """0 without text, 0.85 from three words and twenty characters, else the mean of both shares to two places."""
    short = F.round((F.least(n_words / 20, F.lit(1.0)) + F.least(n_chars / 200, F.lit(1.0))) / 2, 2)
    return F.when((n_words == 0) | (n_chars == 0), 0.0).when((n_words >= 3) & (n_chars >= 20), 0.85).otherwise(short)


def norm_bank_feed(payload: DataFrame) -> DataFrame:
    """Bank-feed rows: the sign stays (positive is money out), the reference is the pending id or the id."""
    amount = F.col("amount").cast("string").try_cast(MONEY)
    return payload.select(
        F.col("transaction_id").alias("external_id"), amount.alias("amount"), F.upper(F.coalesce("iso_currency_code", F.lit("USD"))).alias("currency"), F.when(amount >= 0, "debit").otherwise("credit").alias("transaction_type"),
        F.coalesce("pending_transaction_id", "transaction_id").alias("bank_reference"), F.coalesce("merchant_name", "name", F.lit("")).alias("description"),
        "account_id", F.try_to_date("date", "yyyy-MM-dd").alias("record_date"), F.try_to_date("authorized_date", "yyyy-MM-dd").alias("value_date"),
    )


def norm_payment(rows: DataFrame, provider: str = "processor") -> DataFrame:
    """Payments of a processor: minor units to money, the id as reference, epoch seconds to a date, the first of the methods.

    Without a currency it is USD, without a description or a method that of the provider.
    """
    currency = F.upper(F.coalesce("currency", F.lit("usd")))
    unit = F.when(currency.isin(*ZERO_DECIMAL), 1).otherwise(100)
    return rows.select(
        F.col("id").alias("external_id"), F.col("id").alias("payment_reference"), (F.col("amount").cast(MONEY) / unit).cast(MONEY).alias("amount"), currency.alias("currency"), F.to_date(F.timestamp_seconds("created")).alias("record_date"),
        F.coalesce(F.nullif("description", F.lit("")), F.lit("payment")).alias("description"), F.col("customer").alias("payer_id"), F.coalesce(F.get("payment_method_types", F.lit(0)), F.lit(provider)).alias("payment_method"),
    )


def norm_processor(rows: DataFrame) -> DataFrame:
    """Processor rows: minor units to money (JPY and KRW have none), net and absolute fee, epoch seconds to dates."""
    unit = F.when(F.upper("currency").isin(*ZERO_DECIMAL), 1).otherwise(100)
    money = lambda c: (F.col(c).cast(MONEY) / unit).cast(MONEY)
    return rows.select(F.col("id").alias("settlement_reference"), money("net").alias("amount"), F.abs(money("fee")).alias("fee_amount"), F.upper("currency").alias("currency"), F.to_date(F.timestamp_seconds(F.coalesce("available_on", "created"))).alias("settled_date"))

"""Trade documents: order checks, totals, six draft documents per order and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.session import first_code, once

# ---- fixed values: document types with titles, defaults and limits ----
DOCUMENT_TITLES = {
    "quotation": "报价单 / Quotation",
    "proforma-invoice": "形式发票 / Proforma Invoice",
    "commercial-invoice": "商业发票 / Commercial Invoice",
    "packing-list": "装箱单 / Packing List",
    "sales-contract": "销售合同草稿 / Sales Contract Draft",
    "product-catalog": "产品目录 / Product Catalog",
}
DEFAULT_CURRENCY, DEFAULT_UNIT, DEFAULT_INCOTERM = "USD", "pcs", "FOB Shanghai"
DEFAULT_PAYMENT, DEFAULT_VALIDITY = "T/T 30% deposit, 70% before shipment", 30
LINES_LIMIT = 100
STATUS_LINE = (
    "STATUS: DRAFT — review commercial, customs, tax, banking and legal requirements before external use. "
    "No sending, signing or payment is performed."
)
# ---- end of fixed values ----

MONEY = "decimal(20,2)"
PARTIES = ("name", "address", "contact")


def check_lines(lines: DataFrame) -> DataFrame:
    """Type order lines, apply defaults and add a `refusal` code to unusable ones.

    Lines: order_id, line_no, sku, name, specification, quantity, unit, unit_price, carton_count,
    gross_weight_kg, net_weight_kg. Money is decimal throughout.
    """
    def positive(name: str, default: str | None = None) -> Column:
        value = F.col(name).try_cast("decimal(18,4)")
        # Blank and zero take the default; text that is no number stays null and is refused.
        blank = F.coalesce(t.trimmed(name), F.lit("")) == ""
        return F.when(blank | (value == 0), F.lit(default).cast("decimal(18,4)")).otherwise(value) if default else value

    typed = lines.select(
        "order_id", "line_no", t.squeezed("sku").alias("sku"), t.squeezed("name").alias("name"),
        t.squeezed("specification").alias("specification"), positive("quantity").alias("quantity"),
        F.coalesce(t.squeezed("unit"), F.lit(DEFAULT_UNIT)).alias("unit"), positive("unit_price").alias("unit_price"),
        positive("carton_count", "1").alias("carton_count"), positive("gross_weight_kg", "0.01").alias("gross_weight_kg"),
        positive("net_weight_kg", "0.01").alias("net_weight_kg"))
    numbers = ("quantity", "unit_price", "carton_count", "gross_weight_kg", "net_weight_kg")
    limits = {"sku": 100, "name": 240, "specification": 500, "unit": 30}
    refusal = first_code(
        (F.col("sku").isNull(), "sku-missing"), (F.col("name").isNull(), "name-missing"),
        *[(F.length(c) > n, f"{c}-too-long") for c, n in limits.items()],
        *[(F.col(c).isNull() | (F.col(c) <= 0), f"{c}-not-positive") for c in numbers])
    total = F.round(F.col("quantity") * F.col("unit_price"), 2).cast(MONEY)
    return typed.withColumn("line_total", total).withColumn("refusal", refusal)


def order_totals(checked: DataFrame) -> DataFrame:
    """Amount, cartons and weights per order, the line count and how many lines are refused.

    All buffers are numbers, so this is a hash aggregate."""
    def total(name: str, kind: str = MONEY) -> Column:
        return F.sum(name).cast(kind).alias(name)

    return checked.groupBy("order_id").agg(
        F.sum("line_total").cast(MONEY).alias("amount"), F.sum("carton_count").cast("decimal(20,4)").alias("cartons"),
        F.round(F.sum("gross_weight_kg"), 2).cast(MONEY).alias("gross_weight_kg"),
        F.round(F.sum("net_weight_kg"), 2).cast(MONEY).alias("net_weight_kg"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("refusal").isNotNull()).alias("bad_lines"))


def check_orders(orders: DataFrame, totals: DataFrame, issue_date: Column, prefix: str = "ORDER") -> DataFrame:
    """Orders with defaults, totals and a `refusal` code for those no document may be made from.

    Orders: order_id, supplier and buyer (struct of name, address, contact), currency, incoterm,
    payment_terms, validity_days, issue_date, reference, notes.
    """
    def party(side: str) -> Column:
        return F.struct(*[t.squeezed(f"{side}.{p}").alias(p) for p in PARTIES])

    validity = F.coalesce(F.nullif(t.number("validity_days"), F.lit(0.0)), F.lit(float(DEFAULT_VALIDITY)))
    issued = F.coalesce(t.text("issue_date"), F.date_format(issue_date, "yyyy-MM-dd"))
    made = F.concat(F.lit(f"{prefix}-"), F.date_format(issue_date, "yyyyMMdd"), F.lit("-DRAFT"))
    typed = orders.select(
        "order_id", party("supplier").alias("supplier"), party("buyer").alias("buyer"),
        F.upper(F.coalesce(t.squeezed("currency"), F.lit(DEFAULT_CURRENCY))).alias("currency"),
        F.coalesce(t.squeezed("incoterm"), F.lit(DEFAULT_INCOTERM)).alias("incoterm"),
        F.coalesce(t.squeezed("payment_terms"), F.lit(DEFAULT_PAYMENT)).alias("payment_terms"),
        t.half_up(validity).alias("validity_days"), issued.alias("issue_date"),
        F.coalesce(t.squeezed("reference"), made).alias("reference"), t.squeezed("notes").alias("notes"),
    ).join(totals, "order_id", "left")
    sides = [(f"{s}.{p}", f"{s}-{p}") for s in ("supplier", "buyer") for p in PARTIES]
    limits = {"incoterm": 120, "payment_terms": 500, "reference": 80, "issue_date": 10, "notes": 1000}
    refusal = first_code(
        *[(F.col(c).isNull(), f"{label}-missing") for c, label in sides],
        *[(F.length(c) > 500, f"{label}-too-long") for c, label in sides],
        (~F.col("currency").rlike("^[A-Z]{3}$"), "bad-currency"),
        *[(F.length(c) > n, f"{c.replace('_', '-')}-too-long") for c, n in limits.items()],
        (F.coalesce("lines", F.lit(0)) < 1, "no-lines"), (F.col("lines") > LINES_LIMIT, "too-many-lines"),
        (F.coalesce("bad_lines", F.lit(0)) > 0, "bad-line"), (validity <= 0, "bad-validity"))
    return typed.withColumn("refusal", refusal)


def trade_documents(checked: DataFrame) -> DataFrame:
    """Six draft documents per usable order, each with only the fields its type shows."""
    types = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("title")) for k, v in DOCUMENT_TITLES.items()])
    rows = checked.where(F.col("refusal").isNull()).select("*", F.inline(types))
    kind = F.col("type")
    priced = kind != "product-catalog"
    invoice = kind.isin("proforma-invoice", "commercial-invoice")
    packing = kind == "packing-list"

    def shown(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name)).alias(name)

    return rows.select(
        "order_id", "type", "title", F.concat("reference", F.lit("-"), F.upper(kind)).alias("reference"),
        F.lit("draft").alias("status"), F.lit(True).alias("requires_human_review"), "issue_date", "supplier",
        shown(priced, "buyer"), shown(priced, "currency"), F.when(priced, F.col("amount")).alias("total_amount"),
        shown(priced, "incoterm"), "notes",
        F.when(priced & ~packing, F.col("payment_terms")).alias("payment_terms"),
        F.when(packing, F.col("cartons")).alias("total_cartons"), shown(packing, "gross_weight_kg"),
        shown(packing, "net_weight_kg"),
        F.when(kind == "quotation", F.col("validity_days")).alias("valid_until_days"),
        F.when(kind == "sales-contract", F.lit(True)).alias("legal_review_required"),
        F.when(invoice, F.lit(True)).alias("not_proof_of_payment"))


def plain_number(c: Column) -> Column:
    """Decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def document_texts(documents: DataFrame, checked_lines: DataFrame) -> DataFrame:
    """Plain text of each document. Usable orders have at most LINES_LIMIT lines, so the list is bounded."""
    usable = documents.where(F.col("type") == next(iter(DOCUMENT_TITLES))).select("order_id")  # each usable order has each type once
    fields = ("line_no", "sku", "name", "specification", "quantity", "unit", "carton_count", "gross_weight_kg",
              "net_weight_kg", "unit_price", "line_total")
    items = checked_lines.join(usable, "order_id", "left_semi").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    kind = F.col("type")
    packing, catalog = kind == "packing-list", kind == "product-catalog"

    def bar(*parts: Column | str) -> Column:
        return F.concat_ws(" | ", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = ("SKU", "Product", "Specification", "Quantity")
    columns = F.when(packing, bar(*head, "Cartons", "Gross weight kg", "Net weight kg")).when(
        catalog, bar(*head)).otherwise(bar(*head, "Unit price", "Line total"))

    def money(value: Column) -> Column:
        return F.concat(F.col("currency"), F.lit(" "), plain_number(value))

    # The numbers of a line are written once per order, for all its documents.
    def written(i: Column) -> Column:
        quantity = F.concat(plain_number(i["quantity"]), F.lit(" "), i["unit"])
        return F.struct(
            bar(i["sku"], i["name"], F.coalesce(i["specification"], F.lit("-")), quantity).alias("shared"),
            bar(plain_number(i["carton_count"]), plain_number(i["gross_weight_kg"]), plain_number(i["net_weight_kg"])).alias("packed"),
            plain_number(i["unit_price"]).alias("unit_price"), plain_number(i["line_total"]).alias("line_total"))

    items = once(items, _lines=F.transform("items", written)).select("order_id", "_lines")

    def priced(value: Column) -> Column:
        return F.concat(F.col("currency"), F.lit(" "), value)

    def item(i: Column) -> Column:
        return F.when(packing, bar(i["shared"], F.nullif(i["packed"], F.lit("")))).when(catalog, i["shared"]).otherwise(
            bar(i["shared"], priced(i["unit_price"]), priced(i["line_total"])))

    def side(label: str, name: str) -> Column:
        return F.concat(F.lit(f"{label}: "), bar(*[F.col(f"{name}.{p}") for p in PARTIES]))

    def labelled(label: str, value: Column, unit: str = "") -> Column:
        return F.concat(F.lit(f"{label}: "), value, F.lit(unit))

    packing_line = F.concat(
        F.lit("Packing: "), plain_number(F.col("total_cartons")), F.lit(" cartons; G.W. "),
        plain_number(F.col("gross_weight_kg")), F.lit(" kg; N.W. "), plain_number(F.col("net_weight_kg")), F.lit(" kg"))
    before = [F.upper("title"), F.concat(F.lit("DRAFT · "), "reference"), labelled("Issue date", F.col("issue_date")),
              side("Seller", "supplier"), F.when(F.col("buyer").isNotNull(), side("Buyer", "buyer")), columns]
    after = [F.when(~packing & F.col("total_amount").isNotNull(), labelled("Total", money(F.col("total_amount")))),
             labelled("Incoterm", F.col("incoterm")), labelled("Payment terms", F.col("payment_terms")), packing_line,
             labelled("Validity", F.col("valid_until_days").cast("string"), " days"),
             labelled("Notes", F.col("notes")), F.lit(STATUS_LINE)]
    lines = reduce(F.concat, [F.array(*before), F.transform("_lines", item), F.array(*after)])
    return documents.join(items, "order_id").select(
        "order_id", "type", F.array_join(F.array_compact(lines), "\n").alias("text"))

"""Customer messages: classification by weighted patterns, template replies and reply prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.session import once

# ---- fixed values: message classes in order, with their patterns and weights ----
SCENARIOS = {
    "inquiry": (
        (r"\binterested in\b", 4), (r"\bmore information\b", 3), (r"\bcatalog(?:ue)?\b", 3),
        (r"\bdo you (?:have|supply|make)\b", 3), (r"\bproduct (?:details|range|specifications?)\b", 3),
        (r"\blooking for\b", 2),
    ),
    "quotation": (
        (r"\b(?:price|pricing|quotation|quote)\b", 4), (r"\b(?:FOB|CIF|EXW|DDP)\b", 3), (r"\bprice list\b", 4),
        (r"\bbest price\b", 3), (r"\bunit price\b", 3),
    ),
    "sample": (
        (r"\bsamples?\b", 5), (r"\bprototype\b", 4), (r"\bsample (?:cost|fee|lead time|shipping)\b", 4),
        (r"\btrial order\b", 2),
    ),
    "negotiation": (
        (r"\bdiscount\b", 5), (r"\blower (?:the )?price\b", 5), (r"\btoo expensive\b", 5), (r"\btarget price\b", 4),
        (r"\bbetter (?:price|offer|terms)\b", 4), (r"\bnegotiate\b", 4),
    ),
    "order": (
        (r"\bpurchase order\b", 5), (r"\bplace (?:an|the) order\b", 5), (r"\bconfirm (?:the )?order\b", 4),
        (r"\bPO\b", 3), (r"\border quantity\b", 3),
    ),
    "payment": (
        (r"\bpayment\b", 5), (r"\bpaid\b", 4), (r"\bbank (?:transfer|receipt|slip)\b", 4), (r"\bdeposit\b", 3),
        (r"\bbalance\b", 2), (r"\bT/T\b", 3),
    ),
    "production": (
        (r"\bproduction\b", 5), (r"\blead time\b", 4), (r"\bready (?:date|time)\b", 3),
        (r"\bmanufactur(?:e|ing) progress\b", 4), (r"\bcompletion date\b", 4),
    ),
    "shipping": (
        (r"\bshipping\b", 5), (r"\bshipment\b", 5), (r"\btracking (?:number|information)\b", 4),
        (r"\bbill of lading\b", 4), (r"\bdelivery date\b", 3), (r"\bETA\b", 3), (r"\bfreight\b", 3),
    ),
    "complaint": (
        (r"\bcomplaint\b", 6), (r"\bdefective\b", 6), (r"\bdamaged\b", 5), (r"\bquality (?:issue|problem)\b", 5),
        (r"\bwrong (?:item|product|color|size)\b", 4), (r"\bmissing (?:item|quantity|pieces?)\b", 4),
        (r"\bnot satisfied\b", 4),
    ),
    "follow-up": (
        (r"\bfollow(?:ing)? up\b", 5), (r"\bany update\b", 4),
        (r"\bwaiting for your (?:reply|response|feedback)\b", 4), (r"\bhave you (?:checked|reviewed|decided)\b", 3),
        (r"\bget back to me\b", 3), (r"\breminder\b", 3),
    ),
}
SCENARIO_LABELS = {
    "inquiry": "询盘", "quotation": "报价", "sample": "样品", "negotiation": "议价", "order": "订单", "payment": "付款",
    "production": "生产", "shipping": "运输", "complaint": "投诉", "follow-up": "跟进",
}
BASE_CONFIDENCE, CONFIDENCE_STEP, TOP_CONFIDENCE, UNMATCHED_CONFIDENCE = 0.46, 0.06, 0.98, 0.25
TASKS_PER_CORE = 4

# Reply texts: what is acknowledged and what comes next, per class; a closing line per tone.
REPLY_COPY = {
    "inquiry": (
        "Thank you for your interest in our products.",
        "To recommend the right option, could you share the product specifications, expected quantity, application, "
        "and destination market?"),
    "quotation": (
        "Thank you for your quotation request.",
        "Please confirm the product or model, quantity, destination, and preferred trade term so I can prepare an "
        "accurate offer."),
    "sample": (
        "Thank you for asking about a sample.",
        "Please confirm the required model, quantity, customization details, delivery address, and preferred courier "
        "so I can check the sample cost and lead time."),
    "negotiation": (
        "Thank you for sharing your target and concerns about the offer.",
        "Could you confirm the target quantity, required specification, delivery schedule, and target price? I will "
        "review the workable options based on the complete terms."),
    "order": (
        "Thank you for moving forward with the order.",
        "Please send or confirm the purchase order, product details, quantities, consignee information, and requested "
        "delivery date so I can check everything before confirmation."),
    "payment": (
        "Thank you for the payment update.",
        "Please share the order or invoice number and the payment reference. I will verify the status and update you "
        "after confirmation."),
    "production": (
        "Thank you for checking the production status.",
        "Please confirm the order number and required delivery date. I will check the latest schedule and report any "
        "item that may affect completion."),
    "shipping": (
        "Thank you for checking the shipment.",
        "Please confirm the order or shipment number and the documents or tracking details you need. I will verify the "
        "latest logistics status."),
    "complaint": (
        "I am sorry to hear about this issue, and thank you for bringing it to our attention.",
        "Please share the order number, affected quantity, photos or video, packaging condition, and a short "
        "description of the problem. I will review the evidence and respond with the next step."),
    "follow-up": (
        "Thank you for following up.",
        "Please let me know which quotation, sample, or order you are referring to, and I will check the current status "
        "and reply with a clear next step."),
}
TONE_LINES = {
    "concise": "I will keep the follow-up brief and focused.",
    "professional": "I appreciate the opportunity to support your request.",
    "warm": "We value your time and look forward to helping you move this forward.",
}
SYSTEM_LINES = (
    "You are an experienced B2B export sales communication assistant.",
    "Write one ready-to-send English reply based only on the supplied facts.",
    "Do not invent prices, lead times, certifications, stock, payment status, shipping status, or promises.",
    "Ask concise clarification questions where facts are missing.",
)
# Characters the interactive tool keeps of each part of a reply or prompt.
TOOL_LIMITS = {"customer_name": 80, "customer_company": 120, "customer_country": 80, "customer_notes": 500, "text": 8000, "signature": 300,
               "industry_profile": 500, "company_profile": 500}
# ---- end of fixed values ----


def classify_messages(messages: DataFrame, scenarios=None, column: str = "text") -> DataFrame:
    """Adds scenario_id, score, confidence and the matched words to every message.

    No join with a pattern table. Each pattern is tried once per message; messages are spread over all cores first, since the
    patterns cost far more than the move and a small file is a single partition.
    """
    scenarios = scenarios or SCENARIOS
    body = F.coalesce(t.trimmed(column), F.lit(""))
    staged = once(messages.repartition(TASKS_PER_CORE * messages.sparkSession.sparkContext.defaultParallelism), _body=body)

    def found(pattern: str) -> Column:
        return F.regexp_extract("_body", f"(?i)({t.ascii_regex(pattern)})", 1)

    staged = once(staged, **{f"_words{i}": F.array(*[found(p) for p, _ in patterns]) for i, patterns in enumerate(scenarios.values())})

    def rate(name: str, position: int) -> Column:
        hits = F.transform(f"_words{position}", lambda word, i: F.struct(word.alias("word"), F.array(*[F.lit(w) for _, w in scenarios[name]])[i].alias("weight")))
        matched = F.filter(hits, lambda h: h["word"] != "")
        score = F.aggregate(matched, F.lit(0), lambda total, h: total + h["weight"])
        words = F.array_distinct(F.transform(matched, lambda h: h["word"]))
        return F.struct(score.alias("score"), F.lit(-position).alias("order"), F.lit(name).alias("scenario_id"),
                        words.alias("words"))

    rated = once(staged, _best=F.array_max(F.array(*[rate(n, i) for i, n in enumerate(scenarios)])))
    first = next(iter(scenarios))
    score = F.col("_best.score")
    confidence = (
        F.when(F.col("_body") == "", 0.0).when(score == 0, UNMATCHED_CONFIDENCE)
        .otherwise(F.least(F.lit(TOP_CONFIDENCE), BASE_CONFIDENCE + score * CONFIDENCE_STEP)))
    return rated.select(
        *messages.columns, F.when(score > 0, F.col("_best.scenario_id")).otherwise(first).alias("scenario_id"),
        score.alias("score"), confidence.alias("confidence"),
        F.when(score > 0, F.col("_best.words")).otherwise(F.array().cast("array<string>")).alias("matched"))


def _pick(code: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(table[default])
    for key, value in table.items():
        out = F.when(code == key, F.lit(value)).otherwise(out)
    return out


def _part(column: str, limits: dict[str, int] | None) -> Column:
    return t.squeezed(column, (limits or {}).get(column))


def background(limits: dict[str, int] | None = None) -> Column:
    """The one business background the mode selects, null when there is none."""
    chosen = F.when(F.col("mode") == "industry", _part("industry_profile", limits)).when(F.col("mode") == "company", _part("company_profile", limits))
    return F.concat(F.lit("Relevant background: "), chosen)


def template_replies(rows: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Adds `reply`. Columns used: scenario_id, customer_name, industry_profile, company_profile, signature,
    mode, tone. All are kept whole unless `limits` (as TOOL_LIMITS) names them."""
    name, signature = _part("customer_name", limits), _part("signature", limits)
    scenario = F.col("scenario_id")
    return rows.withColumn("reply", F.concat_ws(
        "\n\n",
        F.coalesce(F.concat(F.lit("Dear "), name, F.lit(",")), F.lit("Hello,")),
        _pick(scenario, {k: v[0] for k, v in REPLY_COPY.items()}, "inquiry"),
        background(limits),
        _pick(scenario, {k: v[1] for k, v in REPLY_COPY.items()}, "inquiry"),
        _pick(F.col("tone"), TONE_LINES, "professional"),
        F.coalesce(F.concat(F.lit("Best regards,\n"), signature), F.lit("Best regards,"))))


def reply_prompts(rows: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Adds `messages`, the system and user message a reply would be written from.

    Only the background the mode selects is included. Further columns used: text, customer_company,
    customer_country, customer_notes. All are kept whole unless `limits` (as TOOL_LIMITS) names them.
    """
    def line(label: str, column: str) -> Column:
        return F.concat(F.lit(label), _part(column, limits))

    details = F.nullif(F.concat_ws(
        "\n", line("Contact: ", "customer_name"), line("Company: ", "customer_company"),
        line("Market: ", "customer_country"), line("Notes: ", "customer_notes")), F.lit(""))
    scenario = F.col("scenario_id")
    tone = F.concat(F.lit("Use a "), F.col("tone"),
                    F.lit(" tone. Return only the email or chat reply, without analysis or labels."))
    system = F.concat_ws(" ", *[F.lit(s) for s in SYSTEM_LINES], tone)
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Detected stage: "), _pick(scenario, SCENARIO_LABELS, "inquiry"), F.lit(" ("),
                 F.when(scenario.isin(*SCENARIO_LABELS), scenario).otherwise("inquiry"), F.lit(")")),
        F.concat(F.lit("Customer message:\n"), F.coalesce(_part("text", limits), F.lit(""))),
        F.concat(F.lit("Customer profile:\n"), F.coalesce(details, F.lit("No customer profile is available."))),
        F.coalesce(background(limits), F.lit("No additional business background was selected.")),
        F.coalesce(F.concat(F.lit("Signature:\n"), _part("signature", limits)), F.lit("No signature was provided.")))
    return rows.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))


def completion_text(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Adds `content`, the trimmed text of the first choice, and `refusal` where there is none."""
    content = t.text(F.get_json_object(column, "$.choices[0].message.content"))
    return rows.withColumn("content", content).withColumn(
        "refusal", F.when(F.col("content").isNull(), "no-content"))

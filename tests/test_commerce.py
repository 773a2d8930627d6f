import json

import pytest
from pyspark.sql import functions as F

from leadloom import model
from leadloom.operators import crm, governance, messages, scoring, trade
from leadloom.sources import store
from leadloom.sources.documents import read_lead_documents
from leadloom.streaming import events as streaming
from tests.fixtures import leads, rows, write

CASES = [
    ("We are interested in your product range. Please send a catalogue.", "inquiry"), ("Could you quote your best FOB price for 2,000 units?", "quotation"),
    ("Can you send two samples and advise the sample shipping cost?", "sample"), ("The offer is too expensive. Can you meet our target price?", "negotiation"),
    ("We are ready to place an order and will send the purchase order today.", "order"), ("The deposit has been paid by bank transfer. Please check the payment.", "payment"),
    ("Please update us on the production progress and completion date.", "production"), ("Do you have the tracking number and latest shipment ETA?", "shipping"),
    ("The cartons arrived damaged and several pieces are defective.", "complaint"), ("Just following up. Have you reviewed our request?", "follow-up"),
    ("Hello there", "inquiry"), ("   ", "inquiry"), ("éPOé and ETAs", "order"), ("POs and ETAs", "inquiry"), ("PO. po", "order")]


def at(value="2026-09-08T00:00:00Z"):
    return F.lit(value).cast("timestamp")


def test_labelled_messages(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CASES)], "id int, text string")
    got = messages.classify_messages(df).orderBy("id").collect()
    assert [r.scenario_id for r in got] == [s for _, s in CASES]
    assert all(r.confidence >= 0.5 for r in got[:10]) and [r.confidence for r in got[10:12]] == [0.25, 0.0]
    assert got[8].matched == ["defective", "damaged"] and max(r.confidence for r in got) <= 0.98 and got[14].matched == ["PO"]


def test_messages_of_one_partition_are_spread_and_tried_once(spark):
    df = spark.createDataFrame([(i, "two samples please") for i in range(200)], "id int, text string").coalesce(1)
    got = messages.classify_messages(df)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == sum(len(p) for p in messages.SCENARIOS.values())
    assert {(r.scenario_id, r.score) for r in got.collect()} == {("sample", 5)}


def test_replies_and_prompts(spark):
    df = spark.createDataFrame([("complaint", "Kim", None, None, "", "broken box", "we make bottles", "secret plan", "Sam", "industry", "warm"),
                                ("unknown", None, None, None, None, "hi", "", "", None, "company", "odd")],
                               "scenario_id string, customer_name string, customer_company string, customer_country string, customer_notes string, text string, "
                               "industry_profile string, company_profile string, signature string, mode string, tone string")
    first, second = messages.template_replies(df).collect()
    assert first.reply.startswith("Dear Kim,\n\nI am sorry") and "Relevant background: we make bottles" in first.reply and first.reply.endswith("Best regards,\nSam")
    assert second.reply.startswith("Hello,\n\nThank you for your interest") and messages.TONE_LINES["professional"] in second.reply and "background" not in second.reply
    prompt = messages.reply_prompts(df).first().messages
    assert [m.role for m in prompt] == ["system", "user"] and "we make bottles" in prompt[1].content and "secret plan" not in str(prompt)
    payloads = spark.createDataFrame([('{"choices":[{"message":{"content":"  Dear Kim  "}}]}',), ('{"choices":[]}',), ("no json",)], "payload string")
    assert [(r.content, r.refusal) for r in messages.completion_text(payloads).collect()] == [("Dear Kim", None), (None, "no-content"), (None, "no-content")]


def imported(spark, tmp_path, customers, *docs):
    tables = leads(spark, tmp_path, list(docs))
    effective = scoring.effective_evidence(tables.evidence, tables.reviews)
    incoming = crm.import_rows(tables.leads, scoring.qualify(tables.leads, effective), effective, at())
    merged = crm.merge_import(customers, incoming, at())
    return merged, incoming


def test_import_updates_managed_fields_only(spark, tmp_path):
    doc = {"id": "lead", "source": "Alibaba", "sourceReference": "R", "organization": {"name": "Velmora", "country": "Norvania"},
           "contact": {"name": "Alex", "email": "A@velmora.example"}, "inquiry": {"product": "Bottle", "quantity": "10"},
           "evidence": [{"kind": "factory", "value": "x", "sourceRef": "s", "status": "rejected"}, {"kind": "factory", "value": "y", "sourceRef": "s"}]}
    merged, incoming = imported(spark, tmp_path, crm.empty_customers(spark), doc)
    c = merged.first()
    assert (c.change, c.name, c.email, c.profile.evidence_count, c.notes) == ("imported", "Alex", "a@velmora.example", 1, "产品：Bottle\n数量：10\n下一步：keep-record")
    assert c.managed == {"name": "Alex", "company": "Velmora", "country": "Norvania", "email": "a@velmora.example"}
    assert tuple(crm.import_counts(merged, incoming).first()) == (1, 0)

    stored = merged.drop("change")
    edit = spark.createDataFrame([("lead", "Alexandra", "Velmora", "Norvania", "a@velmora.example", "", "own note")],
                                 "customer_id string, name string, company string, country string, email string, whatsapp string, notes string")
    edited = crm.edit_customers(stored, edit, at("2026-09-09"))
    assert set(edited.first().managed) == {"company", "country", "email"}
    again, incoming = imported(spark, tmp_path, edited, {**doc, "contact": {"name": "Someone", "email": ""}, "organization": {"name": "Velmora Ltd", "country": "Norvania"}})
    c = again.first()
    assert (c.change, c.name, c.company, c.email, c.notes) == ("updated", "Alexandra", "Velmora Ltd", "", "own note")
    assert c.managed == {"company": "Velmora Ltd", "country": "Norvania"}


def test_old_customers_and_replies(spark):
    old = spark.createDataFrame([(" c1 ", "Kim", "K@X.example", {"name": "Kim", "odd": "x", "email": "K@X.example", "company": " "})], "customer_id string, name string, email string, managed map<string,string>")
    c = crm.migrate_customers(old, at()).first()
    assert (c.customer_id, c.email, c.managed, c.notes, c.profile) == ("c1", "k@x.example", {"name": "Kim", "email": "k@x.example"}, "", None)
    shape = "workspace_id string, reply_id string, created_at timestamp, customer_id string, inbound string, scenario_id string, reply string, mode string, provider string"
    log = spark.createDataFrame([("w", f"r{i}", None, "c", "in", None, "out", None, "ai") for i in range(4)], shape).withColumn(
        "created_at", F.expr("timestampadd(DAY, cast(substring(reply_id, 2) as int), timestamp'2026-01-01')"))
    kept = crm.append_replies(log.where("reply_id < 'r2'"), log.where("reply_id >= 'r2'"), keep=3)
    assert sorted(r.reply_id for r in crm.remove_replies(kept, log.where("reply_id = 'r3'")).collect()) == ["r1", "r2"]


LINE = "order_id string, line_no int, sku string, name string, specification string, quantity string, unit string, unit_price string, carton_count string, gross_weight_kg string, net_weight_kg string"
PARTY = "struct<name:string,address:string,contact:string>"


def orders(spark, buyer="Buyer", lines=(("2000", "4.5", "100"),)):
    checked = trade.check_lines(spark.createDataFrame(
        [("o", i + 1, "SKU", "Bottle", None, q, "", p, c, "12.5", "") for i, (q, p, c) in enumerate(lines)], LINE))
    head = spark.createDataFrame([("o", ("Maker", "Road", "Sam"), (buyer, "Street", "Kim"), "usd", None, None, None, None, "REF", "handle with care")],
                                 f"order_id string, supplier {PARTY}, buyer {PARTY}, currency string, incoterm string, payment_terms string, validity_days string, issue_date string, reference string, notes string")
    return trade.check_orders(head, trade.order_totals(checked), at()), checked


def test_trade_documents(spark):
    checked, lines = orders(spark)
    o = checked.first()
    assert (o.refusal, float(o.amount), float(o.cartons), o.currency, o.validity_days) == (None, 9000.0, 100.0, "USD", 30)
    documents = trade.trade_documents(checked)
    got = {r.type: r for r in documents.collect()}
    assert len(got) == 6 and all(d.status == "draft" for d in got.values())
    assert got["product-catalog"].total_amount is None and got["packing-list"].total_cartons is not None and got["quotation"].reference == "REF-QUOTATION"
    texts = {r.type: r.text for r in trade.document_texts(documents, lines).collect()}
    assert "SKU | Bottle | - | 2000 pcs | USD 4.5 | USD 9000" in texts["quotation"] and "Total: USD 9000" in texts["quotation"] and "Validity: 30 days" in texts["quotation"]
    assert "4.5" not in texts["packing-list"] and "Packing: 100 cartons; G.W. 12.5 kg; N.W. 0.01 kg" in texts["packing-list"]
    assert "Unit price" not in texts["product-catalog"] and "Buyer" not in texts["product-catalog"] and all("\n\n" not in x and "DRAFT" in x for x in texts.values())


def test_numbers_of_lines_are_written_once_for_all_documents(spark):
    checked, lines = orders(spark)
    documents, lines = (spark.createDataFrame(df.collect(), df.schema) for df in (trade.trade_documents(checked), lines))
    plan = trade.document_texts(documents, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * (6 + 4)  # six numbers of a line, four of a document


@pytest.mark.parametrize("change, code", [({"buyer": " "}, "buyer-name-missing"), ({"lines": (("5", "0", "1"),)}, "bad-line"), ({"lines": (("x", "1", "1"),)}, "bad-line"),
                                          ({"lines": ()}, "no-lines"), ({"lines": (("1", "1", "1"),) * 101}, "too-many-lines")])
def test_unusable_orders(spark, change, code):
    checked, _ = orders(spark, **change)
    assert checked.first().refusal == code and trade.trade_documents(checked).count() == 0


def test_scans_and_pruning(spark):
    df = spark.createDataFrame([(1, "-----BEGIN PRIVATE KEY----- sk-" + "a" * 20), (2, "clean"), (3, "z" * 5000 + " ghp_" + "A" * 30)], "id int, text string")
    assert {(r.id, r.rule) for r in governance.rule_hits(df, "text").collect()} == {(1, "private-key"), (1, "service-key"), (3, "repository-token")}
    nested = spark.createDataFrame([(1, ("x", "y"), [("k", "t")], {"cookie": "c", "a": "b"})],
                                   "id int, body struct<name:string,apiKey:string>, items array<struct<k:string,token:string>>, extra map<string,string>")
    kept = governance.without_sensitive(nested)
    assert kept.first().asDict(recursive=True) == {"id": 1, "body": {"name": "x"}, "items": [{"k": "k"}], "extra": {"a": "b"}}


def test_snapshots_restore_into_a_new_workspace(spark, tmp_path):
    tables = leads(spark, tmp_path, [{"id": "a", "source": "s", "organization": {"name": "N"}}])
    path = str(tmp_path / "store")
    manifest = store.snapshot(tables, path, "ws_main01", "Main", at(), "2026-09-08")
    assert {r.table: r.rows for r in manifest.collect()}["leads"] == 1 and {r.schema_version for r in manifest.collect()} == {model.SCHEMA_VERSION}
    again = store.snapshot(tables, path, "ws_main01", "Main", at(), "2026-09-08")
    assert again.count() == 7
    assert store.restore(spark, path, "2026-09-08", "ws_main01", "ws_copy01").leads.first().organization.name == "N"
    for target in ("ws_main01", "bad id"):
        with pytest.raises(store.WorkspaceError):
            store.restore(spark, path, "2026-09-08", "ws_main01", target)
    newer = again.withColumn("schema_version", F.lit(99)).drop("workspace_id")
    newer.write.parquet(f"{path}/snapshot=newer/manifest/workspace_id=ws_main01")
    with pytest.raises(store.WorkspaceError, match="newer"):
        store.restore(spark, path, "newer", "ws_main01", "ws_copy01")
    refs = spark.createDataFrame([("ws_main01", "Other"), ("ws_else01", "main"), ("ws_else01", "Other"), (None, None)], "id string, name string")
    assert [r.refusal for r in store.workspace_refusals(refs, "ws_main01", "Main").collect()] == [None, None, "other-workspace", None]
    with pytest.raises(store.WorkspaceError):
        store.check_workspace("ws_main01", " ")


EVENT = "lead_id string, event_id string, seq bigint, type string, occurred_at string, due_at string, related_event_id string"


def arrive(spark, folder, number, *events):
    data = [(l, e, s, k, o, d, r) for l, e, s, k, o, d, r in events]
    typed = spark.createDataFrame(data, EVENT).select(
        "lead_id", "event_id", "seq", "type", F.col("occurred_at").cast("timestamp"), F.lit(None).cast("string").alias("channel"), F.lit("words").alias("note"),
        F.col("due_at").cast("timestamp"), "related_event_id", F.lit(None).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("outcome_reason"))
    typed.coalesce(1).write.mode("append").parquet(folder)


def test_streams_follow_late_and_void_events(spark, tmp_path):
    folder, log, state, remind = (str(tmp_path / n) for n in ("in", "log", "state", "remind"))

    def run():
        stream = spark.readStream.schema(model.EVENT_DDL).parquet(folder)
        streaming.maintain_states(stream, log, state, str(tmp_path / "c1"), at("2026-09-30")).awaitTermination()
        streaming.remind_overdue(spark.readStream.schema(model.EVENT_DDL).parquet(folder), log + "2", remind, str(tmp_path / "c2")).awaitTermination()
        return {r.lead_id: r.stage for r in streaming.current_states(spark, state).collect()}, sorted(r.event_id for r in streaming.reminders(spark, remind).collect())

    arrive(spark, folder, 1, ("a", "e1", 1, "quote-sent", "2026-09-05", None, None), ("b", "e2", 2, "lost", "2026-09-05", None, None),
           ("a", "f1", 3, "follow-up-scheduled", "2026-09-05", "2026-09-07", None), ("a", "f2", 4, "follow-up-scheduled", "2026-09-05", "2026-09-20", None))
    assert run() == ({"a": "quoted", "b": "lost"}, [])
    arrive(spark, folder, 2, ("a", "v", 5, "activity-voided", "2026-09-06", None, "e1"), ("b", "e3", 6, "contact-attempted", "2026-09-01", None, None), ("a", "e1", 1, "quote-sent", "2026-09-05", None, None))
    assert run() == ({"a": "new", "b": "lost"}, [])
    arrive(spark, folder, 3, ("b", "e4", 7, "reopened", "2026-09-08", None, None))
    assert run() == ({"a": "new", "b": "contacted"}, ["f1"])
    arrive(spark, folder, 4, ("b", "e5", 8, "note", "2026-09-25", None, None))
    assert run() == ({"a": "new", "b": "contacted"}, ["f1", "f2"])


def test_stream_links_reach_every_member_of_a_block(spark, tmp_path):
    folder = str(tmp_path / "keys")
    for batch in (["a", "b"], ["c"], ["b", "d", "e"]):
        spark.createDataFrame([("k", x, 0.95, "same-domain") for x in batch], "key string, account_id string, confidence double, reason string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("key string, account_id string, confidence double, reason string").parquet(folder)
        streaming.link_new_members(stream, str(tmp_path / "m"), str(tmp_path / "l"), str(tmp_path / "c")).awaitTermination()
    assert {(r.left_id, r.right_id) for r in streaming.new_links(spark, str(tmp_path / "l")).collect()} == {("a", x) for x in "bcde"}


def test_lead_documents_keep_reviews_decisions_and_events(spark, tmp_path):
    doc = {"id": "x", "source": "s", "evidence": [{"id": "e", "kind": "factory", "value": "v", "sourceRef": "s", "review": {"decision": "rejected", "reviewedAt": "2026-09-08", "note": "no longer there"}}],
           "duplicateReviews": [{"otherLeadId": "y", "decision": "same", "primaryLeadId": "x", "reviewedAt": "2026-09-08"}, {"otherLeadId": "y", "decision": "same"}],
           "fieldOrigins": [{"path": "organization.employeeRange", "evidenceId": "e"}, {"path": "organization.secret", "evidenceId": "e"}],
           "development": {"events": [{"type": "won", "occurredAt": "2026-09-08"}, {"type": "odd", "occurredAt": "2026-09-08"}], "qualificationBaseline": {"grade": "a", "score": "x", "capturedAt": "2026-09-08"}}}
    tables = read_lead_documents(spark, write(tmp_path / "l.json", json.dumps([doc])))
    assert (tables.reviews.count(), tables.decisions.count(), tables.events.count(), tables.baselines.count()) == (1, 1, 1, 0)
    assert [r.path for r in tables.origins.collect()] == ["organization.employee_range"]
    assert rows(scoring.effective_evidence(tables.evidence, tables.reviews)) == []

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dedup, scoring
from leadloom.sources import inquiry_csv as csv
from tests.fixtures import INQUIRIES, rows, write


def qualified(tables):
    return scoring.qualify(tables.leads, scoring.effective_evidence(tables.evidence, tables.reviews))


def review(spark, path, channel="auto", field_map=None):
    headers = csv.read_headers(spark, path)
    data = csv.read_rows(spark, path, headers)
    return csv.review_import(data, csv.map_headers(headers, field_map), channel)


def test_sample_inquiries_get_their_known_grades(spark, tmp_path):
    tables = csv.read_leads(spark, write(tmp_path / "i.csv", INQUIRIES))
    got = qualified(tables).join(tables.leads, "lead_id").orderBy("ordinal").select(
        "score", "grade", *scoring.DIMENSIONS, "reasons").collect()
    assert [(r.score, r.grade) for r in got] == [(71, "B"), (27, "D"), (0, "HOLD"), (37, "C")]
    assert tuple(got[0][2:6]) == (22, 25, 17, 7)
    assert tuple(got[1][2:6]) == (5, 11, 6, 5)
    assert got[2].reasons == ["do-not-contact", "no-identity"]
    assert tuple(got[3][2:6]) == (5, 21, 6, 5)


def test_sample_inquiries_have_one_duplicate_candidate(spark, tmp_path):
    tables = csv.read_leads(spark, write(tmp_path / "i.csv", INQUIRIES))
    effective = scoring.effective_evidence(tables.evidence, tables.reviews)
    found = rows(dedup.duplicate_candidates(tables.leads, effective))
    assert len(found) == 1
    assert found[0]["confidence"] == 0.95 and found[0]["hold_recommended"]
    assert found[0]["reasons"] == ["same-domain"]


def test_sample_evidence_and_origins(spark, tmp_path):
    tables = csv.read_leads(spark, write(tmp_path / "i.csv", INQUIRIES))
    first = tables.leads.where("ordinal = 0").select("lead_id")
    kinds = rows(tables.evidence.join(first, "lead_id").select("seq", "kind", "status", "confidence"), "seq")
    assert [(k["kind"], k["status"], k["confidence"]) for k in kinds] == [
        ("source-record", "verified", 1.0), ("company-website", "verified", 1.0),
        ("business-registration", "verified", 1.0), ("factory", "candidate", 0.5),
        ("business-email", "candidate", 0.5), ("whatsapp", "candidate", 0.5)]
    paths = [r["path"] for r in rows(tables.origins.join(first, "lead_id"), "seq")]
    assert paths == ["organization.website", "organization.registration_id", "organization.factory_info",
                     "contact.email", "contact.whatsapp"]


def test_quoted_commas_and_line_breaks_stay_in_the_cell(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'company_name,message\n"Demo Co","Need 2,000 units,\nFOB Shanghai"\n')
    lead = csv.read_leads(spark, path).leads.first()
    assert lead.organization.name == "Demo Co"
    assert lead.inquiry.message == "Need 2,000 units,\nFOB Shanghai"


def test_chinese_headers_and_channel(spark, tmp_path):
    path = write(tmp_path / "zh.csv", "询盘编号,公司名称,买家姓名,国家/地区,询盘内容,产品名称,采购数量,工作邮箱\n"
                 "DEMO-CN-01,虚构采购公司,林样例,示例国,请报价,收纳盒,500,buyer@example.com\n")
    lead = csv.read_leads(spark, path, "alibaba").leads.first()
    assert (lead.source, lead.source_reference) == ("Alibaba", "DEMO-CN-01")
    assert (lead.organization.name, lead.contact.name) == ("虚构采购公司", "林样例")
    assert (lead.inquiry.product, lead.inquiry.quantity, lead.contact.email) == ("收纳盒", "500", "buyer@example.com")
    assert lead.signals.explicit_inquiry


def test_unknown_column_is_reported_and_import_allowed(spark, tmp_path):
    path = write(tmp_path / "u.csv", "询盘编号,公司名称,国家/地区,询盘内容,产品名称,工作邮箱,平台备注\n"
                 "DEMO-101,虚构采购公司,示例国,请提供报价,收纳盒,buyer@example.com,仅作虚构测试\n")
    got = review(spark, path, "alibaba")
    summary = got.summary.first()
    assert (summary.row_count, summary.usable_rows, summary.can_import) == (1, 1, True)
    assert summary.unmapped_headers == ["平台备注"]
    assert got.columns.where("header = '公司名称'").first().samples == ["虚构采购公司"]


def test_explicit_map(spark, tmp_path):
    path = write(tmp_path / "m.csv", "Buyer Organization,Ticket,Body,Requested Item,Unneeded Column\n"
                 "Velmora Home Goods,DEMO-102,Please quote 500 units,Enamel lantern,ignore me\n")
    assert not review(spark, path, "made-in-china").summary.first().can_import
    field_map = {"Buyer Organization": "company_name", "Ticket": "source_reference", "Body": "message",
                 "Requested Item": "product", "Unneeded Column": ""}
    summary = review(spark, path, "made-in-china", field_map).summary.first()
    assert summary.can_import and summary.mapped_fields == 4 and summary.unmapped_headers == ["Unneeded Column"]
    lead = csv.read_leads(spark, path, "made-in-china", field_map).leads.first()
    assert (lead.source, lead.source_reference, lead.notes) == ("Made-in-China", "DEMO-102", None)


def test_duplicate_targets_and_weak_traceability(spark, tmp_path):
    path = write(tmp_path / "d.csv", "Company,公司名称,Product\n,虚构采购公司,Storage box\nVelmora Home Goods,,\n")
    got = review(spark, path)
    s = got.summary.first()
    assert s.can_import and s.duplicate_targets == ["company_name"]
    assert (s.missing_reference_rows, s.missing_inquiry_rows, s.missing_contact_rows) == (2, 1, 2)
    assert {"duplicate-targets", "missing-reference", "missing-contact", "no-source"} <= set(s.warnings)
    names = {r.organization.name for r in csv.read_leads(spark, path).leads.collect()}
    assert names == {"虚构采购公司", "Velmora Home Goods"}


def test_structural_errors_block_the_import(spark, tmp_path):
    with pytest.raises(ValueError, match="unclosed quote"):
        csv.read_leads(spark, write(tmp_path / "open.csv", 'Company,Message\n"Unclosed,Please quote'))
    cases = {"Unknown\nvalue\n": "no-mapped-field", "Company\n": "no-rows",
             ",Message\nDemo,Please quote\n": "blank-header", "Company,company\nDemo,Duplicate\n": "duplicate-header"}
    for i, (text, code) in enumerate(cases.items()):
        s = review(spark, write(tmp_path / f"bad{i}.csv", text)).summary.first()
        assert not s.can_import and code in s.errors
    with pytest.raises(ValueError, match="unsupported"):
        csv.map_headers(["Unknown"], {"Unknown": "private_internal_field"})


def test_short_and_long_rows_are_counted(spark, tmp_path):
    path = write(tmp_path / "w.csv", 'company,product,message\nA,x,"one, two"\nB,y\nC,z,"q, r",extra\n,,\n')
    s = review(spark, path).summary.first()
    assert (s.row_count, s.short_rows, s.long_rows) == (3, 1, 1)


def test_two_samples_in_first_seen_order(spark, tmp_path):
    body = "\n".join(["company"] + ["B"] * 3 + ["A", "C", "B"] + ["x" * 100])
    got = review(spark, write(tmp_path / "s.csv", body + "\n")).columns.first()
    assert got.samples == ["B", "A"] and got.populated_rows == 7


def test_audit_holds_no_samples(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Company,Message,Private Column\nVelmora Home Goods,Please quote,secret words\n")
    got = review(spark, path, field_map={"Company": "company_name", "Message": "message", "Private Column": ""})
    audit = csv.import_audit(got, F.lit("2026-09-08 17:00:00").cast("timestamp"), "import-1")
    row = audit.first()
    assert row.schema_version == 1 and [m.field for m in row.mappings] == ["company_name", "message", None]
    assert "secret words" not in str(row)
    checked = csv.check_audit(audit.withColumn("schema_version", F.lit(2))).first()
    assert checked.refusal == "newer-version"


def test_reading_twice_gives_the_same_ids(spark, tmp_path):
    path = write(tmp_path / "i.csv", INQUIRIES)
    first = {r.lead_id for r in csv.read_leads(spark, path).leads.collect()}
    assert first == {r.lead_id for r in csv.read_leads(spark, path).leads.collect()} and len(first) == 4


def test_explicit_false_beats_a_message(spark, tmp_path):
    path = write(tmp_path / "e.csv", "company,message,explicit_inquiry\nA,hello,false\nB,hello,\nC,,\n")
    got = {r.organization.name: r.signals.explicit_inquiry for r in csv.read_leads(spark, path).leads.collect()}
    assert got == {"A": False, "B": True, "C": False}

"""Entries and characters are kept whole unless a limit is given."""

from pyspark.sql import functions as F

from leadloom.operators import crm, relationships, scoring
from leadloom.sources import inquiry_csv as csv
from tests.fixtures import leads as read, write
from tests.test_import import review


def at():
    return F.lit("2026-09-08").cast("timestamp")


def test_import_and_migration_keep_values_whole(spark, tmp_path):
    long = {"name": "n" * 100, "company": "c" * 200, "email": "e" * 300 + "@x.example", "notes": "o" * 1500}
    doc = {"id": "lead", "source": "Alibaba", "organization": {"name": long["company"]}, "contact": {"name": long["name"], "email": long["email"]}, "inquiry": {"product": "p" * 1500},
           "evidence": [{"kind": "factory", "value": f"v{i}", "sourceRef": f"s{i}"} for i in range(1200)]}
    tables = read(spark, tmp_path, [doc])
    effective = scoring.effective_evidence(tables.evidence, tables.reviews)
    qualified = scoring.qualify(tables.leads, effective)
    got = crm.import_rows(tables.leads, qualified, effective, at()).first()
    assert (got.name, got.company, got.email, got.profile.evidence_count) == (long["name"], long["company"], long["email"], 1200) and "p" * 1500 in got.notes
    cut = crm.import_rows(tables.leads, qualified, effective, at(), limits=crm.TOOL_LIMITS).first()
    assert (len(cut.name), len(cut.company), len(cut.email), len(cut.notes), cut.profile.evidence_count) == (80, 120, 254, 1000, 999)
    old = spark.createDataFrame([("c", *long.values(), {"company": long["company"], "email": long["email"]})], "customer_id string, name string, company string, email string, notes string, managed map<string,string>")
    c = crm.migrate_customers(old, at()).first()
    assert (c.name, c.company, c.email, c.notes) == tuple(long.values()) and c.managed == {"company": long["company"], "email": long["email"]}
    assert len(crm.migrate_customers(old, at(), crm.TOOL_LIMITS).first().managed["company"]) == 120


def test_paths_decisions_reviews_and_audits_keep_all_entries(spark, tmp_path):
    ids = [f"e{i}" for i in range(30)]
    path = spark.createDataFrame([("c", "C", "t", "T", "5", None, "true", "", "", "", "approved", "|".join(ids))],
        "connector_id string, connector_name string, target_id string, target_name string, relationship_strength string, last_contact_at string, known_personally string, shared_company string, shared_industry string, shared_education string, consent_status string, evidence_ids string")
    assert relationships.normalize_paths(path).first().evidence_ids == ids and len(relationships.normalize_paths(path, 20).first().evidence_ids) == 20
    judged = {"decision": "accepted", "reviewedAt": "2026-09-01T00:00:00Z", "history": [{"action": "accepted", "reviewedAt": "2026-09-01T00:00:00Z"} for _ in range(70)]}
    doc = {"id": "lead", "source": "Alibaba", "evidence": [{"id": "e", "kind": "factory", "value": "v", "sourceRef": "s", "review": judged}],
           "duplicateReviews": [{"pairId": "p", "otherLeadId": "o", "decision": "distinct", "reviewedAt": "2026-09-01T00:00:00Z", "reasons": ids}]}
    tables = read(spark, tmp_path, [doc])
    assert tables.reviews.count() == 70 and tables.decisions.first().reasons == ids
    header = ",".join(["Company", *[f"Column {i}" for i in range(250)]])
    audit = csv.import_audit(review(spark, write(tmp_path / "wide.csv", header + "\nVelmora" + "," * 250 + "\n")), at(), "import-1").first()
    assert len(audit.mappings) == 251

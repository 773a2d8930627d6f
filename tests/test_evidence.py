import random

from pyspark.sql import functions as F

from leadloom import model
from leadloom.operators import evidence as ev, scoring
from tests.fixtures import leads, rows

SITE = {"id": "site", "kind": "company-website", "value": "https://velmora.example/about", "sourceRef": "https://velmora.example/about", "status": "verified"}
MAIL = {"id": "mail", "kind": "business-email", "value": "sales@velmora.example", "sourceRef": "https://velmora.example/contact", "status": "verified"}
ORIGINS = [{"path": "organization.website", "evidenceId": "site", "appliedValue": SITE["value"], "active": True},
           {"path": "contact.email", "evidenceId": "mail", "appliedValue": MAIL["value"], "active": True}]
LEAD = {"id": "lead", "source": "Manual", "sourceReference": "DEMO-REVIEW", "organization": {"name": "Typed name", "website": SITE["value"]},
        "contact": {"email": MAIL["value"]}, "inquiry": {"product": "Demo product"}, "evidence": [SITE, MAIL], "fieldOrigins": ORIGINS}
ACTION = "lead_id string, evidence_id string, seq bigint, action string, note string, value string, source_ref string, reviewed_at string"


def at(value="2026-09-08T01:00:00Z"):
    return F.lit(value).cast("timestamp")


def review(spark, tables, *items):
    data = [("lead", e, i + 1, a, more.get("note", "looked it up"), more.get("value"), more.get("source"), f"2026-09-08T0{i % 10}:00:00Z")
            for i, (e, a, more) in enumerate(items)]
    actions = spark.createDataFrame(data, ACTION).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    done = ev.review_evidence(tables.leads, tables.evidence, tables.reviews, tables.origins, actions)
    effects = {(r.seq, r.path): r.result for r in done["effects"].collect()}
    outcomes = [r.outcome for r in done["actions"].orderBy("seq").collect()]
    return done, outcomes, effects


def test_filling_keeps_typed_values_and_records_origins(spark, tmp_path):
    tables = leads(spark, tmp_path, [{**LEAD, "organization": {"name": "Typed name"}, "contact": {}, "evidence": [], "fieldOrigins": []}])
    added = leads(spark, tmp_path, [{**LEAD, "evidence": [SITE, MAIL, MAIL]}]).evidence
    patch = spark.createDataFrame(
        [("lead", "organization.website", SITE["value"], "site"), ("lead", "contact.email", " " + MAIL["value"], None), ("lead", "organization.name", "Registry name", None),
         ("lead", "contact.phone", "+1-555", "unknown"), ("lead", "contact.whatsapp", "  ", None)], "lead_id string, path string, value string, requested_id string")
    new, merged, origins = ev.attach_evidence(tables.leads, tables.evidence, tables.origins, added, patch, at())
    lead = new.first()
    assert (lead.organization.name, lead.organization.website, lead.contact.email, lead.contact.phone, lead.contact.whatsapp) == (
        "Typed name", SITE["value"], MAIL["value"], "+1-555", None)
    assert merged.count() == 2
    assert [(r["path"], r["evidence_id"]) for r in rows(origins, "path")] == [("contact.email", "mail"), ("organization.website", "site")]


def test_reject_clears_restore_refills_and_manual_edits_stay(spark, tmp_path):
    tables = leads(spark, tmp_path, [LEAD])
    before = scoring.qualify(tables.leads, scoring.effective_evidence(tables.evidence, tables.reviews)).first().score
    done, outcomes, effects = review(spark, tables, ("mail", "rejected", {}), ("site", "rejected", {}), ("site", "accepted", {}))
    lead = done["leads"].first()
    assert outcomes == ["accepted"] * 3
    assert effects == {(1, "contact.email"): "cleared", (2, "organization.website"): "cleared", (3, "organization.website"): "restored"}
    assert (lead.contact.email, lead.organization.website) == (None, SITE["value"])
    history = [r.action for r in done["reviews"].where("evidence_id = 'site'").orderBy("seq").collect()]
    assert history == ["rejected", "accepted"]
    origin = {r.path: r for r in done["origins"].collect()}
    assert (origin["contact.email"].active, origin["contact.email"].end_reason, origin["organization.website"].active) == (False, "evidence-rejected", True)
    after = scoring.qualify(done["leads"], scoring.effective_evidence(done["evidence"], done["reviews"])).first().score
    assert after < before

    edited = leads(spark, tmp_path, [{**LEAD, "contact": {"email": "manual@velmora.example"}}])
    done, _, effects = review(spark, edited, ("mail", "rejected", {}))
    assert effects == {(1, "contact.email"): "preserved"} and done["leads"].first().contact.email == "manual@velmora.example"
    assert done["origins"].where("path = 'contact.email'").first().end_reason == "field-changed"


def test_revision_updates_the_managed_field_and_logs_the_change(spark, tmp_path):
    tables = leads(spark, tmp_path, [LEAD])
    new = "https://velmora.example/company"
    done, outcomes, effects = review(
        spark, tables, ("site", "revised", {"value": new, "source": new}), ("site", "revised", {"value": new.upper()}), ("site", "revised", {"source": ""}),
        ("site", "rejected", {"note": "no"}), ("mail", "rejected", {}), ("mail", "revised", {"value": "other@x.example"}), ("none", "accepted", {}))
    assert outcomes == ["accepted", "nothing-changed", "source-missing", "note-too-short", "accepted", "evidence-is-rejected", "unknown-evidence"]
    assert effects == {(1, "organization.website"): "updated", (5, "contact.email"): "cleared"}
    assert done["leads"].first().organization.website == new
    row = done["evidence"].where("evidence_id = 'site'").first()
    assert (row.value, row.source_ref) == (new, new)
    change = done["reviews"].where("evidence_id = 'site'").first().changes["value"]
    assert (change["from"], change["to"]) == (SITE["value"], new)


def plain_review(value, origins, evidence, actions):
    state, decided, current, out = [dict(o) for o in origins], {}, value, []
    same = lambda a, b: (a or "").strip().lower() == (b or "").strip().lower()
    values = dict(evidence)
    for seq, (eid, action, more) in enumerate(actions, 1):
        if action == "revised":
            new = more["value"]
            if decided.get(eid) == "rejected" or same(new, values[eid]):
                continue
            old, values[eid] = values[eid], new
        else:
            decided[eid] = action
        for o in state:
            if o["eid"] != eid:
                continue
            unchanged, result = same(current, o["value"]), None
            if action == "rejected" and o["active"]:
                result, o["active"] = ("cleared" if unchanged else "preserved"), False
                current = None if unchanged else current
            elif action == "accepted" and not o["active"]:
                result = "restored" if unchanged or not current else "preserved"
                if result == "restored":
                    current, o["active"] = (current or o["value"]), True
            elif action == "revised" and o["active"] and same(o["value"], old):
                result = "updated" if unchanged else "preserved"
                if unchanged:
                    current = o["value"] = new
                else:
                    o["active"] = False
            if result:
                out.append((seq, result))
    return current, sorted(out)


def test_review_fold_equals_a_plain_walk_in_slices_of_any_size(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    texts = [f"v{i}@x.example" for i in range(4)]
    evidence = [{"id": f"m{i}", "kind": "business-email", "value": texts[i % 4], "sourceRef": "https://s.example", "status": "verified"} for i in range(4)]
    origins = [{"path": "contact.email", "evidenceId": f"m{i}", "appliedValue": texts[i % 4], "active": i % 2 == 0} for i in range(4)]
    tables = leads(spark, tmp_path, [{**LEAD, "contact": {"email": texts[0]}, "evidence": evidence, "fieldOrigins": origins}])
    actions = [(f"m{rnd.randint(0, 3)}", rnd.choice(["accepted", "rejected", "revised"]), {"value": rnd.choice(texts)}) for _ in range(40)]
    want = plain_review(texts[0], [{"eid": o["evidenceId"], "value": o["appliedValue"], "active": o["active"]} for o in origins],
                        {e["id"]: e["value"] for e in evidence}, actions)
    assert len({r for _, r in want[1]}) >= 3
    given = [(e, a, m if a == "revised" else {}) for e, a, m in actions]
    for bits in (9, 2, 0):
        monkeypatch.setattr(ev, "SLICE_BITS", bits)
        done, _, effects = review(spark, tables, *given)
        assert (done["leads"].first().contact.email, sorted((s, r) for (s, _), r in effects.items())) == want


def test_selection_keeps_status_and_fills_only_selected_fields(spark, tmp_path):
    facts = [SITE, {**MAIL, "status": "candidate"}, {"id": "f", "kind": "factory", "value": "Two lines", "sourceRef": "https://x.example"},
             {"id": "n", "kind": "organization-name", "value": "Name", "sourceRef": "https://x.example"}, {"id": "p", "kind": "business-phone", "value": "+1", "sourceRef": "https://x.example"}]
    evidence = leads(spark, tmp_path, [{**LEAD, "evidence": facts}]).evidence
    chosen = spark.createDataFrame([("lead", i) for i in ("site", "mail", "f")], "lead_id string, evidence_id string")
    kept, reviews, patch = ev.select_evidence(evidence, chosen, at())
    assert {r.path: r.value for r in patch.collect()} == {"organization.website": SITE["value"], "contact.email": MAIL["value"], "organization.factory_info": "Two lines"}
    assert {r.evidence_id: r.status for r in kept.collect()} == {"site": "verified", "mail": "candidate", "f": "candidate"}
    assert {r.decision for r in reviews.collect()} == {"accepted"}


def test_strong_lead_and_country_neutrality(spark, tmp_path):
    strong = {"id": "strong", "source": "Alibaba", "sourceReference": "DEMO-001", "organization": {"name": "Demo Buyer", "website": "https://buyer.example"},
              "contact": {"name": "Alex", "role": "Head of Buying", "email": "alex@buyer.example"},
              "inquiry": {"message": "Please quote", "product": "Enamel lantern", "quantity": "2000", "timeline": "30 days", "budget": "USD 4-5"},
              "signals": {s: True for s in ("explicitInquiry", "replied", "requestedQuote", "requestedSample", "mutualIntroduction")},
              "evidence": [{"kind": k, "value": k, "sourceRef": "s", "status": "verified"} for k in ("company-website", "business-registration", "factory", "business-email")]}
    base = {"sourceReference": "DEMO-003", "organization": {"name": "Same"}, "inquiry": {"product": "Part", "quantity": "100"}, "signals": {"explicitInquiry": True}}
    tables = leads(spark, tmp_path, [strong, {**base, "id": "a", "organization": {"name": "Same", "country": "A"}}, {**base, "id": "b", "organization": {"name": "Same", "country": "B"}},
                                     {"id": "hold", "organization": {"name": "Demo"}, "compliance": {"doNotContact": True}}])
    got = {r.lead_id: r for r in scoring.qualify(tables.leads, scoring.effective_evidence(tables.evidence, tables.reviews)).collect()}
    assert got["strong"].grade == "A" and got["strong"].score >= 75
    assert got["a"].score == got["b"].score and got["hold"].grade == "HOLD" and got["hold"].reasons == ["do-not-contact"]


def test_lead_documents_in_all_three_shapes(spark, tmp_path):
    import json

    from leadloom.sources.documents import read_lead_documents
    from tests.fixtures import write
    for i, payload in enumerate(([LEAD], {"leads": [LEAD]}, {"format": "any", "results": [{"lead": LEAD, "qualification": {}}]})):
        tables = read_lead_documents(spark, write(tmp_path / f"doc{i}.json", json.dumps(payload)))
        assert tables.leads.first().lead_id == "lead" and tables.evidence.count() == 2 and tables.origins.count() == 2
    assert set(dict(tables.items())) == {"leads", *model.CHILD_DDL}

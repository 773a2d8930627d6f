"""Time every registered query once at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadloom.plans import catalog  # noqa: E402
from leadloom.session import build_session  # noqa: E402

# The headline queries: one or two per area of the inventory.
HEADLINE = (
    "lead_qualification", "grade_histogram", "csv_leads", "import_summary", "dup_fingerprints", "dup_candidates", "dup_open",
    "dup_latest_decision", "master_links", "dev_state", "dev_funnel", "conversion_by_grade", "work_list", "evidence_merge", "evidence_fill",
    "registry_match", "mail_domains", "prospect_scores", "prospect_rank", "search_plans", "intro_paths", "intro_best_paths", "email_candidates",
    "email_assessment", "page_titles", "page_text", "page_emails", "page_links", "doc_contacts", "doc_rule_hits", "message_class",
    "template_replies", "crm_merge", "order_totals", "order_documents", "order_document_texts",
    # The heaviest ones.
    "dup_review_outcomes", "evidence_review", "dev_record_events", "site_walks", "stream_states", "stream_links",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["grade_histogram"](spark, folder).collect()  # start the JVM's compilers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else folder}))
    spark.stop()


if __name__ == "__main__":
    main()

"""The tables' schemas, as DDL. Columns are added at the end and nullable, so older files still read."""

from __future__ import annotations

TOKENS = "doc_id long, page_no int, token_seq long, text string, x long, y long, w long, h long, page_w long, page_h long"
PAGE_FINGERPRINTS = "doc_id string, page_no int, page_count int, visual_hash string, role string, signature struct<header_tokens:array<string>,summary_labels:array<string>,footer_tokens:array<string>,keyword_hits:map<string,array<string>>>"
FINGERPRINTS = "fingerprint_hash string, template_family_id string, status string, confidence double, apply_count long, reject_count long, gt_apply_count long, gt_reject_count long, gt_confidence double, page_roles array<string>, field_names array<string>, anchor_tokens array<string>, created_at timestamp, version string, table_enabled boolean, page_count int"
FAMILIES = "template_family_id string, provider_name string, country_code string, document_family string, status string, apply_count long, reject_count long, confidence double, gt_apply_count long, gt_reject_count long, gt_confidence double, page_count int, roles array<string>, fields array<string>, tokens array<string>, regions struct<header:array<string>,identity:array<string>,summary:array<string>,footer:array<string>,generic:array<string>>, split_pressure double, profile struct<table_engine:string,table_enabled:boolean,date_order:string,party_labels:array<string>>, field_override_count long, updated_at timestamp"
RESULTS = "id long, invoice_path string, invoice_name string, processed_at timestamp, route string, attempted_route string, status string, validation_passed boolean, validation_score double, validation_errors array<string>, template_family_id string, fingerprint_hash string, stage_status string, reconciliation_failure boolean, policy_failure boolean, family_match_outcome string, elapsed_ms long, peak_rss_mb double, quality_score double, healing_reprocessed boolean, error string"
FIELDS = "doc_id string, seq int, field string, value string"
LINE_ITEMS = "doc_id string, line_no int, description string, quantity string, unit_price string, amount string, net_amount string, gross_amount string, tax_rate string, tax_amount string"
RUNS = "id long, dataset string, started_at timestamp, total_invoices long, accepted long, rejected long, errors long"
RUN_INVOICES = "run_id long, invoice_name string, validation_passed boolean, validation_score double, route string, status string, validation_errors array<string>"
JOB_PROGRESS = "job_id string, done long, failed long, mean_accuracy double"
ANNOTATION = "struct<status:string,value:string,raw:string,evidence:string,confidence:double>"

TABLES = {"tokens": TOKENS, "page_fingerprints": PAGE_FINGERPRINTS, "fingerprints": FINGERPRINTS, "families": FAMILIES, "results": RESULTS, "fields": FIELDS, "line_items": LINE_ITEMS, "runs": RUNS, "run_invoices": RUN_INVOICES, "job_progress": JOB_PROGRESS}

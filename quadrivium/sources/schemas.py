"""Explicit schemas of every table; nothing is inferred and missing keys read as null."""

from __future__ import annotations

CONTENT_OBJECT = "course_name string, course_id string, container_name string, title string, content_type string, url string, due_date string, due_date_raw string, description string, subtext string, extracted_text string, text_type string, read_status string"
CONTENT = f"extracted_at string, read_at string, term string, total_content_objects int, total_items int, total_read int, total_skipped int, courses array<struct<course_id: string, course_name: string, course_url: string, item_count: int, content_objects: array<struct<{CONTENT_OBJECT.replace(' string', ': string')}>>>>"
DOM_ITEM = "content_type string, title string, href string, time_datetime string, description string, subtext string, parent_container string, is_nested boolean, content_id string"
OVERRIDES = "version int, _comment string, overrides map<string, struct<edits: map<string, string>, dismissed: boolean, edited_at: string, manual_add: boolean>>"
OVERRIDE_ROWS = "id string, edits array<struct<field: string, value: string>>, dismissed boolean, edited_at string, manual_add boolean"
DEADLINE = "id string, course_id string, course_name string, title string, type string, due_date_raw string, due_date_resolved string, confidence_score int, source_link string, source_item_id string, flag_reason string, dismissed boolean, user_edited boolean, user_edited_fields array<string>, ai_original array<struct<field: string, value: string>>, manual_add boolean, notes string, bucket string"
DOCUMENT = (
    "id string, user_id string, school_id string, source_type string, course_id string, topic string, title string, original_filename string, content_type string, extracted_text string, extraction_method string, extraction_confidence int, original_file_path string, "
    "mime_type string, file_size_bytes bigint, thread_id string, semester_id string, embeddings_status string, embedding_model string, chunk_count int, user_provided_metadata map<string, string>, created_at string, updated_at string, deleted_at string"
)
CHUNK = "id string, document_id string, user_id string, school_id string, chunk_index int, text string, embedding array<double>, metadata struct<source_type: string, course_id: string, content_type: string, semester_id: string>, created_at string"
MESSAGE = "role string, content string, timestamp string, attachments array<struct<doc_id: string, name: string>>"
THREAD = f"id string, title string, created_at string, updated_at string, incognito boolean, deleted_at string, messages array<struct<{MESSAGE.replace('role string, content string, timestamp string, attachments ', 'role: string, content: string, timestamp: string, attachments: ')}>>, documents array<string>"
HISTORY = f"settings struct<memory_enabled: boolean>, threads array<struct<{THREAD.replace(' string', ': string', 6).replace('incognito boolean', 'incognito: boolean').replace('messages array', 'messages: array').replace('documents array', 'documents: array')}>>"
LEDGER = "event_id string, request_id string, event_time string, user_id string, school_id string, thread_id string, model string, tier string, operation string, input_tokens bigint, output_tokens bigint, cost_usd double"
LEDGER_COLUMNS = [x.split()[0] for x in LEDGER.split(", ")]
SEMESTER = "default struct<semester_start: string, semester_end: string, term_name: string, class_schedule: array<string>>, courses map<string, struct<semester_start: string, semester_end: string, term_name: string, class_schedule: array<string>>>"
UPLOAD_JOB = "id string, status string, filename string, thread_id string, doc_id string, error string, created_at string"

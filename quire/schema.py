"""Schemas of the tables that operators pass on to each other."""

DOCUMENTS = (
    "id string, root_id string, parent_id string, level int, ordinal int, path string, parent_path string, name string, content_type string, base_type string, "
    "content string, size bigint, digest string, language string, foreign_id string, metadata map<string,array<string>>, tags map<string,string>, "
    "is_duplicate boolean, no_content_reason string, error string"
)
REPORTS = "path string, code int, status string, exception_class string, exception_message string, ts timestamp"
QUEUE = "path string, size bigint, queue_status string"
ARTIFACTS = "id string, shard1 string, shard2 string, raw binary, metadata_json string"
PAGES = "id string, page_no int, start bigint, end bigint, text string"

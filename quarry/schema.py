"""Tables of the data model and their status values."""

from __future__ import annotations

PENDING, DONE, FAIL = "pending", "done", "fail"

USER = "user_id string, username string, password_hash string, created_at timestamp, updated_at timestamp"
BOOKMARK = (
    "user_id string, bookmark_id string, url string, canonical_url string, domain string, title string, text_content string, "
    "tags array<string>, summary string, created_at timestamp, updated_at timestamp"
)
AI_STATE = ", ".join(f"{x}_status string, {x}_attempts int, {x}_next_attempt_at timestamp, {x}_fail_reason string, {x}_pipeline_version int" for x in ("text_ai", "embedding"))
TASK = "task_id string, user_id string, url string, status string, tags array<string>, created_at timestamp, updated_at timestamp, next_delivery timestamp, retries int, fail_reason string"
CHUNK = "chunk_id string, bookmark_id string, user_id string, chunk_text string, chunk_index int, embedding array<float>"
AI_CHUNK = "bookmark_id string, user_id string, chunk_index int, chunk_hash string, pipeline_version int, summary string, tags array<string>"
RAG_SESSION = "session_id string, user_id string, question string, answer string, relevant_chunks array<string>, created_at timestamp"

#: What a list of bookmarks shows; the scan reads no other column.
BOOKMARK_COLUMNS = ("user_id", "bookmark_id", "url", "domain", "title", "tags", "summary", "created_at")

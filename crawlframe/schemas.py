"""Explicit schemas of the tables and events; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_STRINGS = T.ArrayType(_S)
_META = T.MapType(_S, _S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Lifecycle states.
JOB_STATUSES = ["pending", "running", "completed", "failed"]
URL_STATUSES = ["pending", "fetched", "parsed", "failed"]
JOB_URL_STATUSES = ["queued", "claimed", "fetched", "parsed", "skipped", "failed"]
TERMINAL_STATUSES = ["parsed", "skipped", "failed"]

# Column length limits.
MAX_LENGTHS = {
    "normalized_url": 2048, "domain": 255, "title": 1024, "language": 16, "storage_key": 1024,
}

CRAWL_JOBS = _struct(
    ("id", _S), ("seed_urls", _STRINGS), ("max_depth", _I), ("allowed_domains", _STRINGS),
    ("status", _S), ("urls_queued", _I), ("created_at", _TS), ("updated_at", _TS),
)
URLS = _struct(
    ("id", _S), ("job_id", _S), ("canonical_url", _S), ("normalized_url", _S), ("domain", _S),
    ("status", _S), ("content_hash", _S), ("depth", _I), ("last_crawled_at", _TS), ("created_at", _TS),
)
HTML_ARTIFACTS = _struct(
    ("id", _S), ("url_id", _S), ("storage_key", _S), ("checksum", _S), ("size_bytes", _I),
    ("http_status", _I), ("fetched_at", _TS),
)
PAGES = _struct(
    ("id", _S), ("url_id", _S), ("title", _S), ("description", _S), ("language", _S),
    ("text_snippet", _S), ("extracted_links", _STRINGS), ("metadata", _META),
    ("schema_types", _STRINGS), ("created_at", _TS),
)
SCHEDULES = _struct(
    ("id", _S), ("name", _S), ("cron_expression", _S), ("job_config", _S), ("enabled", _B),
    ("last_run_at", _TS), ("next_run_at", _TS), ("created_at", _TS),
)
PROCESSED_EVENTS = _struct(("id", _S), ("event_id", _S), ("stage", _S), ("processed_at", _TS))
CRAWL_JOB_URLS = _struct(
    ("id", _S), ("job_id", _S), ("normalized_url", _S), ("depth", _I), ("status", _S),
    ("checkpoint", _META), ("error", _S), ("created_at", _TS), ("updated_at", _TS),
)

_BASE = [
    ("event_id", _S), ("trace_id", _S), ("job_id", _S), ("url", _S), ("normalized_url", _S),
    ("schema_version", _I), ("attempt", _I), ("timestamp", _TS),
]
URL_DISCOVERED = _struct(
    *_BASE, ("depth", _I), ("max_depth", _I), ("allowed_domains", _STRINGS), ("force_recrawl", _B), ("replay", _I)
)
HTML_FETCHED = _struct(
    *_BASE, ("storage_key", _S), ("checksum", _S), ("size_bytes", _I), ("http_status", _I),
    ("fetch_duration_ms", _D), ("content_type", _S), ("depth", _I), ("max_depth", _I),
    ("allowed_domains", _STRINGS), ("replay", _I),
)
PAGE_PARSED = _struct(
    *_BASE, ("storage_key", _S), ("checksum", _S), ("title", _S), ("description", _S),
    ("language", _S), ("text_snippet", _S), ("extracted_links", _STRINGS), ("metadata", _META),
    ("depth", _I), ("schema_types", _STRINGS), ("size_bytes", _I), ("replay", _I),
)
URL_FAILED = _struct(
    *_BASE, ("error", _S), ("stage", _S), ("depth", _I), ("max_depth", _I),
    ("allowed_domains", _STRINGS), ("force_recrawl", _B), ("storage_key", _S), ("checksum", _S),
    ("page_payload", _S), ("replay", _I),
)
#: A change of a URL's state in a job; ``depth`` is told by whoever queues the URL.
TRANSITIONS = _struct(
    ("job_id", _S), ("normalized_url", _S), ("depth", _I), ("status", _S), ("error", _S), ("checkpoint", _META), ("timestamp", _TS),
)
CLAIMS = _struct(("url_key", _S), ("claimed_at", _TS))
JOB_COUNTS = _struct(("job_id", _S), *[(s, T.LongType()) for s in JOB_URL_STATUSES])

# Topic -> event schema, required fields and defaults.
EVENTS = {
    "url.discovered": URL_DISCOVERED,
    "html.fetched": HTML_FETCHED,
    "page.parsed": PAGE_PARSED,
    "url.failed": URL_FAILED,
}
REQUIRED = {
    "url.discovered": ["job_id", "url", "normalized_url"],
    "html.fetched": ["job_id", "url", "normalized_url", "storage_key", "checksum", "size_bytes"],
    "page.parsed": ["job_id", "url", "normalized_url", "storage_key", "checksum"],
    "url.failed": ["job_id", "url", "normalized_url", "error"],
}
DEFAULTS = {
    "trace_id": "", "schema_version": 1, "attempt": 1, "depth": 0, "max_depth": 1,
    "force_recrawl": False, "replay": 0, "http_status": 200, "fetch_duration_ms": 0.0,
    "content_type": "text/html", "stage": "crawler",
}
DLQ_ENVELOPE = _struct(("error", _S), ("payload", _S))
DLQ_TOPIC = "dlq"

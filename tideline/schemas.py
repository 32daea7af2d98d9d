"""Schemas of items; sources never infer one."""

from __future__ import annotations

ENGAGEMENT = "struct<likes:int,reposts:int,replies:int,quotes:int,views:int>"

ITEM = (
    "source string, external_id string, url string, author_id string, author_handle string, author_display_name string, "
    "original_text string, language string, published_at timestamp, engagement " + ENGAGEMENT + ", raw_payload_json string, source_key string"
)

#: Columns that items of some source lack.
EMPTY = {
    "author_id": "CAST(NULL AS string)", "author_handle": "CAST(NULL AS string)", "author_display_name": "CAST(NULL AS string)",
    "language": "CAST(NULL AS string)",
    "engagement": "named_struct('likes', 0, 'reposts', 0, 'replies', 0, 'quotes', 0, 'views', CAST(NULL AS int))",
}

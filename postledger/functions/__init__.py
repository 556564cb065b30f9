from postledger.functions.answers import json_slice, with_answer_columns
from postledger.functions.scalars import (
    combined_score,
    decode_detail,
    encode_detail,
    fingerprint,
    first_or_default,
    id_text,
    lenient_date,
    non_empty,
    or_empty,
    place,
    site_url,
    unique_key,
)
from postledger.functions.text import contains_any, strip_html

__all__ = [
    "combined_score",
    "contains_any",
    "decode_detail",
    "encode_detail",
    "fingerprint",
    "first_or_default",
    "id_text",
    "json_slice",
    "lenient_date",
    "non_empty",
    "or_empty",
    "place",
    "site_url",
    "strip_html",
    "unique_key",
    "with_answer_columns",
]

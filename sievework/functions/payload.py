"""JSON in text columns: envelopes, tolerant parsing, canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# --- fixed values ---------------------------------------------------------------------------------
MAX_PAYLOAD_BYTES = 1024 * 1024
# ----------------------------------------------------------------------------------------------------


def is_json(text: Column) -> Column:
    """True for a text that is one JSON value and nothing after it.

    The parser stops at the end of the first value and would let trailing text pass.  Put into an
    array before a mark the text cannot contain, its own digest, a single value leaves the mark in
    second place and anything else does not.
    """
    mark = F.md5(text)
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == mark, F.lit(False))


def payload_kind(body: Column) -> Column:
    """object, payload (other JSON), raw (not JSON), empty or too_large."""
    return (F.when(F.octet_length(body) > MAX_PAYLOAD_BYTES, "too_large")
            .when(body.isNull() | (body == ""), "empty")
            .when(~is_json(body), "raw")
            .when(F.btrim(body, F.lit(" \t\r\n")).startswith("{"), "object")
            .otherwise("payload"))


def envelope(body: Column, kind: Column) -> Column:
    """The payload as a JSON object; null where it was rejected."""
    return (F.when(kind == "empty", F.lit("{}"))
            .when(kind == "object", body)
            .when(kind == "payload", F.concat(F.lit('{"payload":'), body, F.lit("}")))
            .when(kind == "raw", F.to_json(F.struct(body.alias("raw")))))


def extract_object(text: Column) -> Column:
    """JSON object inside a model's answer, as text: first brace to last, or null if it does not parse."""
    bare = tx.strip(text)
    unfenced = F.when(bare.startswith("```"),
                      F.regexp_replace(bare, r"(?s)^```(?:json)?\s*|\s*```$", "")).otherwise(bare)
    candidate = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.when((candidate != "") & is_json(candidate), candidate)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

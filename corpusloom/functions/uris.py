"""URI checks, redaction and input-bundle unpacking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_json, strip

# The schemes an input location may have.
INPUT_SCHEMES = ("s3", "https")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# scheme, authority, path; query and fragment are left behind
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uri_scheme(c: str | Column) -> Column:
    """Lower-cased scheme, '' when there is none."""
    return F.lower(F.regexp_extract(_col(c), _SCHEME, 1))


def normalise_uri(c: str | Column) -> Column:
    """struct(uri, valid): trimmed location, blank becomes null and is valid, other schemes are not."""
    uri = F.nullif(strip(_col(c)), F.lit(""))
    return F.struct(uri.alias("uri"),
                    (uri.isNull() | uri_scheme(uri).isin(*INPUT_SCHEMES)).alias("valid"))


def redact_uri(c: str | Column) -> Column:
    """scheme://host[:port]/path, safe for logs: no user, query or fragment."""
    col = _col(c)
    authority = F.regexp_extract(col, _PARTS, 2)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    port = F.regexp_extract(host_port, r":([^:\]]*)$", 1)
    host = F.lower(F.regexp_replace(host_port, r":[^:\]]*$", ""))
    bare_host = F.regexp_replace(host, r"^\[|\]$", "")
    number = F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999"))
    bad = ((port != "") & (~port.rlike(r"^[0-9]{1,5}$") | (number > 65535))) | \
        (authority.contains("[") != authority.contains("]"))
    # an explicit port 0 is dropped, leading zeros vanish, as a port is a number
    shown = F.when((port != "") & (number != 0), F.concat(F.lit(":"), number.cast("int").cast("string"))).otherwise("")
    return (F.when(col.isNull(), None)
            .when(bad, "<unparseable uri>")
            .when(uri_scheme(col) == "", "<uri without scheme>")
            .otherwise(F.concat(uri_scheme(col), F.lit("://"), bare_host, shown, F.regexp_extract(col, _PARTS, 3))))


def strip_query(c: str | Column) -> Column:
    return F.substring_index(_col(c), "?", 1)


def split_s3(c: str | Column) -> Column:
    """struct(bucket, key, valid); both parts must be non-empty."""
    col = _col(c)
    bucket = F.nullif(F.regexp_extract(col, r"(?s)^s3://([^/]+)/(.+)$", 1), F.lit(""))
    key = F.nullif(F.regexp_extract(col, r"(?s)^s3://([^/]+)/(.+)$", 2), F.lit(""))
    return F.struct(bucket.alias("bucket"), key.alias("key"),
                    F.coalesce(bucket.isNotNull() & key.isNotNull(), F.lit(False)).alias("valid"))


def payload_text(c: str | Column, key: str = "prompt") -> Column:
    """struct(text, error): the string under `key` when the body is a JSON object having it, else the body.

    A key holding anything but a non-blank string is an error, never raw text.
    """
    def unpack(b: Column) -> Column:
        value = F.try_variant_get(b["doc"], f"$.{key}", "variant")
        kind, text = F.schema_of_variant(value), F.try_variant_get(b["doc"], f"$.{key}", "string")
        good = F.coalesce((kind == "STRING") & (strip(text) != ""), F.lit(False))
        return F.struct(
            F.when(value.isNull(), b["body"]).when(good, text).alias("text"),
            F.when(value.isNotNull() & ~good, f"`{key}` must be a non-empty string").alias("error"))

    body = F.regexp_replace(_col(c), "^\ufeff", "")
    parsed = F.struct(body.alias("body"), parse_json(body).alias("doc"))
    # a one-element transform parses each body once for all its uses
    return F.get(F.transform(F.array(parsed), unpack), F.lit(0))

"""Names, types and payloads of embedded figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSET_NAME_LENGTH = 80

# Data-URI prefixes and media types by extension.
URI_EXTENSIONS = [
    ("data:image/jpeg", "jpg"),
    ("data:image/jpg", "jpg"),
    ("data:image/gif", "gif"),
    ("data:image/webp", "webp"),
]
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def sanitize_asset_name(name: Column) -> Column:
    """Letters, marks, digits, ``-`` and ``_`` only; ``figure`` when nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}_-]", "-"), "-+", "-")
    trimmed = F.btrim(F.substring(dashed, 1, ASSET_NAME_LENGTH), F.lit("-"))
    return F.when(trimmed != "", trimmed).otherwise(F.lit("figure"))


def image_extension(uri: Column) -> Column:
    extension = F.lit("png")
    for prefix, value in reversed(URI_EXTENSIONS):
        extension = F.when(F.startswith(uri, F.lit(prefix)), F.lit(value)).otherwise(extension)
    return extension


def data_uri_payload(uri: Column) -> Column:
    """Base64 text behind the first comma (or the whole value), other characters ignored."""
    payload = F.regexp_replace(uri, r"(?s)^,*[^,]*,(?=.)", "")
    return F.regexp_replace(payload, "[^A-Za-z0-9+/=]", "")


def is_base64(payload: Column) -> Column:
    """True for text that decodes: whole groups of four, padding only at the end."""
    return F.coalesce((F.length(payload) % 4 == 0) & payload.rlike(r"\A[A-Za-z0-9+/]*+={0,2}\z"), F.lit(False))


def media_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    result = F.lit("image/png")
    for key, value in MEDIA_TYPES.items():
        result = F.when(extension == key, F.lit(value)).otherwise(result)
    return result


def figure_caption(alt: Column, path: Column) -> Column:
    plain = (alt == path) | F.startswith(alt, F.lit("assets/"))
    return F.when(plain, F.lit("Source figure")).otherwise(alt)


def is_blocked_path(path: Column) -> Column:
    return F.contains(path, F.lit("..")) | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("://"))

"""Hashes and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import blank_to_null, col, first_match, trim_ws
from sluice.functions.urls import normalized_url

STATUS = r"(?i)/status/(\d+)"


def djb2x(c: Column | str) -> Column:
    """h = h * 33 ^ unit over UTF-16 units from 5381, modulo 2^32, as 8 hex digits. The text is coded once."""

    def fold(hexed: Column) -> Column:
        n = (F.length(hexed) / 4).cast("int")
        units = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        step = lambda a, i: (a * 33).bitwiseAND(F.lit(4294967295)).bitwiseXOR(F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
        return F.aggregate(units, F.lit(5381).cast("bigint"), step)

    value = F.get(F.transform(F.array(F.hex(F.encode(col(c), "UTF-16BE"))), fold), F.lit(0))
    return F.when(col(c).isNotNull(), F.lpad(F.lower(F.hex(value)), 8, "0"))


def dedupe_key(c: Column | str) -> Column:
    return blank_to_null(F.lower(trim_ws(c)))


def item_id(site: Column | str, url: Column | str, title: Column | str, key: Column | str | None = None) -> Column:
    """site:hash of the dedupe key where there is one, else of url and title, lower-cased. The URL comes normalised."""
    own = F.concat(F.lower(col(url)), F.lit("|"), F.lower(trim_ws(title)))
    if key is not None:
        own = F.coalesce(F.concat(F.lit("dedupe:"), dedupe_key(key)), own)
    return F.concat(col(site), F.lit(":"), djb2x(own))


def status_id(c: Column | str) -> Column:
    return first_match(STATUS, c)


def status_url(c: Column | str, prefix: str) -> Column:
    """prefix + id for status links, the trimmed input otherwise."""
    return F.coalesce(F.concat(F.lit(prefix), status_id(c)), trim_ws(c))


def url_without_query(c: Column | str) -> Column:
    """Serialised and lower-cased without query and fragment; where it is no URL, the trimmed text without them."""
    return F.lower(normalized_url(F.regexp_replace(col(c), r"[?#][\s\S]*$", "")))


def media_identity(c: Column | str, kind: str, path_pattern: str) -> Column:
    """kind-id:<digits of the path>, else kind-url:<URL without query>; null in, null out."""
    return F.coalesce(F.concat(F.lit(f"{kind}-id:"), first_match(path_pattern, c)), F.concat(F.lit(f"{kind}-url:"), url_without_query(c)))


def video_key(namespace: str, video: Column | str, path_pattern: str) -> Column:
    return F.concat(F.lit(f"{namespace}:"), media_identity(video, "video", path_pattern))


def ranked_key(namespace: str, explicit: Column, video: str, preview: str, status: str, video_path: str, preview_path: str) -> Column:
    """Explicit id, identity of the video unless its URL is the preview's, identity of the preview, status id."""
    own = F.when(~F.col(video).eqNullSafe(F.col(preview)), media_identity(video, "video", video_path))
    return F.concat(F.lit(f"{namespace}:"), F.coalesce(F.concat(F.lit("video-id:"), explicit), own, media_identity(preview, "preview", preview_path), F.concat(F.lit("tweet-status:"), status_id(status)), F.concat(F.lit("fallback:"), url_without_query(video))))


def ranked_title(rank: Column | str, *options: Column) -> Column:
    return F.concat(col(rank).cast("string"), F.lit("위 - "), F.coalesce(*options))


def explicit_id(video_id: Column | str, own: Column | str) -> Column:
    """video_id, or id only where video_id is null; blank is null."""
    return blank_to_null(trim_ws(F.coalesce(col(video_id), col(own))))


def first_digits_id(ids: Column | str) -> Column:
    """First of an array of ids that is all digits after trimming."""
    return F.get(F.filter(F.transform(col(ids), trim_ws), lambda x: x.rlike(r"^\d+$")), F.lit(0))

"""Column functions on text: tags, white space, entities, clipping, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that browsers' regular expressions and trim know.
JS_WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same, letter by letter.
WS_LETTERS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same in the spelling of RE2, for oracles.
RE2_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The entities that are decoded, in this order, so that &amp;lt; becomes <.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
SNIPPET = 280


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_LETTERS))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", " ")


def normalize_whitespace(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(col(c), f"{JS_WS}+", " "))


def decode_entities(c: Column | str) -> Column:
    out = col(c)
    for name, letter in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(letter))
    return out


def clean_text(c: Column | str) -> Column:
    """Strip tags, then decode, so that &lt;b&gt; stays as text."""
    return normalize_whitespace(decode_entities(strip_tags(c)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def optional_text(c: Column | str) -> Column:
    return blank_to_null(clean_text(F.coalesce(col(c), F.lit(""))))


def utf16_units(c: Column | str) -> Column:
    """Length as browsers count it: two for a character beyond U+FFFF."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def clip_text(c: Column | str, limit: int) -> Column:
    """At most `limit` UTF-16 units: longer texts are cut to three fewer and get "...". Of a character that the cut would halve nothing stays."""
    c = col(c)
    near = F.left(c, F.lit(limit + 1))  # as many characters decide whether there are more units than the limit
    units = F.encode(near, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * (limit - 3) - 1, 1)).between("D8", "DB")  # the cut stands within a pair
    kept = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * (limit - 4)).otherwise(2 * (limit - 3))), "UTF-16BE")
    return F.when(utf16_units(near) <= limit, c).otherwise(F.concat(kept, F.lit("...")))


def clip_snippet(c: Column | str) -> Column:
    """Trimmed and cut to SNIPPET UTF-16 units; blank is null."""
    return clip_text(blank_to_null(trim_ws(c)), SNIPPET)


def first_match(pattern: str, c: Column | str, group: int = 1) -> Column:
    """First non-empty group of the first match, else null."""
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def attribute_anywhere(c: Column | str, name: str) -> Column:
    """Value of name="..." wherever it stands, also as the end of data-name."""
    return F.regexp_extract(col(c), rf"""(?i){name}=["']([^"']+)["']""", 1)


def loose_attribute(c: Column | str, name: str) -> Column:
    """Quoted value (may be empty), else bare value, of name = ... wherever it stands; empty where it is absent."""
    c = col(c)
    quoted = rf"""(?i){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    bare = F.regexp_extract(c, rf"(?i){name}\s*=\s*([^\s>]+)", 1)
    return F.when(c.rlike(quoted), F.concat(F.regexp_extract(c, quoted, 1), F.regexp_extract(c, quoted, 2))).otherwise(bare)


def attribute(c: Column | str, name: str) -> Column:
    """Quoted value (may be empty) or bare value of an attribute of a tag; null where it is absent."""
    c = col(c)
    double, single, bare = rf'(?i)(?<![\w-]){name}\s*=\s*"([^"]*)"', rf"(?i)(?<![\w-]){name}\s*=\s*'([^']*)'", rf"(?i)(?<![\w-]){name}\s*=\s*([^\s\"'=<>`]+)"
    found = F.when(c.rlike(double), F.regexp_extract(c, double, 1)).when(c.rlike(single), F.regexp_extract(c, single, 1))
    return found.when(c.rlike(bare), F.regexp_extract(c, bare, 1))


def parse_int(c: Column | str) -> Column:
    """Leading integer of a text, as browsers read it: '3abc' is 3; null where there is none."""
    return F.regexp_extract(col(c), f"^{JS_WS}*([+-]?[0-9]+)", 1).try_cast("bigint")


def rank_or(c: Column | str, fallback: Column | str) -> Column:
    """Positive rank, else the fallback."""
    rank = parse_int(c)
    return F.when(rank > 0, rank).otherwise(col(fallback))


#: What a letter after a backslash stands for in a script literal, as UTF-16 units.
ESCAPES = {"n": "000A", "r": "000D", "t": "0009", "b": "0008", "f": "000C", "v": "000B", "0": "0000"}


def script_text(c: Column | str) -> Column:
    """Text of a script string literal: \\uXXXX, \\xXX, letters of ESCAPES, line continuations; any other escaped character is itself, as is a backslash at the end.

    Tokens become UTF-16 units in hexadecimal, so that a pair may come from two escapes; half a pair alone becomes U+FFFD.
    """
    tokens = F.regexp_extract_all(col(c), F.lit(r"(?s)[^\\]+|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\\r\n|\\.|\\"), F.lit(0))
    hexed = lambda x: F.hex(F.encode(x, "UTF-16BE"))
    table = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))

    def units(token: Column) -> Column:
        letter = F.substring(token, 2, 1)
        out = F.when(~token.startswith("\\") | (F.length(token) == 1), hexed(token)).when(token.rlike(r"^\\u.{4}$"), F.upper(F.substring(token, 3, 4)))
        out = out.when(token.rlike(r"^\\x.{2}$"), F.concat(F.lit("00"), F.upper(F.substring(token, 3, 2)))).when(letter.isin("\r", "\n"), F.lit(""))
        return out.otherwise(F.coalesce(F.try_element_at(table, letter), hexed(letter)))

    spaced = F.regexp_replace(F.array_join(F.transform(tokens, units), ""), "(....)", "$1 ")
    whole = F.regexp_replace(F.regexp_replace(spaced, "D[89AB].. (?!D[C-F])", "FFFD "), "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    decoded = F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")
    return F.when(F.contains(col(c), F.lit("\\")), decoded).otherwise(col(c))


def packed_text(c: Column | str) -> Column:
    """Value of a packed string: JSON once its quotes are escaped. What does not parse so, as an escaped quote, stays as it is."""
    body = F.replace(col(c), F.lit('"'), F.lit('\\"'))
    sound = F.regexp_replace(body, r'[^"\\\x00-\x1f]+|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4}', "") == ""
    return F.coalesce(F.when(sound, F.get(F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>"), F.lit(0))), col(c))


def views_snippet(variant: Column | str) -> Column:
    """'조회수 n' for a variant number >= 0; texts such as "12" give null."""
    v = col(variant)
    number = F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.try_variant_get(v, "$", "string")
    return F.when(number & (value.try_cast("double") >= 0), F.concat(F.lit("조회수 "), value))


def plain_tags(c: Column | str) -> Column:
    """Tags stripped and white space normalised, entities left alone."""
    return normalize_whitespace(strip_tags(c))


def without_badge(c: Column | str) -> Column:
    """Clean title without a leading +N."""
    return F.regexp_replace(clean_text(c), rf"^\+\d+{JS_WS}*", "")


def section_label(c: Column | str, names: dict[str, str]) -> Column:
    """Canonical name of the first key that the label contains, else null."""
    c, out = clean_text(c), F.lit(None).cast("string")
    for key, name in reversed(names.items()):
        out = F.when(F.contains(c, F.lit(key)), F.lit(name)).otherwise(out)
    return out


#: What is shown for each error code, and for any other.
MESSAGES = {
    "TAB_NOT_FOUND": "활성 탭을 찾지 못했습니다. 탭을 선택한 뒤 다시 시도하세요.",
    "TAB_URL_MISMATCH": "선택한 사이트와 현재 탭 URL이 다릅니다. 먼저 사이트를 열어주세요.",
    "CONTENT_SCRIPT_UNAVAILABLE": "HTML 수집에 실패했습니다. 페이지를 새로고침 후 다시 시도하세요.",
    "PARSE_FAILED": "페이지 구조를 파싱하지 못했습니다. 사이트 구조 변경 여부를 확인하세요.",
    "PRIVACY_BLUR_FAILED": "브라우저 화면 흐림 처리에 실패했습니다.",
    "NO_ITEMS": "수집 가능한 아이템이 없습니다.",
    "INVALID_REQUEST": "요청 형식이 올바르지 않습니다.",
}
OTHER_MESSAGE = "알 수 없는 오류가 발생했습니다."


def error_message(code: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(col(code), F.lit(""))), F.lit(OTHER_MESSAGE))


def shown_time(ms: Column | str) -> Column:
    """Milliseconds as a short Korean date and time of day in the session's time zone: 24. 1. 15. 오후 3:04:05."""
    at = F.timestamp_millis(col(ms))
    half = F.when(F.hour(at) < 12, "오전").otherwise("오후")
    return F.concat(F.date_format(at, "yy. M. d. "), half, F.date_format(at, " h:mm:ss"))

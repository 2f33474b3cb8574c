"""URLs: resolving, normalising, origins, patterns and parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import blank_to_null, col, first_match, plain_tags, trim_ws

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
#: Schemes whose URLs have a host, with the port that a serialised URL leaves out.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: What is percent-encoded everywhere, and what else is in a user name or password.
_BAD, _USER = r"""[\x00-\x20"<>\x7f-\x{10FFFF}]""", "`{}:;=@[]^|"
#: A host in ASCII: no forbidden letter, its last label no number; or an address in numbers.
_HOST = r"^(?!(?:.*\.)?(?:\d+|0x[0-9a-f]*)\.?$)[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+$|^(?:(?:\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])(?:\.(?!$)|$)){4}$|^\[[0-9a-f:.]+\]$"
_DOT = r"(?:\.|%2[eE])"
#: URLs that serialise to themselves.
_CLEAN = rf"""^https?://(?:[a-z0-9_-]+\.)*[a-z][a-z0-9-]*/(?!(?:[^?#]*/)?{_DOT}{{1,2}}(?:[/?#]|$))[A-Za-z0-9%/:@!$&'()*+,;=~._\[\]|^-]*(?:\?[A-Za-z0-9%/:@!$&()*+,;=~._?`{{}}|^\\\[\]-]*)?(?:#[A-Za-z0-9%/:@!$&'()*+,;=~._?{{}}|^#\\\[\]-]*)?$"""


def origin(c: Column | str) -> Column:
    """scheme://host[:port] in lower case, default port left out; null unless http(s)."""
    found = F.regexp_extract(F.lower(trim_ws(c)), r"^(https?)://(?:[^@/?#]*@)?([^/?#:]+)(?::(\d+))?(?=[/?#]|$)", 0)
    scheme = F.regexp_extract(found, "^(https?)", 1)
    host = F.regexp_extract(found, r"^https?://(?:[^@]*@)?([^:]+)", 1)
    port = F.regexp_extract(found, r":(\d+)$", 1)
    usual = ((scheme == "http") & (port == PORTS["http"])) | ((scheme == "https") & (port == PORTS["https"]))
    return F.when(found != "", F.concat(scheme, F.lit("://"), host, F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port))))


def same_origin(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def absolute_url(raw: Column | str, base: Column | str) -> Column:
    """The common forms as a column: absolute, //host, /path, ?query, #part and relative paths without dot segments."""
    raw, base = trim_ws(raw), trim_ws(base)
    directory = F.regexp_replace(F.regexp_replace(base, r"[?#][\s\S]*$", ""), r"(?<=[^/:]/)[^/]*$|(?<![/:])$", "")
    directory = F.when(F.regexp_replace(base, r"[?#][\s\S]*$", "").rlike(r"^[a-z]+://[^/]*$"), F.concat(origin(base), F.lit("/"))).otherwise(F.regexp_replace(F.regexp_replace(base, r"[?#][\s\S]*$", ""), "[^/]*$", ""))
    absolute = F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*$"), F.concat(raw, F.lit("/"))).otherwise(raw)
    out = F.when(raw.rlike(_SCHEME), absolute)
    out = out.when(origin(base).isNull(), raw)
    out = out.when(raw.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), raw))
    out = out.when(raw.startswith("/"), F.concat(origin(base), raw))
    out = out.when(raw.startswith("?"), F.concat(F.regexp_replace(base, r"[?#][\s\S]*$", ""), raw))
    out = out.when(raw.startswith("#") | (raw == ""), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), raw))
    return out.otherwise(F.concat(directory, raw))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _encoded(c: Column, bad: str) -> Column:
    """Percent-encode the characters of a class, as UTF-8."""
    runs = F.regexp_extract_all(c, F.lit(f"{bad}+|[^{bad[1:]}+"), F.lit(0))
    each = F.transform(runs, lambda x: F.when(x.rlike(bad), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x))
    return F.when(c.rlike(bad), F.array_join(each, "")).otherwise(c)


def _replaced(c: Column, letters: str) -> Column:
    for letter in letters:
        c = F.replace(c, F.lit(letter), F.lit(f"%{ord(letter):02X}"))
    return c


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments; one at the end leaves a final /."""
    segments = F.split(F.substring(F.regexp_replace(path, rf"(/{_DOT}{{1,2}})$", "$1/"), 2, 1 << 30), "/", -1)

    def step(kept: Column, x: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(x.rlike(rf"^{_DOT}{{2}}$"), up).when(x.rlike(rf"^{_DOT}$"), kept).otherwise(F.concat(kept, F.array(x)))

    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(rf"/{_DOT}{{1,2}}(?:/|$)"), folded).otherwise(path)


def _host(raw: Column) -> Column:
    """The host in ASCII and lower case, null where it is none. Letters beyond ASCII are mapped as IDNA 2003 does; of numbers only four decimal ones make a host."""
    decoded = F.when(F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    named = let(decoded, lambda h: F.lower(F.when(h.rlike(r"[^\x00-\x7f]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h, F.lit(1))).otherwise(h)))
    return let(named, lambda h: F.when(h.rlike(_HOST), h))


def _special(whole: Column) -> Column:
    """Serialise scheme:authority, path, query and fragment of a scheme in PORTS; null where host or port is none."""
    part = lambda i: F.regexp_extract(whole, r"(?s)^([^:]*):[/\\]*([^/\\?#]*)([^?#]*)(.*)$", i)
    tail = _encoded(F.concat(F.translate(part(3), "\\", "/"), part(4)), _BAD)

    def text(u: Column) -> Column:
        login, place = F.regexp_extract(u["authority"], r"(?s)^(.*)@", 1), F.regexp_replace(u["authority"], r"(?s)^.*@", "")
        word = F.regexp_extract(login, r"(?s)(:.+)$", 1)
        who = F.when(login.rlike("[^:]"), F.concat(_replaced(_encoded(F.substring_index(login, ":", 1), _BAD), _USER), F.left(word, F.lit(1)), _replaced(_encoded(F.substring(word, 2, 1 << 30), _BAD), _USER), F.lit("@"))).otherwise("")
        port = F.regexp_extract(place, r":0*(\d*?)$", 1)
        usual = F.concat(u["scheme"], F.lit(":"), port).isin("http:", "https:", "ws:", "wss:", "ftp:", *(f"{x}:{n}" for x, n in PORTS.items()))
        shown = F.when(place.rlike(r":0+$"), F.lit(":0")).when(usual, F.lit("")).when(port.try_cast("int") <= 65535, F.concat(F.lit(":"), port))
        path = F.regexp_replace(F.regexp_extract(u["tail"], r"^[^?#]*", 0), "^$", "/")
        query, fragment = F.regexp_extract(u["tail"], r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(u["tail"], r"#.*$", 0)
        return F.concat(u["scheme"], F.lit("://"), who, _host(F.regexp_replace(place, r":\d*$", "")), shown, _replaced(_without_dots(path), "`{}"), F.replace(query, F.lit("'"), F.lit("%27")), F.replace(fragment, F.lit("`"), F.lit("%60")))

    return let(F.struct(part(1).alias("scheme"), part(2).alias("authority"), tail.alias("tail")), text)


def _alone(c: Column) -> Column:
    """A whole URL, cleaned, as browsers write it."""
    scheme = F.lower(F.regexp_extract(c, _SCHEME, 1))
    lowered = F.concat(scheme, F.lit(":"), F.regexp_replace(c, _SCHEME, ""))
    return F.when(c.rlike(_CLEAN), c).when(scheme.isin(*PORTS), _special(lowered)).when(scheme != "", lowered)


def _cleaned(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c, F.lit("".join(map(chr, range(33))))), r"[\t\n\r]", "")


def _slashed(c: Column) -> Column:
    """Backslashes before the query are slashes."""
    return F.when(F.contains(c, F.lit("\\")), F.concat(F.translate(F.regexp_extract(c, r"(?s)^[^?#]*", 0), "\\", "/"), F.regexp_extract(c, r"(?s)[?#].*$", 0))).otherwise(c)


def _whole(c: Column, base: Column) -> Column:
    """A cleaned reference as a whole URL, not yet serialised; null where it needs a base and has no sound one, or the base is no URL."""
    scheme, own = F.lower(F.regexp_extract(c, _SCHEME, 1)), F.lower(F.regexp_extract(base, _SCHEME, 1))
    rest = F.when(scheme == "", c).otherwise(F.regexp_replace(c, _SCHEME, ""))
    relative = (scheme == "") | (scheme.isin(*PORTS) & (scheme == own) & ~rest.rlike(r"^[/\\][/\\]"))
    # the base with two slashes before its host, and a path that ends in its folder's slash where it is a folder
    above = F.regexp_replace(F.regexp_replace(_slashed(base), _SCHEME + "/*", "$1://"), rf"(?s)^([^:]+://[^/?#]*|[^?#]*/{_DOT}{{1,2}})(?=[?#]|$)", "$1/")
    part = lambda b, pattern: F.regexp_extract(b, rf"(?s)^[^:]+:{pattern}", 0)

    def text(x: Column) -> Column:
        r, b = x["r"], x["b"]
        out = F.when(r.startswith("//"), F.concat(part(b, ""), r)).when(r.startswith("/"), F.concat(part(b, "//[^/?#]*"), r)).when(r.startswith("?"), F.concat(part(b, "[^?#]*"), r))
        return out.when((r == "") | r.startswith("#"), F.concat(part(b, "[^#]*"), r)).otherwise(F.concat(part(b, "//[^?#]*/"), r))

    joined = F.when(own.isin(*PORTS), let(F.struct(_slashed(rest).alias("r"), above.alias("b")), text))
    return F.when(own == "", None).when(F.coalesce(relative & base.isNotNull(), F.lit(False)), joined).otherwise(c)


def serialised(raw: Column, base: Column | None = None) -> Column:
    """The URL as browsers write it, against a base where one is given; null where it is none (or the base is none).

    White space around and tabs and line ends within go, backslashes are slashes, hosts are lower-cased and in ASCII, usual ports and dot segments go,
    each part is percent-encoded by its own set. URLs of other schemes than those in PORTS keep what follows the scheme.
    """
    if base is None:
        return let(_cleaned(raw), _alone)
    return let(let(F.struct(_cleaned(raw).alias("c"), _cleaned(base).alias("b")), lambda x: _whole(x["c"], x["b"])), _alone)


def resolved_url(raw: Column | str, base: Column | str) -> Column:
    """The raw URL against the base as browsers write it; the raw text where either is no URL. Without a base it stands alone."""
    return F.coalesce(serialised(col(raw), col(base)), col(raw))


def normalized_url(c: Column | str) -> Column:
    """Serialised URL, or the trimmed text where it is none."""
    own = trim_ws(c)
    return F.coalesce(serialised(own), own)


def preview_url(c: Column | str) -> Column:
    """Normalised, with blank and data: addresses as null."""
    own = blank_to_null(trim_ws(c))
    return F.when(~F.lower(own).startswith("data:"), normalized_url(own))


def http_target(c: Column | str) -> Column:
    """Trimmed http(s) URL, else null."""
    own = trim_ws(c)
    return F.when(origin(own).isNotNull(), own)


def path_segment(c: Column | str) -> Column:
    return F.lower(trim_ws(c))


def path_of(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)), F.lit("/"))


def query_param(c: Column | str, name: str) -> Column:
    """Decoded value of the first query parameter of that name, null where there is none or it is empty."""
    return F.try_url_decode(first_match(rf"^[^?#]*\?(?:[^#]*?&)??{name}=([^&#]*)", c))


def first_segment_in(c: Column | str, names: tuple[str, ...]) -> Column:
    """First path segment, lower-cased, that is one of the names."""
    return F.get(F.filter(F.transform(F.split(path_of(c), "/"), path_segment), lambda x: x.isin(*names)), F.lit(0))


def first_alias(c: Column | str, params: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """Canonical value of the first of the parameters that has a known alias."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(*(F.try_element_at(table, F.lower(trim_ws(query_param(c, p)))) for p in params))


def label_contains(labels: Column, names: dict[str, str]) -> Column:
    """Canonical name for the first label that contains a key."""
    each = F.transform(labels, lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(k)), F.lit(v)) for k, v in names.items())))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


#: Views and periods by URL, and by the labels of the active tab and button, in the order of asking.
VIEWS = ("ranking", "realtime", "recent")
VIEW_LABELS = {"실시간": "realtime", "신규": "recent", "인기": "ranking"}
PERIOD_PARAMS = ("period", "time", "range", "filter")
PERIODS = {"hour": "hourly", "hourly": "hourly", "day": "daily", "daily": "daily", "week": "weekly", "weekly": "weekly", "month": "monthly", "monthly": "monthly"}
PERIOD_LABELS = {"1달": "monthly", "1개월": "monthly", "1주": "weekly", "24시간": "daily", "1일": "daily", "1시간": "hourly"}
ACTIVE_TAB = r"""(?i)<(?:button|a)\b[^>]*class=["'][^"']*(?:tab-active|bg-violet-500/20)[^"']*["'][^>]*>([\s\S]*?)</(?:button|a)>"""
ACTIVE_PERIOD = r"""(?i)<button\b[^>]*class=["'][^"']*shadow-violet-500/50[^"']*["'][^>]*>([\s\S]*?)</button>"""


def _labels(html: Column | str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(col(html), F.lit(pattern), F.lit(1)), plain_tags)


def active_view(html: Column | str, url: Column | str) -> Column:
    """The view that the URL names, else the first active tab's with a known label, else ranking."""
    return F.coalesce(first_segment_in(url, VIEWS), label_contains(_labels(html, ACTIVE_TAB), VIEW_LABELS), F.lit("ranking"))


def active_period(html: Column | str, url: Column | str) -> Column:
    """The period that the URL names, else the first active button's with a known label, else hourly."""
    return F.coalesce(first_alias(url, PERIOD_PARAMS, PERIODS), label_contains(_labels(html, ACTIVE_PERIOD), PERIOD_LABELS), F.lit("hourly"))


def active_api_url(html: Column | str, url: Column | str) -> Column:
    """The API address of what a page shows; only the ranking has a period. Null where the URL is none."""
    view = active_view(html, url)
    period = F.when(view == "ranking", F.concat(F.lit("?period="), active_period(html, url))).otherwise("")
    return F.concat(origin(url), F.lit("/api/tw/"), view, period)


def api_url(page: Column | str, view: Column | str, period: Column | str | None = None, prefix: str = "/api/") -> Column:
    out = F.concat(origin(page), F.lit(prefix), col(view))
    return F.concat(out, F.coalesce(F.concat(F.lit("?period="), col(period)), F.lit(""))) if period is not None else out


def article_url(page: Column | str, path: Column | str, mode: Column) -> Column:
    """Origin and path with at most the parameter mode."""
    return F.concat(origin(page), col(path), F.coalesce(F.concat(F.lit("?mode="), F.url_encode(mode)), F.lit("")))


def glob_pattern(c: Column | str) -> Column:
    r"""Anchored regular expression of a glob in which only * is special."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(col(c), r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def title_link(site: Column | str, summary: Column | str, url: Column | str, sites: tuple[str, ...]) -> Column:
    """The summary where the site keeps links there and it is one, else the URL."""
    return F.when(col(site).isin(*sites) & col(summary).rlike("(?i)^https?://"), col(summary)).otherwise(col(url))

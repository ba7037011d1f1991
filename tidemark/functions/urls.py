"""Source URLs: building, checking, and keys out of links."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DUID = r"^[0-9]{1,12}\z"


@dataclass(frozen=True)
class BoardSite:
    """Host and path of a notice board. The rest of the addresses follows from them."""

    host: str = "board.example.org"
    path: str = "/ko/life/notice.jsp"

    @property
    def origin(self) -> str:
        return f"https://{self.host}"

    @property
    def robots(self) -> str:
        return f"{self.origin}/robots.txt"


# The query strings of list and detail pages.
LIST_QUERY = "srCategoryId=&mode=list&searchKey=1&searchVal=&tpage="
DETAIL_QUERY = "BoardMode=view&DUID="


def parse_duid(raw: Column) -> Column:
    """The text if it is 1 to 12 ASCII digits, else null."""
    return F.when(raw.rlike(DUID), raw)


def duid_from_href(href: Column) -> Column:
    """DUID in a link's query, of several the last; null if there is none or it is no id."""
    query = F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)
    values = F.regexp_extract_all(query, F.lit(r"(?:^|&)DUID=([^&]*)"), F.lit(1))
    return parse_duid(F.try_url_decode(F.try_element_at(values, F.lit(-1))))


def list_url(page: Column, site: BoardSite = BoardSite()) -> Column:
    """Null for pages below 1."""
    return F.when(page >= 1, F.concat(F.lit(f"{site.origin}{site.path}?{LIST_QUERY}"), page.cast("string")))


def detail_url(duid: Column, site: BoardSite = BoardSite()) -> Column:
    """Null for what is no id."""
    return F.when(duid.rlike(DUID), F.concat(F.lit(f"{site.origin}{site.path}?{DETAIL_QUERY}"), duid))


def _pieces(url: Column) -> dict[str, Column]:
    rest = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.regexp_extract(authority, r"([^@]*)\z", 1)
    # Scheme and authority may be missing; what follows them is path, query, fragment.
    after = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    port = F.regexp_extract(host_port, r":([^:\]]*)\z", 1)
    return {
        "scheme": F.lower(rest),
        "user": F.instr(authority, "@") > 0,
        "user_text": F.regexp_extract(authority, r"^(.*)@", 1),
        "host": F.lower(F.regexp_replace(host_port, r":[^:\]]*\z", "")),
        "port": port,
        "bad_port": (port != "") & ~(port.rlike(r"^[0-9]+\z") & (F.try_to_number(F.substring(port, 1, 9), F.lit("999999999")) <= 65535) & (F.length(port) <= 9)),
        "path": F.regexp_extract(after, r"^([^?#]*)", 1),
        "query": F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(after, r"^[^#]*#([\s\S]*)", 1),
    }


def source_url_issue(url: Column, site: BoardSite = BoardSite()) -> Column:
    """Null for exact list and detail addresses, else one of malformed_url, wrong_scheme, wrong_host, wrong_path, wrong_query."""
    p = _pieces(url)
    page = F.regexp_extract(p["query"], r"^srCategoryId=&mode=list&searchKey=1&searchVal=&tpage=([0-9]+)\z", 1)
    duid = F.regexp_extract(p["query"], r"^BoardMode=view&DUID=([0-9]{1,12})\z", 1)
    return (
        F.when(url.isNull() | p["bad_port"], "malformed_url")
        .when(p["scheme"] != "https", "wrong_scheme")
        .when((p["host"] != site.host) | (F.regexp_replace(p["user_text"], ":", "") != ""), "wrong_host")
        .when(~p["port"].isin("", "443"), "wrong_host")
        .when((p["path"] != site.path) | (p["fragment"] != ""), "wrong_path")
        .when(~(page.rlike("[1-9]") | (duid != "")), "wrong_query")
    )


def wire_target_issue(url: Column, robots: bool, site: BoardSite = BoardSite()) -> Column:
    """Null for an address that may be fetched in this role, else the first fault by scheme, host, user, port, fragment, path."""
    p = _pieces(url)
    return (
        F.when(url.isNull() | p["bad_port"], "malformed_target")
        .when(p["scheme"] != "https", "invalid_scheme")
        .when(p["host"] != site.host, "invalid_host")
        .when(p["user"], "userinfo")
        .when(~p["port"].isin("", "443"), "invalid_port")
        .when(p["fragment"] != "", "fragment")
        .when(p["path"] != ("/robots.txt" if robots else site.path), "disallowed_path")
    )


# What marks a challenge page within its first 4096 bytes.
CHALLENGE_MARKERS = (
    "captcha",
    "recaptcha",
    "robot check",
    "waf",
    "web application firewall",
    "cloudflare",
    "cf-chl-",
    "incapsula",
    "imperva",
    "sucuri",
    "akamai",
    "access denied",
    "security check",
    "bot protection",
    "bot detection",
    "ddos protection",
)
CHALLENGE_BYTES = 4096
# Length and SHA-256 of the one page that stands for a missing robots file, its line ends made LF.
MISSING_ROBOTS_BYTES = 444
MISSING_ROBOTS_SHA256 = "71b4726aaed2b0261a8edb6bc5490abb83b3aa65f8f7fc6b3fd1d75d7a46d03c"


def challenged(body: Column) -> Column:
    """Whether a body (binary) shows a challenge marker; waf only where no letter or digit touches it."""
    head = F.lower(F.decode(F.substring(body, 1, CHALLENGE_BYTES), "ISO-8859-1"))
    plain = reduce(lambda a, b: a | b, (F.contains(head, F.lit(m)) for m in CHALLENGE_MARKERS if m != "waf"))
    return plain | head.rlike(r"(?<![a-z0-9])waf(?![a-z0-9])")


def content_type(headers: Column) -> Column:
    """Media type out of a map of headers, whatever the case of its name: lower-cased, without parameters; null without one."""
    own = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "content-type"))
    return F.lower(F.trim(F.split(F.try_element_at(own, F.lit(1)), ";", 2)[0]))


def status_reason(status: Column) -> Column:
    return F.when(status == 403, "forbidden").when(status == 429, "rate_limit").otherwise("http_failure")


def is_missing_robots(media_type: Column, body: Column) -> Column:
    """The one HTML page, sent with status 200, that stands for a missing robots file."""
    lines = F.encode(F.replace(F.decode(body, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return F.coalesce((media_type == "text/html") & (F.length(lines) == MISSING_ROBOTS_BYTES) & (F.sha2(lines, 256) == MISSING_ROBOTS_SHA256), F.lit(False))


def decoded_html(body: Column) -> Column:
    """UTF-8 text of a body; null if it isn't valid."""
    return F.try_validate_utf8(body.cast("string"))

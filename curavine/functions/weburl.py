"""URLs as browsers read them, by the rules of the URL Standard: states for scheme, authority, path, query and fragment.

Hosts become ASCII (international names as xn-- labels, numbers as IPv4 addresses), default ports go, backslashes of the
web's schemes are slashes, dot segments are resolved, and each part has its own set of characters that are escaped.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: The special schemes and their default ports; what each part escapes besides controls and non-ASCII; what a host must not hold.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT, QUERY, SPECIAL_QUERY = set(' "<>`'), set(' "#<>'), set(" \"#<>'")
PATH = QUERY | set("?^`{}")
USER = PATH | set("/:;=@[\\]|")
NO_HOST = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
NO_DOMAIN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_IGNORED = dict.fromkeys(map(ord, "\u00ad\u200b\u2060\ufeff"))
_DOTS = re.compile("[\u3002\uff0e\uff61]")
_UP, _HERE = {"..", ".%2e", "%2e.", "%2e%2e"}, {".", "%2e"}


class Url(NamedTuple):
    """Parts of a URL: host is null if it has none, path a list of segments, or a text where it can't be a base."""

    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: list[str] | str = []
    query: str | None = None
    fragment: str | None = None

    def path_text(self) -> str:
        return self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path)

    def href(self, fragment: bool = True) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            user = self.user + (":" + self.password if self.password else "")
            out += "//" + (user + "@" if user else "") + self.host + ("" if self.port is None else f":{self.port}")
        elif not isinstance(self.path, str) and len(self.path) > 1 and self.path[0] == "":
            out += "/."  # else the path would be read as a host
        out += self.path_text() + ("" if self.query is None else "?" + self.query)
        return out + ("#" + self.fragment if fragment and self.fragment is not None else "")


def escaped(text: str, which: set[str]) -> str:
    """UTF-8 bytes of controls, of characters beyond ASCII and of those named as %XX."""
    if text.isascii() and text.isprintable() and which.isdisjoint(text):
        return text
    return "".join(c if " " <= c <= "~" and c not in which else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def unescaped(text: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


def ascii_host(name: str) -> str | None:
    """A domain in ASCII: lower case, compatibility forms composed, labels beyond ASCII in Punycode; null if it can't be one."""
    name = _DOTS.sub(".", unicodedata.normalize("NFKC", name.translate(_IGNORED).lower()).lower())
    labels = []
    for label in name.split("."):
        if not label.isascii():
            if unicodedata.category(label[0]).startswith("M") or label.startswith("xn--"):
                return None
            label = "xn--" + label.encode("punycode").decode()
        elif label.startswith("xn--"):
            try:
                if label[4:].encode().decode("punycode").isascii():
                    return None
            except (UnicodeError, ValueError):
                return None
        labels.append(label)
    return ".".join(labels)


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal or hexadecimal."""
    base = 16 if part[:2] in ("0x", "0X") else 8 if len(part) > 1 and part[0] == "0" else 10
    digits = part[2:] if base == 16 else part[1:] if base == 8 else part
    if not re.fullmatch({16: r"[0-9A-Fa-f]*", 8: "[0-7]*", 10: "[0-9]+"}[base], digits):
        return None
    return int(digits or "0", base)


def _ipv4(name: str) -> str | None:
    """The address of a host that ends in a number; null if it is a wrong one."""
    parts = name.removesuffix(".").split(".")
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    return str(ipaddress.IPv4Address(numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))))


def _ipv6(text: str) -> str | None:
    try:
        pieces = [f"{int(p, 16):x}" for p in ipaddress.IPv6Address(text).exploded.split(":")] if "%" not in text else None
    except ValueError:
        return None
    if pieces is None:
        return None
    longest = max(re.finditer(r"(?:\b0\b:?)+", ":".join(pieces)), key=lambda m: m[0].count("0"), default=None)
    whole = ":".join(pieces)
    if longest is None or longest[0].count("0") < 2:
        return f"[{whole}]"
    head, tail = whole[: longest.start()].rstrip(":"), whole[longest.end() :].lstrip(":")
    return f"[{head}::{tail}]"


def parse_host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if NO_HOST.search(text) else escaped(text, set())
    try:
        name = ascii_host(unescaped(text).decode("utf-8"))
    except UnicodeDecodeError:
        return None
    if not name or NO_DOMAIN.search(name):
        return None
    last = name.removesuffix(".").rpartition(".")[2]
    return _ipv4(name) if last and (last.isdigit() or re.fullmatch(r"0[xX][0-9A-Fa-f]*", last)) else name


def _authority(text: str, scheme: str) -> tuple[str, str, str, int | None] | None:
    """User, password, host and port; null if the host or port is wrong."""
    user, at, place = text.rpartition("@")
    name, _, password = user.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place, re.S)
    special = scheme in PORTS
    if not m or (not m[1] and (special and scheme != "file" or at or m[2])):
        return None
    host = parse_host(m[1], special) if m[1] else ""
    port = int(m[2]) if m[2] else None
    if host is None or port is not None and port > 65535:
        return None
    return escaped(name, USER), escaped(password, USER), "" if scheme == "file" and host == "localhost" else host, None if port == PORTS.get(scheme) else port


def _path(text: str, special: bool, before: list[str]) -> list[str]:
    """Segments of a path behind those of before: dots are resolved, and what a path can't hold is escaped."""
    out = list(before)
    segments = re.split(r"[/\\]" if special else "/", text)
    for k, raw in enumerate(segments):
        segment, last = escaped(raw, PATH), k == len(segments) - 1
        if segment.lower() in _UP:
            if out:
                out.pop()
            if last:
                out.append("")
        elif segment.lower() in _HERE:
            if last:
                out.append("")
        else:
            out.append(segment)
    return out


def parse(text: str, base: Url | None = None) -> Url | None:
    """A URL, read on its own or against a base; null if it isn't one."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    rest, mark, raw = text.partition("#")
    fragment = escaped(raw, FRAGMENT) if mark else None
    m = _SCHEME.match(rest)
    scheme = m[1].lower() if m else base.scheme if base else None
    if scheme is None:
        return None
    special = scheme in PORTS
    rest = rest[m.end() :] if m else rest
    slash = "/\\" if special else "/"
    both = len(rest) > 1 and rest[0] in slash and rest[1] in slash
    if m and not (special and base and base.scheme == scheme and not both):  # has a scheme, and isn't relative with one
        base = None
        if special and scheme != "file":
            rest = "//" + rest.lstrip("/\\")
        elif not special and not rest.startswith("/"):
            opaque, mark, raw = rest.partition("?")
            return Url(scheme, path=escaped(opaque, set()), query=escaped(raw, QUERY) if mark else None, fragment=fragment)
    elif isinstance(base.path, str):
        return base._replace(fragment=fragment) if not rest and not m and mark else None
    way, mark, raw = rest.partition("?")
    query = escaped(raw, SPECIAL_QUERY if special else QUERY) if mark else None
    if len(way) > 1 and way[0] in slash and way[1] in slash:
        way = "//" + way.lstrip(slash) if special and scheme != "file" else way
        end = min((i for i in (way.find(c, 2) for c in slash) if i >= 0), default=len(way))
        found = _authority(way[2:end], scheme)
        if found is None:
            return None
        path = _path(way[end + 1 :], special, []) if end < len(way) else [""] if special else []
        return Url(scheme, *found, path, query, fragment)
    own = base or Url(scheme, host="" if scheme == "file" else None)
    if way[:1] and way[0] in slash:
        return own._replace(path=_path(way[1:], special, []), query=query, fragment=fragment)
    if way:
        return own._replace(path=_path(way, special, own.path[:-1]), query=query, fragment=fragment)
    return own._replace(path=own.path or [""] * special, query=query if mark else own.query, fragment=fragment)


def absolute(link: str | None, base: str | None = None) -> str:
    """The address of a link on a page, with its fragment; empty if it has none or isn't the web's (http or https)."""
    start = parse(base) if base else None
    found = parse(link or "", start) if link or start else None
    return found.href() if found and found.scheme in ("http", "https") else ""


_PARTS = StructType()
for _name in ("href", "scheme", "host", "port", "path", "query", "fragment"):
    _PARTS.add(_name, StringType())


@F.pandas_udf(StringType())
def web_address(link: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute addresses of links on pages; empty where there is none. An empty or null link is none."""
    return pd.Series([absolute(u, b) if u else "" for u, b in zip(link, base)])


@F.pandas_udf(_PARTS)
def web_parts(url: pd.Series) -> pd.DataFrame:
    """href, scheme, host, port, path, query and fragment of absolute URLs, as an address bar has them; nulls if a text isn't one."""
    rows = []
    for text in url:
        u = parse(text) if text else None
        rows.append((None,) * 7 if u is None else (u.href(), u.scheme, u.host, None if u.port is None else str(u.port), u.path_text(), u.query, u.fragment))
    return pd.DataFrame(rows, columns=_PARTS.names)

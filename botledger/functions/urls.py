"""URL, host and path functions as native columns, reading URLs the way Python's urlsplit does."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from botledger.functions.text import let, percent_decode, strip, web_trim

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _clean(c: Column) -> Column:
    return F.translate(c, "\t\r\n", "")


def _empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def url_host(c: Column) -> Column:
    """Lower-case host of an absolute URL, or null: no scheme, no //, no host, or unbalanced brackets."""
    net = F.regexp_extract(_clean(c), r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    after = F.substring_index(net, "@", -1)
    host = F.when(F.contains(after, F.lit("[")), F.regexp_extract(after, r"(?s)\[([^\]]*)", 1)).otherwise(F.substring_index(after, ":", 1))
    return F.when(F.contains(net, F.lit("[")) == F.contains(net, F.lit("]")), _empty_to_null(F.lower(host)))


def normalize_host(c: Column) -> Column:
    """Lower case, without white space around it, dots at its end and one ``www.`` at its start."""
    h = F.rtrim(F.lower(strip(c)), F.lit("."))
    return F.when(F.startswith(h, F.lit("www.")), F.substring(h, 5, 1 << 30)).otherwise(h)


def url_path(c: Column) -> Column:
    """Path of an absolute URL without query and fragment; null for unbalanced brackets."""
    s = F.regexp_replace(_clean(c), _SCHEME, "")
    net = F.regexp_extract(s, r"(?s)^//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(s, r"(?s)^//[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return F.when(F.contains(net, F.lit("[")) == F.contains(net, F.lit("]")), path)


def normalize_path(c: Column) -> Column:
    """Path of a request target: scheme, host, query and fragment dropped; ``-`` if it can't be read."""
    absolute = F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    path = F.when(absolute, url_path(c)).otherwise(F.regexp_extract(c, r"(?s)^[^?#]*", 0))
    return F.when(path == "", F.lit("/")).otherwise(F.coalesce(path, F.lit("-")))


def request_path(c: Column) -> Column:
    """Path of a request line: its second word, words being parted by single blanks."""
    return F.coalesce(normalize_path(F.get(F.split(c, " ", 3), F.lit(1))), F.lit("-"))


_LOCAL = [".localhost", ".local", ".internal", ".home.arpa"]


def domain_input(c: Column) -> Column:
    """What a domain checker makes of typed text: struct(ok, host, origin, reason).

    ASCII hosts are read natively; other hosts are invalid here (see site_input for these).
    """
    return let(web_trim(c), _typed_site)


def site_input(c: Column) -> Column:
    """domain_input() of text whose host may have letters beyond ASCII."""
    return domain_input(ascii_site(c))


def _typed_site(s: Column) -> Column:
    full = F.when(s.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    net = F.substring_index(F.regexp_extract(full, r"(?s)^[^:]*://([^/?#\\]*)", 1), "@", -1)
    return let(F.struct(s.alias("s"), F.lower(F.substring_index(full, "://", 1)).alias("scheme"), net.alias("net")), _site_parts)


def _site_parts(p: Column) -> Column:
    bracket = F.startswith(p["net"], F.lit("["))
    port = F.when(bracket, F.regexp_extract(p["net"], r"\]:(.*)$", 1)).otherwise(F.regexp_extract(p["net"], r":(.*)$", 1))
    host = F.lower(F.when(bracket, F.regexp_extract(p["net"], r"^(\[[^\]]*\])", 1)).otherwise(percent_decode(F.substring_index(p["net"], ":", 1))))
    return let(F.struct(p["s"].alias("s"), p["scheme"].alias("scheme"), port.alias("port"), F.regexp_replace(host, r"\.$", "").alias("host")), _judge_site)


def _judge_site(p: Column) -> Column:
    host, port, scheme, number = p["host"], p["port"], p["scheme"], p["port"].try_cast("int")
    bracket = F.startswith(host, F.lit("["))
    bad = (
        ~scheme.isin("http", "https") | (host == "") | ((port != "") & (~port.rlike("^[0-9]{1,5}$") | (number > 65535)))
        | (~bracket & host.rlike(r"[^a-z0-9._~!$&'()*+,;=\-]"))
    )
    address = ~bracket & host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
    bad = bad | (address & ~_is_ipv4(host))
    local = (host == "localhost") | ~F.contains(host, F.lit("."))
    for suffix in _LOCAL:
        local = local | F.endswith(host, F.lit(suffix))
    reason = (
        F.when(p["s"] == "", "empty").when(bad, "invalid").when(bracket | address, "ip").when(local, "local")
    )
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    tail = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    ok = reason.isNull()
    return F.struct(
        ok.alias("ok"), F.when(ok, host).alias("host"), F.when(ok, F.concat(F.lit("https://"), host, tail)).alias("origin"), reason.alias("reason")
    )


def _is_ipv4(host: Column) -> Column:
    """Whether a host of numbers is an IPv4 address as browsers read it: one to four parts, decimal, octal or hexadecimal, the last as wide as is left."""
    def number(x: Column) -> Column:
        hexa, octal = F.regexp_extract(x, "^0x0*([0-9a-f]{0,12})$", 1), F.regexp_extract(x, "^0+([0-7]{0,14})$", 1)
        digits = lambda d, base: F.conv(F.when(d == "", F.lit("0")).otherwise(d), base, 10).cast("long")
        return F.when(x.rlike("^0x0*[0-9a-f]{0,12}$"), digits(hexa, 16)).when(x.rlike("^0+[0-7]{0,14}$"), digits(octal, 8)).when(x.rlike("^[1-9][0-9]{0,11}$"), x.try_cast("long"))

    def fits(n: Column) -> Column:
        size = F.size(n)
        small = F.forall(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), lambda x: x < 256)
        known = F.forall(n, lambda x: x.isNotNull())
        return F.coalesce((size <= 4) & known & small & (F.element_at(n, -1) < F.pow(F.lit(256.0), 5 - size)), F.lit(False))

    return let(F.transform(F.split(host, r"\."), number), fits)


_SITE = r"(?s)^(\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#\\]*@)?)([^/?#\\:@]*)(.*)$"


def _ascii_host(host: str) -> str | None:
    """A host's labels as browsers ask for them: folded, normalised and in Punycode; null for signs that no host may hold."""
    kept = "\u00df\u03c2\u200c\u200d"
    folded = unicodedata.normalize("NFKC", "".join(c if c in kept else c.casefold() for c in unicodedata.normalize("NFC", host)))
    labels = re.split("[.\u3002]", folded)
    if any(unicodedata.category(c)[0] in "CZ" and c not in kept for c in "".join(labels)):
        return None
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def ascii_site(c: Column) -> Column:
    """Typed text with its host in Punycode (the one function here that needs Python, in Arrow batches); text with an impossible host stays as it is."""
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            if text.isascii():
                return text
            start, host, rest = re.match(_SITE, text).groups()
            made = _ascii_host(host.rstrip()) if not host.isascii() else host
            return text if made is None else start + made + rest

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(encode, "string")(c)


def check_param(c: Column) -> Column:
    """The site that an address's ``check`` parameter names, as host and port; null if there is none or it isn't a site."""
    raw = F.regexp_extract(c, r"[?&]check=([^&#]*)", 1)
    parsed = domain_input(F.coalesce(F.try_url_decode(raw), raw))
    return F.when(c.rlike(r"[?&]check="), F.regexp_replace(parsed["origin"], "^https://", ""))


def check_link(path: Column, site: Column) -> Column:
    """A page's address that carries a site to check."""
    return F.concat(path, F.lit("?check="), F.url_encode(site))


def strip_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*https?://", "")


def is_url(c: Column) -> Column:
    """Whether a value to check is a URL (else it is taken for a user agent)."""
    return strip(c).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s]+$")


_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


def bare_host_hint(c: Column) -> Column:
    """The URL meant by a bare host (with or without port and one slash), or null if the value isn't one."""
    return F.when(c.rlike(rf"^{_LABEL}(?:\.{_LABEL})+(?::[0-9]{{1,5}})?/?$"), F.concat(F.lit("https://"), F.rtrim(c, F.lit("/")), F.lit("/")))

"""URL expressions: canonical form, hosts and their families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors (fixed values); those beginning with utm_ as well.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
#: Leading labels that don't change who runs a host.
VARIANTS = ("www", "m", "blog")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, sorted query, "/" for an empty path. What
    isn't http(s) is returned trimmed."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)))
    rest = F.array_join(kept, "&")
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z]+://([^/?#:]*)", 1))


def family(url: Column) -> Column:
    """The host without a leading variant label."""
    return F.regexp_replace(host(url), f"^({'|'.join(VARIANTS)})\\.", "")


def in_domain(host_: Column, domain: str) -> Column:
    """Whether a host is the domain or one of its subdomains (no look-alikes)."""
    return (host_ == domain) | host_.endswith(f".{domain}")


def social_profile(url: Column) -> Column:
    """(platform, identifier) of a link to a social profile; null for posts, reserved names and other links."""
    path = F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/([^?#]*)", 1), "/")
    first, second, h = path[0], F.try_element_at(path, F.lit(2)), F.regexp_replace(host(url), r"^(www|m|mobile)\.", "")
    handle = F.regexp_replace(first, "^@", "")
    reserved = F.lower(handle).isin("", "home", "share", "intent", "search", "login", "hashtag", "explore", "watch", "i", "p", "reel", "sharer", "privacy", "about")
    plain = F.coalesce(second, F.lit("")) == ""
    platform = (
        F.when(h.isin("x.com", "twitter.com") & plain & ~reserved, "x")
        .when((h == "instagram.com") & plain & ~reserved, "instagram")
        .when((h == "facebook.com") & plain & ~reserved & ~handle.endswith(".php"), "facebook")
        .when((h == "tiktok.com") & plain & first.startswith("@"), "tiktok")
        .when((h == "youtube.com") & (first.startswith("@") | first.isin("channel", "c", "user")), "youtube")
    )
    identifier = F.when((platform == "youtube") & ~first.startswith("@"), second).otherwise(handle)
    return F.when(platform.isNotNull() & (F.coalesce(identifier, F.lit("")) != ""), F.struct(platform.alias("platform"), identifier.alias("identifier")))

"""Addresses in one canonical form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A query parameter whose name starts with one of these (any case) is tracking noise.
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "ref", "source")

_SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def canonical_url(c: Column) -> Column:
    """The same page always has the same address.

    Scheme and host in lower case, no leading `www.`, no default port, no fragment, no tracking parameters, no trailing
    slashes but the root's, an empty path as `/`. Text that is no http(s) address is only trimmed; NULL stays NULL.
    """
    raw = trimmed(c)
    flat = F.regexp_replace(raw, r"[\t\n\r]", "")
    head = r"(?i)^(https?):/*([^/?#@]*@)?([^/?#:@\s]+)(:\d*)?"
    scheme = F.lower(F.regexp_extract(flat, head, 1))
    user = F.regexp_extract(flat, head, 2)
    host = F.regexp_replace(F.lower(F.regexp_extract(flat, head, 3)), r"^www\.", "")
    port = F.regexp_extract(flat, head, 4)
    port = F.when(port.isin(":", "") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    rest = F.regexp_replace(F.regexp_replace(flat, head, ""), "#.*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    noise = "(?i)^(" + "|".join(TRACKING) + ")"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(noise)), "&")
    whole = F.concat(scheme, F.lit("://"), user, host, port, F.replace(path, F.lit(" "), F.lit("%20")), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(flat.rlike(head), whole).otherwise(raw)

"""URL parts and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom import constants as c

# scheme, host, path of an absolute URL; user info, port, query and fragment are left out
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 3))


def https_host_is(url: Column, *names: str) -> Column:
    return (scheme(url) == "https") & host(url).isin(*names)


def normalized_url(url: Column) -> Column:
    """Trim, complete scheme-relative links and upgrade known licence hosts to https."""
    text = F.trim(F.coalesce(url, F.lit("")))
    upgrade = (scheme(text) == "http") & host(text).isin(*c.UPGRADED_HOSTS)
    return (
        F.when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(upgrade, F.regexp_replace(text, "^[Hh][Tt][Tt][Pp]:", "https:"))
        .otherwise(text)
    )


def normalized_category(category: Column) -> Column:
    """Squeeze blanks and add the category prefix; NULL when nothing is left."""
    text = F.trim(F.regexp_replace(category, r"\s+", " "))
    named = F.when(F.lower(text).startswith("category:"), text).otherwise(F.concat(F.lit("Category:"), text))
    return F.when(text != "", named)

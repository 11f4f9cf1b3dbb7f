"""Parts and structural features of URLs as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.text import clean_alnum

# Fixed value: the brands that are looked for.
BRANDS = ["citibank", "whatsapp", "netflix", "dropbox", "wetransfer", "rakuten", "itau", "outlook", "ebay", "facebook", "hsbc", "linkedin", "instagram", "google", "paypal", "dhl", "alibaba", "bankofamerica", "apple", "microsoft", "skype", "amazon", "yahoo", "wellsfargo", "americanexpress"]
# Fixed value: smallest and largest value of each structural feature, in the model's order.
BOUNDS = {"domain_in_alexa": (0, 2), "domain_len": (1, 121), "domain_numbers": (0, 47), "domain_isalnum": (0, 1), "subdomain_len": (0, 220), "subdomain_numbers_count": (0, 116), "subdomain_parts_count": (1, 25), "tld_len": (0, 24), "tld_parts_count": (1, 3), "queries_amount": (0, 38), "fragments_amount": (0, 1), "path_len": (0, 2610), "path_slash_counts": (0, 23), "path_double_slash_counts": (0, 2), "brand_in_subdomain": (0, 1), "brand_in_path": (0, 1), "path_max_len": (0, 409)}
#: Public suffixes of more than one label that are known; any other last label is a suffix of its own.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "com.br", "co.in", "com.mx", "co.nz", "co.za", "com.cn", "com.tr"]
#: Fixed value: names below which hosts are given out as below a suffix.
FAMILIES = ["ddns", "bazar", "onion"]
# Fixed value: highest ranks of the two classes of popular domains.
TOP, KNOWN = 1_000, 100_000
_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def strip_characters(c: Column, characters: str) -> Column:
    """Without the characters, in any order, at both ends; they are a set, not a prefix."""
    return F.trim(c, F.lit("".join(dict.fromkeys(characters))))


def with_scheme(c: Column) -> Column:
    """Quotes and line ends stripped; http:// put before anything that doesn't start with http."""
    c = F.trim(F.trim(c, F.lit("'")), F.lit("\n"))
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("http://"), c))


def without_prefix(c: Column) -> Column:
    """Scheme and www. taken off in the order ftp, https, http, www; of an ftp address as many
    characters go as https:// has."""
    for p, n in (("ftp://", 8), ("https://", 8), ("http://", 7), ("www.", 4)):
        c = F.when(c.startswith(p), F.substring(c, n + 1, 1_000_000)).otherwise(c)
    return c


def parts(url: Column) -> Column:
    """struct(host, path, query, fragment), each '' if missing; the host in lower case without
    user, port and final dot."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _SPLIT, i), F.lit(""))
    host = F.lower(F.regexp_replace(F.regexp_replace(part(2), "^[^@]*@", ""), r":[0-9]*$", ""))
    return F.struct(F.trim(host, F.lit(".")).alias("host"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


def split_host(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """struct(subdomain, domain, suffix) by the longest known suffix of up to three labels; an IP
    number has no suffix. Below the FAMILIES everybody can register, so they belong to the suffix."""
    labels = F.split(host, "[.]")
    n = F.size(labels)
    last = lambda m: F.array_join(F.slice(labels, F.greatest(n - (m - 1), F.lit(1)), m), ".")
    k = F.when(last(3).isin(list(suffixes)) & (n > 3), 3).when(last(2).isin(list(suffixes)) & (n > 2), 2).otherwise(1)
    k = k + F.when(F.element_at(labels, F.greatest(n - k, F.lit(1))).isin(FAMILIES) & (n > k + 1), 1).otherwise(0)
    ip = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    whole = ip | (n < 2)
    join = lambda a, m: F.array_join(F.slice(labels, a, F.greatest(m, F.lit(0))), ".")
    return F.when(whole, F.struct(F.lit("").alias("subdomain"), host.alias("domain"), F.lit("").alias("suffix"))).otherwise(
        F.struct(join(F.lit(1), n - k - 1).alias("subdomain"), F.element_at(labels, F.greatest(n - k, F.lit(1))).alias("domain"), join(F.greatest(n - k + 1, F.lit(1)), k).alias("suffix")))


def popularity(rank: Column) -> Column:
    """2 for the first TOP ranks, 1 up to KNOWN, 0 beyond and without a rank."""
    return F.when(rank <= TOP, 2).when(rank <= KNOWN, 1).otherwise(0)


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def has_brand(c: Column) -> Column:
    return c.rlike("|".join(BRANDS)).cast("int")


def structural(url: Column, rank: Column) -> list[Column]:
    """The 17 structural features in the model's order, see `features`."""
    p = parts(with_scheme(url))
    return features(p, split_host(p["host"]), rank)


def features(p: Column, h: Column, rank: Column) -> list[Column]:
    """The 17 structural features in the model's order from the parts of the URL and of its host.

    `rank` is 2, 1 or 0 for popular domains. domain_isalnum is 1 for a domain of letters and
    digits only. Parts that are columns of their own keep the generated code short."""
    path = p["path"]
    word = F.split(clean_alnum(path), " ")
    values = [rank, F.length(h["domain"]), digits(h["domain"]), h["domain"].rlike("^[0-9A-Za-z]+$").cast("int"), F.length(h["subdomain"]), digits(h["subdomain"]), F.size(F.split(h["subdomain"], "[.]")), F.length(h["suffix"]), F.size(F.split(h["suffix"], "[.]")),
              F.when(p["query"] == "", 0).otherwise(F.size(F.split(p["query"], "&"))), (p["fragment"] != "").cast("int"), F.length(path), occurrences(path, "/"), occurrences(path, "//"), has_brand(h["subdomain"]), has_brand(path), F.array_max(F.transform(word, F.length))]
    return [v.alias(n) for v, n in zip(values, BOUNDS)]


def normalised(name: str) -> Column:
    lo, hi = BOUNDS[name]
    return ((F.col(name) - lo) / float(hi - lo)).alias(name)

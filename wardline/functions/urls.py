"""URL expressions: parsing, registrable domains, lexical features, rules. All are built-in column functions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions.scores import noisy_or

#: Schemes that execute instead of opening a page.
SCRIPT_SCHEMES = ("javascript", "data")


def parse(url: Column) -> dict[str, Column]:
    """Parts of a URL: scheme, userinfo, host, port, path, query, fragment, normalized.

    Quotes and spaces around are dropped, a missing scheme is http, default ports and
    fragments leave the normalised form. Links that don't parse have a null host.
    """
    raw = F.regexp_replace(url, r"""^[\s"'<>]+|[\s"'<>]+$""", "")
    full = F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^(?:javascript|data|mailto|tel):"), raw).otherwise(F.concat(F.lit("http://"), raw))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(full, r"^[^:]+://([^/?#]*)", 1)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    port = F.regexp_extract(hostport, r":([0-9]+)$", 1).try_cast("int")
    host = F.lower(F.regexp_replace(F.regexp_replace(hostport, r":[0-9]*$", ""), r"\.$", ""))
    host = F.when((F.coalesce(port, F.lit(0)) <= 65535) & (host != ""), host)
    path = F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    shown = F.when(port.isNotNull() & ~port.isin(80, 443), F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit(""))
    normal = F.concat(scheme, F.lit("://"), host, shown, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return {
        "scheme": scheme, "userinfo": F.regexp_extract(authority, r"^(.*)@", 1), "host": host, "port": port,
        "path": path, "query": query, "fragment": F.regexp_extract(full, r"#(.*)$", 1), "normalized": normal,
    }


def is_ip(host: Column) -> Column:
    """Dotted IPv4, bracketed IPv6, hexadecimal or 8-10 digit literals."""
    return F.coalesce(host.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9a-f:.]+\]|0x[0-9a-f]+|[0-9]{8,10})$"), F.lit(False))


def labels(host: Column) -> Column:
    return F.split(host, r"\.")


def suffix_of(host: Column, suffixes: tuple[str, ...] = refdata.PUBLIC_SUFFIXES) -> Column:
    """The longest listed suffix; the last label where none is listed."""
    parts = labels(host)
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.coalesce(F.get(F.filter(tails, lambda t: t.isin(*suffixes)), F.lit(0)), F.element_at(parts, -1))


def registrable(host: Column, suffixes: tuple[str, ...] = refdata.PUBLIC_SUFFIXES) -> Column:
    """The suffix and the label before it; the host itself where it is an IP or a suffix."""
    def whole(h: Column, suffix: Column) -> Column:
        rest = F.substring(h, F.lit(1), F.length(h) - F.length(suffix) - 1)
        own = F.concat(F.element_at(F.split(rest, r"\."), -1), F.lit("."), suffix)
        return F.when(is_ip(h) | (h == suffix), h).otherwise(own)

    # the host and its suffix are named once, so that they are computed once
    found = F.transform(F.array(host), lambda h: F.struct(h.alias("h"), suffix_of(h, suffixes).alias("s")))
    return F.get(F.transform(found, lambda x: whole(x["h"], x["s"])), F.lit(0))


def registrable_join(df: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``registrable`` by a suffix table (suffix, and kind: exact, wildcard or exception; exact without it) of any size.

    All ends of each host are joined with the rules on equal keys. A wildcard makes one label
    more than its suffix public, an exception one less; an exception goes before, then the longest.
    """
    parts = labels(F.col(host))
    n = F.size(parts)
    kind = F.col("kind") if "kind" in rules.columns else F.lit("exact")
    table = rules.select("suffix", kind.alias("__kind")).distinct()
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, i, n), ".").alias("suffix"), (n - i + 1).alias("k")))
    tails = df.select(host).distinct().filter(F.col(host).isNotNull()).select(host, n.alias("__n"), F.explode(ends).alias("e")).select(host, "__n", "e.*")
    public = F.col("k") + F.when(F.col("__kind") == "wildcard", 1).when(F.col("__kind") == "exception", -1).otherwise(0)
    met = tails.join(table, "suffix").withColumn("__public", public).filter(F.col("__public") <= F.col("__n"))
    best = met.groupBy(host).agg(F.max(F.struct((F.col("__kind") == "exception").alias("e"), F.col("__public").alias("p")))["p"].alias("__p"))
    out = df.join(best, host, "left").withColumn("__p", F.coalesce("__p", F.lit(1)))
    own = F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.col("__p")), n), ".")
    return out.withColumn("registrable", F.when(is_ip(F.col(host)), F.col(host)).otherwise(own)).drop("__p")


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    distinct = F.array_sort(F.array_distinct(chars))
    share = lambda c: (F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(distinct, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def _count(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)))


def has_suffix(host: Column, roots: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [(host == r) | host.endswith(f".{r}") for r in roots])


def lexical_features(p: dict[str, Column]) -> dict[str, Column]:
    """The lexical features of a parsed URL that need no script tables; 0 where it has no host."""
    ok = p["host"].isNotNull()
    host = F.when(p["host"].rlike(r"^www\..*\."), F.regexp_replace(p["host"], r"^www\.", "")).otherwise(p["host"])
    u = F.regexp_replace(F.regexp_replace(p["normalized"], r"^[a-z][a-z0-9+.-]*://", ""), r"^www\.", "")
    path, query, reg = p["path"], p["query"], registrable(p["host"])
    before = F.when(F.length(p["host"]) > F.length(reg), F.substring(p["host"], F.lit(1), F.length(p["host"]) - F.length(reg) - 1)).otherwise("")
    subs = F.filter(F.split(before, r"\."), lambda x: (x != "") & (x != "www"))
    tokens = F.split(F.lower(F.concat(path, F.lit("?"), query)), r"[/\-._?=&]+")
    n_len = lambda c: F.length(c).cast("long")
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    label = F.element_at(F.split(reg, r"\."), 1)
    lower_path = F.lower(path)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.lower(F.element_at(F.split(x, "="), 1)))
    out = {
        "url_len": n_len(u), "host_len": n_len(host), "path_len": n_len(path), "query_len": n_len(query),
        "n_dots": _count(host, r"\."), "n_subdomains": F.size(subs),
        "digit_ratio": F.round(_count(u, r"\p{Nd}") / F.greatest(F.lit(1), F.length(u)), 6),
        "special_ratio": F.round(_count(u, r"[^\p{L}\p{N}]") / F.greatest(F.lit(1), F.length(u)), 6),
        "n_hyphens": _count(host, "-"), "n_underscores": _count(u, "_"), "n_slashes": _count(path, "/"),
        "has_at": flag(F.element_at(F.split(u, r"\?"), 1).contains("@") | (p["userinfo"] != "")),
        "n_percent": _count(u, "%"), "is_ip": flag(is_ip(p["host"])), "has_port": flag(p["port"].isNotNull() & ~p["port"].isin(80, 443)),
        "is_punycode": flag(p["host"].contains("xn--")), "suspicious_tld": flag(F.element_at(labels(p["host"]), -1).isin(*refdata.SUSPICIOUS_TLDS)),
        "n_keywords": reduce(lambda a, b: a + b, [F.lower(u).contains(k).cast("long") for k in refdata.KEYWORDS]),
        "is_shortener": flag(reg.isin(*refdata.SHORTENERS) | p["host"].isin(*refdata.SHORTENERS)), "free_hosting": flag(has_suffix(p["host"], refdata.FREE_HOSTING)),
        "host_entropy": F.round(entropy(host), 6), "path_entropy": F.round(entropy(F.concat(path, query)), 6),
        "hex_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.lower(u), F.lit("([0-9a-f]{8,})"), F.lit(1)), F.length)), F.lit(0)),
        "longest_token": F.coalesce(F.array_max(F.transform(tokens, F.length)), F.lit(0)),
        "random_path": flag(F.exists(tokens, lambda t: (F.length(t) >= 12) & (entropy(t) > 3.5))),
        "n_susp_params": F.size(F.filter(keys, lambda k: k.isin(*refdata.SUSPICIOUS_PARAMS))), "n_params": F.size(keys),
        "double_slash_path": flag(path.contains("//")), "tld_len": n_len(F.element_at(labels(p["host"]), -1)), "n_host_digits": _count(p["host"], "[0-9]"),
        "host_vowel_ratio": F.round(_count(F.lower(label), "[aeiou]") / F.greatest(F.lit(1), F.length(label)), 6),
        "has_file_ext": flag(lower_path.rlike(r"\.[a-z0-9]{2,4}$")), "exec_ext": flag(lower_path.rlike(rf"\.(?:{'|'.join(refdata.EXECUTABLES)})$")),
        "n_embedded_domains": _count(F.lower(F.concat(path, query)), r"(?:[a-z0-9-]+\.)+(?:com|net|org|in|co|io)\b"), "reg_len": n_len(reg),
    }
    kinds = {n: "double" if n.endswith(("ratio", "entropy")) else "long" for n in out}
    return {n: F.when(ok, c).otherwise(F.lit(0)).cast(kinds[n]).alias(n) for n, c in out.items()}


#: Link rules that the features alone decide: (id, weight, condition).
def link_rules(p: dict[str, Column], f: dict[str, Column]) -> list[tuple[str, float, Column]]:
    on = lambda n: F.col(n) > 0 if n not in f else f[n] > 0
    return [
        ("script_url", 0.7, p["scheme"].isin(*SCRIPT_SCHEMES)),
        ("ip_host", 0.35, on("is_ip")), ("userinfo", 0.4, on("has_at")), ("punycode", 0.25, on("is_punycode")),
        ("shortener", 0.15, on("is_shortener")), ("free_hosting", 0.18, on("free_hosting")), ("suspicious_tld", 0.12, on("suspicious_tld")),
        ("deep_subdomains", 0.15, f["n_subdomains"] >= 4), ("port", 0.12, on("has_port")), ("executable", 0.45, on("exec_ext")),
        ("cred_keywords", 0.1, f["n_keywords"] >= 2), ("redirect_param", 0.08, on("n_susp_params")),
        ("http_sensitive", 0.1, (p["scheme"] == "http") & on("n_keywords")), ("random_path", 0.06, on("random_path")),
    ]


def rule_hits(rules: list[tuple[str, float, Column]]) -> Column:
    """Array of (id, weight) of the rules that hold, in order."""
    hits = F.array(*[F.when(c, F.struct(F.lit(i).alias("id"), F.lit(w).alias("weight"))) for i, w, c in rules])
    return F.filter(hits, lambda h: h.isNotNull())


def url_score(hits: Column, model: Column | None = None, user_content: Column | None = None, trusted: Column | None = None, concrete: Column | None = None) -> Column:
    """Rules and model as one score of 0 to 100; the model weighs more beside concrete rules, trusted links are capped."""
    rule = noisy_or(F.transform(hits, lambda h: h["weight"]))
    if model is None:
        score = rule
    else:
        weight = F.when(concrete if concrete is not None else F.size(hits) > 0, 0.8).otherwise(0.45)
        score = F.when(model.isNull(), rule).otherwise(1 - (1 - rule) * (1 - weight * model))
    if user_content is not None:
        score = F.when(user_content, F.least(score, F.greatest(rule, F.lit(0.55)))).otherwise(score)
    if trusted is not None:
        score = F.when(trusted, F.least(score, F.greatest(rule * 0.6, F.lit(0.02)))).otherwise(score)
    return score * 100


def dedup_key(url: Column) -> Column:
    """Lower case, without scheme, www. and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?", ""), "/+$", "")


def char_ngrams(url: Column, sizes: tuple[int, ...] = (3, 4, 5), limit: int | None = None) -> Column:
    """Character n-grams of the marked URL; the prior system's feature takes the first 200 characters as ``limit``."""
    marked = F.concat(F.lit("^"), url if limit is None else F.substring(url, 1, limit), F.lit("$"))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[grams(n) for n in sizes]))


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null where an octet is out of range."""
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("long")
    valid = reduce(lambda a, b: a & b, [part(i).between(0, 255) for i in range(4)])
    return F.when(valid, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def private_ranges() -> list[tuple[int, int]]:
    """First and last number of each non-public IPv4 block."""
    out = []
    for net, bits in refdata.PRIVATE_BLOCKS:
        low = int.from_bytes(bytes(int(x) for x in net.split(".")), "big")
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def bound(value: Column, f) -> Column:
    """``f`` of a value that it uses several times, worked out once: the plan holds the value's expression once too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 address, in brackets or not; null for anything else."""
    none = F.array().cast("array<string>")
    hexed = lambda n: F.lower(F.conv(n.cast("string"), 10, 16))

    def flat(bare: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(bare, r":([0-9.]+\.[0-9.]+)$", 1))
        return bound(tail, lambda t: F.when(t.isNotNull(), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), hexed(F.floor(t / 65536)), F.lit(":"), hexed(t % 65536))).otherwise(bare))

    def filled(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), none)
        fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (F.size(left) + F.size(right) < 8), F.concat(left, fill, right))

    def numbers(groups: Column) -> Column:
        valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))

    split = lambda x: bound(F.transform(F.split(x, "::"), lambda side: F.filter(F.split(side, ":"), lambda g: g != "")), lambda sides: bound(filled(sides), numbers))
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), "%.*$", "")
    return F.when(host.contains(":"), bound(bound(bare, flat), split))


def _in_block(groups: Column, network: str, bits: int) -> Column:
    packed = ipaddress.IPv6Address(network).packed
    rules = []
    for k in range(-(-bits // 16)):
        mask = 0xFFFF & ~((1 << (16 - min(16, bits - 16 * k))) - 1)
        rules.append(F.get(groups, F.lit(k)).bitwiseAND(F.lit(mask)) == int.from_bytes(packed[2 * k : 2 * k + 2], "big") & mask)
    return reduce(lambda a, b: a & b, rules)


def blocked_target(host: Column) -> Column:
    """Whether a host is private, reserved, an address in disguise or a broken one; IPv4 inside IPv6 counts as itself."""
    off = F.lit(False)

    def rated(groups: Column) -> Column:
        mapped = F.when(_in_block(groups, *refdata.PRIVATE_BLOCKS_6[-1]), F.get(groups, F.lit(6)).cast("long") * 65536 + F.get(groups, F.lit(7)))
        inside = lambda number: reduce(lambda a, b: a | b, [number.between(lo, hi) for lo, hi in private_ranges()])
        inside4 = bound(F.coalesce(ipv4_number(host), mapped), lambda n: F.coalesce(inside(n), off))
        inside6 = reduce(lambda a, b: a | b, [_in_block(groups, *n) for n in refdata.PRIVATE_BLOCKS_6[:-1]])
        return F.coalesce(inside4, off) | F.coalesce(inside6, off) | F.coalesce(host.rlike(r"^\[.*\]$") & groups.isNull(), off)

    name = host.isin(*refdata.PRIVATE_NAMES) | reduce(lambda a, b: a | b, [host.endswith(e) for e in refdata.PRIVATE_ENDINGS])
    broken = host.rlike(r"^(?:0x[0-9a-f]+|[0-9]{8,10})$") | (host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & ipv4_number(host).isNull())
    return F.coalesce(name, off) | F.coalesce(broken, off) | bound(ipv6_groups(host), rated)


def shareable(p: dict[str, Column], url: Column) -> tuple[Column, Column]:
    """(kind, value) that may leave the house: links with personal data are reduced to their host, private ones to nothing."""
    personal = p["query"].rlike(refdata.PII_PARAM) | url.rlike(refdata.EMAIL_IN_URL)
    no = p["host"].isNull() | blocked_target(p["host"])
    return F.when(no, None).when(personal, "domain").otherwise("url"), F.when(no, None).when(personal, p["host"]).otherwise(p["normalized"])

"""Look-alike joins: equal skeletons, one edit, letters moved, protected names inside subdomains; and generated attacks.

Each is an equi-join on a derived key, so nothing compares all names with all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import skeleton


def by_skeleton(names: DataFrame, protected: DataFrame) -> DataFrame:
    """(name, target): different spellings that look the same. Both sides have a column ``name``."""
    a = names.select("name", skeleton(F.col("name")).alias("s"))
    b = protected.select(F.col("name").alias("target"), skeleton(F.col("name")).alias("s"))
    return a.join(b, "s").filter("name <> target").select("name", "target").distinct()


def deletions(name: Column) -> Column:
    """The name and all spellings with one letter left out."""
    n = F.length(name)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n)))
    return F.array_distinct(F.concat(F.array(name), less))


def swapped(a: Column, b: Column) -> Column:
    """Whether two neighbouring letters of ``a`` swapped give ``b``."""
    n = F.length(a)
    at = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n))
    return (n == F.length(b)) & (n > 1) & (a != b) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: at(i) == b)


def swaps(name: Column) -> Column:
    """All spellings with two neighbours swapped."""
    n = F.length(name)
    at = lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.lit(1)), F.substring(name, i, F.lit(1)), F.substring(name, i + 2, n))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), at)).otherwise(F.array().cast("array<string>"))


def edits(a: Column, b: Column) -> Column:
    """Edits and swaps of neighbours between two names, up to 2; 3 stands for more."""
    plain = F.levenshtein(a, b)
    one = F.exists(swaps(a), lambda s: s == b)
    two = F.exists(swaps(a), lambda s: F.levenshtein(s, b) <= 1) | F.exists(swaps(b), lambda s: F.levenshtein(s, a) <= 1) | F.arrays_overlap(swaps(a), swaps(b))
    return F.when(a == b, 0).when((plain == 1) | one, 1).when((plain == 2) | two, 2).otherwise(3)


def by_typos(names: DataFrame, protected: DataFrame, most: int = 2, long: int = 8) -> DataFrame:
    """(name, target, distance): names up to ``most`` (1 or 2) edits or swaps away; two only for targets of ``long`` letters and more.

    Names within two edits share a spelling with at most two letters left out.
    """
    fewer = lambda c: F.array_distinct(F.flatten(F.transform(deletions(c), deletions))) if most > 1 else deletions(c)
    a = names.select("name").distinct().select("name", F.explode(fewer(F.col("name"))).alias("d"))
    b = protected.select("name").distinct().select(F.col("name").alias("target"), F.explode(fewer(F.col("name"))).alias("d"))
    pairs = a.join(b, "d").filter("name <> target").select("name", "target").distinct().withColumn("distance", edits(F.col("name"), F.col("target")))
    return pairs.filter((F.col("distance") == 1) | ((F.col("distance") <= most) & (F.length("target") >= long)))


def by_typo(names: DataFrame, protected: DataFrame) -> DataFrame:
    """(name, target, distance): names one edit or one swap of neighbours away.

    Names within one edit share a spelling with at most one letter left out, so the
    join on these spellings finds all; the distance is checked afterwards.
    """
    a = names.select("name", F.explode(deletions(F.col("name"))).alias("d"))
    b = protected.select(F.col("name").alias("target"), F.explode(deletions(F.col("name"))).alias("d"))
    pairs = a.join(b, "d").filter("name <> target").select("name", "target").distinct()
    near = pairs.withColumn("distance", F.levenshtein("name", "target", 2)).filter((F.col("distance") == 1) | swapped(F.col("name"), F.col("target")))
    return near.withColumn("distance", F.lit(1))


def by_anagram(names: DataFrame, protected: DataFrame, moved: int = 4) -> DataFrame:
    """(name, target): the same letters, the same first one, at most ``moved`` places different."""
    letters = lambda c: F.array_join(F.array_sort(F.split(F.col(c), "")), "")
    a = names.select("name", letters("name").alias("s"))
    b = protected.select(F.col("name").alias("target"), letters("name").alias("s"))
    places = F.size(F.filter(F.zip_with(F.split("name", ""), F.split("target", ""), lambda x, y: x != y), lambda d: d))
    pairs = a.join(b, "s").filter("name <> target and left(name, 1) = left(target, 1)")
    return pairs.withColumn("moved", places).filter(F.col("moved") <= moved).select("name", "target", "moved").distinct()


def best_target(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """The first target of each name in the given order."""
    return pairs.groupBy("name").agg(F.min_by("target", F.struct(*order)).alias("target"))


def spoofed_subdomains(hosts: DataFrame, protected: DataFrame) -> DataFrame:
    """(host, target, at, parts): protected domains (domain) that stand inside a host's subdomain, the first slice of each host.

    Slices are two to four labels long; the last ones, which make the host's own domain, are left out.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    cells = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.struct(i.alias("at"), k.alias("parts"), F.array_join(F.slice(labels, i, k), ".").alias("domain")))))
    slices = hosts.select("host", F.explode(F.filter(cells, lambda c: c["at"] + c["parts"] <= n)).alias("c")).select("host", "c.*")
    found = slices.join(protected.select("domain").distinct(), "domain")
    return found.groupBy("host").agg(F.min(F.struct("at", "parts", "domain")).alias("m")).select("host", F.col("m.domain").alias("target"), F.col("m.at").alias("at"), F.col("m.parts").alias("parts"))


def attacks(names: DataFrame) -> DataFrame:
    """(name, kind, attack): every omission, repetition and swap of neighbours, look-alike digits, and joined words."""
    name, n = F.col("name"), F.length("name")
    cut = lambda a, b: F.substring(name, a, b)
    spots = F.sequence(F.lit(1), n)
    kinds = {
        "omission": F.transform(spots, lambda i: F.concat(cut(F.lit(1), i - 1), cut(i + 1, n))),
        "repetition": F.transform(spots, lambda i: F.concat(cut(F.lit(1), i), cut(i, n))),
        "transposition": F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(cut(F.lit(1), i - 1), cut(i + 1, F.lit(1)), cut(i, F.lit(1)), cut(i + 2, n))),
        "substitution": F.array(F.translate(name, "ol", "01"), F.translate(name, "ei", "31")),
        "combosquat": F.array(F.concat(name, F.lit("-login")), F.concat(F.lit("secure-"), name)),
    }
    named = lambda kind, v: F.transform(v, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("attack")))
    made = F.flatten(F.array(*[named(k, v) for k, v in kinds.items()]))
    return names.select("name", F.explode(F.array_distinct(made)).alias("m")).select("name", "m.kind", "m.attack").filter("attack <> name and attack <> ''")


#: Neighbours on a QWERTY keyboard, row by row.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Letters of other scripts that look like Latin ones.
_FOREIGN = ("aeopcxy", "аеорсху")


def wider_attacks(names: DataFrame, suffix: str = "com") -> DataFrame:
    """(name, kind, attack): a neighbouring key for each letter, letters of other scripts, the name as a subdomain, under other suffixes, with hyphens."""
    name, n = F.col("name"), F.length("name")
    spots = F.sequence(F.lit(1), n)
    put = lambda i, c: F.concat(F.substring(name, F.lit(1), i - 1), c, F.substring(name, i + 1, n))
    left = {b: a for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
    right = {a: b for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
    shift = lambda table: F.transform(spots, lambda i: put(i, F.translate(F.substring(name, i, F.lit(1)), "".join(table), "".join(table.values()))))
    dot = F.lit(f".{suffix}")
    kinds = {
        "keyboard": F.concat(shift(left), shift(right)), "homoglyph": F.transform(spots, lambda i: put(i, F.translate(F.substring(name, i, F.lit(1)), *_FOREIGN))),
        "subdomain": F.array(F.concat(name, dot, F.lit(".verify.example")), F.concat(F.lit("login."), name, F.lit("-secure.example"))), "tld_swap": F.transform(F.array(*map(F.lit, ("net", "org", "xyz", "top"))), lambda t: F.concat(name, F.lit("."), t)),
        "hyphenation": F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i), F.lit("-"), F.substring(name, i + 1, n))),
    }
    named = lambda kind, v: F.transform(F.array_distinct(v), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("attack")))
    return names.select("name", F.explode(F.flatten(F.array(*[named(k, v) for k, v in kinds.items()]))).alias("m")).select("name", "m.kind", "m.attack").filter("attack <> name")

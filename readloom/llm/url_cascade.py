"""URL rules and an exact host list as a cascade of Bloom filters (DataFrame functions only).

The universe holds every host of the corpus; listed are those on the list or below a domain on it.
Level 1 encodes the listed hosts; level 2 those of the rest that level 1 lets through by mistake;
level 3 the listed ones that level 2 lets through, and so on until none are. A host is listed if
the first level that refuses it is an even one (or if none does and the last is odd). Over the
universe this is exact, and the urls are judged without a join: the filters come in as scalar
subqueries of one row, of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.runtime import checkpointed

#: (verdict, rule): host and start of the path; the rule's host fits itself and its subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Domains that are blocked with all their subdomains.
LISTED = ("casino-win.example.org", "cheap-pills.example.com", "spam-farm.example.org", "malware-drop.example.net", "phish-bank.example.com")
HASHES = 5
BITS_PER_KEY = 8
#: A level's filter has at most so many bits (1 MB). Where there are more keys, they are cut into parts by
#: a hash, each with a cascade of its own, so that what a task holds stays as it is.
MAX_BITS = 1 << 23

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path from there to '?', '#' or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are put in front later
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domains_of(host: Column) -> Column:
    """The host and its parent domains; an empty host has none."""
    labels = F.split(host, r"\.")
    all_of = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", all_of).otherwise(F.array().cast("array<string>"))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    low, high = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(1)
    return [F.pmod(low + high * i, F.lit(bits)) for i in range(HASHES)]


def _filter_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the filter of all keys as 64-bit words."""
    spark = keys.sparkSession
    set_bits = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("bit"))
    words = set_bits.groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    blank = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    dense = words.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x.mask).alias("words"))


def _passes(key: Column, words: Column, level: int, bits: int) -> Column:
    hit = lambda p: F.getbit(F.get(words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
    return reduce(lambda a, b: a & b, [hit(p) for p in _positions(key, level, bits)])


class Cascade:
    """Levels of filters for each part of the keys; judged() is exact for every key of the universe they were built over."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int | None = None):
        """universe: distinct keys; listed: keys, of which those in the universe count. Nulls are left out."""
        most = max_bits or MAX_BITS
        marked = universe.where("key is not null").join(listed.select("key").distinct().withColumn("on_list", F.lit(True)), "key", "left").select("key", F.coalesce("on_list", F.lit(False)).alias("on_list"))
        marked = checkpointed(marked)
        n = marked.agg(F.count("*").alias("all"), F.count(F.when(F.col("on_list"), 1)).alias("listed")).first()
        # the second level holds about one in 46 of the keys that aren't listed
        self.parts = max(1, -(-max(n.listed, n["all"] // 32) * BITS_PER_KEY // most))
        self.levels: list[list[tuple[DataFrame, int]]] = []
        for part in range(self.parts):
            keys = marked.where(self.part(F.col("key")) == part) if self.parts > 1 else marked
            inside, outside = keys.where("on_list").select("key"), keys.where("not on_list").select("key")
            levels: list[tuple[DataFrame, int]] = []
            while count := inside.count():
                bits = min(most, max(64, 1 << (count * BITS_PER_KEY - 1).bit_length()))
                words = checkpointed(_filter_words(inside, len(levels) + 1, bits))
                levels.append((words, bits))
                inside, outside = checkpointed(outside.where(_passes(F.col("key"), words.scalar(), len(levels), bits))), inside
            self.levels.append(levels)

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.parts))

    def contains(self, key: Column, part: int = 0) -> Column:
        """Whether a key of that part of the universe is listed."""
        levels = self.levels[part]
        verdict = F.lit(len(levels) % 2 == 1)
        for level in range(len(levels), 0, -1):
            words, bits = levels[level - 1]
            verdict = F.when(_passes(key, words.scalar(), level, bits), verdict).otherwise(F.lit(level % 2 == 0))
        return verdict

    def judged(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with the boolean column name; one scan of rows for each part, no join."""
        one = lambda part: (rows.where(self.part(F.col(key)) == part) if self.parts > 1 else rows).withColumn(name, self.contains(F.col(key), part))
        return reduce(DataFrame.unionByName, map(one, range(self.parts)))


def url_verdicts(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, listed, verdict for each row of pages (page_id, url; more columns are ignored).

    verdict: the longest fitting rule's, else 'block' if the host or a parent domain is listed, else
    'allow'. Null urls and urls without '://' have empty host and path, fit no rule and are allowed.
    Repeated rows come back as often as they came in. An empty table gives an empty table. listed: a
    table with column key, by default LISTED.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = checkpointed(pages.select(host.alias("key")).distinct())
    bad = hosts.select("key", F.explode(domains_of(F.col("key"))).alias("domain")).join(listed.select(F.col("key").alias("domain")), "domain", "left_semi").select("key").distinct()
    judged = Cascade(hosts, bad).judged(parsed, "host", "listed")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def _oracle() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    listed = ", ".join(f"('{d}')" for d in LISTED)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM u),
r AS (SELECT * FROM (VALUES {rules}) AS t(verdict, rule, domain, start)),
d AS (SELECT * FROM (VALUES {listed}) AS t(domain)),
m AS (SELECT p.rid, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.start) GROUP BY p.rid),
l AS (SELECT DISTINCT p.rid FROM p JOIN d ON p.host = d.domain OR ends_with(p.host, '.' || d.domain))
SELECT page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN l.rid IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.rid IS NOT NULL AS listed
FROM p LEFT JOIN m USING (rid) LEFT JOIN l USING (rid)
"""


#: The same rows in DuckDB's SQL.
ORACLE = _oracle()

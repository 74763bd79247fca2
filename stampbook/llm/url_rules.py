"""URL filters: pattern rules indexed by their rarest literal token; only rules fetched by a URL's tokens run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.llm.common import small_broadcast, tidy

#: Site rules: host and path joined, with the verdict for that host, its subdomains, and paths that start so.
SITES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Wildcard patterns over the whole address, for what no site rule decides. ``*`` stands for any text.
PATTERNS = [
    ("*/login/*", "block"), ("*/signin/*", "block"), ("*/cart/*", "block"), ("*/checkout/*", "block"), ("*/ads/*", "block"),
    ("*.casino.*", "block"), ("*/casino/*", "block"), ("*.porn.*", "block"), ("*/porn/*", "block"), ("*/wp-admin/*", "block"),
    ("*-farm.*", "block"), ("*onlinecasino*", "block"), ("*%00*", "block"), ("*/casino/licence/*", "allow"),
]
#: Numbered servers, slots and pages of advertisements, in families of so many rules. The first three share a word; its number tells them apart.
NUMBERED = 1000
FAMILIES = ["*/banner/{}/*", "*/popup/{}/*", "*/slot/{}?*", "*.ads{}.*", "*.track{}.*", "*/ad{}.html*"]
PATTERNS += [(family.format(i), "block") for family in FAMILIES for i in range(NUMBERED)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"://([^/?#]*)([^?#]*)"
MAX_BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to the path, lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_\s])", r"\\$1")


def rule_table(spark: SparkSession, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """Rules as rows: label, verdict, site, subject (text whose tokens index the rule), regex, rank (site rules first, then longest)."""
    rows = [(r, v, True) for r, v in sites] + [(r, v, False) for r, v in patterns]
    rules = spark.createDataFrame(rows, "label string, verdict string, site boolean")
    # the address starts with a dot, so that a host is found at its own start and after each subdomain
    site_regex = F.concat(F.lit(r"^[^/?#]*\."), _quoted(F.col("label")))
    pattern_regex = F.concat(F.lit("(?s)^"), F.regexp_replace(_quoted(F.col("label")), r"\\\*", ".*"), F.lit("$"))
    return rules.select(
        "label", "verdict", "site",
        F.when(F.col("site"), F.concat(F.lit("."), "label", F.lit("*"))).otherwise(F.col("label")).alias("subject"),
        F.when(F.col("site"), site_regex).otherwise(pattern_regex).alias("regex"),
        (F.length("label") + F.when(F.col("site"), 1 << 20).otherwise(0)).alias("rank"),
    )


def _rule_tokens(subject: Column) -> Column:
    """Literal tokens that every matching address must hold whole: bounded on both sides by a separator, not by a wildcard."""
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0)))


def _address_tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(address, r"[^A-Za-z0-9]+"), lambda t: t != ""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """Verdict for every row's url: the longest fitting site rule's, else the longest fitting pattern's, else ``default``.

    Result: key, host, path, rule (the deciding site rule, else missing), verdict, pattern (the deciding pattern, else missing);
    one row per input row. Missing urls and those without :// have an empty host and path and get the default verdict.
    Addresses are judged once each, however many rows hold them. Equally long rules: the larger label wins. Rules without a
    literal token are candidates of every address. Only the key and url columns are used.
    """
    url = pages.select(F.col(key), F.col("url"))
    addresses = url.where(F.col("url").contains("://")).select("url").distinct()
    rest = F.regexp_extract("url", r"(?s)://[^/?#]*[^?#]*(.*)$", 1)
    addresses = addresses.select("url", F.concat(F.lit("."), host_of(F.col("url")), path_of(F.col("url")), rest).alias("address"))
    exploded = addresses.select("url", "address", F.explode(F.array_append(_address_tokens(F.col("address")), F.lit(""))).alias("token"))

    listed = rules.select("*", F.explode_outer(_rule_tokens(F.col("subject"))).alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    held = exploded.join(small_broadcast(listed.select("token").distinct(), MAX_BROADCAST_RULES), "token").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    listed = listed.join(held, "token", "left")
    rarest = F.min_by(F.struct("token", "verdict", "site", "regex", "rank"), F.struct(F.coalesce("held", F.lit(0)), "token")).alias("r")
    index = listed.groupBy("label", "subject").agg(rarest).select("label", "r.*")

    found = exploded.join(small_broadcast(index, MAX_BROADCAST_RULES), "token").where(F.regexp_like("address", F.col("regex")))
    best = found.groupBy("url").agg(F.max_by(F.struct("label", "verdict", "site"), F.struct("rank", "label")).alias("best"))
    judged = url.join(best, "url", "left")
    return judged.select(
        key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("best.site"), F.col("best.label")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.label")).alias("pattern"),
    )


@tidy
def op3_url_rules(spark, folder: str) -> DataFrame:
    """Every page's url against the site rules and patterns."""
    return judge(spark.read.parquet(f"{folder}/pages.parquet"), rule_table(spark))


def _sql_patterns() -> str:
    like = lambda label: label.replace("%", "!%").replace("_", "!_").replace("*", "%")
    return ", ".join(f"({len(label)}, '{label}', '{verdict}', '{like(label)}')" for label, verdict in PATTERNS)


CHECK = f"""
WITH a AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '{ADDRESS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*[^?#]*(.*)$', 1, 's'), '') AS rest FROM pages),
sites(label, host, path, verdict) AS (VALUES {", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in SITES)}),
patterns(rank, label, verdict, shape) AS (VALUES {_sql_patterns()}),
site AS (SELECT a.page_id, max_by(s.label, printf('%05d%s', length(s.label), s.label)) AS label, max_by(s.verdict, printf('%05d%s', length(s.label), s.label)) AS verdict FROM a JOIN sites s
    ON (a.host = s.host OR ends_with(a.host, '.' || s.host)) AND starts_with(a.path, s.path) GROUP BY 1),
pat AS (SELECT a.page_id, max_by(p.label, printf('%05d%s', p.rank, p.label)) AS label, max_by(p.verdict, printf('%05d%s', p.rank, p.label)) AS verdict FROM a JOIN patterns p
    ON '.' || a.host || a.path || a.rest LIKE p.shape ESCAPE '!' WHERE a.url LIKE '%://%' GROUP BY 1)
SELECT a.page_id, a.host, a.path, site.label AS rule, coalesce(site.verdict, pat.verdict, 'allow') AS verdict,
    CASE WHEN site.label IS NULL THEN pat.label END AS pattern
FROM a LEFT JOIN site USING (page_id) LEFT JOIN pat USING (page_id)"""

"""URL rules, found by the rarest literal token of each rule; only fetched rules run their regular expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (rule, action): host and path prefix; fits the host and its subdomains; the longest rule wins.
SITE_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: (rule, action): `||` start of a host label, `|` start or end, `*` anything, `^` a separator or the end.
PATTERN_RULES = [
    ("||spam-farm.", "block"), ("||casino-win.", "block"), ("/casino/", "block"), ("||ads.", "block"), ("/adserver/", "block"),
    ("/wp-login.php^", "block"), ("?replytocom=*", "block"), ("&sessionid=*", "block"), ("||example.org/en/", "allow"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and rest (path, query and fragment); all empty for null or where there is no `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    tail = F.when(at > 0, F.expr(f"substr(coalesce({url}, ''), instr(coalesce({url}, ''), '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("uf__tail", tail)
    return (
        df.withColumn("host", F.translate(F.regexp_extract("uf__tail", r"(?s)^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("rest", F.regexp_extract("uf__tail", r"(?s)^[^/?#]*(.*)$", 1))
        .withColumn("path", F.regexp_extract("uf__tail", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("uf__tail")
    )


def rule_table(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """rule, action, site (a host and path rule), regex over `//host` + rest, and the rule's whole literal tokens."""
    rows = [(r, f"||{r}", a, True) for r, a in site_rules] + [(r, r, a, False) for r, a in pattern_rules]
    return compile_rules(spark.createDataFrame(rows, "rule string, pattern string, action string, site boolean"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Add regex and tokens to (rule, pattern, action, site), all in SQL, so a large list is compiled in parallel.

    A token counts only where both its neighbours in the pattern end it for sure: the next character of the URL
    must be no letter or digit either. The first and last token count only beside an anchor or a separator.
    """
    regex = F.regexp_replace("pattern", r"([.+?${}()\[\]\\/-])", r"\\$1")
    regex = F.regexp_replace(regex, r"^\|\|", "\x01")
    regex = F.regexp_replace(regex, r"^\|", "\x02")
    regex = F.regexp_replace(regex, r"\|$", "\x03")
    regex = F.regexp_replace(regex, r"\*", ".*")
    regex = F.regexp_replace(regex, r"\^", "(?:[^A-Za-z0-9_.%-]|\x03)")
    regex = F.replace(regex, F.lit("\x01"), F.lit(r"^//(?:[^/?#]*\.)?"))
    regex = F.replace(F.replace(regex, F.lit("\x02"), F.lit("^")), F.lit("\x03"), F.lit("$"))
    bounded = r"(?:^\|{1,2}|[^A-Za-z0-9*|])([A-Za-z0-9]+)(?=[^A-Za-z0-9*]|\|$)"
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("pattern", F.lit(bounded), F.lit(1)), F.lower))
    return rules.select("*", F.concat(F.lit("(?s)"), regex).alias("regex"), tokens.alias("tokens"))


def url_tokens(urls: DataFrame) -> DataFrame:
    """Each distinct token of `//host` + rest once, and the empty token, that rules without a token have."""
    target = F.concat(F.lit("//"), "host", "rest")
    words = F.regexp_extract_all(F.lower(target), F.lit("[a-z0-9]+"), F.lit(0))
    return urls.select("url", target.alias("target"), F.explode(F.array_distinct(F.concat(words, F.array(F.lit(""))))).alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """A row for each row of pages: its columns, host, path, rule, pattern_rule, verdict.

    rules: from rule_table() or compile_rules(). rule is the longest site rule that fits, else null (ties: the
    greater text); pattern_rule the longest other rule. verdict is the site rule's action, else the pattern
    rule's, else `default`. A rule is stored under the one of its tokens that the fewest distinct URLs hold.
    Null and odd URLs get empty parts and the default; repeated rows and ids stay. Rules are matched once per
    distinct URL; columns of pages with the names of results are replaced.
    """
    kept = [c for c in pages.columns if c not in {"host", "path", "rest", "rule", "pattern_rule", "verdict"}]
    base = pages.select(*kept)
    urls = url_parts(base.select(F.col(url).alias("url")).filter(F.col(url).isNotNull()).distinct())
    tokens = url_tokens(urls)
    small = rules.count() <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    by_token = rules.select("rule", "site", "pattern", "action", "regex", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = tokens.select("token").join(hint(by_token.select("token").distinct()), "token").groupBy("token").count()
    rarest = (
        by_token.join(seen, "token", "left")
        .groupBy("rule", "site", "pattern", "action", "regex")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
        .select("rule", "site", "action", "regex", F.col("least.token").alias("token"))
    )
    fits = tokens.join(hint(rarest), "token").filter("target rlike regex")
    best = F.struct(F.length("rule").alias("n"), "rule", "action")
    won = fits.groupBy("url").agg(F.max(F.when(F.col("site"), best)).alias("site_rule"), F.max(F.when(~F.col("site"), best)).alias("other_rule"))
    # rows without a URL have no match: keys of their own keep them out of one task
    spread = F.coalesce(F.col(url), F.xxhash64(*[F.col(c).cast("string") for c in kept]).cast("string"))
    out = url_parts(base.withColumn("uf__key", spread), url).drop("rest")
    out = out.join(won.withColumnRenamed("url", "uf__url"), (F.col("uf__key") == F.col("uf__url")) & F.col(url).isNotNull(), "left")
    return out.select(
        *kept,
        "host",
        "path",
        F.col("site_rule.rule").alias("rule"),
        F.col("other_rule.rule").alias("pattern_rule"),
        F.coalesce("site_rule.action", "other_rule.action", F.lit(default)).alias("verdict"),
    )


def op6_url_rules(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).drop("url")


def _sql() -> str:
    fits = lambda rule: (
        lambda h, p: f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))"
    )(rule.partition("/")[0], "/" + rule.partition("/")[2])
    longest = sorted(SITE_RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in longest) + " END"
    other = """CASE WHEN starts_with(host || rest, 'example.org/en/') OR contains('.' || host || rest, '.example.org/en/') THEN '||example.org/en/'
        WHEN contains('&' || rest, '&sessionid=') AND contains(rest, '&sessionid=') THEN '&sessionid=*'
        WHEN contains(rest, '?replytocom=') THEN '?replytocom=*'
        WHEN regexp_matches(rest, '/wp-login\\.php([^A-Za-z0-9_.%-]|$)') THEN '/wp-login.php^'
        WHEN contains('.' || host || rest, '.casino-win.') AND contains('.' || host, '.casino-win.') THEN '||casino-win.'
        WHEN contains('.' || host, '.spam-farm.') THEN '||spam-farm.'
        WHEN contains(rest, '/adserver/') THEN '/adserver/'
        WHEN contains(rest, '/casino/') THEN '/casino/'
        WHEN contains('.' || host, '.ads.') THEN '||ads.' END"""
    return f"""
    WITH t AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^/?#]*(.*)$', 1, 's') AS rest FROM t),
    v AS (SELECT *, {rule} AS rule, {other} AS pattern_rule FROM u)
    SELECT page_id, host, path, rule, pattern_rule,
           coalesce({action}, CASE WHEN pattern_rule = '||example.org/en/' THEN 'allow' WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM v"""


ORACLE_SQL = _sql()

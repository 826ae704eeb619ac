"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over a URL with the literal tokens that any URL
it fits must have.  Of these the index takes the one that fewest URLs hold.  A
URL's tokens fetch the rules filed under them, and only those rules' patterns
run.  All of it is DataFrame operations.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict.  Equal URLs are judged once.  Rows may repeat
and keep their number.  Of the fitting rules the longest wins, then the one
first in text order.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: (rule, verdict): a host and its subdomains, and the start of a path.
HOST_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
#: (pattern, literal tokens, verdict) for URLs that no host rule fits.
PATTERN_RULES = [
    (r"(?i)://[^/?#]*\bcasino\b", ["casino"], "block"),
    (r"(?i)://[^/?#]*\bpills\b", ["pills"], "block"),
    # Without the hyphen it is another token, so each spelling is a rule.
    (r"(?i)://[^/?#]*\bpoker-online\b", ["poker", "online"], "block"),
    (r"(?i)://[^/?#]*\bpokeronline\b", ["pokeronline"], "block"),
    (r"(?i)://[^/?#]*\broulette-online\b", ["roulette", "online"], "block"),
    (r"(?i)://[^/?#]*\brouletteonline\b", ["rouletteonline"], "block"),
    (r"(?i)://[^/?#]*\badult\b", ["adult"], "block"),
    (r"(?i)\.(?:exe|msi|apk)(?:[?#]|$)", [], "block"),
]
DEFAULT = "allow"
#: More index rows than this are joined by shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The token of every URL, under which rules without a literal are filed.
_ANY = ""


def rules_table(spark: SparkSession, hosts: list = HOST_RULES, patterns: list = PATTERN_RULES) -> DataFrame:
    """Columns: rank (host rules first, longer ones before shorter), rule (null for patterns), pattern, tokens, verdict."""
    rows = []
    for rank, (rule, verdict) in enumerate(sorted(hosts, key=lambda r: (-len(r[0]), r[0]))):
        host, path = rule.split("/", 1)
        # The last part of a path may go on in the URL, so it is no token.
        tokens = _words(host) + _words(path.rpartition("/")[0])
        pattern = rf"^://(?:[^/?#]*\.)?{_literal(host)}/{_literal(path)}"
        rows.append((rank, rule, pattern, tokens, verdict))
    for rank, (pattern, tokens, verdict) in enumerate(patterns, len(hosts)):
        rows.append((rank, None, pattern, [t.lower() for t in tokens], verdict))
    return spark.createDataFrame(rows, "rank int, rule string, pattern string, tokens array<string>, verdict string")


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in text)


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.get(F.split(url, "://", 2), 1)


def tokens(url: Column) -> Column:
    """The distinct literal tokens of a URL, and the one all URLs have."""
    found = F.split(F.translate(url, _UPPER, _LOWER), "[^a-z0-9]+")
    return F.array_union(F.array(F.lit(_ANY)), found)


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`rules` with the `token` each is filed under: the one of its tokens that fewest of `urls` (url, tokens) hold."""
    literals = rules.select("rank", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(
        F.array(F.lit(_ANY)))).alias("token"))
    used = literals.select("token").distinct()
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(_small(used, rules), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = Window.partitionBy("rank").orderBy(F.coalesce("n", F.lit(0)), "token")
    return (
        literals.join(counts, "token", "left")
        .withColumn("place", F.row_number().over(rarest)).where("place = 1")
        .select("rank", "token").join(rules.drop("tokens"), "rank")
    )


def _small(df: DataFrame, rules: DataFrame) -> DataFrame:
    """`df`, which has some rows for each rule, broadcast if that is known to be little."""
    return F.broadcast(df) if rules.count() <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages` (page_id, url)."""
    urls = (
        pages.where(F.col("url").isNotNull()).select("url").distinct()
        .withColumn("tokens", tokens(F.col("url")))
    )
    filed = _small(index(urls, rules), rules)
    # What host rules see: case counts in a path, but not in a host.
    canonical = F.concat(F.lit("://"), host(F.col("url")), path(F.col("url")))
    fits = F.when(F.col("rule").isNull(), F.expr("url rlike pattern")).otherwise(F.expr("canonical rlike pattern"))
    judged = (
        urls.withColumn("canonical", canonical).select("url", "canonical", F.explode("tokens").alias("token"))
        .join(filed, "token").where(fits)
        .groupBy("url").agg(F.min(F.struct("rank", "rule", "verdict")).alias("won"))
        .select("url", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("won_verdict"))
    )
    return (
        pages.select("page_id", "url").join(judged, "url", "left")
        .select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule",
                F.coalesce("won_verdict", F.lit(default)).alias("verdict"))
    )

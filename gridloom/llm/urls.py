"""URL filters: host and path rules, then a listed-URL check by blocked Bloom filter and hash join.

Only DataFrame functions run here: no Python on the executors.

Rules are (verdict, host, path prefix). A rule fits its host and all subdomains of it where the
URL's path starts with the rule's path; of the rules that fit, the longest host + path wins.
Where no rule fits, the URL is canonicalised and looked up in a list: the blocked Bloom filter
passes possible hits only to an exact hash join, so a listed URL is blocked and no other is.

Nulls: a null URL, or one without "://", has an empty host and path, no canonical form, no rule
and the verdict "allow". Repeated rows are judged row by row; repeated list entries count once.
An empty list blocks nothing. Columns beside the URL pass through untouched,
but for any named host, path, rule or verdict, which the results replace. The canonical form has no query and no fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules that the query uses: fixed values of its contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

WORDS = 8
#: A filter of up to so many blocks (36 bytes each) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 200_000
KEYS_PER_BLOCK = 16


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased."""
    return F.coalesce(_lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host/path without a leading www. or m., a default port or a trailing slash; null without host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The winning rule as host + path and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _blocks(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and one bit of each of the block's eight 32-bit words."""
    bits = F.xxhash64(F.lit(17), key)
    word = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)), word


def build_filter(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocked Bloom filter of distinct keys, one row for each block in use."""
    block, word = _blocks(F.col(key), n_blocks)
    rows = listed.where(F.col(key).isNotNull()).select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(word)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(df: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url",
                rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """df with host, path, rule and verdict; listed holds the URLs to block where no rule fits."""
    own = df.columns
    at = lambda frame: canonical(host_of(F.col(f"`{listed_url}`")), path_of(F.col(f"`{listed_url}`")))
    block_list = listed.select(at(listed).alias("__key")).where("__key is not null").distinct()
    n_listed = block_list.count()
    n_blocks = max(1, -(-n_listed // KEYS_PER_BLOCK))

    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    judged = (df.withColumn("__host", host_of(F.col(f"`{url}`"))).withColumn("__path", path_of(F.col(f"`{url}`")))
              .withColumn("__rule", rule).withColumn("__verdict", verdict)
              .withColumn("__key", F.when(F.col("__rule").isNull(), canonical(F.col("__host"), F.col("__path")))))
    bloom = build_filter(block_list, "__key", n_blocks).selectExpr("block as __b", *[f"w{i} as __w{i}" for i in range(WORDS)])
    if n_blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    block, word = _blocks(F.col("__key"), n_blocks)
    # Rows whose rule has decided, or that have no key, go round both joins: no null key is shuffled.
    open_rows = judged.where("__key is not null").withColumn("__block", block)
    probed = open_rows.join(bloom, F.col("__block") == F.col("__b"), "left")
    hit = F.lit(True)
    for i, w in enumerate(word):
        hit = hit & (F.coalesce(F.col(f"__w{i}"), F.lit(0)).bitwiseAND(w) != 0)
    probed = probed.withColumn("__hit", hit)
    exact = (probed.where("__hit").join(block_list.withColumn("__listed", F.lit(True)), "__key", "left")
             .withColumn("__verdict", F.when(F.col("__listed"), "block").otherwise("allow")))
    keep = [*[f"`{c}`" for c in own if c not in ("host", "path", "rule", "verdict")], "__host as host", "__path as path", "__rule as rule", "__verdict as verdict"]
    allow = F.coalesce(F.col("__verdict"), F.lit("allow"))
    return (judged.where("__key is null").withColumn("__verdict", allow).selectExpr(*keep)
            .unionByName(probed.where("not __hit").withColumn("__verdict", allow).selectExpr(*keep))
            .unionByName(exact.selectExpr(*keep)))

"""URL filtering: fixed host and path rules first, then association rules mined by FP-growth.

The labelled URLs' tokens (host labels, host words, path words, query keys) plus the label
itself are the transactions of Spark's FP-growth. Tokens that occur in exactly the same labelled
URLs form a class, and only the first of a class is mined, since each other one would double
the itemsets of a long URL with many copies. A rule holds as well with any other member in the
first one's place, so a judged URL's tokens are replaced by the first ones of their classes.
Rules ``tokens -> block`` are kept if their
support and confidence reach the thresholds and no rule on a subset of their tokens does as
well. A rule is indexed under its rarest token (an inverted index); a URL fetches rules by
its tokens, and a fetched rule fires if the URL has all of its tokens.

Defined cases: a null URL or one without ``://`` has empty host and path, no tokens, and is
allowed; several labels of an id count as bad if any is; ids without a label are not used;
no labels, or labels of one class, give no rules; repeated rows are judged alike; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from headway.llm.common import ascii_lower, text_key
from headway.session import materialize

BLOCK = "label=block"
#: Rules broadcast at once; more are matched in blocks of this many.
RULES_AT_ONCE = 50_000


@dataclass(frozen=True)
class RuleParams:
    """A rule needs ``min_support`` of the labelled URLs and at least ``min_rows`` of them."""

    min_support: float = 0.001
    min_rows: int = 10
    min_confidence: float = 0.5


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rule list of the production query.
HOST_RULES = (HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"),
              HostRule("allow", "www.example.com", "/en/"), HostRule("block", "net", "/es/"),
              HostRule("block", "net", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_name(host: Column, path: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> Column:
    """Name of the longest fitting rule, or null (a longer host wins among equals)."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels and their words, ``p:`` path words, ``q:`` query keys. Numbers are
    tokens like others: page numbers fall to the least support, a section such as /888/ does not."""
    u = ascii_lower(F.coalesce(url, F.lit("")))
    rest = _rest(u)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    tag = lambda prefix, xs: F.transform(
        F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return F.array_distinct(F.concat(
        tag("h:", F.split(host, r"\.")), tag("h:", F.split(host, r"[.-]")),
        tag("p:", F.split(path, r"[/._-]")),
        tag("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))))


def token_classes(rows: DataFrame, least: float) -> DataFrame:
    """(token, kept) of ``rows`` (row, tokens): tokens in at least ``least`` rows, each with the first token that
    has the same rows, told apart by their number and the sums of two 31-bit halves of a hash of each."""
    h = F.xxhash64("row")
    t = rows.select(F.explode("tokens").alias("token"), h.bitwiseAND(F.lit((1 << 31) - 1)).alias("a"),
                    F.shiftrightunsigned(h, 33).alias("b"))
    found = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return found.where(F.col("n") >= least).groupBy("n", "a", "b").agg(
        F.min("token").alias("kept"), F.collect_list("token").alias("all")).select(F.explode("all").alias("token"), "kept")


def mine_rules(pages: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """(tokens, anchor, confidence, support) of the pruned rules on the first tokens of classes."""
    return rules_and_classes(pages, labels, params)[0]


def rules_and_classes(pages: DataFrame, labels: DataFrame, params: RuleParams) -> tuple[DataFrame, DataFrame]:
    """The rules of ``mine_rules`` and ``token_classes``, written to the shared folder."""
    l = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    t = pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).join(
        l, F.col("page_id") == F.col("doc_id")).where(F.size("tokens") > 0).select(
        F.monotonically_increasing_id().alias("row"), "tokens", (F.col("quality") == 0).alias("bad"))
    t = materialize(t, "labelled")
    schema = "tokens array<string>, confidence double, support double"
    spark, n = pages.sparkSession, t.count()
    support = max(params.min_support, params.min_rows / max(1, n))
    if support > 1 or not t.where("bad").limit(1).count():
        return spark.createDataFrame([], schema + ", anchor string"), spark.createDataFrame([], "token string, kept string")
    # Written, so that Spark knows the size of the small side.
    classes = materialize(token_classes(t, support * n), "tokens")
    mined = classes.where(F.col("token") == F.col("kept"))
    t = t.select("row", "bad", F.explode("tokens").alias("token")).join(mined, "token", "left").groupBy("row", "bad").agg(
        F.collect_list("kept").alias("tokens"))
    t = materialize(t.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens"))
                             .alias("items")), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=params.min_confidence).fit(t)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", 0).alias("token"), "freq")
    # Redundant: some rule on all tokens but one has at least this confidence.
    rules = materialize(rules, "rules")
    less = rules.select("tokens", "confidence", F.explode(F.transform(
        "tokens", lambda x: F.array_remove("tokens", x))).alias("sub"))
    weaker = less.alias("a").join(rules.alias("b"), (F.col("a.sub") == F.col("b.tokens"))
                                  & (F.col("b.confidence") >= F.col("a.confidence"))).select("a.tokens").distinct()
    kept = rules.join(weaker, "tokens", "left_anti")
    by_token = kept.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(
        F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return materialize(kept.join(by_token, "tokens"), "pruned"), classes


def blocked_urls(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Keys (k1, k2) of URLs on which a rule fires; the index side is broadcast in bounded blocks.

    Tokens in no rule's class are left out, the others replaced by the first of their class."""
    n = rules.count()
    blocks = max(1, -(-n // RULES_AT_ONCE))
    used = classes.join(rules.select(F.explode("tokens").alias("kept")).distinct(), "kept", "left_semi")
    tokens = urls.select(*text_key(F.col("url")), F.explode(url_tokens(F.col("url"))).alias("token")).join(
        F.broadcast(used), "token").groupBy("k1", "k2").agg(F.collect_set("kept").alias("have"))
    posted = tokens.select("k1", "k2", "have", F.explode("have").alias("anchor"))
    out = None
    for b in range(blocks):
        part = rules.where(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == b).select("anchor", "tokens")
        hit = posted.join(F.broadcast(part), "anchor").where(
            F.size(F.array_except("tokens", "have")) == 0).select("k1", "k2")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES,
               params: RuleParams = RuleParams()) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    p = pages.select("page_id", "url")
    found = blocked_urls(p, *rules_and_classes(p, labels, params)).withColumn("_bad", F.lit(True))
    d = p.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                 F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), *text_key(F.col("url")))
    d = d.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).join(found, ["k1", "k2"], "left")
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(said)
    return d.select("page_id", "host", "path", "rule", F.coalesce(
        said, F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))

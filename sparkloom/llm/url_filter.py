"""URL filtering: host and path rules, and a ratio of two character language models for what no rule decides.

URLs that the rules judge teach two variable-order Markov models, one of accepted and one of rejected URLs. Characters are
folded to SYMBOLS; a context has up to two symbols, and a longer one is used only where it was seen MIN_CONTEXT times.
Probabilities are smoothed by interpolation with the next shorter context, weighted by its number of distinct successors, down
to a uniform one. The score of a URL is the mean, per symbol, of the log-likelihood difference of the models; it is
allowed from the threshold on that best tells the rule-judged URLs apart.

Everything is built-in expressions. The models are one table of len(SYMBOLS) ** 3 differences, whatever the input's size, which
every task gets as one array.

Defined results: a null URL and one without ``://`` have empty host and path, so no rule fits; a null URL scores as an empty
one. Without accepted or without rejected URLs all scores are 0 and URLs without a rule are allowed. Repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._lineage import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]

#: Folded characters: the first stands for the border, the second for all others, 0 for every digit.
SYMBOLS = "^*abcdefghijklmnopqrstuvwxyz0/.-_:?=&#%~+"
SIZE = len(SYMBOLS)
MIN_CONTEXT = 4
#: Width of the score bins that the threshold is chosen from, and their number on either side of 0.
BIN, BINS = 0.005, 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(tail, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. A short list: each rule is one condition."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def symbols(url: Column) -> Column:
    """Numbers of the folded characters, with two borders before and one after."""
    folded = F.translate(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "0123456789^", "0000000000*")
    framed = F.concat(F.lit("^^"), folded, F.lit("^"))
    return F.transform(F.regexp_extract_all(framed, F.lit(r"(?s)."), F.lit(0)), lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c) - 1).otherwise(1))


def grams(codes: Column) -> Column:
    """Each symbol with its two predecessors, as one number."""
    n = F.size(codes) - 2
    pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * SIZE + b)
    return F.zip_with(pairs, F.slice(codes, F.lit(3), n), lambda ab, x: ab * SIZE + x)


def model_table(judged: DataFrame) -> DataFrame:
    """``code, diff`` for every gram: log of the accepted model's probability less that of the rejected one's.

    judged: ``gram array<int>, accepted int``. Counts are added up before the shuffle; there are at most 2 * SIZE ** 3.
    """
    counts = judged.select("accepted", F.explode("gram").alias("code")).groupBy("accepted", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.groupBy("code").agg(*[F.sum(F.when(F.col("accepted") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]))
    spark = judged.sparkSession
    grid = spark.range(SIZE**3).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0, ["n0", "n1"])
    grid = grid.withColumn("x", F.col("code") % SIZE).withColumn("b", F.floor(F.col("code") / SIZE) % SIZE).withColumn("a", F.floor(F.col("code") / SIZE**2))
    two = grid.groupBy("b", "x").agg(F.sum("n0").alias("m0"), F.sum("n1").alias("m1"))
    agg = lambda df, keys, tag: df.groupBy(*keys).agg(*[f for k in (0, 1) for f in (F.sum(f"m{k}").alias(f"s{k}{tag}"), F.sum((F.col(f"m{k}") > 0).cast("int")).alias(f"t{k}{tag}"))])
    by_pair = agg(grid.withColumnsRenamed({"n0": "m0", "n1": "m1"}), ["a", "b"], "2")
    by_one = agg(two, ["b"], "1")
    one = two.groupBy("x").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1")).withColumn("g", F.lit(1))
    whole = agg(one, ["g"], "0")
    one = one.join(whole, "g").select("x", *[F.try_divide(F.col(f"m{k}") + F.col(f"t{k}0") / SIZE, F.col(f"s{k}0") + F.col(f"t{k}0")).alias(f"p{k}0") for k in (0, 1)])
    out = grid.join(two, ["b", "x"]).join(by_one, "b").join(by_pair, ["a", "b"]).join(one, "x")
    logs = []
    for k in (0, 1):
        p0 = F.col(f"p{k}0")
        p1 = F.when(F.col(f"s{k}1") >= MIN_CONTEXT, (F.col(f"m{k}") + F.col(f"t{k}1") * p0) / (F.col(f"s{k}1") + F.col(f"t{k}1"))).otherwise(p0)
        p2 = F.when(F.col(f"s{k}2") >= MIN_CONTEXT, (F.col(f"n{k}") + F.col(f"t{k}2") * p1) / (F.col(f"s{k}2") + F.col(f"t{k}2"))).otherwise(p1)
        logs.append(F.ln(p2))
    # Without URLs of one kind its probabilities are undefined, and the difference is 0.
    return out.select("code", F.coalesce(logs[1] - logs[0], F.lit(0.0)).alias("diff"))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score, threshold`` of each row.

    Rows are not shuffled. What is gathered over all rows are the gram counts and the score bins, both of fixed size.
    """
    rules = RULES if rules is None else rules
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("__verdict", verdict).withColumn("__gram", grams(symbols(F.col("url"))))
    judged = base.where("rule IS NOT NULL").select(F.col("__gram").alias("gram"), (F.col("__verdict") == "allow").cast("int").alias("accepted"))
    table = cut(model_table(judged).agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "diff"))), lambda r: r["diff"]).alias("diff")))
    scored = base.withColumn("__model", table.scalar())
    total = F.aggregate("__gram", F.lit(0.0), lambda s, g: s + F.get(F.col("__model"), g))
    scored = scored.withColumn("score", total / F.size("__gram")).drop("__model", "__gram")
    limit = threshold(scored.where("rule IS NOT NULL").select("score", (F.col("__verdict") == "allow").alias("accepted")))
    decided = F.coalesce("__verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "url", "host", "path", "rule", decided.alias("verdict"), "score", F.lit(limit).alias("threshold"))


def threshold(judged: DataFrame) -> float:
    """The lower edge of the score bin from which on allowing errs least, both kinds weighing the same; ties: the lowest edge.

    At most 2 * (2 * BINS + 1) counts reach the driver.
    """
    at = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(BINS)), F.lit(-BINS)).cast("int")
    rows = judged.groupBy(at.alias("bin"), "accepted").agg(F.count(F.lit(1)).alias("n")).collect()
    good = {b: n for b, y, n in rows if y}
    bad = {b: n for b, y, n in rows if not y}
    if not good or not bad:
        return -float(BINS)
    all_good, all_bad = sum(good.values()), sum(bad.values())
    lost, best = 0, (1.0, 0)
    kept = all_bad
    for b in sorted({*good, *bad}):
        # Allowing from bin b on: the good ones below are lost, the bad ones from here on are kept.
        best = min(best, (lost / all_good + kept / all_bad, b))
        lost, kept = lost + good.get(b, 0), kept - bad.get(b, 0)
    return best[1] * BIN


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")

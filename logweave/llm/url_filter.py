"""URL filters: allow and block rules first, then a ratio of two character models. DataFrame functions only.

URLs that a rule allows or blocks train one model each: variable-order Markov models over a reduced
alphabet of 32 symbols. A context of up to three symbols counts only if it was seen often enough, and
smoothing (Witten and Bell's) mixes what was seen after it with the next shorter context. As all
windows of four symbols are numbers below 2^20, both models together are one table of as many rows,
whatever the corpus: the logarithm of the ratio of probabilities, in millionths. A URL's score is its
sum by its length. From which score on URLs are allowed is calibrated on labelled URLs held out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.words import ascii_lower
from logweave.operators.pinning import pin_table

#: Rules of the registered query: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Symbols 1 to 31; 0 is the start and end. Digits are one symbol, all other characters `~`.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-~"
RADIX, ORDER = 32, 4  # of five bits
#: Labelled URLs of each verdict that the query's SQL fits on, at most (filter_urls fits on all); how often a context must be seen; a score's unit.
MAX_FIT, MIN_CONTEXT, UNIT = 200_000, 4, 1_000_000
#: Width of the buckets in which held-out scores are counted.
BUCKET = 1000


def host_of(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str | Column) -> Column:
    """From the host's end up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null. Of rules with equal text the first counts."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        at = at.lower()
        fits = (host == at) | host.endswith("." + at)
        found = F.when(fits & path.startswith("/" + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def window_codes(url: str | Column) -> Column:
    """A number below RADIX ** ORDER for each symbol of a URL and its end: itself and the three before."""
    plain = ascii_lower(F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[0-9]", "0"), "_", "-"), r"(?s)[^a-z0/.\-]", "~")
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    symbols = F.concat(F.transform(letters, lambda c: F.position(c, F.lit(SYMBOLS))), F.array(F.lit(0)))
    # four arrays side by side; symbols before the first are 0
    late = [F.concat(F.array_repeat(F.lit(0), k), symbols) for k in range(ORDER)]
    zipped = F.arrays_zip(*[a.alias(f"s{k}") for k, a in enumerate(late)])
    codes = F.transform(zipped, lambda z: reduce(lambda x, y: x + y, [z[f"s{k}"] * RADIX**k for k in range(ORDER)]))
    return F.slice(codes, 1, F.size(symbols))


def labelled_urls(judged: DataFrame) -> DataFrame:
    """(url, allow, held) of every URL in `judged` (url, verdict) that has a verdict; a quarter, by MD5, are held out."""
    return judged.where(F.col("verdict").isNotNull()).select("url", (F.col("verdict") == "allow").alias("allow"), F.substring(F.md5("url"), 32, 1).isin("0", "1", "2", "3").alias("held"))


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(code, score) for every window of symbols, from how often each was seen in allowed and in blocked URLs: (code, na, nb).

    What is broadcast here has at most RADIX ** ORDER rows of a few numbers, for any input.
    """
    spark = counts.sparkSession
    kinds = lambda n: F.count(F.when(F.col(n) > 0, 1))
    mixed = lambda n, t, d, p: F.when(F.col(t) > 0, (F.coalesce(n, F.lit(0)) + F.col(d) * F.col(p)) / (F.col(t) + F.col(d))).otherwise(F.col(p))
    table = spark.range(1).select(F.col("id").alias("below"), F.lit(1.0 / RADIX).alias("pa"), F.lit(1.0 / RADIX).alias("pb"))
    for k in range(ORDER):
        seen = counts.groupBy((F.col("code") % RADIX ** (k + 1)).alias("code")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        # in a code the last symbol is the lowest digit: its context is what is above
        contexts = seen.groupBy(F.shiftright("code", 5).alias("context")).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), kinds("na").alias("da"), kinds("nb").alias("db"))
        contexts = contexts.where(F.col("ta") + F.col("tb") >= MIN_CONTEXT)
        # the next shorter context drops the oldest symbol, which is the highest digit
        codes = spark.range(RADIX ** (k + 1)).select(F.col("id").alias("code"), F.shiftright("id", 5).alias("context"), (F.col("id") % RADIX**k).alias("below"))
        both = codes.join(F.broadcast(table), "below").join(F.broadcast(seen), "code", "left").join(F.broadcast(contexts), "context", "left")
        table = both.select(F.col("code").alias("below"), mixed("na", "ta", "da", "pa").alias("pa"), mixed("nb", "tb", "db", "pb").alias("pb"))
    return table.select(F.col("below").cast("int").alias("code"), F.floor((F.log("pa") - F.log("pb")) * UNIT + 0.5).cast("int").alias("score"))


def fit_log_ratios(labelled: DataFrame) -> DataFrame:
    """The models' table (code, score) from (url, allow); RADIX ** ORDER rows, pinned."""
    codes = labelled.select("allow", F.explode(window_codes("url")).alias("code"))
    counts = codes.groupBy("code").agg(F.count(F.when(F.col("allow"), 1)).alias("na"), F.count(F.when(~F.col("allow"), 1)).alias("nb"))
    return pin_table(_log_ratios(pin_table(counts, "url_counts")), "url_scores")


def scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """`urls`, which must have a column url, with score_sum and n_symbols (the end included). All other columns are carried, so they should be few."""
    names = urls.columns
    each = urls.withColumn("__row", F.monotonically_increasing_id()).withColumn("code", F.explode(window_codes("url")))
    # one row of partial sums a URL leaves its task, as all its windows are there
    found = each.drop("url").join(F.broadcast(ratios), "code").groupBy("__row", *[n for n in names if n != "url"]).agg(F.sum("score").alias("score_sum"), F.count("*").alias("n_symbols"))
    return found.drop("__row")


def mean_score(total: str | Column = "score_sum", n: str | Column = "n_symbols") -> Column:
    """A score for each symbol, in millionths, floored."""
    return F.floor((F.col(total) if isinstance(total, str) else total) / (F.col(n) if isinstance(n, str) else n)).cast("long")


def calibrated_threshold(held: DataFrame) -> int:
    """The least mean score to allow, a multiple of BUCKET, from held-out (allow, score): the best balanced accuracy; of equal ones the nearest to 0, then the lower.

    Without held-out rows of both kinds it is 0. Scores are counted in buckets, whose number is
    bounded as a smoothed probability is.
    """
    per = held.groupBy(F.floor(F.col("score") / BUCKET).cast("long").alias("bucket")).agg(F.count(F.when(F.col("allow"), 1)).alias("na"), F.count(F.when(~F.col("allow"), 1)).alias("nb"))
    rows = sorted(tuple(r) for r in per.collect())
    all_a, all_b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not all_a or not all_b:
        return 0
    passed, stopped, best = all_a, 0, []
    edges = {b for b, _, _ in rows} | {0, rows[-1][0] + 1}
    counts = {b: (a, x) for b, a, x in rows}
    for b in sorted(edges):  # buckets from b on are allowed
        best.append((-(passed * all_b + stopped * all_a), abs(b), b))
        a, x = counts.get(b, (0, 0))
        passed, stopped = passed - a, stopped + x
    return min(best)[2] * BUCKET


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold) for every row of `pages`.

    The rules' verdict counts, else the models': allow from the threshold on. Rules are (verdict, host
    and path prefix with a slash between), a list that goes with the plan. They also label the URLs
    that models and threshold are fitted on, all of them: what stays of these is counts of windows and of scores, whose
    number is bounded. Without a label every score is 0 and the verdict allow. A null URL is an empty one. Rows with null or repeated ids are judged each; other columns aren't carried.
    """
    base = pages.select(F.col(id_col), F.col(url).cast("string").alias("url")).withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    base = base.withColumn("__found", matching_rule(F.col("host"), F.col("path"), rules)) if rules else base.withColumn("__found", F.lit(None).cast("struct<rule:string,verdict:string>"))
    base = base.select(F.col(id_col).alias("__id"), "url", "host", "path", F.col("__found.rule").alias("rule"), F.col("__found.verdict").alias("verdict"))
    labelled = labelled_urls(base.select("url", "verdict"))
    ratios = fit_log_ratios(labelled.where(~F.col("held")))
    threshold = calibrated_threshold(scored(labelled.where("held").select("url", "allow"), ratios).select("allow", mean_score().alias("score")))
    out = scored(base, ratios).withColumn("score", mean_score())
    judged = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "score", F.lit(threshold).cast("long").alias("threshold"))

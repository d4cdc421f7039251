"""URL filters: host and path rules, and a character language-model ratio for urls that no rule fits.

Two smoothed variable-order Markov models, one of accepted and one of rejected urls, are counted over the urls that a
rule decides, but for a fold of them. An order's probability is interpolated with the next shorter one by a Dirichlet
weight, so contexts count as far as they were seen. A whole url's score is the mean log ratio per character; the border
between the verdicts is the one that best parts the urls of the fold, which the models have not seen. Only DataFrame
functions are used.

Letters lose their case, other ASCII characters than those of SIGNS are one symbol and those of other scripts one for each
range; contexts have three symbols, so that the model is bounded, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import stored

ORDER = 3
SIGNS = "./-_~%?=&#:+@,;"
#: What other characters become, range by range: Latin, Greek to Armenian, Hebrew to Georgian, the rest, and ASCII.
RANGES = (
    (r"[\x{80}-\x{36F}]", "é"),
    (r"[\x{370}-\x{58F}]", "я"),
    (r"[\x{590}-\x{10FF}]", "ع"),
    (r"[^\x00-\x7Féяع]", "字"),
    (r"[^a-z0-9./\-_~%?=&#:+@,;éяع字]", "!"),
)
ALPHABET = 26 + 10 + len(SIGNS) + len(RANGES) + 1
STRETCH = 500
#: The most rows of the model that are broadcast; beyond it, it is shuffled.
MODEL_ROWS = 1_000_000
#: One in so many of the urls that a rule decides gives the border instead of being counted.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, what: str) -> Column:
    """The name or verdict of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, what))).otherwise(found)
    return found


def _symbols(text: Column) -> Column:
    """One of ALPHABET symbols for each character, and ^ at both ends."""
    found = F.translate(text, UPPER, LOWER)
    for characters, symbol in RANGES:
        found = F.regexp_replace(found, characters, symbol)
    return F.concat(F.lit("^" * ORDER), found, F.lit("^"))


def _grams(symbols: Column) -> Column:
    """All substrings of ORDER + 1 symbols; of stretches first, since a substring is looked for from the beginning."""
    last = F.length(symbols) - ORDER
    stretches = F.transform(F.sequence(F.lit(1), last, F.lit(STRETCH)), lambda i: F.substring(symbols, i, F.lit(STRETCH + ORDER)))
    each = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - ORDER), lambda i: F.substring(x, i, F.lit(ORDER + 1)))
    return F.flatten(F.transform(stretches, each))


def markov_ratio(grams: DataFrame, weight: float = 4.0) -> DataFrame:
    """of (a gram) and ratio (millionths of log p_accepted - log p_rejected) of every gram, from its counts in both classes."""
    table = grams.select("gram", "accepted", "rejected")
    totals = table.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    below = table.groupBy(F.substring("gram", ORDER + 1, 1).alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    below = below.select("g", ((F.col("a") + 1) / F.lit((totals["a"] or 0) + ALPHABET)).alias("pa"), ((F.col("r") + 1) / F.lit((totals["r"] or 0) + ALPHABET)).alias("pr"))
    for n in range(2, ORDER + 2):
        own = table.groupBy(F.substring("gram", ORDER + 2 - n, n).alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = own.groupBy(F.substring("g", 1, n - 1).alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        shorter = below.withColumnRenamed("g", "s")
        below = (
            own.join(context, F.substring(own["g"], 1, n - 1) == F.col("c"))
            .join(shorter, F.substring(own["g"], 2, n - 1) == F.col("s"))
            .select(
                own["g"],
                ((F.col("a") + weight * F.col("pa")) / (F.col("ca") + weight)).alias("pa"),
                ((F.col("r") + weight * F.col("pr")) / (F.col("cr") + weight)).alias("pr"),
            )
        )
    return below.select(F.col("g").alias("of"), F.round(F.log(F.col("pa") / F.col("pr")) * 1e6).cast("long").alias("ratio"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every url.

    The rule's verdict holds where one fits; else the url is blocked if its score, the mean log ratio over the whole url,
    is below the calibrated border. Null urls and urls without :// have an empty host and path; a null url is scored as an
    empty one. Equal urls get equal verdicts; repeated rows and null ids are all returned. Urls of a fold of 1 in FOLDS,
    by a hash, are not counted and give the border; if the fold or the rest lacks a class, all urls that a rule decides
    do both. If the rules decide no url of one of the classes there is nothing to compare, and urls without a rule are
    allowed. An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), _symbols(F.coalesce(url, F.lit(""))).alias("symbols"))
    ruled = stored(  # a table, so that no row's symbols are made again for each gram
        split.withColumns(
            {
                "rule": longest_rule(rules, F.col("host"), F.col("path"), "name"),
                "ruled": longest_rule(rules, F.col("host"), F.col("path"), "verdict"),
                "fold": F.pmod(F.xxhash64("symbols"), F.lit(FOLDS)) == 0,
                "key": F.md5(F.col("symbols").cast("binary")),  # for long urls, whose every gram names its url
            }
        ),
        "url-ruled",
    )
    accepted, rejected = F.col("ruled") == "allow", F.col("ruled") == "block"
    seen = ruled.agg(*(F.count_if(c & f) for c in (accepted, rejected) for f in (F.col("fold"), ~F.col("fold")))).first()
    in_fold, counted = (F.col("fold"), ~F.col("fold")) if min(seen) else (F.lit(True), F.lit(True))
    exploded = ruled.select("key", "ruled", "fold", F.explode(_grams(F.col("symbols"))).alias("gram"))
    counts = exploded.groupBy("gram").agg(F.count_if(accepted & counted).alias("accepted"), F.count_if(rejected & counted).alias("rejected"))
    model = stored(markov_ratio(stored(counts, "url-grams")), "url-model")
    scores = stored(  # a table, so that the join below can split a url that very many rows have; a url that is repeated has
        # as many more rows in the sum as in the count
        exploded.join(F.broadcast(model) if model.count() <= MODEL_ROWS else model, F.col("gram") == F.col("of"))
        .groupBy("key", "fold")
        .agg(F.sum("ratio").alias("ratio"), F.count("*").alias("n"))
        .select(F.col("key").alias("of"), "fold", (F.col("ratio") / F.col("n") / 1e6).alias("score")),
        "url-scores",
    )
    joined = ruled.join(scores.select("of", "score"), F.col("key") == F.col("of"), "left")
    binned = joined.where(in_fold).withColumn("bin", F.floor(F.least(F.greatest(F.col("score"), F.lit(-8.0)), F.lit(8.0)) * 250).cast("int"))
    bins = binned.groupBy("bin").agg(F.count_if(accepted).alias("a"), F.count_if(rejected).alias("r")).where("a + r > 0").collect()
    border = _border({b["bin"]: (b["a"], b["r"]) for b in bins})
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("ruled"), F.when(F.col("score") < border, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def _border(bins: dict[int, tuple[float, float]]) -> float:
    """The score with the largest balanced accuracy, amid the gap between two bins; of equal ones the nearest to 0."""
    accepted, rejected = (sum(b[i] for b in bins.values()) for i in (0, 1))
    if not accepted or not rejected:
        return float("-inf")
    below_a = below_r = 0.0
    found, last = [], None
    for k in sorted(bins):
        at = k if last is None else (last + 1 + k) / 2
        found.append((-round(1 - below_a / accepted + below_r / rejected, 9), abs(at), at))
        below_a, below_r, last = below_a + bins[k][0], below_r + bins[k][1], k
    return min(found)[2] / 250

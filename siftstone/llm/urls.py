"""URL filters: rules first, then the ratio of two character language models.

Variable-order Markov models of accepted and of rejected URLs share one table of grams: each gram of up to ``ORDER + 1``
characters has its count in either class. Witten-Bell smoothing mixes the orders, so the order in force varies with what
a context has been seen to be followed by. A URL's score is the difference of the two log-likelihoods per character;
the cut between accept and reject is set on labelled URLs that the models have not seen. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ORDER = 4
#: Grams with at least this share of all places are scored from a broadcast table, which so has at most 1/HEAVY rows.
HEAVY = 0.001
ALPHABET = 256
START, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"

#: (verdict, host, path); a rule is written host + path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits (of equals the first by name), else null.

    A rule fits its host and all subdomains of it, where the path starts with the rule's. The rules are a short list, written
    into the expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of each url (and its end): the character after its ``ORDER`` predecessors; ``last`` is 1 at the end, else 0."""
    padded = F.concat(F.lit(START * ORDER), F.coalesce(F.col("url"), F.lit("")), F.lit(END))
    # a split in characters is linear in the length, where a substring per place would be quadratic
    letters = F.split(padded, "")
    places = F.sequence(F.lit(1), F.size("letters") - ORDER)
    return urls.withColumn("letters", letters).withColumn(
        "grams", F.transform(places, lambda i: F.struct(
            F.array_join(F.slice("letters", i, ORDER + 1), "").alias("gram"), (i == F.size("letters") - ORDER).cast("int").alias("last")
        ))
    ).drop("letters").withColumn("place", F.explode("grams")).drop("grams").withColumns({"gram": F.col("place.gram"), "last": F.col("place.last")}).drop("place")


def gram_scores(places: DataFrame) -> DataFrame:
    """``gram, score, heavy`` for every gram of ``places(gram, accepted, rejected)``, where the two columns are 1 or 0.

    The score is log P(character | context) of the accepted less that of the rejected URLs.
    """
    totals = places.groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), F.count(F.lit(1)).alias("n"))
    totals = stored(totals, "url-grams")
    tail = F.expr("right(gram, k + 1)")
    levels = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDER)))).withColumn("tail", tail)
    seen = levels.groupBy("k", "tail").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    # what follows each context: how often anything, and how many different characters
    contexts = seen.groupBy("k", F.expr("left(tail, k)").alias("context")).agg(
        F.sum("a").alias("all_a"), F.sum("r").alias("all_r"),
        F.count_if(F.col("a") > 0).alias("kinds_a"), F.count_if(F.col("r") > 0).alias("kinds_r"),
    )
    known = seen.withColumn("context", F.expr("left(tail, k)")).join(contexts, ["k", "context"]).drop("context")
    steps = levels.select("gram", "k", "tail").join(known, ["k", "tail"]).groupBy("gram").agg(
        F.sort_array(F.collect_list(F.struct("k", "a", "all_a", "kinds_a", "r", "all_r", "kinds_r"))).alias("steps")
    )

    def smoothed(lower, count, total, kinds):
        return F.when(total > 0, (count + kinds * lower) / (total + kinds)).otherwise(lower)

    start = F.struct(F.lit(1.0 / ALPHABET).alias("a"), F.lit(1.0 / ALPHABET).alias("r"))
    odds = F.aggregate(
        "steps", start,
        lambda p, s: F.struct(smoothed(p["a"], s["a"], s["all_a"], s["kinds_a"]).alias("a"), smoothed(p["r"], s["r"], s["all_r"], s["kinds_r"]).alias("r")),
        lambda p: F.log(p["a"]) - F.log(p["r"]),
    )
    everything = totals.agg(F.sum("n")).first()[0] or 0
    return stored(steps.select("gram", odds.alias("score")).join(totals.select("gram", (F.col("n") >= HEAVY * everything).alias("heavy")), "gram"), "url-scores")


def score_urls(keyed: DataFrame, scores: DataFrame) -> DataFrame:
    """``page_id, url, copies, score``: mean gram score per distinct (page_id, url); ``copies`` is how often that row occurs."""
    places = _grams(keyed.select("page_id", "url"))
    heavy = F.broadcast(scores.filter("heavy").select(F.col("gram").alias("g"), "score"))
    own = places.join(heavy, F.col("gram") == F.col("g"), "left").drop("g")
    # the end has a flag of its own, as a url may hold its character
    parts = own.filter("score IS NOT NULL").select("page_id", "url", "score", "last").unionByName(
        own.filter("score IS NULL").drop("score").join(scores.filter("NOT heavy").select("gram", "score"), "gram").select("page_id", "url", "score", "last")
    )
    return parts.groupBy("page_id", "url").agg(F.sum("last").alias("copies"), F.avg("score").alias("score"))


def kept_back(page_id: Column) -> Column:
    """Pages that place the cut instead of teaching."""
    return F.coalesce(F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 1).isin("0", "1", "2"), F.lit(False))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url)``.

    URLs that a rule decides teach the models; three sixteenths of them (by a hash of the id) are kept back to place the cut between the
    classes' mean scores, in proportion to their spread. Null urls are empty: host, path and rule are then empty or null. Without labelled
    URLs of both classes everything that no rule decides is allowed. Repeated rows are judged alike and all returned.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    ruled = longest_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    aside = kept_back(F.col("page_id"))
    verdict = ruled["verdict"]
    teaching = keyed.withColumns({
        "accepted": F.coalesce(((verdict == "allow") & ~aside).cast("int"), F.lit(0)),
        "rejected": F.coalesce(((verdict == "block") & ~aside).cast("int"), F.lit(0)),
    })
    scored = stored(score_urls(keyed, gram_scores(_grams(teaching).select("gram", "accepted", "rejected"))), "url-judged")
    calm = scored.filter(aside).groupBy(verdict.alias("verdict")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
    found = {r["verdict"]: r for r in calm.collect()}  # at most three rows
    if "allow" in found and "block" in found:
        a, b = found["allow"], found["block"]
        share = b["spread"] / (a["spread"] + b["spread"]) if a["spread"] + b["spread"] else 0.5
        cut = b["mean"] + share * (a["mean"] - b["mean"])
    else:
        cut = float("-inf")
    method = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return scored.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), ruled["rule"].alias("rule"),
        F.coalesce(verdict, method).alias("verdict"), F.round("score", 6).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")

"""URL filtering by association rules, with DataFrame functions only.

FP-growth finds the combinations of URL tokens that are frequent in bad pages. Rules pruned by support and confidence are kept by
their rarest token (an inverted index), and a URL is looked up by its tokens. Listed host and path rules come first, and what they
say of pages is learned from like labels.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import looked_up, stored

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULE, CLASS = "needed array<string>, hits long, support double, confidence double", "token string, class string"
#: Standard deviations of the confidence's lower bound (one side, 5 %).
SURE = 1.6449
#: Repeated rows are dealt to FP-growth by so many.
MANY = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _CAPITALS, _CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens `h:label` and `s:segment`, of all labels of the host and all segments of the path."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
            F.transform(segments, lambda x: F.concat(F.lit("s:"), x)),
        )
    )


def mine(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules (needed, hits, support, confidence) and classes (token, class) from rows (tokens, bad): sets of token classes of which at least the share min_confidence
    is bad, surely more than of all rows (by Wilson's lower bound), and that hit at least the share min_support of all rows, and min_count rows.

    Tokens that stand in the same rows are one class, named by the least of them (see classed()), so what always comes
    together is no more than one item. FP-growth finds the frequent sets of classes in the bad rows; all rows with a set are then counted by
    the inverted index. Sets have no limit of size.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("hits")), "url-tokens")
    n, bad, kinds = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    least = max(1, min_count, math.ceil(min_support * n))
    nothing = spark.createDataFrame([], RULE), spark.createDataFrame([], CLASS)
    if bad < least:
        return nothing
    own = rows.select("n", "hits", F.xxhash64("tokens").alias("row"), F.explode("tokens").alias("token"))
    common = own.groupBy("token").agg(F.sum("hits").alias("hits"), F.sum(F.col("row").cast("decimal(38,0)")).alias("rows")).where(F.col("hits") >= least)
    classes = stored(common.withColumn("class", F.min("token").over(Window.partitionBy("rows", "hits"))).select("token", "class"), "url-classes")
    if classes.isEmpty():
        return nothing
    known = stored(classed(rows.select(F.xxhash64("tokens").alias("row"), "tokens", "n", "hits"), "row", classes, kinds), "url-rows")
    # a row's items as often as it was bad; two steps, so that no list of them is long
    steps = known.where("hits > 0").select("items", "hits", F.explode(F.sequence(F.lit(0), F.col("hits") - 1, F.lit(MANY))).alias("at"))
    worse = steps.select("items", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + MANY, F.col("hits")) - 1)).alias("at")).select("items")
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / bad, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(worse).freqItemsets
    sets = stored(found.select(F.array_sort("items").alias("needed"), F.col("freq").alias("hits")).where(F.col("hits") >= least), "url-sets")
    counted = having(known.select("items", "n"), sets.select("needed"), kinds).groupBy("needed").agg(F.sum("n").alias("all"))
    rules = sets.join(counted, "needed").withColumn("confidence", F.col("hits") / F.col("all")).withColumn("support", F.col("hits") / F.lit(n))
    square = F.lit(SURE * SURE) / F.col("all")
    lower = (F.col("confidence") + square / 2 - F.sqrt(square * (F.col("confidence") * (1 - F.col("confidence")) + square / 4))) / (1 + square)
    rules = stored(rules.where((F.col("confidence") >= min_confidence) & (lower > F.lit(bad / n))).select("needed", "hits", "support", "confidence"), "url-rules")
    return rules, classes


def classed(rows: DataFrame, key: str, classes: DataFrame, total: int) -> DataFrame:
    """rows (column tokens) with items: the classes that a row has a token of; rows without any go. key names the columns that tell rows apart."""
    met = looked_up(rows.select(key, F.explode("tokens").alias("token")), classes, "token", total)
    items = met.groupBy(key).agg(F.collect_set("class").alias("items"))
    return rows.drop("tokens").join(items, key)


def having(rows: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Each row (column items, an array) with each of the sets (needed and other columns) that it has all of: every set is kept under its rarest item."""
    posted = sets.select("needed", F.explode("needed").alias("item"))
    common = posted.groupBy("item").agg(F.count("*").alias("sets"))
    rarest = posted.join(common, "item").groupBy("needed").agg(F.min_by("item", F.struct("sets", "item")).alias("item"))
    index = sets.join(rarest, "needed").groupBy("item").agg(F.collect_list(F.struct(*sets.columns)).alias("under"))
    met = looked_up(rows.withColumn("item", F.explode("items")), index, "item", total)
    met = met.withColumn("set", F.explode("under")).where(F.size(F.array_except("set.needed", "items")) == 0)
    return met.select(*(c for c in rows.columns if c != "items"), "set.*")


def listed(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """url, rule and action of the longest rule (`host/path`, allow or block) that fits; urls: distinct url with host, path."""
    spark = urls.sparkSession
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"), F.lit(r.partition("/")[0]).alias("suffix"), F.lit("/" + r.partition("/")[2]).alias("start")) for r, a in rules])
    given = spark.range(1).select(F.explode(table).alias("r")).select("r.*")  # as long as the list in the call
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(suffixes).alias("suffix")).join(F.broadcast(given), "suffix").where(F.expr("startswith(path, start)"))
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule"))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.action")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    min_support: float = 0.002,
    min_count: int = 8,
    min_confidence: float = 0.6,
    label_key: Column | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the mined rule) for every page.

    labels: doc_id, quality and toxic; label_key is an expression over pages that gives a page's doc_id (default: page_id). A page whose url
    a listed rule fits is bad if that rule blocks; another labelled one if any label of it has quality 0 or toxic 1 (null: neither).
    The verdict is the longest fitting listed rule's (of equally long ones the last by name); else block if the URL
    has all tokens of a mined rule, else allow. Null urls and urls without `://` have empty host and path, no tokens and so `allow`.
    Each distinct url is judged once, and what very many pages share (a url, a label, a token) meets them by broadcast. Repeated rows give
    repeated rows, an empty table none, without labels and rules nothing is mined; further columns are not read.
    """
    key = F.col("page_id") if label_key is None else label_key
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), key.cast("long").alias("key"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = rows.select("url").where("url is not null").distinct().select("url", host.alias("host"), path.alias("path")).where("host != '' or path != ''")
    named = listed(urls, rules) if rules else urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).where("false")
    urls = stored(urls.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))).drop("host", "path").join(named, "url", "left"), "urls")
    n, kinds = rows.count(), urls.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    is_bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(is_bad).alias("bad"))
    met = looked_up(looked_up(rows.select("url", "key"), known, "key", n, "left"), urls, "url", n)
    bad = F.when(F.col("action").isNotNull(), F.col("action") == "block").otherwise(F.col("bad"))
    mined, classes = mine(met.select("tokens", bad.alias("bad")).where("bad is not null"), min_support, min_count, min_confidence)
    items = classed(urls.select("url", "tokens"), "url", classes, kinds)
    found = having(items, mined.select("needed", "confidence"), kinds).groupBy("url").agg(F.max("confidence").alias("confidence"))
    judged = urls.select("url", "rule", "action").join(found, "url", "left").where("rule is not null or confidence is not null")
    verdict = F.coalesce("action", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return looked_up(rows.select("page_id", "url"), judged, "url", n, "left").select("page_id", host.alias("host"), path.alias("path"), "rule", verdict.alias("verdict"), "confidence")


def document_of(url: Column) -> Column:
    """The number that starts a path's second segment, as in `/en/825.html`: the document that a page shows."""
    return F.regexp_extract(path_of(url), r"^/[^/]+/(\d+)", 1).try_cast("long")

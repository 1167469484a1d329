"""URL filters: host and path rules, and a logistic regression on hashed character n-grams, in DataFrame functions only.

Every url is cut into host and path. A rule fits its host and all its subdomains if the url's path starts with the rule's; the
longest fitting rule decides. All other urls are judged by the regression, trained from a small labelled table.

The regression is trained in the dual form of batch gradient descent: with L2 regularisation every weight vector it passes
through is a sum of the training urls' features, so that one number for each labelled url (at most ``max_labelled``) and the
matrix of inner products are enough. The iterations (accelerated by momentum) are one fold over arrays. Bucket weights then follow from a grouping, and
reach the scan as one array of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16_384
#: Labelled urls that the training sees.
MAX_LABELLED = 512
PARALLEL = 32
#: The value of the feature that all urls have; a small one allows long steps.
BIAS = 0.2
SIZES = (3, 4)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of hosts and of paths by which a url is unwanted, and others by which it is not; words that stand beside either.
_UNWANTED = "casino bets poker slots pills pharma viagra adult porn sex xxx loan payday spam prize warez crack ads track cheap replica".split()
_WANTED = (
    "library archive news journal kitchen garden museum weather travel data health radio math school council book music photo software language paper chess running bird train poetry theatre hospital orchard "
    "carpenter thunder mountain harbour lantern cathedral brewery painter furniture engineer astronomy chemistry physics theory statistics grammar dictionary philosophy parliament ministry railway airport weaver "
    "pottery bakery gallery cinema heritage wildlife forestry fishing sailing hiking cycling brother northern southern nation ather thing theman tionary thorn whether"
).split()
#: Common pieces of words, of which names are made that mean nothing.
_PIECES = "th er on an re he in ed nd ha at en es or nt ea ti to it st le is ou ar as de ve".split()
_ENDINGS = "tion ther ing ment able ness ight ston ford son ly wh".split()
_BESIDE = "win best online free top club world land city house 24 point".split()
_UNWANTED_PATHS = "casino-bonus free-spins sports-betting poker-room buy-pills viagra-order porn-videos live-sex xxx-tube payday-loans claim-prize crack-download keygen ad-click replica-bags".split()
_WANTED_PATHS = "articles history recipes about contact reports forecast lessons photos guide timetable members library projects science review gallery events staff help".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The bundled table (url, label): 1 where the host is one of gambling, pill, adult, loan, spam and advertising sites, or the
    path leads to such pages on any host; 0 for others. Words that stand beside, endings and numbers go with either."""
    tops, subs = ("com", "org", "net", "info", "co.uk", "biz", "eu"), ("", "www.", "shop.", "en.", "web.")

    def host(word: str, i: int) -> str:
        beside = _BESIDE[i % len(_BESIDE)]
        return subs[i % len(subs)] + (word, f"{word}-{beside}", f"{beside}{word}", f"{beside}-{word}", f"my{word}")[i % 5] + "." + tops[i % len(tops)]

    def path(word: str, i: int) -> str:
        return (f"/{word}", f"/{word}/{37 * i}", f"/p/{word}.html", f"/{word}/index.php", f"/site/{i}/{word}/", f"/{word}-{i}")[i % 6]

    n, m = len(_PIECES), len(_ENDINGS)
    names = [_PIECES[3 * i % n] + _PIECES[(11 * i + 1) % n] + (_ENDINGS[7 * i % m] if i % 2 else _PIECES[(2 * i + 5) % n]) for i in range(50)]
    rows, i = [], 0
    for label, words, times in ((1, _UNWANTED, 5), (0, _WANTED, 3), (0, names, 2)):
        for word in words:
            for _ in range(times):
                rows.append((f"http{'s' if i % 2 else ''}://{host(word, i)}{path(_WANTED_PATHS[i % len(_WANTED_PATHS)], i // 2)}", label))
                i += 1
    harmless = _WANTED + names
    for k, word in enumerate(_UNWANTED_PATHS * 5):
        rows.append((f"http://{host(harmless[11 * k % len(harmless)], k)}{path(word, k)}", 1))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits; of equally long ones the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, slash, tail = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ngrams(mark: str, part: Column, buckets: int, first: int) -> Column:
    """The distinct n-grams of a part, in ``buckets`` buckets from ``first`` on. Characters are cut apart once: looking for a place
    in a string would take longer the longer it is."""
    chars = F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0))

    def of_size(n: int, c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0)))
        return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.lit(mark), F.lit(n), *[F.get(c, i + j) for j in range(n)]), F.lit(buckets)) + first).cast("int"))

    held = F.transform(F.array(chars), lambda c: F.array_distinct(F.concat(*[of_size(n, c) for n in SIZES])))  # so that chars are made once
    return F.get(held, F.lit(0))


def features(host: Column, path: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of the n-grams of the host (the first half of the buckets) and of the path; digits of a path count as one character."""
    half = buckets // 2
    inside = F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))
    return ngrams("h", F.concat(F.lit("^"), host, F.lit("$")), half, 0), ngrams("p", inside, half, half)


def unit(found: Column) -> Column:
    """The value of each feature: host and path each have length 1."""
    return F.lit(1.0) / F.sqrt(F.size(found).cast("double"))


def train(labelled: DataFrame, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, rounds: int = 100, rate: float = 16.0, shrink: float = 0.00003) -> DataFrame:
    """One row (weights array<double>, the intercept last). ``labelled`` (url, label) is cut to ``max_labelled`` rows by a hash of the url."""
    rows = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max(F.col("label").cast("int")).alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    of_host, of_path = features(host_of(F.col("url")), path_of(F.col("url")), buckets)
    found = rows.select("url", "label", of_host.alias("h"), of_path.alias("p")).withColumns({"vh": unit(F.col("h")), "vp": unit(F.col("p"))})
    whole = lambda df, *more: df.agg(F.array_sort(F.collect_list(F.struct("url", "label", "h", "p", "vh", "vp", *more))).alias("rows"))  # noqa: E731  at most max_labelled
    alike = lambda a, b, c: F.size(F.array_intersect(a[c], b[c])) * a[f"v{c}"] * b[f"v{c}"]
    me = {c: F.col(c) for c in ("h", "p", "vh", "vp")}
    # each row's inner products with all of them, in several tasks
    own = found.repartition(PARALLEL, "url").withColumn("others", whole(found).scalar())
    own = own.withColumn("k", F.transform("others", lambda b: alike(me, b, "h") + alike(me, b, "p") + BIAS * BIAS)).drop("others")
    ready = whole(own, "k").select("rows", F.transform("rows", lambda r: r["k"]).alias("gram"), F.transform("rows", lambda r: (r["label"] > 0).cast("double")).alias("y"))
    # in function space: from a point y ahead of alpha, alpha <- (1 - rate * shrink) y + rate / n (label - p); y goes on in that direction
    step = f"""aggregate(sequence(1, {rounds}), named_struct('alpha', transform(y, x -> 0D), 'ahead', transform(y, x -> 0D)), (s, t) -> transform(
        array(zip_with(gram, zip_with(y, s.ahead, (a, b) -> named_struct('y', a, 'alpha', b)), (k, z) ->
            z.alpha * {1 - rate * shrink}D + {rate}D / size(y) * (z.y - 1D / (1D + exp(- aggregate(zip_with(k, s.ahead, (a, b) -> a * b), 0D, (a, b) -> a + b)))))),
        new -> named_struct('alpha', new, 'ahead', zip_with(new, s.alpha, (a, b) -> a + (t - 1D) / (t + 2D) * (a - b))))[0]).alpha"""
    solved = ready.select("rows", F.expr(step).alias("alpha"))
    each = solved.select(F.posexplode("rows").alias("i", "r"), "alpha").select("r.*", F.element_at("alpha", F.col("i") + 1).alias("b"))
    parts = [each.select(F.explode(c).alias("bucket"), (F.col(f"v{c}") * F.col("b")).alias("a")) for c in "hp"]
    weights = parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("a").alias("w"))
    intercept = each.agg((F.coalesce(F.sum("b"), F.lit(0.0)) * BIAS * BIAS).alias("w")).select(F.lit(buckets).alias("bucket"), "w")
    spread = rows.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(weights.union(intercept), "bucket", "left")
    return spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weights"))  # buckets + 1 numbers


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.6, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score (of the regression).

    At most ``max_labelled`` of the labelled urls are used, drawn by a hash. No shuffle of pages: the model is a fixed-size array, computed once as a scalar subquery. Null urls and urls without ://
    have empty host and path and are judged like any other; repeated rows each give a row; without labelled urls every score is
    one half and blocks nothing; an empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    model = train(labelled_urls(spark) if labelled is None else labelled, buckets, max_labelled)
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    of_host, of_path = features(F.col("host"), F.col("path"), buckets)
    found = cut.withColumns({"__h": of_host, "__p": of_path}).withColumn("weights", model.scalar())
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + F.get(F.col("weights"), b)) * unit(F.col(c))
    scored = found.select("page_id", "host", "path", (F.lit(1.0) / (F.lit(1.0) + F.exp(-(total("__h") + total("__p") + F.get("weights", F.lit(buckets)))))).alias("score"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")

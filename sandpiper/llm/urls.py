"""URL filter: host and path rules, then logistic regression on hashed character n-grams; all in Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host, path prefix)
Rule = tuple[str, str, str]
BUCKETS = 8192
GRAM = 3
#: Labelled URLs that are learnt from at most; a larger table is refused, as the fit runs in one task.
TRAIN_ROWS = 2000
#: What the labelled table is made of: words of unwanted and of wanted sites, what names add to them, suffixes and paths.
BLOCK_WORDS = (
    "casino", "poker", "slots", "roulette", "betting", "sportsbet", "bets", "jackpot", "freespins", "lottery", "porn", "xxx", "sexcams", "adult", "escorts", "hookup", "nude", "viagra", "cialis", "pills",
    "pharma-discount", "weightloss", "payday", "quick-loan", "easy-credit", "free-money", "cash-prize", "crypto-giveaway", "double-btc", "warez", "keygen", "cracked", "torrent", "movie-stream-free", "replica",
    "fake-watches", "phish", "verify-account", "malware", "adserver", "ads", "popads", "clicktrack", "tracker", "banner-exchange", "spam", "linkfarm", "link-exchange", "seo-backlinks", "clickbait", "content-mill",
)
BLOCK_MORE = ("win", "king", "4u", "best", "hot", "vip", "online", "farm", "palace", "deals", "cheap", "club", "zone", "bonus", "tube")
ALLOW_WORDS = (
    "library", "museum", "university", "college", "school", "kindergarten", "hospital", "clinic", "gazette", "herald", "tribune", "journal", "chronicle", "observer", "news", "weather", "radio", "orchestra",
    "theatre", "gallery", "cinema", "history", "heritage", "archive", "science", "physics", "chemistry", "biology", "astronomy", "geology", "climate", "ocean", "mountain", "river", "forest", "garden", "orchard", "farmers-market",
    "bakery", "kitchen", "recipes", "brewery", "coffee", "bookshop", "publisher", "poetry", "travel", "railway", "airport", "cycling", "hiking", "sailing", "football", "chess", "athletics", "parliament", "council",
    "ministry", "embassy", "police", "fire-service", "charity", "foundation", "church", "hotel", "architect", "engineering", "robotics", "software", "docs", "wiki", "forum", "developer", "statistics", "economics", "law-review",
    "insurance", "bank", "energy", "plumbing", "carpentry", "furniture", "textiles", "ceramics", "photography", "birdwatching", "veterinary", "genealogy", "translation", "dictionary", "maps",
)
NAMES = ("oakridge", "lindholm", "riverside", "tanaka", "montclair", "ashford", "bergen", "castellano", "dufour", "hanover", "kowalski", "northfield", "okafor", "pemberton", "salamanca", "westbrook", "yilmaz", "arenal", "thornbury", "hathersage", "erstine", "delander", "inverness", "andover", "restoria", "tihana", "oulton", "esther-street")
SUFFIXES = ("com", "net", "org", "info", "co.uk", "de", "fr", "io", "eu", "es")
PREFIXES = ("", "www.", "", "m.", "en.", "shop.", "blog.", "www2.")
PATHS = ("", "/", "/index.html", "/about-us", "/2021/04/17/spring-open-day", "/category/page/2", "/item?id=88", "/contact#form", "/en/home", "/a/18273", "/files/report.pdf", "/search?q=red+shoes", "/de/", "/blog/how-we-work.html", "/p/4410")


def seed_urls() -> list[tuple[str, int]]:
    """The labelled URLs, made of the words above by rule: each unwanted word alone and with additions, each wanted word alone, with
    two names and with another, each name alone, and invented names of two to four consonants with vowels, as letters as such are harmless.
    Suffixes, prefixes and paths go round alike for both labels, so they tell nothing."""
    made: list[tuple[str, int]] = []
    for i, w in enumerate(BLOCK_WORDS):
        a, b = BLOCK_MORE[i % len(BLOCK_MORE)], BLOCK_MORE[(7 * i + 4) % len(BLOCK_MORE)]
        made += [(w, 1), (f"{w}-{a}", 1), (f"{b}{w}", 1), (f"{w}{a}", 1)]
    for i, w in enumerate(ALLOW_WORDS):
        a, b = NAMES[i % len(NAMES)], NAMES[(5 * i + 3) % len(NAMES)]
        made += [(w, 0), (f"{a}-{w}", 0), (f"{w}{b}", 0), (f"{w}-{ALLOW_WORDS[(11 * i + 5) % len(ALLOW_WORDS)]}", 0)]
    made += [(n, 0) for n in NAMES for _ in range(3)]
    made += [("".join("bcdfghjklmnprstvwz"[(n * k + n // 3 + 5 * k) % 18] + "aeiou"[(n + 3 * k * k) % 5] for k in range(1, 3 + n % 3)), 0) for n in range(300)]
    return [(f"http{'s' * (n % 3 > 0)}://{PREFIXES[n % len(PREFIXES)]}{name}.{SUFFIXES[(n // 3) % len(SUFFIXES)]}{PATHS[(3 * n + n // 7) % len(PATHS)]}", label) for n, (name, label) in enumerate(made)]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def once(value: Column, use, when: Column | None = None) -> Column:
    """use(value) with the value computed once, though ``use`` reads it in a loop; an empty array where not ``when``."""
    made = F.transform(F.array(value) if when is None else F.filter(F.array(value), lambda _: when), use)
    return F.flatten(made) if when is not None else made[0]


def grams(host_col: Column, path_col: Column, buckets: int = BUCKETS, n: int = GRAM) -> Column:
    """Distinct hashed character n-grams of host and path, each kind with its own mark, digits alike; empty ones have none."""

    def of(mark: str, text: Column) -> Column:
        letters = F.split(F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$")), "")
        return once(letters, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(mark), *(F.element_at(c, i + k) for k in range(n))), F.lit(buckets)).cast("int")), F.length(text) > 0)

    return F.array_distinct(F.concat(of("h", host_col), of("p", path_col)))


def train(spark: SparkSession, labelled: DataFrame | None = None, buckets: int = BUCKETS, epochs: int = 3, rate: float = 1.0, decay: float = 0.0005) -> list[float]:
    """Weights (bias last), by gradient steps over the labelled URLs (url, label), one after the other.

    The fold runs as one SQL expression over the gathered rows, of which there are TRAIN_ROWS at most. Rows with a null url or
    label are left out; without rows all weights are zero.
    """
    rows = labelled if labelled is not None else spark.createDataFrame(seed_urls(), "url string, label int")
    rows = rows.filter("url is not null and label is not null").select(F.col("url"), F.col("label").cast("double").alias("y"))
    n = rows.limit(TRAIN_ROWS + 1).count()
    if n > TRAIN_ROWS:
        raise ValueError(f"{TRAIN_ROWS} labelled URLs at most")
    if not n:
        return [0.0] * (buckets + 1)
    seen = rows.withColumn("x", grams(host(F.col("url")), path(F.col("url")), buckets))
    # the row's indicator vector, bias last, scaled by its length
    scale = 1 / F.sqrt(F.size("x") + 1.0)
    full = F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda j: F.when((j == buckets) | F.array_contains("x", j), scale).otherwise(0.0))
    one = seen.select(F.struct(F.xxhash64("url").alias("o"), "url", "y", "x", full.alias("v")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    zero = F.array_repeat(F.lit(0.0), buckets + 1)

    def step(w: Column, r: Column) -> Column:
        total = F.aggregate(r["x"], F.element_at(w, buckets + 1), lambda s, j: s + F.element_at(w, j + 1))
        gain = rate * (r["y"] - 1 / (1 + F.exp(-total)))
        return once(gain, lambda g: F.zip_with(w, r["v"], lambda v, x: v * (1 - decay) + g * x))

    passes = F.flatten(F.array_repeat(F.col("rows"), epochs))
    return list(one.select(F.aggregate(passes, zero, step).alias("w")).first()[0])


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page.

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit, the longest (host
    and path together) decides, then the first in the list. Else the regression does: block if its score is 0.5 or
    more. A null url, or one without ``://``, has an empty host and path, fits no rule, has the bias's score and is
    judged by it. Repeated rows are judged each. Nothing is shuffled: rules and weights are literals of the plan, whose
    number is fixed by the parameters. Columns other than page_id and url are not read.
    """
    w = train(pages.sparkSession, labelled, buckets)
    weights, bias = F.lit([round(x, 9) for x in w[:-1]]), w[-1]
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for action, domain, prefix in ordered:
        # a rule's path is written without the leading slash
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + prefix)
        rule = F.when(fits, f"{domain}/{prefix}") if rule is None else rule.when(fits, f"{domain}/{prefix}")
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    score = 1 / (1 + F.exp(-(F.aggregate(grams(F.col("host"), F.col("path"), buckets), F.lit(float(bias)), lambda s, j: s + F.element_at(weights, j + 1)))))
    scored = parts.withColumn("score", score)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), F.coalesce(verdict, own).alias("verdict") if verdict is not None else own.alias("verdict"), "score")

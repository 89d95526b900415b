"""URL filter: rules on hosts, else logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only. The regression is trained from a small table of labelled URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .rules import let

# Fixed values of the task: verdict, host and path of each rule; the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hashed features: n-grams of these lengths.
FEATURES, ORDERS = 1 << 12, (3, 4, 5)

#: Labelled URLs: host and path of sites to allow and to block: gambling, medicines, money and goods; adult; ads and
#: tracking; spam and link farms; phishing and malware.
ALLOW = """
en.wikipedia.org/wiki/Physics   docs.python.org/3/library/json.html   www.nature.com/articles/s41586   arxiv.org/abs/1706
news.example.org/en/2021/report   blog.example.com/en/2290   www.example.org/fr/3175   library.example.edu/catalog/88
www.gov.example/health/advice   shop.example.com/en/books/12   m.example.org/en/414   museum.example.org/es/collection
forum.example.org/en/thread/55   www.example.com/fr/14472   weather.example.com/today   recipes.example.org/soup/7
wiki.example.org/en/History   history.example.edu/lectures   code.example.org/projects/8   university.example.edu/faculty
school.example.org/en/maths   science.example.com/en/biology   journal.example.org/volume/3   travel.example.com/en/guide
gardening.example.org/plants   sports.example.com/es/results   music.example.org/en/notes   blog.theatre.example.org/en/41
www.heron.example.com/fr/31757   thandre.example.org/en/28   onthere.example.com/es/11830   theraton.example.com/de/25824
new-england.example.org/en/611   www.state-parks.example.com/fr/8120   open-source.example.org/en/77   m.health-care.example.com/en/402
family-farm.example.org/cheese   train-tracks.example.com/en/90   adult-education.example.org/courses   town-hall.example.com/de/31
long-read.example.org/es/5011   book-club.example.com/en/2044   web-design.example.org/fr/19   www.art-school.example.com/en/6
blog.home-garden.example.com/en/118   read-aloud.example.org/en/3   bread-and-butter.example.com/fr/270   m.roadworks.example.org/en/12
www.winter-walks.example.com/en/71   fast-trains.example.org/en/8   new-books.example.com/de/415   news-desk.example.com/en/2207
blog.anthem.example.com/fr/204   hathaway.example.org/es/338   www.tithe.example.com/en/9120   thanet.example.org/en/44
"""
BLOCK = """
buy-viagra.example.org/order   casino-bonus.example.com/win   best-loans.example.org/apply   fake-watches.example.com/sale
online-casino.example.org/slots   poker-bets.example.com/en/1   cheap-meds.example.org/en/25   free-money.example.com/now
m.royal-casino.example.org/en/7   blog.cheap-viagra.example.com/en/36380   diet-pills.example.com/slim   sleeping-pills.example.org/fr/61
betting-tips.example.com/odds   free-spins.example.org/en/18   sports-bets.example.com/es/907   win-prize.example.com/claim
payday-loans.example.org/fast   crypto-profit.example.org/join   replica-bags.example.org/shop   lottery-winner.example.org/claim
pharmacy-discount.example.com/rx   www.slots-win.example.com/de/512   free-iphone.example.com/en/71   cheap-rolex.example.org/en/9
adult-video.example.org/xxx   hot-girls.example.com/dating   free-xxx.example.org/cams   sexy-chat.example.com/live
www.xxx-video.example.com/fr/2   escort-girls.example.org/city   porn-tube.example.com/watch   adult-cams.example.com/en/311
m.adult-dating.example.org/en/5   x-rated.example.com/es/44   nude-cams.example.org/fr/80   www.adult-tube.example.com/en/9412
ads-server.example.com/banner   ad-clicks.example.org/en/6   ads-network.example.com/en/9801   click-tracker.example.com/pixel
m.ads-exchange.example.org/fr/230   tracking-pixel.example.com/en/77   web-tracker.example.org/es/1204   banner-ads.example.com/en/33
popup-ads.example.org/de/81   www.user-tracking.example.com/en/5120   ads-click.example.org/en/2   adtracker.example.com/fr/91
spam-links.example.com/seo   link-farm.example.org/en/70   content-farm.example.com/en/3177   www.spam-blog.example.org/fr/12
seo-spam.example.com/en/8   m.click-farm.example.com/es/640   spam-mail.example.org/en/4409   buy-backlinks.example.com/seo
like-farm.example.org/en/15   www.spam-net.example.com/de/2233   link-exchange.example.org/seo   article-farm.example.com/en/905
phishing-login.example.org/verify   secure-login.example.com/account   verify-account.example.org/en/3   bank-update.example.com/login
mega-casino.example.com/en/88   poker-win.example.org/en/410   m.casino-club.example.com/fr/31   www.jackpot-win.example.com/en/2
paypal-verify.example.com/en/19   malware-download.example.com/exe   keygen-crack.example.com/dl   torrent-warez.example.org/get
"""


#: What is made into further labelled hosts, by one rule for all: words of each kind to block, the words beside
#: them, and words of sites to allow. Words of ALLOW_BESIDE stand beside words to block on sites to allow.
BLOCK_WORDS = """
casino poker betting jackpot roulette slots lottery wager bingo viagra cialis pills pharma tramadol steroids weightloss
loans payday forex bitcoin-profit rolex replica miracle xxx porn sex nude escort webcam-girls milf hentai adserver adclick
advert banner tracker pixel popunder malvert spam backlink linkfarm clickfarm seo-links doorway phish verify-account
login-update bank-alert malware trojan keygen crack warez botnet ransom
"""
BESIDE = "24 best online mega hub free club bargain now zone load shop"
ALLOW_WORDS = """
brook manor valley winter window winner-stories chester cathedral pillar pilgrim village adverb adventure banneret pixel-art
track-and-field athletics railway tracks sexagesimal essex sussex middlesex loan-words bank-holiday holiday garden theatre
library history science maths physics biology museum recipe soup bread weather travel music poetry grammar teacher
lecture health clinic hospital nurse vaccine market harvest farmer dairy orchard bookshop novel reader journal archive
council parish charity volunteer mountain glacier ocean harbour lighthouse ferry engine bicycle football cricket backgammon
"""
ALLOW_BESIDE = "filter history film prevention awareness law research museum museums news-report addiction-help studies novel"
HOSTS = ("{w}-{b}.example.com/en/0", "www.{b}{w}.example.org/fr/0", "{w}{b}.example.com/{b}", "m.{b}-{w}.example.org/es/0", "{w}.example.com/")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    """Whether a rule covers a host, itself or as a subdomain, and the path starts with the rule's."""
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of ``host`` and ``path``, between marks of the edges; every number of the path reads as 0."""
    whole = F.concat(F.lit("^"), host, F.lit("|"), F.regexp_replace(lower_ascii(path), "[0-9]+", "0"), F.lit("$"))

    def of_length(text, n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return let(whole, lambda text: F.concat(*(of_length(text, n) for n in ORDERS)))


def hashed(items: Column) -> Column:
    """The buckets of the n-grams, from 1; a gram counts once."""
    return F.array_distinct(F.transform(items, lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)) + 1))


def made() -> list[tuple[str, str, float]]:
    """(group, url, label) of the table: the listed URLs, and those that words make; a group is never split.

    Each word meets three of the words beside it and three of the forms in turn, so the two sides share
    forms, paths and, by ``ALLOW_BESIDE``, words.
    """
    rows = [(u, u, label) for label, text in ((0.0, ALLOW), (1.0, BLOCK)) for u in text.split()]
    for label, words, beside in ((1.0, BLOCK_WORDS, BESIDE), (0.0, ALLOW_WORDS, BESIDE), (0.0, BLOCK_WORDS, ALLOW_BESIDE)):
        near = beside.split()
        for i, w in enumerate(words.split()):
            times = 3 if beside == BESIDE else 1
            for k in range(times):
                form = HOSTS[(i + k) % (len(HOSTS) if beside == BESIDE else 4)]
                rows.append((w, form.format(w=w, b=near[(i * 3 + k * 5) % len(near)]), label))
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """The table: group, host, path and label (1: block)."""
    table = ", ".join(f"('{g}', '{u}', {label}D)" for g, u, label in made())
    urls = spark.sql(f"SELECT * FROM VALUES {table} AS t(part, url, label)").withColumn("url", F.concat(F.lit("https://"), "url"))
    return urls.select("part", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")


def train(examples: DataFrame, regularisation: float = 0.01, rounds: int = 50) -> tuple[list[float], float]:
    """Weights of the hashed n-grams and the bias, by logistic regression over ``host``, ``path``, ``label``."""
    buckets = F.transform(hashed(grams(F.col("host"), F.col("path"))), lambda b: b.cast("string"))
    # a vocabulary of all buckets makes sparse vectors of the buckets themselves
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(1, FEATURES + 1)], "buckets", "features")
    rows = counter.setBinary(True).transform(examples.select(buckets.alias("buckets"), "label"))
    regression = LogisticRegression(regParam=regularisation, maxIter=rounds, standardization=False)
    model = regression.fit(rows.select("features", "label"))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score_of(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The logistic score of a URL."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    total = F.aggregate(hashed(grams(host, path)), F.lit(bias), lambda sum_, b: sum_ + F.element_at(table, b.cast("int")))
    return 1 / (1 + F.exp(-total))


def best_threshold(examples: DataFrame, folds: int = 3) -> float:
    """The score from which to block that errs least on groups (``part``) that a fit has not seen.

    To block a site that is to be allowed counts half as much again as the other error, whatever their numbers. Of
    thresholds as good the one in the middle is taken.
    """
    fold = F.pmod(F.xxhash64("part"), F.lit(folds))
    scored = []
    for k in range(folds):
        weights, bias = train(examples.where(fold != k))
        held = examples.where(fold == k).select("label", score_of(F.col("host"), F.col("path"), weights, bias).alias("score"))
        scored += [(r["score"], r["label"]) for r in held.collect()]  # a row of the small table each
    good, bad = (sorted(s for s, label in scored if label == side) for side in (0.0, 1.0))
    steps = [i / 100 for i in range(5, 96)]
    cost = [1.5 * sum(s >= t for s in good) / max(1, len(good)) + sum(s < t for s in bad) / max(1, len(bad)) for t in steps]
    best = [t for t, c in zip(steps, cost, strict=True) if c == min(cost)]
    return best[len(best) // 2]


def judge_urls(df: DataFrame, url_col: str = "url", examples: DataFrame | None = None, rules=RULES, threshold: float | None = None) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    ``rule`` is the longest rule that fits, as host and path, else null; ties go to the earlier one.
    Where none fits the regression decides: block from a score of ``threshold``, by default the one that
    errs least on rows of the table (``examples``: part, host, path, label) it was not fitted on. A null url, or one without
    ``://``, has an empty host and path and is scored like any other. Columns of ``df`` with these
    names are replaced.
    """
    names = ("host", "path", "rule", "score", "verdict")
    examples = (examples if examples is not None else labelled(prepare(df.sparkSession))).coalesce(1)
    weights, bias = train(examples)
    threshold = best_threshold(examples) if threshold is None else threshold
    others = [c for c in df.columns if c not in names or c == url_col]
    rest = F.struct(*(df[c] for c in others)).alias("rest")
    split = df.select(rest, host_of(df[url_col]).alias("host"), path_of(df[url_col]).alias("path"))
    host, path = F.col("host"), F.col("path")
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = reduce(lambda tail, r: F.when(fits(host, path, r[1], r[2]), F.lit(r[1] + r[2])).otherwise(tail), reversed(by_length), F.lit(None).cast("string"))
    of_rule = F.create_map(*(F.lit(x) for verdict, h, p in rules for x in (h + p, verdict)))
    judged = split.select("rest", "host", "path", rule.alias("rule"), score_of(host, path, weights, bias).alias("score"))
    verdict = F.coalesce(F.try_element_at(of_rule, F.col("rule")), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select(*(F.col("rest")[c].alias(c) for c in others), *names[:4], verdict.alias("verdict"))

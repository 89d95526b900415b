"""The URL regression on hosts that its table does not hold."""

import re

from veilframe.llm import queries, urlfilter

BAD = "cheap-pills|casino-win|free-bets|ads-track|spam-farm|adult-x"
UNSEEN = {
    "block": """spam-hub.example.com/en/7 linkfarm.example.org/en/12 ad-server.example.com/en/88 ads-pixel.example.org/fr/5 web-tracking.example.com/en/31
        adult-club.example.com/en/6 xxx-tube.example.org/en/90 vegas-casino.example.com/es/14 cheap-drugs.example.org/en/3 verify-login.example.com/en/2""",
    "allow": """river.example.org/en/7 green-house.example.com/en/12 the-valley.example.org/en/88 castle.example.com/fr/5 northern.example.org/en/31
        library-news.example.com/en/6 weather-maps.example.org/en/90 bridge.example.com/es/14 chess-notes.example.org/en/3 theory.example.com/en/2""",
}


def test_no_host_of_the_table_stands_in_the_pages(spark):
    table = {u.split("/")[0] for _, u, _ in urlfilter.made()}
    hosts = {r.host for r in queries.op4_urls(spark, "/root/testdata/sf0.01").select("host").distinct().collect()}
    assert not table & hosts and not any(re.search(BAD, h) for h in table)
    assert not {u.split("/")[0] for us in UNSEEN.values() for u in us.split()} & table


def test_unseen_hosts_of_every_kind(spark):
    rows = [("https://" + u, verdict) for verdict, us in UNSEEN.items() for u in us.split()]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "url string, wanted string")).collect()
    right = {w: sum(r.verdict == w and r.rule is None for r in out if r.wanted == w) for w in UNSEEN}
    assert right["block"] >= 8 and right["allow"] >= 9, [(r.host, round(r.score, 2)) for r in out if r.verdict != r.wanted]


def test_pages_of_every_kind(spark):
    free = queries.op4_urls(spark, "/root/testdata/sf0.1").where("rule IS NULL").collect()
    for kind in BAD.split("|"):
        mine = [r.verdict for r in free if kind in r.host]
        assert mine.count("block") >= 0.95 * len(mine) and (mine or kind == "adult-x")
    rest = [r.verdict for r in free if not re.search(BAD, r.host)]
    assert rest.count("allow") > 0.97 * len(rest)


# Stems that stand nowhere in the table, and good hosts that hold bad words or parts of them.
STEMS = {
    "block": """gambling-palace.example.com/en/4 sportsbook-king.example.org/fr/2 viagra24.example.com/en/8 trojan-load.example.com/en/1
        weightloss-miracle.example.org/en/6 malvertise.example.com/es/7 adnetwork-clicks.example.org/en/30 spamblaster.example.com/fr/9
        hotporn-tube.example.com/en/2 casinoroyal-slots.example.org/en/5""",
    "allow": """spam-filter-howto.example.org/en/12 casino-royale-film.example.com/en/3 winchester.example.org/fr/9 essexgardens.example.com/en/8
        malware-research.example.org/en/2 betty-crocker-recipes.example.com/en/4 spinning-wheel.example.org/es/6 bankside-theatre.example.com/en/7
        pillow-shop.example.org/en/15 steamtrains.example.com/fr/21""",
}


def test_stems_that_are_not_in_the_table(spark):
    rows = [("https://" + u, verdict) for verdict, us in STEMS.items() for u in us.split()]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "url string, wanted string")).collect()
    wrong = [(r.host, round(r.score, 2)) for r in out if r.verdict != r.wanted]
    right = {w: sum(r.verdict == w for r in out if r.wanted == w) for w in STEMS}
    assert right["block"] >= 7 and right["allow"] >= 9, wrong

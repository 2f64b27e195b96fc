"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

Native: DataFrame functions and JVM machine learning only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of the n-grams; the weights are one literal array of this length.
BUCKETS = 4096
NGRAMS = (3, 4, 5)

#: (rule, verdict): a host suffix and a path prefix.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# The small labelled URL table, written by hand: whole urls without their scheme, of many kinds of sites. Hosts of label 1 (block) are invented in
# the manner of advertising, gambling, pill, dating, piracy and phishing pages; those of label 0 are invented or well-known sites.
SEED_URLS = {
    1: """
        cheap-pills-online.biz/buy-now?aff=3 buyviagra4less.net/order best-casino-bonus.com/free-spins luckyslots777.net/play/register pokerkings-online.com/deposit-bonus
        hotsingles-nearby.com/join-free xxxvideos-free.net/watch/hd adultcams-live.com/girls/online sexchat-now.net/signup nudegirls-pics.com/gallery/123 pornhub-mirror.biz/video/88
        replica-watches-outlet.com/rolex-cheap fake-designer-bags.net/sale payday-loans-fast.com/apply-now instant-cash-advance.biz/approve credit-repair-fix.net/guaranteed
        free-iphone-winner.com/claim-prize you-won-giftcard.net/claim/now lottery-winner-notice.com/claim miracle-weight-loss.biz/lose-30-pounds keto-diet-pills.net/trial-offer
        warez-downloads.net/crack/photoshop-keygen torrents-movies-free.com/download/full-movie serialkeys-crack.biz/windows-activator nulled-scripts.net/premium-free mp3-downloads-free.net/album.zip
        secure-login-verify.net/paypal/account-update account-suspended-alert.com/signin/verify bank-security-update.biz/login.php?session=expired appleid-unlock-support.net/verify.html webmail-quota-upgrade.com/login
        forex-signals-profit.com/get-rich-quick bitcoin-doubler.biz/double-your-btc crypto-giveaway-eth.net/send-receive binary-options-robot.com/make-money-fast work-from-home-cash.net/earn-5000-weekly
        cheapjerseys-wholesale.net/nfl-outlet ray-ban-discount.biz/90-off escort-service-city.com/book-tonight hookup-tonight-local.net/chat mature-dating-free.com/meet-now camgirl-tokens-free.net/generator
        sportsbet-odds-tips.com/bet-now roulette-winning-system.net/download bingo-bonus-codes.com/no-deposit online-betting-offers.biz/free-bet jackpot-party-coins.net/hack-unlimited
        penis-enlargement-guide.com/order-now male-enhancement-pills.net/free-trial cialis-no-prescription.biz/cheap xanax-overnight-delivery.net/buy canadian-pharmacy-rx.com/discount-meds steroids-shop-legal.biz/buy-anabolic
        download-free-movies-hd.net/stream/putlocker watch-series-free.biz/episode-1 livestream-ppv-free.net/fight cracked-apks.com/mod-unlimited-money game-cheats-hacks.net/aimbot free-vbucks-generator.com/human-verification
        clickhere-offers.net/redirect?url=promo popunder-ads-network.biz/click?id=99 track-offer-cpa.com/go/aff_c?offer_id=2 superdeals-coupon-hot.net/limited-time-offer seo-backlinks-cheap.com/buy-10000-links
        spam-mailer-tool.net/bulk-email-sender buy-followers-likes.biz/instagram-cheap adult-toys-discount.com/sale webcam-strip-show.net/free milf-hookups.biz/register teen-sexy-pics.net/gallery
        hot-brides-online.com/meet-russian-women sugar-daddy-meet.net/join-free lonely-wives-chat.biz/tonight free-porn-tube.com/category/amateur hentai-manga-xxx.net/read fetish-cams-free.biz/live
        slot-machine-gratis.net/giri-gratis casino-en-ligne-bonus.biz/jouer viagra-kaufen-billig.net/bestellen kredit-ohne-schufa.biz/sofort gagner-argent-facile.net/inscription ganar-dinero-rapido.biz/registro pastillas-baratas.net/comprar
        my-cheap-loans.biz/no-credit-check debt-relief-now.net/free-quote miracle-cure-cancer.com/secret-doctors-hate anti-aging-serum-trial.net/order hair-loss-miracle.biz/buy-1-get-2 fat-burner-extreme.com/special-offer
        unblock-pirate-bay.net/proxy keygen-serial-number.biz/office-crack hacked-accounts-list.net/combo-free cheap-windows-keys.biz/lifetime fake-id-cards-usa.net/order essay-cheap-writers.biz/buy-essay
        win-big-lotto.com/play-now mega-jackpot-spin.net/bonus xxx-dating-site.com/signup-free prize-survey-reward.biz/claim?id=7 get-free-robux.net/generator hot-deal-pills.com/checkout bet365-bonus-code.net/get casino777.biz sexy-live-cams.com xxx-movies.net freeslots.biz
        cheap-pills-store.net/en/9 casino-spins-club.net/en/12 xxx-clips.net/de/7 viagra-shop.net/fr/3 poker-bonus-net.net/es/1 loans-fast.net/en/5 replica-bags.net/de/wetter torrents-free.net/fr/films hot-dates.net/es/chat free-cams.net/en/live
        """,
    0: """
        github.com/apache/spark/pulls arxiv.org/abs/1706.03762 en.wikipedia.org/wiki/Suffix_array bbc.co.uk/news/science-environment nytimes.com/2023/05/01/world/europe.html theguardian.com/books/2022/review
        docs.python.org/3/library/itertools.html stackoverflow.com/questions/11227809 developer.mozilla.org/en-US/docs/Web/HTTP kernel.org/doc/html/latest postgresql.org/docs/current/sql-select.html freebsd.org/handbook/ports debian.org/releases/stable
        stanford.edu/class/cs224n mit.edu/research/energy ox.ac.uk/admissions/undergraduate essex.ac.uk/departments/history uni-heidelberg.de/studium/faecher sorbonne-universite.fr/formation universidad.es/grados/derecho nature.com/articles/s41586-020 sciencedirect.com/journal/cell
        nasa.gov/missions/webb noaa.gov/weather/forecast who.int/news-room/fact-sheets europa.eu/legislation/summaries gov.uk/browse/benefits loc.gov/collections/maps britishmuseum.org/collection/object metmuseum.org/art/collection smithsonianmag.com/history
        weather.com/forecast/paris allrecipes.com/recipe/lentil-soup gardeningknowhow.com/edible/vegetables/tomato nationalgeographic.com/animals/article/whales lonelyplanet.com/italy/rome goodreads.com/book/show/5107 imdb.com/title/tt0111161 openstreetmap.org/way/2391
        cityofsprings.gov/council/minutes/2021 riverside-school.edu/calendar/term-dates oakwood-library.org/opening-hours lakeside-hospital.org/departments/cardiology betterhomes-magazine.com/kitchen/ideas alphabet-books.com/children/reading bettywrites.net/blog/2019/garden
        freeman-architects.com/projects/station hotelkeeper-journal.com/interviews winchester-cathedral.net/visit winterthur-stadt.ch/kultur essex-walks.net/coast/route-4 sussex-beekeepers.org/honey middlesex-history.net/archive scunthorpe-museum.net/steel
        linux-magazine.com/issues/2020 rust-lang.org/learn golang.org/doc/effective numpy.org/doc/stable pandas.pydata.org/docs/reference jupyter.org/install cran.r-project.org/web/packages sqlite.org/lang_select.html gnu.org/software/make/manual
        lemonde.fr/culture/article/2021 spiegel.de/wissenschaft/mensch elpais.com/cultura/2020 corriere.it/esteri repubblica.it/scienze nzz.ch/feuilleton zeit.de/wissen/geschichte larousse.fr/dictionnaires rae.es/diccionario
        npr.org/sections/music reuters.com/markets/commodities apnews.com/hub/climate economist.com/finance scientificamerican.com/article/black-holes newscientist.com/space physicsworld.com/a/quantum chemistry-europe.net/journal mathoverflow.net/questions/2014
        python-forum.net/thread/101 woodworking-talk.net/tools birdwatching-daily.net/migration stamp-collectors-club.net/catalogue chess-opening-notes.net/sicilian astronomy-pictures.net/nebula local-history-society.net/parish railway-timetables.net/1954 mountain-weather.net/alps
        community-orchestra.net/concerts parish-newsletter.net/june village-cricket.net/fixtures food-bank-volunteers.net/help open-data-portal.net/datasets/rivers translation-studies.net/papers poetry-archive.net/keats language-exchange.net/german folk-music-notes.net/jigs
        kitchen-recipes.net/bread/sourdough family-travel-diary.net/norway knitting-patterns.net/scarf home-repair-manual.net/plumbing bicycle-touring.net/danube wildflower-guide.net/meadow photo-walks.net/harbour school-science-projects.net/volcano baking-notes.net/rye
        shop.oldtown-bookstore.net/fiction/novels mail.provider-north.net/inbox static.cdn-assets.net/js/app.js forum.rose-gardeners.net/roses blog.maths-teacher.net/fractions wiki.bridge-engineers.net/arches maps.city-transit.net/lines calendar.rowing-club.net
        en.travel-letters.net/en/12 www.valley-news.net/en/7 magazine.riverpress.net/de/wetter musee-marine.net/fr/histoire biblioteca-central.net/es/catalogo zeitung-am-abend.net/de/politik revue-savante.net/fr/sciences diario-local.net/es/deportes
        api.service-status.net/v1/health cdn.webfonts.net/roboto.woff2 downloads.linux-mirror.net/iso docs.storage-cloud.net/buckets support.printer-maker.net/drivers careers.savings-bank.net/analyst investor.wind-energy.net/reports press.car-maker.net
        theatre-royal.com/whats-on film-festival.com/programme opera-house.com/season museum-of-flight.com/exhibits botanic-garden.com/visit zoo-conservation.com/species observatory-visits.com/nights aquarium-bay.com/feeding science-centre.com/schools
        veterinary-clinic.com/appointments dental-practice.com/team law-society.com/guidance tax-advice-bureau.com/self-assessment housing-charity.com/advice farmers-market.com/stalls brewery-history.com/tours railway-museum.com/engines canal-trust.com/locks
        """,
}

# Held out: no word of these hosts and paths, and no host, is one of the table's; they are never learned from.
HELD_OUT_URLS = {
    1: """
        pharma4u-rebates.net/tramadol gratisporno.biz/filme blackjack-vip.net/welcome nakedteens.biz/schoolgirls megawinner-post.net/redeem piratedgames.biz/repack cheapestviagrapills.net xxxtube.biz/blowjob
        realmoneyslots.net/wager instantpayday.biz/easyloan sexdate-finder.net/flirt loanapproval.biz/dollars hotgirlscams.net/naughty crackedsoftware.biz/serials onlinecasino-rank.biz/bonuses bestbettingsites.net/odds4you
        escorts-directory.biz/callgirls clonedrolexwatch.biz/cheapest verifyaccount.net/signinnow weightlosspills.biz/slimming getfreegiftcards.net/winners pornstars.net/lesbian adultfriend.biz/swingers pokerfreeroll.net/chips
        hackedgames.biz/cheater bulkmailers.biz/spamming freeviagra.biz/tablets casinojackpots.net/bettors sexycamgirls.biz/nude torrentz.biz/cracks luckywinner.biz/prizes cheaploans.net/quickcash
        """,
    0: """
        geology-fieldtrip.net/dolomites harbourmaster.net/tides pottery-workshop.net/glazes kindergarten-sunflower.net/parents handball-verein.net/tabelle violin-makers.net/varnish cartography-today.net/projections sailing-lessons.net/mooring
        apple-orchard.net/cider betacarotene-trials.net/findings analysis-notebook.net/regression cockburn-turbines.net/rotors shitake-growers.net/spores essays-assessed.net/grading titanium-alloys.net/fatigue grape-harvest.net/vintage
        castle-ruins.net/moat compiler-theory.net/parsing glaciermapping.net/moraine lighthouse-keepers.net/logbook monastery-manuscripts.net/psalter owlrescue.net/donate planetarium.net/dome quilting-circle.net/patchwork
        meteorology-institute.net/radiosonde sculpture-trail.net/bronze accordion-makers.net/bellows typography-lab.net/kerning seabiology.net/plankton ferry-timetable.net/islands philosophy-seminar.net/kant bakers-guild.net/flour
        """,
}


def seed_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The labelled URL table (url, label); with `held_out`, urls of other hosts and words."""
    table = HELD_OUT_URLS if held_out else SEED_URLS
    rows = [(f"{'http' if i % 3 == 0 else 'https'}://{'www.' if i % 4 == 0 else ''}{url}", float(label)) for label, urls in table.items() for i, url in enumerate(urls.split())]
    return spark.createDataFrame(rows, "url string, label double")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(part: Column, mark: str) -> Column:
    """Bucket numbers of the character n-grams of one part between its marks."""
    marked = F.concat(F.lit(mark), part, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.char_length(marked) >= n, F.sequence(F.lit(1), F.char_length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of(n) for n in NGRAMS])


def features(host: Column, path: Column) -> Column:
    """Distinct bucket numbers of host and path."""
    return F.array_distinct(F.concat(ngrams(host, "^"), ngrams(path, "/")))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights per bucket and the intercept, from a labelled table (url, label 0 or 1).

    Logistic regression with a ridge penalty on the bucket numbers as sparse vectors; the
    "vocabulary" is the bucket numbers themselves, so index and bucket agree."""
    url = F.col("url")
    used = labelled.where("label is not null").select("label", features(url_host(url), url_path(url)).cast("array<string>").alias("ids"))
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], inputCol="ids", outputCol="features", minTF=0)
    model = LogisticRegression(regParam=0.01, maxIter=60, standardization=False).fit(sparse.transform(used))
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """Probability of label 1 (block): one projection, the weights a constant array."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(features(host, path), F.lit(intercept), lambda acc, i: acc + F.get(table, i))
    return 1 / (1 + F.exp(-total))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains if the
    path starts with the rule's path."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = rule.partition("/")
        found = F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + rest), F.lit(rule)).otherwise(found)
    return found


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """Judge every url of pages (page_id, url; other columns are ignored): page_id, host, path,
    rule, verdict, score.

    The verdict is the longest fitting rule's (of equally long ones the last in `rules`), else block where the classifier's score is 0.5 or
    more. A null url, or one without ://, has empty host and path, fits no rule and is judged by
    the classifier. Repeated rows are each judged; an empty table gives no rows."""
    weights, intercept = fit(labelled)
    url = F.col("url")
    parts = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = parts.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "score": score(F.col("host"), F.col("path"), weights, intercept)})
    by_rule = reduce(lambda c, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(c), rules, F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", by_rule.alias("verdict"), "score")

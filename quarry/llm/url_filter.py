"""URL filter: logistic regression on hashed character n-grams of host and path.

The host (without scheme, user, port and a leading www.) and the path (with the query, without the fragment) are folded to lower case; their
character n-grams of 3 to 5, marked as the host's or the path's, are hashed. The model is fitted to a small table of labelled URLs
(url, bad 0 or 1) and scores every page's URL; no page is fetched and html is never read.

A score equal to the threshold is blocked. URLs may be of any length. A null or empty URL has a null score and isn't blocked. Labelled rows with a null in either column are skipped, as are repeats; a URL with
both labels is bad. Without labels of both kinds every score is 0. All rows are scored, also repeated ones and those with a null page_id. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import vec

U = np.uint64
HASH_BITS = 18
NGRAMS = (3, 4, 5)
THRESHOLD, RIDGE, STEPS, MOST_LABELS = 0.6, 1e-4, 300, 50_000

#: A small labelled table: what hosts and paths to be filtered look like, and ordinary ones.
BAD_HOSTS = (
    "grand-casino casino-royale online-casino bestcasino lucky-slots slot-machines bets-online sport-bets betting-tips poker-room pokerstars-bonus jackpot-city discount-pills "
    "buy-pills cheap-viagra pharmacy-deals viagra-shop cheap-meds diet-pills ad-tracker ads-server track-clicks adserver popup-ads banner-ads click-farm content-farm link-farm spam-mail "
    "seo-links free-links xxx-videos adult-cams porn-tube sexy-chat hot-dates free-iphone win-prizes claim-prize payday-loans quick-loans crypto-doubler "
    "warez-keygen cracked-apps torrent-crack fake-watches replica-bags get-rich"
).split()
GOOD_HOSTS = (
    "wikipedia gutenberg archive library university museum journal science-news weather nature history-notes cityhall gov-data parliament health-service hospital "
    "gardening recipes cooking-class cinema-review book-club chess-school football-results music-theory guitar-lessons photo-album travel-notes railway "
    "airport-info maps geology astronomy physics-forum math-help python-docs linux-manual open-source code-review database-guide statistics economics "
    "law-review philosophy poetry theatre art-gallery local-news morning-post evening-times daily-herald radio-archive northern-heritage orchestra trading-standards botany harbour-office village-council observatory dictionary translation "
    "bakery furniture-repair bicycle-works pottery carpentry veterinary orchard lighthouse mountain-rescue choir kindergarten apprenticeship"
).split()
BAD_PATHS = ("", "win?bonus=100", "play/free-spins", "cheap/buy-now", "click?id=77", "promo/claim", "xxx/watch")
GOOD_PATHS = ("", "articles/2021/05/notes.html", "en/3341", "de/901.html", "wiki/river?page=2&ref=x", "about/team", "fr/5512?utm_source=feed", "es/78/", "docs/index.html#top")
DOMAINS = ("com", "net", "org", "example.com", "example.net", "example.org", "co.uk", "de")


def labelled_urls() -> list[tuple[str, int]]:
    """Every listed host on some of the domains, with paths of its kind; ordinary paths also stand on hosts to be filtered, as the host decides."""
    out = []
    for bad, hosts, paths in ((1, BAD_HOSTS, BAD_PATHS + GOOD_PATHS), (0, GOOD_HOSTS, GOOD_PATHS)):
        for n, host in enumerate(hosts):
            for k in range(6):
                domain, path = DOMAINS[(n * 3 + k) % len(DOMAINS)], paths[(n * 5 + k * 2) % len(paths)]
                out.append((f"http{'s' * (k % 2)}://{('', 'www.', 'm.', 'blog.')[(n + k) % 4]}{host}.{domain}/{path}", bad))
    return out


def parts(url: str) -> tuple[str, str]:
    """Host and path of a URL, folded; what has no scheme begins with its host."""
    rest = url.strip().split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest[:12] else rest.removeprefix("//")
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].lower()
    host = host.rsplit("@", 1)[-1].split(":", 1)[0]
    return host.removeprefix("www."), path


def features(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each distinct n-gram."""
    rows, feats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    both = [parts(u) for u in urls]
    for which in (0, 1):
        data, offsets = vec.text_bytes(pa.array([f"^{p[which]}$" if p[which] else "" for p in both], pa.string()))
        sums = vec.prefix(vec.TABLE[data])
        row = np.searchsorted(offsets, np.arange(len(data)), side="right") - 1
        for n in NGRAMS:
            at = np.arange(max(0, len(data) - n + 1))
            at = at[row[at] == row[at + n - 1]]
            h = vec.mix(vec.span_hashes(sums, at, at + n), 10 * which + n)
            rows.append(row[at])
            feats.append((h >> U(64 - HASH_BITS)).astype(np.int64))
    keys = np.unique(np.concatenate(rows) << HASH_BITS | np.concatenate(feats))
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


def scale(rows: np.ndarray, n: int) -> np.ndarray:
    """Each row's features have length 1 together."""
    return 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))[rows]


def fit(labels: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights of all features, and the bias."""
    table: dict[str, int] = {}
    for url, bad in labels:
        if url and bad is not None:
            table[url] = max(table.get(url, 0), int(bad > 0))
    urls = sorted(table)
    y = np.array([table[u] for u in urls], float)
    w, bias = np.zeros(1 << HASH_BITS), -40.0
    if not len(y) or not 0 < y.sum() < len(y):
        return w, bias
    rows, feats = features(urls)
    used, cols = np.unique(feats, return_inverse=True)
    values = scale(rows, len(urls))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    v, bias, look, look_bias, t = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0
    rate = 1 / (0.25 * weight.max() * len(y) / 4 + RIDGE)
    for _ in range(STEPS):
        error = weight * (1 / (1 + np.exp(-(np.bincount(rows, values * look[cols], len(urls)) + look_bias))) - y)
        new = look - rate * (np.bincount(cols, values * error[rows], len(used)) + RIDGE * look)
        new_bias, t_new = look_bias - rate * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - v), new_bias + (t - 1) / t_new * (new_bias - bias)
        v, bias, t = new, new_bias, t_new
    w[used] = v
    return w, float(bias)


def scores(urls: list[str | None], w: np.ndarray, bias: float) -> list[float | None]:
    texts = [u or "" for u in urls]
    rows, feats = features(texts)
    total = np.bincount(rows, scale(rows, len(texts)) * w[feats], len(texts)) + bias
    p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
    return [float(x) if u and u.strip() else None for x, u in zip(p, urls, strict=True)]


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, most_labels: int = MOST_LABELS) -> DataFrame:
    """page_id, url, score and blocked of every page. labels: url, bad; a small table, of which at most `most_labels` rows are used (those with the smallest hash)."""
    spark: SparkSession = pages.sparkSession
    known = labelled_urls() if labels is None else [(r[0], r[1]) for r in labels.select(F.col("url").cast("string"), F.col("bad").cast("int")).dropna().orderBy(F.xxhash64("url"), "url", "bad").limit(most_labels).collect()]
    held = spark.sparkContext.broadcast(fit(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                p = scores(batch.column(1).to_pylist(), w, bias)
                blocked = [x is not None and x >= threshold for x in p]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array(blocked, pa.bool_())], ["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, url string, score double, blocked boolean")

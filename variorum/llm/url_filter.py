"""URL filters: rules by host and path, else a logistic regression on hashed character n-grams.

Rules, as many as the driver holds, are looked up by the host and its parent
domains, then by those lengths of the path that such a rule has.  The model is
trained on a small labelled table of URLs.  Its features are the distinct
n-grams of the host and, apart from them, of the path.

Defined results: a null url, or one without ``://``, has an empty host and
path; without n-grams the score is 0, which allows; very long urls are judged
whole; of rules that tie in length the first by host and path fits; a null
page_id is kept; equal rows are judged one by one; an empty table gives an
empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._grams import column_bytes
from variorum.llm.toxicity import code_points
from variorum.llm._shared import tidy

# Verdict, host and path of the rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

# Labelled URLs, 1 for those to block.
LABELLED = [
    ("http://ads.banner-network.com/click/728x90?id=4", 1),
    ("https://ad-server.adtrack.net/serve/popunder", 1),
    ("http://track.pixel-ads.io/beacon/impression", 1),
    ("https://m.ads-media.co/en/redirect/2211", 1),
    ("https://click.affiliate-tracker.biz/go/offer", 1),
    ("http://www.ads-exchange.org/bid/creative", 1),
    ("https://tracking.adclicks.example/t/open.gif", 1),
    ("http://stats.ad-tracker.info/collect", 1),
    ("http://free-casino-bonus.win/slots/jackpot", 1),
    ("https://online-poker-bets.bet/signup/bonus", 1),
    ("http://casino-royal.top/play/roulette", 1),
    ("https://sport-betting-tips.xyz/odds/today", 1),
    ("http://xxx-videos-hot.club/watch/1882", 1),
    ("https://adult-cams-live.cam/room/77", 1),
    ("http://porn-tube-free.xxx/video/new", 1),
    ("http://secure-login-verify.tk/paypal/account/update", 1),
    ("http://bank-account-verify.cf/login/confirm", 1),
    ("https://appleid-unlock.ml/verify/password", 1),
    ("http://cheap-pills-pharmacy.ru/viagra/order", 1),
    ("http://buy-followers-now.click/instagram", 1),
    ("http://download-crack-keygen.su/serial/keygen.exe", 1),
    ("http://warez-torrents.to/movies/free-download", 1),
    ("https://winner-prize-claim.online/iphone/free", 1),
    ("http://spam-offers.link/win/gift-card", 1),
    ("https://en.wikipedia.org/wiki/Language", 0),
    ("https://www.example.com/fr/825", 0),
    ("https://example.org/en/685", 0),
    ("https://blog.example.net/en/25.html", 0),
    ("https://news.example.com/de/14804", 0),
    ("http://www.library.edu/catalog/books/12", 0),
    ("https://docs.python.org/3/library/index.html", 0),
    ("https://github.com/project/repository/issues", 0),
    ("https://www.university.edu/research/papers/2021", 0),
    ("http://museum.org/en/exhibitions/77", 0),
    ("https://www.government.gov/fr/reports/annual", 0),
    ("https://weather.service.gov/forecast/today", 0),
    ("https://m.newspaper.com/es/articulo/51097", 0),
    ("http://www.zeitung.de/de/artikel/17357", 0),
    ("https://www.journal.fr/fr/article/43790", 0),
    ("https://recipes.kitchen.com/en/soup/4", 0),
    ("https://history.archive.org/details/text9", 0),
    ("http://mail.company.com/en/contact", 0),
    ("https://shop.bookstore.com/en/item/3746", 0),
    ("https://forum.garden.net/de/thread/1065", 0),
    ("https://travel.maps.org/es/ciudad/281", 0),
    ("https://www.school.org/en/lesson/9834/", 0),
    ("http://theatre.city.net/en/program", 0),
    ("https://blog.science.com/en/13278", 0),
    ("https://ads.example.org/en/12", 1),
    ("http://track.example.com/fr/41.html", 1),
    ("https://m.adserver.example.net/de/9", 1),
    ("http://banner-ads.example.com/es/77", 1),
    ("http://pixel-track.example.net/en/300", 1),
    ("https://click-ads.example.com/de/51", 1),
    ("https://www.example.net/de/300", 0),
    ("http://m.example.com/es/77", 0),
    ("https://blog.example.org/fr/41.html", 0),
    ("http://m.books.example.net/en/9/", 0),
    ("https://garden.example.com/de/51", 0),
    ("http://theatre.example.org/en/12", 0),
]
BITS, SIZES = 16, (3, 4, 5)


def host_and_path(url: str):
    """Columns of the host, A-Z lowered, and of the path."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    found = lambda pattern, group: F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(rest, pattern, group)).otherwise("")
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(found(r"\A[^/?#]*", 0), upper, upper.lower()), found(r"\A[^/?#]*([^?#]*)", 1)


class Rules:
    """Verdicts by host and path."""

    def __init__(self, rules):
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, host, path in sorted(rules, reverse=True):  # of equal rules the first stays
            self.by_host.setdefault(host, {})[path] = verdict
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits the host, or a domain that it is part of, and the path's start."""
        best, at = None, 0
        while at >= 0:
            domain = host[at:]
            for n in self.lengths.get(domain, ()):
                verdict = self.by_host[domain].get(path[:n]) if n <= len(path) else None
                if verdict is not None:
                    key = (-len(domain) - n, domain, path[:n])
                    best = min(best, (key, verdict)) if best else (key, verdict)
                    break
            at = host.find(".", at) + 1 or -1
        return (best[0][1] + best[0][2], best[1]) if best else (None, None)


def _grams(points: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of the distinct n-grams, with a mark at either end; kind keeps hosts and paths apart."""
    if not len(points):
        return np.zeros(0, np.int64)
    marked = np.concatenate([[1], points, [2]]).astype(np.uint64)
    out = []
    for size in SIZES:
        h = np.full(max(len(marked) - size + 1, 0), kind * 31 + size, np.uint64)
        for j in range(size):
            h = (h ^ marked[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64)


def _rows(column: pa.Array) -> list[np.ndarray]:
    data, offsets = column_bytes(column)
    points, first = code_points(data, offsets)
    return [points[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def features(hosts: pa.Array, paths: pa.Array) -> list[np.ndarray]:
    return [np.concatenate([_grams(h, 0), _grams(p, 1)]) for h, p in zip(_rows(hosts), _rows(paths), strict=True)]


def _parts(url: str) -> tuple[str, str]:
    found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return found[1].lower(), found[2]


def fit(labelled=LABELLED, steps: int = 1500, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept, by full gradients; features of a row share a norm of one."""
    hosts, paths = zip(*[_parts(u) for u, _ in labelled], strict=True)
    x = features(pa.array(hosts), pa.array(paths))
    y = np.array([v for _, v in labelled], float)
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(r) for r in x])
    value = 1 / np.sqrt(np.array([len(r) for r in x]))[owner]
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(owner, value * w[flat], len(x)) + b)))
        w -= 4.0 * (np.bincount(flat, value * (p - y)[owner], 1 << BITS) / len(x) + decay * w)
        b -= (p - y).mean()
    return w.astype(np.float32), float(b)


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block) of each page."""
    sent = pages.sparkSession.sparkContext.broadcast((fit(labelled), Rules(rules)))  # as large as the driver's lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), known = sent.value
        for batch in batches:
            found = [b + w[x].sum() / np.sqrt(len(x)) if len(x) else -np.inf for x in features(batch["host"], batch["path"])]
            score = 1 / (1 + np.exp(-np.array(found, float)))
            ruled = [known.find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            verdicts = [v or ("block" if x >= 0.5 else "allow") for (_, v), x in zip(ruled, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in ruled], pa.string()), pa.array(verdicts, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    host, path = host_and_path("url")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(tidy(run), f"page_id {kind}, host string, path string, rule string, verdict string, score double")

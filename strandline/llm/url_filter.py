"""URL filter: host and path rules, and a logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled URL table (a parameter; LABELLED by default) on the driver. Hosts
and paths are cut, and rules matched, by Column expressions; the model scores Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship

# A small labelled table: URLs of kinds that a text corpus wants, and of kinds that it doesn't.
ALLOWED = """
https://www.riverside-gazette.com/en/2021/05/council-vote.html
https://blog.maplewood.org/en/214
http://m.harbourtimes.net/fr/88?page=2&ref=x
https://docs.openlibrary-project.org/guide/install
https://www.university-press.edu/catalogue/history
https://stenor.example.net/en/91.html
http://www.hillandale.example.com/de/407/
https://recipes.kitchen-garden.com/en/soups/leek
https://ontherin.example.org/fr/551#top
https://news.eastvalley.net/en/673?utm_source=feed
https://museum.northshire.org/es/exhibits/12
http://forum.woodworkers.net/en/thread/5561
https://www.thandon.example.com/en/300
https://blog.inerth.example.net/de/18.html
https://science.daily-review.org/en/physics/882
https://m.lytion.example.org/en/777
https://travel-notes.net/es/madrid/44
https://wiki.gardeners.org/en/Roses
http://www.erethand.example.com/fr/62/
https://city-library.org/en/opening-hours
https://weather.coastwatch.net/en/today
https://poetry.smallpress.org/en/autumn/9
https://theanhed.example.net/en/505?page=2&ref=x
https://www.oredish.example.org/es/140#top
https://history.villagearchive.org/en/1890
http://blog.shatonre.example.com/en/23/
https://maths.lecturenotes.edu/en/algebra/3
https://thorstion.example.com/de/912?utm_source=feed
https://www.ndtherea.example.net/en/66.html
https://m.hathering.example.org/fr/410
https://www.withern.example.com/en/41.html
http://blog.northend.example.com/en/290?utm_source=feed
https://thornton.example.net/en/118/
https://m.inthesea.example.com/en/66#top
https://bethany.example.org/de/21
http://www.athletic.example.net/en/704.html
https://ninth-street.example.com/en/530?page=2&ref=x
https://blog.tinhouse.example.com/en/345
https://www.shorestone.example.net/de/97?page=2&ref=x
http://hearth.example.com/en/12.html
https://m.strength.example.net/es/808/
https://ration.example.com/en/450
https://blog.nobleth.example.net/en/3?utm_source=feed
http://northing.example.com/en/881#top
https://www.thirteen.example.net/fr/222
https://mathnt.example.com/en/61/
http://thimble.example.net/en/17?page=2&ref=x
https://www.otherthing.example.com/en/930.html
https://station.example.com/es/73#top
https://blog.threshold.example.net/en/540/
https://breath.example.com/en/728?utm_source=feed
http://m.anthem.example.net/en/109
https://www.tenth-hour.example.com/de/88/
https://lantern.example.net/en/605?page=2&ref=x
"""
BLOCKED = """
https://casino-royal-win.com/en/bonus
http://www.free-casino.net/en/slots/77
https://win-casino-bets.example.com/en/12
https://best-bets.example.net/en/90?ref=x
http://free-bets-now.com/de/301
https://www.cheap-pills-shop.com/en/order/5
http://cheap-meds.example.org/fr/19
https://pills-online.example.net/en/808.html
https://adult-video.example.com/en/44
http://www.adult-cams.net/en/live
https://xxx-adult.example.org/es/71
https://ads-server.example.com/en/click?utm_source=feed
http://track-ads.net/en/pixel/9
https://ads-tracker.example.net/de/400
https://spam-links.example.com/en/1
http://link-farm.example.org/en/22/
https://www.spam-seo-farm.net/en/buy
https://farm-spam.example.net/fr/93
https://loan-fast-cash.com/en/apply
http://replica-watches-cheap.net/en/sale
https://free-download-crack.com/en/keygen
https://win-prize-now.example.org/en/claim
http://poker-bets-casino.net/es/poker
https://porn-free.example.com/en/5
https://viagra-pills.net/en/7
https://clicks-ads-track.com/en/3
https://adult-x-dating.net/en/2
https://casino-spins.example.org/de/18#top
https://cheap-replica-pills.example.com/en/450?page=2&ref=x
https://crypto-win-free.net/en/777
https://big-casino.example.net/en/45
http://www.casino-online.example.com/fr/12
https://win-big.example.net/en/301.html
https://blog.win-money.example.com/en/9
https://adult-chat.example.net/en/83
https://m.pills-cheap.example.net/de/5
http://ads-popup.example.org/en/61
https://track-click.example.com/en/270/
"""
LABELLED = [(u, 0) for u in ALLOWED.split()] + [(u, 1) for u in BLOCKED.split()]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DIMENSION = 1 << 18


PATH_SHARE = 0.3


def grams(host: str, path: str, sizes: tuple[int, ...] = (3, 4, 5), dimension: int = DIMENSION) -> tuple[list[int], list[float]]:
    """Hashed n-grams of ^host$ and of the path, kept apart by a prefix, each once; and their values.

    The host's values have unit length together, the path's a length of PATH_SHARE.
    """
    at: list[int] = []
    values: list[float] = []
    for mark, text, scale in (("h", f"^{host}$" if host else "", 1.0), ("p", path, PATH_SHARE)):
        own = {zlib.crc32(f"{mark}{text[k : k + n]}".encode()) % dimension for n in sizes for k in range(len(text) - n + 1)}
        at += sorted(own)
        values += [scale / max(1, len(own)) ** 0.5] * len(own)
    return at, values


def cut(url: str | None) -> tuple[str, str]:
    """Host and path as the Column expressions give them."""
    rest = (url or "").partition("://")[2]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


@dataclass
class UrlModel:
    """Logistic weights over hashed n-grams."""

    weights: np.ndarray
    bias: float

    def probability(self, host: str, path: str) -> float:
        at, values = grams(host, path, dimension=len(self.weights))
        z = self.bias + (float(self.weights[at] @ np.array(values)) if at else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(labelled: list[tuple[str, int]] = LABELLED, ridge: float = 0.004, steps: int = 1500, rate: float = 8.0) -> UrlModel:
    """Full-batch gradient steps on a small labelled table of (url, 1 to block)."""
    rows = [grams(*cut(url)) for url, _ in labelled]
    used = np.array(sorted({g for at, _ in rows for g in at}), dtype=np.int64)
    x = np.zeros((len(rows), len(used)))
    for i, (at, values) in enumerate(rows):
        np.add.at(x[i], np.searchsorted(used, np.array(at, dtype=np.int64)), values)
    y = np.array([b for _, b in labelled], dtype=float)
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge / len(y) * w)
        bias -= rate * float((p - y).mean())
    weights = np.zeros(DIMENSION, dtype=np.float32)
    weights[used] = w
    return UrlModel(weights, bias)


def host(url: str = "url") -> Column:
    after = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    return F.expr(f"translate(regexp_extract(coalesce({after}, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def path(url: str = "url") -> Column:
    after = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    return F.expr(f"regexp_extract(coalesce({after}, ''), '^[^/?#]*([^?#]*)', 1)")


def matched(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path in one string, and its verdict; null where none fits. Of equals the first wins."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(order):
        say, h, p = rules[k]
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages.

    The longest rule that fits decides; without one, a score (probability of a URL to block) of at least threshold
    blocks. A null url, or one without ://, has an empty host and path, which no rule fits and the model scores by
    its bias. Repeated rows and null ids are kept; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    held = ship(pages.sparkSession).sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = held.value, {}
        for b in batches:
            out = []
            for key in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = m.probability(*key)
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=["page_id", "host", "path", "score"])

    cut_up = pages.select("page_id", host().alias("host"), path().alias("path"))
    scored = cut_up.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = matched(rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")

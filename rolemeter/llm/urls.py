"""URL filter: allow and block rules, and a logistic model of character n-grams beyond them.

The model hashes the 3- to 5-grams of host and path (kept apart by a prefix) into a fixed number of
weights. It is trained once from a small labelled table, with full-batch gradient steps from zero,
so every run gives the same weights. Scoring then is a projection: nothing moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import fresh, kind, table

#: The rules of the contract, fixed values: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)

#: The labelled table; host and path of pages one would block, and of pages one would keep.
BLOCKED = """
casino-royal.example/play casino-bonus.example/slots win-casino.example/en/1 best-casino-games.example/poker online-casino.example/fr/2
free-bets-now.example/odds sports-bets.example/live bets-online.example/en/3 free-spins.example/jackpot poker-win.example/lobby
jackpot-winner.example/claim lottery-win.example/ticket cheap-meds.example/order cheap-viagra.example/buy pills-online.example/rx
buy-pills.example/discount cheap-watches.example/replica cheap-pharma.example/en/4 diet-pills.example/es/5 replica-bags.example/sale
adult-video.example/watch adult-cams.example/live adult-dating.example/join xxx-tube.example/free sexy-chat.example/room
porn-hd.example/clip hot-singles.example/meet escort-list.example/city link-farm.example/seo spam-links.example/page
seo-spam.example/backlinks content-farm.example/article spam-blog.example/en/6 farm-of-links.example/de/7 ads-server.example/click
ad-tracker.example/pixel ads-tracking.example/beacon click-track.example/redirect tracking-pixel.example/t ads-network.example/en/8
popup-ads.example/banner malware-drop.example/exe free-download-crack.example/keygen warez-site.example/serial crack-soft.example/patch
payday-loans.example/apply fast-cash.example/loan get-rich.example/quick crypto-double.example/send miracle-cure.example/trial
"""
KEPT = """
www.library.example/catalog museum.example/exhibits university.example/courses school.example/timetable news.example/en/1
daily-paper.example/politics weather.example/forecast blog.garden.example/roses kitchen.example/recipes travel-notes.example/fr/2
science.example/physics journal.example/issue/3 archive.example/texts m.transport.example/trains city-hall.example/permits
hospital.example/visit docs.software.example/manual wiki.example/article forum.cycling.example/thread music.example/concerts
theatre.example/program blog.history.example/rome maps.example/hiking www.bank.example/help shop.books.example/novels
parks.example/trails open-data.example/sets research.example/papers/4 photo.example/gallery m.sport.example/results
blog.thornton.example/en/5 thames.example/river therapy.example/advice thinkers.example/essays thunder.example/storms
station.example/radio nation.example/es/6 edition.example/de/7 notion.example/notes fiction.example/stories
the-times.example/world other.example/en/8 there.example/home blog.lighthouse.example/sea athletics.example/clubs
gardeners.example/soil m.theory.example/math carpentry.example/joints birds.example/song planets.example/orbit
"""
MARKS = ("", "www.", "m.", "blog.")
BITS = 16


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, label) with 1 for block; each host also under common prefixes, so these decide nothing."""
    out = []
    for urls, label in ((BLOCKED, 1), (KEPT, 0)):
        for entry in urls.split():
            host, _, path = entry.partition("/")
            out += [(mark + host, "/" + path, label) for mark in MARKS]
    return out


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams, each once. Digits are one sign, as they name pages and not kinds of pages."""
    found = set()
    for part, value in (("h", host), ("p", path)):
        value = "^" + "".join("0" if c.isdigit() else c for c in value.lower()) + "$"
        for n in (3, 4, 5):
            for i in range(len(value) - n + 1):
                found.add(zlib.crc32(f"{part}{value[i : i + n]}".encode()) & ((1 << bits) - 1))
    return np.array(sorted(found), dtype=np.int64)


def train(rows: list[tuple[str, str, int]], bits: int = BITS, steps: int = 400, rate: float = 6.0, decay: float = 3e-4, prior: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model.

    The bias is that of the share of pages to block, `prior`, and not learned: the table has as many
    of either kind, and an address of which nothing is known should get the prior. An empty table
    gives zero weights.
    """
    weights, bias = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    if not rows:
        return weights, bias
    vectors = [features(host, path, bits) for host, path, _ in rows]
    labels = np.array([label for *_, label in rows], dtype=np.float64)
    row = np.repeat(np.arange(len(rows)), [len(v) for v in vectors])
    place = np.concatenate(vectors)
    value = np.repeat([1 / np.sqrt(max(len(v), 1)) for v in vectors], [len(v) for v in vectors])
    for _ in range(steps):
        raw = np.bincount(row, weights[place] * value, minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-raw)) - labels) / len(rows)
        weights -= rate * (np.bincount(place, error[row] * value, minlength=len(weights)) + decay * weights)
    return weights, bias


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(after, r"(?s)^([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        same = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fit = F.when(same, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def url_filter(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, examples=None, cut: float = 0.5) -> DataFrame:
    """Kept columns, `host`, `path`, `rule`, `verdict` and the model's `score` (0 to 1, higher: block).

    Where no rule fits, a score of `cut` or more blocks. A null url or one without `://` has an
    empty host and path, which the model scores as any other. Each of repeated rows is judged.
    """
    weights, bias = train(labelled() if examples is None else examples)
    host, path, fit, score, rule, verdict = fresh(keep, "host", "path", "fit", "score", "rule", "verdict")
    h, p = parts(F.col(url))
    rows = pages.select(*keep, h.alias(host), p.alias(path))
    width = len(keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for one, other in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                found = features(one, other)
                raw = weights[found].sum() / np.sqrt(max(len(found), 1)) + bias
                scores.append(float(1 / (1 + np.exp(-raw))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score])

    schema = ", ".join([*(f"`{c}` {kind(pages, c)}" for c in keep), f"`{host}` string", f"`{path}` string", f"`{score}` double"])
    scored = rows.mapInArrow(judge, schema).withColumn(fit, matched(F.col(host), F.col(path), rules))
    learned = F.when(F.col(score) >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *keep, host, path, F.col(fit)["rule"].alias(rule), F.coalesce(F.col(fit)["verdict"], learned).alias(verdict), F.round(score, 9).alias(score),
    )


def op10_urls(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))

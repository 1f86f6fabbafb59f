"""URL filter: host and path rules, and elsewhere logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the default policy; fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words of unwanted sites, by kind. Fixed values, made for this module.
UNWANTED = (
    "casino casinos poker slots slot-machine jackpot roulette blackjack betting bets bet-now sportsbet gamble gambling lottery lotto "
    "porn porno porntube xxx xxx-cams sex sexy sexcam sexchat adult adult-dating nude nudes escort escorts erotic hot-singles hookup "
    "viagra cialis pills cheap-pills diet-pills pharma-deal steroid steroids meds-online weight-loss-now "
    "payday payday-loan quick-loan instant-loans credit-repair get-rich rich-fast make-money earn-cash easy-money double-bitcoin crypto-profit forex-win "
    "prize prizes winner win-now you-win free-win giveaway free-gift free-iphone sweepstake "
    "spam spammer spambot spam-link link-farm content-farm click-farm phish phishing scam scams malware virus-alert hacked "
    "keygen crack cracked warez torrent torrents pirate-movies serial-key replica replicas fake-watch knockoff "
    "ads adserver ad-click ads-track click-track popads popunder banner-ads affiliate-link backlinks seo-boost traffic-bot"
).split()
#: Words of wanted sites. Fixed values, made for this module.
WANTED = (
    "library museum news blog-post garden science university forum archive radio bakery history travel school weather journal orchestra software "
    "zoo books maps farm kitchen parliament code theatre river mountain recipe bicycle music painting physics chemistry biology language grammar "
    "city village council court harbour railway airport hospital clinic doctor nurse teacher student research paper lecture seminar course "
    "football tennis chess swimming hiking camping sailing photo camera film cinema poetry novel author editor publisher magazine market shop "
    "furniture carpenter plumber electrician builder architect design studio gallery craft pottery knitting wool cotton linen bread cheese "
    "coffee tea wine apple orchard forest bird fish horse dog cat animal plant flower seed water energy solar wind engine bridge road "
    "online click track adventure admin address saddle shadow essex sussex betty alphabet diabetes winter window twin pillow pillar spice spanish "
    "expert export slate sloth credit loan bank money insurance lotus adapter download free best top hot cash deal"
).split()
TOPS = ("com", "org", "net", "example", "info", "co.uk", "de", "fr", "es")
BEFORE = ("", "www.", "m.", "blog.", "", "shop.")
LANGUAGES = ("en", "de", "fr", "es")
SIZES = (3, 4, 5)
#: Chosen on held-out urls of the labelled table; the figures are in the README.
THRESHOLD = 0.35


def labelled() -> list[tuple[str, str, int, str]]:
    """The labelled table by rule: host, path, 1 for block, and the word that it was made from.

    Each word gives hosts of its own, joined with another word of its kind or with syllables, and paths of numbers, words and
    languages; half of the unwanted words' urls and all of the wanted ones' have plain paths.
    """
    pick = lambda what, *key: what[zlib.crc32(repr(key).encode()) % len(what)]
    syllables = ("the", "tion", "an", "er", "on", "sta", "mi", "lo", "ne", "ru", "th", "wha", "nd", "ka", "vel", "or")
    out = []
    for label, words in ((0, WANTED), (1, UNWANTED)):
        for w in words:
            for i in range(4):
                made = pick(syllables, w, i, 1) + pick(syllables, w, i, 2)
                host = (w, f"{w}-{pick(words, w, i, 3)}", f"{made}{w}" if label == 0 else f"{w}{pick(('24', '-x', '4u', '365'), w, i)}", f"{w}.{made}")[i]
                number = zlib.crc32(f"{w}{i}".encode()) % 9000 + 100
                plain = f"/{pick(LANGUAGES, w, i, 4)}/{number}" + pick(("", "/", ".html"), w, i, 5)
                path = plain if i % 2 else f"/{pick(words, w, i, 6)}/{pick(words, w, i, 7)}.html"
                out.append((f"{pick(BEFORE, w, i, 8)}{host}.{pick(TOPS, w, i, 9)}", path, label, w))
    for i in range(300):  # hosts that say nothing
        made = "".join(pick(syllables, i, k) for k in range(2 + i % 3))
        out.append((f"{pick(BEFORE, i, 8)}{made}.{pick(TOPS, i, 9)}", f"/{pick(LANGUAGES, i, 4)}/{i * 31 + 7}" + pick(("", "/", ".html"), i, 5), 0, made))
    return out


def grams(hosts: Sequence[str], paths: Sequence[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(url, index) of the distinct hashed character n-grams of all urls at once; host and path have their own."""
    found = []
    for mark, parts in ((1, hosts), (2, paths)):
        raw = [b"^" + x.encode("utf-8", "replace") + b"$" for x in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        letters, of = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.repeat(np.arange(len(raw)), size)
        value = np.full(len(letters), mark, np.uint64)
        for n in range(1, max(SIZES) + 1):
            kept = max(0, len(letters) - n + 1)
            value = value[:kept] * np.uint64(257) + letters[n - 1 :]
            if n in SIZES:
                inside = of[:kept] == of[n - 1 :]
                mixed = (value[inside] + np.uint64(n << 48)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
                found.append(of[:kept][inside] << bits | mixed.astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probabilities that the urls should be blocked."""
        at, index = grams(hosts, paths, int(len(self.weights)).bit_length() - 1)
        total = np.bincount(at, self.weights[index], len(hosts)) / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(hosts))))
        return 1 / (1 + np.exp(-(total + self.bias)))


def train(table: Sequence[tuple], bits: int = 16, steps: int = 400, rate: float = 2.0, decay: float = 2e-4) -> UrlModel:
    """Logistic regression of (host, path, label, ...) rows by full-batch gradient descent; deterministic."""
    at, index = grams([r[0] for r in table], [r[1] for r in table], bits)
    y = np.array([float(r[2]) for r in table])
    value = 1 / np.sqrt(np.bincount(at, minlength=len(y)))[at]
    weights, bias = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(at, weights[index] * value, len(y)) + bias)))
        err = (p - y) / len(y) * 8
        weights -= rate * (np.bincount(index, err[at] * value, len(weights)) + decay * weights)
        bias -= rate * err.sum() / 8
    return UrlModel(weights, float(bias))


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return train(labelled())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as columns; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int) -> Column:
    """Of the longest rule that fits: its text for field 0, its verdict for field 1; null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit((h + p, verdict)[field])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, table: Sequence[tuple] | None = None) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, p_block.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's path; the longest
    rule that fits decides. Elsewhere the verdict is the model's: block if p_block is at least ``threshold``; p_block is null
    where a rule decides. ``table`` has labelled rows (host, path, 1 for block) to train from, by default those of
    ``labelled``. Null urls and urls without ``://`` have an empty host and path and go by the model. Repeated rows are
    judged alike; other columns are ignored, whatever their names; an empty table gives an empty result. A url is scored as
    a whole, however long.
    """
    model = default_model() if table is None else train(tuple(table))

    @F.pandas_udf("double")
    def p_block(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out, asked = np.full(len(hosts), np.nan), hosts.notna().to_numpy()
            some = np.flatnonzero(asked)
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                out[part] = model.score(hosts.iloc[part].tolist(), paths.iloc[part].tolist())
            yield pd.Series(out)

    host, path = split_url(F.col(url_col).cast("string"))
    cut_up = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    judged = cut_up.select("id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules, 0).alias("rule"), longest_rule(F.col("host"), F.col("path"), rules, 1).alias("said"))
    asked = F.col("said").isNull()
    scored = judged.withColumn("p", p_block(F.when(asked, F.col("host")), F.when(asked, F.col("path"))))
    by_model = F.when(F.col("p") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(asked, by_model).otherwise(F.col("said")).alias("verdict"), F.when(asked, F.col("p")).alias("p_block"))

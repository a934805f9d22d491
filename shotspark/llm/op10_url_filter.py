"""URL filter: host and path rules, and a logistic regression for the rest.

The classifier reads hashed character trigrams of host and path.  It is
trained on the driver from a small labelled URL table (a parameter; the
default, some thousand URLs, is built from the rule below), its weights are
rounded to integers, and the verdict is an integer sum over the trigrams: the
same on every engine and in any order of addition.

A fifth of the table's hosts, by a checksum of the name, is held out of the
training and only measured; of the training hosts another fifth chooses the
weight decay.  Wanted URLs weigh more, as blocking one is the worse mistake.

Everything that touches the pages is a built-in SQL function: no Python UDF,
no shuffle, only the ``url`` column is read.

Defined cases: a null url, or one without ``://``, has empty host and path;
no rule fits an empty host, and the method judges by its bias alone.  A rule
fits its host and every subdomain when the path starts with the rule's path;
the longest rule (host and path together) wins.  Every input row is returned,
repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import LOWER, UPPER, position, positional, restore

# Fixed values of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

OWN = ["host", "path", "rule", "verdict", "score"]
BUCKETS = 8192
SCALE = 1_000_000
# Multipliers of the trigram hash: idx = (a*K0 + b*K1 + c*K2 + field) mod BUCKETS.
K0, K1, K2 = 7919, 104_729, 1_299_709
FIELDS = {"host": 17, "path": 2029}

# Words of the default training rule: a URL is unwanted when its host or path
# speaks of gambling, adult material, pills, pirated goods, loans or link farms.
UNWANTED = ["casino", "poker", "slots", "betting", "jackpot", "roulette", "blackjack", "bookmaker", "lottery", "porn", "xxx",
            "escort", "sexcam", "cams", "nude", "milf", "hotgirls", "girls", "viagra", "cialis", "pharma", "pills", "meds",
            "steroid", "replica", "warez", "torrent", "crack", "keygen", "serialz", "freemoney", "payday", "loans", "forex",
            "spam", "clickbait", "linkfarm", "backlinks", "doorway", "phish", "malware", "getrich", "weightloss"]
WANTED = ["news", "docs", "wiki", "science", "library", "museum", "school", "university", "weather", "recipes", "garden",
          "travel", "history", "health", "sports", "music", "forum", "research", "journal", "blog", "maps", "books",
          "astronomy", "gov", "archive", "times", "git", "code", "project", "world", "city", "art", "film", "theatre",
          "bank", "market", "shop", "photo", "water", "energy", "farm", "spa", "cameras", "medicine", "pharmacy",
          "girlscouts", "essex", "cracker", "slotted", "crackle", "campus", "medal", "pillow", "cinema", "poke"]
# Words that stand beside either kind, and beginnings, joints and ends of names.
BESIDE = ["best", "cheap", "free", "online", "top", "live", "hub", "zone", "world", "club", "site", "daily", "my", "the",
          "24", "365", "hot", "new", "big", "info", "center", "group", "land", "house", "win", "page"]
ONSETS = ["th", "tr", "st", "br", "cl", "sh", "m", "n", "r", "l", "d", "k", "b", "p", "g", "f", "v", "w", "h", "j", "t", "s", "c", ""]
NUCLEI = ["a", "e", "i", "o", "u", "ea", "io", "ou", "ai"]
ENDS = ["n", "r", "t", "ng", "l", "s", "nd", "ble", "tion", "ly", "th", "m", ""]
ZONES = ["com", "net", "org", "io", "info", "biz", "xyz", "example.com", "example.net", "example.org"]
SECTIONS = ["en", "de", "fr", "es", "2024", "2023", "about", "index.html", "article", "order", "join", "start", "readme",
            "page", "img", "user", "tag", "search", "contact", "view"]


def default_urls(each: int = 4000, seed: int = 10) -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for unwanted); per ``each`` one part of URLs
    with an unwanted host, half a part with an unwanted path, and four parts of
    wanted ones, of which two have hosts of random syllables."""
    rng = np.random.default_rng(seed)
    one = lambda words: words[int(rng.integers(len(words)))]
    some = lambda share: rng.random() < share

    def name() -> str:
        return "".join(one(ONSETS) + one(NUCLEI) + one(ENDS) for _ in range(int(rng.integers(1, 4)))) + "x" * some(0.02)

    def host(words: list[str]) -> str:
        parts = [one(words)] + [one(BESIDE) if some(0.7) else name() for _ in range(int(rng.integers(0, 3)))]
        parts = [parts[k] for k in rng.permutation(len(parts))]
        return ("-" if some(0.5) else "").join(parts) + (str(rng.integers(100)) if some(0.1) else "")

    def path(words: list[str] = ()) -> str:
        parts = [one(SECTIONS) if some(0.6) else str(rng.integers(10_000)) if some(0.5) else one(WANTED)
                 for _ in range(int(rng.integers(0, 4)))]
        if words:
            parts.insert(int(rng.integers(len(parts) + 1)), host(words))
        return "/" + "/".join(parts) + one(["", "/", ".html", ""]) * bool(parts)

    def url(h: str, p: str) -> str:
        return f"{one(['http', 'https'])}://{one(['', '', 'www.', 'm.', 'blog.'])}{h}.{one(ZONES)}{p}"

    out = [(url(host(UNWANTED), path()), 1) for _ in range(each)]
    out += [(url(name() + name(), path(UNWANTED)), 1) for _ in range(each // 2)]
    out += [(url(host(WANTED), path()), 0) for _ in range(each)] + [(url(name(), path(WANTED)), 0) for _ in range(each)]
    out += [(url(name(), path()), 0) for _ in range(2 * each)]
    return out


def held_out_host(url: str) -> bool:
    """Whether the URL's host is kept from the training of the default model."""
    return zlib.crc32(split_url(url)[0].encode()) % 5 == 0


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as ``with_host_path`` has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host.translate(str.maketrans(UPPER, LOWER)), tail[:cut]


def _grams(host: str, path: str) -> list[int]:
    out = []
    for field, s in (("host", host), ("path", path)):
        c = [ord(x) for x in f"^{s}$"]
        out += [(c[k] * K0 + c[k + 1] * K1 + c[k + 2] * K2 + FIELDS[field]) % BUCKETS for k in range(len(c) - 2)]
    return out


def train(urls: list[tuple[str, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4, wanted: float = 3.0
          ) -> tuple[int, list[int]]:
    """Logistic regression on trigram counts of length one, by full-batch
    steps scaled by the sums of squared gradients; a wanted URL weighs
    ``wanted`` times.  Returns the integer weight that each trigram has in
    common (the bias) and those of the buckets."""
    grams = [_grams(*split_url(url)) for url, _ in urls]
    row = np.repeat(np.arange(len(urls)), [len(g) for g in grams])
    col = np.concatenate([np.array(g, np.int64) for g in grams]) if len(row) else row
    norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(urls)), 1.0))
    y = np.array([label for _, label in urls], float)
    weight = np.where(y > 0, 1.0, wanted)
    weight /= weight.sum()
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, w[col] + w[BUCKETS], len(urls)) / norm
        e = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y) / norm
        g = np.append(np.bincount(col, e[row], BUCKETS), e[row].sum()) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return int(round(w[BUCKETS] * SCALE)), [int(round(v * SCALE)) for v in w[:BUCKETS]]


def scores(urls: list[str], model) -> np.ndarray:
    """The method's score of each URL, in plain integers."""
    bias, weights = model
    return np.array([sum(bias + weights[g] for g in _grams(*split_url(u))) for u in urls])


def fit(urls: list[tuple[str, int]], decays=(1e-8, 1e-7, 1e-6, 1e-5), wanted: float = 3.0):
    """Train with the decay that makes the least weighted mistakes on a fifth of
    the hosts; then on all of ``urls``."""
    kept = np.array([zlib.crc32(split_url(u)[0].encode()[::-1]) % 5 > 0 for u, _ in urls])
    rest = [r for r, k in zip(urls, kept) if not k]
    y = np.array([label for _, label in rest])

    def mistakes(decay: float) -> float:
        blocked = scores([u for u, _ in rest], train([r for r, k in zip(urls, kept) if k], decay=decay, wanted=wanted)) > 0
        return (wanted * (blocked & (y == 0)) + (~blocked & (y == 1))).sum()

    return train(urls, decay=min(decays, key=mistakes) if len(rest) else decays[0], wanted=wanted)


@lru_cache(maxsize=1)
def default_model() -> tuple[int, tuple[int, ...]]:
    b, w = fit([r for r in default_urls() if not held_out_host(r[0])])
    return b, tuple(w)


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) ELSE '' END")
    return (df.withColumn("_rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
            .drop("_rest"))


def _sum_weights(codes: str, field: int, weights: str) -> Column:
    """Sum of the weights of all trigrams of an array of character codes."""
    n = f"greatest(size({codes}) - 2, 0)"
    return F.expr(f"""aggregate(slice({codes}, 1, {n}),
        named_struct('i', 0, 's', cast(0 as bigint)),
        (acc, c) -> named_struct('i', acc.i + 1, 's', acc.s + {weights}[cast(
            pmod(cast(c as bigint) * {K0} + {codes}[acc.i + 1] * cast({K1} as bigint)
                 + {codes}[acc.i + 2] * cast({K2} as bigint) + {field}, {BUCKETS}) as int)]),
        acc -> acc.s)""")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, model=None) -> DataFrame:
    """Every input row with host, path, rule, verdict and score (above 0:
    the method would block)."""
    bias, weights = model or default_model()
    p, names = positional(pages)
    out = with_host_path(p, position(names, url))
    fits = []
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        on = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        fits.append((on, host + path, verdict))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for on, name, verdict in reversed(fits):
        rule, ruled = F.when(on, F.lit(name)).otherwise(rule), F.when(on, F.lit(verdict)).otherwise(ruled)
    table = F.expr(f"array({','.join(f'{int(w)}L' for w in weights)})")
    codes = {f: F.expr(f"transform(split(concat('^', {f}, '$'), ''), x -> ascii(x))") for f in FIELDS}
    out = out.withColumns({"rule": rule, "_ruled": ruled, "_w": table, **{f"_c_{f}": c for f, c in codes.items()}})
    grams = F.size("_c_host") + F.size("_c_path") - 4
    total = sum((_sum_weights(f"_c_{f}", k, "_w") for f, k in FIELDS.items()), F.lit(int(bias)).cast("long") * grams)
    out = out.withColumn("score", total)
    out = out.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") > 0, "block").otherwise("allow")))
    return restore(out, names, OWN)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def sql() -> str:
    """The same in DuckDB SQL, with the trained integer weights as a list."""
    bias, weights = default_model()

    def total(field: str, k: int) -> str:
        c = f"c_{field}"
        return (f"coalesce(list_sum(list_transform(range(1, len({c}) - 1), lambda i: w[({c}[i] * {K0}::BIGINT + "
                f"{c}[i + 1] * {K1}::BIGINT + {c}[i + 2] * {K2}::BIGINT + {k}) % {BUCKETS} + 1])), 0)")

    def rule_cases(what) -> str:
        order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
                                  f"THEN '{what(v, h, p)}'" for v, h, p in order) + " END"

    return f"""
WITH m AS (SELECT [{','.join(map(str, weights))}]::BIGINT[] AS w),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, list_transform(string_split('^' || host || '$', ''), lambda x: unicode(x)) AS c_host,
             list_transform(string_split('^' || path || '$', ''), lambda x: unicode(x)) AS c_path,
             {rule_cases(lambda v, h, p: h + p)} AS rule, {rule_cases(lambda v, h, p: v)} AS ruled FROM b),
d AS (SELECT *, CAST({bias} * (len(c_host) + len(c_path) - 4) + {total('host', FIELDS['host'])}
             + {total('path', FIELDS['path'])} AS BIGINT) AS score FROM c, m)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score
FROM d
"""

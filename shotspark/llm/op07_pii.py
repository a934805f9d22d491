"""Personal data: high-recall candidate generators, a boosted-tree filter.

* *Generators* are regular expressions that propose spans with their format
  and context: the contract's four kinds; mail addresses in words, phone numbers
  without country code or in groups after a 0, card numbers with dots, IPv6
  addresses; and two kinds of their own, ``id`` (account numbers in IBAN form,
  3-2-4 numbers) and ``secret`` (keys and tokens by their known beginnings or after
  a word such as password).  Proposals may overlap.
* *Base spans* are the proposals of the four kinds that pass the contract's
  checks (octets, Luhn, digit counts); they always stay, and those that fail go.
* *Boosted trees* judge the proposals of the other generators by features of format (digits,
  length, separators, checksum, octets) and context (what touches the span,
  words before it).  They are fitted on the driver on a small labelled table of
  sentences (a parameter; the default is made by the rule below), whose
  features come from the same SQL expressions.  A threshold is calibrated on
  sentences kept out of the fit, for a precision of at least ``precision``.
* *Main path.* Built-in functions only: no Python on the executors, no
  shuffle.  Patterns are written so that no text makes them run in square time
  (possessive runs, guards at the start); offsets are prefix sums, in blocks.

Defined cases: a null or empty text has no spans; positions are code points,
end exclusive; repeated rows each get a result; an empty table gives an empty
result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import documents, position, positional, restore

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = KINDS + ["id", "secret"]
OWN = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]

# Equal to the contract's patterns, but linear in time: a run of local-part
# characters is tried from its first one only (or from the end of the match
# before), and runs are never given back, which no match needs.
_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"  # single digits fail the digit count
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT, _DOT = r"(?:\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20|\x20AT\x20)", r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20|\x20DOT\x20)"
_SPELLED = rf"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
_LOCAL = r"(?<![0-9A-Za-z+.()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
_GROUPED = (r"(?<![0-9A-Za-z+.()/:-])(?!\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-]))"
            r"\(?0[0-9]{1,5}\)?(?:[\x20./-][0-9]{2,8}){1,5}(?![0-9A-Za-z-])")
_DOTTED = r"(?<![0-9A-Za-z.])[0-9]{4}(?:\.[0-9]{4}){2}\.[0-9]{1,7}(?![0-9A-Za-z])"
_IPV6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|:)(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])"
_ACCOUNT = (r"(?<![0-9A-Za-z-])(?:[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})"
            r"(?![0-9A-Za-z-])")
# Beginnings of public key and token formats.
_SECRET = (r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_(?:live|test)_[0-9A-Za-z]{16,64}"
           r"|xox[abprs]-[0-9A-Za-z-]{10,80}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)"
           r"|(?<=(?i:password|passwd|secret|token|apikey|api_key|api-key)(?:[:=]|:\x20|\x20=\x20))[^\x00-\x20,;\"']{6,128}")

#: name, kind of its spans, pattern, quick test of a text
GENERATORS = [
    ("email", "email", _EMAIL, "contains({t}, '@')"),
    ("ip", "ip", _IP, r"{t} rlike '[0-9]\\.[0-9]'"),
    ("card", "card", _CARD, "{t} rlike '[0-9]'"),
    ("phone", "phone", _PHONE, "contains({t}, '+')"),
    ("spelled", "email", _SPELLED, "(contains({t}, '(at)') or contains({t}, '[at]') or contains({t}, ' dot ') or contains({t}, ' DOT '))"),
    ("local", "phone", f"{_PHONE}|{_LOCAL}", r"{t} rlike '[0-9]{{3}}[ .-][0-9]{{4}}'"),
    ("grouped", "phone", f"{_PHONE}|{_GROUPED}", r"{t} rlike '0[0-9]{{1,5}}[)]?[ ./-][0-9]{{2}}'"),
    ("dotted", "card", _DOTTED, r"{t} rlike '[0-9]{{4}}[.][0-9]{{4}}[.]'"),
    ("ipv6", "ip", _IPV6, r"{t} rlike ':[0-9A-Fa-f]{{1,4}}:'"),
    ("account", "id", _ACCOUNT, r"{t} rlike '[A-Z]{{2}}[0-9]{{2}}|[0-9]{{3}}-[0-9]{{2}}-[0-9]'"),
    ("secret", "secret", _SECRET, r"{t} rlike 'AKIA|ASIA|gh[pousr]_|sk_|xox|AIza|eyJ|(?i)passw|secret|token|api.?key'"),
]
_BLOCK = 1000  # proposals whose offsets are summed up at a time


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of at most 19 digits passes the Luhn check."""
    return f"""(aggregate(sequence(1, greatest(length({digits}), 1)), 0, (s, i) -> s + CASE
        WHEN length({digits}) < i THEN 1
        WHEN i % 2 = 1 THEN int(substr({digits}, -i, 1))
        ELSE int(substr({digits}, -i, 1)) * 2 - if(int(substr({digits}, -i, 1)) > 4, 9, 0) END) % 10 = 0)"""


def _octets(x: str) -> str:
    """All parts at most 255, leading zeros aside."""
    return (f"forall(split({x}, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 4"
            f" and coalesce(try_cast(trim(LEADING '0' FROM p) as int), 0) <= 255)")


def _mod97(x: str) -> str:
    """Whether the checksum of an account number in IBAN form holds."""
    plain = f"replace({x}, ' ', '')"
    return f"""(aggregate(split(concat(substr({plain}, 5), left({plain}, 4)), ''), 0,
        (s, c) -> if(c between '0' and '9', s * 10 + ascii(c) - 48, s * 100 + ascii(c) - 55) % 97) = 1)"""


_ACCOUNTS = [g[0] for g in GENERATORS].index("account")

#: Whether a proposal x passes the contract's checks, by generator.
_PASSES = {
    "email": "true",
    "ip": _octets("x.match"),
    "card": f"length({_digits('x.match')}) between 13 and 19 and {_luhn(_digits('x.match'))}",
    "phone": f"length({_digits('x.match')}) between 9 and 15",
}  # the others never are base spans

#: Context words of the features.
_CONTACT = "account|iban|ssn|social|password|secret|key|gateway|phone|tel|call|fax|mobile|ring|mail|contact|write|reach|card|visa|pay|host|server|address"
_RECORD = "version|order|invoice|isbn|build|ref|page|section|serial|token|part|model|chapter|score"

#: Features of a proposal x, as SQL; integers.
FEATURES = [
    ("generator", "x.generator"),
    ("digits", f"length({_digits('x.match')})"),
    ("length", "char_length(x.match)"),
    ("letters", "length(regexp_replace(x.match, '[^A-Za-z]', ''))"),
    ("colons", "length(regexp_replace(x.match, '[^:]', ''))"),
    ("words", "length(regexp_replace(x.match, '[^ ]', ''))"),
    ("mod97", f"if(x.generator = {_ACCOUNTS} and x.match rlike '^[A-Z]', int({_mod97('x.match')}), 0)"),
    ("separators", "length(regexp_replace(x.match, '[^ .-]', ''))"),
    ("brackets", "length(regexp_replace(x.match, '[^()]', ''))"),
    ("luhn", f"if(length({_digits('x.match')}) between 13 and 19, int({_luhn(_digits('x.match'))}), 0)"),
    ("octets", f"if(x.generator = 1, int({_octets('x.match')}), 0)"),
    ("joined_before", "int(x.before rlike '[A-Za-z0-9_=/]$')"),
    ("joined_after", "int(x.after rlike '^[A-Za-z0-9_=/]')"),
    ("contact", f"int(lower(x.before) rlike '({_CONTACT})[^.]*$')"),
    ("record", f"int(lower(x.before) rlike '({_RECORD})[^.]*$')"),
]


def propose(df: DataFrame, text: str) -> DataFrame:
    """Adds _x_<generator>: the proposals with match, place and context."""
    for code, (name, _, pattern, quick) in enumerate(GENERATORS):
        hit = F.expr(quick.format(t=text))
        none = F.array().cast("array<string>")
        df = df.withColumns({
            "_m": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_g": F.when(hit, F.split(F.col(text), pattern, -1)).otherwise(none)})
        # Lengths of gap and match, and their sums before each block of proposals.
        df = df.withColumn("_l", F.expr("transform(_m, (m, i) -> bigint(char_length(_g[i]) + char_length(m)))"))
        df = df.withColumn("_b", F.expr(f"""transform(sequence(0, greatest(size(_l) - 1, 0) div {_BLOCK}),
            b -> slice(_l, b * {_BLOCK} + 1, {_BLOCK}))"""))
        df = df.withColumn("_s", F.expr("""aggregate(_b, array(0L),
            (a, b) -> concat(a, array(element_at(a, -1) + aggregate(b, 0L, (s, l) -> s + l))))"""))
        df = df.withColumn("_o", F.expr("""flatten(transform(_b, (b, k) -> slice(
            aggregate(b, array(_s[k]), (a, l) -> concat(a, array(element_at(a, -1) + l))), 1, size(b))))"""))
        df = df.withColumn(f"_x_{name}", F.expr(f"""transform(_m, (m, i) -> named_struct(
            'generator', {code}, 'start', _o[i] + char_length(_g[i]),
            'end', _o[i] + char_length(_g[i]) + char_length(m), 'match', m,
            'before', right(_g[i], 32), 'after', left(_g[i + 1], 4)))"""))
        df = df.drop("_m", "_g", "_l", "_b", "_s", "_o")
    # These patterns take international numbers only to step over them.
    return df.withColumns({c: F.expr(f"filter({c}, x -> not startswith(x.match, '+'))") for c in ("_x_local", "_x_grouped")})


# -- the model ---------------------------------------------------------------------

def default_sentences(seed: int = 5, each: int = 60) -> list[tuple[str, str]]:
    """The small labelled table: sentences, and the kind of personal data in
    them ('' for none).  Proposals of another kind are wrong."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9))))
    num = lambda n: "".join(rng.choice(list("0123456789"), n))

    def card(good: bool) -> str:
        body = "4" + num(14)
        s = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
        last = (10 - s % 10) % 10
        return body + str(last if good else (last + int(rng.integers(1, 10))) % 10)

    octet = lambda: str(rng.integers(0, 256))
    out = []
    for _ in range(each):
        at, dot = rng.choice(["(at)", "[at]", " (at) ", " [at] "]), rng.choice([".", " (dot) ", "[dot]"])
        sep = rng.choice(["-", ".", " "])
        local = f"{num(3)}{sep}{num(3)}{sep}{num(4)}" if rng.random() < 0.5 else f"({num(3)}) {num(3)}-{num(4)}"
        says = rng.choice(["call me on ", "phone: ", "my mobile is ", "tel ", "reach us at ", "fax "])
        about = rng.choice(["order ", "invoice no ", "part ", "serial ", "build ", "ref ", "model ", "score "])
        a, b = word(), word()
        out += [(f"{a} write to {word()}{at}{word()}{dot}com {b}", "email"),
                (f"{a} {says}{local} {b}", "phone"), (f"{a} {about}{local} {b}", ""), (f"{a} {word()} {local} {b}", ""),
                (f"{a} {about}={num(3)}-{num(3)}-{num(4)} {b}", ""),
                (f"{a} pay by card {card(True)} {b}", "card"), (f"{a} pay by card {card(False)} {b}", ""),
                (f"{a} {about}{num(int(rng.choice([8, 10, 12, 16])))} {b}", ""), (f"{a} {num(int(rng.integers(2, 9)))} {b}", ""),
                (f"{a} host {octet()}.{octet()}.{octet()}.{octet()} {b}", "ip"),
                (f"{a} version {octet()}.{num(4)}.{octet()}.{num(5)} {b}", ""),
                (f"{a} mail {word()}@{word()}.org {b}", "email"), (f"{a} call +1 ({num(3)}) {num(3)}-{num(4)} {b}", "phone"),
                (f"{a} +{num(1)} {num(2)} {num(2)} {b}", ""), (f"{a} meet {word()} (at) {num(1)}.{num(2)} {b}", "")]
        # Forms that the base patterns do not know, beside look-alikes.
        gap, full = rng.choice([" ", "-", "/"]), card(True)
        ring = rng.choice([f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)}{gap}{num(7)}", f"(0{num(3)}) {num(6)}",
                           f"0{num(3)}{gap}{num(3)} {num(4)}", f"00{num(2)} {num(2)} {num(4)} {num(4)}"])
        v6 = [f"{int(rng.integers(1, 65536)):x}" for _ in range(8)]
        v6 = ":".join(v6) if rng.random() < 0.5 else f"2001:{v6[0]}::{v6[1]}:{v6[2]}"
        code = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 36))
        mixed = "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN23456789"), 36))
        key = rng.choice([f"AKIA{code[:16]}", f"ghp_{mixed}", f"sk_live_{mixed[:24]}", f"xoxb-{num(11)}-{mixed[:20]}", f"AIza{mixed[:35]}"])
        country, body = rng.choice(["DE", "GB", "FR", "ES", "NL"]), num(int(rng.choice([16, 18, 20])))
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in country) + "00") % 97
        iban = f"{country}{check:02d}{body}"
        iban = " ".join(iban[k:k + 4] for k in range(0, len(iban), 4)) if rng.random() < 0.5 else iban
        broken = f"{country}{(check + int(rng.integers(1, 90))) % 97:02d}{body}"
        says2 = rng.choice(["call ", "ring ", "phone ", "tel. ", "mobile: ", "fax: ", "our number is ", "you reach me under "])
        out += [(f"{a} {says2}{ring} {b}", "phone"), (f"{a} {about}{ring} {b}", ""),
                (f"{a} write {word()} at {word()} dot {rng.choice(['com', 'org', 'net'])} {b}", "email"),
                (f"{a} look {word()} at {word()}.{b.capitalize()}", ""), (f"{a} at {word()} {b} dot {word()}", ""),
                (f"{a} card {full[:4]}.{full[4:8]}.{full[8:12]}.{full[12:]} {b}", "card"),
                (f"{a} {about}{num(4)}.{num(4)}.{num(4)}.{num(4)} {b}", ""),
                (f"{a} {rng.choice(['host', 'server', 'from', 'gateway', word()])} {v6} {b}", "ip"),
                (f"{a} {word()} {rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d} {b}", ""),
                (f"{a} ratio {rng.integers(1, 30)}:{rng.integers(1, 30)}:{rng.integers(1, 30)}:{rng.integers(1, 30)} {b}", ""),
                (f"{a} {rng.choice(['account', 'iban', 'pay to', word()])} {iban} {b}", "id"), (f"{a} {word()} {broken} {b}", ""),
                (f"{a} {rng.choice(['ssn', 'social security number', 'ssn:'])} {num(3)}-{num(2)}-{num(4)} {b}", "id"),
                (f"{a} {about}{num(3)}-{num(2)}-{num(4)} {b}", ""), (f"{a} {rng.choice(['key', 'use', word()])} {key} {b}", "secret"),
                (f"{a} {rng.choice(['password: ', 'secret=', 'api_key = ', 'token: '])}{mixed[:int(rng.integers(8, 30))]} {b}", "secret"),
                (f"{a} the password: {word() + word()[:4]} {b}", ""), (f"{a} token: {word()}ing {b}", "")]
    return out


def _fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int = 8):
    """A regression tree on gradients: nested (feature, threshold, left, right)
    or a leaf value."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * least:
        return value
    best = None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])[:-1]
        for t in cuts[::max(1, len(cuts) // 24)]:
            left = x[:, f] <= t
            if least <= left.sum() <= len(g) - least:
                gain = (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - base)
                if best is None or gain > best[0]:
                    best = gain, f, int(t)
    if best is None or best[0] < 1e-6:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _fit_tree(x[left], g[left], h[left], depth - 1, least),
            _fit_tree(x[~left], g[~left], h[~left], depth - 1, least))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _apply(a, x), _apply(b, x))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, precision: float = 0.99):
    """Gradient boosting with logistic loss; a random third calibrates the
    threshold.  Returns trees, bias and threshold (on the summed score)."""
    keep = np.random.default_rng(1).permutation(len(y)) % 3 > 0
    bias = float(np.log((y[keep].mean() + 1e-6) / (1 - y[keep].mean() + 1e-6)))
    z, trees = np.full(keep.sum(), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _fit_tree(x[keep], p - y[keep], p * (1 - p), depth)
        z = z + rate * _apply(tree, x[keep])
        trees.append(tree)
    rest = bias + rate * sum(_apply(t, x[~keep]) for t in trees)
    # The lowest threshold from which on the calibration rows are precise enough.
    order = np.argsort(-rest, kind="stable")
    exact = np.cumsum(y[~keep][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(exact >= precision)
    threshold = max(float(rest[order][good[-1]]), 0.0) if len(good) else float("inf")
    return trees, bias, rate, threshold


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"double({tree!r})"
    f, t, a, b = tree
    return f"if(y.f{f} <= {t}, {_tree_sql(a)}, {_tree_sql(b)})"


def train(spark: SparkSession, sentences: list[tuple[str, str]] | None = None, **how):
    """Fit on the labelled sentences; their features come from the SQL below."""
    rows = sentences or default_sentences()
    table = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "k int, t string, y string")
    every = F.concat(*[F.col(f"_x_{name}") for name, *_ in GENERATORS if name not in _PASSES])
    found = propose(table, "t").select("k", "y", F.explode(every).alias("x"))
    found = found.select("k", "y", *[F.expr(sql).cast("int").alias(f"f{k}") for k, (_, sql) in enumerate(FEATURES)])
    got = sorted(tuple(r) for r in found.collect())
    x = np.array([r[2:] for r in got], float)
    # A proposal is right if it is of the sentence's kind (feature 0 is its generator).
    y = np.array([GENERATORS[r[2]][1] == r[1] for r in got], float)
    return fit_trees(x, y, **how)


@lru_cache(maxsize=4)
def _default_model(application: str):
    return train(SparkSession.getActiveSession())


def default_model(spark: SparkSession):
    return _default_model(spark.sparkContext.applicationId)


# -- the operator --------------------------------------------------------------------

def find_pii(docs: DataFrame, text: str = "text", model=None) -> DataFrame:
    """Every input row with n_<kind> (all spans of the kind), base_spans and
    spans: arrays of struct(kind, start, end), by kind, then start.  ``spans`` may
    hold two more kinds, ``id`` and ``secret``."""
    trees, bias, rate, threshold = model or default_model(docs.sparkSession)
    p, names = positional(docs)
    p = p.withColumn("_t", F.coalesce(F.col(position(names, text)), F.lit("")))
    df = propose(p, "_t")
    score = f"{bias!r}D + {rate!r}D * ({' + '.join(_tree_sql(t) for t in trees)})"
    features = ", ".join(f"'f{k}', int({sql})" for k, (_, sql) in enumerate(FEATURES))
    # All proposals with the number of their kind; base ones stay, trees judge the rest.
    every = ", ".join(f"""transform(_x_{name}, x -> named_struct('x', x, 'k', {ALL_KINDS.index(kind)},
        'base', {_PASSES.get(name, 'false')}))""" for name, kind, _, _ in GENERATORS)
    df = df.withColumn("_j", F.expr(f"concat({every})"))
    place = "transform(filter({0}, j -> {1}), j -> named_struct('k', j.k, 'start', {2}start, 'end', {2}end))"
    df = df.withColumn("_base", F.expr(place.format("_j", "j.base", "j.x.")))
    df = df.withColumn("_f", F.expr(f"""transform(transform(filter(_j, j -> j.x.generator >= {len(_PASSES)}), j -> named_struct('k', j.k, 'x', j.x)),
        j -> transform(array(j.x), x -> named_struct('k', j.k, 'start', x.start, 'end', x.end, {features}))[0])"""))
    df = df.withColumn("_added", F.expr(place.format("_f", f"transform(array(j), y -> {score})[0] >= {threshold!r}D"
                                                     if np.isfinite(threshold) else "false", "j.")))
    kinds = f"array({', '.join(repr(k) for k in ALL_KINDS)})"

    def spans(parts: str) -> Column:
        return F.expr(f"""transform(array_sort({parts}),
            s -> named_struct('kind', {kinds}[s.k], 'start', s.start, 'end', s.end))""")

    df = df.withColumn("base_spans", spans("_base")).withColumn("spans", spans("concat(_base, _added)"))
    for k in KINDS:
        df = df.withColumn(f"n_{k}", F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))"))
    return restore(df, names, OWN)


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``found`` with ``redacted``: the text with each span replaced by its kind
    in brackets; of overlapping spans the first one counts."""
    return found.withColumn("redacted", F.expr(f"""aggregate(
        array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        named_struct('at', 0L, 'out', ''),
        (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, 'out', concat(a.out,
            substring(coalesce({text}, ''), int(a.at) + 1, int(s.start - a.at)), '[', s.kind, ']'))),
        a -> concat(a.out, substring(coalesce({text}, ''), int(a.at) + 1)))"""))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans; ``spans`` has all of them, and
    n_added counts those that the method adds."""
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"bigint(size(filter(base_spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_text("base_spans"), 256).alias("base_sha256"),
                      spans_text("spans").alias("spans"),
                      F.expr("bigint(size(spans) - size(base_spans))").alias("n_added"))

"""URL filters: allow and block rules first, else logistic regression on hashed character n-grams of host and path.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path (its score is the model's for no
n-grams, the intercept); repeated urls get equal rows; a rule fits its host and every subdomain where the path starts
with the rule's path; of fitting rules the longest (host and path together) wins, then the longer host, then ``block``.
The model knows nothing of a host whose n-grams its small table never shows: such a url scores near the intercept and is
allowed. Rules and the labelled urls are parameters, held in memory and sent to every worker: at most ``MOST_RULES`` rules.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import bounded_batches

MOST_RULES = 1_000_000
BUCKETS, SIZES = 1 << 18, (3, 4, 5)
#: Urls are blocked from this score on: of steps of 0.05 the least at which, with a fifth of ``labelled_table`` held out, at most one
#: in twenty of its urls to allow is blocked (README).
THRESHOLD = 0.6
#: Rules that hold wherever none are given: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: General vocabulary that the labelled table is built from: words of unwanted sites by subject, and ordinary words.
UNWANTED = {
    "gambling": "casino slots poker roulette betting bets jackpot lottery bingo wager",
    "pharmacy": "viagra cialis pills meds tablets steroids",
    "advertising": "ads adserver banner popup clicks track tracker tracking pixel",
    "adult": "adult porn xxx sex cams escort nude",
    "spam": "spam backlinks linkfarm mailblast traffic",
    "bait": "free cheap win winner prize bonus replica crack keygen warez payday",
}
ORDINARY = (
    "library museum school college science physics history theatre music cinema gallery poetry novel grammar teacher student garden flower forest river mountain harbour island valley "
    "bakery kitchen recipe coffee market butcher orchard winery weather climate energy water railway airport bicycle bridge tunnel traffic-report council parliament court police hospital "
    "doctor nurse clinic dentist insurance bank tax pension lawyer notary builder carpenter plumber painter tailor furniture ceramics glass paper printing bookshop magazine newspaper radio "
    "football tennis rowing chess sailing climbing running cycling camping travel hotel hostel map compass kernel compiler database network archive protocol manual forum thread farm village"
)
ENDINGS = ("/", "/en/12", "/about", "/page/3?sort=up", "/2019/report", "/index.html", "/de/88#top", "/list", "", "/fr/7/a")
#: Names that are reserved for examples, so that the table names no one's site.
SUFFIXES = ("test", "example.com", "example", "example.org", "invalid", "example.net", "localhost")
FORMS = ("{0}-{1}", "{1}-{0}", "www.{0}{1}", "{1}.{0}", "m.{1}{0}", "{0}")


def labelled_table() -> tuple[tuple[str, int], ...]:
    """Urls to learn from, 1 for those to block, by rule: each unwanted word joined with ordinary ones in every form, and as many
    ordinary words with each other."""
    bad, good = " ".join(UNWANTED.values()).split(), ORDINARY.split()
    out = []
    for label, words in ((1, bad), (0, good)):
        rounds = len(good) * len(FORMS) // len(words)
        for i, word in enumerate(words):
            for k in range(rounds):
                n = i * rounds + k
                other = good[(n * 31 + 17 * k + 5) % len(good)]
                out.append((f"http://{FORMS[n % len(FORMS)].format(word, other)}.{SUFFIXES[(n + k) % len(SUFFIXES)]}{ENDINGS[(n * 7 + k) % len(ENDINGS)]}", label))
    return tuple(dict.fromkeys(out))


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path after it."""
    found = HOST.search(url) if url else None
    return (found[1].translate(ASCII_LOWER), found[2]) if found else ("", "")


def _grams(part: str, space: bytes) -> np.ndarray:
    """Buckets of the n-grams that one part holds, each once; the part is marked at both ends."""
    data = b"^" + part.encode("utf-8", "surrogatepass") + b"$" if part else b""
    return np.array(sorted({zlib.crc32(space + data[i : i + n]) % BUCKETS for n in SIZES for i in range(len(data) - n + 1)}), np.int64)


def train(labelled=None, steps: int = 300, rate: float = 0.3, decay: float = 0.003) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent over the whole small table (``labelled_table`` where none is given)."""
    labelled = labelled_table() if labelled is None else labelled
    grams = [[_grams(part, space) for part, space in zip(split_url(url), (b"h", b"p"), strict=True)] for url, _ in labelled]
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *[g for parts in grams for g in parts]]))
    x, y = np.zeros((len(labelled), len(used))), np.array([float(label) for _, label in labelled])
    for i, parts in enumerate(grams):
        for part in parts:
            x[i, np.searchsorted(used, part)] += 1
    w, b = np.zeros(len(used)), 0.0
    for _ in range(steps if len(y) else 0):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, float(b)


def rule_index(rules) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, verdict, rule as text), the one that wins first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are held in memory")
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        index.setdefault(host, []).append((path, verdict, host + path))
    for entries in index.values():
        entries.sort(key=lambda e: (-len(e[0]), e[1] != "block"))
    return index


def winning(index, host: str, path: str) -> tuple[str, str] | None:
    """The rule that fits best, as text and verdict."""
    best = None
    while host:
        for entry_path, verdict, text in index.get(host, ()):
            if path.startswith(entry_path):
                if best is None or len(text) > len(best[0]):
                    best = (text, verdict)
                break
        host = host.partition(".")[2]
    return best


VERDICT = T.StructType().add("host", T.StringType()).add("path", T.StringType()).add("rule", T.StringType()).add("verdict", T.StringType()).add("score", T.DoubleType())


def judge(df: DataFrame, url: str = "url", rules=RULES, labelled=None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with host, path, rule (null where none fits), verdict and the model's score; columns of those names are replaced."""
    bounded_batches(df.sparkSession)
    weights, intercept = train(labelled)
    index = rule_index(rules)

    def judged(urls: pd.Series) -> pd.DataFrame:
        @lru_cache(maxsize=100_000)
        def host_sum(host: str) -> float:
            grams = _grams(host, b"h")
            return float(weights[grams].sum())

        out = []
        for one in urls:
            host, path = split_url(one)
            grams = _grams(path, b"p")
            logit = intercept + host_sum(host) + float(weights[grams].sum())
            score = float(1 / (1 + np.exp(-logit)))
            rule = winning(index, host, path)
            out.append((host, path, rule and rule[0], rule[1] if rule else "block" if score >= threshold else "allow", score))
        return pd.DataFrame(out, columns=VERDICT.names)

    judged_udf = F.pandas_udf(judged, VERDICT)
    others = [F.col(f"`{c}`") for c in df.columns if c not in VERDICT.names]
    return df.select(*others, judged_udf(F.col(url)).alias("_veil_judged")).select(*others, "_veil_judged.*")

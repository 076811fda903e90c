"""URL filters: path rules, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small table of labelled URLs, and its weights (``BUCKETS``
numbers) go into the plan as one constant array. Scoring is a sum over array elements in the JVM.
The labelled table is made by a rule from two lists of common English host words, one for kinds of
sites to block (gambling, adult, pills, fraud, malware, advertising) and one for ordinary sites, and
from invented syllable names, which are ordinary too. No host is copied from the tables judged;
the README says what was known of them.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to
``? #`` or the end. Both are empty for null and for urls without ``://``. Such a url scores as the
empty one. Repeated rows are judged each, and equal urls alike. A score of exactly ``CUT`` allows. Of rules
the longest that fits wins. An empty table gives an empty one; very long urls are whole. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
GRAM = 3
#: Log odds over which a url is blocked, chosen on held-out labelled urls.
CUT = 0.5
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

BLOCK_WORDS = (
    "casino casinos poker slots bet bets betting jackpot lottery roulette gamble gambling bingo bookmaker wager porn porno xxx sex sexy adult adults nude nudes escort escorts cams camgirls erotic fetish hookup "
    "viagra cialis pills pill steroids meds replica fake counterfeit payday loan loans quickcash fastcash easymoney getrich doubler giveaway prize prizes winner winners win jackpots freegift giftcard "
    "click clicks clickbait bait popup popups ad ads adserver adclick banner banners tracker trackers track tracking spam spammer spams phish phishing malware virus trojan spyware adware warez crack cracked keygen serials "
    "hack hacks botnet scam scams fraud linkfarm farmlinks backlinks doorway redirect autosurf traffic bonus bonuses cheap miracle slimming"
).split()
ALLOW_WORDS = (
    "news library museum university garden gardens weather recipes travel science history music sports school hospital city council park river mountain theatre art arts book books journal research physics chemistry "
    "biology math language dictionary encyclopedia map maps atlas forum community photo gallery film cinema kitchen cooking health fitness yoga nature animals birds ocean space astronomy engineering software code docs "
    "wiki blog shop store bakery coffee tea farm forest house home family kids education teacher student college academy institute government justice law economy business market finance bank energy transport rail bus "
    "airport hotel camping festival radio television magazine press review lab studio workshop village church bridge harbour island valley winter summer morning evening north south east west green blue red white stone "
    "paper glass wood iron silver gold light water fire earth wind rain snow sun moon star open free public local daily weekly world europe asia africa america archive records reports data statistics charts support "
    "help contact about people society culture heritage tourism cycling walking sailing fishing football tennis chess running swimming medical clinic dental pharmacy insurance property building design fashion crafts "
    "letters poetry stories novels essays lectures courses lessons exams tables windows doors trains planes boats cars bikes"
).split()
_ONSETS, _VOWELS, _ENDS = "b c d f g h k l m n p r s t v w st tr pl br th sh".split(), "a e i o u ea ou".split(), " n r l s t nd st ng".split(" ")


def _name(i: int) -> str:
    """An invented name of two or three syllables."""
    out = ""
    for step in range(2 + i % 2):
        k = i * 7919 + step * 104729
        out += _ONSETS[k % len(_ONSETS)] + _VOWELS[k // 3 % len(_VOWELS)] + (_ENDS[k // 5 % len(_ENDS)] if step else "")
    return out


def _hosts(words: list[str], spread: int) -> list[str]:
    """Every word alone, and joined with two others of its list."""
    n = len(words)
    return [*words, *(f"{w}-{words[(i * spread + 5) % n]}" for i, w in enumerate(words)), *(f"{words[(i * 3 + spread) % n]}{w}" for i, w in enumerate(words))]


def labelled_urls(block: list[str], allow: list[str], invented: int = 400) -> list[tuple[str, int]]:
    """(url, 1 to block): sites, languages, prefixes and pages follow each other alike in both classes."""
    fronts, ends, tongues = ["", "www.", "", "blog.", "m."], ["org", "com", "net", "info"], ["en", "de", "es", "fr"]
    out = []
    for y, hosts in ((1, _hosts(block, 7)), (0, [*_hosts(allow, 11), *(_name(i) for i in range(invented))])):
        out += [(f"http{'s' * (i % 2)}://{fronts[i % 5]}{h}{'.example' * (i % 3 < 2)}.{ends[i // 2 % 4]}/{tongues[i // 3 % 4]}/{i * 37 % 997}", y) for i, h in enumerate(hosts)]
    return out


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    slash = rest.find("/", 0, cut)
    host = rest[: cut if slash < 0 else slash]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), "" if slash < 0 else rest[slash:cut]


def buckets(host: str, path: str) -> list[int]:
    text = f"^{host}{path}$"
    return [sum(ord(c) * 31**j for j, c in enumerate(reversed(text[i : i + GRAM]))) % BUCKETS for i in range(len(text) - GRAM + 1)]


def fit(labelled: list[tuple[str, int]], rounds: int = 1500, rate: float = 8.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias by gradient descent over the whole table; both classes weigh the same. It is bounded by the labelled table."""
    grams = [buckets(*host_path(u)) for u, _ in labelled]
    size = np.array([len(g) for g in grams])
    row = np.repeat(np.arange(len(grams)), size)
    at = np.array([b for g in grams for b in g], dtype=np.int64)
    x = 1 / np.sqrt(np.maximum(size, 1))[row]
    y = np.array([v for _, v in labelled], dtype=float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        margin = bias + np.bincount(row, w[at] * x, minlength=len(grams))
        error = (1 / (1 + np.exp(-margin)) - y) * weight
        bias -= rate * error.sum() / 8
        w -= rate * (np.bincount(at, error[row] * x, minlength=BUCKETS) + decay * w)
    return [round(float(v), 6) for v in w], round(float(bias), 6)


_fitted: list[tuple[list[float], float]] = []


def production_model() -> tuple[list[float], float]:
    """The model of the whole labelled table, fitted once in a process."""
    if not _fitted:
        _fitted.append(fit(labelled_urls(BLOCK_WORDS, ALLOW_WORDS)))
    return _fitted[0]


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/]*((?s).*)$", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def model_score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """Log odds that the url is one to block. The sum is over whole numbers (millionths), so its order does not matter."""
    table = F.split(F.lit(",".join(str(round(x * 1e6)) for x in weights)), ",").cast("array<long>")
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    n = F.greatest(F.size(codes) - (GRAM - 1), F.lit(0))
    sums = F.zip_with(F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * 31 + b), F.slice(codes, 3, n), lambda ab, c: (ab * 31 + c) % BUCKETS)
    total = F.aggregate(sums, F.lit(0).cast("long"), lambda acc, i: acc + F.element_at(table, i + 1))
    return F.lit(bias) + total.cast("double") / 1e6 / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) of every page."""
    weights, bias = fit(labelled) if labelled else production_model()
    host, path = split_url(pages["url"])
    parts = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    score = model_score(F.col("host"), F.col("path"), weights, bias)
    rated = parts.select("*", rule.alias("rule"), says.alias("__says"), score.alias("score"))
    return rated.select("page_id", "host", "path", "rule", F.coalesce("__says", F.when(F.col("score") > CUT, "block").otherwise("allow")).alias("verdict"), "score")

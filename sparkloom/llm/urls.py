"""URL filters: host and path rules, and a weighted vocabulary found by an Aho-Corasick automaton.

A URL is rejected on one strict term, or when the distinct soft terms in it
weigh enough together.  A term counts only between boundaries: no ASCII letter
or digit on either side.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary (a strict term rejects by itself, soft terms by their weights) and the rules.
STRICT = (
    "adult", "adultchat", "amateurporn", "blackjack", "brothel", "camgirl", "camgirls", "camsex", "casino", "cialis", "cracked", "cybersex", "escort", "escorts", "fetish", "gambling",
    "hentai", "keygens", "levitra", "malware", "milf", "nsfw", "nude", "nudes", "onlinecasino", "phishing", "porn", "porno", "pornography", "pornstar", "pornstars", "ransomware", "roulette", "sexcam",
    "sexcams", "sexchat", "slotmachine", "slotmachines", "spam", "spyware", "sportsbook", "striptease", "tramadol", "trojan", "viagra", "warez", "webcamsex", "xanax", "xnxx", "xvideos", "xxx",
)
SOFT = {
    "ads": 1.0, "affiliate": 0.5, "bargain": 0.5, "bet": 1.0, "bets": 1.0, "betting": 1.0, "bingo": 1.0, "bitcoin": 0.5, "bonus": 1.0, "cash": 0.5, "cashback": 1.0, "cheap": 1.0, "cheapest": 1.0, "click": 1.0, "clicks": 1.0,
    "clearance": 0.5, "codec": 0.5, "coupon": 1.0, "coupons": 1.0, "crack": 1.0, "credit": 0.5, "crypto": 0.5, "dating": 1.0, "deal": 0.5, "deals": 0.5, "debt": 0.5, "discount": 0.5, "discounts": 0.5, "doorway": 1.0, "earn": 0.5,
    "erotic": 1.0, "farm": 0.5, "flirt": 1.0, "forex": 1.0, "free": 1.0, "freebies": 1.0, "giveaway": 1.0, "giveaways": 1.0, "hack": 0.5, "hacks": 0.5, "hot": 0.5, "insurance": 0.5, "jackpot": 1.0, "keygen": 1.0, "kissing": 0.5,
    "lender": 0.5, "loan": 1.0, "loans": 1.0, "lottery": 1.0, "lotto": 1.0, "meds": 1.0, "mortgage": 0.5, "nulled": 1.0, "offer": 0.5, "offers": 0.5, "payday": 1.0, "pharmacy": 1.0, "pill": 1.0, "pills": 1.0, "poker": 1.0, "popup": 1.0,
    "popups": 1.0, "prize": 1.0, "prizes": 1.0, "promo": 0.5, "proxy": 0.5, "rebate": 0.5, "redirect": 0.5, "replica": 1.0, "replicas": 1.0, "rich": 0.5, "serial": 0.5, "sex": 1.0, "sexy": 1.0, "singles": 1.0, "slots": 1.0, "sponsored": 0.5,
    "stream": 0.5, "sweepstakes": 1.0, "torrent": 1.0, "torrents": 1.0, "track": 1.0, "tracker": 0.5, "tracking": 1.0, "traffic": 0.5, "unlock": 0.5, "voucher": 0.5, "wager": 1.0, "weightloss": 1.0, "win": 1.0, "winner": 1.0, "winners": 1.0, "banner": 0.5,
}
SOFT_WEIGHT = 2.0
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


class UrlJudge:
    """Rules by host and path prefix first, then the vocabulary."""

    def __init__(self, rules: Mapping[str, str], strict: tuple[str, ...], soft: Mapping[str, float], soft_weight: float):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str]]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r), r)):
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host.translate(_LOWER), []).append((slash + path, rule))
        self.verdicts, self.soft_weight, self.soft = dict(rules), soft_weight, dict(soft)
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, term in strict))
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> str | None:
        """The longest rule whose host is that of the URL or above it and whose path starts the URL's."""
        labels, best = host.split("."), None
        for i in range(len(labels)):
            for start, rule in self.rules.get(".".join(labels[i:]), ()) if host else ():
                if path.startswith(start):
                    best = rule if best is None or len(rule) > len(best) else best
                    break
        return best

    def terms(self, url: str | None) -> tuple[int, float]:
        """Number of places of strict terms; weight of the distinct soft terms."""
        text, n, found = (url or "").translate(_LOWER), 0, set()
        for end, (term, is_strict) in self.automaton.iter(text):
            before = end - len(term)
            if (before >= 0 and text[before] in _INNER) or (end + 1 < len(text) and text[end + 1] in _INNER):
                continue
            if is_strict:
                n += 1
            else:
                found.add(term)
        return n, float(sum(self.soft[t] for t in found))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, float]:
        host, path = split_url(url)
        rule, (strict, soft) = self.rule(host, path), self.terms(url)
        verdict = self.verdicts[rule] if rule is not None else "block" if strict or soft >= self.soft_weight else "allow"
        return host, path, rule, verdict, strict, soft


@lru_cache(8)
def _judge(rules: tuple, strict: tuple[str, ...], soft: tuple, soft_weight: float) -> UrlJudge:
    return UrlJudge(dict(rules), strict, dict(soft), soft_weight)


def vocabulary_of(table: DataFrame, most: int = 100_000) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict and soft terms of a table (term, weight), for judge_urls(): a null weight makes a term strict.

    Terms are lower-cased, nulls and empty ones left out; a term that comes
    twice is strict if it is so once, else has its largest weight.  More than
    ``most`` terms raise.
    """
    rows = table.select(F.lower("term").alias("term"), "weight").where("term <> ''").groupBy("term").agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the vocabulary has too many terms")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: float(r["weight"]) for r in sorted(rows) if not r["strict"]}


def judge_urls(pages: DataFrame, rules: Mapping[str, str] = RULES, strict: tuple[str, ...] = STRICT, soft: Mapping[str, float] = SOFT, soft_weight: float = SOFT_WEIGHT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, soft_weight) of every row.

    Null URLs, and those without ``://``, have empty host and path, which no
    rule fits; the vocabulary sees the whole URL, a null one as empty.
    Repeated rows stay, other columns are ignored.
    """
    args = (tuple(rules.items()), tuple(strict), tuple(soft.items()), soft_weight)
    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string, n_strict long, soft_weight double"

    def run(batches):
        own = _judge(*args)
        for batch in batches:
            rows = [own.judge(u.as_py()) for u in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "soft_weight"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).mapInArrow(run, schema)


def verdict_sql() -> str:
    """DuckDB SQL of judge_urls() with the fixed rules and vocabulary."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(t)}, {w})" for t, w in [*((t, "NULL") for t in STRICT), *SOFT.items()])
    rules = ", ".join(f"({quote(r.partition('/')[0])}, {quote('/' + r.partition('/')[2])}, {quote(r)}, {quote(v)})" for r, v in RULES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH terms(term, weight) AS (VALUES {rows}), rules(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
cut AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw_host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT page_id, low, translate(raw_host, '{upper}', '{lower}') AS host, path, row_number() OVER () AS n FROM cut),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON host <> '' AND (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
hits AS (SELECT n, sum(CASE WHEN weight IS NULL THEN len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) ELSE 0 END) AS strict, coalesce(sum(CASE WHEN regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') THEN weight END), 0) AS soft FROM parts, terms GROUP BY n)
SELECT page_id, host, path, fits.rule AS rule, coalesce(fits.verdict, CASE WHEN strict > 0 OR soft >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(strict AS BIGINT) AS n_strict, CAST(soft AS DOUBLE) AS soft_weight
FROM parts JOIN hits USING (n) LEFT JOIN fits USING (n)"""

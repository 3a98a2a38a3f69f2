"""URL filters: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A URL's host runs from after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
from there to ``?``, ``#`` or the end. A rule names a host and the start of a path (``example.net/en/``); it fits the host
and its subdomains. Rules are looked up by the endings of the host at its dots, so a URL costs as many look-ups as its
host has labels, however many rules there are; the longest fitting rule decides.

Where none fits, one pass of the automaton (pyahocorasick) over the lower-cased URL, its percent escapes decoded, finds all
terms of the vocabulary. A hit counts if no letter or digit stands beside it, so ``adult`` is not found in ``adulthood``.
Every distinct term that is hit adds its weight: a strict term weighs as much as ``limit`` and rejects alone, soft terms
weigh 1 and reject when ``limit`` different ones meet. Repeats of a soft term add nothing.

Rules and vocabulary are parameters and travel with the tasks; there is no shuffle, and nothing is kept between rows.

Edge cases: a null URL, an empty one and one without ``://`` have an empty host and path, no rule fits them, and the
vocabulary judges what text there is (null: allow); a URL of any length is read whole; a null id, repeated rows and equal
URLs get one result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct soft terms that reject a URL; a strict term weighs as much.
LIMIT = 2
STRICT_TERMS = ("porn", "porno", "pornhub", "xxx", "xvideos", "xnxx", "hentai", "milf", "camgirl", "camgirls", "casino", "casinos", "viagra", "cialis",
                "levitra", "payday-loan", "payday-loans", "cheap-pills", "spam-farm", "link-farm", "phishing", "malware", "keygen", "warez")
SOFT_TERMS = ("ad", "ads", "adult", "affiliate", "banner", "bet", "bets", "betting", "bonus", "cheap", "clickbait", "coupon", "crack", "cracked",
              "dating", "deal", "deals", "discount", "escort", "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "nude", "nudes",
              "pharmacy", "pill", "pills", "poker", "popup", "promo", "redirect", "sex", "sexy", "slots", "spam", "sponsored", "torrent", "track",
              "tracker", "tracking", "win", "winner")
#: Weight of every term of the default vocabulary.
VOCABULARY: dict[str, int] = {**dict.fromkeys(SOFT_TERMS, 1), **dict.fromkeys(STRICT_TERMS, LIMIT)}

_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _AUTHORITY.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Rules:
    """(verdict, host/path) rules by host; for a host those of the longest paths come first."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block") or "/" not in rule or rule.startswith("/"):
                raise ValueError(f"a rule is allow or block and host/path, not {verdict} {rule}")
            host, slash, rest = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + rest, rule, verdict))
        for host in self.by_host.values():
            host.sort(key=lambda r: (-len(r[0]), r[2] == "allow"))  # of equal rules the one that blocks counts
        self.longest_host = max(map(len, self.by_host), default=0)

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or nulls."""
        best = None
        if len(host) > self.longest_host:  # longer endings have no rules
            dot = host.find(".", len(host) - self.longest_host - 1)
            host = host[dot + 1 :] if dot >= 0 else ""
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start):
                    if best is None or len(rule) > len(best[0]):
                        best = rule, verdict
                    break
            host = host.partition(".")[2]
        return best or (None, None)


class Vocabulary:
    """Terms and weights in an automaton."""

    def __init__(self, weights: Mapping[str, int], limit: int):
        self.limit = limit
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            if not term or weight <= 0:
                raise ValueError("terms are not empty and weigh more than nothing")
            self.machine.add_word(term.translate(_LOWER), (term, weight))
        if weights:
            self.machine.make_automaton()

    def hits(self, url: str | None) -> dict[str, int]:
        """Distinct terms in the URL that have no letter or digit beside them, with their weights."""
        text = unquote(url or "").lower()
        if not text or not len(self.machine):
            return {}
        found = {}
        for end, (term, weight) in self.machine.iter(text):
            start = end - len(term) + 1
            if not (start and text[start - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                found[term] = weight
        return found

    def verdict(self, url: str | None) -> str:
        return "block" if sum(self.hits(url).values()) >= self.limit else "allow"


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], weights: Mapping[str, int] = VOCABULARY, limit: int = LIMIT,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, terms, verdict) of every row; ``terms`` are the vocabulary's hits, in order, where no rule decides."""
    rules, weights = list(rules), dict(weights)
    Rules(rules)  # refuses wrong parameters before any task starts
    Vocabulary(weights, limit)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    schema = f"page_id {source.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, terms array<string>, verdict string"
    names = ["page_id", "host", "path", "rule", "terms", "verdict"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary = Rules(rules), Vocabulary(weights, limit)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule, verdict = known.longest(host, path)
                terms = {} if rule else vocabulary.hits(url)
                out.append((host, path, rule, sorted(terms), verdict or ("block" if sum(terms.values()) >= limit else "allow")))
            host, path, rule, terms, verdict = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in (host, path, rule)),
                                              pa.array(terms, pa.list_(pa.string())), pa.array(verdict, pa.string())], names)

    return source.mapInArrow(judge, schema)

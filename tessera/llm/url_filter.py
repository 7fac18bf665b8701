"""URL filtering with pattern rules indexed by their rarest literal token.

Two kinds of rules share one index.  A *site* rule names a host (it and all its
subdomains) and a path prefix; among the site rules that fit, the longest decides.  A
*pattern* rule is literal text with ``*`` (any run) and ``^`` (a separator: one character
outside [0-9A-Za-z], or either end), found anywhere in host + path; it blocks, and is
asked only if no site rule fits.

Tokens are runs of [0-9A-Za-z].  A rule's literal tokens are those that any fitting URL
must hold as whole tokens; the rule is filed under the one that the fewest URLs of the
table hold.  A URL's tokens fetch the candidate rules, and only those run their regular
expressions.  Rules without such a token are candidates for every URL.

Rules are a tuple, or a table (verdict, text, site) of any length.  A table is taken in
blocks of at most BLOCK_BYTES of text: the driver and each task hold one block and its index,
and the verdicts after one block are written before the next one revises them, so the order of
the blocks changes nothing.  Equally long site rules that fit one url: the smaller text decides; of
one text with both verdicts, block.  Rows of the table with a null or empty text, a null site, or a
verdict other than allow and block (patterns: block) raise an error.

Very long urls are judged whole.  Only id and url are read, so the names of other columns
cannot clash.  Null urls and urls without ``://`` have an empty host and path, fit no rule and are
allowed.  Repeated rows keep their own output rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise

#: Text of the rules that one pass over the urls takes.
BLOCK_BYTES = 8 << 20
TOKEN = re.compile("[0-9A-Za-z]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    site: bool

    @property
    def tokens(self) -> tuple[str, ...]:
        """Literal tokens that are whole in every fitting URL."""
        # Before a host there is a dot or its start, after it the end; a path prefix is open at its end.
        text = "^" + self.text.replace("/", "^/", 1) if self.site else self.text
        return tuple(m[0] for m in TOKEN.finditer(text) if m.start() > 0 and text[m.start() - 1] != "*" and m.end() < len(text) and text[m.end()] != "*")

    @property
    def rank(self) -> tuple:
        """The site rule of least rank decides."""
        return -len(self.text), self.text, self.verdict != "block"

    @cache  # only rules that are candidates somewhere are ever compiled
    def compiled(self) -> tuple[re.Pattern, re.Pattern | None]:
        if self.site:
            host, slash, path = self.text.partition("/")
            return re.compile(rf"(?s)(?:.*\.)?{re.escape(host)}\Z"), re.compile(re.escape(slash + path))
        parts = {"*": "(?s:.*)", "^": r"(?:[^0-9A-Za-z]|\A|\Z)"}
        return re.compile("".join(parts.get(c, re.escape(c)) for c in self.text)), None


def site(verdict: str, text: str) -> Rule:
    return Rule(verdict, text, True)


def pattern(text: str) -> Rule:
    return Rule("block", text, False)


#: The site rules of the contract.
SITES = (site("block", "net/"), site("allow", "example.net/en/"), site("block", "example.com/de/"), site("allow", "org/fr/"))
#: What the method blocks by itself: advertising hosts and pages without prose.
PATTERNS = (pattern("^ads^"), pattern("^adserver^"), pattern("^track^"), pattern("^tracker^"), pattern("^banners^"), pattern("^casino^"), pattern("/login^"), pattern("/signup^"), pattern("/cart/^"), pattern("/cgi-bin/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class RuleIndex:
    """token -> rules; `frequency` gives the number of URLs that hold a token."""

    def __init__(self, rules: tuple[Rule, ...], frequency: dict[str, int]):
        self.always: list = []
        self.by_token: dict[str, list] = {}
        for rule in rules:
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)

    def decide(self, host: str, path: str, best: Rule | None = None, blocked: Rule | None = None) -> tuple[Rule | None, Rule | None]:
        """The longest fitting site rule, and the first fitting pattern if none fits; given what earlier blocks found."""
        subject = host + path
        candidates = [*self.always]
        for token in dict.fromkeys([*TOKEN.findall(host), *TOKEN.findall(path)]):
            candidates += self.by_token.get(token, ())
        for rule in candidates:
            first, second = rule.compiled()
            if rule.site:
                if (best is None or rule.rank < best.rank) and first.match(host) and second.match(path):
                    best = rule
            elif (blocked is None or rule.text < blocked.text) and first.search(subject):
                blocked = rule
        return best, None if best else blocked


def _tokens(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Counts, within the task, of the URLs that hold each wanted token."""
    counts: dict[str, int] = {}
    for b in batches:
        for url in b.column("url").to_pylist():
            for t in wanted.intersection(t for x in split_url(url) for t in TOKEN.findall(x)):
                counts[t] = counts.get(t, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])


def _blocks(rules: tuple[Rule, ...] | DataFrame) -> Iterator[tuple[Rule, ...]]:
    """The rules, at most BLOCK_BYTES of text (or one rule) at a time; at least one block."""
    if not isinstance(rules, DataFrame):
        yield tuple(rules)
        return
    block, held = [], 0
    for r in rules.select("verdict", "text", F.col("site").cast("boolean").alias("site")).toLocalIterator():
        if not r.text or r.site is None or r.verdict not in (("allow", "block") if r.site else ("block",)):
            raise ValueError(f"not a rule: {r}")
        size = len(r.text.encode())
        if block and held + size > BLOCK_BYTES:
            yield tuple(block)
            block, held = [], 0
        block.append(Rule(r.verdict, r.text, r.site))
        held += size
    yield tuple(block)


def _judged(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls (page_id, url and what earlier blocks found) after these rules."""
    wanted = frozenset(t for r in rules for t in r.tokens)
    # At most one row per literal token of the rules and task comes back, whatever the table's size.
    counted = urls.select("url").mapInArrow(lambda it: _tokens(it, wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r["token"]: r["n"] for r in counted.collect()}
    later = "pattern" in urls.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, frequency)
        for b in batches:
            split = [split_url(u) for u in b.column("url").to_pylist()]
            if later:
                before = zip(b.column("rule").to_pylist(), b.column("verdict").to_pylist(), b.column("pattern").to_pylist(), strict=True)
                found = [index.decide(*x, site(v, r) if r is not None else None, pattern(p) if p is not None else None) for x, (r, v, p) in zip(split, before, strict=True)]
            else:
                found = [index.decide(*x) for x in split]
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), text([h for h, _ in split]), text([p for _, p in split]), text([s.text if s else None for s, _ in found]), text([s.verdict if s else "block" if p else "allow" for s, p in found]), text([p.text if p else None for _, p in found])],
                names=["page_id", "url", "host", "path", "rule", "verdict", "pattern"],
            )

    return urls.mapInArrow(judge, f"page_id {urls.schema['page_id'].dataType.simpleString()}, url string, host string, path string, rule string, verdict string, pattern string")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the deciding site rule), verdict, pattern (what else blocked it)."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    for i, block in enumerate(_blocks(rules)):
        urls = _judged(materialise(urls, "urls") if i else urls, block)
    return urls.drop("url")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages against the contract's rules and the method's patterns."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    sites = sorted(SITES, key=lambda r: -len(r.text))

    def fits(r: Rule) -> str:
        host, _, path = r.text.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    def found(r: Rule) -> str:
        text = "".join({"*": "(?s:.*)", "^": r"(?:[^0-9A-Za-z]|^|$)"}.get(c, re.escape(c)) for c in r.text)
        return f"regexp_matches(host || path, '{text}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in sites)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in sites)
    pat = " ".join(f"WHEN {found(r)} THEN '{r.text}'" for r in sorted(PATTERNS, key=lambda r: r.text))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
sited AS (SELECT *, CASE {rule} ELSE NULL END AS rule FROM split),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pat} ELSE NULL END END AS pattern FROM sited)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict, pattern FROM judged
"""


QUERIES = {"op4_url_rules": op4_url_rules}
ORACLES = {"op4_url_rules": _oracle()}

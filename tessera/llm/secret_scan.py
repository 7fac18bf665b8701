"""Secret scanning with an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its bytes.  The ledger has
one row per blob and rule version scanned so far.  A scan takes the blobs of the given
versions, keeps those whose (blob, rule version) pair the ledger lacks, scans each
once, appends the findings, and joins the ledger back to every path that holds the
blob.  Exact copies, however many, are scanned once and joined by hash; the join is a
plain equi-join that adaptive execution may split for a hot blob.  `replay` scans versions
of a table one after another with one ledger.

Spans are in code points, end exclusive, over the whole match.  Beside the base rules the
method has rules of its own (EXTRA); a new set of rules is a new rule version, for which
every blob counts as unseen.  A null text is the empty blob; null ids and repeated rows each
keep their own output row; an empty table gives an empty result.  A very long text is scanned
as one string, at about five times its size of memory.  Only id and text are read, so the
names of other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    holds: str = ""  # text that every match holds; without it the pattern is not run


def _either_case(words: str) -> str:
    """Letters in either case, spelt out: re.IGNORECASE would also take look-alikes beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


RULES = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", "([0-9a-f]+)", 1, 24),
)


#: Public formats of keys and tokens, and addresses with a password in them.
EXTRA = (
    Rule("pem", r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)", 1, 1, "PRIVATE KEY-----"),
    Rule("url", r"((?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/?#@]*:[^\s/?#@]+@)", 1, 1, "://"),
    Rule("github", r"((?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{36,})", 1, 1, "gh"),
    Rule("slack", r"((?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,})", 1, 1, "xox"),
    Rule("jwt", r"((?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 1, "eyJ"),
)
BASE = tuple(r.kind for r in RULES)


def rule_version(rules: tuple[Rule, ...] = RULES + EXTRA) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _compiled(rules: tuple[Rule, ...]):
    # A run of a lone class is maximal either way, so its minimum can go into the pattern,
    # which skips the short runs inside the regex engine.
    fast = lambda r: r.pattern.replace("]+)", f"]{{{r.least},}})") if re.fullmatch(r"\(\[[^]]*\]\+\)", r.pattern) else r.pattern
    return [(r, re.compile(fast(r))) for r in rules]


def find(text: str, rules=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) sorted by start, then by the order of the rules."""
    found = []
    for order, (rule, pattern) in enumerate(rules or _compiled(RULES + EXTRA)):
        if rule.holds not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, version = _compiled(rules), rule_version(rules)
        for b in batches:
            spans = [find(t.as_py() or "", compiled) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("blob"), pa.array([version] * len(spans), pa.string()), pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["blob", "rules", "spans"],
            )

    return scan


LEDGER = "blob binary, rules string, spans array<struct<kind:string,start:long,end:long>>"


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(path, spans) for every row of versions, and the ledger with the new rows."""
    spark, version = versions.sparkSession, rule_version(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    unseen = named
    if ledger is not None:
        unseen = named.join(ledger.filter(F.col("rules") == version).select("blob"), "blob", "left_anti")
    holder = unseen.groupBy("blob").agg(F.min("path").alias("holder"))
    texts = versions.select(F.col(id_col).alias("path"), text.alias("text"))
    texts = texts.withColumn("name", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    to_scan = texts.join(holder, F.col("path").eqNullSafe(F.col("holder")) & (F.col("name") == F.col("blob"))).select("blob", "text")
    # Only repeated rows (same path, same text) can meet here twice.
    new = materialise(to_scan.mapInArrow(_scanner(rules), LEDGER).dropDuplicates(["blob"]), "ledger")
    grown = new if ledger is None else ledger.unionByName(new)
    current = grown.filter(F.col("rules") == version).select("blob", "spans")
    return named.join(current, "blob", "left").select("path", "blob", "spans"), grown


def replay(versions: Iterable[DataFrame], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan the versions in order; (path, blob, spans) of the last one, and the ledger of them all."""
    found = None
    for version in versions:
        found, ledger = scan_secrets(version, ledger, rules, id_col, text_col)
    return found, ledger


def save_ledger(ledger: DataFrame, path: str) -> None:
    """Keep a ledger for later sessions."""
    ledger.write.parquet(path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by two versions of the table: the first half of its ids, then all of it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    half = docs.select(F.percentile_approx("doc_id", 0.5)).first()[0]
    first = docs.filter(F.col("doc_id") <= half) if half is not None else docs.limit(0)
    found, _ = replay([first, docs])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.hex("blob").alias("blob"),
    )


def _oracle() -> str:
    """The query's rows in DuckDB: what lies between the matches gives their positions.

    RE2 has no lookbehind, so the character before is matched too and taken off again; no
    match of these rules ends where the next may begin.  Addresses are the exception: they
    end with their only @, so each part before an @ is asked for one that ends it.
    """
    space = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    apart = r"(?:^|[^A-Za-z0-9])"
    # kind -> (pattern of the whole match, pattern of a character before it, group whose length counts, its least)
    kinds = {
        "assign": ("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "", 3, 6),
        "access": ("AKIA[A-Z0-9]+", "", 1, 20),
        "hex": ("[0-9a-f]+", "", 1, 24),
        "pem": ("-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "", 1, 1),
        "github": ("gh[oprsu]_[A-Za-z0-9]{36,}", apart, 1, 1),
        "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", apart, 1, 1),
        "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "(?:^|[^A-Za-z0-9_-])", 1, 1),
    }
    order = {r.kind: i for i, r in enumerate(RULES + EXTRA)}
    parts = []
    for kind, (body, before, group, least) in kinds.items():
        p = f"{before}({body})".replace("'", "''")
        parts.append(f"""
SELECT r, '{kind}' AS kind, {order[kind]} AS ord, list_sum(list_transform(gap[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda y: length(y))), 0) + length(whole[i]) - length(body[i]) AS s,
  length(body[i]) AS n
FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT r, string_split_regex(x, '{p}') AS gap, regexp_extract_all(x, '{p}') AS whole, regexp_extract_all(x, '{p}', 1) AS body, regexp_extract_all(x, '{p}', {group}) AS counted FROM t))
WHERE length(counted[i]) >= {least}""")
    address = rf"(?:^|[^A-Za-z0-9+.-])([A-Za-z][A-Za-z0-9+.-]*://[^{space}:/?#@]*:[^{space}/?#@]+)$"
    parts.append(f"""
SELECT r, 'url', {order["url"]}, list_sum(list_transform(seg[1:i], lambda y: length(y) + 1)) - 1 - length(found), length(found) + 1
FROM (SELECT *, regexp_extract(seg[i], '{address}', 1) AS found FROM (SELECT *, unnest(range(1, len(seg))) AS i FROM (SELECT r, string_split(x, '@') AS seg FROM t)))
WHERE found <> ''""")
    base = ", ".join(f"'{k}'" for k in BASE)
    agg = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord, n)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(parts)}),
f AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {agg} FILTER (kind IN ({base})) AS base, {agg} AS spans FROM m GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, upper(sha256(x)) AS blob
FROM t LEFT JOIN f USING (r)
"""


QUERIES = {"op10_blob_ledger": op10_blob_ledger}
ORACLES = {"op10_blob_ledger": _oracle()}

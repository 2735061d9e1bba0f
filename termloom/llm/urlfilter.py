r"""URL filters by a sort-merge range join.

A rule (host, path) becomes the interval of all strings that start with ``reversed host \0 path``. A URL
becomes one key for each ancestor of its host. A sweep over both in key order keeps the nested rules that
are open on a stack; its top is the longest rule for that ancestor.

Up to ``max_rule_bytes`` of rules go along with the tasks, and each Arrow batch of URLs is sorted and swept
where it lies, without a shuffle. Larger rule tables are merged with the distinct keys by (host, salt)
partitions, sorted by Spark; the salt splits hot hosts.

Defined results: a null URL, or one without "://", has empty host and path and gets the default verdict.
Longest means most characters of host and path together, then of the host; of equal rules, the verdict
that sorts first ("allow"); a rule without host or verdict is none. Repeated rows are judged alike; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(text: str) -> UrlRule:
    """'block com/en/' -> UrlRule."""
    verdict, rest = text.split(" ", 1)
    host, slash, path = rest.partition("/")
    return UrlRule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


#: Production rules.
RULES = tuple(map(parse_rule, ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")))


#: URLs that one salt of the merge stands for.
SALT_URLS = 1_000_000


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split(".")))


def ancestors(host: str) -> list[str]:
    """The host and every parent domain."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def sweep(keys: list[str], rules: list[tuple[str, int]]) -> list[int]:
    """For each of the sorted keys the number of the innermost of the sorted (key, number) rules, or -1."""
    out, stack, at = [], [], 0
    for key in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        out.append(stack[-1][1] if stack else -1)
    return out


def ordered(rules: list[UrlRule]) -> tuple[list[UrlRule], list[tuple[str, int]]]:
    """Distinct rules, one verdict each, and their sorted intervals."""
    best: dict[tuple[str, str], UrlRule] = {}
    for r in rules:
        if r.host and ((r.host, r.path) not in best or r.verdict < best[r.host, r.path].verdict):
            best[r.host, r.path] = r
    kept = list(best.values())
    return kept, sorted((f"{reversed_host(r.host)}\0{r.path}", i) for i, r in enumerate(kept))


def match(pairs: list[tuple[str, str]], rules: list[UrlRule], intervals: list[tuple[str, int]]) -> dict[tuple[str, str], int]:
    """The rule number, or -1, of each distinct (host, path)."""
    found = dict.fromkeys(pairs, -1)
    probes = sorted((f"{reversed_host(h)}\0{p}", (host, p)) for host, p in found for h in ancestors(host))
    size = lambda i: (len(rules[i].host) + len(rules[i].path), len(rules[i].host))
    for (_, pair), i in zip(probes, sweep([k for k, _ in probes], intervals), strict=True):
        if i >= 0 and (found[pair] < 0 or size(i) > size(found[pair])):
            found[pair] = i
    return found


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    at = F.instr(F.coalesce(pages[url_col], F.lit("")), "://")
    df = pages.select(pages[id_col].alias(id_col), F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("").alias("_rest"))
    return df.select(id_col, F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rule_bytes: int = 16 << 20, salts: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict. rules: UrlRules, or a DataFrame (verdict, host, path).

    salts: parts that a host's keys are dealt over in the merge; None: one for every ``SALT_URLS`` URLs, 16 at least."""
    split = split_urls(pages, id_col, url_col)
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + F.coalesce(F.octet_length("path"), F.lit(0)) + 64)).first()[0] or 0
        if size > max_rule_bytes:
            return _merged(split, rules, default, id_col, salts or max(16, split.count() // SALT_URLS))
        rules = [UrlRule(r["verdict"], r["host"].translate(str.maketrans(UPPER, LOWER)), r["path"] or "") for r in rules.select("verdict", "host", "path").collect() if r["host"] and r["verdict"] is not None]
    kept, intervals = ordered(list(rules))
    verdicts, names = [r.verdict for r in kept], [r.host + r.path for r in kept]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            pairs = list(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True))
            found = match(pairs, kept, intervals)
            hit = [found[p] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([names[i] if i >= 0 else None for i in hit], pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in hit], pa.string())], names=[id_col, "host", "path", "rule", "verdict"]
            )

    return split.mapInArrow(batches, f"{_ddl(split)}, rule string, verdict string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _merged(split: DataFrame, rules: DataFrame, default: str, id_col: str, salts: int) -> DataFrame:
    """The same join for rules of any number: both sides dealt by (host, salt), sorted, and swept in a stream."""
    parts = F.split("host", r"\.")
    urls = split.select("host", "path").distinct()
    probes = urls.filter("host != ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("at"), F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("path").alias("key"), "host", F.lit("").alias("verdict"))
    r = rules.filter("host is not null and host != '' and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("at"), F.coalesce("path", F.lit("")).alias("key"), "verdict").groupBy("at", "key").agg(F.min("verdict").alias("verdict"))
    r = r.select("at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "key", F.lit("").alias("host"), "verdict")

    def stream(it):
        now, stack = None, []
        for b in it:
            out = {"host": [], "path": [], "n": [], "h": [], "rule": [], "verdict": []}
            for at, salt, kind, key, host, verdict in zip(*(b.column(c).to_pylist() for c in ("at", "salt", "kind", "key", "host", "verdict")), strict=True):
                if now != (at, salt):
                    now, stack = (at, salt), []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    stack.append((key, verdict))
                elif stack:
                    for k, v in zip(out, (host, key, len(at) + len(stack[-1][0]), len(at), at + stack[-1][0], stack[-1][1]), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("n", pa.int64()), ("h", pa.int64()), ("rule", pa.string()), ("verdict", pa.string())]))

    dealt = probes.unionByName(r).repartition("at", "salt").sortWithinPartitions("at", "salt", "key", "kind")
    found = dealt.mapInArrow(stream, "host string, path string, n long, h long, rule string, verdict string")
    best = found.groupBy("host", "path").agg(F.max(F.struct("n", "h", "rule", "verdict")).alias("m")).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "m.rule", "m.verdict")
    return split.join(best, (split["host"] == best["_h"]) & (split["path"] == best["_p"]), "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

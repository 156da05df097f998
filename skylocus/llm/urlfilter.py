"""URL filtering by a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules of more characters than this in all aren't collected and broadcast, but joined.
MAX_TRIE_CHARS = 32 << 20
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    host = rest[: end.start()] if end else rest
    path = rest[end.start() :] if end else ""
    stop = _PATH_END.search(path)
    return host.translate(_LOWER), path[: stop.start()] if stop else path


class Trie:
    """Rules by host labels from the right, then by path segments.

    A node is ``[children by label, children by segment, ends]``. ``ends`` holds what
    rules ask of the segment that follows: (its beginning, length of the rule, verdict,
    rule). Where rules are equally long, the deeper host goes first, then a block.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: list = [{}, {}, []]
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks; this one says {verdict!r}")
            host = host.translate(_LOWER)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, {}, []])
            *segments, beginning = path.split("/")
            for segment in segments:
                node = node[1].setdefault(segment, [{}, {}, []])
            rank = (len(host) + len(path), len(host), verdict == "block")
            node[2].append((beginning, rank, verdict, host + path))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest rule that fits."""
        best = None
        segments = path.split("/")
        node = self.root
        labels = iter(reversed(host.split("."))) if host else iter(())
        while node:
            below = node
            for segment in segments:
                for beginning, rank, verdict, rule in below[2]:
                    if segment.startswith(beginning) and (best is None or rank > best[0]):
                        best = (rank, verdict, rule)
                below = below[1].get(segment)
                if below is None:
                    break
            label = next(labels, None)
            node = node[0].get(label) if label is not None else None
        return best and best[1:]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id", max_trie_chars: int = MAX_TRIE_CHARS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row of ``pages``.

    ``rules``: ``verdict`` (allow or block), ``host`` and ``path``. A rule fits its host
    and all subdomains, if the path starts with the rule's; the longest one (host and
    path, in characters) decides; without one, ``rule`` is null and ``default`` holds.
    A null url has an empty host and path. Rules with a null field are left out;
    repeated rules act once. Null keys and repeated rows stay; an empty table gives no
    rows; other columns are ignored. The trie is broadcast if the rules' size, which
    is checked, allows; otherwise ``judge_by_join`` gives the same result.
    """
    rules = rules.select("verdict", "host", "path").dropna().distinct()
    chars = rules.agg(F.sum(F.length("host") + F.length("path") + 8).alias("n")).first()["n"] or 0
    if chars > max_trie_chars:
        return judge_by_join(pages, rules, default, url, key)
    trie = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in rules.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            split = [parts(x) for x in batch.column(1).to_pylist()]
            found = [find(*x) or (default, None) for x in split]
            columns = [[h for h, _ in split], [p for _, p in split], [r for _, r in found], [v for v, _ in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """As ``judge``, for rules too many to broadcast, by equal keys: a host's suffix and the beginning of a path.

    A path is cut at the lengths that the rules of its host's suffixes have, so a page is
    a row for each length that occurs there, however many rules its host has.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(key).cast("long").alias("page_id"), rest.alias("rest"))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select(
        "__row", "page_id", lower(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*(/[^?#]*)?", 1).alias("path"),
    )
    rows = common.checkpoint(rows.withColumn("path", F.coalesce("path", F.lit(""))))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("suffix"))
    lowered = rules.select("verdict", lower(F.col("host")).alias("suffix"), F.col("path").alias("beginning"))
    lengths = lowered.groupBy("suffix").agg(F.collect_set(F.length("beginning")).alias("lengths"))
    cut = rows.join(hosts.join(lengths, "suffix"), "host").withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("path"))
    cut = cut.select("__row", "suffix", F.substring("path", F.lit(1), F.col("n")).alias("beginning"))
    found = cut.join(lowered, ["suffix", "beginning"]).withColumnRenamed("beginning", "rule_path")
    rank = F.struct(F.length("suffix") + F.length("rule_path"), F.length("suffix"), F.col("verdict") == "block")
    best = found.groupBy("__row").agg(F.max_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), F.col("verdict")), rank).alias("best"))
    out = rows.join(best, "__row", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

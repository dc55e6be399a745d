"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest entry decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.common import free_name, map_batches

# A list of at most this many entries and characters is one broadcast trie; a longer one is joined by key.
TRIE_ENTRIES = 200_000
TRIE_CHARS = 16_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


class _Node:
    """A node of the trie: its children by label or segment, the paths that begin here, the entries that end in the next segment."""

    __slots__ = ("below", "ends", "paths")

    def __init__(self) -> None:
        self.below: dict[str, _Node] = {}
        self.paths: _Node | None = None
        # Beginning of the segment that follows -> (entry, verdict); an empty one where the entry's path ends with a slash.
        self.ends: dict[str, tuple[str, str]] = {}


class UrlTrie:
    """Entries (host, path, verdict) under their host labels from the last to the first, then under their path segments.

    The host with the most labels wins, among its entries the longest path; of the same entry in both lists, the block.
    """

    def __init__(self, entries: Iterable[tuple[str, str, str]]) -> None:
        self.root = _Node()
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.below.setdefault(label, _Node())
            if node.paths is None:
                node.paths = _Node()
            node = node.paths
            *whole, last = path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            if node.ends.get(last, ("", ""))[1] != "block":
                node.ends[last] = (host + path, verdict)

    @staticmethod
    def _in_path(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.ends:
                fits = [e for e in node.ends if segment.startswith(e)]
                if fits:
                    best = node.ends[max(fits, key=len)]
            node = node.below.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest entry that fits, or None."""
        segments = path.split("/")
        node, best = self.root, None
        on_way = [node.paths]
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            on_way.append(node.paths)
        for paths in reversed(on_way):
            if paths is not None:
                best = self._in_path(paths, segments)
                if best is not None:
                    return best
        return None


def _entries(rules: DataFrame) -> DataFrame:
    """(host, path, entry, verdict): one row per distinct host and path. Null parts are empty; other verdicts than allow and block are left out."""
    host = F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), _UPPER, _LOWER)
    named = rules.select(host.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    # "block" is the greater of the two.
    one = named.where(F.col("verdict").isin("allow", "block")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select("host", "path", F.concat("host", "path").alias("entry"), "verdict")


def _by_trie(urls: DataFrame, entries: DataFrame, host: str, path: str, rule: str, verdict: str, default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie((r["host"], r["path"], r["verdict"]) for r in entries.collect()))
    at_host, at_path = urls.columns.index(host), urls.columns.index(path)
    names = [*urls.columns, rule, verdict]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            pairs = zip(batch.column(at_host).to_pylist(), batch.column(at_path).to_pylist(), strict=True)
            found = [find(h, p) or (None, default) for h, p in pairs]
            columns = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    fields = [T.StructField(f.name, f.dataType) for f in urls.schema.fields]
    return map_batches(urls, work, T.StructType([*fields, T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())]))


def _by_key(urls: DataFrame, entries: DataFrame, host: str, path: str, rule: str, verdict: str, default: str) -> DataFrame:
    """The same by equality joins: every distinct host and path meets the entries under its host endings and path beginnings."""
    # As many values as paths have lengths.
    lengths = [r["n"] for r in entries.select(F.length("path").alias("n")).distinct().collect()]
    labels = F.split("h", r"\.")
    n = F.size(labels)
    endings = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("host")))
    beginnings = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("p")), lambda x: F.substring("p", F.lit(1), x))
    asked = urls.select(F.col(f"`{host}`").alias("h"), F.col(f"`{path}`").alias("p")).distinct()
    keys = asked.select("h", "p", F.explode(endings).alias("e")).select("h", "p", "e.depth", "e.host", F.explode(beginnings).alias("path"))
    met = keys.join(entries, ["host", "path"])
    best = met.groupBy("h", "p").agg(F.max(F.struct("depth", F.length("path").alias("n"), "entry", "verdict")).alias("b"))
    side = best.select("h", "p", F.col("b.entry").alias("entry"), F.col("b.verdict").alias("found"))
    joined = urls.join(side, (F.col(f"`{host}`") == F.col("h")) & (F.col(f"`{path}`") == F.col("p")), "left")
    columns = [urls[f"`{c}`"] for c in urls.columns]
    return joined.select(*columns, side["entry"].alias(rule), F.coalesce(side["found"], F.lit(default)).alias(verdict))


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", entries: int = TRIE_ENTRIES, chars: int = TRIE_CHARS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the longest of ``rules`` (host, path, verdict) that fits the URL, else ``default``.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; a rule without a host fits every host. The host with
    the most labels wins, then the longest path, then ``block``. A null URL or one without ``://`` has an empty host and path. Repeated rows
    stay, an empty table gives an empty one. Where ``pages`` has columns of the four names, new ones get underscores. Rows are judged where
    they are: nothing is shuffled as long as the rules fit a broadcast trie; a longer list is joined by host endings and path beginnings.
    """
    host, path, rule, verdict = (free_name(pages, wanted) for wanted in ("host", "path", "rule", "verdict"))
    place = F.col(f"`{url}`").cast("string")
    urls = pages.select("*", url_host(place).alias(host), url_path(place).alias(path))
    listed = _entries(rules)
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("entry")), F.lit(0)).alias("c")).first()
    judge = _by_trie if size["n"] <= entries and size["c"] <= chars else _by_key
    return judge(urls, listed, host, path, rule, verdict, default)

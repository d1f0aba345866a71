"""URL filters: a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The trie is broadcast; a rule list whose pickled trie exceeds this is refused.
MAX_TRIE_BYTES = 64 << 20


class Trie:
    """Rules (verdict, host, path): the longest that fits a url wins.

    A node descends by host labels from the right; each node with rules has a
    second trie over whole path segments, and at each of its nodes the last,
    partial segments of rules by their length, longest first, so that a url
    takes one lookup a length however many rules there are. Precedence: more characters of host and path
    together; for equal length the longer host; allow before block if the same
    rule stands in both lists.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(_lower(host).split(".")):
                node = node.setdefault("kids", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *segments, rest = path.split("/")
            for s in segments:
                node = node.setdefault("kids", {}).setdefault(s, {})
            ends = node.setdefault("ends", {}).setdefault(len(rest), {})
            if ends.get(rest, ("",))[0] != "allow":
                ends[rest] = (verdict, _lower(host) + path, len(host))
        self._sort(self.root)

    def _sort(self, root: dict) -> None:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if "ends" in node:
                node["ends"] = dict(sorted(node["ends"].items(), reverse=True))
            waiting += node.get("kids", {}).values()
            if "paths" in node:
                waiting.append(node["paths"])

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, else None."""
        best, best_key = None, (-1, -1)
        node = self.root
        segments = path.split("/")
        for label in [*reversed(host.split(".")), None]:
            at = node.get("paths")
            for i, s in enumerate(segments):
                if at is None:
                    break
                for n, ends in at.get("ends", {}).items():
                    if found := ends.get(s[:n]):
                        verdict, rule, n_host = found
                        if (len(rule), n_host) > best_key:
                            best, best_key = (verdict, rule), (len(rule), n_host)
                        break
                at = at.get("kids", {}).get(s)
            if label is None or (node := node.get("kids", {}).get(label)) is None:
                break
        return best


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def filter_urls(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds host, path, rule and verdict to pages.

    Host and path are taken from the url with built-in functions; only they go
    to Python, where the broadcast trie (size-checked) is walked once a row.
    There is no shuffle. A null url, or one without ://, has an empty host and
    path, so that no rule fits and the verdict is the default; so is that of a
    url no rule fits (rule is null then). Repeated rows are judged one by one.
    Columns of pages that are named host, path, rule or verdict are replaced;
    others stay. An empty table gives an empty result.
    """
    blob = pickle.dumps(Trie(rules))
    if len(blob) > MAX_TRIE_BYTES:
        raise ValueError(f"the trie has {len(blob)} bytes; at most {MAX_TRIE_BYTES} are broadcast")
    shared = spark.sparkContext.broadcast(blob)

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = pickle.loads(shared.value)
        for hosts, paths in parts:
            found = [trie.match(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r for _, r in found], "verdict": [v for v, _ in found]}, dtype=object)

    # the part after the first :// up to / ? # or the end; then up to ? # or the end
    rest = F.expr(f"substring(`{url}`, nullif(locate('://', `{url}`), 0) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    out = out.withColumn("verdict", judge("host", "path"))
    return out.withColumns({"rule": F.col("verdict.rule"), "verdict": F.col("verdict.verdict")})

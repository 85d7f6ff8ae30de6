"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and a path; it fits its host and all subdomains where the path of the url starts with
its own. Of the rules that fit, the one with the most host labels wins, then the longest path; an entry
that is both allowed and blocked blocks. Urls that no rule fits get the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of rules that are sent to each worker; beyond, rules are joined.
BROADCAST_BYTES = 64 << 20
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Labels from the last to the first, then the segments of a path; a rule's last segment may be a part of one."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules):  # allow before block, so that block stays
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, part = path.split("/")
            node = node.setdefault("/", {})  # no label is "/": the paths of this host
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault("//", {})[part] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the best rule."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if "/" in node:
                hosts.append(node["/"])
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                if parts := node.get("//"):
                    best = next((parts[segment[:k]] for k in range(len(segment), -1, -1) if segment[:k] in parts), best)
                if (node := node.get(segment)) is None:
                    break
            if best:
                return best
        return None


def judge(pages: DataFrame, rules: Iterable[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits. Repeated rows and
    null ids stay. Rules of more than ``broadcast_bytes`` are not broadcast but joined. Other columns are not read.
    """
    rules = list(rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if sum(len(h) + len(p) for _, h, p in rules) > broadcast_bytes:
        return _joined(rows, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(rules)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RuleTrie(shared.value)
        for b in batches:
            found = [trie.find(h, p) or (default, None) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[1] for x in found], pa.string()), pa.array([x[0] for x in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same for rules of any size: each distinct host meets the rules of its suffixes."""
    spark = rows.sparkSession
    table = spark.createDataFrame(rules, "verdict string, r_host string, r_path string")
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.select("host", "path", F.explode(suffix).alias("r_host")).join(table, "r_host").where("startswith(path, r_path)")
    order = Window.partitionBy("host", "path").orderBy(F.desc(F.length("r_host")), F.desc(F.length("r_path")), F.desc("verdict"))
    best = fits.withColumn("k", F.row_number().over(order)).where("k = 1").select("host", "path", F.concat("r_host", "r_path").alias("rule"), "verdict")
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query below.
QUERY_RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), QUERY_RULES)


ORACLE_SQL = """
WITH hosts AS (
  SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(url, '') AS u FROM pages) x),
rules(r_verdict, r_host, r_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT h.page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM hosts h JOIN rules r ON (h.host = r_host OR ends_with(h.host, '.' || r_host)) AND starts_with(h.path, r_path)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN fits f ON h.page_id = f.page_id
"""

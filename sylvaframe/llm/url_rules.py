"""Host and path rules for urls, by a sort-merge range join.

A host's key is its labels in reverse order, each followed by a full stop, so a rule's host and all its subdomains are
the interval of keys that start with the rule's key, and intervals nest or lie apart. Distinct hosts and rules are sorted
together over range partitions; a sweep keeps a stack of the rules whose interval holds the current key and gives each
host its stack. Rules that are open where a partition starts are handed over from the partitions before it: the
driver sees one first key and one stack for each partition, nothing for each host or url.

Null urls, and urls without `://`, have empty hosts and paths. An empty host is under rules with an empty host only.
Rules with equal host and path: block wins. Repeated rows give repeated results; an empty table an empty result;
other columns are ignored. The longest rule (host and path) that fits decides; without any the verdict is `default`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir, field

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """`a.example.net` as `net.example.a.`; the empty host as the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Stack:
    """Nested rules whose key starts the current key; lists of path, rule and verdict by rule host."""

    def __init__(self, carried: list[tuple[str, str, str, str]] = ()):
        self.open: list[tuple[str, str, str, str]] = list(carried)

    def move(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()


def sweep(batches: Iterator[pa.RecordBatch], stack: Stack) -> Iterator[tuple[str | None, str, list[tuple[str, str, str, str]]]]:
    """Hosts in key order with the stack that holds them; rules on a key come before hosts on it."""
    for batch in batches:
        for row in batch.to_pylist():
            stack.move(row["key"])
            if row["kind"] == 0:
                stack.open.append((row["key"], row["path"], row["rule"], row["verdict"]))
            else:
                yield row["host"], row["key"], stack.open


def active_rules(hosts: DataFrame, rules: DataFrame, partitions: int) -> DataFrame:
    """host and rules (array of path, rule, verdict) of distinct hosts that are under any rule."""
    ensure_checkpoint_dir(hosts.sparkSession)
    empty = F.lit("")
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", empty.alias("path"), empty.alias("rule"), empty.alias("verdict"))
    opens = rules.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    ranged = opens.unionByName(points).repartitionByRange(partitions, "key", "kind", "path", "host").sortWithinPartitions("key", "kind", "path", "host")
    ranged = ranged.checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, first, last = Stack(), None, None
        for batch in batches:
            if batch.num_rows and first is None:
                first = batch.column("key")[0].as_py()
            for row in batch.to_pylist():
                stack.move(row["key"])
                if row["kind"] == 0:
                    stack.open.append((row["key"], row["path"], row["rule"], row["verdict"]))
                last = row["key"]
        if first is not None:
            kept = [dict(zip(("key", "path", "rule", "verdict"), x)) for x in stack.open]
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "open": kept}], schema=shape)

    item = pa.struct([(n, pa.string()) for n in ("key", "path", "rule", "verdict")])
    shape = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("open", pa.list_(item))])
    ddl = "part int, first string, last string, open array<struct<key:string,path:string,rule:string,verdict:string>>"
    carry: dict[int, list[tuple[str, str, str, str]]] = {}
    stack = Stack()
    for row in sorted(ranged.mapInArrow(ends, ddl).collect(), key=lambda r: r["part"]):
        stack.move(row["first"])
        carry[row["part"]] = list(stack.open)
        stack.move(row["last"])
        stack.open += [tuple(x) for x in row["open"]]
    carried = hosts.sparkSession.sparkContext.broadcast(carry)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(carried.value.get(TaskContext.get().partitionId(), []))
        rows = []
        for host, _, active in sweep(batches, stack):
            if active:
                rows.append({"host": host, "rules": [{"path": p, "rule": r, "verdict": v} for _, p, r, v in active]})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("host", pa.string()), ("rules", pa.list_(pa.struct([(n, pa.string()) for n in ("path", "rule", "verdict")])))])
    return ranged.mapInArrow(judge, "host string, rules array<struct<path:string,rule:string,verdict:string>>")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """`id_col`, host, path, rule (null where none fits) and verdict of each row.

    rules: host, path and verdict (`allow` or `block`).
    """
    partitions = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.groupBy(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(
        F.max("verdict").alias("verdict")
    )
    urls = pages.select(pages[id_col].alias("id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    stacks = active_rules(urls.select("host").distinct(), rules, partitions)
    joined = urls.join(stacks, "host", "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return joined.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

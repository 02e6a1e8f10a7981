"""URL filters: a sort-merge range join of urls and rules, swept with a stack of active rules.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with the rule's.  With its labels
reversed (``com.example.``), a host is a prefix of all its subdomains, so a rule's host is an interval of the sorted hosts
and intervals nest.  Urls and rules are dealt to ranges of reversed hosts together: a url to its range, a rule to every range
that its interval meets.  Each range is sorted and swept once: rules whose interval begins are pushed, those whose interval
has ended are popped, and the active rules' paths are looked up.  The longest fitting rule (host and path together) wins; of
equally long ones the one with the longer host.

Ranges are cut by a sample of the urls.  A host that fills several ranges, such as one url repeated over and over, is spread
over all of them, and its rules go to each, so no number of rules or repeated urls needs another way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled urls for each range; they only place the cuts, no result depends on them.
SAMPLED = 20
#: Ranges for each task of the sweep; several make the tasks even.
RANGES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reverse_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """Judges urls in the order of their reversed hosts, after all rules with lesser or equal hosts have been added in that order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # reversed host, host, verdicts of paths, their lengths

    def add(self, key: str, path: str, verdict: str) -> None:
        self._pop(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, reverse_host(key[:-1])[:-1], {}, []))
        _, _, paths, lengths = self.stack[-1]
        paths[path] = verdict
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def _pop(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The winning rule as ``host + path`` and its verdict."""
        self._pop(key)
        best, best_size = None, -1
        for _, host, paths, lengths in reversed(self.stack):
            for n in reversed(lengths):
                if len(host) + n <= best_size:
                    break
                verdict = paths.get(path[:n]) if n <= len(path) else None
                if verdict is not None:
                    best, best_size = (host + path[:n], verdict), len(host) + n
                    break
        return best


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _ranges_of_rule(cuts: list[str], key: str) -> tuple[int, int]:
    """The first and last range that hosts below ``key`` can lie in; ``cuts`` are the greatest hosts of all ranges but the last."""
    return bisect_left(cuts, key), bisect_right(cuts, key + chr(0x10FFFF))


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``default`` if none fits) to every row.

    ``rules`` has ``host``, ``path`` and ``verdict``.  Rules with a null are left out; of rules repeated with different
    verdicts the greatest text counts.  A null url and one without ``://`` have an empty host and path and fit no rule.
    Existing columns of the added names, in any case, are replaced; all others keep theirs.
    """
    spark = df.sparkSession
    url = df[url_col]
    columns = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    key_name, range_name, kind_name = fresh_names(df, "reversed_host", "range_number", "is_url")
    reversed_host = lambda host: F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    urls = df.select(*(F.col(f"`{c}`") for c in columns), url_host(url).alias("host"), url_path(url).alias("path"))
    urls = urls.withColumn(key_name, reversed_host("host"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * tasks
    share = min(1.0, SAMPLED * ranges / max(1, urls.count()))  # so about as many keys are gathered from any number of urls
    sample = sorted(r[0] for r in urls.select(key_name).sample(share, 17).collect())
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    @F.arrow_udf("int")
    def range_of(key: pa.Array, salt: pa.Array) -> pa.Array:
        at, salt = [], salt.to_numpy()
        for i, k in enumerate(key.to_pylist()):
            first, last = bisect_left(cuts, k), bisect_right(cuts, k)  # equal cuts: the host fills all ranges between them
            at.append(first + int(salt[i]) % (last - first + 1) if last > first + 1 else first)
        return pa.array(at, pa.int32())

    @F.arrow_udf("array<int>")
    def ranges_of(key: pa.Array) -> pa.Array:
        spans = [_ranges_of_rule(cuts, k) for k in key.to_pylist()]
        return pa.array([np.arange(a, b + 1, dtype=np.int32) for a, b in spans], pa.list_(pa.int32()))

    placed = urls.withColumn(range_name, range_of(key_name, F.monotonically_increasing_id())).withColumn(kind_name, F.lit(True))
    rule_rows = rules.select("path", "verdict", reversed_host("host").alias(key_name))
    rule_rows = rule_rows.withColumn(range_name, F.explode(ranges_of(key_name))).withColumn(kind_name, F.lit(False))
    both = placed.withColumn("verdict", F.lit(None).cast("string")).unionByName(rule_rows, allowMissingColumns=True)
    order = [range_name, key_name, kind_name]  # a rule before the urls of its own host
    both = both.repartition(tasks, range_name).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at = Sweep(), None
        for batch in batches:
            won, rows = [], []
            fields = zip(*(batch.column(c).to_pylist() for c in (*order, "path", "verdict")), strict=True)
            for i, (here, key, is_url, path, verdict) in enumerate(fields):
                if here != at:
                    sweep, at = Sweep(), here
                if is_url:
                    rows.append(i)
                    won.append(sweep.judge(key, path))
                else:
                    sweep.add(key, path, verdict)
            some = batch.take(pa.array(rows, pa.int64())) if len(rows) < batch.num_rows else batch
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in [*columns, "host", "path"]), pa.array([w and w[0] for w in won], pa.string()), pa.array([w[1] if w else default for w in won], pa.string())],
                [*columns, "host", "path", "rule", "verdict"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields if f.name != key_name)
    return both.mapInArrow(run, f"{schema}, rule string, verdict string")

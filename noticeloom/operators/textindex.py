"""A stored inverted index over the fields of a table, and ranked retrieval that reads only what a query names.

Five Parquet tables below one folder, each sorted by its look-up column, so that a filter on it skips all other row groups:

- ``postings (term, field, id, tf, n)``: occurrences of a word in a field of a row, and the field's length there; ranges are cut by
  term and id, so a word that every row has fills many files;
- ``terms (term, fields, rows)``: the dictionary;
- ``variants (variant, term)``: what is left of a word of up to VARIANT_LENGTH characters if up to two are deleted; two words within two edits
  have one in common (the deletion neighbourhood), so near words are found by equality.  Words of digits only have none: they grow with the rows,
  and are near only to a word with as few other characters as edits, for which the dictionary is filtered;
- ``exact (value, id)``: identifying values as a whole;
- ``fields (field, rows, mean)``: the statistics of ranking.

A prefix is a range of terms.  Scores are those of ``search.search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .search import BOOSTS, EXACT_FIELDS, asked_terms, edits_of, first_exact, ranked

#: Longer words are near to others by a filter on the dictionary's lengths, not by deletions.
VARIANT_LENGTH, VARIANT_EDITS = 14, 2
#: Words without variants.
NUMBER = "^[0-9]+$"
#: What ``search.tokens`` cuts at.
WORD_BREAK = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class TextIndex:
    """An index that has been written; ``path`` is a folder that all executors see."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _without_one(words: Column) -> Column:
    """All strings that lack one character of one of ``words``."""
    every = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), every)))


def _deletions(word: str, most: int) -> set[str]:
    found = {word}
    for _ in range(most):
        found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, field, id, tf, n) of (id, field, text): a row for each distinct word of a text, and one without a word for the text itself.

    Texts are in lower case and cut as ``search.tokens`` cuts them.  A batch comes out in the order of the postings, so that sorts merge few runs.
    """
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("id")))
        lists = pc.split_pattern_regex(batch.column("text"), WORD_BREAK)
        cut = lists.flatten().dictionary_encode()
        order = pc.sort_indices(cut.dictionary)
        terms, place = cut.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        word, text = place[cut.indices.to_numpy()], pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        if len(terms) and not terms[0].as_py():  # before, after or between breaks
            word, text = word[word > 0], text[word > 0]
        found, tf = np.unique(word * batch.num_rows + text, return_counts=True)
        at = pa.array(np.concatenate([found % batch.num_rows, np.arange(batch.num_rows)]))
        term = pa.concat_arrays([terms.take(pa.array(found // batch.num_rows)), pa.nulls(batch.num_rows, terms.type)])
        counts = pa.array(np.concatenate([tf, np.zeros(batch.num_rows, np.int64)]), pa.int32())
        n = pa.array(np.bincount(text, minlength=batch.num_rows), pa.int32())
        yield pa.RecordBatch.from_arrays([term, batch.column("field").take(at), batch.column("id").take(at), counts, n.take(at)], ["term", "field", "id", "tf", "n"])


def build_index(df: DataFrame, path: str, fields: tuple[str, ...] = tuple(BOOSTS), key: str = "id") -> TextIndex:
    """Writes the index of ``df``, which replaces one at ``path``; ``fields`` that ``df`` lacks are left out.  ``key`` tells rows apart."""
    fields = tuple(f for f in fields if f in df.columns)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("text")) for f in fields])
    texts = df.select(F.col(key).alias("id"), F.inline(cells))
    kind = texts.schema["id"].dataType.simpleString()
    # written, as ranges are drawn from a sample, and words are cut and counted once for all tables
    counted = durable(texts.mapInArrow(_counted, f"term string, field string, id {kind}, tf int, n int"))
    statistics = counted.where("term is null").groupBy("field").agg(F.count("*").alias("rows"), F.greatest(F.avg("n"), F.lit(1e-9)).alias("mean"))
    statistics.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
    postings = counted.where("term is not null").repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    index = TextIndex(df.sparkSession, path)
    by_field = index.table("postings").groupBy("term", "field").agg(F.count("*").alias("rows"))  # so that sets are made of few rows
    terms = durable(by_field.groupBy("term").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.sum("rows").alias("rows")))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = index.table("terms").where((F.length("term") <= VARIANT_LENGTH) & ~F.col("term").rlike(NUMBER)).repartition(tasks, "term")
    one = short.select("term", F.array("term").alias("zero")).withColumn("one", _without_one(F.col("zero")))
    variants = one.select("term", F.explode(F.array_distinct(F.concat("zero", "one", _without_one(F.col("one"))))).alias("variant"))
    durable(variants).repartitionByRange("variant").sortWithinPartitions("variant").select("variant", "term").write.mode("overwrite").parquet(f"{path}/variants")
    values = [F.lower(F.trim(F.col(key if c == "id" else c).cast("string"))) for c in EXACT_FIELDS if c == "id" or c in df.columns]
    exact = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.array_compact(F.array(*values)))).alias("value"))
    durable(exact).repartitionByRange("value").sortWithinPartitions("value").select("value", "id").write.mode("overwrite").parquet(f"{path}/exact")
    return index


def near_terms(index: TextIndex, term: str, edits: int) -> list[str]:
    """Words of the dictionary within ``edits`` of ``term`` that do not begin with it; as many as the language has."""
    if edits <= VARIANT_EDITS and len(term) + edits <= VARIANT_LENGTH:
        some = index.table("variants").where(reduce(or_, [F.col("variant") == v for v in sorted(_deletions(term, edits))])).select("term").distinct()
    else:
        some = index.table("terms").where(F.length("term").between(len(term) - edits, len(term) + edits)).select("term")
    if edits <= VARIANT_EDITS and len(term) + edits <= VARIANT_LENGTH and sum(c not in "0123456789" for c in term) <= edits:  # so near to words of digits, which have no variants
        numbers = index.table("terms").where(F.length("term").between(len(term) - edits, len(term) + edits) & F.col("term").rlike(NUMBER))
        some = some.unionByName(numbers.select("term"))
    close = F.levenshtein("term", F.lit(term), edits).between(0, edits) & ~F.startswith("term", F.lit(term))
    return [r.term for r in some.where(close).collect()]


def postings_of(index: TextIndex, asked: list[str], near: list[list[str]], fields: list[str]) -> DataFrame:
    """The postings of every word that begins with an asked term or is near one, in the given fields."""
    words = [F.startswith("term", F.lit(t)) for t in asked] + [F.col("term") == w for w in sorted({w for some in near for w in some})]
    return index.table("postings").where(reduce(or_, words) & F.col("field").isin(fields))


def search_index(index: TextIndex, keywords: str, boosts: dict[str, float] | None = None, fuzzy: float = 0.0) -> DataFrame:
    """(id, terms, score) as ``search.search`` gives them, from the postings of the query's words only."""
    asked = asked_terms(keywords)
    statistics = {r.field: (r.rows, r.mean) for r in index.table("fields").collect()}  # one row a field
    fields = {f: w for f, w in (boosts or BOOSTS).items() if f in statistics}
    kind = index.table("postings").schema["id"].dataType.simpleString()
    if not asked or not fields:
        return index.spark.createDataFrame([], f"id {kind}, terms int, score double")
    near = [near_terms(index, t, edits) if (edits := edits_of(t, fuzzy)) else [] for t in asked]
    found = postings_of(index, asked, near, list(fields))
    aggregates = []
    for f in fields:
        own = F.col("field") == f
        aggregates.append(F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias(f"n_{f}"))
        for i, t in enumerate(asked):
            # whole and near words are counted apart, so that sums do not hang on the order of rows
            whole = F.sum(F.when(own & F.startswith("term", F.lit(t)), F.col("tf")).otherwise(0))
            close = F.sum(F.when(own & F.col("term").isin(near[i]), F.col("tf")).otherwise(0)) if near[i] else F.lit(0)
            aggregates += [whole.alias(f"w_{f}_{i}"), close.alias(f"c_{f}_{i}")]
    rows = durable(found.groupBy("id").agg(*aggregates))
    docs = {f"mean_{f}": statistics[f][1] for f in fields}
    return ranked(rows, fields, len(asked), "id", docs=max(n for n, _ in statistics.values()), means=docs)


def search_hits_index(index: TextIndex, keywords: str, boosts: dict[str, float] | None = None, fuzzy: float = 0.2) -> DataFrame:
    """(id, score) as ``search.search_hits`` gives them: exact rows first, then rows with all terms, or with any if there are none."""
    found = search_index(index, keywords, boosts, fuzzy)
    value = keywords.strip().lower()
    exact = index.table("exact").where(F.col("value") == value if len(value) >= 3 else F.lit(False)).select("id").distinct()
    return first_exact(found, exact, len(asked_terms(keywords)), "id")

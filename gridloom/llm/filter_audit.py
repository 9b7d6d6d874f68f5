"""Filter interaction audit by failing-id relations: what each filter removes in each order of filters.

Each filter has a table of the rows that fail it, keyed by id and text hash. The tables are joined with the
corpus one after the other: a left-semi join marks the rows that fail, a left-anti join keeps the
others. Rows that fail the same filters act alike in every order, so after these joins the corpus is
a small relation of classes (part, failed filters) with their numbers of rows and labels. Every
prefix of every order is then joined on these classes: its survivors are the classes that are left
by an anti join with the failing classes of the prefix, its filter's removals are the survivors'
semi join with the failing classes of that filter, its redundancies are the failing ones among the
classes that a semi join finds removed earlier, and label losses are the removed rows that carry a label.

Texts are read once, for the filters that look at one text and for a hash. Equal texts are found by that
hash, aggregated before it is shuffled; the smallest ids are written, so that the join of a hot text is split by rows. Repeated rows are counted before
the joins, and count as often as they stand.

Null texts are empty, a null part (or one that is '') is ''. A row with a null id has no labels and no smaller id, and is none.
Labels of an id that stand several times count once (any 1 makes it 1); labels of unknown ids are ignored.
Rows of one id with different texts are told apart by their text. Empty tables have an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import drop, save
from gridloom.llm.text_columns import UPPER

SPACES = r"[\x20\x09-\x0D]+"
#: Least words; least percent of distinct words; most percent of capitals; marks that fail a text.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, "#$%&*|"

#: A filter looks at (text without null, its words) and says whether the text fails.
Filter = Callable[[Column, Column], Column]

FILTERS: dict[str, Filter | None] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > UPPER_PERCENT * F.length(text),
    "D": lambda text, words: F.length(F.translate(text, MARKS, "")) < F.length(text),
    "E": None,  # equal to the text of a smaller id
}


def failing_tables(docs: DataFrame, filters: dict[str, Filter | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows of the corpus: id, hash, part, n; for each filter its failing ids: id, hash), all written.
    A filter that is None fails the texts that equal one of a smaller id."""
    own = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    split = own.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    judged = split.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("hash"),
        F.filter(F.array(*[F.when(test(F.col("text"), F.col("words")), F.lit(name)) for name, test in filters.items() if test]), lambda f: f.isNotNull()).alias("fails"),
    )
    judged = save(judged.groupBy("id", "hash", "part").agg(F.count("*").alias("n"), F.first("fails").alias("fails")), "judged")
    rows = judged.select("id", F.xxhash64("hash").alias("h"), "part", "n")
    tables = {name: judged.where(F.array_contains("fails", name)).select("id", F.xxhash64("hash").alias("h")).distinct() for name, test in filters.items() if test}
    if None in filters.values():
        least = save(judged.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hash", "least"), "least-ids")
        again = judged.join(least, "hash").where("id > least").select("id", F.xxhash64("hash").alias("h")).distinct()
        tables |= {name: again for name, test in filters.items() if not test}
    return rows, {name: save(tables[name], f"fails-{name}") for name in filters}


def failed_classes(rows: DataFrame, fails: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(part, failed: bits of the filters in their order, n, good, toxic): the corpus after a semi and an
    anti join with each failing table."""
    own = labels.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    now = save(rows.join(own, "id", "left").select("id", "h", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.lit(0).alias("failed")), "rows")
    for k, name in enumerate(fails):
        left, right = now.alias("l"), fails[name].alias("r")
        same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.h") == F.col("r.h"))
        failing = left.join(right, same, "left_semi").withColumn("failed", F.col("failed") + (1 << k))
        after = save(failing.unionByName(left.join(right, same, "left_anti")), "rows")
        drop(now)
        now = after
    out = save(now.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")), "classes")
    drop(now)
    return out


def audit(classes: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from the classes of failed filters."""
    spark = classes.sparkSession
    bit = {name: 1 << k for k, name in enumerate(names)}
    # (prefix as a set of bits, its next filter); a prefix's members are the filters in it
    prefixes = [(p, f) for p in range(1 << len(names)) for f in names if not p & bit[f]]
    fixed = F.broadcast(spark.createDataFrame(prefixes, "prefix int, filter string"))  # at most 2^(n-1) n rows
    fails = classes.select("part", "failed", "n", "good", "toxic", F.explode(F.array(*[F.when(F.col("failed").bitwiseAND(bit[f]) > 0, F.lit(f)) for f in names])).alias("filter")).where("filter IS NOT NULL")
    # classes that fail a member of a prefix
    members = F.broadcast(spark.createDataFrame([(p, f) for p in range(1 << len(names)) for f in names if p & bit[f]], "prefix int, filter string"))
    gone = fails.join(members, "filter").select("part", "failed", "prefix").distinct()
    # survivors of each prefix, and the failing ones of its next filter among them and among the removed
    everywhere = classes.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    key = ["part", "failed", "prefix"]
    survivors = everywhere.join(gone, key, "left_anti")
    alive = survivors.groupBy("part", "prefix").agg(F.sum("n").alias("alive"))
    meets = fails.join(fixed, "filter")
    removed = meets.join(survivors.select(*key), key, "left_semi")
    redundant = meets.join(gone, key, "left_semi")
    counts = removed.groupBy("part", "prefix", "filter").agg(F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    again = redundant.groupBy("part", "prefix", "filter").agg(F.sum("n").alias("redundant"))
    # a filter's own failures are what it removes after all others
    alone = counts.where(F.col("prefix") == sum(bit.values()) - F.element_at(F.create_map(*[F.lit(x) for f in names for x in (f, bit[f])]), F.col("filter"))).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = [("".join(order), k + 1, sum(bit[f] for f in order[:k]), f) for order in permutations(names) for k, f in enumerate(order)]
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter string"))  # n! n rows
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    of_prefix = (
        classes.select("part").distinct().withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)))).join(alive, ["part", "prefix"], "left").join(fixed, "prefix")
        .join(counts, ["part", "prefix", "filter"], "left").join(again, ["part", "prefix", "filter"], "left").join(alone, ["part", "filter"], "left")
        .select("part", "prefix", "filter", (number("alive") - number("removed")).alias("kept"), *[number(c).alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")])
    )
    out = of_prefix.join(table, ["prefix", "filter"])
    shares = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("good"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"))
    rows, fails = failing_tables(docs)
    classes = failed_classes(rows, fails, labels)
    for table in fails.values():
        drop(table)
    return audit(classes, list(fails))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), classes AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS idx
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT filter_order, idx, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), seen AS (
  SELECT part, filter_order, step, idx[step] AS own, n, good, toxic, fails[idx[step]] AS hit,
         list_bool_or(list_transform(idx[1:step - 1], lambda k: fails[k])) AS before,
         list_bool_or(list_transform(list_filter([1, 2, 3, 4, 5], lambda k: k <> idx[step]), lambda k: fails[k])) AS other
  FROM classes, steps
), counted AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT hit AND NOT coalesce(before, false) THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN hit AND NOT coalesce(before, false) THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN hit AND before THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN hit AND NOT other THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN hit AND NOT coalesce(before, false) THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN hit AND NOT coalesce(before, false) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted
"""

"""Checking a batch against stored key counts instead of the tables.

Keys and references can only be judged against all rows, but not by reading them: how often each value of a unique
key, of a reference and of a parent's key occurs is enough.  Those counts are stored in partitions by value.  A batch
looks up its own values, and those that its rows make a difference to, and the report over everything follows from the
stored report, the counts found and the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from campusflow.functions import count_where
from campusflow.operators.quality import ROW_KINDS, check_rules, row_violation
from campusflow.operators.updates import stored
from campusflow.schema import Rule
from campusflow.sources.load import load_literals
from campusflow.sources.partitions import rewrite_changed, save_partitioned, stored_rows

Tables = Mapping[str, DataFrame]
KEY = "Entry"
UNIQUE_KINDS = ("primary_key", "unique")


class KeyCounts:
    """The stored counts and report of some tables under some rules.

    Every unique key, reference and parent key is a *space* of values.  An entry is a value in a space, with the
    number of rows that hold it; rows with a NULL in the key have none.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: Iterable[Rule], report: str, parts: int = 64) -> None:
        self.spark, self.folder, self.rules, self.report_version, self.parts = spark, folder, list(rules), report, parts
        # (table, columns) of each space; a reference has one of its own, and its parent's key another.
        self.spaces: list[tuple[str, tuple[str, ...]]] = []
        self.unique: dict[int, int] = {}  # rule -> space
        self.child: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        for i, rule in enumerate(self.rules):
            if rule.kind in UNIQUE_KINDS:
                self.unique[i] = self._space(rule.table, tuple(rule.columns))
            elif rule.kind == "foreign_key":
                self.child[i] = self._space(rule.table, tuple(rule.columns))
                self.parent[i] = self._space(rule.parent, (rule.parent_key,))

    def _space(self, table: str, columns: tuple[str, ...]) -> int:
        if (table, columns) not in self.spaces:
            self.spaces.append((table, columns))
        return self.spaces.index((table, columns))

    @classmethod
    def create(cls, spark: SparkSession, tables: Tables, rules: Iterable[Rule], folder: str, parts: int = 64) -> KeyCounts:
        """Count whole tables once, into a new folder."""
        counts = cls(spark, folder, rules, uuid.uuid4().hex, parts)
        entries = counts._entries(tables).withColumn(KEY, _entry()).select(KEY, "n")
        save_partitioned(entries, f"{folder}/entries", KEY, parts)
        check_rules(tables, counts.rules).write.parquet(f"{folder}/report/{counts.report_version}")
        return counts

    def report(self) -> DataFrame:
        """``RuleID, TableName, Kind, Columns, Violations`` over all rows counted so far."""
        return self.spark.read.parquet(f"{self.folder}/report/{self.report_version}")

    def _entries(self, tables: Tables) -> DataFrame:
        """``space``, ``value``, ``n`` of the rows of the given tables; values are counted before any shuffle."""
        found = [load_literals(self.spark, [], StructType().add("space", IntegerType()).add("value", StringType())).withColumn("n", F.lit(0).cast("long"))]
        for space, (table, columns) in enumerate(self.spaces):
            if table in tables:
                known = tables[table].na.drop(subset=list(columns))
                value = F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
                counted = known.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
                found.append(counted.select(F.lit(space).alias("space"), "value", "n"))
        return reduce(DataFrame.unionByName, found)

    def _looked_up(self, batch: Tables) -> DataFrame:
        """``space``, ``value``, ``old`` and ``new`` counts of all values that the batch has a say in.

        Each step is stored, as several later ones read it: the batch is counted once.
        """
        new = stored(self._entries(batch).withColumnRenamed("n", "new"))
        partners = [(c, p) for c, p in zip(self.child.values(), self.parent.values(), strict=True)]
        pairs = sorted({*partners, *[(p, c) for c, p in partners]})
        schema = StructType().add("space", IntegerType()).add("other", IntegerType())
        related = new.join(load_literals(self.spark, pairs, schema), "space")
        related = related.select(F.col("other").alias("space"), "value", F.lit(0).cast("long").alias("new"))
        asked = stored(new.unionByName(related).groupBy("space", "value").agg(F.sum("new").alias("new")).withColumn(KEY, _entry()))
        old = stored_rows(self.spark, f"{self.folder}/entries", asked, KEY, self.parts)
        met = asked.join(old, KEY, "left").withColumn("old", F.coalesce("n", F.lit(0)))
        return stored(met.select(KEY, "space", "value", "old", "new"))

    def check(self, batch: Tables) -> DataFrame:
        """The report over all rows counted so far and the batch's; of the tables nothing is read."""
        return self._report(batch, self._looked_up(batch))

    def _report(self, batch: Tables, seen: DataFrame) -> DataFrame:
        def of_rules(spaces: Mapping[int, int], name: str) -> DataFrame:
            schema = StructType().add("RuleNo", IntegerType()).add(name, IntegerType())
            return load_literals(self.spark, list(spaces.items()), schema)

        def gain(column: str) -> Column:
            return F.sum(column).alias(column)

        # A value that was there makes every new row a repetition, a new one all but its first.
        keyed = seen.filter("new > 0").join(of_rules(self.unique, "space"), "space")
        found = [keyed.select("RuleNo", (F.col("new") - F.when(F.col("old") > 0, 0).otherwise(1)).alias("v"))]

        none = F.lit(0).cast("long")
        children = seen.join(of_rules(self.child, "space"), "space")
        children = children.select("RuleNo", "value", "old", "new", none.alias("old_parents"), none.alias("new_parents"))
        parents = seen.join(of_rules(self.parent, "space"), "space")
        parents = parents.select("RuleNo", "value", none.alias("old"), none.alias("new"), F.col("old").alias("old_parents"), F.col("new").alias("new_parents"))
        met = children.unionByName(parents).groupBy("RuleNo", "value")
        met = met.agg(gain("old"), gain("new"), gain("old_parents"), gain("new_parents"))
        before = F.when(F.col("old_parents") == 0, F.col("old")).otherwise(0)
        after = F.when(F.col("old_parents") + F.col("new_parents") == 0, F.col("old") + F.col("new")).otherwise(0)
        found.append(met.select("RuleNo", (after - before).alias("v")))

        for table, rows in batch.items():
            tests = {i: row_violation(r) for i, r in enumerate(self.rules) if r.table == table and r.kind in ROW_KINDS}
            tests |= {i: F.col(r.columns[0]).isNull() for i, r in enumerate(self.rules) if r.table == table and r.kind == "primary_key"}
            if tests:
                counts = rows.agg(*[count_where(test).alias(f"v{i}") for i, test in tests.items()])
                each = [F.struct(F.lit(i).alias("RuleNo"), F.col(f"v{i}").alias("v")) for i in tests]
                found.append(counts.select(F.inline(F.array(*each))))

        gained = reduce(DataFrame.unionByName, found).groupBy("RuleNo").agg(F.sum("v").alias("gained"))
        numbers = load_literals(self.spark, [(i, r.rule_id) for i, r in enumerate(self.rules)], StructType().add("RuleNo", IntegerType()).add("RuleID", StringType()))
        total = (F.col("Violations") + F.coalesce("gained", F.lit(0))).cast("long").alias("Violations")
        joined = self.report().join(numbers, "RuleID").join(gained, "RuleNo", "left")
        return joined.select("RuleID", "TableName", "Kind", "Columns", total)

    def add(self, batch: Tables) -> list[int]:
        """Count the batch's rows in; only partitions with one of its values are rewritten.  Returns them.

        The new report is written first, and holds once the counts are in.
        """
        seen = self._looked_up(batch)
        version = uuid.uuid4().hex
        self._report(batch, seen).write.parquet(f"{self.folder}/report/{version}")
        rows = seen.filter("new > 0").select(KEY, (F.col("old") + F.col("new")).alias("n"))
        touched = rewrite_changed(self.spark, f"{self.folder}/entries", rows, KEY, self.parts)
        self.report_version = version
        return touched


def _entry() -> Column:
    return F.concat(F.col("space").cast("string"), F.lit(":"), F.col("value"))

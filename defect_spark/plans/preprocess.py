"""The preprocessing chain: fitted once, its state kept, and replayed on new data.

The state holds names, at most 50 values of a column, fills and scales, so it is small at any
number of rows. Transforming is a dedupe and projections; columns dropped at the fit stay dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defect_spark.operators import cleaning, features


class PreprocessPlan:
    def __init__(self, state: dict | None = None):
        self.state = state

    def fit(self, df: DataFrame, key: str, target: str | None = None, k_features: int | None = None, most_values: int = 50) -> PreprocessPlan:
        """Cleans, imputes, encodes, scales and selects; key names the rows and is no feature.

        The order is: repeated rows, empty columns and rows, id columns, fills, rows without a
        target, encoding (two values to 0 and 1, up to ``most_values`` to indicators, others
        dropped), scaling of numbers, and the ``k_features`` with most information on the target.
        """
        target = target or cleaning.detect_target(df.drop(key))
        df = cleaning.drop_all_null_rows(cleaning.drop_duplicate_rows(df, key), key)
        df = cleaning.drop_id_columns(cleaning.drop_all_null_columns(df), keep=(key, target), protect_continuous=True)
        numbers = [c for c in cleaning.numeric_columns(df) if c not in (key, target)]
        texts = [c for c in cleaning.text_columns(df) if c not in (key, target)]
        fills = cleaning.fit_imputer(df, numbers, texts)
        df = cleaning.drop_null_target(cleaning.apply_imputer(df, fills), target)
        wide = features.high_cardinality(df, texts, most_values) if texts else []
        values = {c: cleaning.target_values(df, c) for c in texts if c not in wide}
        scales = features.fit_scaler(df, numbers).first().asDict() if numbers else {}
        made = numbers + [n for c in texts if c in values for n in self.names(c, values[c])]
        self.state = {"key": key, "target": target, "classes": cleaning.target_values(df, target), "numbers": numbers, "fills": fills, "values": values, "scales": scales, "selected": made}
        if k_features:
            bins = {c: f"cast(floor(2 * greatest(-6, least(6, `{c}`))) as int)" for c in made}
            scores = features.binned_mutual_info(self.transform(df), bins, target)
            best = {r.feature for r in features.select_k_best(scores, k_features).collect()}
            self.state["selected"] = [c for c in made if c in best]
        return self

    @staticmethod
    def names(column: str, values: list[str]) -> list[str]:
        """Two values make one column of the same name; more an indicator for each but the first."""
        return [column] if len(values) == 2 else [f"{column}_{v}" for v in values[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        """key, target (its rank among the fitted classes, null for a new one) and the features of new data."""
        if self.state is None:
            raise ValueError("fit the plan first")
        s = self.state
        wanted = [s["key"], s["target"], *s["numbers"], *s["values"]]
        df = cleaning.drop_all_null_rows(cleaning.drop_duplicate_rows(df, s["key"]), s["key"]).select(*(F.col(f"`{c}`") for c in wanted))
        df = cleaning.drop_null_target(cleaning.apply_imputer(df, s["fills"]), s["target"])
        made = {c: (F.col(f"`{c}`") - F.lit(s["scales"][f"mean_{c}"])) / F.lit(s["scales"][f"scale_{c}"]) for c in s["numbers"]}
        for c, values in s["values"].items():
            names = self.names(c, values)
            made |= {n: F.coalesce(F.col(f"`{c}`") == v, F.lit(False)).cast("int") for n, v in zip(names, values[1:])}
        code = F.array_position(F.array(*map(F.lit, s["classes"])), F.col(f"`{s['target']}`").cast("string"))
        label = F.when(code > 0, (code - 1).cast("int")).alias(s["target"])
        return df.select(s["key"], label, *(made[c].alias(c) for c in s["selected"]))

    def save(self, path: str, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> PreprocessPlan:
        return cls(json.loads(spark.read.text(path).first().value))

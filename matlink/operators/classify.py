"""Category classifier for texts that no rule recognises: character n-grams, TF-IDF, logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_grams(text: Column, lowest: int = 2, highest: int = 4) -> Column:
    """Character n-grams inside words, each word with a blank on both sides."""
    words = F.transform(F.filter(F.split(F.lower(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        return F.when(F.length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array(w))

    def grams(w: Column) -> Column:
        return F.concat(*(of(w, n) for n in range(lowest, highest + 1)))

    return F.flatten(F.transform(words, grams))


def train(rows: DataFrame, text_col: str = "norm_text", label_col: str = "category", vocabulary: int = 1 << 16) -> PipelineModel:
    """A model of rows with a text and a category; n-grams of fewer than two rows are left out.

    Rows of the label NONE teach it what belongs to no category.
    """
    stages = [
        StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="grams", outputCol="counts", minDF=2, vocabSize=vocabulary),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(regParam=0.01, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("grams", word_grams(F.col(text_col))))


def predict(model: PipelineModel, rows: DataFrame, text_col: str = "norm_text", threshold: float = 0.7) -> DataFrame:
    """rows with predicted (null below the threshold, and for the label NONE) and probability_of."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    rest = PipelineModel(model.stages[1:])
    out = rest.transform(rows.withColumn("grams", word_grams(F.col(text_col))))
    p = F.array_max(vector_to_array("probability"))
    label = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    return out.select(*rows.columns, F.when((p >= threshold) & (label != "NONE"), label).alias("predicted"), p.alias("probability_of"))

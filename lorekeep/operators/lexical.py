"""Weighted BM25 over several text columns, from tokens.

Statistics (number of rows, their mean length, rows of each phrase) cover every row given; filters belong on the result. One
aggregation makes one row of statistics, whatever the input, which meets the rows again by broadcast. A phrase is counted inside
its row, so ranking shuffles nothing but that one row and the top. A table that is searched more than once is indexed (index.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import TEXT_COLUMNS, WEIGHTS

# Saturation, length normalisation, and what an IDF of zero or less counts.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Token columns begin with this. They are columns of their own, not fields of a struct, as Catalyst would compute fields anew for each use.
PREFIX = "__tokens_"


def tokenized(events: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """events with an array of tokens for each text column. Store this for repeated queries."""
    return events.withColumns({PREFIX + c: text.tokens(F.col(c)) for c in columns})


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens; overlapping ones count each."""
    if len(phrase) == 1:
        word = F.lit(phrase[0])
        return F.size(F.filter(tokens, lambda x: x == word))
    # the array is bound to a name, as Catalyst would compute it anew for each place
    here = lambda t: lambda x, i: reduce(lambda a, b: a & b, [F.get(t, i + k) == F.lit(w) for k, w in enumerate(phrase[1:], 1)], x == F.lit(phrase[0]))
    return F.transform(F.array(tokens), lambda t: F.size(F.filter(t, here(t))))[0]


def rank(tokens: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of tokenized() that hold a phrase, with `score` (higher is better). A repeated term counts as often as it is given."""
    weights = weights or WEIGHTS
    columns = [c.removeprefix(PREFIX) for c in tokens.columns if c.startswith(PREFIX)]
    wanted = text.phrases(terms)
    distinct = [list(p) for p in dict.fromkeys(map(tuple, wanted))]
    kept = [c for c in tokens.columns if not c.startswith(PREFIX)]
    found = {"__len": sum((F.size(F.col(PREFIX + c)) for c in columns), F.lit(0))}
    for i, p in enumerate(distinct):
        found |= {f"__n{i}_{c}": occurrences(F.col(PREFIX + c), p) for c in columns}
    if not distinct:
        return tokens.limit(0).select(*kept).withColumn("score", F.lit(0.0))
    sums = {"__len": F.col("__len")}
    for i in range(len(distinct)):
        sums[f"__f{i}"] = sum((F.col(f"__n{i}_{c}") * F.lit(float(weights[c])) for c in columns), F.lit(0.0))
        sums[f"__n{i}"] = sum((F.col(f"__n{i}_{c}") for c in columns), F.lit(0))
    counted = tokens.withColumns(found).select(*kept, *(v.alias(k) for k, v in sums.items()))
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.sum("__len").alias("__total"), *(F.count_if(F.col(f"__n{i}") > 0).alias(f"__df{i}") for i in range(len(distinct))))
    scored = counted.where(" or ".join(f"__n{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(stats))
    norm = K1 * ((1 - B) + B * F.col("__len") * F.col("__n") / F.col("__total"))
    score = F.lit(0.0)
    for p in wanted:
        i = distinct.index(p)
        idf = F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        f = F.col(f"__f{i}")
        score = score + F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + norm)
    return scored.select(*kept, score.alias("score"))

"""Mapping of candidate source fields to target fields: features of pairs, ranking, assignment, calibration."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions import text as t

#: Fixed weights of the features of a pair.
WEIGHTS = {"lexical": 0.30, "alias": 0.25, "type": 0.15, "value": 0.15, "quality": 0.15}


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters by all characters, matched as longest blocks first."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def alias_matches(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(candidate columns, target_id, match): exact and alias matches by an equality join of normalised names."""
    names = targets.select("target_id", F.explode(F.concat(F.array("target_id"), "aliases")).alias("alias"), F.col("target_id").alias("own"))
    keyed = names.select("target_id", t.normalize_name(F.col("alias")).alias("_key"), F.when(F.col("alias") == F.col("own"), "exact").otherwise("alias").alias("match"))
    best = keyed.groupBy("_key", "target_id").agg(F.max("match").alias("match"))
    return candidates.withColumn("_key", t.normalize_name(F.col("source_name"))).join(best, "_key").drop("_key")


def type_score(kind: Column, target: Column) -> Column:
    return F.when(kind == target, 1.0).when(kind.isin("string", "text") & target.isin("string", "text", "enum"), 0.9).when((kind == "date") & (target == "datetime"), 0.85).when(target == "text", 0.6).otherwise(0.4)


def value_score(sample: Column, target: Column) -> Column:
    filled = sample.isNotNull() & (F.trim(sample) != "")
    return (
        F.when(target == "number", F.when(t.normalize_number(sample).isNotNull(), 1.0).otherwise(0.2))
        .when(target == "date", F.when(t.normalize_date(sample).isNotNull(), 1.0).otherwise(0.2))
        .otherwise(F.when(filled, 0.8).otherwise(0.2))
    )


def pair_features(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each candidate and target of one schema, with features and their weighted score.

    targets is a configuration of a few rows; names are compared once for each distinct pair. candidates(doc_id, schema_id, source_path,
    source_name, sample, kind), targets(schema_id, target_id, target_type, aliases, required).
    """
    config = targets.select("schema_id", "target_id", "target_type", "aliases", "required")
    names = candidates.select("schema_id", "source_name").distinct().join(config, "schema_id")
    key, own = t.normalize_name(F.col("source_name")), t.normalize_name(F.col("target_id"))
    alias = F.when(key == own, 1.0).when(F.exists("aliases", lambda a: t.normalize_name(a) == key), 0.9).otherwise(0.0)
    names = names.select("schema_id", "source_name", "target_id", "target_type", "required", alias.alias("alias"), similarity(key, own).alias("lexical"))
    pairs = candidates.join(names, ["schema_id", "source_name"])
    scored = pairs.withColumns({"type": type_score(F.col("kind"), F.col("target_type")), "value": value_score(F.col("sample"), F.col("target_type")), "quality": F.when(F.trim(F.coalesce("sample", F.lit(""))) == "", 0.5).otherwise(1.0)})
    return scored.withColumn("score", F.round(sum(F.col(k) * w for k, w in WEIGHTS.items()), 4))


def ranked(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k best candidates of each document and target, with the margin to the next; ties go to the smaller path."""
    w = W.partitionBy("doc_id", "target_id").orderBy(F.desc("score"), "source_path")
    return pairs.withColumns({"rank": F.row_number().over(w), "margin": F.round(F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)), 4)}).where(F.col("rank") <= k)


def best_assignment(score: np.ndarray) -> list[int]:
    """Column of each row in a one-to-one assignment of the greatest sum, or -1 where abstaining (worth 0) is better. Shortest augmenting paths."""
    rows, real = score.shape
    cost = np.hstack([-score, np.where(np.eye(rows, dtype=bool), 0.0, 1e6)])  # each row has a column of its own for abstaining
    u, v = np.zeros(rows + 1), np.zeros(cost.shape[1] + 1)
    match, way = np.zeros(cost.shape[1] + 1, int), np.zeros(cost.shape[1] + 1, int)
    for i in range(1, rows + 1):
        match[0], at = i, 0
        least, used = np.full(cost.shape[1] + 1, np.inf), np.zeros(cost.shape[1] + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            slack = cost[row - 1] - u[row] - v[1:]
            closer = ~used[1:] & (slack < least[1:])
            least[1:][closer], way[1:][closer] = slack[closer], at
            free = np.where(used[1:], np.inf, least[1:])
            to = int(free.argmin()) + 1
            step = free[to - 1]
            u[match[used]] += step
            v[used] -= step
            least[1:][~used[1:]] -= step
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [-1] * rows
    for j in range(1, real + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assigned(pairs: DataFrame, least: float = 0.45, accept: float = 0.82, review: float = 0.70) -> DataFrame:
    """(doc_id, target_id, source_path, score, status): the greatest total score with each source used once; pairs below `least` never.

    Where each target's best source is another, these are the assignment, and the document stays in the JVM. The fields of other documents
    meet in one row, and they are as many as a form has; these rows are solved in Arrow batches. Equal sums go to targets and paths in order.
    """
    best = pairs.where(F.col("score") >= least).groupBy("doc_id", "target_id").agg(F.min(F.struct((-F.col("score")).alias("down"), "source_path", "score")).alias("x"))
    winners = best.groupBy("doc_id").agg(F.collect_list(F.struct("target_id", "x.source_path", "x.score")).alias("won"))
    clash = F.size(F.array_distinct(F.transform("won", lambda w: w["source_path"]))) < F.size("won")
    plain = winners.where(~clash).select("doc_id", F.explode("won").alias("w")).select("doc_id", "w.*")
    forms = pairs.join(winners.where(clash).select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "source_path", "score", "required"))).alias("pairs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [tuple((x["target_id"], x["source_path"], x["score"], x["required"]) for x in form) for form in batch["pairs"]]
            found = [(doc, *x) for doc, form in zip(batch["doc_id"], keys, strict=True) for x in _solved(form, least)]
            yield pd.DataFrame(found, columns=["doc_id", "target_id", "source_path", "score"])

    taken = plain.unionByName(forms.mapInPandas(solve, "doc_id long, target_id string, source_path string, score double"))
    return taken.withColumn("status", F.when(F.col("score") >= accept, "accepted").when(F.col("score") >= review, "review").otherwise("dropped"))


@lru_cache(maxsize=4096)
def _solved(form: tuple[tuple, ...], least: float) -> list[tuple[str, str, float]]:
    """(target, path, score) of one document's assignment by its pairs (target, path, score, required); forms with equal scores, of which a corpus has few, are solved once a task."""
    targets, paths, scores, required = zip(*form, strict=True)
    rows, i = np.unique(targets, return_inverse=True)
    columns, j = np.unique(paths, return_inverse=True)
    s, need = np.full((len(rows), len(columns)), -np.inf), np.zeros(len(rows))
    np.maximum.at(s, (i, j), np.array(scores, float))
    np.maximum.at(need, i, np.array(required, float))
    got = best_assignment(np.where(s >= least, s + 1e-6 * need[:, None], -1e5))
    return [(str(rows[r]), str(columns[c]), float(s[r, c])) for r, c in enumerate(got) if c >= 0]


#: Fixed weights of what a mapping's rank is made of, and its risk penalties.
RANK_WEIGHTS = {"label": 0.35, "evidence": 0.30, "context": 0.20, "type": 0.10, "quality": 0.05}
RISKS = {"forbidden": 1.0, "high": 0.5, "medium": 0.2, "weak": 0.25, "alias": 0.15, "no_path": 0.4}
#: Fixed confidence of each strategy of the cascade, in its order.
CONFIDENCE = {"exact": 1.0, "alias": 0.95, "regex": 0.92, "hint": 0.86, "type": 0.74, "fuzzy": 0.62}


def risk_penalty(flags: dict[str, Column]) -> Column:
    """Sum of the penalties of the risks that hold, 1 at most."""
    return F.least(F.lit(1.0), sum(F.when(c, RISKS[k]).otherwise(0.0) for k, c in flags.items()))


def ranking(features: dict[str, Column], risk: Column) -> Column:
    """The weighted features without the risk, between 0 and 1."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(F.coalesce(features[k], F.lit(0.0)) * w for k, w in RANK_WEIGHTS.items()) - risk)), 4)


def decision(score: Column, blocked: Column, fuzzy: Column, accept: float = 0.82) -> Column:
    """blocked over review over accepted; a fuzzy match is always reviewed."""
    return F.when(blocked, "blocked").when(fuzzy | (score < accept), "review").otherwise("accepted")


def cascade(candidates: DataFrame, targets: DataFrame, patterns: dict[str, str], no_fuzzy: tuple[str, ...] = (), least: float = 0.55) -> DataFrame:
    """(doc_id, target_id, strategy, source_path, confidence): for each document and target the first strategy that finds a source.

    In order: exact and alias names, a target's pattern over the values, the candidate's hints, the first text for a text target, and fuzzy
    names of at least `least` similarity (never for no_fuzzy). Ties go to the smaller path. candidates(doc_id, source_path, source_name, sample,
    kind, hints); targets(target_id, target_type, aliases) is a configuration of a few rows, joined by equality of names, hints and types, and
    compared by similarity once for each distinct name.
    """
    order = list(CONFIDENCE)
    pick = lambda df, strategy: df.select("doc_id", "target_id", F.lit(order.index(strategy)).alias("place"), "source_path")
    named = alias_matches(candidates, targets)
    found = [named.select("doc_id", "target_id", F.when(F.col("match") == "exact", 0).otherwise(1).alias("place"), "source_path")]
    for target, pattern in patterns.items():
        found.append(pick(candidates.where(F.col("sample").rlike(pattern)).withColumn("target_id", F.lit(target)), "regex"))
    found.append(pick(candidates.withColumn("target_id", F.explode("hints")).join(targets.select("target_id"), "target_id", "left_semi"), "hint"))
    texts = targets.where("target_type = 'text'").select("target_id", F.lit("string").alias("kind"))
    found.append(pick(candidates.where(F.trim("sample") != "").join(texts, "kind"), "type"))
    names = candidates.select("source_name").distinct()
    key = lambda c: t.normalize_name(F.col(c))
    # a row for each distinct source name and target of the configuration: both are field names, not documents
    near = names.withColumn("x", F.explode(F.lit([r["target_id"] for r in targets.select("target_id").collect() if r["target_id"] not in no_fuzzy]))).select("source_name", F.col("x").alias("target_id"))
    near = near.withColumn("near", similarity(key("source_name"), key("target_id"))).where(F.col("near") >= least)
    best = candidates.join(near, "source_name").groupBy("doc_id", "target_id").agg(F.min(F.struct((-F.col("near")).alias("down"), "source_path")).alias("x"))
    found.append(best.select("doc_id", "target_id", F.lit(order.index("fuzzy")).alias("place"), "x.source_path"))
    one = reduce(DataFrame.unionByName, found).groupBy("doc_id", "target_id").agg(F.min(F.struct("place", "source_path")).alias("x"))
    return one.select("doc_id", "target_id", F.element_at(F.array(*map(F.lit, order)), F.col("x.place") + 1).alias("strategy"), "x.source_path", F.element_at(F.array(*map(F.lit, CONFIDENCE.values())), F.col("x.place") + 1).alias("confidence"))


def repaired(pairs: DataFrame, taken: DataFrame, accept: float = 0.82, review: float = 0.62) -> DataFrame:
    """(doc_id, target_id, source_path, score, status): required targets without a source get, in order of id, the best path not used yet.

    pairs(doc_id, target_id, source_path, score, required), taken(doc_id, target_id, source_path). A fold over a document's few required
    targets, in the JVM; equal scores go to the smaller path.
    """
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "source_path")))
    lists = pairs.where(F.col("required") & (F.col("score") >= review)).groupBy("doc_id", "target_id").agg(best_first.alias("paths"))
    open_ = lists.join(taken.select("doc_id", "target_id"), ["doc_id", "target_id"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "paths"))).alias("open"))
    rows = open_.join(taken.groupBy("doc_id").agg(F.collect_set("source_path").alias("used")), "doc_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    start = F.struct(F.col("used").alias("used"), F.array().cast("array<struct<target_id:string,source_path:string,score:double>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["paths"], lambda p: ~F.array_contains(acc["used"], p["source_path"]))
        first = F.try_element_at(free, F.lit(1))
        got = F.struct(x["target_id"].alias("target_id"), first["source_path"].alias("source_path"), (-first["down"]).alias("score"))
        return F.when(F.size(free) > 0, F.struct(F.concat(acc["used"], F.array(first["source_path"])).alias("used"), F.concat(acc["got"], F.array(got)).alias("got"))).otherwise(acc)

    got = rows.select("doc_id", F.explode(F.aggregate("open", start, step, lambda acc: acc["got"])).alias("x")).select("doc_id", "x.*")
    return got.withColumn("status", F.when(F.col("score") >= accept, "accepted").otherwise("review"))


def pooled(bins: list[tuple[float, float]]) -> list[float]:
    """Non-decreasing rates of bins (positives, rows) by pooling neighbours that fall; at most a few bins, on the driver."""
    out: list[list[float]] = []
    for p, n in bins:
        out.append([p, n, 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] > out[-1][0] * out[-2][1]:
            last = out.pop()
            out[-1] = [a + b for a, b in zip(out[-1], last, strict=True)]
    return [p / n if n else 0.0 for p, n, k in out for _ in range(int(k))]


"""Film revenue-tier classification (BQP2, SURVEY 2-N).

Film-grain features come from one aggregate of the fact; labels and medians
from exact distributed quantiles.  Both candidate models, for every fold and
for all films, are grown by ``operators.ensembles``: quantile-binned numbers,
one-value-against-the-rest splits of the categories (what one-hot columns
would give), one pass over the rows for all trees that can grow together.
The driver holds bin edges, category lists, class counts and the models.

Fold assignment is stratified without a per-class window: films are ranked
globally on (tier, hash(bk_film, seed)) with the range-partitioned rank of
``surrogate_key``; rank within the tier = global rank − the tier's first
rank; fold = rank mod k.  Classes of any size are split across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.clean import or_unknown, runtime_segment
from marquee.operators import ensembles as E
from marquee.operators.keys import keep_first, surrogate_key
from marquee.operators.quantiles import exact_quantiles
from marquee.operators.trees import Columns
from marquee.plans.warehouse import _parallel, film_totals
from marquee.session import materialize
from marquee.sources import adapter
from marquee.sources.io import conform, write_table
from marquee.sources.schemas import ML_OUTPUT

# --- fixed values: feature lists and model settings of the reference -----
NUM_COLS = ("film_runtime_min", "film_budget_usd", "imdb_rating", "rt_rating",
            "film_awards_won", "film_awards_nominations")
CAT_COLS = ("film_genre", "film_age_classification", "release_season")
TIER_CUTS = (0.33, 0.66)
TIERS = ("Low", "Mid", "High")
SEED = 42
FOLDS = 5
PREDICTION_COLS = ("bk_film", "film_title", "film_genre", "runtime_segment", "release_season", "film_age_classification", "predicted_tier")
BINS = 64                        # of a numeric column, at quantiles of the training films


@dataclass
class Candidate:
    name: str
    kind: str                      # "rf" | "gbt"
    params: dict = field(default_factory=dict)


RF = Candidate("RF", "rf", dict(numTrees=300, maxDepth=8, minInstancesPerNode=3))
GBM = Candidate("GBM", "gbt", dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8))
CANDIDATES = (RF, GBM)


def tier_features(w: dict[str, DataFrame]) -> DataFrame:
    """N1 + C3 + E2: one row per film with revenue (0 when none), release
    season of its first day, runtime segment; duplicates of bk_film keep the
    smallest surrogate key.  A stage boundary: the quantiles of the labels
    and of the imputation read it several times."""
    per = film_totals(w)
    film = w["dim_film"]
    d = w["dim_date"].select("sk_date", F.col("calendar_season").alias("release_season"))
    j = (film.join(per, film["sk_film"] == per["fk_film"], "left")
         .join(d, F.col("first_date_key") == d["sk_date"], "left"))
    cols = ["sk_film", "bk_film", "film_title", *CAT_COLS[:2], "release_season", *NUM_COLS]
    df = j.select(*[F.col(c).cast("double").alias(c) if c in NUM_COLS else F.col(c) for c in cols],
                  F.coalesce(F.col("rev"), F.lit(0)).cast("double").alias("total_revenue"))
    df = keep_first(df, ["bk_film"], [F.col("sk_film")])
    return materialize(df.withColumn("runtime_segment", runtime_segment("film_runtime_min")), "tier-films")


def tier_labels(df: DataFrame) -> DataFrame:
    """Exact terciles of revenue over films with revenue > 0."""
    r = F.col("total_revenue")
    q33, q66 = (F.lit(q) for q in exact_quantiles(df, {"r": TIER_CUTS}, {"r": F.when(r > 0, r)})["r"])
    tier = F.when(r <= 0, F.lit(None).cast("string")).when(r >= q66, "High").when(r >= q33, "Mid").otherwise("Low")
    return df.withColumn("tier", tier)


def impute(df: DataFrame) -> DataFrame:
    """Numeric medians over all (deduplicated) films; categories ->
    'Unknown'."""
    med = exact_quantiles(df, {c: [0.5] for c in NUM_COLS})
    fills = {c: F.coalesce(F.col(c), F.lit(med[c][0] if med[c][0] is not None else 0.0)) for c in NUM_COLS}
    fills.update({c: or_unknown(c) for c in CAT_COLS})
    return df.withColumns(fills)


def stratified_folds(df: DataFrame, label: str = "tier", key: str = "bk_film", k: int = FOLDS,
                     seed: int = SEED) -> DataFrame:
    """fold = (rank inside the class by hash(key, seed)) mod k."""
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = surrogate_key(h, [label, "_h", key], "_rk", dtype="long")
    first = ranked.groupBy(label).agg(F.min("_rk").alias("_first"))
    return ranked.join(first, label).withColumn(
        "fold", ((F.col("_rk") - F.col("_first")) % k).cast("int")).drop("_h", "_rk", "_first")


@dataclass(frozen=True)
class Encoding:
    """Bin edges of the numeric columns and values of the categories, as
    found in the training films; another category is none of them."""
    edges: dict[str, list[float]]
    values: dict[str, list[str]]

    @property
    def columns(self) -> Columns:
        sizes = [len(self.values[c]) + 1 for c in CAT_COLS] + [len(self.edges[c]) + 1 for c in NUM_COLS]
        return Columns(tuple(sizes), (False,) * len(CAT_COLS) + (True,) * len(NUM_COLS))

    def features(self) -> list[tuple[int, str]]:
        """(cell, name) of every feature."""
        base = self.columns.base
        out = [(int(base[i]) + k, f"{c}={v}") for i, c in enumerate(CAT_COLS) for k, v in enumerate(self.values[c])]
        return out + [(int(base[len(CAT_COLS) + i]), c) for i, c in enumerate(NUM_COLS)]


def encoding(train: DataFrame, bins: int = BINS) -> Encoding:
    cuts = exact_quantiles(train, {c: [i / bins for i in range(1, bins)] for c in NUM_COLS})
    values: dict[str, list[str]] = {c: [] for c in CAT_COLS}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in CAT_COLS]))
    for r in train.select(cells.alias("x")).select("x.*").distinct().orderBy("c", "v").collect():
        values[r["c"]].append(r["v"])
    return Encoding({c: sorted({q for q in qs if q is not None}) for c, qs in cuts.items()}, values)


def encode(films: DataFrame, e: Encoding) -> DataFrame:
    """(bk_film, key, label, fold, bins) of imputed films with tier and fold;
    label and fold are -1 for films without a tier."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        numbers = [{v: i for i, v in enumerate(e.values[c])} for c in CAT_COLS]
        for batch in batches:
            cells = [[own.get(v, len(own)) for v in batch.column(4 + i).to_pylist()] for i, own in enumerate(numbers)]
            first = 4 + len(CAT_COLS)
            cells += [np.searchsorted(e.edges[c], batch.column(first + i).to_numpy(zero_copy_only=False)) for i, c in enumerate(NUM_COLS)]
            bins = np.array(cells, "<i4").T
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b.tobytes() for b in np.ascontiguousarray(bins)], pa.binary())], names=["bk_film", "key", "label", "fold", "bins"])

    label = F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce("tier", F.lit(""))) - 1
    read = films.select("bk_film", F.xxhash64("bk_film").alias("key"), label.cast("int").alias("label"), F.coalesce("fold", F.lit(-1)).alias("fold"), *CAT_COLS, *NUM_COLS)
    return read.mapInArrow(run, "bk_film string, key long, label int, fold int, bins binary")


def scores(counts: list[tuple[float, float, int]]) -> tuple[float, float]:
    """Accuracy and F1 weighted by class size, of (label, prediction, rows)."""
    total = sum(n for *_, n in counts)
    f1 = 0.0
    for label in {y for y, _, _ in counts}:
        size = sum(n for y, _, n in counts if y == label)
        given = sum(n for _, p, n in counts if p == label)
        right = sum(n for y, p, n in counts if y == p == label)
        f1 += size * (2 * right / (size + given))
    return sum(n for y, p, n in counts if y == p) / total, f1 / total


def train(rows: DataFrame, c: Candidate, sample: E.Sample, columns: Columns) -> tuple[E.Forest | E.Boosting, DataFrame]:
    """The model of every fit, and the rows with their scores (class shares
    of a forest, raw scores of boosting)."""
    p = c.params
    if c.kind == "rf":
        return E.scored_forest(rows, sample, columns, p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], SEED)
    return E.train_boosting(rows, sample, columns, p["maxIter"], p["maxDepth"], p["stepSize"], p["subsamplingRate"], SEED)


def evaluate(candidates, scored: dict[str, DataFrame], k: int) -> list[tuple]:
    """Per candidate and fold, train and test accuracy and weighted F1;
    all four come from one count of (fold, split, label, prediction)."""
    out = []
    for c in candidates:
        counts = E.fold_counts(scored[c.name], k, len(TIERS))
        out += [(c.name, fold, *scores(counts[fold, False]), *scores(counts[fold, True])) for fold in range(k)]
    return out


def choose(cv: DataFrame, candidates) -> Candidate:
    """Highest mean test F1, of equal ones the earlier candidate."""
    means = {r["model"]: r["f1"] for r in cv.groupBy("model").agg(F.avg("test_f1").alias("f1")).collect()}
    return max(candidates, key=lambda c: means.get(c.name, 0.0))


def predictions(scored: DataFrame, films: DataFrame, kind: str, k: int) -> DataFrame:
    """Tier and confidence of every film by the fit on all labelled
    ones.  B37: the largest class probability, rounded to 4 places; raw
    scores of boosting become probabilities by softmax."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(batch.num_rows, k + 1, len(TIERS))[:, k]
            share = own if kind == "rf" else E.softmax(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([TIERS[i] for i in share.argmax(1).tolist()], pa.string()), pa.array(share.max(1))], names=["key", "predicted_tier", "share"])

    given = scored.mapInArrow(run, "key long, predicted_tier string, share double")
    joined = films.withColumn("key", F.xxhash64("bk_film")).join(given.dropDuplicates(["key"]), "key")
    return joined.select(*PREDICTION_COLS, F.round("share", 4).alias("tier_confidence"))


def importances(spark, model: E.Forest | E.Boosting, e: Encoding, k: int) -> DataFrame:
    """Share of the impurity decrease by feature, of the fit on all."""
    found = model.importances(k)
    rows = sorted(((name, float(found[cell])) for cell, name in e.features()), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


@dataclass
class TierRun:
    features: DataFrame
    cv: DataFrame
    winner: Candidate
    model: E.Forest | E.Boosting
    predictions: DataFrame
    importances: DataFrame


def run(w: dict[str, DataFrame], candidates=CANDIDATES, k: int = FOLDS) -> TierRun:
    """N1-N10 end to end."""
    feats = materialize(impute(tier_labels(tier_features(w))), "tier-features")
    spark = feats.sparkSession
    hist = feats.filter(F.col("tier").isNotNull())
    folds = stratified_folds(hist, k=k).select(F.col("bk_film").alias("_film"), "fold")
    films = materialize(feats.join(folds, F.col("bk_film") == F.col("_film"), "left").drop("_film"), "tier-folds")
    e = encoding(films.filter(F.col("tier").isNotNull()))
    rows = materialize(E.partitioned(encode(films, e).drop("bk_film"), films.count()), "tier-rows")
    sample = E.sample_of(rows, k, len(TIERS))
    # side by side, and boosting first: it has the fewest and longest tasks
    trained = _parallel({c.name: (lambda c=c: train(rows, c, sample, e.columns)) for c in sorted(candidates, key=lambda c: c.kind != "gbt")})
    models, scored = ({name: made[i] for name, made in trained.items()} for i in (0, 1))
    cv = spark.createDataFrame(evaluate(candidates, scored, k), "model string, fold int, train_accuracy double, train_f1 double, test_accuracy double, test_f1 double")
    best = choose(cv, candidates)
    return TierRun(feats, cv, best, models[best.name], predictions(scored[best.name], feats, best.kind, k), importances(spark, models[best.name], e, k))


def where_to_invest(trend: DataFrame, predictions: DataFrame) -> DataFrame:
    """P5: growing genres x share of films predicted High x projection."""
    share = predictions.filter(F.col("film_genre") != "Unknown").groupBy("film_genre").agg(
        F.count(F.lit(1)).alias("n_films"),
        F.avg((F.col("predicted_tier") == "High").cast("double")).alias("high_tier_share"))
    g = trend.filter(F.col("genre_trend") == "Growing")
    return g.join(share, "film_genre").select("film_genre", "genre_projected_revenue", "n_films", "high_tier_share")


def write_outputs(spark, trend: DataFrame, tiers: DataFrame, root: str) -> dict[str, DataFrame]:
    """The two result tables in their declared layout, overwritten,
    the trends first, and read back.  Called after the load of the tables that
    they are derived from."""
    for name, table in (("ml_genre_trends", trend), ("ml_tier_predictions", tiers)):
        write_table(conform(table, ML_OUTPUT[name]), f"{root.rstrip('/')}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}") for name, schema in ML_OUTPUT.items()}


_RUNS: dict = {}


def run_once(spark, sf_dir: str, loader, candidates=CANDIDATES) -> TierRun:
    """One tier run per (application, folder, candidate set); the CV table,
    predictions and importances of that run serve every ML query."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), adapter._stamp(spark, sf_dir), tuple(c.name for c in candidates))
    if key not in _RUNS:
        r = run(loader(spark, sf_dir), candidates)
        r.predictions = materialize(r.predictions, "tier-predictions")
        _RUNS[key] = r
    return _RUNS[key]

"""Data expectations, nearest-neighbour classification and its reports (ML-*)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.draws import uniform

IRIS_BOUNDS = {"sepal_length": (4.5, 8.0), "sepal_width": (2.1, 4.5), "petal_length": (1.2, 7.0), "petal_width": (0.2, 2.5)}
_RANGES = {"Virginica": ((5.5, 8), (2.2, 3.8), (4.5, 7), (1.4, 2.5)), "Versicolor": ((4.5, 7.5), (2.1, 3.5), (3.1, 5.5), (1.0, 1.8)), "Setosa": ((4.5, 6), (2.3, 4.5), (1.2, 2), (0.3, 0.7))}


def random_flowers(spark, n: int, seed: int = 1) -> DataFrame:
    """n rows (id, four measures, variety): a class at random, then each measure evenly in the class's range."""
    names = list(IRIS_BOUNDS)
    drawn = spark.range(n).withColumn("pick", F.floor(F.rand(seed) * len(_RANGES)).cast("int"))
    for i, name in enumerate(names):
        bounds = F.array(*[F.array(F.lit(float(r[i][0])), F.lit(float(r[i][1]))) for r in _RANGES.values()])[F.col("pick")]
        drawn = drawn.withColumn(name, bounds[0] + F.rand(seed + 1 + i) * (bounds[1] - bounds[0]))
    return drawn.withColumn("variety", F.array(*[F.lit(v) for v in _RANGES])[F.col("pick")]).drop("pick")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, mean, least, most) of numeric columns, in one pass."""
    aggs = [f(F.col(c)).alias(f"{c}|{k}") for c in columns for k, f in (("n", F.count), ("nulls", lambda x: F.count_if(x.isNull())), ("mean", F.avg), ("least", F.min), ("most", F.max))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("n"), F.col(f"{c}|nulls").alias("nulls"), F.col(f"{c}|mean").cast("double").alias("mean"), F.col(f"{c}|least").cast("double").alias("least"), F.col(f"{c}|most").cast("double").alias("most")) for c in columns])
    return df.agg(*aggs).select(F.inline(rows))


def violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, violations): values outside their closed range; nulls count."""
    bad = [F.count_if(~F.coalesce(F.col(c).between(lo, hi), F.lit(False))).alias(c) for c, (lo, hi) in bounds.items()]
    return df.agg(*bad).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in bounds])))


def require(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """df itself, or an error that names the columns with values out of range."""
    bad = {r["column"]: r["violations"] for r in violations(df, bounds).filter("violations > 0").collect()}
    if bad:
        raise ValueError(f"values out of range: {bad}")
    return df


def feature_view(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """df's features as one vector, with its label; rows with a null feature are left out."""
    from pyspark.ml.feature import VectorAssembler

    named = df.select(*features, F.col(label).alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(named).select("features", "label")


def insert_features(group: str, rows: DataFrame, key: list[str], order: str | None = None) -> None:
    """Add rows to a stored feature group; readers see the last row of each key."""
    rows.withColumn("_batch", F.expr("unix_micros(current_timestamp())") if order is None else F.col(order).cast("long")).write.mode("append").parquet(group)


def read_features(spark, group: str, key: list[str]) -> DataFrame:
    """The rows of a feature group, one a key, the one added last."""
    rows = spark.read.parquet(group)
    names = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "_batch").alias("_s")).select(*key, "_s.*")


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a draw from the key, the same in every run."""
    u = uniform(seed, F.col(key))
    return df.filter(u >= test), df.filter(u < test)


#: Rows that one task compares with as many others; queries of them at a time.
KNN_BLOCK, KNN_STEP = 32_768, 256


def _matrix(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ids, vectors as doubles) of the rows whose vector has ``dim`` finite numbers."""
    vec = rows["vec"].combine_chunks()
    at = np.flatnonzero(pc.list_value_length(vec).to_numpy(zero_copy_only=False) == dim)
    x = vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    good = np.isfinite(x).all(axis=1)
    at, x = at[good], x[good]
    return at, np.array(rows["id"].take(pa.array(at)).to_pylist()), x


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(rows of q, rows of x, squared distances): the k nearest of x to each row of q, without those of its own id, by (distance, id).

    Products of float32 matrices find the few rows that may be among them: every row whose distance, less the
    most that rounding adds, isn't beyond the k-th. Those are measured in doubles, dimension by dimension, as SQL adds them.
    """
    dim = x.shape[1]
    middle = x.mean(axis=0) if len(x) else np.zeros(dim)
    size = max(np.abs(x - middle).max(initial=0), np.abs(q - middle).max(initial=0)) or 1.0
    xs, qs = ((v - middle) / size for v in (x, q))
    x32, q32 = xs.astype(np.float32), qs.astype(np.float32)
    far_x, far_q = (xs * xs).sum(axis=1), (qs * qs).sum(axis=1)
    slack = (dim + 16) * 2.0**-22 * (np.sqrt(far_q) + np.sqrt(far_x.max(initial=0))) ** 2
    half = (far_x / 2).astype(np.float32)
    order = np.argsort(ids, kind="stable")
    left, right = np.searchsorted(ids[order], q_ids, "left"), np.searchsorted(ids[order], q_ids, "right")
    group = 64
    for a in range(0, len(q), KNN_STEP):
        d = half - q32[a : a + KNN_STEP] @ x32.T  # half the distance, less what is the same for a row of q
        for i in np.flatnonzero((right > left)[a : a + KNN_STEP]):
            d[i, order[left[a + i] : right[a + i]]] = np.inf
        whole = d.shape[1] // group * group
        least = d[:, :whole].reshape(len(d), -1, group).min(axis=2) if whole >= group * 4 * k else d
        most = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(d), np.inf)
        i, j = np.nonzero((d <= (most + slack[a : a + KNN_STEP])[:, None]) & (d < np.inf))
        far = np.zeros(len(i))
        for c in range(dim):
            far += (x[j, c] - q[a + i, c]) ** 2
        fine = np.isfinite(far)
        i, j, far = i[fine], j[fine], far[fine]
        best = np.lexsort((ids[j], far, i))
        i, j, far = i[best], j[best], far[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield a + i[kept], j[kept], far[kept]


def knn(train: DataFrame, queries: DataFrame, k: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, prediction): the majority of the k nearest other rows by Euclidean distance; of equal votes the nearest decides, of equal distances the lesser key.

    Both sides are cut into blocks of at most about KNN_BLOCK rows; a task compares two blocks and gives the k
    best of each query, so what is shuffled beyond the blocks is k rows for each query and block. Every query
    is compared with every row, so the time is quadratic. Rows with a null vector, or one of another length
    than the query's, are no neighbours.
    """
    kinds = {d.schema[vector].dataType.simpleString() for d in (train, queries)}
    vec = F.col(vector).cast("array<float>" if kinds == {"array<float>"} else "array<double>").alias("vec")
    t = train.select(F.col(key).alias("id"), vec, F.col(label).cast("string").alias("label")).filter("id IS NOT NULL AND vec IS NOT NULL")
    q = queries.select(F.col(key).alias("id"), vec).filter("id IS NOT NULL AND vec IS NOT NULL")
    t_blocks, q_blocks = (max(-(-n // KNN_BLOCK), min(8, -(-n // 1024)), 1) for n in (t.count(), q.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumns({"qb": F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")}).withColumn("tb", every(t_blocks))
    right = t.withColumns({"tb": F.pmod(F.xxhash64("id"), F.lit(t_blocks)).cast("int")}).withColumn("qb", every(q_blocks))
    kind = q.schema["id"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ty = b.schema.field("id").type
        out = [pa.table([pa.array([], x) for x in (ty, pa.float64(), ty, pa.string())], ["q_id", "far", "t_id", "t_label"])]
        lengths = [set(pc.list_value_length(side["vec"]).unique().to_pylist()) for side in (a, b)]
        for dim in lengths[0] & lengths[1]:
            (q_at, q_ids, x), (t_at, t_ids, y) = _matrix(a, dim), _matrix(b, dim)
            for i, j, far in _nearest(x, q_ids, y, t_ids, k) if len(x) and len(y) else ():
                mine, near = pa.array(q_at[i]), pa.array(t_at[j])
                out.append(pa.table([a["id"].take(mine), pa.array(far), b["id"].take(near), b["label"].take(near)], out[0].column_names))
        return pa.concat_tables(out)

    # a number of partitions of its own: small blocks are much work, and would be put together into one task
    left, right = (side.repartition(t_blocks * q_blocks, "qb", "tb") for side in (left, right))
    found = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInArrow(run, f"q_id {kind}, far double, t_id {kind}, t_label string")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("far", "t_id"))
    near = found.withColumn("place", place).filter(F.col("place") <= k)
    vote = near.groupBy("q_id", F.col("t_label").alias("l")).agg(F.count("*").alias("votes"), F.min("place").alias("place"))
    best = vote.groupBy("q_id").agg(F.max_by("l", F.struct("votes", -F.col("place"))).alias("prediction"))
    return best.select(F.col("q_id").alias(key), F.col("prediction").cast(train.schema[label].dataType).alias("prediction"))


def save_model(train: DataFrame, path: str, k: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> None:
    """Store a nearest-neighbour classifier: its rows and its parameters."""
    train.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label")).write.mode("overwrite").parquet(f"{path}/rows")
    train.sparkSession.createDataFrame([(k,)], "k int").coalesce(1).write.mode("overwrite").json(f"{path}/parameters")


def load_model(spark, path: str):
    """The stored classifier as a function of (key, vector) rows to (key, prediction)."""
    rows, k = spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/parameters").first()["k"]
    return lambda queries: knn(rows, queries.select("key", "vector"), k, "key", "vector", "label")


def predict_one(model, spark, *measures: float):
    """The class of one row of measures."""
    found = model(spark.createDataFrame([(-1, list(map(float, measures)))], "key long, vector array<double>")).first()
    return found["prediction"] if found else None


def square(x: Column) -> Column:
    """x squared, as a remote scalar function is called: a vectorised UDF."""
    return F.pandas_udf(lambda s: s * s, "double")(x.cast("double"))


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return predicted.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) of each class."""
    counted = confusion(predicted, label, prediction)
    by = lambda c: F.sum("n").over(Window.partitionBy(c))
    hit = counted.withColumns({"said": by("prediction"), "support": by("label")})
    own = hit.groupBy("label").agg(F.max("support").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    said = counted.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return own.join(said, "label", "left").select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def latest(df: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The last n rows by a column."""
    return df.orderBy(F.desc(order)).limit(n)


def history(stored: DataFrame, new: DataFrame, order: str, n: int = 4, classes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the last n rows of both, (ready): whether the whole history has predictions of ``classes`` classes)."""
    both = stored.unionByName(new)
    return latest(both, order, n), both.agg((F.count_distinct("prediction") == classes).alias("ready"))

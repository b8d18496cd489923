"""Structured Streaming: inference, feedback pairing with state, adaptation and prequential evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrove.operators.feedback import last_n
from quantgrove.operators.quantizer import Quantizer, bins
from quantgrove.operators.trees import Forest


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def score_stream(stream: DataFrame, quantizer: Quantizer, forest: Forest, labels: int) -> DataFrame:
    """Stateless inference: bins and compiled trees as columns of the stream."""
    names = [f"bin_{i}" for i in range(len(quantizer.rules))]
    return forest.predict(bins(quantizer, stream), names, labels)


def windowed_accuracy(stream: DataFrame, ts: str, size: str, slide: str, late: str) -> DataFrame:
    """Accuracy by event-time window; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide)).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def pair_feedback(stream: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Pairs the i-th prediction of a key with its i-th label: (key, predicted, actual).

    ``kind`` tells predictions from labels, ``value`` carries them and ``seq``
    orders them. Labels that come when every prediction has one are dropped,
    as are pairs with a null label. When more than ``most`` predictions wait,
    the queue is flushed: what has no label yet goes out with a null actual, so
    that nothing is lost in silence. State is at most ``most`` predictions a key.
    """

    def step(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        predicted, actual = [], []
        rows = pd.concat(list(parts)).sort_values("seq")
        for kind, value in zip(rows["kind"].tolist(), rows["value"].tolist()):
            if kind == "prediction":
                waiting.append(int(value))
                if len(waiting) > most:
                    predicted += waiting
                    actual += [None] * len(waiting)
                    waiting = []
            elif waiting:
                first = waiting.pop(0)
                if not pd.isna(value):
                    predicted.append(first)
                    actual.append(int(value))
        state.update((waiting,))
        yield pd.DataFrame({key: pd.Series([k[0]] * len(predicted)), "predicted": pd.Series(predicted, dtype="Int32"), "actual": pd.Series(actual, dtype="Int32")})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, predicted int, actual int", "waiting array<int>", "append", "NoTimeout")


def trailing_accuracy_stream(stream: DataFrame, key: str, window: int, every: int = 10) -> DataFrame:
    """Accuracy of the last ``window`` rows of a key at every ``every``-th row, once there are enough: (key, at, accuracy).

    Spark has no windows of counts, so the last rows are state: ``window``
    marks and a counter a key. Rows have ``seq`` and ``correct``.
    """

    def step(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        marks, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(parts)).sort_values("seq")["correct"].astype(int).tolist()
        series = marks + rows
        sums = [0]
        for x in series:
            sums.append(sums[-1] + x)
        out = []
        for i in range(len(rows)):
            n, end = seen + i + 1, len(marks) + i + 1
            if n >= window and n % every == 0:
                out.append((k[0], n - 1, (sums[end] - sums[end - window]) / window))
        state.update((series[-window:], seen + len(rows)))
        yield pd.DataFrame(out, columns=[key, "at", "accuracy"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, accuracy double", "marks array<int>, seen long", "append", "NoTimeout")


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None = None, gap: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows by event-time window and keys: tumbling, sliding (with a slide) or session (with a gap; a stream's sessions need a key)."""
    by = F.session_window(ts, gap) if gap else F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(by.alias("window"), *keys).agg(F.count("*").alias("n"))


def predict_one(stream: DataFrame, quantizer: Quantizer, forest: Forest, labels: int, dictionary: DataFrame, signals: bool = True) -> DataFrame:
    """Score, decode and say what drifted: predicted, label, success, and the bins that are kept until the label comes.

    A row whose label id has no entry did not succeed. ``drift`` names the
    first feature out of range and its value. Works on tables and streams.
    """
    from quantgrove.operators.feedback import decode_labels
    from quantgrove.operators.quantizer import first_drift

    names = [f"bin_{i}" for i in range(len(quantizer.rules))]
    scored = forest.predict(bins(quantizer, first_drift(quantizer, stream) if signals else stream), names, labels)
    return decode_labels(scored, dictionary, "predicted").withColumn("pending", F.array(*names)).drop(*names)


def adapt_each_batch(table_path: str, order: str, most: int, retrain: Callable[[DataFrame, int], None], every: int = 1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends to a bounded training window on shared storage, and retrains every so many batches.

    Windows alternate between two folders by batch number, so a batch that is
    run again overwrites its own output and nothing else.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{table_path}/{(number - 1) % 2}"
        try:
            both = spark.read.parquet(before).unionByName(batch) if number else batch
        except Exception as e:  # the first batch after a cleared window
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both = batch
        last_n(both, order, most).write.mode("overwrite").parquet(f"{table_path}/{number % 2}")
        if number % every == 0:
            retrain(spark.read.parquet(f"{table_path}/{number % 2}"), number)

    return run


def prequential(spark: SparkSession, df: DataFrame, index: str, features: Sequence[str], labels: int, train: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], train_rows: int, batch: int, window: int, below: float, cooldown: int, least: int = 1000) -> list[dict]:
    """Test-then-learn over an ordered table: (window_start, accuracy, precision, recall, f1, retrained) of each batch.

    A model is trained on the first rows; each batch is scored first, then
    joins the buffer. When the accuracy of the last ``window`` rows is below
    the threshold, the cooldown has passed and the buffer is large enough, the
    model is trained anew on the newest rows.

    Batches are scored many at a time: as many as the cooldown spans at first,
    then twice as many each time until a model is replaced, so rows are scored
    about twice at most. A few numbers a batch and label reach the driver.
    """
    n = (df.agg(F.max(index)).first()[0] or 0) + 1
    model = train(df.where(F.col(index) < train_rows))
    out, recent, last, start = [], [], -cooldown, train_rows
    span = first = max(1, cooldown // batch)
    while start < n:
        end = min(n, start + span * batch)
        scored = model(df.where(F.col(index).between(start, end - 1)))
        cells = scored.groupBy(F.floor((F.col(index) - start) / batch).cast("long").alias("b"), "label", "predicted").agg(F.count("*").alias("n")).collect()  # batches x labels x labels
        by: dict[int, list] = {}
        for r in cells:
            by.setdefault(r["b"], []).append((r["label"], r["predicted"], r["n"]))
        for b in range(-(-(end - start) // batch)):
            at, seen = start + b * batch, by.get(b, [])
            recent = (recent + [(sum(c for *_, c in seen), sum(c for a, p, c in seen if a == p))])[-max(1, window // batch) :]
            accuracy = sum(k for _, k in recent) / max(1, sum(m for m, _ in recent))
            retrain = accuracy < below and at - last >= cooldown and at + batch - train_rows >= min(least, window)
            out.append({"window_start": at, "accuracy": accuracy} | _macro(seen) | {"retrained": retrain})
            if retrain:
                model = train(df.where(F.col(index).between(max(0, at + batch - max(least, window)), at + batch - 1)))
                last, recent, start, span = at, [], at + batch, first
                break
        else:
            start, span = end, 2 * span
    return out


def _macro(cells: list[tuple[int, int, int]]) -> dict[str, float]:
    """Precision, recall and F1 averaged over the labels that occur."""
    tp, predicted, actual = ({} for _ in range(3))
    for a, p, n in cells:
        actual[a] = actual.get(a, 0) + n
        predicted[p] = predicted.get(p, 0) + n
        if a == p:
            tp[a] = tp.get(a, 0) + n
    each = [(tp.get(k, 0) / predicted[k] if predicted.get(k) else 0.0, tp.get(k, 0) / actual[k]) for k in actual]
    f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in each]
    m = max(1, len(each))
    return {"precision": sum(p for p, _ in each) / m, "recall": sum(r for _, r in each) / m, "f1": sum(f1) / m}


def adapt_and_retrain(spark: SparkSession, quantizer: Quantizer, stored: DataFrame, new: DataFrame, label: str, order: str, most: int, train: Callable[[DataFrame], Forest]) -> tuple[Quantizer, dict[int, list[int]], DataFrame, Forest]:
    """One turn of the adapt loop on new labelled rows: widen, remap, append with eviction, train.

    ``stored`` holds order, label and bins under the old quantiser. Returns the
    widened quantiser, the maps of its bins, the training window (remapped old
    rows and new ones, the newest ``most``) and the forest grown on it.
    """
    from quantgrove.operators.quantizer import adapt, remap_rows

    wider, maps = adapt(quantizer, new)
    names = [f"bin_{i}" for i in range(len(quantizer.rules))]
    old = remap_rows(stored, {f"bin_{i}": to for i, to in maps.items()}).select(order, label, *names)
    both = old.unionByName(bins(wider, new).select(order, label, *names))
    window = last_n(both, order, most)
    return wider, maps, window, train(window)

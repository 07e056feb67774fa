"""Ordered folds over DataFrames: fitting, continuing and applying learners.

A model's fit depends on the order of its rows, so the rows of one model are one
ordered stream. They are dealt by model key, sorted within partitions, and streamed
through the learner batch by batch: a worker holds the learner and one batch, never
a group. Parallelism comes from keys (a model per segment, a parameter sweep) and from
applying models, which is a map. A fit without keys is one stream by nature.

Labels and weights are two kinds of rows of one written table, so that a fit runs once.
Nulls in inputs are refused with an error that names the row; null keys are a model of
their own. Ties of the order column are broken by the inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoform.operators.learners import Guarded, Learner
from echoform.session import ship
from echoform.sources.tables import written

_OUT = pa.schema([("model", pa.string()), ("kind", pa.string()), ("sample_id", pa.int64()), ("labels", pa.list_(pa.int64())), ("module", pa.string()), ("cluster_id", pa.int32()), ("w", pa.list_(pa.float64())), ("n", pa.int64()), ("mapped", pa.int64()), ("links", pa.list_(pa.int64()))])
OUT = "model string, kind string, sample_id long, labels array<long>, module string, cluster_id int, w array<double>, n long, mapped long, links array<long>"
#: Doubles of weights that are broadcast for applying a model; larger models are applied in blocks or by key.
BROADCAST_DOUBLES = 8_000_000
#: Models that are broadcast at most: every task builds each model that it meets.
BROADCAST_MODELS = 256
#: Rows of a model beyond which it is applied in several tasks, each of which gets its weights.
HOT_ROWS = 500_000
#: Pairs of a row and a weight beyond which it is, too; such tasks are at most PIECES a core's share, and no two of them meet by chance.
HOT_PAIRS, PIECES = 100_000_000, 3
#: Rows of weights that go out in one batch.
WEIGHT_ROWS = 4_096


@dataclass
class Fitted:
    """A fit: labels (model, sample_id, labels) and weights (model, module, cluster_id, w, n, mapped, links)."""

    learner: Learner
    table: DataFrame
    #: Whether each row's first input is beside its labels.
    carried: bool = False

    @property
    def labels(self) -> DataFrame:
        return self.table.where("kind = 'row'").select("model", "sample_id", "labels")

    @property
    def weights(self) -> DataFrame:
        return self.table.where("kind = 'weight'").select("model", "module", "cluster_id", "w", "n", "mapped", "links")


    @property
    def history(self) -> DataFrame:
        """Of a fit with history: model, step, sample_id, module, cluster_id and the weight and rows that the category has after the step."""
        return self.table.where("kind = 'change'").select("model", first_label().alias("step"), "sample_id", "module", "cluster_id", "w", "n")

    def at(self, step: int) -> DataFrame:
        """model, module, cluster_id, w, n as they were after a step: of each category the last change up to it, one aggregation with partial maxima."""
        then = self.history.where(F.col("step") <= step).groupBy("model", "module", "cluster_id").agg(F.max_by(F.struct("w", "n"), "step").alias("s"))
        return then.select("model", "module", "cluster_id", "s.w", "s.n")


def model_key(by: Sequence[str]) -> Column:
    """The name of the model that a row belongs to."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by]) if by else F.lit("")


def _values(batch: pa.RecordBatch, first: int, count: int) -> list:
    """Input columns: a matrix of equally long lists, a list of arrays of other ones, an array of numbers."""
    out = []
    for k in range(first, first + count):
        c = batch.column(k)
        if pa.types.is_list(c.type):
            flat, at = c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if len(at) and at[0] and (at == at[0]).all() and flat.dtype != object:
                out.append(flat.reshape(len(at), -1))
            else:
                out.append(np.split(flat, np.cumsum(at)[:-1]) if len(at) else [])
        else:
            out.append(c.to_numpy(zero_copy_only=False))
    return out


def _sound(column: pa.Array) -> bool:
    """Whether no value of a batch needs a look at its row: no nulls, no NaN, no empty list."""
    if column.null_count:
        return False
    if pa.types.is_list(column.type):
        flat = column.flatten()
        return not flat.null_count and bool((column.value_lengths().to_numpy() > 0).all()) and (not pa.types.is_floating(flat.type) or not np.isnan(flat.to_numpy()).any())
    return not pa.types.is_floating(column.type) or not np.isnan(column.to_numpy()).any()


class Inspection:
    """The rules that a learner's input must keep, looked at for a batch at a time: no holes, one width for each model, the kernels' own rules."""

    def __init__(self, learner: Learner):
        self.kernels = learner.input_kernels
        self.start()

    def start(self) -> None:
        """A new model: its rows may have another width."""
        self.widths: dict[int, int] = {}

    def rows(self, model: str, ids: pa.Array, columns: list[pa.Array], values: list, check: bool = True) -> None:
        if not all(map(_sound, columns)):
            for r, row in enumerate(zip(*values, strict=True)):
                if any(x is None or (isinstance(x, np.ndarray) and (x.dtype == object or np.isnan(x).any() or not len(x))) or (isinstance(x, float) and x != x) for x in row):
                    raise ValueError(f"row {ids[r].as_py()} of model {model!r} has a null or NaN input")
        if not check:
            return
        for k, (column, x) in enumerate(zip(columns, values, strict=True)):
            kernel = self.kernels[k] if k < len(self.kernels) else None
            if kernel is None or not pa.types.is_list(column.type):
                continue
            width = self.widths.setdefault(k, len(x[0]))
            if not isinstance(x, np.ndarray) or x.shape[1] != width:
                bad = next(r for r, v in enumerate(x) if len(v) != width)
                raise ValueError(f"row {ids[bad].as_py()} of model {model!r} has {len(x[bad])} numbers, not {width}")
            try:
                kernel.validate(x)
            except ValueError as e:
                for r in range(len(x)):
                    try:
                        kernel.validate(x[r : r + 1])
                    except ValueError:
                        raise ValueError(f"row {ids[r].as_py()} of model {model!r} is refused. {e}") from None
                raise


def _weight_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (model, module, cluster_id, w, n, mapped, links) as a batch of the fit's table; lists are emptied."""
    n, columns = len(rows), dict(zip(("model", "module", "cluster_id", "w", "n", "mapped", "links"), zip(*rows, strict=True), strict=True))
    columns["kind"] = ["weight"] * n
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def fold(rows: DataFrame, learner: Learner, order: str, inputs: Sequence[str], by: Sequence[str] = (), epochs: int = 1, start: DataFrame | None = None, partitions: int | None = None, check: bool = True, allowed: Callable | None = None, hooks: tuple[Callable | None, Callable | None] = (None, None), history: bool = False, carry: bool = False, packed: bool = False, task: Column | None = None, tasks: int = 0) -> Fitted:
    """Fit a learner for each key, in order. start: weights of an earlier fit to go on from; check: whether rows must keep the kernels' rules.

    With several epochs the rows are streamed that often and the last labels count.
    allowed and hooks (before and after a step) are those of learners.Guarded. history
    keeps a log of changes, a row for each category that a step adds or lets learn, from
    which Fitted.at() gives the model after any step. carry keeps the first input, a vector,
    beside each row's labels (w of the table's rows). packed is for few models of very many
    rows: rows are sorted by ranges, side by side, and reach their model's task as compressed
    blocks, so that the task sorts blocks and not rows; the result is the same. task, from
    0 to tasks - 1, numbers a row's model, so that no two long fits share a task by chance.
    """
    spark = ship(rows.sparkSession)
    if packed and start is not None:
        raise ValueError("a fit that goes on takes its rows unpacked")
    if task is not None and (packed or start is not None):
        raise ValueError("numbered tasks are for fits from the start, of rows unpacked")
    if allowed or any(hooks):
        learner = Guarded(learner, allowed, *hooks)
    # Columns that say nothing are left out: rows are sorted in memory, so their width counts.
    data = rows.select(model_key(by).alias("model"), F.col(order).cast("long").alias("sample_id"), *[F.col(c).alias(f"i{k}") for k, c in enumerate(inputs)], *([task.cast("int").alias("_task")] if task is not None else []))
    if epochs > 1:
        data = data.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    fields = ["module", "cluster_id", "w", "n", "mapped", "links"]
    if start is not None:
        data = data.withColumn("part", F.lit(1)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(fields, ("string", "int", "array<double>", "long", "long", "array<long>"), strict=True)])
        blank = [F.lit(None).cast(data.schema[f"i{k}"].dataType).alias(f"i{k}") for k in range(len(inputs))]
        first = start.select("model", F.lit(0).alias("part"), *([F.lit(0).alias("epoch")] if epochs > 1 else []), F.col("cluster_id").cast("long").alias("sample_id"), *blank, *fields)
        data = data.unionByName(first)
    keys = [c for c in ("model", "part", "epoch", "sample_id") if c in data.columns]
    data = data.select(*keys, *[f"i{k}" for k in range(len(inputs))], *(fields if start is not None else []), *(["_task"] if task is not None else []))
    stages, at = [c for c in keys if c != "sample_id"], len(keys)
    count, width = len(inputs), at + len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, own, steps, weights = None, None, [], 0, []
        inspect = Inspection(learner)

        def close() -> Iterator[pa.RecordBatch]:
            if own:
                state.load(own)
            state.finish()
            weights.extend((now, *r) for r in state.export())
            if len(weights) >= WEIGHT_ROWS:
                yield _weight_rows(weights)

        for batch in batches:
            names, labels, beside, carried = [], [], [], []
            for stage, a, b in _runs(*(batch.column(c) for c in stages)):
                model, part, epoch = (stage, 1, 0) if len(stages) == 1 else (lambda s: (s["model"], s.get("part", 1), s.get("epoch", 0)))(dict(zip(stages, stage, strict=True)))
                if model != now:
                    if now is not None:
                        yield from close()
                    now, state, own, steps = model, learner.fresh(), [], 0
                    inspect.start()
                piece = batch.slice(a, b - a)
                if part == 0:
                    own += zip(*[piece.column(width + k).to_pylist() for k in range(6)], strict=True)
                    continue
                if own:
                    state.load(own)
                    own = []
                ids = piece.column("sample_id")
                columns = [piece.column(at + k) for k in range(count)]
                values = _values(piece, at, count)
                inspect.rows(model, ids, columns, values, check)
                if history:
                    got, changes, steps = _logged(state, model, ids, values, steps)
                    yield changes
                else:
                    got = state.step_rows(values)
                if epoch == epochs - 1:
                    names.append(pa.array([model] * len(got)))
                    labels.append((ids, got))
                    carried.append(columns[0] if carry else pa.nulls(len(got), _OUT.field("w").type))
                    beside.append(pa.nulls(len(got), pa.int64()) if state.aside is None else pa.array(state.aside, pa.int64()))
            if labels:
                yield _labels(pa.concat_arrays(names), pa.concat_arrays([i for i, _ in labels]), np.concatenate([g for _, g in labels]), pa.concat_arrays(beside), pa.concat_arrays([c.cast(_OUT.field("w").type) for c in carried]))
        if now is not None:
            yield from close()
        if weights:
            yield _weight_rows(weights)

    parts, ordered = partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), [*keys, *[f"i{k}" for k in range(count)]]
    if packed:
        # Ties of the keys stay in one range, where the inputs break them.
        ranges = data.repartitionByRange(parts, *keys).sortWithinPartitions(*ordered)
        blocks = ranges.mapInArrow(_pack(keys), T.StructType([data.schema[c] for c in keys]).add("number", "long").add("block", "binary"))
        table = blocks.repartition(parts, "model").sortWithinPartitions(*keys, "number").mapInArrow(lambda batches: run(_unpack(batches)), OUT)
        return Fitted(learner, written(table, "fit"), carry)
    if task is not None:
        dealt = data.repartitionById(tasks, "_task").drop("_task")
    else:
        dealt = data.repartition(parts, "model") if by or start is not None else data.repartition(1)
    table = dealt.sortWithinPartitions(*ordered).mapInArrow(run, OUT)
    return Fitted(learner, written(table, "fit"), carry)


def _pack(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows as blocks: the keys of the first row, a number in the partition, and a model's rows of a batch as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codec = 0, pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            firsts, numbers, blocks = [], [], []
            for _, a, b in _runs(batch.column("model")):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=codec) as out:
                    out.write_batch(batch.slice(a, b - a))
                firsts.append(a)
                numbers.append(number)
                blocks.append(sink.getvalue().to_pybytes())
                number += 1
            if firsts:
                heads = batch.select(keys).take(pa.array(firsts))
                yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary())], [*keys, "number", "block"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())


def _logged(state: Learner, model: str, ids: pa.Array, columns: list, step: int) -> tuple[np.ndarray, pa.RecordBatch, int]:
    """(labels, rows of the log, steps done) of learning rows one by one."""
    labels, log = [], []
    for c in state.modules().values():
        c.touched = []
    for i, row in zip(ids.to_pylist(), zip(*columns, strict=True), strict=True):
        step += 1
        labels.append(state.step(*row))
        for name, c in state.modules().items():
            log += [{"model": model, "kind": "change", "sample_id": i, "labels": [step], "module": name, "cluster_id": j, "w": c.w[j].tolist(), "n": int(c.n[j])} for j in sorted(set(c.touched))]
            c.touched.clear()
    return np.array(labels, np.int64).reshape(len(labels), -1), pa.RecordBatch.from_pylist(log, _OUT), step


def _labels(models: pa.Array, ids: pa.Array, labels: np.ndarray, beside: pa.Array, carried: pa.Array) -> pa.RecordBatch:
    n, more = len(labels), {"n": beside, "w": carried}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * labels.shape[1]), pa.array(labels.ravel()))
    return pa.RecordBatch.from_arrays([models, pa.array(["row"] * n), ids, lists, *[more[_OUT.field(k).name] if _OUT.field(k).name in more else pa.nulls(n, _OUT.field(k).type) for k in range(4, 10)]], schema=_OUT)


def apply(rows: DataFrame, fitted: Fitted, inputs: Sequence[str], sample: str = "sample_id", by: Sequence[str] = (), keep: Sequence[str] = (), check: bool = True) -> DataFrame:
    """(model, sample_id, labels) of rows under fitted models, with the columns to keep; check as for fold().

    Weights of at most BROADCAST_DOUBLES numbers and BROADCAST_MODELS models are broadcast
    and rows stay where they are. Beyond that, models meet their rows by key: weights come
    first in each model's stream, so a worker builds each model once and holds one at a
    time. Models of more than HOT_ROWS rows or HOT_PAIRS pairs of a row and a weight are dealt to several tasks.
    """
    spark = ship(rows.sparkSession)
    learner, weights = fitted.learner, fitted.weights
    data = rows.select(model_key(by).alias("model"), F.col(sample).cast("long").alias("sample_id"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], *[F.col(c).alias(f"i{k}") for k, c in enumerate(inputs)])
    count, kept = len(inputs), len(keep)
    size, models = weights.agg(F.coalesce(F.sum(F.size("w") + F.coalesce(F.size("links"), F.lit(0))), F.lit(0)), F.count_distinct("model")).first()
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("sample_id", T.LongType()), T.StructField("labels", T.ArrayType(T.LongType())), *[T.StructField(c, data.schema[f"k{k}"].dataType) for k, c in enumerate(keep)]])

    def label(state: Learner | None, columns: list, n: int) -> np.ndarray:
        return state.predict_rows(columns) if state is not None else np.full((n, learner.outputs), -1, np.int64)

    def named(models: pa.Array, ids: pa.Array, labels: list[np.ndarray], more: list[pa.Array]) -> pa.RecordBatch:
        flat = np.concatenate(labels)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([models, ids, lists, *more], ["model", "sample_id", "labels", *keep])

    if size <= BROADCAST_DOUBLES and models <= BROADCAST_MODELS:
        shared = spark.sparkContext.broadcast(_packed(weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[str, Learner | None] = {}
            inspect = Inspection(learner)
            for batch in _gathered(batches):
                # The rows of a model come together, as a stable sort of its number.
                batch = batch.take(pa.array(np.argsort(batch.column(0).dictionary_encode().indices.to_numpy(), kind="stable")))
                columns = [batch.column(2 + kept + k) for k in range(count)]
                values, out = _values(batch, 2 + kept, count), []
                alike = all(isinstance(x, np.ndarray) for x in values)
                if alike:
                    inspect.start()
                    inspect.rows("of several", batch.column(1), columns, values, check)
                for model, a, b in _runs(batch.column(0)):
                    if model not in ready:
                        ready[model] = learner.fresh() if model in shared.value else None
                        if ready[model] is not None:
                            ready[model].load(_unpacked(shared.value[model]))
                    own = [x[a:b] for x in values]
                    if not alike:
                        inspect.start()
                        inspect.rows(model, batch.column(1)[a:b], [c[a:b] for c in columns], own, check)
                    out.append(label(ready[model], own, b - a))
                if out:
                    yield named(batch.column(0), batch.column(1), out, [batch.column(2 + k) for k in range(kept)])

        return data.mapInArrow(run, schema)

    fields = ["module", "cluster_id", "w", "n", "mapped", "links"]
    inner = [f"k{k}" for k in range(kept)] + [f"i{k}" for k in range(count)]
    blank = [F.lit(None).cast(data.schema[c].dataType).alias(c) for c in inner]
    # Only models of much work are dealt to several tasks, so that weights are copied by the work there is, not by the tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = data.groupBy("model").agg(F.count("*").alias("_n")).join(weights.groupBy("model").agg(F.count("*").alias("_w")), "model", "left")
    hot = work.where((F.col("_n") > HOT_ROWS) | (F.col("_n") * F.col("_w") > HOT_PAIRS)).collect()
    places, pieces = [], 0
    for model, n, w in hot:
        salts = max(min(parts, -(-n // HOT_ROWS)), min(-(-n * (w or 0) // HOT_PAIRS), -(-PIECES * parts // len(hot))))
        places.append((model, salts, pieces))
        pieces += salts
    table = F.broadcast(spark.createDataFrame(places, "model string, _salts int, _first int"))
    salted, known = (d.withColumn("_salts", F.lit(1)).withColumn("_first", F.lit(None).cast("int")) for d in (data, weights))
    if hot:
        salted, known = (d.join(table, "model", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))) for d in (data, weights))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("sample_id"), F.col("_salts")).cast("int")).withColumn("part", F.lit(1))
    # A task of its own for each piece of a model of much work, the others by a hash.
    place = F.coalesce(F.col("_first") + F.col("salt"), F.lit(pieces) + F.pmod(F.hash("model"), F.lit(parts))).cast("int").alias("_task")
    both = salted.select("model", "salt", "part", "sample_id", place, *inner, *[F.lit(None).cast(weights.schema[c].dataType).alias(c) for c in fields]).unionByName(
        known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select("model", "salt", F.lit(0).alias("part"), F.col("cluster_id").cast("long").alias("sample_id"), place, *blank, *fields)
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, own = None, None, []
        inspect = Inspection(learner)
        for batch in batches:
            got, pieces = [], []
            for place, a, b in _runs(batch.column(0), batch.column(1), batch.column(2)):
                model, salt, part = place
                if (model, salt) != now:
                    now, state, own = (model, salt), None, []
                piece = batch.slice(a, b - a)
                if part == 0:
                    own += zip(*[piece.column(4 + kept + count + k).to_pylist() for k in range(6)], strict=True)
                    continue
                if own:
                    state = learner.fresh()
                    state.load(own)
                    own = []
                values = _values(piece, 4 + kept, count)
                inspect.start()
                inspect.rows(model, piece.column(3), [piece.column(4 + kept + k) for k in range(count)], values, check)
                got.append(label(state, values, b - a))
                pieces.append(piece)
            if got:
                whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
                yield named(whole.column(0), whole.column(3), got, [whole.column(4 + k) for k in range(kept)])

    return both.repartitionById(pieces + parts, "_task").drop("_task").sortWithinPartitions("model", "salt", "part").mapInArrow(stream, schema)


def _runs(*columns: pa.Array) -> Iterator[tuple]:
    """(value, start, end) of the runs of equal values in a batch, or of equal tuples of values."""
    lists = [c.to_pylist() for c in columns]
    values = lists[0] if len(lists) == 1 else list(zip(*lists, strict=True))
    at = 0
    for r in range(1, len(values) + 1):
        if r == len(values) or values[r] != values[at]:
            yield values[at], at, r
            at = r


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 32_768, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a number of rows and bytes, so that each model has some rows in one."""
    held, many, big = [], 0, 0
    for batch in batches:
        held.append(batch)
        many, big = many + len(batch), big + batch.nbytes
        if many >= rows or big >= size:
            yield pa.concat_batches(held)
            held, many, big = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _packed(weights: DataFrame) -> dict[str, pa.Table]:
    """Weights by model as Arrow tables, which travel as buffers."""
    table = weights.toArrow().combine_chunks()
    models = table.column("model").to_pylist()
    places: dict[str, list[int]] = {}
    for r, model in enumerate(models):
        places.setdefault(model, []).append(r)
    return {model: table.take(pa.array(rows)).drop_columns(["model"]) for model, rows in places.items()}


def _unpacked(table: pa.Table) -> list[tuple]:
    columns = [table.column(c).to_pylist() for c in ("module", "cluster_id", "w", "n", "mapped", "links")]
    return list(zip(*columns, strict=True))


def first_label(labels: str = "labels") -> Column:
    return F.get(F.col(labels), F.lit(0))

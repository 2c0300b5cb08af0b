"""Linear-chain conditional random fields as an Estimator: features by joins, sums by partitions.

Sequences are rows ``seq, pos, label, feats`` with feats an array of (attr, value). The batch trainer
sums log-likelihood and gradient over partitions, one job per evaluation; its weights are on the driver,
or in blocks where they are many or ``blockSize`` says so. Online trainers pass over each partition's
sequences in turn and average the partitions' weights after every epoch (iterative parameter mixing);
with one partition that is the plain online method. Their weights are held by every worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.operators import blockvectors, crf_blocks
from seqloom.operators.chain import Chain, best_path, chain_sums
from seqloom.operators.crf_blocks import tagged
from seqloom.operators.crf_layout import Layout, batches_of, gradients, items_of, joined, likelihood, pack, sequences_of, spread_in_order, stacked, stacks_of
from seqloom.operators.dictionary import dense_ids
from seqloom.operators.optimize import Result, Settings, minimise
from seqloom.operators.stages import InTables
from seqloom.sources.staging import ArrayState, staged

ALGORITHMS = ("lbfgs", "l2sgd", "ap", "pa", "arow")
#: Labels of a model at most: the transition matrix is dense in every worker.
MOST_LABELS = 5000
#: Features whose weights the driver holds at most, and weights of a block where there are more.
MOST_FEATURES = 1 << 24
BLOCK = 1 << 16
#: Groups in which the partitions' vectors are added up before they come to the driver.
GROUPS = 16


# -- features


def generate_features(rows: DataFrame, min_freq: float = 0.0, all_states: bool = False, all_transitions: bool = False) -> DataFrame:
    """``type, src, dst, freq``: sums of values by attribute and label (type 0), counts of label pairs (type 1)."""
    seqs = sequences_of(rows)
    pairs = seqs.select(F.explode("items").alias("i")).select("i.label", F.explode("i.feats").alias("f")).select("label", "f.attr", F.coalesce("f.value", F.lit(1.0)).alias("value"))
    states = pairs.groupBy("attr", "label").agg(F.sum("value").alias("freq"))
    labels = labels_of(seqs)
    if all_states:
        states = pairs.select("attr").distinct().crossJoin(labels).join(states, ["attr", "label"], "left").fillna(0.0, ["freq"])
    names, steps = F.col("items")["label"], F.size("items") - 1
    steps = F.arrays_zip(F.slice(names, 1, steps).alias("prev"), F.slice(names, 2, steps).alias("cur"))
    moves = seqs.select(F.inline(steps)).where("prev is not null and cur is not null").groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("freq"))
    if all_transitions:
        grid = labels.select(F.col("label").alias("prev")).crossJoin(labels.select(F.col("label").alias("cur")))
        moves = grid.join(moves, ["prev", "cur"], "left").fillna(0, ["freq"])
    both = states.where("label is not null").select(F.lit(0).alias("type"), F.col("attr").alias("src"), F.col("label").alias("dst"), "freq")
    both = both.unionByName(moves.select(F.lit(1).alias("type"), F.col("prev").alias("src"), F.col("cur").alias("dst"), F.col("freq").cast("double").alias("freq")))
    return both.where(F.col("freq") >= min_freq)


def labels_of(rows: DataFrame) -> DataFrame:
    """``label``: the known labels, each once."""
    return sequences_of(rows).select(F.explode(F.array_distinct(F.col("items")["label"])).alias("label")).where("label is not null").distinct()


# -- batch objective


def objective(packed: DataFrame, layout: Layout, c2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient of packed sequences, with the squared norm; one job per call."""
    return stacked_objective(stacked(packed, layout.labels), layout, c2)


def stacked_objective(held: DataFrame, layout: Layout, c2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """As objective(), of sequences that stacked() has joined."""
    context = held.sparkSession.sparkContext
    shared = context.broadcast(layout)
    in_groups = held.rdd.getNumPartitions() > 4 * GROUPS  # too many vectors for the driver: summed in groups first

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights = context.broadcast(np.append(w, 0.0))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, loss = np.zeros(shared.value.size + 1), 0.0
            for item in stacks_of(batches):
                loss += likelihood(shared.value, weights.value, item, grad)
            yield pa.RecordBatch.from_arrays([pa.array([hash(loss) % GROUPS], pa.int32()), pa.array([loss]), pa.array([grad[:-1].tobytes()])], names=["k", "loss", "grad"])

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            grad = np.sum([np.frombuffer(g) for g in frame["grad"]], axis=0)
            return pd.DataFrame({"k": frame["k"][:1], "loss": [frame["loss"].sum()], "grad": [grad.tobytes()]})

        sums = held.mapInArrow(part, "k int, loss double, grad binary")
        if in_groups:
            sums = sums.groupBy("k").applyInPandas(total, "k int, loss double, grad binary")
        rows = sorted(sums.collect(), key=lambda r: r["loss"])
        weights.destroy()
        grad = np.sum([np.frombuffer(r["grad"]) for r in rows], axis=0) + 2 * c2 * w
        return float(sum(r["loss"] for r in rows) + c2 * (w @ w)), grad

    return evaluate


#: Features up to which the batch trainer begins with an estimate of the loss's curvature, and sequences for each feature that an estimate takes.
CURVED, FOR_EACH = 512, 4


def curvature(held: DataFrame, layout: Layout, c2: float) -> Callable[[np.ndarray], np.ndarray | None]:
    """An estimate of the second derivatives of stacked_objective(): how the sequences' own gradients vary, with the norm's share. None where sequences are few.

    Both are the same in expectation where the model is right, so quasi-Newton steps that begin with it are few; where they end does not hang on it.
    """
    context = held.sparkSession.sparkContext
    shared = context.broadcast(layout)
    in_groups = held.rdd.getNumPartitions() > 4 * GROUPS

    def estimate(w: np.ndarray) -> np.ndarray | None:
        weights = context.broadcast(np.append(w, 0.0))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many, sums, squares = 0, np.zeros(shared.value.size), np.zeros((shared.value.size,) * 2)
            for item in stacks_of(batches):
                for rows in gradients(shared.value, weights.value, item):
                    many, sums = many + len(rows), sums + rows.sum(0)
                    squares += rows.T @ rows
            yield pa.RecordBatch.from_pydict({"k": pa.array([hash(float(squares[0, 0])) % GROUPS], pa.int32()), "n": pa.array([many]), "sums": pa.array([sums.tobytes()]), "squares": pa.array([squares.tobytes()])})

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": frame["k"][:1], "n": [frame["n"].sum()], **{c: [np.sum([np.frombuffer(v) for v in frame[c]], axis=0).tobytes()] for c in ("sums", "squares")}})

        schema = "k int, n long, sums binary, squares binary"
        found = held.mapInArrow(part, schema)
        if in_groups:
            found = found.groupBy("k").applyInPandas(total, schema)
        rows = found.collect()
        weights.destroy()
        many, size = sum(r["n"] for r in rows), len(w)
        if many < FOR_EACH * size:
            return None
        sums, squares = (np.sum([np.frombuffer(r[c]) for r in rows], axis=0) for c in ("sums", "squares"))
        return squares.reshape(size, size) - np.outer(sums, sums) / many + 2 * c2 * np.eye(size)

    return estimate


# -- online trainers: each keeps named vectors that partitions hand on and the driver averages


#: Features up to which the differences of all are summed up, rather than a sequence's own sorted out.
SMALL = 1 << 13


def _delta(layout: Layout, item: dict, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in which the features of a sequence's own labels and of a path differ, and by how much."""
    if layout.size <= SMALL:
        (fids, cells, values), (own, seen) = layout.spread(item), layout.gold(item)
        there = np.zeros(len(path) * layout.labels)
        there[own] = 1.0
        there[np.arange(0, there.size, layout.labels) + path] -= 1.0
        delta = np.bincount(fids, there[cells] * values, layout.size + 1).astype(np.float64, copy=False)  # without any they are counts
        # each pair has a place of its own, but for the spare
        delta[layout.trans] += seen - np.bincount(path[:-1] * layout.labels + path[1:], minlength=seen.size).reshape(seen.shape)
        used = delta[:-1].nonzero()[0]
        return used, delta[used]
    (right, more), (other, less) = layout.on_path(item, item["y"]), layout.on_path(item, path)
    ids = np.concatenate([right, other, layout.trans[item["y"][:-1], item["y"][1:]], layout.trans[path[:-1], path[1:]]])
    ones = np.ones(max(0, len(path) - 1))
    used, inverse = np.unique(ids, return_inverse=True)
    delta = np.bincount(inverse, np.concatenate([more, -less, ones, -ones]), len(used))
    keep = (delta != 0) & (used < layout.size)
    return used[keep], delta[keep]


def _perceptron(layout: Layout, state: dict, item: dict, _: dict) -> float:
    """On a wrong path, move by the difference of the paths' features; ``sum`` keeps what averaging takes off."""
    path, _score = best_path(*layout.scores(state["w"], item))
    wrong = int((path != item["y"]).sum())
    if wrong:
        ids, delta = _delta(layout, item, path)
        state["w"][ids] += delta
        state["sum"][ids] += float(state["c"][0]) * delta
    state["c"][0] += 1
    return wrong / len(path)


def _difference(layout: Layout, state: dict, item: dict) -> tuple[float, int, np.ndarray, np.ndarray]:
    """How far the wrong best path is ahead, its errors, and the entries and values of the features' difference."""
    scores = layout.scores(state["w"], item)
    path, top = best_path(*scores)
    wrong = int((path != item["y"]).sum())
    gold = scores[0][np.arange(len(path)), item["y"]].sum() + scores[1][item["y"][:-1], item["y"][1:]].sum()
    return float(top - gold), wrong, *_delta(layout, item, path)


def _passive_aggressive(layout: Layout, state: dict, item: dict, p: dict) -> float:
    """The least move that puts the right path ahead by its cost; kinds 1 and 2 bound or soften it by c."""
    ahead, wrong, ids, delta = _difference(layout, state, item)
    cost = 0.0
    if wrong and len(ids):
        cost = ahead + (np.sqrt(wrong) if p["error_sensitive"] else 1.0)
        norm = float(delta @ delta)
        tau = {0: cost / norm, 1: min(p["c"], cost / norm), 2: cost / (norm + 0.5 / p["c"])}[p["kind"]]
        state["w"][ids] += tau * delta
        state["sum"][ids] += float(state["c"][0]) * tau * delta
    state["c"][0] += 1
    return cost


def _arow(layout: Layout, state: dict, item: dict, p: dict) -> float:
    """A move along the variances, which shrink where it was made."""
    ahead, wrong, ids, delta = _difference(layout, state, item)
    if not wrong or not len(ids):
        return 0.0
    cost = ahead + wrong
    var = state["var"][ids]
    state["w"][ids] += cost / (p["gamma"] + float(delta * delta @ var)) * var * delta
    state["var"][ids] = 1 / (1 / var + delta * delta / p["gamma"])
    return cost


def _sgd(layout: Layout, state: dict, item: dict, p: dict) -> float:
    """A gradient step with the rate 1 / (lambda (t0 + t)). The weights are ``scale`` times ``w``, so that their decay costs nothing
    and a step touches the sequence's own entries alone."""
    eta = 1 / (p["lam"] * (p["t0"] + state["c"][0]))
    w, scale = state["w"], float(state["scale"][0])
    scores, moves = layout.scores(w, item)
    log_norm, nodes, edges = chain_sums(scale * scores, scale * moves)
    decayed = scale * (1 - eta * p["lam"])
    if abs(decayed) < 1e-9:
        w *= decayed
        decayed = 1.0
    state["scale"][0] = decayed
    step = eta / decayed
    own, seen = layout.gold(item)
    gold = np.add.reduce(scores.ravel()[own]) + np.vdot(moves, seen)
    nodes.ravel()[own] -= 1.0
    layout.add_nodes(w, item, nodes, -step)
    w[layout.trans] -= step * (edges - seen)  # each pair has a place of its own, but for the spare
    w[-1] = 0
    state["c"][0] += 1
    return log_norm - scale * float(gold)


STEPS = {"ap": _perceptron, "pa": _passive_aggressive, "arow": _arow, "l2sgd": _sgd}


def epoch(held: DataFrame, layout, algorithm: str, state: dict, params: dict, seed: int, in_groups: bool = False) -> tuple[dict, float]:
    """One pass of every partition of joined() sequences from the same state; vectors are averaged by the partitions' sequences, losses added.

    Sequences come in the order in which they are stored, those of a batch in a random one; a batch is held at a time.
    """
    context = held.sparkSession.sparkContext
    start = context.broadcast(state)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {k: v.copy() for k, v in start.value.items()}
        order, step = np.random.default_rng(seed), STEPS[algorithm]
        loss, many = 0.0, 0
        for items in batches_of(batches):
            many += len(items)
            for item in spread_in_order(layout.value, items, order.permutation(len(items))):
                loss += step(layout.value, mine, item, params)
        if "scale" in mine:
            mine["w"] *= mine["scale"][0]
            mine["scale"][0] = 1.0
        if many:
            columns = {"k": pa.array([hash(loss) % GROUPS], pa.int32()), "n": pa.array([many]), "loss": pa.array([float(loss)]), **{k: pa.array([(many * v).tobytes()]) for k, v in mine.items()}}
            yield pa.RecordBatch.from_pydict(columns)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("loss")
        return pd.DataFrame({"k": frame["k"][:1], "n": [frame["n"].sum()], "loss": [frame["loss"].sum()], **{k: [np.sum([np.frombuffer(v) for v in frame[k]], axis=0).tobytes()] for k in state}})

    schema = "k int, n long, loss double, " + ", ".join(f"`{k}` binary" for k in state)
    sums = held.mapInArrow(part, schema)
    if in_groups:
        sums = sums.groupBy("k").applyInPandas(total, schema)
    rows = sorted(sums.collect(), key=lambda r: r["loss"])
    start.destroy()
    many = sum(r["n"] for r in rows)
    mixed = {k: sum(np.frombuffer(r[k]) for r in rows) / many for k in state}
    return mixed, float(sum(r["loss"] for r in rows))


# -- the Estimator


class _Settings(Params):
    algorithm = Param(Params._dummy(), "algorithm", "one of lbfgs, l2sgd, ap, pa, arow", TypeConverters.toString)
    c1 = Param(Params._dummy(), "c1", "weight of the L1 norm (lbfgs)", TypeConverters.toFloat)
    c2 = Param(Params._dummy(), "c2", "weight of the squared norm (lbfgs, l2sgd)", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations or epochs at most", TypeConverters.toInt)
    epsilon = Param(Params._dummy(), "epsilon", "gradient or loss at which training ends", TypeConverters.toFloat)
    period = Param(Params._dummy(), "period", "iterations over which delta is taken", TypeConverters.toInt)
    delta = Param(Params._dummy(), "delta", "relative gain below which training ends", TypeConverters.toFloat)
    numMemories = Param(Params._dummy(), "numMemories", "stored steps (lbfgs)", TypeConverters.toInt)
    lineSearch = Param(Params._dummy(), "lineSearch", "interpolation, armijo, wolfe or strong_wolfe (lbfgs)", TypeConverters.toString)
    maxLineSearch = Param(Params._dummy(), "maxLineSearch", "trials of a line search (lbfgs)", TypeConverters.toInt)
    minFreq = Param(Params._dummy(), "minFreq", "least sum of a feature", TypeConverters.toFloat)
    possibleStates = Param(Params._dummy(), "possibleStates", "features for all attributes with all labels", TypeConverters.toBoolean)
    possibleTransitions = Param(Params._dummy(), "possibleTransitions", "features for all pairs of labels", TypeConverters.toBoolean)
    kind = Param(Params._dummy(), "kind", "0, 1 or 2 (pa)", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "aggressiveness (pa)", TypeConverters.toFloat)
    errorSensitive = Param(Params._dummy(), "errorSensitive", "cost by the root of the errors (pa)", TypeConverters.toBoolean)
    variance = Param(Params._dummy(), "variance", "variance at the start (arow)", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "weight of the variances (arow)", TypeConverters.toFloat)
    eta = Param(Params._dummy(), "eta", "rate at the start of calibration (l2sgd)", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "factor between calibration rates (l2sgd)", TypeConverters.toFloat)
    samples = Param(Params._dummy(), "samples", "sequences of calibration (l2sgd)", TypeConverters.toInt)
    candidates = Param(Params._dummy(), "candidates", "rates tried that improve (l2sgd)", TypeConverters.toInt)
    maxTrials = Param(Params._dummy(), "maxTrials", "rates tried in all (l2sgd)", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "order of sequences in an epoch", TypeConverters.toInt)
    partitions = Param(Params._dummy(), "partitions", "partitions of training, 0 for those of the data; 1 makes online trainers exact, and the batch trainer has one per core at least", TypeConverters.toInt)
    stateFile = Param(Params._dummy(), "stateFile", "shared path at which lbfgs keeps its state, if anywhere (weights on the driver)", TypeConverters.toString)
    blockSize = Param(Params._dummy(), "blockSize", "weights of a block of tables (lbfgs); 0 for weights on the driver, as long as there are not too many", TypeConverters.toInt)


#: Iterations or epochs where none are set.
ITERATIONS = {"lbfgs": 1 << 31, "l2sgd": 1000, "ap": 100, "pa": 100, "arow": 100}


class LinearChainCRF(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fits sequences of (seq, pos, label, feats). Rows with a null label count as of no known label and are not learnt from."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(
            algorithm="lbfgs", c1=0.0, c2=1.0, maxIter=0, epsilon=1e-5, period=10, delta=1e-5, numMemories=6, lineSearch="interpolation", maxLineSearch=20, minFreq=0.0,
            possibleStates=False, possibleTransitions=False, kind=1, c=1.0, errorSensitive=True, variance=1.0, gamma=1.0, eta=0.1, rate=2.0, samples=1000, candidates=10,
            maxTrials=20, seed=1, partitions=0, stateFile="", blockSize=0,
        )
        self._set(**self._input_kwargs)
        #: Told iteration and loss, and with the model as it then is.
        self.listener: Callable[[int, float], None] | None = None
        self.observer: Callable[[int, float, LinearChainCRFModel], None] | None = None
        #: How the last batch training ended.
        self.result: Result | None = None

    def with_weights(self, dataset: DataFrame, weight: Column) -> LinearChainCRFModel:
        """The model of the dataset's features with given weights: an expression over type, src, dst (names) and freq."""
        found, attrs, coded = self._features(_kept(dataset), weight)
        return self._copyValues(LinearChainCRFModel(found, attrs, *_arrays(coded)))

    def _features(self, dataset: DataFrame, weight: Column) -> tuple[list[str], DataFrame, DataFrame]:
        """Labels, numbered attributes, and the features ``type, s, d, freq, weight`` by numbers. The dataset is read more than once."""
        get = self.getOrDefault
        spark = dataset.sparkSession
        found = [r[0] for r in labels_of(dataset).orderBy("label").limit(MOST_LABELS + 1).collect()]
        if not found or len(found) > MOST_LABELS:
            raise ValueError("there are no labels" if not found else "there are too many labels")
        features = staged(generate_features(dataset, get(self.minFreq), get(self.possibleStates), get(self.possibleTransitions)).withColumn("weight", weight.cast("double")), "features")
        names = features.where("type = 0").select(F.col("src").alias("attr")).distinct()
        attrs = dense_ids(names, ["attr"], "aid", start=0)
        index = spark.createDataFrame([(k, v) for k, v in enumerate(found)], "lid int, label string")
        src = features.join(attrs, (F.col("type") == 0) & (F.col("src") == F.col("attr")), "left").join(index.select(F.col("lid").alias("sl"), F.col("label").alias("sn")), (F.col("type") == 1) & (F.col("src") == F.col("sn")), "left")
        coded = src.join(index.select(F.col("lid").alias("dl"), F.col("label").alias("dn")), F.col("dst") == F.col("dn")).select("type", F.coalesce("aid", "sl").cast("long").alias("s"), F.col("dl").cast("long").alias("d"), "freq", "weight")
        return found, attrs, staged(coded, "coded")

    def _fit(self, dataset: DataFrame) -> LinearChainCRFModel | BlockCRFModel:
        get = self.getOrDefault
        algorithm = get(self.algorithm)
        if algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm is one of {ALGORITHMS}")
        dataset = _kept(dataset)
        found, attrs, coded = self._features(dataset, F.lit(0.0))
        size = coded.count()
        if size > MOST_FEATURES and algorithm != "lbfgs":
            raise ValueError(f"workers of {algorithm} hold all of the weights, and there are {size}: use lbfgs or minFreq")
        packed = pack(dataset.where(~F.exists("items", lambda x: x["label"].isNull())), attrs, found)
        if algorithm == "lbfgs" and (get(self.blockSize) or size > MOST_FEATURES):
            return self._blocks(packed, found, attrs, coded, size)
        table, freq, _ = _arrays(coded)
        layout = Layout(np.column_stack([np.arange(size), table]), attrs.count(), len(found))

        def model(w: np.ndarray) -> LinearChainCRFModel:
            return self._copyValues(LinearChainCRFModel(found, attrs, table, freq, w))

        def told(k: int, loss: float, w: np.ndarray) -> None:
            if self.listener:
                self.listener(k, loss)
            if self.observer:
                self.observer(k, loss, model(w))

        if algorithm == "lbfgs":
            return model(self._batch(packed, layout, told))
        packed = packed.repartition(get(self.partitions), "seq") if get(self.partitions) else packed
        # a random order that every epoch keeps
        packed = packed.sortWithinPartitions(F.xxhash64("seq", F.lit(get(self.seed))), "seq").persist()
        w = self._online(packed, layout, algorithm, packed.count(), told)
        packed.unpersist()
        return model(w)

    def _settings(self) -> Settings:
        get = self.getOrDefault
        c1 = get(self.c1)
        return Settings(
            memories=get(self.numMemories), epsilon=get(self.epsilon), period=get(self.period), delta=get(self.delta), max_iterations=get(self.maxIter) or ITERATIONS["lbfgs"],
            c1=c1, search="armijo" if c1 else get(self.lineSearch), max_trials=get(self.maxLineSearch),
        )

    def _blocks(self, packed: DataFrame, found: list[str], attrs: DataFrame, coded: DataFrame, size: int) -> BlockCRFModel:
        """The batch trainer with features, weights and vectors in tables."""
        get = self.getOrDefault
        block = get(self.blockSize) or BLOCK
        features = staged(dense_ids(coded, ["type", "s", "d"], "fid", start=0), "features")
        moves = [(r["fid"], r["s"], r["d"]) for r in features.where("type = 1").collect()]  # pairs of labels
        moves.sort()
        held = crf_blocks.stage(crf_blocks.shards(packed, features, moves))
        evaluate, free = crf_blocks.objective(held, moves, len(found), size, block, get(self.c2))

        def model(vector: DataFrame) -> BlockCRFModel:
            place = F.struct((F.col("fid") % block).cast("int").alias("at"), "fid", "type", "s", "d", "freq")
            rows = features.groupBy((F.col("fid") / block).cast("long").alias("block")).agg(F.collect_list(place).alias("rows"))  # a block's at most
            return self._copyValues(BlockCRFModel(found, attrs, rows.join(vector, "block").mapInArrow(_unblocked, BLOCK_FEATURES)))

        def told(k: int, loss: float, vector: DataFrame) -> None:
            if self.listener:
                self.listener(k, loss)
            if self.observer:
                self.observer(k, loss, model(vector))

        vector, self.result = blockvectors.minimise_blocks(evaluate, staged(blockvectors.zeros(packed.sparkSession, size, block), "start"), self._settings(), told)
        out = model(vector)
        out.features = staged(out.features, "weights")
        free()
        return out

    def _batch(self, packed: DataFrame, layout: Layout, told: Callable) -> np.ndarray:
        get = self.getOrDefault
        state = ArrayState(packed.sparkSession, f"{get(self.stateFile)}/c2={get(self.c2)}") if get(self.stateFile) else None
        # the loss is a sum in which any deal over tasks will do, so all cores have a share
        tasks = max(get(self.partitions), packed.sparkSession.sparkContext.defaultParallelism)
        held = stacked(packed, layout.labels).repartition(tasks).persist()
        # where the steps before decide the end, they stay as they are
        curved = curvature(held, layout, get(self.c2)) if not get(self.period) and get(self.c2) > 0 and layout.size <= CURVED else None
        self.result = minimise(stacked_objective(held, layout, get(self.c2)), np.zeros(layout.size), self._settings(), told, state, curved)
        held.unpersist()
        return self.result.x

    def _online(self, packed: DataFrame, layout: Layout, algorithm: str, n: int, told: Callable) -> np.ndarray:
        get = self.getOrDefault
        shared = packed.sparkSession.sparkContext.broadcast(layout)
        zero = np.zeros(layout.size + 1)
        state = {"w": zero, "c": np.ones(1)}
        params: dict = {"kind": get(self.kind), "c": get(self.c), "error_sensitive": get(self.errorSensitive), "gamma": get(self.gamma)}
        if algorithm in ("ap", "pa"):
            state["sum"] = zero.copy()
        if algorithm == "arow":
            state["var"] = np.full(layout.size + 1, get(self.variance))
        if algorithm == "l2sgd":
            params["lam"] = 2 * get(self.c2) / max(1, n)
            params["t0"] = self._calibrate(packed, shared, params, n)
            state["c"], state["scale"] = np.zeros(1), np.ones(1)
        losses, best = [], None
        held = joined(packed).persist()
        in_groups = held.rdd.getNumPartitions() > 4 * GROUPS  # too many vectors for the driver: summed in groups first

        def weights() -> np.ndarray:
            if algorithm == "l2sgd":
                return best[1][:-1]
            return state["w"][:-1] if algorithm == "arow" else (state["w"] - state["sum"] / state["c"][0])[:-1]

        for k in range(get(self.maxIter) or ITERATIONS[algorithm]):
            state, loss = epoch(held, shared, algorithm, state, params, get(self.seed) + k, in_groups)
            if algorithm == "l2sgd":
                loss += 0.5 * params["lam"] * float(state["w"] @ state["w"]) * n
                if best is None or loss < best[0]:
                    best = (loss, state["w"])
            losses.append(loss)
            told(k + 1, loss, weights())
            period = get(self.period)
            if algorithm == "l2sgd":
                if len(losses) > period and (losses[-1 - period] - loss) / loss < get(self.delta):
                    break
            elif loss / max(1, n) <= get(self.epsilon):
                break
        held.unpersist()
        return weights()

    def _calibrate(self, packed: DataFrame, shared, params: dict, n: int) -> float:
        """The t0 of the rate that gains most in one epoch over a sample: rates go up from eta, then down."""
        get = self.getOrDefault
        sample = packed.orderBy(F.xxhash64("seq"), "seq").limit(get(self.samples)).persist()
        held, stacks = joined(sample).persist(), stacked(sample, shared.value.labels).persist()
        zero = np.zeros(shared.value.size + 1)
        value = stacked_objective(stacks, shared.value, params["lam"] * sample.count() / 2)

        def tried(eta: float) -> float:
            p = params | {"t0": 1 / (params["lam"] * eta)}
            state, _ = epoch(held, shared, "l2sgd", {"w": zero, "c": np.zeros(1), "scale": np.ones(1)}, p, get(self.seed))
            return value(state["w"][:-1])[0] if np.isfinite(state["w"]).all() else np.inf

        base = value(zero[:-1])[0]  # no norm yet
        eta, found, up, good = get(self.eta), [], True, 0
        for _ in range(get(self.maxTrials)):
            loss = tried(eta)
            found.append((loss, eta))
            ok = np.isfinite(loss) and loss < base
            good += ok
            if up and not ok:
                up, eta = False, get(self.eta)
            if good >= get(self.candidates) or (not up and ok and len(found) > 1 and eta < get(self.eta)):
                break
            eta = eta * get(self.rate) if up else eta / get(self.rate)
        for table in (held, stacks, sample):
            table.unpersist()
        return 1 / (params["lam"] * min(found)[1])


def _kept(dataset: DataFrame) -> DataFrame:
    """The dataset's sequences, written once for all that reads them; such as are given as sequences are kept already."""
    seqs = sequences_of(dataset)
    return seqs if seqs is dataset else staged(seqs, "sequences")


BLOCK_FEATURES = "fid long, type int, s long, d long, freq double, weight double"


def _arrays(coded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in the order of type, s and d: (n, 3) numbers, frequencies and weights. For as many as the driver's weights."""
    held = coded.select("type", "s", "d", "freq", "weight").toArrow()
    table = np.column_stack([held[c].to_numpy().astype(np.int64) for c in ("type", "s", "d")])
    order = np.lexsort((table[:, 2], table[:, 1], table[:, 0]))
    return table[order], *(held[c].to_numpy()[order].astype(np.float64) for c in ("freq", "weight"))


def _unblocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_FEATURES from blocks of features and of weights."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column("rows")[k].values
            w = np.frombuffer(batch.column("w")[k].as_buffer(), np.float64)[rows.field("at").to_numpy()]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in ("fid", "type", "s", "d", "freq")), pa.array(w)], names=["fid", "type", "s", "d", "freq", "weight"])


class _Tags(Model, _Settings, InTables):
    """What models of both kinds do with ``labels``, ``attrs``, their tags of packed sequences and their coded features."""

    labels: list[str]
    attrs: DataFrame

    def _tag(self, packed: DataFrame) -> DataFrame:
        """``__seq, pred, marginal, probability, all`` of packed sequences, and their ``places``."""
        raise NotImplementedError

    def _coded(self, spark: SparkSession) -> DataFrame:
        """BLOCK_FEATURES."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``seq, pos, label, pred, marginal, probability, marginals``: the best path, its labels' marginals and probability, and all marginals."""
        both = self._tag(pack(dataset, self.attrs, self.labels, places=True)).withColumnRenamed("places", "__p")
        each = both.select("__seq", "probability", F.posexplode("__p").alias("__i", "at"), "pred", "marginal", "all")
        n = len(self.labels)
        return each.select(
            F.col("__seq").alias("seq"), F.col("at.pos").alias("pos"), F.col("at.label").alias("label"), F.col("pred")[F.col("__i")].alias("pred"),
            F.col("marginal")[F.col("__i")].alias("marginal"), "probability", F.slice("all", F.col("__i") * n + 1, F.lit(n)).alias("marginals"),
        )

    def beside(self, dataset: DataFrame) -> DataFrame:
        """``pred, ref``: one row per sequence, its best labels and its own ones, null where the model does not know them. Packed sequences with places are taken as they are."""
        named = F.array(*map(F.lit, self.labels))
        ref = F.transform("places", lambda p: F.when(F.array_contains(named, p["label"]), p["label"]))
        packed = dataset if "aids" in dataset.columns else pack(dataset, self.attrs, self.labels, places=True)
        return self._tag(packed).select("pred", ref.alias("ref"))

    def ranked(self, dataset: DataFrame, k: int) -> DataFrame:
        """``seq, pos, rank, label, marginal``: the k likeliest labels of every item, ties to the lower label."""
        marginals = self.transform(dataset).select("seq", "pos", F.posexplode("marginals").alias("lid", "marginal"))
        order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("marginal")).alias("m"), "lid"))), lambda x: x)
        tops = marginals.groupBy("seq", "pos").agg(F.slice(order, 1, k).alias("top"))
        each = tops.select("seq", "pos", F.posexplode("top").alias("r", "t"))
        return each.select("seq", "pos", (F.col("r") + 1).alias("rank"), F.element_at(F.array(*map(F.lit, self.labels)), F.col("t.lid") + 1).alias("label"), (-F.col("t.m")).alias("marginal"))

    def active(self, spark: SparkSession) -> DataFrame:
        """``type, n_features, n_active``: how many features there are, and how many with a weight other than 0."""
        found = self._coded(spark).groupBy("type").agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("weight") != 0).alias("n_active"))
        kinds = spark.createDataFrame([(0,), (1,)], "type int").join(found, "type", "left")
        return kinds.select("type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_features", "n_active")))

    def dump(self, spark: SparkSession) -> DataFrame:
        """``type, src, dst, freq, weight``: the features by name, those of weight 0 left out."""
        coded, names = self._coded(spark).where("weight <> 0"), F.array(*map(F.lit, self.labels))
        with_attr = coded.join(self.attrs, (F.col("type") == 0) & (F.col("s") == F.col("aid")), "left")
        return with_attr.select("type", F.when(F.col("type") == 0, F.col("attr")).otherwise(F.element_at(names, (F.col("s") + 1).cast("int"))).alias("src"), F.element_at(names, (F.col("d") + 1).cast("int")).alias("dst"), "freq", "weight")

    def write_tables(self, path: str) -> None:
        """Labels, attributes and features as tables under ``path``; features of weight 0 and attributes without others go."""
        spark = self.attrs.sparkSession
        kept = self._coded(spark).where("weight <> 0")
        spark.createDataFrame([*enumerate(self.labels)], "lid int, label string").write.parquet(f"{path}/labels")
        kept.write.parquet(f"{path}/features")
        self.attrs.join(kept.where("type = 0").select(F.col("s").alias("aid")).distinct(), "aid", "left_semi").write.parquet(f"{path}/attrs")

    @staticmethod
    def _read(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("lid").collect()]
        old = spark.read.parquet(f"{path}/attrs")
        attrs = dense_ids(old.select("attr"), ["attr"], "aid", start=0)
        moved = old.withColumnRenamed("aid", "old").join(attrs, "attr").select("old", "aid")
        rows = spark.read.parquet(f"{path}/features").join(moved, (F.col("type") == 0) & (F.col("s") == F.col("old")), "left")
        return labels, attrs, rows.select("type", F.coalesce("aid", "s").alias("s"), "d", "freq", "weight")


class LinearChainCRFModel(_Tags):
    """Labels sequences of (seq, pos, feats); ``label`` may be there or not. Features are (n, 3) numbers of type, source and label."""

    def __init__(self, labels: list[str], attrs: DataFrame, table: np.ndarray, freq: np.ndarray, weights: np.ndarray):
        super().__init__()
        self.labels, self.attrs, self.table, self.freq = labels, attrs, table, freq
        self.layout = Layout(np.column_stack([np.arange(len(table)), table]), attrs.count(), len(labels))
        self.weights = np.append(weights, 0.0)

    def _tag(self, packed: DataFrame) -> DataFrame:
        shared = packed.sparkSession.sparkContext.broadcast((self.layout, self.weights, self.labels))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout, w, labels = shared.value
            for batch in batches:
                out = [(item["seq"], *tagged(Chain(*layout.scores(w, item)), labels)) for item in items_of(batch.drop_columns("places").to_pandas())]
                yield from crf_blocks.tag_table(out, batch.column("places")).to_batches()

        return packed.mapInArrow(work, StructType([*StructType.fromDDL(crf_blocks.TAGS).fields, packed.schema["places"]]))

    def _coded(self, spark: SparkSession) -> DataFrame:
        held = {"fid": np.arange(len(self.table)), "type": self.table[:, 0].astype(np.int32), "s": self.table[:, 1], "d": self.table[:, 2], "freq": self.freq, "weight": self.weights[:-1]}
        return spark.createDataFrame(pa.table(held))

    def _scored(self, dataset: DataFrame, more: DataFrame, schema: str, value: Callable[[Chain, dict, dict], Iterator[tuple]]) -> DataFrame:
        """Rows of ``schema`` from each sequence's chain, its item and its row of ``more`` (by ``__s``)."""
        packed = pack(dataset, self.attrs, self.labels)
        shared = dataset.sparkSession.sparkContext.broadcast((self.layout, self.weights))
        names = [c.split()[0] for c in schema.split(", ")]

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            layout, w = shared.value
            for frame in frames:
                out = [found for item, row in zip(items_of(frame), frame.to_dict("records")) for found in value(Chain(*layout.scores(w, item)), item, row)]
                yield pd.DataFrame(out, columns=names)

        return packed.join(more, F.col("seq") == F.col("__s")).mapInPandas(work, schema)

    def path_probability(self, dataset: DataFrame) -> DataFrame:
        """``seq, score, log_norm, probability`` of the labels that the dataset gives; score and probability are null where one is unknown."""
        many = len(self.labels)

        def value(chain: Chain, item: dict, row: dict) -> Iterator[tuple]:
            known = bool((item["y"] < many).all())
            yield item["seq"], chain.score(item["y"]) if known else None, chain.log_norm, float(np.exp(chain.log_probability(item["y"]))) if known else None

        return self._scored(dataset, dataset.select(F.col("seq").cast("string").alias("__s")).distinct(), "seq string, score double, log_norm double, probability double", value)

    def span_probability(self, dataset: DataFrame, spans: DataFrame) -> DataFrame:
        """``seq, begin, labels, probability`` for spans (seq, begin, labels): that the items from the begin-th on (from 0) have just those labels.

        Null where the span leaves the sequence or a label is unknown.
        """
        names = {label: k for k, label in enumerate(self.labels)}
        asked = spans.groupBy(F.col("seq").cast("string").alias("__s")).agg(F.collect_list(F.struct("begin", "labels")).alias("__spans"))

        def value(chain: Chain, item: dict, row: dict) -> Iterator[tuple]:
            for span in row["__spans"]:
                begin, labels = int(span["begin"]), [*span["labels"]]
                fits = labels and 0 <= begin and begin + len(labels) <= len(item["y"]) and all(x in names for x in labels)
                yield item["seq"], begin, labels, chain.path_marginal(np.array([names[x] for x in labels]), begin) if fits else None

        return self._scored(dataset, asked, "seq string, begin long, labels array<string>, probability double", value)

    @classmethod
    def read_tables(cls, spark: SparkSession, path: str) -> LinearChainCRFModel:
        labels, attrs, rows = cls._read(spark, path)
        return cls(labels, attrs, *_arrays(rows))


class BlockCRFModel(_Tags):
    """A model whose features (BLOCK_FEATURES) stay a table; sequences meet their features' weights in shards."""

    def __init__(self, labels: list[str], attrs: DataFrame, features: DataFrame):
        super().__init__()
        self.labels, self.attrs, self.features = labels, attrs, features

    def _tag(self, packed: DataFrame) -> DataFrame:
        moves = sorted((r["fid"], r["s"], r["d"], r["weight"]) for r in self.features.where("type = 1").collect())  # pairs of labels
        return crf_blocks.tags(packed, self.features, moves, self.labels)

    def _coded(self, spark: SparkSession) -> DataFrame:
        return self.features

    @classmethod
    def read_tables(cls, spark: SparkSession, path: str) -> BlockCRFModel:
        labels, attrs, rows = cls._read(spark, path)
        return cls(labels, attrs, staged(dense_ids(rows, ["type", "s", "d"], "fid", start=0).select(*(c.split()[0] for c in BLOCK_FEATURES.split(", "))), "weights"))

"""Document scores of a gated recurrent language model, beside a smoothed unigram score.

Texts are cut into blocks: a bounded run of documents with its own word list, token numbers and word counts. Counts of
all training words are summed over the block lists (one row per block and word, never per token) and joined back to
the blocks. The recurrent model knows the most frequent words, dealt into classes by rank: it predicts the class and
then the word inside the class, and one last class stands for all other words, which share it by their counts.

Every task trains the model on its own blocks by truncated backpropagation through time, starting from weights that
all share; the weights are then averaged in a tree, weighted by tokens. Scoring carries the state across windows from
the first to the last token of each document.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dealweave.llm.common import shared_folder, stored, text_bytes, text_slices

#: The end of a text as a word; it holds white space, so no word equals it.
END = b"\n"
#: Bytes of text meant for one block.
BLOCK_BYTES = 10 << 20
#: Tokens scored at once where few documents run side by side.
SCORED_TOGETHER = 8192


@dataclass(frozen=True)
class Shape:
    """Size of the model and of its training: known words, words of a class, hidden units, steps of a window, documents
    that run side by side, tokens of a training piece, learning rate and gradient bound."""

    words: int = 1024
    per_class: int = 32
    hidden: int = 16
    steps: int = 16
    lanes: int = 512
    piece: int = 1024
    rate: float = 0.05
    bound: float = 0.25

    @property
    def classes(self) -> int:
        return -(-self.words // self.per_class) + 1


def _sigmoid(x: np.ndarray) -> None:
    """Logistic function in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _log_choice(x: np.ndarray, chosen: np.ndarray, train: bool):
    """Log softmax of each column at its chosen row, and the gradient of their sum if asked for; ``x`` is used up."""
    columns = np.arange(x.shape[1])
    x -= x.max(axis=0)
    logp = x[chosen, columns].astype(np.float64)
    np.exp(x, out=x)
    whole = x.sum(axis=0)
    logp -= np.log(whole)
    if not train:
        return logp, None
    x *= -1 / whole
    x[chosen, columns] += 1
    return logp, x


@dataclass
class Model:
    """Weights by name, and the sums of squared gradients that scale each step of training."""

    shape: Shape
    weights: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, shape: Shape, counts: np.ndarray, rest: int) -> Model:
        """Biases from the counts, so that the untrained model is a class unigram model; other weights from a fixed seed."""
        rng = np.random.default_rng(7)
        h, c = shape.hidden, shape.classes

        def small(*size):
            return rng.normal(0, 0.1, size).astype(np.float32)

        mass = np.ones(shape.words)
        mass[:len(counts)] += counts
        groups = np.append(np.add.reduceat(mass, np.arange(0, shape.words, shape.per_class)), rest + 1)
        return cls(shape, {
            "input": small(shape.words + 2, 3 * h), "state": small(h, 3 * h), "class": small(h, c),
            "class_bias": np.log(groups / groups.sum()).astype(np.float32), "word": small(shape.words, h),
            "word_bias": np.log(mass).astype(np.float32)})

    # word numbers: 0 .. words - 1 known words by rank, ``words`` any other, ``words + 1`` start of a text

    def run(self, inputs: np.ndarray, state: np.ndarray, fresh: np.ndarray | None = None, keep: bool = True):
        """States after each step of a window (steps x lanes x hidden), and what training needs of each step.

        Where ``fresh`` (by default: at the start of a text) a step begins with an empty state. Inside, the axes are
        unit, step and lane, so that every operation runs along many lanes.
        """
        w, h = self.weights, self.shape.hidden
        given = np.take(w["input"].T, inputs, axis=1)
        states = np.empty((h, *inputs.shape), np.float32)
        before, own_new = np.empty((2, *(states.shape if keep else (h, 0, 0))), np.float32)
        fresh = inputs == self.shape.words + 1 if fresh is None else fresh
        starts = fresh.any(axis=1).tolist()
        step, state = np.ascontiguousarray(w["state"].T), state.T
        for t, start in enumerate(starts):
            if start:
                state = np.where(fresh[t], np.float32(0), state)
            own, gates, new = step @ state, given[:2 * h, t], given[2 * h:, t]
            gates += own[:2 * h]
            _sigmoid(gates)
            if keep:
                before[:, t], own_new[:, t] = state, own[2 * h:]
            new += gates[h:] * own[2 * h:]
            np.tanh(new, out=new)
            states[:, t] = new + gates[:h] * (state - new)
            state = states[:, t]
        return states.transpose(1, 2, 0), (before, own_new, given[:h], given[h:2 * h], given[2 * h:])

    def output(self, states: np.ndarray, targets: np.ndarray, train: bool = False):
        """Natural log probability of each target (rest words: of their class), and gradients of the sum."""
        w, size = self.weights, self.shape.per_class
        classes = np.where(targets < self.shape.words, targets // size, self.shape.classes - 1)
        order = np.argsort(classes, kind="stable")
        classes, chosen, own = classes[order], targets[order], np.take(states.T, order, axis=1)
        total, d = _log_choice(w["class"].T @ own + w["class_bias"][:, None], classes, train)
        if train:
            grads = {k: np.zeros_like(w[k]) for k in ("word", "word_bias")}
            grads["class"], grads["class_bias"] = own @ d.T, d.sum(axis=1)
            back = w["class"] @ d
        ends = np.searchsorted(classes, np.arange(self.shape.classes))
        for c in range(self.shape.classes - 1):
            at = slice(ends[c], ends[c + 1])
            if at.start == at.stop:
                continue
            part = slice(c * size, min((c + 1) * size, self.shape.words))
            inner, d = _log_choice(w["word"][part] @ own[:, at] + w["word_bias"][part][:, None], chosen[at] - c * size, train)
            total[at] += inner
            if train:
                grads["word"][part], grads["word_bias"][part] = d @ own[:, at].T, d.sum(axis=1)
                back[:, at] += w["word"][part].T @ d
        result = np.empty_like(total)
        result[order] = total
        if not train:
            return result
        flow = np.empty_like(back)
        flow[:, order] = back
        return result, grads, flow.T

    def learn(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray,
              there: np.ndarray | None = None, fresh: np.ndarray | None = None) -> np.ndarray:
        """One training step over a window; returns the state at its end. Steps not ``there`` are padding at lane ends."""
        there = np.ones(inputs.shape, bool) if there is None else there
        w, h = self.weights, self.shape.hidden
        states, (before, own_new, update, reset, new) = (
            self.run(inputs, state) if fresh is None else self.run(inputs, state, fresh))
        fresh = inputs == self.shape.words + 1 if fresh is None else fresh
        back = np.zeros((h, *inputs.shape), np.float32)
        _, grads, found = self.output(states.reshape(-1, h)[there.reshape(-1)], targets[there], True)
        back[:, there] = found.T
        to_new = (1 - update) * (1 - new * new)
        to_update = (before - new) * update * (1 - update)
        to_reset = own_new * reset * (1 - reset)
        given = np.empty((3 * h, *inputs.shape), np.float32)
        flow = np.zeros((h, inputs.shape[1]), np.float32)
        grads["state"] = np.zeros_like(w["state"])
        starts = fresh.any(axis=1).tolist()
        for t in range(len(inputs) - 1, -1, -1):
            flow = flow + back[:, t]
            d_new = flow * to_new[:, t]
            given[:h, t], given[h:2 * h, t], given[2 * h:, t] = flow * to_update[:, t], d_new * to_reset[:, t], d_new
            own = given[:, t].copy()
            own[2 * h:] *= reset[:, t]
            grads["state"] += before[:, t] @ own.T
            flow = flow * update[:, t] + w["state"] @ own
            if starts[t]:
                flow[:, fresh[t]] = 0
        order = np.argsort(inputs, axis=None, kind="stable")
        ids = inputs.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        grads["input"] = np.zeros_like(w["input"])
        grads["input"][ids[first]] = np.add.reduceat(np.take(given.reshape(3 * h, -1), order, axis=1), first, axis=1).T
        for k, g in grads.items():
            g = np.clip(g / np.float32(there.sum()), -self.shape.bound, self.shape.bound)
            s = self.squares.setdefault(k, np.full_like(g, 1e-6))
            s += g * g
            w[k] += np.float32(self.shape.rate) * g / np.sqrt(s)
        return states[-1]


@dataclass
class Lanes:
    """Documents dealt into lanes of about equal length, for steps of many documents at once."""

    inputs: np.ndarray
    targets: np.ndarray
    owners: np.ndarray
    fresh: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], shape: Shape, piece: int | None = None) -> Lanes:
        """``docs``: word numbers of each text, the end included. Padding has owner -1 and stands at lane ends.

        With ``piece``, longer texts are dealt in pieces of so many tokens, each from an empty state on.
        """
        parts = [(d, a) for d, t in enumerate(docs) for a in range(0, len(t), piece or max(len(t), 1))]
        sizes = np.array([min(len(docs[d]) - a, piece or len(docs[d])) for d, a in parts])
        count = int(max(1, min(shape.lanes, len(parts), 4 * sizes.sum() // max(sizes.max(initial=1), 1))))
        heap = [(0, i) for i in range(count)]
        lanes: list[list[int]] = [[] for _ in range(count)]
        loads = [0] * count
        for p in np.argsort(-sizes, kind="stable").tolist():
            load, i = heapq.heappop(heap)
            lanes[i].append(p)
            loads[i] = load + int(sizes[p])
            heapq.heappush(heap, (loads[i], i))
        order = sorted(range(count), key=lambda i: -loads[i])
        made = cls(*(np.full((max(loads), count), v, np.int32) for v in (shape.words + 1, 0, -1)),
                   np.ones((max(loads), count), bool))
        for i, lane in enumerate(order):
            at = 0
            for p in lanes[lane]:
                (d, a), end = parts[p], at + int(sizes[p])
                text = docs[d][a:a + end - at]
                made.targets[at:end, i] = text
                made.inputs[at + 1:end, i] = text[:-1]
                if a:
                    made.inputs[at, i] = docs[d][a - 1]
                made.owners[at:end, i] = d
                made.fresh[at + 1:end, i] = False
                at = end
        return made

    def windows(self, steps: int, tokens: int = 0):
        """Window bounds and how many lanes still have tokens in each. Windows of few lanes are longer, up to about
        ``tokens`` tokens in all."""
        lengths = (self.owners >= 0).sum(axis=0)
        start = 0
        while start < len(self.owners):
            active = int((lengths > start).sum())
            size = max(steps, min(tokens // active, 64 * steps))
            yield slice(start, start + size), active
            start += size


def train_block(model: Model, docs: list[np.ndarray]) -> None:
    """One pass of training over the documents of a block.

    Truncated backpropagation ends at windows. Texts of more than ``piece`` tokens are learned in pieces, each from an
    empty state on, so that lanes are about equally long; every token is learned from, and scoring carries the state on.
    """
    if not docs:
        return
    lanes = Lanes.of(docs, model.shape, model.shape.piece)
    state = np.zeros((lanes.owners.shape[1], model.shape.hidden), np.float32)
    for window, active in lanes.windows(model.shape.steps):
        state = model.learn(lanes.inputs[window][:, :active], lanes.targets[window][:, :active], state[:active],
                            lanes.owners[window][:, :active] >= 0, lanes.fresh[window][:, :active])


def score_block(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document, rest words by their class alone."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lanes = Lanes.of(docs, model.shape)
    state = np.zeros((lanes.owners.shape[1], model.shape.hidden), np.float32)
    for window, active in lanes.windows(model.shape.steps, SCORED_TOGETHER):
        owners = lanes.owners[window][:, :active].reshape(-1)
        states, _ = model.run(lanes.inputs[window][:, :active], state[:active], keep=False)
        state = states[-1]
        there = owners >= 0
        logp = model.output(states.reshape(-1, model.shape.hidden)[there],
                            lanes.targets[window][:, :active].reshape(-1)[there])
        total += np.bincount(owners[there], logp, len(docs))
    return total


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per block: ids, held-out flags, word list with training counts, token numbers, tokens per document."""
    id_type = docs.schema[doc_id].dataType
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))
    source = docs.select(F.col(doc_id).alias("id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType()),
        T.StructField("sizes", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made = 0
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                index: dict[bytes, int] = {END: 0}
                number = index.setdefault
                docs_tokens = []
                for t in text_bytes(part.column("text")):
                    tokens = [number(w, len(index)) for w in t.lower().split()]
                    tokens.append(0)
                    docs_tokens.append(np.array(tokens, np.int32))
                flags = part.column("held").to_pylist()
                learned = [t for t, f in zip(docs_tokens, flags, strict=True) if not f]
                counts = np.bincount(np.concatenate(learned) if learned else np.zeros(0, np.int32), minlength=len(index))
                block = f"{TaskContext.get().partitionId()}-{made}"
                made += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([part.column("id").to_pylist()], arrow.field("ids").type),
                    pa.array([flags], arrow.field("held").type), pa.array([list(index)], arrow.field("words").type),
                    pa.array([counts], arrow.field("counts").type), pa.array([np.concatenate(docs_tokens).tobytes()]),
                    pa.array([np.array([len(t) for t in docs_tokens], np.int64).tobytes()])], schema=arrow)

    return source.mapInArrow(run, schema)


def _numbers(words: list[bytes], rank: dict[bytes, int], rest: int) -> np.ndarray:
    return np.fromiter((rank.get(w, rest) for w in words), np.int32, len(words))


def _documents(numbers: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(numbers, np.cumsum(sizes)[:-1])


def _trained(blocks: DataFrame, first: Model, rank: dict[bytes, int], folder: str) -> Model:
    """Weights trained in every task from the same start, averaged in a tree of at most 32 at a time."""
    packed = blocks.sparkSession.sparkContext.broadcast(pickle.dumps((first, rank)))
    source = blocks.select("held", "words", "tokens", "sizes")

    def run(batches):
        model, known = pickle.loads(packed.value)
        seen = 0
        for batch in batches:
            for row in range(batch.num_rows):
                held, words, tokens, sizes = (batch.column(i)[row] for i in range(4))
                numbers = _numbers(words.as_py(), known, model.shape.words)[np.frombuffer(tokens.as_py(), np.int32)]
                docs = _documents(numbers, np.frombuffer(sizes.as_py(), np.int64))
                docs = [d for d, h in zip(docs, held.as_py(), strict=True) if not h]
                train_block(model, docs)
                seen += sum(map(len, docs))
        if seen:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "seen": pa.array([seen], pa.int64()),
                "weights": pa.array([pickle.dumps(model.weights)], pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_pylist()
        total: dict[str, np.ndarray] = {}
        for n, packed_weights in zip(seen, table.column("weights"), strict=True):
            for k, v in pickle.loads(packed_weights.as_py()).items():
                total[k] = total.get(k, 0) + v.astype(np.float64) * n
        weights = {k: (v / sum(seen)).astype(np.float32) for k, v in total.items()}
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // 32], pa.int64()),
                         "seen": pa.array([sum(seen)], pa.int64()), "weights": pa.array([pickle.dumps(weights)], pa.binary())})

    schema = "part bigint, seen bigint, weights binary"
    vectors = stored(source.mapInArrow(run, schema), folder)
    while (top := vectors.agg(F.count("*").alias("n"), F.max("part").alias("m")).first()).n > 1:
        vectors = vectors.groupBy(F.floor(F.col("part") / 32)).applyInArrow(mean, schema)
        vectors = stored(vectors, folder)
        if top.m == 0:
            break
    row = vectors.select("weights").first()
    return Model(first.shape, pickle.loads(row.weights)) if row else first


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are A-Z-lower-cased runs without ASCII white space and one end. Documents whose crc32 of the id mod 7 is 2
    are held out of all learning; a null id is not. ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens
    (c: count of the token, N: all tokens, V: different tokens, in training texts); ``score`` is log10 of the recurrent
    model's probability of the text. Null and empty texts have one token, the end. Repeated rows are scored and learned
    from each. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    blocks = stored(_blocks(docs, doc_id, text), folder)
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", F.col("pos").alias("place"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    counts = stored(listed.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), folder)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(shape.words).collect()
    rank = {bytes(r.word): i for i, r in enumerate(top)}
    known = np.array([r.c for r in top], np.float64)
    rest_n, rest_v = total.n - int(known.sum()), total.v - len(top)
    model = _trained(blocks, Model.fresh(shape, known, rest_n), rank, folder)
    packed = context.broadcast(pickle.dumps(Model(shape, model.weights)))
    base_all, rest_all, train_tokens = total.n + total.v + 1, rest_n + rest_v + 1, total.n
    held = T.StructField("held_out", T.BooleanType())
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), held] + T.StructType.fromDDL(
        "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields)
    arrow = to_arrow_schema(schema)

    def score(block: pa.Table, counted: pa.Table) -> pa.Table:
        lm = pickle.loads(packed.value)
        row = {n: block.column(n)[0].as_py() for n in ("ids", "held", "tokens", "sizes")}
        sizes = np.frombuffer(row["sizes"], np.int64)
        tokens = np.frombuffer(row["tokens"], np.int32)
        place = counted.column("place").to_numpy()
        count, numbers = np.zeros(tokens.max() + 1), np.full(tokens.max() + 1, lm.shape.words, np.int32)
        count[place], numbers[place] = counted.column("c").to_numpy(), counted.column("number").to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(owner, np.log10((count + 1) / base_all)[tokens], len(sizes))
        inside = np.where(numbers == lm.shape.words, np.log10((count + 1) / rest_all), 0)
        model_score = score_block(lm, _documents(numbers[tokens], sizes)) / np.log(10)
        model_score = model_score + np.bincount(owner, inside[tokens], len(sizes))
        return pa.table([
            pa.array(row["ids"], arrow.field(0).type), pa.array(row["held"], pa.bool_()), pa.array(sizes),
            pa.array(np.bincount(owner, (count > 0)[tokens], len(sizes)).astype(np.int64)),
            pa.array(np.full(len(sizes), train_tokens, np.int64)), pa.array(base), pa.array(model_score)], schema=arrow)

    numbered = docs.sparkSession.createDataFrame([(bytearray(w), i) for w, i in rank.items()], "word binary, number int")
    counts = counts.join(F.broadcast(numbered), "word", "left")  # as many rows as the model knows words
    counted = listed.select("block", "place", "word").join(counts, "word").select(
        F.col("block").alias("of"), "place", "c", F.coalesce("number", F.lit(shape.words)).alias("number"))
    whole = blocks.select("block", "ids", "held", "tokens", "sizes")
    return whole.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(score, schema)

"""Log-bilinear language model: trained with noise-contrastive estimation, normalised by batched matrix products.

The next word's vector is predicted as r[a] C1 + r[b] C2 from the vectors of the word before (a) and the one before that
(b, told apart only among the most frequent words); its score against each word vector plus a bias is the logarithm of a
probability up to the context's normaliser. Contexts are therefore finite, and all normalisers are one table, computed in
blocks by matrix products. The vocabulary is the most frequent tokens, the end of a text, and one entry for all other
tokens; within that entry a token has its share of the discounted training counts, and tokens never seen in training are
one event together. The model is thus a distribution over the same events as the counts.

Counts cover every training document. Training passes over every training document once, in rounds: in each round every
shard starts from the same parameters and walks through its documents, and the results are averaged in groups, level by
level. A shard is the documents of a hash of the id, in the order of id and text, so equal tables give equal scores
whatever their files. An id with very many rows is one shard. Only vocabulary-sized tables reach the driver or are broadcast. Null and empty texts consist of the end alone;
repeated rows get equal scores; without training rows every count is zero and only unseen events remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from routeloom.session import durable

from .common import flat, fold_of, hashed_words, texts

#: Words with a vector; words told apart two places back; size of a vector; tokens whose counts are broadcast.
VOCAB, FAR_WORDS, DIM, HEAD = 4_096, 63, 16, 200_000
#: Noise words of a batch, positions of a batch, step size, tasks averaged at once.
NOISE, BATCH, RATE, FAN = 64, 4_096, 0.06, 64
#: Training tokens of a shard in all rounds together, about.
SHARD_TOKENS = 2_000_000
UNK, END, START = 0, 1, 2
#: The end of a text as a token; no word hashes to it but by chance of 2^-64.
END_HASH = -1


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c): counts of all tokens by 64-bit hash. Each batch is folded in its task before anything moves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [h for _, _, h, _ in hashed_words(*flat(b.column("text")))]
            value, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value.view(np.int64), END_HASH)), pa.array(np.append(n, b.num_rows))], names=["token", "c"])

    return train.select("text").mapInArrow(rows, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass(frozen=True)
class Totals:
    """Sums over all training tokens: how many, how many different, those outside the vocabulary, and the discount of the latter."""

    n: int
    distinct: int
    rest: int
    rest_distinct: int
    discount: float

    def unseen(self) -> float:
        """Share of the never-seen event within the entry for other tokens."""
        return self.discount * self.rest_distinct / self.rest if self.rest else 1.0


class Model:
    """Head tokens with counts, and the parameters. Vocabulary numbers: 0 other, 1 end, 2 start, then by falling count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: Totals, seed: int = 11):
        self.totals = totals
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[order], counts[order]
        words = [i for i in np.lexsort((hashes, -counts)) if hashes[i] != END_HASH][:VOCAB - 3]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = np.full(len(order), UNK, np.int32)
        self.ids[place[words]] = np.arange(3, 3 + len(words))
        self.ids[self.hashes == END_HASH] = END
        self.size = 3 + len(words)
        c = np.zeros(self.size)
        c[3:] = counts[words]
        c[END] = counts[hashes == END_HASH].sum()
        c[UNK] = totals.rest
        self.unigram = (c + 0.5) / (c.sum() + 0.5 * self.size)
        self.unigram[START] = 0
        rng = np.random.default_rng(seed)
        self.params = {"r": rng.normal(0, 0.1, (self.size, DIM)), "q": rng.normal(0, 0.1, (self.size, DIM)), "c1": np.eye(DIM), "c2": np.eye(DIM) * 0.3,
                       "b": np.log(np.maximum(self.unigram, 1e-30))}
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vocabulary number, count, whether the count is known here) of token hashes."""
        h = h.view(np.int64)
        if not len(self.hashes):
            return np.full(len(h), UNK, np.int32), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[i] == h
        return np.where(ok, self.ids[i], UNK), np.where(ok, self.counts[i], 0), ok

    @staticmethod
    def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, target, text): every token and each text's end, with the two tokens before; text ends make the arrays longer by one per text."""
        n, m = len(ids), len(first) - 1
        text = np.concatenate((np.repeat(np.arange(m), np.diff(first)), np.arange(m)))
        order = np.argsort(text, kind="stable")
        target = np.concatenate((ids, np.full(m, END, ids.dtype)))[order]
        text = text[order]
        begins = first[:-1] + np.arange(m)
        a = np.concatenate(([START], target[:-1])) if n + m else target
        a[begins] = START
        b = np.concatenate(([START], a[:-1])) if n + m else target
        b[begins] = START
        return a, np.where(b < 3 + FAR_WORDS, b, UNK), target, text

    def normalisers(self) -> np.ndarray:
        """ln Z of every context (a, b), by blocks of matrix products over the whole vocabulary."""
        p = self.params
        far = min(3 + FAR_WORDS, self.size)
        one, two = p["r"] @ p["c1"], p["r"][:far] @ p["c2"]
        out = np.empty((self.size, far), np.float32)
        bias = p["b"].copy()
        bias[START] = -np.inf
        q = np.ascontiguousarray(p["q"].T)
        base = np.exp(bias - bias.max())
        for i in range(0, self.size, 32):
            h = (one[i:i + 32, None, :] + two[None]).reshape(-1, DIM)
            s = h @ q
            top = s.max(1, keepdims=True)
            np.exp(s - top, out=s)
            out[i:i + 32] = (np.log(s @ base) + top[:, 0] + bias.max()).reshape(-1, far)
        return out

    def log_probs(self, z: np.ndarray, a: np.ndarray, b: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of normalised probabilities."""
        p = self.params
        one, two = p["r"] @ p["c1"], p["r"][:z.shape[1]] @ p["c2"]
        out = np.empty(len(a), np.float64)
        for i in range(0, len(a), 1 << 16):
            x, y, t = a[i:i + (1 << 16)], b[i:i + (1 << 16)], target[i:i + (1 << 16)]
            out[i:i + (1 << 16)] = np.einsum("ij,ij->i", one[x] + two[y], p["q"][t]) + p["b"][t] - z[x, y]
        return out

    def walk(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[dict[str, np.ndarray], int]:
        """One pass of noise-contrastive estimation over (a, b, target) batches: adaptive steps from the current parameters."""
        p = {k: v.copy() for k, v in self.params.items()}
        seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        rng, total = np.random.default_rng(seed), 0
        steps = np.cumsum(self.unigram)

        def scatter(at: np.ndarray, g: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(at, g[:, j], self.size) for j in range(DIM)], 1).astype(np.float32)

        for a, b, t in batches:
            noise = np.minimum(np.searchsorted(steps, rng.random(NOISE) * steps[-1]), self.size - 1)
            log_noise = np.log(NOISE * np.maximum(self.unigram, 1e-30)).astype(np.float32)
            ra, rb, qt, qn = p["r"][a], p["r"][b], p["q"][t], p["q"][noise]
            h = ra @ p["c1"] + rb @ p["c2"]
            yes = np.einsum("ij,ij->i", h, qt) + p["b"][t] - log_noise[t]
            no = h @ qn.T + (p["b"][noise] - log_noise[noise])
            e_yes = -1 / (1 + np.exp(np.clip(yes, -30, 30)))  # gradients of the loss by the scores
            e_no = 1 / (1 + np.exp(np.clip(-no, -30, 30)))
            gh = e_yes[:, None] * qt + e_no @ qn
            g = {"q": scatter(t, e_yes[:, None] * h), "b": np.bincount(t, e_yes, self.size).astype(np.float32),
                 "r": scatter(a, gh @ p["c1"].T) + scatter(b, gh @ p["c2"].T), "c1": ra.T @ gh, "c2": rb.T @ gh}
            gn = e_no.T @ h
            for j, w in enumerate(noise):
                g["q"][w] += gn[j]
            np.add.at(g["b"], noise, e_no.sum(0))
            for k, x in g.items():
                x /= len(a)
                seen[k] += x * x * 1e4
                p[k] -= RATE * 100 * x / np.sqrt(seen[k]) * (0.1 if k in ("c1", "c2") else 1.0)
            total += len(a)
        return p, total


def _packed(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in ("r", "q", "c1", "c2", "b"))


def _unpacked(data: bytes, size: int) -> dict[str, np.ndarray]:
    x, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k, shape in (("r", (size, DIM)), ("q", (size, DIM)), ("c1", (DIM, DIM)), ("c2", (DIM, DIM)), ("b", (size,))):
        n = int(np.prod(shape))
        out[k], at = x[at:at + n].reshape(shape).copy(), at + n
    return out


def _averaged(df: DataFrame) -> DataFrame:
    """Weighted means of the parameters of up to FAN tasks per group."""

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        weight = rows.column("weight").to_numpy()
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) * w for x, w in zip(rows.column("params"), weight))
        return pa.table({"task": rows.column("group").slice(0, 1), "weight": pa.array([int(weight.sum())], pa.int64()), "params": pa.array([(total / weight.sum()).astype("<f4").tobytes()], pa.binary())})

    return df.withColumn("group", F.floor(F.col("task") / FAN).cast("int")).groupBy("group").applyInArrow(mean, "task int, weight bigint, params binary")


def fit(docs: DataFrame, counts: DataFrame, in_training: Column, fold: Column, rounds: list[int]) -> Model:
    """Counts become the vocabulary; then one round for each fold of the training documents."""
    # Tokens by eighths of powers of two of their count: few rows, whatever the input; whole levels are taken while they fit,
    # and of the next one the tokens of so many hash buckets as still fit.
    level, bucket = F.floor(F.log2("c") * 8), F.pmod(F.xxhash64("token"), F.lit(1024))
    levels = sorted((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())[::-1]
    least, held, over = 1 << 20, 0, None
    for at, n in levels:
        if held + n > HEAD:
            over = at
            break
        least, held = at, held + n
    wanted = level >= least
    if over is not None:
        most = -1
        for at, n in sorted((r["bucket"], r["n"]) for r in counts.where(level == over).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if held + n > HEAD:
                break
            most, held = at, held + n
        wanted = wanted | ((level == over) & (bucket <= most))
    top = counts.where(wanted | (F.col("token") == END_HASH)).toPandas().sort_values(["c", "token"], ascending=[False, True])
    hashes, c = top["token"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("one"), F.sum((F.col("c") == 2).cast("long")).alias("two")).first()
    words = np.sort(c[hashes != END_HASH])[::-1][:VOCAB - 3]
    n, v, one, two = (int(sums[x] or 0) for x in ("n", "v", "one", "two"))
    rest, rest_distinct = n - int(words.sum()) - int(c[hashes == END_HASH].sum()), v - len(words) - int((hashes == END_HASH).sum())
    model = Model(hashes, c, Totals(n, v, rest, rest_distinct, min(0.95, max(0.05, one / (one + 2 * two) if one else 0.5))))
    # Documents go to shards by their id, and into one order within a shard, so that neither files nor lost executors change
    # the result. Their number follows from the tokens.
    shards = max(1, n // SHARD_TOKENS)
    for r in rounds:
        current = model

        def train(batches: Iterator[pa.RecordBatch], current: Model = current, r: int = r) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            task = TaskContext.get().partitionId()

            def positions() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                held: list[tuple[np.ndarray, ...]] = []
                for b in batches:
                    for i, j, h, first in hashed_words(*flat(b.column("text"))):
                        held.append(Model.contexts(current.lookup(h)[0], first)[:3])
                        if sum(len(x[0]) for x in held) >= BATCH:
                            yield from cut(held)
                            held = []
                if held:
                    yield from cut(held)

            def cut(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
                whole = [np.concatenate(x) for x in zip(*held)]
                parts = max(1, round(len(whole[0]) / BATCH))
                yield from zip(*(np.array_split(x, parts) for x in whole))

            p, n = current.walk(positions(), r * 1_000_003 + task)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([_packed(p)], pa.binary())], names=["task", "weight", "params"])

        own = docs.where(in_training & (fold == r)).repartition(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        done = own.select("text").mapInArrow(train, "task int, weight bigint, params binary")
        tasks = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a step too many averages one row with itself
        while tasks > 1:
            done, tasks = _averaged(done), -(-tasks // FAN)
        got = done.orderBy("task").first()
        if got:
            model.params = _unpacked(bytes(got["params"]), model.size)
    return model


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Training rows are those whose fold is not ``held``."""
    d = texts(docs)
    fold = fold_of("doc_id", folds)
    counts = durable(token_counts(d.where(fold != held)))
    model = fit(d, counts, fold != held, fold, [i for i in range(folds) if i != held])
    z = model.normalisers()
    t = model.totals
    below = t.n + 0.5 * (t.distinct + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = flat(b.column("text"))
            n_tokens, n_known, base, log_p, rare = [], [], [], [], []
            for i, j, h, first in hashed_words(raw, offs):
                ids, c, ok = model.lookup(h)
                a, two, target, text = Model.contexts(ids, first)
                m = j - i
                owner = np.repeat(np.arange(m), np.diff(first))
                _, end_count, _ = model.lookup(np.array([END_HASH], np.int64))
                here = ok & (c > 0)
                # Counts that are not broadcast are added after a join; their tokens travel with the row.
                base.append(np.bincount(owner[here], np.log10((c[here] + 0.5) / below), m) + np.log10((end_count[0] + 0.5) / below))
                inner = here & (ids == UNK)
                share = np.log10(np.maximum(c[inner] - t.discount, 1e-9) / max(t.rest, 1))
                log_p.append(np.bincount(text, model.log_probs(z, a, two, target), m) / np.log(10) + np.bincount(owner[inner], share, m))
                n_tokens.append(np.diff(first) + 1)
                n_known.append(np.bincount(owner[here], minlength=m) + int(end_count[0] > 0))
                lost = np.flatnonzero(~ok)
                cuts = np.searchsorted(owner[lost], np.arange(m + 1))
                rare += [h[lost[x:y]].view(np.int64) for x, y in zip(cuts[:-1], cuts[1:])]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rare]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64), pa.int64()))
            joined = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), joined(n_tokens, pa.int64()), joined(n_known, pa.int64()), joined(base, pa.float64()), joined(log_p, pa.float64()), lists],
                                             names=["doc_id", "n_tokens", "n_known", "base", "log_p", "rare"])

    first = durable(d.mapInArrow(rows, "doc_id bigint, n_tokens bigint, n_known bigint, base double, log_p double, rare array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    each = first.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("c", F.lit(0))
    known = c > 0
    inner = F.when(known, F.log10(F.greatest(c - t.discount, F.lit(1e-9)) / max(t.rest, 1))).otherwise(F.lit(float(np.log10(max(t.unseen(), 1e-12)))))
    # Sums of decimals, which unlike those of doubles do not depend on the order in which rows arrive.
    exact = lambda x: F.sum((F.col("times") * x).cast("decimal(38,18)")).cast("double")
    more = each.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("known"), exact(F.log10((c + 0.5) / F.lit(below))).alias("base_more"), exact(inner).alias("p_more"))
    out = first.drop("rare").join(more, "row", "left")
    zero = F.lit(0)
    return out.select("doc_id", (fold == held).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(t.n).cast("bigint").alias("train_tokens"),
                      (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("log_p") + F.coalesce("p_more", zero)).alias("score"))

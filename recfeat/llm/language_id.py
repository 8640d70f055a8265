"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions with gated units (GRU), gives every byte position a
distribution over the languages, and a document's distribution is the mean over all its positions. Long
texts are read in strips of ``STRIP`` bytes, all of them, so that many strips run side by side.
Training is backpropagation through time in numpy on a bounded, documented sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused_name

STRIP = 64
SAMPLE_PER_LANGUAGE = 300
"""At most about so many labelled rows of each language are learned from."""
SAMPLE_CHARS, SAMPLE_PLACES = 256, 4
"""Characters of a sampled text that are learned from, about, and the places, spread over the text, from which they come."""
UNKNOWN = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function, several times cheaper than tanh."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _gate(y: np.ndarray) -> np.ndarray:
    """From (-1, 1) to (0, 1), in place."""
    y *= y.dtype.type(0.5)
    y += y.dtype.type(0.5)
    return y


def _gate_slope(g: np.ndarray) -> np.ndarray:
    """The slope of the gate by its input, from its value."""
    return 0.5 * (1 - np.abs(2 * g - 1)) ** 2


@dataclass
class Network:
    """Weights: for each direction the input tables (one row a byte) and recurrent matrices, then the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = 8, seed: int = 0) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            w[f"b{d}"] = np.zeros(3 * hidden)
        w["o"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        w["c"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, strips: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (time, strip, unit) of one direction; strips: bytes (time, strip). keep: for training.

        z = gate(x_z + h u_z), r = gate(x_r + h u_r), c = soft(x_c + r (h u_c)), h' = h + z (c - h).
        """
        x, u, b = (self.weights[k + d] for k in "xub")
        n = u.shape[0]
        xz, xr, xc = (np.ascontiguousarray((x + b)[:, i * n : (i + 1) * n]) for i in range(3))
        uz, ur, uc = (np.ascontiguousarray(u[:, i * n : (i + 1) * n]) for i in range(3))
        h = np.zeros((strips.shape[1], n), dtype=u.dtype)
        out, kept = np.empty((*strips.shape, n), dtype=u.dtype), []
        for t in range(len(strips)) if d == "f" else range(len(strips) - 1, -1, -1):
            now = strips[t]
            z = h @ uz
            z += xz.take(now, axis=0)
            z = _gate(_soft(z))
            r = h @ ur
            r += xr.take(now, axis=0)
            r = _gate(_soft(r))
            pre = h @ uc
            c = pre * r
            c += xc.take(now, axis=0)
            c = _soft(c)
            if keep:
                kept.append((t, h, z, r, pre, c))
            step = c - h
            step *= z
            h = np.add(h, step, out=out[t])
        return out, kept

    def positions(self, strips: np.ndarray) -> np.ndarray:
        """Probabilities (time, strip, language) of every byte position."""
        o, n = self.weights["o"], self.weights["uf"].shape[0]
        scores = self.states(strips, "f")[0].reshape(-1, n) @ o[:n]
        scores += self.states(strips, "b")[0].reshape(-1, n) @ o[n:]
        scores += self.weights["c"] - np.abs(o).sum(axis=0).max()  # states lie within -1 and 1, so none overflows
        np.exp(scores, out=scores)
        scores /= scores @ np.ones((scores.shape[1], 1), dtype=scores.dtype)
        return scores.reshape(*strips.shape, -1)

    def gradients(self, strips: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions marked ``real``, and its gradients by backpropagation through time."""
        w, (steps, width) = self.weights, strips.shape
        runs = {d: self.states(strips, d, keep=True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        flat = both.reshape(-1, both.shape[2])
        scores = flat @ w["o"] + w["c"]
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        target, weight = np.tile(labels, steps), real.reshape(-1).astype(np.float32)
        weight /= max(1.0, weight.sum())
        loss = float(-(np.log(p[np.arange(len(p)), target] + 1e-9) * weight).sum())
        p[np.arange(len(p)), target] -= 1
        p *= weight[:, None]
        g = {"o": flat.T @ p, "c": p.sum(axis=0)}
        back = (p @ w["o"].T).reshape(steps, width, -1)
        n = back.shape[2] // 2
        for k, d in enumerate("fb"):
            x, u = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"u{d}"])
            later = np.zeros((width, n), dtype=np.float32)
            for t, h, z, r, pre, c in reversed(runs[d][1]):
                dh = later + back[t, :, k * n : (k + 1) * n]
                dz = dh * (c - h) * _gate_slope(z)
                dc = dh * z * (1 - np.abs(c)) ** 2
                dr = dc * pre * _gate_slope(r)
                a = np.concatenate([dz, dr, dc], axis=1)  # into the input table
                np.add.at(x, strips[t], a)
                a[:, 2 * n :] *= r  # the candidate's recurrent part passes the reset gate
                u += h.T @ a
                later = dh * (1 - z) + a @ w[f"u{d}"].T
            g[f"x{d}"], g[f"u{d}"], g[f"b{d}"] = x, u, x.sum(axis=0)
        return loss, g

    @staticmethod
    def fit(texts: list[bytes], labels: list[str], hidden: int = 8, epochs: int = 5, batch: int = 256, rate: float = 0.02, seed: int = 0) -> Network:
        """A network trained with Adam on labelled texts, each cut into strips."""
        net = Network.fresh(sorted(set(labels)), hidden, seed)
        if len(net.languages) < 2:
            return net
        strips, of = _strips(texts)
        target = np.array([net.languages.index(x) for x in labels])[of]
        real = strips > 0
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(of))
            for at in range(0, len(order), batch):
                mine, step = order[at : at + batch], step + 1
                _, g = net.gradients(np.ascontiguousarray(strips[:, mine]), real[:, mine], target[mine])
                for k, v in g.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * v * v
                    change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    net.weights[k] = (net.weights[k] - rate * change).astype(np.float32)
        return net

    def documents(self, texts: list[bytes], width: int = 2048) -> np.ndarray:
        """The mean distribution over all byte positions of each text (zeros for an empty one)."""
        total = np.zeros((len(texts), len(self.languages)))
        strips, of = _strips(texts)
        for at in range(0, len(of), width):
            part = np.ascontiguousarray(strips[:, at : at + width])
            p = self.positions(part)
            p *= (part > 0)[:, :, None]
            np.add.at(total, of[at : at + width], p.sum(axis=0))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def runs(self, text: bytes) -> list[tuple[int, int, str]]:
        """The label of every position of one text, as runs (start byte, end byte, language)."""
        strips, _ = _strips([text])
        best = self.positions(strips).argmax(axis=2).T.reshape(-1)[: len(text)] if text else np.zeros(0, int)
        edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else []
        return [(a, b, self.languages[best[a]]) for a, b in zip(edges, edges[1:])]


def _strips(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as (time, strip), the last strip of each padded with 0; and each strip's text."""
    counts = np.array([-(-len(t) // STRIP) for t in texts], dtype=np.int64)
    flat = b"".join(t.ljust(c * STRIP, b"\0") for t, c in zip(texts, counts.tolist()))
    return np.frombuffer(flat, dtype=np.uint8).reshape(-1, STRIP).T, np.repeat(np.arange(len(texts)), counts)


def train(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE, hidden: int = 8, epochs: int = 5, sample_chars: int = SAMPLE_CHARS, sample_places: int = SAMPLE_PLACES,
) -> Network:
    """A network from about ``per_language`` rows of each label, chosen by a hash of the key and text.

    Rows with a null text or label are left out. Of a sampled text ``sample_chars`` characters are learned from,
    in equal parts from ``sample_places`` places spread evenly over it, so that boilerplate in one place does not
    stand for the text; a shorter text is read whole. Without labelled rows the network knows no language.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).alias("l")).count().collect()}
    if not sizes:
        return Network([], {})
    share = F.coalesce(*[F.when(F.col(label_col) == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64(F.col(key_col), F.length(text_col)), F.lit(1 << 30)) / float(1 << 30)
    each = max(1, sample_chars // sample_places)
    free, steps = F.greatest(F.lit(0), F.length(text_col) - each), max(1, sample_places - 1)
    parts = F.concat(*[F.substring(text_col, F.floor(free * k / steps).cast("int") + 1, F.lit(each)) for k in range(sample_places)])
    spread = F.when(F.length(text_col) <= each * sample_places, F.col(text_col)).otherwise(parts)
    chosen = rows.where(draw < share).select(spread.cast("binary").alias("t"), F.col(label_col).alias("l"), draw.alias("d"))
    sample = chosen.orderBy("d", "t", "l").limit(2 * per_language * len(sizes)).collect()
    return Network.fit([bytes(r[0]) for r in sample], [r[1] for r in sample], hidden, epochs)


def annotate(
    docs: DataFrame, network: Network, text_col: str = "text", keep: list[str] | None = None, with_runs: bool = False
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``, from each whole text alone.

    ``score`` is the pooled probability of the chosen language; of equally likely ones the first by name. A null text and one without a letter
    (Unicode category L) get ``und`` with score 0, as does every text if the network knows no language.
    ``with_runs`` adds ``runs``, the label of every byte position as ``array<struct<start,end,lang>>``.
    Added columns get underscores in front where ``docs`` has such names. Repeated rows and null ids each
    give a row; an empty table gives none.
    """
    keep = list(docs.columns if keep is None else keep)
    sent = docs.sparkSession.sparkContext.broadcast((network.languages, network.weights))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    fields += [T.StructField(unused_name(docs, "lang_pred"), T.StringType()), T.StructField(unused_name(docs, "score"), T.DoubleType())]
    if with_runs:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
        fields.append(T.StructField(unused_name(docs, "runs"), T.ArrayType(span)))
    schema = T.StructType(fields)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(len(keep)).to_pylist()]
                known = [bool(t) and bool(net.languages) for t in texts]
                if net.languages:
                    p = net.documents(texts)
                    best, top = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
                else:
                    best = top = [0] * len(texts)
                out = [
                    *part.columns[: len(keep)],
                    pa.array([net.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array([min(1.0, s) if k else 0.0 for s, k in zip(top, known)], pa.float64()),
                ]
                if with_runs:
                    runs = [[dict(zip(("start", "end", "lang"), r)) for r in net.runs(t)] if k else [] for t, k in zip(texts, known)]
                    out.append(pa.array(runs, run_type))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    return docs.select(*keep, lettered.alias(unused_name(docs, "bytes_read"))).mapInArrow(run, schema)


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """``(id_col, lang_pred, score[, runs])`` of every row; see ``annotate``. Other columns are not read."""
    return annotate(docs.select(*dict.fromkeys((id_col, text_col))), network, text_col, [id_col], with_runs)

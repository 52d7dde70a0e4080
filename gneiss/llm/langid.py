"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every byte with a distribution over
the languages, and a document's probabilities are the mean over all of its bytes. It is
trained here, in numpy, by backpropagation through time, with a loss at every position.

Training uses a bounded sample: for each language the ``SAMPLE`` documents of smallest hash of id and text
(all, if it has fewer) and, of each, ``EXCERPT`` characters from a place that the hash picks. Prediction reads
every byte of every text, in segments of ``SEGMENT`` bytes that each start from empty states;
segments of many texts run side by side, so memory depends on the tile, not on a text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
when there is nothing to learn from; null languages are not learned; a null id is not held
out, and its row is learned from like others; repeated rows are learned from once and predicted alike; equally
probable languages: the first by name; a column of more than ``MOST_LANGUAGES`` names is refused; an empty
table gives an empty result; the prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, trim

HIDDEN = 8
SEGMENT = 128
TILE = 2048
SAMPLE = 600
EXCERPT = 256
#: With more language names than this, the column is refused.
MOST_LANGUAGES = 1000
BATCH = 128
STEPS = 450
RATE = 0.02
#: Texts that are padded at a time.
STEP = 1024
UNKNOWN = "und"


def fold(id_col: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))


# ---- the network: arrays have positions of a segment first, then units, then segments ----


def _start(classes: int, rng) -> dict[str, np.ndarray]:
    h = HIDDEN
    w = {}
    for d in "fb":
        w["x" + d] = rng.normal(0, 0.3, (3 * h, 256))
        w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h))
        w["c" + d] = np.zeros((h, 1))
        w["o" + d] = rng.normal(0, 1 / np.sqrt(h), (classes, h))
    w["bias"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _walk(w, d: str, seg: np.ndarray, mask: np.ndarray | None, keep=None) -> np.ndarray:
    """States of one direction at every position: (T, H, B). Gates: update, reset, new."""
    h, (t_all, n) = HIDDEN, seg.shape
    x, u, c = w["x" + d], w["u" + d], w["c" + d]
    out = np.empty((t_all, h, n), np.float32)
    s = np.zeros((h, n), np.float32)
    half = np.float32(0.5)
    for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
        a = x.take(seg[t], axis=1, mode="clip")
        g = u @ s
        zr = a[: 2 * h]
        zr += g[: 2 * h]
        zr *= half
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        un = g[2 * h :] + c
        new = zr[h:] * un
        new += a[2 * h :]
        np.tanh(new, out=new)
        was = s
        s = was - new
        s *= zr[:h]
        s += new
        if mask is not None:
            s *= mask[t]
        out[t] = s
        if keep is not None:
            keep[t] = (zr, un, new, was)
    return out


def _outputs(w, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Probabilities at every position: (T, K, B)."""
    logits = np.matmul(w["of"], hf)
    logits += np.matmul(w["ob"], hb)
    logits += w["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _back(w, d: str, seg, mask, keep, gh: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Gradients of one direction, back through time from those of its states."""
    h, (t_all, n) = HIDDEN, seg.shape
    u = w["u" + d]
    gx, gu, gc = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros_like(w["c" + d])
    carry = np.zeros((h, n), np.float32)
    for t in range(t_all - 1, -1, -1) if d == "f" else range(t_all):
        zr, un, new, was = keep[t]
        z, r = zr[:h], zr[h:]
        gs = (gh[t] + carry) * mask[t]
        gnew = gs * (1 - z) * (1 - new * new)
        gz = gs * (was - new) * z * (1 - z)
        gr = gnew * un * r * (1 - r)
        gun = gnew * r
        gin = np.concatenate((gz, gr, gnew))
        grec = np.concatenate((gz, gr, gun))
        gu += grec @ was.T
        gc += gun.sum(axis=1, keepdims=True)
        carry = gs * z + u.T @ grec
        np.add.at(gx, seg[t], gin.T)
    grad["x" + d], grad["u" + d], grad["c" + d] = gx.T, gu, gc


def gradients(w, seg: np.ndarray, mask: np.ndarray, ys: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean over all positions of -log p(label), by backpropagation through time."""
    keep = {d: [None] * len(seg) for d in "fb"}
    hs = {d: _walk(w, d, seg, mask, keep[d]) for d in "fb"}
    g = _outputs(w, hs["f"], hs["b"])
    g[:, ys, np.arange(len(ys))] -= 1
    g *= mask / mask.sum()
    grad = {"bias": g.sum(axis=(0, 2))[:, None]}
    for d in "fb":
        grad["o" + d] = np.einsum("tkb,thb->kh", g, hs[d], optimize=True)
        _back(w, d, seg, mask, keep[d], np.matmul(w["o" + d].T, g), grad)
    return grad


def train(texts: list[bytes], labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = _start(classes, rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    segs, lens, ys = [], [], []
    for text, y in zip(texts, labels, strict=True):
        for i in range(0, len(text), SEGMENT):
            if len(part := text[i : i + SEGMENT]) >= 8 or i == 0:
                segs.append(part.ljust(SEGMENT, b"\0"))
                lens.append(len(part))
                ys.append(y)
    data = np.frombuffer(b"".join(segs), np.uint8).reshape(-1, SEGMENT)
    lens, ys = np.array(lens), np.array(ys)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(ys), BATCH)
        seg = np.ascontiguousarray(data[pick].T)
        mask = (np.arange(SEGMENT)[:, None] < lens[pick]).astype(np.float32)[:, None, :]
        grad = gradients(w, seg, mask, ys[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in grad.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1[k] += 0.1 * (v - m1[k])
            m2[k] += 0.001 * (v * v - m2[k])
            w[k] = (w[k] - rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    return w


def label_positions(w, data: bytes) -> np.ndarray:
    """The label of every byte of one text."""
    out = np.zeros(len(data), np.int64)
    for i in range(0, len(data), SEGMENT):
        seg = np.frombuffer(data[i : i + SEGMENT], np.uint8)[:, None]
        out[i : i + SEGMENT] = _outputs(w, _walk(w, "f", seg, None), _walk(w, "b", seg, None))[:, :, 0].argmax(axis=1)
    return out


def pool(w, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text: (texts, K); zeros for empty ones."""
    classes = len(w["bias"])
    sums = np.zeros((len(texts), classes))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return sums
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)[counts > 0] - 1
    lens = np.full(len(owner), SEGMENT)
    lens[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * SEGMENT
    padded = np.zeros(len(owner) * SEGMENT, np.uint8)
    # Full bytes of a text lie together: pad only each text's last segment.
    at = np.concatenate(([0], np.cumsum(counts * SEGMENT)))
    for i, t in enumerate(texts):
        padded[at[i] : at[i] + len(t)] = np.frombuffer(t, np.uint8)
    segs = padded.reshape(-1, SEGMENT)
    order = np.argsort(-lens, kind="stable")
    for i in range(0, len(order), TILE):
        rows = order[i : i + TILE]
        top = int(lens[rows[0]])
        seg = np.ascontiguousarray(segs[rows, :top].T)
        full = lens[rows[-1]] == top
        mask = None if full else (np.arange(top)[:, None] < lens[rows]).astype(np.float32)[:, None, :]
        p = _outputs(w, _walk(w, "f", seg, mask), _walk(w, "b", seg, mask))
        if mask is not None:
            p *= mask
        np.add.at(sums, owner[rows], p.sum(axis=0).T)
    return sums / np.maximum(sizes, 1)[:, None]


# ---- the operator ----


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE) -> list[tuple[str, bytes]]:
    """Excerpts of the ``per_lang`` documents of smallest hash in each language. A document is an id and a text:
    repeated ones count once, and those that share an id, or have none, are told apart. Counts of rows pick a
    hash limit that leaves about twice as many; languages of which too few different documents lie below
    theirs, because rows are repeated, are read again with a larger one, until they have enough or all."""
    learned = docs.where(F.col(lang_col).isNotNull() & F.coalesce(F.length(text_col) > 0, F.lit(False)))
    counts = {r[0]: r[1] for r in learned.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the column {lang_col} holds something else")
    h = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"), F.col(text_col))
    start = F.pmod(F.shiftright(h, 7), F.greatest(F.length(text_col) - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    share, found = {lang: min(1.0, (2 * per_lang + 64) / n) for lang, n in counts.items()}, {}
    while share:
        limits = {lang: int(-(2**63) + x * (2**64 - 1)) if x < 1 else 2**63 - 1 for lang, x in share.items()}
        limit = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
        rows = learned.where(h <= F.try_element_at(limit, F.col(lang_col))).select(
            F.col(lang_col).alias("lang"), h.alias("h"), F.substring(F.col(text_col), start, F.lit(EXCERPT)).cast("binary").alias("x")
        ).groupBy("lang", "h").agg(F.min("x").alias("x")).collect()  # about twice the sample
        for lang in share:
            found[lang] = sorted((r["h"], bytes(r["x"])) for r in rows if r["lang"] == lang)[:per_lang]
        share = {lang: min(1.0, x * (2 * per_lang + 64) / (len(found[lang]) + 1)) for lang, x in share.items() if len(found[lang]) < per_lang and x < 1}
    return [(lang, x) for lang in sorted(counts) for _, x in found[lang]]


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict | None:
    """{"langs", "weights"} learned from the labelled rows of ``docs``; None without any."""
    rows = sample(docs, id_col, text_col, lang_col)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    labels = np.array([langs.index(lang) for lang, _ in rows])
    return {"langs": langs, "weights": train([x for _, x in rows], labels, len(langs))}


def predict(docs: DataFrame, model: dict | None, text_col="text", keep=(), out="_lang") -> DataFrame:
    """The columns ``keep`` and a struct ``out`` of lang_pred and score. Only the text's bytes go
    through Python; other columns, whatever their names, stay where they are."""
    t = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    if model is None:
        return docs.select(*keep, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, w = shared.value["langs"], shared.value["weights"]
        for texts in batches:
            names, scores = [], []
            for i in range(0, len(texts), STEP):
                some = [b"" if t is None else bytes(t) for t in texts.iloc[i : i + STEP]]
                p = pool(w, some)
                best = p.argmax(axis=1)
                names += [langs[k] if t else UNKNOWN for t, k in zip(some, best, strict=True)]
                scores += [min(1.0, max(0.0, float(x[k]))) if t else 0.0 for t, k, x in zip(some, best, p, strict=True)]
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})
        trim()

    return docs.select(*keep, label(t).alias(out))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4, 2)
    model = fit(docs.where(~held))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "_lang.lang_pred", "_lang.score")

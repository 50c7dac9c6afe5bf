"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the identity. The
score is the logistic of the difference of the two log densities (with the class shares), each from the Mahalanobis distance
by a Cholesky factor that is computed once per fit. The sums behind means and covariances come from all labelled rows.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom.llm.tables import Scratch
from studyloom.llm.words import groups, owners, word_hashes

NAMES = ("log_bytes", "upper", "bang", "bar", "symbol", "digit", "stop", "newline", "space", "word_len", "distinct", "repeat")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*<>@^~=+_{}[]\\/", "digit": b"0123456789",
            "stop": b".,;:", "newline": b"\n", "space": b" \t"}


def statistics(texts):
    """Matrix of the statistics NAMES, one row per text (whole texts; NULL or empty: zero counts)."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(NAMES)))
    for first, folded in groups(texts):
        n = len(folded)
        raw = [t.encode() for t in texts[first:first + n]]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        size = np.fromiter(map(len, raw), np.int64, n)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        rate = np.maximum(size, 1)
        o = out[first:first + n]
        o[:, 0] = np.log1p(size)
        for c, name in enumerate(NAMES[1:9], 1):
            member = np.zeros(256, np.int64)
            member[list(_CLASSES[name])] = 1
            got = np.add.reduceat(member[data], begin) - (name == "newline")  # the byte that ends each text
            o[:, c] = np.log(got / rate + 1e-3)
        h, offs = word_hashes(folded)
        words = np.diff(offs)
        o[:, 9] = np.log1p(size / np.maximum(words, 1))
        own = owners(offs)
        if len(h):
            order = np.lexsort((h, own))
            hs, os_ = h[order], own[order]
            new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])])
            distinct = np.bincount(os_[new], minlength=n)
            again = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=n)
        else:
            distinct = again = np.zeros(n)
        o[:, 10] = np.log(distinct / np.maximum(words, 1) + 1e-2)
        o[:, 11] = np.log(again / np.maximum(words, 1) + 1e-3)
    return out


def fit(n, total, square, to_pool=0.1, to_identity=0.01):
    """Model from each class's row count, sum vector and sum of outer products; None when a class has no row.

    Covariance of a class = (1 - to_pool - to_identity) own + to_pool pooled + to_identity mean variance * identity.
    """
    if min(n) < 1:
        return None
    mean = [total[c] / n[c] for c in (0, 1)]
    own = [square[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pool = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    d = len(mean[0])
    model = []
    for c in (0, 1):
        cov = (1 - to_pool - to_identity) * own[c] + to_pool * pool + to_identity * (np.trace(pool) / d + 1e-6) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        model.append((mean[c], np.linalg.inv(chol), float(-np.log(np.diag(chol)).sum() + np.log(n[c] / sum(n)))))
    return model


def score(model, x):
    """Chance of label 1 for each row of statistics; 0.5 without a model."""
    if model is None:
        return np.full(len(x), 0.5)
    log = [k - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, k in model]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _class_sums(rows, d):
    """Counts, sums and outer-product sums by class, added up in Spark from one partial matrix per batch."""
    def part(frames):
        for pdf in frames:
            for y in (0, 1):
                x = np.array(list(pdf["f"][pdf["y"] == y]), float).reshape(-1, d)
                x = np.column_stack([np.ones(len(x)), x])
                m = (x.T @ x)[np.triu_indices(d + 1)]
                yield pd.DataFrame({"y": y, "i": np.arange(len(m)), "v": m})
    got = rows.mapInPandas(part, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 x (d+1)(d+2)/2 numbers
    out = []
    for y in (0, 1):
        m = np.zeros((d + 1, d + 1))
        tri = np.triu_indices(d + 1)
        for r in got:
            if r.y == y:
                m[tri[0][r.i], tri[1][r.i]] = m[tri[1][r.i], tri[0][r.i]] = r.v
        out.append((m[0, 0], m[0, 1:], m[1:, 1:]))
    return zip(*out)


def classify(spark, docs, labels, id_col, text_col, label_col, train, to_pool=0.1, to_identity=0.01):
    """(id, held_out, score, predicted) of every document. ``train`` is a boolean column over ``docs``.

    Labels: 1 or 0 per id (several rows of an id: the majority, a tie is 1; NULL ids or labels are ignored). Repeated
    documents are scored each. Without labelled rows of both classes every score is 0.5.
    """
    def measure(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "train": pdf["train"], "f": list(statistics(pdf["text"]))})
    tables = Scratch(spark)
    feats = tables.keep(docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
                        .mapInPandas(measure, "id string, train boolean, f array<double>").withColumn("id", F.col("id").cast("bigint")))
    truth = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id"))
             .agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y")))
    n, total, square = _class_sums(feats.where("train").join(truth, "id").select("y", "f"), len(NAMES))
    model = fit(n, total, square, to_pool, to_identity)

    def judge(frames):
        for pdf in frames:
            s = score(model, np.array(list(pdf["f"]), float).reshape(-1, len(NAMES)))
            yield pd.DataFrame({"doc_id": pdf["id"], "held_out": ~pdf["train"].astype(bool), "score": s, "predicted": (s >= 0.5).astype(np.int32)})
    return (feats.withColumn("id", F.col("id").cast("string")).mapInPandas(judge, "doc_id string, held_out boolean, score double, predicted int")
            .withColumn("doc_id", F.col("doc_id").cast("bigint")))
